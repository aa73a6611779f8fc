"""Document fingerprints: one-permutation MinHash with optimal densification and b-bit storage, by column expressions only.

A text's words are hashed once, and each window of five words gets one 64-bit
hash from its words' hashes. Its upper bits choose one of ``bins`` bins, which
keeps its least hash. An empty bin b takes the value of the first bin that
isn't empty in its own order of probes, (c_b + t * a_b) mod bins for t = 0, 1,
..., a permutation of the bins as a_b is odd and ``bins`` a power of two
(densification as of Shrivastava 2017). Of each value the low ``BITS`` bits are
stored; as two different values agree in these with probability 2**-BITS,
likeness = (agreeing share - 2**-BITS) / (1 - 2**-BITS), at least 0.

Defined cases: null is the empty text; a text with fewer than five words has
one shingle, its whole sequence of words; one without words has an empty
fingerprint, which is like another empty one with 1 and like any other with 0.
Documents follow each other by (doc_id, text), nulls first; after the last
comes the first; an only document follows itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._cluster import columns_of, table
from ._runs import LEAST, longs, place, run_of

SIZE, BITS, FIRST_TRIES = 5, 8, 12


def with_signature(df: DataFrame, text: str, out: str, bins: int = 256) -> DataFrame:
    """``df`` with a column ``out``: array<tinyint> of ``bins`` stored values; empty for a text without words."""
    shift = 64 - (bins.bit_length() - 1)
    if bins & (bins - 1):
        raise ValueError("bins must be a power of two")
    last = [(b - bins // 2 << shift) + (1 << shift) - 1 for b in range(bins)]
    none = F.split(F.lit(",".join(map(str, last))), ",").cast("array<long>")
    words, count, hashes, places, dense = (f"_{out}_{x}" for x in ("words", "count", "hashes", "places", "dense"))
    keep = df.columns
    df = df.select(*keep, F.transform(F.filter(F.split(F.coalesce(F.col(text), F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != ""), lambda w: F.xxhash64(w)).alias(words))
    n, h = F.size(words), F.col(words)
    windows = F.transform(F.sequence(F.lit(0), n - SIZE), lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(SIZE)]))
    shingles = F.when(n >= SIZE, windows).otherwise(F.array(F.xxhash64(h)))
    # the largest hash of each bin stands for "empty": after sorting, the first of each bin is its least or that
    df = df.select(*keep, n.alias(count), F.sort_array(F.concat(shingles, none)).alias(hashes))
    s = F.col(hashes)
    firsts = F.filter(s, lambda x, i: (i == 0) | (F.shiftright(x, shift) != F.shiftright(F.get(s, i - 1), shift)))
    df = df.select(*keep, F.when(F.col(count) > 0, firsts).alias(places))
    d, low = F.col(places), (1 << shift) - 1
    is_none = lambda x: x.bitwiseAND(low) == low

    def probe(b: Column, t: Column | int) -> Column:
        seed = F.xxhash64(b)
        a, c = seed.bitwiseOR(F.lit(1)), F.shiftright(seed, 32)
        return F.get(d, F.pmod(c + a.bitwiseAND(0xFFFF) * t, F.lit(bins)).cast("int"))

    def dense_value(x: Column, b: Column) -> Column:
        tries = [F.when(~is_none(probe(b, t)), probe(b, t)) for t in range(FIRST_TRIES)]
        rest = F.get(F.filter(F.transform(F.sequence(F.lit(FIRST_TRIES), F.lit(bins - 1)), lambda t: probe(b, t)), lambda v: ~is_none(v)), F.lit(0))
        return F.when(~is_none(x), x).otherwise(F.coalesce(*tries, rest))

    df = df.select(*keep, F.transform(d, dense_value).alias(dense))
    stored = F.transform(dense, lambda v: F.shiftright(F.shiftleft(v, 64 - BITS), 64 - BITS).cast("tinyint"))
    return df.select(*keep, F.coalesce(stored, F.array().cast("array<tinyint>")).alias(out))


def packed(signature: str) -> Column:
    """The stored values, one after the other, in hexadecimal."""
    return F.lower(F.array_join(F.transform(signature, lambda v: F.lpad(F.hex(v.cast("int").bitwiseAND(255)), 2, "0")), ""))


def likeness(one: str, two: str) -> Column:
    """The estimated similarity of the sets behind two signatures, bias of the stored bits taken out."""
    same = F.size(F.filter(F.zip_with(one, two, lambda x, y: x == y), lambda x: x))
    share, chance = same / F.size(one), 2.0**-BITS
    both = (F.size(one) > 0) & (F.size(two) > 0)
    neither = (F.size(one) == 0) & (F.size(two) == 0)
    return F.when(both, F.greatest(F.lit(0.0), (share - chance) / (1 - chance))).when(neither, 1.0).otherwise(0.0)


def followed(docs: DataFrame, rows: int = 1000, most: int = 1 << 15) -> tuple[DataFrame, Window]:
    """``docs`` (doc_id, text) dealt into runs of about ``rows`` neighbouring ids, and the window that has each row's follower next.

    One pass over the ids finds the runs' bounds (at most ``most``) and least
    ids; then each run's first row is also sent, as a guest after all others,
    to the run before. Rows with ``guest`` = 1 only serve as followers.
    """
    ids = docs.select(place().alias("at"))
    run, size = run_of(ids, "at", rows, most)
    first = {r["run"]: r["least"] for r in ids.groupBy(run.alias("run")).agg(F.min("at").alias("least")).collect()}
    order = sorted(first)
    before = {r: order[i - 1] for i, r in enumerate(order)}
    least_of = longs([first.get(r, LEAST) for r in range(size)])
    before_of = longs([before.get(r, 0) for r in range(size)]).cast("array<int>")
    dealt = docs.select("doc_id", "text", place().alias("at")).select("*", run.alias("run"))
    own = F.struct("run", F.lit(0).alias("guest"))
    sent = F.when(F.col("at") == F.get(least_of, F.col("run")), F.array(own, F.struct(F.get(before_of, F.col("run")).alias("run"), F.lit(1).alias("guest")))).otherwise(F.array(own))
    return dealt.select("doc_id", "text", "at", F.explode(sent).alias("to")).select("doc_id", "text", "at", "to.run", "to.guest"), Window.partitionBy("run").orderBy("guest", "at", "text")


def fingerprints(docs: DataFrame, bins: int = 256) -> DataFrame:
    """One row for each of ``docs`` (doc_id, text); see the contract of op3 for its columns."""
    docs = columns_of(docs, {"doc_id": "long", "text": "string"}).withColumn("text", F.coalesce("text", F.lit("")))
    rows, window = followed(docs)
    rows = rows.withColumn("next", F.coalesce(F.lead("text").over(window), F.lit("")))
    rows = with_signature(rows, "text", "own", bins)
    rows = rows.withColumn("following", F.lead("own").over(window)).filter("guest = 0")
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - half), F.substring(F.col("next"), F.lit(1), half))
    rows = rows.select("doc_id", n.cast("long").alias("n_chars"), edited.alias("edited"), "own", "following")
    rows = with_signature(rows, "edited", "changed", bins)
    return rows.select(
        "doc_id",
        "n_chars",
        F.sha2(F.encode("edited", "UTF-8"), 256).alias("edited_sha256"),
        packed("own").alias("fingerprint"),
        packed("changed").alias("edited_fingerprint"),
        likeness("own", "changed").alias("near_edited"),
        likeness("own", "following").alias("near_next"),
    )


def op3_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(table(spark, sf_dir, "documents"))
