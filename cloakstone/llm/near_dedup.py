"""Near duplicates by SuperMinHash signatures, banding, verification and union-find.

1. One pass over the texts: a document's set of distinct five-word shingles
   (as 64-bit hashes), its size, a 128-bit fingerprint of the set and its
   SuperMinHash signature, cut into bands.
2. Documents with equal sets fall to one representative, by a grouping that
   combines before it shuffles. Only representatives go on.
3. Banding: representatives that share a band's bucket are candidates. Rather
   than all pairs of a bucket, each member is paired with the bucket's first
   member, and verified on the full sets; links are unioned. Then, for ``rounds``
   rounds, members that aren't in the component of the bucket's main part are
   paired with another member of that part. What still isn't linked then is
   paired with every other member of its buckets that lies in another
   component, in buckets of at most ``direct`` members; in larger ones by prefix
   filtering, which is exact: two sets that are similar enough share one of
   their rarest few elements, so only members that do are paired. So every pair
   of a bucket is verified, joined by verified links, or known to be too far.
4. Union-find by large-star and small-star steps on tables, to the smallest id.

A true link is missed only if no band agrees: with 30 bands of 6 rows and a
similarity of 0.85 that has probability 7e-7 or less.

Defined cases: null, empty and blank texts have an empty set and are linked
with nothing, their component being their doc_id; a text of fewer than five
words is one shingle; all other rows of a doc_id are one document, linked by
any of its texts, and share one component; rows with a null doc_id form no links and are
their own component (null), kept; an empty table gives an empty result; other
columns are ignored, whatever their names; a text of any length is one set.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._cluster import columns_of, stored, table
from ._words import GOLD, U, batch_of, blocks, mix, shingles_of, words_of

SIZE = 5
#: Counters of elements, by value, that order them by rarity.
SLOTS = 1 << 20


def distinct_shingles(doc: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(doc, hash) pairs without repeats, by doc and hash."""
    order = np.lexsort((value, doc))
    doc, value = doc[order], value[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (value[1:] != value[:-1])
    return doc[new], value[new]


def super_min_hash(doc: np.ndarray, value: np.ndarray, n_docs: int, size: int) -> np.ndarray:
    """The SuperMinHash signatures (n_docs x size, uint64) of sets given as (doc, hash), by doc.

    Each element deals its values r + 0, r + 1, ... to the places of a random
    permutation that is made step by step (Fisher-Yates); a place keeps its
    least value. All elements of all sets take step j together. After it, a
    set whose places are all filled is done: later values are at least j + 1.
    """
    out = np.full(n_docs * size, ~U(0))
    filled = np.zeros(n_docs, np.int64)
    alive = np.arange(len(doc))
    moved = np.zeros((0, size), np.uint16)
    with np.errstate(over="ignore"):
        for j in range(size):
            if not len(alive):
                break
            d = doc[alive]
            draw = mix(value[alive] + U(j + 1) * GOLD)
            k = j + ((draw & U(0xFFFFFFFF)) * U(size - j) >> U(32)).astype(np.int64)
            if j == 0:
                place = k
            else:
                rows = np.arange(len(alive))
                place = moved[rows, k].astype(np.int64)
                moved[rows, k] = moved[rows, j]
            # the value: step number, then 48 random bits; ties between elements of one set don't matter
            v = (U(j) << U(48)) | (draw >> U(32)) << U(16) | (draw & U(0xFFFF))
            at = d * size + place
            order = np.lexsort((v, at))
            first = np.ones(len(order), bool)
            first[1:] = at[order[1:]] != at[order[:-1]]
            best = order[first]
            places = at[best]
            fresh = out[places] == ~U(0)
            out[places] = np.minimum(out[places], v[best])
            filled += np.bincount(places[fresh] // size, minlength=n_docs)
            keep = filled[d] < size
            if j == 0:
                alive = alive[keep]
                moved = np.tile(np.arange(size, dtype=np.uint16), (len(alive), 1))
                rows, k = np.arange(len(alive)), k[keep]
                moved[rows, k] = 0
            else:
                alive, moved = alive[keep], moved[keep]
    return out.reshape(n_docs, size)


def prints(doc: np.ndarray, value: np.ndarray, n_docs: int) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit fingerprints of each set."""
    count = np.bincount(doc, minlength=n_docs)
    one, two = np.zeros(n_docs, U), np.zeros(n_docs, U)
    at = np.flatnonzero(count)
    with np.errstate(over="ignore"):
        if len(at):
            first = (np.cumsum(count) - count)[at]
            one[at] = np.add.reduceat(mix(value), first)
            two[at] = np.add.reduceat(mix(value ^ GOLD), first)
    return one, two


def set_facts(doc: np.ndarray, value: np.ndarray, n_docs: int, bands: int, rows: int) -> tuple[np.ndarray, ...]:
    """Of each set: size, two 64-bit fingerprints, band hashes (n_docs x bands)."""
    count = np.bincount(doc, minlength=n_docs)
    one, two = prints(doc, value, n_docs)
    signature = np.zeros((n_docs, bands * rows), U)
    with np.errstate(over="ignore"):
        # sets in runs of about 60,000 elements, so that the permutations fit in memory
        ends = np.cumsum(count)
        i = 0
        while i < n_docs:
            j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + 60_000, "right")))
            lo, hi = (ends[i - 1] if i else 0), ends[j - 1]
            signature[i:j] = super_min_hash(doc[lo:hi] - i, value[lo:hi], j - i, bands * rows)
            i = j
        h = np.tile(np.arange(1, bands + 1, dtype=U) * GOLD, (n_docs, 1))
        for r in range(rows):
            h = mix(h + signature[:, r::rows])
    return count, one, two, h


def sketch(docs: DataFrame, bands: int, rows: int) -> DataFrame:
    """doc_id, n (set size), one, two (fingerprints), buckets (array, empty for empty sets)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in blocks(batches, limit=1 << 20):
            n_docs = batch.num_rows
            doc, value = distinct_shingles(*shingles_of(words_of(texts, lower=True), n_docs, SIZE))
            count, one, two, h = set_facts(doc, value, n_docs, bands, rows)
            some = count > 0
            at = np.concatenate([[0], np.cumsum(some * bands)]).astype(np.int32)
            buckets = pa.ListArray.from_arrays(pa.array(at), pa.array(h[some].reshape(-1).view(np.int64)))
            yield batch_of(doc_id=batch.column("doc_id"), n=count.astype(np.int64), one=one.view(np.int64), two=two.view(np.int64), buckets=buckets)

    return docs.mapInArrow(run, "doc_id long, n long, one long, two long, buckets array<long>")


def sets_of(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """id, elements (binary: the sorted distinct shingle hashes) for the sets of ``wanted`` (id, one, two, doc_id: a document that has it)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in blocks(batches, limit=1 << 20):
            n = batch.num_rows
            doc, value = distinct_shingles(*shingles_of(words_of(texts, lower=True), n, SIZE))
            one, two = prints(doc, value, n)
            at = np.concatenate([[0], np.cumsum(np.bincount(doc, minlength=n))])
            yield batch_of(one=one.view(np.int64), two=two.view(np.int64), elements=pa.array([value[at[i] : at[i + 1]].tobytes() for i in range(n)], pa.binary()))

    texts = docs.join(wanted.select("doc_id").distinct(), "doc_id", "left_semi").select("text")
    found = texts.mapInArrow(run, "one long, two long, elements binary").join(wanted.select("id", "one", "two"), ["one", "two"])
    # a document may have several texts, and one of them may be another wanted set
    return found.select("id", "elements").dropDuplicates(["id"])


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets x, y have 100 * |x and y| >= percent * |x or y|."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = batch.column("x").to_pylist(), batch.column("y").to_pylist()
            good = []
            for p, q in zip(x, y, strict=True):
                p, q = np.frombuffer(p, U), np.frombuffer(q, U)
                i = np.minimum(np.searchsorted(p, q), len(p) - 1)
                both = int((p[i] == q).sum())
                good.append(100 * both >= percent * (len(p) + len(q) - both))
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    x = sets.select(F.col("id").alias("a"), F.col("elements").alias("x"))
    y = sets.select(F.col("id").alias("b"), F.col("elements").alias("y"))
    return pairs.join(x, "a").join(y, "b").select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """id, component (the smallest id reachable) for each id in ``links`` (a, b), by alternating large-star and small-star steps."""
    edges = stored(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(), "edges")
    mark = None
    while True:
        both = edges.union(edges.select("v", "u"))
        # large star: each node's larger neighbours go to the least of it and its neighbours
        least = both.groupBy("u").agg(F.min("v").alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.least("m", "u").alias("v"))
        # small star: each node's smaller neighbours, and itself, go to the least of them
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        edges = stored(large.join(low, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")).filter("u <> v").distinct(), "edges")
        # the same edges as before: each goes to a node that has no smaller neighbour
        before, mark = mark, edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")), F.sum(F.xxhash64("v", "u").cast("decimal(20,0)"))).first()
        if mark == before:
            break
    return edges.select(F.col("u").alias("id"), F.col("v").alias("component")).union(edges.select("v", "v").distinct())


def rare_elements(live: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """id, n, component, apart, place, element for the elements of each set by which a similar enough set must meet it.

    Of a set of n, these are the first n - ceil(n * percent / 100) + 1 in one order of all elements; place: how many of the
    set's elements come before. Any order gives the same links; that of ``SLOTS`` counters, rare ones first, by which an
    element is about as rare as its counter says, gives few meetings. The counters are one bounded table.
    """
    given = stored(live.join(sets, "id").select("id", "n", "component", "apart", "elements"), "given")

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(SLOTS, np.int64)
        for batch in batches:
            for x in batch.column("elements").to_pylist():
                np.add.at(counts, np.frombuffer(x, U) % U(SLOTS), 1)
        some = np.flatnonzero(counts)
        yield batch_of(slot=some.astype(np.int64), n=counts[some])

    found = given.select("elements").mapInArrow(tally, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(SLOTS, np.int64)
    counts[found.column("slot").to_numpy()] = found.column("n").to_numpy()
    shared = given.sparkSession.sparkContext.broadcast(counts)

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 200):
                part = batch.slice(i, 200)
                kept = []
                for x in part.column("elements").to_pylist():
                    value = np.frombuffer(x, U)
                    order = np.lexsort((value, shared.value[value % U(SLOTS)]))
                    kept.append(value[order[: len(value) + 1 - -(-len(value) * percent // 100)]].view(np.int64))
                at = np.repeat(np.arange(len(kept)), [len(x) for x in kept])
                place = np.concatenate([np.arange(len(x), dtype=np.int32) for x in kept])
                yield pa.RecordBatch.from_arrays([*(part.column(c).take(pa.array(at)) for c in ("id", "n", "component", "apart")), pa.array(place), pa.array(np.concatenate(kept))], names=["id", "n", "component", "apart", "place", "element"])

    return given.mapInArrow(first, "id long, n long, component long, apart boolean, place int, element long")


def link_buckets(members: DataFrame, sets: DataFrame, percent: int, rounds: int, direct: int = 64) -> DataFrame:
    """id, component for the ids of ``members`` (bucket, id, n) that have verified links."""
    close = (100 * F.least("n", "m") >= percent * F.greatest("n", "m")) & (F.col("id") != F.col("other"))
    ordered = [F.least("id", "other").alias("a"), F.greatest("id", "other").alias("b")]
    first = members.groupBy("bucket").agg(F.min(F.struct("id", "n")).alias("f")).select("bucket", F.col("f.id").alias("other"), F.col("f.n").alias("m"))
    tried = stored(members.join(first, "bucket").filter(close).select(*ordered).distinct(), "tried")
    found = stored(components(verified(tried, sets, percent)), "components")
    for turn in range(rounds + 1):
        labelled = members.join(found, "id", "left").select("bucket", "id", "n", F.coalesce("component", "id").alias("component"))
        parts = labelled.groupBy("bucket", "component").agg(F.count("*").alias("size"))
        main = parts.groupBy("bucket").agg(F.max_by("component", F.struct("size", "component")).alias("main"), F.sum("size").alias("size"), F.count("*").alias("parts")).filter("parts > 1").select("bucket", "main", "size")
        live = stored(labelled.join(main, "bucket"), "live")
        apart = live.filter("component <> main")
        if turn < rounds:
            # each member outside the main part meets one member of it, another in each round
            one = live.filter("component = main").groupBy("bucket").agg(F.min_by(F.struct("id", "n"), F.xxhash64("id", "bucket", F.lit(turn))).alias("f"))
            pairs = apart.join(one, "bucket").select("id", "n", F.col("f.id").alias("other"), F.col("f.n").alias("m"))
        else:
            others = live.filter(F.col("size") <= direct).select("bucket", F.col("id").alias("other"), F.col("n").alias("m"), F.col("component").alias("theirs"))
            pairs = apart.join(others, "bucket").filter("component <> theirs").select("id", "n", "other", "m")
            large = live.filter(F.col("size") > direct).groupBy("id", "n", "component").agg(F.max(F.col("component") != F.col("main")).alias("apart"))
            rare = stored(rare_elements(large, sets, percent), "rare")
            mates = rare.select(F.col("element").alias("shared"), F.col("id").alias("other"), F.col("n").alias("m"), F.col("component").alias("theirs"), F.col("place").alias("there"))
            # by the first element that two sets share, what follows in both bounds what else they can share
            enough = (100 + percent) * (1 + F.least(F.col("n") - 1 - F.col("place"), F.col("m") - 1 - F.col("there"))) >= percent * (F.col("n") + F.col("m"))
            met = rare.filter("apart").join(mates, (F.col("element") == F.col("shared")) & (F.col("component") != F.col("theirs")) & enough & close).select("id", "n", "other", "m")
            pairs = pairs.union(met)
        new = stored(pairs.filter(close).select(*ordered).distinct().join(tried, ["a", "b"], "left_anti"), "pairs")
        if new.isEmpty():
            if turn < rounds and not apart.isEmpty():
                continue
            return found
        # what is known of the components stands for the links so far
        links = verified(new, sets, percent).union(found.select("id", "component"))
        tried, found = tried.union(new), stored(components(links), "components")
    return found


def near_duplicates(docs: DataFrame, percent: int = 85, bands: int = 30, rows: int = 6, rounds: int = 1) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each row of ``docs`` (doc_id, text)."""
    docs = columns_of(docs, {"doc_id": "long", "text": "string"})
    # a set's id is the number of one of the rows that have it: unlike a doc_id, it tells sets apart
    facts = stored(sketch(docs, bands, rows).withColumn("row", F.monotonically_increasing_id()), "sketches")
    some = facts.filter("n > 0 AND doc_id IS NOT NULL")
    # of each set: one row's number and buckets, and the least document that has it
    classes = stored(some.groupBy("one", "two").agg(F.min("row").alias("id"), F.min("n").alias("n"), F.min("doc_id").alias("doc_id"), F.min_by("buckets", "row").alias("buckets")), "classes")
    leads = classes.select("id", "n", F.explode(F.array_distinct("buckets")).alias("bucket"))
    full = leads.groupBy("bucket").agg(F.count("*").alias("size")).filter("size > 1").select("bucket")
    members = stored(leads.join(full, "bucket").select("bucket", "id", "n"), "members")
    sets = stored(sets_of(docs, classes.select("one", "two", "id", "doc_id").join(members.select("id").distinct(), "id", "left_semi")), "sets")
    found = link_buckets(members, sets, percent, rounds)
    # documents with several sets
    prints_ = F.struct("one", "two")
    several = stored(some.groupBy("doc_id").agg(F.min(prints_).alias("a"), F.max(prints_).alias("z")).filter("a <> z").select("doc_id", "a"), "several")
    if not several.isEmpty():
        named = some.select("doc_id", "one", "two").join(several, "doc_id").filter(prints_ != F.col("a")).select("a.*", F.col("one").alias("one2"), F.col("two").alias("two2")).distinct()
        ids = classes.select("one", "two", "id")
        same = named.join(ids.withColumnRenamed("id", "a"), ["one", "two"]).join(ids.select(F.col("one").alias("one2"), F.col("two").alias("two2"), F.col("id").alias("b")), ["one2", "two2"]).select("a", "b")
        found = stored(components(found.select(F.col("id").alias("a"), F.col("component").alias("b")).union(same)), "components")
    own = stored(classes.select("one", "two", "doc_id", "id").join(found, "id", "left").select("one", "two", "doc_id", F.coalesce("component", "id").alias("component")), "own")
    least = own.groupBy("component").agg(F.min("doc_id").alias("least"))
    named = stored(own.join(least, "component").select("one", "two", "least"), "named")
    out = facts.select("doc_id", "n", "one", "two").join(named, ["one", "two"], "left")
    component = F.when((F.col("n") > 0) & F.col("doc_id").isNotNull(), F.col("least")).otherwise(F.col("doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def op5_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
