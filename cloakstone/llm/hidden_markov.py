"""Scoring with a hidden Markov language model.

Tokens are lower-cased words and one end a text. The states emit symbols:
words that make up at least 1 / ``symbols`` of the training tokens are symbols
of their own (so at most that many), the others share ``classes`` symbols by
their last two bytes; within its class a word has probability
(c + 0.5) / (the class's sum of c + 0.5, plus 0.5), c its training count.

Training starts from a model that is counted over all training texts: how often
each of the ``seen`` most frequent symbols follows each other gives every one a
profile of neighbours, profiles are grouped into as many clusters as there are
states (a projection by singular vectors, then k-means), and a state emits its
cluster's symbols, moves as clusters follow each other, and shares all other
symbols. Then rounds of Baum-Welch go over all training texts, whose expected
counts are added up in each partition and then across partitions by symbol,
until a round raises the log likelihood by less than ``tolerance`` of itself. A
text of more than ``span`` tokens is trained as several sequences of that size,
which bounds memory; shorter ones are whole. Scoring is the scaled forward
recursion over the whole text, exactly.

A text's token counts come from a table of words that make up at least
1 / ``common`` of the training tokens (at most that many, broadcast), and for
its other words from a join; words no one has seen in training count 0.

Defined cases: null texts are empty, with the end as their only token; a null
doc_id counts as the empty string where texts are held out; rows that repeat a doc_id are each scored; without training texts every state
and symbol is alike; an empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._cluster import columns_of, stored, table
from ._words import LOWER, Counter, Texts, U, Words, batch_of, blocks, look_up, words_of

END_HASH = np.int64(-1)
#: Texts of more tokens than this are long.
LONG = 2048


class Vocabulary(NamedTuple):
    """common words (sorted hashes) with counts; symbols among them (sorted hashes, their numbers by place); class sums; totals."""

    common: np.ndarray
    counts: np.ndarray
    symbols: np.ndarray
    classes: int
    class_log: np.ndarray
    """log10 of each class's sum."""
    total: int
    distinct: int

    @property
    def size(self) -> int:
        return self.classes + len(self.symbols)


class Model(NamedTuple):
    start: np.ndarray
    move: np.ndarray
    emit: np.ndarray
    """states x symbols"""


def classes_of(texts: Texts, words: Words, classes: int) -> np.ndarray:
    """A word's class by its last two bytes, lower-cased."""
    one = LOWER[texts.data[words.end - 1]].astype(np.int64)
    two = np.where(words.end - words.start > 1, LOWER[texts.data[words.end - 2]], 0).astype(np.int64)
    return (one * 31 + two * 7) % classes


def held_out(doc_ids: list) -> np.ndarray:
    return np.array([zlib.crc32(b"" if i is None else str(i).encode()) % 5 == 1 for i in doc_ids], bool)


def tokens_of(texts: Texts, classes: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, hash, class) of each token in order, each text's end (class -1) after its words."""
    words = words_of(texts, lower=True)
    n = len(texts.at) - 1
    doc = np.concatenate([words.doc, np.arange(n)])
    order = np.argsort(doc, kind="stable")
    hashes = np.concatenate([words.hash.view(np.int64), np.full(n, END_HASH)])[order]
    kind = np.concatenate([classes_of(texts, words, classes), np.full(n, -1, np.int64)])[order]
    return doc[order], hashes, kind


def count_tokens(docs: DataFrame, classes: int) -> DataFrame:
    """hash, class, n over the training texts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter, kinds = Counter(), {}
        for batch, texts in blocks(batches):
            train = ~held_out(batch.column("doc_id").to_pylist())
            doc, hashes, kind = tokens_of(texts, classes)
            use = train[doc]
            # the class rides in the low bits of the key that is counted
            key = (hashes[use].view(U) >> U(10) << U(10)) | (kind[use] + 1).astype(U)
            for k, n in counter.add(key):
                yield batch_of(key=k.view(np.int64), n=n.astype(np.int64))
        for k, n in counter.rest():
            yield batch_of(key=k.view(np.int64), n=n.astype(np.int64))

    return docs.mapInArrow(count, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))


def keys_of(hashes: np.ndarray, kind: np.ndarray) -> np.ndarray:
    return ((hashes.view(U) >> U(10) << U(10)) | (kind + 1).astype(U)).view(np.int64)


def vocabulary(counted: DataFrame, classes: int, common: int, symbols: int) -> Vocabulary:
    facts = counted.agg(F.sum("n").alias("total"), F.count("*").alias("distinct")).first()
    total, distinct = facts["total"] or 0, facts["distinct"]
    top = counted.filter((F.col("n") >= max(1, -(-total // common))) | (F.col("key").bitwiseAND(1023) == 0)).toPandas().sort_values("key")
    keys, counts = top["key"].to_numpy(np.int64), top["n"].to_numpy(np.int64)
    kind = F.col("key").bitwiseAND(1023)
    end = (keys & 1023) == 0
    own = (counts >= max(1, -(-total // symbols))) | end
    # classes hold every word that isn't a symbol of its own
    sums = np.full(classes, 0.5)
    rest = counted.filter((F.col("n") < max(1, -(-total // symbols))) & (kind > 0)).groupBy(kind.alias("kind")).agg(F.sum(F.col("n") + 0.5).alias("x")).collect()
    for r in rest:
        sums[r["kind"] - 1] += r["x"]
    return Vocabulary(keys, counts, keys[own], classes, np.log10(sums), total, distinct)


def encode(docs: DataFrame, v: Vocabulary) -> DataFrame:
    """row, doc_id, held_out, n_tokens, symbols (binary: little-endian unsigned 32 bits), what common words give, the rare words with their counts."""
    shared = docs.sparkSession.sparkContext.broadcast(v)
    base = "common_known long, common_base double, common_word double, rare_class double, n_rare long, rare array<long>, rare_n array<int>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = shared.value
        own = look_up(v.symbols, v.common)[1]
        logs = np.log10(v.counts + 0.5)
        for batch, texts in blocks(batches):
            n = batch.num_rows
            doc, hashes, kind = tokens_of(texts, v.classes)
            key = keys_of(hashes, kind)
            i, is_common = look_up(v.common, key)
            j, is_own = look_up(v.symbols, key)
            symbol = np.where(is_own, j + v.classes, np.maximum(kind, 0)).astype("<u4")
            log = np.where(is_common, logs[i] if len(logs) else 0.0, 0.0)
            in_class = ~is_own & (kind >= 0)
            add = lambda w: np.bincount(doc, w, minlength=n)
            rare = np.flatnonzero(~is_common)
            # distinct (text, key) pairs of the rare words
            order = rare[np.lexsort((key[rare], doc[rare]))]
            new = np.ones(len(order), bool)
            new[1:] = (key[order[1:]] != key[order[:-1]]) | (doc[order[1:]] != doc[order[:-1]])
            at = np.flatnonzero(new)
            times = np.diff(np.append(at, len(order))).astype(np.int32)
            offsets = np.concatenate([[0], np.cumsum(np.bincount(doc[order[at]], minlength=n))]).astype(np.int32)
            count = np.bincount(doc, minlength=n)
            ends = np.cumsum(count)
            raw = symbol.tobytes()
            yield batch_of(
                doc_id=batch.column("doc_id"),
                held_out=held_out(batch.column("doc_id").to_pylist()),
                n_tokens=count.astype(np.int64),
                symbols=pa.array([raw[4 * (e - c) : 4 * e] for e, c in zip(ends, count, strict=True)], pa.binary()),
                common_known=add(is_common).astype(np.int64),
                common_base=add(log),
                common_word=add(np.where(is_common & in_class, log, 0.0)),
                rare_class=add(np.where(in_class, v.class_log[np.maximum(kind, 0)], 0.0)),
                n_rare=add(~is_common).astype(np.int64),
                rare=pa.ListArray.from_arrays(pa.array(offsets), pa.array(key[order[at]])),
                rare_n=pa.ListArray.from_arrays(pa.array(offsets), pa.array(times)),
            )

    return docs.mapInArrow(run, f"doc_id long, held_out boolean, n_tokens long, symbols binary, {base}")


class Ragged(NamedTuple):
    """Sequences by falling length, laid out step by step: step t's entries are at[t]:at[t + 1], those of the longest sequences first."""

    order: np.ndarray
    at: np.ndarray
    symbol: np.ndarray


def by_step(sequences: list[np.ndarray]) -> Ragged:
    sizes = np.array([len(s) for s in sequences], np.int64)
    order = np.argsort(-sizes, kind="stable")
    longest = int(sizes.max(initial=0))
    # how many sequences reach step t
    active = len(sizes) - np.searchsorted(np.sort(sizes), np.arange(longest), "right")
    at = np.concatenate([[0], np.cumsum(active)])
    symbol = np.zeros(int(at[-1]), np.int64)
    for rank, i in enumerate(order):
        symbol[at[: sizes[i]] + rank] = sequences[i]
    return Ragged(order, at, symbol)


def forward(model: Model, r: Ragged, n: int) -> np.ndarray:
    """log10 likelihood of each of n sequences (0 for empty ones), by the scaled recursion; only one step is held."""
    out = np.zeros(n)
    if not len(r.symbol):
        return out
    emit = np.ascontiguousarray(model.emit.T)
    ranks = np.zeros(n)
    a = np.tile(model.start, (int(r.at[1]), 1))
    for t in range(len(r.at) - 1):
        lo, hi = r.at[t], r.at[t + 1]
        a = (a if t == 0 else a[: hi - lo] @ model.move) * emit[r.symbol[lo:hi]]
        c = a.sum(1)
        a /= c[:, None]
        ranks[: hi - lo] += np.log10(c)
    out[r.order] = ranks
    return out


def expected_counts(model: Model, r: Ragged) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Expected starts, moves and emissions (symbols x states), and the log10 likelihood."""
    k, symbols = model.emit.shape
    emit = np.ascontiguousarray(model.emit.T).astype(np.float32)
    move = model.move.astype(np.float32)
    total = len(r.symbol)
    alpha, scale = np.empty((total, k), np.float32), np.empty(total, np.float32)
    for t in range(len(r.at) - 1):
        lo, hi = r.at[t], r.at[t + 1]
        before = model.start.astype(np.float32)[None, :] if t == 0 else alpha[r.at[t - 1] : r.at[t - 1] + hi - lo] @ move
        a = before * emit[r.symbol[lo:hi]]
        c = a.sum(1)
        scale[lo:hi] = c
        np.divide(a, c[:, None], out=alpha[lo:hi])
    moves, beta = np.zeros((k, k)), np.zeros((0, k), np.float32)
    for t in range(len(r.at) - 2, -1, -1):
        lo, hi = r.at[t], r.at[t + 1]
        now = np.ones((hi - lo, k), np.float32)
        if len(beta):
            lo2, hi2 = r.at[t + 1], r.at[t + 2]
            ahead = emit[r.symbol[lo2:hi2]] * beta / scale[lo2:hi2, None]
            moves += (alpha[lo : lo + hi2 - lo2].T @ ahead) * model.move
            now[: hi2 - lo2] = ahead @ move.T
        beta = now
        alpha[lo:hi] *= beta  # the posterior of step t; step t - 1 no longer needs alpha here
    emissions = np.stack([np.bincount(r.symbol, alpha[:, s], minlength=symbols) for s in range(k)], 1)
    starts = alpha[: r.at[1]].sum(0) if total else np.zeros(k)
    return starts, moves, emissions, float(np.log10(scale).sum(dtype=np.float64))


def updated(starts: np.ndarray, moves: np.ndarray, emissions: np.ndarray, share: np.ndarray, weight: float) -> Model:
    """The next model; every emission keeps ``weight`` expected counts, dealt by the symbols' shares."""
    k = len(starts)
    emit = emissions.T + weight * share[None, :]
    return Model((starts + 0.1) / (starts.sum() + 0.1 * k), (moves + 1.0) / (moves.sum(1, keepdims=True) + k), emit / emit.sum(1, keepdims=True))


def sequences_of(raw: list[bytes], span: int) -> list[np.ndarray]:
    """The texts' symbols, cut into sequences of ``span`` at most."""
    out = []
    for x in raw:
        s = np.frombuffer(x, "<u4")
        out += [s[i : i + span] for i in range(0, len(s), span)]
    return out


def count_pairs(encoded: DataFrame, top: np.ndarray) -> np.ndarray:
    """How often each of the symbols ``top`` (sorted; the last row and column: any other) is followed by each, over all of ``encoded``."""
    shared = encoded.sparkSession.sparkContext.broadcast(top)
    size = len(top) + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(size * size, np.int64)
        for batch in batches:
            for x in batch.column("symbols").to_pylist():
                i, hit = look_up(shared.value, np.frombuffer(x, "<u4").astype(np.int64))
                n = np.where(hit, i, size - 1)
                np.add.at(table, n[:-1] * size + n[1:], 1)
        some = np.flatnonzero(table)
        yield batch_of(pair=some.astype(np.int64), n=table[some])

    found = encoded.select("symbols").mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(size * size)
    out[found["pair"].to_numpy(np.int64)] = found["n"].to_numpy(float)
    return out.reshape(size, size)


def clusters(profiles: np.ndarray, weights: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    """Each row's cluster of k: the best of ten runs of weighted k-means, from centres that lie apart."""
    best, out = np.inf, np.zeros(len(profiles), np.int64)
    for _ in range(10):
        centres = profiles[rng.choice(len(profiles), 1, p=weights / weights.sum())]
        while len(centres) < k:
            far = ((profiles[:, None] - centres[None]) ** 2).sum(2).min(1) * weights
            centres = np.concatenate([centres, profiles[[rng.choice(len(profiles), p=far / far.sum())] if far.sum() > 0 else [0]]])
        for _ in range(30):
            distance = ((profiles[:, None] - centres[None]) ** 2).sum(2)
            own = distance.argmin(1)
            for c in range(k):
                if (own == c).any():
                    centres[c] = np.average(profiles[own == c], axis=0, weights=weights[own == c])
        cost = float((distance.min(1) * weights).sum())
        if cost < best:
            best, out = cost, own
    return out


def start_model(encoded: DataFrame, v: Vocabulary, share: np.ndarray, states: int, seen: int, seed: int) -> Model:
    """The model that training starts from, counted over all of ``encoded``."""
    rng = np.random.default_rng(seed)
    top = np.sort(np.argsort(-share, kind="stable")[:seen])
    pairs = count_pairs(encoded, top)
    follow = np.sqrt(pairs[:-1] / np.maximum(pairs[:-1].sum(1, keepdims=True), 1))
    ahead = np.sqrt(pairs[:, :-1].T / np.maximum(pairs[:, :-1].sum(0)[:, None], 1))
    both = np.concatenate([follow, ahead], 1)
    left, size, _ = np.linalg.svd(both - both.mean(0), full_matrices=False)
    own = clusters((left * size)[:, :states], np.ones(len(top)), states, rng)
    member = np.full((v.size, states), 0.5 / states)
    member[top] = 0.05 / states
    member[top, own] += 0.95
    # what follows what, by clusters; other symbols belong to all alike
    by = np.concatenate([np.eye(states)[own], np.full((1, states), 1 / states)])
    moves = by.T @ pairs @ by
    # symbols that all states share alike would never be told apart
    noise = rng.uniform(0.5, 1.5, member.shape)
    return updated(np.ones(states), moves, member * noise * share[:, None] * max(1.0, pairs.sum()), share, 10.0)


def train(encoded: DataFrame, v: Vocabulary, states: int, tolerance: float, span: int, seen: int, seed: int = 11) -> Model:
    """Baum-Welch over all training texts, until a round raises their log likelihood by less than ``tolerance`` of itself."""
    share = np.full(v.size, 1e-6)
    i, _ = look_up(v.common, v.symbols)
    if len(v.symbols):
        share[v.classes :] += v.counts[i]
    share[: v.classes] += 10**v.class_log
    share /= share.sum()
    model = start_model(encoded.filter("NOT held_out"), v, share, states, seen, seed)
    columns = [f"s{k}" for k in range(states)]
    kinds = ", ".join(f"{c} double" for c in columns)
    context = encoded.sparkSession.sparkContext
    last = -np.inf
    while True:
        shared = context.broadcast(model)

        def count(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            model, sums = shared.value, None

            def add(held: list[bytes]) -> None:
                nonlocal sums
                got = expected_counts(model, by_step(sequences_of(held, span)))
                sums = got if sums is None else tuple(a + b for a, b in zip(sums, got, strict=True))

            # long texts go together, so that short ones don't wait for their many steps
            held, size = ([], []), [0, 0]
            for batch in batches:
                for x in batch.column("symbols").to_pylist():
                    long = len(x) > 4 * LONG
                    held[long].append(x)
                    size[long] += len(x) // 4
                    if size[long] >= 1_000_000:
                        add(held[long])
                        held[long].clear()
                        size[long] = 0
            for rest in held:
                if rest:
                    add(rest)
            if sums is not None:
                starts, moves, emissions, likelihood = sums
                some = np.flatnonzero(emissions.sum(1))
                row = np.concatenate([some, np.arange(-1, -3 - len(moves), -1)])
                values = np.concatenate([emissions[some], starts[None, :], moves, np.full((1, len(starts)), likelihood)])
                yield batch_of(row=row.astype(np.int64), **{c: values[:, k] for k, c in enumerate(columns)})

        found = encoded.filter("NOT held_out").select("symbols").mapInArrow(count, f"row long, {kinds}").groupBy("row").agg(*[F.sum(c).alias(c) for c in columns]).toPandas().sort_values("row")
        shared.unpersist()
        if not len(found):
            return model
        row, values = found["row"].to_numpy(), found[columns].to_numpy()
        emissions, moves = np.zeros((v.size, states)), np.zeros((states, states))
        emissions[row[row >= 0]] = values[row >= 0]
        by_row = dict(zip(row[row < 0].tolist(), values[row < 0], strict=True))
        for k in range(states):
            moves[k] = by_row[-2 - k]
        likelihood = float(by_row[-2 - states][0])
        if not likelihood - last > tolerance * abs(likelihood):
            return model
        last, model = likelihood, updated(by_row[-1], moves, emissions, share, 10.0)


def score(docs: DataFrame, states: int = 8, tolerance: float = 1e-4, classes: int = 512, common: int = 1 << 19, symbols: int = 1 << 14, span: int = 1 << 20, seen: int = 1024) -> DataFrame:
    """One row for each of ``docs`` (doc_id, text); see the contract of op6 for its columns."""
    docs = columns_of(docs, {"doc_id": "long", "text": "string"})
    counted = stored(count_tokens(docs, classes), "tokens")
    v = vocabulary(counted, classes, common, symbols)
    encoded = stored(encode(docs, v).withColumn("row", F.monotonically_increasing_id()), "encoded")
    model = train(encoded.select("held_out", "symbols"), v, states, tolerance, span, seen)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(rows: list[int], held: list[np.ndarray]) -> pa.RecordBatch:
            return batch_of(row=np.array(rows, np.int64), states_log=forward(shared.value, by_step(held), len(held)))

        rows, held, size = [], [], 0
        for batch in batches:
            for row, x in zip(batch.column("row").to_pylist(), batch.column("symbols").to_pylist(), strict=True):
                rows.append(row)
                held.append(np.frombuffer(x, "<u4"))
                size += len(held[-1])
                if size >= 2_000_000:
                    yield out(rows, held)
                    rows, held, size = [], [], 0
        if rows:
            yield out(rows, held)

    likelihood = encoded.select("row", "symbols").mapInArrow(scored, "row long, states_log double")
    rare = encoded.select("row", F.explode(F.arrays_zip("rare", "rare_n")).alias("r")).select("row", F.col("r.rare").alias("key"), F.col("r.rare_n").alias("times"))
    few = counted.filter((F.col("n") < max(1, -(-v.total // common))) & (F.col("key").bitwiseAND(1023) != 0))
    seen = rare.join(few, "key", "left").groupBy("row").agg(F.sum(F.when(F.col("n").isNotNull(), F.col("times"))).alias("rare_known"), F.sum(F.col("times") * F.log10(F.coalesce("n", F.lit(0)) + 0.5)).alias("rare_log"))
    parts = encoded.drop("symbols", "rare", "rare_n").join(likelihood, "row").join(seen, "row", "left")
    rare_log, log_all = F.coalesce("rare_log", F.lit(0.0)), float(np.log10(v.total + 0.5 * (v.distinct + 1)))
    return parts.select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("common_known") + F.coalesce("rare_known", F.lit(0))).cast("long").alias("n_known"),
        F.lit(v.total).cast("long").alias("train_tokens"),
        (F.col("common_base") + rare_log - F.col("n_tokens") * log_all).alias("base_score"),
        (F.col("states_log") + F.col("common_word") + rare_log - F.col("rare_class")).alias("score"),
    )


def op6_hidden_markov(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"))
