"""Words and hashes of Arrow string columns, computed on their byte buffers.

A word is a run of bytes other than 0x20 and 0x09-0x0D; in UTF-8 these six
bytes occur only as themselves, so byte runs are the code point runs of
``[^\\x20\\x09-\\x0D]+``. A word's hash is a polynomial over mixed byte values
modulo 2**64, finished by a bit mixer, all by array operations.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

U = np.uint64
GOLD = U(0x9E3779B97F4A7C15)
BASE = U(0x5851F42D4C957F2D)
SEPARATOR = np.zeros(256, bool)
SEPARATOR[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
WINDOW = 1 << 20
BLOCK = 4 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit mixer."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


BYTE_VALUE = mix(np.arange(1, 257, dtype=U) * GOLD)
_powers = [np.ones(1, U), np.ones(1, U)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and its inverse modulo 2**64 for i up to n."""
    if len(_powers[0]) <= n:
        size = max(n + 1, WINDOW + 1)
        for k, b in enumerate((BASE, U(pow(int(BASE), -1, 1 << 64)))):
            p = np.full(size, b, U)
            p[0] = 1
            with np.errstate(over="ignore"):
                _powers[k] = np.multiply.accumulate(p)
    return _powers[0][: n + 1], _powers[1][: n + 1]


class Texts(NamedTuple):
    """Bytes of some texts, one after the other; text i is data[at[i]:at[i + 1]]."""

    data: np.ndarray
    at: np.ndarray


class Words(NamedTuple):
    """Each word's first byte, byte after the last, text and hash."""

    start: np.ndarray
    end: np.ndarray
    doc: np.ndarray
    hash: np.ndarray


def texts_of(column: pa.Array) -> Texts:
    """The texts of a string column; nulls are empty texts."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    n = len(column)
    if not n:
        return Texts(np.zeros(0, np.uint8), np.zeros(1, np.int64))
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return Texts(raw[at[0] : at[-1]], at - at[0])


def blocks(batches: Iterator[pa.RecordBatch], text: str = "text", limit: int = BLOCK) -> Iterator[tuple[pa.RecordBatch, Texts]]:
    """The batches cut so that each holds about ``limit`` bytes of text, one row at least; nothing is left out."""
    for batch in batches:
        if not batch.num_rows:
            continue
        texts = texts_of(batch.column(text))
        i = 0
        while i < batch.num_rows:
            j = max(i + 1, int(np.searchsorted(texts.at, texts.at[i] + limit, "right")) - 1)
            yield batch.slice(i, j - i), Texts(texts.data[texts.at[i] : texts.at[j]], texts.at[i : j + 1] - texts.at[i])
            i = j
    # a worker lives on after its task: what Arrow keeps for later goes back
    pa.default_memory_pool().release_unused()


def words_of(texts: Texts, lower: bool = False) -> Words:
    data, at = texts
    n = len(data)
    inside = ~SEPARATOR[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    edges = at[:-1][at[:-1] < n]
    first[edges] = inside[edges]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    ends = at[1:][at[1:] > 0] - 1
    last[ends] = inside[ends]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    doc = np.searchsorted(at, start, "right") - 1
    return Words(start, end, doc, spans_hash(data, start, end, lower))


def spans_hash(data: np.ndarray, start: np.ndarray, end: np.ndarray, lower: bool = False) -> np.ndarray:
    """Hashes of disjoint ascending spans, window by window so that memory stays bounded."""
    out = np.empty(len(start), U)
    i = 0
    with np.errstate(over="ignore"):
        while i < len(start):
            j = max(i + 1, int(np.searchsorted(end, start[i] + WINDOW, "right")))
            lo, hi = start[i], end[j - 1]
            part = data[lo:hi]
            up, down = powers(hi - lo)
            sums = np.zeros(hi - lo + 1, U)
            np.cumsum(BYTE_VALUE[LOWER[part] if lower else part] * up[:-1], out=sums[1:])
            s, e = start[i:j] - lo, end[i:j] - lo
            out[i:j] = mix((sums[e] - sums[s]) * down[s] + (e - s).astype(U) * GOLD)
            i = j
    return out


def shingles_of(words: Words, n_docs: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(text, hash) of each window of ``size`` words; a text with fewer words gives its whole sequence."""
    count = np.bincount(words.doc, minlength=n_docs)
    h, m = words.hash, max(0, len(words.hash) - size + 1)
    with np.errstate(over="ignore"):
        x = np.zeros(m, U)
        for k in range(size):
            x = mix(x * BASE + h[k : k + m])
        full = words.doc[:m] == words.doc[size - 1 :] if m else np.zeros(0, bool)
        doc, out = words.doc[:m][full], x[full]
        short = np.flatnonzero((count > 0) & (count < size))
        if len(short):
            ends = np.cumsum(count)
            extra = np.empty(len(short), U)
            for k, d in enumerate(short):
                y = np.zeros(1, U)
                for v in h[ends[d] - count[d] : ends[d]]:
                    y = mix(y * BASE + v)
                extra[k] = mix(y + U(count[d]))[0]
            doc, out = np.concatenate([doc, short]), np.concatenate([out, extra])
    return doc, out


def tally(keys: np.ndarray, weights: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order and how often (or with what total weight) each occurs."""
    if not len(keys):
        return keys, np.zeros(0, np.int64)
    if weights is None:
        k = np.sort(keys)
        at = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
        return k[at], np.diff(np.append(at, len(k)))
    order = np.argsort(keys, kind="stable")
    k = keys[order]
    at = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
    return k[at], np.add.reduceat(weights[order], at)


class Counter:
    """Counts of 64-bit keys under bounded memory: merged when ``room`` is reached, handed out when ``room`` distinct keys are held."""

    def __init__(self, room: int = 2_000_000) -> None:
        self.room, self.parts, self.held = room, [], 0

    def add(self, keys: np.ndarray, weights: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        k, c = tally(keys, weights)
        self.parts.append((k, c))
        self.held += len(k)
        if self.held > self.room:
            k, c = self._merged()
            if len(k) > self.room // 2:
                yield k, c
            else:
                self.parts, self.held = [(k, c)], len(k)

    def _merged(self) -> tuple[np.ndarray, np.ndarray]:
        parts, self.parts, self.held = self.parts, [], 0
        if len(parts) == 1:
            return parts[0]
        return tally(np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]))

    def rest(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        if self.parts:
            yield self._merged()


def look_up(table: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each key, its place in the sorted table, and whether it is there."""
    if not len(table):
        return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
    i = np.minimum(np.searchsorted(table, keys), len(table) - 1)
    return i, table[i] == keys


def batch_of(**columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x) for x in columns.values()], names=list(columns))
