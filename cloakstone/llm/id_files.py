"""Token ids in files of patched frame-of-reference blocks.

A file holds the ids of a run of documents, in blocks of 128 ids (the last may
be padded). Of each block the minimum is subtracted; the rest is packed at the
width that fits ``share`` of its values; what needs more bits is stored whole
in the block's exception list. All numbers are little-endian:

    "PFR1"
    blocks: minimum u32, width u8, exceptions u8, then 16 * width bytes (bit i
            of value j is bit i + j * width of the stream, low bits first),
            then positions u8 and remainders u32 of the exceptions
    index:  u64 byte offset of each block
    table:  per document: doc_id i64, present u8 (0: null), first id's place
            in the file u64, number of ids u32
    footer: u64 number of ids, u64 number of blocks, u64 number of documents,
            u64 offset of the index, "PFR1"

Files lie in a folder that all executors share; a task writes under a name of
its own and renames, so a repeated or speculative task changes nothing. The
folder is opened by its URI (file:, hdfs:, s3: and what else Arrow opens).

Defined cases: null texts are empty and hold the end id alone; documents are
in the order of (doc_id, text), null ids first; repeated rows are repeated
documents; an empty table gives no files.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._cluster import columns_of, new_path, stored, table
from ._runs import place, run_of
from ._words import batch_of
from .bpe_automaton import PIECES, UNITS, byte_letters, vocabulary_path

BLOCK, MAGIC, END = 128, b"PFR1", 0
HEAD = np.dtype([("minimum", "<u4"), ("width", "u1"), ("exceptions", "u1")])
DOC = np.dtype([("doc_id", "<i8"), ("present", "u1"), ("start", "<u8"), ("n", "<u4")])
FOOT = np.dtype([("ids", "<u8"), ("blocks", "<u8"), ("docs", "<u8"), ("index", "<u8"), ("magic", "S4")])


def bit_lengths(x: np.ndarray) -> np.ndarray:
    return np.frexp(x.astype(np.float64))[1]


def shifted(values: np.ndarray, w: int) -> np.ndarray:
    """The bytes of blocks of values below 2**w, w up to 16: eight values are two words of 64 bits, of which w bytes are kept."""
    eight = values.reshape(len(values), -1, 8).astype("<u8")
    words = np.zeros((*eight.shape[:2], 2), "<u8")
    for k in range(8):
        at = np.uint64(k * w)
        if at < 64:
            words[:, :, 0] |= eight[:, :, k] << at
            if at + w > 64:
                words[:, :, 1] |= eight[:, :, k] >> (np.uint64(64) - at)
        else:
            words[:, :, 1] |= eight[:, :, k] << (at - np.uint64(64))
    return words.view(np.uint8)[:, :, :w].reshape(len(values), -1)


def unshifted(raw: np.ndarray, w: int) -> np.ndarray:
    """The values of blocks of such bytes."""
    filled = np.zeros((len(raw), raw.shape[1] // w, 16), np.uint8)
    filled[:, :, :w] = raw.reshape(len(raw), -1, w)
    low, high = np.moveaxis(filled.view("<u8"), 2, 0)
    out = np.empty((*low.shape, 8), np.uint32)
    for k in range(8):
        at = np.uint64(k * w)
        x = high >> (at - np.uint64(64)) if at >= 64 else low >> at | high << (np.uint64(64) - at) if at + w > 64 else low >> at
        out[:, :, k] = x & np.uint64((1 << w) - 1)
    return out.reshape(len(raw), -1)


def pack(ids: np.ndarray, share: float = 0.9) -> tuple[bytes, np.ndarray]:
    """The blocks' bytes, and where each starts."""
    n = -(-len(ids) // BLOCK)
    if not n:
        return b"", np.zeros(0, np.int64)
    padded = np.full(n * BLOCK, ids[-1], np.uint32)
    padded[: len(ids)] = ids
    rows = padded.reshape(n, BLOCK)
    low = rows.min(1)
    rest = rows - low[:, None]
    bits = bit_lengths(rest)
    width = np.sort(bits.astype(np.int8), 1)[:, int(np.ceil(share * BLOCK)) - 1].astype(np.int64)
    over = bits > width[:, None]
    count = over.sum(1)
    size = HEAD.itemsize + BLOCK // 8 * width + 5 * count
    start = np.cumsum(size) - size
    out = np.zeros(int(size.sum()), np.uint8)
    head = np.zeros(n, HEAD)
    head["minimum"], head["width"], head["exceptions"] = low, width, count
    out[start[:, None] + np.arange(HEAD.itemsize)] = head.view(np.uint8).reshape(n, -1)
    for w in np.unique(width):
        if not w:
            continue
        at = np.flatnonzero(width == w)
        for part in np.array_split(at, -(-len(at) // 2048)):
            if w <= 16:
                packed = shifted(rest[part] & np.uint32((1 << int(w)) - 1), int(w))
            else:
                flags = np.unpackbits(np.ascontiguousarray(rest[part].astype("<u4")).view(np.uint8).reshape(len(part), BLOCK, -1), axis=2, bitorder="little")[:, :, :w]
                packed = np.packbits(flags.reshape(len(part), -1), axis=1, bitorder="little")
            out[start[part][:, None] + HEAD.itemsize + np.arange(BLOCK // 8 * w)] = packed
    block, position = np.nonzero(over)
    rank = np.arange(len(block)) - (np.cumsum(count) - count)[block]
    lists = start + HEAD.itemsize + BLOCK // 8 * width
    out[lists[block] + rank] = position
    values = rest[block, position].astype("<u4").view(np.uint8).reshape(-1, 4)
    out[(lists[block] + count[block] + 4 * rank)[:, None] + np.arange(4)] = values
    return out.tobytes(), start


def unpack(data: np.ndarray, start: np.ndarray, n_ids: int) -> np.ndarray:
    """The ids of the blocks that start at ``start`` in ``data``."""
    n = len(start)
    if not n:
        return np.zeros(0, np.uint32)
    head = np.ascontiguousarray(data[start[:, None] + np.arange(HEAD.itemsize)]).view(HEAD).reshape(n)
    width, count = head["width"].astype(np.int64), head["exceptions"].astype(np.int64)
    rest = np.zeros((n, BLOCK), np.uint32)
    for w in np.unique(width):
        if not w:
            continue
        at = np.flatnonzero(width == w)
        for part in np.array_split(at, -(-len(at) // 2048)):
            raw = data[start[part][:, None] + HEAD.itemsize + np.arange(BLOCK // 8 * w)]
            if w <= 16:
                rest[part] = unshifted(raw, int(w))
                continue
            flags = np.unpackbits(raw, axis=1, bitorder="little").reshape(len(part), BLOCK, w)
            bytes_ = np.packbits(flags, axis=2, bitorder="little").astype(np.uint32)
            rest[part] = sum(bytes_[:, :, k] << np.uint32(8 * k) for k in range(bytes_.shape[2]))
    block = np.repeat(np.arange(n), count)
    rank = np.arange(len(block)) - (np.cumsum(count) - count)[block]
    lists = start + HEAD.itemsize + BLOCK // 8 * width
    values = np.ascontiguousarray(data[(lists[block] + count[block] + 4 * rank)[:, None] + np.arange(4)]).view("<u4").reshape(-1)
    rest[block, data[lists[block] + rank]] = values
    return (rest + head["minimum"][:, None]).reshape(-1)[:n_ids]


def file_bytes(doc_ids: list[int | None], ids: list[bytes]) -> bytes:
    """A whole file for the documents' ids (little-endian unsigned 32 bits)."""
    sizes = np.array([len(x) // 4 for x in ids], np.int64)
    docs = np.zeros(len(ids), DOC)
    docs["doc_id"], docs["present"] = [x or 0 for x in doc_ids], [x is not None for x in doc_ids]
    docs["start"], docs["n"] = np.cumsum(sizes) - sizes, sizes
    blocks, start = pack(np.frombuffer(b"".join(ids), "<u4"))
    foot = np.array([(sizes.sum(), len(start), len(ids), len(MAGIC) + len(blocks), MAGIC)], FOOT)
    return b"".join([MAGIC, blocks, (start + len(MAGIC)).astype("<u8").tobytes(), docs.tobytes(), foot.tobytes()])


def read_file(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(table of documents, ids) of a file's bytes."""
    foot = np.frombuffer(data[-FOOT.itemsize :], FOOT)[0]
    if data[:4] != MAGIC or foot["magic"] != MAGIC:
        raise ValueError("not a file of packed ids, or a part of one")
    index, blocks = int(foot["index"]), int(foot["blocks"])
    start = np.frombuffer(data, "<u8", blocks, index).astype(np.int64)
    docs = np.frombuffer(data, DOC, int(foot["docs"]), index + 8 * blocks)
    return docs, unpack(np.frombuffer(data, np.uint8), start, int(foot["ids"]))


class LibraryEncoder(dict):
    """Ids of texts by the tokenizers library. Texts are cut where its pre-splitting always cuts, so that its model meets a piece once as long as it is kept.

    Units are kept in two generations of up to ``room`` and one text's: when the younger is full it becomes the elder,
    and a unit found there moves back, so that frequent ones stay and most of those met once go.
    """

    def __init__(self, file: str, room: int = 400_000) -> None:
        from tokenizers import Tokenizer

        super().__init__()
        library = Tokenizer.from_str(file)
        self.tokenize, self.room, self.elder, self.pieces = library.model.tokenize, room, {}, {}
        self.letters = {b: letter for letter, b in byte_letters().items()}
        self.blank = self.letters[0x20]
        self.four = [i.to_bytes(4, "little") for i in range(max(library.get_vocab().values()) + 1)]
        self.special = {t.content: np.array([i], "<u4").tobytes() for i, t in library.get_added_tokens_decoder().items()}
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None

    def ids_of(self, letters: str) -> bytes:
        four = self.four
        return b"".join([four[t.id] for t in self.tokenize(letters)])

    def spelled(self, piece: str) -> str:
        return piece.encode("utf-8").decode("latin-1").translate(self.letters)

    def __missing__(self, unit: str) -> bytes:
        if (out := self.elder.get(unit)) is None:
            body = unit.removeprefix(" ")
            if body.isalpha():
                # letters of ASCII stand for themselves
                out = self.ids_of((self.blank + body if unit[0] == " " else unit) if unit.isascii() else self.spelled(unit))
            elif body[-1:] in ".,;:!?" and body[:-1].isalpha():
                out = self[unit[:-1]] + self[unit[-1]]
            else:
                parts, pieces, out = PIECES.findall(unit), self.pieces, b""
                for part in parts:
                    if (ids := pieces.get(part)) is None:
                        ids = self.ids_of(self.spelled(part))
                        if len(parts) > 1:
                            pieces[part] = ids
                    out += ids
        self[unit] = out
        return out

    def encode(self, text: str) -> bytes:
        if len(self) > self.room:
            self.elder = dict(self)
            self.clear()
        if len(self.pieces) > self.room:
            self.pieces.clear()
        if self.cut is None or not self.cut.search(text):
            return b"".join(map(self.__getitem__, UNITS.findall(text)))
        parts = self.cut.split(text)
        return b"".join(self.special[part] if k % 2 else b"".join(map(self.__getitem__, UNITS.findall(part))) for k, part in enumerate(parts))


@lru_cache(maxsize=1)
def library_encoder(file: str) -> LibraryEncoder:
    """One encoder a worker, whose units and pieces the worker's next tasks find again."""
    return LibraryEncoder(file)


def open_folder(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def write_files(docs: DataFrame, tokenizer: str, folder: str, end: int = END, rows: int = 400, most: int = 1 << 15, file_ids: int = 1 << 21) -> DataFrame:
    """Writes the ids of ``docs`` (doc_id, text), with ``end`` after each document, into ``folder``; returns the manifest: run, part, file, n_ids.

    A file ends with its run, or with the document that brings it to ``file_ids`` ids: a task holds no more than these and one document.
    """
    spark = docs.sparkSession
    docs = docs.withColumn("at", place())
    run, _ = run_of(docs.select("at"), "at", rows, most)
    file = open(tokenizer, encoding="utf-8").read()
    shared = spark.sparkContext.broadcast(file)
    last = np.array([end], "<u4").tobytes()
    where, path = open_folder(folder)
    where.create_dir(path, recursive=True)

    def save(run: int, number: int, doc_ids: list, ids: list[bytes]) -> pa.RecordBatch:
        where, path = open_folder(folder)
        name = f"ids-{run:08d}-{number:06d}.pfr"
        own = f"{path}/.{name}.{uuid.uuid4().hex}"
        with where.open_output_stream(own) as out:
            out.write(file_bytes(doc_ids, ids))
        where.move(own, f"{path}/{name}")
        return batch_of(run=np.array([run], np.int32), part=np.array([number], np.int32), file=[name], n_ids=np.array([sum(map(len, ids)) // 4], np.int64))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = library_encoder(shared.value)
        now, number, held, doc_ids, ids = None, 0, 0, [], []
        for batch in batches:
            for i in range(0, batch.num_rows, 500):
                part = batch.slice(i, 500).to_pydict()
                for r, doc_id, text in zip(part["run"], part["doc_id"], part["text"], strict=True):
                    if ids and (r != now or held >= 4 * file_ids):
                        yield save(now, number, doc_ids, ids)
                        number, held, doc_ids, ids = number + 1 if r == now else 0, 0, [], []
                    now = r
                    doc_ids.append(doc_id)
                    ids.append(encoder.encode(text or "") + last)
                    held += len(ids[-1])
        if ids:
            yield save(now, number, doc_ids, ids)

    dealt = docs.select(run.alias("run"), "at", "doc_id", "text").repartition("run").sortWithinPartitions("run", "at", "text")
    return stored(dealt.select("run", "doc_id", "text").mapInArrow(write, "run int, part int, file string, n_ids long"), "manifest")


def read_files(manifest: DataFrame, folder: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), ids (binary, the end id included) for each document in the files."""
    spark = manifest.sparkSession
    runs = sorted(manifest.groupBy("run").agg(F.sum("n_ids").alias("n")).collect(), key=lambda r: r["run"])  # at most `most` rows
    starts = np.cumsum([0, *[r["n"] for r in runs]])
    first = spark.createDataFrame([(r["run"], int(b)) for r, b in zip(runs, starts, strict=False)], "run int, first long")
    within = F.coalesce(F.sum("n_ids").over(Window.partitionBy("run").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = manifest.withColumn("within", within).join(F.broadcast(first), "run").select("file", (F.col("first") + F.col("within")).alias("before"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, path = open_folder(folder)
        for batch in batches:
            for file, first in zip(batch.column("file").to_pylist(), batch.column("before").to_pylist(), strict=True):
                with where.open_input_file(f"{path}/{file}") as f:
                    docs, ids = read_file(f.read())
                raw, at = ids.astype("<u4").tobytes(), docs["start"].astype(np.int64)
                parts = [raw[4 * a : 4 * (a + int(n))] for a, n in zip(at, docs["n"], strict=True)]
                yield batch_of(doc_id=pa.array(docs["doc_id"].astype(np.int64), pa.int64(), mask=docs["present"] == 0), start=first + at, ids=pa.array(parts, pa.binary()))

    return rows.repartition(max(1, min(manifest.count(), 4 * spark.sparkContext.defaultParallelism))).mapInArrow(read, "doc_id long, start long, ids binary")


def with_crc(read: DataFrame) -> DataFrame:
    return read.select("doc_id", "start", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))


def op7_id_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = new_path(spark, "id-files")
    docs = columns_of(table(spark, sf_dir, "documents"), {"doc_id": "long", "text": "string"})
    return with_crc(read_files(write_files(docs, vocabulary_path(), folder), folder))


