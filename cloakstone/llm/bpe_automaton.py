"""Byte-level BPE by a deterministic automaton over tokens.

The automaton accepts exactly the token sequences that BPE gives. It starts as
one state with an arc for every byte and takes the merges one after the other.
The gadget for the merge of u and v: where u's arcs lead to a state p that has
an arc v, they are led to a new state p' instead, a copy of p without the arc
v; and every state with an arc u gets an arc uv that leads where v's arcs lead.
So all arcs with one label lead to one state, which is named by the label. A
copy differs from its original by one lost arc: a state is known by what its
line of copies lost and when. ``lost`` holds these losses by (label, lost arc);
a label uv starts from the state of v as it was when the merge was made, so its
line goes on with the losses of v before that. ``accepts`` reads these records
while the automaton is made. Then they are compiled to the transition table:
states with the same losses share a row, labels that are lost alike share a
column, and a bit says that the arc is lost (14,639 rows by 10,603 columns, 19
MB, for a vocabulary of 50,257). An arc leads to the state of its label.

Encoding a word walks the table by the longest label first. A position
that can't be passed is never tried again: each prefix has one accepted
sequence, so the walk is linear in the word. Decoding emits the arcs' labels.

Defined cases: a null or empty text has no ids; invalid UTF-8 that ids spell
becomes U+FFFD; every row is encoded by itself, so ties, repeated rows and
empty tables need nothing; texts of any length are encoded whole; columns that
have the names of the results are replaced by these, all others are kept.
"""

from __future__ import annotations

import json
import re
import struct
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._cluster import columns_of, table
from ._words import batch_of

#: White space of Unicode (the property White_Space).
SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: A run of other characters with the space before it; white space but its last character before such a run; white space.
UNITS = re.compile(rf" ?[^{SPACE}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+")
PIECES = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACE}\p{{L}}\p{{N}}]+|[{SPACE}]+")
NEVER = 1 << 40


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a byte-level vocabulary file: visible Latin-1 bytes for themselves, the others from U+0100 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(rest)}


class Automaton(NamedTuple):
    labels: list[bytes]
    """By token id."""
    left: list[int]
    right: list[int]
    """A token's two parts; -1 for bytes."""
    born: list[int]
    """The merge that made a token; -1 for bytes, NEVER for tokens that no text gives."""
    lost: dict[int, int]
    """When the state of a label lost an arc, by label << 20 | arc."""
    special: dict[str, int]
    """Strings that become one id wherever they stand."""
    tree: dict[int, int]
    """The labels by their bytes: from a node (0: the root) by a byte to the next, as node << 8 | byte."""
    ends: dict[int, int]
    """The label that a node's bytes spell."""
    row: list[int] = []
    """Of each state (by the label that leads to it), where its row of the table starts."""
    column: list[int] = []
    """Of each label, its column."""
    table: bytes = b""
    """A bit for each row and column, highest first in a byte: whether the arc is lost."""

    def compiled(self) -> Automaton:
        """The automaton without the records of its making: what encoding needs."""
        return self._replace(left=[], right=[], born=[], lost={})

    def passes(self, state: int, label: int) -> bool:
        """Whether the state after a label has an arc ``label``, by the table."""
        c = self.column[label]
        return not self.table[self.row[state] + (c >> 3)] << (c & 7) & 128

    def accepts(self, state: int, label: int) -> bool:
        """Whether the state after a label (-1: the start) has an arc ``label``."""
        left, right, born, lost = self.left, self.right, self.born, self.lost
        if born[label] == NEVER:
            return False
        until = NEVER  # the arc uv was made where an arc u was, so losses of u up to then count
        while state >= 0:
            line, before = state, NEVER
            while line >= 0:
                when = lost.get(line << 20 | label)
                if when is not None and when < before and when <= until:
                    return False
                before = min(before, born[line])
                line = right[line]
            if left[label] < 0:
                break
            until = born[label]
            label = left[label]
        return True


def transition_table(a: Automaton) -> tuple[list[int], list[int], bytes]:
    """(row starts, columns, table) of an automaton whose losses are known."""
    by_state: dict[int, list[int]] = {}
    by_label: dict[int, list[int]] = {}
    for key, when in a.lost.items():
        by_state.setdefault(key >> 20, []).append(when)
        by_label.setdefault(key & 0xFFFFF, []).append(when)
    for times in (*by_state.values(), *by_label.values()):
        times.sort()
    rows: dict[tuple, int] = {}
    columns: dict[tuple, int] = {}
    row, column = [0] * len(a.labels), [0] * len(a.labels)
    for i, when in enumerate(a.born):
        if when == NEVER:
            continue
        # what the state's line lost and when: the first losses of each label in it
        seen, line, before = [], i, NEVER
        while line >= 0:
            if n := bisect_left(by_state.get(line, []), before):
                seen.append((line, n))
            before, line = min(before, a.born[line]), a.right[line]
        row[i] = rows.setdefault(tuple(seen), len(rows))
        # an arc uv goes where an arc u is, so it is lost with u up to its making
        seen, first, until = [], i, NEVER
        while first >= 0:
            if n := bisect_right(by_label.get(first, []), until):
                seen.append((first, n))
            until, first = a.born[first], a.left[first]
        column[i] = columns.setdefault(tuple(seen), len(columns))
    with_state: dict[int, list[tuple[int, int]]] = {}
    with_label: dict[int, list[tuple[int, int]]] = {}
    for classes, found in ((rows, with_state), (columns, with_label)):
        for seen, k in classes.items():
            for label, n in seen:
                found.setdefault(label, []).append((n, k))
    width = -(-max(1, len(columns)) // 8)
    table = np.zeros((max(1, len(rows)), width), np.uint8)
    for key, when in a.lost.items():
        u, v = key >> 20, key & 0xFFFFF
        in_row, in_column = bisect_left(by_state[u], when), bisect_left(by_label[v], when)
        flags = np.zeros(width * 8, bool)
        flags[[k for n, k in with_label[v] if n > in_column]] = True
        table[[k for n, k in with_state[u] if n > in_row]] |= np.packbits(flags)
    return [r * width for r in row], column, table.tobytes()


def compile_automaton(vocabulary: dict[bytes, int], merges: list[tuple[bytes, bytes]], special: dict[str, int] | None = None) -> Automaton:
    size = max([*vocabulary.values(), *(special or {}).values()], default=-1) + 1
    labels: list[bytes] = [b""] * size
    for label, i in vocabulary.items():
        labels[i] = label
    for text, i in (special or {}).items():
        labels[i] = text.encode()
    a = Automaton(labels, [-1] * size, [-1] * size, [NEVER] * size, {}, special or {}, {}, {})
    for b in range(256):
        if (i := vocabulary.get(bytes([b]))) is not None:
            a.born[i] = -1
    for when, (u, v) in enumerate(merges):
        first, second, whole = vocabulary[u], vocabulary[v], vocabulary[u + v]
        if a.born[first] == NEVER or a.born[whole] != NEVER or not a.accepts(first, second):
            continue
        a.left[whole], a.right[whole], a.born[whole] = first, second, when
        a.lost[first << 20 | second] = when
    for label, i in vocabulary.items():
        if a.born[i] != NEVER:
            node = 0
            for b in label:
                node = a.tree.setdefault(node << 8 | b, len(a.tree) + 1)
            a.ends[node] = i
    row, column, table = transition_table(a)
    return a._replace(row=row, column=column, table=table)


def load_automaton(path: str) -> Automaton:
    """The automaton of a tokenizers file: BPE over bytes, pre-split by the pattern of this module."""
    file = json.loads(open(path, encoding="utf-8").read())
    model, split = file["model"], file["pre_tokenizer"]
    plain = model["type"] == "BPE" and split["type"] == "ByteLevel" and split["use_regex"] and not split["add_prefix_space"]
    if not plain or file["normalizer"] or model.get("dropout") or model.get("ignore_merges") or any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in file["added_tokens"]):
        raise ValueError(f"{path} isn't a plain byte-level BPE file")
    letters = byte_letters()
    special = {t["content"]: t["id"] for t in file["added_tokens"]}
    to_bytes = lambda s: bytes(letters[c] for c in s)
    pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    return compile_automaton({to_bytes(s): i for s, i in model["vocab"].items() if s not in special}, [(to_bytes(u), to_bytes(v)) for u, v in pairs], special)


class Encoder(dict):
    """Ids (little-endian unsigned 32 bits) of units of text; those met are kept, up to ``room`` of them and of pieces."""

    def __init__(self, automaton: Automaton, room: int = 250_000) -> None:
        super().__init__()
        self.automaton, self.room, self.pieces = automaton, room, {}
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(automaton.special, key=len, reverse=True))) + ")") if automaton.special else None

    def word(self, word: bytes) -> list[int]:
        """The accepted sequence whose labels spell a pre-split word."""
        a, n = self.automaton, len(word)
        table, row, column = a.table, a.row, a.column
        path: list[int] = []
        waiting: list[list[int]] = []  # at each step of the path, the labels that fit there and weren't tried, shorter first
        at, dead = 0, bytearray(n + 1)
        fitting = self.fitting(word, 0)
        while at < n:
            state = path[-1] if path else -1
            while fitting:
                token = fitting.pop()
                if dead[at + len(a.labels[token])]:
                    continue
                c = column[token]
                if state < 0 or not table[row[state] + (c >> 3)] << (c & 7) & 128:
                    break
            else:
                if not path:
                    raise ValueError("a byte has no token")
                dead[at] = 1
                at -= len(a.labels[path.pop()])
                fitting = waiting.pop()
                continue
            path.append(token)
            waiting.append(fitting)
            at += len(a.labels[token])
            fitting = self.fitting(word, at)
        return path

    def fitting(self, word: bytes, at: int) -> list[int]:
        """The labels that the word goes on with, shorter first."""
        node, out, tree, ends = 0, [], self.automaton.tree, self.automaton.ends
        for k in range(at, len(word)):
            node = tree.get(node << 8 | word[k])
            if node is None:
                break
            if (i := ends.get(node)) is not None:
                out.append(i)
        return out

    def __missing__(self, unit: str) -> bytes:
        pieces, out = self.pieces, b""
        for piece in PIECES.findall(unit):
            if (ids := pieces.get(piece)) is None:
                found = self.word(piece.encode("utf-8"))
                ids = pieces[piece] = struct.pack(f"<{len(found)}I", *found)
            out += ids
        self[unit] = out
        return out

    def encode(self, text: str) -> bytes:
        if len(self) > self.room:
            self.clear()
        if len(self.pieces) > self.room:
            self.pieces.clear()
        if self.cut is None or "<" not in text and not self.cut.search(text):
            return b"".join(map(self.__getitem__, UNITS.findall(text)))
        out = []
        for k, part in enumerate(self.cut.split(text)):
            if k % 2:
                out.append(np.array([self.automaton.special[part]], "<u4").tobytes())
            else:
                out.extend(map(self.__getitem__, UNITS.findall(part)))
        return b"".join(out)


def decode_ids(labels: list[bytes], ids: bytes) -> str:
    """The labels one after the other, as UTF-8; bytes that aren't become U+FFFD."""
    return b"".join(map(labels.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")


def encode(docs: DataFrame, path: str, text: str = "text", back: bool = False) -> DataFrame:
    """The rows of ``docs`` with ids (binary: little-endian unsigned 32-bit integers) in place of the column ``text``; a null or empty text has no ids (empty binary). Any length.

    back: with a further column text, what the ids spell, by the same worker; as ``decode`` gives it.
    """
    shared = docs.sparkSession.sparkContext.broadcast(load_automaton(path).compiled())
    made = ["ids", "text"] if back else ["ids"]
    keep = [c for c in docs.columns if c != text and c not in made]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(shared.value)
        labels = encoder.automaton.labels
        for batch in batches:
            for i in range(0, batch.num_rows, 100):
                part = batch.slice(i, 100)
                ids = [encoder.encode(x or "") for x in part.column(len(keep)).to_pylist()]
                columns = [*part.columns[:-1], pa.array(ids, pa.binary())]
                if back:
                    columns.append(pa.array([decode_ids(labels, x) for x in ids], pa.string()))
                yield pa.RecordBatch.from_arrays(columns, names=[*keep, *made])

    kinds = [f"`{c}` {kind}" for c, kind in docs.select(*keep).dtypes]
    return docs.select(*keep, F.col(text).cast("string")).mapInArrow(run, ", ".join([*kinds, "ids binary", *(["text string"] if back else [])]))


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """The rows of ``encoded`` with the column text: what its ids spell."""
    encoded = encoded.drop("text")
    shared = encoded.sparkSession.sparkContext.broadcast(load_automaton(path).labels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 500):
                part = batch.slice(i, 500)
                texts = [decode_ids(shared.value, x or b"") for x in part.column("ids").to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string())], names=[*part.schema.names, "text"])

    kinds = ", ".join(f"`{c}` {kind}" for c, kind in encoded.dtypes)
    return encoded.mapInArrow(run, f"{kinds}, text string")


def vocabulary_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def digests(docs: DataFrame, path: str) -> DataFrame:
    both = encode(columns_of(docs, {"doc_id": "long", "text": "string"}), path, back=True)
    return both.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.encode("text", "UTF-8"), 256).alias("decoded_sha256"))


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's ids and their decoding, as digests. Extra columns of documents are ignored; repeated rows give repeated results."""
    return digests(table(spark, sf_dir, "documents"), vocabulary_path())
