"""The automaton against plain merging and against the tokenizers library."""

import random

import numpy as np
import pytest

from cloakstone.llm.bpe_automaton import Encoder, compile_automaton, decode_ids, load_automaton, vocabulary_path


def merged(word: bytes, merges):
    parts = [bytes([b]) for b in word]
    for u, v in merges:
        out, i = [], 0
        while i < len(parts):
            if i + 1 < len(parts) and parts[i] == u and parts[i + 1] == v:
                out.append(u + v)
                i += 2
            else:
                out.append(parts[i])
                i += 1
        parts = out
    return parts


@pytest.mark.parametrize("seed", range(40))
def test_small_merge_lists(seed):
    rng = random.Random(seed)
    letters = [bytes([b]) for b in b"abc"]
    tokens, merges = [bytes([b]) for b in range(256)], []
    pool = list(letters)
    for _ in range(rng.randint(1, 14)):
        u, v = rng.choice(pool), rng.choice(pool)
        if u + v not in tokens:
            merges.append((u, v))
            tokens.append(u + v)
            pool.append(u + v)
    a = compile_automaton({t: i for i, t in enumerate(tokens)}, merges)
    encoder = Encoder(a)
    for _ in range(200):
        word = bytes(rng.choice(b"abc") for _ in range(rng.randint(1, 14)))
        assert [a.labels[i] for i in encoder.word(word)] == merged(word, merges)
    some = [i for i, t in enumerate(tokens) if t in pool and a.born[i] < 1 << 40]
    assert all(a.passes(u, v) == a.accepts(u, v) for u in some for v in some)


def test_same_as_library():
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(vocabulary_path())
    encoder = Encoder(load_automaton(vocabulary_path()))
    rng = random.Random(5)
    texts = ["", " ", "a", "Hello  world", "it's we'll I'd  \n\n x", "a<|endoftext|>b <|endoftext|>", "<|endoftext", "x" * 3000, "ab" * 2000, "é́ क् \U0001f600\U0001f600", "\t\x1c \x85　a  b", "1234567 12,5 !!?! ...", " lead", "tail ", "\n"]
    alphabet = "ab cde's\n\t .,!?0123éß中क\U0001f600 \x1f"
    texts += ["".join(rng.choice(alphabet) for _ in range(rng.randint(1, 60))) for _ in range(1500)]
    for text in texts:
        expected = library.encode(text, add_special_tokens=False).ids
        ids = encoder.encode(text)
        assert np.frombuffer(ids, "<u4").tolist() == expected, repr(text)
        assert decode_ids(encoder.automaton.labels, ids) == library.decode(expected, skip_special_tokens=False)


def test_pieces_by_the_library_are_as_whole_texts():
    from tokenizers import Tokenizer

    from cloakstone.llm.id_files import LibraryEncoder

    file = open(vocabulary_path(), encoding="utf-8").read()
    library, encoder = Tokenizer.from_str(file), LibraryEncoder(file)
    rng = random.Random(8)
    alphabet = ["a", "b", "Word", " ", " ", "\n", "\t", "\x1c", "\x85", "\u3000", "'s", "'", "12", ".", ",", "!", "é", "ß", "中", "\U0001f600", "\u094d", "<|endoftext|>", "<|", "_", "²"]
    for _ in range(3000):
        text = "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 40)))
        assert np.frombuffer(encoder.encode(text), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids, repr(text)


def test_clashing_columns(spark):
    from cloakstone.llm.bpe_automaton import decode, encode

    df = spark.createDataFrame([(1, "ab c", "x", 7), (1, None, None, None)], "doc_id long, text string, ids string, n int")
    out = decode(encode(df, vocabulary_path()).withColumn("text", decode_marker()), vocabulary_path())
    both = encode(df, vocabulary_path(), back=True)
    assert both.columns == ["doc_id", "n", "ids", "text"] and sorted(map(str, both.collect())) == sorted(map(str, decode(encode(df, vocabulary_path()), vocabulary_path()).collect()))
    assert out.columns == ["doc_id", "n", "ids", "text"] and [r["text"] for r in out.collect()] == ["ab c", ""]


def decode_marker():
    from pyspark.sql import functions as F

    return F.lit("other")
