"""Near duplicates against brute force, with a large group of copies edited to different degrees."""

import random
import re
from collections import Counter
from itertools import combinations

import numpy as np
import pytest

from cloakstone.llm.near_dedup import near_duplicates, super_min_hash


def shingles(text):
    w = re.findall("[^\x20\x09-\x0d]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def expected(rows, percent):
    """(doc_id, set size, component) of each row; rows are linked by their texts and by their doc_id."""
    sets = {k: shingles(t) for k, (_, t) in enumerate(rows)}
    parent = {k: k for k in sets}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in combinations(sets, 2):
        x, y = sets[a], sets[b]
        ids = rows[a][0], rows[b][0]
        if x and y and None not in ids and (ids[0] == ids[1] or 100 * len(x & y) >= percent * len(x | y)):
            parent[top(a)] = top(b)
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[top(k)] = min(i, least.get(top(k), i))
    return Counter((i, len(sets[k]), least[top(k)] if sets[k] and i is not None else i) for k, (i, _) in enumerate(rows))


@pytest.mark.parametrize("direct", [64, 4])
def test_against_brute_force(spark, monkeypatch, direct):
    import cloakstone.llm.near_dedup as m

    plain = m.link_buckets
    monkeypatch.setattr(m, "link_buckets", lambda *a: plain(*a, direct=direct))
    rng = random.Random(3)
    word = lambda: "w%d" % rng.randint(0, 5000)
    base = [word() for _ in range(120)]
    rows = []
    for i in range(150):
        w = list(base)
        for _ in range(rng.randint(0, 9)):
            w[rng.randrange(len(w))] = word()
        rows.append((i * 3, " ".join(w)))
    rows += [(1000 + i, " ".join(word() for _ in range(rng.randint(1, 60)))) for i in range(60)]
    rows += [(2000 + i, rows[k][1].upper()) for i, k in enumerate(rng.choices(range(len(rows)), k=40))]
    rows += [(3000, None), (3001, ""), (3002, " \n"), (3003, "one two"), (3004, "ONE  two"), (3005, "x " * 20000), (3006, "x " * 9000)]
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert Counter(tuple(r)[:3] for r in got) == expected(rows, 85)
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_repeated_and_null_ids_against_brute_force(spark, seed):
    rng = random.Random(seed)
    base = [[f"w{rng.randint(0, 900)}" for _ in range(60)] for _ in range(12)]
    rows = [(5, "a b c d e"), (7, "a b c d e"), (7, "f g h i j"), (9, "f g h i j")]
    for _ in range(150):
        w = list(rng.choice(base))
        for _ in range(rng.randint(0, 2)):
            w[rng.randrange(len(w))] = f"x{rng.randint(0, 9)}"
        rows.append((rng.choice([None, *range(10, 120)]), rng.choice([" ".join(w), " ".join(w), " ".join(w[:3]), "", None])))
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, id int, row int")
    got = near_duplicates(df).collect()
    assert Counter(tuple(r)[:3] for r in got) == expected(rows, 85)
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)


def test_odd_tables(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, n int, component long")
    assert near_duplicates(empty).collect() == []
    rows = spark.createDataFrame([(None, "a b c d e f", 1), (1, "a b c d e f", 2), (1, "a b c d e f", 3)], "doc_id long, text string, bucket int")
    got = sorted((r["doc_id"] or 0, r["component_id"], r["kept"]) for r in near_duplicates(rows).collect())
    assert got == [(0, None, True), (1, 1, True), (1, 1, True)]


def test_signature_estimates_similarity():
    rng = np.random.default_rng(0)
    both = rng.integers(0, 1 << 63, 300, dtype=np.uint64)
    one, two = np.concatenate([both, rng.integers(0, 1 << 63, 50, dtype=np.uint64)]), np.concatenate([both, rng.integers(0, 1 << 63, 50, dtype=np.uint64)])
    doc = np.repeat([0, 1], 350)
    s = super_min_hash(doc, np.concatenate([one, two]), 2, 180)
    assert abs((s[0] == s[1]).mean() - 0.75) < 0.1
    assert (super_min_hash(np.zeros(1, int), one[:1], 1, 180) != np.iinfo(np.uint64).max).all()
