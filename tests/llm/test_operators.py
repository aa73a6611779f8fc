"""The other operators on odd rows, and against brute force."""

import hashlib
import json
import math
import random
import re
import time
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cloakstone.llm import chat_format, fingerprints, hidden_markov, html_extraction, id_files, quality_rules, source_mixing, url_filter
from cloakstone.llm.bpe_automaton import digests, vocabulary_path

WORDS = re.compile("[^\x20\x09-\x0d]+")
ODD = [(1, "a b c", "en", "s"), (2, None, None, None), (3, "", "en", ""), (None, "x y z", "fr", "s"), (4, "w " * 30000, "en", "s"), (4, "w " * 30000, "en", "s"), (5, "é😀 \x85\n\n tail", "de", "t")]
KIND = "doc_id long, text string, lang string, source string"


def docs(spark, rows=None):
    """The odd rows, with further columns whose names are those of the operators."""
    df = spark.createDataFrame(ODD if rows is None else rows, KIND)
    return df.withColumns({c: F.lit("other") for c in ("ids", "n", "bucket", "run", "at", "kept", "row", "topic", "score", "n_chars")})


def made(n, seed=1):
    rng = random.Random(seed)
    letters = ["ra", "mo", "li", "ten", "sho", "qu"]
    word = lambda: "".join(rng.choice(letters) for _ in range(rng.randint(1, 3)))
    return [(i, " ".join(word() for _ in range(rng.randint(1, 120))), rng.choice(["en", "fr"]), rng.choice("sst")) for i in range(n)]


def test_quality_facts(spark):
    rows = made(60) + [(900, "same line\nsame line\n\n \nsame line", "en", "s"), (901, "a b c a b c d", "en", "s"), (902, "#$ <b> & |", "en", "s")]
    got = {r["doc_id"]: r for r in quality_rules.judge(docs(spark, rows)).collect()}
    for i, text, *_ in rows:
        w = WORDS.findall(text)
        windows = Counter(zip(w, w[1:], w[2:]))
        covered = {k + j for k in range(len(w) - 2) if windows[tuple(w[k : k + 3])] > 1 for j in range(3)}
        lines = [x for x in text.split("\n") if WORDS.search(x)]
        want = (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered))
        assert tuple(got[i][c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) == want, text
        assert got[i]["base_failed"] == (len(w) < 50 or 100 * len(covered) > 50 * len(w))
    odd = quality_rules.judge(docs(spark)).collect()
    assert len(odd) == len(ODD) and not any(r["kept"] for r in odd)
    assert quality_rules.judge(docs(spark, [])).collect() == []


def test_quality_rejects_what_is_unusual(spark):
    rng = random.Random(2)
    rows = [(i, t * 2, "en", "s") for i, t, *_ in made(200) if len(t.split()) >= 50]
    rows += [(9000 + i, " ".join("".join(rng.choice("xzqk#%&7") for _ in range(9)) for _ in range(80)), "en", "s") for i in range(3)]
    got = {r["doc_id"]: r for r in quality_rules.judge(docs(spark, [(i, " ".join(dict.fromkeys(t.split())) + " " + t, lang, s) for i, t, lang, s in rows]), least=50).collect()}
    assert all(got[9000 + i]["kept"] is False for i in range(3))
    good = [r for i, r in got.items() if i < 9000 and not r["base_failed"]]
    assert sum(r["kept"] for r in good) >= 0.97 * len(good)


def test_quality_keeps_rare_languages(spark):
    rng = random.Random(3)
    word = lambda letters: "".join(rng.choice(letters) for _ in range(rng.randint(3, 9)))
    many, few = [word("abcdefg") for _ in range(300)], [word("stuvwxyz") for _ in range(4000)]
    rows = [(i, " ".join(rng.choices(many, k=80)), "en", "s") for i in range(400)]
    rows += [(1000 + i, " ".join(rng.choices(few, k=80)), "es", "s") for i in range(20)] + [(2000, " ".join(rng.choices(few, k=80)), None, "s")]
    got = {r["doc_id"]: r for r in quality_rules.judge(docs(spark, rows)).collect()}
    assert sum(got[i]["kept"] for i in range(400)) >= 390
    assert all(r["kept"] for i, r in got.items() if i >= 1000)


def test_quality_rejects_what_is_too_predictable(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefghijklm") for _ in range(rng.randint(2, 9)))
    words = [word() for _ in range(3000)]
    line = " ".join(rng.sample(words, 60))
    rows = [(i, " ".join(rng.choices(words, k=rng.randint(60, 600))) + ("\n" + line if i % 10 == 0 else ""), "en", "s") for i in range(400)]
    rows += [(1000, line, "en", "s")] + [(2000 + i, rows[1][1], "en", "s") for i in range(200)]
    got = {r["doc_id"]: r for r in quality_rules.judge(docs(spark, rows)).collect()}
    assert not got[1000]["base_failed"] and not got[1000]["kept"] and got[1000]["log10_ppl"] < got[1000]["lower"]
    # a clean text that has many copies stays
    assert all(got[i]["kept"] for i in range(2000, 2200)) and sum(got[i]["kept"] for i in range(400)) >= 380


def test_quality_by_join_is_the_same(spark):
    rows = made(120, 9)
    one, two = (sorted(quality_rules.judge(docs(spark, rows), held_grams=h).collect(), key=str) for h in (1 << 23, 0))
    assert [r[:8] for r in one] == [r[:8] for r in two]
    for x, y in zip(one, two, strict=True):
        assert (x["log10_ppl"], x["kept"]) == (y["log10_ppl"], y["kept"]) or math.isclose(x["log10_ppl"], y["log10_ppl"], rel_tol=1e-6) and x["kept"] == y["kept"]


def test_kneser_ney_is_as_by_its_definition(spark):
    from cloakstone.llm import ngram_model
    from cloakstone.llm._words import texts_of

    rng = random.Random(5)
    texts = ["".join(rng.choices("aab b\u00e9c", k=rng.randint(0, 40))) for _ in range(60)]
    order = 4
    code, doc = ngram_model.byte_grams(texts_of(pa.array(texts)), order)
    assert np.bincount(doc, minlength=60).tolist() == [len(t.encode()) for t in texts]
    counts = Counter()
    for t in texts:
        x = [0] * (order - 1) + [b + 1 for b in t.encode()]
        counts.update(tuple(x[i - order + 1 : i + 1]) for i in range(order - 1, len(x)))
    packed = {g: sum(s << 9 * (order - 1 - i) for i, s in enumerate(g)) for g in counts}
    assert Counter(code.tolist()) == {packed[g]: n for g, n in counts.items()}
    levels = ngram_model.kneser_ney(spark.createDataFrame([(packed[g], n) for g, n in counts.items()], "code long, n long"), order)
    by = {order: counts}
    for k in range(order - 1, 0, -1):
        by[k] = Counter()
        for g, n in by[k + 1].items():
            by[k][g[1:]] += n if g[1] == 0 else 1
    cuts = {k: ngram_model.discounts(Counter(c.values())) for k, c in by.items()}
    cut = lambda k, n: cuts[k][min(n, 3) - 1]

    def p(g: tuple) -> float:
        if not g:
            return 1 / 256
        k, followers = len(g), {x: n for x, n in by[len(g)].items() if x[:-1] == g[:-1]}
        total = sum(followers.values())
        if not total:
            return p(g[1:])
        n = followers.get(g, 0)
        return (n - cut(k, n) if n else 0) / total + sum(cut(k, m) for m in followers.values()) / total * p(g[1:])

    for k, level in enumerate(levels, 1):
        got = {r["code"]: r["p"] for r in level.collect()}
        assert len(got) == len(by[k])
        for g in by[k]:
            assert math.isclose(got[sum(s << 9 * (k - 1 - i) for i, s in enumerate(g))], p(g), rel_tol=1e-9)
    some = next(iter(counts))[:-1]
    assert math.isclose(sum(p((*some, s)) for s in range(1, 257)), 1.0, rel_tol=1e-9)
    empty = ngram_model.kneser_ney(spark.createDataFrame([], "code long, n long"), 2)
    assert all(level.count() == 0 for level in empty)


def test_fingerprints(spark):
    rows = made(80, 3)
    got = {r["doc_id"]: r for r in fingerprints.fingerprints(docs(spark, rows)).collect()}
    order = sorted(rows)
    for k, (i, text, *_) in enumerate(order):
        after, half = order[(k + 1) % len(order)][1], len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        assert got[i]["n_chars"] == len(text) and got[i]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        sets = [{tuple(w[j : j + 5]) for j in range(len(w) - 4)} or {tuple(w)} for w in (WORDS.findall(text), WORDS.findall(edited), WORDS.findall(after))]
        assert abs(got[i]["near_edited"] - len(sets[0] & sets[1]) / len(sets[0] | sets[1])) < 0.2
        assert abs(got[i]["near_next"] - len(sets[0] & sets[2]) / len(sets[0] | sets[2])) < 0.2
    odd = fingerprints.fingerprints(docs(spark)).collect()
    assert len(odd) == len(ODD)
    by = {r["doc_id"]: r for r in odd}
    assert by[2]["fingerprint"] == by[3]["fingerprint"] == "" and by[2]["near_next"] == 1.0
    one = fingerprints.fingerprints(docs(spark, [(7, "a b c d e f g", "en", "s")])).first()
    assert one["near_next"] == 1.0
    assert fingerprints.fingerprints(docs(spark, [])).collect() == []


def test_runs_cover_all_neighbours(spark):
    ids = sorted(random.Random(4).sample(range(10**6), 500)) + [7, 7]
    df = spark.createDataFrame([(i, f"t{i}") for i in ids], "doc_id long, text string")
    rows, window = fingerprints.followed(df, rows=20)
    got = sorted((r["doc_id"], r["next"]) for r in rows.withColumn("next", F.lead("doc_id").over(window)).filter("guest = 0").collect())
    ids = sorted(ids)
    assert got == sorted(zip(ids, ids[1:] + ids[:1], strict=True))


def test_bpe_and_files(spark, tmp_path):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(vocabulary_path())
    rows = ODD + [(10, "a <|endoftext|>  b<|endoftext|>", "en", "s")]
    got = digests(docs(spark, rows), vocabulary_path()).collect()
    want = sorted((i or 0, len(e := library.encode(t or "", add_special_tokens=False).ids), hashlib.sha256(np.array(e, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()) for i, t, *_ in rows)
    assert sorted((r["doc_id"] or 0, r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in got) == want
    folder = f"file://{tmp_path}/ids"
    manifest = id_files.write_files(docs(spark, rows).select("doc_id", "text"), vocabulary_path(), folder, rows=2, file_ids=50)
    assert manifest.filter("part > 0").count() and manifest.filter("run > 0").count()
    back = sorted(id_files.with_crc(id_files.read_files(manifest, folder)).collect(), key=lambda r: r["start"])
    at = 0
    for r, (i, t, *_) in zip(back, sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")), strict=True):
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 0]
        assert (r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) == (i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    none = id_files.write_files(docs(spark, []).select("doc_id", "text"), vocabulary_path(), f"{folder}-none")
    assert id_files.read_files(none, f"{folder}-none").collect() == []


@pytest.mark.parametrize("high", [1, 2, 300, 50257, 1 << 32])
def test_packed_blocks(high):
    rng = np.random.default_rng(high)
    for n in (0, 1, 127, 128, 129, 3000):
        ids = rng.integers(0, high, n, dtype=np.uint64).astype("<u4")
        ids[rng.random(n) < 0.05] = high - 1
        docs, back = id_files.read_file(id_files.file_bytes([5, None], [ids.tobytes(), b""]))
        assert (back == ids).all() and docs["n"].tolist() == [n, 0] and docs["present"].tolist() == [1, 0]


def test_hidden_markov(spark):
    rows = made(150, 5) + [(1000, None, "en", "s"), (1001, "Unknown WORDS only", "en", "s")]
    got = {r["doc_id"]: r for r in hidden_markov.score(docs(spark, rows), states=3, common=40, symbols=20).collect()}
    tokens = {i: [*WORDS.findall((t or "").lower()), None] for i, t, *_ in rows}
    train = Counter(x for i, w in tokens.items() if zlib.crc32(str(i).encode()) % 5 != 1 for x in w)
    total, distinct = sum(train.values()), len(train)
    for i, w in tokens.items():
        r = got[i]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (zlib.crc32(str(i).encode()) % 5 == 1, len(w), sum(train[x] > 0 for x in w), total)
        assert math.isclose(r["base_score"], sum(math.log10((train[x] + 0.5) / (total + 0.5 * (distinct + 1))) for x in w), rel_tol=1e-9, abs_tol=1e-9)
        assert r["score"] < 0
    odd = hidden_markov.score(docs(spark)).collect()
    assert len(odd) == len(ODD) and all(math.isfinite(r["score"]) for r in odd)
    assert hidden_markov.score(docs(spark, [])).collect() == []


def test_hidden_markov_trains_until_it_stops_rising(spark, monkeypatch):
    rng = random.Random(8)
    # after the first 5 tokens the texts go on in another way
    rows = [(i, " ".join([rng.choice("pq") for _ in range(5)] + [w for _ in range(20) for w in rng.choice([("a", "b", "c"), ("d", "e", "f")])]), "en", "s") for i in range(60)]
    models, update = [], hidden_markov.updated
    monkeypatch.setattr(hidden_markov, "updated", lambda *a: models.append(update(*a)) or models[-1])

    def trained(**more):
        models.clear()
        got = hidden_markov.score(docs(spark, rows), states=7, classes=64, **more).collect()
        # the model that training starts from comes first
        return len(models) - 1, sum(r["score"] for r in got if not r["held_out"]), sum(r["score"] - r["base_score"] for r in got if r["held_out"])

    rounds, score, gain = trained(tolerance=1e-6)
    assert rounds > 2 and gain > 0.3 * sum(len(t.split()) for i, t, *_ in rows if zlib.crc32(str(i).encode()) % 5 == 1) * math.log10(2)
    assert trained(tolerance=1.0)[1] < score


def test_hidden_markov_scores_by_its_definition(spark, monkeypatch):
    rows = made(80, 5) + [(1000, None, "en", "s"), (1001, "Unknown WORDS only", "en", "s")]
    kept, train, words = {}, hidden_markov.train, hidden_markov.vocabulary
    monkeypatch.setattr(hidden_markov, "train", lambda *a, **k: kept.setdefault("model", train(*a, **k)))
    monkeypatch.setattr(hidden_markov, "vocabulary", lambda *a: kept.setdefault("v", words(*a)))
    got = {r["doc_id"]: r["score"] for r in hidden_markov.score(docs(spark, rows), states=3, classes=16, common=60, symbols=25).collect()}
    model, v = kept["model"], kept["v"]
    from cloakstone.llm._words import texts_of

    counts = Counter(x for i, t, *_ in rows if zlib.crc32(str(i).encode()) % 5 != 1 for x in WORDS.findall((t or "").lower()))
    for i, t, *_ in rows:
        _, hashes, kind = hidden_markov.tokens_of(texts_of(pa.array([t or ""])), v.classes)
        own = dict(zip(v.symbols.tolist(), range(len(v.symbols)), strict=True))
        a, log = model.start, 0.0
        for n, (key, k, word) in enumerate(zip(hidden_markov.keys_of(hashes, kind).tolist(), kind.tolist(), [*WORDS.findall((t or "").lower()), None], strict=True)):
            symbol = v.classes + own[key] if key in own else k
            if key not in own:  # a word by its class, then by its count in the class
                log += math.log10(counts[word] + 0.5) - v.class_log[k]
            a = (a if n == 0 else a @ model.move) * model.emit[:, symbol]
            log += math.log10(a.sum())
            a = a / a.sum()
        assert math.isclose(got[i], log, rel_tol=1e-9)


def test_forward_is_exact():
    rng = np.random.default_rng(3)
    model = hidden_markov.Model(*(lambda a, b, c: (a / a.sum(), b / b.sum(1, keepdims=True), c / c.sum(1, keepdims=True)))(rng.random(3), rng.random((3, 3)), rng.random((3, 5))))
    sequences = [rng.integers(0, 5, n) for n in (1, 4, 0, 7, 4)]
    got = hidden_markov.forward(model, hidden_markov.by_step(sequences), len(sequences))
    for s, x in zip(sequences, got, strict=True):
        a = model.start.copy()
        for k, v in enumerate(s):
            a = (a if k == 0 else a @ model.move) * model.emit[:, v]
        assert math.isclose(x, math.log10(a.sum()) if len(s) else 0.0, abs_tol=1e-9)
    starts, moves, emissions, _ = hidden_markov.expected_counts(model, hidden_markov.by_step(sequences))
    assert math.isclose(starts.sum(), 4, rel_tol=1e-4) and math.isclose(moves.sum(), 12, rel_tol=1e-4) and math.isclose(emissions.sum(), 16, rel_tol=1e-4)


def hand_made_pages():
    """(page, main blocks) of layouts that the training pages don't share."""
    said = [
        "How rivers change their beds", "Rivers move sand and stones all year, and they never stop doing so.", "In spring the water rises quickly; in autumn it falls again.",
        "Let x be the height of the water in metres.", "Two things matter", "the slope of the valley", "how much rain falls", "A long drought leaves the bed dry, so that plants take hold between the stones, and their roots keep the banks in place for many years.", "Press Start to begin.",
    ]
    body = f"<h1>{said[0]}</h1><p>{said[1]}<p>{said[2]}<p>Let <math><mi>x</mi></math> be the height of the water in <object>metres</object>.</p><h2>{said[4]}</h2><ul><li>{said[5]}<li>{said[6]}</ul><p>{said[7]}</p><p>Press <button>Start</button> to begin.</p>"
    menu = "<a href=/>Home</a> <a href=/news>News</a> <a href=/shop>Shop</a>"
    yield f"<html><body><div id=topbar class='site-header'><nav>{menu}</nav></div><div class=content-wrapper><article class=post>{body}</article><aside class=sidebar><h4>Popular</h4><p><a href=1>Ten tips</a></p></aside></div><footer class=site-footer><p>&copy; 2024 River House</p></footer></body></html>", said
    yield f"<body><header><h2 class=logo>The Daily</h2>{menu}</header><main><section class=story>{body}</section><section id=comments class=comments><h3>3 comments</h3><div class=comment><p>I liked this very much, thanks!</p></div></section></main></body>", said
    yield f"<body><ul class='menu main-menu'><li>{menu}</li></ul><div class='cookie-banner'><p>We use cookies to make this site work.</p></div><div class='entry-content'>{body}</div><div class='advertisement'><p>Buy boots now!</p></div><form class='newsletter-signup'><p>Subscribe to our letter.</p><input></form></body>", said
    yield f"<body><nav class=breadcrumbs>{menu}</nav><article>{body}<div class=share-buttons>{menu}</div></article><div class=footer-links>{menu} Imprint</div></body>", said


def test_html_of_other_layouts():
    field = html_extraction.default_field()
    right = wrong = missing = 0
    for page, want in hand_made_pages():
        got = html_extraction.main_blocks(page, field)
        hit = Counter(got) & Counter(want)
        right, wrong, missing = right + hit.total(), wrong + len(got) - hit.total(), missing + len(want) - hit.total()
    assert right / (right + wrong) >= 0.95 and right / (right + missing) >= 0.95, (right, wrong, missing)


@pytest.mark.parametrize("page", ["<p a='" * 1_700_000, "<p a='>'" * 300_000, "<" * 3_000_000, "<![CDATA[" * 300_000, "<!--" * 500_000, "<b>a" * 300_000, "<span><dt>" * 100_000, "".join(f"<div class=x{i}>a" for i in range(100_000)), "<table><td>" * 30_000 + "</div>" * 90_000])
def test_html_is_read_in_linear_time(page):
    began = time.process_time()
    html_extraction.leaf_blocks(page, {})
    assert time.process_time() - began < 8


def test_html(spark):
    field = html_extraction.default_field()
    pages = html_extraction.training_pages(120, seed=5)
    tp = fp = fn = 0
    for page, main in pages:
        got, want = Counter(html_extraction.main_blocks(page, field)), Counter(main)
        tp, fp, fn = tp + sum((got & want).values()), fp + sum((got - want).values()), fn + sum((want - got).values())
    assert tp / (tp + fp) > 0.95 and tp / (tp + fn) > 0.95
    body = "<nav><ul><li><a href=/x>Home</a></ul></nav><article><h1>A &amp; B</h1><p>One\n two<br>three <b>four</b>, and more of it.<p>Five six seven, eight nine ten.</article><script>var x='<p>no</p>'</script><footer>&copy; x</footer>"
    rows = [(1, "u", body), (2, None, None), (3, "u", ""), (4, "u", "<div"), (5, "u", "plain"), (6, "u", "<p a='" * 3000)]
    got = {r["page_id"]: r["text"] for r in html_extraction.extract(spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit(1))).collect()}
    assert got[1] == "A & B\n\nOne two three four, and more of it.\n\nFive six seven, eight nine ten."
    assert got[2] == got[3] == "" and set(got) == {1, 2, 3, 4, 5, 6}


def test_viterbi_is_best():
    rng = np.random.default_rng(1)
    field = html_extraction.Field({}, rng.normal(size=2), rng.normal(size=(2, 2)))
    for n in (1, 2, 6):
        s = rng.normal(size=n)
        value = lambda y: field.first[y[0]] + sum(s[i] for i in range(n) if y[i]) + sum(field.pairs[a][b] for a, b in zip(y, y[1:]))
        every = [[k >> i & 1 for i in range(n)] for k in range(2**n)]
        assert [int(x) for x in html_extraction.viterbi(field, s)] == max(every, key=value)
        z = sum(math.exp(value(y)) for y in every)
        p, _ = html_extraction.marginals(field, s)
        assert np.allclose(p, [sum(math.exp(value(y)) for y in every if y[i]) / z for i in range(n)])


def test_urls(spark):
    urls, bad = url_filter.labelled_urls()
    trees = url_filter.fit(urls[:3000], bad[:3000])
    x = np.array([url_filter.features(u, trees.suffixes) for u in urls[3000:]])
    assert ((trees.score(x) >= 0.5) == np.array(bad[3000:])).mean() > 0.93
    rows = [(1, "http://WWW.Example.org/es/x?a#b"), (2, "https://a.org"), (3, "https://example.org/en/12"), (4, "x://m.a.com/fr/"), (5, "x://com/de/1"), (6, None), (7, "no scheme"), (8, "http://notexample.org.x/es/"), (9, "http://cheap-pills.example.net/en/1"), (10, "")]
    got = {r["page_id"]: r for r in url_filter.judge(spark.createDataFrame(rows, "page_id long, url string").withColumn("host", F.lit(1))).collect()}
    assert [(got[i]["host"], got[i]["path"], got[i]["rule"]) for i in (1, 2, 3, 4, 5, 6, 7)] == [("www.example.org", "/es/x", "example.org/es/"), ("a.org", "", None), ("example.org", "/en/12", "example.org/en/1"), ("m.a.com", "/fr/", "com/fr/"), ("com", "/de/1", "com/de/"), ("", "", None), ("", "", None)]
    assert got[9]["verdict"] == "block" and got[8]["rule"] is None
    # hosts that the labelled set doesn't hold, with hyphens and without
    clean = ["http://tionsh.example.net/fr/6550?utm_source=feed", "https://well-water.example.org/en/1", "https://www.stone-bridge-tours.com/a/b.html", "https://en.wikipedia.org/wiki/Rain", "http://m.harbour12.de/x"]
    junk = ["http://poker247.com/en/1", "https://freecasino.net/", "https://m.ads-track.example.com/es/9", "http://blog.spam-farm.example.org/a", "https://adult-x.example.com/fr/2", "http://cheaploans.biz/?id=3"]
    rows = list(enumerate(clean + junk)) + [(90, "http://a.net/" + "x" * 2_000_000), (91, "http://a.net/")]
    got = {r["page_id"]: r["verdict"] for r in url_filter.judge(spark.createDataFrame(rows, "page_id long, url string"), rules=[]).collect()}
    assert [got[i] for i in range(len(clean + junk))] == ["allow"] * len(clean) + ["block"] * len(junk)
    assert url_filter.judge(spark.createDataFrame([], "page_id long, url string")).collect() == []


def test_mixing(spark):
    rng = random.Random(6)
    # every combination occurs, so the targets can be met
    rows = [(i, "w " * rng.choice([3, 150, 700]), rng.choice(["en", "fr", None]), rng.choice(["a", "a", "a", "b", None])) for i in range(400)]
    got = source_mixing.mix(docs(spark, rows)).collect()
    assert len(got) == 400 and all(0 < r["probability"] <= 1 for r in got)
    for field in ("source", "lang", "topic"):
        have, base = Counter(), Counter()
        for r in got:
            have[r[field]] += r["n_tokens"] * r["probability"]
            base[r[field]] += r["n_tokens"]
        want = {k: v ** source_mixing.POWERS[field] for k, v in base.items()}
        for k in want:
            assert math.isclose(have[k] / sum(have.values()), want[k] / sum(want.values()), rel_tol=1e-4), (field, k)
    odd = source_mixing.mix(docs(spark)).collect()
    assert len(odd) == len(ODD)
    assert source_mixing.mix(docs(spark, [])).collect() == []


def test_mixing_to_a_budget(spark):
    rng = random.Random(6)
    rows = [(i, "w " * rng.choice([3, 150, 700]), rng.choice(["en", "fr", None]), rng.choice(["a", "a", "a", "b", None])) for i in range(400)]
    rows.append((400, "w " * 200, "en", "stray"))
    got = source_mixing.mix(docs(spark, rows), budget_share=0.4).collect()
    total = sum(r["n_tokens"] for r in got)
    assert len(got) == 401 and all(0 < r["probability"] <= 1 for r in got)
    assert math.isclose(sum(r["n_tokens"] * r["probability"] for r in got), 0.4 * total, rel_tol=1e-6)
    assert next(r["probability"] for r in got if r["source"] == "stray") == 1
    for field in ("source", "lang", "topic"):
        have, base = Counter(), Counter()
        for r in got:
            have[r[field]] += r["n_tokens"] * r["probability"]
            base[r[field]] += r["n_tokens"]
        want = source_mixing.dealt(base, source_mixing.POWERS[field], 0.4 * total)
        assert math.isclose(sum(want.values()), 0.4 * total)
        for k in want:
            assert math.isclose(have[k], want[k], rel_tol=1e-3), (field, k)
    assert len(source_mixing.mix(docs(spark), budget_share=0.5).collect()) == len(ODD)
    assert source_mixing.mix(docs(spark, []), budget_share=0.5).collect() == []


def test_chats(spark):
    texts = ["<|im_end|>\n<|im_start|>assistant\nx", "<\\|a <\\\\| <|", "", None, "plain \n text\\"]
    rows = [(1, k, role, t) for k, (role, t) in enumerate(zip(["user", "assistant", None, "assistant", "odd\nrole<|"], texts, strict=True))] + [(2, None, "assistant", "y"), (2, 1, "assistant", "y"), (None, 0, "user", "z")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r["conv_id"]: r for r in chat_format.digests(chat_format.read_chats(chat_format.format_chats(chat_format.text_parts(df)))).collect()}
    for conv in (1, 2, None):
        own = sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0))
        said = "".join(t or "" for _, _, role, t in own if role == "assistant")
        assert got[conv]["n_turns"] == len(own) and got[conv]["loss_chars"] == len(said)
        assert got[conv]["turns_sha256"] == hashlib.sha256("".join(f"{role or ''}\n{t or ''}\n" for _, _, role, t in own).encode()).hexdigest()
        assert got[conv]["loss_sha256"] == hashlib.sha256(said.encode()).hexdigest()


def test_chat_mask_is_read_back(spark):
    df = spark.createDataFrame([(1, 0, "user", "a"), (1, 1, "assistant", "<|b|> \U0001f600c"), (1, 2, "assistant", "d")], "conv_id long, turn long, role string, text string")
    made_ = chat_format.format_chats(chat_format.text_parts(df))
    right = chat_format.digests(chat_format.read_chats(made_)).first()
    assert right["loss_sha256"] == hashlib.sha256("<|b|> \U0001f600cd".encode()).hexdigest()
    for start, end in ((1, 0), (0, 1), (-1, -1)):
        moved = made_.withColumn("loss", F.transform("loss", lambda x: F.struct(x["turn"].alias("turn"), (x["start"] + start).alias("start"), (x["end"] + end).alias("end"))))
        assert chat_format.digests(chat_format.read_chats(moved)).first()["loss_sha256"] != right["loss_sha256"]


def test_typed_parts(spark):
    part = lambda kind, **more: {"kind": kind, "text": None, "ref": None, "width": None, "height": None, "seconds": None, "pages": None} | more
    rows = [(1, 0, "user", [part("text", text="see <|image|>"), part("image", ref="a.png", width=28, height=15), part("audio", ref="b.wav", seconds=2.0)]), (1, 1, "assistant", [part("document", ref="c.pdf", pages=2), part("text", text="ok")]), (1, 2, "user", None)]
    r = chat_format.format_chats(spark.createDataFrame(rows, f"conv_id long, turn long, role string, parts array<{chat_format.PART}>")).first()
    assert r["formatted"] == "<|im_start|>user\nsee <\\|image|><|image|><|audio|><|im_end|>\n<|im_start|>assistant\n<|document|>ok<|im_end|>\n<|im_start|>user\n<|im_end|>\n"
    assert [tuple(a) for a in r["attachments"]] == [(0, "image", "a.png", 4), (0, "audio", "b.wav", 50), (1, "document", "c.pdf", 2000)]
    assert r["attachment_tokens"] == 2054
    assert [r["formatted"][x["start"] : x["end"]] for x in r["loss"]] == ["<|document|>ok"]


def test_registry_and_pipeline(spark, tmp_path):
    import corpus_pipeline
    from cloakstone.llm import registry

    assert {q.split("_")[0] for q in registry.QUERIES if q.startswith("op")} == {f"op{n}" for n in range(1, 11)} and set(registry.ORACLE_SQL) <= set(registry.QUERIES)
    rows = [(i, f"{t} {t[::-1]} number {i}", lang, s) for i, t, lang, s in made(60, 9)]
    rows += [(1000 + i, rows[i][1], "en", "t") for i in range(20)]
    out = spark.createDataFrame(rows, KIND).withColumn("n_chars", F.length("text").cast("long"))
    for name, stage in corpus_pipeline.STAGES:
        given, out = out, stage(spark, out, str(tmp_path))
        out.write.parquet(str(tmp_path / name))
        out = spark.read.parquet(str(tmp_path / name))
        before, after = {r["doc_id"] for r in given.select("doc_id").collect()}, [r["doc_id"] for r in out.select("doc_id").collect()]
        assert after and set(after) <= before and len(set(after)) == len(after)
        if name == "near_dedup":
            assert not any(i >= 1000 for i in after)
    assert out.filter("NOT round_trip").count() == 0
    assert json.dumps([n for n, _ in corpus_pipeline.STAGES])


def test_pipeline_decides_by_row(spark, tmp_path):
    import corpus_pipeline

    texts = [t for _, t, *_ in made(200, 12) if len(t.split()) >= 60]
    clean, bad = [f"{t} {t[::-1]} number {i}" for i, t in enumerate(texts[:30])], "again and again " * 40
    # different texts without an id, and under one id; rows that fail with the ids of rows that pass; copies
    rows = [(None, t, "en", "s") for t in clean[:10]] + [(7, t, "en", "s") for t in clean[10:20]] + [(100 + i, t, "en", "s") for i, t in enumerate(clean[20:])]
    rows += [(None, bad, "en", "s"), (7, bad, "en", "s"), (7, clean[10], "en", "s"), (900, clean[0], "en", "s"), (None, clean[1], "fr", "t")]
    given = spark.createDataFrame(rows, KIND).withColumn("n_chars", F.length("text").cast("long"))
    stages = dict(corpus_pipeline.STAGES)
    passed = stages["quality_rules"](spark, given, str(tmp_path))
    got = Counter((r["doc_id"], r["text"]) for r in passed.collect())
    assert got == Counter((i, t) for i, t, *_ in rows if t != bad)
    once = stages["near_dedup"](spark, passed, str(tmp_path)).collect()
    assert sorted(r["text"] for r in once) == sorted(clean)
    assert {r["text"]: r["doc_id"] for r in once}[clean[0]] == 900
