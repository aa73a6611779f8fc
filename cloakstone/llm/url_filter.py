"""URL filters: rules for hosts and paths, and gradient-boosted trees on lexical features for what no rule fits.

Host: what follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z
lower-cased; path: what follows up to ``?``, ``#`` or the end. A rule is a host
and a path; it fits its host and every subdomain where the url's path starts
with the rule's; of those that fit, the longest wins.

The trees are fitted on labelled URLs (``labelled_urls`` makes a set of them
by rule; any other labelled list can be given), with logistic loss: each tree
halves the feature values' ranges at up to 32 quantiles, to ``depth`` levels.
Suffix statistics are the smoothed shares of bad URLs by the host's last
label, by its words, and by the four-letter pieces of these, learnt from the
same labels; what fewer than ``least`` labelled URLs show has the overall share.

Defined cases: null and urls without ``://`` have an empty host and path, no
rule fits them, and the trees judge their text as it is (null: empty); urls of
any length are read whole; repeated rows are each judged; an empty table gives
an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import random
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._cluster import columns_of, table
from ._words import batch_of

RULES = [("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block")]
WORDS = re.compile("[a-z]+")
FEATURES = ("length", "host_length", "path_length", "depth", "labels", "digit_share", "host_digit_share", "entropy", "parameters", "hyphens", "host_hyphens", "longest_run", "other_share", "suffix", "word", "piece", "pieces")


def host_of(url: Column) -> Column:
    rest = F.when(F.instr(url, "://") > 0, F.substr(url, F.instr(url, "://") + 3)).otherwise("")
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.coalesce(host, F.lit(""))


def path_of(url: Column) -> Column:
    rest = F.when(F.instr(url, "://") > 0, F.substr(url, F.instr(url, "://") + 3)).otherwise("")
    return F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def fits(rule: str, host: Column, path: Column) -> Column:
    at = rule.index("/")
    own = rule[:at]
    return ((host == own) | host.endswith("." + own)) & path.startswith(rule[at:])


def host_shows(host: str) -> tuple[str, list[str], list[str]]:
    """The keys of a host's suffix, words and pieces of words in the suffix statistics."""
    front, _, last = host.rpartition(".")
    words = WORDS.findall(front or last)
    return f".{last}", [f"w:{w}" for w in words], [f"p:{w[i : i + 4]}" for w in words for i in range(len(w) - 3)]


def entropy(text: str) -> float:
    n = len(text)
    return -sum(c / n * np.log2(c / n) for c in Counter(text).values()) if n else 0.0


def features(url: str | None, suffixes: dict[str, float]) -> list[float]:
    url = url or ""
    _, found, rest = url.partition("://")
    rest = rest if found else url
    ends = [i for i in (rest.find(c) for c in "/?#") if i >= 0]
    host = rest[: min(ends, default=len(rest))].lower()
    path, _, query = rest[len(host) :].partition("#")[0].partition("?")
    labels = host.split(".")
    runs = max((len(x) for x in labels), default=0)
    digits = sum(c.isdigit() for c in rest)
    prior = suffixes[""]
    suffix, words, pieces = host_shows(host)
    shares = [suffixes.get(x, prior) for x in pieces]
    return [
        len(rest),
        len(host),
        len(path),
        sum(1 for x in path.split("/") if x),
        len(labels),
        digits / max(1, len(rest)),
        sum(c.isdigit() for c in host) / max(1, len(host)),
        entropy(host),
        sum(1 for x in query.split("&") if x),
        rest.count("-"),
        host.count("-"),
        runs,
        sum(not (c.isalnum() or c in "./-") for c in rest) / max(1, len(rest)),
        suffixes.get(suffix, prior),
        max((suffixes.get(w, prior) for w in words), default=prior),
        max(shares, default=prior),
        sum(shares) / len(shares) if shares else prior,
    ]


class Trees(NamedTuple):
    """Of each tree: feature and threshold of its inner nodes in level order, values of its leaves."""

    base: float
    feature: np.ndarray
    threshold: np.ndarray
    leaf: np.ndarray
    suffixes: dict[str, float]

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability that a url is bad."""
        total = np.full(len(x), self.base)
        depth = int(self.feature.shape[1] + 1).bit_length() - 1
        for feature, threshold, leaf in zip(self.feature, self.threshold, self.leaf, strict=True):
            node = np.zeros(len(x), np.int64)
            for _ in range(depth):
                node = 2 * node + 1 + (x[np.arange(len(x)), feature[node]] > threshold[node])
            total += leaf[node - len(feature)]
        return 1 / (1 + np.exp(-total))


def fit(urls: list[str], bad: list[int], trees: int = 60, depth: int = 3, rate: float = 0.2, least: int = 5) -> Trees:
    """Trees for at most 20,000 labelled urls (more are an error: pass a sample)."""
    if len(urls) > 20_000:
        raise ValueError("pass at most 20,000 labelled urls")
    y = np.array(bad, float)
    prior = (y.sum() + 1) / (len(y) + 2)
    seen: dict[str, list[float]] = {}
    for url, b in zip(urls, bad, strict=True):
        host = re.split("[/?#]", url.partition("://")[2] or url, maxsplit=1)[0].lower()
        suffix, words, pieces = host_shows(host)
        for key in {suffix, *words, *pieces}:
            seen.setdefault(key, []).append(b)
    suffixes = {k: (sum(v) + 10 * prior) / (len(v) + 10) for k, v in seen.items() if len(v) >= least} | {"": prior}
    x = np.array([features(u, suffixes) for u in urls], float).reshape(len(urls), len(FEATURES))
    base = float(np.log(prior / (1 - prior)))
    total, inner = np.full(len(y), base), 2**depth - 1
    cuts = [np.unique(np.quantile(x[:, k], np.linspace(0.02, 0.98, 32))) if len(x) else np.zeros(0) for k in range(len(FEATURES))]
    out: list[tuple] = []
    for _ in range(trees if len(y) else 0):
        p = 1 / (1 + np.exp(-total))
        g, h = y - p, p * (1 - p)
        feature, threshold, leaf = np.zeros(inner, np.int64), np.full(inner, np.inf), np.zeros(2**depth)
        node = np.zeros(len(y), np.int64)
        for n in range(inner):
            at = np.flatnonzero(node == n)
            best = 1e-6
            for k, values in enumerate(cuts):
                if len(at) < 2 * least:
                    break
                right = x[at, k][:, None] > values[None, :]
                many = right.sum(0)
                gr, hr = g[at] @ right, h[at] @ right
                gl, hl = g[at].sum() - gr, h[at].sum() - hr
                gain = gr**2 / (hr + 1) + gl**2 / (hl + 1) - g[at].sum() ** 2 / (h[at].sum() + 1)
                gain[(many < least) | (len(at) - many < least)] = 0
                if len(gain) and gain.max() > best:
                    best = gain.max()
                    feature[n], threshold[n] = k, values[gain.argmax()]
            node[at] = 2 * n + 1 + (x[at, feature[n]] > threshold[n])
        for i in range(2**depth):
            at = node == inner + i
            leaf[i] = rate * g[at].sum() / (h[at].sum() + 1)
        total += leaf[node - inner]
        out.append((feature, threshold, leaf))
    empty = np.zeros((0, inner))
    return Trees(base, *((np.array(z) for z in zip(*out, strict=True)) if out else (empty.astype(np.int64), empty, np.zeros((0, 2**depth)))), suffixes)


def labelled_urls(n: int = 6000, seed: int = 3) -> tuple[list[str], list[int]]:
    """Made-up urls with labels: 1 for advertising and junk hosts, 0 for others. Hyphens, digits and rare suffixes occur in both."""
    rng = random.Random(seed)
    parts = "th re on an er ti in at ou ha be st ing ed ra mo lu ka sel vin dor per tal nor mi".split()
    lures = "cheap free win casino pills loan poker adult bonus deal sale farm spam bet bets cash xxx dating crypto replica diet ads track".split()
    plain = "city news book river school garden music park green north house water science paper history health sport travel food art".split()
    tails = "com org net info example.com example.org example.net de fr co.uk edu".split()
    odd_tails = "xyz top click biz win loan info com net".split()
    word = lambda: "".join(rng.choice(parts) for _ in range(rng.randint(2, 4)))
    junk = lambda a, b: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz0123456789") for _ in range(rng.randint(a, b)))
    letters = lambda a, b: "".join(rng.choice(("aeiou", "bcdfghklmnprstvw")[k % 2]) for k in range(rng.randint(a, b)))
    urls, bad = [], []
    for _ in range(n):
        path = "/".join([rng.choice(["en", "fr", "de", "es", word()]), *(rng.choice([word(), str(rng.randint(1, 99999))]) for _ in range(rng.randint(0, 3)))])
        end = rng.choice(["", "", "/", ".html", ".php", f"?id={rng.randint(1, 999)}", f"?q={word()}&lang=en", "?page=2&sort=new", "#part"])
        front = rng.choice(["", "", "www.", "m.", "blog.", "shop.", "cdn.", "en.", "news.", "api."])
        if is_bad := rng.random() < 0.4:
            lure = rng.choice(lures)
            number = str(rng.randint(1, 999))
            host = rng.choice([f"{lure}-{word()}", f"{lure}-{rng.choice(lures)}", f"{word()}-{lure}", f"{lure}-{rng.choice('xyz')}", f"{lure}{number}", f"{lure}{rng.choice(lures)}", f"{lure}{word()}", f"{word()}{lure}{number}", f"{lure}-{lure}-{number}", junk(14, 24)])
            end = rng.choice([end, end, f"?{junk(2, 5)}={junk(8, 20)}&{junk(2, 5)}={junk(8, 20)}&aff={number}"])
        else:
            host = rng.choice([word(), word(), word(), word() + word(), letters(4, 11), f"{word()}-{word()}", f"{rng.choice(plain)}-{word()}", f"{rng.choice(plain)}{rng.choice(plain)}", f"{word()}-{rng.choice(plain)}", f"{word()}{rng.randint(1, 99)}"])
        urls.append(f"{rng.choice(['http', 'https'])}://{front}{host}.{rng.choice(odd_tails if is_bad and rng.random() < 0.5 else tails)}/{path}{end}")
        bad.append(int(is_bad))
    return urls, bad


@lru_cache(maxsize=1)
def default_trees() -> Trees:
    return fit(*labelled_urls())


def judge(pages: DataFrame, rules: list[tuple[str, str]] | None = None, trees: Trees | None = None, threshold: float = 0.5) -> DataFrame:
    """page_id, host, path, rule, verdict, score for each row of ``pages`` (page_id, url)."""
    pages = columns_of(pages, {"page_id": "long", "url": "string"})
    shared = pages.sparkSession.sparkContext.broadcast(trees or default_trees())

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            x = np.array([features(u, model.suffixes) for u in batch.column("url").to_pylist()], float).reshape(batch.num_rows, len(FEATURES))
            yield batch_of(page_id=batch.column("page_id"), url=batch.column("url"), score=model.score(x))

    split = pages.mapInArrow(scored, "page_id long, url string, score double").select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), "score")
    chosen, verdict = F.lit(None).cast("string"), F.when(F.col("score") >= threshold, "block").otherwise("allow")
    for rule, what in sorted(rules if rules is not None else RULES, key=lambda r: len(r[0])):  # longer rules go outside, so they win
        fit_ = fits(rule, F.col("host"), F.col("path"))
        chosen, verdict = F.when(fit_, rule).otherwise(chosen), F.when(fit_, what).otherwise(verdict)
    return split.select("page_id", "host", "path", chosen.alias("rule"), verdict.alias("verdict"), "score")


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages"))
