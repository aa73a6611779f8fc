"""Mixing sources to target weights by iterative proportional fitting, with column expressions and SQL aggregates only.

Token totals of the cells (source, language, topic) are raked until the
expected tokens of every source, language and topic have their target shares.
A cell's weight is a product of three factors, one for each marginal, so only
these are fitted. Sources may be many: their factors stay in a table, one row
a source with its totals by (language, topic) pair. A sweep is one pass over
that table, and what comes back is one number for each (language, topic) pair.
Both sets are closed (topics are a fixed rule, languages are codes); more than
``most_pairs`` pairs raise an error rather than being cut.

Documents are then sampled without repeats. Without a token budget, a document's
probability is its cell's weight over the largest weight, so no probability
exceeds 1 and the expected shares are the targets, but the smallest cell sets
the size of the sample. With a budget (a share of all tokens), probabilities
are capped at 1 within the fitting: what a source, language or topic doesn't
have is dealt to the others in proportion to their targets, so the sample has
the expected size whatever the smallest cell. Where cells can't meet all three
marginals at once, sources are met and the others as near as the sweeps come.

Defined cases: null source, language or topic is a value of its own; null
texts have 0 tokens; cells without tokens don't take part in the fitting and
have probability 1 (they weigh nothing); rows that repeat a doc_id are drawn
together; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._cluster import columns_of, stored, table

SWEEPS, SEED, DIGITS = 40, 7, 9
#: Target shares are in proportion to tokens to this power: 1 keeps a marginal, 0 levels it.
POWERS = {"source": 0.5, "lang": 0.7, "topic": 0.8}


def n_words(text: Column) -> Column:
    return F.size(F.filter(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")).cast("long")


def topic_of(text: Column, tokens: Column) -> Column:
    """A closed set of topics by what a text shows: the first that fits."""
    return (
        F.when(F.contains(text, F.lit("License")), "licence")
        .when(F.contains(text, F.lit("@")), "contact")
        .when(F.contains(text, F.lit(" | ")), "table")
        .when(F.contains(text, F.lit("###")), "markup")
        .when(tokens < 100, "short")
        .when(tokens < 500, "medium")
        .otherwise("long")
    )


def rake(cells: DataFrame, powers: dict[str, float], sweeps: int, most_pairs: int) -> DataFrame:
    """source, lang, topic, weight for the ``cells`` (source, lang, topic, tokens > 0)."""
    pairs = sorted(cells.groupBy("lang", "topic").agg(F.sum("tokens").alias("tokens")).limit(most_pairs + 1).collect(), key=lambda r: (r["lang"] or "", r["topic"] or ""))
    if len(pairs) > most_pairs:
        raise ValueError(f"more than {most_pairs} pairs of language and topic")
    if not pairs:
        return cells.select("source", "lang", "topic", F.lit(1.0).alias("weight"))
    langs, topics = sorted({r["lang"] for r in pairs}), sorted({r["topic"] for r in pairs})
    number = F.create_map(*[F.lit(x) for k, r in enumerate(pairs) for x in (f"{r['lang']}\0{r['topic']}", k)])
    key = F.concat("lang", F.lit("\0"), "topic")
    by_source = stored(cells.groupBy("source").agg(F.sum("tokens").cast("double").alias("total"), F.collect_list(F.struct(number[key].alias("pair"), F.col("tokens").cast("double").alias("tokens"))).alias("parts")), "sources")
    share = F.pow("total", powers["source"])
    norm = by_source.agg(F.sum(share)).first()[0]

    def target(values: list[str], field: str) -> dict[str, float]:
        sums = {v: sum(r["tokens"] for r in pairs if r[field] == v) ** powers[field] for v in values}
        return {v: x / sum(sums.values()) for v, x in sums.items()}

    want_lang, want_topic = target(langs, "lang"), target(topics, "topic")
    b, c = dict.fromkeys(langs, 1.0), dict.fromkeys(topics, 1.0)

    def factor() -> Column:
        fit = F.array(*[F.lit(b[r["lang"]] * c[r["topic"]]) for r in pairs])
        return share / norm / F.aggregate("parts", F.lit(0.0), lambda a, p: a + p["tokens"] * F.get(fit, p["pair"]))

    for _ in range(sweeps):
        moved = by_source.select(factor().alias("a"), F.explode("parts").alias("p")).groupBy("p.pair").agg(F.sum(F.col("a") * F.col("p.tokens")).alias("x")).collect()
        mass = {(pairs[r["pair"]]["lang"], pairs[r["pair"]]["topic"]): r["x"] for r in moved}
        b = {v: want_lang[v] / sum(x * c[t] for (w, t), x in mass.items() if w == v) for v in langs}
        c = {v: want_topic[v] / sum(x * b[w] for (w, t), x in mass.items() if t == v) for v in topics}
    names = F.array(*[F.struct(F.lit(r["lang"]).alias("lang"), F.lit(r["topic"]).alias("topic"), F.lit(b[r["lang"]] * c[r["topic"]]).alias("fit")) for r in pairs])
    out = by_source.select("source", factor().alias("a"), F.explode("parts").alias("p")).select("source", "a", F.get(names, F.col("p.pair")).alias("n"))
    return out.select("source", "n.lang", "n.topic", (F.col("a") * F.col("n.fit")).alias("weight"))


def dealt(totals: dict[str, float], power: float, budget: float) -> dict[str, float]:
    """``budget`` in proportion to the totals to a power, no more to each than its total."""
    full: set[str] = set()
    while True:
        rest = {v: x**power for v, x in totals.items() if v not in full}
        rate = (budget - sum(totals[v] for v in full)) / sum(rest.values()) if rest else 0.0
        over = {v for v, x in rest.items() if rate * x >= totals[v]}
        if not over:
            return {v: totals[v] if v in full else rate * rest[v] for v in totals}
        full |= over


def rake_to(cells: DataFrame, budget_share: float, powers: dict[str, float], sweeps: int, most_pairs: int) -> DataFrame:
    """source, lang, topic, weight (a probability) for the ``cells`` (source, lang, topic, tokens > 0): expected tokens are ``budget_share`` of all."""
    pairs = sorted(cells.groupBy("lang", "topic").agg(F.sum("tokens").alias("tokens")).limit(most_pairs + 1).collect(), key=lambda r: (r["lang"], r["topic"]))
    if len(pairs) > most_pairs:
        raise ValueError(f"more than {most_pairs} pairs of language and topic")
    if not pairs:
        return cells.select("source", "lang", "topic", F.lit(1.0).alias("weight"))
    budget = budget_share * sum(r["tokens"] for r in pairs)
    number = F.create_map(*[F.lit(x) for k, r in enumerate(pairs) for x in (f"{r['lang']}\0{r['topic']}", k)])
    key = F.concat("lang", F.lit("\0"), "topic")
    by_source = stored(cells.groupBy("source").agg(F.sum("tokens").cast("double").alias("total"), F.collect_list(F.struct(number[key].alias("pair"), F.col("tokens").cast("double").alias("tokens"))).alias("parts")), "sources")
    # sources stay in their table: the rate at which the uncapped ones fill the budget rises to its value
    share, rate = F.pow("total", powers["source"]), 0.0
    while True:
        full = F.lit(rate) * share >= F.col("total")
        r = by_source.agg(F.sum(F.when(full, F.col("total")).otherwise(0.0)).alias("full"), F.sum(F.when(full, 0.0).otherwise(share)).alias("rest")).first()
        found = (budget - r["full"]) / r["rest"] if r["rest"] else rate
        if found <= rate * (1 + 1e-12):
            break
        rate = found
    want_source = F.least(F.lit(rate) * share, F.col("total"))
    langs, topics = sorted({r["lang"] for r in pairs}), sorted({r["topic"] for r in pairs})
    sums = {field: {v: float(sum(r["tokens"] for r in pairs if r[field] == v)) for v in values} for field, values in (("lang", langs), ("topic", topics))}
    want = {field: dealt(x, powers[field], budget) for field, x in sums.items()}
    factor = {"lang": dict.fromkeys(langs, 1.0), "topic": dict.fromkeys(topics, 1.0)}

    def rated() -> DataFrame:
        """source, pair, tokens, weight: each source's factor is exact, its cells of the largest factors being capped one by one."""
        fit = F.array(*[F.lit(factor["lang"][r["lang"]] * factor["topic"][r["topic"]]) for r in pairs])
        falling = F.array_sort(F.transform("parts", lambda p: F.named_struct(F.lit("less"), -F.get(fit, p["pair"]), F.lit("pair"), p["pair"], F.lit("tokens"), p["tokens"])))
        held = by_source.select("source", "total", want_source.alias("want"), falling.alias("parts"))
        start = F.named_struct(F.lit("left"), "want", F.lit("rest"), F.aggregate("parts", F.lit(0.0), lambda a, p: a - p["less"] * p["tokens"]), F.lit("open"), F.lit(True))

        def cap(a: Column, p: Column) -> Column:
            hit = a["open"] & (-a["left"] * p["less"] >= a["rest"])
            return F.named_struct(F.lit("left"), F.when(hit, a["left"] - p["tokens"]).otherwise(a["left"]), F.lit("rest"), F.when(hit, a["rest"] + p["less"] * p["tokens"]).otherwise(a["rest"]), F.lit("open"), hit)

        whole = F.col("want") >= F.col("total") * (1 - 1e-9)
        a = F.aggregate("parts", start, cap, lambda x: x["left"] / F.nullif(x["rest"], F.lit(0.0)))
        cell = held.select("source", whole.alias("whole"), a.alias("a"), F.explode("parts").alias("p"))
        return cell.select("source", "p.pair", "p.tokens", F.when(F.col("whole"), 1.0).otherwise(F.least(F.lit(1.0), -F.col("a") * F.col("p.less"))).alias("weight"))

    for k in range(2 * sweeps):
        field = ("lang", "topic")[k % 2]
        moved = rated().groupBy("pair").agg(F.sum(F.col("weight") * F.col("tokens")).alias("x")).collect()
        have = dict.fromkeys(sums[field], 0.0)
        for r in moved:
            have[pairs[r["pair"]][field]] += r["x"]
        factor[field] = {v: min(max(x * want[field][v] / have[v], 1e-9), 1e9) for v, x in factor[field].items()}
    names = F.array(*[F.struct(F.lit(r["lang"]).alias("lang"), F.lit(r["topic"]).alias("topic")) for r in pairs])
    return rated().select("source", F.get(names, F.col("pair")).alias("n"), "weight").select("source", "n.lang", "n.topic", "weight")


def draw(doc_id: Column, seed: int = SEED) -> Column:
    """A number in [0, 1) that depends on the id and the seed only."""
    return F.conv(F.substring(F.md5(F.encode(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(f":{seed}")), "UTF-8")), 1, 13), 16, 10).cast("double") / 2.0**52


def mix(docs: DataFrame, powers: dict[str, float] | None = None, sweeps: int = SWEEPS, seed: int = SEED, most_pairs: int = 10_000, budget_share: float | None = None) -> DataFrame:
    """One row for each of ``docs`` (doc_id, text, source, lang): doc_id, source, lang, topic, n_tokens, probability, selected."""
    docs = columns_of(docs, {"doc_id": "long", "text": "string", "source": "string", "lang": "string"})
    counted = docs.select("doc_id", "source", "lang", "text", n_words(F.col("text")).alias("n_tokens"))
    facts = stored(counted.select("doc_id", "source", "lang", topic_of(F.coalesce("text", F.lit("")), F.col("n_tokens")).alias("topic"), "n_tokens"), "facts")
    # nulls become a key of their own
    keys = {c: F.concat(F.when(F.col(c).isNull(), "-").otherwise("="), F.coalesce(c, F.lit(""))) for c in ("source", "lang", "topic")}
    cells = facts.groupBy(*[k.alias(c) for c, k in keys.items()]).agg(F.sum("n_tokens").alias("tokens")).filter("tokens > 0")
    cells = stored(cells, "cells")
    if budget_share is None:
        weights = stored(rake(cells, powers or POWERS, sweeps, most_pairs), "weights")
        top = weights.agg(F.max("weight")).first()[0] or 1.0
    else:
        weights, top = stored(rake_to(cells, budget_share, powers or POWERS, sweeps, most_pairs), "weights"), 1.0
    share = weights.select(*[F.col(c).alias(f"_{c}") for c in keys], F.round(F.col("weight") / top, DIGITS).alias("p"))
    joined = facts.join(share, [keys[c] == F.col(f"_{c}") for c in keys], "left")
    p = F.coalesce("p", F.lit(1.0))
    return joined.select("doc_id", "source", "lang", "topic", "n_tokens", p.alias("probability"), (draw(F.col("doc_id"), seed) < p).alias("selected"))


def op9_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))


def _sql() -> str:
    """The same fitting, sweep by sweep, as one statement."""
    keys = {c: f"CASE WHEN {c} IS NULL THEN '-' ELSE '=' || {c} END" for c in ("source", "lang", "topic")}
    steps = [
        "counted AS (SELECT doc_id, source, lang, coalesce(text, '') AS body, len(list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> ''))::BIGINT AS n_tokens FROM documents)",
        "facts AS (SELECT doc_id, source, lang, n_tokens, CASE WHEN contains(body, 'License') THEN 'licence' WHEN contains(body, '@') THEN 'contact' WHEN contains(body, ' | ') THEN 'table' WHEN contains(body, '###') THEN 'markup' WHEN n_tokens < 100 THEN 'short' WHEN n_tokens < 500 THEN 'medium' ELSE 'long' END AS topic FROM counted)",
        f"cells AS MATERIALIZED (SELECT {keys['source']} AS source, {keys['lang']} AS lang, {keys['topic']} AS topic, sum(n_tokens)::DOUBLE AS w FROM facts GROUP BY 1, 2, 3 HAVING sum(n_tokens) > 0)",
    ]
    for c, power in POWERS.items():
        steps.append(f"want_{c} AS MATERIALIZED (SELECT {c}, pow(sum(w), {power}) / sum(pow(sum(w), {power})) OVER () AS want FROM cells GROUP BY {c})")
    last = "cells"
    for k in range(SWEEPS):
        for c in POWERS:
            name = f"s{k}_{c}"
            steps.append(f"{name} AS MATERIALIZED (SELECT source, lang, topic, w * want / sum(w) OVER (PARTITION BY {c}) AS w FROM {last} JOIN want_{c} USING ({c}))")
            last = name
    steps.append(f"weights AS (SELECT source AS s, lang AS l, topic AS t, x.w / cells.w AS weight FROM {last} x JOIN cells USING (source, lang, topic))")
    steps.append(f"share AS (SELECT s, l, t, round(weight / max(weight) OVER (), {DIGITS}) AS p FROM weights)")
    draw_sql = f"('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || ':{SEED}'), 1, 13))::BIGINT / 4503599627370496.0"
    return f"WITH {', '.join(steps)} SELECT doc_id, source, lang, topic, n_tokens, coalesce(p, 1.0) AS probability, {draw_sql} < coalesce(p, 1.0) AS selected FROM facts LEFT JOIN share ON s = {keys['source']} AND l = {keys['lang']} AND t = {keys['topic']}"


OP9_SQL = _sql()
