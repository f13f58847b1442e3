"""Quality rules with risk-controlled cutoffs, in DataFrame functions alone.

Each rule compares one ratio of a text with a cutoff of the text's stratum (its language). The
cutoffs come from labelled documents: for a stratum and a rule, cutoffs are tried from the most
lenient to stricter ones, and the last is taken for which an exact binomial test still shows that
the rule rejects fewer than `risk` / rules of the good documents. Trying in a fixed order and
stopping at the first failure needs no correction within a rule; between rules and strata the
error `delta` is divided (Bonferroni). A stratum with too few labels gets no cutoff and rejects nothing.

What is guaranteed: with probability 1 - delta, in no stratum do the rules reject more than `risk` of the good documents
that pass the base rules. The base rules are fixed beforehand and stand outside of the bound: what they
reject is rejected whatever the labels say. The test takes labelled documents as independent draws, so documents of
one stratum with equal texts count once (told by a 64-bit hash); near copies still count each.

Null text has no words; null strata are a stratum of their own, of any number of strata. Repeated rows are judged
alike; of a document's repeated labels the smallest counts. Other columns may have any names.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from orrery.llm.shared import table, written

SPACE = "[\\x20\\x09-\\x0D]+"
SYMBOLS = "#*$%&|<>"
RISK, DELTA = 0.02, 0.05
#: Strata whose cutoffs are broadcast; those of more meet the documents by a join that is salted SALTS times.
MAX_STRATA, SALTS = 10_000, 64
CUTOFFS = {
    "symbols": [0.5, 0.3, 0.2, 0.15, 0.1, 0.08, 0.06, 0.05, 0.04, 0.03, 0.02, 0.015, 0.01, 0.005],
    "dup_lines": [0.9, 0.8, 0.7, 0.6, 0.5, 0.45, 0.4, 0.35, 0.3, 0.25, 0.2, 0.15, 0.1],
    "repeats": [0.9, 0.8, 0.7, 0.6, 0.5, 0.45, 0.4, 0.35, 0.3, 0.25, 0.2, 0.15, 0.1, 0.05],
    "capitals": [0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.35, 0.3, 0.25, 0.2, 0.15, 0.1],
}


def statistics(docs: DataFrame, keep: list[str], text_col: str = "text") -> DataFrame:
    """The kept columns (as given) and n_words, word_chars, n_symbols, n_dup_lines, n_lines, n_repeat_words, n_capitals, text_hash.

    A window of three words is told by a 64-bit hash; windows are compared within one text only.
    """
    n = F.size("_w")
    zipped = F.arrays_zip(F.col("_w").alias("a"), F.slice("_w", 2, F.greatest(n, F.lit(1))).alias("b"), F.slice("_w", 3, F.greatest(n, F.lit(1))).alias("c"))
    grams = F.slice(F.transform(zipped, lambda z, i: F.struct(F.xxhash64(z["a"], z["b"], z["c"]).alias("g"), i.alias("p"))), 1, F.greatest(n - 2, F.lit(0)))
    twice = F.filter(F.arrays_zip(F.col("_g").alias("a"), F.slice("_g", 2, F.greatest(F.size("_g"), F.lit(1))).alias("b")), lambda z: z["a"]["g"] == z["b"]["g"])
    spread = F.flatten(F.transform(twice, lambda z: F.array(*[z[k]["p"] + d for k in "ab" for d in range(3)])))
    out = docs.select(*keep, F.coalesce(F.col(text_col), F.lit("")).alias("_t"))
    out = out.select(*keep, F.xxhash64("_t").alias("_h"), F.array_remove(F.split("_t", SPACE), "").alias("_w"), F.filter(F.split("_t", "\n"), lambda x: F.translate(x, " \t\x0b\f\r", "") != "").alias("_l"))
    out = out.select(*keep, "_h", "_w", F.array_join("_w", "").alias("_j"), F.sort_array(grams).alias("_g"), F.size("_l").alias("_nl"), F.size(F.array_distinct("_l")).alias("_dl"))
    return out.select(
        *keep,
        F.size("_w").cast("long").alias("n_words"),
        F.length("_j").cast("long").alias("word_chars"),
        (F.length("_j") - F.length(F.translate("_j", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.col("_nl") - F.col("_dl")).cast("long").alias("n_dup_lines"),
        F.col("_nl").cast("long").alias("n_lines"),
        F.size(F.array_distinct(spread)).cast("long").alias("n_repeat_words"),
        (F.length("_j") - F.length(F.translate("_j", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))).cast("long").alias("n_capitals"),
        F.col("_h").alias("text_hash"),
    )


def ratios() -> dict[str, Column]:
    """Each rule's ratio; null where there is nothing to divide by."""
    return {
        "symbols": F.try_divide("n_symbols", "word_chars"),
        "dup_lines": F.try_divide("n_dup_lines", "n_lines"),
        "repeats": F.try_divide("n_repeat_words", "n_words"),
        "capitals": F.try_divide("n_capitals", "word_chars"),
    }


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def binomial_tail(k: Column, n: Column, p: float) -> Column:
    """P(X <= k) of a binomial X, exactly by its terms; 1 where k >= n p, for there it is near a half or more."""
    step = math.log(p / (1 - p))
    terms = F.aggregate(
        F.sequence(F.lit(1), F.greatest(k, F.lit(1)).cast("int")),
        F.struct((n * math.log1p(-p)).alias("t"), F.exp(n * math.log1p(-p)).alias("s")),
        lambda a, i: F.when(i > k, a).otherwise(F.struct((a["t"] + F.log((n - i + 1) / i) + step).alias("t"), (a["s"] + F.exp(a["t"] + F.log((n - i + 1) / i) + step)).alias("s"))),
    )
    return F.when(k >= n * p, F.lit(1.0)).otherwise(terms["s"])


def good_ids(labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The ids (_id) of documents labelled good."""
    return labels.where(F.col(id_col).isNotNull() & F.col("quality").isNotNull()).groupBy(F.col(id_col).alias("_id")).agg(F.min("quality").alias("_q")).where("_q = 1").select("_id")


def cutoffs(stats: DataFrame, labels: DataFrame, risk: float = RISK, id_col: str = "doc_id", stratum_col: str = "lang") -> DataFrame:
    """One row per stratum, rule and cutoff: n_good, n_rejected, p_value, and the worst p-value up to it."""
    rows = _only(stats, ~base_failed()).select(F.col(id_col).alias("_id"), F.col(stratum_col).cast("string").alias("stratum"), "text_hash", *[r.alias(f"_{k}") for k, r in ratios().items()]).join(good_ids(labels, id_col), "_id")
    rows = rows.groupBy("stratum", "text_hash").agg(*[F.max(f"_{k}").alias(f"_{k}") for k in CUTOFFS])  # equal texts have equal ratios
    beyond = {k: sum((F.when(F.col(f"_{k}") > x, 1).otherwise(0) for x in c), F.lit(0)) for k, c in CUTOFFS.items()}
    passed = F.array(*[F.struct(F.lit(k).alias("rule"), n.alias("beyond")) for k, n in beyond.items()])
    counts = rows.select("stratum", F.explode(passed).alias("_r")).groupBy("stratum", "_r.rule", "_r.beyond").agg(F.count("*").alias("n"))
    # a ratio passes the cutoffs from the strictest up, so a row beyond b cutoffs is beyond the last b of the list
    sizes = F.create_map(*[F.lit(x) for k, c in CUTOFFS.items() for x in (k, len(c))])
    values = F.create_map(*[x for k, c in CUTOFFS.items() for x in (F.lit(k), F.array(*map(F.lit, c)))])
    grid = counts.groupBy("stratum", "rule").agg(F.sum("n").alias("n_good"), F.map_from_entries(F.collect_list(F.struct("beyond", "n"))).alias("by"))
    grid = grid.select("stratum", "rule", "n_good", "by", F.posexplode(values[F.col("rule")]).alias("at", "cutoff"))
    rejected = F.aggregate(F.map_entries("by"), F.lit(0).cast("long"), lambda a, e: a + F.when(e["key"] >= sizes[F.col("rule")] - F.col("at"), e["value"]).otherwise(0))
    grid = grid.select("stratum", "rule", "n_good", "at", "cutoff", rejected.alias("n_rejected"))
    grid = grid.select("*", binomial_tail(F.col("n_rejected"), F.col("n_good"), risk / len(CUTOFFS)).alias("p_value"))
    return grid.select("*", F.max("p_value").over(Window.partitionBy("stratum", "rule").orderBy("at")).alias("worst"))


def fit(stats: DataFrame, labels: DataFrame, risk: float = RISK, delta: float = DELTA, id_col: str = "doc_id", stratum_col: str = "lang") -> DataFrame:
    """The strictest safe cutoffs as a written table: a row per stratum that has any, with a column per rule."""
    found = written(cutoffs(stats, labels, risk, id_col, stratum_col), "cutoffs")
    strata = found.select("stratum").distinct().count()
    safe = found.where(F.col("worst") <= delta / (len(CUTOFFS) * max(1, strata)))
    return written(safe.groupBy("stratum").agg(*[F.max_by(F.when(F.col("rule") == k, F.col("cutoff")), F.when(F.col("rule") == k, F.col("at"))).alias(f"max_{k}") for k in CUTOFFS]), "chosen")


def _only(stats: DataFrame, condition: Column) -> DataFrame:
    """The rows of a condition on statistics. A filter that were pushed below them would compute each of them again; a row number in it keeps it above."""
    return stats.withColumn("_at", F.monotonically_increasing_id()).where(condition & (F.col("_at") >= 0)).drop("_at")


def judge(stats: DataFrame, chosen: DataFrame, stratum_col: str = "lang") -> DataFrame:
    """The statistics with base_failed and kept: whether the base rules pass and no ratio is beyond its stratum's cutoff."""
    limits = chosen.select(F.col("stratum").alias("_stratum"), *[F.col(f"max_{k}").alias(f"_max_{k}") for k in CUTOFFS])
    rows, on = stats, F.col(stratum_col).cast("string").eqNullSafe(F.col("_stratum"))
    if chosen.count() <= MAX_STRATA:
        limits = F.broadcast(limits)  # of MAX_STRATA rows at most
    else:
        limits = limits.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        rows, on = stats.withColumn("_deal", F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int")), on & (F.col("_deal") == F.col("_salt"))
    rows = rows.join(limits, on, "left")
    beyond = [F.coalesce(r > F.col(f"_max_{k}"), F.lit(False)) for k, r in ratios().items()]
    verdict = ~base_failed()
    for b in beyond:
        verdict &= ~b
    return rows.select(*stats.columns, base_failed().alias("base_failed"), verdict.alias("kept"))


def keep_good(docs: DataFrame, labels: DataFrame, risk: float = RISK, delta: float = DELTA) -> DataFrame:
    """The documents that pass, with their columns. To fit, statistics of all documents meet the labels, so that no text is shuffled; they are computed again for the verdicts."""
    named = docs.select(F.struct("*").alias("_row"), F.col("lang"), F.col("text"))
    chosen = fit(statistics(docs.select("doc_id", "lang", "text"), ["doc_id", "lang"]), labels, risk, delta)
    return _only(judge(statistics(named, ["_row", "lang"]), chosen), F.col("kept")).select("_row.*")


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = written(statistics(table(spark, sf_dir, "documents"), ["doc_id", "lang"]), "quality")
    out = judge(stats, fit(stats, table(spark, sf_dir, "labels")))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def _oracle_sql() -> str:
    """The same by SQL: the statistics, the exact binomial tests of labelled documents, and the verdicts."""
    rules = {"symbols": "n_symbols / nullif(word_chars, 0)", "dup_lines": "n_dup_lines / nullif(n_lines, 0)", "repeats": "n_repeat_words / nullif(n_words, 0)", "capitals": "n_capitals / nullif(word_chars, 0)"}
    grid = ", ".join(f"('{k}', {i}, {x!r}::DOUBLE)" for k, c in CUTOFFS.items() for i, x in enumerate(c))
    share = RISK / len(CUTOFFS)
    return f"""
WITH d AS (
  SELECT doc_id, lang, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents
), g AS (
  SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS gram FROM d, unnest(range(1, len(w) - 1)) u(i)
), r AS (
  SELECT doc_id, count(DISTINCT i + k) AS n FROM (SELECT doc_id, i FROM g QUALIFY count(*) OVER (PARTITION BY doc_id, gram) > 1), unnest([0, 1, 2]) v(k) GROUP BY doc_id
), s AS (
  SELECT d.doc_id, lang, t, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars,
    len(regexp_extract_all(t, '[#*$%&|<>]')) AS n_symbols, len(regexp_extract_all(t, '[A-Z]')) AS n_capitals, coalesce(r.n, 0) AS n_repeat_words,
    [x FOR x IN string_split(t, chr(10)) IF regexp_matches(x, '[^\\x20\\x09-\\x0D]')] AS l FROM d LEFT JOIN r USING (doc_id)
), f AS (
  SELECT *, len(l) AS n_lines, len(l) - len(list_distinct(l)) AS n_dup_lines, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM s
), q AS (
  SELECT *, {", ".join(f"{x} AS {k}" for k, x in rules.items())} FROM f
), good AS (
  SELECT DISTINCT lang, t, {", ".join(rules)} FROM q JOIN (SELECT doc_id FROM labels WHERE quality IS NOT NULL GROUP BY doc_id HAVING min(quality) = 1) USING (doc_id) WHERE NOT base_failed
), grid AS (
  SELECT * FROM (VALUES {grid}) v(rule, step, cutoff)
), tried AS (
  SELECT lang, rule, step, cutoff, count(*) AS n, count(*) FILTER (WHERE CASE rule {" ".join(f"WHEN '{k}' THEN {k}" for k in rules)} END > cutoff) AS k FROM good, grid GROUP BY lang, rule, step, cutoff
), p AS (
  SELECT *, CASE WHEN k >= n * {share!r} THEN 1.0 ELSE list_sum(list_transform(range(0, k + 1), lambda i: exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln({share!r}) + (n - i) * ln(1 - {share!r})))) END AS p_value FROM tried
), safe AS (
  SELECT lang, rule, cutoff, step FROM p QUALIFY max(p_value) OVER (PARTITION BY lang, rule ORDER BY step) <= {DELTA!r} / ({len(CUTOFFS)} * (SELECT count(*) FROM (SELECT DISTINCT lang FROM good)))
), chosen AS (
  SELECT lang, {", ".join(f"max_by(cutoff, step) FILTER (WHERE rule = '{k}') AS max_{k}" for k in rules)} FROM safe GROUP BY lang
)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols,
  CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed,
  NOT base_failed AND {" AND ".join(f"NOT coalesce({k} > max_{k}, false)" for k in rules)} AS kept
FROM q LEFT JOIN chosen ON q.lang IS NOT DISTINCT FROM chosen.lang
"""


ORACLE_SQL = _oracle_sql()
