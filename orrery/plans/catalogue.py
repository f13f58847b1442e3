"""The library's queries over the test tables, each with its SQL where SQL can express it.

Values are rounded for presentation only. Tables are read as they are: time columns have no zone.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from orrery.functions import dsl, exprs
from orrery.functions.constants import EVENT_TYPES, FIBONACCI, HYPOTHESES, PHI, PHI_INV, PRIORS, TAU, ETA
from orrery.functions.exprs import rounded
from orrery.operators import assign, diff, divergence, events as ev, exact, graph, ledger, markov, perf, profile as pf, retrieve, verdict

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def read(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def shown(frame: DataFrame, *plain: str, digits: int = 4, **values) -> DataFrame:
    """Plain columns, and values rounded (a column, or True for one of that name)."""
    return frame.select(*plain, *[rounded(F.col(k) if v is True else v, digits).alias(k) for k, v in values.items()])


def _r(x: str, name: str, digits: int = 4) -> str:
    return f"round({x}, {digits}) + 0.0 AS {name}"


# ---------------------------------------------------------------- profiles and scores

FIB = " ".join(f"WHEN n - {a} <= {b} - n THEN {a}" for a, b in zip(sorted(set(FIBONACCI)), sorted(set(FIBONACCI))[1:], strict=False))


def fib_sql(n: str) -> str:
    return f"abs({n} - CASE {FIB.replace('n - ', f'({n}) - ').replace(' - n ', f' - ({n}) ')} ELSE 377 END) / {PHI!r}"


def profile_cte(table: str, key: str, x: str, lines: str | None = None, anomaly: str = "false") -> str:
    """WITH-clauses s and p: p has the columns of a profile."""
    dist = fib_sql(lines) if lines else "0.0"
    return f"""
s AS (SELECT {key} AS k, count({x}) AS n, sum({x}) AS total, avg({x}) AS mean, var_pop({x}) AS variance, max({x}) AS largest,
        sum(CASE WHEN {x} > 0 THEN {x} * log2({x}) ELSE 0 END) AS xl, sum({dist}) AS fib_total, avg({dist}) AS fib_mean,
        sum(CASE WHEN {anomaly} THEN 1 ELSE 0 END) AS n_anomalies FROM {table} GROUP BY 1),
m AS (SELECT {key} AS k, avg(pow(({x} - mean) / sqrt(variance), 3)) AS g1, avg(pow(({x} - mean) / sqrt(variance), 4)) AS b2
      FROM {table} JOIN s ON s.k = {key} WHERE variance > 0 GROUP BY 1),
p AS (SELECT s.k, n, mean, variance, largest, fib_total, fib_mean, n_anomalies,
        CASE WHEN mean > 0 THEN variance / (mean * mean) ELSE 0 END AS var_rel,
        CASE WHEN n < 3 OR variance <= 0 THEN 0 ELSE g1 END AS skew, CASE WHEN n < 3 OR variance <= 0 THEN 3 ELSE b2 END AS kurt,
        CASE WHEN total > 0 THEN log2(total) - xl / total ELSE 0 END AS entropy,
        CASE WHEN n > 1 THEN (log2(total) - xl / total) / log2(n) ELSE 0 END AS entropy_norm,
        CASE WHEN n > 1 AND mean > 0 THEN largest / mean ELSE 1 END AS phi_ratio FROM s LEFT JOIN m ON s.k = m.k),
q AS (SELECT *, greatest(40, 100 - least(25, variance / {100 * PHI**2!r} * 25) - least(20, 5 * greatest(0, entropy - {math.log2(PHI**4)!r}))
          - least(30, {3 * TAU!r} * n_anomalies) - least(10, {ETA!r} * fib_total)) AS classic,
        greatest(40, 100 - CASE WHEN var_rel <= {PHI_INV!r} THEN 0 ELSE least(25, (var_rel - {PHI_INV!r}) / {PHI!r} * 25) END
          - CASE WHEN entropy_norm < 0.236 THEN least(20, (0.236 - entropy_norm) * 40) WHEN entropy_norm > 0.98 AND n >= 5 THEN least(5, (entropy_norm - 0.98) * 50) ELSE 0 END
          - least(30, {3 * TAU!r} * n_anomalies) - least(10, 2 * fib_mean)) AS radiance,
        greatest(0, least(1, 1 - abs(var_rel - {PHI_INV!r}) / {PHI!r})) AS antifragility FROM p)"""


SUPPLIER = profile_cte("lineitem", "l_suppkey", "l_extendedprice", "l_quantity", "l_returnflag = 'R' AND l_discount >= 0.095")
STATUS_SQL = "CASE WHEN radiance >= 85 THEN 'HERMÉTIQUE ✦' WHEN radiance >= 60 THEN 'EN ÉVEIL ◈' ELSE 'DORMANT ░' END"
RESERVE_SQL = f"CASE WHEN antifragility >= 0.85 THEN 'ANTIFRAGILE ✦' WHEN antifragility >= {PHI_INV!r} THEN 'RÉSISTANT ◈' ELSE 'FRAGILE ░' END"


def suppliers(spark: SparkSession, d: str) -> DataFrame:
    anomaly = (F.col("l_returnflag") == "R") & (F.col("l_discount") >= 0.095)
    return pf.scored(pf.profile(read(spark, d, "lineitem"), ["l_suppkey"], "l_extendedprice", anomaly, F.col("l_quantity")))


@query("profile_supplier", f"WITH {SUPPLIER} SELECT k AS l_suppkey, n, {_r('mean', 'mean', 2)}, {_r('var_rel', 'var_rel')}, {_r('skew', 'skew')}, {_r('kurt', 'kurt')}, {_r('entropy', 'entropy')}, {_r('entropy_norm', 'entropy_norm')}, {_r('phi_ratio', 'phi_ratio')} FROM q")
def profile_supplier(spark, d):
    return shown(suppliers(spark, d), "l_suppkey", "n", var_rel=True, skew=True, kurt=True, entropy=True, entropy_norm=True, phi_ratio=True, mean=F.round("mean", 2))


@query("score_supplier", f"WITH {SUPPLIER} SELECT k AS l_suppkey, {_r('classic', 'classic')}, {_r('radiance', 'radiance')}, {STATUS_SQL} AS status, {_r('antifragility', 'antifragility')}, {RESERVE_SQL} AS reserve, CAST(n_anomalies AS BIGINT) AS n_anomalies, {_r('fib_mean', 'fib_mean')} FROM q")
def score_supplier(spark, d):
    return shown(suppliers(spark, d), "l_suppkey", "status", "reserve", "n_anomalies", classic=True, radiance=True, antifragility=True, fib_mean=True)


@query("profile_event_type", f"WITH {profile_cte('events', 'event_type', 'value')} SELECT k AS event_type, n, {_r('var_rel', 'var_rel')}, {_r('skew', 'skew')}, {_r('kurt', 'kurt')}, {_r('entropy', 'entropy')} FROM q")
def profile_event_type(spark, d):
    return shown(pf.profile(read(spark, d, "events"), ["event_type"], "value"), "event_type", "n", var_rel=True, skew=True, kurt=True, entropy=True)


@query("zeta_score", f"SELECT l_orderkey, count(*) AS n, round(least(1, {PHI!r} * list_sum(list_transform(range(1, count(*) + 1), lambda i: pow(CAST(i AS DOUBLE), {-PHI!r}))) / count(*)), 4) + 0.0 AS zeta FROM lineitem GROUP BY 1")
def zeta(spark, d):
    n = read(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n"))
    return shown(n, "l_orderkey", "n", zeta=exprs.zeta_score("n"))


@query("divergence_customer", f"""
WITH s AS (SELECT o_custkey, count(*) AS n, sum(o_totalprice) AS s, sum(o_totalprice * o_totalprice) AS s2, max(o_totalprice) AS hi, min(o_totalprice) AS lo,
  sum(sqrt(o_totalprice)) AS rt, sum(o_totalprice * log2(o_totalprice)) AS xl FROM orders GROUP BY 1 HAVING count(*) >= 3),
t AS (SELECT o.o_custkey, sum(abs(o_totalprice - s / n)) / (2 * any_value(s)) AS tv FROM orders o JOIN s ON s.o_custkey = o.o_custkey GROUP BY 1)
SELECT s.o_custkey, n, {_r('greatest(0, n * s2 / (s * s) - 1)', 'chi2')}, {_r('greatest(0, log2(n) - log2(s) + xl / s)', 'kl_bits')}, {_r('ln(n * hi / s)', 'd_inf')},
  {_r('sqrt(greatest(0, 1 - rt / sqrt(n * s)))', 'hellinger')}, {_r('tv', 'tv')}, {_r('n / greatest(1, n * s2 / (s * s))', 'n_eff')}, {_r('hi / lo', 'contrast', 3)}
FROM s JOIN t ON s.o_custkey = t.o_custkey""")
def divergence_customer(spark, d):
    orders = read(spark, d, "orders")
    out = divergence.divergences(orders, ["o_custkey"], "o_totalprice").where("n >= 3").join(divergence.total_variation(orders, ["o_custkey"], "o_totalprice"), "o_custkey")
    return shown(out, "o_custkey", "n", chi2=True, kl_bits=True, d_inf=True, hellinger=True, tv=True, n_eff=True, contrast=F.round("contrast", 3))


def _alpha(a: str) -> str:
    return f"""SELECT b, n, {a} AS alpha, ln(sum(pow(p, {a}))) / (1 - {a}) AS h, (pow(n, {a} - 1) * sum(pow(p, {a})) - 1) / ({a} - 1) AS t FROM x GROUP BY b, n"""


@query("renyi_sweep_brand", f"""
WITH g AS (SELECT p_brand AS b, count(*) AS n, sum(p_retailprice) AS s FROM part GROUP BY 1),
x AS (SELECT b, n, p_retailprice / s AS p FROM part JOIN g ON p_brand = b),
a AS ({_alpha('0.5')} UNION ALL {_alpha('2.0')} UNION ALL {_alpha('3.0')}
  UNION ALL SELECT b, n, 1.0, -sum(p * ln(p)), ln(n) + sum(p * ln(p)) FROM x GROUP BY b, n
  UNION ALL SELECT b, n, CAST('Infinity' AS DOUBLE), -ln(max(p)), CASE WHEN abs(ln(n) + ln(max(p))) < 1e-12 THEN 0 ELSE CAST('Infinity' AS DOUBLE) END FROM x GROUP BY b, n)
SELECT b AS p_brand, CAST(alpha AS VARCHAR) AS alpha, {_r('h', 'h')}, {_r('ln(n) - h', 'd')}, CASE WHEN isinf(t) THEN 'inf' ELSE CAST(CAST(round(t * 10000) AS BIGINT) AS VARCHAR) END AS t_e4 FROM a""".replace("CAST(alpha AS VARCHAR)", "CASE WHEN isinf(alpha) THEN 'inf' ELSE CAST(CAST(round(alpha * 10) AS BIGINT) AS VARCHAR) END"))
def renyi_sweep_brand(spark, d):
    out = divergence.alpha_sweep(read(spark, d, "part"), ["p_brand"], "p_retailprice", [0.5, 1.0, 2.0, 3.0, math.inf])
    text = lambda c, k: F.when(F.col(c) == float("inf"), "inf").otherwise(F.when(F.col(c) < 1e12, F.round(F.col(c) * k)).cast("long").cast("string"))
    return shown(out.withColumn("a", text("alpha", 10)).withColumn("t_e4", text("t", 10000)), F.col("a").alias("alpha"), "p_brand", "t_e4", h=True, d=True)


@query("unification_check", """
WITH s AS (SELECT p_brand, count(*) AS n, sum(p_retailprice) AS s, max(p_retailprice) AS m, sum(p_retailprice * ln(p_retailprice)) AS x, sum(pow(p_retailprice, 2)) AS q FROM part GROUP BY 1),
r AS (SELECT p_brand, max(p_retailprice * n / s) AS m, avg(p_retailprice * n / s * ln(p_retailprice * n / s)) AS one, avg(pow(p_retailprice * n / s, 2)) AS two FROM part JOIN s USING (p_brand) GROUP BY 1)
SELECT p_brand, abs(ln(n) - (ln(s) - x / s) - one) < 1e-9 AND abs(ln(n) + ln(q / (s * s)) - ln(two)) < 1e-9 AND abs(ln(n) + ln(s.m / s) - ln(r.m)) < 1e-9 AND least(one, ln(two), ln(r.m)) > -1e-9 AS unified FROM s JOIN r USING (p_brand)""")
def unification_check(spark, d):
    out = divergence.alpha_sweep(read(spark, d, "part"), ["p_brand"], "p_retailprice", [1.0, 2.0, math.inf])
    return out.groupBy("p_brand").agg(F.bool_and("unified").alias("unified"))


@query("item_phi_ratio", "SELECT l_orderkey, l_linenumber, round(l_extendedprice / avg(l_extendedprice) OVER (PARTITION BY l_orderkey), 4) + 0.0 AS phi_ratio FROM lineitem")
def item_phi_ratio(spark, d):
    return shown(pf.item_ratio(read(spark, d, "lineitem"), ["l_orderkey"], "l_extendedprice"), "l_orderkey", "l_linenumber", phi_ratio=True)


@query("oudjat_per_group", "SELECT l_suppkey, l_orderkey, l_linenumber, l_extendedprice AS weight FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber) AS r FROM lineitem) WHERE r = 1")
def oudjat_per_group(spark, d):
    return pf.largest_item(read(spark, d, "lineitem"), ["l_suppkey"], "l_extendedprice", ["l_orderkey", "l_linenumber"], ["l_orderkey", "l_linenumber"])


@query("oudjat_supreme", "SELECT l_orderkey, l_linenumber, l_extendedprice AS weight FROM lineitem ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber LIMIT 1")
def oudjat_supreme(spark, d):
    return pf.largest_item(read(spark, d, "lineitem"), [], "l_extendedprice", ["l_orderkey", "l_linenumber"], ["l_orderkey", "l_linenumber"])


@query("fib_distance_lines", f"SELECT doc_id, n, round({fib_sql('n')}, 4) + 0.0 AS fib_dist FROM (SELECT doc_id, len(string_split(text, chr(10))) AS n FROM documents)")
def fib_distance_lines(spark, d):
    n = read(spark, d, "documents").select("doc_id", F.size(F.split("text", "\n")).cast("long").alias("n"))
    return shown(n, "doc_id", "n", fib_dist=exprs.fibonacci_distance("n"))


@query("rule_size_fibonacci", f"SELECT l_orderkey, n FROM (SELECT l_orderkey, CAST(sum(l_quantity) AS BIGINT) AS n FROM lineitem GROUP BY 1) WHERE n > 55 AND {fib_sql('n')} * {PHI!r} > 10.0000001")
def rule_size_fibonacci(spark, d):
    from orrery.sources.files import size_rule

    n = read(spark, d, "lineitem").groupBy("l_orderkey").agg(F.sum("l_quantity").cast("long").alias("n_lines"))
    return size_rule(n).withColumnRenamed("n_lines", "n")


@query("project_rollup", f"""WITH {profile_cte('(SELECT * FROM orders JOIN customer ON o_custkey = c_custkey)', 'c_custkey', 'o_totalprice')}
SELECT r_name, count(*) AS n_groups, {_r('avg(radiance)', 'radiance', 3)}, CASE WHEN avg(radiance) >= 85 THEN 'HERMÉTIQUE ✦' WHEN avg(radiance) >= 60 THEN 'EN ÉVEIL ◈' ELSE 'DORMANT ░' END AS status, arg_max(k, struct_pack(a := largest, b := -k)) AS top_customer
FROM q JOIN customer ON k = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1""")
def project_rollup(spark, d):
    scores = pf.scored(pf.profile(read(spark, d, "orders"), ["o_custkey"], "o_totalprice"))
    out = scores.join(read(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(read(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(read(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    out = out.groupBy("r_name").agg(F.count("*").alias("n_groups"), F.avg("radiance").alias("radiance"), F.max_by("o_custkey", F.struct("largest", -F.col("o_custkey"))).alias("top_customer"))
    return shown(out.withColumn("status", exprs.status("radiance")), "r_name", "n_groups", "status", "top_customer", radiance=F.round("radiance", 3))


@query("collisions_text", "SELECT md5(text) AS h, count(*) AS occurrences, count(DISTINCT source) AS places, string_agg(DISTINCT source, ',' ORDER BY source) AS where_found FROM documents WHERE text IS NOT NULL GROUP BY 1 HAVING count(DISTINCT source) >= 2")
def collisions_text(spark, d):
    docs = read(spark, d, "documents").where("text IS NOT NULL").select(F.md5("text").alias("h"), "source")
    return pf.collisions(docs, "h", "source").withColumn("where_found", F.array_join("where_found", ","))


@query("collisions_part_name", "SELECT w, count(*) AS occurrences, count(DISTINCT p_brand) AS places, string_agg(DISTINCT p_brand, ',' ORDER BY p_brand) AS where_found FROM (SELECT unnest(string_split(p_name, ' ')) AS w, p_brand FROM part) GROUP BY 1 HAVING count(DISTINCT p_brand) >= 2")
def collisions_part_name(spark, d):
    words = read(spark, d, "part").select(F.explode(F.split("p_name", " ")).alias("w"), "p_brand")
    return pf.collisions(words, "w", "p_brand").withColumn("where_found", F.array_join("where_found", ","))


@query("bipartite_split", """
WITH c AS (SELECT l_suppkey, l_quantity AS w, count(*) AS c FROM lineitem GROUP BY 1, 2),
x AS (SELECT l_suppkey, w, sum(c) OVER u AS n1, sum(c * w) OVER u AS s1, sum(c) OVER a AS n, sum(c * w) OVER a AS s FROM c
  WINDOW u AS (PARTITION BY l_suppkey ORDER BY w ROWS UNBOUNDED PRECEDING), a AS (PARTITION BY l_suppkey)),
y AS (SELECT l_suppkey, n1, s1 / n1 AS lo, (s - s1) / (n - n1) AS hi, round(n1 * (n - n1) / (n * n) * pow((s - s1) / (n - n1) - s1 / n1, 2), 6) AS b FROM x WHERE n1 >= 2 AND n - n1 >= 2),
z AS (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY b DESC, n1) AS r FROM y)
SELECT l_suppkey, CAST(n1 AS BIGINT) AS n_low, round(b, 3) + 0.0 AS between_var, round(lo, 4) + 0.0 AS low_mean, round(hi, 4) + 0.0 AS high_mean, round(hi / lo, 4) + 0.0 AS contrast FROM z WHERE r = 1""")
def bipartite_split(spark, d):
    out = pf.bipartite(read(spark, d, "lineitem"), "l_suppkey", "l_quantity")
    return shown(out, "l_suppkey", "n_low", between_var=F.round("between", 3), low_mean=True, high_mean=True, contrast=True)


ENV = "SELECT k AS l_suppkey, radiance, var_rel, variance, entropy FROM q"


@query("gate_supplier", f"WITH {SUPPLIER} SELECT k AS l_suppkey, radiance >= 75 AND var_rel < 0.32 AS open FROM q")
def gate_supplier(spark, d):
    s = suppliers(spark, d).withColumnsRenamed({"var_rel": "lilith_rel_variance"})
    return s.select("l_suppkey", dsl.gate("radiance >= 75 and lilith_rel_variance < 0.32", s.columns).alias("open"))


@query("formula_supplier", f"WITH {SUPPLIER} SELECT k AS l_suppkey, round(100 - sqrt(variance) / {PHI!r} - pow(entropy, 2), 2) + 0.0 AS value, round(pow(-2, 2) * entropy, 4) + 0.0 AS tight FROM q")
def formula_supplier(spark, d):
    s = suppliers(spark, d).withColumnsRenamed({"variance": "lilith_variance", "entropy": "shannon_entropy"})
    return s.select("l_suppkey", rounded(dsl.formula("100 - sqrt(lilith_variance)/phi - shannon_entropy^2", s.columns), 2).alias("value"), rounded(dsl.formula("-2^2 * shannon_entropy", s.columns)).alias("tight"))


@query("gate_closed_filter", f"WITH {SUPPLIER} SELECT k AS l_suppkey FROM q WHERE NOT (phi_ratio < 2.72 AND entropy_norm > 0.9843)")
def gate_closed_filter(spark, d):
    return dsl.filter_gate(suppliers(spark, d), "phi_ratio < 2.72 and entropy_norm > 0.9843", closed=True).select("l_suppkey")


@query("f1_tripwire", f"WITH {SUPPLIER} SELECT k AS l_suppkey, {_r('pow(phi_ratio - 1, 2) / n', 'bound')}, {_r('1 + sqrt(n * var_rel)', 'ratio_most')}, CASE WHEN n < 3 THEN 'INDÉCIDABLE' WHEN phi_ratio >= 5 THEN 'CONDITIONNEL' ELSE 'DÉMONTRÉ' END AS verdict FROM q")
def f1_tripwire(spark, d):
    return shown(verdict.f1_tripwire(suppliers(spark, d)), "l_suppkey", "verdict", bound=True, ratio_most=True)


EVENTS_BY_USER = profile_cte("(SELECT user_id, value * value * value AS v FROM events)", "user_id", "v")


def users(spark, d):
    return pf.scored(pf.profile(read(spark, d, "events").withColumn("v", F.col("value") * F.col("value") * F.col("value")), ["user_id"], "v"))


@query("f1_verdict", f"WITH {EVENTS_BY_USER} SELECT k AS user_id, CASE WHEN n < 5 THEN 'INSUFFISANT' WHEN var_rel >= 2.4 THEN CASE WHEN phi_ratio >= 5 THEN 'DÉMONTRÉ' ELSE 'ÉVIDENCE' END WHEN var_rel >= 1.2 THEN 'CONDITIONNEL' ELSE 'RÉFUTÉ' END AS verdict FROM q")
def f1_verdict(spark, d):
    return verdict.f1_detector(users(spark, d)).select("user_id", "verdict")


@query("concentration_alert", f"WITH {EVENTS_BY_USER} SELECT k AS user_id, {_r('var_rel', 'var_rel')}, {_r('n / (1 + var_rel)', 'n_eff')} FROM q WHERE var_rel > 2.95")
def concentration_alert(spark, d):
    return shown(verdict.concentration_alert(users(spark, d)), "user_id", var_rel=True, n_eff=True)


_sig = lambda x, s: f"1 / (1 + exp(-{s} * ({x})))"


@query("bayes_posterior", f"""
WITH {EVENTS_BY_USER}, c AS (SELECT user_id, sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) AS e, sum(CASE WHEN event_type = 'click' THEN 1 ELSE 0 END) AS cl, sum(CASE WHEN event_type = 'signup' THEN 1 ELSE 0 END) AS sg FROM events GROUP BY 1),
l AS (SELECT k, {PRIORS[0]} * greatest(1e-4, {_sig(f'phi_ratio - {PHI!r}', 1.2)} * {_sig('kurt - 4.5', 0.8)}) AS a, {PRIORS[1]} * greatest(1e-4, {_sig(f'e * 2.0 + var_rel - {PHI_INV!r}', 1.5)}) AS b,
  {PRIORS[2]} * CASE WHEN cl > 9 THEN 0.95 ELSE 0.05 END AS c, {PRIORS[3]} * CASE WHEN sg > 9 THEN 0.90 ELSE 0.08 END AS d, {PRIORS[4]} * greatest(1e-4, radiance / 100 * antifragility * CASE WHEN e > 0 THEN 0.2 ELSE 1 END) AS h FROM q JOIN c ON user_id = k),
post AS (SELECT k, a / (a + b + c + d + h) AS a, b / (a + b + c + d + h) AS b, c / (a + b + c + d + h) AS c, d / (a + b + c + d + h) AS d, h / (a + b + c + d + h) AS h FROM l)
SELECT k AS user_id, CASE WHEN a >= greatest(b, c, d, h) THEN '{HYPOTHESES[0]}' WHEN b >= greatest(c, d, h) THEN '{HYPOTHESES[1]}' WHEN c >= greatest(d, h) THEN '{HYPOTHESES[2]}' WHEN d >= h THEN '{HYPOTHESES[3]}' ELSE '{HYPOTHESES[4]}' END AS dominant,
  round(greatest(a, b, c, d, h), 4) + 0.0 AS probability, round(a, 4) + 0.0 AS p_monolith, round(h, 4) + 0.0 AS p_harmonic FROM post""")
def bayes_posterior(spark, d):
    count = lambda t: F.sum(F.when(F.col("event_type") == t, 1).otherwise(0))
    c = read(spark, d, "events").groupBy("user_id").agg(count("error").alias("e"), count("click").alias("cl"), count("signup").alias("sg"))
    rows = users(spark, d).join(c, "user_id")
    col = F.col
    like = verdict.likelihoods(col("phi_ratio"), col("kurt"), col("var_rel"), col("e"), (col("cl") > 9).cast("int"), (col("sg") > 9).cast("int"), col("radiance"), col("antifragility"), col("e") > 0)
    out = verdict.posterior(rows, like)
    return shown(out, "user_id", "dominant", probability=True, p_monolith=col("posterior")[0], p_harmonic=col("posterior")[4])


@query("priority_score", """
SELECT c_custkey, round(ln(1 + count(o_orderkey)) + CASE WHEN max(c_acctbal) < 0 THEN 3 ELSE 0 END + ln(1 + count(DISTINCT o_orderpriority)) + 0.5 * ln(1 + count(CASE WHEN o_orderstatus = 'O' THEN 1 END)), 4) + 0.0 AS score
FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1""")
def priority_score(spark, d):
    o = read(spark, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("k"), F.count_distinct("o_orderpriority").alias("dep"), F.sum(F.when(F.col("o_orderstatus") == "O", 1).otherwise(0)).alias("churn"))
    rows = read(spark, d, "customer").join(o, F.col("c_custkey") == F.col("o_custkey"), "left").fillna(0, ["k", "dep", "churn"])
    return shown(verdict.priority(rows, "k", F.col("c_acctbal") < 0, "dep", "churn"), "c_custkey", score=True)


@query("risk_score", """
WITH r AS (SELECT p_partkey, 100 * (0.35 * least(count(DISTINCT l_suppkey), 50) / 50 + 0.25 * least(max(p_size) / 10.0, 6) / 6 + 0.25 * CASE WHEN count(CASE WHEN l_returnflag = 'R' THEN 1 END) > 0 THEN 0 ELSE 1 END + 0.15 * least(count(l_orderkey), 20) / 20) AS r
FROM part LEFT JOIN lineitem ON l_partkey = p_partkey GROUP BY 1)
SELECT p_partkey, round(r, 4) + 0.0 AS risk, CASE WHEN r < 25 THEN 'FAIBLE' WHEN r <= 50 THEN 'MOYEN' WHEN r <= 75 THEN 'ELEVE' ELSE 'CRITIQUE' END AS level FROM r""")
def risk_score(spark, d):
    u = read(spark, d, "lineitem").groupBy("l_partkey").agg(F.count_distinct("l_suppkey").alias("d"), F.max(F.col("l_returnflag") == "R").alias("t"), F.count("*").alias("c"))
    rows = read(spark, d, "part").join(u, F.col("p_partkey") == F.col("l_partkey"), "left").fillna(0, ["d", "c"]).fillna(False, ["t"])
    return shown(verdict.with_risk(rows, F.col("d"), F.col("p_size") / 10, F.col("t"), F.col("c")), "p_partkey", "level", risk=True)


@query("facet_strongest", "SELECT doc_id, CASE WHEN toxic = 1 THEN 'toxic' WHEN quality = 1 THEN 'good' ELSE 'poor' END AS verdict, CASE WHEN toxic = 1 THEN 3 WHEN quality = 1 THEN 1 ELSE 2 END AS force FROM labels")
def facet_strongest(spark, d):
    lb = read(spark, d, "labels")
    facets = lb.select("doc_id", F.when(F.col("quality") == 1, "good").otherwise("poor").alias("verdict"), F.when(F.col("quality") == 1, 1).otherwise(2).alias("force"), F.lit(False).alias("positive"))
    facets = facets.unionByName(lb.where("toxic = 1").select("doc_id", F.lit("toxic").alias("verdict"), F.lit(3).alias("force"), F.lit(True).alias("positive")))
    return verdict.strongest(facets, ["doc_id"])


@query("prescriptions", f"WITH {SUPPLIER} SELECT k AS l_suppkey, concat_ws(',', CASE WHEN phi_ratio > 2.7 THEN 'split' END, CASE WHEN radiance < 85 THEN 'review' END, CASE WHEN n_anomalies > 2 THEN 'repair' END) AS advice FROM q")
def prescriptions(spark, d):
    rules = {"split": F.col("phi_ratio") > 2.7, "review": F.col("radiance") < 85, "repair": F.col("n_anomalies") > 2}
    return verdict.prescriptions(suppliers(spark, d), rules).select("l_suppkey", F.array_join("advice", ",").alias("advice"))


@query("double_verdict", "SELECT doc_id FROM labels WHERE quality = 1 AND toxic = 1")
def double_verdict(spark, d):
    rows = read(spark, d, "labels").select("doc_id", F.array_compact(F.array(F.when(F.col("quality") == 1, "good"), F.when(F.col("toxic") == 1, "toxic"))).alias("v"))
    return verdict.double_verdict(rows, "v", ["good"], ["toxic"]).select("doc_id")
