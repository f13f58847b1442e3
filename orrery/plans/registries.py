"""Queries on registries, probes, ledgers, checks of state and expressions, over literal rows or the test tables."""

from __future__ import annotations

import math

from pyspark.sql import Window, functions as F

from orrery.functions import dsl, exprs
from orrery.functions.constants import HYPOTHESES as CAUSES, PHI, PHI_INV
from orrery.operators import graph, probes, registry, retrieve, verdict
from orrery.plans.catalogue import _r, query, read, shown
from orrery.plans.changes import LAYERED, _layered
from orrery.plans.code import facts
from orrery.plans.fixtures import ENTRIES, HYPOTHESES, KILLS, MECHANISMS, OBSTRUCTIONS, STEPS, Given

# ---------------------------------------------------------------- probes

ZONE = """CASE WHEN status = 'DÉMONTRÉ' THEN 'DÉMONTRÉ' WHEN status IN ('RÉFUTÉ', 'ÉLIMINÉ') THEN 'RÉFUTÉ' WHEN status IN ('NON-ATTAQUÉ', 'CONDITIONNEL') THEN status
  WHEN status = 'NOMMÉ' OR status LIKE 'NOMMÉ %' THEN CASE WHEN source LIKE 'journal §12%' OR (len(worksites) = 0 AND source IN ('table §1', 'faisabilité §4')) THEN 'NON-ATTAQUÉ' ELSE 'CONDITIONNEL' END
  WHEN status IN ('EN-COURS', 'CONJECTURAL', 'ÉVIDENCE') THEN 'CONDITIONNEL' ELSE status END"""
ROUTE = f"m AS ({MECHANISMS.sql}), h AS ({HYPOTHESES.sql}), r AS (SELECT mechanism, h.*, {ZONE} AS zone, status IN ('DÉMONTRÉ', 'ÉLIMINÉ') AS lifted FROM m JOIN h ON list_has_any(m.holes, h.holes) AND lower(name) <> lower(mechanism))"


def _route(spark):
    return probes.probe_route(MECHANISMS.frame(spark), HYPOTHESES.frame(spark))


@query("zones", f"SELECT name, {ZONE} AS zone FROM ({HYPOTHESES.sql})")
def zones(spark, d):
    return HYPOTHESES.frame(spark).select("name", probes.zone("status", "source", "worksites").alias("zone"))


@query("probe_route", f"WITH {ROUTE} SELECT mechanism, name, zone, lifted, NOT lifted AND zone = 'NON-ATTAQUÉ' AS unexplored, CAST(row_number() OVER (PARTITION BY mechanism ORDER BY rank, name) AS INTEGER) AS place FROM r")
def probe_route(spark, d):
    return _route(spark).select("mechanism", "name", "zone", "lifted", "unexplored", "place")


@query("probe_orders", "SELECT c_mktsegment AS mechanism, p.o_orderpriority AS name, count(*) AS n FROM (SELECT DISTINCT c_mktsegment, o_orderstatus FROM customer JOIN orders ON o_custkey = c_custkey) m JOIN (SELECT o_orderpriority, o_orderstatus FROM orders GROUP BY 1, 2) p ON m.o_orderstatus = p.o_orderstatus GROUP BY 1, 2")
def probe_orders(spark, d):
    o = read(spark, d, "orders")
    hypotheses = o.groupBy(F.col("o_orderpriority").alias("name"), F.col("o_orderstatus").alias("s")).agg(F.lit(1).alias("_x")).select("name", F.array(F.ascii("s").cast("long")).alias("holes"), "s")
    mechanisms = o.join(read(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).groupBy(F.col("c_mktsegment").alias("mechanism")).agg(F.collect_set(F.ascii("o_orderstatus").cast("long")).alias("holes"))
    return probes._meeting(mechanisms, hypotheses, "holes").groupBy("mechanism", "name").agg(F.count("*").alias("n"))


@query("probe_obstructions", f"WITH m AS ({MECHANISMS.sql}), o AS ({OBSTRUCTIONS.sql}) SELECT mechanism, title, CASE WHEN list_has_any(m.holes, o.holes) THEN 'hole' ELSE 'title' END AS how FROM m JOIN o ON list_has_any(m.holes, o.holes) OR contains(title, mechanism)")
def probe_obstructions(spark, d):
    return probes.probe_obstructions(MECHANISMS.frame(spark), OBSTRUCTIONS.frame(spark)).select("mechanism", "title", "how")


@query("probe_refutations", facts("worksite string, identifier string, status string", ("4", "foo_bar", "RÉFUTÉ"), ("4", "baz_qux", "ÉLIMINÉ"), ("5", "foo_bar", "RÉFUTÉ")))
def probe_refutations(spark, d):
    return probes.refutations(ENTRIES.frame(spark))


VERSIONS = [(OBSTRUCTIONS.rows[0][0], "faible", "RÉFUTÉ"), (OBSTRUCTIONS.rows[0][0], "forte", "DÉMONTRÉ"), (OBSTRUCTIONS.rows[1][0], "dure", "ÉLIMINÉ"), (OBSTRUCTIONS.rows[1][0], "molle", "CONDITIONNEL")]


@query("verdict_versions", facts("title string, version string, status string", *VERSIONS))
def verdict_versions(spark, d):
    return probes.versions(OBSTRUCTIONS.frame(spark))


@query("verdict_scope", facts("mechanism string, title string, node string, scope string", ("alpha", OBSTRUCTIONS.rows[0][0], "H1", "noeud"), ("alpha", OBSTRUCTIONS.rows[0][0], "H3", "noeud"), ("beta", OBSTRUCTIONS.rows[1][0], "beta", "mecanisme"), ("alpha", OBSTRUCTIONS.rows[2][0], "", "hors_route"), ("beta", OBSTRUCTIONS.rows[2][0], "H4", "noeud")))
def verdict_scope(spark, d):
    found = probes.probe_obstructions(MECHANISMS.frame(spark), OBSTRUCTIONS.frame(spark))
    return probes.verdict_scope(found, _route(spark).select("mechanism", "name"))


@query("pertinent_names", "SELECT * FROM (VALUES ('known', CAST(1 AS BIGINT)), ('MyConjecture', 1), ('GridData', 1), ('twice', 2)) v(identifier, n)")
def pertinent_names(spark, d):
    found = spark.createDataFrame([(x,) for x in ("known", "MyConjecture", "GridData", "twice", "twice", "once", "sorry", "sorry", "axioms")], "identifier string")
    return probes.pertinent(found, spark.createDataFrame([("known",), ("other",)], "name string"))


@query("parse_integrity", "SELECT count(*) AS n_first, count(*) AS n_second, true AS agree FROM part")
def parse_integrity(spark, d):
    return probes.same_parse(read(spark, d, "part"), read(spark, d, "part").repartition(3))


@query("parse_divergence", "SELECT count(*) AS n_first, count(*) AS n_second, false AS agree FROM part")
def parse_divergence(spark, d):
    part = read(spark, d, "part")
    return probes.same_parse(part, part.withColumn("p_size", F.col("p_size") + (F.col("p_partkey") == 7).cast("int")))


BOOK = """m AS (SELECT c_mktsegment AS mechanism, c_custkey AS name, c_acctbal AS w FROM customer WHERE c_acctbal > 0), kk AS (SELECT c_mktsegment AS mechanism, c_custkey AS name, year(o_orderdate) AS t FROM orders JOIN customer ON c_custkey = o_custkey WHERE o_orderstatus = 'F'), k AS (SELECT mechanism, name, min(t) AS t FROM kk GROUP BY 1, 2),
s AS (SELECT mechanism, t FROM kk GROUP BY 1, 2 UNION ALL SELECT DISTINCT mechanism, NULL FROM m),
a AS (SELECT s.mechanism, s.t AS step, sum(w) AS m, sum(w * log2(w)) AS x FROM s JOIN m ON m.mechanism = s.mechanism LEFT JOIN k ON k.mechanism = m.mechanism AND k.name = m.name WHERE s.t IS NULL OR k.t IS NULL OR k.t > s.t GROUP BY 1, 2),
b AS (SELECT s.mechanism, s.t AS step, CASE WHEN coalesce(m, 0) > 1e-15 THEN greatest(0, log2(m) - x / m) ELSE 0 END AS entropy FROM s LEFT JOIN a ON a.mechanism = s.mechanism AND a.step IS NOT DISTINCT FROM s.t)"""


def _books(spark, d):
    c = read(spark, d, "customer")
    route = c.select(F.col("c_mktsegment").alias("mechanism"), F.col("c_custkey").alias("name"), F.col("c_acctbal").alias("weight"), F.col("c_nationkey").cast("string").alias("zone"))
    kills = read(spark, d, "orders").where("o_orderstatus = 'F'").join(c, F.col("o_custkey") == F.col("c_custkey")).select(F.col("c_mktsegment").alias("mechanism"), F.col("c_custkey").alias("name"), F.year("o_orderdate").alias("step"))
    return route, kills


@query("ledgers_by_mechanism", f"WITH {BOOK} SELECT mechanism, CAST(step AS BIGINT) AS step, {_r('entropy', 'entropy', 6)}, round(coalesce(lag(entropy) OVER (PARTITION BY mechanism ORDER BY step NULLS FIRST) - entropy, 0), 6) + 0.0 AS gain FROM b")
def ledgers_by_mechanism(spark, d):
    return shown(probes.ledgers(*_books(spark, d)), "mechanism", "step", entropy=True, gain=True, digits=6)


_H = -(PHI_INV * math.log2(PHI_INV) + (1 - PHI_INV) * math.log2(1 - PHI_INV))
COST = f"""z AS (SELECT c_mktsegment AS mechanism, c_nationkey < 5 AS p, c_nationkey, sum(c_acctbal) AS m FROM customer WHERE c_acctbal > 0 GROUP BY ALL), sd AS (SELECT mechanism, p, sum(m) AS s, sum(m * log2(m)) AS x FROM z GROUP BY 1, 2),
cost AS (SELECT mechanism, (sum(s * log2(s)) - sum(x)) / sum(s) AS cost, (sum(s * log2(s)) - sum(x)) / sum(s) / (1 - {_H!r}) AS ratio FROM sd GROUP BY 1)"""
LOW = tuple(map(str, range(5)))


@query("collapse_by_mechanism", f"WITH {COST} SELECT mechanism, {_r('cost', 'cost', 6)}, {_r('ratio', 'ratio', 4)} FROM cost")
def collapse_by_mechanism(spark, d):
    route, _ = _books(spark, d)
    out = probes.collapse_costs(route.where("weight > 0"), positive=LOW)
    return out.select("mechanism", exprs.rounded("cost", 6).alias("cost"), exprs.rounded("ratio", 4).alias("ratio"))


@query("attention_list", f"WITH {ROUTE}, w AS (SELECT mechanism, name, zone, max(weight) AS w FROM r GROUP BY 1, 2, 3), zz AS (SELECT mechanism, zone, zone IN ('DÉMONTRÉ', 'CONDITIONNEL') AS p, sum(w) AS m FROM w GROUP BY 1, 2, 3), sd AS (SELECT mechanism, p, sum(m) AS s, sum(m * log2(m)) AS x FROM zz GROUP BY 1, 2), cost AS (SELECT mechanism, (sum(s * log2(s)) - sum(x)) / sum(s) AS cost FROM sd GROUP BY 1), k AS ({KILLS.sql}), live AS (SELECT mechanism, sum(w) AS m, sum(w * log2(w)) AS x, coalesce(sum(w) FILTER (NOT dead), 0) AS m2, coalesce(sum(w * log2(w)) FILTER (NOT dead), 0) AS x2 FROM (SELECT w.*, EXISTS (SELECT 1 FROM k WHERE k.mechanism = w.mechanism AND k.name = w.name) AS dead FROM w) GROUP BY 1), ob AS (SELECT mechanism, count(*) AS n FROM m JOIN ({OBSTRUCTIONS.sql}) o ON list_has_any(m.holes, o.holes) OR contains(title, mechanism) GROUP BY 1) SELECT mechanism, (SELECT count(DISTINCT name) FROM r WHERE r.mechanism = live.mechanism) AS n_nodes, coalesce(ob.n, 0) AS n_obstructions, round(log2(live.m) - live.x / live.m - CASE WHEN m2 > 1e-15 THEN greatest(0, log2(m2) - x2 / m2) ELSE 0 END, 6) + 0.0 AS gain, round(cost, 6) + 0.0 AS cost FROM live JOIN cost USING (mechanism) LEFT JOIN ob USING (mechanism)")
def attention_list(spark, d):
    route = _route(spark)
    found = probes.probe_obstructions(MECHANISMS.frame(spark), OBSTRUCTIONS.frame(spark))
    return shown(probes.attention(route, KILLS.frame(spark), found), "mechanism", "n_nodes", "n_obstructions", gain=True, cost=True, digits=6)


@query("explorer_grid", f"WITH {ROUTE} SELECT mechanism, name, rank AS band, zone, CAST(dense_rank() OVER (PARTITION BY mechanism ORDER BY rank) - 1 AS INTEGER) AS x, CAST(row_number() OVER (PARTITION BY mechanism, rank ORDER BY name) - 1 AS INTEGER) AS y, lead(name) OVER (PARTITION BY mechanism ORDER BY rank, name) AS next FROM r")
def explorer_grid(spark, d):
    return probes.explorer(_route(spark))


HOLES = Given("name string, file string, hole long", [("five", "b.lean", 1), ("five", "c.lean", 1), ("six", "b.lean", 3), ("gone", None, None)])
AFTER = Given("file string, dependant string", [("b.lean", "x.lean"), ("b.lean", "y.lean"), ("c.lean", "x.lean")])


@query("hole_dossier", f"WITH h AS ({HOLES.sql}), a AS ({AFTER.sql}), w AS (SELECT DISTINCT unnest(holes) AS hole, name, source FROM ({HYPOTHESES.sql})) SELECT name, CASE WHEN count(file) > 0 THEN 'TROUVÉ' ELSE 'INTROUVABLE' END AS found, count(file) AS n_occurrences, (SELECT count(DISTINCT dependant) FROM a WHERE file IN (SELECT file FROM h h2 WHERE h2.name = h.name)) AS n_dependants, (SELECT count(*) FROM w WHERE w.hole = max(h.hole)) AS work FROM h GROUP BY name")
def hole_dossier(spark, d):
    work = HYPOTHESES.frame(spark).select(F.col("name").alias("item"), F.col("source").alias("place"), "holes")
    return probes.dossier(HOLES.frame(spark), AFTER.frame(spark), work)


# ---------------------------------------------------------------- checks of state


@query("blind_spots", "SELECT p_brand, id, CASE WHEN id = 'C9' THEN 'COUVERT' WHEN id = 'C3' AND n >= 5 THEN 'PARTIEL' WHEN id = 'C7' THEN CASE WHEN n >= 3 THEN 'COUVERT' ELSE 'DÉGRADÉ' END ELSE 'NON_COUVERT' END AS status FROM (SELECT p_brand, count(*) AS n FROM part GROUP BY 1), (SELECT 'C' || unnest(range(1, 10)) AS id)")
def blind_spots(spark, d):
    return probes.blind_spots(read(spark, d, "part").groupBy("p_brand").agg(F.count("*").alias("n"))).drop("n")


DECISIONS = Given("name string, reason string", [("a", "long enough to count"), ("b", "  short   "), (None, "long enough to count"), ("c", None), ("d", "exactly 10")])


@query("veto_validity", f"SELECT *, length(trim(coalesce(reason, ''))) >= 10 AND name IS NOT NULL AS valid FROM ({DECISIONS.sql})")
def veto_validity(spark, d):
    return probes.vetoes(DECISIONS.frame(spark))


@query("prescriptive_guard", "SELECT doc_id, CASE WHEN contains(lower(text), 'secret') THEN 'secret' WHEN contains(lower(text), 'license') THEN 'License' ELSE 'token' END AS word FROM documents WHERE contains(lower(text), 'secret') OR contains(lower(text), 'license') OR contains(lower(text), 'token')")
def prescriptive_guard(spark, d):
    return probes.prescriptive(read(spark, d, "documents").select("doc_id", "text"), "text", ["secret", "License", "token"]).select("doc_id", "word")


@query("chain_forward", "SELECT user_id, CASE WHEN go THEN 'A-REPRENDRE' ELSE s END AS status, CASE WHEN go THEN CASE WHEN n <> '' THEN n || ' | chained' ELSE 'chained' END ELSE n END AS note FROM (SELECT user_id, arg_max(event_type, event_id) AS s, CASE WHEN user_id % 2 = 0 THEN 'note' ELSE '' END AS n, max(event_id) < 0.99 * (SELECT max(event_id) FROM events) AND user_id % 3 <> 0 AND s IN ('view', 'click') AS go FROM events GROUP BY 1)")
def chain_forward(spark, d):
    e = read(spark, d, "events")
    most = e.agg(F.max("event_id")).first()[0]
    state = e.groupBy("user_id").agg(F.max_by("event_type", "event_id").alias("status"), F.max("event_id").alias("last")).withColumn("note", F.when(F.col("user_id") % 2 == 0, "note").otherwise(""))
    return probes.chained(state, F.col("last") < 0.99 * most, F.col("user_id") % 3 == 0, ["view", "click"]).select("user_id", "status", "note")


@query("residual_footprints", facts("agent string, failed_at long, last_call string, last_result string", ("a", 4, "call 2", "ok 1"), ("c", 1, None, None)))
def residual_footprints(spark, d):
    return probes.footprints(STEPS.frame(spark))


@query("footprints_without_log", "SELECT DISTINCT user_id FROM events WHERE event_type = 'error' AND user_id NOT IN (SELECT user_id FROM events WHERE event_id < 12)")
def footprints_without_log(spark, d):
    e = read(spark, d, "events")
    return probes.without_log(e.where("event_type = 'error'"), e.where("event_id < 12"), "user_id")


@query("perimeter_check", "WITH a AS (SELECT DISTINCT o_custkey AS path FROM orders), b AS (SELECT c_custkey + 3 AS path FROM customer) SELECT path, 'missing' AS side FROM b WHERE path NOT IN (SELECT path FROM a) UNION ALL SELECT path, 'orphan' FROM a WHERE path NOT IN (SELECT path FROM b)")
def perimeter_check(spark, d):
    return probes.perimeter(read(spark, d, "orders").select(F.col("o_custkey").alias("path")), read(spark, d, "customer").select((F.col("c_custkey") + 3).alias("path")))


@query("instrument_health", "SELECT '.lean' AS extension, CAST(2 AS BIGINT) AS n_files")
def instrument_health(spark, d):
    before = spark.createDataFrame([("a.lean",), ("b.LEAN",), ("c.py",), ("none",)], "path string")
    return probes.instrument_health(before, spark.createDataFrame([("x/y.py",), ("z.rs",)], "path string"))


@query("baseline_comparison", "WITH c AS (SELECT l_suppkey, count(DISTINCT l_partkey) AS kappa, round(sum(l_extendedprice), 2) AS t FROM lineitem GROUP BY 1), q AS (SELECT quantile_disc(kappa, 0.8) AS a, quantile_disc(t, 0.8) AS b FROM c), v AS (SELECT l_suppkey AS name, CASE WHEN kappa >= a AND t >= b THEN 'GOULOT' WHEN kappa >= a THEN 'GROSSE_FROIDE' WHEN t >= b THEN 'PETITE_CHAUDE' ELSE 'NEUTRE' END AS quadrant, row_number() OVER (ORDER BY t DESC, l_suppkey) <= 1 AS top FROM c, q) SELECT name, quadrant, CASE quadrant WHEN 'GROSSE_FROIDE' THEN 'large and cold' WHEN 'PETITE_CHAUDE' THEN 'small and hot' ELSE 'bottleneck outside' END AS finding FROM v WHERE quadrant IN ('GROSSE_FROIDE', 'PETITE_CHAUDE') OR (quadrant = 'GOULOT' AND NOT top)")
def baseline_comparison(spark, d):
    from orrery.operators import perf
    from orrery.plans.changes import _costs

    costs = _costs(spark, d).withColumnRenamed("l_suppkey", "name")
    return probes.baseline(perf.quadrants(costs, "kappa", "t"), costs.orderBy(F.desc("t"), "name").limit(1).select("name"))


@query("duplicates_existed", "WITH o AS (SELECT o_custkey AS name, o_orderpriority AS file, o_orderdate < TIMESTAMP '1996-01-01' AS old FROM orders WHERE o_orderpriority NOT LIKE '5%') SELECT name, count(DISTINCT file) FILTER (NOT old) AS n_files, count(DISTINCT file) FILTER (old) >= 2 AS existed FROM o GROUP BY 1 HAVING count(DISTINCT file) FILTER (NOT old) >= 2")
def duplicates_existed(spark, d):
    o = read(spark, d, "orders").select(F.col("o_custkey").alias("name"), F.col("o_orderpriority").alias("file"), (F.col("o_orderdate") < F.expr("TIMESTAMP_NTZ '1996-01-01 00:00:00'")).alias("old"))
    return probes.duplicated(o.where("old"), o.where("NOT old"), excluded=("5",))


MAPPED = "s AS (SELECT c_nationkey AS file, c_name AS name, c_custkey AS line, 1 + c_custkey % 50 AS kappa, CASE WHEN c_custkey % 2 = 0 THEN c_acctbal < 0 END AS h FROM customer), dp AS (SELECT s_nationkey AS file, count(*) AS n FROM supplier GROUP BY 1), ch AS (SELECT c_nationkey AS file, count(*) AS n FROM orders JOIN customer ON c_custkey = o_custkey WHERE o_orderdate >= TIMESTAMP '1998-01-01' GROUP BY 1), sm AS (SELECT s.file, name, line, kappa, coalesce(h, false) AS hole, CASE WHEN h IS NULL THEN 'non_applicable' ELSE 'analyseur' END AS mode, coalesce(dp.n, 0) AS dependants, coalesce(ch.n, 0) AS churn, ln(1 + kappa) + CASE WHEN coalesce(h, false) THEN 3 ELSE 0 END + ln(1 + coalesce(dp.n, 0)) + 0.5 * ln(1 + coalesce(ch.n, 0)) AS score FROM s LEFT JOIN dp USING (file) LEFT JOIN ch USING (file))"


def _mapped(spark, d):
    c = read(spark, d, "customer")
    symbols = c.select(F.col("c_nationkey").alias("file"), F.col("c_name").alias("name"), F.col("c_custkey").alias("line"), (1 + F.col("c_custkey") % 50).alias("kappa"))
    holes = c.where("c_custkey % 2 = 0").select(F.col("c_nationkey").alias("file"), F.col("c_name").alias("name"), F.col("c_custkey").alias("line"), (F.col("c_acctbal") < 0).alias("hole"))
    dependants = read(spark, d, "supplier").groupBy(F.col("s_nationkey").alias("file")).agg(F.count("*").alias("n"))
    churn = read(spark, d, "orders").where(F.col("o_orderdate") >= F.expr("TIMESTAMP_NTZ '1998-01-01 00:00:00'")).join(c, F.col("o_custkey") == F.col("c_custkey")).groupBy(F.col("c_nationkey").alias("file")).agg(F.count("*").alias("n"))
    return probes.symbol_map(symbols, holes, dependants, churn)


@query("symbol_map", f"WITH {MAPPED} SELECT * REPLACE (round(score, 6) + 0.0 AS score) FROM sm")
def symbol_map(spark, d):
    return shown(_mapped(spark, d), "file", "name", "line", "kappa", "hole", "mode", "dependants", "churn", score=True, digits=6)


@query("attack_first", f"WITH {MAPPED} SELECT file, name, line, round(score, 6) + 0.0 AS score FROM sm WHERE hole ORDER BY round(score, 9) DESC, file, line LIMIT 10")
def attack_first(spark, d):
    return shown(probes.attack_first(_mapped(spark, d), 10), "file", "name", "line", score=True, digits=6)


@query("validated_registry", "SELECT o_custkey AS key, max(year(o_orderdate)) AS version, CASE WHEN max(year(o_orderdate)) FILTER (o_orderstatus = 'O') > coalesce(max(year(o_orderdate)) FILTER (o_orderstatus = 'F'), 0) THEN 'update' ELSE 'entry' END AS origin FROM orders WHERE o_orderstatus IN ('O', 'F') GROUP BY 1")
def validated_registry(spark, d):
    o = read(spark, d, "orders").select(F.col("o_custkey").alias("key"), F.year("o_orderdate").alias("version"), "o_orderstatus").distinct()
    side = lambda s, t: o.where(F.col("o_orderstatus") == s).select("key", "version", F.lit(t).alias("origin"))
    return probes.validated(side("F", "entry"), side("O", "update"), "key", "version")


@query("bragg_peaks", "WITH s AS (SELECT date_diff('day', TIMESTAMP '2024-01-01', ts) AS k, event_type, count(*) AS v FROM events GROUP BY 1, 2), x AS (SELECT *, lag(v) OVER w AS a, lead(v) OVER w AS b, max(v) OVER (PARTITION BY event_type) AS m, count(*) OVER (PARTITION BY event_type) // 2 AS c FROM s WINDOW w AS (PARTITION BY event_type ORDER BY k)), p AS (SELECT event_type, round(abs(k - c) / 2.0, 6) AS frequency, max(v) AS v FROM x WHERE v > 0.35 * m AND v >= a AND v >= b AND k <> c GROUP BY 1, 2) SELECT event_type, frequency, v FROM p QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY v DESC, frequency) <= 6")
def bragg_peaks(spark, d):
    days = read(spark, d, "events").groupBy(F.date_diff(F.to_date("ts"), F.to_date(F.lit("2024-01-01"))).alias("k"), "event_type").agg(F.count("*").alias("v"))
    return probes.peaks(days, ["event_type"], "k", "v", 1.0)


# ---------------------------------------------------------------- registries


@query("registry_occurrences", "SELECT p_partkey, b.b FROM part JOIN (SELECT DISTINCT lower(split_part(p_name, ' ', 1)) AS b FROM part) b ON contains(lower(p_name), b.b) WHERE length(b.b) >= 4")
def registry_occurrences(spark, d):
    part = read(spark, d, "part")
    words = part.select(F.lower(F.split("p_name", " ")[0]).alias("b")).distinct()
    return registry.occurrences(part.select("p_partkey", "p_name"), words, "p_name", "b").select("p_partkey", "b")


@query("registry_attached", facts("title string, n string, how string", ("about foobar", "lemma", "exact"), ("about foobar2", "foobar", "contains"), ("else", None, "none")))
def registry_attached(spark, d):
    names = spark.createDataFrame([("foobar",), ("lemma",), ("foo",)], "n string")
    return registry.attached(spark.createDataFrame([("about foobar", "lemma"), ("about foobar2", None), ("else", None)], "title string, k string"), names, "title", "k", "n")


@query("registry_priority", "SELECT name, arg_min(target, struct_pack(a := level, b := target)) AS target, CAST(min(level) AS INTEGER) AS level FROM (SELECT c_nationkey AS name, c_mktsegment AS target, 0 AS level FROM customer WHERE c_acctbal < 0 UNION ALL SELECT s_nationkey, s_name, 1 FROM supplier UNION ALL SELECT n_nationkey, n_name, 2 FROM nation) GROUP BY 1")
def registry_priority(spark, d):
    c, s, n = (read(spark, d, t) for t in ("customer", "supplier", "nation"))
    return registry.by_priority([c.where("c_acctbal < 0").select(F.col("c_nationkey").alias("name"), F.col("c_mktsegment").alias("target")), s.select(F.col("s_nationkey").alias("name"), F.col("s_name").alias("target")), n.select(F.col("n_nationkey").alias("name"), F.col("n_name").alias("target"))], "name", "target")


@query("registry_zone_counts", "SELECT n_nationkey, count(*) FILTER (c_mktsegment = 'BUILDING') AS BUILDING, count(*) FILTER (c_mktsegment = 'MACHINERY') AS MACHINERY FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY 1")
def registry_zone_counts(spark, d):
    items = read(spark, d, "customer").withColumnRenamed("c_nationkey", "n_nationkey")
    return registry.zone_counts(items, "n_nationkey", "c_mktsegment", ["BUILDING", "MACHINERY"], read(spark, d, "nation"))


LINKED = Given("i long, n string, h string, t array<string>", [(1, "n1", "h1", ["a", "b"]), (2, "n1", "h2", ["c"]), (3, "n2", "h2", ["b"]), (4, None, None, []), (5, "n2", "h9", ["a", "b"])])


@query("registry_connected", f"WITH x AS ({LINKED.sql}) SELECT s.i AS a, t.i AS b, CASE WHEN s.n = t.n THEN 'equal' WHEN s.h = t.h THEN 'head' ELSE 'token' END AS why FROM x s JOIN x t ON s.i < t.i WHERE s.n = t.n OR s.h = t.h OR list_has_any(s.t, t.t)")
def registry_connected(spark, d):
    return registry.connected(LINKED.frame(spark), "i", "n", "h", "t")


@query("registry_unjustified", facts("m string, problem string", ("m", "text too short"), ("n", "no entry"), ("x", "no module"), ("x", "unknown kind")))
def registry_unjustified(spark, d):
    return registry.unjustified(spark.createDataFrame([("m",), ("n",), ("o",)], "m string"), spark.createDataFrame([("m", "short", "core"), ("x", "a text that is long enough", "odd"), ("o", "a text that is long enough", "core")], "m string, text string, k string"), "m", "text", "k", ["core"])


@query("registry_spec_errors", facts("n string, errors string", ("a", "repeated name"), ("1b", "bad name; unbalanced (); no import"), ("a", "repeated name; hole"), (None, "missing n; missing b; no import")))
def registry_spec_errors(spark, d):
    specs = spark.createDataFrame([("a", "(x)", ["i"]), ("1b", "(x", []), ("a", "sorry", ["i"]), (None, "", None)], "n string, b string, i array<string>")
    return registry.spec_errors(specs, "n", "b", "i", ["n", "b"]).select("n", F.array_join("errors", "; ").alias("errors"))


@query("registry_stale", "SELECT coalesce(a.k, b.k) AS path, CASE WHEN b.k IS NULL THEN 'delete' WHEN a.k IS NULL THEN 'insert' ELSE 'refresh' END AS action FROM (SELECT o_custkey AS k, count(*) AS n FROM orders WHERE o_orderstatus = 'F' GROUP BY 1) a FULL JOIN (SELECT o_custkey AS k, count(*) AS n FROM orders WHERE o_orderstatus = 'O' GROUP BY 1) b ON a.k = b.k WHERE a.n IS DISTINCT FROM b.n")
def registry_stale(spark, d):
    side = lambda s: read(spark, d, "orders").where(F.col("o_orderstatus") == s).groupBy(F.col("o_custkey").alias("path")).agg(F.count("*").alias("modified"))
    return registry.stale(side("F"), side("O"))


@query("registry_attributed", "SELECT n_name, c_name AS q, c_name IS NOT NULL AS known FROM (SELECT DISTINCT n_name || '9' AS n_name FROM nation UNION ALL SELECT '000000001') n LEFT JOIN (SELECT c_name, substr(c_name, 10) AS s FROM customer) ON s = n_name")
def registry_attributed(spark, d):
    short = read(spark, d, "nation").select(F.concat("n_name", F.lit("9")).alias("n_name")).distinct().union(spark.createDataFrame([("000000001",)], "n_name string"))
    named = read(spark, d, "customer").select(F.concat(F.lit("c."), F.substring("c_name", 10, 20)).alias("q0"), "c_name")
    out = registry.attributed(short, named.select("q0"), "n_name", "q0")
    return out.join(named, "q0", "left").select("n_name", F.col("c_name").alias("q"), "known")


@query("registry_mirrors", "SELECT name, row_number() OVER (ORDER BY latency NULLS LAST, name) AS place FROM (VALUES ('a', NULL), ('b', 2.0), ('c', 0.5), ('d', 2.0)) v(name, latency)")
def registry_mirrors(spark, d):
    ranked = registry.ranked_mirrors(spark.createDataFrame([("a", None), ("b", 2.0), ("c", 0.5), ("d", 2.0)], "name string, latency double"), "latency", "name")
    return ranked.withColumn("place", F.row_number().over(Window.orderBy(F.monotonically_increasing_id())).cast("long")).select("name", "place")


@query("registry_severity", "SELECT o_custkey, CASE max(CASE o_orderstatus WHEN 'F' THEN 2 WHEN 'P' THEN 1 ELSE 0 END) WHEN 2 THEN 'EN PANNE' WHEN 1 THEN 'DÉGRADÉ' ELSE 'OK' END AS verdict FROM orders GROUP BY 1")
def registry_severity(spark, d):
    checks = read(spark, d, "orders").select("o_custkey", F.when(F.col("o_orderstatus") == "F", "EN PANNE").when(F.col("o_orderstatus") == "P", "DÉGRADÉ").otherwise("OK").alias("verdict"))
    return registry.severity(checks, ["o_custkey"], "verdict")


@query("covered_by_tests", "SELECT p_partkey, EXISTS (SELECT 1 FROM documents WHERE contains(lower(text), lower(split_part(p_name, ' ', 1)))) AS covered FROM part WHERE length(split_part(p_name, ' ', 1)) >= 4")
def covered_by_tests(spark, d):
    part = read(spark, d, "part").select("p_partkey", F.split("p_name", " ")[0].alias("word")).where("length(word) >= 4")
    seen = registry.occurrences(read(spark, d, "documents").select("doc_id", "text"), part.select("word").distinct(), "text", "word").select("word").distinct().withColumn("covered", F.lit(True))
    return part.join(seen, "word", "left").select("p_partkey", F.coalesce("covered", F.lit(False)).alias("covered"))


# ---------------------------------------------------------------- graphs


@query("closure", f"WITH RECURSIVE e AS ({LAYERED}), w(origin, node) AS (SELECT src, dst FROM e UNION SELECT origin, dst FROM w JOIN e ON node = src) SELECT origin, node FROM w")
def closure(spark, d):
    return graph.closure(_layered(spark, d))


@query("cascade_invalidation", f"WITH RECURSIVE e AS ({LAYERED}), w(node) AS (SELECT 'p1' UNION SELECT src FROM w JOIN e ON node = dst) SELECT node, CASE node WHEN 'p1' THEN 'modified' ELSE 'dependant' END AS why FROM w")
def cascade_invalidation(spark, d):
    return graph.cascade(_layered(spark, d), spark.createDataFrame([("p1",)], "node string"))


@query("transpose", "SELECT DISTINCT 1000000 + l_partkey AS src, l_suppkey AS dst FROM lineitem")
def transpose(spark, d):
    from orrery.plans.changes import _trade

    return graph.transposed(_trade(spark, d))


NEEDS = Given("src string, dst string", [("a", "b"), ("a", "c"), ("b", "d"), ("c", "d"), ("d", "out"), ("x", "y"), ("y", "z"), ("z", "x")])


@query("dependency_order", facts("name string, place int, node string", ("a", 1, "d"), ("a", 2, "b"), ("a", 3, "c"), ("a", 4, "a"), ("x", 1, "x"), ("x", 2, "y"), ("x", 3, "z")))
def dependency_order(spark, d):
    known = spark.createDataFrame([(c,) for c in "abcdxyz"], "n string")
    return graph.dependency_order(NEEDS.frame(spark), known, spark.createDataFrame([("a",), ("x",)], "n string"))


@query("routes_without", "WITH l AS (SELECT r_regionkey % 2 AS layer, 'r' || r_regionkey AS node FROM region UNION ALL SELECT 2, 'n' || n_nationkey FROM nation UNION ALL SELECT 1 + 2, 'only'), s AS (SELECT layer, CAST(count(*) AS DOUBLE) AS n FROM l GROUP BY 1), t AS (SELECT round(exp(sum(ln(n)))) AS total FROM s) SELECT node, CAST(CAST(CASE WHEN n > 1 THEN total / n * (n - 1) ELSE total / n END AS BIGINT) AS VARCHAR) AS routes, CAST(CAST(CASE WHEN n > 1 THEN -total / n ELSE total / n - total END AS BIGINT) AS VARCHAR) AS delta FROM l JOIN s USING (layer), t")
def routes_without(spark, d):
    layers = read(spark, d, "region").select((F.col("r_regionkey") % 2).alias("layer"), F.concat(F.lit("r"), "r_regionkey").alias("node"))
    layers = layers.union(read(spark, d, "nation").select(F.lit(2), F.concat(F.lit("n"), "n_nationkey"))).union(spark.createDataFrame([(3, "only")], "layer int, node string"))
    return graph.routes_without(layers, "layer", "node", F.lit(True)).select("node", F.col("routes").cast("string").alias("routes"), F.col("delta").cast("string").alias("delta"))


@query("golden_routes", "WITH RECURSIVE f(k, a, b) AS (SELECT CAST(0 AS BIGINT), CAST(1 AS HUGEINT), CAST(1 AS HUGEINT) UNION ALL SELECT k + 1, b, a + b FROM f WHERE k < 150) SELECT k, CAST(b AS VARCHAR) AS routes FROM f")
def golden_routes(spark, d):
    return graph.golden_routes(spark.range(151).withColumnRenamed("id", "k"), "k").withColumn("routes", F.col("routes").cast("string"))


@query("layered_count", "SELECT CAST((SELECT count(*) FROM region) * (SELECT count(*) FROM nation) * (SELECT count(*) FROM supplier) AS VARCHAR) AS routes")
def layered_count(spark, d):
    sizes = [read(spark, d, t).agg(F.count("*").alias("n")) for t in ("region", "nation", "supplier")]
    return graph.layered_count(sizes[0].union(sizes[1]).union(sizes[2]), "n").withColumn("routes", F.col("routes").cast("string"))


# ---------------------------------------------------------------- expressions

PATHS = Given("path string, module string", [("a/b/__init__.py", "a.b"), ("a/c.py", "a.c"), ("d.py", "d")])


@query("module_names", PATHS.sql)
def module_names(spark, d):
    return PATHS.frame(spark).select("path", exprs.module_name("path").alias("module"))


@query("texts_of_numbers", "SELECT p_partkey, CASE WHEN b < 1000000 THEN b || ' o' WHEN b < 1000000000 THEN format('{:.1f} Mo', b / 1e6) ELSE format('{:.2f} Go', b / 1e9) END AS text, CASE WHEN p_size + p_partkey % 7 > 0 THEN round(p_size / (p_size + p_partkey % 7), 6) END AS rate FROM (SELECT *, CAST(p_partkey * p_partkey * p_partkey * 997 AS BIGINT) AS b FROM part)")
def texts_of_numbers(spark, d):
    part = read(spark, d, "part")
    key = F.col("p_partkey").cast("decimal(38,0)")
    b = key * key * key * F.lit(997).cast("decimal(38,0)")  # of keys beyond 209,000 no long holds the product
    return part.select("p_partkey", exprs.bytes_text(b).alias("text"), F.round(exprs.dedup_rate("p_size", F.col("p_partkey") % 7), 6).alias("rate"))


@query("squeezed_texts", "SELECT doc_id, md5(trim(regexp_replace(text, '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g'))) AS h FROM documents")
def squeezed_texts(spark, d):
    return read(spark, d, "documents").select("doc_id", F.md5(exprs.squeezed("text")).alias("h"))


FORMULAS = Given("x double, y double", [(1.0, 2.0), (0.0, 3.0), (-4.0, 0.0), (9.0, -1.0)])


@query("formula_errors", f"SELECT x, y, CASE WHEN y <> 0 THEN x / y END AS ratio, CASE WHEN x >= 0 THEN sqrt(x) END AS root, CASE WHEN x > 0 THEN ln(x) END AS log, CASE WHEN y = 0 THEN false ELSE x / y > 0 END AS guarded, (CASE WHEN x > 0 THEN 1 ELSE 0 END) + 2.0 AS counted FROM ({FORMULAS.sql})")
def formula_errors(spark, d):
    rows, names = FORMULAS.frame(spark), ["x", "y"]
    value = lambda f: dsl.formula(f, names)
    return rows.select("x", "y", value("x / y").alias("ratio"), value("sqrt(x)").alias("root"), value("log(x)").alias("log"), F.coalesce(dsl.gate("y != 0 and x / y > 0", names), F.lit(False)).alias("guarded"), value("(x > 0) + 2").alias("counted"))


@query("declaration_scores", "WITH x AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_linestatus = 'O' THEN 1 ELSE 0 END + CASE WHEN l_returnflag = 'R' THEN 0.5 ELSE 0 END + CASE WHEN l_quantity > 25 THEN 1 ELSE 0 END + 2 * l_discount + least(3, l_quantity / 10) + least(2, l_linenumber) AS score0 FROM lineitem) SELECT l_orderkey, l_linenumber, round(score0, 6) AS score FROM x")
def declaration_scores(spark, d):
    score = retrieve.declaration_score(F.col("l_linestatus") == "O", F.col("l_returnflag") == "R", F.col("l_quantity") > 25, F.col("l_discount"), F.col("l_quantity") / 10, F.col("l_linenumber").cast("double"))
    return read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.round(score, 6).alias("score"))


# ---------------------------------------------------------------- verdicts of every branch

SHAPES = Given("k long, n long, var_rel double, phi_ratio double, contrast double", [(1, 4, 9.0, 9.0, 9.0), (2, 10, 2.5, 6.0, None), (3, 10, 2.5, 3.0, 5.0), (4, 10, 2.5, 3.0, 4.9), (5, 10, 2.4, 4.0, None), (6, 10, 1.2, 9.0, 9.0), (7, 10, 1.1, 9.0, 9.0)])


@query("f1_every_branch", f"SELECT k, CASE WHEN n < 5 THEN 'INSUFFISANT' WHEN var_rel >= 2.4 THEN CASE WHEN phi_ratio >= 5 THEN 'DÉMONTRÉ' WHEN contrast >= 5 THEN 'CONDITIONNEL' ELSE 'ÉVIDENCE' END WHEN var_rel >= 1.2 THEN 'CONDITIONNEL' ELSE 'RÉFUTÉ' END AS verdict FROM ({SHAPES.sql})")
def f1_every_branch(spark, d):
    return verdict.f1_detector(SHAPES.frame(spark), F.col("contrast")).select("k", "verdict")


SIGNALS = Given("k long, a long, b long, c long, e long, broken boolean", [(k, k & 1, k >> 1 & 1, k >> 2 & 1, k >> 3 & 1, bool(k >> 4 & 1)) for k in range(32)])


@query("snapshot_verdict_signals", f"SELECT k, CASE WHEN broken THEN 'INSTRUMENT DÉGRADÉ' WHEN a + b + c + e > 0 THEN 'DÉGRADATION DÉTECTÉE' ELSE 'STABLE' END AS verdict FROM ({SIGNALS.sql})")
def snapshot_verdict_signals(spark, d):
    from orrery.operators import diff

    return SIGNALS.frame(spark).select("k", diff.snapshot_verdict(F.col("a"), F.col("b"), F.col("c"), F.col("e"), F.col("broken")).alias("verdict"))


@query("exact_sum_total", "SELECT l_returnflag, l_linestatus, CAST(sum(CAST(l_extendedprice AS DECIMAL(18, 2))) AS DOUBLE) AS total, count(*) AS n, true AS certain FROM lineitem GROUP BY 1, 2")
def exact_sum_total(spark, d):
    """The certified sums as cents: their bounds are far below half a cent, which `certain` tells."""
    from orrery.operators import exact

    out = exact.certified_sum(read(spark, d, "lineitem"), ["l_returnflag", "l_linestatus"], "l_extendedprice")
    return out.select("l_returnflag", "l_linestatus", F.round("hi", 2).alias("total"), "n", (F.col("bound") < 0.005).alias("certain"))


TIES = Given("x double, d long, r double", [(0.125, 2, 0.13), (2.5, 0, 3.0), (-0.00001, 3, 0.0), (1.005, 3, 1.005), (12.34567, 4, 12.3457)])


@query("rounding", f"SELECT x, r FROM ({TIES.sql})")
def rounding(spark, d):
    rows = TIES.frame(spark)
    return rows.select("x", F.coalesce(*[F.when(F.col("d") == k, exprs.rounded("x", k)) for k in (0, 2, 3, 4)]).alias("r"))


GAINS = Given("cause string, p double, radiance double, ratio double", [(c, p, r, 2.5) for c in CAUSES for p in (0.2, 0.9) for r in (40.0, 95.0)])


@query("expected_gain", f"""SELECT cause, p, radiance, round(least(100 - radiance, CASE cause WHEN '{CAUSES[0]}' THEN 15 * p + (ratio - {PHI!r}) * 4 WHEN '{CAUSES[1]}' THEN 20 * p WHEN '{CAUSES[2]}' THEN 12 * p WHEN '{CAUSES[3]}' THEN 8 * p ELSE 2.0 END), 6) AS gain FROM ({GAINS.sql})""")
def expected_gain(spark, d):
    gain = verdict.expected_gain(F.col("cause"), F.col("p"), F.col("radiance"), F.col("ratio"))
    return GAINS.frame(spark).select("cause", "p", "radiance", F.round(gain, 6).alias("gain"))


@query("safe_order", "WITH r AS (SELECT p_partkey, 100 * (0.35 * least(p_size, 50) / 50 + 0.25 * least(p_partkey % 9, 6) / 6 + 0.25 * CASE WHEN p_size > 20 THEN 0 ELSE 1 END + 0.15 * least(p_partkey % 30, 20) / 20) AS risk FROM part) SELECT p_partkey, row_number() OVER (ORDER BY round(risk, 9), p_partkey) AS place FROM r")
def safe_order(spark, d):
    risk = verdict.risk(F.col("p_size"), F.col("p_partkey") % 9, F.col("p_size") > 20, F.col("p_partkey") % 30)
    return verdict.safe_order(read(spark, d, "part").withColumn("risk", risk), "risk", "p_partkey").select("p_partkey", F.col("place").cast("long").alias("place"))


STATED = Given("path string, text string", [("v.lean", """def Same (a : Nat) := a < a
def Fine (a : Nat) := a = a
theorem one (h : x < x) : ∀ y z, ∃ k : Nat, y = k := by
  simp
theorem two (g : Fine x) (h : Same (b)) (k : Same n) : p := by
  simp
lemma three (h : Fine x) : ∀ e > 0, q := by
  simp
theorem four (h : p) (f : False) : r := by
  simp
""")])  # fmt: skip


@query("vacuous_hypotheses", facts("name string, why string, detail string", ("one", "direct", "x < x"), ("two", "unfolded", "(b) < (b)"), ("four", "direct", "False")))
def vacuous_hypotheses(spark, d):
    from orrery.sources import declarations as decl

    return decl.vacuous(decl.declarations(decl.without_comments(STATED.frame(spark)))).select("name", "why", "detail")


@query("quantifiers", facts("name string, place int, quantifier string, bound string", ("one", 0, "∀", "y z"), ("one", 1, "∃", "k"), ("three", 0, "∀", "e")))
def quantifiers(spark, d):
    from orrery.sources import declarations as decl

    return decl.quantifiers(decl.declarations(decl.without_comments(STATED.frame(spark)))).select("name", "place", "quantifier", "bound")
