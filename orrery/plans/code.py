"""Queries on sources, scans, audits and source graphs: literal sources, and their facts written out as SQL values."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from orrery.functions import extend
from orrery.functions.constants import PHI
from orrery.operators import graph, probes, profile as pf, sourcegraph as sg
from orrery.plans import audit as au
from orrery.plans.catalogue import query, read, shown
from orrery.plans.fixtures import LOG, PROOFS, PYTHON, REGISTRY, Given
from orrery.sources import declarations as decl, files, sinks


def facts(schema: str, *rows: tuple) -> str:
    return Given(schema, list(rows)).sql


def _refs(spark):
    return sg.references(PYTHON.frame(spark).where("path LIKE '%.py'"))


# ---------------------------------------------------------------- scans


def _written(spark, given: Given, name: str):
    """The literal texts as files of the shared folder, and their listing."""
    folder = graph.folder(spark, name)
    for path, text in given.rows:
        sinks.write_json_atomic(spark, f"{folder}/{path}", text or "")
    for hidden in ("build/x.py", "node_modules/y.py", "lib.egg-info/z.py"):
        sinks.write_json_atomic(spark, f"{folder}/{hidden}", "1")
    listed = files.listing(spark, folder)
    return listed.withColumn("path", F.element_at(F.split("path", folder.rsplit("/", 1)[1] + "/"), -1))


@query("scan_listing", f"SELECT path, CAST(strlen(coalesce(text, '')) AS BIGINT) AS size, CASE WHEN path LIKE '%.py' THEN 'python' END AS language FROM ({PYTHON.sql}) WHERE text IS NOT NULL")
def scan_listing(spark, d):
    return files.with_language(_written(spark, PYTHON, "listing")).select("path", "size", "language")


@query("scan_unsupported", f"SELECT path, 'no analyser for the extension' AS reason FROM ({PYTHON.sql}) WHERE path NOT LIKE '%.py'")
def scan_unsupported(spark, d):
    return files.unsupported(_written(spark, PYTHON, "unsupported")).select("path", "reason")


@query("scan_python_items", facts(
    "path string, item string, line long, n_args long, n_lines long, max_depth long, cyclomatic long, failed string",
    ("pkg/a.py", "run", 9, 1, 3, 0, 1, None), ("pkg/a.py", "step", 13, 1, 2, 0, 1, None), ("pkg/a.py", "inner", 18, 0, 2, 0, 1, None), ("pkg/a.py", "main", 17, 0, 5, 0, 1, None), ("pkg/a.py", "idle", 24, 0, 2, 0, 1, None),
    ("pkg/b.py", "close", 7, 1, 2, 0, 1, None), ("pkg/b.py", "visit_Name", 12, 2, 2, 0, 1, None), ("pkg/b.py", "helper", 16, 1, 2, 0, 1, None),
    ("pkg/c.py", "area", 5, 1, 2, 0, 1, None), ("pkg/c.py", "spare", 9, 1, 2, 0, 1, None), ("pkg/c.py", "idle", 13, 0, 7, 3, 4, None), ("tests/test_a.py", "test_main", 5, 0, 3, 0, 3, None),
    ("pkg/broken.py", None, None, None, None, None, None, "SyntaxError"),
))
def scan_python_items(spark, d):
    return files.python_items(PYTHON.frame(spark).where("path LIKE '%.py'")).select("path", "item", "line", "n_args", "n_lines", "max_depth", "cyclomatic", "failed")


@query("scan_python_rules", facts("path string, line long, level string, rule string", ("pkg/c.py", 14, "WARNING", "SUTURE"), ("pkg/c.py", 17, "CRITICAL", "LILITH")))
def scan_python_rules(spark, d):
    return files.python_totals(PYTHON.frame(spark)).select("path", F.explode("notes").alias("n")).select("path", "n.line", "n.level", "n.rule")


@query("scan_python_totals", facts("path string, n_classes long, n_imports long, n_lines long, n_comments long", ("pkg/a.py", 1, 3, 25, 0), ("pkg/b.py", 2, 2, 17, 0), ("pkg/c.py", 0, 1, 19, 0), ("tests/test_a.py", 0, 2, 7, 0), ("pkg/broken.py", None, None, 1, None), ("pkg/empty.py", 0, 0, 0, 0)))
def scan_python_totals(spark, d):
    return files.python_totals(PYTHON.frame(spark).where("path LIKE '%.py'")).select("path", "n_classes", "n_imports", "n_lines", "n_comments")


@query("scan_imports", f"SELECT DISTINCT path, module FROM (SELECT path, unnest(regexp_extract_all(text, '(?m)^\\s*(?:import|from)\\s+([\\w.]+)', 1)) AS module FROM ({PYTHON.sql}) UNION ALL SELECT path, unnest(regexp_extract_all(text, '(?m)^\\s*(?:import|from)\\s+([\\w.]+)', 1)) FROM ({PROOFS.sql}))")
def scan_imports(spark, d):
    return files.imports(PYTHON.frame(spark)).unionByName(files.imports(PROOFS.frame(spark)))


@query("scan_change_log", facts(
    "commit string, ts timestamp_ntz, subject string, file string, added long, removed long",
    ("abcdef1", "2024-01-02 10:00:00", "first subject", "src/a.py", 3, 1), ("abcdef2", "2024-02-20 10:00:00", "second | with a bar", "src/a.py", 10, 0), ("abcdef2", "2024-02-20 10:00:00", "second | with a bar", "src/b.py", 2, 2), ("abcdef3", "2024-02-25 10:00:00", "third", "src/a.py", 1, 1),
))
def scan_change_log(spark, d):
    return files.change_log(LOG.frame(spark)).withColumn("ts", F.col("ts").cast("timestamp_ntz"))


@query("scan_churn", "SELECT 'src/a.py' AS file, CAST(2 AS BIGINT) AS n UNION ALL SELECT 'src/b.py', 1")
def scan_churn(spark, d):
    changes = files.change_log(LOG.frame(spark)).withColumn("merge", F.col("subject").startswith("Merge "))
    return probes.churned(changes, F.to_timestamp(F.lit("2024-03-01 00:00:00")))


@query("churn_of_orders", "SELECT o_custkey AS file, count(DISTINCT o_orderkey) AS n FROM orders WHERE o_orderdate >= TIMESTAMP '1998-06-01' - INTERVAL 30 DAY AND o_orderstatus <> 'P' GROUP BY 1")
def churn_of_orders(spark, d):
    changes = read(spark, d, "orders").select(F.col("o_custkey").alias("file"), F.col("o_orderkey").alias("commit"), F.col("o_orderdate").alias("ts"), (F.col("o_orderstatus") == "P").alias("merge"))
    return probes.churned(changes, F.expr("TIMESTAMP_NTZ '1998-06-01 00:00:00'"))


@query("scan_markdown", facts(
    "section string, line int, cells string, malformed boolean",
    ("Routes", 2, "name|status|hole", False), ("Routes", 4, "`alpha`|NOMMÉ → PROUVÉE|1 (2)", False), ("Routes", 5, "`beta`|EN-COURS|3", False), ("Routes", 6, "broken row", True), ("Journal", 8, "a|b", False), ("Journal", 10, "x|y", False),
))
def scan_markdown(spark, d):
    return files.markdown_rows(REGISTRY.frame(spark), "text", ["path"]).select("section", "line", F.array_join("cells", "|").alias("cells"), "malformed")


@query("scan_registry_status", facts("name string, status string, holes string", ("alpha", "DÉMONTRÉ", "1,2"), ("beta", "EN-COURS", "3")))
def scan_registry_status(spark, d):
    rows = files.markdown_rows(REGISTRY.frame(spark), "text", ["path"]).where("NOT malformed AND section = 'Routes' AND cells[0] LIKE '`%'").select(*[F.col("cells")[k].alias(c) for k, c in enumerate("abc")])
    holes = F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all("c", F.lit(r"(\d+)"), 1), lambda x: x.cast("long"))))
    holes = F.array_join(holes.cast("array<string>"), ",")
    return rows.select(F.regexp_extract("a", "`([^`]+)`", 1).alias("name"), probes.status_after_arrow("b").alias("status"), holes.alias("holes"))


@query("scan_event_log", "SELECT * FROM (VALUES ('a', 'view', CAST(3 AS BIGINT)), ('b', 'click', 2)) v(agent, type, n)")
def scan_event_log(spark, d):
    folder = graph.folder(spark, "log")
    lines = ['{"agent": "a", "type": "view", "n": 3}', "{broken", '{"agent": "b", "type": "click", "n": 2}', '{"agent": "c", "type": "odd", "n": 1}']
    sinks.write_json_atomic(spark, f"{folder}/log.jsonl", "\n".join(lines))
    return files.event_log(spark, folder, "agent string, type string, n long", vocabulary=["view", "click"])


TELEMETRY = Given("path string, text string", [("ok", '{"decls_done": 4, "current_decl": "x", "term_table_size": 5, "str_table_size": 6, "bytes_written": 700, "dedup_hits": 8, "timestamp_ms": 9, "more": 1}'), ("list", "[1]"), ("broken", "{"), ("few", '{"decls_done": 1}')])


@query("scan_telemetry", f"""SELECT path, {", ".join(f"CAST(CASE WHEN path IN ('ok', 'few') THEN json_extract_string(text, '$.{f}') END AS {'VARCHAR' if f == 'current_decl' else 'BIGINT'}) AS {f}" for f in ("decls_done", "current_decl", "term_table_size", "str_table_size", "bytes_written", "dedup_hits", "timestamp_ms"))},
  CASE path WHEN 'list' THEN 'not an object' WHEN 'broken' THEN 'invalid JSON' END AS error FROM ({TELEMETRY.sql.replace("'{'", "'{}'")})""")
def scan_telemetry(spark, d):
    return probes.telemetry(TELEMETRY.frame(spark))


@query("scan_kappa_literal", "SELECT CAST(i AS INTEGER) AS ordinal, CAST(k AS DOUBLE) AS kappa FROM (VALUES (0, 10), (1, 10), (2, 1000)) v(i, k)")
def scan_kappa_literal(spark, d):
    return files.kappas(spark, "10, 10,1000")


@query("congruential_profile", "WITH RECURSIVE x(i, s) AS (SELECT 0, CAST((CAST(1664525 AS BIGINT) * 20261007 + 1013904223) % 4294967296 AS BIGINT) UNION ALL SELECT i + 1, (1664525 * s + 1013904223) % 4294967296 FROM x WHERE i < 499) SELECT CAST(i AS BIGINT) AS ordinal, CASE WHEN i = 0 THEN 200000.0 ELSE CAST(1 + s % 20000 AS DOUBLE) END AS kappa FROM x")
def congruential_profile(spark, d):
    return probes.congruential(spark, 500)


# ---------------------------------------------------------------- proof sources


def _declared(spark):
    return decl.declarations(decl.without_comments(PROOFS.frame(spark)))


@query("scan_declarations", facts("path string, kind string, name string, line long, end_line long, n_lines long, kappa long, hole boolean", ("a.lean", "theorem", "one", 3, 4, 2, 3, False), ("a.lean", "lemma", "two", 6, 7, 2, 3, True), ("a.lean", "axiom", "three", 8, 8, 1, 1, False), ("a.lean", "def", "four", 9, 9, 1, 1, False), ("b.lean", "theorem", "five", 3, 5, 3, 5, True)))
def scan_declarations(spark, d):
    return _declared(spark).drop("body")


@query("hard_holes", "SELECT 'a.lean' AS path, 'two' AS name UNION ALL SELECT 'b.lean', 'five'")
def hard_holes(spark, d):
    return _declared(spark).where("hole").select("path", "name")


@query("axiom_inventory", "SELECT 'a.lean' AS path, 'three' AS name, CAST(8 AS BIGINT) AS line")
def axiom_inventory(spark, d):
    return decl.axioms(_declared(spark)).select("path", "name", "line")


@query("unused_binders", "SELECT 'a.lean' AS path, 'one' AS name, CAST(3 AS BIGINT) AS line, 'k' AS binder")
def unused_binders(spark, d):
    return decl.unused_binders(_declared(spark)).select("path", "name", "line", "binder")


@query("impossible_statements", "SELECT 'two' AS name, 'x < x' AS stated UNION ALL SELECT 'three', 'False'")
def impossible_statements(spark, d):
    return decl.impossible(_declared(spark)).select("name", "stated")


@query("extractors_compared", "SELECT 'a.lean' AS path, 'four' AS name, CAST(9 AS BIGINT) AS line, 'first' AS only UNION ALL SELECT 'b.lean', 'five', 9, 'second' UNION ALL SELECT 'b.lean', 'five', 3, 'first'")
def extractors_compared(spark, d):
    found = _declared(spark)
    moved = F.when(F.col("name") == "five", 6).otherwise(2)
    return decl.differing(found, found.withColumn("line", F.col("line") + moved).where("name <> 'four'"))


@query("body_identifiers", "SELECT * FROM (VALUES ('one', 'h'), ('one', 'a'), ('one', 'k'), ('one', 'b'), ('one', 'c'), ('one', 'exact'), ('two', 'x'), ('three', 'False'), ('five', 'a'), ('five', 'b'), ('five', 'simp')) v(name, identifier)")
def body_identifiers(spark, d):
    return decl.identifiers(_declared(spark), ["name"])


HEADS = Given("t string, head string", [("∀ x, P x → x = y", "="), ("(a ∧ b)", "∧"), ("Nat.Prime p", "Nat.Prime"), ("∀ n, (n < m) → Foo n", "Foo"), ("¬ Bar", "Bar")])


@query("type_heads", HEADS.sql)
def type_heads(spark, d):
    return HEADS.frame(spark).select("t", F.udf(decl.head_symbol)("t").alias("head"))


QUOTES = Given("t string, odd boolean", [('a "b', True), ('a "b" # "', False), (r'a "\""', False), ("plain", False), ('"', True)])


@query("orphan_quotes", f"SELECT t FROM ({QUOTES.sql}) WHERE odd")
def orphan_quotes(spark, d):
    from orrery.operators import registry

    return registry.orphan_quotes(QUOTES.frame(spark).select("t"), "t")


# ---------------------------------------------------------------- audits


@query("audit_overview", "SELECT CAST(6 AS BIGINT) AS n_sources, 'pkg/c.py' AS path, 'idle' AS item")
def audit_overview(spark, d):
    return au.overview(au.audit(PYTHON.frame(spark).where("path LIKE '%.py'"))).select("n_sources", "path", "item")


@query("audit_anomalies", facts("path string, nb_anomalies double, nb_fonctions double", ("pkg/a.py", 0.0, 5.0), ("pkg/b.py", 0.0, 3.0), ("pkg/c.py", 2.0, 3.0), ("tests/test_a.py", 0.0, 1.0), ("pkg/broken.py", 0.0, 0.0), ("pkg/empty.py", 0.0, 0.0)))
def audit_anomalies(spark, d):
    return au.named(au.audit(PYTHON.frame(spark).where("path LIKE '%.py'"))).select("path", "nb_anomalies", "nb_fonctions")


@query("audit_gate", "SELECT 'pkg/c.py' AS path")
def audit_gate(spark, d):
    return au.check(au.audit(PYTHON.frame(spark).where("path LIKE '%.py'")), gate="nb_anomalies < 1 and nb_fonctions >= 0").select("path")


@query("audit_formula", facts("path string, value double", ("pkg/a.py", 13.0), ("pkg/b.py", 8.0), ("pkg/c.py", 7.0), ("tests/test_a.py", 4.0), ("pkg/broken.py", None), ("pkg/empty.py", 0.0)))
def audit_formula(spark, d):
    return au.evaluated(au.audit(PYTHON.frame(spark).where("path LIKE '%.py'")), "nb_fonctions * 2 + nb_imports + 0 * nb_classes")


@query("same_names", "SELECT 'idle' AS item, CAST(2 AS BIGINT) AS n_places")
def same_names(spark, d):
    found = au.same_names(PYTHON.frame(spark).where("path LIKE '%.py'"))
    return found.select("item", F.col("places").cast("long").alias("n_places"))


@query("stale_versions", "SELECT 'pkg/c.py' AS path, '1.3.0' AS told")
def stale_versions(spark, d):
    return probes.stale_versions(PYTHON.frame(spark), "1.2.0")


@query("user_analyser", f"SELECT path, 'python' AS language, 'file' AS item, CAST(1 AS BIGINT) AS line, CAST(len(text) AS DOUBLE) AS kappa, CAST(NULL AS VARCHAR) AS failed FROM ({PYTHON.sql}) WHERE path LIKE '%.py' AND text IS NOT NULL AND path <> 'pkg/broken.py' UNION ALL SELECT 'pkg/broken.py', 'python', NULL, NULL, NULL, 'ValueError' UNION ALL SELECT 'pkg/empty.py', 'python', 'file', 1, 0, NULL")
def user_analyser(spark, d):
    def whole(path, text):
        if path.endswith("broken.py"):
            raise ValueError(path)
        yield "file", 1, float(len(text))

    extend.analyser("python")(whole)
    return extend.analysed(files.with_language(PYTHON.frame(spark)))


@query("user_aggregate", "SELECT p_brand, round(exp(avg(ln(p_retailprice))), 4) + 0.0 AS middle FROM part GROUP BY 1")
def user_aggregate(spark, d):
    geometric = extend.grouped()(lambda v: math.exp(sum(map(math.log, v)) / len(v)))
    return shown(read(spark, d, "part").groupBy("p_brand").agg(geometric("p_retailprice").alias("middle")), "p_brand", middle=True)


@query("user_table_function", "SELECT n_nationkey, CAST(unnest(range(1, len(n_name) + 1)) AS INTEGER) AS at, unnest(string_split(n_name, '')) AS letter FROM nation")
def user_table_function(spark, d):
    extend.table_function(spark, "letters", "at int, letter string")(lambda text: enumerate(text, 1))
    read(spark, d, "nation").createOrReplaceTempView("user_nation")
    return spark.sql("SELECT n_nationkey, at, letter FROM user_nation, LATERAL letters(n_name)")


@query("user_strategy", "SELECT c_custkey, c_nationkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY CASE WHEN c_nationkey % 2 = 0 THEN -c_acctbal END, c_custkey) - 1 AS place, c_nationkey % 2 = 1 AS fallback FROM customer")
def user_strategy(spark, d):
    def richest(rows):
        if rows["c_nationkey"].iloc[0] % 2:
            return rows["c_custkey"].iloc[1:]  # no permutation: refused
        return rows.sort_values(["c_acctbal", "c_custkey"], ascending=[False, True])["c_custkey"]

    return extend.ordered_by(read(spark, d, "customer").select("c_custkey", "c_nationkey", "c_acctbal"), ["c_nationkey"], "c_custkey", richest, "c_custkey")


# ---------------------------------------------------------------- graphs of sources

CALLS = [
    ("pkg/a.py:Tool.run", "pkg/a.py:Tool.step", 0), ("pkg/a.py:Tool.run", "pkg/c.py:area", 4), ("pkg/a.py:Tool.step", "pkg/b.py:helper", 3), ("pkg/a.py:Tool.step", "external:os.getcwd", 5),
    ("pkg/a.py:main.inner", "pkg/b.py:helper", 3), ("pkg/a.py:main", "pkg/a.py:main.inner", 2), ("pkg/a.py:main", "pkg/a.py:Tool", 2), ("pkg/c.py:spare", "pkg/c.py:area", 2), ("pkg/c.py:idle", "external:open", 5),
    ("tests/test_a.py:test_main", "pkg/a.py:main", 3), ("tests/test_a.py:test_main", "pkg/c.py:spare", 3),
]


@query("call_resolution", facts("src string, dst string, level int", *CALLS))
def call_resolution(spark, d):
    return sg.resolved(_refs(spark), "call").select("src", "dst", "level")


@query("base_resolution", facts("src string, dst string", ("pkg/a.py:Tool", "pkg/b.py:Base"), ("pkg/b.py:Walker", "external:ast.NodeVisitor")))
def base_resolution(spark, d):
    return sg.resolved(_refs(spark), "base").select("src", "dst")


IMPORTS = [("pkg/a.py", "pkg/b.py", "pkg.b"), ("pkg/a.py", "pkg/c.py", "pkg.c"), ("pkg/a.py", None, "os"), ("pkg/b.py", None, "ast"), ("pkg/b.py", None, "pkg.gone"), ("pkg/c.py", "pkg/a.py", "pkg.a"), ("tests/test_a.py", "pkg/a.py", "pkg.a"), ("tests/test_a.py", "pkg/c.py", "pkg.c")]


@query("import_dag", facts("src string, dst string, module string", *IMPORTS))
def import_dag(spark, d):
    return sg.import_edges(_refs(spark))


@query("typed_edges", facts("src string, dst string, type string, weight double", *[(s, t, "call", 1.0) for s, t, _ in CALLS], *[(s, t, "import", 0.5) for s, t, _ in IMPORTS if t], ("pkg/a.py:Tool", "pkg/b.py:Base", "inheritance", 1.5), ("pkg/b.py:Walker", "external:ast.NodeVisitor", "inheritance", 1.5)))
def typed_edges(spark, d):
    return sg.edges(_refs(spark))


@query("import_closure", facts("origin string, node string", *[("pkg/a.py", x) for x in ("pkg/b.py", "pkg/c.py")], *[("pkg/c.py", x) for x in ("pkg/a.py", "pkg/b.py")], *[("tests/test_a.py", x) for x in ("pkg/a.py", "pkg/b.py", "pkg/c.py")]))
def import_closure(spark, d):
    return graph.closure(sg.import_edges(_refs(spark)).where("dst IS NOT NULL"))


@query("dead_code", facts("id string, line long, reason string", ("pkg/a.py:Tool.run", 9, None), ("pkg/a.py:idle", 24, None), ("pkg/b.py:Base.close", 7, None), ("pkg/b.py:Walker.visit_Name", 12, "dispatch"), ("pkg/c.py:idle", 13, None), ("tests/test_a.py:test_main", 5, "test")))
def dead_code(spark, d):
    return sg.dead_code(_refs(spark))


@query("dead_api", "SELECT 'pkg/a.py:idle' AS id, CAST(24 AS BIGINT) AS line")
def dead_api(spark, d):
    return sg.dead_api(_refs(spark))


@query("test_usage", "SELECT 'pkg/a.py:main' AS id UNION ALL SELECT 'pkg/c.py:spare'")
def test_usage(spark, d):
    return sg.used_by_tests(_refs(spark))


@query("visitor_dispatch", "SELECT 'pkg/b.py:Walker.visit_Name' AS id")
def visitor_dispatch(spark, d):
    return sg.dispatched(_refs(spark))


@query("never_executed", "SELECT * FROM (VALUES ('pkg/a.py:Tool.run'), ('pkg/a.py:Tool.step'), ('pkg/a.py:idle'), ('pkg/b.py:Base.close'), ('pkg/b.py:Walker.visit_Name'), ('pkg/c.py:idle'), ('pkg/c.py:spare'), ('pkg/c.py:area'), ('tests/test_a.py:test_main')) v(id)")
def never_executed(spark, d):
    return sg.never_executed(_refs(spark), spark.createDataFrame([("pkg/a.py:main",), ("pkg/a.py:main.inner",), ("pkg/b.py:helper",), ("pkg/b.py:helper",)], "id string"))


@query("symbol_impact", facts("name string, id string, n_dependants long, max_depth int, dependants string", ("helper", "pkg/b.py:helper", 5, 3, "pkg/a.py:Tool.step,pkg/a.py:main.inner,pkg/a.py:Tool.run,pkg/a.py:main,tests/test_a.py:test_main"), ("pkg/c.py:spare", "pkg/c.py:spare", 1, 1, "tests/test_a.py:test_main"), ("Tool.run", "pkg/a.py:Tool.run", 0, None, None), ("nowhere", None, None, None, None)))
def symbol_impact(spark, d):
    refs = _refs(spark)
    wanted = spark.createDataFrame([("helper",), ("pkg/c.py:spare",), ("Tool.run",), ("nowhere",)], "name string")
    return sg.impact(sg.edges(refs), sg.definitions(refs), wanted).drop("truncated").withColumn("dependants", F.array_join("dependants", ","))


@query("most_coupled", facts("file string, most long", ("pkg/a.py", 3), ("pkg/b.py", 2), ("pkg/c.py", 2), ("tests/test_a.py", 2)))
def most_coupled(spark, d):
    refs = _refs(spark)
    return probes.coupling_most(sg.edges(refs), sg.definitions(refs).select("id", F.col("path").alias("file")))


# ---------------------------------------------------------------- sinks


@query("sink_sarif", r"""SELECT 'pkg/c.py' AS path, '{"version":"2.1.0","runs":[{"tool":{"driver":{"name":"orrery","rules":[{"id":"LILITH"},{"id":"SUTURE"}]}},"results":[{"ruleId":"SUTURE","level":"warning","message":{"text":"rule SUTURE"},"locations":[{"physicalLocation":{"artifactLocation":{"uri":"pkg/c.py"},"region":{"startLine":14}}}]},{"ruleId":"LILITH","level":"error","message":{"text":"rule LILITH"},"locations":[{"physicalLocation":{"artifactLocation":{"uri":"pkg/c.py"},"region":{"startLine":17}}}]}]}]}' AS sarif""")
def sink_sarif(spark, d):
    notes = files.python_totals(PYTHON.frame(spark)).select("path", F.explode("notes").alias("n")).select("path", "n.line", "n.level", "n.rule", F.concat(F.lit("rule "), "n.rule").alias("message"))
    return sinks.sarif(notes)


@query("sink_json", """SELECT '{"n_nationkey":' || n_nationkey || ',"n_name":"' || n_name || '"}' AS json FROM nation""")
def sink_json(spark, d):
    return sinks.as_json(read(spark, d, "nation").select("n_nationkey", "n_name"))


@query("sink_texts", "SELECT '| r_regionkey |' || chr(10) || '|---|' || chr(10) || '| 0 |' || chr(10) || '| 1 |' || chr(10) || chr(10) || 'There are more rows.' AS markdown, 'regions' || chr(10) || 'r_regionkey' || chr(10) || '-----------' || chr(10) || '0' || chr(10) || '1' || chr(10) || '... 3 more of 5' AS console")
def sink_texts(spark, d):
    rows = read(spark, d, "region").select("r_regionkey").orderBy("r_regionkey")
    return spark.createDataFrame([(sinks.markdown(rows, 2), sinks.console(rows, "regions", 2))], "markdown string, console string")


@query("sink_snapshot", "SELECT 'v1' AS version, count(*) AS n, (SELECT count(*) FROM region) AS m FROM nation")
def sink_snapshot(spark, d):
    path = graph.folder(spark, "snapshot")
    sinks.write_snapshot(read(spark, d, "nation"), read(spark, d, "region"), path, "v1")
    symbols, edges, meta = sinks.read_snapshot(spark, path)
    return symbols.agg(F.count("*").alias("n")).crossJoin(edges.agg(F.count("*").alias("m"))).select(F.lit(meta["version"]).alias("version"), "n", "m")


@query("sink_atomic", "SELECT 'second' AS value")
def sink_atomic(spark, d):
    path = graph.folder(spark, "atomic") + "/state.json"
    for text in ("first and longer", "second"):
        sinks.write_json_atomic(spark, path, text)
    return spark.read.text(path)


@query("sink_rotation", "SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) <= 5 AS kept FROM events")
def sink_rotation(spark, d):
    kept, archived = sinks.rotated(read(spark, d, "events").select("user_id", "event_id"), ["user_id"], "event_id", 5)
    return kept.withColumn("kept", F.lit(True)).unionByName(archived.withColumn("kept", F.lit(False)))


@query("static_profile", f"SELECT p_brand, count(*) AS n, CAST(sum(p_size) AS BIGINT) AS total, CAST(sum(p_size * p_size) AS BIGINT) AS squares, quantile_disc(p_size, 0.8) AS p80, CASE WHEN count(*) < 3 THEN 'DÉGRADÉ' WHEN count(*) < 5 THEN 'CONDITIONNEL' ELSE 'COUVERT' END AS verdict, round(max(p_size) / avg(p_size) - {PHI!r}, 6) + 0.0 AS delta FROM part GROUP BY 1")
def static_profile(spark, d):
    return shown(pf.static(read(spark, d, "part"), ["p_brand"], "p_size"), "p_brand", "n", "total", "squares", "p80", "verdict", delta=F.col("ratio") - PHI, digits=6)
