"""Declarations and registries."""

from pyspark.sql import functions as F

from orrery.operators import registry
from orrery.sources import declarations as decl

TEXT = '''import A.B
/- theorem hidden : sorry /- nested -/ still -/
theorem one (h : a) (k : b) : c := by
  exact h -- sorry

lemma two : x < x := by
  sorry
axiom three : False
def four := "sorry"
'''


def test_declarations(spark):
    files = spark.createDataFrame([("f.lean", TEXT)], "path string, text string")
    found = decl.declarations(decl.without_comments(files))
    rows = {r["name"]: r for r in found.collect()}
    assert {k: (r.kind, r.line, r.end_line, r.hole) for k, r in rows.items()} == {"one": ("theorem", 3, 4, False), "two": ("lemma", 6, 7, True), "three": ("axiom", 8, 8, False), "four": ("def", 9, 9, False)}
    assert rows["one"].kappa == 3
    assert [r.name for r in decl.axioms(found).collect()] == ["three"]
    assert [(r["name"], r.binder) for r in decl.unused_binders(found).collect()] == [("one", "k")]
    assert {r["name"] for r in decl.impossible(found).collect()} == {"two", "three"}
    assert ("one", "h") in {(r["name"], r.identifier) for r in decl.identifiers(found, ["name"]).collect()}
    other = found.withColumn("line", F.col("line") + 2).where("name <> 'four'")
    assert [(r["name"], r.only) for r in decl.differing(found, other).collect()] == [("four", "first")]


def test_heads():
    assert [decl.head_symbol(x) for x in ("∀ x, P x → x = y", "(a ∧ b)", "Nat.Prime p", "∀ n, (n < m) → Foo n", "¬ Bar")] == ["=", "∧", "Nat.Prime", "Foo", "Bar"]


def test_substring_joins(spark):
    texts = spark.createDataFrame([("The Foobar lemma",), ("nothing",), ("",)], "title string")
    names = spark.createDataFrame([("foobar",), ("lemma",), ("foo",), ("hing",)], "n string")
    assert {(r.title, r.n) for r in registry.occurrences(texts, names, "title", "n").collect()} == {("The Foobar lemma", "foobar"), ("The Foobar lemma", "lemma"), ("nothing", "hing")}
    ob = spark.createDataFrame([("about foobar", "lemma"), ("about foobar2", None), ("else", None)], "title string, k string")
    got = {(r.title, r.n, r.how) for r in registry.attached(ob, names, "title", "k", "n").collect()}
    assert got == {("about foobar", "lemma", "exact"), ("about foobar2", "foobar", "contains"), ("else", None, "none")}


def test_registry_checks(spark):
    items = spark.createDataFrame([(1, "n1", "h1", ["a", "b"]), (2, "n1", "h2", ["c"]), (3, "n2", "h2", ["b"])], "i int, n string, h string, t array<string>")
    assert {(r.a, r.b, r.why) for r in registry.connected(items, "i", "n", "h", "t").collect()} == {(1, 2, "equal"), (2, 3, "head"), (1, 3, "token")}
    assert [r.i for r in registry.probe(items, "t", ["b"], -F.col("i"), "n").collect()] == [3, 1]
    modules = spark.createDataFrame([("m",), ("n",)], "m string")
    entries = spark.createDataFrame([("m", "short", "core"), ("x", "a text that is long enough", "odd")], "m string, text string, k string")
    assert {(r.m, r.problem) for r in registry.unjustified(modules, entries, "m", "text", "k", ["core"]).collect()} == {("m", "text too short"), ("n", "no entry"), ("x", "no module"), ("x", "unknown kind")}
    specs = spark.createDataFrame([("a", "(x)", ["i"]), ("1b", "(x", []), ("a", "sorry", ["i"]), (None, "", None)], "n string, b string, i array<string>")
    got = sorted(sorted(r.errors) for r in registry.spec_errors(specs, "n", "b", "i", ["n", "b"]).collect())
    assert got == [["bad name", "no import", "unbalanced ()"], ["hole", "repeated name"], ["missing b", "missing n", "no import"], ["repeated name"]]
    zones = registry.zone_counts(spark.createDataFrame([("h", "open"), ("h", "open"), ("h", "shut")], "h string, z string"), "h", "z", ["open", "shut"], spark.createDataFrame([("h",), ("g",)], "h string"))
    assert {(r.h, r.open, r.shut) for r in zones.collect()} == {("h", 2, 1), ("g", 0, 0)}
    now, then = (spark.createDataFrame(x, "path string, modified int") for x in ([("a", 1), ("b", 2), ("d", 1)], [("a", 1), ("b", 1), ("c", 1)]))
    assert {(r.path, r.action) for r in registry.stale(then, now).collect()} == {("b", "refresh"), ("c", "delete"), ("d", "insert")}
    lines = spark.createDataFrame([('a "b',), ('a "b" # "',), (r'a "\""',)], "t string")
    assert registry.orphan_quotes(lines, "t").count() == 1
    worst = registry.severity(spark.createDataFrame([("k", "OK"), ("k", "DÉGRADÉ"), ("j", "OK")], "k string, v string"), ["k"], "v")
    assert {r.k: r.v for r in worst.collect()} == {"k": "DÉGRADÉ", "j": "OK"}
    best = registry.by_priority([spark.createDataFrame([("x", "t2")], "n string, t string"), spark.createDataFrame([("x", "t1"), ("y", "t3")], "n string, t string")], "n", "t")
    assert {(r.n, r.t, r.level) for r in best.collect()} == {("x", "t2", 0), ("y", "t3", 1)}
    prof = registry.attributed(spark.createDataFrame([("f", 1.0), ("g", 2.0)], "s string, v double"), spark.createDataFrame([("a.f",), ("b.f",)], "q string"), "s", "q")
    assert prof.count() == 3 and prof.where("NOT known").count() == 1
    assert registry.ranked_mirrors(spark.createDataFrame([("a", None), ("b", 2.0)], "n string, l double"), "l", "n").first().n == "b"
