"""Operators against analytic values and small worked examples."""

import math
import random
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from orrery.functions.constants import HYPOTHESES
from orrery.operators import assign, diff, divergence, events as ev, exact, graph, ledger, markov, perf, profile as pf, retrieve, verdict

PROFILES = {
    "giant": [10] * 9 + [1000],
    "even": [10, 9, 11, 10, 9],
    "halves": [50] * 5 + [500] * 5,
    "uniform": [15] * 10,
    "pair": [10, 20],
    "pair10": [100, 200],
    "single": [7],
}


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame([(g, float(k), i) for g, ks in PROFILES.items() for i, k in enumerate(ks)], "g string, k double, i int")


def rows(frame, key):
    return {r[key]: r for r in frame.collect()}


def test_profiles(items):
    got = rows(pf.scored(pf.profile(items, ["g"], "k")), "g")
    want = {"giant": (7.4244, 9.1743, 0.6729, 0.2026, 2.6667, 8.1111), "even": (0.0058, 1.1224, 2.3178, 0.9982, 0.3436, 1.8469), "halves": (0.6694, 1.8182, 2.7614, 0.8313, 0, 1.0), "uniform": (0, 1, 3.3219, 1, 0, 3), "pair": (0.1111, 1.3333, 0.9183, 0.9183, 0, 3), "single": (0, 1, 0, 0, 0, 3)}
    for g, (v, r, h, hn, g1, b2) in want.items():
        x = got[g]
        assert (round(x.var_rel, 4), round(x.phi_ratio, 4), round(x.entropy, 4), round(x.entropy_norm, 4), round(x.skew, 4), round(x.kurt, 4)) == pytest.approx((v, r, h, hn, g1, b2), abs=1.1e-4), g
    assert got["pair"].var_rel == pytest.approx(got["pair10"].var_rel) and got["pair"].radiance == pytest.approx(got["pair10"].radiance)


def test_profile_of_null_and_zero_weights(spark):
    frame = spark.createDataFrame([("z", 0.0), ("z", 0.0), ("n", None), ("m", 4.0), ("m", None)], "g string, k double")
    got = rows(pf.scored(pf.profile(frame, ["g"], "k")), "g")
    assert (got["z"].entropy, got["z"].var_rel, got["z"].phi_ratio) == (0, 0, 1)
    assert got["m"].n == 1 and got["n"].n == 0
    groups = spark.createDataFrame([("m",), ("absent",)], "g string")
    assert rows(pf.with_empty_groups(pf.scored(pf.profile(frame, ["g"], "k")), groups, "g"), "g")["absent"].radiance == 60.0


def test_divergences(items):
    got = rows(divergence.divergences(items, ["g"], "k").join(divergence.total_variation(items, ["g"], "k"), "g"), "g")
    want = {"giant": (2.6490, 2.2164, 0.6515, 0.8174, 1.1870), "even": (0.0042, 0.1155, 0.0269, 0.0327, 4.9710), "halves": (0.5605, 0.5978, 0.3356, 0.4091, 5.9901), "uniform": (0, 0, 0, 0, 10), "pair": (0.0817, 0.2877, 0.1200, 0.1667, 1.8)}
    for g, w in want.items():
        x = got[g]
        assert (x.kl_bits, x.d_inf, x.hellinger, x.tv, x.n_eff) == pytest.approx(w, abs=1e-4), g
    assert got["single"].entropy_norm == 1.0


def test_alpha_sweep(items):
    out = divergence.alpha_sweep(items, ["g"], "k", [0.5, 1.0, 2.0, math.inf]).collect()
    assert all(r.unified for r in out)
    by = {(r.g, r.alpha): r for r in out}
    assert by["uniform", math.inf].t == 0 and by["giant", math.inf].t == math.inf
    assert by["giant", 2.0].t == pytest.approx(7.4244, abs=1e-4)  # chi-squared
    assert all(by[g, 1.0].d <= by[g, 2.0].d + 1e-9 <= by[g, math.inf].d + 2e-9 for g in PROFILES)


def test_bipartite(items):
    x = rows(pf.bipartite(items, "g", "k"), "g")
    assert (x["halves"].n_low, x["halves"].contrast) == (5, 10)
    assert "pair" not in x and "single" not in x


def test_largest_item_takes_the_first_of_ties(spark):
    frame = spark.createDataFrame([("a", 1, 5.0), ("a", 2, 9.0), ("a", 3, 9.0)], "g string, i int, k double")
    (r,) = pf.largest_item(frame, ["g"], "k", ["i"], ["i"]).collect()
    assert (r.i, r.weight) == (2, 9.0)


def test_verdicts(items):
    p = pf.profile(items, ["g"], "k")
    assert rows(verdict.f1_tripwire(p), "g")["giant"].verdict == "CONDITIONNEL"
    assert rows(verdict.f1_tripwire(p), "g")["pair"].verdict == "INDÉCIDABLE"
    d = rows(verdict.f1_detector(p), "g")
    assert (d["giant"].verdict, d["uniform"].verdict, d["pair"].verdict) == ("DÉMONTRÉ", "RÉFUTÉ", "INSUFFISANT")
    assert [r.g for r in verdict.concentration_alert(p).collect()] == ["giant"]


def test_posterior(spark):
    frame = spark.createDataFrame([(0.0, 0.5), (1.0, 0.5)], "a double, b double")
    out = verdict.posterior(frame, [F.col("a"), F.col("b"), F.lit(0.0), F.lit(0.0), F.lit(0.0)]).collect()
    assert all(sum(r.posterior) == pytest.approx(1) for r in out)
    assert out[0].dominant == HYPOTHESES[1]
    nothing = verdict.posterior(frame, [F.lit(0.0)] * 5).first()
    assert nothing.posterior == [0.2] * 5 and nothing.dominant == HYPOTHESES[0]


def test_risk_at_its_caps(spark):
    frame = spark.createDataFrame([(50, 6, False, 20), (0, 0, True, 0), (500, 60, False, 200)], "d int, p int, t boolean, c int")
    out = verdict.with_risk(frame, F.col("d"), F.col("p"), F.col("t"), F.col("c")).collect()
    assert [r.risk for r in out] == pytest.approx([100, 0, 100]) and [r.level for r in out] == ["CRITIQUE", "FAIBLE", "CRITIQUE"]


def test_observations_in_order(spark):
    schema = "file string, name string, line int, h_statement string, h_body string, n_body_lines int, hole boolean, is_axiom boolean"
    before = [("f", "foo", 1, "s", "b", 3, False, False), ("f", "long", 2, "s", "b", 9, False, False), ("f", "bar", 3, "s", "b", 1, False, False), ("f", "old", 4, "s", "b", 1, False, False)]
    after = [("f", "foo", 1, "t", "b", 3, False, False), ("f", "long", 2, "t", "c", 1, False, False), ("f", "bar", 3, "s", "c", 1, False, False), ("f", "ax", 5, "s", "b", 0, False, True), ("f", "hole", 6, "s", "b", 1, True, False), ("f", "new", 7, "s", "b", 1, False, False), ("g", "new", 8, "s", "b", 1, False, False)]
    out = diff.observations(spark.createDataFrame(before, schema), spark.createDataFrame(after, schema)).collect()
    assert [(r.kind, r.name, r.salience) for r in out] == [("enonce_change", "foo", 10), ("enonce_change", "long", 10), ("effondrement_preuve", "long", 9), ("nouvel_axiome", "ax", 9), ("doublon", "new", 8), ("nouveau_sorry", "hole", 8), ("symbole_perdu", "old", 5), ("corps_change", "bar", 1), ("symbole_gagne", "new", 1), ("symbole_gagne", "new", 1)]


def test_renames_are_greedy_and_unique(spark):
    lost = spark.createDataFrame([("f", "a", 10), ("f", "b", 12), ("f", "c", 50)], "file string, name string, line int")
    gained = spark.createDataFrame([("f", "x", 11), ("f", "y", 21), ("f", "c", 51), ("g", "z", 10)], "file string, name string, line int")
    got = {(r.old_name, r.new_name) for r in diff.renames(lost, gained).collect()}
    assert got == {("a", "x"), ("b", "y")}


def test_edges_and_manifest(spark):
    a = spark.createDataFrame([("a", "b"), ("b", "c")], "src string, dst string")
    b = spark.createDataFrame([("a", "b"), ("a", "c")], "src string, dst string")
    assert {(r.src, r.dst, r.change, r.source_gone) for r in diff.edges_changed(a, b).collect()} == {("b", "c", "broken", True), ("a", "c", "new", False)}
    m = diff.manifest_delta(spark.createDataFrame([("p", "1"), ("q", "1"), ("r", "1")], "f string, h string"), spark.createDataFrame([("p", "1"), ("q", "2"), ("s", "1")], "f string, h string"), "f", "h")
    assert {r.f: r.change for r in m.collect()} == {"p": "unchanged", "q": "modified", "r": "removed", "s": "added"}


def test_aftershock_boundary(spark):
    frame = spark.createDataFrame([("a", "2024-01-01 00:00:00"), ("a", "2024-01-01 12:00:00"), ("a", "2024-01-02 00:00:00"), ("b", "2024-01-01 00:00:00"), ("b", "2024-01-01 12:00:00"), ("b", "2024-01-02 00:00:01")], "f string, t string").withColumn("t", F.to_timestamp("t"))
    assert {r.f: r.aftershock for r in ev.aftershock(frame, "f", "t").collect()} == {"a": True, "b": False}


def test_mechanisms(spark):
    frame = spark.createDataFrame([(5, 0), (0, 5), (5, 4), (100, 5), (0, 0)], "a int, r int")
    assert [r[0] for r in frame.select(ev.mechanism(F.col("a"), F.col("r"))).collect()] == ["construction", "effondrement", "barattage", "ajustement", "stable"]


def test_silence(spark):
    frame = spark.createDataFrame([("a", "2024-01-01 00:30:00"), ("b", "2024-01-01 00:29:59"), ("c", None)], "k string, t string").withColumn("t", F.to_timestamp("t"))
    out = ev.silent(frame, "t", F.to_timestamp(F.lit("2024-01-01 01:00:00"))).collect()
    assert {r.k: r.orphan for r in out} == {"a": False, "b": True, "c": True}


def edges(spark, pairs):
    return spark.createDataFrame(pairs, "src string, dst string")


def test_reach(spark):
    e = edges(spark, [("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("a", "a")])
    start = spark.createDataFrame([("a",)], "n string")
    out = graph.reach(e, start).collect()
    assert {r.node: (r.depth, r.truncated) for r in out} == {"b": (1, False), "c": (2, False), "d": (3, False)}
    assert {r.node: r.path for r in out}["d"] == ["a", "b", "c", "d"]
    assert all(r.truncated for r in graph.reach(e, start, 1).collect())
    assert {r.node for r in graph.reach(e, spark.createDataFrame([("d",)], "n string"), backward=True).collect()} == {"a", "b", "c"}


def test_routes_and_levels(spark):
    diamond = edges(spark, [("a", "b"), ("a", "c"), ("b", "d"), ("c", "d"), ("d", "e")])
    start = spark.createDataFrame([("a",)], "n string")
    assert {r.node: int(r.routes) for r in graph.routes(diamond, start).collect()}["e"] == 2
    assert {r.node: int(r.routes) for r in graph.routes(diamond, start, spark.createDataFrame([("b",)], "n string")).collect()}["e"] == 1
    assert {r.node: r.level for r in graph.levels(diamond).collect()} == {"a": 0, "b": 1, "c": 1, "d": 2, "e": 3}
    loop = {r.node: r.level for r in graph.levels(edges(spark, [("a", "b"), ("b", "c"), ("c", "b")])).collect()}
    assert loop == {"a": 0, "b": None, "c": None}
    with pytest.raises(ValueError, match="cycle"):
        graph.routes(edges(spark, [("a", "b"), ("b", "a")]), start, most=5)
    steps = edges(spark, [(str(k), str(k + d)) for k in range(12) for d in (1, 2) if k + d <= 11])
    assert {r.node: int(r.routes) for r in graph.routes(steps, spark.createDataFrame([("0",)], "n string")).collect()}["11"] == 144


def test_pagerank_sums_to_one(spark):
    out = graph.pagerank(edges(spark, [("a", "b"), ("b", "c"), ("c", "a"), ("d", "a")]), rounds=30).collect()
    assert sum(r.rank for r in out) == pytest.approx(1)
    ranks = {r.node: r.rank for r in out}
    assert ranks["a"] > ranks["b"] > ranks["c"] > ranks["d"]


def test_first_edges_and_unused(spark):
    e = spark.createDataFrame([("a", "b", "call", 1.0), ("a", "b", "import", 0.5), ("a", "a", "call", 1.0)], "src string, dst string, type string, weight double")
    (r,) = graph.first_edges(e, {"import": 0, "call": 1}).collect()
    assert (r.src, r.dst, r.type, r.weight) == ("a", "b", "import", 0.5)
    nodes = spark.createDataFrame([("a",), ("b",)], "n string")
    assert [r.n for r in graph.unused(nodes, e.where("src <> dst"), "n").collect()] == ["a"]


def chain(spark, p, d):
    return spark.createDataFrame([(a, b, x, float(d[a])) for a, b, x in p], "src string, dst string, p double, duration double")


def test_markov_known_solutions(spark):
    out = rows(markov.analysis(chain(spark, [("A", "A", 0.7), ("A", "B", 0.3), ("B", "A", 0.4), ("B", "B", 0.6)], {"A": 1, "B": 1})), "state")
    assert (out["A"].stationary, out["B"].stationary) == pytest.approx((4 / 7, 3 / 7), abs=1e-6)
    out = rows(markov.analysis(chain(spark, [("A", "B", 1.0), ("B", "DONE", 0.8), ("B", "FAIL", 0.2)], {"A": 10, "B": 20})), "state")
    assert out["A"].absorption == pytest.approx(30) and out["B"].bottleneck
    out = rows(markov.analysis(chain(spark, [("A", "B", 0.8), ("A", "FAIL", 0.2), ("B", "DONE", 1.0)], {"A": 10, "B": 20})), "state")
    assert out["A"].absorption == pytest.approx(26)
    gain = markov.what_if(chain(spark, [("A", "B", 1.0), ("B", "DONE", 1.0)], {"A": 10, "B": 25})).collect()
    assert gain[0].state == "B" and gain[0].before == pytest.approx(30) and gain[0].gain == pytest.approx(12.5)


def test_ledger(spark):
    masses = spark.createDataFrame([("x", 0.9), ("y", 0.05), ("z", 0.05)], "node string, w double")
    out = sorted(ledger.ledger(masses, spark.createDataFrame([(1, "x")], "step long, node string"), "node", "w", "step").collect(), key=lambda r: r.step or 0)
    assert [r.entropy for r in out] == pytest.approx([0.5690, 1.0], abs=1e-4) and out[1].gain < 0
    kills = spark.createDataFrame([(1, "x"), (2, "unknown"), (3, "y"), (4, "z"), (5, "x")], "step long, node string")
    out = sorted(ledger.ledger(masses, kills, "node", "w", "step").collect(), key=lambda r: r.step or 0)
    assert [r.killed for r in out] == [0, 1, 0, 1, 1, 0] and out[-1].entropy == 0
    assert sum(r.gain for r in out) == pytest.approx(out[0].entropy)


def test_collapse_cost_is_not_negative(spark):
    rng = random.Random(20260930)
    for _ in range(3):
        masses = spark.createDataFrame([(z, rng.random()) for z in "abcd"], "z string, m double")
        assert ledger.collapse_cost(masses, "z", "m", ["a", "b"]).first().cost >= -1e-12


def test_golden_prior_moves_the_mass_of_an_empty_class(spark):
    n = spark.createDataFrame([(1, True), (2, False), (3, False)], "n int, o boolean")
    assert sum(r.prior for r in ledger.golden_prior(n, F.col("o"), "n").collect()) == pytest.approx(1)
    assert [r.prior for r in ledger.golden_prior(n.where("NOT o"), F.col("o"), "n").collect()] == [0.5, 0.5]


def test_imputation(spark):
    n = spark.createDataFrame([("a",), ("b",), ("c",)], "n string")
    known = spark.createDataFrame([("a", 2.0), ("b", 4.0)], "n string, v double")
    assert {r.n: r.v for r in ledger.imputed(n, known, "n", "v").collect()} == {"a": 2.0, "b": 4.0, "c": 3.0}
    assert {r.v for r in ledger.imputed(n, known.limit(0), "n", "v").collect()} == {1.0}


def test_idf_bounds(spark):
    docs = spark.createDataFrame([(1, "all one"), (2, "all two"), (3, "all two")], "d int, t string")
    got = {r.token: r.idf for r in retrieve.idf(retrieve.tokenized(docs, "d", "t"), "d", 3).collect()}
    assert got["all"] == 0 and got["one"] == pytest.approx(1) and 0 < got["two"] < 1
    assert {r.idf for r in retrieve.idf(retrieve.tokenized(docs.limit(1), "d", "t"), "d", 1).collect()} == {0.0}


def test_chains_hold_the_budget(spark):
    n = spark.createDataFrame([("a", 1.0), ("b", 2.0), ("c", 3.0)], "n string, c double")
    out = retrieve.chains(n, edges(spark, [("a", "b"), ("b", "c"), ("c", "a")]), "n", "c", 3, 5.0, 100, 10).collect()
    assert [(r.chain, r.cost) for r in out if r.length == 2] == [(["a", "b"], 5.0)] and not out[0].truncated
    assert retrieve.chains(n, edges(spark, [("a", "b")]), "n", "c", 3, 99.0, 1, 10).first().truncated


def test_p80_and_pareto(spark):
    for n, want in ((1, 0), (2, 1), (5, 3), (10, 7)):
        frame = spark.createDataFrame([(i, float(i)) for i in range(n)], "s int, t double")
        assert min(r.s for r in perf.quadrants(frame, "s", "t").where("big").collect()) == want
    frame = spark.createDataFrame([("g", i, 60.0 if i == 0 else 10.0) for i in range(5)], "g string, i int, v double")
    (r,) = perf.pareto(frame, ["g"], "v", "i").collect()
    assert r.top_share == pytest.approx(0.6) and r.pareto
    assert perf.pearson(frame.limit(2), ["g"], "i", "v").first().pearson is None


def test_sturmian_slots(spark):
    assert [r[0] for r in spark.range(12).select(assign.sturmian_slot("id", 4)).collect()] == [0, 2, 0, 3, 1, 0, 2, 1, 3, 2, 0, 3]
    order = assign.density_order(spark.createDataFrame([("g", float(v), i) for i, v in enumerate([1, 1, 1, 9, 5])], "g string, v double, i int"), ["g"], "v", "i").collect()
    assert sorted(r.place for r in order) == [1, 2, 3, 4, 5] and {r.i for r in order if r.place <= 3} == {0, 1, 2}


def test_certified_sums(spark):
    rng = random.Random(42)
    values = [rng.uniform(-1, 1) * 10 ** rng.randint(-12, 12) for _ in range(500)] + [1e16, 1.0, -1e16]
    frame = spark.createDataFrame([("g", v) for v in values], "g string, v double").repartition(3)
    (r,) = exact.certified_sum(frame, ["g"], "v").collect()
    error = abs(Fraction(r.hi) + Fraction(r.lo) - sum(map(Fraction, values)))
    assert error <= Fraction(r.bound)
    assert exact.two_prod(0.1, 0.3)[1] == float(Fraction(0.1) * Fraction(0.3) - Fraction(0.1 * 0.3))
