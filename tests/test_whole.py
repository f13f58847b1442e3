"""Queries over all rows: against their SQL, and that nothing is left out."""

from pathlib import Path

import duckdb
import pytest

from orrery.operators import graph, perf
from orrery.plans import catalogue, changes

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in Path(SF).glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return con


def same(spark, duck, name):
    """The query's rows, which are those of its SQL."""
    got, want = catalogue.QUERIES[name](spark, SF).toPandas(), duck.sql(catalogue.SQL[name]).df()
    names = sorted(want.columns)
    assert sorted(got.columns) == names
    rows = [sorted(tuple(f"{v:.6g}" if isinstance(v, float) else str(v) for v in r) for r in f[names].astype(object).where(f[names].notna(), None).itertuples(index=False, name=None)) for f in (got, want)]
    assert rows[0] == rows[1]
    return got


def test_observations_diff_compares_every_document(spark, duck):
    got = same(spark, duck, "observations_diff")
    states = [changes._state(spark, SF, odd).select("file", "name").distinct() for odd in (0, 1)]
    assert sum(s.count() for s in states) == duck.sql("SELECT count(*) FROM documents WHERE text IS NOT NULL").fetchall()[0][0]
    assert states[0].join(states[1], ["file", "name"]).count() == duck.sql("SELECT count(*) FROM documents a JOIN documents b ON a.doc_id + 1 = b.doc_id AND a.doc_id % 2 = 0").fetchall()[0][0]
    assert "enonce_change" in set(got["kind"])


@pytest.mark.parametrize("name, start", [("impact_depth", "src"), ("backward_dependants", "dst")])
def test_reach_starts_everywhere_and_goes_ten_deep(spark, duck, name, start):
    got = same(spark, duck, name)
    assert set(got["origin"]) == {r[0] for r in duck.sql(f"SELECT DISTINCT {start} FROM ({changes.CHAIN})").fetchall()}
    assert got["depth"].max() == 10


def test_coupling_has_every_pair_of_nations(spark, duck):
    got = same(spark, duck, "coupling_instability")
    assert got["ce"].sum() == got["ca"].sum() == duck.sql(f"WITH {changes.NATIONS} SELECT count(*) FROM e WHERE a <> b").fetchall()[0][0]


def test_pagerank_goes_on_to_the_tolerance(spark):
    pairs = [(k, k + 1) for k in range(12)] + [(12, 0), (3, 0), (7, 20), (0, 5)]
    nodes = sorted({x for p in pairs for x in p})
    out = {v: [b for a, b in pairs if a == v] for v in nodes}
    rank = dict.fromkeys(nodes, 1 / len(nodes))
    for k in range(1, 201):
        lost = sum(rank[v] for v in nodes if not out[v])
        now = {v: 0.15 / len(nodes) + 0.85 * (sum(rank[a] / len(out[a]) for a, b in pairs if b == v) + lost / len(nodes)) for v in nodes}
        change, rank = sum(abs(now[v] - rank[v]) for v in nodes), now
        if change < 1e-8:
            break
    assert 20 < k < 200
    got = {r.node: r.rank for r in graph.pagerank(spark.createDataFrame(pairs, "src long, dst long")).collect()}
    assert got == pytest.approx(rank, abs=1e-12)


def test_diffusion_takes_eight_steps(spark, duck):
    same(spark, duck, "diffuse_density")


def test_manifest_delta_compares_every_document(spark, duck):
    got = same(spark, duck, "manifest_delta")
    assert got["before_h"].notna().sum() + got["after_h"].notna().sum() == duck.sql("SELECT count(text) FROM documents").fetchall()[0][0]


def test_manifest_delta_tells_removed_and_added(spark):
    before, after = (spark.createDataFrame(r, "path long, h string") for r in ([(1, "a"), (2, "b"), (3, "c")], [(2, "b"), (3, "x"), (4, "d")]))
    got = {r.path: r.change for r in changes.diff.manifest_delta(before, after, "path", "h").collect()}
    assert got == {1: "removed", 2: "unchanged", 3: "modified", 4: "added"}


def test_levels_beyond_the_bound_are_not_taken_for_a_cycle(spark):
    chain = spark.createDataFrame([(k, k + 1) for k in range(5)], "src long, dst long")
    assert {r.node: r.level for r in graph.levels(chain, most=6).collect()} == {k: k for k in range(6)}
    with pytest.raises(ValueError, match="more levels"):
        graph.levels(chain, most=3)


def test_chains_are_not_cut(spark):
    assert not any(r.truncated for r in catalogue.QUERIES["budgeted_chains"](spark, SF).collect())


@pytest.mark.parametrize("kind", ["spread", "ties", "few"])
def test_order_statistics_are_exact(spark, kind):
    import random

    rng = random.Random(4)
    values = [{"spread": rng.gauss(0, 1e6), "ties": float(rng.choice([1, 1, 1, 2, rng.randrange(500)])), "few": float(rng.randrange(4))}[kind] for _ in range(3000)]
    frame = spark.createDataFrame([(v,) for v in [*values, None]], "v double")
    ranks = [1, 2, 700, 1500, 1501, 2999, 3000]
    assert perf.order_statistics(frame, "v", ranks, most=40) == [sorted(values)[r - 1] for r in ranks]
    assert perf.median(frame, "v") == (sorted(values)[1499] + sorted(values)[1500]) / 2
    assert perf.percentile(frame, "v", 0.8) == sorted(values)[2399]
    assert perf.median(frame.limit(0), "v") is None


def test_streams_of_several_batches_and_late_events(spark, tmp_path):
    from orrery.streaming import streams

    times = [("a", 0), ("a", 3600), ("b", 0), ("a", 200_000), ("a", 7200), ("a", 203_600), ("b", 100_000), ("a", 260_000), ("c", 900_000)]
    times = [(k, 10_000_000 + s) for k, s in times]
    for part in (times[:4], times[4:6], times[6:]):  # 7200 comes after 200,000
        spark.createDataFrame(part, "k string, s long").selectExpr("k", "timestamp_seconds(s) AS ts").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    rows = streams.stream(spark, str(tmp_path / "in"), "k string, ts timestamp", files=1)
    got = {(r.k, int(r.at.timestamp()) - 10_000_000) for r in streams.drained(streams.bursts(rows, "k", late="10 days"), str(tmp_path / "bursts")).collect()}
    assert got == {("a", 7200), ("a", 260_000)}
    quiet = {(r.k, int(r["last"].timestamp()) - 10_000_000) for r in streams.drained(streams.silences(rows, "k", seconds=86_400, late="0 seconds"), str(tmp_path / "silences")).collect()}
    assert {("a", 3600), ("a", 260_000), ("b", 0)} <= quiet  # 100,000 of b comes later than the watermark allows
