"""Queries of each family against their SQL in DuckDB, on the smallest tables."""

from pathlib import Path

import duckdb
import pytest

from orrery.plans import catalogue, changes, code, registries  # noqa: F401 (their queries join the catalogue)

SF = "/root/testdata/sf0.001"
SOME = [
    "profile_supplier", "score_supplier", "divergence_customer", "renyi_sweep_brand", "oudjat_per_group", "project_rollup", "collisions_text", "bipartite_split", "gate_supplier", "formula_supplier", "bayes_posterior", "priority_score",
    "snapshot_diff_orders", "observations_diff", "edge_diff", "aftershock_user", "seismic_report", "runs_segment", "markov_transitions", "latest_status", "impact_depth", "toposort_levels", "pagerank", "entropy_ledger", "overlap_topk", "p80_quadrant", "stream_sessions",
    "scan_listing", "scan_python_items", "scan_markdown", "scan_telemetry", "scan_declarations", "congruential_profile", "audit_gate", "audit_formula", "user_analyser", "user_strategy", "call_resolution", "typed_edges", "dead_code", "symbol_impact",
    "sink_sarif", "sink_atomic", "sink_texts", "probe_route", "probe_refutations", "verdict_scope", "ledgers_by_mechanism", "attention_list", "hole_dossier", "chain_forward", "residual_footprints", "baseline_comparison", "symbol_map", "validated_registry",
    "bragg_peaks", "registry_connected", "registry_spec_errors", "covered_by_tests", "closure", "cascade_invalidation", "dependency_order", "routes_without", "golden_routes", "formula_errors", "stream_silences", "vacuous_hypotheses", "quantifiers", "expected_gain", "safe_order", "f1_every_branch", "rounding",
]


def rows(frame, names):
    plain = frame[names].astype(object).where(frame[names].notna(), None)
    return sorted(tuple(f"{v:.6g}" if isinstance(v, float) else str(v) for v in r) for r in plain.itertuples(index=False, name=None))


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in Path(SF).glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return con


@pytest.mark.parametrize("name", SOME)
def test_query_matches_sql(spark, duck, name):
    got, want = catalogue.QUERIES[name](spark, SF).toPandas(), duck.sql(catalogue.SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got, sorted(got.columns)) == rows(want, sorted(got.columns))


def test_every_query_has_sql_or_cannot_have_it():
    without = {"rename_match", "markov_analysis", "markov_what_if", "budgeted_chains", "welch_p", "density_order", "exact_sum_bound", "approx_distinct"}
    assert set(catalogue.QUERIES) - set(catalogue.SQL) == without
