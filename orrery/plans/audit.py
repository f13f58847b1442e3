"""From source files to metrics and gates: scan, profile, score, formula."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from orrery.functions import dsl, exprs
from orrery.functions.constants import PHI
from orrery.operators import profile
from orrery.sources import files as src

#: The names that formulas use, and the columns of `audit` that they stand for.
METRICS = {
    "radiance": "radiance",
    "radiance_adiabatique": "radiance",
    "radiance_classique": "classic",
    "antifragilite": "antifragility",
    "lilith_variance": "variance",
    "lilith_rel_variance": "var_rel",
    "lilith_skewness": "skew",
    "lilith_kurtosis": "kurt",
    "shannon_entropy": "entropy",
    "shannon_entropy_norm": "entropy_norm",
    "phi_ratio": "phi_ratio",
    "phi_ratio_delta": "phi_ratio_delta",
    "fibonacci_distance": "fib_total",
    "fibonacci_distance_moyenne": "fib_mean",
    "zeta_score": "zeta",
    "nb_fonctions": "n",
    "nb_classes": "n_classes",
    "nb_imports": "n_imports",
    "nb_lignes_total": "n_lines",
    "ratio_commentaires": "comment_ratio",
    "nb_anomalies": "n_anomalies",
}


def audit(files: DataFrame) -> DataFrame:
    """One row per Python source of (path, text): the profile and scores of its functions, its totals, its largest function and its notes."""
    items = src.python_items(files).where("item IS NOT NULL")
    size = src.size_rule(items).groupBy("path").agg(F.count("*").alias("_size"))
    totals = src.python_totals(files).join(size, "path", "left").fillna(0, ["_size"])
    totals = totals.withColumn("n_anomalies", F.size(F.filter("notes", lambda x: x["level"].isin("WARNING", "CRITICAL"))) + F.col("_size")).drop("_size")
    shape = profile.profile(items, ["path"], "kappa", lines=F.col("n_lines")).drop("n_anomalies")
    largest = profile.largest_item(items, ["path"], "kappa", ["line"], ["item", "line"]).select("path", F.struct("item", "line", "weight").alias("largest_item"))
    rows = totals.join(shape, "path", "left").fillna({"n": 0, "total": 0.0, "variance": 0.0, "var_rel": 0.0, "skew": 0.0, "kurt": 3.0, "entropy": 0.0, "entropy_norm": 0.0, "phi_ratio": 1.0, "fib_total": 0.0, "fib_mean": 0.0})
    scored = profile.scored(rows)
    empty = F.col("n") == 0
    radiance = F.when(empty, 60.0).otherwise(F.col("radiance"))
    scored = scored.withColumns({"radiance": radiance, "classic": F.when(empty, 60.0).otherwise(F.col("classic")), "status": exprs.status(radiance), "phi_ratio_delta": F.abs(F.col("phi_ratio") - PHI), "zeta": exprs.zeta_score("n"), "comment_ratio": F.col("n_comments") / F.greatest(F.lit(1), F.col("n_lines"))})
    return scored.join(largest, "path", "left")


def named(audited: DataFrame) -> DataFrame:
    """path and the metrics under the names that formulas use."""
    return audited.select("path", *[F.col(c).cast("double").alias(k) for k, c in METRICS.items()])


def evaluated(audited: DataFrame, formula: str, strict: bool = False) -> DataFrame:
    """(path, value) of a formula."""
    rows = named(audited)
    return rows.select("path", dsl.formula(formula, list(METRICS), strict).alias("value"))


def check(audited: DataFrame, gate: str | None = None, least: float | None = None) -> DataFrame:
    """The sources that fail: below the least score, or with a closed gate (a formula that errs closes it). An empty result is exit status 0."""
    rows = named(audited)
    opened = F.lit(True)
    if gate is not None:
        opened &= F.coalesce(dsl.gate(gate, list(METRICS)), F.lit(False))
    if least is not None:
        opened &= F.coalesce(F.col("radiance") >= least, F.lit(False))
    return rows.where(~opened)


def overview(audited: DataFrame) -> DataFrame:
    """One row: number of sources, mean score (60 without any), its status, and the source of the largest function."""
    top = F.max_by(F.struct("path", "largest_item.item"), F.struct("largest_item.weight", "path"))
    mean = F.coalesce(F.avg("radiance"), F.lit(60.0))
    return audited.agg(F.count("*").alias("n_sources"), mean.alias("radiance"), top.alias("top")).select("n_sources", "radiance", exprs.status("radiance").alias("status"), "top.path", "top.item")


def same_names(files: DataFrame) -> DataFrame:
    """Functions that two sources or more define."""
    return profile.collisions(src.python_items(files).where("item IS NOT NULL"), "item", "path")
