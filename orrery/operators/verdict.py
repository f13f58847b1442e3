"""Typed verdicts, Bayesian scoring and risk: projections over metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from orrery.functions.constants import HYPOTHESES, PHI, PHI_INV, PRIORS
from orrery.functions.exprs import capped, col, prior_term, risk_level, sigmoid


def f1_tripwire(profiled: DataFrame, giant: float = 5.0) -> DataFrame:
    """Bound var_rel >= (R-1)^2/n, its contrapositive R <= 1 + sqrt(n var_rel), and the verdict."""
    bound = F.pow(F.col("phi_ratio") - 1, F.lit(2.0)) / F.col("n")
    verdict = F.when(F.col("n") < 3, "INDÉCIDABLE").when(F.col("var_rel") < bound - 1e-9, "INDÉCIDABLE").when(F.col("phi_ratio") >= giant, "CONDITIONNEL").otherwise("DÉMONTRÉ")
    return profiled.select("*", bound.alias("bound"), (1 + F.sqrt(F.col("n") * F.col("var_rel"))).alias("ratio_most"), verdict.alias("verdict"))


def f1_detector(profiled: DataFrame, contrast: Column | None = None, high: float = 2.40, low: float = 1.20, giant: float = 5.0) -> DataFrame:
    two = F.lit(False) if contrast is None else F.coalesce(contrast >= giant, F.lit(False))
    verdict = (
        F.when(F.col("n") < 5, "INSUFFISANT")
        .when(F.col("var_rel") >= high, F.when(F.col("phi_ratio") >= giant, "DÉMONTRÉ").when(two, "CONDITIONNEL").otherwise("ÉVIDENCE"))
        .when(F.col("var_rel") >= low, "CONDITIONNEL")
        .otherwise("RÉFUTÉ")
    )
    return profiled.select("*", verdict.alias("verdict"))


def concentration_alert(profiled: DataFrame, most: float = 2.95) -> DataFrame:
    return profiled.where(F.col("var_rel") > most).withColumn("n_eff", F.col("n") / (1 + F.col("var_rel")))


def likelihoods(phi_ratio: Column, kurt: Column, var_rel: Column, nested: Column, leaks: Column, arity: Column, radiance: Column, alpha: Column, annotated: Column) -> list[Column]:
    """Of the five hypotheses in order, each at least 1e-4."""
    raw = [
        sigmoid(phi_ratio - PHI, 1.2) * sigmoid(kurt - 4.5, 0.8),
        sigmoid(nested * 2.0 + var_rel - PHI_INV, 1.5),
        F.when(leaks > 0, 0.95).otherwise(0.05),
        F.when(arity > 0, 0.90).otherwise(0.08),
        radiance / 100 * alpha * F.when(annotated, 0.2).otherwise(1.0),
    ]
    return [F.greatest(F.lit(1e-4), x) for x in raw]


def posterior(frame: DataFrame, likelihood: list[Column], priors: list[float] = PRIORS) -> DataFrame:
    """With `posterior` (an array in order of the hypotheses), `dominant`, `probability` and `gain`. Of equal ones the first dominates; a sum of zero gives equal shares."""
    n = len(priors)
    out = frame.withColumn("_l", F.array(*[x * p for x, p in zip(likelihood, priors, strict=True)]))
    total = F.aggregate("_l", F.lit(0.0), lambda a, x: a + x)
    out = out.withColumn("_s", total).withColumn("posterior", F.transform("_l", lambda x: F.when(F.col("_s") > 0, x / F.col("_s")).otherwise(1.0 / n)))
    names = F.array(*map(F.lit, HYPOTHESES[:n]))
    best = F.array_max(F.transform("posterior", lambda x, i: F.struct(x.alias("p"), (-i).alias("i"))))
    out = out.withColumn("_b", best)
    return out.select(*frame.columns, "posterior", F.element_at(names, 1 - F.col("_b.i")).alias("dominant"), F.col("_b.p").alias("probability"))


def expected_gain(dominant: Column, probability: Column, radiance: Column, item_ratio: Column) -> Column:
    # fixed values: 15 and 4, 20, 12, 8, 2
    room = F.greatest(F.lit(0.0), 100 - radiance)
    return (
        F.when(dominant == HYPOTHESES[0], F.least(room, 15 * probability + (item_ratio - PHI) * 4))
        .when(dominant == HYPOTHESES[1], F.least(room, 20 * probability))
        .when(dominant == HYPOTHESES[2], F.least(room, 12 * probability))
        .when(dominant == HYPOTHESES[3], F.least(room, 8 * probability))
        .otherwise(F.least(room, F.lit(2.0)))
    )


def risk(d: Column, p: Column, tested: Column, c: Column) -> Column:
    """100 (.35 min(D,50)/50 + .25 min(P,6)/6 + .25 (1-T) + .15 min(C,20)/20)."""
    return 100 * (0.35 * capped(d, 50) / 50 + 0.25 * capped(p, 6) / 6 + 0.25 * F.when(tested, 0.0).otherwise(1.0) + 0.15 * capped(c, 20) / 20)


def with_risk(frame: DataFrame, d: Column, p: Column, tested: Column, c: Column) -> DataFrame:
    return frame.withColumn("risk", risk(d, p, tested, c)).withColumn("level", risk_level("risk"))


def priority_terms(kappa: Column | str, hole: Column, dependants: Column | str, churn: Column | str) -> list[Column]:
    return [prior_term(kappa), F.when(hole, 3.0).otherwise(0.0), prior_term(dependants), 0.5 * prior_term(churn)]


def priority(frame: DataFrame, kappa: Column | str, hole: Column, dependants: Column | str, churn: Column | str) -> DataFrame:
    """log1p k + 3 hole + log1p dependants + 0.5 log1p churn, with the map of terms."""
    names = ["kappa", "hole", "dependants", "churn"]
    terms = priority_terms(kappa, hole, dependants, churn)
    named = F.create_map(*[x for k, t in zip(names, terms, strict=True) for x in (F.lit(k), t)])
    return frame.withColumn("terms", named).withColumn("score", sum(terms[1:], terms[0]))


def strongest(facets: DataFrame, keys: list[str]) -> DataFrame:
    """Of facets (verdict, force, positive) the strongest positive one, else the strongest."""
    order = F.struct(F.col("positive"), F.col("force"), F.col("verdict"))
    return facets.groupBy(*keys).agg(F.max_by("verdict", order).alias("verdict"), F.max_by("force", order).alias("force"))


def prescriptions(frame: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """An array of the names of the rules that hold."""
    held = F.array(*[F.when(c, F.lit(k)) for k, c in rules.items()])
    return frame.withColumn("advice", F.array_compact(held))


def double_verdict(frame: DataFrame, verdicts: str, positive: list[str], negative: list[str]) -> DataFrame:
    """Rows whose verdicts meet both sets."""
    sets = [F.array(*map(F.lit, x)) for x in (positive, negative)]
    return frame.where(F.arrays_overlap(col(verdicts), sets[0]) & F.arrays_overlap(col(verdicts), sets[1]))


def safe_order(frame: DataFrame, risk_: str, name: str) -> DataFrame:
    """The order in which things are changed most safely: least risk first, then by name; place from 1."""
    return frame.withColumn("place", F.row_number().over(Window.orderBy(F.round(risk_, 9), name)))
