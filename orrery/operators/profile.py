"""Distribution profiles of grouped weights: one hash aggregation, with mergeable sums kept as columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from orrery.functions import exprs


def profile(frame: DataFrame, keys: list[str], weight: Column | str, anomalies: Column | None = None, lines: Column | None = None) -> DataFrame:
    """By group: n, total, total_sq, mean, variance, var_rel, skew, kurt, entropy, entropy_norm, phi_ratio, largest, fib_total, fib_mean, n_anomalies.

    Null weights are left out; entropy takes positive weights only. Groups of fewer than three items or
    of equal weights have skew 0 and kurtosis 3, groups of one have phi_ratio 1.
    """
    x = exprs.col(weight).cast("double")
    flagged = F.lit(0) if anomalies is None else F.when(anomalies, 1).otherwise(0)
    distance = F.lit(0.0) if lines is None else exprs.fibonacci_distance(lines)
    sums = frame.groupBy(*keys).agg(
        F.count(x).alias("n"),
        F.sum(x).alias("total"),
        F.sum(x * x).alias("total_sq"),
        F.avg(x).alias("mean"),
        F.var_pop(x).alias("variance"),
        F.skewness(x).alias("_g1"),
        F.kurtosis(x).alias("_b2"),
        F.sum(F.when(x > 0, x * F.log2(x)).otherwise(0.0)).alias("_xlogx"),
        F.max(x).alias("largest"),
        F.sum(distance).alias("fib_total"),
        F.avg(distance).alias("fib_mean"),
        F.sum(flagged).cast("long").alias("n_anomalies"),
    )
    flat = (F.col("n") < 3) | (F.col("variance") <= 0) | F.isnan("_g1")
    entropy = F.when(F.col("total") > 0, F.log2("total") - F.col("_xlogx") / F.col("total")).otherwise(0.0)
    return sums.select(
        *keys,
        "n",
        "total",
        "total_sq",
        "mean",
        "variance",
        F.when(F.col("mean") > 0, F.col("variance") / F.pow("mean", F.lit(2.0))).otherwise(0.0).alias("var_rel"),
        F.when(flat, 0.0).otherwise(F.col("_g1")).alias("skew"),
        F.when(flat, 3.0).otherwise(F.col("_b2") + 3).alias("kurt"),
        entropy.alias("entropy"),
        F.when(F.col("n") > 1, entropy / F.log2("n")).otherwise(entropy).alias("entropy_norm"),
        F.when((F.col("n") > 1) & (F.col("mean") > 0), F.col("largest") / F.col("mean")).otherwise(1.0).alias("phi_ratio"),
        "largest",
        "fib_total",
        "fib_mean",
        "n_anomalies",
    )


def scored(profiled: DataFrame) -> DataFrame:
    """A profile with both scores, the antifragility index and their ladders; status looks at the unrounded score."""
    c = F.col
    radiance = exprs.adiabatic_score(c("var_rel"), c("entropy_norm"), c("n"), c("n_anomalies"), c("fib_mean"))
    alpha = exprs.antifragility("var_rel")
    return profiled.select(
        "*",
        exprs.classic_score(c("variance"), c("entropy"), c("n_anomalies"), c("fib_total")).alias("classic"),
        radiance.alias("radiance"),
        exprs.status(radiance).alias("status"),
        alpha.alias("antifragility"),
        exprs.reserve(alpha).alias("reserve"),
    )


def with_empty_groups(scored_groups: DataFrame, groups: DataFrame, key: str) -> DataFrame:
    """Every group of the dimension; those without items get the neutral row (score 60, kurtosis 3, ratio 1)."""
    neutral = {"n": 0, "radiance": 60.0, "classic": 60.0, "kurt": 3.0, "phi_ratio": 1.0, "antifragility": exprs.PHI_INV, "var_rel": 0.0, "entropy": 0.0, "entropy_norm": 0.0, "skew": 0.0}
    out = groups.select(key).distinct().join(scored_groups, key, "left").fillna({k: v for k, v in neutral.items() if k in scored_groups.columns})
    return out.withColumn("status", exprs.status("radiance")).withColumn("reserve", exprs.reserve("antifragility"))


def item_ratio(frame: DataFrame, keys: list[str], weight: str) -> DataFrame:
    """Each item's weight over its group's mean."""
    return frame.withColumn("phi_ratio", F.try_divide(F.col(weight), F.avg(weight).over(Window.partitionBy(*keys))))


def largest_item(frame: DataFrame, keys: list[str], weight: str, order: list[str], take: list[str]) -> DataFrame:
    """By group the item of largest weight; of ties the first by `order`. A partial aggregate, no sort."""
    best = F.max_by(F.struct(*take, F.col(weight).alias("weight")), F.struct(F.col(weight), *[-F.col(c) for c in order]))
    return frame.groupBy(*keys).agg(best.alias("_b")).select(*keys, "_b.*")


def collisions(frame: DataFrame, name: str, place: str) -> DataFrame:
    """Names that stand in two places or more, with their distinct places in order."""
    return frame.groupBy(name).agg(F.count("*").alias("occurrences"), F.count_distinct(place).alias("places"), F.sort_array(F.collect_set(place)).alias("where_found")).where("places >= 2")


def bipartite(frame: DataFrame, key: str, weight: str) -> DataFrame:
    """The cut of a group's sorted weights, two or more on either side, with the largest variance between sides.

    Prefix sums over distinct weights: the windows hold one row per weight and group, so repeated
    weights, however many, are one row.
    """
    counted = frame.where(F.col(weight).isNotNull()).groupBy(key, F.col(weight).cast("double").alias("w")).agg(F.count("*").alias("c"))
    up = Window.partitionBy(key).orderBy("w")
    whole = Window.partitionBy(key)
    sums = counted.select(
        key,
        "w",
        F.sum("c").over(up.rowsBetween(Window.unboundedPreceding, 0)).alias("n1"),
        F.sum(F.col("c") * F.col("w")).over(up.rowsBetween(Window.unboundedPreceding, 0)).alias("s1"),
        F.sum("c").over(whole).alias("n"),
        F.sum(F.col("c") * F.col("w")).over(whole).alias("s"),
    ).where("n1 >= 2 AND n - n1 >= 2")
    low, high = F.col("s1") / F.col("n1"), (F.col("s") - F.col("s1")) / (F.col("n") - F.col("n1"))
    between = F.col("n1") * (F.col("n") - F.col("n1")) / (F.col("n") * F.col("n")) * F.pow(high - low, F.lit(2.0))
    cut = sums.select(key, F.struct(F.round(between, 6).alias("between"), (-F.col("n1")).alias("m"), low.alias("low"), high.alias("high")).alias("x"))
    best = cut.groupBy(key).agg(F.max("x").alias("x"))
    return best.select(key, (-F.col("x.m")).alias("n_low"), F.col("x.between").alias("between"), F.col("x.low").alias("low_mean"), F.col("x.high").alias("high_mean"), F.try_divide("x.high", "x.low").alias("contrast"))


def static(frame: DataFrame, keys: list[str], weight: str) -> DataFrame:
    """The mergeable triplet n, total and squares of each group, its nearest-rank P80, the ratio of largest to mean, and what n allows to say."""
    x = F.col(weight)
    verdict = F.when(F.col("n") < 3, "DÉGRADÉ").when(F.col("n") < 5, "CONDITIONNEL").otherwise("COUVERT")
    out = frame.groupBy(*keys).agg(F.count(x).alias("n"), F.sum(x).alias("total"), F.sum(x * x).alias("squares"), F.expr(f"percentile_disc(0.8) WITHIN GROUP (ORDER BY {weight})").alias("p80"), F.max(x).alias("_m"))
    return out.withColumn("ratio", F.col("_m") * F.col("n") / F.col("total")).drop("_m").withColumn("verdict", verdict)
