"""Divergences of a group's shares from the uniform distribution, in algebraic form: one aggregation.

With n weights k, sum S and p = k / S: chi-squared is var/mean^2; KL (bits) log2 n - H; D_inf (nats)
ln(n max p); Hellinger sqrt(1 - sum sqrt(k) / sqrt(n S)). Total variation needs the mean on each
row, so it takes the group's mean by a second aggregation joined on the key.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from orrery.functions.exprs import col


def divergences(frame: DataFrame, keys: list[str], weight: Column | str) -> DataFrame:
    """n, chi2, kl_bits, d_inf, hellinger, entropy_norm, n_eff and contrast by group; weights are positive or zero."""
    x = col(weight).cast("double")
    sums = frame.groupBy(*keys).agg(
        F.count(x).alias("n"),
        F.sum(x).alias("s"),
        F.sum(x * x).alias("s2"),
        F.max(x).alias("hi"),
        F.min(x).alias("lo"),
        F.sum(F.sqrt(x)).alias("root"),
        F.sum(F.when(x > 0, x * F.log2(x)).otherwise(0.0)).alias("xlogx"),
    ).where("s > 0")
    h = F.log2("s") - F.col("xlogx") / F.col("s")
    chi2 = F.greatest(F.lit(0.0), F.col("n") * F.col("s2") / (F.col("s") * F.col("s")) - 1)
    return sums.select(
        *keys,
        "n",
        chi2.alias("chi2"),
        F.greatest(F.lit(0.0), F.log2("n") - h).alias("kl_bits"),
        F.log(F.col("n") * F.col("hi") / F.col("s")).alias("d_inf"),
        F.sqrt(F.greatest(F.lit(0.0), 1 - F.col("root") / F.sqrt(F.col("n") * F.col("s")))).alias("hellinger"),
        F.when(F.col("n") > 1, h / F.log2("n")).otherwise(1.0).alias("entropy_norm"),
        (F.col("n") / (1 + chi2)).alias("n_eff"),
        F.when(F.col("lo") > 0, F.col("hi") / F.col("lo")).otherwise(float("inf")).alias("contrast"),
    )


def total_variation(frame: DataFrame, keys: list[str], weight: Column | str) -> DataFrame:
    """Half the sum of |p - 1/n|: two aggregations and a join on the key, no window over unbounded groups."""
    x = col(weight).cast("double")
    rows = frame.select(*keys, x.alias("_x")).where("_x IS NOT NULL")
    means = rows.groupBy(*keys).agg(F.avg("_x").alias("_m"), F.sum("_x").alias("_s")).where("_s > 0")
    return rows.join(means, keys).groupBy(*keys).agg((F.sum(F.abs(F.col("_x") - F.col("_m"))) / (2 * F.first("_s"))).alias("tv"))


def alpha_sweep(frame: DataFrame, keys: list[str], weight: Column | str, alphas: list[float]) -> DataFrame:
    """Rényi entropy and divergence and Tsallis divergence (nats) for each alpha; math.inf is a limit of its own.

    Entropies come from power sums of the weights. Divergences come from another pass over the ratios of weights to
    their mean: D = ln(mean of r^alpha) / (alpha - 1), with the mean of r ln r at 1 and ln(max r) at infinity. The self-check `unified` says whether
    the two meet in D = ln n - H within 1e-9, and D is not negative.
    """
    x = col(weight).cast("double")
    finite = [a for a in alphas if a not in (1.0, math.inf)]
    sums = frame.where(x > 0).groupBy(*keys).agg(
        F.count(x).alias("n"),
        F.sum(x).alias("s"),
        F.max(x).alias("hi"),
        F.sum(x * F.log(x)).alias("xlnx"),
        *[F.sum(F.pow(x, F.lit(a))).alias(f"_p{i}") for i, a in enumerate(finite)],
    )
    means = frame.where(x > 0).select(*keys, x.alias("_x")).join(sums.select(*keys, "n", "s"), keys)
    r = F.col("_x") * F.col("n") / F.col("s")
    ratios = means.groupBy(*keys).agg(F.max(r).alias("_rmax"), F.avg(r * F.log(r)).alias("_r1"), *[F.avg(F.pow(r, F.lit(a))).alias(f"_r_{i}") for i, a in enumerate(finite)])
    sums = sums.join(ratios, keys)
    ln_n, h1 = F.log("n"), F.log("s") - F.col("xlnx") / F.col("s")
    rows = []
    for a in alphas:
        if a == 1.0:
            h, t, d = h1, ln_n - h1, F.col("_r1")
        elif a == math.inf:
            h = -F.log(F.col("hi") / F.col("s"))
            t, d = F.when(F.abs(ln_n - h) < 1e-12, 0.0).otherwise(float("inf")), F.log("_rmax")
        else:
            p = F.col(f"_p{finite.index(a)}") / F.pow("s", F.lit(a))
            h = F.log(p) / (1 - a)
            t = (F.pow(F.col("n").cast("double"), F.lit(a - 1)) * p - 1) / (a - 1)
            d = F.log(f"_r_{finite.index(a)}") / (a - 1)
        rows.append(F.struct(F.lit(float(a)).alias("alpha"), h.alias("h"), d.alias("d"), t.alias("t")))
    out = sums.select(*keys, "n", F.explode(F.array(*rows)).alias("_r")).select(*keys, "n", "_r.*")
    return out.withColumn("unified", (F.abs(F.log("n") - F.col("h") - F.col("d")) < 1e-9) & (F.col("d") > -1e-9))
