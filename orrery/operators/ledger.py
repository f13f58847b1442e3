"""Entropy ledgers: what ordered kills take from the entropy of a set of masses.

A node dies at its first kill. With M_t and X_t the sums of w and of w log2 w over nodes that live
after step t, H_t = log2 M_t - X_t / M_t, so a suffix sum over steps replaces the sequential fold:
the window holds one row per step, not per node.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from orrery.functions.constants import PHI_INV
from orrery.operators import perf


def entropy_of(total: Column, xlogx: Column) -> Column:
    return F.when(total > 1e-15, F.greatest(F.lit(0.0), F.log2(total) - xlogx / total)).otherwise(0.0)


def ledger(masses: DataFrame, kills: DataFrame, node: str, weight: str, step: str) -> DataFrame:
    """(step, killed, entropy, gain): after each kill, and step null for the start. Kills of unknown or dead nodes change nothing and stay listed."""
    death = kills.groupBy(node).agg(F.min(step).alias("_t"))
    w = F.col(weight).cast("double")
    by = masses.where(w > 0).join(death, node, "left").groupBy("_t").agg(F.sum(w).alias("m"), F.sum(w * F.log2(w)).alias("x"), F.count("*").alias("killed"))
    steps = kills.select(F.col(step).alias("_t")).distinct()
    rows = by.join(steps.withColumn("_s", F.lit(1)), "_t", "full_outer").fillna(0, ["m", "x", "killed"])
    last = F.coalesce(F.col("_t").cast("double"), F.lit(float("inf")))
    later = Window.orderBy(last).rowsBetween(1, Window.unboundedFollowing)
    alive = rows.select("_t", F.when(F.col("_t").isNotNull(), F.col("killed")).otherwise(0).alias("killed"), entropy_of(F.coalesce(F.sum("m").over(later), F.lit(0.0)), F.coalesce(F.sum("x").over(later), F.lit(0.0))).alias("entropy")).where("_t IS NOT NULL")
    start = masses.where(w > 0).agg(F.sum(w).alias("m"), F.sum(w * F.log2(w)).alias("x")).select(F.lit(None).cast("long").alias("_t"), F.lit(0).cast("long").alias("killed"), entropy_of(F.col("m"), F.col("x")).alias("entropy"))
    out = start.unionByName(alive.withColumn("_t", F.col("_t").cast("long")))
    before = F.lag("entropy").over(Window.orderBy(F.col("_t").asc_nulls_first()))
    return out.select(F.col("_t").alias("step"), "killed", "entropy", F.coalesce(before - F.col("entropy"), F.lit(0.0)).alias("gain"))


def collapse_cost(masses: DataFrame, zone: str, weight: str, positive: list[str]) -> DataFrame:
    """Entropy over zones, over the two sides `positive` makes, their difference, and its ratio to 1 - H(PHI_INV): one row."""
    import math

    h = -(PHI_INV * math.log2(PHI_INV) + (1 - PHI_INV) * math.log2(1 - PHI_INV))
    z = masses.groupBy(F.col(zone).alias("z")).agg(F.sum(weight).cast("double").alias("m")).where("m > 0").withColumn("side", F.col("z").isin(positive))
    s = z.groupBy("side").agg(F.sum("m").alias("m"), F.sum(F.col("m") * F.log2("m")).alias("x"))
    out = s.agg(F.sum("m").alias("t"), F.sum("x").alias("x"), F.sum(F.col("m") * F.log2("m")).alias("y"))
    fine, coarse = F.log2("t") - F.col("x") / F.col("t"), F.log2("t") - F.col("y") / F.col("t")
    return out.select(fine.alias("h_zones"), coarse.alias("h_sides"), (fine - coarse).alias("cost"), ((fine - coarse) / (1 - h)).alias("ratio"))


def golden_prior(nodes: DataFrame, open_: Column, node: str) -> DataFrame:
    """PHI_INV over the open nodes and PHI_INV^2 over the closed ones; an empty class gives its mass to the other."""
    counts = nodes.agg(F.sum(F.when(open_, 1).otherwise(0)).alias("_o"), F.sum(F.when(open_, 0).otherwise(1)).alias("_c"))  # one row
    a, b = F.when(F.col("_c") == 0, 1.0).otherwise(PHI_INV), F.when(F.col("_o") == 0, 1.0).otherwise(PHI_INV**2)
    return nodes.withColumn("_open", open_).crossJoin(F.broadcast(counts)).select(node, F.col("_open").alias("open"), F.when(F.col("_open"), a / F.col("_o")).otherwise(b / F.col("_c")).alias("prior"))


def imputed(nodes: DataFrame, known: DataFrame, node: str, value: str) -> DataFrame:
    """Nodes with their value, the median of the matched where there is none, or 1 where nothing matched."""
    joined = nodes.join(known.select(node, value), node, "left")
    middle = perf.median(joined, value)
    return joined.withColumn("imputed", F.col(value).isNull()).withColumn(value, F.coalesce(value, F.lit(1.0 if middle is None else middle)))


def branching(counts: DataFrame, order: str, n: str) -> DataFrame:
    """log2 of each count over the one before; a count that is not positive raises."""
    before = F.lag(n).over(Window.orderBy(order))
    bad = (F.col(n) <= 0) | (F.col("_b") <= 0)
    return counts.withColumn("_b", before).withColumn("rate", F.when(bad, F.raise_error(F.lit("a count is not positive")).cast("double")).otherwise(F.log2(F.col(n) / F.col("_b")))).drop("_b")
