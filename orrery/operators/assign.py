"""Assignment arithmetic: aging priorities, Sturmian slots, burst tests and density order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from orrery.functions.constants import PHI
from orrery.functions.exprs import col


def aged_priority(priority: Column | str, waited: Column | str, alpha: float = 0.5) -> Column:
    return col(priority) + alpha * col(waited)


def starvation_bound(gap: float, tick: float, worst: float, alpha: float = 0.5) -> float:
    return gap / alpha + tick + 3 * worst


def sturmian_slot(seq: Column | str, workers: int, rho: float = 0.0) -> Column:
    """floor(W frac(seq / PHI + rho))."""
    x = col(seq) / PHI + rho
    return F.floor(workers * (x - F.floor(x))).cast("int")


def fine_burst(frame: DataFrame, keys: list[str], duration: str) -> DataFrame:
    """Whether a group's durations are at most 10 s and their coefficient of variation at most 1."""
    cv = F.try_divide(F.stddev_pop(duration), F.avg(duration))
    return frame.groupBy(*keys).agg(F.max(duration).alias("longest"), cv.alias("cv")).withColumn("fine", (F.col("longest") <= 10) & (F.coalesce(F.col("cv"), F.lit(0.0)) <= 1))


def density_order(frame: DataFrame, keys: list[str], duration: str, tie: str, bins: int = 64, width: float = 2.0) -> DataFrame:
    """Items of a group by the density of their duration, densest first; the density is a Gaussian blur of a histogram by FFT.

    The histogram has `bins` counters for a group, computed by aggregation; only counters reach Python.
    """
    import pandas as pd

    lo, hi = F.min(duration).over(Window.partitionBy(*keys)), F.max(duration).over(Window.partitionBy(*keys))
    place = F.least(F.lit(bins - 1), F.floor(bins * F.coalesce(F.try_divide(F.col(duration) - lo, hi - lo), F.lit(0.0)))).cast("int")
    placed = frame.withColumn("_bin", place)
    counts = placed.groupBy(*keys, "_bin").agg(F.count("*").alias("_c"))
    kinds = ", ".join(f"{k} {frame.schema[k].dataType.simpleString()}" for k in keys)

    def blur(pdf):
        import numpy as np

        h = np.zeros(bins)
        h[pdf["_bin"]] = pdf["_c"]
        kernel = np.exp(-0.5 * (np.fft.fftfreq(bins) * 2 * np.pi * width) ** 2)
        d = np.fft.ifft(np.fft.fft(h) * kernel).real
        out = pdf[[*keys, "_bin"]].copy()
        out["density"] = d[pdf["_bin"]]
        return out

    return placed.join(counts.groupBy(*keys).applyInPandas(blur, f"{kinds}, _bin int, density double"), [*keys, "_bin"]).withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy(F.round("density", 9).desc(), tie))).drop("_bin")
