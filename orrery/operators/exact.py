"""Certified sums: double-double arithmetic with an error bound, mergeable between partitions."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

U = 2.0**-53


def two_sum(a: float, b: float) -> tuple[float, float]:
    s = a + b
    t = s - a
    return s, (a - (s - t)) + (b - t)


def two_prod(a: float, b: float) -> tuple[float, float]:
    from fractions import Fraction

    p = a * b
    return p, float(Fraction(a) * Fraction(b) - Fraction(p))


def dd_add(x: tuple[float, float], y: tuple[float, float]) -> tuple[float, float]:
    s, e = two_sum(x[0], y[0])
    t, f = two_sum(x[1], y[1])
    s, e = two_sum(s, e + t)
    return two_sum(s, e + f)


def dd_sum(values) -> tuple[float, float]:
    """Pairwise, whole arrays at a time: halves are added element by element until one pair is left."""
    import numpy as np

    hi = np.asarray(values, np.float64)
    lo = np.zeros(len(hi))
    if not len(hi):
        return 0.0, 0.0
    while len(hi) > 1:
        odd = len(hi) % 2
        a, b = slice(0, len(hi) - odd, 2), slice(1, None, 2)
        s, e = two_sum(hi[a], hi[b])
        t, f = two_sum(lo[a], lo[b])
        s, e = two_sum(s, e + t)
        s, e = two_sum(s, e + f)
        hi, lo = (np.concatenate([s, hi[-1:]]), np.concatenate([e, lo[-1:]])) if odd else (s, e)
    return float(hi[0]), float(lo[0])


def certified_sum(frame: DataFrame, keys: list[str], value: str) -> DataFrame:
    """By group: hi, lo, n and a bound 16 n u^2 M of the sum's error, M the sum of magnitudes.

    Each partition sums its rows of a group in double-double first, so what meets by key is a row per
    group and partition, whatever the group's size; order does not change hi beyond the bound.
    """
    import pandas as pd

    kinds = ", ".join(f"{k} {frame.schema[k].dataType.simpleString()}" for k in keys)
    schema = f"{kinds}, hi double, lo double, n long, mag double"

    def partial(batches):
        sums: dict[tuple, list] = {}
        for pdf in batches:
            for key, part in pdf.groupby(keys, dropna=False, sort=False)["_v"]:
                held = sums.setdefault(key, [(0.0, 0.0), 0, 0.0])
                values = part.dropna()
                held[0] = dd_add(held[0], dd_sum(values))
                held[1] += len(values)
                held[2] += float(values.abs().sum())
        if sums:
            yield pd.DataFrame([(*k, *s, n, m) for k, (s, n, m) in sums.items()], columns=[*keys, "hi", "lo", "n", "mag"])

    def final(pdf):
        out = (0.0, 0.0)
        for hi, lo in sorted(zip(pdf.hi, pdf.lo, strict=True)):
            out = dd_add(out, (hi, lo))
        return pd.DataFrame([(*(pdf[k].iloc[0] for k in keys), *out, int(pdf.n.sum()), float(pdf.mag.sum()))], columns=[*keys, "hi", "lo", "n", "mag"])

    rows = frame.select(*keys, F.col(value).cast("double").alias("_v")).mapInPandas(partial, schema)
    out = rows.groupBy(*keys).applyInPandas(final, schema)
    return out.withColumn("bound", 16 * F.col("n") * (U * U) * F.col("mag")).drop("mag")
