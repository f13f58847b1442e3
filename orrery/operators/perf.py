"""Concentration of cost: medians over runs, nearest-rank percentiles, Pareto shares, quadrants and tests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def order_statistics(frame: DataFrame, value: str, ranks: list[int], most: int = 50_000) -> list:
    """The exact values of given ranks (from 1) of a whole column, nulls aside, without one task that holds all values.

    Sketched percentiles bracket a rank; the rows below are counted, the bracket is kept and narrowed again, until it has at most `most`
    distinct values, whose counts the driver takes. A bracket that does not get narrower is cut at its middle value.
    """
    v = frame.select(F.col(value).alias("_v")).where("_v IS NOT NULL")
    out = []
    for rank in ranks:
        rows, before = v, 0
        while True:
            got = rows.groupBy("_v").count().orderBy("_v").limit(most + 1).collect()
            if len(got) <= most:
                break
            n = rows.count()
            at, wide = (rank - before - 0.5) / n, 2e-4
            lo, middle, hi = rows.agg(F.percentile_approx("_v", [max(0.0, at - wide), at, min(1.0, at + wide)], 20_000)).first()[0]
            below, within = rows.agg(F.count_if(F.col("_v") < lo), F.count_if(F.col("_v").between(lo, hi))).first()
            if not before + below < rank <= before + below + within:
                lo, hi = None, None
            narrowed = rows.where(F.col("_v").between(lo, hi)) if lo is not None else None
            if narrowed is None or within == n:
                below = rows.where(F.col("_v") < middle).count()
                narrowed = rows.where(F.col("_v") >= middle) if rank > before + below else rows.where(F.col("_v") < middle)
                before += below if rank > before + below else 0
            else:
                before += below
            rows = narrowed
        for r in got:
            before += r["count"]
            if before >= rank:
                break
        out.append(r["_v"] if got else None)
    return out


def percentile(frame: DataFrame, value: str, share: float):
    """The nearest-rank percentile of a whole column: its ceil(share n)-th value."""
    import math

    n = frame.select(F.count(value)).first()[0]
    return order_statistics(frame, value, [max(1, math.ceil(share * n - 1e-9))])[0] if n else None


def median(frame: DataFrame, value: str) -> float | None:
    n = frame.select(F.count(value)).first()[0]
    return sum(map(float, order_statistics(frame, value, sorted({(n + 1) // 2, n // 2 + 1})))) / (1 if n % 2 else 2) if n else None


def median_runs(frame: DataFrame, keys: list[str], value: str) -> DataFrame:
    return frame.groupBy(*keys).agg(F.median(value).alias("median"), F.count(value).alias("runs"))


def quadrants(frame: DataFrame, size: str, time: str, share: float = 0.8) -> DataFrame:
    """big: size at its P80 or more; hot: time at its P80 or more and above 0. The percentiles are two numbers."""
    big = F.col(size) >= F.lit(percentile(frame, size, share))
    hot = (F.col(time) >= F.lit(percentile(frame, time, share))) & (F.col(time) > 0)
    name = F.when(big & hot, "GOULOT").when(big, "GROSSE_FROIDE").when(hot, "PETITE_CHAUDE").otherwise("NEUTRE")
    return frame.select("*", big.alias("big"), hot.alias("hot"), name.alias("quadrant"))


def pareto(frame: DataFrame, keys: list[str], value: str, tie: str, share: float = 0.2, most: float = 0.6) -> DataFrame:
    """The share of the top ceil(share n) items and of the first, and whether the former is `most` or more."""
    order = Window.partitionBy(*keys).orderBy(F.col(value).desc(), tie)
    ranked = frame.select(*keys, F.col(value).alias("_v"), F.row_number().over(order).alias("_r"), F.count("*").over(Window.partitionBy(*keys)).alias("_n"))
    top = F.sum(F.when(F.col("_r") <= F.ceil(share * F.col("_n")), F.col("_v")).otherwise(0.0)) / F.sum("_v")
    out = ranked.groupBy(*keys).agg(top.alias("top_share"), (F.sum(F.when(F.col("_r") == 1, F.col("_v")).otherwise(0.0)) / F.sum("_v")).alias("first_share"))
    return out.withColumn("pareto", F.col("top_share") >= most)


def pearson(frame: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """Null for fewer than three rows or a constant side."""
    guard = (F.count(x) >= 3) & (F.stddev_pop(x) > 0) & (F.stddev_pop(y) > 0)
    return frame.groupBy(*keys).agg(F.when(guard, F.corr(x, y)).alias("pearson"), F.count(x).alias("n"))


def welch(frame: DataFrame, side: Column, value: str) -> DataFrame:
    """t and Satterthwaite's degrees of freedom between rows where `side` is true and those where it is false: one row."""
    v = F.col(value).cast("double")
    a, b = F.when(side, v), F.when(~side, v)
    s = frame.agg(F.avg(a).alias("ma"), F.avg(b).alias("mb"), (F.var_samp(a) / F.count(a)).alias("va"), (F.var_samp(b) / F.count(b)).alias("vb"), F.count(a).alias("na"), F.count(b).alias("nb"))
    df = F.pow(F.col("va") + F.col("vb"), F.lit(2.0)) / (F.pow("va", F.lit(2.0)) / (F.col("na") - 1) + F.pow("vb", F.lit(2.0)) / (F.col("nb") - 1))
    return s.select(((F.col("ma") - F.col("mb")) / F.sqrt(F.col("va") + F.col("vb"))).alias("t"), df.alias("df"), "na", "nb")


def t_p_value(t: float, df: float) -> float:
    """Two-sided p of Student's t, by the continued fraction of the incomplete beta function (Lentz)."""
    import math

    x, a, b = df / (df + t * t), df / 2, 0.5
    if x <= 0 or x >= 1:
        return float(x >= 1)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    swap = x > (a + 1) / (a + b + 2)
    if swap:
        a, b, x = b, a, 1 - x
    tiny, c, d = 1e-300, 1.0, 0.0
    f = 1.0
    for i in range(400):
        m = i // 2
        if i == 0:
            num = 1.0
        elif i % 2 == 0:
            num = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        else:
            num = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        d = 1 / (1 + num * d or tiny)
        c = 1 + num / c or tiny
        f *= c * d
        if abs(1 - c * d) < 1e-15:
            break
    value = front * (f - 1) / a
    return 1 - value if swap else value


def welch_p(frame: DataFrame) -> DataFrame:
    """The p-value for rows of t and df, in Arrow batches."""

    def run(batches):
        for pdf in batches:
            yield pdf.assign(p_value=[t_p_value(a, b) if a == a and b == b else None for a, b in zip(pdf.t, pdf.df, strict=True)])

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in frame.schema.fields)
    return frame.mapInPandas(run, f"{fields}, p_value double")


def hotspots(frame: DataFrame, keys: list[str], value: str, least: float = 0.5) -> DataFrame:
    part = F.try_divide(F.col(value), F.sum(value).over(Window.partitionBy(*keys)))
    return frame.withColumn("share", part).where(F.col("share") >= least)
