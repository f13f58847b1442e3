"""Markov chains of staged runs: transitions by windows and aggregation; linear algebra per chain in numpy.

A chain has as many states as the vocabulary of stages, so its matrix is small whatever the log's size;
a chain key's transitions are what one task holds.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

DONE, FAILED = "TERMINE", "ECHEC"


def transitions(runs: DataFrame, keys: list[str], stage: str, order: str, ok: str | None = None) -> DataFrame:
    """(src, dst, n, p): successive stages of runs; a run ends in DONE, or at its first failure in FAILED."""
    w = Window.partitionBy(*keys).orderBy(order)
    rows = runs.select(*keys, F.col(stage).alias("src"), order, (F.col(ok) if ok else F.lit(True)).alias("_ok"))
    fail = F.min(F.when(~F.col("_ok"), F.col(order))).over(Window.partitionBy(*keys))
    rows = rows.withColumn("_fail", fail).withColumn("_next", F.lead("src").over(w)).where(F.col("_fail").isNull() | (F.col(order) <= F.col("_fail")))
    dst = F.when(~F.col("_ok"), FAILED).otherwise(F.coalesce("_next", F.lit(DONE)))
    counts = rows.select("src", dst.alias("dst")).groupBy("src", "dst").agg(F.count("*").alias("n"))
    return counts.withColumn("p", F.col("n") / F.sum("n").over(Window.partitionBy("src")))


def mean_durations(runs: DataFrame, stage: str, duration: str, least: int = 5) -> DataFrame:
    """stage, mean duration, departures, and whether they are too few to trust."""
    out = runs.groupBy(F.col(stage).alias("stage")).agg(F.avg(duration).alias("mean_duration"), F.count("*").alias("departures"))
    return out.withColumn("unreliable", F.col("departures") < least)


def matrix(rows: list[tuple[str, str, float]], states: list[str]):
    """The row-stochastic matrix; states without transitions stay where they are."""
    import numpy as np

    at = {s: k for k, s in enumerate(states)}
    p = np.zeros((len(states), len(states)))
    for a, b, x in rows:
        p[at[a], at[b]] += x
    for k in range(len(states)):
        if p[k].sum() == 0:
            p[k, k] = 1.0
    return p / p.sum(axis=1, keepdims=True)


def stationary_of(p, tol: float = 1e-10, most: int = 10_000):
    """Power iteration from the uniform distribution."""
    import numpy as np

    x = np.full(len(p), 1 / len(p))
    for _ in range(most):
        y = x @ p
        if np.abs(y - x).sum() < tol:
            return y
        x = y
    return x


def solved(p, d, absorbing):
    """Expected time to absorption from each transient state; a singular system raises."""
    import numpy as np

    keep = [k for k in range(len(p)) if k not in absorbing]
    a = np.eye(len(keep)) - p[np.ix_(keep, keep)]
    if abs(np.linalg.det(a)) < 1e-14:
        raise ValueError("a state never reaches an absorbing one")
    out = np.zeros(len(p))
    out[keep] = np.linalg.solve(a, d[keep])
    return out


ANALYSIS = "state string, stationary double, time_share double, sojourn double, absorption double, bottleneck boolean"


def analysis(chain: DataFrame, key: str | None = None) -> DataFrame:
    """By chain of (src, dst, p, duration of src): stationary share, share of time, time spent before absorption from a uniform start, absorption time, bottleneck.

    Where the absorbing states hold all stationary mass, the bottleneck is the state with the most expected time; else that of the largest time share.
    """
    import pandas as pd

    def solve(pdf):
        import numpy as np

        states = sorted(set(pdf.src) | set(pdf.dst))
        p = matrix(list(pdf[["src", "dst", "p"]].itertuples(index=False, name=None)), states)
        d = np.array([pdf.loc[pdf.src == s, "duration"].mean() if (pdf.src == s).any() else 0.0 for s in states])
        d = np.nan_to_num(d)
        pi = stationary_of(p)
        share = pi * d / (pi * d).sum() if (pi * d).sum() > 0 else pi * 0
        absorbing = {k for k in range(len(states)) if p[k, k] == 1.0}
        sojourn, absorption = np.full(len(states), np.nan), np.full(len(states), np.nan)
        transient = [k for k in range(len(states)) if k not in absorbing]
        if absorbing and transient:
            absorption = solved(p, d, absorbing)
            start = np.full(len(transient), 1 / len(transient))
            visits = np.linalg.solve((np.eye(len(transient)) - p[np.ix_(transient, transient)]).T, start)
            sojourn = np.zeros(len(states))
            sojourn[transient] = visits * d[transient]
        regime = sojourn if absorbing and pi[transient].sum() < 1e-6 else share
        worst = int(np.nanargmax(regime))
        return pd.DataFrame({"state": states, "stationary": pi, "time_share": share, "sojourn": sojourn, "absorption": absorption, "bottleneck": [k == worst for k in range(len(states))]})

    if key is None:
        return chain.groupBy(F.lit(1).alias("_k")).applyInPandas(lambda pdf: solve(pdf), ANALYSIS)
    kind = chain.schema[key].dataType.simpleString()

    def keyed(k, pdf):
        out = solve(pdf)
        out.insert(0, key, k[0])
        return out

    return chain.groupBy(key).applyInPandas(keyed, f"{key} {kind}, {ANALYSIS}")


def what_if(chain: DataFrame, factors: list[float] = [2.0]) -> DataFrame:  # noqa: B006
    """(state, factor, before, after, gain): mean absorption time from a uniform start if a state ran `factor` times as fast."""
    import pandas as pd

    def solve(pdf):
        import numpy as np

        states = sorted(set(pdf.src) | set(pdf.dst))
        p = matrix(list(pdf[["src", "dst", "p"]].itertuples(index=False, name=None)), states)
        d = np.nan_to_num(np.array([pdf.loc[pdf.src == s, "duration"].mean() if (pdf.src == s).any() else 0.0 for s in states]))
        absorbing = {k for k in range(len(states)) if p[k, k] == 1.0}
        keep = [k for k in range(len(states)) if k not in absorbing]
        before = solved(p, d, absorbing)[keep].mean()
        rows = []
        for k in keep:
            for f in factors:
                faster = d.copy()
                faster[k] /= f
                after = solved(p, faster, absorbing)[keep].mean()
                rows.append((states[k], f, before, after, before - after))
        return pd.DataFrame(rows, columns=["state", "factor", "before", "after", "gain"]).sort_values(["gain", "state"], ascending=[False, True])

    return chain.groupBy(F.lit(1).alias("_k")).applyInPandas(lambda pdf: solve(pdf), "state string, factor double, before double, after double, gain double")
