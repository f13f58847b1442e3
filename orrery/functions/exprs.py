"""Column expressions: distances, ladders and capped terms. All run inside code generation."""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F

from orrery.functions.constants import AWAKENING, ETA, FIBONACCI, HARMONIOUS, PHI, PHI_INV, RESERVE, RISK_LEVELS, SCORE_FLOOR, STATUS, TAU


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def nearest_fibonacci(n: Column | str) -> Column:
    """The nearest Fibonacci number of the table; of two, the smaller; beyond the table its last."""
    n = col(n)
    table = sorted(set(FIBONACCI))
    ladder = F.lit(table[-1])
    for low, high in reversed(list(zip(table, table[1:], strict=False))):
        ladder = F.when(n - low <= high - n, F.lit(low)).otherwise(ladder)
    return ladder


def fibonacci_distance(n: Column | str) -> Column:
    return F.abs(col(n) - nearest_fibonacci(n)) / PHI


def clamp(x: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def antifragility(var_rel: Column | str) -> Column:
    return clamp(1 - F.abs(col(var_rel) - PHI_INV) / PHI)


def status(score: Column | str) -> Column:
    return F.when(col(score) >= HARMONIOUS, STATUS[0]).when(col(score) >= AWAKENING, STATUS[1]).otherwise(STATUS[2])


def reserve(alpha: Column | str) -> Column:
    return F.when(col(alpha) >= 0.85, RESERVE[0]).when(col(alpha) >= PHI_INV, RESERVE[1]).otherwise(RESERVE[2])


def risk_level(score: Column | str) -> Column:
    return F.when(col(score) < 25, RISK_LEVELS[0]).when(col(score) <= 50, RISK_LEVELS[1]).when(col(score) <= 75, RISK_LEVELS[2]).otherwise(RISK_LEVELS[3])


def sigmoid(x: Column | str, slope: float = 1.0) -> Column:
    return 1 / (1 + F.exp(-slope * col(x)))


def prior_term(x: Column | str) -> Column:
    return F.log1p(F.greatest(F.lit(0.0), col(x).cast("double")))


def zeta_score(n: Column | str) -> Column:
    """min(1, PHI * sum of (i+1)^-PHI for i < n, over n)."""
    n = col(n)
    total = F.aggregate(F.sequence(F.lit(1), n.cast("int")), F.lit(0.0), lambda a, i: a + F.pow(i.cast("double"), F.lit(-PHI)))
    return F.when(n > 0, F.least(F.lit(1.0), PHI * total / n)).otherwise(0.0)


def capped(x: Column, most: float) -> Column:
    return F.least(F.lit(most), x)


def classic_score(variance: Column, entropy: Column, anomalies: Column, fib_total: Column) -> Column:
    lost = capped(variance / (100 * PHI**2) * 25, 25.0) + capped(5 * F.greatest(F.lit(0.0), entropy - math.log2(PHI**4)), 20.0)
    lost += capped(3 * TAU * anomalies, 30.0) + capped(ETA * fib_total, 10.0)
    return F.greatest(F.lit(SCORE_FLOOR), 100 - lost)


def adiabatic_score(var_rel: Column, entropy_norm: Column, n: Column, anomalies: Column, fib_mean: Column) -> Column:
    spread = F.when(var_rel <= PHI_INV, 0.0).otherwise(capped((var_rel - PHI_INV) / PHI * 25, 25.0))
    flat = F.when(entropy_norm < 0.236, capped((0.236 - entropy_norm) * 40, 20.0)).when((entropy_norm > 0.98) & (n >= 5), capped((entropy_norm - 0.98) * 50, 5.0)).otherwise(0.0)
    lost = spread + flat + capped(3 * TAU * anomalies, 30.0) + capped(2 * fib_mean, 10.0)
    return F.greatest(F.lit(SCORE_FLOOR), 100 - lost)


def dedup_rate(hits: Column | str, table: Column | str) -> Column:
    return F.try_divide(col(hits), col(hits) + col(table))


def age_seconds(ts: Column | str, as_of: Column) -> Column:
    """Seconds from ts to as_of, at least 0, null for a null time; both of the same timestamp kind."""
    age = (F.unix_micros(as_of.cast("timestamp")) - F.unix_micros(col(ts).cast("timestamp"))) / 1e6
    return F.when(age.isNotNull(), F.greatest(F.lit(0.0), age))  # greatest would pass over a null


def bytes_text(n: Column | str) -> Column:
    """A whole number of bytes, long or decimal, as text; null for null. Ties are told by a quotient's exact value, as format_number does and format_string does not, and go to the even digit."""
    n = col(n)
    part = lambda unit, digits: F.translate(F.format_number(n / unit, digits), ",", "")
    return F.when(n < 1_000_000, F.concat(n.cast("string"), F.lit(" o"))).when(n < 1_000_000_000, F.concat(part(1e6, 1), F.lit(" Mo"))).otherwise(F.concat(part(1e9, 2), F.lit(" Go")))


def squeezed(x: Column | str) -> Column:
    return F.trim(F.regexp_replace(col(x), r"\s+", " "))


def module_name(path: Column | str) -> Column:
    """a/b/__init__.py gives a.b, a/c.py gives a.c."""
    return F.regexp_replace(F.regexp_replace(col(path), r"(/__init__)?\.py$", ""), "/", ".")


def rounded(x: Column | str, digits: int = 4) -> Column:
    """For presentation; never gives a negative zero."""
    return F.round(col(x), digits) + F.lit(0.0)
