"""Event logs: bursts, spans, runs, last entries, silence, quarantine and change seismology."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from orrery.functions.constants import EVENT_TYPES, MECHANISMS
from orrery.functions.exprs import age_seconds


def micros(ts: Column | str) -> Column:
    return F.unix_micros(F.col(ts).cast("timestamp") if isinstance(ts, str) else ts.cast("timestamp"))


def aftershock(events: DataFrame, key: str, ts: str, hours: int = 24, touches: int = 3) -> DataFrame:
    """By key: touches, the most in any closed window of `hours`, and whether that is `touches` or more."""
    w = Window.partitionBy(key).orderBy("_us").rangeBetween(0, hours * 3_600_000_000)
    counted = events.select(key, micros(ts).alias("_us")).withColumn("_n", F.count("*").over(w))
    return counted.groupBy(key).agg(F.count("*").alias("touches"), F.max("_n").alias("most_in_window")).withColumn("aftershock", F.col("most_in_window") >= touches)


def mechanism(added: Column, removed: Column, churn: float = 0.2) -> Column:
    build, fall, stir, adjust, stable = MECHANISMS
    both = F.least(added, removed) / F.greatest(added, removed)
    return F.when((added > 0) & (removed == 0), build).when((removed > 0) & (added == 0), fall).when((added > 0) & (removed > 0), F.when(both > churn, stir).otherwise(adjust)).otherwise(stable)


def seismic(changes: DataFrame, key: str, added: str, removed: str, radius: DataFrame | None = None) -> DataFrame:
    """By key: touches, added, removed, mechanism and magnitude (added + removed)(1 + radius)."""
    out = changes.groupBy(key).agg(F.count("*").alias("touches"), F.sum(added).alias("added"), F.sum(removed).alias("removed"))
    if radius is None:
        out = out.withColumn("radius", F.lit(0))
    else:
        out = out.join(radius.select(key, "radius"), key, "left").fillna(0, ["radius"])
    return out.withColumn("mechanism", mechanism(F.col("added"), F.col("removed"))).withColumn("magnitude", (F.col("added") + F.col("removed")) * (1 + F.col("radius")))


def epicentre(report: DataFrame, key: str) -> DataFrame:
    """The row of most touches, then of largest magnitude, then of the first name."""
    return report.orderBy(F.desc("touches"), F.desc("magnitude"), key).limit(1)


def spans(events: DataFrame, keys: list[str], ts: str, tie: str) -> DataFrame:
    """Each event with the next one's time and the seconds to it; the last of a key has none."""
    after = F.lead(ts).over(Window.partitionBy(*keys).orderBy(ts, tie))
    return events.withColumn("next_ts", after).withColumn("span_s", (micros(F.col("next_ts")) - micros(ts)) / 1e6)


def runs(events: DataFrame, key: str, order: list[str], stage: str, positions: list[str]) -> DataFrame:
    """Events of known stages with their run: a new one starts where the stage's position does not grow."""
    position = F.array_position(F.array(*map(F.lit, positions)), F.col(stage))
    rows = events.withColumn("pos", position).where("pos > 0")
    w = Window.partitionBy(key).orderBy(*order)
    new = F.when(F.lag("pos").over(w).isNull() | (F.col("pos") <= F.lag("pos").over(w)), 1).otherwise(0)
    return rows.withColumn("_new", new).withColumn("run", F.sum("_new").over(w)).drop("_new")


def last_n(events: DataFrame, keys: list[str], order: list[str], n: int) -> DataFrame:
    """The last n rows of each key (a top-k report)."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*[F.desc(c) for c in order]))
    return events.withColumn("back", rank).where(F.col("back") <= n)


def unanswered(events: DataFrame, key: str, kind: str, call: str, answer: str) -> DataFrame:
    calls, answers = (F.sum(F.when(F.col(kind) == k, 1).otherwise(0)) for k in (call, answer))
    return events.groupBy(key).agg(calls.alias("calls"), answers.alias("answers")).withColumn("unanswered", F.greatest(F.lit(0), F.col("calls") - F.col("answers")))


def latest(events: DataFrame, key: str, ts: str, tie: str, value: str) -> DataFrame:
    """The last value of each key and its time: a partial aggregate."""
    return events.groupBy(key).agg(F.max_by(value, F.struct(ts, tie)).alias(value), F.max(ts).alias(ts))


def silent(state: DataFrame, ts: str, as_of: Column, after_s: int = 1800, closed: Column | None = None) -> DataFrame:
    """With age_s and orphan: no sign of life for more than `after_s` seconds (or ever), unless closed."""
    age = age_seconds(ts, as_of)
    orphan = F.coalesce(age > after_s, F.lit(True))
    return state.withColumn("age_s", age).withColumn("orphan", orphan if closed is None else orphan & ~closed)


def quarantine(events: DataFrame, kind: str, vocabulary: list[str] = EVENT_TYPES) -> DataFrame:
    """Events outside the vocabulary, null included."""
    return events.where(~F.coalesce(F.col(kind).isin(vocabulary), F.lit(False)))


def append_log(events: DataFrame, path: str, message: str = "msg", tags: str = "tags", kind: str = "type", vocabulary: list[str] | None = None) -> None:
    """Append as JSON lines; messages are cut to 500 characters and tags to 12. A type outside the vocabulary raises."""
    out = events.withColumn(message, F.substring(message, 1, 500)).withColumn(tags, F.slice(tags, 1, 12))
    if vocabulary is not None:
        out = out.withColumn(kind, F.when(F.col(kind).isin(vocabulary), F.col(kind)).otherwise(F.raise_error(F.lit("type outside the vocabulary"))))
    out.write.mode("append").json(path)
