"""Event streams: tumbling and session windows with watermarks, and exact bursts with state."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession, functions as F


def event_time(events: DataFrame, ts: str = "ts") -> DataFrame:
    """Timestamps without zone become timestamps: watermarks take no others."""
    return events.withColumn(ts, F.col(ts).cast("timestamp"))


def stream(spark: SparkSession, path: str, schema, files: int | None = None, kind: str = "parquet") -> DataFrame:
    reader = spark.readStream.schema(schema).format(kind)
    return (reader.option("maxFilesPerTrigger", files) if files else reader).load(path)


def tumbling(events: DataFrame, keys: list[str], ts: str = "ts", width: str = "1 hour", late: str = "2 hours", value: str | None = None) -> DataFrame:
    """Counts (and sums) by window and key. The same function serves batch and stream; on a stream, what is later than the watermark is dropped."""
    rows = event_time(events, ts)
    rows = rows.withWatermark(ts, late) if rows.isStreaming else rows
    sums = [F.sum(value).alias("total")] if value else []
    return rows.groupBy(F.window(ts, width).alias("w"), *keys).agg(F.count("*").alias("n"), *sums).select(F.col("w.start").alias("start"), *keys, "n", *[c for c in ("total",) if value])


def sessions(events: DataFrame, key: str, ts: str = "ts", gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    """Sessions of a key, ended by a gap: start, end and events. A key whose last session has ended is silent."""
    rows = event_time(events, ts)
    rows = rows.withWatermark(ts, late) if rows.isStreaming else rows
    return rows.groupBy(F.session_window(ts, gap).alias("w"), key).agg(F.count("*").alias("n")).select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def heartbeats(events: DataFrame, key: str, ts: str = "ts") -> DataFrame:
    """The last sign of life of each key; run in update mode."""
    return event_time(events, ts).groupBy(key).agg(F.max(ts).alias("last"))


def bursts(events: DataFrame, key: str, ts: str = "ts", hours: int = 24, touches: int = 3, late: str = "2 hours") -> DataFrame:
    """A row (key, at, touches) for each event that ends `touches` events of its key within `hours`, both ends included.

    A late event is put in its place among the times that are kept, and every end that it completes is told, each once. State is the times
    of the last `hours` before the watermark; events older than the watermark are dropped, and a key that stays silent for `hours` of event time is forgotten.
    """
    span = hours * 3_600_000_000
    kind = events.schema[key].dataType.simpleString()

    def step(k: tuple, batches: Iterator, state):
        import pandas as pd

        held = list(zip(*state.get, strict=True)) if state.exists else []
        mark, out = state.getCurrentWatermarkMs() * 1000, []
        if not state.hasTimedOut:
            held = sorted([*held, *((int(x), False) for pdf in batches for x in pdf["_us"] if x >= mark)])
        for i in range(touches - 1, len(held)):
            if not held[i][1] and held[i][0] - held[i - touches + 1][0] <= span:
                out.append((k[0], held[i][0], touches))
                held[i] = held[i][0], True
        held = [x for x in held if x[0] >= mark - span]
        if held:
            state.update(([x[0] for x in held], [x[1] for x in held]))
            state.setTimeoutTimestamp(max(held[-1][0] + span, mark) // 1000 + 1)
        elif state.exists:
            state.remove()
        yield pd.DataFrame(out, columns=[key, "_at", "touches"])

    rows = event_time(events, ts).withWatermark(ts, late).select(key, ts, F.unix_micros(ts).alias("_us"))
    found = rows.groupBy(key).applyInPandasWithState(step, f"{key} {kind}, _at long, touches int", "at array<long>, told array<boolean>", "append", "EventTimeTimeout")
    return found.select(key, F.timestamp_micros("_at").alias("at"), "touches")


def latest_status(events: DataFrame, key: str, value: str, ts: str = "ts", tie: str | None = None) -> DataFrame:
    """The value of each key's last event, ties by `tie`; run in update mode."""
    return event_time(events, ts).groupBy(key).agg(F.max_by(value, F.struct(*([ts, tie] if tie else [ts]))).alias(value), F.max(ts).alias("last"))


def silences(events: DataFrame, key: str, ts: str = "ts", seconds: int = 1800, late: str = "2 hours") -> DataFrame:
    """(key, last, silent_from) for every silence of a key that is longer than `seconds`, told by a timer of event time as soon as the watermark shows it, without another event."""
    span = seconds * 1_000_000
    kind = events.schema[key].dataType.simpleString()

    def step(k: tuple, batches: Iterator, state):
        import pandas as pd

        waiting = list(state.get[0]) if state.exists else []
        mark, out = state.getCurrentWatermarkMs() * 1000, []
        if not state.hasTimedOut:
            waiting = sorted([*waiting, *(int(x) for pdf in batches for x in pdf["_us"] if x >= mark)])
        while waiting and waiting[0] + span < mark:
            last = waiting.pop(0)
            if not waiting or waiting[0] - last > span:
                out.append((k[0], last, last + span))
        if waiting:
            state.update((waiting,))
            state.setTimeoutTimestamp(max(waiting[0] + span, mark) // 1000 + 1)
        elif state.exists:
            state.remove()
        yield pd.DataFrame(out, columns=[key, "_last", "_from"])

    rows = event_time(events, ts).withWatermark(ts, late).select(key, ts, F.unix_micros(ts).alias("_us"))
    found = rows.groupBy(key).applyInPandasWithState(step, f"{key} {kind}, _last long, _from long", "waiting array<long>", "append", "EventTimeTimeout")
    return found.select(key, F.timestamp_micros("_last").alias("last"), F.timestamp_micros("_from").alias("silent_from"))


def drained(result: DataFrame, folder: str, keys: list[str] | None = None, mode: str = "append") -> DataFrame:
    """Run a stream over what is there into Parquet files of a folder, and read them back; nothing comes to the driver.

    In mode append the files are the result. In update, each micro-batch writes the rows that it changed, and the last of each key
    counts; in complete it writes the whole result, and the last batch counts. A batch that runs again writes the same folder anew.
    """
    spark = result.sparkSession
    target = f"{folder}/rows"
    if mode == "append":
        query = result.writeStream.format("parquet").outputMode(mode).option("path", target).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
        query.awaitTermination()
        return spark.read.schema(result.schema).parquet(target)
    query = result.writeStream.foreachBatch(lambda frame, batch: frame.write.mode("overwrite").parquet(f"{target}/batch={batch}")).outputMode(mode).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    rows = spark.read.option("basePath", target).parquet(target)
    if mode == "complete":
        return rows.where(F.col("batch") == rows.agg(F.max("batch")).first()[0]).select(*result.columns)
    others = [c for c in result.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*others), "batch").alias("_v")).select(*[F.col(c) if c in keys else F.col(f"_v.{c}") for c in result.columns])
