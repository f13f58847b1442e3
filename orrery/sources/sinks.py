"""Reports and snapshots as files: JSON, Markdown, SARIF, versioned snapshots, rotated logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F


def sarif(notes: DataFrame) -> DataFrame:
    """One SARIF 2.1.0 document per path, as text, from (path, line, level, rule, message). A document holds its file's notes."""
    level = F.when(F.col("level") == "CRITICAL", "error").when(F.col("level") == "WARNING", "warning").otherwise("note")
    place = F.array(F.struct(F.struct(F.struct(F.col("path").alias("uri")).alias("artifactLocation"), F.struct(F.col("line").alias("startLine")).alias("region")).alias("physicalLocation")))
    result = F.struct(F.col("rule").alias("ruleId"), level.alias("level"), F.struct(F.col("message").alias("text")).alias("message"), place.alias("locations"))
    rules = F.transform(F.array_sort(F.collect_set("rule")), lambda r: F.struct(r.alias("id")))
    by = notes.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("line", "rule", result.alias("r")))).alias("_r"), rules.alias("_rules"))
    run = F.struct(F.struct(F.struct(F.lit("orrery").alias("name"), F.col("_rules").alias("rules")).alias("driver")).alias("tool"), F.transform("_r", lambda x: x["r"]).alias("results"))
    return by.select("path", F.to_json(F.struct(F.lit("2.1.0").alias("version"), F.array(run).alias("runs"))).alias("sarif"))


def with_largest(notes: DataFrame, audited: DataFrame, above: float = 3.0) -> DataFrame:
    """The notes, and one on the largest item of each file whose ratio of largest to mean is above a bound."""
    largest = audited.where(F.col("phi_ratio") > above).select("path", F.col("largest_item.line").alias("line"), F.lit("WARNING").alias("level"), F.lit("OUDJAT").alias("rule"), F.concat(F.col("largest_item.item"), F.lit(" holds "), F.round("phi_ratio", 2).cast("string"), F.lit(" times the mean")).alias("message"))
    return notes.select("path", "line", "level", "rule", "message").unionByName(largest)


def markdown(frame: DataFrame, most: int = 50) -> str:
    """A small result (its first rows, with a line that tells how many more there are) as a Markdown table."""
    rows = frame.limit(most + 1).collect()
    lines = ["| " + " | ".join(frame.columns) + " |", "|" + "---|" * len(frame.columns)]
    lines += ["| " + " | ".join("" if v is None else str(v).replace("|", "\\|").replace("\n", " ") for v in r) + " |" for r in rows[:most]]
    return "\n".join(lines + (["", "There are more rows."] if len(rows) > most else []))


def as_json(frame: DataFrame) -> DataFrame:
    return frame.select(F.to_json(F.struct("*")).alias("json"))


def fingerprint(frame: DataFrame, keys: list[str]) -> str:
    """An order-free md5 of a table: of the sums of its rows' hashes, so that no task sees all rows."""
    row = F.xxhash64(F.to_json(F.struct(*sorted(frame.columns))))
    got = frame.agg(F.count("*").alias("n"), F.sum(F.pmod(row, F.lit(1 << 31)).cast("decimal(38,0)")).alias("a"), F.bit_xor(row).alias("b")).select(F.md5(F.concat_ws(":", "n", "a", "b")).alias("m"))
    return got.first()["m"]


def write_snapshot(symbols: DataFrame, edges: DataFrame, path: str, version: str) -> str:
    """symbols, edges and a meta row with the fingerprint of both; returns the fingerprint."""
    symbols.write.parquet(f"{path}/symbols")
    edges.write.parquet(f"{path}/edges")
    mark = f"{fingerprint(symbols, [])}-{fingerprint(edges, [])}"
    symbols.sparkSession.createDataFrame([(version, mark)], "version string, mark string").write.parquet(f"{path}/meta")
    return mark


def read_snapshot(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, dict]:
    """The snapshot's tables and meta row; one whose tables no longer have the recorded fingerprint raises."""
    symbols, edges = spark.read.parquet(f"{path}/symbols"), spark.read.parquet(f"{path}/edges")
    meta = spark.read.parquet(f"{path}/meta").first().asDict()
    if meta["mark"] != f"{fingerprint(symbols, [])}-{fingerprint(edges, [])}":
        raise ValueError("the snapshot's tables differ from its fingerprint")
    return symbols, edges, meta


def rotated(log: DataFrame, keys: list[str], order: str, keep: int) -> tuple[DataFrame, DataFrame]:
    """The last `keep` entries of each key, and the rest, which goes to the archive."""
    ranked = log.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(order))))
    return ranked.where(F.col("_r") <= keep).drop("_r"), ranked.where(F.col("_r") > keep).drop("_r")


def console(frame: DataFrame, title: str, most: int = 20) -> str:
    """A small result as aligned text under a title, its first rows, with the true count where there are more."""
    rows = [["" if v is None else str(v) for v in r] for r in frame.limit(most).collect()]
    n = frame.count()
    wide = [max(map(len, column)) for column in zip(frame.columns, *rows, strict=True)]
    lines = ["  ".join(v.ljust(w) for v, w in zip(r, wide, strict=True)).rstrip() for r in [frame.columns, ["-" * w for w in wide], *rows]]
    return "\n".join([title, *lines, *([f"... {n - most} more of {n}"] if n > most else [])])


def write_json_atomic(spark: SparkSession, path: str, text: str) -> None:
    """One small text at a path of any Hadoop file system, all or nothing: it is written beside and renamed over the old one."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    beside = jvm.org.apache.hadoop.fs.Path(f"{path}.new")
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), spark.sparkContext._jsc.hadoopConfiguration())
    system = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    stream = system.create(beside, True)
    stream.write(bytearray(text.encode()))
    stream.close()
    options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    context.rename(beside, target, options)
