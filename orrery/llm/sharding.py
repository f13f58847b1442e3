"""A uniform shuffle into shards of exact sizes, by a hypergeometric communication matrix.

Law `rows`: shard sizes differ by one at most. A shard is cut into blocks of exact sizes, about
`block_rows` each, so that no task holds a shard. How many rows of each input partition go to each
block is a draw from the multivariate hypergeometric law with the partitions' exact counts and the
blocks' exact sizes. Partitions permute their rows locally, deal them out by their row of the
matrix, and each block permutes what it has received: every permutation of all rows is equally likely.

The matrix is never held as a whole. Partitions, cut into pieces of at most `group_rows` rows, form groups of
at most as many. A stage of its own draws each group's row of the matrix: a task descends a binary
tree over the groups, and at a node it draws how the node's block counts divide between the two halves, down a
second tree, over shards and blocks, by a generator seeded from the node, so that all tasks agree.
Rows go to files of the shared folder. Within a group, its blocks' labels are permuted, and a piece takes its run of them. The
driver holds a number for each input partition and a file name for each group; tasks get the former by
broadcast, and one group's row.

The input must be read the same way twice (a table is; give others `materialize=True`, which writes
them to the shared folder first). A task whose partition has another number of rows than counted fails.
Null and repeated rows and ids are rows like any other. Input columns named shard or slot are replaced; all
others may have any names.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F, types as T

from orrery.llm import shared
from orrery.llm.shared import table, written

SHARDS = 8
BLOCK_ROWS = 20_000
#: Rows whose blocks a task permutes at once.
GROUP_ROWS = 4_000_000
SEED = 20240611
#: numpy's generator takes populations below this.
_NUMPY_MOST = 1_000_000_000


def hypergeometric(rng: np.random.Generator, good: int, bad: int, n: int) -> int:
    """How many of n rows drawn without replacement are good."""
    if min(good, n) == 0:
        return 0
    if bad == 0 or n == good + bad:
        return n if bad == 0 else good
    if good + bad < _NUMPY_MOST:
        return int(rng.hypergeometric(good, bad, n))
    lo, hi, total = max(0, n - bad), min(n, good), good + bad
    mean = n * good / total
    sd = np.sqrt(max(1.0, mean * (bad / total) * ((total - n) / max(1, total - 1))))
    a, b = max(lo, int(mean - 9 * sd)), min(hi, int(mean + 9 * sd) + 1)
    k = np.arange(a, b, dtype=np.float64)
    # ratios of neighbouring probabilities; what lies beyond 9 deviations is below what a double's draw can tell
    steps = np.log((good - k) * (n - k) / ((k + 1) * (bad - n + k + 1)))
    logs = np.concatenate([[0.0], np.cumsum(steps)])
    p = np.cumsum(np.exp(logs - logs.max()))
    return a + int(np.searchsorted(p, rng.random() * p[-1], side="right"))


def hypergeometrics(rng: np.random.Generator, good: np.ndarray, bad: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Independent draws, most of them by one call."""
    out = np.zeros_like(n)
    small = good + bad < _NUMPY_MOST
    out[small] = rng.hypergeometric(good[small], bad[small], n[small])
    for k in np.flatnonzero(~small).tolist():
        out[k] = hypergeometric(rng, int(good[k]), int(bad[k]), int(n[k]))
    return out


def multivariate(rng: np.random.Generator, sizes: np.ndarray, n: int) -> np.ndarray:
    """How n rows drawn without replacement divide between classes of the given sizes: halves of the classes first, then their halves."""
    if not 0 <= n <= int(sizes.sum()):
        raise ValueError(f"{n} rows of {int(sizes.sum())}")
    levels = [sizes.astype(np.int64)]
    while len(levels[-1]) > 1:
        x = levels[-1]
        levels.append(np.append(x, np.zeros(len(x) % 2, np.int64)).reshape(-1, 2).sum(1))
    drawn = np.array([n], np.int64)
    for x in reversed(levels[:-1]):
        pairs = np.append(x, np.zeros(len(x) % 2, np.int64)).reshape(-1, 2)
        left = hypergeometrics(rng, pairs[:, 0], pairs[:, 1], drawn)
        drawn = np.stack([left, drawn - left], axis=1).reshape(-1)[: len(x)]
    return drawn


def pieces_of(counts: np.ndarray, group_rows: int = GROUP_ROWS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each piece: its partition, its rows, its group. Pieces and groups hold group_rows rows at most."""
    many = -(-counts // group_rows)
    part = np.repeat(np.arange(len(counts)), many)
    nth = np.arange(len(part)) - np.repeat(np.cumsum(many) - many, many)
    size = np.minimum(group_rows, counts[part] - nth * group_rows)
    group, g, held = np.zeros(len(part), np.int64), 0, 0
    for k, n in enumerate(size.tolist()):
        if held and held + n > group_rows:
            g, held = g + 1, 0
        group[k] = g
        held += n
    return part, size, group


def group_row(totals: np.ndarray, sizes: np.ndarray, g: int, seed: int) -> np.ndarray:
    """A group's row of the communication matrix: its rows in each block. `totals` are rows before each group."""
    lo, hi = 0, len(totals) - 1
    while hi - lo > 1:
        mid = (lo + hi) // 2
        left = multivariate(np.random.default_rng([seed, lo, hi]), sizes, int(totals[mid] - totals[lo]))
        if g < mid:
            hi, sizes = mid, left
        else:
            lo, sizes = mid, sizes - left
    return sizes


def blocks_within(row: np.ndarray, g: int, seed: int) -> np.ndarray:
    """The blocks of a group's rows, in an order of its own."""
    out = np.repeat(np.arange(len(row), dtype=np.int32), row)
    np.random.default_rng([seed, 1, g]).shuffle(out)
    return out


def matrix_row(counts: np.ndarray, sizes: np.ndarray, part: int, seed: int, group_rows: int = GROUP_ROWS) -> np.ndarray:
    """One partition's row of the matrix."""
    owner, rows, group = pieces_of(counts, group_rows)
    totals = np.concatenate([[0], np.cumsum(np.bincount(group, rows).astype(np.int64))])
    out = np.zeros(len(sizes), np.int64)
    for k in np.flatnonzero(owner == part).tolist():
        first = int(rows[:k].sum() - totals[group[k]])
        own = blocks_within(group_row(totals, sizes, int(group[k]), seed), int(group[k]), seed)
        out += np.bincount(own[first : first + rows[k]], minlength=len(sizes))
    return out


def block_sizes(total: int, shards: int, block_rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each block: its shard, its first slot there, its size."""
    shard_of, first, size = [], [], []
    for s in range(shards):
        rows = total // shards + (s < total % shards)
        blocks = max(1, -(-rows // block_rows))
        bounds = [rows * k // blocks for k in range(blocks + 1)]
        shard_of += [s] * blocks
        first += bounds[:-1]
        size += [b - a for a, b in zip(bounds, bounds[1:], strict=False)]
    return np.array(shard_of, np.int32), np.array(first, np.int64), np.array(size, np.int64)


def draw_groups(spark: SparkSession, held, shards: int, block_rows: int, seed: int, groups: int) -> dict[int, str]:
    """The files with the groups' rows; none where one group has all rows."""
    if groups < 2:
        return {}
    folder = shared.shared_dir(spark, "matrix")

    def run(batches):
        import zstandard

        _, rows, group = held.value
        totals = np.concatenate([[0], np.cumsum(np.bincount(group, rows).astype(np.int64))])
        _, _, sizes = block_sizes(int(totals[-1]), shards, block_rows)
        for batch in batches:
            for g in batch.column(0).to_pylist():
                file = f"{folder}/row-{g:08d}-{uuid.uuid4().hex}"
                with shared.open_output(file) as stream:
                    stream.write(zstandard.ZstdCompressor(level=1).compress(group_row(totals, sizes, g, seed).astype("<i8").tobytes()))
                yield pa.RecordBatch.from_pydict({"g": pa.array([g], pa.int64()), "file": [file]})

    found = spark.range(0, groups, 1, groups).mapInArrow(run, "g long, file string").collect()  # a row for each group
    return {r["g"]: r["file"] for r in found}


def shuffle(docs: DataFrame, shards: int = SHARDS, seed: int = SEED, block_rows: int = BLOCK_ROWS, materialize: bool = False, group_rows: int = GROUP_ROWS) -> DataFrame:
    """The rows with shard (from 0) and slot (from 0 within the shard)."""
    if materialize:
        docs = written(docs, "shuffle")
    spark = docs.sparkSession
    rows = docs.drop("shard", "slot").select(F.struct("*").alias("row"))
    found = docs.groupBy(F.spark_partition_id().alias("part")).count().collect()  # a row for each input partition
    counts = np.zeros(max((r["part"] for r in found), default=0) + 1, np.int64)
    for r in found:
        counts[r["part"]] = r["count"]
    pieces = pieces_of(counts, group_rows)
    held = spark.sparkContext.broadcast(pieces)  # three numbers for each partition or group_rows rows
    files = draw_groups(spark, held, shards, block_rows, seed, int(pieces[2][-1]) + 1 if len(pieces[2]) else 0)
    named = spark.sparkContext.broadcast(files)  # a name for each group

    def deal(batches):
        import zstandard

        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        batch = next(batches, None)
        if batch is None:
            return
        owner, sizes_, group = held.value
        shard_of, first, size = block_sizes(int(sizes_.sum()), shards, block_rows)
        own = np.flatnonzero(owner == part).tolist()
        expected = int(sizes_[own].sum())

        def dealt():
            for k in own:
                g = int(group[k])
                row = size
                if g in named.value:
                    with shared.open_input(named.value[g]) as source:
                        row = np.frombuffer(zstandard.ZstdDecompressor().decompress(source.read()), "<i8")
                before = int(sizes_[np.flatnonzero(group[:k] == g)].sum())
                yield blocks_within(row, g, seed)[before : before + int(sizes_[k])].copy()

        rng, at, ready, source = np.random.default_rng([seed, 2, part]), 0, np.zeros(0, np.int32), dealt()
        while batch is not None:
            n = batch.num_rows
            if at + n > expected:
                raise ValueError(f"partition {part} has more rows than the {expected} counted; use materialize=True")
            while len(ready) < n:
                ready = np.concatenate([ready, next(source)])
            block, ready = ready[:n], ready[n:]
            draws = rng.integers(0, 1 << 63, n, dtype=np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(block), pa.array(draws), pa.array(shard_of[block]), pa.array(first[block])], schema=pa.schema([*batch.schema, ("block", pa.int32()), ("draw", pa.int64()), ("shard", pa.int32()), ("first", pa.int64())]))
            at += n
            batch = next(batches, None)
        if at != expected:
            raise ValueError(f"partition {part} has {at} rows, not the {expected} counted; use materialize=True")

    schema = T.StructType([*rows.schema.fields, T.StructField("block", T.IntegerType()), T.StructField("draw", T.LongType()), T.StructField("shard", T.IntegerType()), T.StructField("first", T.LongType())])
    place = F.row_number().over(Window.partitionBy("block").orderBy("draw"))
    out = rows.mapInArrow(deal, schema).select("row", "shard", (F.col("first") + place - 1).alias("slot"))
    return out.select("row.*", "shard", "slot")


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = shuffle(table(spark, sf_dir, "documents").select("doc_id", "text"))
    data = F.coalesce(F.encode("text", "UTF-8"), F.lit(b""))
    return out.select("doc_id", (F.length(data) + 1).cast("long").alias("size"), F.crc32(data).alias("text_crc32"), F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
