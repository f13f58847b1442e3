"""Token ids in bit-plane or byte-plane files.

A file holds ids in blocks of a fixed number of ids. A block is an array of little-endian
unsigned 32-bit ids, transposed so that equal-ranking bytes (or bits) stand together, and each
plane is compressed by zstandard on its own. Layout, little-endian throughout:

    magic "ORPL0001"
    planes of block 0, planes of block 1, ...
    row table: a zstandard frame with an Arrow stream of (id, n_tokens), rows in file order
    chunk index: a zstandard frame with, for each block, its offset, its number of ids and the size of each plane
    footer: offset and size of the row table and of the index, number of ids, number of planes, magic

Documents are range-partitioned and sorted by id, so files in order of their number hold ids in
ascending order of documents. There is a file for about PART_BYTES of text. Null text is empty; null ids come first; rows of equal
ids are ordered by a hash of their text, then by where they stand in the input, so that a repeated id is split over files too.
"""

from __future__ import annotations

import struct
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from orrery.llm import shared, tokens
from orrery.llm.textbytes import blocks

MAGIC = b"ORPL0001"
FOOTER = struct.Struct("<QQQQQI8s")
BLOCK_IDS = 1 << 16
#: Text that one file is meant to hold.
PART_BYTES = 96 << 20
TOKENIZER = "byte_bpe_50k.json"
END_ID = 0


def to_planes(ids: np.ndarray, bits: bool) -> list[bytes]:
    rows = ids.astype("<u4").view(np.uint8).reshape(-1, 4)
    if not bits:
        return [np.ascontiguousarray(rows[:, k]).tobytes() for k in range(4)]
    unpacked = np.unpackbits(rows, axis=1, bitorder="little")
    return [np.packbits(unpacked[:, k], bitorder="little").tobytes() for k in range(32)]


def from_planes(planes: list[bytes], n: int) -> np.ndarray:
    if len(planes) == 4:
        out = np.empty((n, 4), np.uint8)
        for k, p in enumerate(planes):
            out[:, k] = np.frombuffer(p, np.uint8)
        return out.reshape(-1).view("<u4")
    bits = np.empty((n, 32), np.uint8)
    for k, p in enumerate(planes):
        bits[:, k] = np.unpackbits(np.frombuffer(p, np.uint8), count=n, bitorder="little")
    return np.packbits(bits, axis=1, bitorder="little").reshape(-1).view("<u4")


class PlaneWriter:
    def __init__(self, stream, block_ids: int = BLOCK_IDS, bits: bool = False, level: int = 1):
        import zstandard

        self.stream, self.block_ids, self.bits = stream, block_ids, bits
        self.compressor = zstandard.ZstdCompressor(level=level)
        self.at, self.total, self.index = len(MAGIC), 0, []
        self.waiting: list[np.ndarray] = []
        self.held = 0
        stream.write(MAGIC)

    def _put(self, ids: np.ndarray) -> None:
        planes = [self.compressor.compress(p) for p in to_planes(ids, self.bits)]
        self.index.append([self.at, len(ids), *map(len, planes)])
        for p in planes:
            self.stream.write(p)
            self.at += len(p)
        self.total += len(ids)

    def add(self, ids: np.ndarray) -> None:
        self.waiting.append(ids)
        self.held += len(ids)
        if self.held >= self.block_ids:
            held = np.concatenate(self.waiting)
            whole = len(held) // self.block_ids * self.block_ids
            for a in range(0, whole, self.block_ids):
                self._put(held[a : a + self.block_ids])
            self.waiting, self.held = [held[whole:]], len(held) - whole

    def close(self, rows: pa.Table) -> None:
        if self.held:
            self._put(np.concatenate(self.waiting))
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, rows.schema) as out:
            out.write_table(rows)
        parts = [self.compressor.compress(sink.getvalue().to_pybytes()), self.compressor.compress(np.array(self.index, "<u8").tobytes())]
        for p in parts:
            self.stream.write(p)
        self.stream.write(FOOTER.pack(self.at, len(parts[0]), self.at + len(parts[0]), len(parts[1]), self.total, 32 if self.bits else 4, MAGIC))


class PlaneReader:
    """Random access to a file's blocks."""

    def __init__(self, source):
        import zstandard

        self.source, self.decompressor = source, zstandard.ZstdDecompressor()
        size = source.size()
        rows_at, rows_n, index_at, index_n, self.total, self.planes, magic = FOOTER.unpack(source.read_at(FOOTER.size, size - FOOTER.size))
        if magic != MAGIC or source.read_at(len(MAGIC), 0) != MAGIC:
            raise ValueError("not a plane file")
        self.rows = pa.ipc.open_stream(self.decompressor.decompress(source.read_at(rows_n, rows_at))).read_all()
        self.index = np.frombuffer(self.decompressor.decompress(source.read_at(index_n, index_at)), "<u8").reshape(-1, 2 + self.planes)

    def block(self, k: int) -> np.ndarray:
        at, n, *sizes = map(int, self.index[k])
        data, planes = self.source.read_at(sum(sizes), at), []
        for size in sizes:
            planes.append(self.decompressor.decompress(data[:size]))
            data = data[size:]
        return from_planes(planes, n)

    def slices(self, bounds: np.ndarray):
        """Ids between consecutive bounds, with a few blocks in memory."""
        held, base, k = np.zeros(0, np.uint32), 0, 0
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            if b > base + len(held):
                parts = [held[a - base :]]
                have = base + len(held)
                while have < b:
                    parts.append(self.block(k))
                    have += len(parts[-1])
                    k += 1
                held, base = np.concatenate(parts), a
            yield held[a - base : b - base]


def write(docs: DataFrame, path: str, tokenizer_file: str | None = None, end_id: int = END_ID, block_ids: int = BLOCK_IDS, bits: bool = False, id_col: str = "doc_id", text_col: str = "text", parts: int | None = None) -> list[dict]:
    """Write all texts; the manifest has one row per file: part, file, n_docs, n_tokens, start.

    A task writes under a name of its own and reports it on success, so retried and speculative
    attempts leave the manifest right. The manifest's rows are as many as `parts`, by default one for each
    PART_BYTES of text, and at least as many as the cluster runs tasks at once where the text is that long.
    """
    spark = docs.sparkSession
    if parts is None:
        total = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
        parts = max(-(-total // PART_BYTES), min(spark.sparkContext.defaultParallelism, -(-total // (1 << 20))), 1)
    name = tokenizer_file or TOKENIZER

    def run(batches):
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        batch = next(batches, None)
        if batch is None:
            return
        encoder = tokens.encoder(name if "/" in name else tokens.tokenizer_path(name))
        file = f"{path}/part-{part:06d}-{uuid.uuid4().hex}.planes"
        ids_of, sizes = [], []
        with shared.open_output(file) as stream:
            out = PlaneWriter(stream, block_ids, bits)
            while batch is not None:
                for _, _, raw, off in blocks(batch.column(1)):
                    ids, where = encoder.encode(raw, off, end_id)
                    out.add(ids)
                    sizes.append(np.diff(where))
                ids_of.append(batch.column(0))
                batch = next(batches, None)
            n = np.concatenate(sizes) if sizes else np.zeros(0, np.int64)
            out.close(pa.table({"id": pa.chunked_array(ids_of), "n_tokens": n.astype(np.int64)}))
        yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "file": [file], "n_docs": pa.array([len(n)], pa.int64()), "n_tokens": pa.array([int(n.sum())], pa.int64())})

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("h"), F.monotonically_increasing_id().alias("at"))
    rows = rows.repartitionByRange(parts, "id", "h", "at").sortWithinPartitions("id", "h", "at").select("id", "text")
    manifest = [r.asDict() for r in rows.mapInArrow(run, "part int, file string, n_docs long, n_tokens long").collect()]
    start = 0
    for row in sorted(manifest, key=lambda r: r["part"]):
        row["start"] = start
        start += row["n_tokens"]
    return sorted(manifest, key=lambda r: r["part"])


def read(spark: SparkSession, manifest: list[dict], id_type: T.DataType = T.LongType()) -> DataFrame:
    """One row per document from the files: id, start (ids before it), n_tokens, and its ids as little-endian bytes."""
    frame = spark.createDataFrame([(r["file"], r["start"]) for r in manifest], "file string, start long").repartition(max(1, len(manifest)))

    def run(batches):
        for batch in batches:
            for file, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                with shared.open_input(file) as source:
                    reader = PlaneReader(source)
                    sizes = reader.rows["n_tokens"].to_numpy()
                    bounds = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
                    ids = reader.rows["id"].combine_chunks()
                    it, step = reader.slices(bounds), 2048
                    for a in range(0, len(sizes), step):
                        b = min(a + step, len(sizes))
                        data = [next(it).tobytes() for _ in range(a, b)]
                        yield pa.RecordBatch.from_arrays([ids.slice(a, b - a), pa.array(start + bounds[a:b]), pa.array(sizes[a:b]), pa.array(data, pa.binary())], names=["doc_id", "start", "n_tokens", "ids"])

    schema = T.StructType([T.StructField("doc_id", id_type), T.StructField("start", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.BinaryType())])
    return frame.mapInArrow(run, schema)


def crc32_of(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())


def op7_bitplanes(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = shared.table(spark, sf_dir, "documents")
    manifest = write(docs, shared.shared_dir(spark, "planes"))
    return read(spark, manifest, docs.schema["doc_id"].dataType).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
