"""Packing by power-of-two decomposition: binary-length pieces, equal lengths together.

A document of n tokens becomes n // max_length pieces of max_length, and one piece for each
one-bit of the rest, longest first. A sequence is one piece, so none crosses documents and
none is padded. Pieces are written to a folder for each length, from which batches of equal lengths
are drawn: a batch is a full rectangle of ids. No shuffle is needed.

Null and empty texts give the end token alone: one piece of length 1. Rows with equal or null
ids are packed each on its own. Other columns of the input are ignored unless kept with `keep`.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from orrery.llm import shared, tokens
from orrery.llm.shared import table
from orrery.llm.textbytes import blocks

MAX_LENGTH = 2048
END_ID = 1
TOKENIZER = "word_bpe_49k.json"


def decompose(sizes: np.ndarray, max_length: int = MAX_LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, start and length of each piece, in order of row and start."""
    bits = max_length.bit_length() - 1
    if max_length != 1 << bits:
        raise ValueError("max_length must be a power of two")
    full, rest = sizes >> bits, sizes & (max_length - 1)
    ones = (rest[:, None] >> np.arange(bits)[None, ::-1]) & 1
    row, bit = np.nonzero(ones)
    length = 1 << (bits - 1 - bit)
    start = (full[row] << bits) + (rest[row] & ~((length << 1) - 1))
    whole = np.repeat(np.arange(len(sizes)), full)
    first = np.arange(len(whole)) - np.repeat(np.cumsum(full) - full, full)
    row, start, length = np.concatenate([whole, row]), np.concatenate([first << bits, start]), np.concatenate([np.full(len(whole), max_length), length])
    order = np.lexsort((start, row))
    return row[order], start[order], length[order]


def pack(docs: DataFrame, tokenizer_file: str | None = None, end_id: int = END_ID, max_length: int = MAX_LENGTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: its document, place there, bucket (binary logarithm of the length), sequence, offset, and ids as little-endian unsigned 32-bit integers."""
    path = tokenizer_file or TOKENIZER
    kind = docs.schema[id_col].dataType

    def run(batches):
        from pyspark import TaskContext

        encoder = tokens.encoder(path if "/" in path else tokens.tokenizer_path(path))
        serial = TaskContext.get().partitionId() << 33
        for batch in batches:
            for a, b, raw, off in blocks(batch.column(1)):
                ids, where = encoder.encode(raw, off, end_id)
                row, start, length = decompose(np.diff(where), max_length)
                at = where[:-1][row] + start
                ends = np.append(at, len(ids))  # pieces tile the ids
                binary = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(row), [None, pa.py_buffer((ends * 4).astype(np.int64)), pa.py_buffer(ids.astype("<u4"))])
                log = np.round(np.log2(length)).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a).take(pa.array(row)), pa.array(start.astype(np.int64)), pa.array(length.astype(np.int64)), binary.cast(pa.binary()), pa.array(np.diff(where)[row].astype(np.int64)), pa.array(serial + np.arange(len(row))), pa.array(np.zeros(len(row), np.int64)), pa.array(log)],
                    names=["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset", "bucket"],
                )
                serial += len(row)

    schema = T.StructType([T.StructField("doc_id", kind), *[T.StructField(c, t) for c, t in (("start", T.LongType()), ("length", T.LongType()), ("ids", T.BinaryType()), ("doc_tokens", T.LongType()), ("sequence_id", T.LongType()), ("offset", T.LongType()), ("bucket", T.IntegerType()))]])
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, schema)


def write_buckets(pieces: DataFrame, path: str) -> DataFrame:
    """Sequences in one folder per length, read back; a filter on `bucket` reads that folder alone."""
    pieces.write.partitionBy("bucket").option("compression", "zstd").parquet(path)
    return pieces.sparkSession.read.schema(pieces.schema).parquet(path)


def batches(buckets: DataFrame, length: int, rows: int) -> DataFrame:
    """Batches of `rows` sequences of one length at most: sequence ids, and their ids as one row-major block of little-endian unsigned 32-bit integers."""

    def run(parts):
        held, at = [], 0

        def put(take):
            nonlocal held, at
            table_ = pa.Table.from_batches(held).combine_chunks()
            out = table_.slice(0, take)
            held, at = table_.slice(take).to_batches(), at - take
            return pa.RecordBatch.from_pydict({"sequence_ids": pa.array([out.column(0).to_pylist()], pa.list_(pa.int64())), "ids": pa.array([b"".join(out.column(1).to_pylist())], pa.binary())})

        for part in parts:
            held.append(part)
            at += part.num_rows
            while at >= rows:
                yield put(rows)
        if at:
            yield put(at)

    own = buckets.where(F.col("bucket") == length.bit_length() - 1).select("sequence_id", "ids")
    return own.mapInArrow(run, "sequence_ids array<long>, ids binary")


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = write_buckets(pack(table(spark, sf_dir, "documents")), shared.shared_dir(spark, "packed"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
