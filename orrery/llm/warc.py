"""WARC archives as seekable Zstandard bundles.

A bundle is a file of independent zstandard frames, each with whole WARC records, and a seek table
in a skippable frame at its end: for each frame its compressed and its decompressed size, then the
number of frames, a descriptor byte and the seekable format's magic number. Any zstandard reader can
read a bundle from its start; the index maps a record to its bundle, frame and offset within the
frame, so that one frame is read to get a record.

Of pages with equal payloads of at least `min_revisit` bytes (equal SHA-1 and length), those with the
largest page_id are responses and the others revisits of it, without a body. Smaller payloads are all
responses. Null html is an empty payload. Rows are archived each on its own, and no two records have the same
WARC-Record-ID: it follows from page and payload, but for rows that repeat both, or have no page_id, whose records
have one drawn from their file and place. Revisits refer to a response's record by WARC-Refers-To, where rows do not repeat it, and
by X-Refers-To-Page. A null id counts as smaller than all others. Only the id, url and html columns are read.
"""

from __future__ import annotations

import base64
import struct
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from orrery.llm import shared

MIN_REVISIT = 1000
FRAME_BYTES = 1 << 18
_SKIPPABLE, _SEEKABLE = 0x184D2A5E, 0x8F92EAB1
_DATE = "2024-01-01T00:00:00Z"
_SPACE = uuid.UUID("6f1f3c52-2a11-5c1e-9a53-6d0d8f0f6a10")


def record_id(page_id: int | None, digest: str, place: str = "") -> str:
    return f"urn:uuid:{uuid.uuid5(_SPACE, f'page:{page_id}:{digest}:{place}')}"


def make_record(name: str, page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, repeated: bool) -> bytes:
    """A WARC/1.1 record of that record id; the digest is hexadecimal SHA-1, and `repeated` tells that refers_to is no single record."""
    revisit = refers_to is not None
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <{name}>",
        f"WARC-Date: {_DATE}",
        f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(digest)).decode()}",
        f"X-Payload-Length: {len(payload)}",
        f"X-Page-ID: {'' if page_id is None else page_id}",
    ]
    if url:
        head.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"X-Refers-To-Page: {refers_to}"]
        if not repeated:
            head.append(f"WARC-Refers-To: <{record_id(refers_to, digest)}>")
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
    block = http if revisit else http + payload
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(data: bytes, at: int) -> tuple[dict[str, str], bytes, int]:
    """Header fields, block, and where the next record starts."""
    end = data.index(b"\r\n\r\n", at)
    first, *lines = data[at:end].decode().split("\r\n")
    if not first.startswith("WARC/"):
        raise ValueError("no record starts here")
    fields = dict(x.split(": ", 1) if ": " in x else (x.rstrip(": "), "") for x in lines)
    start = end + 4
    stop = start + int(fields["Content-Length"])
    return fields, data[start:stop], stop + 4


class BundleWriter:
    def __init__(self, stream, frame_bytes: int = FRAME_BYTES, level: int = 3):
        import zstandard

        self.stream, self.frame_bytes = stream, frame_bytes
        self.compressor = zstandard.ZstdCompressor(level=level, write_content_size=True)
        self.frames: list[tuple[int, int]] = []
        self.held: list[bytes] = []
        self.size = 0

    def add(self, record: bytes) -> tuple[int, int]:
        """The record's frame, and its offset there."""
        if self.size and self.size + len(record) > self.frame_bytes:
            self._flush()
        place = len(self.frames), self.size
        self.held.append(record)
        self.size += len(record)
        return place

    def _flush(self) -> None:
        data = self.compressor.compress(b"".join(self.held))
        self.stream.write(data)
        self.frames.append((len(data), self.size))
        self.held, self.size = [], 0

    def close(self) -> None:
        if self.size:
            self._flush()
        body = b"".join(struct.pack("<II", *x) for x in self.frames) + struct.pack("<IBI", len(self.frames), 0, _SEEKABLE)
        self.stream.write(struct.pack("<II", _SKIPPABLE, len(body)) + body)


class BundleReader:
    def __init__(self, source):
        import zstandard

        self.source, self.decompressor = source, zstandard.ZstdDecompressor()
        size = source.size()
        n, _, magic = struct.unpack("<IBI", source.read_at(9, size - 9))
        if magic != _SEEKABLE:
            raise ValueError("no seek table")
        sizes = np.frombuffer(source.read_at(8 * n, size - 9 - 8 * n), "<u4").reshape(-1, 2).astype(np.int64)
        self.starts, self.sizes = np.concatenate([[0], np.cumsum(sizes[:, 0])]), sizes

    def frame(self, k: int) -> bytes:
        data = self.source.read_at(int(self.sizes[k, 0]), int(self.starts[k]))
        return self.decompressor.decompress(data, max_output_size=int(self.sizes[k, 1]))


INDEX = "record_id string, page_id long, file string, frame int, offset long, length long"


def decided(pages: DataFrame, min_revisit: int = MIN_REVISIT) -> DataFrame:
    """The pages with digest, refers_to where they are revisits, again (the row repeats page and payload, or has no id) and many (so does the page it refers to).

    Only ids and digests meet by payload; html moves once, by page, and only pages with something to say take part in that join.
    """
    payload = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    own = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html", F.sha1(payload).alias("digest"), F.length(payload).alias("n"))
    ids = own.groupBy("page_id", "digest", "n").agg(F.count("*").alias("c"))
    groups = ids.where(F.col("n") >= min_revisit).groupBy("digest", "n").agg(F.max(F.struct("page_id", "c")).alias("last"), F.sum("c").alias("all")).where("all > 1")
    groups = groups.select("digest", "n", F.col("last.page_id").alias("last"), (F.col("last.c") > 1).alias("many"))
    again = (F.col("c") > 1) | F.col("page_id").isNull()
    told = ids.join(groups, ["digest", "n"], "left").select("page_id", "digest", again.alias("again"), F.when(~F.col("page_id").eqNullSafe(F.col("last")), F.col("last")).alias("refers_to"), "many")
    told = told.where(F.col("again") | F.col("refers_to").isNotNull()).select(F.col("page_id").alias("_page"), F.col("digest").alias("_digest"), "again", "refers_to", "many")
    on = F.col("page_id").eqNullSafe(F.col("_page")) & (F.col("digest") == F.col("_digest"))
    out = own.join(told, on, "left")
    return out.select("page_id", "url", "html", "digest", "refers_to", *[F.coalesce(c, F.lit(False)).alias(c) for c in ("again", "many")])


def write(pages: DataFrame, path: str, min_revisit: int = MIN_REVISIT, frame_bytes: int = FRAME_BYTES) -> DataFrame:
    """Write bundles, one per task, and return the index, which is kept as a table beside them.

    A task writes a file of its own name and reports it on success, so files of failed attempts are never indexed.
    """
    spark = pages.sparkSession

    def run(batches):
        from pyspark import TaskContext

        batch = next(batches, None)
        if batch is None:
            return
        file = f"{path}/bundle-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.warc.zst"
        rows: list[tuple] = []
        with shared.open_output(file) as stream:
            out = BundleWriter(stream, frame_bytes)
            while batch is not None:
                for page_id, url, html, digest, refers_to, again, many in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                    name = record_id(page_id, digest, f"{file}:{len(rows)}" if again else "")
                    record = make_record(name, page_id, url, (html or "").encode(), digest, refers_to, many)
                    frame, offset = out.add(record)
                    rows.append((name, page_id, file, frame, offset, len(record)))
                batch = next(batches, None)
            out.close()
        for a in range(0, len(rows), 10_000):
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[a : a + 10_000], strict=True), (pa.string(), pa.int64(), pa.string(), pa.int32(), pa.int64(), pa.int64()), strict=True)], names=["record_id", "page_id", "file", "frame", "offset", "length"])

    index = f"{path}/index"
    decided(pages, min_revisit).mapInArrow(run, INDEX).write.parquet(index)
    return spark.read.schema(INDEX).parquet(index)


def fetch(index: DataFrame, payloads: bool = True) -> DataFrame:
    """Read indexed records back: page_id, payload_bytes, payload_digest, record_type, refers_to, payload (null for revisits, or where `payloads` is false).

    Rows of a frame come together, so a frame is read once; a response's payload is checked against its digest.
    """
    import hashlib

    def run(batches):
        opened: tuple[str, object, BundleReader] | None = None
        for batch in batches:
            out: list[tuple] = []
            frame: tuple[str, int, bytes] | None = None
            for file, k, offset in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if frame is None or frame[:2] != (file, k):
                    if opened is None or opened[0] != file:
                        if opened:
                            opened[1].close()
                        source = shared.open_input(file)
                        opened = file, source, BundleReader(source)
                    frame = file, k, opened[2].frame(k)
                fields, block, _ = parse_record(frame[2], offset)
                digest = base64.b32decode(fields["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
                payload = None
                if fields["WARC-Type"] == "response":
                    payload = block[block.index(b"\r\n\r\n") + 4 :]
                    if hashlib.sha1(payload).hexdigest() != digest or len(payload) != int(fields["X-Payload-Length"]):
                        raise ValueError(f"{file}: a payload differs from its digest")
                page, refers = fields["X-Page-ID"], fields.get("X-Refers-To-Page")
                out.append((int(page) if page else None, int(fields["X-Payload-Length"]), digest, fields["WARC-Type"], int(refers) if refers else None, payload if payloads else None))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else [()] * 6, (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()), strict=True)], names=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"])
        if opened:
            opened[1].close()

    frames = index.select("file", "frame", "offset").repartition("file", "frame").sortWithinPartitions("file", "frame", "offset")
    return frames.mapInArrow(run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary")


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = write(shared.table(spark, sf_dir, "pages"), shared.shared_dir(spark, "warc"))
    return fetch(index, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE_SQL = """
WITH p AS (
  SELECT page_id, strlen(coalesce(html, '')) AS n, sha1(coalesce(html, '')) AS d FROM pages
), w AS (
  SELECT *, max(page_id) OVER (PARTITION BY d, n) AS last FROM p
)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, d AS payload_digest,
  CASE WHEN n >= 1000 AND page_id <> last THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN n >= 1000 AND page_id <> last THEN last END AS refers_to
FROM w
"""
