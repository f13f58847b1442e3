import hashlib
import io

import pytest
import zstandard
from pyspark.sql import functions as F

from orrery.llm import shared, warc


@pytest.fixture(scope="module")
def pages(spark):
    long, other = "é" * 600, "x" * 1000
    rows = [(1, "http://a/", long), (2, None, long), (9, "http://b/\r\nX: y", long), (3, "u", "short"), (4, "u", "short"), (5, "u", None), (None, "n", other), (6, "u", other), (6, "u", other), (7, "", "")]
    return spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, digest int")


def want(rows):
    payloads = [(r.page_id, (r.html or "").encode()) for r in rows]
    out = []
    for page, data in payloads:
        last = max((p for p, d in payloads if d == data and p is not None), default=None)
        revisit = len(data) >= 1000 and page != last
        out.append((page, len(data), hashlib.sha1(data).hexdigest(), "revisit" if revisit else "response", last if revisit else None))
    return sorted(out, key=str)


def test_round_trip(spark, pages):
    index = warc.write(pages, shared.shared_dir(spark, "warc"), frame_bytes=500)
    got = warc.fetch(index).collect()
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got), key=str) == want(pages.collect())
    assert {bytes(r.payload) for r in got if r.record_type == "response"} >= {("é" * 600).encode(), b"short", b""}
    names = [r.record_id for r in index.collect()]
    assert len(set(names)) == len(names) == len(got)
    # any zstandard reader can read a bundle as one stream of records
    for file in {r.file for r in index.select("file").distinct().collect()}:
        with shared.open_input(file) as source:
            data = zstandard.ZstdDecompressor().stream_reader(io.BytesIO(source.read()), read_across_frames=True).read()
        at, ids = 0, []
        while at < len(data):
            fields, _, at = warc.parse_record(data, at)
            ids.append(fields["WARC-Record-ID"])
            if refers := fields.get("WARC-Refers-To"):
                assert refers[1:-1] in names
            elif fields["WARC-Type"] == "revisit":
                assert fields["X-Refers-To-Page"] == "6"  # whose rows repeat
        assert len(ids) == index.where(F.col("file") == file).count()


def test_no_pages(spark, pages):
    index = warc.write(pages.limit(0), shared.shared_dir(spark, "warc"))
    assert warc.fetch(index).count() == 0


def test_the_query(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/pages.parquet").collect()
    got = warc.op5_warc(spark, "/root/testdata/sf0.001").collect()
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got), key=str) == want(rows)
