import math
import time
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from orrery.llm import sharding


def test_exact_sizes_and_slots(spark, documents):
    docs = documents.repartition(5)
    got = sharding.shuffle(docs, shards=8, block_rows=10, materialize=True).collect()
    assert sorted(r.doc_id for r in got) == sorted(r.doc_id for r in documents.select("doc_id").collect())
    sizes = Counter(r.shard for r in got)
    assert len(sizes) == 8 and max(sizes.values()) - min(sizes.values()) <= 1
    for s, n in sizes.items():
        assert sorted(r.slot for r in got if r.shard == s) == list(range(n))


def test_odd_rows_and_few_rows(odd):
    got = sharding.shuffle(odd, shards=8, materialize=True)
    assert got.columns == [*odd.columns, "shard", "slot"] and got.count() == odd.count()
    assert sharding.shuffle(odd.limit(0)).count() == 0


CLASHING = ["_block", "_draw", "_first", "block", "draw", "first", "row", "part", "count", "_row", "_at"]


def test_no_column_is_lost(spark):
    rows = [(k if k % 3 else None, *[100 * k + i for i in range(len(CLASHING))], 0, 0) for k in range(40)]
    docs = spark.createDataFrame(rows, ", ".join(f"{c} long" for c in ["doc_id", *CLASHING, "shard", "slot"]))
    got = sharding.shuffle(docs, shards=3, block_rows=4, group_rows=9, materialize=True)
    assert got.columns == ["doc_id", *CLASHING, "shard", "slot"]
    assert sorted(map(str, (tuple(r)[:-2] for r in got.collect()))) == sorted(map(str, (r[:-2] for r in rows)))
    assert sorted((r.shard, r.slot) for r in got.collect()) == [(s, k) for s in range(3) for k in range(14 if s == 0 else 13)]


@pytest.mark.parametrize("group_rows", [10, 50, 10_000])
def test_matrix_rows_agree_and_add_up(group_rows):
    counts = np.array([5, 0, 40, 17, 1, 900], np.int64)
    _, _, sizes = sharding.block_sizes(int(counts.sum()), 8, 30)
    rows = np.array([sharding.matrix_row(counts, sizes, k, 3, group_rows) for k in range(len(counts))])
    assert (rows.sum(1) == counts).all() and (rows.sum(0) == sizes).all() and (rows >= 0).all()


def test_pieces_are_bounded():
    counts = np.array([0, 7, 25, 3, 0, 1], np.int64)
    part, size, group = sharding.pieces_of(counts, 10)
    assert size.max() <= 10 and np.bincount(group, size).max() <= 10
    assert np.bincount(part, size, len(counts)).tolist() == counts.tolist()
    assert len(sharding.pieces_of(np.zeros(3, np.int64))[0]) == 0


def test_ten_billion_rows():
    total = 10_000_000_000
    _, _, sizes = sharding.block_sizes(total, 8, 20_000)
    counts = np.full(100_000, total // 100_000, np.int64)
    _, rows, group = sharding.pieces_of(counts)
    totals = np.concatenate([[0], np.cumsum(np.bincount(group, rows).astype(np.int64))])
    row = sharding.group_row(totals, sizes, 1234, 5)  # drawn in a stage of its own
    assert row.sum() == totals[1235] - totals[1234] and (row >= 0).all() and (row <= sizes).all()
    began = time.process_time()
    own = sharding.blocks_within(row, 1234, 5)
    assert time.process_time() - began < 1
    assert (np.bincount(own, minlength=len(sizes)) == row).all()
    halves = [sharding.multivariate(np.random.default_rng(1), sizes, n) for n in (total // 2, 4_000_000)]
    assert [int(x.sum()) for x in halves] == [total // 2, 4_000_000] and all((x <= sizes).all() for x in halves)


def test_large_population_draws():
    rng = np.random.default_rng(1)
    good, bad, n = 3_000_000_000, 9_000_000_000, 1_000_000
    draws = np.array([sharding.hypergeometric(rng, good, bad, n) for _ in range(400)])
    assert abs(draws.mean() - n / 4) < 5 * np.sqrt(n * 0.25 * 0.75 / 400)
    assert 0.8 < draws.var() / (n * 0.25 * 0.75) < 1.25
    sizes = np.array([2_000_000_000] * 3)
    assert sharding.multivariate(rng, sizes, 10_000).sum() == 10_000


@pytest.mark.parametrize("group_rows", [1, 2, 100])
def test_uniform_over_permutations(group_rows):
    # three rows in two partitions, three blocks of one row: all six orders are equally likely
    seen = Counter()
    counts = np.array([2, 1])
    part, size, group = sharding.pieces_of(counts, group_rows)
    totals = np.concatenate([[0], np.cumsum(np.bincount(group, size).astype(np.int64))])
    _, _, sizes = sharding.block_sizes(3, 3, 1)
    for seed in range(3000):
        order = []
        for g in range(len(totals) - 1):
            order += sharding.blocks_within(sharding.group_row(totals, sizes, g, seed), g, seed).tolist()
        seen[tuple(order)] += 1
    assert len(seen) == 6 and min(seen.values()) > 400


def test_multivariate_has_the_law():
    rng, sizes = np.random.default_rng(2), np.array([3, 0, 1, 2])
    seen = Counter(tuple(sharding.multivariate(rng, sizes, 3).tolist()) for _ in range(20_000))
    for x, n in seen.items():
        p = np.prod([math.comb(int(s), k) for s, k in zip(sizes, x, strict=True)]) / math.comb(6, 3)
        assert abs(n / 20_000 - p) < 5 * math.sqrt(p / 20_000)
    with pytest.raises(ValueError):
        sharding.multivariate(rng, sizes, 7)


@pytest.mark.parametrize("change", [1, -1])
def test_a_changed_input_fails(spark, tmp_path, change):
    def run(batches):
        for batch in batches:
            mark = tmp_path / f"{batch.column(0)[0].as_py()}"
            seen = mark.exists()
            mark.touch()
            rows = batch.column(0).to_pylist()
            if seen:
                rows = rows + rows[:1] if change > 0 else rows[1:]
            yield pa.RecordBatch.from_pydict({"id": pa.array(rows, pa.int64())})

    with pytest.raises(Exception, match="counted; use materialize"):
        sharding.shuffle(spark.range(0, 10, 1, 2).mapInArrow(run, "id long")).collect()


def test_the_query(spark, documents):
    rows = {r.doc_id: r for r in sharding.op10_sharding(spark, "/root/testdata/sf0.001").collect()}
    texts = {r.doc_id: (r.text or "").encode() for r in documents.collect()}
    assert {k: (r["size"], r.text_crc32, r.law, r.grown_shard) for k, r in rows.items()} == {k: (len(t) + 1, zlib.crc32(t), "rows", None) for k, t in texts.items()}
    sizes = Counter(r.shard for r in rows.values())
    assert set(sizes) == set(range(8)) and max(sizes.values()) - min(sizes.values()) <= 1
    assert all(sorted(r.slot for r in rows.values() if r.shard == s) == list(range(n)) for s, n in sizes.items())
