import hashlib
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from orrery.llm import decontam


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items, window=10):
    index = {}
    for item_id, text in items:
        w = words(text)
        m = min(window, len(w))
        for i in range(len(w) - m + 1 if w else 0):
            index.setdefault(tuple(w[i : i + m]), set()).add("null" if item_id is None else str(item_id))
    sizes = {len(k) for k in index}
    out = []
    for doc_id, text in docs:
        w, hit, found = words(text), set(), set()
        for m in sizes:
            for i in range(len(w) - m + 1):
                if names := index.get(tuple(w[i : i + m])):
                    found |= names
                    hit.update(range(i, i + m))
        out.append((str(doc_id), len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()))
    return sorted(out)


def digest(found):
    items = F.array_sort(F.array_distinct(F.transform("matches", lambda m: m["item_id"])))
    rows = found.select(F.col("doc_id"), "n_words", decontam.hit_words().alias("n_hit"), F.size(items).alias("k"), F.sha2(F.array_join(items, ","), 256).alias("s")).collect()
    return sorted((str(r.doc_id), r.n_words, r.n_hit, r.k, r.s) for r in rows)


@pytest.fixture(scope="module")
def benchmark(spark):
    made = [(900, "one TWO three, four five six seven eight nine ten eleven"), (901, "nine"), (902, "line line other"), (903, None), (903, ""), (None, "extra w1 w2 w3 w4 w5 w6 w7 w8 w9 w10 w11"), (904, "é été"), (905, "déjà naïve")]
    return spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").union(spark.createDataFrame(made, "item_id long, text string"))


@pytest.mark.parametrize("window", [10, 3])
def test_matches_brute_force(documents, odd, benchmark, window):
    docs = documents.select("doc_id", "text").union(odd.select("doc_id", "text"))
    got = digest(decontam.find(docs, benchmark, window))
    assert got == brute([tuple(r) for r in docs.collect()], [tuple(r) for r in benchmark.collect()], window)


def test_blocks_of_the_benchmark_give_the_same(documents, benchmark):
    docs = documents.limit(80).repartition(3)  # as after a shuffle, rows have no fixed order
    assert len(decontam.write_blocks(benchmark, 2000)) > 2
    assert len(decontam.write_blocks(benchmark.repartition(17))) == 1
    assert digest(decontam.find(docs, benchmark, block_bytes=2000)) == digest(decontam.find(docs, benchmark))
    assert sorted(r.doc_id for r in decontam.clean(docs, benchmark, block_bytes=2000).collect()) == sorted(r.doc_id for r in decontam.clean(docs, benchmark).collect())


def test_the_query(spark, documents):
    rows = decontam.op1_decontamination(spark, "/root/testdata/sf0.001").collect()
    items = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").collect()]
    assert sorted((str(r.doc_id), r.n_words, r.n_hit, r.n_items, r.items_sha256) for r in rows) == brute([(r.doc_id, r.text) for r in documents.collect()], items)
    assert all(r.contaminated == (r.n_hit > 0) for r in rows)


def test_longest_matches(spark):
    docs = spark.createDataFrame([(1, "x a b c d e f y a b c z"), (2, None)], "doc_id long, text string")
    items = spark.createDataFrame([(5, "q a b c d e f r")], "item_id long, text string")
    (one,) = decontam.find(docs, items, window=3).where("doc_id = 1").collect()
    assert [(m.item_id, m.item_word, m.doc_word, m.n_words) for m in one.matches] == [("5", 1, 1, 6), ("5", 1, 8, 3)]


def test_suffix_array_order():
    rng = np.random.default_rng(3)
    for n_words in (3, 200):
        sizes = rng.integers(0, 60, 30)
        rows = np.concatenate([[0], np.cumsum(sizes)])
        sa = decontam.SuffixArray(rng.integers(0, n_words, rows[-1]).astype(np.uint64), rows, 12)
        padded = np.concatenate([sa.text, np.zeros(12, np.int64)])
        seen = [tuple(padded[p : p + 12]) for p in sa.order]
        cut = [x[: x.index(0) + 1] if 0 in x else x for x in seen]
        assert cut == sorted(cut)


def test_stage(odd, benchmark):
    out = decontam.clean(odd, benchmark)
    assert out.columns == odd.columns
    bad = {r[0] for r in brute([(r.doc_id, r.text) for r in odd.collect()], [tuple(r) for r in benchmark.collect()]) if r[2]}
    assert sorted(str(r.doc_id) for r in out.collect()) == sorted(str(r.doc_id) for r in odd.collect() if str(r.doc_id) not in bad)
    assert decontam.clean(odd, benchmark.limit(0)).count() == odd.count()
    assert decontam.clean(odd.limit(0), benchmark).count() == 0
