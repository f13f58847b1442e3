import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from orrery.llm import ordinal
from orrery.llm.textbytes import range_hashes, text_buffer


def graded(n=900, seed=2):
    rng = np.random.default_rng(seed)
    out = []
    for k in range(n):
        g = k % 3
        w = [f"w{i}" for i in rng.integers(0, 400, rng.integers(20, 60))]
        for i in rng.integers(0, len(w), len(w) // 3):
            w[i] = [["bad", "worse###"], ["plain"], ["fine", "great"]][g][0]
        out.append((k, " ".join(w), g))
    return out


def test_grades_are_ordered_and_held_out_texts_are_ranked(spark):
    data = graded()
    docs = spark.createDataFrame([r[:2] for r in data], "doc_id long, text string")
    ratings = spark.createDataFrame([(r[0], r[2]) for r in data], "doc_id long, g int")
    fitted = ordinal.fit(docs, ratings, F.col("g"))
    assert fitted.grades == [0, 1, 2] and (np.diff(fitted.model.thresholds()) > 0).all()
    rows = {r.doc_id: r for r in ordinal.score(docs, fitted).collect()}
    held = [k for k, *_ in data if zlib.crc32(str(k).encode()) % 5 == 0]
    e, y = np.array([rows[k].expected_grade for k in held]), np.array([data[k][2] for k in held])
    assert (np.abs(e - y) < 0.5).mean() > 0.9
    assert all(1 >= rows[k].tails[0] >= rows[k].tails[1] >= 0 for k in held)
    assert all(abs(sum(rows[k].tails) - rows[k].expected_grade) < 1e-9 for k in held)


def test_the_gradient_is_that_of_the_likelihood():
    rng = np.random.default_rng(0)
    ids = [rng.integers(0, 50, 6).astype(np.int32) for _ in range(40)]
    dense, y = rng.random((40, ordinal.DENSE)).astype(np.float32), rng.integers(0, 4, 40)
    rows = np.arange(41) * 6

    def loss(m):
        return -np.log(m.probabilities(m.linear(np.concatenate(ids), rows, dense))[np.arange(40), y]).mean()

    start = loss(ordinal.Model(4))
    assert loss(ordinal.fit_rows(ids, dense, y, 4, epochs=60)) < 0.5 * start


def test_odd_rows_and_few_ratings(spark, odd):
    ratings = spark.createDataFrame([(4, 1), (None, 0), (5, None), (7, 0)], "doc_id long, g int")
    for some in (ratings, ratings.limit(1), ratings.limit(0)):
        out = ordinal.select(ordinal.score(odd, ordinal.fit(odd, some, F.col("g")))).collect()
        assert len(out) == odd.count() and all(0 <= r.p_tail <= 1 for r in out)
    assert ordinal.score(odd.limit(0), ordinal.fit(odd.limit(0), ratings, F.col("g"))).count() == 0


def test_features_of_rows_do_not_mix():
    texts = ["a a b", None, "", "B b b ***", "a a b"]
    ids, rows, dense = ordinal.features(*text_buffer(pa.array(texts)))
    assert np.diff(rows).tolist() == [3, 0, 0, 4, 3]
    assert (dense[0] == dense[4]).all() and (ids[rows[0] : rows[1]] == ids[rows[4] : rows[5]]).all()
    assert np.isclose(dense[0, 256], 1 / 3) and np.isclose(dense[0, 257], 1 / 3) and np.isclose(dense[3, 257], 0.5)
    assert dense[1, :256].sum() == 0


def by_hand(model, grades, text):
    """Expected grade and tail probabilities of one text."""
    data = (text or "").encode()
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w]
    hashes = [int(range_hashes(np.frombuffer(w.encode(), np.uint8), np.array([0]), np.array([len(w.encode())]))[0]) for w in words]
    dense = [np.sqrt(data.count(bytes([k])) / max(1, len(data))) for k in range(256)]
    dense += [sum(a == b for a, b in zip(words, words[1:], strict=False)) / max(1, len(words)), 1 - len(set(words)) / max(1, len(words)), np.log1p(len(words)) / 10, 1]
    z = sum(float(model.w[h % ordinal.BUCKETS]) for h in hashes) / np.sqrt(max(1, len(words))) + float(np.dot(model.d, dense))
    below = [1 / (1 + np.exp(-(t - z))) for t in model.thresholds()]
    p = np.diff([0, *below, 1])
    return float(p @ grades), [float(p[k:].sum()) for k in range(1, len(grades))]


def test_the_query(spark):
    folder = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    got = {r.doc_id: r for r in ordinal.op6_ordinal_quality(spark, folder).collect()}
    texts = {r.doc_id: r.text for r in docs.collect()}
    fitted = ordinal.fit(docs, labels, ordinal.grade_of())
    assert set(got) == set(texts) and fitted.grades == [0, 1, 2]
    for k in sorted(texts, key=lambda k: len(texts[k] or ""))[:800:8]:
        e, tails = by_hand(fitted.model, fitted.grades, texts[k])
        r = got[k]
        assert max(abs(r.expected_grade - e), abs(r.p_tail - tails[0]), abs(r.p_top - tails[1])) < 1e-4, k
    assert all(r.held_out == (zlib.crc32(str(k).encode()) % 5 == 0) and r.kept == (r.p_tail >= ordinal.CUTOFF) for k, r in got.items())
    held = [(got[r.doc_id].p_tail, r.quality) for r in labels.collect() if got[r.doc_id].held_out]
    s, y = (np.array(x) for x in zip(*held, strict=True))
    assert (s[y == 1][:, None] > s[y == 0][None]).mean() > 0.9
