"""Ordinal quality by cumulative-link regression on graded ratings.

P(grade <= k) = 1 / (1 + exp(-(t_k - w.x))) with one weight vector w for all grades and ordered
thresholds t_0 < t_1 < ... (each the one before plus the exponential of a parameter). A text's
vector x is hashed: its lower-case words `[^\\x20\\x09-\\x0D]+`, the shares of its bytes, the share of words that repeat the word
before, and of words seen before. The fit is Adagrad in numpy on at most `most` rated rows (those smallest by a
hash of their id, never those whose crc32 of the id as text is divisible by 5) with at most MOST_WORDS words together, whole texts of them.

Scores are the expected grade and tail probabilities P(grade >= k); selection takes texts whose tail
probability is at least a cutoff. Null and empty texts have the vector of no words. Null ids are scored and never
learned from; of a document's repeated ratings the smallest counts; repeated rows get equal scores.
With fewer than two different grades every text gets the one grade (or 0 without any rating).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from orrery.llm.shared import table
from orrery.llm.textbytes import LOWER, WHITE, blocks, range_hashes, word_ranges
from orrery.llm.toxicity import bounded, held_out

BUCKETS = 1 << 18
DENSE = 256 + 4
MOST, MOST_WORDS = 6000, 40_000_000
EPOCHS, BATCH, RATE, DECAY = 8, 64, 0.3, 1e-6
CUTOFF = 0.5


def features(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashed words, offsets of each row's words, and a dense part by row: byte shares, repeats, bias."""
    low, n = LOWER[raw], len(off) - 1
    starts, stops, rows = word_ranges(low, off, WHITE)
    h = range_hashes(low, starts, stops)
    ids = (h % np.uint64(BUCKETS)).astype(np.int32)
    dense = np.zeros((n, DENSE), np.float32)
    owner = np.repeat(np.arange(n), np.diff(off))
    counts = np.bincount(owner * 256 + raw, minlength=256 * n).reshape(n, 256) if len(raw) else np.zeros((n, 256))
    dense[:, :256] = np.sqrt(counts / np.maximum(1, np.diff(off))[:, None])
    words = np.diff(rows)
    if len(h):
        row = np.repeat(np.arange(n), words)
        again = np.zeros(len(h))
        again[1:] = (h[1:] == h[:-1]) & (row[1:] == row[:-1])
        distinct = _distinct(row, h)
        dense[:, 256] = np.bincount(row, again, n) / np.maximum(1, words)
        dense[:, 257] = 1 - np.bincount(distinct, minlength=n) / np.maximum(1, words)
    dense[:, 258] = np.log1p(words) / 10
    dense[:, 259] = 1
    return ids, rows, dense


def _distinct(row: np.ndarray, h: np.ndarray) -> np.ndarray:
    """The row of each distinct word of each row."""
    order = np.lexsort((h, row))
    r, x = row[order], h[order]
    new = np.ones(len(r), bool)
    new[1:] = (r[1:] != r[:-1]) | (x[1:] != x[:-1])
    return r[new]


class Model:
    def __init__(self, grades: int):
        self.w = np.zeros(BUCKETS, np.float32)
        self.d = np.zeros(DENSE, np.float32)
        self.t = np.concatenate([[-(grades - 2) / 2.0], np.zeros(grades - 2)]).astype(np.float64)  # the first, then logarithms of steps

    def thresholds(self) -> np.ndarray:
        return np.concatenate([self.t[:1], self.t[0] + np.cumsum(np.exp(self.t[1:]))])

    def linear(self, ids: np.ndarray, rows: np.ndarray, dense: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0.0], np.cumsum(self.w[ids], dtype=np.float64)])
        return (total[rows[1:]] - total[rows[:-1]]) / np.sqrt(np.maximum(1, np.diff(rows))) + dense @ self.d

    def below(self, z: np.ndarray) -> np.ndarray:
        """P(grade <= k) for k below the highest grade."""
        return 1 / (1 + np.exp(-np.clip(self.thresholds()[None] - z[:, None], -30, 30)))

    def probabilities(self, z: np.ndarray) -> np.ndarray:
        c = np.concatenate([np.zeros((len(z), 1)), self.below(z), np.ones((len(z), 1))], axis=1)
        return np.maximum(np.diff(c, axis=1), 1e-12)


def fit_rows(ids: list[np.ndarray], dense: np.ndarray, y: np.ndarray, grades: int, epochs: int = EPOCHS, seed: int = 11) -> Model:
    model, rng = Model(grades), np.random.default_rng(seed)
    gw, gd, gt = np.full(BUCKETS, 1e-6, np.float32), np.full(DENSE, 1e-6, np.float32), np.full(grades - 1, 1e-6)
    for _ in range(epochs):
        order = rng.permutation(len(y))
        for a in range(0, len(order), BATCH):
            part = order[a : a + BATCH]
            sizes = np.array([len(ids[k]) for k in part])
            rows = np.concatenate([[0], np.cumsum(sizes)])
            flat = np.concatenate([ids[k] for k in part]) if sizes.sum() else np.zeros(0, np.int32)
            z, yk, n = model.linear(flat, rows, dense[part]), y[part], len(part)
            below, p = model.below(z), model.probabilities(z)[np.arange(n), yk]
            slope = below * (1 - below)
            upper = np.where(yk < grades - 1, slope[np.arange(n), np.minimum(yk, grades - 2)], 0.0)
            lower = np.where(yk > 0, slope[np.arange(n), np.maximum(yk - 1, 0)], 0.0)
            dz = (upper - lower) / p / n  # of minus the log-likelihood
            dt = np.zeros(grades - 1)
            np.add.at(dt, np.minimum(yk, grades - 2), np.where(yk < grades - 1, -upper / p / n, 0.0))
            np.add.at(dt, np.maximum(yk - 1, 0), np.where(yk > 0, lower / p / n, 0.0))
            later = np.cumsum(dt[::-1])[::-1]
            step_t = np.concatenate([[later[0]], later[1:] * np.exp(model.t[1:])])
            touched, inverse = np.unique(flat, return_inverse=True)
            step_w = np.bincount(inverse, np.repeat(dz / np.sqrt(np.maximum(1, sizes)), sizes), len(touched)).astype(np.float32) + DECAY * model.w[touched] if len(touched) else np.zeros(0, np.float32)
            step_d = (dense[part].T @ dz).astype(np.float32)
            gw[touched] += step_w * step_w
            gd += step_d * step_d
            gt += step_t * step_t
            model.w[touched] -= RATE * step_w / np.sqrt(gw[touched])
            model.d -= RATE * step_d / np.sqrt(gd)
            model.t -= RATE * step_t / np.sqrt(gt)
    return model


class Fitted:
    def __init__(self, model: Model | None, grades: list[int]):
        self.model, self.grades = model, grades


def fit(docs: DataFrame, ratings: DataFrame, grade: Column, most: int = MOST) -> Fitted:
    """Fit on whole-number grades; the driver gets at most `most` rows and MOST_WORDS words."""
    rated = ratings.where(F.col("doc_id").isNotNull() & ~held_out()).select(F.col("doc_id").alias("_id"), grade.cast("long").alias("_g")).where("_g IS NOT NULL")
    chosen = rated.groupBy("_id").agg(F.min("_g").alias("_g")).orderBy(F.xxhash64("_id"), "_id").limit(most)
    rows = docs.select(F.col("doc_id").alias("_id"), "text").join(F.broadcast(chosen), "_id")  # at most `most` rows

    def run(batches):
        for batch in batches:
            words, parts = [], []
            for _, _, raw, off in blocks(batch.column(0)):
                ids, where, dense = features(raw, off)
                words += [ids[a:b].tobytes() for a, b in zip(where[:-1], where[1:], strict=True)]
                parts += [d.tobytes() for d in dense]
            yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(2), pa.array(words, pa.binary()), pa.array(parts, pa.binary())], names=["g", "id", "words", "dense"])

    schema = T.StructType([T.StructField("g", T.LongType()), T.StructField("id", docs.schema["doc_id"].dataType), T.StructField("words", T.BinaryType()), T.StructField("dense", T.BinaryType())])
    got = bounded(rows.select("text", "_g", "_id").mapInArrow(run, schema), most, "words", 4 * MOST_WORDS)
    grades = sorted({r["g"] for r in got})
    if len(grades) < 2:
        return Fitted(None, grades or [0])
    y = np.array([grades.index(r["g"]) for r in got])
    return Fitted(fit_rows([np.frombuffer(r["words"], np.int32) for r in got], np.stack([np.frombuffer(r["dense"], np.float32) for r in got]), y, len(grades)), grades)


def score(docs: DataFrame, fitted: Fitted) -> DataFrame:
    """doc_id, expected_grade, and tails: P(grade >= g) for each grade but the lowest, in order."""
    held = docs.sparkSession.sparkContext.broadcast(fitted)  # of the model's fixed size

    def run(batches):
        model, grades = held.value.model, np.array(held.value.grades, float)
        for batch in batches:
            expected, tails = [], []
            for a, b, raw, off in blocks(batch.column(1)):
                if model is None:
                    p = np.ones((b - a, 1))
                else:
                    p = model.probabilities(model.linear(*features(raw, off)))
                    p /= p.sum(axis=1, keepdims=True)
                expected.append(p @ grades)
                tails.append(np.cumsum(p[:, ::-1], axis=1)[:, ::-1][:, 1:])
            e = np.concatenate(expected) if expected else np.zeros(0)
            t = np.clip(np.concatenate(tails), 0, 1) if tails else np.zeros((0, max(0, len(grades) - 1)))
            offsets = np.arange(len(e) + 1, dtype=np.int32) * t.shape[1]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(e), pa.ListArray.from_arrays(pa.array(offsets), pa.array(t.reshape(-1)))], names=["doc_id", "expected_grade", "tails"])

    schema = T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("expected_grade", T.DoubleType()), T.StructField("tails", T.ArrayType(T.DoubleType()))])
    return docs.select("doc_id", "text").mapInArrow(run, schema)


def grade_of(quality: str = "quality", toxic: str = "toxic") -> Column:
    """Grades of the test labels: 0 poor, 1 good but toxic, 2 good; a null mark of toxicity is none."""
    return F.when(F.col(quality).isNotNull(), F.col(quality) * (2 - F.coalesce(F.col(toxic), F.lit(0))))


def select(scores: DataFrame, cutoff: float = CUTOFF, at: int = 0) -> DataFrame:
    """With p_tail, the chance of more than the grade numbered `at`, and kept: whether that is `cutoff` or more (true where there is one grade only)."""
    tail = F.coalesce(F.get("tails", F.lit(at)), F.lit(1.0))
    return scores.withColumn("p_tail", tail).withColumn("kept", tail >= cutoff)


def op6_ordinal_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = select(score(docs, fit(docs, table(spark, sf_dir, "labels"), grade_of())))
    return out.select("doc_id", held_out().alias("held_out"), "expected_grade", "p_tail", F.coalesce(F.get("tails", F.lit(1)), F.lit(1.0)).alias("p_top"), "kept")
