"""A convolutional text classifier for toxicity, trained in numpy.

Words (lower-cased, `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`) are hashed twice, and a word's vector is the
sum of two rows of the embedding, so that one shared bucket does not make two words alike. Filters of
several widths slide over the whole text, each is pooled by its maximum, and a logistic layer scores
the pooled values. A score depends on the text alone. Thresholds of the flag are calibrated by
language on labelled rows that training has not seen; the score and `predicted` know no language.

It learns from the whole texts of all labelled rows, never from rows whose crc32 of the id as text is divisible by 5.
They are dealt by a hash of their id into groups of about GROUP labels, files of the shared folder. In each of EPOCHS
rounds a task goes through a group's file from the model of the round before, and the groups' models are averaged: a row of the
embedding over the groups that changed it, all else over all groups. A single group goes through its epochs in one
round. Every fifth row of a group is kept from training; all of these give the thresholds. Null and empty texts get the
score of a text in which no filter fires. Rows with a null id are scored, and neither learned from nor
held out. Repeated rows get equal scores; of a document's repeated labels the largest counts. Without
any label of one of the two classes all scores are the share of the positive class, or 0.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from orrery.llm.shared import file_system, open_input, open_output, release, shared_dir, table, written
from orrery.llm.textbytes import LOWER, PUNCT, blocks, range_hashes, word_ranges

BUCKETS = 1 << 16
DIM = 12
WIDTHS = (1, 2, 3)
FILTERS = 8
EPOCHS = 5
#: Steps of training at least; few rows are gone through more often.
LEAST_STEPS = 150
BATCH = 32
RATE = 0.05
#: Labels of a group, about.
GROUP = 6000
#: Rows and words after which a block of a group's file ends; words after which a batch ends.
BLOCK_ROWS, BLOCK_WORDS, BATCH_WORDS = 2048, 1 << 20, 1 << 19
#: Slots of the bitmap of labelled ids, which keeps most texts without a label from the shuffle.
SLOTS = 1 << 26
#: Tasks among which the rows of the embedding are dealt when models are averaged.
SLICES = 32
#: Steps from 0 to 1 by which the scores of rows kept from training are counted.
SCORE_STEPS = 4096
#: Rows and words that sample() takes.
MAX_LABELLED, MAX_WORDS = 6000, 20_000_000
HELD_OUT_EVERY = 5
#: Least labelled rows of a class for a threshold of a language's own.
LEAST_OF_CLASS = 20
_SECOND = np.uint64(0xD6E8FEB86659FD93)


def word_ids(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two bucket numbers for each word, and the offsets of each row's words."""
    low = LOWER[raw]
    starts, stops, rows = word_ranges(low, off, PUNCT)
    h = range_hashes(low, starts, stops)
    return np.stack([h % np.uint64(BUCKETS), ((h * _SECOND) >> np.uint64(40)) % np.uint64(BUCKETS)]).astype(np.int32), rows


def shifted(ids: np.ndarray, rows: np.ndarray, j: int) -> np.ndarray:
    """The ids j words ahead; BUCKETS (no word) beyond a row's end."""
    if not j:
        return ids
    out = np.full_like(ids, BUCKETS)
    out[:, :-j] = ids[:, j:]
    ends = rows[1:]
    for d in range(1, j + 1):
        at = ends - d
        at = at[(at >= rows[:-1])]
        out[:, at] = BUCKETS
    return out


def pooled(tables: dict, ids: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Each row's maximum of each filter; 0 for rows without words."""
    out = np.zeros((len(rows) - 1, FILTERS * len(WIDTHS)), np.float32)
    some = np.flatnonzero(np.diff(rows))
    if not len(some):
        return out
    ahead = [shifted(ids, rows, j) for j in range(max(WIDTHS))]
    for n, w in enumerate(WIDTHS):
        act = None
        for j in range(w):
            t = tables[w, j]
            part = t[0].take(ahead[j][0], axis=0)
            part += t[1].take(ahead[j][1], axis=0)
            act = part if act is None else act + part
        out[some, n * FILTERS : (n + 1) * FILTERS] = np.maximum.reduceat(act, rows[:-1][some], axis=0)
    return out


class Model:
    def __init__(self, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.p = {"E": rng.normal(0, 0.03, (2, BUCKETS + 1, DIM)).astype(np.float32), "out": rng.normal(0, 0.1, FILTERS * len(WIDTHS)).astype(np.float32), "bias": np.zeros(1, np.float32)}
        self.p["E"][:, BUCKETS] = 0
        for w in WIDTHS:
            self.p[f"W{w}"] = rng.normal(0, 0.3, (w, DIM, FILTERS)).astype(np.float32)
            self.p[f"b{w}"] = np.zeros(FILTERS, np.float32)

    def tables(self) -> dict:
        return {(w, j): self.p["E"] @ self.p[f"W{w}"][j] for w in WIDTHS for j in range(w)}

    def head(self, features: np.ndarray) -> np.ndarray:
        bias = np.concatenate([self.p[f"b{w}"] for w in WIDTHS])
        z = np.maximum(features + bias, 0) @ self.p["out"] + self.p["bias"]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))

    def step(self, ids: np.ndarray, rows: np.ndarray, y: np.ndarray, weight: np.ndarray, state: dict, rate: float) -> None:
        """One step of Adagrad on a batch of documents that all have words."""
        p, n = self.p, len(rows) - 1
        ahead = [shifted(ids, rows, j) for j in range(max(WIDTHS))]
        used = np.unique(np.concatenate([ids[0], ids[1] + BUCKETS + 1, [BUCKETS, 2 * BUCKETS + 1]]))
        flat = p["E"].reshape(-1, DIM)
        features, places = np.empty((n, FILTERS * len(WIDTHS)), np.float32), {}
        position = np.empty(2 * BUCKETS + 2, np.int32)
        position[used] = np.arange(len(used))
        small = [(position[a[0]], position[a[1] + BUCKETS + 1]) for a in ahead]
        rowid = np.repeat(np.arange(n), np.diff(rows))
        for k, w in enumerate(WIDTHS):
            act = None
            for j in range(w):
                t = flat[used] @ p[f"W{w}"][j]
                part = t[small[j][0]] + t[small[j][1]]
                act = part if act is None else act + part
            top = np.maximum.reduceat(act, rows[:-1], axis=0)
            features[:, k * FILTERS : (k + 1) * FILTERS] = top
            at = np.full((n, FILTERS), -1, np.int64)
            r, f = np.nonzero(act == top[rowid])
            at[rowid[r], f] = r
            places[w] = at
        bias = np.concatenate([p[f"b{w}"] for w in WIDTHS])
        pre = features + bias
        hidden = np.maximum(pre, 0)
        score = 1 / (1 + np.exp(-np.clip(hidden @ p["out"] + p["bias"], -30, 30)))
        g = ((score - y) * weight / n).astype(np.float32)
        grad = {"out": hidden.T @ g, "bias": np.array([g.sum()], np.float32)}
        back = g[:, None] * p["out"][None] * (pre > 0)
        rows_touched, deltas = [], []
        for k, w in enumerate(WIDTHS):
            gf = back[:, k * FILTERS : (k + 1) * FILTERS]
            grad[f"b{w}"] = gf.sum(0)
            gw = np.zeros_like(p[f"W{w}"])
            d, f = np.nonzero(gf)
            at, gv = places[w][d, f], gf[d, f]
            for j in range(w):
                for s in range(2):
                    idx = ahead[j][s][at] + s * (BUCKETS + 1)
                    np.add.at(gw[j].T, f, gv[:, None] * flat[idx])
                    rows_touched.append(idx)
                    deltas.append(gv[:, None] * p[f"W{w}"][j].T[f])
            grad[f"W{w}"] = gw
        for name, value in grad.items():
            state[name] = state.get(name, 1e-8) + value * value
            p[name] -= rate * value / np.sqrt(state[name])
        if rows_touched:
            idx, inv = np.unique(np.concatenate(rows_touched), return_inverse=True)
            total = np.zeros((len(idx), DIM), np.float32)
            np.add.at(total, inv, np.concatenate(deltas))
            total[(idx == BUCKETS) | (idx == 2 * BUCKETS + 1)] = 0
            held = state.setdefault("E", np.full((2 * BUCKETS + 2, DIM), 1e-8, np.float32))
            held[idx] += total * total
            flat[idx] -= rate * total / np.sqrt(held[idx])


def initial(seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """A new model and the state of its Adagrad as numbers: a row for each row of the embedding with its state, and all else with its state."""
    p = Model(seed).p
    flat = p["E"].reshape(-1, DIM)
    rest = np.concatenate([p[k].ravel() for k in p if k != "E"])
    return np.hstack([flat, np.full_like(flat, 1e-8)]), np.stack([rest, np.full_like(rest, 1e-8)])


def model_of(rows: np.ndarray, rest: np.ndarray) -> tuple[Model, dict]:
    """The model and the state that such numbers stand for."""
    model, state, at = Model(), {}, 0
    for name, value in model.p.items():
        if name == "E":
            model.p[name], state[name] = rows[:, :DIM].reshape(value.shape).copy(), rows[:, DIM:].copy()
        else:
            model.p[name], state[name] = (x[at : at + value.size].reshape(value.shape).copy() for x in rest)
            at += value.size
    return model, state


def numbers_of(model: Model, state: dict) -> tuple[np.ndarray, np.ndarray]:
    names = [k for k in model.p if k != "E"]
    return np.hstack([model.p["E"].reshape(-1, DIM), state["E"]]), np.stack([np.concatenate([x[k].ravel() for k in names]) for x in (model.p, state)])


_ROWS = pa.schema([("toxic", pa.float32()), ("lang", pa.string()), ("words", pa.large_binary())])


def read_group(path: str) -> Iterator[tuple[np.ndarray, list, list[np.ndarray], np.ndarray]]:
    """A group's blocks: labels, languages, both bucket numbers of each row's words, and the rows' places in the group."""
    at = 0
    with open_input(path) as f, pa.ipc.open_stream(f) as blocks_:
        for block in blocks_:
            ids = [np.frombuffer(x.as_buffer(), np.uint16).reshape(2, -1) if x.as_buffer().size else np.zeros((2, 0), np.uint16) for x in block.column("words")]
            yield block.column("toxic").to_numpy(), block.column("lang").to_pylist(), ids, np.arange(at, at + len(ids))
            at += len(ids)


def together(ids: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    return np.concatenate(ids, axis=1).astype(np.int32), np.concatenate([[0], np.cumsum([x.shape[1] for x in ids])])


def train_group(path: str, numbers: tuple[np.ndarray, np.ndarray], share: float, apart: bool, epochs: int, seed: list[int], rate: float = RATE) -> tuple[np.ndarray, np.ndarray]:
    """Go through a group from a model's numbers, in batches of BATCH rows of a block; with `apart`, not through every fifth row."""
    model, state = model_of(*numbers)
    rng = np.random.default_rng(seed)
    heavy = min(3.0, 0.5 / share)
    for _ in range(epochs):
        for y, _, ids, at in read_group(path):
            some = np.flatnonzero(np.array([x.shape[1] > 0 for x in ids]) & ((at % 5 != 0) | (not apart)))
            part, words = [], 0
            for k in [*rng.permutation(some).tolist(), None]:
                if part and (k is None or len(part) == BATCH or words + ids[k].shape[1] > BATCH_WORDS):
                    model.step(*together([ids[i] for i in part]), y[part], np.where(y[part] == 1, heavy, 1.0).astype(np.float32), state, rate)
                    part, words = [], 0
                if k is not None:
                    part.append(k)
                    words += ids[k].shape[1]
    return numbers_of(model, state)


def held_out(id_col: str = "doc_id") -> Column:
    """Whether the crc32 of the id as text is divisible by 5; false for a null id."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % HELD_OUT_EVERY == 0, F.lit(False))


def bounded(rows: DataFrame, most: int, words: str, most_bytes: int) -> list:
    """At most `most` rows by hash of id, with `words` of at most `most_bytes` together; the rows are written first, so that the driver sees sizes before it takes any."""
    held = written(rows, "sample")
    sizes = held.groupBy("id", F.length(words).alias("n")).agg(F.count("*").alias("c"))
    fits, used = [], 0
    for r in sizes.orderBy(F.xxhash64("id"), "id", "n").limit(most).collect():
        if used + r["n"] * r["c"] <= most_bytes:
            used += r["n"] * r["c"]
            fits.append((r["id"], r["n"]))
    wanted = held.sparkSession.createDataFrame(fits, T.StructType([T.StructField("_id", rows.schema["id"].dataType), T.StructField("_n", T.IntegerType())]))
    kept = held.join(F.broadcast(wanted), (F.col("id") == F.col("_id")) & (F.length(words) == F.col("_n")))  # `wanted` has at most `most` rows
    return kept.orderBy(F.xxhash64("id"), "id", words).limit(most).collect()


def sample(docs: DataFrame, labels: DataFrame, most: int = MAX_LABELLED, most_words: int = MAX_WORDS) -> list:
    """Rows (lang, toxic, both bucket numbers of all words) of at most `most` labelled documents with at most `most_words` words: to look at what is learned from; fit() takes all of them, by groups()."""
    label = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out()).groupBy(F.col("doc_id").alias("_id")).agg(F.max("toxic").alias("toxic"))
    chosen = label.orderBy(F.xxhash64("_id"), "_id").limit(most)
    rows = docs.select(F.col("doc_id").alias("_id"), "text", F.col("lang").cast("string").alias("lang")).join(F.broadcast(chosen), "_id")  # at most `most` rows

    def run(batches):
        for batch in batches:
            found: list[bytes] = []
            for _, _, raw, off in blocks(batch.column(0)):
                ids, where = word_ids(raw, off)
                found += [np.ascontiguousarray(ids[:, a:b]).tobytes() for a, b in zip(where[:-1], where[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(found, pa.binary())], names=["lang", "toxic", "id", "words"])

    kinds = T.StructType([T.StructField("lang", T.StringType()), T.StructField("toxic", labels.schema["toxic"].dataType), T.StructField("id", docs.schema["doc_id"].dataType), T.StructField("words", T.BinaryType())])
    return bounded(rows.select("text", "lang", "toxic", F.col("_id").alias("id")).mapInArrow(run, kinds), most, "words", 8 * most_words)


def may_be_labelled(label: DataFrame) -> np.ndarray:
    """A bitmap of SLOTS slots with those of all ids of `label` set; of one size whatever the input's."""
    slot = F.pmod(F.xxhash64("_id"), F.lit(SLOTS))
    wide = 1 << 15  # bits of one bitmap of Spark's
    out = np.zeros(SLOTS // 8, np.uint8)
    for r in label.groupBy(F.floor(slot / wide).alias("b")).agg(F.bitmap_construct_agg(slot % wide).alias("m")).toLocalIterator():
        out[r["b"] * wide // 8 : (r["b"] + 1) * wide // 8] = np.frombuffer(r["m"], np.uint8)
    return out


def groups(docs: DataFrame, labels: DataFrame, folder: str) -> list:
    """All labelled rows as files of the folder, a file for a group; one row per file, with numbers of what is in it.

    Labels and texts that may have one go through one shuffle by group and meet in the order of a hash of their id.
    """
    spark, kind = docs.sparkSession, docs.schema["doc_id"].dataType
    label = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out()).groupBy(F.col("doc_id").cast(kind).alias("_id")).agg(F.max("toxic").cast("float").alias("toxic"))
    label = written(label, "labels")
    count = max(1, -(-label.count() // GROUP))
    bits = spark.sparkContext.broadcast(may_be_labelled(label))  # SLOTS bits

    def words(batches):
        for batch in batches:
            slot = batch.column(0).to_numpy()
            keep = pa.array(bits.value[slot >> 3] >> (slot & 7).astype(np.uint8) & 1 == 1)
            few = batch.filter(keep)
            found: list[bytes] = []
            for _, _, raw, off in blocks(few.column(3)):
                ids, where = word_ids(raw, off)
                ids = ids.astype(np.uint16)
                found += [np.ascontiguousarray(ids[:, a:b]).tobytes() for a, b in zip(where[:-1], where[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([few.column(1), few.column(2), pa.array(found, pa.binary())], names=["_id", "lang", "words"])

    def write(batches):
        writer, stream, now, name, held, size, seen = None, None, None, "", [], 0, None

        def flush():
            nonlocal held, size
            if held:
                writer.write_batch(pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), _ROWS.types, strict=True)], schema=_ROWS))
            held, size = [], 0

        def end():
            if writer is None:
                return
            flush()
            writer.close()
            stream.close()
            yield pa.RecordBatch.from_pylist([seen | {"file": name}])

        own = None
        for batch in batches:
            for g, key, toxic, lang, data in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if data is None:
                    own = (key, toxic)
                elif own is not None and own[0] == key:
                    if g != now:
                        yield from end()
                        now, name = g, f"{g:06d}-{uuid.uuid4().hex[:12]}"
                        stream = open_output(f"{folder}/{name}")
                        writer = pa.ipc.new_stream(stream, _ROWS, options=pa.ipc.IpcWriteOptions(compression="zstd"))
                        seen = {"rows": 0, "low": own[1], "high": own[1], "total": 0.0, "apart": 0, "learn_low": None, "learn_high": None, "learn_total": 0.0, "some": 0, "learn_some": 0}
                    y = own[1]
                    seen |= {"low": min(seen["low"], y), "high": max(seen["high"], y), "total": seen["total"] + y, "some": seen["some"] + bool(data)}
                    if seen["rows"] % 5:
                        first = seen["learn_low"] is None
                        seen |= {"learn_low": y if first else min(seen["learn_low"], y), "learn_high": y if first else max(seen["learn_high"], y), "learn_total": seen["learn_total"] + y, "learn_some": seen["learn_some"] + bool(data)}
                    else:
                        seen["apart"] += 1
                    seen["rows"] += 1
                    held.append((y, lang, data))
                    size += len(data) // 4
                    if len(held) >= BLOCK_ROWS or size >= BLOCK_WORDS:
                        flush()
        for last in end():
            yield last

    may = docs.where(F.col("doc_id").isNotNull() & ~held_out()).select(F.pmod(F.xxhash64("doc_id"), F.lit(SLOTS)).alias("slot"), "doc_id", F.col("lang").cast("string").alias("lang"), "text")
    found = may.mapInArrow(words, T.StructType([T.StructField("_id", kind), T.StructField("lang", T.StringType()), T.StructField("words", T.BinaryType())]))
    both = label.select("_id", "toxic", F.lit(None).cast("string").alias("lang"), F.lit(None).cast("binary").alias("words")).union(found.select("_id", F.lit(None).cast("float"), "lang", "words"))
    order = F.xxhash64("_id")
    both = both.withColumn("g", F.pmod(order, F.lit(count))).repartition(count, "g").sortWithinPartitions("g", order, "_id", F.col("words").asc_nulls_first(), "lang")
    schema = "rows long, low double, high double, total double, apart long, learn_low double, learn_high double, learn_total double, some long, learn_some long, file string"
    out = both.select("g", "_id", "toxic", "lang", "words").mapInArrow(write, schema).collect()
    bits.destroy()
    release(label)
    return sorted(out, key=lambda r: r["file"])


def averaged(spark: SparkSession, paths: list[str], before: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The mean of the groups' numbers; a row of the embedding over those groups that changed it."""
    rows, rest = before
    bounds = np.linspace(0, len(rows), SLICES + 1).astype(int).tolist()
    base, width = spark.sparkContext.broadcast(rows), rows.shape[1]

    def run(batches):
        for batch in batches:
            for k in batch.column(0).to_pylist():
                a, b = (bounds[k], bounds[k + 1]) if k < SLICES else (0, 0)
                own, total, changes, more = base.value[a:b], np.zeros((b - a, width)), np.zeros(b - a), np.zeros(rest.shape)
                for path in paths:
                    with open_input(path) as f:
                        if k == SLICES:
                            more += np.frombuffer(f.read_at(4 * rest.size, 4 * rows_size), np.float32).reshape(rest.shape)
                            continue
                        part = np.frombuffer(f.read_at(4 * width * (b - a), 4 * width * a), np.float32).reshape(-1, width)
                    other = (part != own).any(axis=1)
                    total[other] += part[other]
                    changes += other
                mean = np.where(changes[:, None] > 0, total / np.maximum(1, changes)[:, None], own) if k < SLICES else more / len(paths)
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int64()), pa.array([mean.astype(np.float32).tobytes()], pa.binary())], names=["k", "data"])

    rows_size, out = rows.size, np.empty_like(rows)
    for r in spark.range(0, SLICES + 1, 1, SLICES + 1).mapInArrow(run, "k long, data binary").collect():  # the model, of one size
        if r["k"] == SLICES:
            rest = np.frombuffer(r["data"], np.float32).reshape(rest.shape)
        else:
            out[bounds[r["k"]] : bounds[r["k"] + 1]] = np.frombuffer(r["data"], np.float32).reshape(-1, width)
    base.destroy()
    return out, rest


def train(spark: SparkSession, folder: str, files: list[str], rows: int, share: float, apart: bool, epochs: int = EPOCHS, seed: int = 7) -> Model:
    """Fit on all groups' files, that have `rows` rows with words to learn from, of which `share` are toxic."""
    numbers = initial(seed)
    rounds = epochs if len(files) > 1 else 1
    each = max(epochs, -(-LEAST_STEPS // max(1, -(-rows // BATCH)))) // rounds
    for turn in range(rounds):
        held, made = spark.sparkContext.broadcast(numbers), f"{folder}/turn-{turn}"

        def run(batches, held=held, made=made, turn=turn):
            for batch in batches:
                for k in batch.column(0).to_pylist():
                    path = f"{made}/{k:06d}-{uuid.uuid4().hex[:12]}"
                    with open_output(path) as f:
                        for x in train_group(f"{folder}/{files[k]}", held.value, share, apart, each, [seed, turn, k]):
                            f.write(np.ascontiguousarray(x, np.float32).tobytes())
                    yield pa.RecordBatch.from_arrays([pa.array([path])], names=["path"])

        paths = sorted(r["path"] for r in spark.range(0, len(files), 1, len(files)).mapInArrow(run, "path string").collect())
        numbers = averaged(spark, paths, numbers)
        held.destroy()
        system, at = file_system(made)
        system.delete_dir(at)
    return model_of(*numbers)[0]


def score_rows(model: Model, tables: dict, ids: np.ndarray, rows: np.ndarray) -> np.ndarray:
    return model.head(pooled(tables, ids, rows))


def best_cut(low: np.ndarray, high: np.ndarray, n: np.ndarray, hits: np.ndarray) -> float:
    """The score from which F1 is largest, between steps of scores (ascending; each with its least and largest score, rows and positive rows); of equal ones the one nearest to 0.5."""
    low, high, n, hits = (np.asarray(x, float)[::-1] for x in (low, high, n, hits))
    f1 = 2 * np.cumsum(hits) / (np.cumsum(n) + hits.sum())
    cuts = np.append((low[:-1] + high[1:]) / 2, low[-1] / 2)[f1 >= f1.max() - 1e-12]
    return float(cuts[np.argmin(np.abs(cuts - 0.5))])


def best_threshold(scores: np.ndarray, y: np.ndarray) -> float:
    """The score from which F1 is largest; of equal ones the one nearest to 0.5."""
    s, where = np.unique(scores, return_inverse=True)
    return best_cut(s, s, np.bincount(where), np.bincount(where, y))


def calibrated(spark: SparkSession, folder: str, files: list[str], model: Model) -> dict[str, float]:
    """Thresholds of the languages with enough rows of both classes, from all rows that were kept from training; scores are counted in SCORE_STEPS steps."""
    held = spark.sparkContext.broadcast((model.p, model.tables()))  # of the model's fixed size

    def run(batches):
        scorer = Model.__new__(Model)
        scorer.p, tables = held.value
        for batch in batches:
            for k in batch.column(0).to_pylist():
                for y, lang, ids, at in read_group(f"{folder}/{files[k]}"):
                    own = np.flatnonzero(at % 5 == 0)
                    if len(own):
                        scores = np.concatenate([score_rows(scorer, tables, *together([ids[i]])) for i in own])
                        yield pa.RecordBatch.from_arrays([pa.array([lang[i] for i in own], pa.string()), pa.array(scores.astype(np.float64)), pa.array(y[own].astype(np.float64))], names=["lang", "score", "toxic"])

    rows = spark.range(0, len(files), 1, len(files)).mapInArrow(run, "lang string, score double, toxic double").where("lang IS NOT NULL")
    steps = rows.groupBy("lang", F.floor(F.col("score") * SCORE_STEPS).alias("step")).agg(F.min("score").alias("low"), F.max("score").alias("high"), F.count("*").alias("n"), F.sum("toxic").alias("hits"))
    by = steps.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("low", "high", "n", "hits"))).alias("steps"), F.sum("n").alias("n"), F.sum("hits").alias("hits"))  # SCORE_STEPS at most
    enough = by.where(F.least(F.col("hits"), F.col("n") - F.col("hits")) >= LEAST_OF_CLASS)
    out = {r["lang"]: best_cut(*np.array(r["steps"], float).T) for r in enough.toLocalIterator()}
    held.destroy()
    return out


class Fitted:
    """A model's pooled tables and head, and the thresholds by language."""

    def __init__(self, model: Model | None, share: float, thresholds: dict[str, float]):
        self.model, self.share, self.thresholds = model, share, thresholds

    def tables(self) -> dict:
        return self.model.tables() if self.model else {}


def fit(docs: DataFrame, labels: DataFrame) -> Fitted:
    folder = shared_dir(docs.sparkSession, "toxicity")
    made = groups(docs, labels, folder)
    fitted = fit_groups(docs.sparkSession, folder, made)
    if made:
        system, at = file_system(folder)
        system.delete_dir(at)
    return fitted


def fit_groups(spark: SparkSession, folder: str, made: list) -> Fitted:
    rows, total = sum(r["rows"] for r in made), sum(r["total"] for r in made)
    if not rows or min(r["low"] for r in made) == max(r["high"] for r in made) or not any(r["some"] for r in made):
        return Fitted(None, total / rows if rows else 0.0, {})
    learned = [r for r in made if r["learn_low"] is not None]
    apart = sum(r["apart"] for r in made) >= 5 and min(r["learn_low"] for r in learned) < max(r["learn_high"] for r in learned) and any(r["learn_some"] for r in made)
    learn, positive, some = (sum(r["rows"] - r["apart"] for r in made), sum(r["learn_total"] for r in made), sum(r["learn_some"] for r in made)) if apart else (rows, total, sum(r["some"] for r in made))
    files = [r["file"] for r in made]
    model = train(spark, folder, files, some, positive / learn, apart)
    return Fitted(model, total / rows, calibrated(spark, folder, files, model) if apart else {})


def score(docs: DataFrame, fitted: Fitted) -> DataFrame:
    """One row per document: doc_id, score, and by its language threshold (0.5 where none was calibrated) and flagged."""
    spark = docs.sparkSession
    model, share = fitted.model, fitted.share
    small = None if model is None else {k: v for k, v in model.p.items() if k != "E"}
    held = spark.sparkContext.broadcast((small, fitted.tables()))  # of the model's fixed size

    def run(batches):
        head, tables = held.value
        scorer = Model.__new__(Model)
        scorer.p = head
        for batch in batches:
            found = []
            for a, b, raw, off in blocks(batch.column(1)):
                found.append(np.full(b - a, share) if head is None else score_rows(scorer, tables, *word_ids(raw, off)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(np.concatenate(found).astype(np.float64) if found else [], pa.float64())], names=["doc_id", "lang", "score"])

    schema = T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("lang", T.StringType()), T.StructField("score", T.DoubleType())])
    out = docs.select("doc_id", "text", F.col("lang").cast("string").alias("lang")).mapInArrow(run, schema)
    threshold = F.lit(0.5)
    if fitted.thresholds:
        known = F.create_map(*[F.lit(x) for pair in sorted(fitted.thresholds.items()) for x in pair])
        threshold = F.coalesce(F.try_element_at(known, F.coalesce("lang", F.lit(""))), threshold)
    return out.select("doc_id", "score", threshold.alias("threshold")).withColumn("flagged", F.col("score") >= F.col("threshold"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = score(docs, fit(docs, table(spark, sf_dir, "labels")))
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "threshold", "flagged")
