"""Benchmark decontamination by suffix arrays over shards of the documents.

A shard is a run of whole documents of one partition. Its words, numbered, are put in a suffix
array that is ordered by their first words (at least as many as a window has). Each suffix of a
benchmark item that holds a window is searched by bisection, which gives all places of its
window; places on one diagonal join into the longest verbatim matches, with their locations. A
document with a match is contaminated.

Words are `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` after A-Z is lower-cased, and told apart by 64-bit
hashes. A window has `window` words; an item of fewer, but not none, is one window. Null texts and
items have no words. Equal item ids count once for a document; a null item id is named null. Each row
is judged on its own, so ties and repeated rows need no rule. The benchmark is cut into blocks of about
BLOCK_BYTES of text, each a file of the shared folder, that tasks read one by one: there is one pass over the documents and one
suffix array for a shard, whatever the benchmark's size, and no task or driver holds more than HELD blocks. An empty one marks nothing.
"""

from __future__ import annotations

import pickle
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from orrery.llm import shared
from orrery.llm.shared import table
from orrery.llm.textbytes import LOWER, PUNCT, blocks, range_hashes, text_buffer, word_ranges

WINDOW = 10
#: Text of the benchmark that one block holds; in memory it is a few times this. A Python worker keeps HELD blocks.
BLOCK_BYTES, HELD = 8 << 20, 2


def words_of(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes, and the offsets of each row's words."""
    low = LOWER[raw]
    starts, stops, rows = word_ranges(low, off, PUNCT)
    return range_hashes(low, starts, stops), rows


class Items:
    """A block of the benchmark: words of all items, and every window of each."""

    def __init__(self, ids: list[str], hashes: np.ndarray, rows: np.ndarray, window: int = WINDOW):
        self.ids, self.hashes, self.rows = ids, hashes, rows
        item, start, size = [], [], []
        for k, n in enumerate(np.diff(self.rows).tolist()):
            if n:
                w = min(window, n)
                item.append(np.full(n - w + 1, k))
                start.append(np.arange(n - w + 1))
                size.append(np.full(n - w + 1, w))
        empty = np.zeros(0, np.int64)
        self.item, self.start, self.size = (np.concatenate(x) if x else empty for x in (item, start, size))


class SuffixArray:
    """Suffixes of a shard's words in order of their first `depth` words or more.

    Word numbers are from 1 in order of hash; 0 ends each document, so no match crosses documents.
    """

    def __init__(self, hashes: np.ndarray, rows: np.ndarray, depth: int):
        n_rows, n = len(rows) - 1, len(hashes)
        self.vocabulary, code = np.unique(hashes, return_inverse=True)
        self.starts = rows[:-1] + np.arange(n_rows)
        self.text = np.zeros(n + n_rows, np.int64)
        self.text[np.arange(n) + np.repeat(np.arange(n_rows), np.diff(rows))] = code + 1
        self.bits = max(1, int(len(self.vocabulary)).bit_length())
        self.per = max(1, min(depth, 63 // self.bits))
        key = self._packed()
        self.order = np.argsort(key)
        self.keys = key[self.order]
        self._refine(depth)

    def _packed(self) -> np.ndarray:
        t = self.text
        key = t << (self.bits * (self.per - 1))
        for j in range(1, self.per):
            key[:-j] |= t[j:] << (self.bits * (self.per - 1 - j))
        return key

    def _refine(self, depth: int) -> None:
        """Order groups of equal prefixes by twice as many words, until `depth`."""
        size = len(self.text)
        new = np.ones(size, bool)
        new[1:] = self.keys[1:] != self.keys[:-1]
        done = self.per
        while done < depth and size:
            tied = ~new
            tied[:-1] |= ~new[1:]
            at = np.flatnonzero(tied)
            if not len(at):
                break
            group = np.cumsum(new) - 1
            rank = np.zeros(size + done, np.int64)
            rank[self.order] = group + 1
            move = self.order[at]
            second = rank[move + done]
            again = np.argsort((group[at] << 32) | second)
            self.order[at] = move[again]
            pair = (group[at] << 32) | second[again]
            new[at[1:]] |= (pair[1:] != pair[:-1]) & ~new[at[1:]]
            done *= 2

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each row of word hashes, the range of suffixes that begin with it."""
        n, m = hashes.shape
        lo, hi = np.zeros(n, np.int64), np.zeros(n, np.int64)
        if not len(self.vocabulary) or not n:
            return lo, hi
        at = np.minimum(np.searchsorted(self.vocabulary, hashes), len(self.vocabulary) - 1)
        live = np.flatnonzero((self.vocabulary[at] == hashes).all(axis=1))
        code = at[live] + 1
        first = min(self.per, m)
        key = np.zeros(len(live), np.int64)
        for j in range(first):
            key |= code[:, j] << (self.bits * (self.per - 1 - j))
        room = (1 << (self.bits * (self.per - first))) - 1
        a, b = np.searchsorted(self.keys, key), np.searchsorted(self.keys, key | room, side="right")
        for d in range(first, m):
            some = a < b
            live, code, a, b = live[some], code[some], a[some], b[some]
            if not len(live):
                break
            a, b = self._bisect(a, b, code[:, d], d, False), self._bisect(a, b, code[:, d], d, True)
        lo[live], hi[live] = a, np.maximum(a, b)
        return lo, hi

    def _bisect(self, a: np.ndarray, b: np.ndarray, want: np.ndarray, d: int, right: bool) -> np.ndarray:
        """Within ranges that agree up to word d, where that word is no longer below (or above) `want`."""
        a, b = a.copy(), b.copy()
        last = len(self.text) - 1
        while (open_ := a < b).any():
            mid = (a + b) // 2
            # a suffix that ends before word d has ended at its 0, which is below every word
            word = self.text[np.minimum(self.order[np.minimum(mid, last)] + d, last)]
            go = open_ & ((word <= want) if right else (word < want))
            a = np.where(go, mid + 1, a)
            b = np.where(open_ & ~go, mid, b)
        return a


def search(shard: SuffixArray, items: Items) -> tuple[np.ndarray, np.ndarray]:
    """Windows and the places in the shard's words where they occur."""
    windows, places = [], []
    for m in np.unique(items.size).tolist():
        own = np.flatnonzero(items.size == m)
        at = items.rows[items.item[own]] + items.start[own]
        lo, hi = shard.find(items.hashes[at[:, None] + np.arange(m)])
        n = hi - lo
        windows.append(np.repeat(own, n))
        places.append(shard.order[np.repeat(lo, n) + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)])
    empty = np.zeros(0, np.int64)
    return (np.concatenate(windows), np.concatenate(places)) if windows else (empty, empty)


def longest(shard: SuffixArray, items: Items, windows: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Longest verbatim matches, by row: row, item, first word in the item, first word in the row, words."""
    item, start, size = items.item[windows], items.start[windows], items.size[windows]
    order = np.lexsort((start, places - start, item))
    item, start, size, place = item[order], start[order], size[order], places[order]
    new = np.ones(len(item), bool)
    new[1:] = (item[1:] != item[:-1]) | (place[1:] - start[1:] != place[:-1] - start[:-1]) | (start[1:] != start[:-1] + 1)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(item))[: len(first)] - 1
    row = np.searchsorted(shard.starts, place[first], side="right") - 1
    out = row, item[first], start[first], place[first] - shard.starts[row], start[last] - start[first] + size[last]
    order = np.lexsort((out[3], out[1], out[0]))
    return tuple(x[order] for x in out)


def shards(batches: Iterator[pa.RecordBatch], column: int, depth: int):
    """The batches' shards: batch, first row, end row, words by row, suffix array."""
    for batch in batches:
        for a, b, raw, off in blocks(batch.column(column)):
            hashes, rows = words_of(raw, off)
            yield batch, a, b, np.diff(rows), SuffixArray(hashes, rows, depth)


def write_blocks(benchmark: DataFrame, limit: int = BLOCK_BYTES) -> list[str]:
    """Blocks of the benchmark's words as files; their names, of which there is one for each `limit` bytes or partition."""
    spark = benchmark.sparkSession
    folder = shared.shared_dir(spark, "benchmark")
    rows = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("i"), "text")
    total = rows.agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + 16)).first()[0] or 0

    def run(batches):
        held: list[pa.RecordBatch] = []
        size = 0

        def put():
            nonlocal held, size
            rows_ = pa.Table.from_batches(held)
            file = f"{folder}/{uuid.uuid4().hex}"
            with shared.open_output(file) as stream:
                stream.write(pickle.dumps((rows_.column(0).to_pylist(), *words_of(*text_buffer(rows_.column(1))))))
            held, size = [], 0
            return pa.RecordBatch.from_pydict({"file": [file]})

        for batch in batches:
            ends = text_buffer(batch.column(1))[1][1:] + 16 * np.arange(1, batch.num_rows + 1)
            a = 0
            while a < batch.num_rows:
                b = max(a + 1, int(np.searchsorted(ends, limit - size + (ends[a - 1] if a else 0), side="right")))
                held.append(batch.slice(a, b - a))
                size += int(ends[b - 1] - (ends[a - 1] if a else 0))
                a = b
                if size >= limit or a < batch.num_rows:
                    yield put()
        if held:
            yield put()

    return [r["file"] for r in rows.coalesce(int(total // limit) + 1).mapInArrow(run, "file string").collect()]


_blocks: dict[tuple[str, int], Items] = {}


def blocks_of(files: list[str], window: int) -> Iterator[Items]:
    """The blocks in turn; those read last stay in the worker's memory."""
    for file in files:
        if (file, window) not in _blocks:
            while len(_blocks) >= HELD:
                _blocks.pop(next(iter(_blocks)))
            with shared.open_input(file) as source:
                _blocks[file, window] = Items(*pickle.loads(source.read()), window)
        yield _blocks[file, window]


MATCH = T.ArrayType(T.StructType([T.StructField("item_id", T.StringType()), *[T.StructField(c, T.LongType()) for c in ("item_word", "doc_word", "n_words")]]))


def find(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per document: doc_id, n_words, and matches (item_id, item_word, doc_word, n_words), all longest verbatim matches, in order of their place."""
    schema = T.StructType([T.StructField("doc_id", docs.schema[id_col].dataType), T.StructField("n_words", T.LongType()), T.StructField("matches", MATCH)])
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    files = write_blocks(benchmark, block_bytes)

    def run(batches):
        for batch, a, b, sizes, shard in shards(batches, 1, window):
            names: list[str] = []
            found = [(np.zeros(0, np.int64),) * 5]
            for items in blocks_of(files, window):
                row, item, item_word, doc_word, n = longest(shard, items, *search(shard, items))
                found.append((row, len(names) + np.arange(len(item)), item_word, doc_word, n))
                names += [items.ids[k] for k in item]
            row, name, item_word, doc_word, n = (np.concatenate(x) for x in zip(*found, strict=True))
            order = np.lexsort((item_word, doc_word, row))  # stable: ties stay in order of blocks and items
            entries = pa.StructArray.from_arrays([pa.array(names, pa.string()).take(pa.array(name[order])), *[pa.array(x[order].astype(np.int64)) for x in (item_word, doc_word, n)]], ["item_id", "item_word", "doc_word", "n_words"])
            offsets = np.searchsorted(row[order], np.arange(b - a + 1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(sizes.astype(np.int64)), pa.ListArray.from_arrays(pa.array(offsets), entries)], names=["doc_id", "n_words", "matches"])

    return source.mapInArrow(run, schema)


def clean(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The documents without a match, with all their columns."""
    at, files = docs.columns.index(text_col), write_blocks(benchmark, block_bytes)

    def run(batches):
        for batch, a, b, _, shard in shards(batches, at, window):
            keep = np.ones(b - a, bool)
            for items in blocks_of(files, window):
                _, places = search(shard, items)
                keep[np.searchsorted(shard.starts, places, side="right") - 1] = False
            yield batch.slice(a, b - a).filter(pa.array(keep))

    return docs.mapInArrow(run, docs.schema)


def hit_words(matches: str = "matches"):
    """How many words lie in any match."""
    spans = F.array_sort(F.transform(matches, lambda m: F.struct(m["doc_word"].alias("a"), (m["doc_word"] + m["n_words"]).alias("b"))))
    zero = F.lit(0).cast("long")
    return F.aggregate(
        spans,
        F.struct(zero.alias("end"), zero.alias("n")),
        lambda acc, s: F.struct(F.greatest(acc["end"], s["b"]).alias("end"), (acc["n"] + F.greatest(F.lit(0), s["b"] - F.greatest(s["a"], acc["end"]))).alias("n")),
    )["n"]


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    items = F.array_sort(F.array_distinct(F.transform("matches", lambda m: m["item_id"])))
    out = found.select("doc_id", "n_words", hit_words().alias("n_hit"), F.size(items).cast("long").alias("n_items"), F.sha2(F.array_join(items, ","), 256).alias("items_sha256"))
    return out.withColumn("contaminated", F.col("n_hit") > 0)


ORACLE_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), b AS (
  SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), bw AS (
  SELECT DISTINCT item, least(10, len(w)) AS m, array_to_string(w[i : i + least(10, len(w)) - 1], ' ') AS g FROM b, unnest(range(1, len(w) - least(10, len(w)) + 2)) t(i) WHERE len(w) > 0
), dw AS (
  SELECT doc_id, i, m, array_to_string(w[i : i + m - 1], ' ') AS g FROM (SELECT * FROM d, (SELECT DISTINCT m FROM bw) WHERE len(w) >= m), unnest(range(1, len(w) - m + 2)) t(i)
), hit AS (
  SELECT doc_id, i, m, item FROM dw JOIN bw USING (m, g)
), pos AS (
  SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + m)) AS p FROM hit) GROUP BY doc_id
), its AS (
  SELECT doc_id, count(DISTINCT item) AS n, string_agg(DISTINCT item, ',' ORDER BY item) AS s FROM hit GROUP BY doc_id
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(pos.n, 0) AS BIGINT) AS n_hit, CAST(coalesce(its.n, 0) AS BIGINT) AS n_items,
  sha256(coalesce(s, '')) AS items_sha256, coalesce(pos.n, 0) > 0 AS contaminated
FROM d LEFT JOIN pos USING (doc_id) LEFT JOIN its USING (doc_id)
"""
