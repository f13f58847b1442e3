"""Exact Jaccard join of 5-word shingle sets, its classes and their connected components.

1.  One pass over the texts makes each document's set of 64-bit shingle hashes. A set goes, once per
    task, to a file in the shared folder; copies meet by the set's fingerprint and are one class from
    there on. The pass also counts shingles in a sketch of SKETCH counters.
2.  The sketch gives one global order of shingles, ties by hash. By prefix filtering, two sets that link share
    a shingle among the n - ceil(3n/4) + 1 rarest of each. These prefix entries meet in buckets of shingles; a
    shingle whose counter tells of more than RUN_SPLIT entries is dealt over as many buckets as that needs, so no task holds a long run.
    Any fixed order gives right results; the sketch only keeps shingles that many sets share out of prefixes. With N shingles in
    all, a counter's noise is about the square root of N / SKETCH, so a shingle in a few thousand sets still
    stands out at 10^13 shingles, and rarer ones make runs that are short anyway.
3.  In a run, each set is a candidate with the run's first PIVOTS sets, as far as sizes and positions
    allow a link. Candidates are verified, and links joined to components. Then, in longer runs that still
    hold two components or more, the sets are dealt into chunks, files of the shared folder, and each pair of chunks is a unit that is
    joined as a whole. So every link that could join two components is found, and no group gives all its pairs: rows that are
    shuffled are a run's sets, and one for each pair of chunks of RUN_CHUNK sets.
4.  Both go through a prefix-tree join (Trie): sets in the global order, common shingles first, are stored in a tree whose
    branchless paths are single nodes. One traversal serves all probing sets at once; their overlaps with a path are
    counted once for all sets below it. Before each block of a node's shingles, a subtree is left when for no probe the overlap so far and the
    remaining lengths, the probe's and the longest below, reach what a link needs.
5.  Every link lies in one component. To count all of them, a component's sets are dealt into chunks, and
    each pair of chunks gives its sets' links by a product of incidence matrices; only sums by set leave it.

Words are `[^\\x20\\x09-\\x0D]+` after A-Z is lower-cased; fewer than five words are one shingle; texts
that are null or have no words have no set and link with nothing. Sets link when 4 |A and B| >= 3 |A or B|.
A class of equal sets and a component are named by their smallest doc_id; null ids are joined too, and
name nothing. Repeated rows are copies. A document's links are all other rows whose sets link with its own. Only the id and text columns are read, so other columns may have any names.
"""

from __future__ import annotations

import hashlib
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F, types as T

from orrery.llm import shared
from orrery.llm.textbytes import LOWER, WHITE, blocks, mix, range_hashes, word_ranges

WORDS = 5
PIVOTS = 3
#: Counters of the sketch; a slice of them is a row when tasks' counts are added.
SKETCH, SLICE = 1 << 21, 1 << 16
#: Prefix entries that a bucket is meant to hold; those of one shingle beyond which it is dealt over several.
BUCKET_ENTRIES, RUN_SPLIT = 2_000_000, 200_000
#: Sets of a chunk of a run, about; shingles that a trie's traversal takes between two looks at the bounds.
RUN_CHUNK, STEP = 500, 64
#: Candidate pairs and shingles that are verified at once.
VERIFY_PAIRS, VERIFY_SHINGLES = 1024, 400_000
#: Sets and shingles of a component that a chunk holds when links are counted, twice at most; and numbers expanded at once there.
COUNT_CHUNK, COUNT_SHINGLES, COUNT_STEP = 200, 400_000, 1 << 21
#: Rows of candidates and shingles of sets that a task is meant to get; tasks over which the comparisons with one set are dealt.
TASK_PAIRS, TASK_SHINGLES, SALTS = 50_000, 8_000_000, 32
_STEP = np.uint64(0x9E3779B97F4A7C15)


def tasks(spark: SparkSession, amount: int, each: int) -> int:
    """How many tasks an amount of work makes: by its size, and for small amounts up to what the cluster runs at once."""
    return max(1, -(-amount // each), min(spark.sparkContext.defaultParallelism, -(-16 * amount // each)))


def shingles(raw: np.ndarray, off: np.ndarray, size: int = WORDS) -> list[np.ndarray]:
    """Each row's set of shingle hashes, ascending."""
    low = LOWER[raw]
    starts, stops, rows = word_ranges(low, off, WHITE)
    h = range_hashes(low, starts, stops)
    folded = h.copy()
    for j in range(1, size):
        ahead = np.zeros_like(h)
        ahead[:-j] = h[j:]
        folded = mix(folded * _STEP + ahead)
    out = []
    for a, b in zip(rows[:-1].tolist(), rows[1:].tolist(), strict=True):
        if b - a >= size:
            out.append(np.unique(folded[a : b - size + 1]))
        elif b > a:
            one = mix(np.array([b - a], np.uint64))
            for k in range(a, b):
                one = mix(one * _STEP + h[k : k + 1])
            out.append(one)
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def fingerprint(s: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(s.tobytes(), digest_size=8).digest(), "little", signed=True)


def need(n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """The overlap from which sets of these sizes link."""
    return (3 * (n + m) + 6) // 7


SCAN = T.StructType([T.StructField("n", T.LongType()), T.StructField("fp", T.LongType()), T.StructField("file", T.StringType()), T.StructField("at", T.LongType()), T.StructField("slice", T.IntegerType()), T.StructField("counts", T.BinaryType())])


def scan(docs: DataFrame, folder: str, id_col: str, text_col: str) -> DataFrame:
    """Rows of documents (slice is null) and of sketch slices. Retried tasks write files of their own."""

    def run(batches):
        import zstandard

        from pyspark import TaskContext

        batch = next(batches, None)
        if batch is None:
            return
        name, at, sketch, seen = f"{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex[:12]}", 0, np.zeros(SKETCH, np.uint32), set()
        kind = batch.schema.field(0).type
        with shared.open_output(f"{folder}/{name}") as stream:
            while batch is not None:
                for a, b, raw, off in blocks(batch.column(1)):
                    sizes, fps, places = [], [], []
                    for s in shingles(raw, off):
                        fp = fingerprint(s)
                        sizes.append(len(s))
                        fps.append(fp)
                        if len(s) and fp not in seen:
                            seen.add(fp)
                            stream.write(s.tobytes())
                            places.append(at)
                            at += len(s)
                            np.add.at(sketch, (s % np.uint64(SKETCH)).astype(np.int64), 1)
                        else:
                            places.append(None)
                    n = b - a
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, n), pa.array(sizes, pa.int64()), pa.array(fps, pa.int64()), pa.array([None if p is None else name for p in places], pa.string()), pa.array(places, pa.int64()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary())], names=["doc_id", *SCAN.names])
                batch = next(batches, None)
        packer = zstandard.ZstdCompressor(level=1)
        for k in range(0, SKETCH, SLICE):
            if not sketch[k : k + SLICE].any():
                continue
            yield pa.RecordBatch.from_arrays([pa.nulls(1, kind), *[pa.nulls(1, t) for t in (pa.int64(), pa.int64(), pa.string(), pa.int64())], pa.array([k // SLICE], pa.int32()), pa.array([packer.compress(sketch[k : k + SLICE].tobytes())], pa.binary())], names=["doc_id", *SCAN.names])

    schema = T.StructType([T.StructField("doc_id", docs.schema[id_col].dataType), *SCAN.fields])
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, schema)


def add_sketches(slices: DataFrame) -> np.ndarray:
    """The sum of all tasks' sketches: SKETCH counters, whatever the input's size."""

    def run(batches):
        import zstandard

        unpacker, sums = zstandard.ZstdDecompressor(), {}
        for batch in batches:
            for k, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                sums[k] = sums.get(k, 0) + np.frombuffer(unpacker.decompress(data), np.uint32).astype(np.uint64)
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([x.astype(np.uint64).tobytes() for x in sums.values()], pa.binary())], names=["slice", "counts"])

    out = np.zeros(SKETCH, np.uint64)
    for r in slices.repartition(SKETCH // SLICE, "slice").mapInArrow(run, "slice int, counts binary").collect():
        out[r["slice"] * SLICE : (r["slice"] + 1) * SLICE] = np.frombuffer(r["counts"], np.uint64)
    return np.minimum(out, np.uint64((1 << 32) - 1)).astype(np.uint32)


class Store:
    """Sets in the shared folder, by file and place."""

    def __init__(self, folder: str):
        self.folder, self.files = folder, {}

    def read(self, file: str, at: int, size: int) -> bytes:
        if file not in self.files:
            if len(self.files) >= 256:
                self.files.pop(next(iter(self.files))).close()
            self.files[file] = shared.open_input(f"{self.folder}/{file}")
        return self.files[file].read_at(size, at)

    def get(self, file: str, at: int, n: int) -> np.ndarray:
        return np.frombuffer(self.read(file, 8 * at, 8 * n), np.uint64)

    def close(self) -> None:
        for f in self.files.values():
            f.close()


def prefixes(classes: DataFrame, folder: str, sketch, buckets: int, parts: int) -> DataFrame:
    """Prefix entries as blobs: bucket, and compressed columns (fp, n, entries) of sets and (shingle, position) of entries.

    Buckets from `buckets` on hold entries of long runs, each run dealt by set.
    """

    def run(batches):
        import zstandard

        counts, store, packer = sketch.value, Store(folder), zstandard.ZstdCompressor(level=1)
        noise = np.int64(counts.min())
        held: list[tuple] = []
        size = 0

        def flush():
            nonlocal held, size
            fp = np.array([x[0] for x in held], np.int64)
            n = np.array([x[1] for x in held], np.uint32)
            token = np.concatenate([x[2] for x in held])
            sizes = np.array([len(x[2]) for x in held])
            owner = np.repeat(np.arange(len(held), dtype=np.uint32), sizes)
            place = (np.arange(len(token)) - np.repeat(np.cumsum(sizes) - sizes, sizes)).astype(np.uint32)
            bucket = ((token >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64)
            salts = 1 + (counts[(token % np.uint64(SKETCH)).astype(np.int64)].astype(np.int64) - noise) // RUN_SPLIT
            hot = np.flatnonzero(salts > 1)
            salt = mix(fp[owner[hot]].astype(np.uint64)) % salts[hot].astype(np.uint64)
            bucket[hot] = buckets + (mix(token[hot] + salt * _STEP) % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            bounds = np.searchsorted(bucket[order], np.arange(2 * buckets + 1))
            out = []
            for b in np.flatnonzero(np.diff(bounds)).tolist():
                o = order[bounds[b] : bounds[b + 1]]
                who, entries = np.unique(owner[o], return_counts=True)  # owners ascend in a bucket
                data = fp[who].tobytes() + n[who].tobytes() + entries.astype(np.uint32).tobytes() + token[o].tobytes() + place[o].tobytes()
                out.append((b, len(who), len(o), packer.compress(data)))
            held, size = [], 0
            for a in range(0, len(out), 64):
                part = list(zip(*out[a : a + 64], strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(part, (pa.int32(), pa.int32(), pa.int32(), pa.binary()), strict=True)], names=["bucket", "sets", "entries", "data"])

        for batch in batches:
            for fp, n, file, at in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                s = store.get(file, at, n)
                order = np.argsort(counts[(s % np.uint64(SKETCH)).astype(np.int64)], kind="stable")
                held.append((fp, n, s[order[: n - (3 * n + 3) // 4 + 1]]))
                size += len(held[-1][2])
                if size > 1_000_000:
                    yield from flush()
        if held:
            yield from flush()
        store.close()

    rows = classes.select("fp", "n", "file", "at").repartition(parts, "file", F.floor(F.col("at") / (1 << 20))).sortWithinPartitions("file", "at")
    return rows.mapInArrow(run, "bucket int, sets int, entries int, data binary")


RUNS = T.StructType([*[T.StructField(c, T.LongType()) for c in ("run", "a", "b", "n", "pos")], T.StructField("bucket", T.IntegerType()), T.StructField("head", T.LongType())])


def runs(blobs: DataFrame, buckets: int) -> DataFrame:
    """Rows of long runs (run, a = fp, n, pos; b null) and of candidates with the runs' pivots (a, b; run null).

    Of a run that is dealt over buckets, rows tell their bucket, and `head` is the order key of the bucket's first PIVOTS sets, else null.
    """
    kinds = [pa.int64()] * 5 + [pa.int32(), pa.int64()]

    def rows(size: int, **columns):
        return pa.RecordBatch.from_arrays([pa.array(columns[f.name], k) if f.name in columns else pa.nulls(size, k) for f, k in zip(RUNS.fields, kinds, strict=True)], names=RUNS.names)

    def one(bucket: int, parts: list[tuple]):
        columns: list[list] = [[] for _ in range(4)]
        for sets, entries, data in parts:
            at = 0

            def take(k, kind):
                nonlocal at
                at += k * np.dtype(kind).itemsize
                return np.frombuffer(data, kind, k, at - k * np.dtype(kind).itemsize)

            fp, n, many = take(sets, np.int64), take(sets, np.uint32), take(sets, np.uint32)
            columns[0].append(np.repeat(fp, many))
            columns[1].append(np.repeat(n, many))
            columns[2].append(take(entries, np.uint64))
            columns[3].append(take(entries, np.uint32))
        fp, n, token, pos = map(np.concatenate, columns)
        if bucket < buckets:
            order = np.argsort(token, kind="stable")
            new = np.ones(len(token), bool)
            new[1:] = token[order[1:]] != token[order[:-1]]
            first = np.flatnonzero(new)
            size = np.diff(np.append(first, len(token)))
            keep = order[np.repeat(size > 1, size)]
            fp, n, token, pos = fp[keep], n[keep], token[keep], pos[keep]
        n, pos = n.astype(np.int64), pos.astype(np.int64)
        order = np.lexsort((first_of(fp), token))
        fp, n, token, pos = fp[order], n[order], token[order], pos[order]
        new = np.ones(len(token), bool)
        new[1:] = token[1:] != token[:-1]
        start = np.maximum.accumulate(np.where(new, np.arange(len(token)), 0))
        if bucket >= buckets:
            yield rows(len(fp), run=token.view(np.int64), a=fp, n=n, pos=pos, bucket=np.full(len(fp), bucket), head=np.ma.array(first_of(fp), mask=np.arange(len(fp)) >= start + PIVOTS))
            return
        pairs = []
        for k in range(PIVOTS):
            i = np.flatnonzero(np.arange(len(token)) > start + k)
            p = start[i] + k
            ok = (fp[p] != fp[i]) & linkable(n[p], pos[p], n[i], pos[i])
            pairs.append(np.stack([np.minimum(fp[p], fp[i])[ok], np.maximum(fp[p], fp[i])[ok]]))
        pair = np.concatenate(pairs, axis=1)
        pair = pair[:, np.lexsort(pair)]
        distinct = np.ones(pair.shape[1], bool)
        distinct[1:] = (pair[:, 1:] != pair[:, :-1]).any(axis=0)
        pair = pair[:, distinct]
        size = np.diff(np.append(np.flatnonzero(new), len(token)))
        open_ = np.repeat(size > PIVOTS + 1, size)  # of shorter runs, the pivots' candidates are all
        yield rows(int(open_.sum()), run=token[open_].view(np.int64), a=fp[open_], n=n[open_], pos=pos[open_])
        yield rows(pair.shape[1], a=pair[0], b=pair[1])

    def run(batches):
        import zstandard

        unpacker, now, parts = zstandard.ZstdDecompressor(), None, []
        for batch in batches:
            for bucket, sets, entries, data in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if bucket != now:
                    if parts:
                        yield from one(now, parts)
                    now, parts = bucket, []
                parts.append((sets, entries, unpacker.decompress(data)))
        if parts:
            yield from one(now, parts)

    return blobs.repartition(2 * buckets, "bucket").sortWithinPartitions("bucket").mapInArrow(run, RUNS)


def first_of(fp: np.ndarray) -> np.ndarray:
    """The key by which the same sets come first in all runs."""
    return mix(fp.astype(np.uint64)).astype(np.int64)


def candidates(met: DataFrame) -> DataFrame:
    """Distinct pairs (a, b): those that runs() gave, and of runs dealt over buckets, each set with the run's first PIVOTS sets.

    A bucket's heads are few; the pivots among them go to each bucket of the run, and meet its sets there.
    """
    dealt = met.where("bucket IS NOT NULL")
    heads = dealt.where("head IS NOT NULL").select("run", "bucket", "a", "n", "pos", "head")
    pivots = heads.withColumn("r", F.row_number().over(Window.partitionBy("run").orderBy("head", "a"))).where(F.col("r") <= PIVOTS)
    cells = heads.select("run", "bucket").distinct().join(pivots.select("run", F.col("a").alias("p"), F.col("n").alias("pn"), F.col("pos").alias("pp")), "run")
    least_ = F.floor((3 * (F.col("n") + F.col("pn")) + 6) / 7)
    can = (4 * F.least("n", "pn") >= 3 * F.greatest("n", "pn")) & (F.col("pos") <= F.col("n") - least_) & (F.col("pp") <= F.col("pn") - least_)
    more = dealt.join(cells, ["run", "bucket"]).where((F.col("a") != F.col("p")) & can)
    return met.where("b IS NOT NULL").select("a", "b").union(more.select(F.least("a", "p"), F.greatest("a", "p"))).distinct()


def linkable(n, pos_n, m, pos_m):
    """Whether sets of sizes n and m that share the shingles at these positions first can link."""
    least = (3 * (n + m) + 6) // 7
    return (4 * np.minimum(n, m) >= 3 * np.maximum(n, m)) & (pos_n <= n - least) & (pos_m <= m - least)


def flat(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    return np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(s) for s in sets])


class Trie:
    """Ordered sets (ascending codes) as a prefix tree; node 0 is the root.

    A node holds the shingles from depth `start` to `end` of the set `of`, the sets that end there, and its children; of all sets below, the
    greatest length and the least size of the whole set.
    """

    def __init__(self, sets: list[np.ndarray], sizes: np.ndarray):
        self.sets, self.sizes = sets, sizes
        order = sorted(range(len(sets)), key=lambda k: sets[k].astype(">u4").tobytes())
        lengths = np.array([len(sets[k]) for k in order])
        common = np.zeros(len(order), np.int64)  # with the set before
        for i in range(1, len(order)):
            x, y = sets[order[i - 1]], sets[order[i]]
            m = min(len(x), len(y))
            differ = x[:m] != y[:m]
            common[i] = differ.argmax() if differ.any() else m
        own = sizes[order]
        self.of, self.start, self.end, self.longest, self.smallest, self.ends, self.children = [], [], [], [], [], [], []
        waiting = [(0, len(order), 0, -1)]
        while waiting:
            lo, hi, depth, parent = waiting.pop()
            end = int(common[lo + 1 : hi].min()) if hi - lo > 1 else int(lengths[lo])
            last = lo
            while last < hi and lengths[last] == end:
                last += 1
            node = len(self.of)
            self.of.append(order[lo])
            self.start.append(depth)
            self.end.append(end)
            self.longest.append(int(lengths[lo:hi].max()))
            self.smallest.append(int(own[lo:hi].min()))
            self.ends.append(order[lo:last])
            self.children.append([])
            if parent >= 0:
                self.children[parent].append(node)
            if last < hi:
                cuts = [last, *(last + 1 + np.flatnonzero(common[last + 1 : hi] == end)).tolist(), hi]
                waiting += [(a, b, end, node) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]

    def join(self, codes: np.ndarray, first: np.ndarray, sizes: np.ndarray, n_codes: int) -> list[tuple[np.ndarray, int, np.ndarray]]:
        """Probes are rows of ascending codes between `first`, with the sizes of their whole sets. Triples: probes that link, a set, their overlaps."""
        n = len(sizes)
        length = np.diff(first)
        owner = np.repeat(np.arange(n), length)
        keys, base = owner * n_codes + codes, np.arange(n) * n_codes
        by = np.argsort(codes, kind="stable")
        holders, at = owner[by], np.searchsorted(codes[by], np.arange(n_codes + 1))
        out, waiting = [], [(0, np.arange(n), np.zeros(n, np.int64))]
        while waiting:
            node, who, counts = waiting.pop()  # the probes that can still link with a set below, and their overlaps so far
            path, d, end = self.sets[self.of[node]], self.start[node], self.end[node]
            least = need(sizes, self.smallest[node])
            while True:
                alive = counts + np.minimum(length[who], self.longest[node] - d) >= least[who]
                who, counts = who[alive], counts[alive]
                if d and len(who):
                    left = length[who] - (np.searchsorted(keys, base[who] + path[d - 1], side="right") - first[who])
                    alive = counts + np.minimum(left, self.longest[node] - d) >= least[who]
                    who, counts = who[alive], counts[alive]
                if d == end or not len(who):
                    break
                block = path[d : min(end, d + STEP)]
                a, many = at[block], at[block + 1] - at[block]
                met = holders[np.repeat(a - (np.cumsum(many) - many), many) + np.arange(int(many.sum()))]
                counts = counts + np.bincount(met, minlength=n)[who]
                d += len(block)
            if not len(who):
                continue
            for k in self.ends[node]:
                hit = np.flatnonzero(counts >= need(sizes[who], self.sizes[k]))
                if len(hit):
                    out.append((who[hit], k, counts[hit]))
            waiting += [(c, who, counts) for c in self.children[node]]
        return out


def _distinct(ordered: np.ndarray) -> np.ndarray:
    new = np.ones(len(ordered), bool)
    new[1:] = ordered[1:] != ordered[:-1]
    return ordered[new]


def trie_join(xs: list[np.ndarray], ys: list[np.ndarray], counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All pairs (i, j) of sets of xs and of ys that link, and their overlaps; where both are one list, of distinct sets, pairs of a set with itself may be left out. `counts` is the sketch that gives the order.

    Shingles that one side alone holds can add nothing, and a set whose other shingles are too few for any link is left out with them.
    """
    none = (np.zeros(0, np.int64),) * 3
    if not xs or not ys:
        return none
    (tx, ox), (ty, oy) = flat(xs), flat(ys)
    ux = np.sort(tx)
    if xs is ys:
        token = _distinct(ux[1:][ux[1:] == ux[:-1]])
    else:
        ux, uy = _distinct(ux), _distinct(np.sort(ty))
        token = ux[uy[np.minimum(np.searchsorted(uy, ux), len(uy) - 1)] == ux] if len(ux) and len(uy) else ux[:0]
    if not len(token):
        return none
    nx, ny = np.array([len(s) for s in xs]), np.array([len(s) for s in ys])
    code = np.empty(len(token), np.int64)
    code[np.lexsort((token, -counts[(token % np.uint64(SKETCH)).astype(np.int64)].astype(np.int64)))] = np.arange(len(token))

    def coded(t, o, sizes, other):
        at = np.minimum(np.searchsorted(token, t), len(token) - 1)
        held = token[at] == t
        c, o = code[at[held]], o[held]
        kept = np.flatnonzero(np.bincount(o, minlength=len(sizes)) >= need(sizes, other.min()))
        place = np.full(len(sizes), -1)
        place[kept] = np.arange(len(kept))
        some = place[o] >= 0
        c, o = c[some], place[o[some]]
        order = np.lexsort((c, o))
        return kept, c[order], np.searchsorted(o[order], np.arange(len(kept) + 1))

    (ix, cx, fx), (iy, cy, fy) = coded(tx, ox, nx, ny), coded(ty, oy, ny, nx)
    if not len(ix) or not len(iy):
        return none
    trie = Trie([cy[a:b] for a, b in zip(fy[:-1], fy[1:], strict=True)], ny[iy])
    found = trie.join(cx, fx, nx[ix], len(token))
    if not found:
        return none
    return ix[np.concatenate([f[0] for f in found])], iy[np.repeat([f[1] for f in found], [len(f[0]) for f in found])], np.concatenate([f[2] for f in found])


LINKS = "a long, b long, overlap long, n_a long, n_b long"


def _links(found: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*found, strict=True) if found else [()] * 5)], names=["a", "b", "overlap", "n_a", "n_b"])


def verified(pairs: DataFrame, classes: DataFrame, folder: str, sketch, parts: int) -> DataFrame:
    """Of candidate pairs (a, b) those that link, with the overlap and both sizes."""

    def compare(store, rows):
        wanted = {(r[0], r[1]) for r in rows}
        left = {r[0]: r[2:5] for r in rows}
        right = {r[1]: r[5:8] for r in rows}
        a, b = list(left), list(right)
        xs, ys = ([store.get(file, at, n) for n, file, at in side.values()] for side in (left, right))
        for i, j, overlap in zip(*(x.tolist() for x in trie_join(xs, ys, sketch.value)), strict=True):
            if (a[i], b[j]) in wanted:
                yield a[i], b[j], overlap, len(xs[i]), len(ys[j])

    def run(batches):
        store, rows, held = Store(folder), [], 0
        for batch in batches:
            found: list[tuple] = []
            for r in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if len(rows) >= VERIFY_PAIRS or held >= VERIFY_SHINGLES:
                    found += compare(store, rows)
                    rows, held = [], 0
                held += r[5] + (r[2] if not rows or rows[-1][0] != r[0] else 0)
                rows.append(r)
            yield _links(found)
        if rows:
            yield _links(list(compare(store, rows)))
        store.close()

    def at(name: str) -> DataFrame:
        return classes.select(F.col("fp").alias(name), *[F.col(c).alias(f"{name}_{c}") for c in ("n", "file", "at")])

    rows = pairs.join(at("a"), "a").join(at("b"), "b").select("a", "b", "a_n", "a_file", "a_at", "b_n", "b_file", "b_at")
    rows = rows.repartition(parts, "a", F.pmod(F.xxhash64("b"), F.lit(SALTS))).sortWithinPartitions("a", "b")
    return rows.mapInArrow(run, LINKS)


CHUNKS = "key long, own int, k int, blob string, place long, bytes long, lo long, hi long"


def chunk_files(rows: DataFrame, folder: str, parts: int) -> DataFrame:
    """Chunks of groups as files: rows of (key, own, k, label, ...) with own below k in, one row per chunk out, with its place and its least and greatest label."""

    def run(batches):
        held, name, at = [], uuid.uuid4().hex, 0
        with shared.open_output(f"{folder}/chunks-{name}") as stream:

            def put():
                nonlocal at
                chunk = pa.Table.from_batches(held)
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, chunk.schema) as out:
                    out.write_table(chunk)
                data = sink.getvalue()
                stream.write(data)
                at += data.size
                label = chunk["label"].to_numpy()
                return (*(chunk[c][0].as_py() for c in ("key", "own", "k")), name, at - data.size, data.size, int(label.min()), int(label.max()))

            def out(found):
                kinds = (pa.int64(), pa.int32(), pa.int32(), pa.string(), *[pa.int64()] * 4)
                return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found, strict=True) if found else [()] * 8, kinds, strict=True)], names=["key", "own", "k", "blob", "place", "bytes", "lo", "hi"])

            now = None
            for batch in batches:
                found = []
                key, own = batch["key"].to_numpy(), batch["own"].to_numpy()
                cuts = [0, *(1 + np.flatnonzero((key[1:] != key[:-1]) | (own[1:] != own[:-1]))).tolist(), len(key)]
                for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                    if held and (key[a], own[a]) != now:
                        found.append(put())
                        held = []
                    now = key[a], own[a]
                    held.append(batch.slice(a, b - a))
                yield out(found)
            if held:
                yield out([put()])

    rows = rows.repartition(parts, "key", "own").sortWithinPartitions("key", "own", "fp")
    return shared.written(rows.mapInArrow(run, CHUNKS), "chunks")


def chunk_pairs(chunks: DataFrame, differing: bool) -> DataFrame:
    """Each pair of chunks of a group, once, and each chunk with itself; with `differing`, only pairs of more than one label."""
    right = chunks.select("key", F.col("own").alias("y"), *[F.col(c).alias(f"y_{c}") for c in ("blob", "place", "bytes", "lo", "hi")])
    pairs = chunks.withColumn("y", F.explode(F.sequence("own", F.col("k") - 1))).join(right, ["key", "y"])
    if differing:
        pairs = pairs.where((F.least("lo", "y_lo") != F.greatest("hi", "y_hi")))
    return pairs.select("key", F.col("own").alias("x"), "y", "blob", "place", "bytes", "y_blob", "y_place", "y_bytes")


def units(pairs: DataFrame, folder: str, parts: int, unit, out, schema: str) -> DataFrame:
    """unit(store, left, right, same) of each pair of chunks, each a dict of columns; `out` makes a batch of what a task's units gave."""

    def run(batches):
        store, known = Store(folder), {}

        def chunk(blob, place, size):
            if (blob, place) not in known:
                if len(known) > 1:
                    known.pop(next(iter(known)))
                data = store.read(f"chunks-{blob}", place, size)
                rows = pa.ipc.open_stream(data).read_all()
                known[blob, place] = {c: rows[c].to_pylist() for c in rows.column_names}, {}
            return known[blob, place]

        for batch in batches:
            found: list[tuple] = []
            for _, x, y, *where in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                found += unit(store, chunk(*where[:3]), chunk(*where[3:]), x == y)
                if len(found) > 10_000:
                    yield out(found)
                    found = []
            yield out(found)
        store.close()

    return pairs.repartition(parts, "key", "x", "y").sortWithinPartitions("key", "x", "y").mapInArrow(run, schema)


def small_groups(rows: DataFrame, folder: str, parts: int, unit, out, schema: str) -> DataFrame:
    """The same for groups of one chunk, where their rows meet."""

    def run(batches):
        store, held, now = Store(folder), [], None

        def done():
            chunk = pa.Table.from_batches(held)
            columns = {c: chunk[c].to_pylist() for c in chunk.column_names}, {}
            return unit(store, columns, columns, True)

        for batch in batches:
            found: list[tuple] = []
            key = batch["key"].to_numpy()
            cuts = [0, *(1 + np.flatnonzero(key[1:] != key[:-1])).tolist(), len(key)]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if held and key[a] != now:
                    found += done()
                    held = []
                now = key[a]
                held.append(batch.slice(a, b - a))
            yield out(found)
        if held:
            yield out(list(done()))
        store.close()

    return rows.repartition(parts, "key").sortWithinPartitions("key", "fp").mapInArrow(run, schema)


def _sets(store: Store, chunk: tuple[dict, dict]) -> list[np.ndarray]:
    """A chunk's sets, read once while the chunk is held."""
    rows, held = chunk
    if not held:
        held["sets"] = [store.get(*r) for r in zip(rows["file"], rows["at"], rows["n"], strict=True)]
    return held["sets"]


class Joining:
    """Labels that links found in one task have joined."""

    def __init__(self):
        self.parent: dict[int, int] = {}

    def root(self, k: int) -> int:
        parent = self.parent
        while parent.get(k, k) != k:
            parent[k] = parent.get(parent[k], parent[k])
            k = parent[k]
        return k

    def links(self, left: dict, right: dict, found: tuple):
        """Of found links between rows of columns (fp, n, label), those that join two labels which earlier ones have not joined; of each pair of labels, one link is looked at."""
        i, j, overlap = found
        u, v = np.array(left["label"], np.int64)[i], np.array(right["label"], np.int64)[j]
        some = np.flatnonzero(u != v)
        pairs = np.stack([np.minimum(u, v)[some], np.maximum(u, v)[some]], axis=1)
        _, first = np.unique(pairs, axis=0, return_index=True)
        for k in some[first].tolist():
            a, b = self.root(int(u[k])), self.root(int(v[k]))
            if a != b:
                self.parent[a] = b
                (fp, n), (other, m) = sorted([(left["fp"][i[k]], left["n"][i[k]]), (right["fp"][j[k]], right["n"][j[k]])])
                yield fp, other, int(overlap[k]), n, m


def small_runs(rows: DataFrame, folder: str, sketch, parts: int) -> DataFrame:
    """Links across labels in runs of one chunk. Runs of neighbouring sets come together, and the sets of several runs are joined at once."""

    def run(batches):
        store, held, now = Store(folder), {}, None
        size = 0

        def done():
            columns = {c: [r[k] for r in held.values()] for k, c in enumerate(("fp", "n", "label", "file", "at"))}
            sets = _sets(store, (columns, {}))
            return Joining().links(columns, columns, trie_join(sets, sets, sketch.value))

        for batch in batches:
            found: list[tuple] = []
            for key, *r in zip(*[batch[c].to_pylist() for c in ("key", "fp", "n", "label", "file", "at")], strict=True):
                if key != now and (len(held) >= RUN_CHUNK or size >= VERIFY_SHINGLES):
                    found += done()
                    held, size = {}, 0
                now = key
                if r[0] not in held:
                    held[r[0]] = r
                    size += r[1]
            yield _links(found)
        if held:
            yield _links(list(done()))
        store.close()

    rows = rows.repartition(parts, "lo", F.pmod("key", F.lit(8))).sortWithinPartitions("lo", "hi", "key", "fp")
    return rows.mapInArrow(run, LINKS)


def across(runs_: DataFrame, classes: DataFrame, folder: str, sketch) -> DataFrame:
    """Links between sets of one run whose labels differ: rows of (run, fp, n, label) in, links (a, b, overlap, n_a, n_b) out.

    A unit gives only links that join two labels which its links before have not joined.
    """
    spark = runs_.sparkSession
    many = runs_.groupBy("run").agg(F.count("*").alias("c"), F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo <> hi")
    rows = runs_.join(many.select("run", F.ceil(F.col("c") / RUN_CHUNK).cast("int").alias("k"), "lo", "hi"), "run").join(classes.select("fp", "file", "at"), "fp")
    rows = shared.written(rows.select(F.col("run").alias("key"), F.pmod(F.xxhash64("fp"), F.col("k")).cast("int").alias("own"), "k", "fp", "n", "label", "file", "at", "lo", "hi"), "open")
    small, large = rows.where("k = 1"), rows.where("k > 1").drop("lo", "hi")
    some = small_runs(small, folder, sketch, tasks(spark, small.count(), 50 * RUN_CHUNK))
    chunks = chunk_files(large, folder, tasks(spark, large.count(), 100 * RUN_CHUNK))
    pairs = chunk_pairs(chunks, True)

    def unit(store, left, right, same):
        return Joining().links(left[0], right[0], trie_join(_sets(store, left), _sets(store, right), sketch.value))

    return some.unionByName(units(pairs, folder, tasks(spark, pairs.count(), 20), unit, _links, LINKS))


def components(links: DataFrame) -> DataFrame:
    """(node, label) of every node in a link: the label is the smallest node of its component.

    Each round, nodes take the smallest node among themselves and their neighbours, labels follow, and
    links are contracted; sums and joins only, no node's links in one place.
    """
    edges = shared.written(links.select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).where("u <> v").distinct(), "edges")
    labels = shared.written(edges.select(F.col("u").alias("node")).union(edges.select("v")).distinct().select("node", F.col("node").alias("label")), "labels")
    while not edges.isEmpty():
        parent = edges.groupBy(F.col("v").alias("x")).agg(F.min("u").alias("p"))  # u < v, so chains end
        jump = parent.alias("s").join(parent.alias("t"), F.col("s.p") == F.col("t.x"), "left").select(F.col("s.x").alias("x"), F.coalesce("t.p", "s.p").alias("p"))
        jump, before = shared.written(jump, "jump"), (edges, labels)
        labels = shared.written(labels.join(jump, F.col("label") == F.col("x"), "left").select("node", F.coalesce("p", "label").alias("label")), "labels")
        left = edges.join(jump, F.col("u") == F.col("x"), "left").select(F.coalesce("p", "u").alias("u"), "v")
        both = left.join(jump, F.col("v") == F.col("x"), "left").select("u", F.coalesce("p", "v").alias("v"))
        edges = shared.written(both.where("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), "edges")
        shared.release(*before, jump)
    shared.release(edges)
    return labels


def overlaps(xs: list[np.ndarray], ys: list[np.ndarray]) -> np.ndarray:
    """How many shingles each of xs shares with each of ys. Common shingles go through a dense product, the others pair by pair."""

    (tx, ox), (ty, oy) = flat(xs), flat(ys)
    token = np.intersect1d(tx, ty)
    out = np.zeros((len(xs), len(ys)), np.int64)
    if not len(token):
        return out

    def met(t, o):
        at = np.minimum(np.searchsorted(token, t), len(token) - 1)
        keep = token[at] == t
        at, o = at[keep], o[keep]
        order = np.argsort(at, kind="stable")
        at = at[order]
        return at, o[order], np.searchsorted(at, np.arange(len(token) + 1))

    (ax, ox, fx), (ay, oy, fy) = met(tx, ox), met(ty, oy)
    many = np.diff(fx) * np.diff(fy)
    common = np.flatnonzero(100 * many > out.size)
    for a in range(0, len(common), 2048):
        part = common[a : a + 2048]
        place = np.full(len(token), -1)
        place[part] = np.arange(len(part))
        left, right = np.zeros((len(xs), len(part)), np.float32), np.zeros((len(ys), len(part)), np.float32)  # sums to 2,048 are exact
        for m, at, o in ((left, ax, ox), (right, ay, oy)):
            k = place[at]
            m[o[k >= 0], k[k >= 0]] = 1
        out += (left @ right.T).astype(np.int64)
    i = np.flatnonzero(100 * many[ax] <= out.size)
    times = np.diff(fy)[ax[i]]
    ends = np.cumsum(times)
    a = 0
    while a < len(i):
        b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + COUNT_STEP, side="right")))
        t = times[a:b]
        nth = np.arange(t.sum()) - np.repeat(np.cumsum(t) - t, t)
        y = oy[np.repeat(fy[ax[i[a:b]]], t) + nth]
        out += np.bincount(np.repeat(ox[i[a:b]], t) * len(ys) + y, minlength=out.size).reshape(out.shape)
        a = b
    return out


def link_counts(groups: DataFrame, folder: str) -> DataFrame:
    """All links within components, counted: rows of (label, fp, n, file, at, copies) in, (fp, sets, docs) out.

    `sets` is how many other sets link with a set, `docs` how many documents have one of those. Each pair
    of a component's sets is in exactly one unit, a pair of chunks, so that nothing is counted twice.
    """
    spark = groups.sparkSession
    many = groups.groupBy("label").agg(F.count("*").alias("c"), F.sum("n").alias("s"))
    many = many.select("label", F.greatest(F.ceil(F.col("c") / COUNT_CHUNK), F.least("c", F.ceil(F.col("s") / COUNT_SHINGLES))).cast("int").alias("k"))
    rows = groups.join(many, "label").select(F.col("label").alias("key"), F.pmod(F.xxhash64("fp"), F.col("k")).cast("int").alias("own"), "k", "label", "fp", "file", "at", "n", "copies")
    rows = shared.written(rows, "linked")
    small, large = rows.where("k = 1"), rows.where("k > 1")
    chunks = chunk_files(large, folder, tasks(spark, large.count(), 100 * COUNT_CHUNK))
    pairs = chunk_pairs(chunks, False)

    def unit(store, left, right, same):
        (l, _), (r, _) = left, right
        if same and len(l["fp"]) == 1:
            return
        xs, ys = _sets(store, left), _sets(store, right)
        link = 7 * overlaps(xs, ys) >= 3 * np.add.outer(l["n"], r["n"])
        if same:
            np.fill_diagonal(link, False)
        for side, other, m in [(l, r, link), (r, l, link.T)][: 1 if same else 2]:
            for fp, sets, docs in zip(side["fp"], m.sum(axis=1).tolist(), (m @ np.array(other["copies"])).tolist(), strict=True):
                if sets:
                    yield fp, sets, docs

    def out(found):
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*found, strict=True) if found else [()] * 3)], names=["fp", "sets", "docs"])

    schema = "fp long, sets long, docs long"
    counted = units(pairs, folder, tasks(spark, pairs.count(), 200), unit, out, schema)
    counted = counted.unionByName(small_groups(small, folder, tasks(spark, small.count(), 200 * COUNT_CHUNK), unit, out, schema))
    return counted.groupBy("fp").agg(F.sum("sets").alias("sets"), F.sum("docs").alias("docs"))


class Joined:
    """members: doc_id, n, fp of all rows; classes: one row per distinct set, in files of the folder; links: verified pairs of classes that join the components; labels: fp and component of linked classes."""

    def __init__(self, members: DataFrame, classes: DataFrame, links: DataFrame, labels: DataFrame, folder: str):
        self.members, self.classes, self.links, self.labels, self.folder = members, classes, links, labels, folder

    def placed(self) -> DataFrame:
        """doc_id, n, fp and label (the component's smallest fingerprint) of all rows with words."""
        rows = self.members.where("n > 0").join(self.labels.withColumnRenamed("node", "fp"), "fp", "left")
        return rows.select("doc_id", "n", "fp", F.coalesce("label", "fp").alias("label"))

    def by_document(self) -> DataFrame:
        """doc_id, n_shingles, class_id, component_id, n_links."""
        own = self.members.where("n > 0").groupBy("fp").agg(F.min("doc_id").alias("class_id"), F.count("*").alias("copies"))
        sets = shared.written(own.join(self.labels.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "class_id", "copies", "label"), "named")
        groups = sets.where("label IS NOT NULL").select("fp", "label", "copies").join(self.classes, "fp")
        counts = link_counts(groups.select("label", "fp", "n", "file", "at", "copies"), self.folder)
        sets = sets.withColumn("label", F.coalesce("label", "fp"))
        named = sets.groupBy("label").agg(F.min("class_id").alias("component_id"))
        by_set = sets.join(named, "label").join(counts, "fp", "left").select("fp", "class_id", "component_id", (F.col("copies") - 1 + F.coalesce("docs", F.lit(0))).alias("n_links"))
        rows = self.members.join(by_set, "fp", "left")
        some = F.col("n") > 0
        return rows.select("doc_id", F.col("n").alias("n_shingles"), *[F.when(some, F.col(c)).otherwise(F.col("doc_id")).alias(c) for c in ("class_id", "component_id")], F.when(some, F.col("n_links")).otherwise(0).alias("n_links"))


def join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Joined:
    spark = docs.sparkSession
    folder = shared.shared_dir(spark, "sets")
    scanned = shared.written(scan(docs, folder, id_col, text_col), "scan")
    members = scanned.where("slice IS NULL").select("doc_id", "n", "fp")
    sketch = spark.sparkContext.broadcast(add_sketches(scanned.where("slice IS NOT NULL").select("slice", "counts")))
    found = scanned.where("file IS NOT NULL").groupBy("fp").agg(F.min(F.struct("n", "file", "at")).alias("s"))
    classes = shared.written(found.select("fp", "s.n", "s.file", "s.at"), "classes")
    total = classes.agg(F.sum("n")).first()[0] or 0
    buckets = int((total // 4 + 1) // BUCKET_ENTRIES) + 1
    met = shared.written(runs(prefixes(classes, folder, sketch, buckets, tasks(spark, total, TASK_SHINGLES)), buckets), "runs")
    pairs = shared.written(candidates(met), "pairs")
    links = shared.written(verified(pairs, classes, folder, sketch, tasks(spark, pairs.count(), TASK_PAIRS)), "links")
    labels = components(links)
    entries = met.where("run IS NOT NULL").select("run", F.col("a").alias("fp"), "n")
    placed = entries.join(labels.withColumnRenamed("node", "fp"), "fp", "left").select("run", "fp", "n", F.coalesce("label", "fp").alias("label"))
    placed = shared.written(placed, "placed")
    more = shared.written(across(placed, classes, folder, sketch), "links")
    if not more.isEmpty():
        links = links.unionByName(more)
        labels = components(links)
    shared.release(met, pairs, placed)
    return Joined(members, classes, links, labels, folder)


def _fingerprinted(rows: DataFrame) -> DataFrame:
    """Rows of (row, id, text) with the fingerprint of the text's set (null of texts without words)."""

    def run(batches):
        for batch in batches:
            fps = [fingerprint(s) if len(s) else None for _, _, raw, off in blocks(batch.column(2)) for s in shingles(raw, off)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(fps, pa.int64())], schema=batch.schema.append(pa.field("fp", pa.int64())))

    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField("fp", T.LongType())]))


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One document of each component, that with the smallest id; documents without words stay.

    Rows whose id repeats or is null are told apart by their sets; a null id is the largest. Of rows with equal ids and
    sets the first by text stays. A row travels as one column, so that its columns may have any names and keep their values.
    """
    found = join(docs, id_col, text_col)
    least = found.placed().groupBy("label").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "fp")).alias("s")).select("s.doc_id", "s.fp")
    empty = found.members.where("n = 0").select("doc_id", F.lit(None).cast("long").alias("fp"))
    keep = shared.written(least.unionByName(empty).select(F.col("doc_id").alias("kept_id"), F.col("fp").alias("kept_fp")), "keep")
    many = shared.written(found.members.groupBy("doc_id").agg(F.count("*").alias("c")).where("c > 1 OR doc_id IS NULL").select(F.col("doc_id").alias("many_id")), "many")
    rows = docs.select(F.struct("*").alias("row"), F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    if many.isEmpty():
        return rows.select("row", "id").join(keep, F.col("id") == F.col("kept_id"), "left_semi").select("row.*")
    again = F.col("id").eqNullSafe(F.col("many_id"))
    single = rows.join(many, again, "left_anti").join(keep, F.col("id") == F.col("kept_id"), "left_semi")
    repeated = _fingerprinted(rows.join(many, again, "left_semi"))
    repeated = repeated.join(keep.where("kept_fp IS NOT NULL"), F.col("id").eqNullSafe(F.col("kept_id")) & F.col("fp").eqNullSafe(F.col("kept_fp")), "left")
    worded = repeated.where("fp IS NOT NULL AND kept_fp IS NOT NULL").groupBy("id", "fp").agg(F.min_by("row", F.struct("text", F.xxhash64("row"))).alias("row"))
    return single.select("row").unionByName(repeated.where("fp IS NULL").select("row")).unionByName(worded.select("row")).select("row.*")


def op2_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join(shared.table(spark, sf_dir, "documents")).by_document()


ORACLE_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i : i + 4], ' ') AS g FROM d, unnest(range(1, greatest(len(w) - 3, 2))) t(i) WHERE len(w) > 0
), z AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), o AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id
), link AS (
  SELECT a, b, c = x.n AND c = y.n AS same FROM o JOIN z x ON x.doc_id = a JOIN z y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)
), reach AS (
  SELECT doc_id AS a, doc_id AS b FROM z UNION SELECT reach.a, link.b FROM reach JOIN link ON reach.b = link.a
)
SELECT d.doc_id, coalesce(z.n, 0) AS n_shingles, coalesce(k.c, d.doc_id) AS class_id, coalesce(r.c, d.doc_id) AS component_id, coalesce(k.n, 0) AS n_links
FROM d LEFT JOIN z USING (doc_id)
LEFT JOIN (SELECT a, least(a, min(b) FILTER (WHERE same)) AS c, count(*) AS n FROM link GROUP BY a) k ON k.a = d.doc_id
LEFT JOIN (SELECT a, min(b) AS c FROM reach GROUP BY a) r ON r.a = d.doc_id
"""
