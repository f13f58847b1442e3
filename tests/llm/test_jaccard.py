import random
import re

import numpy as np
import pytest

from orrery.llm import jaccard


def shingle_set(text):
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if x]
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute(rows):
    """doc_id, set size and component of (doc_id, text) rows."""
    sets = [shingle_set(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    holders = {}
    for k, s in enumerate(sets):
        for g in s:
            holders.setdefault(g, []).append(k)
    for i, s in enumerate(sets):
        common = {}
        for g in s:
            for k in holders[g]:
                if k < i:
                    common[k] = common.get(k, 0) + 1
        for k, n in common.items():
            if 100 * n >= 75 * (len(s) + len(sets[k]) - n):
                parent[root(i)] = root(k)
    least = {}
    for k, (doc, _) in enumerate(rows):
        if sets[k] and doc is not None:
            least[root(k)] = min(doc, least.get(root(k), doc))
    return sorted(((doc, len(sets[k]), least.get(root(k)) if sets[k] else doc) for k, (doc, _) in enumerate(rows)), key=str)


def got(frame):
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in frame.collect()), key=str)


@pytest.fixture(scope="module")
def copies(spark):
    """A group of many near copies whose pairs straddle the threshold, chains, exact copies and one shared passage."""
    rng = random.Random(11)
    base = [f"w{rng.randrange(5000)}" for _ in range(220)]
    rows, doc = [], 1000
    for _ in range(150):
        w = list(base)
        for _ in range(rng.randrange(1, 6)):
            w[rng.randrange(len(w))] = f"e{rng.randrange(10**6)}"
        rows.append((doc, " ".join(w)))
        doc += 1
    chain = [f"c{k}" for k in range(120)]
    for k in range(25):
        rows.append((doc, " ".join(chain[k * 4 :] + [f"n{k}_{i}" for i in range(k * 4)])))
        doc += 1
    passage = " ".join(f"p{k}" for k in range(60))
    for k in range(80):
        rows.append((doc, passage + " " + " ".join(f"u{k}_{i}" for i in range(rng.choice([5, 12, 25, 60])))))
        doc += 1
    rows += [(doc + k, "Exactly the same text for all of these rows") for k in range(30)]
    return spark.createDataFrame(rows, "doc_id long, text string")


def test_matches_brute_force(documents, odd, copies):
    docs = documents.select("doc_id", "text").union(odd.select("doc_id", "text")).union(copies)
    assert got(jaccard.join(docs).by_document()) == brute([tuple(r) for r in docs.collect()])


def test_small_buckets_chunks_and_one_pivot(copies, monkeypatch):
    monkeypatch.setattr(jaccard, "BUCKET_ENTRIES", 500)
    monkeypatch.setattr(jaccard, "PIVOTS", 1)
    monkeypatch.setattr(jaccard, "RUN_CHUNK", 20)
    monkeypatch.setattr(jaccard, "VERIFY_PAIRS", 50)
    assert got(jaccard.join(copies).by_document()) == brute([tuple(r) for r in copies.collect()])


@pytest.mark.parametrize("pivots", [1, 3])
def test_runs_dealt_over_buckets(copies, monkeypatch, pivots):
    monkeypatch.setattr(jaccard, "BUCKET_ENTRIES", 500)
    monkeypatch.setattr(jaccard, "RUN_SPLIT", 15)
    monkeypatch.setattr(jaccard, "RUN_CHUNK", 30)
    monkeypatch.setattr(jaccard, "PIVOTS", pivots)
    assert got(jaccard.join(copies).by_document()) == brute([tuple(r) for r in copies.collect()])


def test_unlike_sets_with_a_shared_shingle_stay_linear(spark, tmp_path, monkeypatch):
    # all 3,000 sets have one shingle in common, in every prefix: rows written between steps grow with the sets, not their square
    made, write = {}, jaccard.shared.written

    def counted(frame, name):
        out = write(frame, name)
        made[name] = max(made.get(name, 0), out.count())
        return out

    monkeypatch.setattr(jaccard.shared, "written", counted)
    monkeypatch.setattr(jaccard, "RUN_SPLIT", 500)
    monkeypatch.setattr(jaccard, "SKETCH", 1 << 16)  # small, so that the common shingle's rank is no help
    passage = "these five words are common"
    docs = spark.createDataFrame([(k, passage + f" x{k} y{k} z{k}" if k % 2 else passage + "".join(f" x{k}_{i}" for i in range(k % 7))) for k in range(3000)], "doc_id long, text string")
    labels = {r.doc_id: r.component_id for r in jaccard.join(docs).by_document().collect()}
    want = brute([tuple(r) for r in docs.collect()])
    assert labels == {d: c for d, _, c in want}
    assert max(made.values()) < 10 * 3000


def test_counts_every_link(odd, copies, monkeypatch):
    monkeypatch.setattr(jaccard, "COUNT_CHUNK", 20)
    monkeypatch.setattr(jaccard, "COUNT_STEP", 500)
    docs = odd.select("doc_id", "text").union(copies)
    rows = [tuple(r) for r in docs.collect()]
    sets = [shingle_set(t) for _, t in rows]
    want = []
    for k, (doc, _) in enumerate(rows):
        same = [d for (d, _), s in zip(rows, sets, strict=True) if s == sets[k] and d is not None]
        links = sum(j != k and 4 * len(s & sets[k]) >= 3 * len(s | sets[k]) for j, s in enumerate(sets)) if sets[k] else 0
        want.append((doc, min(same, default=None) if sets[k] else doc, links))
    assert max(links for _, _, links in want) > 4 * jaccard.COUNT_CHUNK
    got_ = [(r.doc_id, r.class_id, r.n_links) for r in jaccard.join(docs).by_document().collect()]
    assert sorted(got_, key=str) == sorted(want, key=str)


def test_overlaps():
    rng = np.random.default_rng(3)
    xs, ys = ([np.unique(np.concatenate([rng.integers(0, 60, 30), rng.integers(0, 3000, 40)]).astype(np.uint64)) for _ in range(k)] for k in (30, 45))
    assert jaccard.overlaps(xs, ys).tolist() == [[len(np.intersect1d(x, y)) for y in ys] for x in xs]


def test_trie_join():
    rng = np.random.default_rng(2)
    counts = rng.integers(0, 50, jaccard.SKETCH).astype(np.uint32)
    for _ in range(40):
        base = np.unique(rng.integers(0, 400, rng.integers(1, 250)).astype(np.uint64))

        def near():
            drop = rng.random(len(base)) > rng.choice([0.0, 0.02, 0.1, 0.3])
            return np.unique(np.concatenate([base[drop], rng.integers(0, 400, rng.integers(0, 30)).astype(np.uint64)]))

        xs, ys = ([s for s in (near() for _ in range(25)) if len(s)] for _ in range(2))
        ys += xs[:2]
        got = {(i, j): n for i, j, n in zip(*(x.tolist() for x in jaccard.trie_join(xs, ys, counts)), strict=True)}
        both = {(i, j): len(np.intersect1d(x, y)) for i, x in enumerate(xs) for j, y in enumerate(ys)}
        assert got == {k: n for k, n in both.items() if 7 * n >= 3 * (len(xs[k[0]]) + len(ys[k[1]]))}


def test_trie_shares_paths_and_leaves_subtrees():
    sets = [np.array(x) for x in ([0, 1, 2, 3], [0, 1, 2, 4, 5], [0, 1, 2], [7, 8], [0, 1, 2, 3])]
    trie = jaccard.Trie(sets, np.array([4, 5, 3, 2, 4]))
    paths = {tuple(sets[trie.of[k]][trie.start[k] : trie.end[k]].tolist()): sorted(trie.ends[k]) for k in range(len(trie.of))}
    assert paths == {(): [], (0, 1, 2): [2], (3,): [0, 4], (4, 5): [1], (7, 8): [3]}
    assert trie.longest[0] == 5 and trie.smallest[0] == 2
    seen = []

    class Path(np.ndarray):
        def __getitem__(self, k):
            seen.append(self.tolist())
            return np.ndarray.__getitem__(self, k)

    trie.sets = [s.view(Path) for s in sets]
    found = trie.join(np.array([0, 1, 2, 4, 5]), np.array([0, 5]), np.array([5]), 9)
    assert [(h.tolist(), k, n.tolist()) for h, k, n in found if k == 1] == [([0], 1, [5])]
    assert [7, 8] not in seen  # the bound leaves it before its first block


def test_components(spark):
    links = spark.createDataFrame([(k, k + 1) for k in range(40)] + [(100, 101), (102, 101), (-5, -5), (7, 3)], "a long, b long")
    labels = {r.node: r.label for r in jaccard.components(links).collect()}
    assert labels == {**dict.fromkeys(range(41), 0), 100: 100, 101: 100, 102: 100}


def test_stage_keeps_one_of_each(odd, copies):
    out = jaccard.one_of_each(copies)
    want = brute([tuple(r) for r in copies.collect()])
    assert sorted(r.doc_id for r in out.collect()) == sorted({c for _, _, c in want})
    rows = jaccard.one_of_each(odd)
    assert rows.columns == odd.columns
    kept = sorted(str(r.doc_id) for r in rows.collect())
    assert kept == sorted(str(x) for x in [None, 1, 2, 3, 4, 6, 7, 8, 9, 10, 11, 12])
    assert jaccard.one_of_each(odd.limit(0)).count() == 0


def test_stage_leaves_every_column_alone(spark):
    names = ["_first", "_fp", "_of", "_keep", "_many", "_row", "row", "id", "fp", "kept_id", "kept_fp", "many_id", "label", "n"]
    texts = ["one two three four five six", "one two three four five six", "seven eight nine ten eleven twelve", "", None, "one two three four five six"]
    ids = [(3, 3, 3, 3, 3, None), (1, 2, 3, 4, 5, 6), (7, 7, None, None, 8, 9)]
    for some in ids:
        rows = [(d, t, *[100 * k + i for i in range(len(names))]) for k, (d, t) in enumerate(zip(some, texts, strict=True))]
        out = jaccard.one_of_each(spark.createDataFrame(rows, "doc_id long, text string, " + ", ".join(f"{c} long" for c in names)))
        kept = [tuple(r) for r in out.collect()]
        assert out.columns == ["doc_id", "text", *names] and set(map(str, kept)) <= set(map(str, rows))
        assert sorted(str(r[1]) for r in kept) == sorted(map(str, ["one two three four five six", *texts[2:5]]))


def test_the_query(spark, documents):
    got_ = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.op2_jaccard_join(spark, "/root/testdata/sf0.001").collect()), key=str)
    assert got_ == brute([(r.doc_id, r.text) for r in documents.collect()])
