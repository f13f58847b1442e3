import math
import re
from collections import Counter

from pyspark.sql import functions as F

from orrery.llm import quality


def brute(text):
    text = text or ""
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text) if w]
    grams = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    hit = {i + d for i in range(len(words) - 2) if grams[tuple(words[i : i + 3])] > 1 for d in range(3)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(hit)


def test_statistics_match_brute_force(odd, documents):
    docs = odd.select("doc_id", "text", "lang").union(documents.select("doc_id", "text", "lang"))
    rows = quality.statistics(docs, ["doc_id", "text"]).collect()
    assert len(rows) == docs.count()
    for r in rows:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute(r.text), r.doc_id


def test_binomial_tail_is_exact(spark):
    cases = [(0, 100), (3, 500), (9, 1000), (40, 5000), (80, 5000)]
    got = spark.createDataFrame(cases, "k long, n long").select("k", "n", quality.binomial_tail(F.col("k"), F.col("n"), 0.01).alias("p")).collect()
    for r in got:
        exact = sum(math.comb(r.n, i) * 0.01**i * 0.99 ** (r.n - i) for i in range(r.k + 1))
        assert math.isclose(r.p, 1.0 if r.k >= r.n * 0.01 else exact, rel_tol=1e-9)


def test_cutoffs_hold_the_risk(spark):
    good = [(i, "en", 1000, 5000, 2 * (i % 10 == 0) + (600 if i < 3 else 0), 0, 10, 0, 0, i) for i in range(6000)]
    bad = [(6000 + i, "en", 1000, 5000, 900, 0, 10, 0, 0, 6000 + i) for i in range(500)]
    stats = spark.createDataFrame(good + bad, "doc_id long, lang string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_lines long, n_repeat_words long, n_capitals long, text_hash long")
    labels = spark.createDataFrame([(i, int(i < 6000)) for i in range(6500)], "doc_id long, quality int")
    chosen = quality.fit(stats, labels)
    kept = {r.doc_id for r in quality.judge(stats, chosen).where("kept").collect()}
    assert not any(i >= 6000 for i in kept)
    assert sum(i < 6000 for i in kept) >= 0.98 * 6000
    assert quality.fit(stats.where("doc_id < 50"), labels).count() == 0
    # thousands of copies of a few texts are no more than a few draws
    copies = stats.withColumn("text_hash", F.col("text_hash") % 40)
    assert quality.cutoffs(copies, labels).select(F.max("n_good")).first()[0] == 40
    assert quality.fit(copies, labels).count() == 0


def test_strata_beyond_the_broadcast_give_the_same(spark, monkeypatch):
    stats = spark.createDataFrame([(i, None if i % 4 == 3 else f"s{i % 4}", 1000, 5000, 900 if i % 50 == 0 else i % 3, 0, 10, 0, 0, i) for i in range(8000)], "doc_id long, lang string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_lines long, n_repeat_words long, n_capitals long, text_hash long")
    chosen = quality.fit(stats, spark.createDataFrame([(i, 1) for i in range(8000) if i % 50], "doc_id long, quality int"))
    assert chosen.count() == 4
    want = sorted(map(str, quality.judge(stats, chosen).collect()))
    assert sum("kept=False" in x for x in want) == 160
    monkeypatch.setattr(quality, "MAX_STRATA", 2)
    assert sorted(map(str, quality.judge(stats, chosen).collect())) == want


def cutoffs_by_hand(rows, good):
    """Cutoffs by stratum and rule, by plain Python: rows of (id, stratum, text, ratios, base_failed)."""
    drawn = {(s, t): r for i, s, t, r, failed in rows if i in good and not failed}
    strata, out = {s for s, _ in drawn}, {}
    for s in strata:
        for k, tries in quality.CUTOFFS.items():
            values, worst = [r[k] for (x, _), r in drawn.items() if x == s], 0.0
            for cut in tries:
                n, bad, p = len(values), sum(v is not None and v > cut for v in values), quality.RISK / len(quality.CUTOFFS)
                worst = max(worst, 1.0 if bad >= n * p else sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(bad + 1)))
                if worst <= quality.DELTA / (len(quality.CUTOFFS) * len(strata)):
                    out[s, k] = cut
    return out


def test_the_query_and_its_verdicts(spark, monkeypatch):
    # at this size the risk must be larger for any cutoff to be safe
    monkeypatch.setattr(quality, "RISK", 0.4)
    monkeypatch.setattr(quality.keep_good, "__defaults__", (0.4, quality.DELTA))
    monkeypatch.setattr(quality.fit, "__defaults__", (0.4, *quality.fit.__defaults__[1:]))
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    low = {}
    for r in labels.collect():
        low[r.doc_id] = min(low.get(r.doc_id, 9), r.quality)
    rows, base = [], {}
    for r in docs.collect():
        n, chars, symbols, dup, repeats = brute(r.text)
        lines = sum(bool(re.search(r"[^\x20\x09-\x0D]", x)) for x in (r.text or "").split("\n"))
        capitals = sum("A" <= c <= "Z" for c in r.text or "")
        failed = n < 50 or 100 * repeats > 50 * n
        base[r.doc_id] = (n, chars, symbols, dup, repeats, failed)
        part = lambda a, b: a / b if b else None
        rows.append((r.doc_id, r.lang, r.text, {"symbols": part(symbols, chars), "dup_lines": part(dup, lines), "repeats": part(repeats, n), "capitals": part(capitals, chars)}, failed))
    chosen = cutoffs_by_hand(rows, {i for i, q in low.items() if q == 1})
    assert chosen
    kept = {i: not failed and not any((s, k) in chosen and v is not None and v > chosen[s, k] for k, v in r.items()) for i, s, _, r, failed in rows}
    got = quality.op9_quality_rules(spark, "/root/testdata/sf0.01").collect()
    assert {r.doc_id: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in got} == base
    assert {r.doc_id: r.kept for r in got} == kept and sum(not kept[i] and not b[-1] for i, b in base.items()) > 0
    assert {r.doc_id for r in quality.keep_good(docs, labels).collect()} == {i for i, k in kept.items() if k}


def test_stage_keeps_columns_and_odd_rows(spark, odd):
    labels = spark.createDataFrame([(4, 1, 0), (None, 0, 0), (5, None, None)], "doc_id long, quality int, toxic int")
    out = quality.keep_good(odd, labels)
    assert out.columns == odd.columns
    assert {r.doc_id for r in out.collect()} <= {10, 7, 12}
    assert quality.keep_good(odd.limit(0), labels.limit(0)).count() == 0


def test_no_text_meets_the_labels(spark, monkeypatch):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet") for t in ("documents", "labels"))
    plans, fit = [], quality.fit
    monkeypatch.setattr(quality, "fit", lambda stats, *rest: plans.append(stats._jdf.queryExecution().optimizedPlan().toString()) or fit(stats, *rest))
    kept = quality.keep_good(docs, labels)
    assert kept.count() > 0 and len(plans) == 1 and "Join" not in plans[0]
