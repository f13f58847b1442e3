import numpy as np
import pytest
from tokenizers import Tokenizer

from orrery.llm import packing, pii, shared, tokens

corpus_pipeline = pytest.importorskip("corpus_pipeline")

SF = "/root/testdata/sf0.001"


def test_run_is_its_stages_by_brute_force(spark):
    from test_decontam import brute as contaminated
    from test_jaccard import brute as groups
    from test_quality import brute as counts

    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    kept = {}
    for doc, text in docs.items():  # too few labels at this size for a cutoff: the base rules decide
        n, _, _, _, repeats = counts(text)
        if n >= 50 and 100 * repeats <= 50 * n:
            kept[doc] = text
    kept = {doc: kept[doc] for doc, _, c in groups(list(kept.items())) if doc == c}
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    bad = {int(r[0]) for r in contaminated(list(kept.items()), items) if r[2]}
    whole = Tokenizer.from_file(tokens.tokenizer_path(packing.TOKENIZER))
    want = {}
    for doc, text in kept.items():
        if doc not in bad:
            text = pii.redacted(text, pii.spans_of(text, pii.automaton()))
            want[doc] = [*whole.encode(text, add_special_tokens=False).ids, 1]
    got = {}
    for r in sorted(corpus_pipeline.run(spark, SF).collect(), key=lambda r: (r.doc_id, r.start)):
        got.setdefault(r.doc_id, []).extend(np.frombuffer(r.ids, "<u4").tolist())
    assert got == want


def test_stages_take_odd_and_no_rows(spark, odd):
    for rows in (odd, odd.limit(0)):
        docs = shared.written(rows, "odd")
        for name, stage in corpus_pipeline.STAGES:
            docs = shared.written(stage(spark, docs, SF), name)
            assert docs.columns == odd.columns or name == "packing"
    assert docs.count() == 0
