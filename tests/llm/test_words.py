"""Words and pieces whose bytes follow a pattern: no operator may take two of them for one."""

import numpy as np
import pytest

from orrery.llm import decontam, jaccard, tokens
from orrery.llm.textbytes import range_hashes

SIZES = [512, 1024, 2048, 4096, 8192]


def thue_morse(n: int, flip: bool = False) -> str:
    word = "a"
    while len(word) < n:
        word += word.translate(str.maketrans("ab", "ba"))
    return word.translate(str.maketrans("ab", "ba")) if flip else word


PAIRS = [(thue_morse(n), thue_morse(n, True)) for n in SIZES]


def test_hashes_of_patterned_words_differ():
    words = [w for pair in PAIRS for w in pair]
    words += [("a" * k, "a" * k + "\0")[z] for k in range(1, 30) for z in (0, 1)]
    words += [w[:k] + "c" + w[k + 1 :] for w in (PAIRS[0][0],) for k in range(0, 512, 7)]
    data = np.frombuffer("".join(words).encode(), np.uint8)
    stops = np.cumsum([len(w) for w in words])
    h = range_hashes(data, np.concatenate([[0], stops[:-1]]), stops)
    assert len(set(h.tolist())) == len(set(words))
    alone = [int(range_hashes(np.frombuffer(w.encode(), np.uint8), np.array([0]), np.array([len(w)]))[0]) for w in words]
    assert alone == h.tolist()


def test_jaccard_keeps_patterned_words_apart(spark):
    rows = [(2 * k + f, w) for k, pair in enumerate(PAIRS) for f, w in enumerate(pair)]
    got = {r["doc_id"]: r["component_id"] for r in jaccard.join(spark.createDataFrame(rows, "doc_id long, text string")).by_document().collect()}
    assert got == {k: k for k, _ in rows}


def test_decontamination_keeps_patterned_words_apart(spark):
    docs = spark.createDataFrame([(k, pair[0]) for k, pair in enumerate(PAIRS)], "doc_id long, text string")
    items = spark.createDataFrame([(k, pair[1]) for k, pair in enumerate(PAIRS)], "item_id long, text string")
    assert decontam.find(docs, items).where("size(matches) > 0").count() == 0
    assert decontam.find(docs, docs.withColumnRenamed("doc_id", "item_id")).where("size(matches) = 1").count() == len(PAIRS)


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_pieces_are_told_by_their_bytes(name):
    from tokenizers import Tokenizer

    file = tokens.tokenizer_path(name)
    plain, encoder = Tokenizer.from_file(file), tokens.PieceEncoder(file)
    for word in (w for pair in PAIRS for w in pair):
        raw = np.frombuffer(word.encode(), np.uint8)
        ids, _ = encoder.encode(raw, np.array([0, len(raw)]))
        assert ids.tolist() == plain.encode(word, add_special_tokens=False).ids
