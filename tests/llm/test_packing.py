import zlib

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from orrery.llm import packing, planes, shared, textbytes, tokens

SF = "/root/testdata/sf0.001"
ODD_TEXTS = ["a  b   c", "  x", "a\n\n b \n", "café,   x", "<|endoftext|>. a <|endoftext|>", "it's don't.", "", None, "  a  b", "É.é,x", "a \t\n c", "x́ ́y.", "12,3 4.5!?", " ", "Σ ΟΔΟΣ. ΟΔΟΣ", "a\n\nb\nc", "a  b", "x   y", "日本語。 テキスト", "a\r\n\r\nb", "\n", "x y z", "!!! ??? ...", "A.B,C;D", "\x1c a\x1fb"]


@pytest.mark.parametrize(("name", "end"), [("byte_bpe_50k.json", 0), ("word_bpe_49k.json", 1)])
def test_ids_are_the_library_s(documents, name, end):
    texts = ODD_TEXTS + [r.text for r in documents.select("text").limit(60).collect()]
    rng = np.random.default_rng(4)
    parts = ["a", "B", " ", "  ", "\n", ".", ",", "é", "'s", "12", "\t", " ", "x!", "?", "Ünï", "…", "—", "\r", "'"]
    texts += ["".join(rng.choice(parts, rng.integers(1, 25))) for _ in range(1500)]
    encoder = tokens.PieceEncoder(tokens.tokenizer_path(name))
    whole = Tokenizer.from_file(tokens.tokenizer_path(name))
    for _ in range(2):  # the second time from the lookup
        raw, off = textbytes.text_buffer(pa.array(texts, pa.string()))
        ids, rows = encoder.encode(raw, off, end)
        for k, e in enumerate(whole.encode_batch([t or "" for t in texts], add_special_tokens=False)):
            assert ids[rows[k] : rows[k + 1]].tolist() == [*e.ids, end], texts[k]


def test_decompose():
    sizes = np.array([1, 2048, 2049, 6143, 5, 0])
    row, start, length = packing.decompose(sizes)
    for k, n in enumerate(sizes.tolist()):
        s, m = start[row == k], length[row == k]
        assert m.sum() == n and (s == np.cumsum(m) - m).all() and ((m & (m - 1)) == 0).all()
        assert len(m) == n // 2048 + bin(n % 2048).count("1")


def test_pieces_rebuild_documents(odd, documents):
    docs = documents.select("doc_id", "text").union(odd.select("doc_id", "text"))
    rows = packing.pack(docs).collect()
    whole = Tokenizer.from_file(tokens.tokenizer_path(packing.TOKENIZER))
    want = sorted(([*whole.encode(r.text or "", add_special_tokens=False).ids, 1] for r in docs.collect()), key=str)
    by, out = {}, []
    for r in rows:
        assert len(r.ids) == 4 * r.length and r.length == 1 << r.bucket and r.length <= 2048 and r.offset == 0
    for r in sorted(rows, key=lambda r: r.sequence_id):
        ids = by.setdefault(str(r.doc_id), [])
        assert r.start == sum(map(len, ids)) % max(1, r.doc_tokens)
        ids.append(np.frombuffer(r.ids, "<u4").tolist())
        if r.start + r.length == r.doc_tokens:
            out.append(sum(ids, []))
            by[str(r.doc_id)] = []
    assert sorted(out, key=str) == want
    assert len({r.sequence_id for r in rows}) == len(rows)
    assert packing.pack(docs.limit(0)).count() == 0


@pytest.mark.parametrize("bits", [False, True])
def test_plane_files_round_trip(spark, odd, documents, bits):
    docs = documents.select("doc_id", "text").union(odd.select("doc_id", "text"))
    manifest = planes.write(docs, shared.shared_dir(spark, "planes"), block_ids=1000, bits=bits, parts=3)
    rows = planes.read(spark, manifest).collect()
    whole = Tokenizer.from_file(tokens.tokenizer_path(planes.TOKENIZER))
    want = []
    for d in docs.collect():
        ids = [*whole.encode(d.text or "", add_special_tokens=False).ids, 0]
        want.append((d.doc_id, len(ids), planes.crc32_of(np.array(ids))))
    rows.sort(key=lambda r: r.start)
    assert sorted(((r.doc_id, r.n_tokens, zlib.crc32(r.ids)) for r in rows), key=str) == sorted(want, key=str)
    assert [r.start for r in rows] == [0, *np.cumsum([r.n_tokens for r in rows]).tolist()[:-1]]
    ids = [-1 if r.doc_id is None else r.doc_id for r in rows]
    assert ids == sorted(ids)


def test_no_documents_give_no_files(spark, odd):
    for parts in (2, None):
        manifest = planes.write(odd.limit(0), shared.shared_dir(spark, "planes"), parts=parts)
        assert manifest == [] and planes.read(spark, manifest).count() == 0


def test_a_repeated_id_is_split_over_files(spark):
    docs = spark.createDataFrame([(None if k % 2 else 7, f"text {k % 5} of many") for k in range(400)], "doc_id long, text string")
    manifest = planes.write(docs, shared.shared_dir(spark, "planes"), parts=4)
    assert len(manifest) == 4 and max(m["n_docs"] for m in manifest) < 200
    rows = sorted(planes.read(spark, manifest).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in rows] == [None] * 200 + [7] * 200
    assert all(a.start + a.n_tokens == b.start for a, b in zip(rows, rows[1:]))


def test_batches_of_equal_lengths(spark, documents):
    pieces = packing.pack(documents.select("doc_id", "text"))
    buckets = packing.write_buckets(pieces, shared.shared_dir(spark, "packed"))
    assert sorted(map(str, buckets.collect())) == sorted(map(str, pieces.collect()))
    known = {r.sequence_id: bytes(r.ids) for r in pieces.collect()}
    for length in (1, 64, 2048):
        seen = []
        for r in packing.batches(buckets, length, 8).collect():
            assert 1 <= len(r.sequence_ids) <= 8 and len(r.ids) == 4 * length * len(r.sequence_ids)
            assert bytes(r.ids) == b"".join(known[k] for k in r.sequence_ids)
            seen += r.sequence_ids
        assert sorted(seen) == sorted(k for k, x in known.items() if len(x) == 4 * length)


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_the_plane_query(spark, documents):
    whole, at, want = Tokenizer.from_file(tokens.tokenizer_path(planes.TOKENIZER)), 0, []
    for r in sorted(documents.collect(), key=lambda r: r.doc_id):
        ids = [*whole.encode(r.text or "", add_special_tokens=False).ids, 0]
        want.append((r.doc_id, at, len(ids), crc(ids)))
        at += len(ids)
    assert sorted((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in planes.op7_bitplanes(spark, SF).collect()) == want


def test_the_packing_query(spark, documents):
    whole, want = Tokenizer.from_file(tokens.tokenizer_path(packing.TOKENIZER)), set()
    got = packing.op8_packing(spark, SF).collect()
    for r in documents.collect():
        ids, at = [*whole.encode(r.text or "", add_special_tokens=False).ids, 1], 0
        for n in [2048] * (len(ids) // 2048) + [1 << k for k in range(10, -1, -1) if len(ids) % 2048 >> k & 1]:
            want.add((r.doc_id, at, n, crc(ids[at : at + n]), len(ids), 0))
            at += n
    assert {(r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens, r.offset) for r in got} == want and len(want) == len(got) == len({r.sequence_id for r in got})


def test_planes():
    ids = np.array([0, 1, 255, 256, 50256, 2**31, 2**32 - 1], np.uint32)
    for bits in (False, True):
        assert (planes.from_planes(planes.to_planes(ids, bits), len(ids)) == ids).all()
