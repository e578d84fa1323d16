"""Token counts and the token store against the libraries."""

import zlib

import numpy as np
import pytest

P = pytest.importorskip("public_tokenizers")


def test_counts_equal_the_library(spark, awkward, nothing, all_null):
    import sentencepiece

    from tremorlake.llm.token_counts import MODEL, token_counts

    sp = sentencepiece.SentencePieceProcessor(model_file=P.path(MODEL))
    got = token_counts(awkward, P.path(MODEL), limit=100)
    assert set(awkward.columns) <= set(got.columns) and got.columns.count("n_tokens") == 1
    rows = got.collect()
    assert len(rows) == awkward.count()
    for r in rows:
        n = len(sp.encode(r["text"] or ""))
        assert (r["n_bytes"], r["n_tokens"], r["over_limit"]) == (len((r["text"] or "").encode()), n, n > 100)
    assert token_counts(nothing, P.path(MODEL)).count() == 0
    assert [r["n_tokens"] for r in token_counts(all_null, P.path(MODEL)).collect()] == [0, 0, 0]


def test_small_table_starts_anew():
    import pyarrow as pa
    import sentencepiece

    from tests_llm_text import prose
    from tremorlake.llm.text import column_bytes
    from tremorlake.llm.token_counts import MODEL, Transducer

    machine = Transducer(P.path(MODEL), max_cells=20_000)
    sp = sentencepiece.SentencePieceProcessor(model_file=P.path(MODEL))
    for seed in range(6):
        texts = [prose(seed * 10 + i, 200) for i in range(4)] + ["é" * seed, "=" * 1500]
        got = machine.counts(*column_bytes(pa.array(texts)))
        assert got.tolist() == [len(x) for x in sp.encode(texts)]


def test_store_equals_the_library(spark, awkward, nothing):
    from tokenizers import Tokenizer

    from tremorlake.llm.token_store import END, MODEL, read_blocks, write_blocks

    tk = Tokenizer.from_file(P.path(MODEL))
    rows = read_blocks(write_blocks(awkward, P.path(MODEL), block_ids=2000)).orderBy("start").collect()
    want = sorted((r["doc_id"] is not None, r["doc_id"] or 0) for r in awkward.collect())
    assert [(r["doc_id"] is not None, r["doc_id"] or 0) for r in rows] == want
    texts = {}
    for r in awkward.collect():
        ids = np.array([*tk.encode(r["text"] or "", add_special_tokens=False).ids, END], "<u4")
        texts.setdefault(r["doc_id"], []).append((len(ids), zlib.crc32(ids.tobytes())))
    at = 0
    for r in rows:
        assert r["start"] == at
        at += r["n_tokens"]
        texts[r["doc_id"]].remove((r["n_tokens"], r["ids_crc32"]))
    assert read_blocks(write_blocks(nothing, P.path(MODEL))).count() == 0


def test_repair_round_trip():
    from tremorlake.llm.token_store import Block, compress

    rng = np.random.default_rng(1)
    for n, kinds in ((0, 5), (1, 5), (2, 5), (5000, 3), (20_000, 50), (3000, 60_000)):
        ids = rng.integers(0, kinds, n).astype(np.uint32)
        if n == 5000:
            ids[:2500] = 1  # runs of one id overlap with themselves
        block = Block(compress(ids, 60_000))
        assert np.array_equal(block.ids(), ids)
        for a, b in rng.integers(0, n + 1, (20, 2)):
            assert np.array_equal(block.range(min(a, b), max(a, b)), ids[min(a, b) : max(a, b)])
    assert len(compress(np.tile(np.arange(10, dtype=np.uint32), 2000), 100)) < 8000
