import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from nodalis.llm import byte_bpe as bb

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")
LIBRARY = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bb.read_ranks(PATH), special_tokens={})
PARTS = ["a", "s", "t", "re", "ve", "ll", "'", "''", "'s", "'re", "'d", "'M", " ", "  ", "\t", "\n", " ", "　", "\x1c", "\x85", "é", "漢", "\U0001f600", "½", "7", "42", ".", "--", "\x00", "<|endoftext|>", "word", " the", "\U0001e900", "Ᲊ", "̀"]


def test_pattern():
    assert bb.PATTERN == public_tokenizers.PATTERN


@settings(max_examples=500, deadline=None)
@given(st.lists(st.one_of(st.sampled_from(PARTS), st.characters(exclude_categories=["Cs"])), max_size=40).map("".join))
def test_equals_library(text):
    ids = bb.vocabulary(PATH).encode([text])[0]
    assert ids == LIBRARY.encode_ordinary(text)
    assert bb.vocabulary(PATH).decode(np.array(ids)) == text.encode()


def test_scan_is_the_running_composition():
    scanner, draw = bb.scanner(), np.random.default_rng(3)
    after, _ = bb.transitions()
    for n in (1, 2, bb.BLOCK, bb.BLOCK + 1, 5 * bb.BLOCK * bb.BLOCK + 7):
        symbols = draw.integers(0, bb.SYMBOLS, n)
        found, state = scanner.functions[scanner.scan(scanner.of_symbol[symbols])], np.arange(8)
        for i, symbol in enumerate(symbols):
            state = after[state, symbol]
            if i % 97 == 0 or i == n - 1:
                assert (found[i] == state).all()


def test_batches_memory_and_long_words(monkeypatch):
    monkeypatch.setattr(bb, "MEMO_WORDS", 50)
    draw = random.Random(5)
    texts = ["".join(draw.choice(PARTS) for _ in range(draw.randint(0, 300))) for _ in range(60)] + ["x" * 5000, "ab" * 3000, "ß漢" * 900, "".join(draw.choice("etaoin") for _ in range(20_000)), " " * 3000, ""]
    held = bb.ByteBpe(bb.read_ranks(PATH))
    for _ in range(2):
        assert held.encode(texts) == [LIBRARY.encode_ordinary(t) for t in texts]


def test_heap_equals_plain_merging(monkeypatch):
    draw, held = random.Random(6), bb.vocabulary(PATH)
    words = [bytes(draw.choice(b"aeinst \xc3\xa9") for _ in range(draw.randint(2, 47))) for _ in range(2000)]
    assert [held.merge(w) for w in words] == [held.merge_long(w) for w in words]
    assert [np.frombuffer(x, "<u4").tolist() for x in held.merge_batch(words)] == [held.merge(w) for w in words]


def test_rows(spark):
    rows = [(1, "it's  here", "x", 1), (1, "it's  here", "x", 1), (2, None, "x", 2), (3, "", None, 3), (None, "漢字 \U0001f600", "x", 4), (4, "word's " * 30_000, "x", 5), (5, "q" * 120_000, "x", 6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string, id long")
    got = bb.decode(bb.encode(docs, PATH), PATH).collect()
    want = [(i or 0, t or "", LIBRARY.encode_ordinary(t or "")) for i, t, _, _ in rows]
    assert sorted((r.doc_id or 0, r.decoded.decode(), list(r.ids), r.n_tokens) for r in got) == sorted((i, t, ids, len(ids)) for i, t, ids in want)
    for r in got:
        assert r.packed == np.array(r.ids, "<u4").tobytes()
        cut = [r.decoded[a:b] for a, b in zip([0, *r.ends], r.ends)]
        assert cut == [LIBRARY.decode_single_token_bytes(x) for x in r.ids]
    plain = bb.decode(spark.createDataFrame([(1, [40, 41]), (2, None), (3, [])], "doc_id long, ids array<int>"), PATH, ends_col=None)
    assert {r.doc_id: r.decoded for r in plain.collect()} == {1: LIBRARY.decode_bytes([40, 41]), 2: None, 3: b""}
    assert bb.encode(docs.limit(0), PATH).count() == 0
    with pytest.raises(ValueError):
        bb.vocabulary(PATH).decode(np.array([60_000]))


def test_query(spark):
    got = {r.doc_id: r for r in bb.op13_byte_bpe(spark, "/root/testdata/sf0.001").collect()}
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()
    assert len(got) == len(docs)
    for d in docs:
        ids = LIBRARY.encode_ordinary(d.text or "")
        assert (got[d.doc_id].n_tokens, got[d.doc_id].ids_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
        assert got[d.doc_id].decoded_sha256 == hashlib.sha256((d.text or "").encode()).hexdigest()
