import itertools
import random

import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from nodalis.llm import sentencepieces as sp

PATH = public_tokenizers.path("piece_bpe_32k.model")
LIBRARY = sentencepiece.SentencePieceProcessor(model_file=PATH)
SCHEMA = "doc_id long, text string, ids string"
PARTS = ["a", "th", "the", "ing", " ", "  ", "▁", "é", "漢", "\U0001f600", "\n", "\t", "\x00", "1", ".", "##", "—", "<0x41>", "</s>", "    ", "reading"]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(PARTS), max_size=30).map("".join))
def test_equals_library(text):
    ids = sp.model(PATH).encode([text])[0]
    assert ids == LIBRARY.encode(text)
    assert sp.model(PATH).decode(ids) == LIBRARY.decode(ids)


def test_batches_and_long_words():
    draw = random.Random(4)
    words = ["".join(draw.choice("etaoinshrdluécv") for _ in range(draw.randint(1, 20))) for _ in range(4000)]
    texts = [" ".join(words[i::7]) for i in range(7)] + ["x" * 5000, "ab" * 3000 + " tail", ""]
    assert sp.model(PATH).encode(texts) == [LIBRARY.encode(t) for t in texts]


def test_unigram_finds_the_best_segmentation():
    """The same lattice with added scores, against every segmentation."""
    pieces = [("<unk>", 0.0, 2)] + [(p, s, 1) for p, s in (("a", -2.0), ("b", -2.5), ("ab", -3.1), ("ba", -3.0), ("aba", -4.9), ("▁", -1.0), ("▁a", -2.2), ("bb", -9.0))]
    model = sp.PieceModel.__new__(sp.PieceModel)
    model.kind, model.prefix, model.squeeze = sp.UNIGRAM, True, False
    model.build(pieces)
    score = {p: s for p, s, kind in pieces if kind == 1}
    words = ["▁" + "".join(w) for w in itertools.product("abc", repeat=5)]

    def best(word):
        if not word:
            return 0.0
        return max((score.get(word[:n], -19.0 if n == 1 else float("-inf")) + best(word[n:])) for n in range(1, len(word) + 1))

    found, counts = model.segment_batch(words)
    for word, row, n in zip(words, found, counts, strict=True):
        assert model.score[row[len(word) - n :]].sum() == pytest.approx(best(word))
        assert model.score[model.segment_word(word)].sum() == pytest.approx(best(word))


def test_rows(spark):
    rows = [(1, "hello world", "x"), (1, "hello world", "x"), (2, None, "x"), (3, "", "x"), (None, "漢字 \U0001f600", "x"), (4, "word " * 30_000, "x")]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = sp.encode(docs, PATH).collect()
    assert sorted((r.doc_id or 0, tuple(r.ids), r.n_tokens, r.round_trip) for r in got) == sorted(
        (i or 0, tuple(LIBRARY.encode(t or "")), len(LIBRARY.encode(t or "")), True) for i, t, _ in rows
    )
    back = sp.decode(sp.encode(docs, PATH).select("doc_id", "ids"), PATH).collect()
    assert {(r.doc_id, r.decoded) for r in back} == {(i, t or "") for i, t, _ in rows}
    assert sp.encode(docs.limit(0), PATH).count() == 0
