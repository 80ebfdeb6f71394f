import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from nodalis.llm import common, token_counts
from nodalis.llm.common import fresh_path

PATH = public_tokenizers.path("byte_bpe_50k.json")
SCHEMA = "doc_id long, text string, content_digest string, n_tokens string"
TEXTS = ["Hello world's end", "", None, " <|endoftext|> inside", "漢字 \U0001f600\n\n  tabs\t", "x" * 50_000, "a b " * 5_000, "  lead", "trail  ", "l'été  ², 12３"]


def test_memo_equals_library():
    library, counter = Tokenizer.from_file(PATH), token_counts.TokenCounter(PATH)
    draw = random.Random(3)
    parts = ["ab", "c", "D's", " ", "  ", "\n", "\t", "'ll", "é", "²", "½", "ª", "×", "...", "12", "3", "’", "<|endoftext|>", "漢", "\U0001f600", "\xa0", "\x1c", "\x85", " "]
    for _ in range(4000):
        text = "".join(draw.choice(parts) for _ in range(draw.randint(0, 12)))
        assert counter.count(text) == len(library.encode(text, add_special_tokens=False).ids), repr(text)


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_counts_and_cache(spark, name):
    path = public_tokenizers.path(name)
    library = Tokenizer.from_file(path)
    want = lambda t: len(library.encode(t or "", add_special_tokens=False).ids)
    rows = [(i, t, "clash", "clash") for i, t in enumerate(TEXTS)] + [(0, TEXTS[0], "c", "c"), (None, TEXTS[0], "c", "c"), (None, "only null id", "c", "c")] + [(50 + i, "many copies", "c", "c") for i in range(40)]
    cache = fresh_path(spark, "cache-test")
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = token_counts.count_tokens(docs, path, cache).collect()
    key = lambda r: (str(r[0]), r[1], r[2])
    assert sorted(((r.doc_id, r.n_bytes, r.n_tokens) for r in got), key=key) == sorted(((i, len((t or "").encode()), want(t)) for i, t, *_ in rows), key=key)
    stored = spark.read.parquet(cache)
    distinct = len({t or "" for _, t, *_ in rows})
    assert stored.count() == distinct  # each text was encoded once
    more = spark.createDataFrame([(1, "many copies", "c", "c"), (2, "something new", "c", "c")], SCHEMA)
    assert {r.doc_id: r.n_tokens for r in token_counts.count_tokens(more, path, cache).collect()} == {1: want("many copies"), 2: want("something new")}
    assert spark.read.parquet(cache).count() == distinct + 1
    assert token_counts.count_tokens(docs.limit(0), path, fresh_path(spark, "cache-test")).count() == 0


def test_cache_that_holds_most(spark, monkeypatch):
    """Few bits, so that places clash: results and the number of encoded texts stay the same."""
    monkeypatch.setattr(common, "MAP_BITS", 256)
    library = Tokenizer.from_file(PATH)
    cache = fresh_path(spark, "cache-test")
    old = spark.createDataFrame([(i, f"stored text {i}", "c", "c") for i in range(180)], SCHEMA)
    token_counts.count_tokens(old, PATH, cache)
    rows = [(i, f"stored text {i % 200}", "c", "c") for i in range(300)] + [(None, "alone", "c", "c")]
    got = token_counts.count_tokens(spark.createDataFrame(rows, SCHEMA).repartition(5), PATH, cache).collect()
    assert sorted((str(r.doc_id), r.n_tokens) for r in got) == sorted((str(i), len(library.encode(t).ids)) for i, t, *_ in rows)
    assert spark.read.parquet(cache).count() == 201


def test_versions_do_not_meet(spark):
    cache = fresh_path(spark, "cache-test")
    docs = spark.createDataFrame([(1, "Hello THERE world", "c", "c")], SCHEMA)
    for name in ("byte_bpe_50k.json", "word_bpe_49k.json"):
        path = public_tokenizers.path(name)
        assert token_counts.count_tokens(docs, path, cache).first().n_tokens == len(Tokenizer.from_file(path).encode("Hello THERE world", add_special_tokens=False).ids)
    assert spark.read.parquet(cache).count() == 2
