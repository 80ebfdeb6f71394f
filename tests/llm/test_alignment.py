import hashlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from nodalis.llm import alignment as al

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
FIRST, SECOND = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
FIRST.encode_special_tokens = True
BYTES = al.byte_of_symbol()
PARTS = ["a", "the", " the", "reading", " ", "  ", "\t", "\n", "\n ", " \n", "é", "漢", "\U0001f600", "▁", "1", "2024", ".", "##", "'s", "\x00", "<|endoftext|>", "<0x41>", "<s>", " ", "wörter"]


def plain(text):
    """Groups by walking both lists of tokens side by side."""
    if not text:
        return []
    spaced = (" " + text).encode()
    a = [(i, bytes(BYTES[c] for c in FIRST.id_to_token(i))) for i in FIRST.encode(" " + text, add_special_tokens=False).ids]
    b = [(i, bytes([int(p[3:5], 16)]) if SECOND.is_byte(i) else p.replace("▁", " ").encode()) for i in SECOND.encode(text) for p in [SECOND.id_to_piece(i)]]
    if b"".join(x for _, x in a) != spaced or b"".join(x for _, x in b) != spaced:
        return []
    out, left, right, size = [], [], [], 0
    a, b = a[::-1], b[::-1]
    while a or b:
        if size <= 0:
            i, x = a.pop()
            left.append(i)
            size += len(x)
        else:
            i, x = b.pop()
            right.append(i)
            size -= len(x)
        if size == 0 and left and right:
            out.append((left, right))
            left, right = [], []
    return out


def brute(texts):
    groups = [plain(t) for t in texts]
    links = [Counter((x, y) for left, right in g for x in left for y in right) for g in groups]
    held = Counter(pair for c in links for pair in c)
    best = defaultdict(int)
    for (x, _), n in held.items():
        best[x] = max(best[x], n)
    for g, c in zip(groups, links, strict=True):
        text = ";".join(f"{','.join(map(str, x))}|{','.join(map(str, y))}" for x, y in g)
        yield (
            sum(len(x) for x, _ in g), sum(len(y) for _, y in g), len(g), sum(c.values()),
            sum(n for p, n in c.items() if held[p] == best[p[0]]), sum(n * held[p] for p, n in c.items()),
            hashlib.sha256(text.encode()).hexdigest() if g else "",
        )


def rows_of(found):
    names = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
    return sorted((r.doc_id or 0, *(r[n] for n in names)) for r in found.collect())


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(PARTS), max_size=25).map("".join))
def test_groups_equal_a_walk(text):
    record, want = al.aligner(A, B).align(["ab", text, "a b"])[1], plain(text)
    assert (record is None) == (not want)
    if record:
        assert record.groups == ";".join(f"{','.join(map(str, x))}|{','.join(map(str, y))}" for x, y in want)
        codes, times = al.distinct_links(record)
        assert dict(zip(codes.tolist(), times.tolist(), strict=True)) == Counter(x << 32 | y for left, right in want for x in left for y in right)


def test_long_groups_by_distinct_ids(monkeypatch):
    model = al.Aligner(A, B)
    model.a_bytes, model.b_bytes = [b"", b"a" * 11, b"a" * 11], [b"a" * 13, b"a" * 13]
    model.set_tables()
    given = [[1, 2, 2] * 4 + [1]] * 2, [[0, 1] * 5 + [0]] * 2
    records = model.records(*given)
    assert all(r.long and not len(r.codes) and (r.n_a, r.n_b, r.n_groups) == (13, 11, 1) for r in records)
    monkeypatch.setattr(al, "FEW_LINKS", 10**9)
    for record, plainly in zip(records, model.records(*given), strict=True):
        assert not plainly.long and plainly.groups == record.groups
        for x, y in zip(al.distinct_links(record), al.distinct_links(plainly), strict=True):
            assert x.tolist() == y.tolist()


def test_both_libraries_of_the_first_tokenizer_agree():
    """On every distinct word of the table, with what stands around it."""
    model = al.aligner(A, B)
    assert model.fast
    texts = [t for t in pq.read_table("/root/testdata/sf0.01/documents.parquet").column("text").to_pylist() if t and al.SETTLED.fullmatch(t)]
    words = sorted({f" {w}" for t in texts for w in t.split()})
    assert len(words) > 20_000
    assert [e.ids for e in FIRST.encode_batch(words, add_special_tokens=False)] == model.fast.encode_ordinary_batch(words, num_threads=1)


def test_narrow():
    for values in ([], [0], [255, 3], [256], [70_000, 1], [2**33]):
        assert al.wide(al.narrow(np.array(values, np.int64)), len(values)).tolist() == values


def test_rows_and_small_chunks(spark, monkeypatch):
    texts = ["the cat sat on the mat", "the cat sat on the mat", None, "", "  two  spaces\n\n and\ttabs ", "▁ literal", "漢字 and \U0001f600 emoji", "word's " * 20_000, "q" * 100_000, "Über größe, naïve façade", "<|endoftext|> in text", "the end"]
    docs = spark.createDataFrame([(None if i == 3 else i // 2, t, 7, "x") for i, t in enumerate(texts)], "doc_id long, text string, chunk long, id string")
    want = sorted((0 if i == 3 else i // 2, *row) for i, row in enumerate(brute(texts)))
    assert rows_of(al.link_counts(docs.coalesce(1), A, B)) == want
    assert rows_of(al.link_counts(docs.repartition(5), A, B)) == want
    assert al.link_counts(docs.limit(0), A, B).count() == 0


def test_query_equals_brute_force(spark):
    at = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{at}/documents.parquet").collect()
    assert rows_of(al.op12_alignment(spark, at)) == sorted((d.doc_id, *row) for d, row in zip(docs, brute([d.text for d in docs]), strict=True))
