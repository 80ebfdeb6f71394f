import random
import re
from collections import Counter, defaultdict
from time import perf_counter

import duckdb
import numpy as np
import pytest

from nodalis.llm import collocations as co

SCHEMA = "doc_id long, lang string, text string, phrase int, f string"


def brute(rows, least, longest, top):
    counts, totals = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", lowered):
            words = re.findall("[^\x20\x09]+", piece)
            totals[lang] += len(words)
            for i in range(len(words)):
                for k in range(1, min(longest, len(words) - i) + 1):
                    counts[lang][tuple(words[i : i + k])] += 1
    out = []
    for lang, c in counts.items():
        found = {p: n for p, n in c.items() if n >= least and len(p) > 1}
        rows = []
        for p, a in found.items():
            if any(n >= a and len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q))) for q, n in found.items()):
                continue
            score, k = min((1000 * a * totals[lang] // (c[p[:k]] * c[p[k:]]), k) for k in range(1, len(p)))
            rows.append((-score, -a, " ".join(p).encode(), c[p[:k]], c[p[k:]]))
        out += [(lang, i, p.decode(), -a, left, right, totals[lang], -score) for i, (score, a, p, left, right) in enumerate(sorted(rows)[:top], 1)]
    return sorted(out)


def corpus():
    draw = random.Random(11)
    words = ["New", "york", "city", "of", "the", "big", "Ünter", "ünter", "a-b", "漢", "\x1c", "x"]
    rows = []
    for i in range(160):
        lang = draw.choice(["en", "en", "de", None, "und", ""])
        text = "".join(draw.choice(words) + draw.choice([" ", " ", " ", "\t ", ", ", ".", "\n", "!?"]) for _ in range(draw.randint(0, 60)))
        rows.append((i % 90, lang, draw.choice([text, text + " the big apple tree here"]) if i % 40 else None))
    return [*rows, *rows[:9], (1, "en", "alpha beta gamma delta epsilon zeta " * 40), (2, "fr", "w" * 50_000), (3, None, "")]


@pytest.mark.parametrize("most", [1 << 18, 7])
def test_equals_brute_force(spark, most, monkeypatch):
    monkeypatch.setattr(co, "BLOCK_BYTES", 1500)
    monkeypatch.setattr(co, "MOST_WORDS", 20)
    rows = corpus()
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA).repartition(3)
    got = co.collocations(docs, least=9, top=25, most=most).collect()
    assert sorted((r.lang, r["rank"], r.phrase, r.a, r.l, r.r, r.n, r.score) for r in got) == brute([r[1:] for r in rows], 9, 5, 25)


def test_empty_and_unfrequent(spark):
    docs = spark.createDataFrame([(1, "en", "one two", 1, "x"), (2, None, None, 1, "x")], SCHEMA)
    assert co.collocations(docs).count() == 0
    assert co.collocations(docs.limit(0)).count() == 0


def test_large_products(spark):
    """1000 a n and l r pass 64 bits; the score stays exact."""
    n = 3 * 10**12 + 7
    known = spark.createDataFrame([("en", 1, "p", n // 2), ("en", 1, "q", n // 3), ("en", 2, "p q", n // 5)], "lang string, k int, phrase string, f long")
    totals = spark.createDataFrame([("en", n)], "lang string, n long")
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(co, "frequent_phrases", lambda *a: (known, totals))
        row = co.collocations(known.withColumn("text", known.phrase)).head()
    assert row.score == 1000 * (n // 5) * n // ((n // 2) * (n // 3))


def test_trie_follows_every_path():
    draw = random.Random(2)
    words = [f"w{i}".encode() for i in range(400)]
    phrases = sorted({(draw.choice("abc"), b" ".join(draw.choice(words) for _ in range(draw.randint(1, 4)))) for _ in range(20_000)})
    began = perf_counter()
    trie = co.Trie(phrases)
    assert perf_counter() - began < 20
    assert len(trie.check) < 6 * 20_000 * 5 + 4096  # an array hardly longer than it has states
    for i in draw.sample(range(len(phrases)), 2000):
        lang, phrase = phrases[i]
        codes = np.array([trie.codes[w] for w in phrase.split(b" ")], np.int32)
        end = trie.advance(np.array([trie.roots[lang]] + [0] * (len(codes) - 1), np.int32), codes, len(codes))
        assert trie.accept[end[0]] == i
    known = set(phrases)
    codes = np.array([draw.randint(0, 400) for _ in range(6000)], np.int32)
    names = {c: w for w, c in trie.codes.items()}
    ends = trie.advance(np.full(6000, trie.roots["a"], np.int32), codes, 2)
    for i in range(5998):
        held = ends[i] > 0 and trie.accept[ends[i]] >= 0
        assert held == (("a", b" ".join(names.get(c, b"?") for c in codes[i : i + 2].tolist())) in known)


def test_query_equals_sql(spark):
    at = "/root/testdata/sf0.001"
    got = co.op11_collocations(spark, at).collect()
    with duckdb.connect() as db:
        db.execute(f"CREATE VIEW documents AS SELECT * FROM '{at}/documents.parquet'")
        assert sorted(map(tuple, got)) == sorted(db.execute(co.OP11_SQL).fetchall())
