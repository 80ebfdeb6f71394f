import random
import re
from itertools import combinations

import numpy as np
import pytest
import xxhash

from nodalis.llm import simhash

SCHEMA = "doc_id long, text string, fp string"


def brute_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def brute_components(fps):
    """id -> smallest reachable id, for {id: fingerprint}."""
    parent = {i: i for i in fps}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, j in combinations(sorted(fps), 2):
        if (fps[i] ^ fps[j]).bit_count() <= 2:
            a, b = sorted((root(i), root(j)))
            parent[b] = a
    return {i: root(i) for i in fps}


def test_codewords_within_four():
    """Every two 23-bit words that differ in one bit share a decoded codeword."""
    words = np.arange(1 << 23, dtype=np.int64)[:: 97]
    own = simhash.codewords(words)
    for bit in range(23):
        other = simhash.codewords(words ^ (1 << bit))
        assert (own[:, :, None] == other[:, None, :]).any(axis=(1, 2)).all()


def test_every_link_shares_a_key():
    draw = random.Random(5)
    fps = np.array([draw.getrandbits(64) for _ in range(30)], np.uint64)
    own = [set(k) for k in simhash.keys(fps).tolist()]
    for bits in combinations(range(64), 2):
        flip = np.uint64(sum(1 << b for b in bits))
        assert all(a & set(b) for a, b in zip(own, simhash.keys(fps ^ flip).tolist(), strict=True))


@pytest.mark.parametrize("text", ["", " \t", "One", "ONE two", "a b c", "É É é \x0b x y z", "w " * 9 + "end", "p\x85q r　s t u v"])
def test_fingerprint(text):
    assert simhash.fingerprint(text) == brute_fingerprint(text)


def test_long_text_in_chunks():
    text = " ".join(str(i * i % 977) for i in range(2 * simhash.CHUNK + 5))
    assert simhash.fingerprint(text) == brute_fingerprint(text)


@pytest.mark.parametrize("bucket", [64, 2])
def test_components(spark, bucket, monkeypatch):
    """Random clusters of fingerprints with chains, by the pair join and by the way for large keys."""
    draw, fps = random.Random(3), {}
    for cluster in range(40):
        at = draw.getrandbits(64)
        for _ in range(draw.randint(1, 12)):
            fps[len(fps) * 3 + 1] = at
            for _ in range(draw.choice([0, 1, 2, 2, 3])):
                at ^= 1 << draw.randrange(64)
    signed = [(i, f - (1 << 64) if f >> 63 else f) for i, f in fps.items()]
    nodes = spark.createDataFrame(signed, "id long, fp long").groupBy("fp").agg({"id": "min"}).withColumnRenamed("min(id)", "least")
    roots = {r.node: r.root for r in simhash.components(simhash.links(nodes, bucket)).collect()}
    classes = {}
    for i, f in signed:
        classes.setdefault(roots.get(f, f), []).append(i)
    got = {i: min(group) for group in classes.values() for i in group}
    assert got == brute_components(fps)


def test_documents(spark):
    base = "the quick brown fox jumps over the lazy dog and runs away from every other animal in the wide green forest"
    texts = [base, base.upper(), base + " ", None, "", base.replace("dog", "cat"), "something else entirely here", "x", "X", base * 40, base * 40 + " end"]
    rows = [(10 - i, t, "clash") for i, t in enumerate(texts)] + [(10, base, "clash"), (4, texts[6], "clash"), (4, texts[6], "clash")]
    got = simhash.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()
    fps = {i: brute_fingerprint(t) for i, t, _ in rows}
    assert len(got) == len(rows)
    assert {r.doc_id: r.fp % (1 << 64) for r in got} == fps
    assert {r.doc_id: r.component_id for r in got} == brute_components(fps)
    docs = spark.createDataFrame(rows, SCHEMA)
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(brute_components(fps).values()))


def test_empty(spark):
    assert simhash.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0
