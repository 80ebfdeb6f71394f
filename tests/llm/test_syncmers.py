import hashlib
import random
import re

import pytest
import xxhash
from pyspark.sql import functions as F

from nodalis.llm import syncmers

SCHEMA = "doc_id long, text string, tail string"


def long64(value: bytes, seed: int = 42) -> int:
    h = xxhash.xxh64_intdigest(value, seed)
    return h - (1 << 64) if h >= 1 << 63 else h


def chained(values):
    """Spark's xxhash64 of several longs: the hash of one is the seed of the next."""
    seed = 42
    for v in values:
        seed = xxhash.xxh64_intdigest((v % (1 << 64)).to_bytes(8, "little"), seed % (1 << 64))
    return seed


def brute(text, k=5):
    pieces = [w[i : i + 32] for w in re.findall(r"[^\x20\x09-\x0D]+", text or "") for i in range(0, len(w), 32)]
    hashes = [long64(p.encode()) for p in pieces]
    if len(hashes) < k:
        return None if hashes else []
    out = []
    for i in range(len(hashes) - k + 1):
        run = hashes[i : i + k]
        if min(run) in (run[0], run[-1]):
            out.append((i, chained(run) & 0x7FFFFFFF))
    return out


def brute_marks(found):
    links = {("link", a[1], b[0] - a[0], b[1]) for a, b in zip(found, found[1:], strict=False)}
    return {h for _, h in found} | links


def split(anchors):
    return [(a >> 31, a & 0x7FFFFFFF) for a in anchors]


def texts():
    words = "of the and was for with over under river stone".split()
    out = [None, "", " \t\n", "one", "x" * 300, "\U0001f600é " * 7]
    out += [" ".join(words[(i * i + j * (i + 3)) % 10] + str((j * j + i) % 17) for j in range(5 + 9 * i)) for i in range(20)]
    return out + [out[10], out[10]]


def test_anchors_match_definition(spark):
    rows = [(i, t, "clash") for i, t in enumerate(texts())]
    got = {r.doc_id: r.a for r in spark.createDataFrame(rows, SCHEMA).select("doc_id", syncmers.anchors(F.coalesce("text", F.lit(""))).alias("a")).collect()}
    for i, t, _ in rows:
        want = brute(t)
        assert len(got[i]) == 1 if not want and (t or "").strip() else split(got[i]) == want


def test_comparison_with_edits(spark):
    rows = [(i, t, "clash") for i, t in enumerate(texts())]
    got = {r.doc_id: r for r in syncmers.compare_with_edits(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()}
    n = len(rows)
    assert len(got) == n
    marks = {i: brute_marks(brute(t)) if brute(t) else {("whole", t)} if (t or "").strip() else set() for i, t, _ in rows}
    for i, t, _ in rows:
        t, following = t or "", (rows[i - 1] if i else rows[-1])[1] or ""
        cut = len(t) // 3
        edited = t[: len(t) - cut] + following[:cut]
        assert got[i].n_chars == len(t)
        assert got[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        a, b, c = marks[i], brute(edited), marks[(i - 1) % n]
        assert got[i].near_next == pytest.approx(len(a & c) / len(a | c) if a | c else 1.0)
        if brute(t) and b:
            b = brute_marks(b)
            assert got[i].near_edited == pytest.approx(len(a & b) / len(a | b))
            assert got[i].fingerprint == ",".join(f"{p}:{h}" for p, h in brute(t))
    assert got[26].fingerprint == got[27].fingerprint == got[10].fingerprint
    assert got[27].near_next == 1.0


def test_matching_is_by_position(spark):
    """An insertion in front changes little; the same runs in another order share anchors but few links."""
    draw = random.Random(8)
    runs = [" ".join(f"{draw.randrange(10**6):x}" for _ in range(12)) for _ in range(40)]
    shuffled = draw.sample(runs, len(runs))
    rows = [(1, " ".join(runs), "x"), (2, "some new words stand first here " + " ".join(runs), "x"), (3, " ".join(shuffled), "x"), (4, " ".join(f"{draw.randrange(10**6):x}" for _ in range(480)), "x")]
    found = spark.createDataFrame(rows, SCHEMA).select("doc_id", syncmers.anchors(F.col("text")).alias("a"))
    pairs = found.alias("x").crossJoin(found.alias("y")).where("x.doc_id = 1").select("y.doc_id", syncmers.likeness(F.col("x.a"), F.col("y.a")).alias("near"))
    near = {r.doc_id: r.near for r in pairs.collect()}
    assert near[1] == 1.0 and near[2] > 0.95 and 0.2 < near[3] < 0.65 and near[4] == 0.0


def test_repeats_nulls_and_empty(spark):
    rows = [(1, "a b c d e f", "x"), (1, "a b c d e f", "x"), (None, "q r s t u", "x"), (None, None, "x"), (2, "z", "x")]
    got = syncmers.compare_with_edits(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(got) == 5
    assert syncmers.compare_with_edits(spark.createDataFrame([], SCHEMA)).count() == 0
    lone = syncmers.compare_with_edits(spark.createDataFrame([(7, "a b c d e f", "x")], SCHEMA)).collect()
    assert lone[0].near_next == 1.0


def test_short_texts_without_a_chosen_run(spark):
    bare = {}
    for i in range(400):
        n = 5 + i % 3
        text = " ".join(f"w{i}x{j}" for j in range(n))
        if not brute(text) and len(bare.setdefault(n, [])) < 4:
            bare[n].append(text)
    assert all(len(bare[n]) == 4 for n in (5, 6, 7))
    short = [t for n in (5, 6, 7) for t in bare[n]]
    got = syncmers.compare_with_edits(spark.createDataFrame([(i, t, "x") for i, t in enumerate(short)], SCHEMA)).collect()
    assert all(len(r.fingerprint.split(",")) == 1 and r.fingerprint for r in got)
    assert len({r.fingerprint for r in got}) == len(short)
    assert all(r.near_next == 0.0 and r.near_edited == 0.0 for r in got)
    same = syncmers.compare_with_edits(spark.createDataFrame([(1, short[0], "x"), (2, short[0], "x"), (3, "", "x"), (4, None, "x")], SCHEMA)).collect()
    assert {r.doc_id: r.near_next for r in same} == {1: 0.0, 2: 1.0, 3: 0.0, 4: 1.0}


def by_content(stretch):
    """Pieces of a long stretch: cut before the least pair of characters among seven, else every 32."""
    pairs = [xxhash.xxh64_intdigest(b.encode(), xxhash.xxh64_intdigest(a.encode(), 42)) for a, b in zip(stretch, stretch[1:], strict=False)]
    pairs = [p - (1 << 64) if p >= 1 << 63 else p for p in pairs]
    low = [i for i in range(3, len(pairs) - 3) if pairs[i] < pairs[i - 1] and pairs[i] == min(pairs[i - 3 : i + 4])]
    return [stretch[a:b][i : i + 32] for a, b in zip([0, *low], [*low, len(stretch)], strict=True) for i in range(0, b - a, 32)]


def test_unspaced_texts_are_cut_by_content(spark):
    draw = random.Random(5)
    alphabets = ["ACGT", "0123456789abcdef", "".join(map(chr, range(0x4E00, 0x5200))), "\U0001f600\U0001f601\u0e01\u0e02z\u0085\u2028"]
    bases = ["".join(draw.choice(letters) for _ in range(n)) for letters in alphabets for n in (33, 120, 700)] + ["ab" * 300]
    rows = [(i, t, "x") for i, t in enumerate(b for base in bases for b in (base, draw.choice("yq\u00e9") + base, "two words " + base))]
    texts = spark.createDataFrame(rows, SCHEMA)
    hashes = {r.doc_id: r.h for r in texts.select("doc_id", syncmers._hashes(F.col("text")).alias("h")).collect()}
    for i, t, _ in rows:
        assert hashes[i] == [long64(p.encode()) for w in t.split(" ") for p in (by_content(w) if len(w) > 32 else [w])]
    found = {r.doc_id: {h for _, h in split(r.a)} for r in texts.select("doc_id", syncmers.anchors(F.col("text")).alias("a")).collect()}
    for k, base in enumerate(bases):
        for other in (3 * k + 1, 3 * k + 2):
            if len(base) > 100:
                shared, together = len(found[3 * k] & found[other]), len(found[3 * k] | found[other])
                assert together - shared <= 8 and shared / together > (0.8 if len(base) == 700 else 0.2), (base, shared, together)
    long = spark.createDataFrame([(1, "\u4e00\u4e8c\u4e09" * 200_000 + "\u56db", "x")], SCHEMA)
    assert len(long.select(syncmers._hashes(F.col("text")).alias("h")).first().h) > 100_000
