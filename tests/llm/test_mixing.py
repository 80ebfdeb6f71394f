import random
import re

import pytest
from pyspark.sql import functions as F

from nodalis.llm import mixing

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size string"


def targets_by_rounds(sizes, weights=(3, 1, 2), share=1.5, most=2.0):
    """The definition, step by step: share out, stop who is above, share the excess again."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, target, open_ = share * sum(sizes.values()), {}, set(names)
    while True:
        total = sum(weight[s] for s in open_)
        above = [s for s in open_ if left * weight[s] / total > most * sizes[s]]
        if not above:
            return target | {s: left * weight[s] / total for s in open_}
        for s in above:
            target[s] = most * sizes[s]
            left -= target[s]
            open_.remove(s)


def documents(spark, n, seed=1):
    draw = random.Random(seed)
    rows = []
    for i in range(n):
        source = "hot" if draw.random() < 0.4 else draw.choice(["a", "é", "z", None])
        words = draw.choice([0, 1, 3, 10, 40, 400])
        rows.append((i, None if words == 0 and draw.random() < 0.5 else "\x0b".join("w x" for _ in range(words)), "en", source, 1, "clash"))
    return spark.createDataFrame(rows, SCHEMA)


def test_targets_are_met_and_reruns_agree(spark):
    docs = documents(spark, 900)
    first = mixing.mix(docs).toPandas().sort_values("doc_id").reset_index(drop=True)
    again = mixing.mix(docs.repartition(7)).toPandas().sort_values("doc_id").reset_index(drop=True)
    assert first.equals(again)
    assert len(first) == 900
    words = {r.doc_id: len(re.findall(r"[^\x20\x09-\x0D]+", r.text or "")) for r in docs.collect()}
    assert (first["size"] == first["doc_id"].map(words)).all()
    sizes = first.assign(source=first.source.map(lambda s: s or "￿")).groupby("source")["size"].sum().to_dict()
    want = targets_by_rounds({(None if s == "￿" else s): int(v) for s, v in sizes.items()})
    for row in first.itertuples():
        assert row.target == pytest.approx(want[row.source])
        assert 0 <= row.copies <= 2
    taken = (first["copies"] * first["size"]).groupby(first.source.fillna("￿")).sum()
    for source, words_taken in taken.items():
        assert abs(words_taken - want[None if source == "￿" else source]) <= 400


def test_expected_copies(spark):
    """Over many seeds a document's mean number of copies is its source's target over its size."""
    docs = spark.createDataFrame([(i, "w " * (1 + i % 5), "en", "ab"[i % 2], 1, "x") for i in range(60)], SCHEMA).cache()
    total, runs = 0, 12
    for seed in range(runs):
        got = mixing.mix(docs, seed=seed).toPandas()
        total += (got["copies"] - got["target"] / got["source_size"]).abs().max() <= 1
        assert abs((got["copies"] * got["size"]).sum() - 1.5 * got["size"].sum()) <= 10
    assert total == runs


def test_repeats_empty_and_take(spark):
    rows = [(1, "a b", "en", None, 1, "x")] * 3 + [(None, "a", "en", None, 1, "x"), (2, "", "en", "s", 1, "x"), (3, "q r s", "en", "s", 1, "x")]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = mixing.mix(docs).collect()
    assert {(r.doc_id, r.repeats) for r in got} == {(1, 3), (None, 1), (2, 1), (3, 1)}
    copies = {(r.doc_id): r.copies for r in got}
    assert copies[2] == 0
    docs = docs.withColumns({"copies": F.lit("c"), "_copy": F.lit(1), "id": F.lit("i"), "row": F.lit("r")})
    out = mixing.take(docs)
    assert out.columns == docs.columns and {(r["copies"], r["id"], r["row"]) for r in out.collect()} == {("c", "i", "r")}
    count = {}
    for r in out.collect():
        count[r.doc_id] = count.get(r.doc_id, 0) + 1
    assert count == {k: v * (3 if k == 1 else 1) for k, v in copies.items() if v}
    assert mixing.mix(docs.limit(0)).count() == 0
