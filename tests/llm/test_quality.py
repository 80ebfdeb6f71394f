import zlib

import numpy as np
import pytest

from nodalis.llm import quality

DOCS = "doc_id long, text string, lang string, stats string"
LABELS = "doc_id long, quality int, toxic int"


def corpus(n):
    rows, labels = [], []
    for i in range(n):
        good = i % 3 != 0
        words = [f"word{(i * j) % 41}" if j % 3 else "and" for j in range(20 + i % 30)]
        rows.append((i, " ".join(words) + "." if good else " ".join(w.upper() + "!!" for w in words), "en", "clash"))
        labels.append((i, int(good), 0))
    return rows, labels


def test_scores_follow_the_densities(spark):
    rows, labels = corpus(300)
    docs = spark.createDataFrame(rows, DOCS)
    got = {r.doc_id: r for r in quality.classify(docs, spark.createDataFrame(labels, LABELS)).collect()}
    assert len(got) == 300
    stats = np.array([quality.statistics(t) for _, t, _, _ in rows])
    y = np.array([q for _, q, _ in labels])
    held = np.array([zlib.crc32(str(i).encode()) % 3 == 1 for i in range(300)])
    x = stats[~held]
    covs = []
    for c in (0, 1):
        own = x[y[~held] == c]
        covs.append((own - own.mean(0)).T @ (own - own.mean(0)))
    pooled = sum(covs) / len(x)
    logs = []
    for c in (0, 1):
        own = x[y[~held] == c]
        shrunk = (1 - quality.RIDGE) * ((1 - quality.POOLED) * covs[c] / len(own) + quality.POOLED * pooled) + quality.RIDGE * np.diag(np.diag(pooled) + 1e-6)
        gap = stats - own.mean(0)
        logs.append(np.log(len(own) / len(x)) - 0.5 * np.linalg.slogdet(shrunk)[1] - 0.5 * np.einsum("ni,ij,nj->n", gap, np.linalg.inv(shrunk), gap))
    want = 1 / (1 + np.exp(np.clip(logs[0] - logs[1], -700, 700)))
    for i in range(300):
        assert got[i].score == pytest.approx(want[i], abs=1e-6)
        assert got[i].held_out == held[i]
        assert got[i].predicted == int(got[i].score >= 0.5)
    assert np.mean([got[i].predicted == y[i] for i in range(300) if held[i]]) > 0.95


def test_odd_rows(spark):
    rows, labels = corpus(60)
    rows += [(1000, None, "en", "x"), (1001, "", None, "x"), (1001, "", None, "x"), (None, "a b", "en", "x"), (1002, "z" * 200_000, "en", "x")]
    docs = spark.createDataFrame(rows, DOCS)
    marked = spark.createDataFrame(labels + [(5, None, 0), (77_777, 1, 0), (None, 1, 0)], LABELS)
    got = quality.classify(docs, marked).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    kept = quality.keep_good(docs, marked)
    assert kept.columns == docs.columns
    good = {r.doc_id for r in got if r.predicted}
    assert {r.doc_id for r in kept.collect()} == good
    assert quality.classify(docs.limit(0), marked).count() == 0
    only = quality.classify(docs, marked.where("quality = 1")).collect()
    assert {r.score for r in only} == {1.0}
    none = quality.classify(docs, marked.limit(0)).collect()
    assert {r.score for r in none} == {0.5}
