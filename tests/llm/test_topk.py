import math

import numpy as np
import pytest

from nodalis.llm import topk

SCHEMA = "vec_id long, embedding array<float>, label int, score string"


def brute(rows, k):
    usable = [(i, [math.floor(1024 * float(np.float32(x))) for x in v]) for i, v, *_ in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q, a in usable:
        if q % 100 == 0:
            scored = sorted(((-sum(x * y for x, y in zip(a, b, strict=True)), i) for i, b in usable if i != q and len(a) == len(b)))
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scored[:k])]
    return sorted(out)


@pytest.mark.parametrize("blocks", [(8192, 16384), (16, 2)])
def test_against_brute_force(spark, blocks, monkeypatch):
    monkeypatch.setattr(topk, "VECTOR_BLOCK", blocks[0])
    monkeypatch.setattr(topk, "QUERY_BLOCK", blocks[1])
    draw = np.random.default_rng(1)
    rows = [(i, [float(x) for x in draw.normal(0, 0.3, 6)], 0, "c") for i in range(420)]
    rows += [(1000 + i, rows[100][1], 0, "c") for i in range(30)]  # ties with each other
    rows += [(500, None, 0, "c"), (600, [1.0, None, 0.0, 0.0, 0.0, 0.0], 0, "c"), (700, [math.nan] * 6, 0, "c"), (800, [math.inf] * 6, 0, "c"), (None, [1.0] * 6, 0, "c")]
    rows += [(900, [0.0] * 6, 0, "c"), (2000, [1.0, 2.0], 0, "c"), (2001, [0.5, -2.0], 0, "c"), (2100, [], 0, "c"), (2101, [], 0, "c"), (2200, [5.0] * 3, 0, "c")]
    vectors = topk.quantised(spark.createDataFrame(rows, SCHEMA), "vec_id", "embedding")
    got = topk.top_k(vectors, vectors.where("id % 100 = 0"), 10)
    assert sorted(tuple(r) for r in got.select("query_id", "rank", "vec_id", "score").collect()) == brute(rows, 10)


def test_repeated_rows_and_empty(spark):
    rows = [(0, [1.0, 1.0], 0, "c"), (0, [1.0, 1.0], 0, "c"), (1, [2.0, 0.0], 0, "c"), (1, [2.0, 0.0], 0, "c"), (2, [0.0, 1.0], 0, "c")]
    vectors = topk.quantised(spark.createDataFrame(rows, SCHEMA), "vec_id", "embedding")
    got = topk.top_k(vectors, vectors.where("id % 100 = 0"), 10).collect()
    assert sorted((r.vec_id, r.score) for r in got) == [(1, 2 * 1024 * 1024), (1, 2 * 1024 * 1024), (2, 1024 * 1024)]
    empty = vectors.limit(0)
    assert topk.top_k(empty, empty, 10).count() == 0


def test_large_values_stay_exact():
    lists = topk.SortedLists(np.arange(3), np.array([[2.0**30, 1.0], [2.0**30, 2.0], [0.0, 0.0]]))
    ids, scores = lists.top(-1, np.array([2.0**30, 1.0]), 2)
    assert ids.tolist() == [1, 0] and scores.tolist() == [2**60 + 2, 2**60 + 1]


def test_differing_rows_of_one_query_and_huge_components(spark):
    rows = [(0, [1.0, 0.0], 0, "c"), (0, [0.5, 0.0], 0, "c"), (1, [3e20, 1.0], 0, "c"), (2, [2.0, 9.0], 0, "c"), (3, [3.4e38, 0.0], 0, "c"), (4, [-3.4e38, 0.0], 0, "c")]
    vectors = topk.quantised(spark.createDataFrame(rows, SCHEMA), "vec_id", "embedding")
    got = topk.top_k(vectors, vectors.where("id % 100 = 0"), 10).orderBy("rank").collect()
    assert [r.vec_id for r in got] == [3, 1, 2, 4]
    assert [r.score for r in got if r.vec_id == 2] == [512 * 2048] and [r.score for r in got if r.vec_id in (3, 4)] == [2**63 - 1, -(2**63)]
    lists = topk.SortedLists(np.arange(3), np.array([[3.0e41, 1.0], [3.0e41, 2.0], [-3.0e41, 5.0]]))
    ids, scores = lists.top(-1, np.array([3.0e41, 1.0]), 2)
    assert ids.tolist() == [1, 0] and scores.tolist() == [int(3.0e41) ** 2 + 2, int(3.0e41) ** 2 + 1]


def test_algorithm_stops_early():
    draw = np.random.default_rng(0)
    vectors = draw.exponential(1.0, (20_000, 2)).round(3) * 1000
    lists = topk.SortedLists(np.arange(20_000), vectors)
    seen = []
    score = lists.score
    lists.score = lambda rows, q: (seen.append(len(rows)), score(rows, q))[1]
    ids, scores = lists.top(-1, np.array([3.0, 1.0]), 10)
    exact = vectors @ [3.0, 1.0]
    assert sorted(scores.tolist(), reverse=True) == sorted(exact.astype(int).tolist(), reverse=True)[:10]
    assert sum(seen) < 2000
