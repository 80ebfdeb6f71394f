from datetime import date, timedelta

import numpy as np
import pytest

from nodalis.operators import evaluation


def rows(start, matrix):
    return [(start, f"k{i}", f"n{j:02d}", float(v)) for i, r in enumerate(matrix) for j, v in enumerate(r) if v]


def plain(a, b, rank):
    """Angles between the leading right singular vectors."""
    va, vb = (np.linalg.svd(x)[2][: min(rank, np.linalg.matrix_rank(x))] for x in (a, b))
    return np.degrees(np.arccos(np.clip(np.linalg.svd(va @ vb.T, compute_uv=False), 0, 1)))


def test_planted_rotations(spark):
    draw, start = np.random.default_rng(3), date(2024, 1, 1)
    a = np.zeros((4, 12))
    a[:2, :2] = [[5, 1], [1, 4]]  # the leading two directions lie in the plane of the first two nodes
    turn = np.eye(12)
    angle = np.radians(30)
    turn[np.ix_([1, 5], [1, 5])] = [[np.cos(angle), np.sin(angle)], [-np.sin(angle), np.cos(angle)]]
    maps = [a, a @ turn, draw.normal(size=(6, 12)), draw.normal(size=(3, 12))]
    data = [r for i, m in enumerate(maps) for r in rows(start + timedelta(days=7 * i), m)]
    got = {r.window_start: r for r in evaluation.rotation(spark.createDataFrame(data, "window_start date, key string, sp string, sf double"), 7, 2).collect()}
    assert sorted(got) == [start, start + timedelta(days=7), start + timedelta(days=14)]
    assert got[start].angles == pytest.approx([0, 30], abs=1e-4) and got[start].largest == pytest.approx(30, abs=1e-4)
    for i in (1, 2):
        assert sorted(got[start + timedelta(days=7 * i)].angles) == pytest.approx(sorted(plain(maps[i], maps[i + 1], 2)), abs=1e-4)


def test_no_later_map(spark):
    frame = spark.createDataFrame(rows(date(2024, 1, 1), np.eye(2)), "window_start date, key string, sp string, sf double")
    assert evaluation.rotation(frame, 7).count() == 0
