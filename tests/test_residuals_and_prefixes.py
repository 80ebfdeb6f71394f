import random
from datetime import date, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from nodalis.operators import prefixes, residuals


def test_ranks_equal_one_sort(spark):
    draw = random.Random(4)
    rows = [(i, draw.choice([0.0, 0.0, draw.random()])) for i in range(900)]
    got = residuals.ranked(spark.createDataFrame(rows, "id long, eps double").repartition(7), "eps", ["id"], 9).collect()
    want = {i: n for n, (i, _) in enumerate(sorted(rows, key=lambda r: (r[1], r[0])))}
    assert {r.id: r["rank"] for r in got} == want
    assert residuals.ranked(spark.createDataFrame([], "id long, eps double"), "eps", ["id"]).count() == 0


def test_draws_follow_the_pool_and_agree(spark):
    """Kolmogorov distance of 20,000 draws from a pool with atoms; the same draws from other partitions."""
    values = np.concatenate([np.random.default_rng(5).normal(size=300), np.full(200, 0.25)])
    frame = spark.createDataFrame([(i, float(v)) for i, v in enumerate(values)], "id long, eps double")
    ranks = residuals.ranked(frame, "eps", ["id"], 5)
    asked = spark.range(20_000).select((F.col("id") % 500).alias("ts"), F.col("id").alias("key"), F.lit(0).alias("draw"))
    one = {r.key: r.eps for r in residuals.drawn(asked, ranks, ["ts", "key", "draw"]).collect()}
    two = {r.key: r.eps for r in residuals.drawn(asked.repartition(11), residuals.ranked(frame.repartition(3), "eps", ["id"], 8), ["ts", "key", "draw"]).collect()}
    assert len(one) == 20_000 and one == two
    found, at = np.sort(list(one.values())), np.unique(values)
    gap = np.abs(np.searchsorted(found, at, "right") / len(found) - np.searchsorted(np.sort(values), at, "right") / len(values))
    assert gap.max() < 0.02
    other = {r.key: r.eps for r in residuals.drawn(asked, ranks, ["ts", "key", "draw"], seed=1).collect()}
    assert other != one


def test_pool_and_empty_pool(spark):
    rows = spark.createDataFrame([(1, 10.0, 5.0), (1, 10.0, -3.0), (0, 4.0, 1.0), (1, None, 1.0), (1, 3.0, float("nan"))], "y_bind int, y_mu double, mu_gbm double")
    assert sorted(r.eps for r in residuals.pool(rows).collect()) == pytest.approx(sorted([np.log1p(10) - np.log1p(5), np.log1p(10)]))
    none = spark.createDataFrame([], "rank long, eps double")
    predictions = spark.createDataFrame([(1, "k", 1.0, 50.0)], "ts int, key string, p_bind double, mu_gbm double")
    sf = spark.createDataFrame([("k", "n", 0.5)], "key string, sp string, sf double")
    assert {round(r.point, 6) for r in residuals.draws(predictions, sf, none, 5).collect()} == {-25.0}


def test_windows_equal_direct_sums(spark):
    draw = random.Random(9)
    start = date(2024, 1, 1)
    rows = [(draw.choice("abc"), start + timedelta(days=draw.randint(0, 60)), draw.randint(-5, 9)) for _ in range(300)]
    settings = prefixes.grid(date(2024, 1, 20), date(2024, 3, 1), [3, 14, 90], [1, 7])
    assert settings[14, 7][0] == (date(2024, 1, 6), date(2024, 1, 20))
    windows = [w for ws in settings.values() for w in ws]
    got = {(r.window_start, r.window_end, r.key): r.v for r in prefixes.window_sums(spark.createDataFrame(rows, "key string, day date, v int"), ["key"], windows).collect()}
    want = {}
    for a, b in set(windows):
        for k, d, v in rows:
            if a <= d < b:
                want[a, b, k] = want.get((a, b, k), 0) + v
    assert got == want


def test_products_of_all_lengths_equal_direct_sums(spark):
    draw = random.Random(3)
    rows = [(k, draw.choice("xy"), date(2024, 1, 1) + timedelta(days=d), draw.random() * 1e6) for d in range(40) for k in "ab" if draw.random() < 0.6]
    windows = [w for ws in prefixes.grid(date(2024, 1, 15), date(2024, 2, 9), [5, 10], [3]).values() for w in ws]
    got = {(r.window_start, r.window_end, r.a, r.b): r.v for r in prefixes.window_sums(spark.createDataFrame(rows, "a string, b string, day date, v double"), ["a", "b"], windows).collect()}
    for (start, end, a, b), v in got.items():
        assert v == pytest.approx(sum(x for k, m, d, x in rows if (k, m) == (a, b) and start <= d < end), rel=1e-9, abs=1e-6)
    assert len(got) > 30
