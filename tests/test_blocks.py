import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from nodalis.operators import models, views
from nodalis.sources import market


def plan(df):
    """The physical plan as text."""
    return df._jdf.queryExecution().executedPlan().toString()


def test_correlations_in_blocks(spark):
    draw = random.Random(5)
    rows = [(h, f"k{k}", draw.uniform(-5, 90)) for h in range(90) for k in range(25) if draw.random() < 0.4]
    df = spark.createDataFrame(rows, "ts int, key string, mu double")
    found = [{(r.a, r.b): r.r for r in models.correlations(df, 90, 10, block=block).collect()} for block in (4096, 6)]
    x = {k: {h: v for h, n, v in rows if n == k} for k in {r[1] for r in rows}}

    def r(a, b):
        s, t = sum(x[a].values()) / 90, sum(x[b].values()) / 90
        var = [sum(v * v for v in x[k].values()) / 90 - m * m for k, m in ((a, s), (b, t))]
        return (sum(v * x[b].get(h, 0.0) for h, v in x[a].items()) / 90 - s * t) / (var[0] * var[1]) ** 0.5

    want = {(a, b): r(a, b) for a in x for b in x if a < b and x[a].keys() & x[b].keys()}
    assert all(got == pytest.approx(want, abs=1e-9) for got in found)
    near = {(q.a, q.b) for q in models.correlations(df, 90, 10, 0.1, block=6).collect()}
    assert near == {p for p, v in want.items() if v >= 0.1}
    assert "Join" not in plan(models.correlations(df, 90, 10))  # pairs are not formed by a join on the hour


def counted(spark, df):
    """``df`` and the number of its rows that were computed so far."""
    seen = spark.sparkContext.accumulator(0)

    def pass_on(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    return df.mapInArrow(pass_on, df.schema), seen


@pytest.mark.parametrize("block", [8192, 6])
def test_copies_are_correlated_as_one_series(spark, monkeypatch, block):
    """Copies of a key travelled as often as keys; prices were computed twice, and four times for groups."""
    draw = random.Random(6)
    series = [{h: draw.uniform(-5, 90) for h in range(60) if draw.random() < 0.6} for _ in range(5)]
    rows = [(h, f"k{i}-{k}", v) for k, x in enumerate(series) for i in range(7) for h, v in x.items()]
    met, pairs = [], models._pairs
    monkeypatch.setattr(models, "_pairs", lambda alike, *others: met.append(alike.count()) or pairs(alike, *others))
    df, seen = counted(spark, spark.createDataFrame(rows, "ts int, key string, mu double"))
    got = models.correlations(df, 60, 10, block=block, digits=9).collect()
    assert met == [5] and seen.value == len(rows)
    x = np.array([[s.get(h, 0.0) for h in range(60)] for s in series])
    r = np.corrcoef(x)
    keys = sorted((f"k{i}-{k}", k) for k in range(5) for i in range(7))
    want = {(a, b): r[k, m] for n, (a, k) in enumerate(keys) for b, m in keys[n + 1 :]}
    assert len(got) == len(want) and {(p.a, p.b): p.r for p in got} == pytest.approx(want, abs=2e-9)
    df, seen = counted(spark, df)
    assert models.constraint_groups(df, 60, 0.9, 10).count() == 35 and seen.value == len(rows)


def test_one_exchange_serves_hours_and_keys(spark, tmp_path):
    spark.sql("SELECT id AS user_id, TIMESTAMP_NTZ '2024-01-01 00:30:00' AS ts, 1.5D AS value FROM range(9)").write.parquet(f"{tmp_path}/events.parquet")
    mu = market.shadow_prices(spark, str(tmp_path), by_key=True)
    assert plan(mu.groupBy("key").agg(F.collect_list("mu"))).count("Exchange") == 1
    assert sorted(mu.collect()) == sorted(market.shadow_prices(spark, str(tmp_path)).collect()) and market.hours(spark, str(tmp_path)) == 1


def test_exposure_in_blocks(spark):
    draw = random.Random(7)
    sf = [(f"k{k}", f"n{n}", draw.uniform(-1, 1)) for k in range(11) for n in range(9) if draw.random() < 0.5]
    out = [(f"2026-01-{d:02d}", f"n{n}", draw.uniform(0, 50)) for d in range(1, 9) for n in range(9) for _ in range(2) if draw.random() < 0.3]
    outages = spark.createDataFrame(out, "day string, sp string, mw double").withColumn("day", F.to_date("day"))
    want = {}
    for day, n, mw in out:
        for k, m, v in sf:
            if m == n:
                want[day, k] = want.get((day, k), 0.0) + abs(v) * mw
    got = views.exposure(spark.createDataFrame(sf, "key string, sp string, sf double"), outages, block=3)
    assert {(str(r.day), r.key): r.exposure for r in got.collect()} == pytest.approx(want)
    assert "Join" not in plan(got)  # terms by node are not joined and shuffled


def test_draws_in_blocks(spark):
    draw = random.Random(9)
    sf = spark.createDataFrame([(f"k{k}", f"n{n}", draw.uniform(-1, 1)) for k in range(7) for n in range(5) if draw.random() < 0.6], "key string, sp string, sf double")
    p = spark.createDataFrame([(t, f"k{k}", 0.3, draw.uniform(1, 99)) for t in range(6) for k in range(8)], "ts int, key string, p_bind double, mu_gbm double")
    got = models.draws(p, sf, 43, 0.4)
    one = p.withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(42))))
    u = [models.uniform(F.col("ts"), F.col("key"), F.col("draw"), 42 + i) for i in range(3)]
    noise = F.sqrt(-2 * F.log(u[1])) * F.cos(2 * 3.141592653589793 * u[2]) * 0.4
    laid = one.where(u[0] < F.col("p_bind")).select("draw", "ts", "key", F.greatest(F.lit(0.0), F.expm1(F.log1p("mu_gbm") + noise)).alias("mu"))
    want = laid.join(sf, "key").groupBy("draw", "ts", "sp").agg((-F.sum(F.col("mu") * F.col("sf"))).alias("point"))
    as_dict = lambda df: {(r.draw, r.ts, r.sp): r.point for r in df.collect()}
    assert as_dict(got) == pytest.approx(as_dict(want))
    assert "FlatMapCoGroupsInPandas" in plan(got)  # draws are not laid out by node before they are summed
