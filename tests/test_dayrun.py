import random
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from nodalis.operators import dayrun, models

DAY = "2024-03-20"
COLUMNS = ["net"]
SETTINGS = {"rounds": 2, "rate": 0.6, "min_leaf": 10, "train_days": 30}


def panel(spark):
    draw, rows = random.Random(2), []
    for d in range(20):
        day = date(2024, 3, 1) + timedelta(days=d)
        for h in range(0, 24, 2):
            for key in ("A", "B", "C"):
                net = draw.random()
                binds = key != "C" and net > 0.5
                rows.append((day, datetime(day.year, day.month, day.day, h), key, net, int(binds), 100.0 * net if binds else None))
    return spark.createDataFrame(rows, "day date, ts timestamp, key string, net double, y_bind int, y_mu double")


def maps(spark, keys=("A", "B"), start=date(2024, 3, 12), value=0.5):
    sf = spark.createDataFrame([(start, k, sp, value * (1 if sp == "N1" else -1)) for k in keys for sp in ("N1", "N2")], "window_start date, key string, sp string, sf double")
    return sf, spark.createDataFrame([(start, start + timedelta(days=7))], "window_start date, window_end date")


def test_a_day_is_served_and_novel_keys_are_listed(spark, tmp_path):
    ledger, (sf, meta) = dayrun.Ledger(spark, str(tmp_path)), maps(spark)
    assert ledger.pointer(DAY) == (0, None) and ledger.served(DAY, "points") is None
    assert dayrun.forecast_day(ledger, "r1", DAY, panel(spark), COLUMNS, sf, meta, **SETTINGS)
    points = ledger.served(DAY, "points").collect()
    assert len(points) == 24 and {r.map for r in points} == {"map"}
    assert [r.key for r in ledger.table(DAY, "r1", "novel").collect()] == ["C"]
    assert {r.key for r in ledger.table(DAY, "r1", "predictions").collect()} == {"A", "B"}
    assert ledger.verdicts(DAY) == [{"run": "r1", "verdict": "served", "reason": ""}]


def test_a_crash_between_data_and_pointer_leaves_the_old_run(spark, tmp_path, monkeypatch):
    ledger, (sf, meta) = dayrun.Ledger(spark, str(tmp_path)), maps(spark)
    ledger.keep(DAY, "old", {"points": spark.createDataFrame([(1,)], "x int")})
    assert ledger.swap(DAY, 0, "old")

    def crash(self, *a):
        raise RuntimeError("lost power")

    rows = panel(spark)
    with monkeypatch.context() as m:
        m.setattr(dayrun.Ledger, "swap", crash)
        with pytest.raises(RuntimeError):
            dayrun.forecast_day(ledger, "new", DAY, rows, COLUMNS, sf, meta, **SETTINGS)
    assert ledger.pointer(DAY) == (1, "old") and ledger.served(DAY, "points").columns == ["x"]
    assert dayrun.forecast_day(ledger, "new", DAY, rows, COLUMNS, sf, meta, **SETTINGS)
    assert ledger.pointer(DAY) == (2, "new") and ledger.served(DAY, "points").count() == 24


def test_only_one_of_two_runs_from_the_same_version(spark, tmp_path, monkeypatch):
    ledger, (sf, meta) = dayrun.Ledger(spark, str(tmp_path)), maps(spark)
    assert ledger.swap(DAY, 0, "a") and not ledger.swap(DAY, 0, "b") and ledger.pointer(DAY) == (1, "a")
    seen = dayrun.features.guarded

    def slow(*args):
        assert ledger.swap(DAY, 1, "faster")
        return seen(*args)

    monkeypatch.setattr(dayrun.features, "guarded", slow)
    assert not dayrun.forecast_day(ledger, "slower", DAY, panel(spark), COLUMNS, sf, meta, **SETTINGS)
    assert ledger.pointer(DAY) == (2, "faster")
    assert ledger.verdicts(DAY) == [{"run": "slower", "verdict": "rejected", "reason": "overtaken by faster"}]


def test_runs_are_turned_down_with_a_reason(spark, tmp_path):
    ledger, rows = dayrun.Ledger(spark, str(tmp_path)), panel(spark)
    old, meta = maps(spark, start=date(2024, 1, 1))
    assert not dayrun.forecast_day(ledger, "stale", DAY, rows, COLUMNS, old, meta, **SETTINGS)
    flat, meta = maps(spark, value=0.0)
    assert not dayrun.forecast_day(ledger, "flat", DAY, rows, COLUMNS, flat, meta, **SETTINGS)
    assert not dayrun.forecast_day(ledger, "none", "2024-05-01", rows.where("day < '2024-03-10'"), COLUMNS, flat, meta, **SETTINGS)
    reasons = [v["reason"] for v in ledger.verdicts(DAY)]
    assert "no map within" in reasons[0] and reasons[1] == "the projection is the same everywhere"
    assert ledger.verdicts("2024-05-01")[0]["reason"] == "no rows to score"
    assert ledger.pointer(DAY) == (0, None) and ledger.table(DAY, "flat", "points").count() == 24  # kept
    fitted = maps(spark)[0].drop("window_start")
    assert dayrun.forecast_day(ledger, "fitted", DAY, rows, COLUMNS, old, maps(spark, start=date(2024, 1, 1))[1], fallback=lambda: fitted, **SETTINGS)
    assert {r.map for r in ledger.served(DAY, "points").collect()} == {"fallback"}


def test_a_walk_goes_on_where_it_was_stopped(spark, tmp_path, monkeypatch):
    rows, calls, fit = panel(spark).withColumn("day", F.col("day").cast("string")), [], models.walk_forward
    folds = [("2024-03-01", "2024-03-10", "2024-03-12"), ("2024-03-01", "2024-03-12", "2024-03-14"), ("2024-03-05", "2024-03-02", "2024-03-03")]
    settings = {"rounds": 2, "min_leaf": 10}

    def once(panel, folds, *a, **k):
        calls.append(folds[0][1])
        if len(calls) == 2:
            raise RuntimeError("stopped")
        return fit(panel, folds, *a, **k)

    monkeypatch.setattr(models, "walk_forward", once)
    with pytest.raises(RuntimeError):
        dayrun.walk_forward(rows, folds, COLUMNS, str(tmp_path), **settings)
    got = dayrun.walk_forward(rows, folds, COLUMNS, str(tmp_path), **settings)
    assert calls == ["2024-03-10", "2024-03-12", "2024-03-12", "2024-03-02"]
    assert {r.fold for r in got.select("fold").distinct().collect()} == {"2024-03-10", "2024-03-12"}
