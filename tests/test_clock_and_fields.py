import math

import pytest
from pyspark.sql import functions as F

from nodalis.functions import clock, fields
from nodalis.operators import panels


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


@pytest.mark.parametrize(("day", "hours", "first"), [("2026-01-15", 24, "06:00"), ("2026-03-08", 23, "06:00"), ("2026-07-30", 24, "05:00"), ("2026-11-01", 25, "05:00")])
def test_day_bounds(spark, day, hours, first):
    d = F.lit(day).cast("date")
    row = one(spark, F.size(clock.hours_of(d)).alias("n"), F.date_format(clock.midnight(d), "HH:mm").alias("first"))
    assert (row["n"], row["first"]) == (hours, first)


def test_delivery_date_seam(spark):
    row = one(spark, clock.delivery_date(F.to_timestamp(F.lit("2026-07-31 00:00:00"))).cast("string").alias("d"))
    assert row.d == "2026-07-30"


def test_dam_close_and_fire_times(spark):
    day = F.lit("2026-07-30").cast("date")
    row = one(spark, clock.dam_close(day).cast("string").alias("c"), clock.fire_time(day, F.lit(1)).cast("string").alias("a"), clock.fire_time(day, F.lit(2)).cast("string").alias("b"))
    assert (row.c, row.a, row.b) == ("2026-07-29 15:00:00", "2026-07-29 17:00:00", "2026-07-28 20:15:00")


@pytest.mark.parametrize(("day", "ending", "flag", "utc"), [("2025-11-02", 2, False, "06:00"), ("2025-11-02", 2, True, "07:00"), ("2025-11-02", 3, False, "08:00"), ("2025-03-09", 1, False, "06:00"), ("2025-07-01", 1, False, "05:00")])
def test_hour_ending(spark, day, ending, flag, utc):
    got = one(spark, F.date_format(clock.hour_ending_to_utc(F.lit(day).cast("date"), F.lit(ending), F.lit(1), F.lit(flag)), "HH:mm").alias("t"))
    assert got.t == utc


def test_range_check():
    clock.check_range("2026-01-01", "2026-01-02")
    for bad in (("2026-01-02", "2026-01-01"), ("2026-01-01", "2026-03-01")):
        with pytest.raises(ValueError):
            clock.check_range(*bad)


def test_refit_grid(spark):
    days = spark.sql("SELECT explode(sequence(DATE '2026-01-10', DATE '2026-01-25')) AS day")
    got = [str(r.refit_start) for r in clock.refit_grid(days, 7, "2026-01-01").collect()]
    assert got == ["2026-01-08", "2026-01-15", "2026-01-22"]


def test_fields(spark):
    row = one(
        spark, fields.half_up(F.lit(0.125), 2).alias("a"), fields.half_up(F.lit(-2.675), 2).alias("b"), fields.clean(F.lit("nan")).alias("c"), fields.clean(F.lit(" 1.5 ")).alias("d"),
        fields.clean(F.lit("x")).alias("e"), fields.point_type(F.lit("HB_HOUSTON")).alias("f"), fields.point_type(F.lit("HB_BUSAVG")).alias("g"), fields.point_type(F.lit("LZ_WEST")).alias("h"),
        fields.voltage_class(F.lit(138.5)).alias("i"), fields.voltage_class(F.lit(None).cast("double")).alias("j"), fields.constraint_key(F.lit(" A "), F.lit("B ")).alias("k"),
        fields.haversine_km(F.lit(29.76), F.lit(-95.37), F.lit(32.78), F.lit(-96.80)).alias("l"),
    )
    assert (row.a, row.b, row.c, row.d, row.e) == (0.13, -2.68, None, 1.5, None)
    assert (row.f, row.g, row.h, row.i, row.j, row.k) == ("hub", None, "load_zone", "138 kV", "Unknown", "A|B")
    assert row.l == pytest.approx(361.5, abs=2)


def test_coordinates(spark):
    digits = fields.BASE62

    def group(value):
        out = ""
        for _ in range(5):
            value, r = divmod(value, 62)
            out = digits[r] + out
        return out

    code = group(round((29.76 + 90) * 1e6)) + group(round((-95.37 + 180) * 1e6))
    lat, lon = fields.coordinates(F.lit(code))
    row = one(spark, lat.alias("lat"), lon.alias("lon"))
    assert (row.lat, row.lon) == (pytest.approx(29.76), pytest.approx(-95.37))


def test_scales(spark):
    points = [(-20.0, 0.0), (0.0, 0.4), (50.0, 1.0)]
    got = one(spark, *(fields.interpolate(F.lit(v), points).alias(f"v{i}") for i, v in enumerate((-30.0, -10.0, 0.0, 25.0, 99.0))), *(fields.congestion_position(F.lit(v)).alias(f"c{i}") for i, v in enumerate((5.0, -55.0, 500.0))))
    assert [got[f"v{i}"] for i in range(5)] == pytest.approx([0.0, 0.2, 0.4, 0.7, 1.0])
    assert [got[f"c{i}"] for i in range(3)] == pytest.approx([0.0, -0.5, 1.0])


def test_calendar_features(spark):
    row = clock.calendar_features(spark.sql("SELECT TIMESTAMP '2026-07-31 05:00:00' AS ts")).first()
    assert (row.hour_ct, row.dow, row.month, row.is_weekend) == (0, 4, 7, 0)
    assert math.isclose(row.hour_cos, 1.0)


def test_duplicates_raise(spark):
    rows = spark.createDataFrame([(1, "a"), (1, "b")], "k int, v string")
    assert panels.unique_or_raise(rows, ["k", "v"]).count() == 2
    with pytest.raises(Exception, match="duplicate key"):
        panels.unique_or_raise(rows, ["k"]).collect()


def test_as_of_matches_a_scan(spark):
    left = [(k, t) for k in "ab" for t in range(0, 40, 3)]
    right = [(k, t, t * 10 + (k == "b")) for k in "ab" for t in range(5, 40, 7)]
    got = panels.as_of(spark.createDataFrame(left, "k string, t int"), spark.createDataFrame(right, "k string, u int, v int"), ["k"], "t", "u", ["v"])
    want = {(k, t): max((v for kk, u, v in right if kk == k and u <= t), default=None) for k, t in left}
    assert {(r.k, r.t): r.v for r in got.collect()} == want
