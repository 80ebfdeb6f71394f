from datetime import datetime, timedelta

import duckdb
from pyspark.sql import functions as F

import __spark_entry__
from nodalis.operators import places
from nodalis.plans import views


def test_points_on_an_edge_are_not_within(spark):
    square = [{"x": x, "y": y} for x, y in ((1.0, 2.05), (3.0, 2.05), (3.0, 7.95), (1.0, 7.95))]
    zones = spark.createDataFrame([("z", square)], "zone string, ring array<struct<x: double, y: double>>")
    points = spark.createDataFrame([(1, 2.0, 2.05), (2, 1.0, 5.0), (3, 3.0, 5.0), (4, 2.0, 7.95), (5, 1.0, 2.05), (6, 2.0, 5.0)], "id int, x double, y double")
    got = {r.id: r.method for r in places.assign_zone(points, zones, "id").collect()}
    assert got == {i: "nearest" for i in range(1, 6)} | {6: "within"}


def test_copies_of_a_place_do_not_meet_pair_by_pair(spark, monkeypatch):
    met = spark.sparkContext.accumulator(0)

    def away(*at):
        @F.udf("double")
        def count(a, b, c, d):
            met.add(1)
            return 100 * (abs(a - c) + abs(b - d))

        return count(*at)

    monkeypatch.setattr(places, "haversine_km", away)
    left = spark.range(300).select("id", F.lit(30.0).alias("lat"), F.lit(-99.0).alias("lon"), (F.col("id") % 2).alias("fuel")).withColumnRenamed("id", "k")
    right = spark.range(300).select((299 - F.col("id")).alias("id"), F.lit(30.01).alias("lat_r"), F.lit(-99.0).alias("lon_r"), (F.col("id") % 2).alias("fuel_r"))
    got = {r.k: r.id for r in places.radius_match(left, right, "k", 30.0, F.col("fuel") == F.col("fuel_r")).collect()}
    assert got == {k: 1 - k % 2 for k in range(300)}
    assert met.value <= 20


def test_daily_totals_do_not_depend_on_the_order_of_hours(spark, tmp_path):
    first = datetime(2024, 1, 30)
    rows = [(k, first + timedelta(hours=h), [0.1, 0.2, 0.3, 0.7, 1.1][(h * (1 + k % 4) + k) % 5]) for k in range(60) for h in range(5)]
    spark.createDataFrame(rows, "user_id long, ts timestamp_ntz, value double").repartition(4).write.parquet(str(tmp_path / "events.parquet"))
    totals = {r.v for r in views._daily(spark, str(tmp_path)).collect()}
    assert totals == {2.4}


def test_board_counts_days_of_zero_as_its_sql_does(spark, tmp_path):
    """Keys with zeros in their history, with a history of zeros only, with nothing today, and below zero."""
    first, at = datetime(2024, 1, 15), f"{tmp_path}/events.parquet"
    past = {1: [0.0] * 8 + [4.0] * 6, 2: [0.0] * 14, 3: [0.0] * 5 + [8.0] * 9, 4: [-4.0] * 14, 5: [2.0] * 9, 6: [2.0] * 14, 7: [0.0] * 14, 8: [3.0] * 14}
    last = {1: (4.0, 2.0), 2: (1.0, 5.0), 3: (9.0, 0.0), 4: (-9.0, -9.0), 5: (7.0, 7.0), 6: (2.5, 0.0), 7: (0.0, 0.0), 8: (6.0, 6.0)}
    rows = [(k, first + timedelta(days=i), v) for k, days in past.items() for i, v in enumerate([*days, *last[k]], 14 - len(days))]
    spark.createDataFrame(rows, "user_id long, ts timestamp_ntz, value double").coalesce(1).write.parquet(at)
    db = duckdb.connect()
    db.sql(f"CREATE VIEW events AS SELECT * FROM read_parquet('{at}/*.parquet')")
    want = db.sql(__spark_entry__.oracle_sql()["standouts_board"]).fetchall()
    got = __spark_entry__.queries()["standouts_board"](spark, str(tmp_path))
    assert sorted(map(tuple, got.collect())) == sorted(want)
    assert {r[0]: r[1:3] for r in want} == {"1|N1": (True, False), "2|N1": (True, True), "4|N1": (True, True), "7|N1": (True, True), "8|N1": (True, True)}
