import pytest
from pyspark.sql import functions as F

from nodalis.functions import clock
from nodalis.operators import boards, evaluation, features, history, models, projection, runs, views
from nodalis.sources import geography
from nodalis.streaming import ingest


def test_arms():
    columns = ["ts", "key", "load_total", "hour_ct", "lag_mu_1", "geo_lat", "out_now", "vintage_load_x", "y_bind", "y_mu"]
    assert features.feature_columns(columns, features.arms_for("lag")) == ["load_total", "hour_ct", "lag_mu_1"]
    assert features.feature_columns(columns, features.arms_for("all")) == ["load_total", "hour_ct", "lag_mu_1", "geo_lat", "out_now"]
    with pytest.raises(ValueError):
        features.arms_for("nothing")


def test_design_and_candidates(spark):
    mu = spark.sql("SELECT TIMESTAMP '2026-01-15 07:00:00' AS ts, 'a' AS key, 30.0D AS mu UNION ALL SELECT TIMESTAMP '2026-01-15 08:00:00', 'a', 0.5D")
    hours = spark.sql("SELECT explode(sequence(TIMESTAMP '2026-01-15 07:00:00', TIMESTAMP '2026-01-15 09:00:00', INTERVAL 1 HOUR)) AS ts")
    keys = spark.sql("SELECT 'a' AS key, DATE '2026-01-15' AS day UNION ALL SELECT 'b', DATE '2026-01-15'")
    got = {(r.key, str(r.ts)[11:13]): (r.y_bind, r.y_mu) for r in features.design(hours, keys, hours.withColumn("x", F.lit(None).cast("double")), mu).collect()}
    assert len(got) == 6 and got["a", "07"] == (1, 30.0) and got["a", "08"] == (0, None) and got["b", "07"] == (0, None)
    past = spark.createDataFrame([("a", 0), ("b", 3)], "key string, binds_28d int")
    assert [r.key for r in features.candidates(past).collect()] == ["b"] and features.candidates(past, "all").count() == 2
    assert dict(features.downcast(mu).dtypes)["mu"] == "float"


def test_system_panel_keeps_holes(spark):
    load = spark.createDataFrame([(1, 100.0), (2, 90.0)], "ts int, load_total double")
    wind = spark.createDataFrame([(1, 30.0, 25.0), (3, 1.0, 1.0)], "ts int, wind_total double, wind_low double")
    solar, out = spark.createDataFrame([(1, 10.0)], "ts int, solar_total double"), spark.createDataFrame([(2, 5.0)], "ts int, out_total double")
    got = {r.ts: (r.net_load, r.wind_band) for r in features.system_panel(load, wind, solar, out).collect()}
    assert got == {1: (60.0, 5.0), 2: (None, None), 3: (None, 0.0)}


def test_leak_is_found(spark):
    rows = spark.sql("SELECT TIMESTAMP '2026-07-29 14:00:00' AS posted, TIMESTAMP '2026-07-30 12:00:00' AS ts UNION ALL SELECT TIMESTAMP '2026-07-29 16:00:00', TIMESTAMP '2026-07-30 12:00:00'")
    row = features.audit_leakage(rows).first()
    assert (row.min_slack, row.median_slack, row.n_leaks) == (-1.0, 0.0, 1)


def test_groups_cursor_and_hubs(spark):
    rows = spark.createDataFrame([(t, s, g) for t in (1, 2) for s, g in (("n2", 5), ("n1", 5), ("n3", t))] + [(1, "n4", 5)], "ts int, sp string, grp int")
    groups = features.essp_study_groups(rows)
    assert [(r.representative, r.members, r.n) for r in groups.collect()] == [("n1", ["n1", "n2"], 2)]
    got = {r.sp: (r.representative, r.n) for r in features.canonical(rows.select("sp").distinct(), groups).collect()}
    assert got == {"n1": ("n1", 2), "n2": ("n1", 2), "n3": ("n3", 1), "n4": ("n4", 1)}
    a, b = spark.createDataFrame([("k", -3.0)], "key string, mu double"), spark.createDataFrame([("k", 9.0), ("l", 1.0)], "key string, mu double")
    assert {r.key: (r.mu, r.settled) for r in features.cursor_mu(a, b).collect()} == {"k": (3.0, True), "l": (1.0, False)}
    sf = spark.createDataFrame([("k", "n1", 0.5), ("l", "n1", 1e-5)], "key string, sp string, sf double")
    assert [(r.key, r.score) for r in features.anchor_ranking(b, sf, ["n1"]).collect()] == [("k", 4.5)]
    terms = spark.createDataFrame([("HB_A", 1.0), ("HB_B", -4.0), ("x", 9.0)], "sp string, contribution double")
    assert features.default_hub(terms, ["HB_A", "HB_B"]).first().sp == "HB_B"


def test_guarded_map(spark):
    meta = spark.sql("SELECT DATE '2026-01-01' AS window_start, DATE '2026-01-31' AS window_end")
    sf = spark.sql("SELECT DATE '2026-01-01' AS window_start, 'k' AS key, 'n' AS sp, 0.5D AS sf")
    mu = spark.createDataFrame([("k", 6.0), ("other", 4.0)], "key string, mu double")
    assert features.guarded(sf, meta, mu, "2026-02-03").count() == 1
    for wrong in ({"day": "2026-03-30"}, {"day": "2026-02-03", "least": 0.7}):
        with pytest.raises(LookupError):
            features.guarded(sf, meta, mu, **wrong)
    new = spark.sql("SELECT DATE '2026-01-01' AS window_start, 0.9D AS r2")
    stored = meta.withColumn("r2", F.lit(None).cast("double"))
    assert features.backfill(stored, new, ["window_start"], ["r2"]).first().r2 == 0.9
    covered = spark.range(1).select(features.covers(F.to_timestamp(F.lit("2026-01-01 12:00:00")), F.to_timestamp(F.lit("2026-01-01"))).alias("a"), features.covers(F.to_timestamp(F.lit("2026-01-01 11:00:00")), F.to_timestamp(F.lit("2026-01-01"))).alias("b")).first()
    assert (covered.a, covered.b) == (True, False)


def test_trailing_average_needs_every_day(spark):
    rows = spark.createDataFrame([(d, 1, "k", 3.0) for d in (1, 2)] + [(2, 2, "k", 4.0)], "day int, ordinal int, key string, v double")
    universe = spark.createDataFrame([("k", 1), ("k", 2), ("q", 1)], "key string, ordinal int")
    assert {(r.key, r.ordinal): r["mean"] for r in features.trailing_average(rows, universe, 2).collect()} == {("k", 1): 3.0, ("k", 2): 2.0, ("q", 1): 0.0}
    assert {r["mean"] for r in features.trailing_average(rows, universe, 3).collect()} == {None}


def test_evaluation(spark):
    ts = "SELECT explode(sequence(TIMESTAMP '2026-01-01', TIMESTAMP '2026-01-29 23:00:00', INTERVAL 1 HOUR)) AS ts"
    hours = spark.sql(ts)
    mu = hours.select("ts", F.explode(F.array(F.lit("a"), F.lit("b"))).alias("key")).withColumn("mu", models.uniform(F.col("ts"), F.col("key"), 1) * 400)
    sf = spark.createDataFrame([("a", "n", 0.4), ("b", "n", -0.3), ("a", "m", 0.1), ("b", "m", 0.2)], "key string, sp string, sf double")
    cong = projection.project(mu, sf).withColumnRenamed("point", "c")
    windows = spark.sql("SELECT DATE '2026-01-01' AS window_start, DATE '2026-01-11' AS window_end UNION ALL SELECT DATE '2026-01-08', DATE '2026-01-18'")
    maps = models.rolling_ridge(mu, cong, windows, ridge=0.01, min_hours=10, std_floor=1.0).cache()
    scored = evaluation.score_windows(maps, mu, cong, 10, 7).collect()
    assert len(scored) == 2 and all(r.r2 > 0.999 and r.coverage == pytest.approx(1) for r in scored)
    fit = evaluation.diagnostics(sf, mu, cong).collect()
    assert all(r.r2 == pytest.approx(1) for r in fit)
    assert [(r.lag_days, r.pairs, round(r.r, 3)) for r in evaluation.decay(maps, [7]).collect()] == [(7, 1, 1.0)]
    swept = evaluation.sweep(mu, cong, windows, [{"ridge": 0.01, "min_hours": 10, "std_floor": 1.0}, {"ridge": 1e6, "min_hours": 10, "std_floor": 1.0}], 10, 7).collect()
    best = max(swept, key=lambda r: r.r2)
    assert "ridge=0.01" in best.setting and len(swept) == 2
    rows = spark.createDataFrame([(1, 0.5), (1, 0.5), (2, 0.1), (2, 0.2)], "g int, v double")
    assert [r.g for r in evaluation.identical(rows, ["g"], "v").collect()] == [2]


def test_group_views(spark):
    daily = spark.createDataFrame([("k", f"2026-01-{d:02d}", n) for d, n in ((1, 2), (2, 1), (5, 4), (9, 1))], "key string, day string, n long").withColumn("day", F.to_date("day"))
    assert [r.n_7d for r in views.window_counts(daily, 7).orderBy("day").collect()] == [2, 3, 7, 5]
    before = spark.createDataFrame([("a", "g"), ("b", "g"), ("c", "h")], "key string, grp string")
    after = spark.createDataFrame([("a", "g"), ("c", "h"), ("b", "h")], "key string, grp string")
    assert models.churn(before, after).first().jaccard == pytest.approx(0.5)
    members = spark.createDataFrame([("a", "g", 0.75), ("b", "g", 0.25)], "key string, grp string, share double")
    sf = spark.createDataFrame([("a", "n", 0.4), ("c", "n", 1.0)], "key string, sp string, sf double")
    assert projection.group_projection(sf, members).first().sf == pytest.approx(0.4)
    terms = spark.createDataFrame([("n", "k", 1.0), ("n", "l", 2.0)], "sp string, key string, contribution double")
    assert projection.column_totals(terms, terms.where("key = 'k'").select("key")).first().total == 1.0
    flat = spark.createDataFrame([("d", 1.0), ("d", 1.0), ("e", 1.0), ("e", 2.0)], "day string, point double")
    assert [r.day for r in projection.flat_days(flat).collect()] == ["d"]
    encoded = history.target_encoding(spark.createDataFrame([("a", 1.0), ("a", 0.0), ("b", 1.0)], "key string, y double"), "key", "y", 1.0)
    assert {r.key: round(r.encoded, 6) for r in history.apply_encoding(before, encoded, "key", 0.9).collect()} == {"a": round((1 + 2 / 3) / 3, 6), "b": round((1 + 2 / 3) / 2, 6), "c": 0.9}
    bands = spark.createDataFrame([(1.0, 0.0, 2.0), (5.0, 0.0, 2.0)], "y double, low double, high double")
    assert models.band_metrics(bands).first().coverage == 0.5
    assert boards.unique_only(spark.createDataFrame([("a", 1), ("a", 2), ("b", 1)], "k string, v int"), "k", "v").collect() == [("b", 1)]


def test_geography(spark, tmp_path):
    (tmp_path / "c.csv").write_text("settlement_point,lat,lon\nA,29.0,-95.0\nB,30.0,-96.0\n")
    (tmp_path / "m.csv").write_text("resource_node,zone,kv\nA,houston,138\nA,houston,138\n")
    got = {r.settlement_point: (r.zone, r.kv) for r in geography.points(spark, str(tmp_path / "c.csv"), str(tmp_path / "m.csv")).collect()}
    assert got == {"A": ("houston", 138.0), "B": (None, None)}
    (tmp_path / "none.csv").write_text("resource_node,zone,kv\nZ,west,69\n")
    with pytest.raises(ValueError):
        geography.points(spark, str(tmp_path / "c.csv"), str(tmp_path / "none.csv"))
    registry = spark.createDataFrame([("S", "U1", "A"), ("S", "U2", "B"), ("T", "U1", "C")], "substation string, unit string, sp string")
    units, stations = geography.crosswalk(registry)
    assert {r.key: r.value for r in units.collect()} == {"S_U1": "A", "S_U2": "B", "T_U1": "C"} and [(r.key, r.value) for r in stations.collect()] == [("T", "C")]
    row = spark.range(1).select(geography.county(F.lit(" Harris County ")).alias("a"), geography.county(F.lit("Travis")).alias("b")).first()
    assert (row.a, row.b) == ("HARRIS", "TRAVIS")
    names = geography.typed(spark.createDataFrame([("HB_WEST",), ("X",), ("Y",)], "sp string"), spark.createDataFrame([("X", "resource")], "sp string, kind string"))
    assert {r.sp: r.kind for r in names.collect()} == {"HB_WEST": "hub", "X": "resource", "Y": None}


def test_vintages_before_close(spark):
    rows = spark.sql(
        "SELECT TIMESTAMP '2026-07-30 12:00:00' AS ts, TIMESTAMP '2026-07-29 14:30:00' AS posted, 1 AS v UNION ALL SELECT TIMESTAMP '2026-07-30 12:00:00', TIMESTAMP '2026-07-29 15:00:00', 2 "
        "UNION ALL SELECT TIMESTAMP '2026-07-31 12:00:00', TIMESTAMP '2026-07-30 09:00:00', 3 UNION ALL SELECT TIMESTAMP '2026-08-01 12:00:00', TIMESTAMP '2026-07-31 01:00:00', 4"
    )
    assert {str(r.ts)[:10]: r.v for r in ingest.latest_before_close(rows).collect()} == {"2026-07-30": 1, "2026-07-31": 3}
    newest = features.vintage_rows(rows, ["ts"], ["v"])
    assert {str(r.ts)[:10]: r.v for r in newest.collect()} == {"2026-07-30": 2, "2026-07-31": 3, "2026-08-01": 4}
    assert clock.hour_grid(spark, "2026-01-01", "2026-01-02").count() == 25


def test_watermarked_hours(spark, tmp_path):
    source = str(tmp_path / "in")
    rows = spark.sql("SELECT explode(sequence(TIMESTAMP '2026-01-01', TIMESTAMP '2026-01-01 01:45:00', INTERVAL 15 MINUTES)) AS ts, 'z' AS zone, 4.0D AS price")
    rows.write.parquet(source)
    stream = ingest.hourly_mean(spark.readStream.schema(rows.schema).parquet(source), "ts", ["zone"], "price")
    run = stream.writeStream.format("memory").queryName("hours").outputMode("complete").trigger(availableNow=True).start()
    run.awaitTermination()
    assert sorted((str(r.hour)[11:16], r.price, r.n) for r in spark.table("hours").collect()) == [("00:00", 4.0, 4), ("01:00", 4.0, 4)]


def test_refit_grid_refuses_short_history(spark):
    days = spark.sql("SELECT explode(sequence(date'2026-01-01', date'2026-04-01', interval 1 day)) AS day")
    got = [str(r.refit_ts) for r in runs.refit_boundaries(days, 30, 7, score_from="2026-03-02").orderBy("day").collect()]
    assert got == ["2026-03-02 06:00:00", "2026-03-09 05:00:00", "2026-03-16 05:00:00", "2026-03-23 05:00:00", "2026-03-30 05:00:00"]
    assert str(runs.refit_boundaries(days, 30, 7).agg(F.min("day")).first()[0]) == "2026-01-31"
    with pytest.raises(Exception, match="needs 90 days of history"):
        runs.refit_boundaries(days, 90, 7, score_from="2026-03-02").collect()


def test_sources_and_missing_metrics(spark):
    rows = spark.createDataFrame([("Onshore Wind Turbine", "WND"), ("Conventional", " ng "), (None, None)], "t string, c string")
    assert [r[0] for r in rows.select(runs.plant_source(F.col("t"), F.col("c"), {"NG": "gas"})).collect()] == ["wind", "gas", None]
    windows = spark.createDataFrame([("a", None), ("a", 0.5), ("b", 1.0)], "run_id string, r2 double")
    assert {r.run_id: r.n for r in runs.missing_metric(windows, "r2").collect()} == {"a": 1, "b": 0}
