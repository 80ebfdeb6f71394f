import datetime as dt
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from nodalis.operators import boards, graphs, history, linkage, metrics, models, panels, places, projection, writes
from nodalis.sources import files
from nodalis.streaming import ingest


def test_tie_expected_average_precision(spark):
    rows = spark.createDataFrame([("A", 1.0, True), ("B", 0.0, True), ("C", 0.0, False)], "key string, score double, bound boolean").withColumn("g", F.lit(1))
    row = metrics.expected_ap(rows, ["g"]).first()
    assert row.ap == pytest.approx(11 / 12) and row.universe == 3


def test_expected_precision_over_orders(spark):
    """Against the mean over random orders of equal scores."""
    draw = random.Random(1)
    data = [(draw.choice([0.0, 1.0, 2.0]), draw.random() < 0.4) for _ in range(12)]
    got = metrics.expected_ap(spark.createDataFrame(data, "score double, bound boolean").withColumn("g", F.lit(1)), ["g"]).first().ap
    total = 0.0
    for _ in range(20_000):
        order = sorted(data, key=lambda x: (-x[0], draw.random()))
        hits, ap = 0, 0.0
        for i, (_, bound) in enumerate(order, 1):
            if bound:
                hits += 1
                ap += hits / i
        total += ap / hits
    assert got == pytest.approx(total / 20_000, abs=5e-3)


def test_quiet_universe(spark):
    """One hit, ten misses, a hundred quiet keys."""
    data = [("hit", 5.0, 5.0)] + [(f"miss{i}", 0.0, 1.0) for i in range(10)] + [(f"quiet{i}", 0.0, 0.0) for i in range(100)]
    rows = spark.createDataFrame(data, "key string, predicted double, settled double").withColumn("g", F.lit(1))
    ap = metrics.expected_ap(rows.withColumn("score", F.col("predicted")).withColumn("bound", F.col("settled") > 0), ["g"]).first()
    assert ap.universe == 111 and ap.ap < 0.3
    overlap = metrics.soft_overlap(rows, ["g"]).first()
    assert overlap.overlap == pytest.approx(2 * 5 / (5 + 15))
    assert metrics.soft_overlap(spark.createDataFrame([(1, 0.0, 0.0)], "g int, predicted double, settled double"), ["g"]).first().overlap is None


def test_spearman_and_screening(spark):
    draw = random.Random(2)
    rows = [(t, f"n{i:02d}", float(draw.randint(0, 9)), float(draw.randint(0, 9))) for t in range(3) for i in range(30)] + [(9, f"n{i:02d}", float(i), 1.0) for i in range(30)]
    df = spark.createDataFrame(rows, "ts int, sp string, y double, y_hat double")

    def ranks(values):
        order = sorted(values)
        return [order.index(v) + (order.count(v) + 1) / 2 for v in values]

    got = {r.ts: r.spearman for r in metrics.spearman(df, ["ts"]).collect()}
    assert set(got) == {0, 1, 2}
    for t in range(3):
        a, b = ranks([r[2] for r in rows if r[0] == t]), ranks([r[3] for r in rows if r[0] == t])
        assert got[t] == pytest.approx(np.corrcoef(a, b)[0, 1])
    bundle = metrics.screening(df, ["ts"], "sp").first()
    assert bundle.spearman == pytest.approx(np.mean(list(got.values()))) and bundle.n_hours == 3


def test_ridge_recovers_planted_factors(spark):
    planted = {("A", "n1"): 0.35, ("A", "n2"): -0.10, ("B", "n1"): -0.25, ("B", "n2"): 0.45, ("C", "n1"): 0.15, ("C", "n2"): 0.20}
    draw, mu, cong = np.random.default_rng(0), [], []
    for h in range(984):
        hour = {k: float(draw.uniform(50, 600)) for k in "ABC" if draw.random() < 0.3}
        ts = f"2026-01-{1 + h // 24:02d} {h % 24:02d}:00:00" if h < 744 else f"2026-02-{1 + (h - 744) // 24:02d} {h % 24:02d}:00:00"
        mu += [(ts, k, v) for k, v in hour.items()]
        cong += [(ts, n, -sum(v * planted[k, n] for k, v in hour.items()) + float(draw.normal(0, 0.4))) for n in ("n1", "n2")]
    mu += [("2026-01-01 00:00:00", "thin", 5.0)]
    mu_df = spark.createDataFrame(mu, "ts string, key string, mu double").withColumn("ts", F.to_timestamp("ts"))
    cong_df = spark.createDataFrame(cong, "ts string, sp string, c double").withColumn("ts", F.to_timestamp("ts"))
    windows = spark.sql("SELECT DATE '2026-01-01' AS window_start, DATE '2026-02-15' AS window_end UNION ALL SELECT DATE '2026-01-10', DATE '2026-02-01'")
    got = models.rolling_ridge(mu_df, cong_df, windows, ridge=1.0, min_hours=25).collect()
    assert {r.key for r in got} == set("ABC") and len(got) == 12
    for r in got:
        assert r.sf == pytest.approx(planted[r.key, r.sp], abs=0.02) and not r.clipped
    # the same by the direct solution
    hours = sorted({t for t, _, _ in cong})
    x, y = np.zeros((len(hours), 3)), np.zeros((len(hours), 2))
    for t, k, v in mu:
        if k in "ABC":
            x[hours.index(t), "ABC".index(k)] = v
    for t, n, v in cong:
        y[hours.index(t), int(n[1]) - 1] = v
    scale = np.maximum(x.std(axis=0), 100)
    direct = -(np.linalg.solve((x / scale).T @ (x / scale) + np.eye(3), (x / scale).T @ y) / scale[:, None])
    for r in got:
        if str(r.window_start) == "2026-01-01":
            assert r.sf == pytest.approx(direct["ABC".index(r.key), int(r.sp[1]) - 1], abs=1e-9)


def test_planted_groups(spark):
    draw, rows = np.random.default_rng(0), []
    base = {b: draw.random(500) < 0.3 for b in "ABCD"}
    size = {b: draw.uniform(50, 300, 500) for b in "ABCD"}
    weight = {"A0": 3, "A1": 2, "A2": 1, "B0": 1, "B1": 2, "C0": 1, "D0": 2, "D1": 1}
    for h in range(500):
        rows += [(h, k, float(size[k[0]][h] * w * draw.uniform(0.98, 1.02))) for k, w in weight.items() if base[k[0]][h]]
    rows += [(h, "F_thin", 9.0) for h in range(3)]
    df = spark.createDataFrame(rows, "ts int, key string, mu double")
    got = {r.key: (r.grp, r.share) for r in models.constraint_groups(df, 500, rho=0.9).collect()}
    assert {k: v[0] for k, v in got.items()} == {"A0": "A0", "A1": "A0", "A2": "A0", "B0": "B1", "B1": "B1", "C0": "C0", "D0": "D0", "D1": "D0", "F_thin": "F_thin"}
    assert sum(v[1] for k, v in got.items() if k[0] == "A") == pytest.approx(1)


def test_one_node_centroid_and_opposing_pair(spark):
    geo = spark.createDataFrame([("HOU", 29.76, -95.37, "houston", 345.0), ("NOR", 32.78, -96.80, "north", 138.0), ("SOU", 27.8, -97.4, "south", 69.0)], "sp string, lat double, lon double, zone string, kv double")
    sf = spark.createDataFrame([("one", "NOR", 0.9), ("one", "HOU", 0.0), ("pair", "HOU", 0.5), ("pair", "NOR", -0.5)], "key string, sp string, sf double")
    got = {r.key: r for r in projection.centroids(sf, geo).collect()}
    assert (got["one"].lat_c, got["one"].lon_c, got["one"].spread_km, got["one"].kv_at_max) == (pytest.approx(32.78), pytest.approx(-96.80), pytest.approx(0, abs=1e-6), 138.0)
    assert got["one"].effective_nodes == pytest.approx(1) and got["pair"].effective_nodes == pytest.approx(2) and got["pair"].spread_km > 100
    shares = {(r.key, r.zone): r.share for r in projection.zone_shares(sf, geo).collect()}
    assert shares["one", "north"] == 1.0 and shares["pair", "houston"] == shares["pair", "north"] == 0.5


def test_contributions_add_up_to_the_projection(spark):
    draw = random.Random(4)
    mu = spark.createDataFrame([(t, f"k{k}", draw.uniform(0, 100)) for t in range(5) for k in range(8)], "ts int, key string, mu double")
    sf = spark.createDataFrame([(f"k{k}", f"n{n}", draw.uniform(-1, 1)) for k in range(8) for n in range(6)], "key string, sp string, sf double")
    points = {(r.ts, r.sp): r.point for r in projection.project(mu, sf).collect()}
    sums = {(r.ts, r.sp): r.s for r in projection.contributions(mu, sf).groupBy("ts", "sp").agg(F.sum("contribution").alias("s")).collect()}
    assert points == pytest.approx(sums)


def test_spanning_tree():
    lat, lon = np.array([0.0, 0.0, 0.0, 5.0]), np.array([0.0, 1.0, 2.0, 2.0])
    edges = models.spanning_tree(lat, lon)
    assert {frozenset(e[:2]) for e in edges} == {frozenset((0, 1)), frozenset((1, 2)), frozenset((2, 3))}
    assert models.spanning_tree(np.array([]), np.array([])) == []


def test_heads_learn_the_planted_rule(spark):
    rows = []
    draw = random.Random(3)
    for d in range(40):
        for k, threshold in (("A", 0.5), ("B", 2.0)):
            for _ in range(12):
                net = draw.random()
                rows.append((f"2026-01-{1 + d % 28:02d}", k, float(k == "A"), net if draw.random() > 0.05 else None, int(net > threshold), max(0.0, net - threshold) * 500))
    panel = spark.createDataFrame(rows, "day string, key string, is_a double, net double, y_bind int, y_mu double")
    got = models.walk_forward(panel, [("2026-01-01", "2026-01-20", "2026-01-27")], ["is_a", "net"], rounds=6, rate=0.3, min_leaf=20).toPandas()
    assert set(got["key"]) == {"A"}  # B never bound in training
    known = got.dropna(subset=["net"])
    assert ((known.p_bind > 0.5) == (known.y_bind == 1)).mean() > 0.95
    assert known.loc[known.y_bind == 1, ["mu_gbm", "y_mu"]].corr().iloc[0, 1] > 0.7
    assert models.walk_forward(panel, [("2026-03-01", "2026-03-20", "2026-03-27")], ["net"]) is None


def test_draws_are_reproducible_and_centred(spark):
    p = spark.createDataFrame([(t, "k", 0.5, 100.0) for t in range(50)], "ts int, key string, p_bind double, mu_gbm double")
    sf = spark.createDataFrame([("k", "n", -1.0)], "key string, sp string, sf double")
    a = models.draws(p, sf, 40, 0.0).agg(F.count("*").alias("n"), F.avg("point").alias("m")).first()
    assert a == models.draws(p.repartition(3), sf, 40, 0.0).agg(F.count("*").alias("n"), F.avg("point").alias("m")).first()
    assert a.m == pytest.approx(100) and abs(a.n - 1000) < 120


def test_history(spark):
    rows = [(f"2026-01-{d:02d}", "k", 30.0) for d in (1, 1, 3, 4)] + [(f"2026-01-{d:02d}", "other", 0.5) for d in range(1, 6)]
    got = {(r.key, r.day): r for r in history.binding_history(spark.createDataFrame(rows, "day string, key string, mu double"), 1.0, (1, 2)).collect()}
    row = got["k", "2026-01-05"]
    assert (row.binds_1d, row.binds_2d, row.days_since) == (1, 2, 1) and row.life_rate == pytest.approx(4 / 96)
    assert got["k", "2026-01-01"].binds_2d == 0 and got["k", "2026-01-01"].life_rate is None and got["other", "2026-01-05"].days_since is None
    edges = history.quantile_edges(spark.createDataFrame([(float(i),) for i in range(5)], "v double"), "v", 4)
    assert edges == [1.0, 2.0, 3.0]
    values = spark.createDataFrame([(None,), (0.5,), (1.0,), (9.0,)], "v double").select(history.bucket(F.col("v"), edges).alias("b"))
    assert [r.b for r in values.collect()] == [-1, 0, 1, 3]


def test_writes(spark, tmp_path):
    stored = spark.createDataFrame([(1, 5, "a"), (2, 5, "b")], "k int, posted int, v string")
    batch = spark.createDataFrame([(1, 4, "old"), (2, 6, "new"), (3, 1, "x"), (3, 2, "y")], "k int, posted int, v string")
    assert sorted(map(tuple, writes.upsert(stored, batch, ["k"], "posted").collect())) == [(1, 4, "old"), (2, 6, "new"), (3, 2, "y")]
    assert sorted(map(tuple, writes.upsert_if_newer(stored, batch, ["k"], "posted").collect())) == [(1, 5, "a"), (2, 6, "new"), (3, 2, "y")]
    assert sorted(map(tuple, writes.insert_ignore(stored, batch, ["k"]).collect())) == [(3, 1, "x")]
    folder = str(tmp_path / "t")
    for _ in range(2):
        writes.replace_scope(spark.createDataFrame([("r", 1, 10), ("r", 2, 20)], "run string, day int, v int"), folder, ["run", "day"])
    writes.replace_scope(spark.createDataFrame([("r", 2, 21)], "run string, day int, v int"), folder, ["run", "day"])
    assert sorted((r.day, r.v) for r in spark.read.parquet(folder).collect()) == [(1, 10), (2, 21)]
    ledger = spark.createDataFrame([("a", 1, 0), ("b", 1, 5)], "endpoint string, w int, rows_fetched int")
    wanted = spark.createDataFrame([("a", 1), ("b", 1)], "endpoint string, w int")
    assert [r.endpoint for r in writes.open_windows(wanted, ledger, ["endpoint", "w"]).collect()] == ["a"]
    assert writes.asserted(stored, positive="k > 0").count() == 2
    with pytest.raises(Exception, match="check small failed"):
        writes.asserted(stored, small="k < 2").collect()
    writes.publish(stored, {"artifact_sf": stored}, spark.createDataFrame([("map", "r")], "layer string, run_id string"), str(tmp_path / "p"), ["k"])
    assert spark.read.parquet(str(tmp_path / "p/forecast_current")).first().run_id == "r"


def test_scopes_that_a_load_speaks_for(spark, tmp_path):
    schema, folder = "run string, day string, v int", str(tmp_path / "scopes")
    writes.replace_scope(spark.createDataFrame([("r", "a b", 1), ("r", "c/d", 2), ("s", "a b", 3)], schema), folder, ["run", "day"])
    asked = spark.createDataFrame([("r", "a b"), ("r", "c/d")], "run string, day string")
    writes.replace_scope(spark.createDataFrame([("r", "a b", 9)], schema), folder, ["run", "day"], asked)
    assert sorted((r.run, r.day, r.v) for r in spark.read.parquet(folder).collect()) == [("r", "a b", 9), ("s", "a b", 3)]
    writes.replace_scope(spark.createDataFrame([], schema), folder, ["run", "day"], asked)
    assert [r.v for r in spark.read.parquet(folder).collect()] == [3]
    writes.replace_scope(spark.createDataFrame([("s", "e", 4)], schema), folder, ["run", "day"])
    writes.delete_scopes(spark, folder, [{"run": "s"}])
    assert not list((tmp_path / "scopes").glob("run=s*"))


def test_components_of_long_chains(spark):
    edges = [(f"n{i:03d}", f"n{i + 1:03d}") for i in range(60)] + [("x", "y"), ("z", "y"), ("x", "x")]
    got = {r.node: r.root for r in graphs.components(spark.createDataFrame(edges, "a string, b string")).collect()}
    assert {k: v for k, v in got.items() if k[0] == "n"} == {f"n{i:03d}": "n000" for i in range(61)}
    assert {k: v for k, v in got.items() if k[0] != "n"} == {"x": "x", "y": "x", "z": "x"}


def test_linkage_against_brute_force():
    draw = np.random.default_rng(5)
    for n in (1, 2, 7, 25):
        for _ in range(20):
            d = draw.random((n, n))
            d = (d + d.T) / 2
            np.fill_diagonal(d, 0)
            clusters = [[i] for i in range(n)]
            while len(clusters) > 1:
                far, i, j = min((max(d[a, b] for a in x for b in y), i, j) for i, x in enumerate(clusters) for j, y in enumerate(clusters) if i < j)
                if far > 0.5:
                    break
                clusters[i] += clusters.pop(j)
            assert linkage.dense(d, 0.5) == sorted(sorted(c) for c in clusters)


def test_as_of_over_stretches(spark):
    draw = random.Random(3)
    at = lambda: dt.datetime(2020, 1, 1) + dt.timedelta(hours=draw.randrange(24 * 900))
    left = [(i, draw.choice("abc"), at()) for i in range(300)]
    right = {(draw.choice("ab"), at()): i for i in range(25)}
    got = panels.as_of(spark.createDataFrame(left, "id int, k string, ts timestamp"), spark.createDataFrame([(k, t, v) for (k, t), v in right.items()], "k string, at timestamp, v int"), ["k"], "ts", "at", ["v"], bucket="month")
    want = {i: max(((t, v) for (k2, t), v in right.items() if k2 == k and t <= ts), default=(None, None))[1] for i, k, ts in left}
    assert {r.id: r.v for r in got.collect()} == want


def test_nearest_edge_is_not_nearest_vertex(spark):
    long = [{"x": -50.0, "y": 0.0}, {"x": 50.0, "y": 0.0}, {"x": 50.0, "y": -1.0}, {"x": -50.0, "y": -1.0}]
    small = [{"x": 0.0, "y": 5.0}, {"x": 1.0, "y": 5.0}, {"x": 1.0, "y": 6.0}, {"x": 0.0, "y": 6.0}]
    zones = spark.createDataFrame([("long", long), ("small", small)], "zone string, ring array<struct<x: double, y: double>>")
    points = spark.createDataFrame([(1, 0.5, 2.0), (2, 0.5, 3.5), (3, 900.0, 900.0), (4, 10.0, -0.5), (5, None, 1.0)], "id int, x double, y double")
    got = {r.id: (r.zone, r.method) for r in places.assign_zone(points, zones, "id").collect()}
    assert got == {1: ("long", "nearest"), 2: ("small", "nearest"), 3: ("long", "nearest"), 4: ("long", "within")}


def test_radius_near_the_pole_and_the_date_line(spark):
    draw = random.Random(6)
    near = lambda: draw.choice([(draw.uniform(84, 89.9), draw.uniform(-180, 180)), (draw.uniform(-2, 2), draw.choice([-179.9, 179.9, 180.0]) + draw.uniform(-0.1, 0.1)), (draw.uniform(62, 63), draw.uniform(10, 12))])
    left, right = [(i, *near()) for i in range(150)], [(i, *near()) for i in range(150)]
    got = {r.k: r.id for r in places.radius_match(spark.createDataFrame(left, "k int, lat double, lon double"), spark.createDataFrame(right, "id int, lat_r double, lon_r double"), "k", 60.0).collect()}

    def away(a, b, c, d):
        h = math.sin(math.radians(c - a) / 2) ** 2 + math.cos(math.radians(a)) * math.cos(math.radians(c)) * math.sin(math.radians(d - b) / 2) ** 2
        return 2 * 6371.0 * math.asin(min(1, math.sqrt(h)))

    want = {i: min((away(a, b, c, d), j) for j, c, d in right) for i, a, b in left}
    assert got == {i: j for i, (km, j) in want.items() if km <= 60.0} and len(got) > 60


def test_merged_files_stay_bounded(spark, tmp_path):
    schema, folder = "k int, posted int, v string", str(tmp_path / "buckets")
    apply = ingest.merge_into(folder, schema, lambda stored, batch: writes.upsert(stored, batch, ["k"], "posted"), ["k"], buckets=8)
    for i in range(10):
        apply(spark.createDataFrame([(i % 3, i, f"v{i}")], schema), i)
    assert sorted(map(tuple, ingest.current(spark, folder, schema).collect())) == [(0, 9, "v9"), (1, 7, "v7"), (2, 8, "v8")]
    assert len(list((tmp_path / "buckets/data").glob("*/*/*.parquet"))) <= 4 and len(list((tmp_path / "buckets/state").iterdir())) == 2


def test_boards(spark):
    weekly = spark.createDataFrame([("m", "2026-01-05", 1), ("m", "2026-01-12", 2)], "s string, week string, value int").withColumn("week", F.to_date("week"))
    daily = spark.createDataFrame([("m", "2026-01-14", 9)], "s string, day string, value int").withColumn("day", F.to_date("day"))
    got = sorted((str(r.day), r.value, r.grain) for r in boards.served_first(weekly, daily, ["s"]).collect())
    assert got == [("2026-01-05", 1, "weekly"), ("2026-01-14", 9, "daily")]
    days = spark.createDataFrame([(1,), (4,), (9,)], "day int")
    assert tuple(boards.neighbours(days, F.lit(4)).first()) == (1, 9)
    assert boards.gradeable(days, days.where("day = 9"), days.where("day < 9")).first().day == 4


def test_places(spark):
    ring = [(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (2.0, 1.0), (0.0, 4.0)]
    zones = spark.createDataFrame([("z", [{"x": x, "y": y} for x, y in ring]), ("far", [{"x": 50.0, "y": 50.0}, {"x": 51.0, "y": 50.0}, {"x": 50.0, "y": 51.0}])], "zone string, ring array<struct<x:double,y:double>>")
    points = spark.createDataFrame([(1, 0.5, 1.0), (2, 2.0, 3.0), (3, 49.0, 49.0)], "id int, x double, y double")
    got = {r.id: (r.zone, r.method) for r in places.assign_zone(points, zones, "id").collect()}
    assert got == {1: ("z", "within"), 2: ("z", "nearest"), 3: ("far", "nearest")}
    station = spark.createDataFrame([("ABCDE",), ("XYZ",)], "station string")
    sps = spark.createDataFrame([("ABCD_1",), ("ABX_2",)], "sp string")
    assert [(r.station, r.sp, r.length) for r in places.prefix_match(station, sps, 2).collect()] == [("ABCDE", "ABCD_1", 4)]
    feature = places.features(spark.createDataFrame([("a", 1.0, 2.0), ("b", None, 2.0)], "sp string, lat double, lon double")).collect()
    assert len(feature) == 1 and '"coordinates":[2.0,1.0]' in feature[0].feature


def test_files(spark, tmp_path):
    import zipfile

    for i, names in enumerate((["a.csv"], ["b.csv", "note.txt"])):
        with zipfile.ZipFile(tmp_path / f"{i}.zip", "w") as archive:
            for n in names:
                archive.writestr(n, f"ts,price\n2026-01-0{i + 1},1.5\n2026-01-0{i + 1},nan\n")
    got = files.hour_minus_nulls(files.read_zipped_csv(spark, str(tmp_path / "*.zip"), ["ts", "price"]), ["price"])
    assert sorted((r.ts, r.price is None) for r in got.collect()) == [("2026-01-01", False), ("2026-01-01", True), ("2026-01-02", False), ("2026-01-02", True)]
    assert files.newest(spark, str(tmp_path / "*.zip")).endswith("1.zip")
    with pytest.raises(ValueError):
        files.only_csv((lambda p: (zipfile.ZipFile(p, "w").close(), p.read_bytes())[1])(tmp_path / "empty.zip"))
    with pytest.raises(Exception, match="unsound"):
        files.validated_map(spark.createDataFrame([("k", "n", math.nan)], "key string, sp string, sf double")).collect()
    meta = spark.createDataFrame([("2026-01-01", "2026-02-01"), ("2026-01-08", "2026-02-08")], "a string, b string").select(F.to_date("a").alias("window_start"), F.to_date("b").alias("window_end"))
    assert str(files.resolve_window(meta, "2026-02-05").first().window_end) == "2026-02-01"
    assert files.resolve_window(meta, "2026-03-30", 14).count() == 0


def test_streaming_merge_is_idempotent(spark, tmp_path):
    schema, source, folder = "k int, posted int, v string", str(tmp_path / "in"), str(tmp_path / "out")
    for i, rows in enumerate(([(1, 1, "a"), (2, 1, "b")], [(1, 0, "late"), (2, 2, "c"), (3, 1, "d")])):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(schema).parquet(source)
        ingest.upsert_stream(stream, folder, schema, ["k"], posted="posted").awaitTermination()
    want = [(1, 1, "a"), (2, 2, "c"), (3, 1, "d")]
    assert sorted(map(tuple, ingest.current(spark, folder, schema).collect())) == want
    again = ingest.merge_into(folder, schema, lambda stored, batch: batch, ["k"])
    again(spark.createDataFrame([(9, 9, "z")], schema), 0)  # a batch that was merged before changes nothing
    assert sorted(map(tuple, ingest.current(spark, folder, schema).collect())) == want


def test_stored_rows_have_ids_and_nulls_and_asked_days_are_listed(spark):
    import datetime

    import pytest

    from nodalis.operators import runs

    scores = spark.createDataFrame([("a", float("nan"), 3.0), ("b", 0.5, 4.0)], "source string, r double, n double")
    ids = spark.createDataFrame([("a", 1), ("b", 2)], "source string, source_id int")
    assert sorted(map(tuple, runs.weekly_rows(scores, ids, ("n",), "w").collect())) == [("w", 1, None, 3), ("w", 2, 0.5, 4)]
    with pytest.raises(Exception, match="no id for source b"):
        runs.weekly_rows(scores, ids.where("source = 'a'"), ("n",), "w").collect()
    days = spark.range(5).selectExpr("date_add(date'2024-01-01', cast(id AS int)) AS day")
    stored = days.where("day < '2024-01-04'")
    assert [r.day.day for r in runs.pending_days(days, stored.union(stored), ["day"]).orderBy("day").collect()] == [4, 5]
    assert [r.day for r in runs.newest_days(stored.union(stored), "2024-01-03", 2).collect()] == [datetime.date(2024, 1, 2), datetime.date(2024, 1, 3)]


def test_outage_signal_counts_unbound_keys_as_zero_and_skips_flat_days(spark):
    from nodalis.operators import runs

    exposed = spark.range(20).selectExpr("date_add(date'2024-01-01', cast(id div 10 AS int)) AS day", "string(id % 10) AS key", "double(id) AS exposure")
    sizes = exposed.where("exposure BETWEEN 5 AND 9").selectExpr("day", "key", "exposure AS size")
    got = runs.outage_signal(exposed, sizes).collect()
    assert len(got) == 1 and got[0].n == 10 and 0.8 < got[0].spearman < 1
