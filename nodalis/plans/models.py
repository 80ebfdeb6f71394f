"""Queries over the numeric kernels and over spatial and fuzzy matching."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nodalis.operators import history, models, places, projection
from nodalis.operators.graphs import laid
from nodalis.plans.registry import query, r6, stamp
from nodalis.sources import market
from nodalis.sources.market import with_sql


def _windows(spark: SparkSession) -> DataFrame:
    starts = ["2024-01-01", "2024-01-08", "2024-01-15"]
    return spark.createDataFrame([(s,) for s in starts], "s string").select(F.to_date("s").alias("window_start"), F.date_add(F.to_date("s"), 14).alias("window_end"))


def _planted(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    mu, sf = market.shadow_prices(spark, sf_dir).select("ts", "key", "mu"), market.shift_factors(spark, sf_dir)
    return mu, sf, projection.project(mu, sf).withColumnRenamed("point", "c")


@query()
def ridge_sf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rolling 14-day ridge on congestion made from known shift factors; see the tests for the recovery."""
    mu, _, cong = _planted(spark, sf_dir)
    got = models.rolling_ridge(mu, cong, _windows(spark), ridge=0.1, min_hours=10, std_floor=1.0)
    return got.select(F.date_format("window_start", "yyyy-MM-dd").alias("window_start"), "key", "sp", r6("sf").alias("sf"), "clipped")


@query(with_sql("mu", """
, h AS (SELECT count(DISTINCT ts) AS h FROM mu), k AS (SELECT key, sum(mu) AS s, sum(mu * mu) AS ss FROM mu GROUP BY key HAVING count(*) FILTER (mu > 0) >= 40),
 v AS (SELECT key, s, ss / h - power(s / h, 2) AS var, h FROM k, h),
 p AS (SELECT a.key AS a, b.key AS b, sum(a.mu * b.mu) AS sxy FROM mu AS a JOIN mu AS b ON a.ts = b.ts AND a.key < b.key GROUP BY 1, 2)
SELECT p.a, p.b, round((sxy / x.h - x.s / x.h * y.s / y.h) / sqrt(x.var * y.var), 6) + 0.0 AS r FROM p JOIN v AS x ON p.a = x.key JOIN v AS y ON p.b = y.key"""))
def constraint_correlation(spark: SparkSession, sf_dir: str) -> DataFrame:
    mu = market.shadow_prices(spark, sf_dir, by_key=True)
    return models.correlations(mu, market.hours(spark, sf_dir), 40, digits=6)


@query()
def complete_linkage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return models.constraint_groups(market.shadow_prices(spark, sf_dir, by_key=True), market.hours(spark, sf_dir), rho=0.1)


@query()
def mst_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = projection.reach(market.shift_factors(spark, sf_dir), 0.5, 0.05, 20).select("key", "sp")
    return models.mst_edges(near.join(market.geography(spark, sf_dir), "sp"))


@query()
def monte_carlo(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bands of 40 draws for every hour and node."""
    mu, sf = market.shadow_prices(spark, sf_dir), market.shift_factors(spark, sf_dir)
    predictions = mu.select("ts", "key", F.lit(0.8).alias("p_bind"), F.col("mu").alias("mu_gbm"))
    drawn = models.draws(predictions, sf, 40, 0.4)
    bands = drawn.groupBy("ts", "sp").agg(F.percentile("point", [0.1, 0.5, 0.9]).alias("p"))
    return bands.select(stamp("ts").alias("ts"), "sp", r6(F.col("p")[0]).alias("p10"), r6(F.col("p")[1]).alias("p50"), r6(F.col("p")[2]).alias("p90"))


def _panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features and labels by key and day, computed once for training and scoring."""
    mu = market.shadow_prices(spark, sf_dir).withColumn("day", F.to_date("ts"))
    past = history.binding_history(mu, 20.0, (1, 7))
    today = history.daily(mu, 20.0)
    return laid(past.join(today, ["key", "day"], "left").select(
        "key", "day", "binds_1d", "binds_7d", "life_rate", "mean_mu_7d", F.col("days_since").cast("double").alias("days_since"), F.dayofweek("day").alias("dow"),
        (F.coalesce("binds", F.lit(0)) > 2).cast("int").alias("y_bind"), F.coalesce("total", F.lit(0.0)).alias("y_mu"),
    ))


FEATURES = ["binds_1d", "binds_7d", "life_rate", "mean_mu_7d", "days_since", "dow"]


@query()
def bind_head(spark: SparkSession, sf_dir: str) -> DataFrame:
    panel = _panel(spark, sf_dir)
    scored = models.bind_head(panel.where("day < '2024-01-24'"), panel.where("day >= '2024-01-24'"), FEATURES)
    return scored.select("key", F.date_format("day", "yyyy-MM-dd").alias("day"), r6("p_bind").alias("p_bind"), "y_bind")


@query()
def mu_head(spark: SparkSession, sf_dir: str) -> DataFrame:
    panel = _panel(spark, sf_dir)
    scored = models.mu_head(panel.where("day < '2024-01-24'"), panel.where("day >= '2024-01-24'"), FEATURES)
    return scored.select("key", F.date_format("day", "yyyy-MM-dd").alias("day"), r6("mu_gbm").alias("mu_gbm"), "y_mu")


@query(with_sql("mu", """
, c AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY ts) AS n FROM mu WHERE mu > 0)
SELECT key, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS first_bind, strftime(min(CASE WHEN n = 25 THEN ts END), '%Y-%m-%d %H:%M:%S') AS admitted,
  CAST(date_diff('day', CAST(min(ts) AS DATE), CAST(min(CASE WHEN n = 25 THEN ts END) AS DATE)) AS INTEGER) AS latency_days, round(sum(CASE WHEN n < 25 THEN mu END), 6) AS blind_mass FROM c GROUP BY key"""))
def admission_latency(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = models.admission(market.shadow_prices(spark, sf_dir), 25)
    return got.select("key", stamp("first_bind").alias("first_bind"), stamp("admitted").alias("admitted"), "latency_days", r6("blind_mass").alias("blind_mass"))


@query("""
WITH p AS (SELECT s_suppkey AS id, CAST((s_suppkey * 37) % 1000 AS DOUBLE) / 100 AS x, CAST((s_suppkey * 91) % 1000 AS DOUBLE) / 100 AS y FROM supplier),
z AS (SELECT 'Z' || CAST(r_regionkey AS VARCHAR) AS zone, r_regionkey * 1.9 + 0.1 AS x0, r_regionkey * 1.9 + 1.85 AS x1, 2.05 AS y0, 7.95 AS y1 FROM region),
i AS (SELECT id, min(zone) AS zone FROM p JOIN z ON x > x0 AND x < x1 AND y > y0 AND y < y1 GROUP BY 1),
n AS (SELECT id, arg_min(zone, (power(greatest(x0 - x, x - x1, 0), 2) + power(greatest(y0 - y, y - y1, 0), 2), zone)) AS zone FROM p CROSS JOIN z WHERE id NOT IN (SELECT id FROM i) GROUP BY 1)
SELECT id, zone, 'within' AS method FROM i UNION ALL SELECT id, zone, 'nearest' FROM n""")
def point_in_polygon(spark: SparkSession, sf_dir: str) -> DataFrame:
    id_ = F.col("s_suppkey")
    points = market.table(spark, sf_dir, "supplier").select(id_.alias("id"), ((id_ * 37 % 1000).cast("double") / 100).alias("x"), ((id_ * 91 % 1000).cast("double") / 100).alias("y"))
    r = F.col("r_regionkey")
    x0, x1, y0, y1 = (r * 190 + 10) / F.lit(100.0), (r * 190 + 185) / F.lit(100.0), F.lit(2.05), F.lit(7.95)
    corners = F.array(*(F.struct(x.alias("x"), y.alias("y")) for x, y in ((x0, y0), (x1, y0), (x1, y1), (x0, y1))))
    zones = market.table(spark, sf_dir, "region").select(F.concat(F.lit("Z"), r.cast("string")).alias("zone"), corners.alias("ring"))
    return places.assign_zone(points, zones, "id")


@query("""
WITH a AS (SELECT s_suppkey AS id, 26.0 + CAST((s_suppkey * 37) % 1000 AS DOUBLE) / 100 AS lat, -104.0 + CAST((s_suppkey * 91) % 1000 AS DOUBLE) / 100 AS lon, s_nationkey AS fuel FROM supplier),
b AS (SELECT c_custkey AS rid, 26.0 + CAST((c_custkey * 53) % 1000 AS DOUBLE) / 100 AS lat_r, -104.0 + CAST((c_custkey * 71) % 1000 AS DOUBLE) / 100 AS lon_r, c_nationkey AS fuel_r FROM customer),
j AS (SELECT a.id, rid, 2 * 6371.0 * asin(least(1.0, sqrt(power(sin(radians(lat_r - lat) / 2), 2) + cos(radians(lat)) * cos(radians(lat_r)) * power(sin(radians(lon_r - lon) / 2), 2)))) AS km FROM a JOIN b ON fuel % 5 = fuel_r % 5)
SELECT id, arg_min(rid, (km, rid)) AS match, round(min(km), 4) AS km FROM j WHERE km <= 30 GROUP BY id""")
def radius_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    def place(table: str, key: str, nation: str, a: int, b: int) -> DataFrame:
        k = F.col(key)
        return market.table(spark, sf_dir, table).select(k.alias("k"), (F.lit(26.0) + (k * a % 1000).cast("double") / 100).alias("lat"), (F.lit(-104.0) + (k * b % 1000).cast("double") / 100).alias("lon"), (F.col(nation) % 5).alias("fuel"))

    left = place("supplier", "s_suppkey", "s_nationkey", 37, 91).withColumnRenamed("k", "key")
    right = place("customer", "c_custkey", "c_nationkey", 53, 71).toDF("id", "lat_r", "lon_r", "fuel_r")
    got = places.radius_match(left, right, "key", 30.0, F.col("fuel") == F.col("fuel_r"))
    return got.select(F.col("key").alias("id"), F.col("id").alias("match"), F.round("km", 4).alias("km"))


@query("""
WITH q AS (SELECT p_partkey AS q, upper(p_name) || ' ' || upper(p_type) AS name FROM part), p AS (SELECT p_partkey AS p, upper(p_name) AS pool_name FROM part),
qt AS (SELECT q, list_sort(list_distinct(string_split(name, ' '))) AS t FROM q), t AS (SELECT DISTINCT t AS q, t FROM qt), u AS (SELECT min(p) AS p, u FROM (SELECT p, list_sort(list_distinct(string_split(pool_name, ' '))) AS u FROM p) GROUP BY u),
j AS (SELECT q, p, t, u, list_sort(list_intersect(t, u)) AS s FROM t, u WHERE len(list_intersect(t, u)) > 0),
k AS (SELECT q, p, array_to_string(s, ' ') AS s, trim(array_to_string(s, ' ') || ' ' || array_to_string(list_sort(list_filter(t, lambda x: NOT list_contains(u, x))), ' ')) AS a, trim(array_to_string(s, ' ') || ' ' || array_to_string(list_sort(list_filter(u, lambda x: NOT list_contains(t, x))), ' ')) AS b FROM j),
r AS (SELECT q, p, greatest(100 * (1 - levenshtein(s, a) / greatest(length(s), length(a))), 100 * (1 - levenshtein(s, b) / greatest(length(s), length(b))), 100 * (1 - levenshtein(a, b) / greatest(length(a), length(b)))) AS score FROM k)
SELECT qt.q, b.p, b.score FROM qt JOIN (SELECT q, arg_min(p, (-score, p)) AS p, round(max(score), 6) AS score FROM r WHERE score >= 60 GROUP BY q) AS b ON qt.t = b.q""")
def fuzzy_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = market.table(spark, sf_dir, "part")
    queries = part.select(F.col("p_partkey").alias("q"), F.concat_ws(" ", "p_name", "p_type").alias("name"))
    pool = part.select(F.col("p_partkey").alias("p"), F.col("p_name").alias("pool_name"))
    return places.fuzzy_match(queries, pool, 60.0).select("q", "p", r6("score").alias("score"))


@query(with_sql("mu sf", """
, m AS (SELECT key, 'G' || CAST(vec_id % 12 AS VARCHAR) AS grp, sum(abs(mu)) AS w FROM mu GROUP BY key, vec_id), s AS (SELECT key, grp, w / sum(w) OVER (PARTITION BY grp) AS share FROM m)
SELECT grp, sp, round(sum(sf * share) / sum(share), 6) + 0.0 AS sf FROM sf JOIN s USING (key) GROUP BY 1, 2"""))
def group_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    mu = market.shadow_prices(spark, sf_dir)
    mass = mu.groupBy("key", F.concat(F.lit("G"), (F.col("vec_id") % 12).cast("string")).alias("grp")).agg(F.sum(F.abs("mu")).alias("w"))
    members = mass.select("key", "grp", (F.col("w") / F.sum("w").over(Window.partitionBy("grp"))).alias("share"))
    return projection.group_projection(market.shift_factors(spark, sf_dir), members).select("grp", "sp", r6("sf").alias("sf"))
