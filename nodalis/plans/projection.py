"""Queries over the projection family."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nodalis.functions import clock, fields
from nodalis.operators import projection
from nodalis.plans.registry import query, r6, stamp
from nodalis.sources import market
from nodalis.sources.market import with_sql

DAY = "ts >= TIMESTAMP '2024-01-10' AND ts < TIMESTAMP '2024-01-11'"


def _day(df: DataFrame) -> DataFrame:
    return df.where("ts >= '2024-01-10' AND ts < '2024-01-11'")


@query(with_sql("mu sf", """
SELECT strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts, sp, round(-sum(mu * sf), 6) + 0.0 AS point FROM mu JOIN sf USING (key) GROUP BY mu.ts, sp"""))
def sf_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = projection.project(market.shadow_prices(spark, sf_dir), market.shift_factors(spark, sf_dir))
    return points.select(stamp("ts").alias("ts"), "sp", r6("point").alias("point"))


@query(with_sql("mu sf", """
, p AS (SELECT ts, key, least(mu / 100, 1.0) AS p_bind, mu AS mu_gbm FROM mu UNION ALL SELECT ts, key, 0.5, mu + 1 FROM mu WHERE vec_id % 4 = 0),
 e AS (SELECT ts, key, avg(p_bind) * avg(mu_gbm) AS mu FROM p GROUP BY 1, 2)
SELECT strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts, key, round(mu, 9) AS mu FROM e"""))
def expected_mu(spark: SparkSession, sf_dir: str) -> DataFrame:
    mu = market.shadow_prices(spark, sf_dir)
    first = mu.select("ts", "key", F.least(F.col("mu") / 100, F.lit(1.0)).alias("p_bind"), F.col("mu").alias("mu_gbm"))
    again = mu.where("vec_id % 4 = 0").select("ts", "key", F.lit(0.5).alias("p_bind"), (F.col("mu") + 1).alias("mu_gbm"))
    return projection.expected_mu(first.unionByName(again)).select(stamp("ts").alias("ts"), "key", F.round("mu", 9).alias("mu"))


@query(with_sql("mu sf", f"""
SELECT strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts, sp, mu.key, round(-mu * sf, 6) + 0.0 AS contribution FROM mu JOIN sf USING (key) WHERE {DAY} AND mu * sf <> 0"""))
def node_contributions(spark: SparkSession, sf_dir: str) -> DataFrame:
    terms = projection.contributions(_day(market.shadow_prices(spark, sf_dir)), market.shift_factors(spark, sf_dir))
    return terms.select(stamp("ts").alias("ts"), "sp", "key", r6("contribution").alias("contribution"))


@query(with_sql("mu sf", f"""
, t AS (SELECT ts, sp, mu.key, -mu * sf AS c FROM mu JOIN sf USING (key) WHERE {DAY} AND mu * sf <> 0),
 r AS (SELECT *, row_number() OVER (PARTITION BY ts, sp ORDER BY abs(c) DESC, key) AS rank FROM t)
SELECT strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts, sp, key, round(c, 6) + 0.0 AS contribution, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 5"""))
def top_drivers(spark: SparkSession, sf_dir: str) -> DataFrame:
    terms = projection.contributions(_day(market.shadow_prices(spark, sf_dir)), market.shift_factors(spark, sf_dir))
    return projection.node_drivers(terms, 5).select(stamp("ts").alias("ts"), "sp", "key", r6("contribution").alias("contribution"), "rank")


@query(with_sql("mu sf", f"""
, t AS (SELECT sp, mu.key AS key, sum(-mu * sf) AS v FROM mu JOIN sf USING (key) WHERE {DAY} AND mu * sf <> 0 GROUP BY 1, 2),
 r AS (SELECT *, row_number() OVER (PARTITION BY sp ORDER BY abs(v) DESC, key) AS n, sum(abs(v)) OVER (PARTITION BY sp) AS gross FROM t)
SELECT sp, key, round(v, 6) AS contribution, round(abs(v) / gross, 6) AS share FROM r WHERE n = 1"""))
def dominant_driver(spark: SparkSession, sf_dir: str) -> DataFrame:
    terms = projection.contributions(_day(market.shadow_prices(spark, sf_dir)), market.shift_factors(spark, sf_dir))
    return projection.dominant_driver(terms).select("sp", "key", r6("contribution").alias("contribution"), r6("share").alias("share"))


@query(with_sql("sf", """
, p AS (SELECT *, max(abs(sf)) OVER (PARTITION BY key) AS peak FROM sf), a AS (SELECT * FROM p WHERE abs(sf) >= greatest(peak * 0.6, 0.1)),
 r AS (SELECT *, count(*) OVER (PARTITION BY key) AS n_nodes, row_number() OVER (PARTITION BY key ORDER BY abs(sf) DESC, sp) AS rank FROM a)
SELECT key, sp, sf, n_nodes, CAST(rank AS INTEGER) AS rank, n_nodes > 6 AS truncated FROM r WHERE rank <= 6"""))
def reach_floor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return projection.reach(market.shift_factors(spark, sf_dir), 0.6, 0.1, 6).select("key", "sp", "sf", "n_nodes", "rank", "truncated")


@query(with_sql("mu sf", """
, m AS (SELECT key, sum(abs(mu)) AS mass FROM mu GROUP BY 1),
 g AS (SELECT key, sum(abs(sf)) AS reach, CAST(count(*) FILTER (sf >= 0.1) AS BIGINT) AS n_up, CAST(count(*) FILTER (sf <= -0.1) AS BIGINT) AS n_down FROM sf GROUP BY 1)
SELECT key, round(mass, 6) AS mass, round(reach, 6) AS reach, n_up, n_down, round(mass * reach, 4) AS contribution FROM m JOIN g USING (key) WHERE mass * reach > 0 ORDER BY mass * reach DESC, key LIMIT 25"""))
def ranked_contribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    top = projection.ranked_constraints(market.shadow_prices(spark, sf_dir), market.shift_factors(spark, sf_dir), 25, 0.1)
    return top.select("key", r6("mass").alias("mass"), r6("reach").alias("reach"), "n_up", "n_down", F.round("contribution", 4).alias("contribution"))


@query(with_sql("mu sf", f"""
, d AS (SELECT key, sum(mu) AS mu FROM mu WHERE {DAY} GROUP BY 1), t AS (SELECT key, sf, -mu * sf AS c FROM sf JOIN d USING (key) WHERE sp = 'N7' AND mu * sf <> 0)
SELECT key, sf, round(c, 6) AS contribution, round((SELECT sum(abs(c)) FROM t), 6) AS gross FROM t ORDER BY abs(c) DESC, key LIMIT 15"""))
def exposures(spark: SparkSession, sf_dir: str) -> DataFrame:
    top = projection.exposures(market.shift_factors(spark, sf_dir), _day(market.shadow_prices(spark, sf_dir)), "N7", 15)
    return top.select("key", "sf", r6("contribution").alias("contribution"), r6("gross").alias("gross"))


@query(with_sql("mu sf", """
SELECT strftime(CAST(ts AS DATE), '%Y-%m-%d') AS day, round(sum(CASE WHEN k.key IS NOT NULL THEN abs(mu) ELSE 0 END) / sum(abs(mu)), 6) AS coverage, round(sum(abs(mu)), 6) AS mass
FROM mu LEFT JOIN (SELECT DISTINCT key FROM sf WHERE abs(sf) >= 0.25) AS k ON mu.key = k.key GROUP BY 1"""))
def sf_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    mu = market.shadow_prices(spark, sf_dir).withColumn("day", F.date_format("ts", "yyyy-MM-dd"))
    covered = projection.mass_coverage(mu, market.shift_factors(spark, sf_dir).where("abs(sf) >= 0.25"), ("day",))
    return covered.select("day", r6("coverage").alias("coverage"), r6("mass").alias("mass"))


@query(with_sql("mu sf", f"""
, d AS (SELECT key, sum(mu) AS mu FROM mu WHERE {DAY} GROUP BY 1), a AS (SELECT key, -mu * sf AS c FROM sf JOIN d USING (key) WHERE sp = 'N3' AND sf > 0), b AS (SELECT key, -mu * sf AS c FROM sf JOIN d USING (key) WHERE sp = 'N9' AND sf < 0),
 j AS (SELECT key, a.c AS a, b.c AS b, coalesce(a.c, 0) - coalesce(b.c, 0) AS c FROM a FULL JOIN b USING (key))
SELECT key, round(a, 6) AS a, round(b, 6) AS b, round(c, 6) AS contribution, round(abs(c) / sum(abs(c)) OVER (), 6) AS share, CAST(row_number() OVER (ORDER BY abs(c) DESC, key) AS INTEGER) AS rank FROM j"""))
def basis_full_outer(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = _day(market.shadow_prices(spark, sf_dir)).groupBy("key").agg(F.sum("mu").alias("mu"))
    terms = market.shift_factors(spark, sf_dir).join(day, "key").withColumn("contribution", -F.col("mu") * F.col("sf"))
    out = projection.basis(terms.where("sp = 'N3' AND sf > 0"), terms.where("sp = 'N9' AND sf < 0"))
    return out.select("key", r6("a").alias("a"), r6("b").alias("b"), r6("contribution").alias("contribution"), r6("share").alias("share"), "rank")


@query(with_sql("sf geo", """
, p AS (SELECT key, sp, abs(sf) AS w, lat, lon, kv FROM sf JOIN geo USING (sp) WHERE sf <> 0),
 c AS (SELECT key, sum(w * lat) / sum(w) AS lat_c, sum(w * lon) / sum(w) AS lon_c, power(sum(w), 2) / sum(w * w) AS effective_nodes, sum(w * kv) / sum(w) AS kv_mean, arg_max(kv, (w, sp)) AS kv_at_max FROM p GROUP BY key),
 s AS (SELECT key, sqrt(sum(w * power(2 * 6371.0 * asin(least(1.0, sqrt(power(sin(radians(lat_c - lat) / 2), 2) + cos(radians(lat)) * cos(radians(lat_c)) * power(sin(radians(lon_c - lon) / 2), 2)))), 2)) / sum(w)) AS spread FROM p JOIN c USING (key) GROUP BY key)
SELECT key, round(lat_c, 6) AS lat_c, round(lon_c, 6) AS lon_c, round(effective_nodes, 6) AS effective_nodes, round(kv_mean, 6) AS kv_mean, kv_at_max, round(spread, 4) AS spread_km FROM c JOIN s USING (key)"""))
def geo_centroid(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = projection.centroids(market.shift_factors(spark, sf_dir), market.geography(spark, sf_dir))
    rounded = [r6(n).alias(n) for n in ("lat_c", "lon_c", "effective_nodes", "kv_mean")]
    return c.select("key", *rounded, "kv_at_max", F.round("spread_km", 4).alias("spread_km"))


@query(with_sql("sf geo", """
, z AS (SELECT key, zone, sum(abs(sf)) AS w, avg(sf) AS net FROM sf JOIN geo USING (sp) GROUP BY 1, 2)
SELECT key, zone, round(w / sum(w) OVER (PARTITION BY key), 6) AS share, round(net, 6) + 0.0 AS net_mean FROM z"""))
def zone_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    shares = projection.zone_shares(market.shift_factors(spark, sf_dir), market.geography(spark, sf_dir))
    return shares.select("key", "zone", r6("share").alias("share"), r6("net_mean").alias("net_mean"))


@query(with_sql("sf", """
SELECT key, max(abs(sf)) AS max_abs_sf, CAST(count(*) FILTER (abs(sf) >= 0.3) AS BIGINT) AS n_rail, max(CASE WHEN abs(sf) < 0.3 THEN abs(sf) END) AS peak_offrail FROM sf GROUP BY key"""))
def rail_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return projection.rail_stats(market.shift_factors(spark, sf_dir), 0.3)


@query(with_sql("sf", """
, q AS (SELECT 'N' || CAST(place % 20 AS VARCHAR) || CASE WHEN place >= 40 THEN 'b' ELSE 'a' END AS sp, key, max(CASE WHEN place % 20 < 5 THEN CAST(vec_id AS FLOAT) ELSE CAST(sf AS FLOAT) END) AS v FROM sf GROUP BY 1, 2),
 g AS (SELECT sp, list(v ORDER BY key) AS sig FROM q GROUP BY sp)
SELECT min(sp) AS representative, count(*) AS n, string_agg(sp, ',' ORDER BY sp) AS members FROM g GROUP BY sig"""))
def essp_signature_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes with one and the same column; the first five places are given a column by key alone."""
    sf = market.shift_factors(spark, sf_dir)
    sp = F.concat(F.lit("N"), (F.col("place") % 20).cast("string"), F.when(F.col("place") >= 40, "b").otherwise("a"))
    value = F.when(F.col("place") % 20 < 5, F.col("vec_id").cast("double")).otherwise(F.col("sf"))
    columns = sf.groupBy(sp.alias("sp"), "key").agg(F.max(value).alias("sf"))
    return projection.signature_groups(columns).select(F.col("members")[0].alias("representative"), "n", F.array_join("members", ",").alias("members"))


@query(with_sql("mu sf geo", """
, m AS (SELECT key, sum(abs(mu)) AS w FROM mu GROUP BY 1), z AS (SELECT zone, key, sum(abs(sf)) AS s FROM sf JOIN geo USING (sp) GROUP BY 1, 2), t AS (SELECT key, sum(s) AS s FROM z GROUP BY 1)
SELECT zone, round(sum(w * z.s / t.s), 4) AS mass FROM z JOIN t USING (key) JOIN m USING (key) GROUP BY zone"""))
def zone_mass(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mass of each zone: shadow prices spread by the constraint's zone shares, held as a map."""
    shares = projection.zone_shares(market.shift_factors(spark, sf_dir), market.geography(spark, sf_dir))
    maps = shares.groupBy("key").agg(F.map_from_entries(F.collect_list(F.struct("zone", "share"))).alias("zone_shares"))
    mass = market.shadow_prices(spark, sf_dir).groupBy("key").agg(F.sum(F.abs("mu")).alias("w"))
    laid = maps.join(mass, "key").select("w", F.explode("zone_shares").alias("zone", "share"))
    return laid.groupBy("zone").agg(F.round(F.sum(F.col("w") * F.col("share")), 4).alias("mass"))


@query(with_sql("mu sf", """
, p AS (SELECT ts, sp, -sum(mu * sf) AS v FROM mu JOIN sf USING (key) GROUP BY 1, 2)
SELECT strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts, sp, round(sign(v) * least(greatest((abs(v) - 10) / 90, 0), 1), 6) + 0.0 AS congestion_position,
       round(CASE WHEN v <= -20 THEN 0 WHEN v < 0 THEN (v + 20) * 0.02 WHEN v < 50 THEN 0.4 + v * 0.012 ELSE 1 END, 6) + 0.0 AS lmp_position FROM p"""))
def colour_scales(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = projection.project(market.shadow_prices(spark, sf_dir), market.shift_factors(spark, sf_dir))
    lmp = fields.interpolate(F.col("point"), [(-20.0, 0.0), (0.0, 0.4), (50.0, 1.0)])
    return points.select(stamp("ts").alias("ts"), "sp", r6(fields.congestion_position(F.col("point"))).alias("congestion_position"), r6(lmp).alias("lmp_position"))


@query(with_sql("mu sf", """
, p AS (SELECT ts, sp, -sum(mu * sf) AS v FROM mu JOIN sf USING (key) GROUP BY 1, 2), n AS (SELECT sp, count(*) AS n, (SELECT count(DISTINCT ts) FROM mu) AS hours, sum(v) AS total FROM p GROUP BY sp)
SELECT sp, round(total, 4) AS total FROM n WHERE n = hours"""))
def settled_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals of the nodes that have a value in every hour."""
    points = projection.project(market.shadow_prices(spark, sf_dir), market.shift_factors(spark, sf_dir))
    hours = market.shadow_prices(spark, sf_dir).agg(F.count_distinct("ts").alias("hours"))
    sums = points.groupBy("sp").agg(F.count(F.lit(1)).alias("n"), F.sum("point").alias("total"))
    return sums.crossJoin(F.broadcast(hours)).where("n = hours").select("sp", F.round("total", 4).alias("total"))


@query(with_sql("mu", f"""
SELECT strftime(arg_max(ts, (mass, ts)), '%Y-%m-%d %H:%M:%S') AS cursor_ts, day FROM (SELECT ts, strftime(((ts AT TIME ZONE 'UTC') AT TIME ZONE 'America/Chicago'), '%Y-%m-%d') AS day, sum(abs(mu)) AS mass FROM mu GROUP BY 1, 2) GROUP BY day"""))
def peak_cursor(spark: SparkSession, sf_dir: str) -> DataFrame:
    hours = market.shadow_prices(spark, sf_dir).groupBy("ts").agg(F.sum(F.abs("mu")).alias("mass"))
    day = F.date_format(clock.delivery_date(F.col("ts")), "yyyy-MM-dd")
    return hours.groupBy(day.alias("day")).agg(stamp(F.max_by("ts", F.struct("mass", "ts"))).alias("cursor_ts"))
