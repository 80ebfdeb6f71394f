"""Queries around runs: provenance, absent nodes, selections led by nodes, studies of arms and draws."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nodalis.operators import runs, views
from nodalis.plans.registry import day_text, query, r6, stamp
from nodalis.sources import market
from nodalis.sources.market import with_sql


@query("""
WITH p AS (SELECT DISTINCT CAST(l_shipdate AS DATE) AS day, l_suppkey AS sp FROM lineitem WHERE l_returnflag = 'A'), a AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS day, o_custkey % 120 + 1 AS sp FROM orders),
d AS (SELECT DISTINCT day FROM p)
SELECT strftime(a.day, '%Y-%m-%d') AS day, a.sp, CASE WHEN p.sp IS NOT NULL THEN NULL WHEN d.day IS NOT NULL THEN 'sp_not_in_service' ELSE 'sp_not_in_fit' END AS reason
FROM a LEFT JOIN p ON a.day = p.day AND a.sp = p.sp LEFT JOIN d ON a.day = d.day""")
def absent_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = market.table(spark, sf_dir, "lineitem").where("l_returnflag = 'A'").select(F.to_date("l_shipdate").alias("day"), F.col("l_suppkey").alias("sp"))
    asked = market.table(spark, sf_dir, "orders").select(F.to_date("o_orderdate").alias("day"), (F.col("o_custkey") % 120 + 1).alias("sp"))
    return runs.absent_reason(asked, points).select(day_text("day").alias("day"), "sp", "reason")


_PROVENANCE = """
WITH q AS (SELECT DISTINCT o_orderstatus AS run_id, CAST(o_orderdate AS DATE) AS day FROM orders),
a AS (SELECT o_orderstatus AS run_id, CAST(o_orderdate AS DATE) AS day, CASE WHEN min(o_orderkey) % 3 = 0 THEN 'old' END AS m, CAST(o_orderdate AS DATE) - 400 AS s, CAST(o_orderdate AS DATE) - 40 AS e FROM orders WHERE o_orderpriority = '1-URGENT' GROUP BY 1, CAST(o_orderdate AS DATE)),
w AS (SELECT 'map' AS run_id, CAST(date_trunc('month', o_orderdate) AS DATE) - 240 AS window_start, CAST(date_trunc('month', o_orderdate) AS DATE) AS window_end, round(avg(o_totalprice), 6) AS r2 FROM orders GROUP BY 1, 2, 3),
x AS (SELECT q.run_id, q.day, a.day AS artifact_day, a.m, a.s, a.e FROM q ASOF LEFT JOIN a ON q.run_id = a.run_id AND q.day >= a.day),
y AS (SELECT x.*, w.run_id AS wr, w.window_start AS ws, w.window_end AS we FROM x ASOF LEFT JOIN w ON x.artifact_day >= w.window_end),
z AS (SELECT run_id, day, artifact_day, CASE WHEN artifact_day = day THEN 'artifact' WHEN artifact_day IS NOT NULL THEN 'nearest_past' END AS basis, coalesce(m, wr) AS map_run_id,
  CASE WHEN m IS NOT NULL THEN s ELSE ws END AS window_start, CASE WHEN m IS NOT NULL THEN e ELSE we END AS window_end FROM y)
SELECT z.run_id, strftime(day, '%Y-%m-%d') AS day, strftime(artifact_day, '%Y-%m-%d') AS artifact_day, basis, z.map_run_id, strftime(z.window_start, '%Y-%m-%d') AS window_start, strftime(z.window_end, '%Y-%m-%d') AS window_end, w.r2, w.r2 IS NOT NULL AS available
FROM z LEFT JOIN w ON z.map_run_id = w.run_id AND z.window_start = w.window_start"""


@query(_PROVENANCE)
def artifact_provenance(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = market.table(spark, sf_dir, "orders").select(F.col("o_orderstatus").alias("run_id"), F.to_date("o_orderdate").alias("day"), "o_orderpriority", "o_orderkey", "o_totalprice")
    found = orders.where("o_orderpriority = '1-URGENT'").groupBy("run_id", "day").agg(F.when(F.min("o_orderkey") % 3 == 0, "old").alias("map_run_id"))
    artifacts = found.withColumn("window_start", F.date_sub("day", 400)).withColumn("window_end", F.date_sub("day", 40))
    ends = orders.groupBy(F.trunc("day", "month").alias("window_end")).agg(r6(F.avg("o_totalprice")).alias("r2"))
    windows = ends.select(F.lit("map").alias("run_id"), F.date_sub("window_end", 240).alias("window_start"), "window_end", "r2")
    got = runs.fit_metadata(runs.provenance(orders.select("run_id", "day").distinct(), artifacts, windows), windows, ["r2"])
    days = (day_text(c).alias(c) for c in ("day", "artifact_day", "window_start", "window_end"))
    return got.select("run_id", *days, "basis", "map_run_id", "r2", "available")


@query(with_sql("mu sf", """
, m AS (SELECT key, sum(abs(mu)) AS size FROM mu WHERE key IN (SELECT key FROM sf) GROUP BY 1), t AS (SELECT key FROM m ORDER BY size DESC, key LIMIT 1),
 s AS (SELECT sp, max(CASE WHEN key = (SELECT key FROM t) THEN abs(sf) ELSE 0 END) AS score FROM sf GROUP BY 1), r AS (SELECT *, row_number() OVER (ORDER BY score DESC, sp) AS rank FROM s),
 f AS (SELECT sp FROM r WHERE lower(sp) LIKE '%1%' ORDER BY rank LIMIT 20), b AS (SELECT *, rank <= 30 AND sp IN (SELECT sp FROM f) AS base, sp IN (SELECT sp FROM f) AS found, CASE sp WHEN 'N7' THEN 1 WHEN 'N1' THEN 2 ELSE 0 END AS pin FROM r),
 c AS (SELECT *, row_number() OVER (PARTITION BY base ORDER BY rank) AS turn, greatest(15 - count(*) FILTER (NOT base) OVER (), 1) AS room FROM b WHERE base OR found OR pin > 0),
 d AS (SELECT *, CASE WHEN base AND turn <= room THEN 0 WHEN pin > 0 THEN 1 WHEN found THEN 2 END AS part FROM c),
 e AS (SELECT sp, score, row_number() OVER (ORDER BY part, CASE WHEN part = 1 THEN pin ELSE rank END) AS place FROM d WHERE part IS NOT NULL)
SELECT sp, CAST(place AS INTEGER) AS place, round(score, 6) AS score FROM e WHERE place <= 15"""))
def nodes_major(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = runs.nodes_major(market.shift_factors(spark, sf_dir), market.shadow_prices(spark, sf_dir), 30, 15, (), ("N7", "N1"), "1")
    return got.select("sp", "place", r6("score").alias("score"))


@query("""
SELECT l_suppkey AS sp, round(avg(l_extendedprice), 6) AS mean, round(quantile_cont(l_extendedprice, 0.5), 6) AS p50, round(quantile_cont(l_extendedprice, 0.75), 6) AS p75, round(quantile_cont(l_extendedprice, 0.9), 6) AS p90,
  round(quantile_cont(l_extendedprice, 0.95), 6) AS p95, round(quantile_cont(l_extendedprice, 0.99), 6) AS p99 FROM lineitem GROUP BY 1""")
def rank_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = runs.rank_stats(market.table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("sp"), F.col("l_extendedprice").alias("v")), ["sp"], "v")
    return got.select("sp", *(r6(c).alias(c) for c in got.columns if c != "sp"))


@query("""
WITH a AS (SELECT CASE WHEN o_orderpriority LIKE '1%' THEN 'ungrouped' ELSE o_orderpriority END AS rho_min, avg(o_totalprice / 1e5) AS stability, avg(o_totalprice % 1000 / 1000) AS control, avg(o_totalprice / 1e6) AS r2, avg(CAST(o_custkey % 7 AS DOUBLE)) AS g, avg(CAST(o_custkey % 100 AS DOUBLE)) AS c, avg(o_orderkey % 10 / 10.0) AS sign FROM orders GROUP BY 1),
b AS (SELECT * FROM a WHERE rho_min = 'ungrouped')
SELECT a.rho_min, round(a.c / greatest(a.g, 1), 6) AS compression, round(a.stability - a.control, 6) AS delta, round(a.r2 - b.r2, 6) AS d_r2, round(a.sign - b.sign, 6) AS d_sign, a.stability - a.control >= 0.1 AS pass_stability, a.r2 - b.r2 >= -0.01 AND a.sign - b.sign >= -0.01 AS pass_guard
FROM a, b WHERE a.rho_min <> 'ungrouped'""")
def grouping_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    price = F.col("o_totalprice").cast("double")
    weekly = market.table(spark, sf_dir, "orders").select(
        F.when(F.col("o_orderpriority").startswith("1"), "ungrouped").otherwise(F.col("o_orderpriority")).alias("rho_min"), (price / 1e5).alias("stability"), (price % 1000 / 1000).alias("control"),
        (price / 1e6).alias("r2"), (F.col("o_custkey") % 7).cast("double").alias("groups"), (F.col("o_custkey") % 100).cast("double").alias("constraints"), (F.col("o_orderkey") % 10 / 10).alias("sign"),
    )
    got = runs.grouping_verdict(weekly, ["sign"])
    return got.select("rho_min", *(r6(c).alias(c) for c in ("compression", "delta", "d_r2", "d_sign")), "pass_stability", "pass_guard")


@query(with_sql("mu", """
SELECT strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts, key, CASE WHEN stddev_pop(mu) OVER w > 0 THEN round((mu - avg(mu) OVER w) / stddev_pop(mu) OVER w, 5) + 0.0 END AS z FROM mu WINDOW w AS (PARTITION BY key)"""))
def population_zscore(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = runs.zscore(market.shadow_prices(spark, sf_dir), ["key"], "mu")
    return got.select(stamp("ts").alias("ts"), "key", (F.round("z", 5) + 0.0).alias("z"))


@query(with_sql("vintage", """
SELECT zone, CAST(sum(CAST(mw AS DECIMAL(18,2))) AS DOUBLE) AS total, CAST(sum(CASE WHEN ts >= posted + INTERVAL 60 DAY THEN CAST(mw AS DECIMAL(18,2)) ELSE 0 END) AS DOUBLE) AS still,
  round(CAST(sum(CASE WHEN ts >= posted + INTERVAL 60 DAY THEN CAST(mw AS DECIMAL(18,2)) ELSE 0 END) AS DOUBLE) / CAST(sum(CAST(mw AS DECIMAL(18,2))) AS DOUBLE), 6) AS share FROM vintage GROUP BY 1"""))
def outage_persistence(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = market.vintages(spark, sf_dir).select("zone", "posted", F.col("ts").alias("ends"), F.col("mw").cast(market.CENTS).alias("mw"))
    got = runs.persistence_share(rows, ["zone"], 60)
    total, still = F.col("total").cast("double"), F.col("still").cast("double")
    return got.select("zone", total.alias("total"), still.alias("still"), r6(still / total).alias("share"))


@query("""
WITH m AS (SELECT o_orderpriority AS arm, avg(o_totalprice) AS mean FROM orders GROUP BY 1)
SELECT arm, round(mean, 4) AS mean, round(mean - (SELECT mean FROM m WHERE arm = '3-MEDIUM'), 4) + 0.0 AS delta FROM m""")
def arm_deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = market.table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("arm"), F.col("o_totalprice").cast("double").alias("v"))
    got = runs.arm_deltas(rows, "arm", "v", "3-MEDIUM")
    return got.select("arm", F.round("mean", 4).alias("mean"), (F.round("delta", 4) + 0.0).alias("delta"))


@query(with_sql("mu sf", """
, o AS (SELECT DATE '2024-01-01' + CAST(day(l_shipdate) - 1 AS INTEGER) AS day, 'N' || CAST(l_suppkey % 64 AS VARCHAR) AS sp, sum(CAST(l_quantity AS BIGINT)) AS mw FROM lineitem GROUP BY 1, 2),
 e AS (SELECT day, key, round(sum(abs(sf) * mw), 4) AS exposure FROM o JOIN sf USING (sp) GROUP BY 1, 2), d AS (SELECT CAST(ts AS DATE) AS day, key, round(sum(abs(mu)), 4) AS size FROM mu GROUP BY 1, 2),
 j AS (SELECT e.day, exposure, coalesce(size, 0) AS size FROM e LEFT JOIN d ON e.day = d.day AND e.key = d.key),
 r AS (SELECT day, rank() OVER (PARTITION BY day ORDER BY exposure) + (count(*) OVER (PARTITION BY day, exposure) - 1) / 2.0 AS a, rank() OVER (PARTITION BY day ORDER BY size) + (count(*) OVER (PARTITION BY day, size) - 1) / 2.0 AS b FROM j)
SELECT strftime(day, '%Y-%m-%d') AS day, count(*) AS n, round(corr(a, b), 6) AS spearman FROM r GROUP BY day HAVING count(*) >= 10 AND max(a) > min(a) AND max(b) > min(b)"""))
def outage_signal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outages stand on the panel's days by their day of the month."""
    day = F.date_add(F.to_date(F.lit("2024-01-01")), F.dayofmonth("l_shipdate") - 1)
    outages = market.table(spark, sf_dir, "lineitem").select(day.alias("day"), F.concat(F.lit("N"), (F.col("l_suppkey") % 64).cast("string")).alias("sp"), F.col("l_quantity").alias("mw"))
    exposed = views.exposure(market.shift_factors(spark, sf_dir), outages).withColumn("exposure", F.round("exposure", 4))
    sizes = market.shadow_prices(spark, sf_dir).groupBy(F.to_date("ts").alias("day"), "key").agg(F.round(F.sum(F.abs("mu")), 4).alias("size"))
    return runs.outage_signal(exposed, sizes).select(day_text("day").alias("day"), "n", r6("spearman").alias("spearman"))


@query("""
WITH s AS (SELECT o_orderpriority AS source, sum(CASE WHEN o_orderstatus = 'F' THEN CAST(o_totalprice AS DECIMAL(18,2)) END) AS won, count(*) AS n, count(*) FILTER (o_orderstatus = 'F') AS k FROM orders GROUP BY 1)
SELECT 'weekly' AS run_id, CAST(substr(source, 1, 1) AS BIGINT) AS source_id, CASE WHEN k > 0 AND source <> '5-LOW' THEN round(CAST(won AS DOUBLE) / k, 4) END AS score, n FROM s""")
def weekly_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = market.table(spark, sf_dir, "orders").withColumnRenamed("o_orderpriority", "source")
    closed = F.col("o_orderstatus") == "F"
    won, k = F.sum(F.when(closed, F.col("o_totalprice").cast(market.CENTS))).cast("double"), F.count_if(closed)
    score = F.when((k > 0) & (F.col("source") != "5-LOW"), F.round(won / k, 4)).otherwise(F.lit(float("nan")))
    scores = orders.groupBy("source").agg(score.alias("score"), F.count(F.lit(1)).cast("double").alias("n"))
    ids = orders.select("source", F.substring("source", 1, 1).cast("long").alias("source_id")).distinct()
    return runs.weekly_rows(scores, ids, ("n",), "weekly")
