"""Queries over studies: admission by windows of every length, ranks of residuals, bands drawn from them."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nodalis.operators import facets, prefixes, residuals
from nodalis.plans.registry import day_text, query, r6, stamp
from nodalis.sources import market
from nodalis.sources.market import with_sql


@query(with_sql("mu", """
, d AS (SELECT key, CAST(ts AS DATE) AS day, count(*) AS v FROM mu WHERE mu > 0 GROUP BY 1, 2),
 s AS (SELECT n, t, DATE '2024-01-08' + CAST(i AS INTEGER) AS refit FROM (VALUES (5), (10), (20)) AS a(n), (VALUES (1), (7)) AS b(t), (SELECT unnest(range(23)) AS i) WHERE i % t = 0),
 c AS (SELECT n, t, refit, key, sum(v) AS hours FROM s JOIN d ON day >= refit - n AND day < refit GROUP BY 1, 2, 3, 4 HAVING sum(v) >= 10)
SELECT n AS length, t AS step, strftime(refit, '%Y-%m-%d') AS refit, count(key) AS admitted, CAST(coalesce(sum(hours), 0) AS BIGINT) AS hours FROM s LEFT JOIN c USING (n, t, refit) GROUP BY 1, 2, 3"""))
def admission_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys admitted for windows of 5, 10 and 20 days, refitted daily and weekly."""
    mu = market.shadow_prices(spark, sf_dir).where("mu > 0")
    days = mu.groupBy("key", F.to_date("ts").alias("day")).agg(F.count(F.lit(1)).alias("v"))
    got = prefixes.admission_grid(days, date(2024, 1, 8), date(2024, 1, 31), [5, 10, 20], [1, 7], 10)
    return got.select("length", "step", day_text("refit").alias("refit"), "admitted", "hours")


def _persistence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(ts, key, y_bind, y_mu, mu_gbm): every hour that bound, with the day before's value as its prediction."""
    mu = market.shadow_prices(spark, sf_dir).select("ts", "key", "mu")
    before = mu.select(F.timestamp_add("DAY", F.lit(1), F.col("ts")).alias("ts"), "key", F.col("mu").alias("mu_gbm"))
    return mu.where("mu > 0").join(before, ["ts", "key"]).select("ts", "key", F.lit(1).alias("y_bind"), F.col("mu").alias("y_mu"), "mu_gbm")


@query(with_sql("mu", """
, e AS (SELECT m.ts, m.key, round(ln(1 + m.mu) - ln(1 + greatest(p.mu, 0)), 9) + 0.0 AS eps FROM mu AS m JOIN mu AS p ON p.key = m.key AND p.ts = m.ts - INTERVAL 1 DAY WHERE m.mu > 0)
SELECT strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts, key, round(eps, 6) AS eps, row_number() OVER (ORDER BY eps, ts, key) - 1 AS rank FROM e"""))
def residual_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pool of persistence errors, ranked."""
    rows = residuals.pool(_persistence(spark, sf_dir)).withColumn("eps", F.round("eps", 9) + F.lit(0.0))
    return residuals.ranked(rows, "eps", ["ts", "key"]).select(stamp("ts").alias("ts"), "key", r6("eps").alias("eps"), "rank")


@query()
def residual_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bands of 20 draws around persistence for every hour and node, with errors drawn from the pool."""
    rows = residuals.pool(_persistence(spark, sf_dir))
    ranks = residuals.ranked(rows.select("ts", "key", "eps"), "eps", ["ts", "key"]).select("rank", "eps")
    predictions = rows.select("ts", "key", F.lit(0.8).alias("p_bind"), "mu_gbm")
    points = residuals.draws(predictions, market.shift_factors(spark, sf_dir), ranks, 20)
    bands = points.groupBy("ts", "sp").agg(F.percentile("point", [0.1, 0.5, 0.9]).alias("p"))
    return bands.select(stamp("ts").alias("ts"), "sp", r6(F.col("p")[0]).alias("p10"), r6(F.col("p")[1]).alias("p50"), r6(F.col("p")[2]).alias("p90"))


@query(with_sql("mu", """
, i AS (SELECT key, split_part(key, '|', 2) AS ctype, CASE WHEN vec_id % 7 < 6 THEN 'Z' || CAST(vec_id % 7 AS VARCHAR) END AS zone, CASE WHEN sum(mu) >= 2000 THEN 'large' WHEN sum(mu) >= 500 THEN 'middle' ELSE 'small' END AS size FROM mu GROUP BY key, vec_id),
 s AS (SELECT * FROM i WHERE lower(key || ' ' || ctype) LIKE '%1%')
SELECT 'ctype' AS facet, ctype AS value, count(*) AS n, ctype = 'N1' AS chosen FROM s WHERE zone IN ('Z1', 'Z2', 'Z4') GROUP BY ctype
UNION ALL SELECT 'zone', zone, count(*), zone IN ('Z1', 'Z2', 'Z4') FROM s WHERE ctype = 'N1' AND zone IS NOT NULL GROUP BY zone
UNION ALL SELECT 'size', size, count(*), FALSE FROM s WHERE ctype = 'N1' AND zone IN ('Z1', 'Z2', 'Z4') GROUP BY size"""))
def matrix_facets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the facets of constraints offer under a choice of type and zones and a search."""
    mu, zone = market.shadow_prices(spark, sf_dir), F.col("vec_id") % 7
    total = F.sum("mu")
    items = mu.groupBy("key", "vec_id").agg(F.when(total >= 2000, "large").when(total >= 500, "middle").otherwise("small").alias("size"))
    items = items.select("key", F.substring_index("key", "|", -1).alias("ctype"), F.when(zone < 6, F.concat(F.lit("Z"), zone.cast("string"))).alias("zone"), "size")
    return facets.counts(items, ["ctype", "zone", "size"], {"ctype": ["N1"], "zone": ["Z1", "Z2", "Z4"]}, " 1", ["key", "ctype"])
