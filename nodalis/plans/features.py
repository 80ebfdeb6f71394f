"""Queries over the design matrix and out-of-sample evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nodalis.functions import clock
from nodalis.operators import evaluation, features, models, projection
from nodalis.plans.models import _planted, _windows
from nodalis.plans.registry import day_text, query, r6, stamp
from nodalis.sources import market
from nodalis.sources.market import with_sql

CT = "((ts AT TIME ZONE 'UTC') AT TIME ZONE 'America/Chicago')"


@query(with_sql("mu", f"""
, h AS (SELECT DISTINCT ts, CAST({CT} AS DATE) AS day FROM mu), k AS (SELECT DISTINCT key FROM mu)
SELECT strftime(h.ts, '%Y-%m-%d %H:%M:%S') AS ts, k.key, CASE WHEN coalesce(abs(m.mu), 0) > 20 THEN 1 ELSE 0 END AS y_bind, CASE WHEN abs(m.mu) > 20 THEN m.mu END AS y_mu
FROM h CROSS JOIN k LEFT JOIN mu AS m ON m.ts = h.ts AND m.key = k.key"""))
def design_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mu = market.shadow_prices(spark, sf_dir)
    hours = mu.select("ts").distinct()
    days = hours.select(clock.delivery_date(F.col("ts")).alias("day")).distinct()
    keys = mu.select("key").distinct().crossJoin(F.broadcast(days))
    system = hours.select("ts", F.hour("ts").alias("hour"))
    return features.design(hours, keys, system, mu, 20.0).select(stamp("ts").alias("ts"), "key", "y_bind", "y_mu")


@query("""
WITH r AS (SELECT o_orderdate AS posted, l_shipdate AS ts FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
s AS (SELECT date_diff('second', posted, ((CAST(CAST(((ts AT TIME ZONE 'UTC') AT TIME ZONE 'America/Chicago') AS DATE) - 1 AS TIMESTAMP) + INTERVAL 10 HOUR) AT TIME ZONE 'America/Chicago') AT TIME ZONE 'UTC') / 3600.0 AS s FROM r)
SELECT round(min(s), 6) AS min_slack, round(median(s), 6) AS median_slack, CAST(count(*) FILTER (s < 0) AS BIGINT) AS n_leaks FROM s""")
def leakage_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = features.audit_leakage(market.vintages(spark, sf_dir))
    return got.select(r6("min_slack").alias("min_slack"), r6("median_slack").alias("median_slack"), "n_leaks")


@query("""
WITH r AS (SELECT CAST(l_shipdate AS DATE) AS day, l_linenumber AS ordinal, 'S' || CAST(l_suppkey % 5 AS VARCHAR) AS key, sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS v FROM lineitem WHERE l_shipdate >= TIMESTAMP '1996-05-01' AND l_shipdate < TIMESTAMP '1996-05-31' GROUP BY 1, 2, 3),
u AS (SELECT DISTINCT key, ordinal FROM r)
SELECT u.key, u.ordinal, round(CASE WHEN (SELECT count(DISTINCT day) FROM r) = 30 THEN CAST(coalesce(sum(v), 0) AS DOUBLE) / 30 END, 6) AS mean FROM u LEFT JOIN r ON r.key = u.key AND r.ordinal = u.ordinal GROUP BY 1, 2""")
def trailing_average(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = market.table(spark, sf_dir, "lineitem").where("l_shipdate >= '1996-05-01' AND l_shipdate < '1996-05-31'")
    v = F.sum(F.col("l_extendedprice").cast(market.CENTS)).cast("double")
    days = rows.groupBy(F.to_date("l_shipdate").alias("day"), F.col("l_linenumber").alias("ordinal"), F.concat(F.lit("S"), (F.col("l_suppkey") % 5).cast("string")).alias("key")).agg(v.alias("v"))
    got = features.trailing_average(days, days.select("key", "ordinal").distinct(), 30)
    return got.select("key", "ordinal", r6("mean").alias("mean"))


@query("""
WITH r AS (SELECT DISTINCT h AS ts, 'N' || CAST(s_suppkey % 40 AS VARCHAR) AS sp, CASE WHEN s_suppkey % 40 % 7 = 0 THEN h * (s_suppkey % 40) ELSE (s_suppkey % 40) // 4 END AS grp FROM supplier, (SELECT unnest(range(6)) AS h)),
s AS (SELECT sp, string_agg(CAST(ts AS VARCHAR) || ':' || CAST(grp AS VARCHAR), ',' ORDER BY ts) AS sig, count(*) AS n FROM r GROUP BY 1)
SELECT min(sp) AS representative, string_agg(sp, ',' ORDER BY sp) AS members, count(*) AS n FROM s WHERE n = 6 GROUP BY sig HAVING count(*) > 1""")
def study_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    place = F.col("s_suppkey") % 40
    rows = market.table(spark, sf_dir, "supplier").withColumn("ts", F.explode(F.sequence(F.lit(0), F.lit(5)))).select(
        "ts", F.concat(F.lit("N"), place.cast("string")).alias("sp"), F.when(place % 7 == 0, F.col("ts") * place).otherwise(F.floor(place / 4)).alias("grp")).distinct()
    return features.essp_study_groups(rows).select("representative", F.array_join("members", ",").alias("members"), "n")


@query("""
WITH r AS (SELECT CAST(o_custkey % 40 AS VARCHAR) AS key, CASE WHEN o_orderpriority LIKE '1%' THEN NULL ELSE substr(o_orderpriority, 3) END AS a, o_orderstatus AS b, CAST(o_totalprice AS DECIMAL(18,2)) - 100000 AS mu FROM orders),
m AS (SELECT key, a AS from_station, b AS to_station, CAST(sum(greatest(mu, 0)) AS DOUBLE) AS mass FROM r GROUP BY 1, 2, 3)
SELECT key, from_station, to_station, round(mass, 2) AS mass, round(mass / nullif(sum(mass) OVER (PARTITION BY key), 0), 6) AS share FROM m""")
def station_mass(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = market.table(spark, sf_dir, "orders").select(
        (F.col("o_custkey") % 40).cast("string").alias("key"), F.when(F.col("o_orderpriority").startswith("1"), "  ").otherwise(F.expr("substr(o_orderpriority, 3)")).alias("from_station"), F.col("o_orderstatus").alias("to_station"),
        (F.col("o_totalprice").cast(market.CENTS) - 100000).cast("double").alias("mu"))
    return features.station_mass(rows).select("key", "from_station", "to_station", F.round("mass", 2).alias("mass"), r6("share").alias("share"))


@query(with_sql("sf geo", """
, p AS (SELECT key, abs(sf) AS w, lon AS x, lat AS y FROM sf JOIN geo USING (sp)),
 s AS (SELECT key, sum(w) AS w, sum(w * x) / sum(w) AS mx, sum(w * y) / sum(w) AS my, sum(w * x * x) AS xx, sum(w * y * y) AS yy, sum(w * x * y) AS xy FROM p GROUP BY 1),
 c AS (SELECT key, xx / w - mx * mx AS a, yy / w - my * my AS b, xy / w - mx * my AS c FROM s)
SELECT key, round(atan2(2 * c, a - b) / 2, 4) + 0.0 AS angle, round(sqrt(greatest((a + b) / 2 + sqrt(power((a - b) / 2, 2) + c * c), 0)), 4) AS half_span FROM c"""))
def principal_axis(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = market.shift_factors(spark, sf_dir).join(market.geography(spark, sf_dir), "sp").select("key", F.abs("sf").alias("w"), F.col("lon").alias("x"), F.col("lat").alias("y"))
    return features.principal_axis(rows).select("key", F.round("angle", 4).alias("angle"), F.round("half_span", 4).alias("half_span"))


@query(with_sql("mu", """
, s AS (SELECT key, mu FROM mu WHERE ts = TIMESTAMP '2024-01-10 12:00:00'), f AS (SELECT key, avg(mu) AS mu FROM mu WHERE ts >= TIMESTAMP '2024-01-03' AND ts < TIMESTAMP '2024-01-10' GROUP BY 1)
SELECT key, round(abs(coalesce(s.mu, f.mu)), 6) AS mu, s.mu IS NOT NULL AS settled FROM s FULL JOIN f USING (key)"""))
def cursor_mu(spark: SparkSession, sf_dir: str) -> DataFrame:
    mu = market.shadow_prices(spark, sf_dir)
    forecast = mu.where("ts >= '2024-01-03' AND ts < '2024-01-10'").groupBy("key").agg(F.avg("mu").alias("mu"))
    return features.cursor_mu(mu.where("ts = '2024-01-10 12:00:00'"), forecast).select("key", r6("mu").alias("mu"), "settled")


@query(with_sql("mu sf", f"""
, p AS (SELECT sp, place % 8 AS family, -sum(mu * sf) AS v FROM mu JOIN sf USING (key) WHERE hour({CT}) BETWEEN 15 AND 18 GROUP BY ts, sp, place), m AS (SELECT family, sp, avg(v) AS m FROM p GROUP BY 1, 2)
SELECT family, arg_max(sp, (m, sp)) AS high, round(max(m), 6) AS high_mean, arg_min(sp, (m, sp)) AS low, round(min(m), 6) AS low_mean FROM m GROUP BY 1 HAVING max(m) >= 0.5 AND min(m) <= -0.5"""))
def benchmark_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    mu = market.shadow_prices(spark, sf_dir).where(clock.local_hour(F.col("ts")).between(15, 18))
    points = projection.project(mu, market.shift_factors(spark, sf_dir)).withColumn("family", F.substring("sp", 2, 3).cast("long") % 8)
    got = features.benchmark_split(points, 0.5)
    return got.select("family", "high", r6("high_mean").alias("high_mean"), "low", r6("low_mean").alias("low_mean"))


@query()
def map_evaluation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each 14-day map on the week after it: fit and coverage out of sample."""
    mu, _, cong = _planted(spark, sf_dir)
    maps = models.rolling_ridge(mu, cong, _windows(spark), ridge=0.1, min_hours=10, std_floor=1.0)
    got = evaluation.score_windows(maps, mu, cong, 14, 7)
    return got.select(day_text("window_start").alias("window_start"), r6("r2").alias("r2"), r6("coverage").alias("coverage"))


@query(with_sql("mu sf", """
, s AS (SELECT 'oracle' AS source, ts, key, mu FROM mu UNION ALL SELECT 'persistence', ts + INTERVAL 1 DAY, key, mu FROM mu UNION ALL SELECT 'null', ts, key, 0.0 FROM mu),
 y AS (SELECT ts, sp, -sum(mu * sf) AS y FROM mu JOIN sf USING (key) GROUP BY 1, 2), h AS (SELECT source, ts, sp, -sum(mu * sf) AS y_hat FROM s JOIN sf USING (key) GROUP BY 1, 2, 3),
 g AS (SELECT n.source, y.ts, y.sp, y, coalesce(y_hat, 0) AS y_hat FROM y CROSS JOIN (SELECT DISTINCT source FROM s) AS n LEFT JOIN h ON h.source = n.source AND h.ts = y.ts AND h.sp = y.sp),
 r AS (SELECT source, ts, y_hat, count(*) OVER t AS n, rank() OVER (PARTITION BY source, ts ORDER BY y) + (count(*) OVER (PARTITION BY source, ts, y) - 1) / 2.0 AS ry, rank() OVER (PARTITION BY source, ts ORDER BY y_hat) + (count(*) OVER (PARTITION BY source, ts, y_hat) - 1) / 2.0 AS rh,
  row_number() OVER (PARTITION BY source, ts ORDER BY y DESC, sp) AS a, row_number() OVER (PARTITION BY source, ts ORDER BY y_hat DESC, sp) AS b FROM g WINDOW t AS (PARTITION BY source, ts)),
 hours AS (SELECT source, ts, CASE WHEN max(n) >= 10 THEN corr(ry, rh) END AS spearman, CASE WHEN max(n) >= 20 THEN count(*) FILTER (a <= greatest(1, n // 10) AND b <= greatest(1, n // 10)) / CAST(greatest(1, max(n) // 10) AS DOUBLE) END AS hit FROM r GROUP BY 1, 2 HAVING max(y_hat) > min(y_hat) AND max(ry) > min(ry)),
 signs AS (SELECT source, avg(CASE WHEN sign(y) = sign(y_hat) THEN 1.0 ELSE 0.0 END) AS sign_agree FROM g WHERE abs(y) > 1 GROUP BY 1)
SELECT signs.source, round(avg(spearman), 6) AS spearman, round(avg(hit), 6) AS topdecile, round(max(sign_agree), 6) AS sign_agree, count(ts) AS n_hours FROM signs LEFT JOIN hours ON hours.source = signs.source GROUP BY 1"""))
def source_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Oracle, persistence and null shadow prices through one map."""
    mu, sf, cong = _planted(spark, sf_dir)
    truth = cong.select("ts", "sp", F.col("c").alias("y"))
    before = mu.withColumn("ts", F.col("ts") + F.expr("INTERVAL 1 DAY"))
    nothing = mu.withColumn("mu", F.lit(0.0))
    got = evaluation.source_scores(truth, {"oracle": mu, "persistence": before, "null": nothing}, sf)
    return got.select("source", *(r6(c).alias(c) for c in ("spearman", "topdecile", "sign_agree")), "n_hours")
