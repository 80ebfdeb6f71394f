"""Queries over scans, vintages, clocks and set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from nodalis.functions import clock, fields
from nodalis.operators import panels
from nodalis.plans.registry import day_text, query, r6, stamp
from nodalis.sources import market
from nodalis.sources.market import with_sql


@query(with_sql("spp lam cong", """
SELECT sp, count(*) AS n_ts, round(avg(c), 6) AS mean_c, round(max(c), 6) AS max_c, round(min(c), 6) AS min_c,
       row_number() OVER (ORDER BY round(avg(c), 6) DESC, sp) AS rank
FROM cong GROUP BY sp ORDER BY rank LIMIT 20"""))
def realized_congestion(spark: SparkSession, sf_dir: str) -> DataFrame:
    cong = panels.congestion_of(market.price_sums(spark, sf_dir), "money", "volume")
    by_node = cong.groupBy("sp").agg(F.count(F.lit(1)).alias("n_ts"), r6(F.avg("c")).alias("mean_c"), r6(F.max("c")).alias("max_c"), r6(F.min("c")).alias("min_c"))
    top = by_node.orderBy(F.desc("mean_c"), "sp").limit(20)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("mean_c"), "sp")).cast("long"))


@query(with_sql("spp lam cong", """
SELECT strftime(s.ts, '%Y-%m-%d %H:%M:%S') AS ts, s.sp, CAST(round(CAST(CAST(s.price AS VARCHAR) AS DECIMAL(38,18)), 2) AS DOUBLE) AS lmp, CAST(round(CAST(CAST(s.price - l.slam AS VARCHAR) AS DECIMAL(38,18)), 2) AS DOUBLE) AS congestion
FROM spp1 AS s LEFT JOIN lam1 AS l USING (ts) WHERE s.ts BETWEEN TIMESTAMP '1996-01-01' AND TIMESTAMP '1996-01-14'"""))
def realized_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = panels.realized_range(market.prices(spark, sf_dir), market.system_lambda(spark, sf_dir), "1996-01-01", "1996-01-14")
    return rows.withColumn("ts", stamp("ts"))


@query(with_sql("mu spp lam", """
SELECT strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS first_ts, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS last_ts, count(*) AS n_ts
FROM (SELECT ts FROM mu UNION (SELECT ts FROM lam INTERSECT SELECT ts FROM spp))"""))
def panel_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    bounds = panels.panel_bounds(market.shadow_prices(spark, sf_dir), market.system_lambda(spark, sf_dir), market.prices(spark, sf_dir))
    return bounds.select(stamp("first_ts").alias("first_ts"), stamp("last_ts").alias("last_ts"), "n_ts")


@query(with_sql("vintage", """
SELECT strftime(ts, '%Y-%m-%d') AS ts, zone, arg_max(mw, (posted, doc, line, mw)) AS mw, strftime(max(posted), '%Y-%m-%d') AS posted, count(*) AS n_known
FROM vintage WHERE posted <= ts - INTERVAL 14 HOUR GROUP BY 1, 2"""))
def vintage_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = market.vintages(spark, sf_dir)
    cutoff = F.col("ts") - F.expr("INTERVAL 14 HOURS")
    newest = panels.latest_vintage(rows, ["ts", "zone"], "posted", cutoff, ["doc", "line", "mw"], count="n_known")
    return newest.select(day_text("ts").alias("ts"), "zone", "mw", day_text("posted").alias("posted"), "n_known")


@query(with_sql("vintage", """
SELECT strftime(ts, '%Y-%m-%d') AS ts, zone, arg_max(mw, (posted, doc, line, mw)) AS mw
FROM vintage WHERE posted <= least(ts - INTERVAL 1 DAY, TIMESTAMP '1997-06-30') GROUP BY 1, 2"""))
def asof_cutoff_least(spark: SparkSession, sf_dir: str) -> DataFrame:
    cutoff = F.least(F.col("ts") - F.expr("INTERVAL 1 DAY"), F.to_timestamp(F.lit("1997-06-30")))
    newest = panels.latest_vintage(market.vintages(spark, sf_dir), ["ts", "zone"], "posted", cutoff, ["doc", "line", "mw"])
    return newest.select(day_text("ts").alias("ts"), "zone", "mw")


@query(with_sql("vintage", """
, probe AS (SELECT DISTINCT ts, zone FROM vintage),
 posts AS (SELECT posted, zone, arg_max(mw, (doc, line, mw)) AS mw FROM vintage GROUP BY 1, 2)
SELECT strftime(p.ts, '%Y-%m-%d') AS ts, p.zone, o.mw, strftime(o.posted, '%Y-%m-%d') AS posted
FROM probe AS p ASOF LEFT JOIN posts AS o ON p.zone = o.zone AND p.ts >= o.posted"""))
def asof_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = market.vintages(spark, sf_dir)
    probe = rows.select("ts", "zone").distinct()
    posts = rows.groupBy("posted", "zone").agg(F.max_by("mw", F.struct("doc", "line", "mw")).alias("mw"))
    joined = panels.as_of(probe, posts.withColumn("at", F.col("posted")), ["zone"], "ts", "at", ["mw", "posted"])
    return joined.select(day_text("ts").alias("ts"), "zone", "mw", day_text("posted").alias("posted"))


@query(with_sql("vintage spp lam cong", """
, grid AS (SELECT unnest(generate_series(TIMESTAMP '1995-03-01', TIMESTAMP '1995-03-14', INTERVAL 1 DAY)) AS ts),
 load AS (SELECT ts, sum(mw) AS mw FROM (SELECT ts, zone, CAST(arg_max(mw, (posted, doc, line, mw)) AS DECIMAL(18,2)) AS mw FROM vintage WHERE posted <= ts - INTERVAL 1 DAY AND zone < 'Z4' GROUP BY 1, 2) GROUP BY 1),
 wind AS (SELECT ts, sum(mw) AS mw FROM (SELECT ts, zone, CAST(arg_max(mw, (posted, doc, line, mw)) AS DECIMAL(18,2)) AS mw FROM vintage WHERE posted <= ts - INTERVAL 1 DAY AND zone >= 'Z4' GROUP BY 1, 2) GROUP BY 1)
SELECT strftime(g.ts, '%Y-%m-%d') AS ts, CAST(l.mw AS DOUBLE) AS load_mw, CAST(w.mw AS DOUBLE) AS wind_mw, CAST(l.mw - w.mw AS DOUBLE) AS net_mw, round(s.slam, 6) AS slam
FROM grid AS g LEFT JOIN load AS l USING (ts) LEFT JOIN wind AS w USING (ts) LEFT JOIN lam1 AS s USING (ts)"""))
def conditions_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    grid = spark.range(1).select(F.explode(F.sequence(F.to_timestamp(F.lit("1995-03-01")), F.to_timestamp(F.lit("1995-03-14")), F.expr("INTERVAL 1 DAY"))).alias("ts"))
    inside = market.vintages(spark, sf_dir).where(F.col("ts").between("1995-03-01", "1995-03-14"))
    newest = panels.latest_vintage(inside, ["ts", "zone"], "posted", F.col("ts") - F.expr("INTERVAL 1 DAY"), ["doc", "line", "mw"])

    def total(rows: DataFrame, name: str) -> DataFrame:
        return rows.groupBy("ts").agg(F.sum(F.col("mw").cast(market.CENTS)).alias(name))

    lam = panels.lowest_flag(market.system_lambda(spark, sf_dir), ["ts"], "slam")
    joined = grid.join(total(newest.where("zone < 'Z4'"), "l"), "ts", "left").join(total(newest.where("zone >= 'Z4'"), "w"), "ts", "left").join(lam, "ts", "left")
    return joined.select(day_text("ts").alias("ts"), F.col("l").cast("double").alias("load_mw"), F.col("w").cast("double").alias("wind_mw"), (F.col("l") - F.col("w")).cast("double").alias("net_mw"), r6("slam").alias("slam"))


CT = "((ts AT TIME ZONE 'UTC') AT TIME ZONE 'America/Chicago')"


@query(with_sql("mu", f"""
, l AS (SELECT DISTINCT ts, {CT} AS c FROM mu)
SELECT strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts, CAST(hour(c) AS INTEGER) AS hour_ct, CAST(isodow(c) - 1 AS INTEGER) AS dow, CAST(month(c) AS INTEGER) AS month,
       CAST(isodow(c) >= 6 AS INTEGER) AS is_weekend, round(sin(hour(c) * 2 * pi() / 24), 6) + 0.0 AS hour_sin, round(cos(hour(c) * 2 * pi() / 24), 6) + 0.0 AS hour_cos FROM l"""))
def calendar_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    hours = market.shadow_prices(spark, sf_dir).select("ts").distinct()
    made = clock.calendar_features(hours)
    return made.select(stamp("ts").alias("ts"), "hour_ct", "dow", "month", "is_weekend", r6("hour_sin").alias("hour_sin"), r6("hour_cos").alias("hour_cos"))


@query(with_sql("mu", f"""
SELECT strftime({CT}, '%Y-%m-%d') AS day, key, round(sum(mu), 6) AS total_mu, CAST(count(*) FILTER (mu <> 0) AS BIGINT) AS hours
FROM mu WHERE hour({CT}) BETWEEN 7 AND 22 GROUP BY 1, 2"""))
def constraint_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    mu = market.shadow_prices(spark, sf_dir).where(clock.local_hour(F.col("ts")).between(7, 22))
    return mu.groupBy(day_text(clock.delivery_date(F.col("ts"))).alias("day"), "key").agg(r6(F.sum("mu")).alias("total_mu"), F.count_if(F.col("mu") != 0).alias("hours"))


@query(with_sql("mu", f"""
, d AS (SELECT DISTINCT CAST({CT} AS DATE) AS day FROM mu),
 e AS (SELECT day, unnest(generate_series(CAST(day AS TIMESTAMP), CAST(day AS TIMESTAMP) + INTERVAL 23 HOUR, INTERVAL 1 HOUR)) AS c FROM d),
 x AS (SELECT day, ((c AT TIME ZONE 'America/Chicago') AT TIME ZONE 'UTC') AS ts FROM e),
 have AS (SELECT DISTINCT ts FROM mu WHERE mu > 300)
SELECT strftime(day, '%Y-%m-%d') AS day, strftime(x.ts, '%Y-%m-%d %H:%M:%S') AS ts FROM x ANTI JOIN have USING (ts)"""))
def missing_hours_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    mu = market.shadow_prices(spark, sf_dir)
    days = mu.select(clock.delivery_date(F.col("ts")).alias("day")).distinct()
    gaps = panels.missing(panels.expected_hours(days), mu.where("mu > 300"), ["ts"])
    return gaps.select(day_text("day").alias("day"), stamp("ts").alias("ts"))


@query(with_sql("mu", """
, before AS (SELECT DISTINCT key FROM mu WHERE ts < TIMESTAMP '2024-01-20' AND mu > 200),
 after AS (SELECT key, count(*) AS hours, round(sum(mu), 6) AS mass FROM mu WHERE ts >= TIMESTAMP '2024-01-20' AND mu > 200 GROUP BY key)
SELECT key, hours, mass FROM after ANTI JOIN before USING (key)"""))
def novel_keys_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    mu = market.shadow_prices(spark, sf_dir).where("mu > 200")
    after = mu.where("ts >= '2024-01-20'").groupBy("key").agg(F.count(F.lit(1)).alias("hours"), r6(F.sum("mu")).alias("mass"))
    return after.join(mu.where("ts < '2024-01-20'").select("key").distinct(), "key", "left_anti")


@query("""
WITH days AS (SELECT CAST(unnest(generate_series(TIMESTAMP '1995-01-01', TIMESTAMP '1995-12-31', INTERVAL 1 DAY)) AS DATE) AS day),
a AS (SELECT DISTINCT CAST(l_shipdate AS DATE) AS day FROM lineitem WHERE l_returnflag = 'R'), b AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS day FROM orders WHERE o_orderstatus = 'P')
SELECT strftime(days.day, '%Y-%m-%d') AS day, a.day IS NOT NULL AS has_prices, b.day IS NOT NULL AS has_postings, a.day IS NOT NULL AND b.day IS NOT NULL AS complete
FROM days LEFT JOIN a ON a.day = days.day LEFT JOIN b ON b.day = days.day""")
def day_completeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = spark.range(1).select(F.explode(F.sequence(F.to_date(F.lit("1995-01-01")), F.to_date(F.lit("1995-12-31")), F.expr("INTERVAL 1 DAY"))).alias("day"))
    relations = {
        "prices": market.table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(F.to_date("l_shipdate").alias("day")),
        "postings": market.table(spark, sf_dir, "orders").where("o_orderstatus = 'P'").select(F.to_date("o_orderdate").alias("day")),
    }
    return panels.completeness(days, relations).withColumn("day", day_text("day"))


@query(with_sql("mu", """
, p AS (SELECT m.ts, m.key, m.mu, e.mu AS lagged FROM mu AS m LEFT JOIN mu AS e ON m.key = e.key AND e.ts = m.ts - INTERVAL 1 DAY)
SELECT strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts, key, mu, coalesce(lagged, 0.0) AS persistence FROM p"""))
def persistence_lag_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    lagged = panels.lag_days(market.shadow_prices(spark, sf_dir), "mu")
    return lagged.select(stamp("ts").alias("ts"), "key", "mu", F.coalesce("lagged", F.lit(0.0)).alias("persistence"))


@query(with_sql("mu", """
, w AS (SELECT key, CAST(date_trunc('week', ts) AS DATE) AS start, round(max(mu), 6) AS peak FROM mu GROUP BY 1, 2),
 d AS (SELECT DISTINCT key, CAST(ts AS DATE) AS day FROM mu)
SELECT d.key, strftime(d.day, '%Y-%m-%d') AS day, strftime(w.start, '%Y-%m-%d') AS start, w.peak
FROM d LEFT JOIN w ON d.key = w.key AND d.day >= w.start + INTERVAL 7 DAY AND d.day < w.start + INTERVAL 14 DAY"""))
def interval_attach(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each day gets the features of the refit made from the week before it."""
    mu = market.shadow_prices(spark, sf_dir)
    weeks = mu.groupBy("key", F.to_date(F.date_trunc("week", "ts")).alias("start")).agg(r6(F.max("mu")).alias("peak"))
    served = weeks.withColumn("serve", F.date_add("start", 7))
    days = mu.select("key", F.to_date("ts").alias("day")).distinct()
    return panels.interval_attach(days, served, "day", "serve", 7, ["key"]).select("key", day_text("day").alias("day"), day_text("start").alias("start"), "peak")


@query(with_sql("mu", """
, a AS (SELECT key, 0 AS part, row_number() OVER (ORDER BY sum(mu) DESC, key) AS place FROM mu WHERE ts < TIMESTAMP '2024-01-15' GROUP BY key),
 b AS (SELECT key, 1 AS part, row_number() OVER (ORDER BY max(mu) DESC, key) AS place FROM mu WHERE ts >= TIMESTAMP '2024-01-15' GROUP BY key),
 u AS (SELECT * FROM a WHERE place <= 12 UNION ALL SELECT * FROM b WHERE place <= 12), f AS (SELECT key, min((part, place)) AS firstat FROM u GROUP BY key)
SELECT key, firstat[1] AS part, firstat[2] AS place FROM f ORDER BY part, place LIMIT 18"""))
def joined_top_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    mu = market.shadow_prices(spark, sf_dir)

    def top(rows: DataFrame, by) -> DataFrame:
        ranked = rows.groupBy("key").agg(by.alias("v")).orderBy(F.desc("v"), "key").limit(12)
        return ranked.withColumn("place", F.row_number().over(Window.orderBy(F.desc("v"), "key")).cast("long"))

    first, second = top(mu.where("ts < '2024-01-15'"), F.sum("mu")), top(mu.where("ts >= '2024-01-15'"), F.max("mu"))
    return panels.ordered_union([first, second], "key", 18)


@query("""
SELECT event_id, event_type, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, CAST(json_extract_string(props, '$.k') AS INTEGER) % 7 AS bucket
FROM events WHERE CAST(json_extract_string(props, '$.k') AS INTEGER) >= 50""")
def json_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").try_cast("int")
    return market.table(spark, sf_dir, "events").select("event_id", "event_type", k.alias("k"), (k % 7).alias("bucket")).where("k >= 50")


@query(with_sql("mu", f"""
SELECT strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts, CAST(row_number() OVER (PARTITION BY CAST({CT} AS DATE), key ORDER BY ts) AS INTEGER) AS ordinal, key, mu FROM mu"""))
def ordinal_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    mu = market.shadow_prices(spark, sf_dir).withColumn("day", clock.delivery_date(F.col("ts")))
    return panels.ordinal_profile(mu, "ts", ["day", "key"]).select(stamp("ts").alias("ts"), "ordinal", "key", "mu")


@query(with_sql("mu", """
SELECT DISTINCT key, split_part(key, '|', 1) AS name, CASE WHEN position('|' IN key) > 0 THEN substr(key, position('|' IN key) + 1) END AS contingency,
       CASE WHEN key LIKE '%|BASE CASE' THEN 'gtc' WHEN vec_id % 3 = 0 AND (vec_id % 8) / 10.0 < 0.25 THEN 'radial' ELSE 'transmission' END AS ctype FROM mu"""))
def constraint_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = market.shadow_prices(spark, sf_dir).select("key", "vec_id").distinct()
    name, contingency = fields.split_key(F.col("key"))
    kind = fields.constraint_type(F.col("key"), F.when(F.col("vec_id") % 3 == 0, 1).otherwise(0), (F.col("vec_id") % 8) / 10)
    return keys.select("key", name.alias("name"), contingency.alias("contingency"), kind.alias("ctype"))
