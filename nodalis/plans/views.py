"""Queries over composed views."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from nodalis.functions import clock
from nodalis.operators import boards, history, metrics, models, projection, views
from nodalis.plans.models import _planted, _windows
from nodalis.plans.registry import day_text, query, r6, stamp
from nodalis.sources import market
from nodalis.sources.market import with_sql

CT = "((ts AT TIME ZONE 'UTC') AT TIME ZONE 'America/Chicago')"
DAY = "ts >= TIMESTAMP '2024-01-10' AND ts < TIMESTAMP '2024-01-11'"


def _day(df: DataFrame) -> DataFrame:
    return df.where("ts >= '2024-01-10' AND ts < '2024-01-11'")


def _daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(key, day, v): daily totals, summed as decimals, so that equal days are equal and ranks do not depend on the order of rows."""
    return market.shadow_prices(spark, sf_dir).groupBy("key", F.to_date("ts").alias("day")).agg(F.sum(F.col("mu").cast(market.CENTS)).cast("double").alias("v"))


@query(with_sql("mu", """
, f AS (SELECT ts, key, mu AS point, 2 AS horizon FROM mu UNION ALL SELECT ts, key, mu * 2, 1 FROM mu WHERE hour(ts) % 2 = 0)
SELECT strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts, key, round(arg_min(point, horizon), 6) AS point, min(horizon) AS horizon FROM f GROUP BY f.ts, key"""))
def forecast_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    mu = market.shadow_prices(spark, sf_dir)
    preview, final = mu.select("ts", "key", F.col("mu").alias("point"), F.lit(2).alias("horizon")), mu.where("hour(ts) % 2 = 0").select("ts", "key", (F.col("mu") * 2).alias("point"), F.lit(1).alias("horizon"))
    return views.lowest_horizon(preview.unionByName(final), ["ts", "key"]).select(stamp("ts").alias("ts"), "key", r6("point").alias("point"), "horizon")


@query(with_sql("mu", f"""
, h AS (SELECT ts, sum(mu) AS slam, {CT} AS c FROM mu GROUP BY ts), s AS (SELECT * FROM h WHERE hour(ts) % 3 <> 0),
 d AS (SELECT max(CAST(c AS DATE)) AS latest FROM s), k AS (SELECT hour(c) AS hour, arg_min(slam, ts) AS curve FROM s, d WHERE CAST(c AS DATE) = latest GROUP BY 1)
SELECT strftime(h.ts, '%Y-%m-%d %H:%M:%S') AS ts, round(coalesce(s.slam, k.curve), 6) AS slam, CASE WHEN s.slam IS NOT NULL THEN 'settled' WHEN k.curve IS NOT NULL THEN 'persisted' END AS source
FROM h LEFT JOIN s USING (ts) LEFT JOIN k ON k.hour = hour(h.c)"""))
def lambda_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    hours = market.shadow_prices(spark, sf_dir).groupBy("ts").agg(F.sum("mu").alias("slam"))
    got = views.with_fallback(hours.select("ts"), hours.where("hour(ts) % 3 <> 0"))
    return got.select(stamp("ts").alias("ts"), r6("slam").alias("slam"), "source")


@query("""
WITH o AS (SELECT l_linestatus || l_returnflag AS fuel, l_shipdate AS s, l_shipdate + CAST(l_quantity AS INTEGER) * INTERVAL 1 DAY AS e, CAST(l_extendedprice AS DECIMAL(18,2)) AS mw FROM lineitem)
SELECT coalesce(fuel, 'all') AS fuel, CAST(sum(mw) AS DOUBLE) AS mw, count(*) AS units FROM o WHERE s <= TIMESTAMP '1996-06-01' AND e > TIMESTAMP '1996-06-01' GROUP BY ROLLUP (fuel)""")
def fuel_outages(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = market.table(spark, sf_dir, "lineitem").select(F.concat("l_linestatus", "l_returnflag").alias("fuel"), F.col("l_shipdate").alias("start"), F.timestamp_add("DAY", F.col("l_quantity").cast("int"), F.col("l_shipdate")).alias("end"), F.col("l_extendedprice").cast(market.CENTS).alias("mw"))
    got = views.outages_at(rows, F.to_timestamp(F.lit("1996-06-01")), "fuel")
    return got.select(F.coalesce("fuel", F.lit("all")).alias("fuel"), F.col("mw").cast("double").alias("mw"), "units")


@query("""
WITH u AS (SELECT CASE WHEN s_suppkey % 4 = 0 THEN 'code' WHEN s_nationkey < 12 THEN 'name' ELSE 'none' END AS method, CAST(s_acctbal AS DECIMAL(18,2)) AS mw FROM supplier WHERE s_acctbal > 0), b AS (SELECT method, sum(mw) AS mw FROM u GROUP BY 1)
SELECT method, CAST(mw AS DOUBLE) AS mw, round(CAST(mw AS DOUBLE) / CAST(sum(mw) OVER () AS DOUBLE), 6) AS share, round(CAST(sum(CASE WHEN method <> 'none' THEN mw ELSE 0 END) OVER () AS DOUBLE) / CAST(sum(mw) OVER () AS DOUBLE), 6) AS located FROM b""")
def mw_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    method = F.when(F.col("s_suppkey") % 4 == 0, "code").when(F.col("s_nationkey") < 12, "name").otherwise("none")
    rows = market.table(spark, sf_dir, "supplier").where("s_acctbal > 0").select(method.alias("method"), F.col("s_acctbal").alias("mw"))
    got = views.located_share(rows)
    return got.select("method", F.round("mw", 2).alias("mw"), r6("share").alias("share"), r6("located").alias("located"))


@query(with_sql("mu sf", f"""
, d AS (SELECT key, sum(mu) AS mu FROM mu WHERE {DAY} GROUP BY 1), t AS (SELECT key, sp, -mu * sf AS c FROM sf JOIN d USING (key) WHERE mu * sf <> 0),
 k AS (SELECT key, sum(abs(c)) AS size, sum(c) AS total FROM t WHERE lower(key) LIKE '%base%' OR key IN ('7|N1', '13|N1') GROUP BY 1),
 r AS (SELECT *, row_number() OVER (ORDER BY CASE WHEN key IN ('7|N1', '13|N1') THEN 0 ELSE 1 END, size DESC, key) AS row_rank FROM k), s AS (SELECT t.*, row_rank, total FROM t JOIN r USING (key) WHERE row_rank <= 8),
 n AS (SELECT sp, row_number() OVER (ORDER BY sum(abs(c)) DESC, sp) AS column_rank FROM s GROUP BY sp)
SELECT key, sp, round(c, 6) AS contribution, CAST(row_rank AS INTEGER) AS row_rank, CAST(column_rank AS INTEGER) AS column_rank, round(total, 6) AS row_total FROM s JOIN n USING (sp) WHERE column_rank <= 12"""))
def matrix_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = _day(market.shadow_prices(spark, sf_dir)).groupBy("key").agg(F.sum("mu").alias("mu")).withColumn("ts", F.lit("day"))
    got = views.frame(projection.contributions(day, market.shift_factors(spark, sf_dir)), 8, 12, ("7|N1", "13|N1"), "base")
    return got.select("key", "sp", r6("contribution").alias("contribution"), "row_rank", "column_rank", r6("row_total").alias("row_total"))


@query(with_sql("mu", """
, d AS (SELECT key, CAST(ts AS DATE) AS day, sum(mu) AS v FROM mu GROUP BY 1, 2), t AS (SELECT key, v FROM d WHERE day = DATE '2024-01-30'), y AS (SELECT key, v FROM d WHERE day = DATE '2024-01-29'),
 h AS (SELECT key, median(v) AS p50, quantile_cont(v, 0.9) AS p90, count(*) AS n FROM d WHERE day < DATE '2024-01-29' GROUP BY 1),
 e AS (SELECT key FROM y JOIN h USING (key) WHERE n >= 10 AND v / p50 >= 1.5 ORDER BY v / p50 DESC, key LIMIT 20), s AS (SELECT key FROM t JOIN h USING (key) WHERE n >= 10 AND v / p90 >= 1.25),
 u AS (SELECT key, max(elevated) AS elevated, max(surprise) AS surprise FROM (SELECT key, TRUE AS elevated, FALSE AS surprise FROM e UNION ALL SELECT key, FALSE, TRUE FROM s) GROUP BY 1),
 r AS (SELECT key, row_number() OVER (ORDER BY v DESC, key) AS settled_rank FROM t)
SELECT key, elevated, surprise, CAST(settled_rank AS INTEGER) AS settled_rank, CAST(row_number() OVER (ORDER BY settled_rank ASC NULLS LAST, key) AS INTEGER) AS place FROM u LEFT JOIN r USING (key)"""))
def standouts_board(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _daily(spark, sf_dir)
    past = d.where("day < '2024-01-29'")
    today = d.where("day = '2024-01-30'").drop("day")
    elevated = history.elevated(d.where("day = '2024-01-29'").drop("day"), past, nonzero=False)
    return views.board({"elevated": elevated, "surprise": history.surprises(today, past, nonzero=False)}, today)


@query(with_sql("mu sf", f"""
, p AS (SELECT ts, sp, -sum(mu * sf) AS v FROM mu JOIN sf USING (key) WHERE {DAY} GROUP BY 1, 2), m AS (SELECT sp, avg(v) AS peak FROM p WHERE hour({CT}) BETWEEN 7 AND 22 GROUP BY 1),
 t AS (SELECT sp, mu.key AS key, sum(-mu * sf) AS v FROM mu JOIN sf USING (key) WHERE {DAY} AND mu * sf <> 0 GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY sp ORDER BY abs(v) DESC, key) AS n, sum(abs(v)) OVER (PARTITION BY sp) AS gross FROM t)
SELECT m.sp, round(peak, 6) AS peak_mean, r.key AS driver, round(abs(r.v) / gross, 6) AS share FROM m JOIN r ON m.sp = r.sp AND n = 1 ORDER BY abs(peak) DESC, m.sp LIMIT 15"""))
def top_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    mu, sf = _day(market.shadow_prices(spark, sf_dir)), market.shift_factors(spark, sf_dir)
    peak = projection.project(mu, sf).where(clock.local_hour(F.col("ts")).between(7, 22)).groupBy("sp").agg(F.avg("point").alias("peak"))
    best = projection.dominant_driver(projection.contributions(mu, sf))
    top = peak.join(best, "sp").orderBy(F.abs("peak").desc(), "sp").limit(15)
    return top.select("sp", r6("peak").alias("peak_mean"), F.col("key").alias("driver"), r6("share").alias("share"))


@query(with_sql("sf", """
, a AS (SELECT DISTINCT sp, place // 3 AS grp FROM sf WHERE place < 60), b AS (SELECT DISTINCT sp, CASE WHEN place % 9 = 4 THEN 1000 + place ELSE place // 3 END AS grp FROM sf),
 j AS (SELECT sp, a.grp AS a, b.grp AS b FROM a JOIN b USING (sp)), x AS (SELECT a, count(*) AS n FROM j GROUP BY 1), y AS (SELECT b, count(*) AS n FROM j GROUP BY 1), z AS (SELECT a, b, count(*) AS n FROM j GROUP BY 1, 2),
 h AS (SELECT count(*) AS hits FROM z JOIN x ON z.a = x.a JOIN y ON z.b = y.b WHERE z.n = x.n AND z.n = y.n AND z.n >= 2), c AS (SELECT count(*) AS n_ours FROM x WHERE n >= 2), d AS (SELECT count(*) AS n_theirs FROM y WHERE n >= 2)
SELECT hits, n_ours, n_theirs, round(hits / n_ours, 6) AS precision, round(hits / n_theirs, 6) AS recall FROM h, c, d"""))
def essp_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = market.shift_factors(spark, sf_dir).select("sp", "place").distinct()
    third = F.floor(F.col("place") / 3)
    ours = nodes.where("place < 60").select("sp", third.alias("grp"))
    theirs = nodes.select("sp", F.when(F.col("place") % 9 == 4, 1000 + F.col("place")).otherwise(third).alias("grp"))
    got = views.group_agreement(ours, theirs)
    return got.select("hits", "n_ours", "n_theirs", r6("precision").alias("precision"), r6("recall").alias("recall"))


@query(with_sql("mu", """
, d AS (SELECT key, CAST(ts AS DATE) AS day, sum(mu) AS v FROM mu GROUP BY 1, 2), u AS (SELECT DISTINCT key FROM d), s AS (SELECT key, v FROM d WHERE day = DATE '2024-01-20' AND v > 50),
 a AS (SELECT 'persistence' AS source, key, v FROM d WHERE day = DATE '2024-01-19' UNION ALL SELECT 'climatology', key, sum(v) / 19 FROM d WHERE day < DATE '2024-01-20' GROUP BY 2),
 f AS (SELECT x.source, u.key, coalesce(a.v, 0) AS predicted, coalesce(s.v, 0) AS settled, s.key IS NOT NULL AS bound FROM u CROSS JOIN (SELECT DISTINCT source FROM a) AS x LEFT JOIN a ON a.source = x.source AND a.key = u.key LEFT JOIN s ON s.key = u.key),
 t AS (SELECT source, predicted, count(*) AS n, count(*) FILTER (bound) AS b FROM f GROUP BY 1, 2), w AS (SELECT *, coalesce(sum(n) OVER v, 0) AS cn, coalesce(sum(b) OVER v, 0) AS cb FROM t WINDOW v AS (PARTITION BY source ORDER BY predicted DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
 ap AS (SELECT source, sum(list_sum(list_transform(range(1, n + 1), lambda i: (cb + 1 + (i - 1) * CASE WHEN n > 1 THEN (b - 1) / (n - 1) ELSE 0 END) / (cn + i) * b / n))) / sum(b) AS ap, sum(b) / sum(n) AS rate FROM w GROUP BY 1),
 o AS (SELECT source, 2 * sum(least(predicted, settled)) / (sum(predicted) + sum(settled)) AS overlap FROM f GROUP BY 1)
SELECT source, round(ap, 6) AS ap, round(rate, 6) AS rate, round((ap - rate) / (1 - rate), 6) AS skill, round(overlap, 6) AS overlap FROM ap JOIN o USING (source)"""))
def grade_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _daily(spark, sf_dir)
    settled = d.where("day = '2024-01-20' AND v > 50").select("key", "v")
    climatology = d.where("day < '2024-01-20'").groupBy("key").agg((F.sum("v") / 19).alias("v"))
    got = views.grade_sources(d.select("key").distinct(), settled, {"persistence": d.where("day = '2024-01-19'").select("key", "v"), "climatology": climatology})
    return got.select("source", *(r6(c).alias(c) for c in ("ap", "rate", "skill", "overlap")))


@query(with_sql("mu", """
, d AS (SELECT key, CAST(ts AS DATE) AS day, count(*) AS n FROM mu WHERE mu > 20 GROUP BY 1, 2)
SELECT a.key, strftime(a.day, '%Y-%m-%d') AS day, CAST(sum(b.n) AS BIGINT) AS n_7d FROM d AS a JOIN d AS b ON a.key = b.key AND b.day <= a.day AND b.day > a.day - 7 GROUP BY a.key, a.day"""))
def window_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    daily = market.shadow_prices(spark, sf_dir).where("mu > 20").groupBy("key", F.to_date("ts").alias("day")).agg(F.count(F.lit(1)).alias("n"))
    return views.window_counts(daily, 7).select("key", day_text("day").alias("day"), "n_7d")


@query(with_sql("mu sf", f"""
, p AS (SELECT CAST(ts AS DATE) AS day, round(abs(sum(mu * sf)), 6) AS v FROM mu JOIN sf USING (key) GROUP BY ts, sp), r AS (SELECT *, count(*) OVER (PARTITION BY day) AS n, row_number() OVER (PARTITION BY day ORDER BY v DESC) AS i FROM p)
SELECT strftime(day, '%Y-%m-%d') AS day, v AS threshold FROM r WHERE n >= 500 AND i = ceil(n * 0.01)"""))
def local_extreme(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = projection.project(market.shadow_prices(spark, sf_dir), market.shift_factors(spark, sf_dir)).select(F.date_format("ts", "yyyy-MM-dd").alias("day"), F.round(F.abs("point"), 6).alias("v"))
    return views.local_extreme(points, ["day"], "v")


@query(with_sql("mu", """
, m AS (SELECT * FROM mu WHERE mu > 150), b AS (SELECT key, max(ts) AS last FROM m WHERE ts < TIMESTAMP '2024-01-20' GROUP BY 1), a AS (SELECT key, sum(mu) AS mass FROM m WHERE ts >= TIMESTAMP '2024-01-20' GROUP BY 1)
SELECT CASE WHEN last IS NULL THEN 'new' WHEN date_diff('day', CAST(last AS DATE), DATE '2024-01-20') <= 5 THEN 'warm' ELSE 'seen' END AS tier, count(*) AS keys, round(sum(mass), 4) AS mass FROM a LEFT JOIN b USING (key) GROUP BY 1"""))
def novelty_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = views.novelty(market.shadow_prices(spark, sf_dir).where("mu > 150"), "2024-01-20", 5)
    return got.select("tier", "keys", F.round("mass", 4).alias("mass"))


@query(with_sql("sf", """
, o AS (SELECT CAST(l_shipdate AS DATE) AS day, 'N' || CAST(l_suppkey % 64 AS VARCHAR) AS sp, sum(CAST(l_quantity AS BIGINT)) AS mw FROM lineitem GROUP BY 1, 2)
SELECT strftime(day, '%Y-%m-%d') AS day, key, round(sum(abs(sf) * mw), 6) AS exposure FROM o JOIN sf USING (sp) GROUP BY 1, 2"""))
def outage_exposure(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = market.table(spark, sf_dir, "lineitem").select(F.to_date("l_shipdate").alias("day"), F.concat(F.lit("N"), (F.col("l_suppkey") % 64).cast("string")).alias("sp"), F.col("l_quantity").alias("mw"))
    got = views.exposure(market.shift_factors(spark, sf_dir), rows)
    return got.select(day_text("day").alias("day"), "key", r6("exposure").alias("exposure"))


SLOTS = """
, d AS (SELECT CAST(ts AS DATE) AS day, key, sum(mu) AS v FROM mu GROUP BY 1, 2), s AS (SELECT key, zone, sum(abs(sf)) AS w FROM sf JOIN geo USING (sp) WHERE abs(sf) >= 0.25 GROUP BY 1, 2), q AS (SELECT key, zone, w / sum(w) OVER (PARTITION BY key) AS share FROM s),
 t AS (SELECT day, sum(v) AS total FROM d GROUP BY 1), r AS (SELECT a.day, a.total, 1 + (SELECT count(*) FROM t AS b WHERE b.day < a.day AND b.total >= a.total) AS rank, a.total / (SELECT median(total) FROM t) AS ratio, 100.0 * (SELECT count(*) FROM t AS b WHERE b.day <= a.day AND b.total <= a.total) / (SELECT count(*) FROM t AS b WHERE b.day <= a.day) AS pct FROM t AS a),
 z AS (SELECT day, zone, sum(v * share) AS m FROM d JOIN q USING (key) GROUP BY 1, 2), l AS (SELECT day, zone, m / sum(m) OVER (PARTITION BY day) AS share, row_number() OVER (PARTITION BY day ORDER BY round(m, 6) DESC, zone) AS i FROM z),
 n AS (SELECT day, count(DISTINCT key) AS unmapped FROM d WHERE key NOT IN (SELECT key FROM q) AND v > 250 GROUP BY 1),
 slots AS (
SELECT strftime(r.day, '%Y-%m-%d') AS day, CASE WHEN rank = 1 THEN 'record' WHEN rank <= 3 THEN 'near_top' WHEN ratio >= 1.25 THEN 'elevated' WHEN ratio >= 1.10 THEN 'ordinary_plus' WHEN ratio >= 0.75 THEN 'ordinary' WHEN ratio >= 0.5 THEN 'ordinary_minus' ELSE 'quiet' END AS size,
  CASE WHEN pct >= 100 THEN 'record' WHEN pct >= 95 THEN 'extreme' WHEN pct <= 5 THEN 'calm' ELSE 'typical' END AS regime, l.zone, round(l.share, 6) AS share, CASE WHEN l.share >= 0.55 THEN 'concentrated' WHEN l.share >= 0.45 THEN 'leaning' ELSE 'spread' END AS where_class,
  coalesce(n.unmapped, 0) AS unmapped, CASE WHEN coalesce(n.unmapped, 0) = 0 THEN 'none' WHEN n.unmapped <= 2 THEN 'few' ELSE 'many' END AS exceptions
FROM r JOIN l ON l.day = r.day AND i = 1 LEFT JOIN n ON n.day = r.day)"""


@query(with_sql("mu sf geo", SLOTS + """
SELECT * FROM slots"""))
def daily_brief_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _slots(spark, sf_dir).select("day", "size", "regime", "zone", r6("share").alias("share"), views.where_class(F.col("share")).alias("where_class"), "unmapped", views.exceptions(F.col("unmapped")).alias("exceptions"))


def _slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per day: size, regime, leading zone, constraints outside of the map."""
    daily = _daily(spark, sf_dir)
    shares = projection.zone_shares(market.shift_factors(spark, sf_dir).where("abs(sf) >= 0.25"), market.geography(spark, sf_dir))
    days = daily.groupBy("day").agg(F.sum("v").alias("total"))
    prior = F.collect_list("total").over(Window.orderBy("day").rowsBetween(Window.unboundedPreceding, -1))  # a calendar of the history
    median = days.agg(F.percentile("total", 0.5).alias("median"))
    sized = days.withColumn("prior", prior).crossJoin(F.broadcast(median))
    size = metrics.magnitude(history.conservative_rank(F.col("total"), F.col("prior")), F.col("total") / F.col("median"))
    zones = daily.join(shares.select("key", "zone", "share"), "key").groupBy("day", "zone").agg(F.sum(F.col("v") * F.col("share")).alias("m"))
    lead = zones.groupBy("day").agg(F.min(F.struct((-F.round("m", 6)).alias("n"), "zone", "m")).alias("l"), F.sum("m").alias("all")).select("day", "l.zone", (F.col("l.m") / F.col("all")).alias("share"))
    unmapped = daily.where("v > 250").join(shares.select("key").distinct(), "key", "left_anti").groupBy("day").agg(F.count_distinct("key").alias("unmapped"))
    joined = sized.join(lead, "day").join(unmapped, "day", "left")
    return joined.select(day_text("day").alias("day"), size.alias("size"), views.regime(history.trailing_percentile(F.col("total"), F.col("prior"))).alias("regime"), "zone", "share", F.coalesce("unmapped", F.lit(0)).cast("long").alias("unmapped"))


@query(with_sql("mu sf geo", SLOTS + """
, g AS (SELECT *, list_position(['quiet', 'ordinary_minus', 'ordinary', 'ordinary_plus', 'elevated', 'near_top', 'record'], size) AS rung FROM slots),
 b AS (SELECT *, abs(rung - lag(rung) OVER (ORDER BY day)) AS gap FROM g)
SELECT day, day || ': ' || CASE WHEN size = 'record' THEN 'Heaviest congestion on record' WHEN size IN ('near_top', 'elevated') THEN 'Heavy congestion' WHEN size = 'quiet' THEN 'Light congestion' ELSE 'Ordinary congestion' END || ', ' || zone || ' leads with '
  || CAST(CAST(round(share * 100) AS INTEGER) AS VARCHAR) || '%; ' || CASE unmapped WHEN 0 THEN 'no unmapped constraints' WHEN 1 THEN 'one unmapped constraint' ELSE CAST(unmapped AS VARCHAR) || ' unmapped constraints' END AS headline,
  CASE gap WHEN 0 THEN 'held' WHEN 1 THEN 'close' ELSE 'missed' END AS verdict FROM b"""))
def daily_brief(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each day's headline, and how the day before had it."""
    slots = _slots(spark, sf_dir)
    ladder = ("quiet", "ordinary_minus", "ordinary", "ordinary_plus", "elevated", "near_top", "record")
    before = F.lag("size").over(Window.orderBy("day"))  # one row per day
    text = views.sentence(F.col("day"), F.col("size"), F.col("zone"), F.col("share"), F.col("unmapped"))
    return slots.withColumn("before", before).select("day", text.alias("headline"), views.verdict(F.col("before"), F.col("size"), ladder).alias("verdict"))


@query()
def sf_stability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Correlation of each weekly map with the next one, and the fit of each."""
    mu, _, cong = _planted(spark, sf_dir)
    fitted = models.rolling_ridge(mu, cong, _windows(spark), ridge=0.1, min_hours=10, std_floor=1.0)
    stable = models.sf_stability(fitted, 7)
    return stable.select(F.date_format("window_start", "yyyy-MM-dd").alias("window_start"), "keys", r6("r").alias("r"))


@query(with_sql("mu", f"""
SELECT strftime(CAST({CT} AS DATE), '%Y-%m-%d') AS day, round(max(mu), 6) AS peak, round(avg(CASE WHEN hour({CT}) IN (15, 16, 17, 18) THEN mu END), 6) AS afternoon, count(DISTINCT key) AS keys FROM mu GROUP BY 1"""))
def daily_peaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    mu, hour = market.shadow_prices(spark, sf_dir), clock.local_hour(F.col("ts"))
    return mu.groupBy(day_text(clock.delivery_date(F.col("ts"))).alias("day")).agg(r6(F.max("mu")).alias("peak"), r6(F.avg(F.when(hour.isin(15, 16, 17, 18), F.col("mu")))).alias("afternoon"), F.count_distinct("key").alias("keys"))


@query("""
SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS hour, event_type AS zone, round(CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) / count(*), 6) AS lmp FROM events GROUP BY 1, 2""")
def hourly_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = market.table(spark, sf_dir, "events")
    mean = F.sum(F.col("value").cast(market.CENTS)).cast("double") / F.count("value")
    return rows.groupBy(F.date_trunc("hour", "ts").alias("h"), F.col("event_type").alias("zone")).agg(r6(mean).alias("lmp")).select(stamp("h").alias("hour"), "zone", "lmp")


@query(with_sql("mu", """
, d AS (SELECT key, CAST(ts AS DATE) AS day, sum(mu) AS v FROM mu GROUP BY 1, 2)
SELECT key, count(DISTINCT day) AS bound_days, round(median(v), 6) AS median FROM d WHERE v <> 0 GROUP BY key HAVING count(DISTINCT day) >= 24 ORDER BY median(v) DESC, key LIMIT 14"""))
def chronic_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = _daily(spark, sf_dir).where("v <> 0").groupBy("key").agg(F.count_distinct("day").alias("bound_days"), F.percentile("v", 0.5).alias("m")).where("bound_days >= 24")
    return own.orderBy(F.desc("m"), "key").limit(14).select("key", "bound_days", r6("m").alias("median"))


@query("""
WITH p AS (SELECT DISTINCT date_trunc('day', l_shipdate) + (l_linenumber - 1) * INTERVAL 1 HOUR AS wall, l_shipdate AS day, l_linenumber AS he FROM lineitem),
u AS (SELECT day, he, wall, wall + INTERVAL 5 HOUR AS s, wall + INTERVAL 6 HOUR AS w FROM p),
b AS (SELECT *, (s AT TIME ZONE 'UTC') AT TIME ZONE 'America/Chicago' = wall AS summer, (w AT TIME ZONE 'UTC') AT TIME ZONE 'America/Chicago' = wall AS winter FROM u)
SELECT DISTINCT strftime(day, '%Y-%m-%d') AS day, he, strftime(CASE WHEN summer THEN s ELSE w END, '%Y-%m-%d %H:%M:%S') AS ts, strftime(CASE WHEN summer AND NOT winter THEN s ELSE w END, '%Y-%m-%d %H:%M:%S') AS ts_second FROM b""")
def hour_ending_utc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both passes of every hour; they differ in the hour that occurs twice in autumn. Spring's missing hour counts on from the winter's clock."""
    rows = market.table(spark, sf_dir, "lineitem").select(F.to_date("l_shipdate").alias("day"), F.col("l_linenumber").alias("he")).distinct()
    first, second = (clock.hour_ending_to_utc(F.col("day"), F.col("he"), F.lit(1), F.lit(flag)) for flag in (False, True))
    return rows.select(day_text("day").alias("day"), "he", stamp(first).alias("ts"), stamp(second).alias("ts_second"))


@query("""
WITH s AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS day FROM orders WHERE o_orderpriority = '1-URGENT' AND o_orderstatus = 'P')
SELECT strftime(day, '%Y-%m-%d') AS day, strftime(lag(day) OVER (ORDER BY day), '%Y-%m-%d') AS previous, strftime(lead(day) OVER (ORDER BY day), '%Y-%m-%d') AS following FROM s""")
def neighbour_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nearest artifact day before and after each one; the window runs over the calendar of artifacts."""
    days = market.table(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT' AND o_orderstatus = 'P'").select(F.to_date("o_orderdate").alias("day")).distinct()
    along = Window.orderBy("day")
    return days.select(day_text("day").alias("day"), day_text(F.lag("day").over(along)).alias("previous"), day_text(F.lead("day").over(along)).alias("following"))


@query("""
WITH c AS (SELECT 'ECONOMY' AS k, 7.5 AS heat, 2.0 AS vom UNION ALL SELECT 'SMALL', 9.1, 3.5)
SELECT p_partkey AS unit, round((p_size / 10.0) * coalesce(heat, 10.0) + coalesce(vom, 4.0), 2) AS marginal_cost FROM part LEFT JOIN c ON p_type = k""")
def marginal_costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    costs = spark.createDataFrame([("ECONOMY", 7.5, 2.0), ("SMALL", 9.1, 3.5)], "p_type string, heat double, vom double")
    rows = market.table(spark, sf_dir, "part").join(F.broadcast(costs), "p_type", "left")
    return rows.select(F.col("p_partkey").alias("unit"), F.round((F.col("p_size") / 10) * F.coalesce("heat", F.lit(10.0)) + F.coalesce("vom", F.lit(4.0)), 2).alias("marginal_cost"))


@query("""
WITH t AS (SELECT p_partkey AS plant, unnest(string_split(upper(replace(p_name, ' ', ';')), ';')) AS token FROM part)
SELECT token, count(DISTINCT plant) AS plants, min(plant) AS first_plant FROM t WHERE token <> '' GROUP BY token""")
def token_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens = F.explode(F.split(F.upper(F.regexp_replace("p_name", "[ ;,/]+", ";")), ";"))
    rows = market.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("plant"), tokens.alias("token")).where("token <> ''")
    return rows.groupBy("token").agg(F.count_distinct("plant").alias("plants"), F.min("plant").alias("first_plant"))


@query("""
WITH m AS (SELECT 'all' AS split, o_orderstatus AS source, o_totalprice AS v FROM orders), s AS (SELECT source, avg(v) AS a, median(v) AS b, max(v) AS c FROM m GROUP BY 1), p AS (SELECT x.source AS model, y.source AS other, x.a > y.a AND x.b > y.b AND x.c > y.c AS beats FROM s AS x JOIN s AS y ON x.source <> y.source)
SELECT model, other, beats FROM p""")
def beats_board(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether one source is strictly better than another on every metric; one row per source."""
    rows = market.table(spark, sf_dir, "orders").groupBy(F.col("o_orderstatus").alias("source")).agg(F.avg("o_totalprice").alias("a"), F.percentile("o_totalprice", 0.5).alias("b"), F.max("o_totalprice").alias("c"))
    left = rows.select(F.col("source").alias("model"), *(F.col(m).alias(f"x_{m}") for m in "abc"))
    right = rows.select(F.col("source").alias("other"), *(F.col(m).alias(f"y_{m}") for m in "abc"))
    return left.join(F.broadcast(right), F.col("model") != F.col("other")).select("model", "other", boards.beats(list("abc"), "x", "y").alias("beats"))
