"""Queries over history, grading metrics, boards and write semantics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from nodalis.operators import boards, history, metrics, projection, writes
from nodalis.plans.registry import day_text, query, r6, stamp
from nodalis.sources import market
from nodalis.sources.market import with_sql

LAST = "DATE '2024-01-30'"
DAILY = """
, d AS (SELECT key, CAST(ts AS DATE) AS day, sum(mu) AS v FROM mu GROUP BY 1, 2)"""
#: Forecast of an hour: the same hour a day before; truth: the hour. Both projected to nodes.
TRUTH = """
, pr AS (SELECT ts + INTERVAL 1 DAY AS ts, key, mu FROM mu),
 y AS (SELECT ts, sp, -sum(mu * sf) AS y FROM mu JOIN sf USING (key) GROUP BY 1, 2),
 h AS (SELECT ts, sp, -sum(mu * sf) AS y_hat FROM pr JOIN sf USING (key) GROUP BY 1, 2),
 g AS (SELECT ts, sp, round(y, 6) AS y, round(y_hat, 6) AS y_hat FROM y JOIN h USING (ts, sp))"""


def _daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    return market.shadow_prices(spark, sf_dir).groupBy("key", F.to_date("ts").alias("day")).agg(F.sum("mu").alias("v"))


def _graded(spark: SparkSession, sf_dir: str) -> DataFrame:
    mu, sf = market.shadow_prices(spark, sf_dir).select("ts", "key", "mu"), market.shift_factors(spark, sf_dir)
    before = mu.withColumn("ts", F.col("ts") + F.expr("INTERVAL 1 DAY"))
    y = projection.project(mu, sf).withColumnRenamed("point", "y")
    h = projection.project(before, sf).withColumnRenamed("point", "y_hat")
    return y.join(h, ["ts", "sp"]).select("ts", "sp", r6("y").alias("y"), r6("y_hat").alias("y_hat"))


@query(with_sql("mu", """
, s AS (SELECT key, CAST(ts AS DATE) AS day, count(*) FILTER (abs(mu) > 20) AS binds, sum(CASE WHEN abs(mu) > 20 THEN abs(mu) ELSE 0 END) AS total FROM mu GROUP BY 1, 2),
 days AS (SELECT day, row_number() OVER (ORDER BY day) AS ordinal FROM (SELECT DISTINCT CAST(ts AS DATE) AS day FROM mu)),
 g AS (SELECT k.key, d.day, d.ordinal, coalesce(s.binds, 0) AS binds, coalesce(s.total, 0) AS total FROM (SELECT DISTINCT key FROM mu) AS k CROSS JOIN days AS d LEFT JOIN s ON s.key = k.key AND s.day = d.day)
SELECT key, strftime(day, '%Y-%m-%d') AS day,
  CAST(coalesce(sum(binds) OVER (PARTITION BY key ORDER BY day ROWS BETWEEN 1 PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS binds_1d,
  CAST(coalesce(sum(binds) OVER (PARTITION BY key ORDER BY day ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS binds_7d,
  round(coalesce(sum(binds) OVER (PARTITION BY key ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) / nullif(24.0 * (ordinal - 1), 0), 6) AS life_rate,
  round(sum(total) OVER (PARTITION BY key ORDER BY day ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING) / nullif(sum(binds) OVER (PARTITION BY key ORDER BY day ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING), 0), 6) AS mean_mu_7d,
  ordinal - last_value(CASE WHEN binds > 0 THEN ordinal END IGNORE NULLS) OVER (PARTITION BY key ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS days_since
FROM g"""))
def binding_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    mu = market.shadow_prices(spark, sf_dir).withColumn("day", F.to_date("ts"))
    got = history.binding_history(mu, 20.0, (1, 7))
    return got.select("key", day_text("day").alias("day"), "binds_1d", "binds_7d", r6("life_rate").alias("life_rate"), r6("mean_mu_7d").alias("mean_mu_7d"), F.col("days_since").cast("long").alias("days_since"))


@query(with_sql("mu", DAILY + """
SELECT key, count(*) AS n, round(quantile_cont(v, 0.1), 6) AS p10, round(quantile_cont(v, 0.5), 6) AS p50, round(quantile_cont(v, 0.9), 6) AS p90 FROM d WHERE v <> 0 GROUP BY key"""))
def history_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = history.percentiles(_daily(spark, sf_dir), ["key"], "v", (0.1, 0.5, 0.9), nonzero=True)
    return got.select("key", "n", r6("p10").alias("p10"), r6("p50").alias("p50"), r6("p90").alias("p90"))


@query(with_sql("mu", DAILY + f"""
, h AS (SELECT key, median(v) AS p50, count(*) AS n FROM d WHERE day < {LAST} AND v <> 0 GROUP BY 1)
SELECT key, round(v, 6) AS v, round(p50, 6) AS p50, round(v / p50, 6) AS ratio FROM d JOIN h USING (key) WHERE day = {LAST} AND n >= 10 AND v / p50 >= 1.5 ORDER BY v / p50 DESC, key LIMIT 20"""))
def standouts_elevated(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _daily(spark, sf_dir)
    got = history.elevated(d.where("day = '2024-01-30'").drop("day"), d.where("day < '2024-01-30'"))
    return got.select("key", r6("v").alias("v"), r6("p50").alias("p50"), r6("ratio").alias("ratio"))


@query(with_sql("mu", DAILY + f"""
, h AS (SELECT key, median(v) AS m, count(DISTINCT day) AS n FROM d WHERE day < {LAST} AND v <> 0 GROUP BY 1), t AS (SELECT key, v FROM d WHERE day = {LAST})
SELECT key, round(m, 6) AS median, n AS bound_days, round(coalesce(v, 0), 6) AS v FROM h LEFT JOIN t USING (key) WHERE n >= 20 AND coalesce(v, 0) <= 0.25 * m"""))
def chronic_under_called(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _daily(spark, sf_dir)
    got = history.chronic_under_called(d.where("day = '2024-01-30'").drop("day"), d.where("day < '2024-01-30'"), 20)
    return got.select("key", r6("median").alias("median"), "bound_days", r6("v").alias("v"))


@query(with_sql("mu", DAILY + f"""
, h AS (SELECT key, quantile_cont(v, 0.9) AS p90, count(*) AS n FROM d WHERE day < {LAST} AND v <> 0 GROUP BY 1)
SELECT key, round(v, 6) AS v, round(p90, 6) AS p90, round(abs(v) / p90, 6) AS ratio FROM d JOIN h USING (key) WHERE day = {LAST} AND n >= 10 AND abs(v) / p90 >= 1.25"""))
def settled_surprises(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _daily(spark, sf_dir)
    got = history.surprises(d.where("day = '2024-01-30'").drop("day"), d.where("day < '2024-01-30'"))
    return got.select("key", r6("v").alias("v"), r6("p90").alias("p90"), r6("ratio").alias("ratio"))


@query(with_sql("mu", """
, n AS (SELECT hour(ts) AS hour, count(DISTINCT ts) AS n FROM mu GROUP BY 1), k AS (SELECT key, hour(ts) AS hour, count(*) AS k FROM mu WHERE mu > 0 GROUP BY 1, 2), s AS (SELECT key, avg(mu) AS m FROM mu WHERE mu > 0 GROUP BY 1)
SELECT key, CAST(hour AS INTEGER) AS hour, round(k / n, 6) AS p_bind, round(m, 6) AS mean_mu, round(k / n * m, 6) AS mu FROM k JOIN n USING (hour) JOIN s USING (key)"""))
def climatology(spark: SparkSession, sf_dir: str) -> DataFrame:
    mu = market.shadow_prices(spark, sf_dir)
    got = history.climatology(mu, mu.select("ts").distinct())
    return got.select("key", "hour", r6("p_bind").alias("p_bind"), r6("mean_mu").alias("mean_mu"), r6("mu").alias("mu"))


@query(with_sql("mu", """
SELECT key, count(*) AS n, round((sum(CASE WHEN mu > 50 THEN 1 ELSE 0 END) + 50 * (SELECT avg(CASE WHEN mu > 50 THEN 1.0 ELSE 0.0 END) FROM mu)) / (count(*) + 50), 6) AS encoded FROM mu GROUP BY key"""))
def target_encoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = market.shadow_prices(spark, sf_dir).select("key", F.when(F.col("mu") > 50, 1.0).otherwise(0.0).alias("y"))
    return history.target_encoding(rows, "key", "y").select("key", "n", r6("encoded").alias("encoded"))


@query(with_sql("mu", """
, t AS (SELECT ts, sum(mu) AS net FROM mu GROUP BY 1),
 e AS (SELECT quantile_cont(net, 0.25) AS a, quantile_cont(net, 0.5) AS b, quantile_cont(net, 0.75) AS c FROM t WHERE ts < TIMESTAMP '2024-01-15')
SELECT CASE WHEN net >= c THEN 3 WHEN net >= b THEN 2 WHEN net >= a THEN 1 ELSE 0 END AS bucket, count(*) AS n, round(avg(net), 4) AS mean_net FROM t, e GROUP BY 1"""))
def net_load_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = market.shadow_prices(spark, sf_dir).groupBy("ts").agg(F.sum("mu").alias("net"))
    edges = history.quantile_edges(t.where("ts < '2024-01-15'"), "net", 4)
    return t.groupBy(history.bucket(F.col("net"), edges).alias("bucket")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("net"), 4).alias("mean_net"))


@query(with_sql("mu", """
, x AS (SELECT ts, CAST(sum(mu) AS DOUBLE) AS load, CAST(count(*) AS DOUBLE) AS wind, sin(hour(ts) * pi() / 12) AS solar FROM mu GROUP BY 1),
 k AS (SELECT DISTINCT key FROM mu), p AS (SELECT k.key, x.*, coalesce(m.mu, 0) AS mu FROM k CROSS JOIN x LEFT JOIN mu AS m ON m.key = k.key AND m.ts = x.ts)
SELECT key, 'load' AS name, round(corr(mu, load), 6) AS r FROM p GROUP BY 1 UNION ALL SELECT key, 'wind', round(corr(mu, wind), 6) FROM p GROUP BY 1 UNION ALL SELECT key, 'solar', round(corr(mu, solar), 6) FROM p GROUP BY 1"""))
def weather_corr(spark: SparkSession, sf_dir: str) -> DataFrame:
    mu = market.shadow_prices(spark, sf_dir)
    x = mu.groupBy("ts").agg(F.sum("mu").alias("load"), F.count(F.lit(1)).cast("double").alias("wind")).withColumn("solar", F.sin(F.hour("ts") * F.pi() / 12))
    return history.responses(mu, x, ["load", "wind", "solar"]).select("key", "name", r6("r").alias("r"))


@query(with_sql("mu sf", TRUTH + """
, r AS (SELECT ts, rank() OVER (PARTITION BY ts ORDER BY y) + (count(*) OVER (PARTITION BY ts, y) - 1) / 2.0 AS a, rank() OVER (PARTITION BY ts ORDER BY y_hat) + (count(*) OVER (PARTITION BY ts, y_hat) - 1) / 2.0 AS b FROM g)
SELECT strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts, count(*) AS n, round(corr(a, b), 6) AS spearman FROM r GROUP BY 1 HAVING count(*) >= 10"""))
def spearman_by_hour(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.spearman(_graded(spark, sf_dir), ["ts"]).select(stamp("ts").alias("ts"), "n", r6("spearman").alias("spearman"))


@query(with_sql("mu sf", TRUTH + """
SELECT strftime(CAST(ts AS DATE), '%Y-%m-%d') AS day, count(*) AS n, round(avg(CASE WHEN sign(y) = sign(y_hat) THEN 1.0 ELSE 0.0 END), 6) AS sign_agree FROM g WHERE abs(y) > 1 GROUP BY 1"""))
def sign_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _graded(spark, sf_dir).withColumn("day", F.date_format("ts", "yyyy-MM-dd"))
    return metrics.sign_agreement(rows, ["day"]).select("day", "n", r6("sign_agree").alias("sign_agree"))


@query(with_sql("mu sf", TRUTH + """
, c AS (SELECT ts, count(*) OVER (PARTITION BY ts) AS n, row_number() OVER (PARTITION BY ts ORDER BY y DESC, sp) AS a, row_number() OVER (PARTITION BY ts ORDER BY y_hat DESC, sp) AS b FROM g)
SELECT strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts, CAST(max(n) // 10 AS BIGINT) AS k, round(count(*) FILTER (a <= n // 10 AND b <= n // 10) / CAST(max(n) // 10 AS DOUBLE), 6) AS hit FROM c WHERE n >= 20 GROUP BY 1"""))
def topdecile_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.topdecile_hit(_graded(spark, sf_dir), ["ts"], "sp").select(stamp("ts").alias("ts"), "k", r6("hit").alias("hit"))


AP = """
, s AS (SELECT key, round(sum(CASE WHEN ts < TIMESTAMP '2024-01-29' AND ts >= TIMESTAMP '2024-01-28' THEN mu ELSE 0 END), -1) AS score, coalesce(sum(CASE WHEN ts >= TIMESTAMP '2024-01-29' AND ts < TIMESTAMP '2024-01-30' THEN mu END), 0) > 100 AS bound FROM mu GROUP BY key),
 t AS (SELECT score, count(*) AS n, count(*) FILTER (bound) AS b FROM s GROUP BY 1),
 u AS (SELECT *, coalesce(sum(n) OVER w, 0) AS cn, coalesce(sum(b) OVER w, 0) AS cb FROM t WINDOW w AS (ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
 v AS (SELECT *, list_sum(list_transform(range(1, n + 1), lambda i: (cb + 1 + (i - 1) * CASE WHEN n > 1 THEN (b - 1) / (n - 1) ELSE 0 END) / (cn + i) * b / n)) AS term FROM u),
 ap AS (SELECT sum(term) / sum(b) AS ap, sum(b) / sum(n) AS rate, sum(n) AS universe FROM v)"""


def _called(spark: SparkSession, sf_dir: str) -> DataFrame:
    mu = market.shadow_prices(spark, sf_dir)
    before = F.sum(F.when((F.col("ts") < "2024-01-29") & (F.col("ts") >= "2024-01-28"), F.col("mu")).otherwise(0.0))
    after = F.coalesce(F.sum(F.when((F.col("ts") >= "2024-01-29") & (F.col("ts") < "2024-01-30"), F.col("mu"))), F.lit(0.0))
    return mu.groupBy("key").agg(F.round(before, -1).alias("score"), (after > 100).alias("bound")).withColumn("all", F.lit(1))


@query(with_sql("mu", AP + """
SELECT round(ap, 6) AS ap, round(rate, 6) AS rate, CAST(universe AS BIGINT) AS universe FROM ap"""))
def expected_ap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.expected_ap(_called(spark, sf_dir), ["all"]).select(r6("ap").alias("ap"), r6("rate").alias("rate"), "universe")


@query(with_sql("mu", AP + """
SELECT round((ap - rate) / (1 - rate), 6) AS skill FROM ap WHERE rate < 1"""))
def chance_adjusted_skill(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = metrics.expected_ap(_called(spark, sf_dir), ["all"])
    return got.select(r6(metrics.chance_adjusted(F.col("ap"), F.col("rate"))).alias("skill"))


@query(with_sql("mu", DAILY + """
, a AS (SELECT key, day, v FROM d), j AS (SELECT coalesce(t.day, y.day + 1) AS day, coalesce(y.v, 0) AS predicted, coalesce(t.v, 0) AS settled FROM a AS t FULL JOIN a AS y ON t.key = y.key AND t.day = y.day + 1),
 o AS (SELECT day, 2 * sum(least(predicted, settled)) / nullif(sum(predicted) + sum(settled), 0) AS overlap, sum(predicted) / nullif(sum(settled), 0) AS ratio FROM j GROUP BY 1),
 c AS (SELECT *, least(ratio, 1 / nullif(ratio, 0)) AS q FROM o)
SELECT strftime(day, '%Y-%m-%d') AS day, round(overlap, 6) AS overlap, round(ratio, 6) AS ratio, round(2 * q / (1 + q), 6) AS ceiling, round(overlap / nullif(2 * q / (1 + q), 0), 6) AS share FROM c"""))
def soft_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _daily(spark, sf_dir)
    before = d.select("key", F.date_add("day", 1).alias("day"), F.col("v").alias("predicted"))
    both = d.withColumnRenamed("v", "settled").join(before, ["key", "day"], "full").fillna(0.0, ["predicted", "settled"])
    return metrics.soft_overlap(both, ["day"]).select(day_text("day").alias("day"), *(r6(c).alias(c) for c in ("overlap", "ratio", "ceiling", "share")))


@query(with_sql("mu sf", TRUTH + """
SELECT sp, count(*) AS n, round(1 - sum(power(y - y_hat, 2)) / (sum(y * y) - power(sum(y), 2) / count(*)), 6) AS r2 FROM g GROUP BY sp"""))
def pooled_r2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.pooled_r2(_graded(spark, sf_dir), ["sp"]).select("sp", "n", r6("r2").alias("r2"))


@query("""
WITH r AS (SELECT l_returnflag AS source, l_shipdate AS day, CASE WHEN l_discount > 0.01 THEN l_tax END AS v, CAST(l_quantity AS BIGINT) AS n FROM lineitem),
s AS (SELECT 'all' AS split, * FROM r UNION ALL SELECT CASE WHEN day < DATE '1997-01-01' THEN 'pre' ELSE 'post' END, * FROM r)
SELECT split, source, round(sum(v * n) / sum(CASE WHEN v IS NOT NULL THEN n END), 6) AS wmean, count(*) AS n FROM s GROUP BY 1, 2""")
def weighted_mean_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = market.table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("source"), F.to_date("l_shipdate").alias("day"), F.when(F.col("l_discount") > 0.01, F.col("l_tax")).alias("v"), F.col("l_quantity").cast("long").alias("n"))
    return boards.splits(rows, "1997-01-01").groupBy("split", "source").agg(r6(metrics.weighted_mean("v")).alias("wmean"), F.count(F.lit(1)).alias("n"))


@query(with_sql("mu sf geo", """
, k AS (SELECT key, arg_max(kv, (abs(sf), sp)) AS kv FROM sf JOIN geo USING (sp) GROUP BY 1)
SELECT CASE WHEN kv IS NULL THEN 'Unknown' ELSE CAST(CAST(kv AS INTEGER) AS VARCHAR) || ' kV' END AS class, count(DISTINCT key) AS keys, count(*) AS hours, round(avg(mu), 6) AS mean_mu, round(sum(mu) / sum(sum(mu)) OVER (), 6) AS share
FROM mu LEFT JOIN k USING (key) GROUP BY 1"""))
def voltage_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from nodalis.functions.fields import voltage_class

    top = market.shift_factors(spark, sf_dir).join(market.geography(spark, sf_dir), "sp").groupBy("key").agg(F.max_by("kv", F.struct(F.abs("sf"), "sp")).alias("kv"))
    rows = market.shadow_prices(spark, sf_dir).join(top, "key", "left").groupBy(voltage_class(F.col("kv")).alias("class")).agg(
        F.count_distinct("key").alias("keys"), F.count(F.lit(1)).alias("hours"), r6(F.avg("mu")).alias("mean_mu"), F.sum("mu").alias("mass"))
    return rows.select("class", "keys", "hours", "mean_mu", r6(F.col("mass") / F.sum("mass").over(Window.partitionBy())).alias("share"))


@query(with_sql("mu", """
, d AS (SELECT CAST(ts AS DATE) AS day, count(DISTINCT ts) AS hours FROM mu GROUP BY 1), g AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS day FROM orders)
SELECT strftime(max(day), '%Y-%m-%d') AS day FROM d ANTI JOIN (SELECT DATE '2024-01-30' AS day UNION SELECT day FROM g) AS x USING (day) WHERE hours = 24"""))
def gradeable_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    mu = market.shadow_prices(spark, sf_dir).withColumn("day", F.to_date("ts"))
    complete = mu.groupBy("day").agg(F.count_distinct("ts").alias("hours")).where("hours = 24")
    graded = market.table(spark, sf_dir, "orders").select(F.to_date("o_orderdate").alias("day")).union(spark.sql("SELECT DATE '2024-01-30'")).distinct()
    return boards.gradeable(mu, graded, complete).select(day_text("day").alias("day"))


@query("""
WITH w AS (SELECT l_returnflag AS series, CAST(date_trunc('week', l_shipdate) AS DATE) AS day, sum(CAST(l_quantity AS BIGINT)) AS value FROM lineitem GROUP BY 1, 2),
d AS (SELECT o_orderstatus AS s, CAST(o_orderdate AS DATE) AS day, count(*) AS value FROM orders WHERE extract('year' FROM o_orderdate) = 1996 GROUP BY 1, 2),
m AS (SELECT CASE s WHEN 'F' THEN 'A' WHEN 'O' THEN 'N' ELSE 'R' END AS series, day, value FROM d)
SELECT series, strftime(day, '%Y-%m-%d') AS day, CAST(value AS BIGINT) AS value, 'daily' AS grain FROM m UNION ALL
SELECT series, strftime(day, '%Y-%m-%d'), CAST(value AS BIGINT), 'weekly' FROM w WHERE NOT EXISTS (SELECT 1 FROM m WHERE m.series = w.series AND CAST(date_trunc('week', m.day) AS DATE) = w.day)""")
def served_first_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines, orders = market.table(spark, sf_dir, "lineitem"), market.table(spark, sf_dir, "orders")
    weekly = lines.groupBy(F.col("l_returnflag").alias("series"), F.to_date(F.date_trunc("week", "l_shipdate")).alias("week")).agg(F.sum(F.col("l_quantity").cast("long")).alias("value"))
    series = F.when(F.col("o_orderstatus") == "F", "A").when(F.col("o_orderstatus") == "O", "N").otherwise("R")
    daily = orders.where(F.year("o_orderdate") == 1996).groupBy(series.alias("series"), F.to_date("o_orderdate").alias("day")).agg(F.count(F.lit(1)).alias("value"))
    return boards.served_first(weekly, daily, ["series"]).withColumn("day", day_text("day"))


@query("""
WITH a AS (SELECT CAST(o_custkey % 50 AS BIGINT) AS g, o_orderkey AS id FROM orders WHERE o_orderpriority = '1-URGENT' AND o_custkey % 50 < 20), b AS (SELECT CAST(o_custkey % 50 AS BIGINT) AS g, o_orderkey AS id FROM orders WHERE o_orderpriority = '2-HIGH' AND o_custkey % 50 < 40),
c AS (SELECT CAST(o_custkey % 50 AS BIGINT) AS g, o_orderkey AS id FROM orders WHERE o_orderpriority = '5-LOW'),
u AS (SELECT *, 0 AS part FROM a UNION ALL SELECT *, 1 FROM b UNION ALL SELECT *, 2 FROM c), m AS (SELECT *, min(part) OVER (PARTITION BY g) AS best FROM u)
SELECT g, part, count(*) AS n, min(id) AS first_id FROM m WHERE part = best GROUP BY 1, 2""")
def scorecard_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = market.table(spark, sf_dir, "orders").select((F.col("o_custkey") % 50).alias("g"), F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("p"))
    parts = [orders.where("p = '1-URGENT' AND g < 20"), orders.where("p = '2-HIGH' AND g < 40"), orders.where("p = '5-LOW'")]
    got = boards.first_available([p.drop("p") for p in parts], ["g"])
    return got.groupBy("g", "part").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first_id"))


@query(with_sql("mu", DAILY + """
, t AS (SELECT day, sum(v) AS v FROM d GROUP BY 1), q AS (SELECT a.day, a.v, 1 + (SELECT count(*) FROM t AS b WHERE b.day < a.day AND b.v >= a.v) AS rank, a.v / (SELECT median(v) FROM t) AS ratio FROM t AS a)
SELECT strftime(day, '%Y-%m-%d') AS day, round(v, 4) AS v, CAST(rank AS INTEGER) AS rank, round(ratio, 6) AS ratio,
  CASE WHEN rank = 1 THEN 'record' WHEN rank <= 3 THEN 'near_top' WHEN ratio >= 1.25 THEN 'elevated' WHEN ratio >= 1.10 THEN 'ordinary_plus' WHEN ratio >= 0.75 THEN 'ordinary' WHEN ratio >= 0.5 THEN 'ordinary_minus' ELSE 'quiet' END AS class FROM q"""))
def magnitude_ladder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each day among the days before it. One row per day of the panel: the window is a calendar."""
    days = _daily(spark, sf_dir).groupBy("day").agg(F.sum("v").alias("v"))
    prior = F.collect_list("v").over(Window.orderBy("day").rowsBetween(Window.unboundedPreceding, -1))
    median = days.agg(F.percentile("v", 0.5).alias("median"))
    ranked = days.withColumn("rank", history.conservative_rank(F.col("v"), prior)).crossJoin(F.broadcast(median)).withColumn("ratio", F.col("v") / F.col("median"))
    return ranked.select(day_text("day").alias("day"), F.round("v", 4).alias("v"), "rank", r6("ratio").alias("ratio"), metrics.magnitude(F.col("rank"), F.col("ratio")).alias("class"))


@query("""
WITH e AS (SELECT l_orderkey AS k, l_linenumber AS ln, max(l_quantity) AS q, min(l_tax) AS t FROM lineitem WHERE l_returnflag = 'A' GROUP BY 1, 2),
b AS (SELECT l_orderkey AS k, l_linenumber AS ln, arg_max(l_quantity, (l_tax, l_quantity)) AS q, max(l_tax) AS t FROM lineitem WHERE l_returnflag = 'N' GROUP BY 1, 2)
SELECT coalesce(e.k, b.k) AS k, coalesce(e.ln, b.ln) AS ln, coalesce(b.q, e.q) AS q, coalesce(b.t, e.t) AS t FROM e FULL JOIN b ON e.k = b.k AND e.ln = b.ln""")
def upsert_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = market.table(spark, sf_dir, "lineitem")
    named = [F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("ln")]
    stored = rows.where("l_returnflag = 'A'").groupBy(*named).agg(F.max("l_quantity").alias("q"), F.min("l_tax").alias("t"))
    return writes.upsert(stored, rows.where("l_returnflag = 'N'").select(*named, F.col("l_quantity").alias("q"), F.col("l_tax").alias("t")), ["k", "ln"], "t")


@query("""
WITH e AS (SELECT o_custkey AS k, max(o_orderdate) AS posted, max(o_totalprice) AS v FROM orders WHERE o_orderstatus = 'F' GROUP BY 1), b AS (SELECT o_custkey AS k, o_orderdate AS posted, o_totalprice AS v FROM orders WHERE o_orderstatus = 'O'),
u AS (SELECT *, 0 AS turn FROM e UNION ALL SELECT *, -1 FROM b)
SELECT k, strftime(arg_max(posted, (posted, turn, v)), '%Y-%m-%d') AS posted, arg_max(v, (posted, turn, v)) AS v FROM u GROUP BY k""")
def upsert_conditional(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = market.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k"), F.col("o_orderdate").alias("posted"), F.col("o_totalprice").alias("v"), "o_orderstatus")
    stored = rows.where("o_orderstatus = 'F'").groupBy("k").agg(F.max("posted").alias("posted"), F.max("v").alias("v"))
    return writes.upsert_if_newer(stored, rows.where("o_orderstatus = 'O'"), ["k"], "posted").withColumn("posted", day_text("posted"))


@query("""
WITH b AS (SELECT o_custkey AS k, min((o_totalprice, o_orderkey)) AS r FROM orders WHERE o_orderstatus = 'O' GROUP BY 1)
SELECT k, r[1] AS v, r[2] AS id FROM b WHERE k NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 200000)""")
def insert_ignore(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = market.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k"), F.col("o_totalprice").alias("v"), F.col("o_orderkey").alias("id"), "o_orderstatus")
    stored = rows.where("o_orderstatus = 'F' AND v > 200000")
    return writes.insert_ignore(stored, rows.where("o_orderstatus = 'O'").drop("o_orderstatus"), ["k"])


@query(with_sql("mu", """
, r AS (SELECT ts, key, least(mu / 120, 1.0) AS p, mu > 60 AS y FROM mu)
SELECT CAST(least(floor(p * 10), 9) AS INTEGER) AS bin, count(*) AS n, round(avg(p), 6) AS mean_p, round(avg(CASE WHEN y THEN 1.0 ELSE 0.0 END), 6) AS rate, round(abs(avg(p) - avg(CASE WHEN y THEN 1.0 ELSE 0.0 END)), 6) AS gap FROM r GROUP BY 1"""))
def reliability_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = market.shadow_prices(spark, sf_dir).select(F.least(F.col("mu") / 120, F.lit(1.0)).alias("p"), (F.col("mu") > 60).cast("int").alias("y"))
    return metrics.reliability(rows).select("bin", "n", *(r6(c).alias(c) for c in ("mean_p", "rate", "gap")))


@query(with_sql("mu", """
, r AS (SELECT least(mu / 120, 1.0) AS p, CASE WHEN vec_id % 3 = 0 OR mu > 90 THEN 1 ELSE 0 END AS y FROM mu),
 b AS (SELECT least(floor(p * 10), 9) AS bin, count(*) AS n, abs(avg(p) - avg(y)) AS gap FROM r GROUP BY 1),
 k AS (SELECT y, rank() OVER (ORDER BY p) + (count(*) OVER (PARTITION BY p) - 1) / 2.0 AS mid FROM r)
SELECT (SELECT round(avg(power(y - p, 2)), 6) FROM r) AS brier, (SELECT round(avg(y), 6) FROM r) AS base_rate, (SELECT round(avg(p), 6) FROM r) AS mean_p, (SELECT round(sum(n * gap) / sum(n), 6) FROM b) AS ece,
  (SELECT round((sum(CASE WHEN y = 1 THEN mid END) - sum(y) * (sum(y) + 1) / 2.0) / (sum(y) * (count(*) - sum(y))), 6) FROM k) AS auc"""))
def bind_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = market.shadow_prices(spark, sf_dir).select(F.least(F.col("mu") / 120, F.lit(1.0)).alias("p"), ((F.col("vec_id") % 3 == 0) | (F.col("mu") > 90)).cast("int").alias("y"))
    return metrics.bind_metrics(rows).select(*(r6(c).alias(c) for c in ("brier", "base_rate", "mean_p", "ece", "auc")))


@query("""
WITH u AS (SELECT s_suppkey AS unit, CASE WHEN s_suppkey % 4 = 0 THEN 'C' || CAST(s_suppkey AS VARCHAR) END AS code, 'R' || CAST(s_suppkey % 30 AS VARCHAR) AS name, 'S' || CAST(s_nationkey AS VARCHAR) AS station FROM supplier),
a AS (SELECT 'C' || CAST(s_suppkey AS VARCHAR) AS key, 'N1' || CAST(s_suppkey AS VARCHAR) AS value FROM supplier WHERE s_suppkey % 8 = 0),
b AS (SELECT 'R' || CAST(n_nationkey AS VARCHAR) AS key, 'N2' || CAST(n_nationkey AS VARCHAR) AS value FROM nation WHERE n_regionkey < 2),
c AS (SELECT 'S' || CAST(c_nationkey AS VARCHAR) AS key, min(c_mktsegment) AS value FROM customer WHERE c_custkey % 40 = 0 GROUP BY 1 HAVING count(DISTINCT c_mktsegment) = 1)
SELECT unit, coalesce(a.value, b.value, c.value) AS sp, CASE WHEN a.value IS NOT NULL THEN 'code' WHEN b.value IS NOT NULL THEN 'name' WHEN c.value IS NOT NULL THEN 'station' ELSE 'none' END AS method
FROM u LEFT JOIN a ON u.code = a.key LEFT JOIN b ON u.name = b.key LEFT JOIN c ON u.station = c.key""")
def crosswalk_priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = lambda prefix, c: F.concat(F.lit(prefix), F.col(c).cast("string"))
    supplier, nation, customer = (market.table(spark, sf_dir, t) for t in ("supplier", "nation", "customer"))
    units = supplier.select(F.col("s_suppkey").alias("unit"), F.when(F.col("s_suppkey") % 4 == 0, text("C", "s_suppkey")).alias("code"), F.concat(F.lit("R"), (F.col("s_suppkey") % 30).cast("string")).alias("name"), text("S", "s_nationkey").alias("station"))
    by_code = supplier.where("s_suppkey % 8 = 0").select(text("C", "s_suppkey").alias("key"), text("N1", "s_suppkey").alias("value"))
    by_name = nation.where("n_regionkey < 2").select(text("R", "n_nationkey").alias("key"), text("N2", "n_nationkey").alias("value"))
    stations = boards.unique_only(customer.where("c_custkey % 40 = 0").select(text("S", "c_nationkey").alias("s"), "c_mktsegment"), "s", "c_mktsegment")
    found = boards.priority_lookup(units, [("code", by_code, "code"), ("name", by_name, "name"), ("station", stations, "station")])
    return found.select("unit", "sp", "method")


@query(with_sql("mu", DAILY + """
, c AS (SELECT CAST(unnest(generate_series(TIMESTAMP '2024-01-24', TIMESTAMP '2024-01-30', INTERVAL 1 DAY)) AS DATE) AS day), k AS (SELECT DISTINCT key FROM mu)
SELECT k.key, string_agg(CAST(CAST(coalesce(v, 0) * 100 AS BIGINT) AS VARCHAR), ',' ORDER BY c.day) AS cents FROM k CROSS JOIN c LEFT JOIN d ON d.key = k.key AND d.day = c.day GROUP BY k.key"""))
def daily_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seven days of each key as one ordered list, zero where it did not bind."""
    days = spark.range(1).select(F.explode(F.sequence(F.to_date(F.lit("2024-01-24")), F.to_date(F.lit("2024-01-30")), F.expr("INTERVAL 1 DAY"))).alias("day"))
    d = _daily(spark, sf_dir)
    filled = history.zero_filled(d, d.select("key").distinct(), days, "v")
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("day", "v"))), lambda x: F.round(x["v"] * 100).cast("long").cast("string"))
    return filled.groupBy("key").agg(F.array_join(ordered, ",").alias("cents"))


@query(with_sql("mu sf", TRUTH + """
, l AS (SELECT *, row_number() OVER (PARTITION BY ts ORDER BY abs(y) DESC, sp) <= ceil(count(*) OVER (PARTITION BY ts) * 0.1) AS bound FROM g)
SELECT sp, CAST(count(*) FILTER (bound) AS BIGINT) AS n_bound FROM l GROUP BY sp"""))
def top_fraction_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _graded(spark, sf_dir).withColumn("size", F.abs("y"))
    return metrics.top_fraction(rows, ["ts"], "size", 0.1, "sp").groupBy("sp").agg(F.count_if(F.col("bound")).alias("n_bound"))
