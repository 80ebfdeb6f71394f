"""The market relations, read from the star-schema tables.

Every relation is a DataFrame and has the same definition as a common table expression in ``SQL``,
so that a query's SQL can be put together from the relations it reads. Money is summed as decimals:
results do not depend on the order of rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

CENTS = "decimal(18,2)"

SQL = {
    "mu": """mu AS (
  SELECT date_trunc('hour', ts) AS ts, CAST(user_id AS VARCHAR) || '|' || CASE WHEN user_id % 10 = 0 THEN 'BASE CASE' ELSE 'N1' END AS key,
         user_id AS vec_id, CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS mu
  FROM events WHERE value IS NOT NULL GROUP BY 1, 2, 3)""",
    "spp": """spp AS (
  SELECT l_shipdate AS ts, 'SP' || CAST(l_suppkey AS VARCHAR) AS sp, l_returnflag = 'R' AS dst_flag,
         CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) / CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS price
  FROM lineitem GROUP BY 1, 2, 3)""",
    "lam": """lam AS (
  SELECT l_shipdate AS ts, l_returnflag = 'R' AS dst_flag,
         CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) / CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS slam
  FROM lineitem GROUP BY 1, 2)""",
    "vintage": """vintage AS (
  SELECT o_orderdate AS posted, l_shipdate AS ts, l_orderkey AS doc, l_linenumber AS line, 'Z' || CAST(l_suppkey % 8 AS VARCHAR) AS zone, l_extendedprice AS mw
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey)""",
    "sf": """sf AS (
  SELECT vec_id, CAST(vec_id AS VARCHAR) || '|' || CASE WHEN vec_id % 10 = 0 THEN 'BASE CASE' ELSE 'N1' END AS key,
         'N' || CAST(i AS VARCHAR) AS sp, i AS place, CAST(embedding[i + 1] AS DOUBLE) AS sf, label
  FROM embeddings, (SELECT unnest(range(64)) AS i))""",
    "geo": """geo AS (
  SELECT 'N' || CAST(i AS VARCHAR) AS sp, i AS place, n_name AS zone, 26.0 + (i % 8) * 0.75 AS lat, -104.0 + (i // 8) * 1.25 AS lon,
         CASE i % 3 WHEN 0 THEN 69.0 WHEN 1 THEN 138.0 ELSE 345.0 END AS kv
  FROM (SELECT unnest(range(64)) AS i) JOIN nation ON n_nationkey = i % 5)""",
    "cong": """spp1 AS (SELECT ts, sp, arg_min(price, dst_flag) AS price FROM spp GROUP BY 1, 2),
lam1 AS (SELECT ts, arg_min(slam, dst_flag) AS slam FROM lam GROUP BY 1),
cong AS (SELECT ts, sp, price, slam, price - slam AS c FROM spp1 JOIN lam1 USING (ts))""",
}


def with_sql(names: str, select: str) -> str:
    """A query over relations, given by their names in order."""
    return "WITH " + ",\n".join(SQL[n] for n in names.split()) + "\n" + select


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table with its wall-clock timestamps read as instants (the session zone is UTC).

    The schema says so, rather than a cast, and filters on time reach the scan."""
    path = f"{sf_dir}/{name}.parquet"
    found = spark.read.parquet(path).schema
    fields = [T.StructField(f.name, T.TimestampType() if isinstance(f.dataType, T.TimestampNTZType) else f.dataType, f.nullable) for f in found]
    return spark.read.schema(T.StructType(fields)).parquet(path)


def _key(number: str):
    return F.concat(F.col(number).cast("string"), F.lit("|"), F.when(F.col(number) % 10 == 0, "BASE CASE").otherwise("N1"))


def _money(column: str):
    return F.sum(F.col(column).cast(CENTS)).cast("double")


def shadow_prices(spark: SparkSession, sf_dir: str, by_key: bool = False) -> DataFrame:
    """(ts, key, vec_id, mu): hourly shadow prices; an hour without a row is an hour without binding. ``by_key``: dealt
    out by key before the hours are summed, so that a grouping by key needs no exchange of its own."""
    rows = table(spark, sf_dir, "events").where("value IS NOT NULL")
    rows = rows.select(F.date_trunc("hour", "ts").alias("ts"), _key("user_id").alias("key"), F.col("user_id").alias("vec_id"), "value")
    return (rows.repartition("key") if by_key else rows).groupBy("ts", "key", "vec_id").agg(_money("value").alias("mu"))


def hours(spark: SparkSession, sf_dir: str) -> int:
    """The number of hours that have a shadow price."""
    return table(spark, sf_dir, "events").where("value IS NOT NULL").select(F.date_trunc("hour", "ts")).distinct().count()


def prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(ts, sp, dst_flag, price): settlement-point prices."""
    rows = table(spark, sf_dir, "lineitem")
    keys = [F.col("l_shipdate").alias("ts"), F.concat(F.lit("SP"), F.col("l_suppkey").cast("string")).alias("sp"), (F.col("l_returnflag") == "R").alias("dst_flag")]
    return rows.groupBy(*keys).agg((_money("l_extendedprice") / _money("l_quantity")).alias("price"))


def price_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(ts, sp, dst_flag, money, volume): the decimals from which both price relations derive."""
    rows = table(spark, sf_dir, "lineitem")
    keys = [F.col("l_shipdate").alias("ts"), F.concat(F.lit("SP"), F.col("l_suppkey").cast("string")).alias("sp"), (F.col("l_returnflag") == "R").alias("dst_flag")]
    return rows.groupBy(*keys).agg(F.sum(F.col("l_extendedprice").cast(CENTS)).alias("money"), F.sum(F.col("l_quantity").cast(CENTS)).alias("volume"))


def system_lambda(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(ts, dst_flag, slam): the system price."""
    rows = table(spark, sf_dir, "lineitem")
    return rows.groupBy(F.col("l_shipdate").alias("ts"), (F.col("l_returnflag") == "R").alias("dst_flag")).agg((_money("l_extendedprice") / _money("l_quantity")).alias("slam"))


def vintages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(posted, ts, doc, line, zone, mw): forecasts of a delivery instant, as posted at some time."""
    lines, orders = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    return lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.col("o_orderdate").alias("posted"), F.col("l_shipdate").alias("ts"), F.col("l_orderkey").alias("doc"), F.col("l_linenumber").alias("line"),
        F.concat(F.lit("Z"), (F.col("l_suppkey") % 8).cast("string")).alias("zone"), F.col("l_extendedprice").alias("mw"),
    )


def shift_factors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(vec_id, key, sp, place, sf, label): constraint by node, long."""
    rows = table(spark, sf_dir, "embeddings")
    return rows.select("vec_id", _key("vec_id").alias("key"), "label", F.posexplode("embedding").alias("place", "x")).select(
        "vec_id", "key", F.concat(F.lit("N"), F.col("place").cast("string")).alias("sp"), F.col("place").cast("long").alias("place"), F.col("x").cast("double").alias("sf"), "label"
    )


def geography(spark: SparkSession, sf_dir: str, nodes: int = 64) -> DataFrame:
    """(sp, place, zone, lat, lon, kv): one row for each of the matrix's nodes; a bounded table."""
    place = F.col("id")
    nation = table(spark, sf_dir, "nation")
    return spark.range(nodes).join(nation, F.col("n_nationkey") == place % 5).select(
        F.concat(F.lit("N"), place.cast("string")).alias("sp"), place.alias("place"), F.col("n_name").alias("zone"),
        (F.lit(26.0) + (place % 8) * F.lit(0.75)).alias("lat"), (F.lit(-104.0) + F.floor(place / 8) * F.lit(1.25)).alias("lon"),
        F.when(place % 3 == 0, 69.0).when(place % 3 == 1, 138.0).otherwise(345.0).alias("kv"),
    )
