"""Draws from an empirical pool of errors.

The pool is every finite error in log space of hours that bound, none left out. Ranks are made without
one task seeing the pool: values are dealt into ranges, each range numbers its own, and what lies before
a range comes from one count a range. A draw hashes its own names to a rank and meets the value there,
so reruns agree, whatever the partitions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from nodalis.operators.graphs import cut
from nodalis.operators.models import uniform

RANGES = 64


def pool(rows: DataFrame) -> DataFrame:
    """``rows`` that bound (y_bind, y_mu, mu_gbm) with their error eps = log1p(y_mu) - log1p(max(mu_gbm, 0))."""
    eps = F.log1p("y_mu") - F.log1p(F.greatest(F.lit(0.0), F.col("mu_gbm")))
    found = rows.where("y_bind = 1 AND y_mu IS NOT NULL AND mu_gbm IS NOT NULL").withColumn("eps", eps)
    return found.where(~F.isnan("eps") & (F.abs("eps") < float("inf")))


def ranked(rows: DataFrame, value: str, ties: list[str], ranges: int = RANGES) -> DataFrame:
    """``rows`` with their rank (from 0) by ``value``, then ``ties``, which should tell all rows apart."""
    dealt = cut(rows.repartitionByRange(ranges, value, *ties).withColumn("_range", F.spark_partition_id()))
    counts = dealt.groupBy("_range").agg(F.count(F.lit(1)).alias("n"))
    before = counts.withColumn("_before", F.sum("n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))).drop("n")  # one row for each range
    order = Window.partitionBy("_range").orderBy(value, *ties)
    own = dealt.withColumn("_own", F.row_number().over(order) - 1).join(F.broadcast(before), "_range")
    return own.withColumn("rank", F.coalesce("_before", F.lit(0)) + F.col("_own")).drop("_range", "_own", "_before")


def drawn(rows: DataFrame, ranks: DataFrame, names: list[str], seed: int = 42) -> DataFrame:
    """``rows`` with an error eps drawn from the ranked pool (rank, eps) by the hash of their ``names``; 0 from an
    empty pool."""
    n = ranks.count()
    if not n:
        return rows.withColumn("eps", F.lit(0.0))
    at = F.least(F.floor(uniform(*(F.col(c) for c in names), seed) * n).cast("long"), F.lit(n - 1))
    return rows.withColumn("rank", at).join(ranks.select("rank", "eps"), "rank").drop("rank")


def draws(predictions: DataFrame, sf: DataFrame, ranks: DataFrame, n: int, seed: int = 42) -> DataFrame:
    """(draw, ts, sp, point): projections of n draws of Bernoulli(p_bind) times expm1(log1p(mu_gbm) + eps), at least 0."""
    laid = predictions.withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    bound = laid.where(uniform(F.col("ts"), F.col("key"), F.col("draw"), seed + 1) < F.col("p_bind"))
    mu = F.greatest(F.lit(0.0), F.expm1(F.log1p(F.greatest(F.lit(0.0), F.col("mu_gbm"))) + F.col("eps")))
    errors = drawn(bound, ranks, ["ts", "key", "draw"], seed).select("draw", "ts", "key", mu.alias("mu"))
    return errors.join(sf.select("key", "sp", "sf"), "key").groupBy("draw", "ts", "sp").agg((-F.sum(F.col("mu") * F.col("sf"))).alias("point"))
