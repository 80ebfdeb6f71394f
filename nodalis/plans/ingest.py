"""Queries over postings as they come in."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nodalis.functions import clock
from nodalis.plans.registry import day_text, query, stamp
from nodalis.sources import market
from nodalis.streaming import sides

CT = "((ts AT TIME ZONE 'UTC') AT TIME ZONE 'America/Chicago')"


@query(f"""
WITH p AS (SELECT CAST({CT} AS DATE) + 1 AS day, CASE WHEN hour({CT}) < 10 THEN 'study' ELSE 'final' END AS side, ts, event_id FROM events)
SELECT strftime(day, '%Y-%m-%d') AS day, side, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS posted, arg_max(event_id, (ts, event_id)) AS doc, count(*) AS postings FROM p GROUP BY p.day, side""")
def study_final_sides(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as postings for the day after theirs: the newest of each side."""
    events = market.table(spark, sf_dir, "events")
    postings = events.select(F.date_add(clock.delivery_date(F.col("ts")), 1).alias("day"), F.col("ts").alias("posted"), F.col("event_id").alias("doc"))
    return sides.sides(postings).select(day_text("day").alias("day"), "side", stamp("posted").alias("posted"), "doc", "postings")
