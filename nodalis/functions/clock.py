"""Central-time clock helpers as column expressions. Instants are UTC; the session zone is UTC."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ZONE = "America/Chicago"
DAM_CLOSE_HOUR = 10
MOST_RANGE_HOURS = 336


def local(ts: Column) -> Column:
    """The wall-clock time of an instant."""
    return F.from_utc_timestamp(ts, ZONE)


def delivery_date(ts: Column) -> Column:
    return F.to_date(local(ts))


def local_hour(ts: Column) -> Column:
    return F.hour(local(ts))


def midnight(day: Column) -> Column:
    """The instant at which a delivery day begins."""
    return F.to_utc_timestamp(day.cast("timestamp"), ZONE)


def day_bounds(day: Column) -> tuple[Column, Column]:
    """First instant of a delivery day, and of the next one."""
    return midnight(day), midnight(F.date_add(day, 1))


def dam_close(day: Column) -> Column:
    """10:00 local time on the day before delivery: what is posted later is unknown to a forecast."""
    return F.to_utc_timestamp(F.date_sub(day, 1).cast("timestamp") + F.expr(f"INTERVAL {DAM_CLOSE_HOUR} HOURS"), ZONE)


def hours_of(day: Column) -> Column:
    """All instants on the hour of a delivery day: 23, 24 or 25."""
    first, following = day_bounds(day)
    return F.sequence(first, following - F.expr("INTERVAL 1 HOUR"), F.expr("INTERVAL 1 HOUR"))


def hour_ending_to_utc(day: Column, hour_ending: Column, interval: Column, dst_flag: Column) -> Column:
    """Start of an hour-ending period (and quarter) in UTC. In the hour that occurs twice, ``dst_flag``
    marks the second pass; Spark reads an ambiguous wall clock as the first one."""
    wall = F.timestamp_add("MINUTE", (hour_ending - 1) * 60 + (interval - 1) * 15, day.cast("timestamp_ntz"))
    first = F.to_utc_timestamp(wall.cast("timestamp"), ZONE)
    later = F.timestamp_add("HOUR", F.lit(1), first)
    twice = local(later).cast("timestamp_ntz") == wall
    return F.when(twice & dst_flag, later).otherwise(first)


def fire_time(day: Column, horizon: Column) -> Column:
    """When a forecast of a delivery day was due: 17:00Z the day before, or 20:15Z two days before."""
    final = F.date_sub(day, 1).cast("timestamp") + F.expr("INTERVAL 17 HOURS")
    preview = F.date_sub(day, 2).cast("timestamp") + F.expr("INTERVAL '20:15' HOUR TO MINUTE")
    return F.when(horizon == 1, final).otherwise(preview)


def calendar_features(df: DataFrame, ts: str = "ts") -> DataFrame:
    """Local hour, weekday (Monday 0), month, weekend flag, and the hour on a circle."""
    hour = local_hour(F.col(ts))
    dow = F.weekday(local(F.col(ts)))
    angle = hour * (2 * math.pi / 24)
    return df.select(
        "*", hour.alias("hour_ct"), dow.alias("dow"), F.month(local(F.col(ts))).alias("month"),
        (dow >= 5).cast("int").alias("is_weekend"), F.sin(angle).alias("hour_sin"), F.cos(angle).alias("hour_cos"),
    )


def hour_grid(spark: SparkSession, start: str, end: str) -> DataFrame:
    """One row for every hour in [start, end]; both are UTC literals."""
    check_range(start, end)
    return spark.range(1).select(F.explode(F.sequence(F.to_timestamp(F.lit(start)), F.to_timestamp(F.lit(end)), F.expr("INTERVAL 1 HOUR"))).alias("ts"))


def check_range(start: str, end: str, most_hours: int = MOST_RANGE_HOURS) -> None:
    """Raise unless start <= end and the span is at most ``most_hours``."""
    from datetime import datetime

    hours = (datetime.fromisoformat(end) - datetime.fromisoformat(start)).total_seconds() / 3600
    if hours < 0 or hours > most_hours:
        raise ValueError(f"a range must run forward over at most {most_hours} hours")


def refit_grid(days: DataFrame, step: int, anchor: str, day: str = "day") -> DataFrame:
    """(refit_start): boundaries every ``step`` days, in phase with ``anchor``, that cover all days."""
    phase = F.pmod(F.datediff(F.min(day), F.lit(anchor).cast("date")), F.lit(step))
    bounds = days.agg(F.date_sub(F.min(day), phase.cast("int")).alias("low"), F.max(day).alias("high"))
    return bounds.select(F.explode(F.sequence("low", "high", F.expr(f"INTERVAL {step} DAYS"))).alias("refit_start"))
