"""The registry of queries: a function (spark, sf_dir) -> DataFrame and, where SQL can say the same, its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a function under its own name."""

    def add(function: Query) -> Query:
        QUERIES[function.__name__] = function
        if sql:
            ORACLES[function.__name__] = sql
        return function

    return add


def stamp(ts: str | Column) -> Column:
    """An instant as text, so that results compare without time zones."""
    return F.date_format(ts, "yyyy-MM-dd HH:mm:ss")


def day_text(day: str | Column) -> Column:
    return F.date_format(day, "yyyy-MM-dd")


def r6(value: str | Column) -> Column:
    return F.round(value, 6)
