"""Geography and crosswalk tables from CSV files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nodalis.functions.fields import point_type
from nodalis.operators.boards import unique_only
from nodalis.sources.files import read_csv


def points(spark: SparkSession, coordinates: str, metadata: str) -> DataFrame:
    """(settlement_point, lat, lon, zone, kv). Reading raises where no point at all has a zone."""
    left = read_csv(spark, coordinates, "settlement_point string, lat double, lon double")
    right = read_csv(spark, metadata, "resource_node string, zone string, kv double").dropDuplicates(["resource_node"])
    joined = left.join(right, F.col("settlement_point") == F.col("resource_node"), "left").drop("resource_node")
    if joined.where("zone IS NOT NULL").limit(1).count() == 0:
        raise ValueError("no settlement point has a zone")
    return joined


def typed(names: DataFrame, metadata: DataFrame) -> DataFrame:
    """Points (sp) with the type their metadata or, failing that, their name gives."""
    return names.join(metadata.select("sp", "kind"), "sp", "left").withColumn("kind", F.coalesce("kind", point_type(F.col("sp"))))


def crosswalk(registry: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Unit code to point, and substation to point where that is the only one. Registry: substation, unit, sp."""
    units = registry.select(F.concat_ws("_", "substation", "unit").alias("code"), "sp")
    return unique_only(units, "code", "sp"), unique_only(registry, "substation", "sp")


def county(name):
    """A county's name in capitals without its suffix."""
    return F.trim(F.regexp_replace(F.upper(F.trim(name)), r"\s+(COUNTY|PARISH)$", ""))
