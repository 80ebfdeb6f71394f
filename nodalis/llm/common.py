"""Helpers the training-data operators share: table access, the shared folder, staged tables."""

from __future__ import annotations

import tempfile
import uuid
from functools import cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"
_folders: set[str] = set()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@cache
def _own_folder() -> str:
    return "file://" + tempfile.mkdtemp(prefix="nodalis-shared-")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: the cluster's spark.checkpoint.dir.

    A temporary folder of our own is used only where the setting is absent and the master local, as in
    tests; a cluster without the setting is refused, as its executors would not see each other's files.
    """
    if not spark.conf.get("spark.checkpoint.dir", None) and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    path = spark._jvm.org.apache.hadoop.fs.Path(spark.conf.get("spark.checkpoint.dir", None) or _own_folder())
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString().rstrip("/")


def fresh_path(spark: SparkSession, label: str) -> str:
    """A new path for a table that this application's later stages read.

    It lies in a folder of the application, which goes when the driver's JVM ends."""
    folder = f"{shared_dir(spark)}/nodalis/{spark.sparkContext.applicationId}"
    if folder not in _folders:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        files = path.getFileSystem(spark._jsc.hadoopConfiguration())
        files.mkdirs(path)
        files.deleteOnExit(path)
        _folders.add(folder)
    return f"{folder}/{label}-{uuid.uuid4().hex}"


def staged(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    This cuts the lineage with a table that outlives any executor, keeps column pruning for
    later readers, and makes sure that the work above is done once.
    """
    spark = df.sparkSession
    path = fresh_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def text_or_empty(column: str = "text"):
    return F.coalesce(F.col(column), F.lit(""))


#: Bits of a bitmap of keys: 512 pieces of 4 KB, whatever the number of keys.
MAP_BITS = 1 << 24


def _bit(key: str):
    return F.pmod(F.xxhash64(key), F.lit(MAP_BITS)) + 1


def bitmap(keys: DataFrame, column: str) -> DataFrame:
    """(piece, bits): a bitmap of the hashed keys of ``column``; at most ``MAP_BITS`` bits, 2 MB, in all."""
    at = keys.select(_bit(column).alias("at")).distinct()
    return at.groupBy(F.bitmap_bucket_number("at").alias("piece")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("bits"))


def with_membership(rows: DataFrame, column: str, maps: dict[str, DataFrame]) -> DataFrame:
    """``rows`` with one boolean for each named bitmap: false only if the key of ``column`` is surely not
    among its keys. Each map meets the rows by a broadcast, so rows stay where they are."""
    named = rows.withColumn("_at", _bit(column))
    place = F.bitmap_bit_position("_at")
    for name, found in maps.items():
        pieces = found.select(F.col("piece").alias("_piece"), F.col("bits").alias("_bits"))
        byte = F.conv(F.hex(F.expr("substring(_bits, cast(_place div 8 as int) + 1, 1)")), 16, 10).cast("int")
        held = byte.bitwiseAND(F.expr("shiftleft(1, cast(_place % 8 as int))")) != 0
        met = named.withColumn("_place", place).join(F.broadcast(pieces), F.bitmap_bucket_number("_at") == F.col("_piece"), "left")
        named = met.withColumn(name, F.coalesce(held, F.lit(False))).drop("_piece", "_bits", "_place")
    return named.drop("_at")


def without_keys(rows: DataFrame, column: str, keys: DataFrame) -> DataFrame:
    """``rows`` without those whose ``column`` (null included) is among the distinct values of the
    one-column table ``keys``. Only rows that a bitmap of the keys cannot clear are shuffled."""
    kept = keys.select(F.col(keys.columns[0]).alias("gone"))
    held = with_membership(rows.select(F.col(column).alias("key"), F.struct(*rows.columns).alias("row")), "key", {"may": staged(bitmap(kept, "gone"), "bitmap")})
    doubtful = held.where("may").join(kept, F.col("key").eqNullSafe(F.col("gone")), "left_anti")
    return held.where("NOT may").select("row.*").unionByName(doubtful.select("row.*"))


def only_keys(rows: DataFrame, column: str, keys: DataFrame) -> DataFrame:
    """The rows that ``without_keys`` leaves out, found in the same way."""
    kept = keys.select(F.col(keys.columns[0]).alias("here"))
    held = with_membership(rows.select(F.col(column).alias("key"), F.struct(*rows.columns).alias("row")), "key", {"may": staged(bitmap(kept, "here"), "bitmap")})
    return held.where("may").join(kept, F.col("key").eqNullSafe(F.col("here")), "left_semi").select("row.*")
