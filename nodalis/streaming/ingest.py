"""Incremental ingest with Structured Streaming: late data, vintages, idempotent merges.

A keyed table is kept in buckets of its keys' hashes. A batch rewrites only the buckets that it has
rows of, under a folder of its own, and then writes the new list of buckets and their folders as one
small file. A batch that is run again after a failure starts from the same list and ends in the same
one; folders that neither the newest list nor the one before it names are deleted.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nodalis.operators import writes

Merge = Callable[[DataFrame, DataFrame], DataFrame]


BUCKETS = 64


def _files(spark: SparkSession, folder: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path


def _there(spark: SparkSession, folder: str) -> bool:
    files, path = _files(spark, folder)
    return files.exists(path)


def _numbers(spark: SparkSession, folder: str, done: bool) -> list[int]:
    """Numbers of the folders batch=N, in order; only finished ones if ``done``."""
    files, path = _files(spark, folder)
    if not files.exists(path):
        return []
    found = [s.getPath() for s in files.listStatus(path) if s.getPath().getName().startswith("batch=")]
    finished = [p for p in found if not done or files.exists(spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))]
    return sorted(int(p.getName().removeprefix("batch=")) for p in finished)


def _state(spark: SparkSession, folder: str) -> tuple[int, dict[int, int]]:
    """The newest merged batch and, for each bucket, the batch whose folder holds it."""
    numbers = _numbers(spark, f"{folder}/state", done=True)
    if not numbers:
        return -1, {}
    return numbers[-1], {r["bucket"]: r["batch"] for r in spark.read.parquet(f"{folder}/state/batch={numbers[-1]}").select("bucket", F.col("version").alias("batch")).collect()}


def _read(spark: SparkSession, folder: str, schema: str, held: dict[int, int]) -> DataFrame:
    paths = [f"{folder}/data/batch={batch}/_bucket={bucket}" for bucket, batch in sorted(held.items())]
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def current(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """The table's rows, empty before the first batch."""
    return _read(spark, folder, schema, _state(spark, folder)[1])


def merge_into(folder: str, schema: str, merge: Merge, keys: list[str], buckets: int = BUCKETS) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that merges every batch once."""
    bucket = F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")

    def apply(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        last, held = _state(spark, folder)
        if last >= batch_id:
            return
        batch = batch.persist()
        touched = [r["b"] for r in batch.select(bucket.alias("b")).distinct().collect()]  # at most ``buckets``
        if touched:
            stored = _read(spark, folder, schema, {b: held[b] for b in touched if b in held})
            merged = merge(stored, batch).withColumn("_bucket", bucket)
            merged.repartition("_bucket").write.mode("overwrite").partitionBy("_bucket").parquet(f"{folder}/data/batch={batch_id}")
        now = held | {b: batch_id if _there(spark, f"{folder}/data/batch={batch_id}/_bucket={b}") else None for b in touched}
        now = {b: version for b, version in now.items() if version is not None}
        spark.createDataFrame(sorted(now.items()), "bucket int, version long").coalesce(1).write.mode("overwrite").parquet(f"{folder}/state/batch={batch_id}")
        batch.unpersist()
        _tidy(spark, folder, {*held.values(), *now.values()}, {last, batch_id})

    return apply


def _tidy(spark: SparkSession, folder: str, data: set[int], states: set[int]) -> None:
    """Delete what neither of the two newest states needs. A folder with any bucket in use stays whole."""
    for name, kept in (("data", data), ("state", states)):
        for number in _numbers(spark, f"{folder}/{name}", done=False):
            if number not in kept:
                files, path = _files(spark, f"{folder}/{name}/batch={number}")
                files.delete(path, True)


def upsert_stream(stream: DataFrame, folder: str, schema: str, keys: list[str], order: str | None = None, posted: str | None = None):
    """Start a run over what is available; ``posted`` makes stored rows yield to later postings only."""

    def merge(stored: DataFrame, batch: DataFrame) -> DataFrame:
        return writes.upsert_if_newer(stored, batch, keys, posted) if posted else writes.upsert(stored, batch, keys, order)

    return stream.writeStream.foreachBatch(merge_into(folder, schema, merge, keys)).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()


def hourly_mean(stream: DataFrame, ts: str, keys: list[str], value: str, late: str = "7 days") -> DataFrame:
    """Mean of a quarter-hour series by hour; rows later than ``late`` are no longer waited for."""
    return stream.withWatermark(ts, late).groupBy(F.window(ts, "1 hour"), *keys).agg(F.avg(value).alias(value), F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("hour"), *keys, value, "n")


def latest_before_close(stream_or_table: DataFrame, hours: int = 2, fallback: int = 8) -> DataFrame:
    """Of the postings in the hours before a day's close, the newest; a wider look back where there is none."""
    from nodalis.functions.clock import dam_close, delivery_date

    close = dam_close(delivery_date(F.col("ts")))
    rows = stream_or_table.withColumn("_close", close).where((F.col("posted") < F.col("_close")) & (F.col("posted") >= F.timestamp_add("HOUR", F.lit(-fallback), F.col("_close"))))
    near = F.col("posted") >= F.timestamp_add("HOUR", F.lit(-hours), F.col("_close"))
    rest = [c for c in stream_or_table.columns if c != "ts"]
    best = rows.groupBy("ts").agg(F.max_by(F.struct(*rest), F.struct(near.alias("near"), F.col("posted"))).alias("_row"))
    return best.select("ts", "_row.*")
