"""Write semantics as DataFrame merges: the state after a batch, and its idempotent persistence."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def upsert(existing: DataFrame, batch: DataFrame, keys: list[str], order: str | None = None) -> DataFrame:
    """The batch's row wins; within the batch the one with the highest ``order`` does."""
    rest = [c for c in existing.columns if c not in keys]
    parts = existing.withColumn("_turn", F.lit(0)).unionByName(batch.select(existing.columns).withColumn("_turn", F.lit(1)))
    newest = F.struct("_turn", *([order] if order else []), F.struct(*rest))
    return parts.groupBy(*keys).agg(F.max_by(F.struct(*rest), newest).alias("_row")).select(*keys, "_row.*").select(existing.columns)


def upsert_if_newer(existing: DataFrame, batch: DataFrame, keys: list[str], posted: str) -> DataFrame:
    """A stored row yields only to a later posting; equal postings keep what is stored."""
    rest = [c for c in existing.columns if c not in keys]
    parts = existing.withColumn("_turn", F.lit(0)).unionByName(batch.select(existing.columns).withColumn("_turn", F.lit(-1)))
    newest = F.struct(posted, "_turn", F.struct(*rest))
    return parts.groupBy(*keys).agg(F.max_by(F.struct(*rest), newest).alias("_row")).select(*keys, "_row.*").select(existing.columns)


def insert_ignore(existing: DataFrame, batch: DataFrame, keys: list[str]) -> DataFrame:
    """The batch's rows whose key is new, one per key; append them."""
    rest = [c for c in batch.columns if c not in keys]
    once = batch.groupBy(*keys).agg(F.min(F.struct(*rest)).alias("_row")).select(*keys, "_row.*")
    return once.join(existing.select(*keys), keys, "left_anti").select(batch.columns)


def replace_scope(df: DataFrame, path: str, scope: list[str], scopes: DataFrame | None = None) -> None:
    """Overwrite the partitions that ``df`` has rows of; a rerun leaves the same rows.

    ``scopes`` lists all partitions (scope columns) that this load speaks for: those without a row in
    ``df`` are deleted, so a rerun that finds nothing for a day takes the old day away. The two steps are not
    one: after a crash between them emptied scopes still hold old rows until the load is run again.
    Readers that must never see that go through a pointer, as ``publish`` or a ``dayrun.Ledger`` writes it."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*scope).parquet(path)
    if scopes is not None:
        empty = scopes.select(*scope).distinct().join(df.select(*scope).distinct(), scope, "left_anti")
        delete_scopes(df.sparkSession, path, [r.asDict() for r in empty.collect()])  # a load's own list of scopes


def delete_scopes(spark: SparkSession, path: str, scopes: list[dict]) -> None:
    """Delete the partitions of a table that match a scope; one that names only the outer partition
    columns, as a run, takes everything below them."""
    escape = spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName
    for one in scopes:
        parts = [f"{k}={'__HIVE_DEFAULT_PARTITION__' if v is None else escape(str(v))}" for k, v in one.items()]
        folder = spark._jvm.org.apache.hadoop.fs.Path("/".join([path.rstrip("/"), *parts]))
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def open_windows(wanted: DataFrame, ledger: DataFrame, keys: list[str]) -> DataFrame:
    """Windows without a completion; a fetch of no rows does not complete one."""
    return wanted.join(ledger.where("rows_fetched > 0").select(*keys), keys, "left_anti")


def asserted(df: DataFrame, **checks: str) -> DataFrame:
    """``df``; reading a row that breaks a named SQL condition raises. Null conditions pass, as in a database."""
    out = df
    for name, condition in checks.items():
        out = out.where(F.when(~F.coalesce(F.expr(condition), F.lit(True)), F.raise_error(F.lit(f"check {name} failed")).cast("boolean")).otherwise(F.lit(True)))
    return out


def publish(points: DataFrame, artifacts: dict[str, DataFrame], pointer: DataFrame, folder: str, scope: list[str]) -> None:
    """Data first, the pointer last: readers that go through the pointer never see half a run."""
    replace_scope(points, f"{folder}/forecast_nodal", scope)
    for name, rows in artifacts.items():
        replace_scope(rows, f"{folder}/{name}", scope)
    pointer.coalesce(1).write.mode("overwrite").parquet(f"{folder}/forecast_current")
