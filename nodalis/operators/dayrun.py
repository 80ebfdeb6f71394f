"""The run of one forecast day: fit, guard, project, judge, keep, and only then serve.

A run's tables lie in a folder of their own, written before anything points to them. What is served of
a day is the newest of its pointer's versions; a version is a file that only one writer can create, so
a run that began from an older version cannot replace what another run has published meanwhile. A run
that is stopped between data and pointer leaves the old run served, and may be run again. Runs that are
turned down are kept with the reason.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from datetime import date, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nodalis.operators import features, models, projection


class Ledger:
    """Runs and pointers of forecast days under a folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _path(self, *parts: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path("/".join([self.folder, *parts]))

    def _files(self):
        path = self._path("x")
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _names(self, *parts: str) -> list[str]:
        files, path = self._files(), self._path(*parts)
        return sorted(s.getPath().getName() for s in files.listStatus(path)) if files.exists(path) else []

    def _read(self, *parts: str) -> dict:
        stream = self._files().open(self._path(*parts))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def _create(self, value: dict, *parts: str) -> bool:
        """Create a small file at once, whole; false if there is one already."""
        files, path = self._files(), self._path(*parts)
        draft = self._path("drafts", f"{'-'.join(parts)}-{self.spark._jvm.java.util.UUID.randomUUID()}")
        stream = files.create(draft, True)
        stream.write(bytearray(json.dumps(value).encode()))
        stream.close()
        files.mkdirs(path.getParent())
        if files.exists(path):
            files.delete(draft, False)
            return False
        none = self.spark._jvm.java.lang.reflect.Array.newInstance(self.spark._jvm.java.lang.Class.forName("org.apache.hadoop.fs.Options$Rename"), 0)
        context = self.spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(path.toUri(), self.spark._jsc.hadoopConfiguration())
        try:
            context.rename(files.makeQualified(draft), files.makeQualified(path), none)  # never over a file
        except Exception as e:
            if "FileAlreadyExists" not in str(e):
                raise
            files.delete(draft, False)
            return False
        return True

    def pointer(self, day: str) -> tuple[int, str | None]:
        """(version, run) that is served of a day; (0, None) before the first."""
        versions = self._names("pointers", day)
        return (int(versions[-1]), self._read("pointers", day, versions[-1])["run"]) if versions else (0, None)

    def swap(self, day: str, seen: int, run: str) -> bool:
        """Serve ``run`` if the pointer is still at version ``seen``."""
        return self._create({"run": run}, "pointers", day, f"{seen + 1:09d}")

    def keep(self, day: str, run: str, tables: dict[str, DataFrame]) -> None:
        for name, rows in tables.items():
            rows.write.mode("overwrite").parquet(f"{self.folder}/runs/{day}/{run}/{name}")

    def table(self, day: str, run: str, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/runs/{day}/{run}/{name}")

    def served(self, day: str, name: str) -> DataFrame | None:
        run = self.pointer(day)[1]
        return self.table(day, run, name) if run else None

    def conclude(self, day: str, run: str, verdict: str, reason: str = "") -> None:
        """Note a run's end. The first note stands, unless a run that was turned down is run again."""
        number = len(self._names("verdicts", day)) + 1
        while not self._create({"run": run, "verdict": verdict, "reason": reason}, "verdicts", day, f"{number:09d}"):
            number += 1

    def verdicts(self, day: str) -> list[dict]:
        return [self._read("verdicts", day, n) for n in self._names("verdicts", day)]


def day_inference(panel: DataFrame, day: str, columns: list[str], train_days: int = 240, **settings) -> tuple[DataFrame, DataFrame]:
    """Predictions (ts, key, p_bind, mu_gbm, mu) of a day from the days before it, and its keys that never bound in them.

    The panel holds (day, ts, key, y_bind, y_mu) and the feature columns."""
    start = (date.fromisoformat(day) - timedelta(days=train_days)).isoformat()
    train = panel.where((F.col("day") >= start) & (F.col("day") < day))
    today = panel.where(F.col("day") == day)
    known = train.where("y_bind = 1").select("key").distinct()
    score = today.join(known, "key", "left_semi")
    found = models.mu_head(train, models.bind_head(train, score, columns, **settings), columns, **settings)
    novel = today.select("key").distinct().join(known, "key", "left_anti")
    return found.select("ts", "key", "p_bind", "mu_gbm", (F.col("p_bind") * F.col("mu_gbm")).alias("mu")), novel


def forecast_day(
    ledger: Ledger, run: str, day: str, panel: DataFrame, columns: list[str], sf: DataFrame, meta: DataFrame, fallback: Callable[[], DataFrame] | None = None, train_days: int = 240, **settings
) -> bool:
    """Make a day's forecast and serve it; whether it is served.

    ``sf`` are the maps by window_start, ``meta`` their list. Without a map that may be used, ``fallback``
    fits one (key, sp, sf). Turned down, with the reason kept, are a day without rows to score, without a
    map, or with a projection that is empty or the same everywhere, and a run that another one overtook.
    A run that is already served is left as it is."""
    seen, serving = ledger.pointer(day)
    if serving == run:
        return True

    def refuse(reason: str) -> bool:
        ledger.conclude(day, run, "rejected", reason)
        return False

    predictions, novel = day_inference(panel, day, columns, train_days, **settings)
    ledger.keep(day, run, {"predictions": predictions, "novel": novel})
    predictions = ledger.table(day, run, "predictions")
    if predictions.isEmpty():
        return refuse("no rows to score")
    try:
        own, kind = features.guarded(sf, meta, predictions, day), "map"
    except LookupError as e:
        if fallback is None:
            return refuse(str(e))
        own, kind = fallback(), "fallback"
    points = projection.project(predictions.select("ts", "key", "mu"), own.select("key", "sp", "sf"))
    ledger.keep(day, run, {"points": points.withColumn("map", F.lit(kind))})
    points = ledger.table(day, run, "points")
    if points.isEmpty():
        return refuse("the projection is empty")
    if not projection.flat_days(points.withColumn("day", F.lit(day))).isEmpty():
        return refuse("the projection is the same everywhere")
    if not ledger.swap(day, seen, run):
        return refuse(f"overtaken by {ledger.pointer(day)[1]}")
    ledger.conclude(day, run, "served")
    return True


def walk_forward(panel: DataFrame, folds: list[tuple[str, str, str]], columns: list[str], folder: str, **settings) -> DataFrame | None:
    """Predictions of every fold (train_from, score_from, score_to), each written when it is done; a walk that
    was stopped goes on with the folds that have no finished table. None if no fold has any."""
    spark = panel.sparkSession
    files = Ledger(spark, folder)
    done = []
    for fold in folds:
        name = f"fold-{fold[1]}"
        if "_SUCCESS" not in files._names(name):
            found = models.walk_forward(panel, [fold], columns, **settings)
            if found is None:
                continue
            found.write.mode("overwrite").parquet(f"{folder}/{name}")
        done.append(f"{folder}/{name}")
    return spark.read.parquet(*done) if done else None
