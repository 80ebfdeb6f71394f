"""Out-of-sample evaluation of rolling maps: fits, scores, decay, sweeps, diagnostics."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nodalis.operators import metrics, models, projection
from nodalis.operators.graphs import cut


def score_windows(maps: DataFrame, mu: DataFrame, cong: DataFrame, fit_days: int, score_days: int) -> DataFrame:
    """(window_start, r2, coverage): each map on the days after its fit. All weeks are one job: hours are
    laid out to the windows that score them."""
    starts = maps.select("window_start").distinct().withColumn("day", F.explode(F.sequence(F.date_add("window_start", fit_days), F.date_add("window_start", fit_days + score_days - 1), F.expr("INTERVAL 1 DAY"))))
    own = mu.withColumn("day", F.to_date("ts")).join(F.broadcast(starts), "day")
    points = own.join(maps.select("window_start", "key", "sp", "sf"), ["window_start", "key"]).groupBy("window_start", "ts", "sp").agg((-F.sum(F.col("mu") * F.col("sf"))).alias("point"))
    fit = models.r2_by_window(points, cong)
    known = maps.select("window_start", "key").distinct().withColumn("known", F.lit(True))
    covered = own.join(known, ["window_start", "key"], "left").groupBy("window_start").agg((F.sum(F.when(F.col("known"), F.abs("mu")).otherwise(0.0)) / F.sum(F.abs("mu"))).alias("coverage"))
    return fit.join(covered, "window_start", "full")


def diagnostics(sf: DataFrame, mu: DataFrame, cong: DataFrame) -> DataFrame:
    """(sp, n, r2) of a map on the hours it was fitted on."""
    rows = projection.project(mu, sf).withColumnRenamed("point", "y_hat").join(cong.withColumnRenamed("c", "y"), ["ts", "sp"])
    return metrics.pooled_r2(rows, ["sp"])


def decay(maps: DataFrame, lags: list[int]) -> DataFrame:
    """(lag_days, r): mean correlation of maps that lie so far apart."""
    parts = [models.sf_stability(maps, lag, least=1).agg(F.avg("r").alias("r"), F.count(F.lit(1)).alias("pairs")).withColumn("lag_days", F.lit(lag)) for lag in lags]
    return reduce(DataFrame.unionByName, parts).select("lag_days", "r", "pairs")


def sweep(mu: DataFrame, cong: DataFrame, windows: DataFrame, grid: list[dict], fit_days: int, score_days: int) -> DataFrame:
    """Mean out-of-sample fit and coverage of every setting of the ridge; all settings share the windows' sums,
    unless there are more keys than hours."""
    parts, sums = [], None if models.many_keys(mu, windows) else cut(models.window_sums(mu, cong, windows))
    for setting in grid:
        maps = models.rolling_ridge(mu, cong, windows, **setting) if sums is None else models.solve_windows(sums, **setting)
        scored = score_windows(maps, mu, cong, fit_days, score_days).agg(F.avg("r2").alias("r2"), F.avg("coverage").alias("coverage"))
        parts.append(scored.withColumn("setting", F.lit(", ".join(f"{k}={v}" for k, v in sorted(setting.items())))))
    return reduce(DataFrame.unionByName, parts)


def source_scores(truth: DataFrame, sources: dict[str, DataFrame], sf: DataFrame) -> DataFrame:
    """(source, spearman, topdecile, sign_agree): every source of shadow prices through one map."""
    parts = []
    for name, mu in sources.items():
        points = projection.project(mu, sf).withColumnRenamed("point", "y_hat")
        rows = truth.join(points, ["ts", "sp"], "left").fillna(0.0, ["y_hat"])
        parts.append(metrics.screening(rows, ["ts"], "sp").withColumn("source", F.lit(name)))
    return reduce(DataFrame.unionByName, parts)


def identical(rows: DataFrame, by: list[str], value: str, tolerance: float = 1e-9) -> DataFrame:
    """Groups whose values differ by more than the tolerance; baselines must have none."""
    return rows.groupBy(*by).agg((F.max(value) - F.min(value)).alias("gap")).where(F.col("gap") > tolerance)


def grams(left: DataFrame, right: DataFrame, by: str) -> DataFrame:
    """(by, a, b, v): products of two maps' rows (by, key, sp, sf), summed over nodes."""
    a, b = left.select(by, "sp", F.col("key").alias("a"), F.col("sf").alias("x")), right.select(by, "sp", F.col("key").alias("b"), F.col("sf").alias("y"))
    return a.join(b, [by, "sp"]).groupBy(by, "a", "b").agg(F.sum(F.col("x") * F.col("y")).alias("v"))


def angles_of(own: np.ndarray, other: np.ndarray, cross: np.ndarray, rank: int) -> list[float]:
    """Principal angles in degrees between the leading ``rank`` directions of two sets of rows, from their grams."""

    def half(gram: np.ndarray) -> np.ndarray:
        values, vectors = np.linalg.eigh(gram)
        lead = [i for i in np.argsort(-values)[:rank] if values[i] > 1e-10 * max(values.max(), 1e-300)]
        return vectors[:, lead] / np.sqrt(values[lead])

    cosines = np.linalg.svd(half(own).T @ cross @ half(other), compute_uv=False)
    return np.degrees(np.arccos(np.clip(cosines, 0.0, 1.0))).tolist()


def rotation(windows: DataFrame, lag_days: int, rank: int = 3) -> DataFrame:
    """(window_start, angles, largest): how far a map (window_start, key, sp, sf) has turned against the one
    ``lag_days`` later, as principal angles between their leading directions over the nodes.

    Products are summed in Spark; a window's task sees square matrices over its keys only."""
    later = windows.withColumn("window_start", F.date_sub("window_start", lag_days))
    both = windows.select("window_start").distinct().join(later.select("window_start").distinct(), "window_start")
    now, then = windows.join(both, "window_start"), later.join(both, "window_start")
    parts = [grams(x, y, "window_start").withColumn("kind", F.lit(kind)) for kind, x, y in (("own", now, now), ("other", then, then), ("cross", now, then))]

    def turned(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        kinds = {k: g.pivot(index="a", columns="b", values="v").fillna(0.0) for k, g in rows.groupby("kind")}
        own, other = (kinds[k] for k in ("own", "other"))
        cross = kinds["cross"].reindex(index=own.index, columns=other.index).fillna(0.0) if "cross" in kinds else pd.DataFrame(0.0, index=own.index, columns=other.index)
        found = angles_of(own.reindex(columns=own.index).to_numpy(), other.reindex(columns=other.index).to_numpy(), cross.to_numpy(), rank)
        return pd.DataFrame({"window_start": [key[0]], "angles": [found], "largest": [max(found, default=None)]})

    return reduce(DataFrame.unionByName, parts).groupBy("window_start").applyInPandas(turned, "window_start date, angles array<double>, largest double")
