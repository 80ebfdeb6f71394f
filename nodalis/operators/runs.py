"""Operators around runs: provenance, absent nodes, selections led by nodes, studies of arms and draws."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from nodalis.functions import clock
from nodalis.operators import metrics, panels


def absent_reason(asked: DataFrame, points: DataFrame) -> DataFrame:
    """(day, sp, reason) for asked (day, sp) pairs: null where the day has a point of the node, otherwise
    whether the day has points of other nodes, so that the node was out of service, or none at all."""
    own = points.select("day", "sp").distinct().withColumn("_own", F.lit(True))
    days = points.select("day").distinct().withColumn("_day", F.lit(True))
    joined = asked.select("day", "sp").distinct().join(own, ["day", "sp"], "left").join(days, "day", "left")
    reason = F.when(F.col("_own").isNull(), F.when(F.col("_day"), "sp_not_in_service").otherwise("sp_not_in_fit"))
    return joined.select("day", "sp", reason.alias("reason"))


def provenance(asked: DataFrame, artifacts: DataFrame, windows: DataFrame) -> DataFrame:
    """(run_id, day, artifact_day, basis, map_run_id, window_start, window_end) for asked (run_id, day).

    The artifact is that of the day, else the nearest before it. Its window is the one stored with it
    (map_run_id, window_start and window_end of ``artifacts``, null where none is), else the newest
    window of the newest map run that ended by the artifact's day."""
    stored = artifacts.select("run_id", F.col("day").cast("timestamp").alias("at"), F.struct(F.col("day").alias("artifact_day"), "map_run_id", "window_start", "window_end").alias("found"))
    left = asked.select("run_id", "day", F.col("day").cast("timestamp").alias("_ts"))
    met = panels.as_of(left, stored, ["run_id"], "_ts", "at", ["found"]).select("run_id", "day", "found.*")
    newest = windows.agg(F.max_by("run_id", F.struct("window_start", "run_id")).alias("run_id"))  # one row
    causal = windows.join(F.broadcast(newest), "run_id").select(F.lit(1).alias("_one"), F.col("window_end").cast("timestamp").alias("at"), F.struct(F.col("run_id").alias("r"), F.col("window_start").alias("s"), F.col("window_end").alias("e")).alias("w"))
    best = causal.groupBy("_one", "at").agg(F.max_by("w", F.struct("w.s")).alias("w"))
    days = met.where("artifact_day IS NOT NULL AND map_run_id IS NULL").select(F.lit(1).alias("_one"), "artifact_day", F.col("artifact_day").cast("timestamp").alias("_ts")).distinct()
    replayed = panels.as_of(days, best, ["_one"], "_ts", "at", ["w"]).select("artifact_day", "w")
    joined = met.join(replayed, "artifact_day", "left")
    basis = F.when(F.col("artifact_day") == F.col("day"), "artifact").when(F.col("artifact_day").isNotNull(), "nearest_past")
    pick = lambda name, short: F.when(F.col("map_run_id").isNotNull(), F.col(name)).otherwise(F.col(f"w.{short}")).alias(name)
    return joined.select("run_id", "day", "artifact_day", basis.alias("basis"), pick("window_start", "s"), pick("window_end", "e"), F.coalesce("map_run_id", "w.r").alias("map_run_id"))


def fit_metadata(resolved: DataFrame, windows: DataFrame, metrics: list[str]) -> DataFrame:
    """Resolved provenance with the fit's metrics of its window, and whether there are any."""
    meta = windows.select(F.col("run_id").alias("map_run_id"), "window_start", *metrics, F.lit(True).alias("_there"))
    return resolved.join(meta, ["map_run_id", "window_start"], "left").withColumn("available", F.coalesce("_there", F.lit(False))).drop("_there")


def missing_metric(windows: DataFrame, metric: str) -> DataFrame:
    """(run_id, n): how many windows of each run still lack a metric."""
    return windows.groupBy("run_id").agg(F.count_if(F.col(metric).isNull()).alias("n"))


def nodes_major(sf: DataFrame, mu: DataFrame, rows: int, columns: int, pinned_rows: tuple[str, ...] = (), pinned_columns: tuple[str, ...] = (), search: str | None = None, most_found: int = 20) -> DataFrame:
    """(sp, place, score): the nodes of a view led by nodes.

    Its constraints are the pinned ones, else the one with the largest shadow price; nodes are ordered by
    their largest shift factor on those. The first ``rows`` of them (of those that hold ``search``, if
    given) come first, as many as leave room for the others, then pinned nodes, then the best
    ``most_found`` that hold ``search``, in all ``columns`` at most."""
    if pinned_rows:
        shown = sf.where(F.col("key").isin(*pinned_rows))
    else:
        known = mu.join(sf.select("key").distinct(), "key", "left_semi").groupBy("key").agg(F.sum(F.abs("mu")).alias("size"))
        shown = sf.join(F.broadcast(known.orderBy(F.desc("size"), "key").limit(1).select("key")), "key", "left_semi")
    score = sf.select("sp").distinct().join(shown.groupBy("sp").agg(F.max(F.abs("sf")).alias("score")), "sp", "left").fillna(0.0, ["score"])
    order = [F.desc("score"), F.asc("sp")]
    ranked = score.withColumn("rank", F.row_number().over(Window.orderBy(*order)))  # one row for each node
    matches = F.lit(True) if search is None else F.lower("sp").contains(search.lower())
    found = ranked.where(matches).orderBy(*order).limit(most_found).withColumn("found", F.lit(True)) if search is not None else ranked.limit(0).withColumn("found", F.lit(True))
    marked = ranked.join(found.select("sp", "found"), "sp", "left").withColumn("found", F.coalesce("found", F.lit(False)))
    pin = F.array_position(F.array(*map(F.lit, pinned_columns)), F.col("sp")) if pinned_columns else F.lit(0)
    own = (F.col("rank") <= rows) & (F.col("found") if search is not None else F.lit(True))
    marked = marked.withColumn("base", own).withColumn("pin", pin).where("base OR found OR pin > 0")
    room = F.greatest(F.lit(columns) - F.count_if(~F.col("base")).over(Window.partitionBy(F.lit(1))), F.lit(1))
    marked = marked.withColumn("room", room).withColumn("turn", F.row_number().over(Window.partitionBy("base").orderBy("rank")))
    part = F.when(F.col("base") & (F.col("turn") <= F.col("room")), 0).when(F.col("pin") > 0, 1).when(F.col("found"), 2)
    parts = marked.withColumn("part", part).where("part IS NOT NULL").withColumn("within", F.when(F.col("part") == 1, F.col("pin")).otherwise(F.col("rank")))
    return parts.withColumn("place", F.row_number().over(Window.orderBy("part", "within"))).where(F.col("place") <= columns).select("sp", "place", "score")


def refit_boundaries(days: DataFrame, train_days: int, refit_days: int, score_from: str | None = None, anchor: str | None = None) -> DataFrame:
    """(refit_ts, day): local midnights every ``refit_days`` calendar days, before the panel's last day.

    ``score_from`` is the first boundary itself and needs ``train_days`` of history before it, otherwise
    the first week would be scored after a short training: reading the grid then raises. Without it the
    grid begins ``train_days`` after ``anchor`` or the panel's first day. Steps are made on local dates, so
    that they stay at midnight over changes of the clock."""
    span = days.agg(F.min("day").alias("first"), F.max("day").alias("last"))
    if score_from is not None:
        begin = F.lit(score_from).cast("date")
        short = F.date_sub(begin, train_days) < F.col("first")
        message = F.concat(F.lit(f"score_from={score_from} needs {train_days} days of history, the panel starts "), F.col("first").cast("string"))
        span = span.where(F.when(short, F.raise_error(message).cast("boolean")).otherwise(F.lit(True)))
    else:
        begin = F.date_add(F.lit(anchor).cast("date") if anchor else F.col("first"), train_days)
    grid = span.where(begin < F.col("last")).select(F.explode(F.sequence(begin, F.date_sub("last", 1), F.expr(f"INTERVAL {refit_days} DAYS"))).alias("day"))
    return grid.select(clock.midnight(F.col("day")).alias("refit_ts"), "day")


RANKS = (50, 75, 90, 95, 99)


def rank_stats(draws: DataFrame, by: list[str], value: str) -> DataFrame:
    """The same draws read six ways: mean, median and four upper percentiles of each group."""
    got = draws.groupBy(*by).agg(F.avg(value).alias("mean"), F.percentile(value, [q / 100 for q in RANKS]).alias("_p"))
    return got.select(*by, "mean", *(F.col("_p")[i].alias(f"p{q}") for i, q in enumerate(RANKS)))


def grouping_verdict(weekly: DataFrame, guards: list[str], bar: float = 0.10, guard: float = 0.01, guard_r2: float = 0.01) -> DataFrame:
    """One row for each grouped arm (rho_min) of weekly rows: its gain in stability over its control, its
    losses against the arm 'ungrouped', and whether it passes the bar and the guards."""
    means = ["stability", "control", "r2", "groups", "constraints", *guards]
    arms = weekly.groupBy("rho_min").agg(*(F.avg(m).alias(m) for m in means))
    base = arms.where("rho_min = 'ungrouped'").select(F.col("r2").alias("_r2"), *(F.col(g).alias(f"_{g}") for g in guards))
    joined = arms.where("rho_min <> 'ungrouped'").crossJoin(F.broadcast(base))  # one row
    losses = {"r2": guard_r2, **dict.fromkeys(guards, guard)}
    fine = F.lit(True)
    for name, least in losses.items():
        fine = fine & (F.col(name) - F.col(f"_{name}") >= -least)
    delta = F.col("stability") - F.col("control")
    return joined.select("rho_min", (F.col("constraints") / F.greatest("groups", F.lit(1.0))).alias("compression"), delta.alias("delta"), *((F.col(n) - F.col(f"_{n}")).alias(f"d_{n}") for n in losses), (delta >= bar).alias("pass_stability"), fine.alias("pass_guard"))


def zscore(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """``rows`` with ``z``, the value in population deviations from its group's mean; null in a constant
    group, of which nothing is known."""
    group = Window.partitionBy(*by)
    away = F.stddev_pop(value).over(group)
    return rows.withColumn("z", F.when(away > 0, (F.col(value) - F.avg(value).over(group)) / away))


def persistence_share(outages: DataFrame, by: list[str], days: int) -> DataFrame:
    """(total, still, share): megawatts of each snapshot, and of those whose planned end lies at least
    ``days`` after the snapshot (posted, ends, mw)."""
    still = F.when(F.col("ends") >= F.date_add(F.to_date("posted"), days).cast("timestamp"), F.col("mw"))
    got = outages.groupBy(*by).agg(F.sum("mw").alias("total"), F.coalesce(F.sum(still), F.lit(0)).alias("still"))
    return got.withColumn("share", F.col("still") / F.nullif("total", F.lit(0)))


def outage_signal(exposure: DataFrame, sizes: DataFrame) -> DataFrame:
    """(day, n, spearman): how a day's exposures (day, key, exposure) order what bound (day, key, size).

    A key without a size did not bind and counts as zero; days without any spread are left out."""
    both = exposure.join(sizes, ["day", "key"], "left").withColumn("size", F.coalesce("size", F.lit(0.0)))
    return metrics.spearman(both, ["day"], "exposure", "size")


def weekly_rows(scores: DataFrame, sources: DataFrame, counts: tuple[str, ...], run_id: str) -> DataFrame:
    """Scores (source, ...) as rows to store: the source's id from ``sources`` (source, source_id), counts as
    integers, NaN as null. A source without an id is an error, not a lost row."""
    joined = scores.join(sources.select("source", "source_id"), "source", "left")
    kept = F.when(F.col("source_id").isNull(), F.raise_error(F.concat(F.lit("no id for source "), F.coalesce("source", F.lit("null"))))).otherwise(F.col("source_id"))
    fields = [F.nanvl(c, F.lit(None).cast("double")).alias(c) if t in ("double", "float") and c not in counts else F.col(c).cast("long").alias(c) if c in counts else F.col(c) for c, t in scores.dtypes if c != "source"]
    return joined.select(F.lit(run_id).alias("run_id"), kept.alias("source_id"), *fields)


def pending_days(asked: DataFrame, stored: DataFrame, by: list[str]) -> DataFrame:
    """The asked rows that no stored artifact answers yet."""
    return asked.join(stored.select(*by).distinct(), by, "left_anti")


def newest_days(stored: DataFrame, until: str, count: int) -> DataFrame:
    """(day): the newest ``count`` days up to ``until``, oldest first."""
    return stored.where(F.col("day") <= F.to_date(F.lit(until))).select("day").distinct().orderBy(F.desc("day")).limit(count).orderBy("day")


def arm_deltas(weekly: DataFrame, arm: str, metric: str, baseline: str) -> DataFrame:
    """(arm, mean, delta): each arm's mean and its distance from the baseline arm's."""
    means = weekly.groupBy(arm).agg(F.avg(metric).alias("mean"))
    base = means.where(F.col(arm) == baseline).select(F.col("mean").alias("_base"))
    return means.crossJoin(F.broadcast(base)).select(arm, "mean", (F.col("mean") - F.col("_base")).alias("delta"))  # one row


#: Words of a technology's label and the source they mean, the first that fits. Fixed values.
TECHNOLOGIES = (
    ("SOLAR", "solar"), ("PHOTOVOLTAIC", "solar"), ("WIND", "wind"), ("BATTERY", "battery"), ("STORAGE", "battery"), ("COMBINED CYCLE", "gas"),
    ("GAS TURBINE", "gas"), ("COAL", "coal"), ("NUCLEAR", "nuclear"), ("HYDRO", "hydro"),
)


def plant_source(technology: Column, code: Column, codes: dict[str, str]) -> Column:
    """A plant's source from its technology's label, else from its fuel code."""
    label = F.upper(F.coalesce(technology, F.lit("")))
    out = F.coalesce(*(F.when(F.upper(F.trim(code)) == c, s) for c, s in codes.items())) if codes else F.lit(None).cast("string")
    for word, source in reversed(TECHNOLOGIES):
        out = F.when(label.contains(word), source).otherwise(out)
    return out
