"""Composed views: forecast range, fallbacks, outages, frames, standouts, grades by source, the daily brief."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from nodalis.functions import clock
from nodalis.operators import metrics


def lowest_horizon(rows: DataFrame, keys: list[str], horizon: str = "horizon") -> DataFrame:
    """One row per key: the one of the lowest horizon."""
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.min_by(F.struct(*rest), horizon).alias("_row")).select(*keys, "_row.*")


def with_fallback(wanted: DataFrame, settled: DataFrame, value: str = "slam") -> DataFrame:
    """Each hour's settled value, else that of the same local hour on the latest settled day, else null; and
    where it is from. The curve that falls back has 24 rows."""
    days = settled.withColumn("day", clock.delivery_date(F.col("ts")))
    latest = days.agg(F.max("day").alias("latest"))
    curve = days.crossJoin(F.broadcast(latest)).where("day = latest").groupBy(clock.local_hour(F.col("ts")).alias("hour")).agg(F.min_by(value, "ts").alias("curve"))
    joined = wanted.join(settled, "ts", "left").withColumn("hour", clock.local_hour(F.col("ts"))).join(F.broadcast(curve), "hour", "left")
    source = F.when(F.col(value).isNotNull(), "settled").when(F.col("curve").isNotNull(), "persisted")
    return joined.select(*wanted.columns, F.coalesce(value, "curve").alias(value), source.alias("source"))


def outages_at(outages: DataFrame, at: Column, by: str) -> DataFrame:
    """Megawatts out at an instant by bucket, and in total (null bucket)."""
    out = outages.where((F.col("start") <= at) & (F.coalesce(F.col("end") > at, F.lit(True))))
    return out.rollup(by).agg(F.sum("mw").alias("mw"), F.count(F.lit(1)).alias("units"))


def located_share(rows: DataFrame, mw: str = "mw") -> DataFrame:
    """Megawatts by the method that located them, and the located share of all."""
    total = Window.partitionBy()
    by = rows.groupBy("method").agg(F.sum(mw).alias("mw"))
    found = F.sum(F.when(F.col("method") != "none", F.col("mw")).otherwise(0.0)).over(total)
    return by.withColumn("share", F.col("mw") / F.sum("mw").over(total)).withColumn("located", found / F.sum("mw").over(total))


def frame(terms: DataFrame, rows: int, columns: int, pins: tuple[str, ...] = (), search: str | None = None) -> DataFrame:
    """A rectangle of constraints by nodes (key, sp, contribution, row_rank, column_rank, row_total).

    Pinned keys come first, then keys whose name holds ``search``, by size; columns by size over the rows
    shown. Ranks see one row per key or node."""
    keys = terms.groupBy("key").agg(F.sum(F.abs("contribution")).alias("size"), F.sum("contribution").alias("row_total"))
    wanted = keys if search is None else keys.where(F.lower("key").contains(search.lower()) | F.col("key").isin(*pins))
    pinned = F.when(F.col("key").isin(*pins), 0).otherwise(1) if pins else F.lit(1)
    top = wanted.withColumn("pinned", pinned).orderBy("pinned", F.desc("size"), "key").limit(rows)
    top = top.withColumn("row_rank", F.row_number().over(Window.orderBy("pinned", F.desc("size"), "key")))
    shown = terms.join(top.select("key", "row_rank", "row_total"), "key")
    nodes = shown.groupBy("sp").agg(F.sum(F.abs("contribution")).alias("size")).orderBy(F.desc("size"), "sp").limit(columns)
    nodes = nodes.withColumn("column_rank", F.row_number().over(Window.orderBy(F.desc("size"), "sp")))
    return shown.join(nodes.select("sp", "column_rank"), "sp").select("key", "sp", "contribution", "row_rank", "column_rank", "row_total")


def board(parts: dict[str, DataFrame], settled: DataFrame) -> DataFrame:
    """Keys that any part names, with the parts as flags and the rank among all settled rows; unranked keys last."""
    labelled = reduce(DataFrame.unionByName, (p.select("key", F.lit(n).alias("part")) for n, p in parts.items()))
    flags = labelled.groupBy("key").agg(*(F.max(F.col("part") == n).alias(n) for n in parts))
    ranked = settled.withColumn("settled_rank", F.row_number().over(Window.orderBy(F.desc("v"), F.asc_nulls_last("key")))).select("key", "settled_rank")
    joined = flags.join(ranked, "key", "left")
    return joined.withColumn("place", F.row_number().over(Window.orderBy(F.asc_nulls_last("settled_rank"), "key")))


def group_agreement(ours: DataFrame, theirs: DataFrame) -> DataFrame:
    """Precision and recall of groups (sp, grp) of two or more members, restricted to nodes both know.

    Sizes are compared, not members: two groups are equal if their overlap is as large as each."""
    both = ours.select("sp", F.col("grp").alias("a")).join(theirs.select("sp", F.col("grp").alias("b")), "sp")
    mine, other, overlap = (both.groupBy(*c).agg(F.count(F.lit(1)).alias(n)) for c, n in ((["a"], "na"), (["b"], "nb"), (["a", "b"], "nab")))
    hit = overlap.join(mine, "a").join(other, "b").where("nab = na AND nab = nb AND nab >= 2").agg(F.count(F.lit(1)).alias("hits"))
    totals = mine.where("na >= 2").agg(F.count(F.lit(1)).alias("n_ours")).crossJoin(other.where("nb >= 2").agg(F.count(F.lit(1)).alias("n_theirs")))
    return hit.crossJoin(totals).select("hits", "n_ours", "n_theirs", (F.col("hits") / F.nullif("n_ours", F.lit(0))).alias("precision"), (F.col("hits") / F.nullif("n_theirs", F.lit(0))).alias("recall"))


def grade_sources(universe: DataFrame, settled: DataFrame, sources: dict[str, DataFrame]) -> DataFrame:
    """(source, ap, rate, skill, overlap): each source's (key, v) against the settled one over one universe of
    keys; a settled row counts as bound even at 0, keys without any row are 0 and unbound."""
    truth = universe.join(settled.select("key", F.col("v").alias("settled"), F.lit(True).alias("bound")), "key", "left")
    filled = [truth.join(s.select("key", F.col("v").alias("predicted")), "key", "left").withColumn("source", F.lit(n)) for n, s in sources.items()]
    rows = reduce(DataFrame.unionByName, filled).fillna(0.0, ["predicted", "settled"]).fillna(False, ["bound"])
    ap = metrics.expected_ap(rows, ["source"], "predicted", "bound")
    overlap = metrics.soft_overlap(rows, ["source"]).select("source", "overlap")
    return ap.join(overlap, "source").withColumn("skill", metrics.chance_adjusted(F.col("ap"), F.col("rate")))


def window_counts(daily: DataFrame, days: int, value: str = "n") -> DataFrame:
    """Trailing sums by differences of running sums: each length costs one join, not one window."""
    running = daily.withColumn("run", F.sum(value).over(Window.partitionBy("key").orderBy("day")))
    earlier = running.select("key", F.date_add("day", days).alias("day"), F.col("run").alias("before"))
    order = Window.partitionBy("key").orderBy("day", "side").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    marked = running.select("key", "day", "run", F.lit(None).cast("long").alias("before"), F.lit(1).alias("side")).unionByName(earlier.select("key", "day", F.lit(None).cast("long").alias("run"), "before", F.lit(0).alias("side")))
    last = F.coalesce(F.last("before", ignorenulls=True).over(order), F.lit(0))
    return marked.withColumn("gone", last).where("side = 1").select("key", "day", (F.col("run") - F.col("gone")).alias(f"n_{days}d"))


def local_extreme(rows: DataFrame, by: list[str], value: str, fraction: float = 0.01, least: int = 500) -> DataFrame:
    """The ceil(fraction * n)-th highest value of each group of at least ``least``."""
    group = Window.partitionBy(*by)
    placed = rows.withColumn("_n", F.count(value).over(group)).where(F.col("_n") >= least).withColumn("_p", F.row_number().over(group.orderBy(F.desc(value))))
    return placed.where(F.col("_p") == F.ceil(F.col("_n") * fraction)).select(*by, F.col(value).alias("threshold"))


def novelty(mu: DataFrame, cut: str, warm_days: int) -> DataFrame:
    """(tier, keys, mass): keys after ``cut`` by what was seen of them: lately, before, or never."""
    at = F.lit(cut).cast("timestamp")
    before = mu.where(F.col("ts") < at).groupBy("key").agg(F.max("ts").alias("last"))
    after = mu.where(F.col("ts") >= at).groupBy("key").agg(F.sum(F.abs("mu")).alias("mass"))
    tier = F.when(F.col("last").isNull(), "new").when(F.datediff(at, "last") <= warm_days, "warm").otherwise("seen")
    return after.join(before, "key", "left").groupBy(tier.alias("tier")).agg(F.count(F.lit(1)).alias("keys"), F.sum("mass").alias("mass"))


def exposure(sf: DataFrame, outages: DataFrame, block: int = 256, calendar: int = 4) -> DataFrame:
    """(day, key, exposure): the sum over a day's outages of abs(sf) at their node times megawatts.

    Blocks of days meet blocks of keys, each couple in one task that multiplies them: terms by node do not
    travel, only nodes' megawatts and shift factors, once for each block of the other side."""
    blocks = 1 + sf.agg(F.approx_count_distinct("key")).first()[0] // block
    per_node = outages.groupBy("day", "sp").agg(F.sum("mw").cast("double").alias("mw"))
    days = per_node.select(F.pmod(F.xxhash64("day"), F.lit(calendar)).cast("int").alias("d"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("k"), "day", "sp", "mw")
    keys = sf.select(F.explode(F.sequence(F.lit(0), F.lit(calendar - 1))).alias("d"), F.pmod(F.xxhash64("key"), F.lit(blocks)).cast("int").alias("k"), "key", "sp", F.abs("sf").cast("double").alias("sf"))

    def multiply(at: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        nodes = np.intersect1d(left["sp"].to_numpy(str), right["sp"].to_numpy(str))
        if not len(nodes):
            return pd.DataFrame(columns=["day", "key", "exposure"])
        sides = []
        for rows, name, value in ((left, "day", "mw"), (right, "key", "sf")):
            rows = rows[rows["sp"].isin(nodes)]
            i, names = pd.factorize(rows[name])
            x, there = np.zeros((len(names), len(nodes))), np.zeros((len(names), len(nodes)), np.float32)
            j = np.searchsorted(nodes, rows["sp"].to_numpy(str))
            np.add.at(x, (i, j), rows[value].to_numpy(float))
            there[i, j] = 1
            sides.append((names, x, there))
        (a, x, p), (b, y, q) = sides
        i, j = np.nonzero(p @ q.T)
        return pd.DataFrame({"day": np.asarray(a)[i], "key": np.asarray(b)[j], "exposure": (x @ y.T)[i, j]})

    known, listed = days.where("day IS NOT NULL AND sp IS NOT NULL AND mw IS NOT NULL"), keys.where("key IS NOT NULL AND sp IS NOT NULL AND sf IS NOT NULL")
    return known.groupBy("d", "k").cogroup(listed.groupBy("d", "k")).applyInPandas(multiply, f"day {outages.schema['day'].dataType.simpleString()}, key string, exposure double")


def regime(percentile: Column) -> Column:
    return F.when(percentile >= 100, "record").when(percentile >= 95, "extreme").when(percentile <= 5, "calm").otherwise("typical")


def where_class(share: Column) -> Column:
    """How far one zone leads."""
    return F.when(share >= 0.55, "concentrated").when(share >= 0.45, "leaning").otherwise("spread")


def exceptions(count: Column) -> Column:
    return F.when(count == 0, "none").when(count <= 2, "few").otherwise("many")


def verdict(forecast: Column, settled: Column, ladder: tuple[str, ...]) -> Column:
    """held, close or missed by the distance of two rungs."""
    rungs = F.array(*map(F.lit, ladder))
    gap = F.abs(F.array_position(rungs, forecast) - F.array_position(rungs, settled))
    return F.when(gap == 0, "held").when(gap == 1, "close").otherwise("missed")


def sentence(day: Column, size: Column, zone: Column, share: Column, new: Column) -> Column:
    """The brief's headline."""
    lead = F.when(size == "record", "Heaviest congestion on record").when(size.isin("near_top", "elevated"), "Heavy congestion").when(size == "quiet", "Light congestion").otherwise("Ordinary congestion")
    tail = F.when(new == 0, "no unmapped constraints").when(new == 1, "one unmapped constraint").otherwise(F.concat(new.cast("string"), F.lit(" unmapped constraints")))
    return F.concat(day, F.lit(": "), lead, F.lit(", "), zone, F.lit(" leads with "), F.round(share * 100).cast("int").cast("string"), F.lit("%; "), tail)
