"""Shift-factor projection: expected shadow prices through a constraint-by-node matrix, kept long."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def expected_mu(predictions: DataFrame, on: tuple[str, ...] = ("ts", "key")) -> DataFrame:
    """(ts, key, mu): the product of the mean probability and the mean size of repeated predictions."""
    return predictions.groupBy(*on).agg((F.avg("p_bind") * F.avg("mu_gbm")).alias("mu"))


def contributions(mu: DataFrame, sf: DataFrame, keep_zero: bool = False) -> DataFrame:
    """(ts, sp, key, contribution): -mu * sf for the keys both sides know. The join is on the key alone;
    both sides are plain scans, so that Spark can split a key that most rows share."""
    terms = mu.join(sf.select("key", "sp", "sf"), "key").withColumn("contribution", -F.col("mu") * F.col("sf"))
    return terms if keep_zero else terms.where("contribution <> 0")


def project(mu: DataFrame, sf: DataFrame) -> DataFrame:
    """(ts, sp, point): the nodes' congestion; partial sums form before the shuffle."""
    return contributions(mu, sf, keep_zero=True).groupBy("ts", "sp").agg(F.sum("contribution").alias("point"))


def _ranked(df: DataFrame, by: list[str], order: list[Column]) -> DataFrame:
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order)))


def node_drivers(terms: DataFrame, k: int = 10) -> DataFrame:
    """The k largest terms of every (ts, sp) by size, ties by key."""
    return _ranked(terms, ["ts", "sp"], [F.abs("contribution").desc(), F.col("key").asc()]).where(F.col("rank") <= k)


def dominant_driver(terms: DataFrame, by: tuple[str, ...] = ("sp",)) -> DataFrame:
    """The largest term of each group and its share of the gross total. Terms are summed per key first."""
    totals = terms.groupBy(*by, "key").agg(F.sum("contribution").alias("v"))
    # max_by on (size, reversed key order) would need a second pass; the smallest key of the largest size is the minimum of (-size, key)
    best = totals.groupBy(*by).agg(F.min(F.struct(-F.abs("v"), F.col("key").alias("key"), F.col("v").alias("v"))).alias("b"), F.sum(F.abs("v")).alias("gross"))
    return best.select(*by, F.col("b.key").alias("key"), F.col("b.v").alias("contribution"), (F.abs("b.v") / F.nullif("gross", F.lit(0.0))).alias("share"))


def reach(sf: DataFrame, min_frac: float, floor: float, k: int) -> DataFrame:
    """A constraint's nodes with abs(sf) >= max(min_frac * its largest, floor); the k first, and whether that cut any."""
    by_key = Window.partitionBy("key")
    above = sf.withColumn("peak", F.max(F.abs("sf")).over(by_key)).where(F.abs("sf") >= F.greatest(F.col("peak") * min_frac, F.lit(floor)))
    counted = above.withColumn("n_nodes", F.count(F.lit(1)).over(by_key))
    return _ranked(counted, ["key"], [F.abs("sf").desc(), F.col("sp").asc()]).where(F.col("rank") <= k).withColumn("truncated", F.col("n_nodes") > k)


def ranked_constraints(mu: DataFrame, sf: DataFrame, k: int, floor: float) -> DataFrame:
    """Constraints by sum of abs(mu) times sum of abs(sf), positive only, with the signs of their nodes above ``floor``."""
    mass = mu.groupBy("key").agg(F.sum(F.abs("mu")).alias("mass"))
    gross = sf.groupBy("key").agg(F.sum(F.abs("sf")).alias("reach"), F.count_if(F.col("sf") >= floor).alias("n_up"), F.count_if(F.col("sf") <= -floor).alias("n_down"))
    joined = mass.join(gross, "key").withColumn("contribution", F.col("mass") * F.col("reach")).where("contribution > 0")
    return joined.orderBy(F.desc("contribution"), "key").limit(k)


def exposures(sf: DataFrame, mu: DataFrame | None, sp: str, k: int) -> DataFrame:
    """A node's k constraints by size: of -mu * sf where mu is given (zeros left out), else of sf."""
    own = sf.where(F.col("sp") == sp)
    if mu is None:
        sized = own.select("key", "sf", F.lit(None).cast("double").alias("contribution"), F.abs("sf").alias("size"))
    else:
        day = mu.groupBy("key").agg(F.sum("mu").alias("mu"))
        sized = own.join(day, "key").select("key", "sf", (-F.col("mu") * F.col("sf")).alias("contribution")).withColumn("size", F.abs("contribution")).where("size > 0")
    gross = sized.agg(F.sum("size").alias("gross"))
    return sized.orderBy(F.desc("size"), "key").limit(k).crossJoin(gross)  # gross is one row


def mass_coverage(mu: DataFrame, sf: DataFrame, by: tuple[str, ...] = (), when_none: float | None = None) -> DataFrame:
    """Share of abs(mu) on keys that the matrix holds; ``when_none`` stands for it where there is no mass."""
    known = sf.select("key").distinct().withColumn("known", F.lit(True))
    total, covered = F.sum(F.abs("mu")), F.sum(F.when(F.col("known"), F.abs("mu")).otherwise(0.0))
    return mu.join(known, "key", "left").groupBy(*by).agg(F.when(total > 0, covered / total).otherwise(F.lit(when_none)).alias("coverage"), total.alias("mass"))


def basis(a: DataFrame, b: DataFrame) -> DataFrame:
    """Two nodes' terms side by side: every constraint of either, the difference, its rank and share."""
    both = a.select("key", F.col("contribution").alias("a")).join(b.select("key", F.col("contribution").alias("b")), "key", "full")
    diff = both.withColumn("contribution", F.coalesce("a", F.lit(0.0)) - F.coalesce("b", F.lit(0.0)))
    everything = Window.partitionBy()
    return diff.withColumn("share", F.abs("contribution") / F.nullif(F.sum(F.abs("contribution")).over(everything), F.lit(0.0))).withColumn(
        "rank", F.row_number().over(Window.orderBy(F.abs("contribution").desc(), "key"))
    )


def column_totals(terms: DataFrame, keys: DataFrame) -> DataFrame:
    """Each node's sum over the shown constraints; null where no term is there."""
    return terms.join(keys.select("key"), "key", "left_semi").groupBy("sp").agg(F.sum("contribution").alias("total"))


def group_projection(sf: DataFrame, members: DataFrame) -> DataFrame:
    """(grp, sp, sf): shift factors of groups, as members' weighted by their shares among those the matrix has."""
    joined = sf.join(members, "key")
    kept = members.join(sf.select("key").distinct(), "key", "left_semi").groupBy("grp").agg(F.sum("share").alias("kept"))
    return joined.join(kept, "grp").groupBy("grp", "sp").agg((F.sum(F.col("sf") * F.col("share")) / F.first("kept")).alias("sf"))


def centroids(sf: DataFrame, geo: DataFrame) -> DataFrame:
    """Weighted geography of each constraint: centroid, spread, effective nodes, voltages."""
    from nodalis.functions.fields import haversine_km

    w = F.abs("sf")
    placed = sf.join(geo, "sp").where("sf <> 0")
    first = placed.groupBy("key").agg(
        F.sum(w).alias("w"), (F.sum(w * F.col("lat")) / F.sum(w)).alias("lat_c"), (F.sum(w * F.col("lon")) / F.sum(w)).alias("lon_c"),
        (F.sum(w) ** 2 / F.sum(w * w)).alias("effective_nodes"), (F.sum(w * F.col("kv")) / F.sum(w)).alias("kv_mean"), F.max_by("kv", F.struct(w, "sp")).alias("kv_at_max"),
    )
    away = haversine_km(F.col("lat"), F.col("lon"), F.col("lat_c"), F.col("lon_c"))
    spread = placed.join(first.select("key", "lat_c", "lon_c"), "key").groupBy("key").agg(F.sqrt(F.sum(w * away**2) / F.sum(w)).alias("spread_km"))
    return first.join(spread, "key").drop("w")


def zone_shares(sf: DataFrame, geo: DataFrame) -> DataFrame:
    """(key, zone, share, net_mean): where a constraint's weight lies."""
    w = F.sum(F.abs("sf"))
    zones = sf.join(geo.select("sp", "zone"), "sp").groupBy("key", "zone").agg(w.alias("w"), F.avg("sf").alias("net_mean"))
    return zones.withColumn("share", F.col("w") / F.nullif(F.sum("w").over(Window.partitionBy("key")), F.lit(0.0))).drop("w")


def rail_stats(sf: DataFrame, rail: float = 0.999) -> DataFrame:
    """Largest size, nodes at the rail, and the largest size below it."""
    size = F.abs("sf")
    return sf.groupBy("key").agg(F.max(size).alias("max_abs_sf"), F.count_if(size >= rail).alias("n_rail"), F.max(F.when(size < rail, size)).alias("peak_offrail"))


def signature_groups(sf: DataFrame) -> DataFrame:
    """(signature, members, n): nodes whose whole column of shift factors is the same, as 32-bit floats.

    The column travels as its hash; only groups of equal hash hold more than one name."""
    column = F.sha2(F.to_json(F.array_sort(F.collect_list(F.struct("key", F.col("sf").cast("float").alias("sf"))))), 256)
    return sf.groupBy("sp").agg(column.alias("signature")).groupBy("signature").agg(F.array_sort(F.collect_list("sp")).alias("members"), F.count(F.lit(1)).alias("n"))


def flat_days(points: DataFrame, by: str = "day") -> DataFrame:
    """Days whose projection has no spread at all; a forecast made of them is not to be served."""
    return points.groupBy(by).agg((F.max("point") - F.min("point")).alias("range")).where("range = 0")
