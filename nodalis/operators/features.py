"""The design matrix: arms of columns, candidates, targets, covariates, audits."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nodalis.functions import clock
from nodalis.operators import panels

#: Feature sets by name, as the prefixes of the columns they add. Fixed values.
ARMS = {"base": ("load_", "wind_", "solar_", "net_", "hour_", "dow", "month", "is_", "binds_", "life_", "mean_", "days_"), "lag": ("lag_",), "geo": ("geo_",), "weather": ("wx_",), "outage": ("out_",)}
TARGETS = ("y_bind", "y_mu")


def arms_for(name: str) -> tuple[str, ...]:
    """The arms of a feature set; "all", one arm, or arms joined by "+"; base is always among them."""
    names = tuple(ARMS) if name == "all" else ("base", *(n for n in name.split("+") if n != "base"))
    if unknown := [n for n in names if n not in ARMS]:
        raise ValueError(f"unknown feature set {unknown}")
    return names


def feature_columns(columns: list[str], arms: tuple[str, ...]) -> list[str]:
    """The feature columns of the given arms, in table order; vintages and targets are none."""
    prefixes = tuple(p for a in arms for p in ARMS[a])
    return [c for c in columns if c.startswith(prefixes) and not c.startswith("vintage_") and c not in TARGETS]


def downcast(df: DataFrame) -> DataFrame:
    return df.select(*(F.col(c).cast("float").alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


def candidates(history: DataFrame, policy: str = "recent", column: str = "binds_28d") -> DataFrame:
    """All keys, or those that bound within the trailing window."""
    if policy not in ("all", "recent"):
        raise ValueError(policy)
    return history if policy == "all" else history.where(F.col(column) > 0)


def system_panel(load: DataFrame, wind: DataFrame, solar: DataFrame, outages: DataFrame) -> DataFrame:
    """Hours of any source with their totals, net load and its lower band; holes stay null."""
    joined = reduce(lambda a, b: a.join(b, "ts", "full"), (wind, solar, outages), load)
    net = F.col("load_total") - F.col("wind_total") - F.col("solar_total")
    return joined.select("*", net.alias("net_load"), (F.col("wind_total") - F.col("wind_low")).alias("wind_band"))


def design(hours: DataFrame, keys: DataFrame, system: DataFrame, mu: DataFrame, deadband: float = 1.0) -> DataFrame:
    """Hours of each day times that day's candidate keys, with covariates and targets. A key that has no
    shadow price in an hour did not bind; the size of what did not bind is null."""
    grid = hours.withColumn("day", clock.delivery_date(F.col("ts"))).join(keys, "day")
    own = mu.select("ts", "key", F.abs("mu").alias("size"))
    rows = grid.join(system, "ts", "left").join(own, ["ts", "key"], "left")
    bound = F.coalesce(F.col("size"), F.lit(0.0)) > deadband
    return rows.withColumn("y_bind", bound.cast("int")).withColumn("y_mu", F.when(bound, F.col("size"))).drop("size")


def audit_leakage(rows: DataFrame, posted: str = "posted", ts: str = "ts") -> DataFrame:
    """Hours between a vintage and the close it had to meet: least, median, and how many are late."""
    slack = (F.unix_timestamp(clock.dam_close(clock.delivery_date(F.col(ts)))) - F.unix_timestamp(posted)) / 3600
    return rows.select(slack.alias("s")).agg(F.min("s").alias("min_slack"), F.percentile("s", 0.5).alias("median_slack"), F.count_if(F.col("s") < 0).alias("n_leaks"))


def covers(last_ts: Column, start: Column) -> Column:
    """Whether settled prices reach at least half a day into a window."""
    return last_ts >= F.timestamp_add("HOUR", F.lit(12), start)


def trailing_average(days: DataFrame, universe: DataFrame, n: int) -> DataFrame:
    """(key, ordinal, mean): each hour of the day's mean over n days (day, ordinal, key, v), absent rows being
    0; null if any of the n days is absent as a whole."""
    present = days.agg(F.count_distinct("day").alias("days"))
    sums = universe.join(days.groupBy("key", "ordinal").agg(F.sum("v").alias("s")), ["key", "ordinal"], "left")
    return sums.crossJoin(F.broadcast(present)).select("key", "ordinal", F.when(F.col("days") == n, F.coalesce("s", F.lit(0.0)) / n).alias("mean"))


def essp_study_groups(rows: DataFrame) -> DataFrame:
    """(representative, members, n) of points whose group is the same in every hour of (ts, sp, grp)."""
    hours = rows.agg(F.count_distinct("ts").alias("hours"))
    signature = F.sha2(F.to_json(F.array_sort(F.collect_list(F.struct("ts", "grp")))), 256)
    own = rows.groupBy("sp").agg(signature.alias("sig"), F.count(F.lit(1)).alias("n")).crossJoin(F.broadcast(hours)).where("n = hours")
    return own.groupBy("sig").agg(F.min("sp").alias("representative"), F.array_sort(F.collect_list("sp")).alias("members"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("sig")


def canonical(universe: DataFrame, groups: DataFrame) -> DataFrame:
    """Every point with its group's representative and size; points without a group stand for themselves."""
    laid = groups.select(F.explode("members").alias("sp"), "representative", "n")
    return universe.join(laid, "sp", "left").select("sp", F.coalesce("representative", "sp").alias("representative"), F.coalesce("n", F.lit(1)).alias("n"))


def station_mass(rows: DataFrame) -> DataFrame:
    """(key, from_station, to_station, mass, share): positive mass by the pair of stations a row names."""
    from pyspark.sql import Window

    named = [F.nullif(F.trim(c), F.lit("")).alias(c) for c in ("from_station", "to_station")]
    mass = rows.select("key", *named, F.greatest("mu", F.lit(0.0)).alias("m")).groupBy("key", "from_station", "to_station").agg(F.sum("m").alias("mass"))
    return mass.withColumn("share", F.col("mass") / F.nullif(F.sum("mass").over(Window.partitionBy("key")), F.lit(0.0)))


def principal_axis(rows: DataFrame) -> DataFrame:
    """(key, angle, half_span): direction of each key's weighted points (x, y, w) and its standard deviation."""
    w, x, y = F.sum("w"), F.sum(F.col("w") * F.col("x")), F.sum(F.col("w") * F.col("y"))
    s = rows.groupBy("key").agg(w.alias("w"), (x / w).alias("mx"), (y / w).alias("my"), F.sum(F.col("w") * F.col("x") ** 2).alias("xx"), F.sum(F.col("w") * F.col("y") ** 2).alias("yy"), F.sum(F.col("w") * F.col("x") * F.col("y")).alias("xy"))
    cxx, cyy, cxy = F.col("xx") / F.col("w") - F.col("mx") ** 2, F.col("yy") / F.col("w") - F.col("my") ** 2, F.col("xy") / F.col("w") - F.col("mx") * F.col("my")
    largest = (cxx + cyy) / 2 + F.sqrt(((cxx - cyy) / 2) ** 2 + cxy**2)
    return s.select("key", (F.atan2(2 * cxy, cxx - cyy) / 2).alias("angle"), F.sqrt(F.greatest(largest, F.lit(0.0))).alias("half_span"))


def cursor_mu(settled: DataFrame, forecast: DataFrame) -> DataFrame:
    """abs(mu) at a cursor: settled where there is a row, else forecast."""
    both = settled.select("key", F.col("mu").alias("s")).join(forecast.select("key", F.col("mu").alias("f")), "key", "full")
    return both.select("key", F.abs(F.coalesce("s", "f")).alias("mu"), F.col("s").isNotNull().alias("settled"))


def anchor_ranking(mu: DataFrame, sf: DataFrame, anchors: list[str], least: float = 5e-4) -> DataFrame:
    """Keys by abs(mu) times their abs(sf) over the anchor nodes, where any of those is not negligible."""
    pull = sf.where(F.col("sp").isin(*anchors)).groupBy("key").agg(F.sum(F.abs("sf")).alias("pull"), F.max(F.abs("sf")).alias("peak")).where(F.col("peak") >= least)
    return mu.join(pull, "key").select("key", (F.abs("mu") * F.col("pull")).alias("score"))


def default_hub(terms: DataFrame, hubs: list[str]) -> DataFrame:
    """The hub with the largest sum of sizes over the rows shown."""
    return terms.where(F.col("sp").isin(*hubs)).groupBy("sp").agg(F.sum(F.abs("contribution")).alias("size")).orderBy(F.desc("size"), "sp").limit(1)


def benchmark_split(points: DataFrame, least: float = 1.0) -> DataFrame:
    """The dearest and the cheapest of a family (sp, family, point), if they part to both sides."""
    mean = points.groupBy("family", "sp").agg(F.avg("point").alias("m"))
    pair = mean.groupBy("family").agg(F.max_by("sp", F.struct("m", "sp")).alias("high"), F.max("m").alias("high_mean"), F.min_by("sp", F.struct("m", "sp")).alias("low"), F.min("m").alias("low_mean"))
    return pair.where((F.col("high_mean") >= least) & (F.col("low_mean") <= -least))


def guarded(sf: DataFrame, meta: DataFrame, predictions: DataFrame, day: str, oldest_days: int = 14, least: float = 0.5) -> DataFrame:
    """The map that a forecast of ``day`` may use. Raises where there is none recent enough, where it is
    empty, or where it holds less than ``least`` of the predicted mass. The checks are three scalars."""
    from nodalis.operators.projection import mass_coverage
    from nodalis.sources.files import resolve_window

    window = resolve_window(meta, day, oldest_days).select("window_start").first()
    if window is None:
        raise LookupError(f"no map within {oldest_days} days of {day}")
    own = sf.where(F.col("window_start") == F.lit(window[0]))
    share = mass_coverage(predictions, own, when_none=1.0).first()["coverage"]
    if own.limit(1).count() == 0 or share < least:
        raise LookupError(f"the map of {window[0]} covers {share} of the predicted mass")
    return own


def backfill(meta: DataFrame, found: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """``meta`` with the columns' new values where there are any."""
    new = found.select(*keys, *(F.col(c).alias(f"_{c}") for c in columns))
    return meta.join(new, keys, "left").select(*(F.coalesce(f"_{c}", c).alias(c) if c in columns else F.col(c) for c in meta.columns))


def vintage_rows(df: DataFrame, keys: list[str], columns: list[str], posted: str = "posted") -> DataFrame:
    """Newest posting by each day's close, with the columns wanted."""
    cutoff = clock.dam_close(clock.delivery_date(F.col("ts")))
    return panels.latest_vintage(df.select(*keys, posted, *columns), keys, posted, cutoff)
