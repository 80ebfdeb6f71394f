"""Grading metrics over long (hour, node or key, truth, forecast) rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RANK_SLICES = 4096


def _average_rank(value: str, by: list[str]) -> Column:
    """Mean rank of ties."""
    ties = F.count(F.lit(1)).over(Window.partitionBy(*by, value))
    return F.rank().over(Window.partitionBy(*by).orderBy(value)) + (ties - 1) / 2


def spearman(rows: DataFrame, by: list[str], y: str = "y", y_hat: str = "y_hat", least: int = 10) -> DataFrame:
    """(by, n, spearman): rank correlation of each group with at least ``least`` rows and some spread on both sides."""
    ranked = rows.where(F.col(y).isNotNull() & F.col(y_hat).isNotNull()).select(*by, _average_rank(y, by).alias("a"), _average_rank(y_hat, by).alias("b"))
    n, sa, sb = F.count(F.lit(1)), F.sum("a"), F.sum("b")
    sums = ranked.groupBy(*by).agg(n.alias("n"), sa.alias("sa"), sb.alias("sb"), F.sum(F.col("a") * F.col("a")).alias("saa"), F.sum(F.col("b") * F.col("b")).alias("sbb"), F.sum(F.col("a") * F.col("b")).alias("sab"))
    va = F.col("n") * F.col("saa") - F.col("sa") ** 2
    vb = F.col("n") * F.col("sbb") - F.col("sb") ** 2
    return sums.where((F.col("n") >= least) & (va > 0) & (vb > 0)).select(*by, "n", ((F.col("n") * F.col("sab") - F.col("sa") * F.col("sb")) / F.sqrt(va * vb)).alias("spearman"))


def sign_agreement(rows: DataFrame, by: list[str], deadband: float = 1.0) -> DataFrame:
    """Share of equal signs among truths beyond the dead band."""
    same = F.when(F.signum("y") == F.signum("y_hat"), 1.0).otherwise(0.0)
    return rows.where(F.abs("y") > deadband).groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.avg(same).alias("sign_agree"))


def topdecile_hit(rows: DataFrame, by: list[str], key: str, least: int = 20) -> DataFrame:
    """Share of the truth's top tenth that is in the forecast's; ties go to the smaller key."""
    group = Window.partitionBy(*by)
    sized = rows.where(F.col("y").isNotNull() & F.col("y_hat").isNotNull()).withColumn("n", F.count(F.lit(1)).over(group)).where(F.col("n") >= least)
    k = F.greatest(F.lit(1), F.floor(F.col("n") / 10))
    placed = sized.select(*by, k.alias("k"), F.row_number().over(group.orderBy(F.desc("y"), key)).alias("a"), F.row_number().over(group.orderBy(F.desc("y_hat"), key)).alias("b"))
    hits = F.count_if((F.col("a") <= F.col("k")) & (F.col("b") <= F.col("k")))
    return placed.groupBy(*by).agg((hits / F.first("k")).alias("hit"), F.first("k").alias("k"))


def expected_ap(rows: DataFrame, by: list[str], score: str = "score", bound: str = "bound") -> DataFrame:
    """Average precision, expected over random orders within equal scores; null without any bound key.

    Only one row per distinct score reaches the window; inside a tie the sum runs over its places."""
    ties = rows.groupBy(*by, score).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col(bound)).alias("b"))
    above = Window.partitionBy(*by).orderBy(F.desc(score)).rowsBetween(Window.unboundedPreceding, -1)
    run = ties.withColumn("n_above", F.coalesce(F.sum("n").over(above), F.lit(0))).withColumn("b_above", F.coalesce(F.sum("b").over(above), F.lit(0)))
    step = F.expr("CASE WHEN n > 1 THEN (b - 1) / (n - 1) ELSE 0D END")
    term = F.expr("aggregate(sequence(1L, n), 0D, (s, i) -> s + (b_above + 1 + (i - 1) * step) / (n_above + i)) * b / n")
    got = run.withColumn("step", step).withColumn("term", F.when(F.col("b") > 0, term).otherwise(0.0))
    return got.groupBy(*by).agg((F.sum("term") / F.nullif(F.sum("b"), F.lit(0))).alias("ap"), (F.sum("b") / F.sum("n")).alias("rate"), F.sum("n").alias("universe"))


def chance_adjusted(ap: Column, rate: Column) -> Column:
    """How far average precision is above chance; null where everything is bound."""
    return F.when(rate < 1, (ap - rate) / (1 - rate))


def soft_overlap(rows: DataFrame, by: list[str]) -> DataFrame:
    """2 sum(min) / (sum + sum) of two non-negative masses, null where both are empty; ratio, ceiling and share."""
    p, s = F.sum("predicted"), F.sum("settled")
    out = rows.groupBy(*by).agg((2 * F.sum(F.least("predicted", "settled")) / F.nullif(p + s, F.lit(0.0))).alias("overlap"), (p / F.nullif(s, F.lit(0.0))).alias("ratio"))
    r = F.least(F.col("ratio"), 1 / F.nullif(F.col("ratio"), F.lit(0.0)))
    ceiling = 2 * r / (1 + r)
    return out.withColumn("ceiling", ceiling).withColumn("share", F.col("overlap") / F.nullif("ceiling", F.lit(0.0)))


def pooled_r2(rows: DataFrame, by: list[str]) -> DataFrame:
    """1 - SSR / SST over pairs that have both; null for fewer than two or no spread."""
    both = rows.where(F.col("y").isNotNull() & F.col("y_hat").isNotNull())
    sst = F.sum(F.col("y") ** 2) - F.sum("y") ** 2 / F.count(F.lit(1))
    return both.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.when((F.count(F.lit(1)) > 1) & (sst > 1e-12), 1 - F.sum((F.col("y") - F.col("y_hat")) ** 2) / sst).alias("r2"))


def screening(rows: DataFrame, by: list[str], key: str) -> DataFrame:
    """Means over the hours of Spearman, sign agreement and top-decile hit; hours whose forecast is flat
    count for all but the last."""
    spread = F.max("y_hat").over(Window.partitionBy(*by)) - F.min("y_hat").over(Window.partitionBy(*by))
    varied = rows.withColumn("_s", spread).where("_s > 0").drop("_s")
    hours = spearman(rows, by).select(*by, "spearman").join(topdecile_hit(varied, by, key).select(*by, "hit"), by, "full")
    sign = sign_agreement(rows.withColumn("_all", F.lit(1)), ["_all"]).select("sign_agree")
    return hours.agg(F.avg("spearman").alias("spearman"), F.avg("hit").alias("topdecile"), F.count(F.lit(1)).alias("n_hours")).crossJoin(sign)


def reliability(rows: DataFrame, bins: int = 10) -> DataFrame:
    """(bin, n, mean_p, rate, gap) over equal-width bins of p."""
    at = F.least(F.floor(F.col("p") * bins), F.lit(bins - 1)).cast("int")
    out = rows.groupBy(at.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.avg("p").alias("mean_p"), F.avg(F.col("y").cast("double")).alias("rate"))
    return out.withColumn("gap", F.abs(F.col("mean_p") - F.col("rate")))


def bind_metrics(rows: DataFrame) -> DataFrame:
    """Brier score, calibration error, AUC by ranks (null with one class), base rate and mean p.

    Ranks come from slices of p: a running sum over RANK_SLICES totals, and one inside each slice."""
    bins = reliability(rows)
    ece = bins.agg((F.sum(F.col("n") * F.col("gap")) / F.sum("n")).alias("ece"))
    sums = rows.agg(F.avg((F.col("y") - F.col("p")) ** 2).alias("brier"), F.avg(F.col("y").cast("double")).alias("base_rate"), F.avg("p").alias("mean_p"))
    scores = rows.groupBy("p").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("y").cast("long")).alias("k")).withColumn("slice", F.floor(F.col("p") * RANK_SLICES))
    offsets = scores.groupBy("slice").agg(F.sum("n").alias("m")).withColumn("before", F.coalesce(F.sum("m").over(Window.orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    below = Window.partitionBy("slice").orderBy("p").rowsBetween(Window.unboundedPreceding, -1)
    placed = scores.withColumn("inside", F.coalesce(F.sum("n").over(below), F.lit(0))).join(F.broadcast(offsets.select("slice", "before")), "slice")
    ranks = placed.withColumn("mid", F.col("before") + F.col("inside") + (F.col("n") + 1) / 2)
    auc = ranks.agg(F.sum(F.col("k") * F.col("mid")).alias("s"), F.sum("k").alias("k"), F.sum("n").alias("n")).select(
        F.when((F.col("k") > 0) & (F.col("k") < F.col("n")), (F.col("s") - F.col("k") * (F.col("k") + 1) / 2) / (F.col("k") * (F.col("n") - F.col("k")))).alias("auc")
    )
    return sums.crossJoin(ece).crossJoin(auc)


def weighted_mean(value: str, weight: str = "n") -> Column:
    """Sum of value times weight over the weights of rows that have a value."""
    return F.sum(F.col(value) * F.col(weight)) / F.nullif(F.sum(F.when(F.col(value).isNotNull(), F.col(weight))), F.lit(0))


def top_fraction(rows: DataFrame, by: list[str], value: str, fraction: float, key: str) -> DataFrame:
    """Rows with ``bound``: whether they are among the ceil(n * fraction) largest of their group."""
    group = Window.partitionBy(*by)
    place = F.row_number().over(group.orderBy(F.desc(value), key))
    return rows.withColumn("bound", place <= F.ceil(F.count(F.lit(1)).over(group) * fraction))


def magnitude(rank: Column, ratio: Column) -> Column:
    """The ladder of a day's size by its rank in history and its ratio to the median."""
    return (
        F.when(rank == 1, "record").when(rank <= 3, "near_top").when(ratio >= 1.25, "elevated").when(ratio >= 1.10, "ordinary_plus")
        .when(ratio >= 0.75, "ordinary").when(ratio >= 0.5, "ordinary_minus").otherwise("quiet")
    )
