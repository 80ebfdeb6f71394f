"""Mixing sources to target weights by pivotal dependent rounding, with Spark expressions only.

Each source gets a target number of words; its documents all get the same expected number of copies,
target / source size. The whole part of that number is taken at once. The fractional parts are
rounded in dependence on each other: two documents exchange probability mass, weighted by their
sizes so that the expected words of the pair stay as they are, in a random direction, until one of
the two is decided. The other one goes on to meet the next document. A group of ``FAN`` documents so
leaves at most one undecided document, and those residuals are combined FAN by FAN through a
reduction tree, whose last node draws for what is left. The words taken from a source therefore
differ from its target by less than one document.

Random draws are hashes of ids and a seed: reruns agree. Only (id, source, size) rows travel.
Defined cases: a null text has size 0; a null source is a source, ordered last; documents of size 0
take 0 words; rows that repeat id, source and size are one unit and are decided alike; an empty
table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from nodalis.llm.common import WORD, staged, table, text_or_empty

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST = 2.0
FAN = 128
SEED = 42

#: One step of the rounding. c: the document under way, x: the next one; a: words, p: probability.
#: up and down: the words of mass that c can gain from x or lose to it before one is decided.
_STEP = """
aggregate(items,
  named_struct('c', cast(NULL AS {item}), 'done', cast(array() AS array<{item}>)),
  (acc, x) -> CASE
    WHEN acc.c IS NULL THEN named_struct('c', x, 'done', acc.done)
    WHEN acc.c.p <= 0D OR acc.c.p >= 1D THEN named_struct('c', x, 'done', array_append(acc.done, acc.c))
    ELSE transform(transform(
      array(named_struct('up', least((1D - acc.c.p) * acc.c.a, x.p * x.a), 'down', least(acc.c.p * acc.c.a, (1D - x.p) * x.a),
                         'u', shiftrightunsigned(xxhash64(x.h, acc.c.h, {seed}L), 11) * pow(2D, -53))),
      d -> CASE WHEN d.u * (d.up + d.down) < d.down
        THEN named_struct('c', CASE WHEN (1D - acc.c.p) * acc.c.a <= x.p * x.a THEN 1D ELSE acc.c.p + d.up / acc.c.a END,
                          'x', CASE WHEN x.p * x.a <= (1D - acc.c.p) * acc.c.a THEN 0D ELSE x.p - d.up / x.a END)
        ELSE named_struct('c', CASE WHEN acc.c.p * acc.c.a <= (1D - x.p) * x.a THEN 0D ELSE acc.c.p - d.down / acc.c.a END,
                          'x', CASE WHEN (1D - x.p) * x.a <= acc.c.p * acc.c.a THEN 1D ELSE x.p + d.down / x.a END) END),
      q -> CASE WHEN q.c <= 0D OR q.c >= 1D
        THEN named_struct('c', {x_with}, 'done', array_append(acc.done, {c_with}))
        ELSE named_struct('c', {c_with}, 'done', array_append(acc.done, {x_with})) END)[0]
  END)
"""


def allocate(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """(source, source_size, units, target) from (source, source_size, units), one row per source.

    Sources fill up by weight from a common level; those whose bound lies below the level stop at
    it. Sorted by bound per weight, the level follows from running sums, without any iteration.
    """
    by_name, by_bound = Window.orderBy(F.asc_nulls_last("source")), Window.orderBy("full_at", F.asc_nulls_last("source"))
    before, onward = by_bound.rowsBetween(Window.unboundedPreceding, -1), by_bound.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy()
    ranked = sizes.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.row_number().over(by_name) - 1) % len(weights) + 1).cast("double"))
    bounded = ranked.withColumn("bound", F.col("source_size") * F.lit(float(most))).withColumn("full_at", F.col("bound") / F.col("weight"))
    total = F.sum("source_size").over(everything) * F.lit(share)
    levels = bounded.withColumn("level", (total - F.coalesce(F.sum("bound").over(before), F.lit(0.0))) / F.sum("weight").over(onward))
    last = F.max(F.when(F.col("full_at") > F.col("level"), F.struct(-F.col("full_at"), F.col("level").alias("level")))).over(everything)["level"]
    return levels.withColumn("last", last).select(
        "source",
        "source_size",
        "units",
        F.when(F.col("full_at") > F.col("level"), F.least("bound", F.col("weight") * F.col("last"))).otherwise(F.col("bound")).alias("target"),
    )


def _with(name: str, fields: list[str], p: str) -> str:
    return "named_struct(" + ", ".join(f"'{f}', {p if f == 'p' else f'{name}.{f}'}" for f in fields) + ")"


def _round(fractional: DataFrame, most_units: int, seed: int) -> DataFrame:
    """Decide the units (unit struct, words a, probability p) of every group; adds ``up``, 0 or 1."""
    groups = ["source", "source_size", "target"]
    kind = fractional.schema["unit"].dataType.simpleString()
    item, fields = f"struct<h:bigint,unit:{kind},a:double,p:double>", ["h", "unit", "a", "p"]
    step = _STEP.format(item=item, seed=seed, x_with=_with("x", fields, "q.x"), c_with=_with("acc.c", fields, "q.c"))
    rows = fractional.withColumn("node", F.pmod(F.xxhash64("unit", F.lit(seed)), F.greatest(F.lit(1), F.ceil(F.col("units") / FAN))))
    rows = rows.select(*groups, "node", F.struct(F.xxhash64("unit", F.lit(seed + 1)).alias("h"), "unit", "a", "p").alias("item"))
    decided, nodes = None, -(-most_units // FAN)
    while True:
        grouped = rows.groupBy(*groups, "node").agg(F.array_sort(F.collect_list("item")).alias("items"))
        level = staged(grouped.withColumn("got", F.expr(step)).select(*groups, "node", "got.c", "got.done"), "mix-level")
        done = level.select(*groups, F.explode("done").alias("item"))
        decided = done if decided is None else decided.unionByName(done)
        if nodes <= 1:
            draw = F.expr(f"shiftrightunsigned(xxhash64(c.h, {seed + 2}L), 11) * pow(2D, -53) < c.p")
            rest = level.select(*groups, F.struct("c.h", "c.unit", "c.a", F.when(draw, 1.0).otherwise(0.0).alias("p")).alias("item"))
            return decided.unionByName(rest).select(*groups, "item.unit", F.when(F.col("item.p") >= 1, 1).otherwise(0).alias("up"))
        whole = level.where("c.p <= 0 OR c.p >= 1").select(*groups, F.col("c").alias("item"))
        decided = decided.unionByName(whole)
        rows = level.where("c.p > 0 AND c.p < 1").select(*groups, F.floor(F.col("node") / FAN).alias("node"), F.col("c").alias("item"))
        nodes = -(-nodes // FAN)


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = SEED, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """One row per unit: id, source, size, repeats (rows alike), source_size, target, copies."""
    size = F.regexp_count(text_or_empty(text_col), F.lit(WORD)).cast("long")
    units = docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), size.alias("size"))
    units = staged(units.groupBy("id", "source", "size").agg(F.count(F.lit(1)).alias("repeats")), "mix-units")
    totals = units.groupBy("source").agg(F.sum(F.col("size") * F.col("repeats")).alias("source_size"), F.count(F.lit(1)).alias("units"))
    targets = staged(allocate(totals, weights, share, most), "mix-targets")
    most_units = targets.agg(F.max("units")).first()[0] or 0
    expected = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    joined = units.alias("u").join(targets.alias("t"), F.col("u.source").eqNullSafe(F.col("t.source"))).select(
        F.struct("u.id", "u.size", "u.repeats").alias("unit"), "u.source", "t.source_size", "t.units", "t.target",
        (F.col("u.size") * F.col("u.repeats")).cast("double").alias("a"), expected.alias("expected"),
    )
    joined = joined.withColumn("base", F.floor("expected")).withColumn("p", F.col("expected") - F.col("base"))
    open_ = (F.col("p") > 0) & (F.col("a") > 0)
    fixed = joined.where(~open_).select("source", "source_size", "target", "unit", F.lit(0).alias("up"))
    rounded = _round(joined.where(open_), most_units, seed)
    base = F.when((F.col("source_size") > 0) & (F.col("unit.size") > 0), F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0))
    return fixed.unionByName(rounded).select(
        F.col("unit.id").alias(id_col), F.col("source").alias(source_col), "unit.size", "unit.repeats", "source_size", "target", (base + F.col("up")).cast("int").alias("copies")
    )


def take(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it."""
    id_col, text_col, source_col = (options.get(k, v) for k, v in (("id_col", "doc_id"), ("text_col", "text"), ("source_col", "source")))
    taken = mix(docs, **options).where("copies > 0").select(F.col(id_col).alias("_id"), F.col(source_col).alias("_source"), F.col("size").alias("_size"), "copies")
    size = F.regexp_count(text_or_empty(text_col), F.lit(WORD)).cast("long")
    rows = docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), size.alias("words"), F.struct(*docs.columns).alias("row"))
    met = rows.join(taken, F.col("id").eqNullSafe(F.col("_id")) & F.col("source").eqNullSafe(F.col("_source")) & (F.col("words") == F.col("_size")))
    return met.select("row", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("row.*")


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix(table(spark, sf_dir, "documents"))
    rows = mixed.withColumn("_row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("repeats"))))
    return rows.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).cast("long").alias("taken"))
