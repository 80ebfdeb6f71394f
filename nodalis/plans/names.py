"""Queries over fuzzy joins of names."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nodalis.operators import names
from nodalis.plans.registry import query, r6
from nodalis.sources import market

_SQL = """
WITH pool AS (SELECT p_partkey AS p, list_sort(list_distinct(string_split(upper(p_name), ' '))) AS rw, CASE WHEN p_partkey % 4 < 3 THEN p_partkey % 4 END AS has, p_retailprice AS capacity FROM part),
asked AS (SELECT p_partkey AS q, list_sort(list_distinct(string_split(upper(replace(p_name, 'i', '')) || ' ' || upper(p_type), ' '))) AS lw,
  CASE WHEN p_partkey % 5 < 4 THEN p_partkey % 5 END AS want, CASE WHEN p_partkey % 3 = 0 THEN p_retailprice + 10 ELSE 0 END AS expected FROM part),
n AS (SELECT l.lw, r.rw, list_sort(list_intersect(lw, rw)) AS s FROM (SELECT DISTINCT lw FROM asked) AS l, (SELECT DISTINCT rw FROM pool) AS r),
w AS (SELECT lw, rw, array_to_string(s, ' ') AS s, array_to_string(list_concat(s, list_sort(list_filter(lw, lambda x: NOT list_contains(rw, x)))), ' ') AS a, array_to_string(list_concat(s, list_sort(list_filter(rw, lambda x: NOT list_contains(lw, x)))), ' ') AS b FROM n),
m AS (SELECT *, (1::HUGEINT << length(a)::INT) - 1 AS whole, list_transform(string_split(b, ''), lambda c: list_sum(list_transform(range(1, length(a) + 1), lambda i: CASE WHEN a[i] = c THEN 1::HUGEINT << (i - 1)::INT ELSE 0::HUGEINT END))) AS masks FROM w),
c AS (SELECT *, length(a) - bit_count(list_reduce(list_prepend(whole, masks), lambda v, x: ((v + (v & x)) | (v - (v & x))) & whole)) AS common FROM m),
score AS (SELECT lw, rw, greatest(200.0 * common / (length(a) + length(b)), CASE WHEN s <> '' THEN 200.0 * length(s) / (length(s) + length(a)) ELSE 0 END, CASE WHEN s <> '' THEN 200.0 * length(s) / (length(s) + length(b)) ELSE 0 END) AS score FROM c),
fits AS (SELECT q, expected, p, capacity, rw, score, max(score) OVER (PARTITION BY q) AS top FROM asked JOIN score USING (lw) JOIN pool USING (rw) WHERE score >= 70 AND (want IS NULL OR has IS NULL OR want = has)),
near AS (SELECT *, count(*) OVER (PARTITION BY q) AS tied FROM fits WHERE score >= top - 1),
words AS (SELECT q, max(n) AS most FROM (SELECT q, word, count(DISTINCT p) AS n FROM (SELECT q, p, unnest(rw) AS word FROM near) GROUP BY 1, 2) GROUP BY 1)
SELECT q, arg_min(p, CASE WHEN tied = 1 THEN (0.0, p) ELSE (abs(capacity - expected), p) END) AS p, round(max(top), 6) AS score, max(tied) AS tied
FROM near JOIN words USING (q) WHERE tied = 1 OR expected > 0 AND most = tied GROUP BY q"""


@query(_SQL)
def fuzzy_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Misspelt part names with a word too many, against all parts, by source and capacity."""
    part, k = market.table(spark, sf_dir, "part"), F.col("p_partkey")
    pool = part.select(k.alias("p"), F.col("p_name").alias("pool_name"), F.col("p_name").alias("site"), F.when(k % 4 < 3, k % 4).alias("source"), F.col("p_retailprice").alias("mw"))
    queries = part.select(k.alias("q"), F.concat_ws(" ", F.replace("p_name", F.lit("i"), F.lit("")), "p_type").alias("name"), F.when(k % 5 < 4, k % 5).alias("source"), F.when(k % 3 == 0, F.col("p_retailprice") + 10).otherwise(0.0).alias("mw"))
    return names.best_compatible(queries, pool, 70.0).select("q", "p", r6("score").alias("score"), "tied")
