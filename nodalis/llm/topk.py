"""Exact top-k by inner product with Fagin's threshold algorithm.

Vectors are quantised to integers and dealt by hash into blocks of bounded size. A block keeps one
sorted list per dimension. For a query the algorithm walks all lists from their better end (the
large values where the query's component is positive, the small ones where it is negative), scores
every vector it meets in full, and stops once the bound on all vectors not met yet - the query
against the values at the current depth - is below the kth score found. Blocks of queries meet
blocks of vectors; each pair yields k rows per query at most, and a ranked window merges them.

Defined cases: vectors that are null, or hold null, NaN, an infinity or a value that is none once
scaled, and rows without an id take no part; ties go to the smaller id; query rows that share an id
are one query, that of the smallest vector in array order; all rows of the query's id count as its
own and are no candidates; rows repeated under another id are candidates each; vectors meet only
vectors of the same length, and empty ones score 0; scores that a long
holds are exact, larger ones are returned as the nearest long and ranked as doubles between blocks; very long vectors make blocks larger, nothing else;
further columns, whatever their names, are ignored; a query without candidates has no rows; an empty
table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from nodalis.llm.common import staged, table

VECTOR_BLOCK = 8192
QUERY_BLOCK = 16384
FIRST_DEPTH = 16
EXACT, LONG = 2.0**53, 2.0**62
LARGEST = 2**1023


def quantised(rows: DataFrame, id_col: str, vector_col: str, scale: int = 1024) -> DataFrame:
    """(id, vector array<double> of whole numbers) of the rows that take part."""
    sound = F.forall(F.col(vector_col).cast("array<double>"), lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) * scale < float("inf")), F.lit(False)))
    return rows.where(F.col(id_col).isNotNull() & F.col(vector_col).isNotNull() & sound).select(
        F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("vector")
    ).select("id", F.lit(scale).alias("scale"), "vector")


def _pack(rows: pd.DataFrame) -> pd.DataFrame:
    """One row for each vector length of a block: ids and whole-number components as bytes."""
    out, lengths, block = [], rows["vector"].map(len), rows["block"].iloc[0]
    for length, group in rows.groupby(lengths):
        group = group.sort_values("id", kind="stable")
        matrix = np.floor(np.stack([np.asarray(v, float) for v in group["vector"]]) * float(group["scale"].iloc[0])).reshape(len(group), length)
        out.append((block, int(length), group["id"].to_numpy("<i8").tobytes(), matrix.astype("<f8").tobytes()))
    return pd.DataFrame(out, columns=["block", "dims", "ids", "matrix"])


def _packed(rows: DataFrame, blocks: int) -> DataFrame:
    dealt = rows.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int"))
    return dealt.groupBy("block").applyInPandas(_pack, "block int, dims int, ids binary, matrix binary")


class SortedLists:
    """A block's sorted list of every dimension."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        self.ids, self.vectors = ids, vectors
        self.order = np.argsort(vectors, axis=0, kind="stable")
        self.values = np.take_along_axis(vectors, self.order, axis=0)
        self.largest = np.abs(vectors).max(axis=1, initial=0.0)

    def score(self, rows: np.ndarray, query: np.ndarray) -> np.ndarray:
        """Exact inner products: in doubles, longs or, where those are too small, Python's integers."""
        most = self.largest[rows] * (float(np.abs(query).max(initial=0.0)) * max(1, query.size))
        if (most < EXACT).all():
            return (self.vectors[rows] @ query).astype(np.int64)
        out = np.zeros(len(rows), object)
        small, middle = most < EXACT, (most >= EXACT) & (most < LONG)
        out[small] = (self.vectors[rows[small]] @ query).astype(np.int64).tolist()
        if middle.any():
            out[middle] = (self.vectors[rows[middle]].astype(np.int64) @ query.astype(np.int64)).tolist()
        whole = [int(y) for y in query.tolist()]
        for place in np.flatnonzero(~(small | middle)):
            out[place] = sum(int(x) * y for x, y in zip(self.vectors[rows[place]].tolist(), whole, strict=True))
        return out

    @staticmethod
    def ranked(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
        if scores.dtype == object:
            return np.array(sorted(range(len(ids)), key=lambda i: (-scores[i], ids[i]))[:k], np.int64)
        return np.lexsort((ids, -scores))[:k]

    def top(self, own: int, query: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and scores of the k best vectors but the query's own, best first."""
        n, up, down = len(self.ids), np.flatnonzero(query > 0), np.flatnonzero(query < 0)
        met = self.ids == own
        best_ids, best = np.empty(0, np.int64), np.empty(0, np.int64)
        done, depth = 0, min(n, max(FIRST_DEPTH, k)) if up.size + down.size else n
        while True:
            fresh = np.zeros(n, bool)
            if up.size + down.size:
                fresh[self.order[n - depth : n - done, up].ravel()] = True
                fresh[self.order[done:depth, down].ravel()] = True
            else:
                fresh[:] = True
            rows = np.flatnonzero(fresh & ~met)
            met |= fresh
            scores = np.concatenate([best, self.score(rows, query)])
            ids = np.concatenate([best_ids, self.ids[rows]])
            if scores.dtype != object and scores.size > 4 * k:
                least = np.partition(scores, scores.size - k)[scores.size - k]
                keep = scores >= least
                scores, ids = scores[keep], ids[keep]
            ranked = self.ranked(ids, scores, k)
            best_ids, best = ids[ranked], scores[ranked]
            if depth >= n:
                return best_ids, best
            if best.size == k:
                terms = np.concatenate([query[up] * self.values[n - depth, up], query[down] * self.values[depth - 1, down]])
                kth, slack = float(best[-1]), float(np.abs(terms).sum()) * 2.0**-48  # sums beyond 2**53 are rounded
                if np.isfinite(slack) and kth - abs(kth) * 2.0**-50 > float(terms.sum()) + slack:
                    return best_ids, best
            done, depth = depth, min(n, 2 * depth)


def _unpack(ids: bytes, matrix: bytes, dims: int) -> tuple[np.ndarray, np.ndarray]:
    keys = np.frombuffer(ids, "<i8")
    return keys, np.frombuffer(matrix, "<f8").reshape(len(keys), dims)


def _searcher(k: int):
    schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64()), ("size", pa.float64())])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                pair = {name: batch.column(name)[at].as_py() for name in batch.schema.names}
                lists = SortedLists(*_unpack(pair["ids"], pair["matrix"], pair["dims"]))
                found = []
                for own, query in zip(*_unpack(pair["query_ids"], pair["query_matrix"], pair["dims"]), strict=True):
                    ids, scores = lists.top(int(own), query, k)
                    scores = scores.tolist()
                    longs = np.array([min(max(x, -(1 << 63)), (1 << 63) - 1) for x in scores], np.int64)
                    found.append((np.full(len(ids), own), ids, longs, np.array([float(min(max(x, -LARGEST), LARGEST)) for x in scores])))
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*found, strict=True)], schema=schema)

    return search


def top_k(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k best vectors. Both tables are quantised()."""
    queries = queries.groupBy("id").agg(F.first("scale").alias("scale"), F.min("vector").alias("vector"))
    rows, asked = vectors.count(), queries.count()
    blocks, query_blocks = max(1, -(-rows // VECTOR_BLOCK)), max(1, -(-asked // QUERY_BLOCK))
    have = staged(_packed(vectors, blocks), "topk-vectors").withColumn("query_block", F.explode(F.expr(f"sequence(0, {query_blocks - 1})")))
    want = staged(_packed(queries, query_blocks), "topk-queries").select(
        F.col("block").alias("query_block"), "dims", F.col("ids").alias("query_ids"), F.col("matrix").alias("query_matrix"),
        F.explode(F.expr(f"sequence(0, {blocks - 1})")).alias("block"),
    )
    pairs = have.join(want, ["block", "query_block", "dims"]).repartition(blocks * query_blocks)
    found = pairs.select("dims", "ids", "matrix", "query_ids", "query_matrix").mapInArrow(_searcher(k), "query_id long, vec_id long, score long, size double")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), F.desc("size"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op3_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = quantised(table(spark, sf_dir, "embeddings"), "vec_id", "embedding")
    return top_k(vectors, vectors.where("id % 100 = 0"), 10)


OP3_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
  FROM (SELECT vec_id, min(e) AS e FROM v WHERE vec_id % 100 = 0 GROUP BY vec_id) AS q JOIN v AS c ON q.vec_id <> c.vec_id
), r AS (
  SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank, vec_id, score FROM s
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 10
"""
