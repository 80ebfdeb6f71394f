"""Document quality by regularised quadratic discriminant analysis.

Each text becomes a vector of transformed statistics. Labelled training rows give each class a mean
and a covariance, by sums over all of them; the covariance is shrunk towards the pooled one and
towards a scaled identity. A text's score is the logistic of the difference of the classes' log
densities, whose Mahalanobis distances come from the Cholesky factors found once.

Only ids that ``held_out`` leaves free are learned from, and no label, language, source or id is an
input of a score.

Defined cases: a null text is an empty one and is scored like any text; a training table that lacks
one of the classes gives the labelled share of the other as every score (0.5 without any label);
null labels and repeated labels of other tables' ids are ignored; labels of a repeated id count each
time; a null id is not held out; an empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nodalis.llm.common import staged, table, text_or_empty, without_keys

STATISTICS = (
    "words", "word_length", "length_spread", "upper", "symbols", "exclaims", "bars", "digits", "variety",
    "echo", "common_word", "line_repeat", "line_length", "long_words", "short_words", "stops", "packed", "wide",
)
POOLED = 0.6  # weight of the pooled covariance
RIDGE = 0.05  # weight of the identity, scaled to the mean variance
PIECE = 1 << 16


def _logit(share: float, n: int) -> float:
    """The log odds of a share of n things, kept finite as if half a thing more were on either side."""
    hits = share * n
    return float(np.log((hits + 0.5) / (n - hits + 0.5)))


def statistics(text: str) -> list[float]:
    """The transformed statistics of a text, in the order of STATISTICS."""
    data = text.encode("utf-8", "replace")
    at = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    words = text.split()
    n, chars = len(words), int(at.sum())
    lengths = np.fromiter(map(len, words), np.int64, n) if n else np.zeros(1, np.int64)
    upper, lower = int(at[65:91].sum()), int(at[97:123].sum())
    punctuation = int(at[[33, 34, 39, 40, 41, 44, 45, 46, 58, 59, 63]].sum())
    visible = int(at[33:127].sum())
    letters, digits = upper + lower, int(at[48:58].sum())
    tally = Counter(words)
    lines = [x for x in text.split("\n") if x.strip()]
    packer = zlib.compressobj(1)
    packed = sum(len(packer.compress(data[i : i + PIECE])) for i in range(0, len(data), PIECE)) + len(packer.flush())
    echo = sum(a == b for a, b in zip(words, words[1:], strict=False))
    some = max(n, 1)
    return [
        float(np.log1p(n)),
        float(np.log1p(lengths.mean())),
        float(np.log1p(lengths.std())),
        _logit(upper / max(letters, 1), letters),
        _logit((visible - letters - digits - punctuation) / max(visible, 1), visible),
        _logit(int(at[33]) / max(chars, 1), chars),
        _logit(int(at[124]) / max(chars, 1), chars),
        _logit(digits / max(visible, 1), visible),
        float(np.log1p(len(tally)) / np.log1p(some)),
        _logit(echo / some, some),
        _logit(max(tally.values(), default=0) / some, some),
        _logit(1 - len(set(lines)) / max(len(lines), 1), len(lines)),
        float(np.log1p(len(text) / max(len(lines), 1))),
        _logit(float((lengths > 18).sum()) / some, some),
        _logit(float((lengths < 4).sum()) / some, some),
        _logit(int(at[46]) / max(chars, 1), chars),
        float(np.log((packed + 8) / (len(data) + 8))),
        _logit(int(at[128:].sum()) / max(chars, 1), chars),
    ]


@dataclass(frozen=True)
class Discriminant:
    """Means, inverse Cholesky factors and log constants of the two classes."""

    means: tuple
    factors: tuple
    constants: tuple
    share: float

    @classmethod
    def fit(cls, counts: np.ndarray, sums: np.ndarray, products: np.ndarray, pooled: float = POOLED, ridge: float = RIDGE) -> Discriminant:
        """From each class's count, sums (2, d) and sums of products (2, d, d)."""
        total = counts.sum()
        if not counts.all():
            return cls((), (), (), float(counts[1] / total) if total else 0.5)
        means = sums / counts[:, None]
        scatters = np.stack([products[c] - counts[c] * np.outer(means[c], means[c]) for c in (0, 1)])
        together = scatters.sum(axis=0) / total
        unit = np.diag(np.diag(together) + 1e-6)
        factors, constants = [], []
        for c in (0, 1):
            own = scatters[c] / counts[c]
            shrunk = (1 - ridge) * ((1 - pooled) * own + pooled * together) + ridge * unit
            factor = np.linalg.cholesky(shrunk)
            factors.append(np.linalg.inv(factor))
            constants.append(float(np.log(counts[c] / total) - np.log(np.diag(factor)).sum()))
        return cls(tuple(means), tuple(factors), tuple(constants), float(counts[1] / total))

    def score(self, rows: np.ndarray) -> np.ndarray:
        if not self.factors:
            return np.full(len(rows), self.share)
        densities = [k - 0.5 * (((rows - m) @ f.T) ** 2).sum(axis=1) for m, f, k in zip(self.means, self.factors, self.constants, strict=True)]
        return 1 / (1 + np.exp(np.clip(densities[0] - densities[1], -700, 700)))


def _describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [statistics(x.as_py()) for x in batch.column("text")]
        yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(found, pa.list_(pa.float64()))], ["id", "stats"])


def described(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, stats): the statistics of every whole text, staged."""
    rows = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text"))
    schema = rows.select("id", F.array(F.lit(0.0)).alias("stats")).schema
    return staged(rows.mapInArrow(_describe, schema), "quality-stats")


def held_out(id_col: str):
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 3 == 1, F.lit(False))


def _moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    d = len(STATISTICS)
    counts, sums, products = np.zeros(2), np.zeros((2, d)), np.zeros((2, d, d))
    for batch in batches:
        if batch.num_rows:
            rows = batch.column("stats").flatten().to_numpy().reshape(-1, d)
            labels = batch.column("label").to_numpy()
            for c in (0, 1):
                own = rows[labels == c]
                counts[c] += len(own)
                sums[c] += own.sum(axis=0)
                products[c] += own.T @ own
    flat = np.concatenate([counts, sums.ravel(), products.ravel()])
    yield pa.RecordBatch.from_arrays([pa.array(np.arange(flat.size, dtype=np.int64)), pa.array(flat)], ["place", "value"])


def train(stats: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id") -> Discriminant:
    """Fit on all labelled rows that are not held out. The driver sees sums only, 2 + 2d + 2d² numbers."""
    d = len(STATISTICS)
    free = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull() & ~held_out(id_col)).select(F.col(id_col).alias("id"), F.col(label_col).cast("long").alias("label"))
    moments = stats.join(free, "id").select("label", "stats").mapInArrow(_moments, "place long, value double")
    flat = np.zeros(2 + 2 * d + 2 * d * d)
    for row in moments.groupBy("place").agg(F.sum("value").alias("value")).collect():
        flat[row["place"]] = row["value"]
    return Discriminant.fit(flat[:2], flat[2 : 2 + 2 * d].reshape(2, d), flat[2 + 2 * d :].reshape(2, d, d))


def score(stats: DataFrame, model: Discriminant) -> DataFrame:
    """(id, score) of staged statistics."""

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.column("stats").flatten().to_numpy().reshape(batch.num_rows, len(STATISTICS))
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(model.score(rows))], ["id", "score"])

    return stats.mapInArrow(scored, stats.select("id", F.lit(0.0).alias("score")).schema)


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, held_out, score, predicted) for every row of ``docs``."""
    stats = described(docs, id_col, text_col)
    found = score(stats, train(stats, labels))
    return found.select(F.col("id").alias(id_col), held_out("id").alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that the classifier accepts; rows of a repeated id stay if any of them does.

    Texts of accepted rows are not shuffled: the ids that fall are taken out.
    """
    judged = classify(docs, labels, id_col, text_col).groupBy(F.col(id_col).alias("id")).agg(F.max("predicted").alias("accepted"))
    return without_keys(docs, id_col, staged(judged.where("accepted = 0").select("id"), "quality-rejected"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
