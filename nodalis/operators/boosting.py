"""Gradient-boosted trees over histograms, with holes.

Features become bins at quantiles that one sketch aggregate finds for all of them; a hole has a bin of
its own and no stand-in value. Rows that share all their bins have one score in every round and add up to
one row with their number and the sum of their labels, which is exact, so that it does not depend on their
order. They are packed into blocks, which keep their bins and their running score. A tree grows best-first
up to its number of leaves. Histograms of gradients are summed in two steps, inside tasks and then by leaf
and feature in Spark, where each feature's best split is found as well, holes on either side; the driver
sees one row for each open leaf and feature.

Growing best-first takes one pass over the blocks for each level, not for each split: a pass looks at
the children of every leaf that may still be split (as many of the best as leaves are left to make),
and splits are then taken in order of their gain as long as the children of the next are known. The
sums of a split give its leaves' values, so the last splits need no pass. What a row costs does not
depend on the number of trees; blocks are checkpointed every few trees. Up to ``PARTITION_ROWS`` rows with
different bins there is one partition, whose task makes the passes of all rounds by itself.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nodalis.operators.graphs import cut, laid

HOLE, WIDTH = 255, 256  # the bin of holes, bins of a feature
BLOCK_ROWS = 1 << 16
PARTITION_ROWS = 1 << 18  # rows with different bins up to which there is one partition
CUT_EVERY = 16
LEAST_HESSIAN = 1e-3
_BLOCK = "bins binary, n binary, y binary, score binary"
_TREE = ["feature", "bin", "hole_left", "left", "right", "value"]
_SPLITS = "leaf int, feature int, bin int, left boolean, gain double, gl double, hl double, nl double, gr double, hr double, nr double"


@dataclass(frozen=True)
class Settings:
    """``loss``: ``log`` for 0/1 labels, ``squares`` for numbers."""

    loss: str = "log"
    rounds: int = 200
    rate: float = 0.06
    leaves: int = 31
    min_leaf: int = 100
    l2: float = 1.0


@dataclass
class Tree:
    """Nodes by number: feature (-1: leaf), bin up to which values go left, side of holes, children, value."""

    feature: list[int] = field(default_factory=lambda: [-1])
    bin: list[int] = field(default_factory=lambda: [0])
    hole_left: list[bool] = field(default_factory=lambda: [False])
    left: list[int] = field(default_factory=lambda: [0])
    right: list[int] = field(default_factory=lambda: [0])
    value: list[float] = field(default_factory=lambda: [0.0])

    def split(self, node: int, best: Split) -> tuple[int, int]:
        a, b = len(self.feature), len(self.feature) + 1
        self.feature[node], self.bin[node], self.hole_left[node], self.left[node], self.right[node] = best.feature, best.bin, best.left, a, b
        for value in (best.left_value, best.right_value):
            for column, given in zip((self.feature, self.bin, self.hole_left, self.left, self.right, self.value), (-1, 0, False, 0, 0, value), strict=True):
                column.append(given)
        return a, b

    def arrays(self) -> tuple[np.ndarray, ...]:
        return tuple(np.array(x) for x in (self.feature, self.bin, self.hole_left, self.left, self.right, self.value))


@dataclass(frozen=True)
class Split:
    feature: int
    bin: int
    left: bool
    gain: float
    left_value: float
    right_value: float


def descend(tree: tuple[np.ndarray, ...], bins: np.ndarray) -> np.ndarray:
    """The leaf of every row; ``bins`` has a row for each feature."""
    feature, last, hole_left, left, right, _ = tree
    node, open_ = np.zeros(bins.shape[1], np.int64), np.arange(bins.shape[1])
    while True:
        open_ = open_[feature[node[open_]] >= 0]
        if not len(open_):
            return node
        at = node[open_]
        held = bins[feature[at], open_]
        goes_left = np.where(held == HOLE, hole_left[at], held <= last[at])
        node[open_] = np.where(goes_left, left[at], right[at])


def slopes(loss: str, score: np.ndarray, n: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and second derivatives of the loss by the score, over ``n`` rows with labels that add up to ``y``."""
    if loss == "squares":
        return n * score - y, n
    p = 1 / (1 + np.exp(-score))
    return n * p - y, n * p * (1 - p)


def best_split(sums: np.ndarray, settings: Settings) -> tuple | None:
    """The best split of one leaf by one feature from its (gradients, hessians, rows) by bin:
    (bin, holes left, gain, sums left, sums right); of equal ones the first, holes on the right first."""
    total, hole = sums.sum(axis=1), sums[:, HOLE]
    below = np.cumsum(sums[:, :HOLE], axis=1)
    found = None
    for left in (False, True) if hole[2] > 0 else (False,):
        lower = below + hole[:, None] if left else below
        upper = total[:, None] - lower
        fits = (lower[2] >= settings.min_leaf) & (upper[2] >= settings.min_leaf) & (lower[1] >= LEAST_HESSIAN) & (upper[1] >= LEAST_HESSIAN)
        if not fits.any():
            continue
        gain = np.where(fits, lower[0] ** 2 / (lower[1] + settings.l2) + upper[0] ** 2 / (upper[1] + settings.l2) - total[0] ** 2 / (total[1] + settings.l2), -np.inf)
        at = int(gain.argmax())
        if gain[at] > 0 and (found is None or gain[at] > found[2]):
            found = at, left, float(gain[at]), lower[:, at], upper[:, at]
    if found and not hole[2]:  # holes that come later follow the larger side
        found = found[0], bool(found[3][2] > found[4][2]), *found[2:]
    return found


def edges_of(rows: DataFrame, features: list[str], accuracy: int = 10_000) -> list[np.ndarray]:
    """Upper ends of every feature's bins but the last: at most 254 quantiles of its values."""
    shares = [i / (HOLE - 1) for i in range(1, HOLE)]
    found = rows.agg(*(F.percentile_approx(F.nullif(F.col(f).cast("double"), F.lit(float("nan"))), shares, accuracy).alias(f"q{i}") for i, f in enumerate(features))).head()
    return [np.unique(np.array(q or [], float))[:-1] for q in found]


def binned(columns: list[np.ndarray], edges: list[np.ndarray]) -> np.ndarray:
    out = np.empty((len(columns), len(columns[0]) if columns else 0), np.uint8)
    for i, (x, ends) in enumerate(zip(columns, edges, strict=True)):
        out[i] = np.where(np.isnan(x), HOLE, np.searchsorted(ends, x, side="left"))
    return out


def _columns(batch: pa.RecordBatch, names: list[str]) -> list[np.ndarray]:
    return [batch.column(n).cast(pa.float64()).to_numpy(zero_copy_only=False) for n in names]


def merged(rows: DataFrame, features: list[str], label: str, edges: list[np.ndarray], largest: float, count: int) -> DataFrame:
    """(bins, n, y): the rows of equal bins as one, with their number and the sum of their labels. Labels are added as
    whole numbers of two units, of which the finer one is far below the last bit of the ``largest``."""
    names = [f"f{i}" for i in range(len(features))]
    plain = rows.select(*(F.col(f).cast("double").alias(n) for f, n in zip(features, names, strict=True)), F.col(label).cast("double").alias("y"))

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            packed = np.ascontiguousarray(binned(_columns(batch, names), edges).T)
            ends = np.arange(batch.num_rows + 1, dtype=np.int32) * len(names)
            bins = pa.Array.from_buffers(pa.binary(), batch.num_rows, [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(packed.tobytes())])
            yield pa.RecordBatch.from_arrays([bins, batch.column("y")], ["bins", "y"])

    bits = 61 - count.bit_length()
    scaled = F.col("y") * 2.0 ** (bits - np.frexp(largest)[1])
    coarse, fine = F.floor(scaled), F.floor((scaled - F.floor(scaled)) * 2.0**bits)
    sums = plain.mapInArrow(put, "bins binary, y double").groupBy("bins").agg(F.count(F.lit(1)).alias("n"), F.sum(coarse).alias("coarse"), F.sum(fine).alias("fine"))
    return sums.select("bins", F.col("n").cast("double").alias("n"), ((F.col("coarse") + F.col("fine") * 2.0**-bits) * 2.0 ** (np.frexp(largest)[1] - bits)).alias("y"))


def blocks_of(rows: DataFrame, n_features: int, start: float) -> DataFrame:
    """(bins, n, y, score): the partitions' rows (bins, n, y), packed in their order of bins."""

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (whole.slice(i, BLOCK_ROWS) for whole in batches for i in range(0, whole.num_rows, BLOCK_ROWS)):
            bins = np.frombuffer(b"".join(batch.column("bins").to_pylist()), np.uint8).reshape(-1, n_features)
            values = np.ascontiguousarray(bins.T), *_columns(batch, ["n", "y"]), np.full(batch.num_rows, start)
            yield pa.RecordBatch.from_arrays([pa.array([v.tobytes()], pa.binary()) for v in values], ["bins", "n", "y", "score"])

    return rows.sortWithinPartitions("bins").mapInArrow(packed, _BLOCK)


def _opened(batches: Iterator[pa.RecordBatch], n_features: int) -> Iterator[tuple[np.ndarray, ...]]:
    for batch in batches:
        for bins, *others in zip(*(batch.column(c).to_pylist() for c in ("bins", "n", "y", "score")), strict=True):
            yield np.frombuffer(bins, np.uint8).reshape(n_features, -1), *map(np.frombuffer, others)


def _scored(blocks: DataFrame, tree: tuple[np.ndarray, ...], n_features: int) -> DataFrame:
    """The blocks with a tree's values added to their scores."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            new = [(score + tree[5][descend(tree, bins)]).tobytes() for bins, _, _, score in _opened([batch], n_features)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("bins", "n", "y")), pa.array(new, pa.binary())], ["bins", "n", "y", "score"])

    return blocks.mapInArrow(add, blocks.schema)


def _histogram(bins: np.ndarray, g: np.ndarray, h: np.ndarray, n: np.ndarray, at: np.ndarray, leaves: int) -> np.ndarray:
    """Sums of gradients, hessians and rows by leaf, feature and bin; ``at`` is each row's leaf."""
    sums = np.zeros((leaves, len(bins), 3, WIDTH))
    for f in range(len(bins)):
        place = at * WIDTH + bins[f]
        for i, weights in enumerate((g, h, n)):
            sums[:, f, i] = np.bincount(place, weights, leaves * WIDTH).reshape(-1, WIDTH)
    return sums


def _split(feature: int, found: tuple, settings: Settings) -> Split:
    value = lambda sums: -settings.rate * sums[0] / (sums[1] + settings.l2)
    return Split(feature, *found[:3], value(found[3]), value(found[4]))


def _best_splits(blocks: DataFrame, tree: tuple[np.ndarray, ...], wanted: list[int], n_features: int, settings: Settings) -> dict[int, Split]:
    """The best split of each wanted leaf, in one pass over the blocks."""
    slot = np.full(len(tree[0]), -1)
    slot[wanted] = np.arange(len(wanted))

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        sums = None
        for bins, n, y, score in _opened(batches, n_features):
            at = slot[descend(tree, bins)]
            mine = np.flatnonzero(at >= 0)
            g, h = slopes(settings.loss, score[mine], n[mine], y[mine])
            more = _histogram(bins[:, mine], g, h, n[mine], at[mine], len(wanted))
            sums = more if sums is None else sums + more
        if sums is not None:
            leaf, feature = np.divmod(np.arange(len(wanted) * n_features), n_features)
            arrays = [leaf.astype(np.int32), feature.astype(np.int32), np.full(len(leaf), TaskContext.get().partitionId(), np.int32)]
            yield pa.RecordBatch.from_arrays([*map(pa.array, arrays), pa.array([sums[i, f].tobytes() for i, f in zip(leaf, feature, strict=True)], pa.binary())], ["leaf", "feature", "part", "sums"])

    def rows_of(found: list[tuple[int, int, tuple]]) -> pa.RecordBatch:
        rows = [(leaf, feature, *x[:3], *map(float, x[3]), *map(float, x[4])) for leaf, feature, x in found]
        names = ["leaf", "feature", "bin", "left", "gain", "gl", "hl", "nl", "gr", "hr", "nr"]
        kinds = [pa.int32(), pa.int32(), pa.int32(), pa.bool_(), *[pa.float64()] * 7]
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)], names)

    def split(key: tuple, parts: pa.Table) -> pa.Table:
        order = np.argsort(parts.column("part").to_numpy())
        packed = parts.column("sums").to_pylist()
        total = np.zeros((3, WIDTH))
        for i in order:  # in one order, so that runs agree
            total += np.frombuffer(packed[i]).reshape(3, WIDTH)
        best = best_split(total, settings)
        return pa.Table.from_batches([rows_of([(key[0].as_py(), key[1].as_py(), best)] if best else [])])

    found = blocks.mapInArrow(summed, "leaf int, feature int, part int, sums binary").groupBy("leaf", "feature").applyInArrow(split, _SPLITS).collect()
    best: dict[int, Split] = {}
    for r in sorted(found, key=lambda r: (-r.gain, r.feature)):  # a row for each wanted leaf and feature
        best.setdefault(wanted[r.leaf], _split(r.feature, (r.bin, r.left, r.gain, (r.gl, r.hl), (r.gr, r.hr)), settings))
    return best


def grow(best_of: Callable[[Tree, list[int]], dict[int, Split]], settings: Settings) -> Tree:
    """A tree grown best-first. ``best_of(tree, leaves)`` finds the best splits of leaves, where they have any."""
    trial, tree = Tree(), Tree()
    known: dict[int, Split | None] = {0: best_of(trial, [0]).get(0)}
    children: dict[int, tuple[int, int]] = {}
    own = {0: 0}  # open leaves: their node in the trial tree, and in the tree
    while len(own) < settings.leaves:
        ranked = sorted((n for n in own if known[n]), key=lambda n: (-known[n].gain, n))
        if not ranked:
            break
        first, left = ranked[0], settings.leaves - len(own)
        if left > 1 and not (first in children and children[first][0] in known):
            fresh = [n for n in ranked[:left] if n not in children]
            for n in fresh:
                children[n] = trial.split(n, known[n])
            leaves = [c for n in fresh for c in children[n]]
            found = best_of(trial, leaves)
            known |= {c: found.get(c) for c in leaves}
        a, b = tree.split(own.pop(first), known[first])
        if first in children:
            own |= {children[first][0]: a, children[first][1]: b}
        else:
            break  # the last split: its leaves stay leaves
    return tree


@dataclass
class Model:
    features: list[str]
    edges: list[np.ndarray]
    start: float
    trees: list[tuple[np.ndarray, ...]]
    loss: str

    def predict(self, rows: DataFrame, name: str) -> DataFrame:
        """``rows`` with the model's score as ``name``: a probability for ``log``."""
        inputs = [f"_feature{i}" for i in range(len(self.features))]
        given = rows.drop(name).select("*", *(F.col(f).cast("double").alias(i) for f, i in zip(self.features, inputs, strict=True)))
        kept, model = [c for c in rows.columns if c != name], self
        schema = given.select(*kept, F.lit(0.0).alias(name)).schema

        def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                bins, score = binned(_columns(batch, inputs), model.edges), np.full(batch.num_rows, model.start)
                for tree in model.trees:
                    score = score + tree[5][descend(tree, bins)]
                score = 1 / (1 + np.exp(-score)) if model.loss == "log" else score
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(score)], [*kept, name])

        return given.mapInArrow(scored, schema)


def _all_rounds(blocks: DataFrame, n_features: int, settings: Settings) -> list[tuple[np.ndarray, ...]]:
    """The trees of blocks in one partition, grown by its task."""

    def grown(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = list(_opened(batches, n_features))
        if not parts:
            return
        bins, (n, y, score) = np.concatenate([p[0] for p in parts], axis=1), (np.concatenate([p[i] for p in parts]) for i in (1, 2, 3))
        for _ in range(settings.rounds):
            g, h = slopes(settings.loss, score, n, y)
            inside = {0: np.arange(len(n))}  # the rows of every leaf of the trial tree

            def best_of(trial: Tree, leaves: list[int], g: np.ndarray = g, h: np.ndarray = h, inside: dict[int, np.ndarray] = inside) -> dict[int, Split]:
                for node in [i for i in inside if trial.feature[i] >= 0]:
                    rows = inside.pop(node)
                    held = bins[trial.feature[node], rows]
                    goes_left = np.where(held == HOLE, trial.hole_left[node], held <= trial.bin[node])
                    inside[trial.left[node]], inside[trial.right[node]] = rows[goes_left], rows[~goes_left]
                best = {}
                for leaf in leaves:
                    rows = inside[leaf]
                    sums = _histogram(bins[:, rows], g[rows], h[rows], n[rows], np.zeros(len(rows), int), 1)[0]
                    found = [(f, x) for f in range(n_features) if (x := best_split(sums[f], settings))]
                    if found:
                        best[leaf] = _split(*max(found, key=lambda x: (x[1][2], -x[0])), settings)
                return best

            tree = grow(best_of, settings).arrays()
            if len(tree[0]) == 1:
                return  # no split gains anything, nor will one later
            score = score + tree[5][descend(tree, bins)]
            yield pa.RecordBatch.from_arrays([pa.array([x.tolist()]) for x in tree], _TREE)

    kinds = ["array<long>", "array<long>", "array<boolean>", "array<long>", "array<long>", "array<double>"]
    return [tuple(map(np.array, r)) for r in blocks.mapInArrow(grown, ", ".join(map(" ".join, zip(_TREE, kinds, strict=True)))).collect()]


def fit(rows: DataFrame, features: list[str], label: str, settings: Settings) -> Model:
    """A model of ``label``. No rows give a score of 0, rows of one label its own (clipped) score."""
    rows = laid(rows.where(F.col(label).isNotNull()).select(*dict.fromkeys([*features, label])))  # read three times
    y = F.col(label).cast("double")
    mean, largest, n = rows.agg(F.avg(y), F.max(F.abs(y)), F.count(F.lit(1))).head()
    if mean is None:
        return Model(features, [np.zeros(0)] * len(features), 0.0, [], settings.loss)
    if not np.isfinite(largest):
        raise ValueError("labels must be finite")
    clipped = min(max(mean, 1e-12), 1 - 1e-12)
    start = float(np.log(clipped / (1 - clipped))) if settings.loss == "log" else mean
    edges = edges_of(rows, features)
    plain = laid(merged(rows, features, label, edges, largest, n))
    different = plain.count()
    if different <= PARTITION_ROWS:
        return Model(features, edges, start, _all_rounds(blocks_of(plain.coalesce(1), len(features), start), len(features), settings), settings.loss)
    blocks = cut(blocks_of(plain.repartition(max(2, different // (4 * BLOCK_ROWS)), "bins"), len(features), start))
    trees: list[tuple[np.ndarray, ...]] = []
    kept: list[DataFrame] = []  # persisted blocks, the newest last
    for i in range(settings.rounds):
        tree = grow(lambda trial, leaves: _best_splits(blocks, trial.arrays(), leaves, len(features), settings), settings)
        for old in kept[:-1]:  # what they led to has been read by now
            old.unpersist()
        kept = kept[-1:]
        if len(tree.feature) == 1:
            break  # no split gains anything, nor will one later
        trees.append(tree.arrays())
        blocks = _scored(blocks, trees[-1], len(features))
        if (i + 1) % CUT_EVERY == 0:
            blocks = cut(blocks)
        else:
            blocks = blocks.persist()
            kept.append(blocks)
    for old in kept:
        old.unpersist()
    return Model(features, edges, start, trees, settings.loss)
