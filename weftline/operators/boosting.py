"""Gradient boosting on binned features: sums by class, node, feature and bin choose the splits, one job a level; only they reach the driver."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from weftline.operators.fits import _matrix, summed
from weftline.session_dirs import ensure_checkpoint_dir

#: Sums that a level may send: classes x nodes x features x bins x 3.
MOST_SUMS = 20_000_000
#: Rounds after which scores are written out, so that no lineage grows with the rounds.
WRITE_EVERY = 10


@dataclass
class Boosted:
    """Trees of one depth, a class each in every round: node i has the children 2 i + 1 and 2 i + 2. A row goes right where the bin of the
    node's feature is over its cut; a leaf's value is added to the class's score."""

    edges: np.ndarray
    classes: list[str]
    start: np.ndarray
    depth: int
    rounds: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=list)

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.column_stack([np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(self.edges)]).astype(np.uint8)

    def scores(self, bins: np.ndarray) -> np.ndarray:
        out = np.tile(self.start, (len(bins), 1))
        for trees in self.rounds:
            out += self.gain(bins, trees)
        return out

    def gain(self, bins: np.ndarray, trees: tuple[np.ndarray, np.ndarray, np.ndarray]) -> np.ndarray:
        features, cuts, values = trees
        leaves = _leaves(bins, features, cuts, self.depth)
        return np.column_stack([values[k][leaves[:, k]] for k in range(len(self.classes))])


def _leaves(bins: np.ndarray, features: np.ndarray, cuts: np.ndarray, depth: int) -> np.ndarray:
    """For each row and class the node that it is in after so many levels, counted from 0 within its level."""
    at = np.zeros((len(bins), len(features)), np.int64)
    rows = np.arange(len(bins))
    for level in range(depth):
        for k in range(len(features)):
            node = at[:, k] + (1 << level) - 1
            at[:, k] = 2 * at[:, k] + (bins[rows, features[k][node]] > cuts[k][node])
    return at


def _chances(scores: np.ndarray) -> np.ndarray:
    p = np.exp(scores - scores.max(axis=1, keepdims=True))
    return p / p.sum(axis=1, keepdims=True)


def _bytes(column: pa.Array, dtype: type, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype).reshape(len(column), width)


def fit(rows: DataFrame, features: str, label: str, rounds: int = 20, depth: int = 3, rate: float = 0.1, bins: int = 32, least_rows: int = 5, penalty: float = 1.0) -> Boosted:
    """A model of the labels, all of the same weight. Rows that lack features or label don't count; all feature arrays are of one length.

    Features are cut at quantiles into `bins`. In a round each class's tree grows level by level: a job sums gradients, Hessians and rows by class,
    node, feature and bin, and each node takes the cut that gains most with least_rows on either side; a node without one sends all rows left.
    """
    spark = rows.sparkSession
    ensure_checkpoint_dir(spark)
    known = rows.filter(F.col(features).isNotNull() & F.col(label).isNotNull()).select(F.col(features).cast("array<double>").alias("x"), F.col(label).cast("string").alias("y"))
    known = known.persist(StorageLevel.MEMORY_AND_DISK)
    counts = dict(known.groupBy("y").agg(F.count(F.lit(1))).collect())  # a row a class
    classes = sorted(counts)
    if len(classes) < 2:
        raise ValueError("a model of classes needs two at least")
    shares = [i / bins for i in range(1, bins)]
    cuts_of = known.select(F.posexplode("x").alias("f", "v")).groupBy("f").agg(F.percentile_approx("v", shares, 10_000).alias("q")).orderBy("f").collect()  # a row a feature
    edges, width, n_classes = np.array([r["q"] for r in cuts_of]), len(cuts_of), len(classes)
    if n_classes * (1 << (depth - 1)) * width * bins * 3 > MOST_SUMS:
        raise ValueError(f"a level would send over {MOST_SUMS} sums; take fewer bins or a smaller depth")
    place, weight = {c: i for i, c in enumerate(classes)}, np.array([sum(counts.values()) / (n_classes * counts[c]) for c in classes])
    model = Boosted(edges, classes, np.zeros(n_classes), depth)

    def begin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                b = model.bins(_matrix(batch.column("x")))
                y = [place[c] for c in batch.column("y").to_pylist()]
                yield _packed(b, y, np.tile(model.start, (len(b), 1)))

    def _packed(b: np.ndarray, y: list[int], scores: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r.tobytes() for r in b], pa.binary()), pa.array(y, pa.int32()), pa.array([r.tobytes() for r in scores], pa.binary())], ["b", "y", "s"])

    shape = "b binary, y int, s binary"
    now = known.mapInArrow(begin, shape).persist(StorageLevel.MEMORY_AND_DISK)
    nodes = (1 << depth) - 1
    for turn in range(rounds):
        cut_at, feature_at = np.full((n_classes, nodes), bins, np.int64), np.zeros((n_classes, nodes), np.int64)
        values = np.zeros((n_classes, 1 << depth))
        for level in range(depth):
            sums = _level_sums(now, feature_at, cut_at, level, width, n_classes, bins, weight)
            _choose(sums, feature_at, cut_at, values, level, depth, least_rows, penalty, rate)
        trees = (feature_at, cut_at, values)
        model.rounds.append(trees)
        if turn == rounds - 1:
            break

        def add(batches: Iterator[pa.RecordBatch], trees=trees) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    b, s = _bytes(batch.column("b"), np.uint8, width), _bytes(batch.column("s"), np.float64, n_classes)
                    yield _packed(b, batch.column("y").to_pylist(), s + model.gain(b, trees))

        after = now.mapInArrow(add, shape)
        after = after.checkpoint() if turn % WRITE_EVERY == WRITE_EVERY - 1 else after.persist(StorageLevel.MEMORY_AND_DISK)
        after.count()
        now.unpersist()
        now = after
    now.unpersist()
    known.unpersist()
    return model


def _level_sums(now: DataFrame, features: np.ndarray, cuts: np.ndarray, level: int, width: int, n_classes: int, bins: int, weight: np.ndarray) -> np.ndarray:
    """Gradients, Hessians and rows by class, node of the level, feature and bin."""
    shape = (3, n_classes, 1 << level, width, bins)

    def add(batch: pa.RecordBatch) -> dict[int, np.ndarray]:
        b, s = _bytes(batch.column("b"), np.uint8, width), _bytes(batch.column("s"), np.float64, n_classes)
        y = batch.column("y").to_numpy()
        p, w = _chances(s), weight[y]
        at = _leaves(b, features, cuts, level)
        out = np.zeros(shape)
        for k in range(n_classes):
            g, h = w * (p[:, k] - (y == k)), w * p[:, k] * (1 - p[:, k])
            cell = ((at[:, k, None] * width + np.arange(width)) * bins + b).ravel()
            for i, amount in enumerate((g, h, np.ones(len(b)))):
                out[i, k] = np.bincount(cell, np.repeat(amount, width), (1 << level) * width * bins).reshape(shape[2:])
        return {0: out}

    return summed(now, add)[0].reshape(shape)


def _choose(sums: np.ndarray, features: np.ndarray, cuts: np.ndarray, values: np.ndarray, level: int, depth: int, least_rows: int, penalty: float, rate: float) -> None:
    """Set each node's split of this level, and after the last level what the leaves add."""
    left = sums.cumsum(axis=4)[..., :-1]
    whole = sums.sum(axis=4, keepdims=True)
    right = whole - left
    worth = lambda s: s[0] ** 2 / (s[1] + penalty)
    gains = np.where((left[2] >= least_rows) & (right[2] >= least_rows), worth(left) + worth(right) - worth(whole), -np.inf)
    first = (1 << level) - 1
    for k in range(gains.shape[0]):
        for n in range(gains.shape[1]):
            best = int(np.argmax(gains[k, n]))
            f, b = divmod(best, gains.shape[3])
            splits = gains[k, n, f, b] > 1e-9
            if splits:
                features[k, first + n], cuts[k, first + n] = f, b
            if level == depth - 1:
                sides = (left[:, k, n, f, b], right[:, k, n, f, b]) if splits else (whole[:, k, n, 0, 0], np.zeros(3))
                values[k, 2 * n : 2 * n + 2] = [-rate * s[0] / (s[1] + penalty) for s in sides]


def chances(features: Column, model: Boosted) -> Column:
    """The chance of each class, in the model's order; null for null features."""

    @F.arrow_udf(ArrayType(DoubleType()))
    def told(x: pa.Array) -> pa.Array:
        values: list = [None] * len(x)
        held = np.flatnonzero(np.asarray(x.is_valid()))
        if len(held):
            for i, row in zip(held, _chances(model.scores(model.bins(_matrix(x.drop_null())))), strict=True):
                values[i] = row
        return pa.array(values, pa.list_(pa.float64()))

    return told(features.cast("array<double>"))


def top(chances_of: Column, classes: list[str], k: int = 3) -> Column:
    """The k likeliest classes (value, conf), best first, equal ones by name; conf to three places, none of chance 0."""
    names = F.array(*[F.lit(c) for c in classes])
    ranked = F.array_sort(F.zip_with(names, chances_of, lambda c, p: F.struct((-p).alias("low"), c.alias("value"))))
    best = F.filter(F.slice(ranked, 1, k), lambda s: s["low"] < 0)
    return F.transform(best, lambda s: F.struct(s["value"].alias("value"), F.round(-s["low"], 3).alias("conf")))
