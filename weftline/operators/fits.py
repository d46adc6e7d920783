"""Models fitted on sums: tasks scan rows in batches and send sums of the size of the features; no row reaches the driver."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

#: Penalties that a ridge fit chooses from.
ALPHAS = tuple(10 ** (-1 + 5 * i / 23) for i in range(24))


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def _ready(rows: DataFrame, features: str, *columns: str) -> DataFrame:
    known = rows.filter(F.col(features).isNotNull())
    for c in columns:
        known = known.filter(F.col(c).isNotNull())
    return known


def summed(rows: DataFrame, add: Callable[[pa.RecordBatch], dict[int, np.ndarray]]) -> dict[int, np.ndarray]:
    """For each key the sum of the arrays that add() gives batches of rows: added up by task, then cell by cell."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            if batch.num_rows:
                for key, part in add(batch).items():
                    held[key] = held[key] + part if key in held else part
        for key, part in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([key], pa.int64()), pa.array([part.ravel()], pa.list_(pa.float64()))], ["key", "cells"])

    cells = rows.mapInArrow(run, "key long, cells array<double>").select("key", F.posexplode("cells").alias("cell", "x"))
    told = cells.groupBy("key", "cell").agg(F.sum("x").alias("x")).toArrow()  # one number a cell
    keys, places, x = (told.column(c).to_numpy() for c in ("key", "cell", "x"))
    order = np.lexsort((places, keys))
    ends = np.flatnonzero(np.diff(keys[order])) + 1
    return {int(keys[part[0]]): x[part] for part in np.split(order, ends) if len(part)}


# ---- ridge
@dataclass
class Linear:
    """A linear model, the penalty it was given, and the squared error by which that was chosen."""

    weights: np.ndarray
    intercept: float
    alpha: float
    error: float


def grams(rows: DataFrame, features: str, target: str, fold: str) -> dict[int, np.ndarray]:
    """By fold the products of all pairs of (1, features, target), summed over its rows; rows that lack one don't count."""

    def add(batch: pa.RecordBatch) -> dict[int, np.ndarray]:
        x, y, of = _matrix(batch.column("x")), batch.column("y").to_numpy(), batch.column("f").to_numpy()
        whole = np.column_stack([np.ones(len(x)), x, y])
        return {int(f): whole[of == f].T @ whole[of == f] for f in np.unique(of)}

    known = _ready(rows, features, target, fold).select(F.col(features).cast("array<double>").alias("x"), F.col(target).cast("double").alias("y"), F.col(fold).cast("long").alias("f"))
    return {f: cells.reshape(int(len(cells) ** 0.5), -1) for f, cells in summed(known, add).items()}


def ridge(gram: np.ndarray, alpha: float) -> tuple[np.ndarray, float]:
    """Weights and intercept of a ridge fit on features scaled to deviation 1; one without deviation stays as it is."""
    n, mean, target = gram[0, 0], gram[0, 1:-1] / gram[0, 0], gram[0, -1] / gram[0, 0]
    spread = np.sqrt(np.maximum(np.diag(gram)[1:-1] / n - mean**2, 0))
    spread[spread < 1e-12] = 1.0
    within = (gram[1:-1, 1:-1] - n * np.outer(mean, mean)) / np.outer(spread, spread)
    across = (gram[1:-1, -1] - n * mean * target) / spread
    weights = np.linalg.solve(within + alpha * np.eye(len(mean)), across) / spread
    return weights, float(target - mean @ weights)


def squared_error(gram: np.ndarray, weights: np.ndarray, intercept: float) -> float:
    """The squared errors that a model makes on the rows of a Gram matrix."""
    residual = np.concatenate([[-intercept], -weights, [1.0]])
    return float(residual @ gram @ residual)


def chosen_ridge(folds: dict[int, np.ndarray], alphas: tuple[float, ...] = ALPHAS) -> Linear:
    """A ridge fit on all folds, with the penalty that does best on each fold when fitted on the others; the smallest of equals."""
    whole = sum(folds.values())
    errors = [sum(squared_error(gram, *ridge(whole - gram, a)) for gram in folds.values()) if len(folds) > 1 else 0.0 for a in alphas]
    best = int(np.argmin(errors))
    return Linear(*ridge(whole, alphas[best]), alphas[best], errors[best])


def nested_ridge(folds: dict[int, np.ndarray], alphas: tuple[float, ...] = ALPHAS) -> dict[int, Linear]:
    """For each fold a model that has seen nothing of it: fitted on the others, its penalty chosen among them alone."""
    if len(folds) < 2:
        raise ValueError("a fit out of fold needs two folds at least")
    return {f: chosen_ridge({g: gram for g, gram in folds.items() if g != f}, alphas) for f in sorted(folds)}


# ---- logistic and softmax
@dataclass
class Logits:
    """Weights (a row a class, or one row of a yes-or-no model) and intercepts; classes in order."""

    weights: np.ndarray
    intercepts: np.ndarray
    classes: list[str]


def logistic(rows: DataFrame, features: str, target: str, penalty: float = 1.0, intercept: bool = True, balanced: bool = False, rounds: int = 50, mirrored: bool = False) -> Logits:
    """A yes-or-no model by Newton's steps on summed gradients and Hessians: the least of the sum of log losses and penalty / 2 times the
    squared weights, the intercept free. balanced gives both answers the same weight. Rows that lack a column don't count.

    mirrored: each row, all of which say yes, counts a second time as its negative that says no; without an intercept that has the same loss, so no such row is made."""
    if mirrored and intercept:
        raise ValueError("mirrored rows leave nothing for an intercept")
    data = _ready(rows, features, target).select(F.col(features).cast("array<double>").alias("x"), F.col(target).cast("double").alias("y")).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        counts = {r["y"]: r["n"] for r in data.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}  # two rows
        if set(counts) != ({1.0} if mirrored else {0.0, 1.0}):
            raise ValueError(f"the target must have both answers and no third: {sorted(counts)}")
        width = len(data.select("x").first()["x"])
        share = {0.0: 0.0, 1.0: 2.0} if mirrored else {y: sum(counts.values()) / (2 * n) if balanced else 1.0 for y, n in counts.items()}
        beta = np.zeros(width + intercept)
        ridge_of = np.full(len(beta), penalty)
        if intercept:
            ridge_of[-1] = 0.0

        def measure(at: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
            def add(batch: pa.RecordBatch) -> dict[int, np.ndarray]:
                x, y = _matrix(batch.column("x")), batch.column("y").to_numpy()
                x = np.column_stack([x, np.ones(len(x))]) if intercept else x
                z = x @ at
                s = np.where(y == 1, share[1.0], share[0.0])
                p = 1 / (1 + np.exp(-np.clip(z, -700, 700)))
                loss = s @ (np.logaddexp(0, z) - y * z)
                return {0: np.concatenate([[loss], (s * (p - y)) @ x, (x.T @ ((s * p * (1 - p))[:, None] * x)).ravel()])}

            sums = summed(data, add)[0]
            n = len(at)
            return float(sums[0] + 0.5 * (ridge_of * at) @ at), sums[1 : n + 1] + ridge_of * at, sums[n + 1 :].reshape(n, n) + np.diag(ridge_of)

        loss, slope, bend = measure(beta)
        for _ in range(rounds):
            step = np.linalg.solve(bend + 1e-12 * np.eye(len(beta)), slope)
            if np.abs(step).max() < 1e-9:
                break
            size = 1.0
            while True:
                tried = measure(beta - size * step)
                if tried[0] <= loss + 1e-12 * abs(loss) or size < 1e-6:
                    break
                size /= 2
            beta = beta - size * step
            loss, slope, bend = tried
        return Logits(beta[None, :width], beta[width:] if intercept else np.zeros(1), ["yes"])
    finally:
        data.unpersist()


def softmax(rows: DataFrame, features: str, label: str, penalty: float = 0.1, balanced: bool = True, rounds: int = 200, close: float = 1e-4) -> Logits:
    """A model of several classes: the least of the sum of log losses and penalty / 2 times the squared weights, intercepts free.

    Steps are quasi-Newton, each on one scan's loss and gradient, classes x features numbers; the first bend is half the weighted Gram matrix
    of the features, which bounds every class's Hessian. They end once no slope is over `close` of the steepest at the start. Classes are the labels as text, in order; balanced gives all the same weight.
    Rows that lack a column don't count.
    """
    data = _ready(rows, features, label).select(F.col(features).cast("array<double>").alias("x"), F.col(label).cast("string").alias("y")).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        counts = dict(data.groupBy("y").agg(F.count(F.lit(1))).collect())  # a row a class
        classes = sorted(counts)
        if len(classes) < 2:
            raise ValueError("a model of classes needs two at least")
        place = {c: i for i, c in enumerate(classes)}
        share = np.array([sum(counts.values()) / (len(classes) * counts[c]) if balanced else 1.0 for c in classes])
        width = len(data.select("x").first()["x"]) + 1
        free = np.full(width, penalty)
        free[-1] = 0.0

        def parts(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            x = _matrix(batch.column("x"))
            y = np.array([place[c] for c in batch.column("y").to_pylist()])
            return np.column_stack([x, np.ones(len(x))]), y, share[y]

        def bound(batch: pa.RecordBatch) -> dict[int, np.ndarray]:
            x, _, s = parts(batch)
            return {0: x.T @ (s[:, None] * x)}

        def measure(at: np.ndarray) -> tuple[float, np.ndarray]:
            def add(batch: pa.RecordBatch) -> dict[int, np.ndarray]:
                x, y, s = parts(batch)
                z = x @ at.T
                z -= z.max(axis=1, keepdims=True)
                total = np.log(np.exp(z).sum(axis=1))
                p = np.exp(z - total[:, None])
                loss = s @ (total - z[np.arange(len(y)), y])
                p[np.arange(len(y)), y] -= 1
                return {0: np.concatenate([[loss], ((s[:, None] * p).T @ x).ravel()])}

            sums = summed(data, add)[0]
            return float(sums[0] + 0.5 * (free * at * at).sum()), sums[1:].reshape(at.shape) + free * at

        gram = summed(data, bound)[0].reshape(width, width)
        inverse = np.linalg.inv(0.5 * gram + np.diag(free) + 1e-9 * np.trace(gram) / width * np.eye(width))
        at = np.zeros((len(classes), width))
        loss, slope = measure(at)
        start, past = np.abs(slope).max(), []
        for _ in range(rounds):
            if np.abs(slope).max() <= close * max(start, 1e-12):
                break
            step = _two_loops(slope, past, inverse)
            size, downhill = 1.0, (step * slope).sum()
            while True:
                tried = at - size * step
                new_loss, new_slope = measure(tried)
                if new_loss <= loss - 1e-4 * size * downhill or size < 1e-8:
                    break
                size /= 2
            past = [*past[-9:], (tried - at, new_slope - slope)]
            at, loss, slope = tried, new_loss, new_slope
        return Logits(at[:, :-1], at[:, -1], classes)
    finally:
        data.unpersist()


def _two_loops(slope: np.ndarray, past: list[tuple[np.ndarray, np.ndarray]], inverse: np.ndarray) -> np.ndarray:
    """The quasi-Newton direction from the last moves and changes of slope."""
    q, held = slope.copy(), []
    usable = [(s, y) for s, y in past if (s * y).sum() > 1e-12]
    for s, y in reversed(usable):
        a = (s * q).sum() / (s * y).sum()
        held.append(a)
        q = q - a * y
    r = q @ inverse
    for (s, y), a in zip(usable, reversed(held), strict=True):
        r = r + s * (a - (y * r).sum() / (s * y).sum())
    return r


def told(features: Column, weights: np.ndarray, intercepts: np.ndarray) -> Column:
    """weights x features + intercepts, one number a row of weights; null for null features."""

    @F.arrow_udf(ArrayType(DoubleType()))
    def score(x: pa.Array) -> pa.Array:
        out = np.flatnonzero(np.asarray(x.is_valid()))
        values: list = [None] * len(x)
        if len(out):
            for i, row in zip(out, _matrix(x.drop_null()) @ weights.T + intercepts, strict=True):
                values[i] = row
        return pa.array(values, pa.list_(pa.float64()))

    return score(features.cast("array<double>"))
