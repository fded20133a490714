"""One-vs-rest linear SVM of dense vectors: squared hinge loss, L2 or L1 penalty, all classes in one pass.

The vectors are packed once into blocks. An iteration is one job: every task adds up sums of all columns over its
blocks, the sums are merged by a tree, and the driver takes a step per column; nothing there grows with the rows.
A column is one class of one parameter point and one fold, so a whole grid is searched in shared passes.

The ``FEW`` columns of a single fit take Newton steps on loss, gradient and curvature, (width x width) numbers each;
the L1 penalty is met by a proximal one (coordinate descent on the penalised quadratic), which gives exact zeros. The
many columns of a grid need no curvature: they take limited-memory quasi-Newton steps on loss and gradient, more
passes that are far cheaper, and under L1 stay in the orthant of the last weights, which gives exact zeros too.
"""

from collections.abc import Iterator
from dataclasses import dataclass
from multiprocessing.pool import ThreadPool

import numpy as np
import pandas as pd
from pyspark import TaskContext, inheritable_thread_target, keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasFeaturesCol, HasLabelCol, HasMaxIter, HasTol
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talentspark.functions.scores import argmax
from talentspark.session import BLOCK_TABLE, settle_table, small_batches

MAX_WIDTH = 2_048  # wider vectors have no dense curvature
SUM_BYTES = 16 << 20  # of one task's sums; more columns take more passes
FAN_IN = 8
BLOCK_ROWS = 256  # a pass holds some blocks at a time
TASKS = 2  # of a pass, for each core: each sends its sums
FEW = 16  # columns that take Newton steps
MEMORY = 10  # steps that a column remembers
PARALLEL = 4  # groups of columns at a time
TOLERANCE = 1e-5  # of the gradient's norm against that at zero
SWEEPS = 200
CLOSE = 1e-7  # a coordinate's last move


@dataclass(frozen=True)
class Columns:
    """What the columns of a solution stand for."""

    target: np.ndarray  # class against the rest
    cost: np.ndarray  # (columns, classes): cost of a violation by a row of a class
    held: np.ndarray  # fold that is left out, -1 for none
    l1: np.ndarray  # whether the penalty is L1

    def part(self, use) -> "Columns":
        return Columns(self.target[use], self.cost[use], self.held[use], self.l1[use])


def packed(vectors: DataFrame, features: str, label: str, fold: str | None = None) -> DataFrame:
    """(x, y, fold): blocks of rows with a constant 1 as the last feature; written once, as every pass reads them."""
    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), BLOCK_ROWS):
                part = batch.iloc[at:at + BLOCK_ROWS]
                x = np.stack(part["x"].to_numpy()).astype(np.float32)
                x = np.hstack([x, np.ones((len(x), 1), np.float32)])
                y, f = part["y"].to_numpy(np.int16), part["fold"].to_numpy(np.int16)
                yield pd.DataFrame({"x": [x.tobytes()], "y": [y.tobytes()], "fold": [f.tobytes()]})

    small_batches(vectors.sparkSession)
    fold_of = F.coalesce(F.col(fold).cast("int"), F.lit(-1)) if fold else F.lit(-1)
    rows = vectors.select(vector_to_array(features, "float32").alias("x"), F.col(label).cast("int").alias("y"), fold_of.alias("fold"))
    return few_tasks(settle_table(rows.mapInPandas(pack, "x binary, y binary, fold binary"), "svm-blocks", **BLOCK_TABLE))


def few_tasks(blocks: DataFrame) -> DataFrame:
    """The blocks in as many partitions as keep all cores busy: what a pass sends does not grow with the rows."""
    most = TASKS * blocks.sparkSession.sparkContext.defaultParallelism
    return blocks.coalesce(most) if blocks.rdd.getNumPartitions() > most else blocks


def _blocks(frames: Iterator[pd.DataFrame], width: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    for frame in frames:
        for x, y, f in zip(frame["x"], frame["y"], frame["fold"], strict=True):
            yield np.frombuffer(x, np.float32).reshape(-1, width).astype(float), np.frombuffer(y, np.int16), np.frombuffer(f, np.int16)


def summed(parts: DataFrame, number: int) -> np.ndarray:
    """Sum of equally long double vectors (``key int``, ``v binary``) of ``number`` tasks, by a tree."""
    def add(frame: pd.DataFrame) -> pd.DataFrame:
        total = np.sum([np.frombuffer(v) for v in frame["v"]], axis=0)
        return pd.DataFrame({"key": [int(frame["key"].iloc[0]) // FAN_IN], "v": [total.tobytes()]})

    while number > FAN_IN:
        parts = parts.groupBy(F.floor(F.col("key") / FAN_IN)).applyInPandas(add, "key int, v binary")
        number = -(-number // FAN_IN)
    return np.sum([np.frombuffer(row["v"]) for row in parts.collect()], axis=0)


def over_blocks(blocks: DataFrame, size: int, add) -> np.ndarray:
    """One pass: ``add(total, frames)`` adds a task's blocks to ``size`` numbers; the sum over all tasks."""
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(size)
        add(total, frames)
        yield pd.DataFrame({"key": [TaskContext.get().partitionId()], "v": [total.tobytes()]})

    return summed(blocks.mapInPandas(run, "key int, v binary"), blocks.rdd.getNumPartitions())


def sums(blocks: DataFrame, w: np.ndarray, columns: Columns) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(loss, gradient, curvature) of the columns ``w`` (width, columns) without the penalty."""
    width, n = w.shape
    upper = np.triu_indices(width)
    target, cost, held = columns.target, columns.cost, columns.held

    def add(total: np.ndarray, frames: Iterator[pd.DataFrame]) -> None:
        loss, gradient, curvature = np.split(total, [n, n + width * n])
        gradient, curvature = gradient.reshape(width, n), curvature.reshape(n, -1)
        square = np.zeros((n, width, width))
        for x, y, fold in _blocks(frames, width):
            sign = np.where(y[:, None] == target, 1.0, -1.0)
            c = np.where(fold[:, None] == np.where(held < 0, -2, held), 0.0, cost[:, y].T)
            slack = np.maximum(0.0, 1.0 - sign * (x @ w))
            loss += (c * slack * slack).sum(0)
            gradient += x.T @ (-2.0 * c * slack * sign)
            for m in range(n):
                on = np.flatnonzero((slack[:, m] > 0) & (c[:, m] > 0))
                some = x[on]
                square[m] += some.T @ (2.0 * c[on, m, None] * some)
        curvature += square[:, upper[0], upper[1]]

    total = over_blocks(blocks, n + width * n + n * len(upper[0]), add)
    loss, gradient, curvature = np.split(total, [n, n + width * n])
    square = np.zeros((n, width, width))
    square[:, upper[0], upper[1]] = curvature.reshape(n, -1)
    square = square + np.triu(square, 1).transpose(0, 2, 1)
    return loss, gradient.reshape(width, n), square


class Descent:
    """Quasi-Newton steps of some columns, side by side; each column has its own step length and penalty."""

    def __init__(self, width: int, l1: np.ndarray):
        n = len(l1)
        self.l1 = l1
        self.w, self.trial, self.step = (np.zeros((width, n)) for _ in range(3))
        self.value, self.length = np.full(n, np.inf), np.ones(n)
        self.gradient, self.slope = (np.zeros((width, n)) for _ in range(2))  # without and with the L1 penalty's
        self.first, self.done = np.zeros(n), np.zeros(n, bool)
        self.moves, self.turns = [], []  # the newest last, zero where a column has none
        self.scale = np.ones(n)

    def take(self, loss: np.ndarray, gradient: np.ndarray, tol: float) -> None:
        """Go on from the loss and gradient at the trial weights; the penalty is added here."""
        value, gradient = loss + penalty(self.trial, self.l1), gradient + np.where(self.l1, 0.0, self.trial)
        started = np.isfinite(self.value)
        fall = (self.slope * (self.trial - self.w)).sum(0)
        good = ~self.done & (~started | (value <= self.value + 1e-4 * fall))
        self._remember(good & started, gradient)
        self.w = np.where(good, self.trial, self.w)
        self.value, self.gradient = np.where(good, value, self.value), np.where(good, gradient, self.gradient)
        self.slope = np.where(self.l1, slope(self.w, self.gradient, True), self.gradient)
        size = np.linalg.norm(self.slope, axis=0)
        self.first = np.where(started, self.first, size)
        self.length = np.where(good, 1.0, self.length / 2)
        self.done |= (size <= tol * self.first) | (self.length < 1e-8)
        step = self._direction(size)
        step = np.where(self.l1 & (step * self.slope >= 0), 0.0, step)
        self.step = np.where(good, step, self.step)
        trial = self.w + self.length * self.step
        side = np.where(self.w != 0, np.sign(self.w), -np.sign(self.slope))
        trial = np.where(self.l1 & (trial * side <= 0), 0.0, trial)
        self.trial = np.where(self.done, self.w, trial)

    def _remember(self, good: np.ndarray, gradient: np.ndarray) -> None:
        move, turn = self.trial - self.w, gradient - self.gradient
        bend = (move * turn).sum(0)
        good = good & (bend > 1e-12)
        if not good.any():
            return
        self.scale = np.where(good, bend / np.maximum((turn * turn).sum(0), 1e-300), self.scale)
        self.moves.append(np.where(good, move, 0.0))
        self.turns.append(np.where(good, turn, 0.0))
        del self.moves[:-MEMORY], self.turns[:-MEMORY]

    def _direction(self, size: np.ndarray) -> np.ndarray:
        q, kept = self.slope.copy(), []
        for move, turn in zip(reversed(self.moves), reversed(self.turns), strict=True):
            bend = (move * turn).sum(0)
            rate = np.where(bend > 0, 1.0 / np.where(bend > 0, bend, 1.0), 0.0)
            share = rate * (move * q).sum(0)
            q -= share * turn
            kept.append((move, turn, rate, share))
        q *= self.scale if self.moves else 1.0 / np.maximum(size, 1.0)
        for move, turn, rate, share in reversed(kept):
            q += move * (share - rate * (turn * q).sum(0))
        return -q


def slopes(blocks: DataFrame, w: np.ndarray, columns: Columns) -> tuple[np.ndarray, np.ndarray]:
    """(loss, gradient) of the columns ``w`` (width, columns) without the penalty."""
    width, n = w.shape
    target, cost, held = columns.target, columns.cost, columns.held

    def add(total: np.ndarray, frames: Iterator[pd.DataFrame]) -> None:
        loss, gradient = total[:n], total[n:].reshape(width, n)
        for x, y, fold in _blocks(frames, width):
            sign = np.where(y[:, None] == target, 1.0, -1.0)
            c = np.where(fold[:, None] == np.where(held < 0, -2, held), 0.0, cost[:, y].T)
            slack = np.maximum(0.0, 1.0 - sign * (x @ w))
            c *= slack
            loss += (c * slack).sum(0)
            gradient += x.T @ (-2.0 * c * sign)

    total = over_blocks(blocks, n + width * n, add)
    return total[:n], total[n:].reshape(width, n)


def _descend(blocks: DataFrame, width: int, columns: Columns, max_iter: int, tol: float) -> tuple[np.ndarray, int]:
    group = max(1, SUM_BYTES // (8 * (width + 1)))
    found, passes = [], 0
    for at in range(0, len(columns.target), group):
        some = columns.part(slice(at, at + group))
        state = Descent(width, some.l1)
        for done in range(1, max_iter + 1):
            left = np.flatnonzero(~state.done)
            loss, gradient = np.zeros(len(some.target)), np.zeros((width, len(some.target)))
            loss[left], gradient[:, left] = slopes(blocks, state.trial[:, left], some.part(left))
            state.take(loss, gradient, tol)
            if state.done.all():
                break
        found.append(state.w)
        passes += done
    return np.hstack(found), passes


def proximal_steps(w: np.ndarray, g: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Steps that minimise g d + d h d / 2 + |w + d| for each column (columns, width), by coordinate descent."""
    d, hd = np.zeros_like(w), np.zeros_like(w)
    curve = np.einsum("mjj->mj", h) + 1e-12
    every = np.arange(w.shape[1])

    def sweep(some: np.ndarray) -> float:
        most = 0.0
        for j in some:
            at = w[:, j] + d[:, j] - (g[:, j] + hd[:, j]) / curve[:, j]
            move = np.sign(at) * np.maximum(np.abs(at) - 1.0 / curve[:, j], 0.0) - w[:, j] - d[:, j]
            if move.any():
                d[:, j] += move
                hd[:] += move[:, None] * h[:, j, :]
                most = max(most, float(np.abs(move).max()))
        return most

    for _ in range(SWEEPS):
        # coordinates at zero mostly stay there: the others are settled between two sweeps over all
        first = sweep(every)
        if first < CLOSE:
            break
        some = np.flatnonzero((w + d != 0).any(0))
        for _ in range(SWEEPS):
            if sweep(some) < max(CLOSE, first / 100):
                break
    return d


def penalty(w: np.ndarray, l1: np.ndarray) -> np.ndarray:
    return np.where(l1, np.abs(w).sum(0), 0.5 * (w * w).sum(0))


def slope(w: np.ndarray, g: np.ndarray, l1: bool) -> np.ndarray:
    """The gradient with the penalty's, or the least subgradient."""
    if not l1:
        return g + w
    return np.where(w != 0, g + np.sign(w), np.sign(g) * np.maximum(np.abs(g) - 1.0, 0.0))


def solve(blocks: DataFrame, width: int, columns: Columns, max_iter: int, tol: float = TOLERANCE) -> tuple[np.ndarray, int]:
    """Weights (width, columns) and the number of passes; at most ``max_iter`` passes a group of columns."""
    if width > MAX_WIDTH:
        raise ValueError(f"vectors of {width} numbers: at most {MAX_WIDTH} here")
    if len(columns.target) > FEW:
        return _descend(blocks, width, columns, max_iter, tol)
    group = max(1, SUM_BYTES // (4 * width * (width + 1)))
    groups = [columns.part(slice(i, i + group)) for i in range(0, len(columns.target), group)]
    # the passes of several groups run side by side
    with ThreadPool(PARALLEL) as pool:
        parts = pool.map(inheritable_thread_target(blocks.sparkSession)(lambda some: _solve(blocks, width, some, max_iter, tol)), groups)
    return np.hstack([w for w, _ in parts]), sum(n for _, n in parts)


def _solve(blocks: DataFrame, width: int, columns: Columns, max_iter: int, tol: float) -> tuple[np.ndarray, int]:
    n = len(columns.target)
    best, step, moved = np.zeros((width, n)), np.zeros((width, n)), np.ones(n)
    value, least = np.full(n, np.inf), np.full(n, np.inf)  # best's value, and what a step has to reach
    norm, left = np.zeros(n), np.arange(n)
    w = best.copy()
    for done in range(1, max_iter + 1):
        some = columns.part(left)
        loss, gradient, curvature = sums(blocks, w[:, left], some)
        now = loss + penalty(w[:, left], some.l1)
        going, newton = [], []
        for i, m in enumerate(left):
            if now[i] > least[m] and moved[m] > 1e-8:
                # the step was too long
                moved[m] /= 2
                w[:, m] = best[:, m] + moved[m] * step[:, m]
                going.append(m)
                continue
            if now[i] <= value[m]:
                best[:, m], value[m] = w[:, m], now[i]
            size = float(np.linalg.norm(slope(w[:, m], gradient[:, i], bool(some.l1[i]))))
            norm[m] = norm[m] or size
            if size > tol * norm[m] and now[i] <= value[m] and moved[m] > 1e-8:
                newton.append(i)
                going.append(m)
        flat = [i for i in newton if not some.l1[i]]
        for i in flat:
            m = left[i]
            full = gradient[:, i] + w[:, m]
            step[:, m] = -np.linalg.solve(curvature[i] + np.eye(width), full)
            least[m] = value[m] + 1e-4 * float(full @ step[:, m])
        sharp = [i for i in newton if some.l1[i]]
        if sharp:
            at = left[sharp]
            d = proximal_steps(w[:, at].T.copy(), gradient[:, sharp].T.copy(), curvature[sharp])
            for row, i, m in zip(d, sharp, at, strict=True):
                step[:, m] = row
                fall = gradient[:, i] @ row + np.abs(w[:, m] + row).sum() - np.abs(w[:, m]).sum()
                least[m] = value[m] + 1e-4 * float(fall)
        for i in newton:
            m = left[i]
            moved[m] = 1.0
            w[:, m] = best[:, m] + step[:, m]
        left = np.array(sorted(going), int)
        if not len(left):
            break
    return best, done


def class_costs(counts: np.ndarray, c: float, class_weight: str) -> np.ndarray:
    """Cost of each class's rows; balanced: total / (classes * n)."""
    present = counts > 0
    if class_weight != "balanced":
        return np.where(present, c, 0.0)
    return np.where(present, c * counts.sum() / (present.sum() * np.maximum(counts, 1)), 0.0)


def counted(vectors: DataFrame, label: str, fold: str | None = None) -> dict[int, np.ndarray]:
    """Rows of each class in each fold (-1: no fold); a row per fold and class comes back."""
    key = F.coalesce(F.col(fold).cast("int"), F.lit(-1)) if fold else F.lit(-1)
    rows = vectors.groupBy(key.alias("f"), F.col(label).cast("int").alias("y")).count().collect()
    classes = max(r["y"] for r in rows) + 1
    out = {f: np.zeros(classes) for f in {r["f"] for r in rows}}
    for r in rows:
        out[r["f"]][r["y"]] = r["count"]
    return out


def columns_of(points: list[dict], counts: dict[int, np.ndarray], folds: list[int]) -> Columns:
    """A column for every point, fold left out (-1: none) and class, in this order."""
    total, target, cost, held, l1 = sum(counts.values()), [], [], [], []
    for p in points:
        for f in folds:
            costs = class_costs(total - (counts.get(f, 0 * total) if f >= 0 else 0), p["C"], p["classWeight"])
            for k in range(len(total)):
                target.append(k)
                cost.append(costs)
                held.append(f)
                l1.append(p["penalty"] == "l1")
    return Columns(np.array(target), np.array(cost), np.array(held), np.array(l1))


def width_of(vectors: DataFrame, features: str) -> int:
    return len(vectors.select(vector_to_array(features).alias("x")).first()["x"]) + 1


def macro_f1(cells: np.ndarray) -> float:
    """Mean F1 of the classes that occur, from counts (label, prediction)."""
    both = cells.sum(0) + cells.sum(1)
    return float((2 * np.diag(cells)[both > 0] / both[both > 0]).mean()) if both.any() else 0.0


def grid_scores(
    vectors: DataFrame, points: list[dict], features: str, label: str, fold: str, max_iter: int, tol: float = TOLERANCE
) -> list[list[float]]:
    """Macro F1 of each point on each fold, trained on the other folds."""
    blocks, counts, width = packed(vectors, features, label, fold), counted(vectors, label, fold), width_of(vectors, features)
    folds = sorted(f for f in counts if f >= 0)
    w, _ = solve(blocks, width, columns_of(points, counts, folds), max_iter, tol)
    classes, per_fold = len(next(iter(counts.values()))), len(points)
    w = w.reshape(width, per_fold, len(folds), classes)

    def add(total: np.ndarray, frames: Iterator[pd.DataFrame]) -> None:
        cells = total.reshape(per_fold, len(folds), classes, classes)
        for x, y, fold_of in _blocks(frames, width):
            for i, f in enumerate(folds):
                on = fold_of == f
                if on.any():
                    best = np.einsum("nd,dpk->npk", x[on], w[:, :, i]).argmax(2)
                    for p in range(per_fold):
                        np.add.at(cells[p, i], (y[on], best[:, p]), 1)

    cells = over_blocks(blocks, per_fold * len(folds) * classes * classes, add).reshape(per_fold, len(folds), classes, classes)
    return [[macro_f1(c) for c in point] for point in cells]


class BlockSvmModel(Model, HasFeaturesCol, DefaultParamsReadable, DefaultParamsWritable):
    """Decision values and the best class of dense vectors; the weights are parameters and are saved with it."""

    weights = Param(Params._dummy(), "weights", "weights class by class, the intercept last", TypeConverters.toListFloat)
    classes = Param(Params._dummy(), "classes", "number of classes", TypeConverters.toInt)

    @keyword_only
    def __init__(self, featuresCol="features", weights=None, classes=None):
        super().__init__()
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    def matrix(self) -> np.ndarray:
        return np.array(self.getOrDefault("weights")).reshape(self.getOrDefault("classes"), -1)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        w = self.matrix()
        small_batches(dataset.sparkSession)

        def values(vectors: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for some in vectors:
                x = np.stack(some.to_numpy()) if len(some) else np.zeros((0, w.shape[1] - 1))
                yield pd.Series(list(x @ w[:, :-1].T + w[:, -1]))

        scores = F.pandas_udf(values, "array<double>")(vector_to_array(self.getFeaturesCol()))
        scored = dataset.withColumn("_scores", scores)
        return scored.withColumn("rawPrediction", array_to_vector("_scores")).withColumn(
            "prediction", argmax(F.col("_scores")).cast("double")).drop("_scores")


class BlockSvm(Estimator, HasFeaturesCol, HasLabelCol, HasMaxIter, HasTol, DefaultParamsReadable, DefaultParamsWritable):
    """One-vs-rest linear SVM with cost ``C``, balanced class weights and an L1 or L2 penalty."""

    C = Param(Params._dummy(), "C", "cost of a margin violation", TypeConverters.toFloat)
    classWeight = Param(Params._dummy(), "classWeight", "balanced or none", TypeConverters.toString)
    penalty = Param(Params._dummy(), "penalty", "l1 or l2", TypeConverters.toString)

    @keyword_only
    def __init__(self, C=0.5, classWeight="balanced", penalty="l2", maxIter=3000, tol=TOLERANCE, featuresCol="features", labelCol="label"):
        super().__init__()
        self._set(**{"C": C, "classWeight": classWeight, "penalty": penalty, "maxIter": maxIter, "tol": tol,
                     "featuresCol": featuresCol, "labelCol": labelCol})

    def point(self) -> dict:
        return {name: self.getOrDefault(name) for name in ("C", "classWeight", "penalty")}

    def _fit(self, dataset: DataFrame) -> BlockSvmModel:
        features, label = self.getFeaturesCol(), self.getLabelCol()
        counts, width = counted(dataset, label), width_of(dataset, features)
        columns = columns_of([self.point()], counts, [-1])
        w, _ = solve(packed(dataset, features, label), width, columns, self.getMaxIter(), self.getTol())
        return BlockSvmModel(featuresCol=features, weights=[float(v) for v in w.T.ravel()], classes=w.shape[1])
