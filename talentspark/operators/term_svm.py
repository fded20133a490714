"""The grid of the TF-IDF path in shared passes: one-vs-rest SVM (squared hinge, L2) of term weights.

A vocabulary belongs to what a fold trains on, so each fold and vectoriser setting has a space of its own. Terms are
counted once per fold (``features.fold_terms``); a space takes the total less the fold's own counts. Texts are packed
once into blocks of (term number, count) over the terms of all spaces; a space's weights are those counts times its
idf, scaled to length 1, so every space is read from the same blocks. All classes and costs of a space are columns of
one solution. A pass adds up their loss and gradient in every task and merges them by a tree; the driver keeps a few
gradients of each column (limited-memory quasi-Newton steps), which grow with the vocabulary, never with the rows.
"""

from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce
from itertools import product

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.feature import CountVectorizerModel, ElementwiseProduct, Normalizer
from pyspark.ml.linalg import Vectors
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talentspark.operators import svm
from talentspark.operators.features import MAX_DF, fold_terms, training_counts
from talentspark.operators.known import KnownSequences, Tokens
from talentspark.session import BLOCK_TABLE, settle_table, small_batches

NO_FOLD = -1
GROUP_BYTES = 8 << 20  # of the weights that share a pass
ROWS = 256  # made dense at a time
BLOCK = ["ends", "ids", "counts", "y", "fold"]
TOLERANCE = 1e-3  # of the gradient's norm against that at zero


@dataclass
class Space:
    """The vocabulary that one setting gives when one fold is left out, and the costs tried on it."""

    held: int
    max_n: int
    min_df: int
    size: int
    terms: list[str]  # most frequent first
    idf: np.ndarray
    costs: list[float]
    numbers: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))  # of the terms, in the blocks

    @property
    def width(self) -> int:
        return len(self.terms) + 1


def spaces(
    rows: DataFrame, tokens: str, fold: str, max_ns: list[int], min_dfs: list[int], sizes: list[int], costs: list[float],
    max_df: float = MAX_DF,
) -> list[Space]:
    """A space for each setting and each fold left out, and for all rows. What comes to the driver are the vocabularies,
    which ``sizes`` bounds."""
    counted = rows.select(F.col(fold).alias("fold"), F.col(tokens).alias("_tokens"))
    terms, held = fold_terms(counted, max(max_ns), min_dfs, max_df, max(sizes))
    total, picked = sum(held.values()), []
    for f, n, least in product([*sorted(held), NO_FOLD], max_ns, min_dfs):
        rest = terms.where(F.col("words") <= n).select(
            F.lit(f).alias("held"), F.lit(n).alias("n"), F.lit(least).alias("least"), "term",
            *[v.alias(c) for c, v in training_counts(f if f in held else None).items()],
        )
        fits = (F.col("df") >= least) & (F.col("df") <= max_df * (total - held.get(f, 0)))
        picked.append(rest.where(fits).orderBy(F.desc("cf"), F.asc("term")).limit(max(sizes)))
    found = reduce(DataFrame.unionByName, picked).toPandas().sort_values(["cf", "term"], ascending=[False, True])
    by_setting = dict(list(found.groupby(["held", "n", "least"])))
    out = []
    for f, n, least, size in product([*sorted(held), NO_FOLD], max_ns, min_dfs, sizes):
        some = by_setting.get((f, n, least), found[:0])[:size]
        idf = np.log((total - held.get(f, 0) + 1) / (some["df"].to_numpy(float) + 1)) + 1
        out.append(Space(f, n, least, size, some["term"].tolist(), idf, list(costs)))
    numbers = {t: i for i, t in enumerate(sorted({t for s in out for t in s.terms}))}
    for s in out:
        s.numbers = np.array([numbers[t] for t in s.terms], np.int64)
    return out


def packed(rows: DataFrame, tokens: str, label: str, fold: str, some: list[Space]) -> DataFrame:
    """Blocks of rows as (term number, number of words, count), written once: every pass reads them. ``tokens`` holds lists
    of words or lower-cased texts."""
    terms = sorted({t for s in some for t in s.terms})
    known, size = KnownSequences([t.split(" ") for t in terms]), max(len(terms), 1)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = Tokens(batch.column("t"))
            hits = [found.rows[at] * size + names for _, at, names in known.occurrences(found)]
            keys, counts = np.unique(np.concatenate([np.zeros(0, np.int64), *hits]), return_counts=True)
            ids, counts = (keys % size).astype(np.int32), counts.astype(np.float32)
            ends = np.searchsorted(keys, np.arange(batch.num_rows + 1) * size)
            y, f = (batch.column(c).to_numpy(zero_copy_only=False).astype(np.int16) for c in ("y", "fold"))
            blocks = []
            for at in range(0, batch.num_rows, ROWS):
                part, own = slice(at, at + ROWS), ends[at:at + ROWS + 1]
                inside = slice(own[0], own[-1])
                blocks.append([x.tobytes() for x in (own - own[0], ids[inside], counts[inside], y[part], f[part])])
            if blocks:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary()) for c in zip(*blocks, strict=True)], names=BLOCK)

    small_batches(rows.sparkSession)
    fold_of = F.coalesce(F.col(fold).cast("int"), F.lit(NO_FOLD))
    chosen = rows.select(F.col(tokens).alias("t"), F.col(label).cast("int").alias("y"), fold_of.alias("fold"))
    blocks = chosen.mapInArrow(pack, ", ".join(f"{c} binary" for c in BLOCK))
    return svm.few_tasks(settle_table(blocks, "term-blocks", **BLOCK_TABLE))


class Panel:
    """Spaces that are read from one matrix of counts over the terms of all of them.

    The scaled weights of a space are (counts x idf) / length, so its products with a row's weights are those of the counts
    with idf x weights, divided by the length.
    """

    def __init__(self, members: list[int], some: list[Space], weights: list[np.ndarray]):
        own = [some[k] for k in members]
        self.members, self.terms = members, np.unique(np.concatenate([s.numbers for s in own]))
        self.places = [np.searchsorted(self.terms, s.numbers) for s in own]
        self.place = np.full(1 + (int(self.terms[-1]) if len(self.terms) else 0), -1, np.int32)  # of a term's number
        self.place[self.terms] = np.arange(len(self.terms))
        self.idf = np.zeros((len(self.terms), len(own)))
        for j, (place, s) in enumerate(zip(self.places, own, strict=True)):
            self.idf[place, j] = s.idf
        self.ends = np.cumsum([weights[k].shape[1] for k in members])
        self.of = np.repeat(np.arange(len(own)), [weights[k].shape[1] for k in members])
        self.constant = np.concatenate([weights[k][-1] for k in members])
        self.weights = np.zeros((len(self.terms), len(self.of)))
        for j, (place, k) in enumerate(zip(self.places, members, strict=True)):
            self.weights[place, self.columns(j)] = some[k].idf[:, None] * weights[k][:-1]

    def columns(self, j: int) -> slice:
        return slice(int(self.ends[j - 1]) if j else 0, int(self.ends[j]))

    def read(self, row: np.ndarray, ids: np.ndarray, counts: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
        """(counts of the terms, 1 / length of each row in each space) of a block."""
        at = np.where(ids < len(self.place), self.place[np.minimum(ids, len(self.place) - 1)], -1)
        on = np.flatnonzero(at >= 0)
        x = np.zeros((rows, len(self.terms)))
        x[row[on], at[on]] = counts[on]
        return x, 1.0 / np.maximum(np.sqrt((x * x) @ (self.idf * self.idf)), 1e-300)

    def scores(self, x: np.ndarray, scale: np.ndarray) -> np.ndarray:
        return (x @ self.weights) * scale[:, self.of] + self.constant

    def slopes(self, x: np.ndarray, scale: np.ndarray, g: np.ndarray) -> np.ndarray:
        """Sums over the rows of each term's weight, and of the constant, times ``g`` (row, column); idf is still left out."""
        return np.vstack([x.T @ (g * scale[:, self.of]), g.sum(0)])


def panels(some: list[Space], weights: list[np.ndarray]) -> list[Panel]:
    """Spaces of one length of n-gram and one size have most terms in common."""
    alike: dict[tuple[int, int], list[int]] = {}
    for k, s in enumerate(some):
        alike.setdefault((s.max_n, s.size), []).append(k)
    return [Panel(members, some, weights) for members in alike.values()]


def _read(
    frames: Iterator[pd.DataFrame], some: list[Panel]
) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(panel, counts, scales, labels, folds) of each block in each panel."""
    for frame in frames:
        for ends, ids, counts, y, fold in zip(*(frame[c] for c in BLOCK), strict=True):
            ends, ids, counts = np.frombuffer(ends, np.int64), np.frombuffer(ids, np.int32), np.frombuffer(counts, np.float32)
            row = np.repeat(np.arange(len(ends) - 1), np.diff(ends))
            for p, panel in enumerate(some):
                yield p, *panel.read(row, ids, counts, len(ends) - 1), np.frombuffer(y, np.int16), np.frombuffer(fold, np.int16)


def _columns(s: Space, counts: dict[int, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(class, cost of a row by its class) of the columns of a space: costs, then classes."""
    total = sum(counts.values())
    total = total - counts.get(s.held, 0 * total) if s.held != NO_FOLD else total
    target = np.tile(np.arange(len(total)), len(s.costs))
    return target, np.repeat([svm.class_costs(total, c, "balanced") for c in s.costs], len(total), axis=0)


def solve(
    blocks: DataFrame, some: list[Space], counts: dict[int, np.ndarray], max_iter: int, tol: float = TOLERANCE
) -> list[np.ndarray]:
    """The weights (width, costs x classes) of each space, after at most ``max_iter`` passes; columns that are done leave
    the passes."""
    columns = [_columns(s, counts) for s in some]
    state = [svm.Descent(s.width, np.zeros(len(c[0]), bool)) for s, c in zip(some, columns, strict=True)]
    for _ in range(max_iter):
        left = [k for k, d in enumerate(state) if not d.done.all()]
        if not left:
            break
        going = [np.flatnonzero(~state[k].done) for k in left]
        asked = panels([some[k] for k in left], [state[k].trial[:, on] for k, on in zip(left, going, strict=True)])
        target, cost, held = [], [], []
        for p in asked:
            own = [(left[k], going[k]) for k in p.members]
            target.append(np.concatenate([columns[k][0][on] for k, on in own]))
            cost.append(np.concatenate([columns[k][1][on] for k, on in own]))
            held.append(np.array([some[k].held if some[k].held != NO_FOLD else -2 for k, _ in own])[p.of])
        sizes = [len(p.of) * (len(p.terms) + 2) for p in asked]
        cuts = np.cumsum(sizes)[:-1]

        def add(total: np.ndarray, frames: Iterator[pd.DataFrame], asked=asked, target=target, cost=cost, held=held, cuts=cuts) -> None:
            parts = np.split(total, cuts)
            for p, x, scale, y, fold in _read(frames, asked):
                n = len(target[p])
                sign = np.where(y[:, None] == target[p], 1.0, -1.0)
                c = np.where(fold[:, None] == held[p], 0.0, cost[p][:, y].T)
                slack = np.maximum(0.0, 1.0 - sign * asked[p].scores(x, scale))
                c *= slack
                parts[p][:n] += (c * slack).sum(0)
                parts[p][n:] += asked[p].slopes(x, scale, -2.0 * c * sign).ravel()

        for p, part in zip(asked, np.split(svm.over_blocks(blocks, sum(sizes), add), cuts), strict=True):
            loss, gradient = part[:len(p.of)], part[len(p.of):].reshape(-1, len(p.of))
            for j, k in enumerate(p.members):
                s, own, d = some[left[k]], gradient[:, p.columns(j)], state[left[k]]
                value, slope = np.zeros(len(d.done)), np.zeros(d.w.shape)
                value[going[k]] = loss[p.columns(j)]
                slope[:, going[k]] = np.vstack([s.idf[:, None] * own[p.places[j]], own[-1:]])
                d.take(value, slope, tol)
    return [d.w for d in state]


def groups(some: list[Space], classes: int) -> Iterator[list[Space]]:
    """Spaces whose weights share a pass."""
    part, size = [], 0
    for s in some:
        need = 8 * s.width * classes * len(s.costs)
        if part and size + need > GROUP_BYTES:
            yield part
            part, size = [], 0
        part.append(s)
        size += need
    if part:
        yield part


def held_out_cells(blocks: DataFrame, some: list[Space], weights: list[np.ndarray], classes: int) -> list[np.ndarray]:
    """Counts (cost, label, prediction) of each space's own fold."""
    sizes = [len(s.costs) * classes * classes for s in some]
    cuts, asked = np.cumsum(sizes)[:-1], panels(some, weights)

    def add(total: np.ndarray, frames: Iterator[pd.DataFrame]) -> None:
        parts = np.split(total, cuts)
        for p, x, scale, y, fold in _read(frames, asked):
            scores = asked[p].scores(x, scale)
            for j, k in enumerate(asked[p].members):
                on = fold == some[k].held
                if on.any():
                    best = scores[on][:, asked[p].columns(j)].reshape(on.sum(), -1, classes).argmax(2)
                    cells = parts[k].reshape(-1, classes, classes)
                    for c in range(cells.shape[0]):
                        np.add.at(cells[c], (y[on], best[:, c]), 1)

    found = np.split(svm.over_blocks(blocks, sum(sizes), add), cuts)
    return [f.reshape(-1, classes, classes) for f in found]


def distinct(some: list[Space]) -> tuple[list[Space], list[int]]:
    """The spaces that differ, and the place of each space among them: two limits may leave the same terms."""
    places: dict[tuple, int] = {}
    at = [places.setdefault((s.held, s.numbers.tobytes(), s.idf.tobytes(), tuple(s.costs)), len(places)) for s in some]
    return [some[at.index(i)] for i in range(len(places))], at


def grid_scores(
    blocks: DataFrame, some: list[Space], counts: dict[int, np.ndarray], max_iter: int
) -> dict[tuple[int, int, int, float], list[float]]:
    """Macro F1 of each point (max_n, min_df, size, cost) on each fold, trained on the other folds."""
    classes = len(next(iter(counts.values())))
    out: dict[tuple[int, int, int, float], list[float]] = {}
    some = [s for s in some if s.held != NO_FOLD]
    solved, at = distinct(some)
    cells = []
    for part in groups(solved, classes):
        cells += held_out_cells(blocks, part, solve(blocks, part, counts, max_iter), classes)
    for s, i in zip(some, at, strict=True):
        for c, found in zip(s.costs, cells[i], strict=True):
            out.setdefault((s.max_n, s.min_df, s.size, c), []).append(svm.macro_f1(found))
    return out


def stages(s: Space, weights: np.ndarray, prefix: str = "grams") -> list:
    """Count, weigh, scale and classify: a space and its weights (width, classes) as stages that can be saved."""
    return [
        CountVectorizerModel.from_vocabulary(s.terms, inputCol=f"{prefix}{s.max_n}", outputCol="_counts"),
        ElementwiseProduct(scalingVec=Vectors.dense(s.idf), inputCol="_counts", outputCol="_weighted"),
        Normalizer(inputCol="_weighted", outputCol="features", p=2.0),
        svm.BlockSvmModel(weights=[float(v) for v in weights.T.ravel()], classes=weights.shape[1]),
    ]
