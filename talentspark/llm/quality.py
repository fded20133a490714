"""Quality classifier: random Fourier features of document statistics, ridge regression from
partition-summed normal equations, isotonic calibration.

Edge cases: a null text counts as empty, and empty texts get a score like any other; labels that are
null or whose document is unknown are left out; several labels of a document are averaged; with no
label of one of the classes nothing can be learned and every score is 1 (nothing is rejected).
Documents may repeat and carry any further columns; scores depend on the text alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from talentspark.llm.common import tree_sum
from talentspark.session import settle_table

SYMBOLS = b"*$%&#!|<>{}[]=_~^@+/\\"
FEATURES = 22
FOURIER = 256
GAMMA = 0.05
RIDGE = 1e-3
BINS = 4096
ACCEPT = 0.7


def _classes() -> np.ndarray:
    """Byte classes as rows: letters, upper case, digits, white space, new lines, symbols, other punctuation."""
    code = np.arange(256)
    upper, lower = (code >= 65) & (code <= 90), (code >= 97) & (code <= 122)
    digit, space = (code >= 48) & (code <= 57), (code == 32) | ((code >= 9) & (code <= 13))
    symbol = np.isin(code, np.frombuffer(SYMBOLS, np.uint8))
    letter = upper | lower | (code >= 128)
    return np.array([letter, upper, digit, space, code == 10, symbol, ~(letter | digit | space | symbol)], float)


CLASSES = _classes()


def statistics(text: str) -> list[float]:
    """Length, character classes, word lengths and repetition of one whole text."""
    data = text.encode("utf-8", "replace")
    words, lines = data.split(), data.split(b"\n")
    n, m = max(len(data), 1), max(len(words), 1)
    shares = CLASSES @ np.bincount(np.frombuffer(data, np.uint8), minlength=256) / n
    lengths = np.fromiter(map(len, words), np.int64, len(words)) if words else np.zeros(1, np.int64)
    distinct = set(words)
    pairs = set(zip(words, words[1:], strict=False))
    odd_ends = sum(1 for w in words if w[-1] in SYMBOLS)
    same_next = sum(a == b for a, b in zip(words, words[1:], strict=False))
    return [
        np.log1p(len(data)), np.log1p(len(words)), *shares, lengths.mean(), lengths.std(), np.log1p(lengths.max()),
        (lengths <= 3).mean(), (lengths >= 12).mean(), len(distinct) / m, len(pairs) / m, np.log1p(m) * len(distinct) / m,
        len(set(lines)) / len(lines), np.log1p(n / len(lines)), odd_ends / m, same_next / m,
        sum(1 for w in words if len(w) == 1) / m,
    ]


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def _statistics(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: [float(x) for x in statistics(t or "")])


@dataclass
class Model:
    """Mean and spread of the statistics, the projection, its weights and the calibration steps."""

    mean: np.ndarray
    spread: np.ndarray
    seed: int
    gamma: float
    weights: np.ndarray | None
    knots: np.ndarray
    levels: np.ndarray

    def lift(self, stats: np.ndarray) -> np.ndarray:
        rng = np.random.default_rng(self.seed)
        size = (len(self.weights) if self.weights is not None else FOURIER + 1) - 1
        along = rng.normal(0, np.sqrt(2 * self.gamma), (FEATURES, size))
        phase = rng.uniform(0, 2 * np.pi, size)
        x = np.clip((stats - self.mean) / self.spread, -8, 8)
        return np.hstack([np.sqrt(2 / size) * np.cos(x @ along + phase), np.ones((len(x), 1))])

    def raw(self, stats: np.ndarray) -> np.ndarray:
        return self.lift(stats) @ self.weights

    def score(self, stats: np.ndarray) -> np.ndarray:
        if self.weights is None:
            return np.ones(len(stats))
        return np.interp(self.raw(stats), self.knots, self.levels)


def isotonic(x: np.ndarray, y: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators over bins (centre, mean, rows) in ascending order of the centre."""
    blocks: list[list[float]] = []
    for centre, mean, rows in zip(x, y, n, strict=True):
        blocks.append([centre * rows, mean * rows, rows])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][2] >= blocks[-1][1] * blocks[-2][2]:
            last = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], last, strict=True)]
    sums = np.array(blocks)
    return sums[:, 0] / sums[:, 2], np.clip(sums[:, 1] / sums[:, 2], 0, 1)


def fit(labelled: DataFrame, seed: int = 7, gamma: float = GAMMA, ridge: float = RIDGE) -> Model:
    """Fit on all rows of ``labelled`` (s: the statistics of a text, y between 0 and 1)."""
    table = settle_table(labelled.where(F.col("y").isNotNull()), "quality-statistics")
    sums = table.agg(
        F.count(F.lit(1)), F.sum("y"), *[F.avg(F.get("s", F.lit(i))) for i in range(FEATURES)],
        *[F.stddev_pop(F.get("s", F.lit(i))) for i in range(FEATURES)],
    ).first()
    rows, positive = sums[0], sums[1]
    none = Model(np.zeros(FEATURES), np.ones(FEATURES), seed, gamma, None, np.zeros(1), np.ones(1))
    if not rows or positive <= 0 or positive >= rows:
        return none
    deviation = np.array(sums[2 + FEATURES:], float)
    model = Model(np.array(sums[2:2 + FEATURES], float), np.where(deviation > 1e-9, deviation, 1.0), seed, gamma, None, none.knots, none.levels)
    size = FOURIER + 1

    def normal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((size, size + 1))
        for batch in batches:
            z = model.lift(np.array(batch["s"].tolist(), float).reshape(-1, FEATURES))
            total += z.T @ np.hstack([z, batch["y"].to_numpy()[:, None]])
        yield pd.DataFrame({"key": [TaskContext.get().partitionId()], "v": [total.tobytes()]})

    total = tree_sum(table.mapInPandas(normal, "key int, v binary")).reshape(size, size + 1)
    model.weights = np.linalg.solve(total[:, :size] + ridge * rows / size * np.eye(size), total[:, size])

    @F.pandas_udf("double")
    def raw(stats: pd.Series) -> pd.Series:
        return pd.Series(model.raw(np.array(stats.tolist(), float).reshape(-1, FEATURES)))

    # at most BINS + 1 rows, whatever the input
    bins = F.floor(F.least(F.greatest((F.col("r") + 0.5) / 2, F.lit(0.0)), F.lit(1.0)) * BINS)
    steps = table.select(raw("s").alias("r"), "y").groupBy(bins.alias("bin")).agg(
        F.avg("r").alias("x"), F.avg("y").alias("m"), F.count(F.lit(1)).alias("n")
    ).orderBy("bin").collect()
    model.knots, model.levels = isotonic(*(np.array([r[c] for r in steps], float) for c in ("x", "m", "n")))
    return model


def score(model: Model, text: Column) -> Column:
    """The calibrated score of each text, between 0 and 1."""
    @F.pandas_udf("double")
    def run(texts: pd.Series) -> pd.Series:
        stats = np.array([statistics(t or "") for t in texts], float).reshape(-1, FEATURES)
        return pd.Series(model.score(stats))

    return run(text)


def labelled_statistics(docs: DataFrame, labels: DataFrame, use: Column) -> DataFrame:
    """(s, y) of the labelled documents for which ``use`` (over doc_id) holds; texts are not shuffled."""
    y = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull() & use).groupBy("doc_id").agg(
        F.avg("quality").alias("y")
    )
    return docs.select("doc_id", _statistics("text").alias("s")).join(y, "doc_id").select("s", "y")


def held_out(doc_id: Column, folds: int = 4, fold: int = 2) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % folds == fold, F.lit(False))


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` with ``held_out``, ``score`` and ``predicted`` (1 from a score of ``ACCEPT`` on)."""
    model = fit(labelled_statistics(docs, labels, ~held_out(F.col("doc_id"))))
    return docs.withColumn("held_out", held_out(F.col("doc_id"))).withColumn(
        "score", score(model, F.col("text"))
    ).withColumn("predicted", (F.col("score") >= ACCEPT).cast("int"))
