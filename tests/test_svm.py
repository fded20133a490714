"""The block SVM against plain descent on all rows, in numpy."""

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from talentspark.operators import svm


def plain_value(x, y, w, target, cost, l1):
    sign = np.where(y == target, 1.0, -1.0)
    slack = np.maximum(0, 1 - sign * (x @ w))
    return (cost[y] * slack ** 2).sum() + (np.abs(w).sum() if l1 else 0.5 * w @ w)


def plain_solve(x, y, target, cost, l1, steps=20_000):
    """Accelerated proximal gradient, restarted when the value rises."""
    sign = np.where(y == target, 1.0, -1.0)
    rate = 1.0 / (2 * np.linalg.norm(x.T @ (cost[y][:, None] * x), 2) + 1)
    w = v = np.zeros(x.shape[1])
    t, value = 1.0, np.inf
    for _ in range(steps):
        g = x.T @ (-2 * cost[y] * np.maximum(0, 1 - sign * (x @ v)) * sign) + (0 if l1 else v)
        new = v - rate * g
        if l1:
            new = np.sign(new) * np.maximum(np.abs(new) - rate, 0)
        now = plain_value(x, y, new, target, cost, l1)
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v, t = (new + (t - 1) / t2 * (new - w), t2) if now <= value else (new, 1.0)
        w, value = new, now
    return value, w


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(7)
    y = np.repeat([0, 1, 2], [60, 100, 20])
    x = (rng.normal(size=(180, 12)) + np.eye(12)[y * 2] * 1.5).astype(np.float32)
    x[:, 11] = 0  # says nothing
    fold = np.arange(180) % 3
    rows = [(i, [float(a) for a in v], int(k), int(f)) for i, (v, k, f) in enumerate(zip(x, y, fold, strict=True))]
    frame = spark.createDataFrame(rows, "id long, v array<double>, label int, fold int").repartition(20)
    return frame.withColumn("features", array_to_vector("v")), np.c_[x.astype(float), np.ones(180)], y, fold


@pytest.mark.parametrize("penalty", ["l1", "l2"])
@pytest.mark.parametrize("weight", ["balanced", "none"])
def test_the_least_value_is_found(data, penalty, weight):
    frame, x, y, _ = data
    model = svm.BlockSvm(C=0.03, classWeight=weight, penalty=penalty).fit(frame)
    cost, l1 = svm.class_costs(np.bincount(y).astype(float), 0.03, weight), penalty == "l1"
    for k, w in enumerate(model.matrix()):
        want, plain = plain_solve(x, y, k, cost, l1)
        assert plain_value(x, y, w, k, cost, l1) == pytest.approx(want, rel=1e-5)
        if l1:
            assert (w == 0).sum() >= 2 and set(np.flatnonzero(w == 0)) >= {11}
            assert ((np.abs(plain) < 1e-6) == (np.abs(w) < 1e-6)).all()


def test_scores_predictions_and_storage(spark, data, tmp_path):
    frame, x, y, _ = data
    model = svm.BlockSvm(C=0.3).fit(frame)
    model.write().overwrite().save(str(tmp_path / "m"))
    again = svm.BlockSvmModel.load(str(tmp_path / "m"))
    rows = again.transform(frame).orderBy("id").select("rawPrediction", "prediction").collect()
    scores = x @ model.matrix().T
    assert np.allclose([r.rawPrediction.toArray() for r in rows], scores)
    assert [int(r.prediction) for r in rows] == scores.argmax(1).tolist()
    assert (scores.argmax(1) == y).mean() > 0.8


def test_grid_scores_equal_fits_without_the_fold(data, monkeypatch):
    frame, x, y, fold = data
    points = [{"C": c, "classWeight": w, "penalty": p} for c in (0.2, 0.4) for w in ("balanced", "none") for p in ("l1", "l2")]
    monkeypatch.setattr(svm, "SUM_BYTES", 4 * 13 * 14 * 10)  # ten columns a pass
    got = svm.grid_scores(frame, points, "features", "label", "fold", 100)
    for point, scores in zip(points[:3], got[:3], strict=True):
        for f in range(3):
            on = fold != f
            cost = svm.class_costs(np.bincount(y[on], minlength=3).astype(float), point["C"], point["classWeight"])
            w = np.stack([plain_solve(x[on], y[on], k, cost, point["penalty"] == "l1", 3000)[1] for k in range(3)])
            best = (x[~on] @ w.T).argmax(1)
            f1 = [2 * ((y[~on] == k) & (best == k)).sum() / ((y[~on] == k).sum() + (best == k).sum()) for k in range(3)]
            assert scores[f] == pytest.approx(np.mean(f1), abs=0.02)


def test_too_wide_vectors_are_refused(data):
    frame, *_ = data
    with pytest.raises(ValueError, match="at most"):
        svm.solve(frame, 5000, svm.columns_of([{"C": 1.0, "classWeight": "none", "penalty": "l2"}], {-1: np.ones(2)}, [-1]), 3)


@pytest.mark.parametrize("penalty", ["l1", "l2"])
def test_grids_need_no_curvature(data, penalty, monkeypatch):
    frame, x, y, fold = data
    monkeypatch.setattr(svm, "sums", None)
    points = [{"C": c, "classWeight": "balanced", "penalty": penalty} for c in (0.02, 0.03)]
    columns = svm.columns_of(points, svm.counted(frame, "label", "fold"), [0, 1, 2])
    assert len(columns.target) > svm.FEW
    w, _ = svm.solve(svm.packed(frame, "features", "label", "fold"), 13, columns, 2000, 1e-7)
    for m in (0, 4, 17):
        on, l1 = fold != columns.held[m], penalty == "l1"
        want, _ = plain_solve(x[on], y[on], columns.target[m], columns.cost[m], l1)
        assert plain_value(x[on], y[on], w[:, m], columns.target[m], columns.cost[m], l1) == pytest.approx(want, rel=1e-5)
        assert not l1 or w[11, m] == 0


def test_blocks_and_tasks_are_bounded(spark, monkeypatch):
    monkeypatch.setattr(svm, "TASKS", 1)
    rows = spark.range(9000).repartition(30).selectExpr("array(double(id), 1d) AS v", "int(id % 2) AS label")
    blocks = svm.packed(rows.withColumn("features", array_to_vector("v")), "features", "label")
    assert blocks.rdd.getNumPartitions() <= spark.sparkContext.defaultParallelism
    sizes = [len(r["y"]) // 2 for r in blocks.collect()]
    assert sum(sizes) == 9000 and max(sizes) <= svm.BLOCK_ROWS


def test_blocks_are_read_in_small_pieces(spark):
    rows = spark.range(10_240, numPartitions=1).selectExpr("transform(sequence(1, 512), i -> rand(7)) AS v", "0 AS label")
    blocks = svm.packed(rows.withColumn("features", array_to_vector("v")), "features", "label")
    files = [pq.ParquetFile(f.removeprefix("file://")).metadata for f in blocks.inputFiles()]
    groups = [m.row_group(i).total_byte_size for m in files for i in range(m.num_row_groups)]
    # 21 MB; a group was 100 blocks at least
    assert sum(groups) > 20e6 and max(groups) < 8e6
