"""The TF-IDF grid against vocabularies, weights and minima computed in plain Python and numpy."""

import collections
import math
import random

import numpy as np
import pytest

from talentspark.operators import svm, term_svm
from talentspark.plans import train
from talentspark.session import settle_table


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(12)
    own = [["aa", "bb", "cc"], ["cc", "dd", "ee"], ["ff", "gg", "aa"]]
    data = []
    for i in range(90):
        y = rng.choice([0, 0, 1, 2])
        data.append((rng.choices(own[y] + ["hh", "ii", "jj"], k=rng.randrange(0, 9)), float(y), i % 3))
    data[5] = (None, 1.0, 2)
    return spark.createDataFrame(data, "grams1 array<string>, label double, fold int"), data


def grams(tokens, n):
    return [" ".join(tokens[i:i + k]) for k in range(1, n + 1) for i in range(len(tokens) - k + 1)]


def plain_space(data, held, max_n, min_df, size):
    texts = [grams(t or [], max_n) for t, _, f in data if f != held]
    cf = collections.Counter(g for t in texts for g in t)
    df = collections.Counter(g for t in texts for g in set(t))
    terms = sorted((g for g in cf if min_df <= df[g] <= 0.95 * len(texts)), key=lambda g: (-cf[g], g))[:size]
    return terms, [math.log((len(texts) + 1) / (df[g] + 1)) + 1 for g in terms]


def plain_matrix(data, terms, idf, max_n):
    x = np.zeros((len(data), len(terms) + 1))
    for r, (tokens, _, _) in enumerate(data):
        n = collections.Counter(grams(tokens or [], max_n))
        x[r, :-1] = [n[t] * w for t, w in zip(terms, idf, strict=True)]
        x[r] /= np.linalg.norm(x[r]) or 1
    x[:, -1] = 1
    return x


def test_spaces_and_solutions(spark, rows):
    frame, data = rows
    some = term_svm.spaces(frame, "grams1", "fold", [1, 2], [2, 4], [6, 400], [0.5, 20.0])
    assert len(some) == 4 * 2 * 2 * 2
    for s in some:
        terms, idf = plain_space(data, s.held, s.max_n, s.min_df, s.size)
        assert s.terms == terms and s.idf == pytest.approx(idf)
    blocks, counts = term_svm.packed(frame, "grams1", "label", "fold", some), svm.counted(frame, "label", "fold")
    some = [some[0], some[7], some[-1]]
    y, fold = np.array([int(r[1]) for r in data]), np.array([r[2] for r in data])
    weights = term_svm.solve(blocks, some, counts, 500, 1e-7)
    for s, w, cells in zip(some, weights, term_svm.held_out_cells(blocks, some, weights, 3), strict=True):
        x, used = plain_matrix(data, s.terms, s.idf, s.max_n), fold != s.held
        per_class = np.bincount(y[used], minlength=3)
        for m in range(w.shape[1]):
            cost = s.costs[m // 3] * used.sum() / (3 * per_class[y]) * used
            sign = np.where(y == m % 3, 1.0, -1.0)
            slack = np.maximum(0, 1 - sign * (x @ w[:, m]))
            # convex: the gradient vanishes at the minimum alone
            slope = w[:, m] - 2 * x.T @ (cost * slack * sign)
            at_zero = 2 * x.T @ (cost * sign)
            assert np.linalg.norm(slope) <= 1e-5 * np.linalg.norm(at_zero)
        best = (x @ w).reshape(len(data), 2, 3).argmax(2)
        for c in range(2):
            want = np.zeros((3, 3))
            np.add.at(want, (y[fold == s.held], best[fold == s.held, c]), 1)
            assert (cells[c] == want).all()


def test_points_share_passes(spark, rows, monkeypatch):
    frame, _ = rows
    some = term_svm.spaces(frame, "grams1", "fold", [1], [2], [50], [0.5, 2.0])
    blocks, counts = term_svm.packed(frame, "grams1", "label", "fold", some), svm.counted(frame, "label", "fold")
    together = term_svm.grid_scores(blocks, some, counts, 200)
    monkeypatch.setattr(term_svm, "GROUP_BYTES", 1)
    assert together == term_svm.grid_scores(blocks, some, counts, 200)
    assert set(together) == {(1, 2, 50, 0.5), (1, 2, 50, 2.0)} and all(len(v) == 3 for v in together.values())


def test_a_pass_reads_each_setting_once(spark, rows, monkeypatch):
    frame, _ = rows
    some = term_svm.spaces(frame, "grams1", "fold", [1], [1, 2], [50], [0.5, 2.0])
    held = [s for s in some if s.held != term_svm.NO_FOLD]
    # both limits leave all ten words
    assert len(held) == 6 and len(term_svm.distinct(held)[0]) == 3
    blocks, counts = term_svm.packed(frame, "grams1", "label", "fold", some), svm.counted(frame, "label", "fold")
    asked = []
    over = svm.over_blocks
    monkeypatch.setattr(svm, "over_blocks", lambda blocks, size, add: asked.append(size) or over(blocks, size, add))
    found = term_svm.grid_scores(blocks, some, counts, 500)
    assert found[1, 1, 50, 0.5] == found[1, 2, 50, 0.5] and len(found) == 4
    passes = asked[:-1]
    # one matrix for the three folds: six columns of a loss, ten terms and a constant each; columns that are done leave
    assert passes[0] == 3 * 6 * (1 + 10 + 1) and min(passes) < passes[0] and passes == sorted(passes, reverse=True)


def test_texts_and_lists_give_the_same_blocks(spark, rows):
    frame, _ = rows
    some = term_svm.spaces(frame, "grams1", "fold", [2], [2], [400], [2.0])
    texts = frame.selectExpr("array_join(grams1, ', ') AS lower", "label", "fold")
    assert [s.terms for s in term_svm.spaces(texts, "lower", "fold", [2], [2], [400], [2.0])] == [s.terms for s in some]
    one, two = (term_svm.packed(f, c, "label", "fold", some).collect() for f, c in ((frame, "grams1"), (texts, "lower")))
    assert sorted(map(str, one)) == sorted(map(str, two))


def test_grams_are_not_written(spark, sf, monkeypatch):
    written = {}
    monkeypatch.setattr(train, "settle_table", lambda df, name, **o: written.update({name: df.columns}) or settle_table(df, name, **o))
    rows = spark.read.parquet(f"{sf}/documents.parquet").selectExpr("doc_id", "lang AS class", "text")
    found = train.train_on_terms(rows, "doc_id", "class", "text", 2, 4, max_ns=[1], min_dfs=[2], sizes=[50], costs=[0.5])
    assert written == {"texts": ["class", "label", "is_test", "fold", "text"]}
    assert found.test_predictions.where("prediction IS NULL").count() == 0 and found.test_predictions.count() > 0
