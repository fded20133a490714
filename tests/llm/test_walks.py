"""Random walks and their buckets: recall by length, and decontamination against an exhaustive alignment."""

import random

import numpy as np
import pytest

from talentspark.llm import decontaminate, walks


@pytest.mark.parametrize("rate", [0.0, 0.05, 0.1, 0.2])
@pytest.mark.parametrize("n", [5, 16, 37, 59, 130])
def test_walks_reach_their_recall(n, rate):
    family = walks.Walks(n, walks.walks_for(n, decontaminate.DIFFER, decontaminate.RECALL, 2), 2)
    rng = np.random.default_rng(77)
    pairs = [walks.altered(rng, n, int(rate * n + 1e-9), 2 * n) for _ in range(500)]
    items, copies = (np.stack(side) for side in zip(*pairs, strict=True))
    known = family.buckets(items, walks.ITEM_END)
    met = (known == family.buckets(copies, walks.WINDOW_END)).any(0)
    assert met.mean() >= (1 if rate == 0 else 0.99)
    # unrelated words meet nowhere: what is found is found by shared words
    assert not (known == family.buckets(np.roll(items, 1, 0), walks.WINDOW_END)).any()


def test_walks_do_not_depend_on_the_company():
    family, rng = walks.Walks(20, 8, 2), np.random.default_rng(3)
    windows = rng.integers(1, 1 << 63, (50, 20), dtype=np.uint64)
    together = family.buckets(windows, walks.ITEM_END)
    assert (np.concatenate([family.buckets(windows[i:i + 7], walks.ITEM_END) for i in range(0, 50, 7)], 1) == together).all()
    assert (walks.Walks(20, 16, 2).turn[:, :8] == family.turn).all()


def nearest(item, text):
    """The least number of word edits between the item and any passage of the text."""
    row = [0] * (len(text) + 1)
    for i, word in enumerate(item, 1):
        last, row = row, [i]
        for j, other in enumerate(text):
            row.append(min(last[j] + (word != other), last[j + 1] + 1, row[j] + 1))
    return min(row)


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, word in enumerate(a, 1):
        last, row = row, [i]
        for j, other in enumerate(b):
            row.append(min(last[j] + (word != other), last[j + 1] + 1, row[j] + 1))
    return row[-1]


def test_matches_equal_an_exhaustive_alignment(spark):
    rng = random.Random(31)
    # few different words, so that unrelated texts share many
    def draw(n):
        return [f"v{rng.randrange(40)}" for _ in range(n)]

    items = [draw(rng.choice([5, 8, 12, 25, 40])) for _ in range(12)]
    items += [items[3], items[4][:-1]]  # equal and nearly equal items
    texts = []
    for k in range(60):
        w = list(items[k % len(items)])
        for _ in range(rng.randrange(0, max(len(w) // 3, 1) + 1)):
            p = rng.randrange(len(w) + 1)
            w[p:p + rng.randrange(2)] = draw(rng.randrange(2))
        texts.append(" ".join(draw(rng.randrange(30)) + w + draw(rng.randrange(30))))
    texts += [" ".join(draw(400)), "", None, "v1", texts[0], texts[0]]
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(items)], "item_id long, text string")
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = decontaminate.matches(docs, bench).collect()
    want = {}
    for i, text in enumerate(texts):
        for k, item in enumerate(items):
            d = nearest(item, (text or "").split())
            if d <= int(0.2 * len(item) + 1e-9):
                want[i, k] = d
    got = {}
    for r in found:
        assert distance(items[r.item_id], texts[r.doc_id][r.start:r.end].split()) == r.distance
        got[r.doc_id, r.item_id] = min(r.distance, got.get((r.doc_id, r.item_id), r.distance))
    assert got == want


def test_empty_documents_and_clashing_columns(spark):
    bench = spark.createDataFrame([(1, "one two three four five six")], "item_id long, text string")
    none = spark.createDataFrame([], "doc_id long, text string")
    assert decontaminate.matches(none, bench).count() == 0 and decontaminate.without(none, bench).count() == 0
    rows = spark.createDataFrame(
        [(7, "One two, three four five six!", 3, 4), (7, "One two, three four five six!", 3, 4), (None, "one two", 5, 6)],
        "doc_id long, text string, item_id long, start int",
    )
    assert [(r.doc_id, r.item_id, r.start, r.distance) for r in decontaminate.matches(rows, bench).collect()] == [(7, 1, 0, 0)] * 2
    assert [(r.doc_id, r.item_id, r.start) for r in decontaminate.without(rows, bench).collect()] == [(None, 5, 6)]
    short = spark.createDataFrame([(2, "one two")], "item_id long, text string")
    assert decontaminate.matches(rows, short).count() == 0
    assert decontaminate.matches(rows, short, min_words=2).count() == 3
