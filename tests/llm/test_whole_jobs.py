"""Operators that did less than the whole job, on small tables that show it."""

import collections
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from talentspark.llm import decontaminate, lm_score, ngram_join

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def frame(spark, texts):
    return spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(texts)], SCHEMA)


def words(rng, n):
    return [f"w{rng.randrange(4000)}x" for _ in range(n)]


def plain_losses(texts, target):
    """Mean losses of each text by counts of the n-grams themselves, over all texts for the background."""
    split = [(t or "").lower().split() for t in texts]
    own = []
    for s in split:
        padded = ["", "", *s]
        own.append(collections.Counter(tuple(padded[k + 2 - o:k + 3]) for k in range(len(s)) for o in range(3)))
    vocabulary, out = len({w for s in split for w in s}), []
    sizes = [sum(len(split[i]) for i in some) for some in (target, range(len(split)))]
    for some, size in zip((target, range(len(split))), sizes, strict=True):
        counts, scale, lost = collections.Counter(), sizes[0] / size, []
        for i in some:
            counts.update(own[i])
        for i, s in enumerate(split):
            less = own[i] if i in some else {}
            def seen(g):
                return scale * (counts[g] - less.get(g, 0))
            padded, total = ["", "", *s], 0.0
            for k in range(len(s)):
                g = tuple(padded[k:k + 3])
                p = (seen(g[2:]) + 0.5) / (scale * (size - (len(s) if i in some else 0)) + 0.5 * vocabulary)
                for n, prior in ((2, 8.0), (3, 4.0)) if k else ():
                    context = g[3 - n:2]
                    p = (seen(g[3 - n:]) + prior * p) / (seen(context) + prior)
                total -= np.log2(p)
            lost.append(total / len(s) if s else None)
        out.append(lost)
    return out


def test_lm_score_counts_the_ngrams_themselves(spark):
    rng = random.Random(21)
    texts = [" ".join(words(rng, rng.randrange(1, 200))) for _ in range(80)] + ["a b a b a b"] * 3 + [None, ""]
    target = set(range(0, 80, 5)) | {80}
    ids = spark.createDataFrame([(i,) for i in target], "doc_id long")
    want = plain_losses(texts, target)
    got = {r.doc_id: r for r in lm_score.score(frame(spark, texts), ids).collect()}
    assert len(got) == len(texts)
    for i, r in got.items():
        for loss, value in zip((r.target_loss, r.background_loss), want, strict=True):
            assert loss is None and value[i] is None or abs(loss - value[i]) < 1e-9


def test_lm_score_sends_no_list_of_targets(spark, monkeypatch):
    rng = random.Random(25)
    texts = [" ".join(words(rng, rng.randrange(1, 12))) for _ in range(900)] + ["a b", "", None]
    far = 1 << 60
    # an id of its own each, then one that many rows share, one that is no target, and none
    ids = [far + i for i in range(700)] + [7] * 60 + [8] * 60 + [None] * (len(texts) - 820)
    chosen = {far + i for i in range(0, 700, 2)} | {7, 9}
    sent = []
    monkeypatch.setattr(F, "broadcast", lambda df: sent.append(df.count()) or df)
    targets = spark.createDataFrame([(i,) for i in [*chosen, 7, None]], "doc_id long")
    rows = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in zip(ids, texts, strict=True)], SCHEMA)
    got = lm_score.score(rows, targets).collect()
    assert sum(sent) == 2  # the ids of many rows
    losses = plain_losses(texts, {k for k, i in enumerate(ids) if i in chosen})
    want = [(i, len((t or "").split()), *x) for i, t, x in zip(ids, texts, zip(*losses, strict=True), strict=True)]

    def order(rows):
        return sorted(rows, key=lambda r: [x is None or round(x, 6) for x in r])

    for a, b in zip(order(r[:4] for r in got), order(want), strict=True):
        assert a[:2] == b[:2] and all(x is y is None or abs(x - y) < 1e-9 for x, y in zip(a[2:], b[2:], strict=True))


def test_lm_score_keeps_many_ngrams_apart():
    rng = random.Random(22)
    bits = lm_score.key_bits(1_200_000)
    keys, sizes = lm_score.grams([" ".join(f"{rng.random()}" for _ in range(400_000))], lm_score.WordHash(), 64)
    assert sizes.tolist() == [400_000] and len(np.unique(keys)) == 3 * len(np.unique(keys[0])) == 1_200_000
    some = np.sort(keys[0])
    assert np.array_equal(np.cumsum(lm_score.unpack(lm_score.pack(np.diff(some, prepend=np.uint64(0)))), dtype=np.uint64), some)
    # shorter hashes at the same rate of shared ones whatever the size
    assert bits == 41 and lm_score.key_bits(1 << 50) == 64 and lm_score.key_bits(0) == lm_score.SPARE
    assert len(np.unique(keys >> np.uint64(64 - bits))) > 1_199_990
    for buckets in (1, 64, 1000):
        for b, part in lm_score.runs(np.sort(keys[2]), buckets):
            low, high = lm_score.first_of(b, buckets), np.sort(keys[2])[part]
            assert low <= high[0] and (b + 1 == buckets or high[-1] < lm_score.first_of(b + 1, buckets))


def test_pipeline_drops_copies_of_four_fifths(spark, sf):
    rng = random.Random(23)
    text = words(rng, 400)
    longer = text + words(rng, 60)  # 0.87 on five words and on three
    edited = list(text)
    for k in range(25, 400, 50):
        edited[k] = "edited"  # 0.82 on five words, 0.88 on three
    other = text[:200] + words(rng, 200)
    docs = frame(spark, [" ".join(w) for w in (text, longer, edited, other)])
    assert sorted(r.doc_id for r in corpus_pipeline.distinct(spark, docs, sf).collect()) == [0, 3]


def edited(rng, item, n):
    """``item`` after n edits: words changed, left out or put in, at n places."""
    out = [[w] for w in item]
    for k in rng.sample(range(len(item)), n):
        out[k] = rng.choice([["changed"], [], ["put", out[k][0]]])
    return [w for part in out for w in part]


@pytest.mark.parametrize("rate", [0.0, 0.05, 0.1, 0.2])
def test_decontaminate_finds_all_up_to_the_threshold(spark, rate):
    rng = random.Random(24)
    items = [words(rng, rng.randrange(15, 60)) for _ in range(80)]
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(items)], "item_id long, text string")
    docs = [" ".join(words(rng, 40) + edited(rng, w, int(rate * len(w) + 1e-9)) + words(rng, 40)) for w in items]
    # every other word from the first on is changed, so the first pair comes late; and a worse copy before a better one
    w = items[0]
    docs.append(" ".join(["changed" if k % 2 == 0 and k < 2 * int(rate * len(w)) else x for k, x in enumerate(w)]))
    docs.append(" ".join(edited(rng, w, int(rate * len(w) + 1e-9)) + w))
    found = decontaminate.matches(frame(spark, docs), bench).collect()
    assert {(r.doc_id, r.item_id) for r in found} == {(i, i) for i in range(80)} | {(80, 0), (81, 0)}
    assert all(r.distance <= int(rate * r.n_words + 1e-9) for r in found)
    assert sum(r.doc_id == 81 for r in found) == 2


@pytest.mark.parametrize("block", [ngram_join.BLOCK, 300])
def test_ngram_join_counts_all_links(spark, monkeypatch, block):
    monkeypatch.setattr(ngram_join, "BLOCK", block)
    rng, texts = random.Random(25), []
    for n in (60, 120, 300):
        base = words(rng, n)
        for _ in range(8):
            text = list(base)
            for k in rng.sample(range(n), rng.randrange(n // 40 + 1)):
                text[k] = f"edit{rng.randrange(3)}"
            texts.append(" ".join(text))
    texts += texts[::5] + ["one two", "one two", "", None] + [" ".join(words(rng, 50)) for _ in range(10)]
    sets = [ngram_join.shingles(t or "", 3, ngram_join.WordHash()) for t in texts]
    want = dict.fromkeys(range(len(texts)), 0)
    for i, a in enumerate(sets):
        for j, b in enumerate(sets):
            both = len(np.intersect1d(a, b))
            want[i] += i != j and both > 0 and 100 * both >= 90 * (len(a) + len(b) - both)
    got = {r.doc_id: r.n_links for r in ngram_join.classes(frame(spark, texts)).collect()}
    assert got == want and max(want.values()) > 4
