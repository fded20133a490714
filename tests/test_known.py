"""Sequences found a batch at a time, against plain searches."""

import random
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from talentspark.operators import features as FT
from talentspark.operators import grams as G
from talentspark.operators import known as K

TEXTS = ["aa bb aa bb cc", None, "", "x", "Aa, bb\ncc-x dd", "KA İb zéro ab1cd", "dd aa bb aa bb cc dd", "aa"]


def texts(spark, rows=TEXTS):
    return spark.createDataFrame(list(enumerate(rows)), "id int, t string").coalesce(1)


def test_words_in_bytes_equal_the_pattern(spark):
    lower = texts(spark).select(F.lower("t").alias("low"), FT.term_tokens(F.col("t")).alias("words")).collect()
    found = K.Tokens(pa.array([r.low for r in lower], pa.string()))
    words = found.distinct.take(pa.array(found.codes)).to_pylist()
    assert list(zip(found.rows.tolist(), words, strict=True)) == [(i, w) for i, r in enumerate(lower) for w in r.words or []]
    assert len(K.Tokens(pa.array([None, "", "a"], pa.string())).rows) == 0


def test_known_sequences_equal_slices():
    rng = random.Random(1)
    lists = [[rng.choice("abcd") for _ in range(rng.randrange(9))] for _ in range(60)]
    known = sorted({tuple(rng.choice("abc") for _ in range(rng.randrange(1, 5))) for _ in range(20)})
    found = K.Tokens(pa.array(lists, pa.list_(pa.string())))
    first = np.searchsorted(found.rows, np.arange(len(lists)))
    got = {(int(found.rows[p]), int(p - first[found.rows[p]]), known[k])
           for _, at, names in K.KnownSequences(known).occurrences(found) for p, k in zip(at, names, strict=True)}
    assert got == {(i, s, x) for i, t in enumerate(lists) for x in known for s in range(len(t)) if tuple(t[s:s + len(x)]) == x}


def test_a_batch_passes_on_one_row_per_gram(spark):
    docs = texts(spark).select(F.lower("t").alias("t"))
    rows = [tuple(r) for r in K.partial_counts(docs, "t", None, None).collect()]
    assert {r[0]: r[1:] for r in rows}["aa"] == (4, 6) and len(rows) == len({r[0] for r in rows})
    parts = ["aa", "bb"]
    pairs = {r["_code"]: (r["df"], r["cf"]) for r in K.partial_counts(docs, "t", parts, None).collect()}
    assert pairs == {1: (3, 5), 2: (2, 2)}


def test_parts_too_many_for_the_tasks_are_joined(spark, monkeypatch):
    rng = random.Random(2)
    docs = texts(spark, [" ".join(rng.choice(["aa", "bb", "cc", "dd", "ee"]) for _ in range(rng.randrange(12))) for _ in range(40)])
    folds = docs.withColumn("fold", F.col("id") % 3)

    def results():
        stats = FT.term_stats(docs, "t", min_df=2, max_df=0.9, max_features=20)
        return Counter(map(tuple, stats.collect())), Counter(map(tuple, FT.fold_vocabularies(folds, "t", "fold", max_features=15).collect()))

    sent = results()
    monkeypatch.setattr(K, "KNOWN_ROWS", 0)
    assert results() == sent


def test_tfidf_adds_up_texts_of_one_id(spark):
    docs = texts(spark, ["aa bb", "aa bb cc", "cc aa aa", "dd"])
    twice = docs.withColumn("id", F.when(F.col("id") < 3, F.floor(F.col("id") / 2)))
    got = {(r.id, r.term): r.tfidf for r in FT.tfidf(twice, "id", "t", max_n=2, max_df=1.0).collect()}
    idf = {r.term: r.idf for r in FT.term_stats(docs, "t", max_n=2, max_df=1.0).collect()}
    counts = {0: Counter({"aa": 2, "bb": 2, "cc": 1, "aa bb": 2}), 1: Counter({"cc": 1, "aa": 2})}
    want = {}
    for i, c in counts.items():
        norm = sum((n * idf[t]) ** 2 for t, n in c.items()) ** 0.5
        want |= {(i, t): n * idf[t] / norm for t, n in c.items()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want)


RUNS = ["c++ dev, c++dev", "a.net  .net x.net", "New York new york  new york", None, "", "c++", "of the of the of the"]
SKILLS = ["c++", ".net", "new york", "New York", "of the", " of", ".", "++dev", "+", "york  new"]


def test_runs_sent_to_tasks_equal_joined_ones(spark, monkeypatch):
    docs = texts(spark, RUNS * 2).withColumn("id", F.when(F.col("id") < 10, F.col("id") % 7))
    once = G.skill_table(spark, SKILLS)
    repeated = once.withColumn("pos", F.when(F.col("pos") > 2, F.col("pos") % 4))
    phrases = spark.createDataFrame([("new york", "NY"), ("of the of", "x"), ("the", "y"), ("c + +", "z")], "phrase string, preferred string")

    def results():
        hits = G.phrase_match(docs, "id", "t", G.lexicon(phrases))
        return [Counter(map(tuple, df.collect())) for df in (
            G.whole_word_hits(docs, "id", "t", once), G.whole_word_hits(docs, "id", "t", repeated), hits)]

    sent = results()
    assert all(sent) and (0, 7, "++dev") in sent[0] and not any(pos == 5 for _, pos, _ in sent[0])
    monkeypatch.setattr(K, "KNOWN_ROWS", 0)
    assert results() == sent


def test_a_text_passes_on_one_row_per_run_and_pair_of_neighbours(spark):
    pieces = texts(spark, ["the of the the", "x.y .y x.y"]).select(
        "id", F.regexp_extract_all("t", F.lit(G.WORD_PIECE), F.lit(0)).alias("p"))
    found = K.partial_runs(pieces, "id", "p", [["the"], [".", "y"]], [False, True], G.BLANKS)
    assert Counter(map(tuple, found.collect())) == Counter([(0, 0, None, None), (1, 1, "x", None), (1, 1, None, None)])
    blank = spark.createDataFrame([(c,) for c in G.BLANKS], "c string")
    assert blank.where(F.col("c").rlike(f"[{G.P.WHITESPACE}]")).count() == len(G.BLANKS)
    every = spark.range(1, 0x10000).where("id < 55296 or id > 57343").select(F.decode(F.encode(F.expr(
        "decode(unhex(lpad(hex(id), 4, '0')), 'UTF-16BE')"), "UTF-8"), "UTF-8").alias("c"))
    assert every.where(F.col("c").rlike(rf"\A[{G.P.WHITESPACE}]\z")).count() == len(G.BLANKS)
