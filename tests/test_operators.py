import collections
import math
import random
import re

import pytest
from pyspark.sql import functions as F

from talentspark.functions import patterns as P
from talentspark.functions import redact as R
from talentspark.operators import dictionary as D
from talentspark.operators import entities as E
from talentspark.operators import features as FT
from talentspark.operators import grams as G
from talentspark.operators import joins
from talentspark.operators import matching as M
from talentspark.operators import metrics as MT
from talentspark.operators import splits as SP
from talentspark.plans import analyze, dataset


def pairs(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


# ------------------------------------------------------------------ dictionary and phrases

@pytest.fixture(scope="module")
def dictionary(spark):
    esco = spark.createDataFrame(
        [(1, "Python", "py\n python 3\n\n"), (2, "Snake care ", "PY"), (3, "Docker", None)],
        "row_no long, preferredLabel string, altLabels string")

    def terms(*t):
        return spark.createDataFrame([(x,) for x in t], "term string")

    spans = spark.createDataFrame([("acme excel", 0, 4), ("acme foo corp", 0, 4), ("acme foo corp", 9, 13), ("acme", 0, 4)],
                                  "term string, start int, end int")
    return D.skill_dictionary(esco, terms("python", "writing"), terms("writing", "law"),
                              terms("acme excel", "acme foo corp", "acme", "docker"), spans)


def test_merge_rules(dictionary):
    assert dict(pairs(dictionary, "phrase", "preferred")) == {
        "python": "python", "python 3": "python", "snake care": "snake care", "py": "snake care", "docker": "docker",
        "writing": "writing", "law": "law", "acme excel": "excel", "acme foo corp": "acme foo", "acme": "acme"}


def test_tokens(one):
    assert one(G.tokens, "CI/CD and C++ Node.js")[0] == "ci / cd and c + + node . js".split()


def test_phrase_match(spark, dictionary):
    docs = spark.createDataFrame([(1, "Python 3, PY and Acme   Excel; python"), (2, "hiking"), (3, "")], "doc_id long, t string")
    hits = G.phrase_match(docs, "doc_id", "t", G.lexicon(dictionary))
    assert pairs(hits, "doc_id", "start", "end", "preferred") == [
        (1, 0, 1, "python"), (1, 0, 2, "python"), (1, 3, 4, "snake care"), (1, 5, 6, "acme"), (1, 5, 7, "excel"), (1, 8, 9, "python")]
    assert pairs(G.first_spans(hits, "doc_id"), "skill", "start", "end") == [
        ("acme", 5, 6), ("excel", 5, 7), ("python", 0, 1), ("snake care", 3, 4)]


def test_empty_dictionary(spark):
    docs = spark.createDataFrame([(1, "x")], "doc_id long, t string")
    lex = G.lexicon(spark.createDataFrame([], "phrase string, preferred string"))
    assert G.phrase_match(docs, "doc_id", "t", lex).count() == 0


def test_spellings_of_one_phrase(spark):
    lex = G.lexicon(spark.createDataFrame([("ci/cd", "b"), ("ci / cd", "a"), ("x  y", "q")], "phrase string, preferred string"))
    assert pairs(lex.table, "gram", "preferred") == [("ci / cd", "a"), ("x y", "q")]


def test_whole_word_hits_equal_python(spark):
    rng = random.Random(5)
    parts = ["go", "net", ".", "c", "+", "#", " ", "  ", "-", "é", "_", "a1", "\n", "İ"[:0] + "ß"]
    texts = ["".join(rng.choice(parts) for _ in range(12)) for _ in range(150)]
    skills = list({"".join(rng.choice(parts) for _ in range(rng.randint(1, 4))).strip() for _ in range(120)} - {""})
    docs = spark.createDataFrame(list(enumerate(texts)), "id long, t string")
    got = set(pairs(G.whole_word_hits(docs, "id", "t", G.skill_table(spark, skills)), "id", "pos"))
    assert got == {(i, p) for i, t in enumerate(texts) for p, s in enumerate(skills)
                   if re.search(r"\b" + re.escape(s.lower()) + r"\b", t.lower())}


def test_model_skills_fill_gaps(spark, dictionary):
    docs = spark.createDataFrame([(1, "python rust"), (2, "rust")], "doc_id long, t string")
    entities = spark.createDataFrame(
        [(1, "skill", " Py ", 0, 2, 0.9), (1, "software", "Python", 0, 6, 0.9), (1, "skill", "Rust", 7, 11, 0.9),
         (1, "skill", "rust", 2, 3, 0.7), (1, "education", "BSc", 0, 3, 0.9), (2, "skill", "rust", 0, 4, 0.5)],
        "doc_id long, label string, text string, start int, end int, score double")
    got = analyze.extract_skills(docs, "doc_id", "t", G.lexicon(dictionary), entities)
    assert pairs(got, "doc_id", "skill", "unit", "start", "end") == [
        (1, "python", "token", 0, 1), (1, "rust", "char", 2, 3), (1, "snake care", "char", 0, 2)]


def test_analyze_jobs(spark, dictionary):
    docs = spark.createDataFrame([(1, "We use <Python> & docker"), (2, "hiking"), (3, " "), (4, None)], "doc_id long, t string")
    rows = {r.doc_id: r for r in analyze.analyze_jobs(docs, "doc_id", "t", G.lexicon(dictionary)).collect()}
    assert set(rows) == {1, 2} and rows[2].skills == {} and rows[1].education == ""
    assert rows[1].cleaned_job_desc == "We use Python docker"
    assert {k: (v.unit, v.start, v.end) for k, v in rows[1].skills.items()} == {"python": ("token", 2, 3), "docker": ("token", 3, 4)}


# ------------------------------------------------------------------ entities

def test_gazetteer_spans(spark):
    text = "Ann met ann lee; Ännann ann"
    df = spark.createDataFrame([(1, text), (2, ""), (3, "nobody")], "id long, t string")
    names = [("PERSON", "Ann"), ("PERSON", "Ann Lee"), ("ORG", "met")]
    got = pairs(E.entity_table(df, "id", E.gazetteer_spans(F.col("t"), names)), "id", "start", "end", "label", "text")
    assert got == [(1, 0, 3, "PERSON", "Ann"), (1, 4, 7, "ORG", "met"), (1, 8, 15, "PERSON", "ann lee"), (1, 24, 27, "PERSON", "ann")]
    assert all(text[a:b] == t for _, a, b, _, t in got)
    table = E.entity_table(df, "id", E.gazetteer_spans(F.col("t"), names))
    assert pairs(E.redact_entities(df, "id", "t", table), "id", "t") == [
        (1, "[PERSON] met [PERSON]; Ännann [PERSON]"), (2, ""), (3, "nobody")]


def test_model_entities(spark):
    def load():
        return lambda texts: [[dict(label="skill", text=t[:2], start=0, end=2, score=0.7)] if t else [] for t in texts]

    df = spark.createDataFrame([(1, "abc"), (2, "")], "id long, t string")
    assert pairs(E.model_entities(df, "id", "t", load), "id", "label", "text", "end") == [(1, "skill", "ab", 2)]


def test_label_check(spark):
    """Redactions by column and by table, and both plans, refuse labels that the finder does not know."""
    names = [("PERSON", "ann"), ("GPE", "rome")]
    docs = spark.createDataFrame([(1, "Ann of Rome", "HR")], "id long, Text string, Category string")
    spans = E.gazetteer_spans(F.col("Text"), names)
    table = E.entity_table(docs, "id", spans)
    assert docs.select(R.redact_spans(F.col("Text"), spans, ["GPE"], ["PERSON", "GPE"])).first()[0] == "Ann of [GPE]"
    assert E.redact_entities(docs, "id", "Text", table, ["GPE"], ["PERSON", "GPE"]).first().Text == "Ann of [GPE]"
    finder = lambda c: E.gazetteer_spans(c, names)
    good = dict(entity_spans=finder, labels=["PERSON"], known=["PERSON", "GPE"])
    assert dataset.prepare_dataset(docs, **good).first().Text == "[PERSON] of Rome"
    assert analyze.clean_resumes(docs, "id", "Text", **good).first().cleaned_resume == "[PERSON] of Rome"
    bad = dict(entity_spans=finder, labels=["PERSON", "FOO"], known=["PERSON", "GPE"])
    for run in (
        lambda: R.redact_spans(F.col("Text"), spans, ["FOO"], ["PERSON"]),
        lambda: E.redact_entities(docs, "id", "Text", table, None, ["PERSON"]),  # GPE and LOC are asked for
        lambda: dataset.prepare_dataset(docs, **bad),
        lambda: analyze.clean_resumes(docs, "id", "Text", **bad),
    ):
        with pytest.raises(ValueError, match="unknown entity labels"):
            run()


def test_rare_grams_are_not_kept_for_vocabularies(spark):
    texts = [f"aa bb aa bb rare{chr(97 + i // 2)} odd{chr(97 + i // 2)}" for i in range(20)]
    tokens = spark.createDataFrame([(i % 4, t.split()) for i, t in enumerate(texts)], "fold int, _tokens array<string>")
    terms, sizes = FT.fold_terms(tokens, 3, [2], 1.0, 2)
    assert sizes == {f: 5 for f in range(4)}
    # every training set has two words with 30 occurrences; what is rarer has no place
    assert {r["term"]: r["cf"] for r in terms.where("words > 1").collect()} == {"aa bb": 40}
    assert {r["term"] for r in FT.fold_terms(tokens, 3, [2], 1.0, 50)[0].where("words = 2").collect()} > {"aa bb", "bb aa", "rarea odda"}


def test_embedding_batches_are_small(spark):
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    was, rows = spark.conf.get(key), spark.range(3000).selectExpr("string(id) AS t")
    spark.conf.set(key, "10000")
    try:
        FT.embed_with(F.col("t"), lambda: lambda texts: [[len(t)] for t in texts])
        assert int(spark.conf.get(key)) <= 1000
    finally:
        spark.conf.set(key, was)


def test_fold_vocabularies(spark):
    texts = ["red fox runs", "red fox sleeps", "blue fox runs", "red fox runs", None, "", "red cat", "lone words here"]
    folds = [0, 1, 2, 0, 1, 2, 1, None]
    docs = spark.createDataFrame(list(zip(texts, folds, strict=True)), "t string, f int")
    for limit in (100, 2):
        got = FT.fold_vocabularies(docs, "t", "f", max_n=2, min_df=2, max_df=0.8, max_features=limit).collect()
        for fold in range(3):
            rows = [(t or "").split() for t, f in zip(texts, folds, strict=True) if f is not None and f != fold]
            grams = [[" ".join(w[i:i + n]) for n in (1, 2) for i in range(len(w) - n + 1)] for w in rows]
            df, cf = collections.Counter(g for x in grams for g in set(x)), collections.Counter(g for x in grams for g in x)
            want = sorted((-cf[g], g, df[g]) for g in df if 2 <= df[g] <= 0.8 * len(rows))[:limit]
            assert sorted((-r.cf, r.term, r.df) for r in got if r.fold == fold) == want and want
    assert FT.fold_vocabularies(docs.limit(0), "t", "f").count() == 0


def test_validate(spark):
    df = spark.createDataFrame([(1, "ok"), (2, None), (3, ""), (4, "  \n")], "id long, t string")
    good, bad = analyze.validate(df, "t")
    assert pairs(good, "id") == [(1,)] and pairs(bad, "id", "reason") == [(2, "null"), (3, "blank"), (4, "blank")]


# ------------------------------------------------------------------ joins

@pytest.mark.parametrize("how", ["inner", "left", "left_anti", "left_semi"])
def test_large_lookup_equals_plain_join(spark, how):
    big = spark.createDataFrame([(i, "hot" if i % 3 else f"k{i % 7}") for i in range(300)], "id long, k string")
    small = spark.createDataFrame([("hot", 1), ("k0", 2), ("k3", 3), ("k3", 4)], "k string, v int")
    plain = sorted(map(tuple, big.join(small, "k", how).collect()))
    assert sorted(map(tuple, joins.lookup_join(big, small, ["k"], how).collect())) == plain
    assert sorted(map(tuple, joins.lookup_join(big, small, ["k"], how, ["id"], max_rows=1).collect())) == plain
    assert sorted(map(tuple, joins.skew_join(big, small, ["k"], how, ["id"], hot_rows=50).collect())) == plain
    assert sorted(map(tuple, joins.skew_join(big, small, ["k"], how, ["id"]).collect())) == plain


def test_broadcast_bound(spark):
    df = spark.range(100)
    assert joins.fits_broadcast(df) and not joins.fits_broadcast(df, max_rows=99) and not joins.fits_broadcast(df, max_bytes=50)


# ------------------------------------------------------------------ matching

def test_score_pairs(spark):
    resumes = M.keyword_sets(spark.createDataFrame([(1, "Five years of Kubernetes, Terraform and network design.")],
                                                   "resume_id long, t string"), "resume_id", "t")
    jobs = M.keyword_sets(spark.createDataFrame([(7, "Seeking Kubernetes and network design talent"), (8, "the of")],
                                                "job_id long, t string"), "job_id", "t")
    requests = spark.createDataFrame([(1, 7), (1, 8)], "resume_id long, job_id long")
    assert pairs(M.score_pairs(requests, resumes, jobs), "job_id", "score", "band") == [(7, 60, P.ADVICE_TEXT), (8, 0, P.ADVICE_TEXT)]


@pytest.mark.parametrize("min_score,top_k,rows", [(70, 3, None), (1, 2, None), (50, 100, 1), (100, 1, None)])
def test_match_pairs_equals_brute_force(spark, monkeypatch, min_score, top_k, rows):
    rng = random.Random(min_score)
    words = [f"w{i}" for i in range(14)]

    def sets(n, most):
        made = [sorted(rng.sample(words, min(len(words), rng.randint(0, most)))) for _ in range(n)]
        return made + made[: n // 3] + [["w0", "w1"]] * 5  # with copies

    resumes, jobs = sets(40, 10), sets(25, 6)
    if rows is not None:  # nothing may be broadcast, and every key counts as hot
        monkeypatch.setattr(M, "lookup_join", lambda a, b, on, how="inner", by=None: joins.lookup_join(a, b, on, how, by, 0))
        monkeypatch.setattr(M, "skew_join", lambda a, b, on, how, by: joins.skew_join(a, b, on, how, by, 1))
    got = M.match_pairs(
        spark.createDataFrame(list(enumerate(resumes)), "resume_id long, words array<string>"),
        spark.createDataFrame(list(enumerate(jobs)), "job_id long, words array<string>"), top_k, min_score)
    want = []
    for i, r in enumerate(resumes):
        scored = [(-math.floor(100 * len(set(j) & set(r)) / len(j) + 0.5), k) for k, j in enumerate(jobs) if j]
        best = sorted((s, k) for s, k in scored if -s >= min_score)[:top_k]
        want += [(i, k, -s, n) for n, (s, k) in enumerate(best, 1)]
    assert pairs(got, "resume_id", "job_id", "score", "rank") == sorted(want)


def test_match_pairs_refuses_zero(spark):
    with pytest.raises(ValueError):
        M.match_pairs(None, None, min_score=0)


# ------------------------------------------------------------------ splits, terms, metrics

@pytest.fixture(scope="module")
def classed(spark):
    rows = [(i, "abc"[min(i % 7, 2)]) for i in range(500)] + [(1000 + i, "d") for i in range(3)] + [(2000, "e"), (3000, None)]
    return spark.createDataFrame(rows, "id long, c string")


def test_split_shares(classed):
    n = collections.Counter(r.c for r in classed.collect() if r.c)
    first = SP.stratified_split(classed, "c", "id").collect()
    test = collections.Counter(r.c for r in first if r.is_test)
    assert test == {c: math.ceil(k * 30 / 100) for c, k in n.items()} and len(first) == sum(n.values())
    again = SP.stratified_split(classed.repartition(5), "c", "id").collect()
    assert {r.id for r in first if r.is_test} == {r.id for r in again if r.is_test}


def test_fold_sizes(classed):
    sizes = collections.defaultdict(collections.Counter)
    for r in SP.stratified_kfold(classed, "c", "id").collect():
        sizes[r.c][r.fold] += 1
    n = collections.Counter(r.c for r in classed.collect() if r.c)
    for c, folds in sizes.items():
        counts = [folds.get(f, 0) for f in range(5)]
        assert sum(counts) == n[c] and max(counts) - min(counts) <= 1


def test_tfidf_by_hand(spark):
    texts = ["red apple red", "red apple pie", "a green pie"]
    docs = spark.createDataFrame(list(enumerate(texts)), "id long, t string")
    stats = {r.term: (r.df, r.cf, r.idf) for r in FT.term_stats(docs, "t", max_df=1.0).collect()}
    idf = math.log(4 / 3) + 1
    assert stats == {"red": (2, 3, pytest.approx(idf)), "apple": (2, 2, pytest.approx(idf)), "pie": (2, 2, pytest.approx(idf)),
                     "red apple": (2, 2, pytest.approx(idf))}
    assert set(r.term for r in FT.term_stats(docs, "t", max_df=1.0, max_features=2).collect()) == {"red", "apple"}
    weights = {(r.id, r.term): r.tfidf for r in FT.tfidf(docs, "id", "t", max_df=1.0).collect()}
    assert weights[0, "red"] == pytest.approx(2 / math.sqrt(6)) and weights[2, "pie"] == pytest.approx(1.0)


@pytest.mark.parametrize("max_features", [1, 5, 12, 40, 1000])
def test_term_pruning_loses_nothing(spark, max_features):
    rng = random.Random(max_features)
    texts = [" ".join(rng.choices(["aa", "bb", "cc", "dd", "ee", "ff"], [9, 7, 5, 2, 1, 1], k=rng.randint(0, 9))) for _ in range(30)]
    grams = [[" ".join(t.split()[i:i + n]) for n in (1, 2, 3) for i in range(len(t.split()) - n + 1)] for t in texts]
    cf = collections.Counter(g for text in grams for g in text)
    df = collections.Counter(g for text in grams for g in set(text))
    want = sorted((g for g in cf if 3 <= df[g] <= 0.8 * 30), key=lambda g: (-cf[g], g))[:max_features]
    docs = spark.createDataFrame([(t,) for t in texts], "t string")
    got = FT.term_stats(docs, "t", min_df=3, max_df=0.8, max_features=max_features)
    assert pairs(got, "term", "df", "cf") == sorted((g, df[g], cf[g]) for g in want)


def test_vectoriser_agrees_with_terms(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    from pyspark.ml import Pipeline
    from pyspark.ml.functions import vector_to_array

    listed = FT.term_lists("text").fit(docs).transform(docs)
    model = Pipeline(stages=FT.tfidf_stages()).fit(listed)
    vectors = model.transform(listed)
    sums = dict(pairs(vectors.select("doc_id", F.aggregate(vector_to_array("features"), F.lit(0.0), lambda a, x: a + x * x).alias("s")), "doc_id", "s"))
    counts = dict(pairs(FT.term_stats(docs, "text"), "term", "cf"))
    assert all(s == 0 or abs(s - 1) < 1e-9 for s in sums.values())
    # terms with the lowest count that still fits are ties, of which either may keep others
    assert {t for t, n in counts.items() if n > min(counts.values())} <= set(model.stages[0].vocabulary)


def test_lemma_lookup(spark):
    docs = spark.createDataFrame([(1, "The cars ran, x2"), (2, "the")], "id long, t string")
    lemmas = spark.createDataFrame([("cars", "car"), ("ran", "run")], "form string, lemma string")
    assert pairs(FT.normalize_by_lookup(docs, "id", "t", ["the"], lemmas), "id", "normalized") == [(1, "car run"), (2, "")]


def test_embed_with(spark):
    def load():
        return lambda texts: [[float(len(t)), float(len(texts))] for t in texts]

    df = spark.createDataFrame([(i, "x" * i) for i in range(70)], "id long, t string").coalesce(1)
    got = {r[0]: r[1] for r in df.select("id", FT.embed_with(F.col("t"), load)).collect()}
    assert all(v[0] == i for i, v in got.items()) and {v[1] for v in got.values()} == {32.0, 6.0}


def test_models_by_name(spark, monkeypatch):
    monkeypatch.setattr(FT, "MODELS", {})

    def load():
        return lambda texts: [[float(len(t)), 1.0] for t in texts]

    with pytest.raises(ValueError, match="unknown embedding model 'sizes'; known: none"):
        FT.embed_with(F.col("t"), "sizes")
    FT.register_model("sizes", load)
    FT.register_model("sizes", load)
    df = spark.createDataFrame([(1, "abc"), (2, ""), (3, None)], "id long, t string")
    got = {r.id: r.v for r in df.select("id", FT.embed_with(F.col("t"), "sizes").alias("v")).collect()}
    assert got == {1: [3.0, 1.0], 2: [0.0, 1.0], 3: [0.0, 1.0]}
    assert df.limit(0).select(FT.embed_with(F.col("t"), "sizes").alias("v")).count() == 0
    for name, other in (("", load), ("sizes", lambda: None)):
        with pytest.raises(ValueError, match="no name"):
            FT.register_model(name, other)


def test_report_by_hand(spark):
    rows = [("a", "a")] * 3 + [("a", "b")] + [("b", "b")] * 2 + [("c", "a")] + [("b", "d")]
    df = spark.createDataFrame(rows, "y string, p string")
    got = {r.label: r for r in MT.classification_report(df, "y", "p").collect()}
    assert (got["a"].precision, got["a"].recall, got["a"].support) == (0.75, 0.75, 4)
    assert (got["c"].precision, got["c"].recall, got["c"].f1) == (0, 0, 0) and got["d"].support == 0
    assert got["accuracy"].f1 == pytest.approx(5 / 8) and got["accuracy"].support == 8
    f1 = [0.75, 2 / 3, 0, 0]
    assert got["macro avg"].f1 == pytest.approx(sum(f1) / 4)
    assert got["weighted avg"].f1 == pytest.approx((4 * 0.75 + 3 * 2 / 3) / 8)
    assert MT.MacroF1("y", "p").evaluate(df) == pytest.approx(sum(f1) / 4)


def test_label_distribution(spark):
    df = spark.createDataFrame([("train", "a"), ("train", "b"), ("test", "a")], "part string, label string")
    got = {(r.part, r.label): r.n for r in MT.label_distribution(df, "label", "part").collect()}
    assert got == {("train", "a"): 1, ("train", "b"): 1, ("test", "a"): 1, ("train", None): 2, ("test", None): 1,
                   (None, "a"): 2, (None, "b"): 1, (None, None): 3}


def test_class_weights(spark):
    df = spark.createDataFrame([("a",)] * 3 + [("b",)], "c string")
    assert pairs(MT.class_weights(df, "c"), "label", "weight") == [("a", pytest.approx(4 / 6)), ("b", 2.0)]


def test_category_map(spark):
    assert len(P.CATEGORY_PAIRS) == 43 and len({broad for _, broad in P.CATEGORY_PAIRS}) == 12
    df = spark.createDataFrame([("DevOps",), ("devops",), ("BPO",), (None,)], "Category string")
    assert {r.Category: r.Mapped_Category for r in dataset.map_categories(df).collect()} == {
        "DevOps": "Technology", "devops": None, "BPO": "Business & Management", None: None}
