import json

import pytest
from pyspark.sql import functions as F

from talentspark.operators import grams as G
from talentspark.operators import learning as L
from talentspark.operators.entities import gazetteer_spans
from talentspark.operators.features import embed_with
from talentspark.plans import analyze, dataset, train
from talentspark.session import scratch_path, settle_table, shared_dir
from talentspark.sources import files
from talentspark.streaming import requests


def test_csv_round_trip(spark, tmp_path):
    rows = [("a", 'x "q"\n y, z ', "b"), ("c", " lead", "d")]
    df = spark.createDataFrame(rows, "Category string, Text string, M string")
    files.sink_dataset_csv(df, str(tmp_path / "d"))
    got = files.scan_labelled_csv(spark, str(tmp_path / "d"), df.schema.simpleString()[7:-1].replace(":", " "))
    assert sorted(map(tuple, got.collect())) == sorted(rows)


def test_vocabulary(spark, tmp_path):
    (tmp_path / "v.txt").write_text('Code\tElement Name\n1\t Sql \n2\tsql\n3\t"R" tool\n')
    got = files.scan_vocab_tsv(spark, str(tmp_path / "v.txt"), "Element Name")
    assert sorted(r.term for r in got.collect()) == ['"r" tool', "sql"]


def test_skill_map(spark, tmp_path):
    good = tmp_path / "m.json"
    good.write_text(json.dumps({"py": "python", "python": "python"}, indent=1))
    assert sorted(map(tuple, files.scan_skill_map(spark, str(good)).collect())) == [("py", "python"), ("python", "python")]
    with pytest.raises(FileNotFoundError):
        files.scan_skill_map(spark, str(tmp_path / "none.json"))
    bad = tmp_path / "bad.json"
    bad.write_text("[1, 2")
    with pytest.raises(Exception):
        files.scan_skill_map(spark, str(bad)).collect()


def test_uploads(spark, tmp_path):
    for name in ("a.pdf", "b.DOCX", "c.doc", "d.txt"):
        (tmp_path / name).write_bytes(b"x")
    got = {r.path.rsplit("/", 1)[1]: r.status for r in files.scan_uploads(spark, str(tmp_path)).collect()}
    assert got == {"a.pdf": "accepted", "b.DOCX": "accepted", "c.doc": "unsupported", "d.txt": "rejected"}


class FakeSession:
    """Just the settings of a session."""

    def __init__(self, master, folder):
        self.master, self.dir, self.conf, self.sparkContext = master, None, {"spark.checkpoint.dir": folder}, self

    def getCheckpointDir(self):
        return self.dir

    def setCheckpointDir(self, folder):
        self.dir = folder


def test_shared_folder_is_the_clusters():
    cluster = FakeSession("yarn", "hdfs:///shared/")
    assert scratch_path(cluster, "x").startswith("hdfs:///shared/x-") and cluster.dir == "hdfs:///shared/"
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_dir(FakeSession("yarn", None))
    local = FakeSession("local[2]", None)
    assert shared_dir(local) == local.dir


def test_settled_table_keeps_rows_and_schema(spark):
    df = spark.range(3).withColumn("words", F.array(F.lit("a")))
    table = settle_table(df, "rows")
    assert table.schema.simpleString() == df.schema.simpleString() and table.count() == 3


@pytest.fixture(scope="module")
def texts(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", F.col("lang").alias("class"), "text")


@pytest.fixture(scope="module")
def model(texts):
    return train.fit_text_model(texts, "class", "text", max_iter=5)


def test_model_learns_and_survives_storage(spark, texts, model, tmp_path):
    predicted = model.transform(texts)
    right = predicted.where(F.col("category") == F.col("class")).count() / texts.count()
    assert right > 0.9 and L.classes_of(model) == ["de", "en", "es", "fr"]
    L.save_model(model, str(tmp_path / "m"))
    again = L.load_model(str(tmp_path / "m")).transform(texts)
    assert sorted(map(tuple, again.select("doc_id", "category").collect())) == sorted(
        map(tuple, predicted.select("doc_id", "category").collect()))
    with pytest.raises(Exception):
        L.load_model(str(tmp_path / "none"))


def test_scores_follow_the_prediction(texts, model):
    predicted = model.transform(texts)
    from talentspark.functions.scores import argmax

    assert predicted.where(argmax(L.decision_scores(predicted)) != F.col("prediction")).count() == 0


def test_classify_and_analyze_resumes(spark, texts, model):
    lex = G.lexicon(spark.createDataFrame([("the", "the"), ("email", "mail")], "phrase string, preferred string"))
    rows = spark.createDataFrame([(1, "The the a.b@mail.example.org is of and in"), (2, " "), (3, "der die das und ist")], "id long, t string")
    got = {r.id: r for r in analyze.analyze_resumes(rows, "id", "t", model, lex).collect()}
    assert set(got) == {1, 3}
    assert got[1].cleaned_resume == "The the [EMAIL] is of and in" and got[1].education == ""
    assert {k: (v.unit, v.start, v.end) for k, v in got[1].skills.items()} == {"the": ("token", 0, 1), "mail": ("token", 3, 4)}
    assert len(got[1].categories) == 2 and got[1].categories[0] == "en" and got[3].categories[0] == "de"
    one = analyze.classify_resumes(rows, "id", "t", model, top_k=1).collect()
    assert {r.id: r.categories for r in one} == {1: ["en"], 3: ["de"]}
    with pytest.raises(ValueError, match="classes to choose from"):
        analyze.classify_resumes(rows, "id", "t", model, top_k=5)


def test_training(spark, texts):
    two = texts.where(F.col("class").isin("en", "fr"))
    extra = spark.createDataFrame([("le la les des", "fr")], "text string, class string")
    result = train.train_classifier(two, "doc_id", "class", "text", costs=[0.3], class_weights=["balanced", "none"], folds=2,
                                    synthetic=extra)
    scores = result.scores.collect()
    assert [json.loads(r.params) for r in scores] == [
        {"C": 0.3, "classWeight": w, "penalty": p} for w in ("balanced", "none") for p in ("l1", "l2")]
    assert all(r.mean_score > 0.8 for r in scores)
    assert {r.label for r in result.report().collect()} == {"en", "fr", "accuracy", "macro avg", "weighted avg"}
    assert result.topk((1, 2)).collect()[1].accuracy == 1.0
    assert result.train_predictions.count() + result.test_predictions.count() == two.count() + 1


def test_training_on_terms(spark, texts, tmp_path):
    two = texts.where(F.col("class").isin("en", "de"))
    result = train.train_on_terms(two, "doc_id", "class", "text", folds=2, max_iter=30, max_ns=[1, 2], min_dfs=[2],
                                  sizes=[500], costs=[0.5])
    assert [json.loads(r.params)["max_n"] for r in result.scores.collect()] == [1, 2]
    assert {r.label: r.f1 for r in result.report("train").collect()}["accuracy"] > 0.9
    L.save_model(result.model, str(tmp_path / "m"))
    row = spark.createDataFrame([("the and of is in",)], "text string")
    assert L.load_model(str(tmp_path / "m")).transform(row).first().category == "en"


def test_training_on_a_models_vectors(spark, texts):
    def load():
        return lambda batch: [[float(t.count(" the ")), float(t.count(" der ")), 1.0] for t in batch]

    def embed(text):
        return embed_with(text, load)

    two = texts.where(F.col("class").isin("en", "de"))
    result = train.train_classifier(two, "doc_id", "class", "text", costs=[0.5], class_weights=["none"], folds=2,
                                    max_iter=3, embed=embed)
    got = analyze.classify_resumes(spark.createDataFrame([(1, "of the and the end")], "id long, t string"), "id", "t",
                                   result.model, 1, embed=embed)
    assert got.first().categories == ["en"]


def test_second_cleaning_sees_entities_again(spark, model):
    seen = []

    def spans(text):
        seen.append(text)
        return gazetteer_spans(text, [("PERSON", "Ann")])

    lex = G.lexicon(spark.createDataFrame([("x", "x")], "phrase string, preferred string"))
    rows = spark.createDataFrame([(1, "Ann x")], "id long, t string")
    row = analyze.analyze_resumes(rows, "id", "t", model, lex, entity_spans=spans).first()
    assert row.cleaned_resume == "[PERSON] x" and len(seen) == 2


def test_prepare_dataset_with_entities(spark):
    df = spark.createDataFrame([(1, "DevOps", "Ann at ann@x.example.org, P.O. Box 7")], "resume_id long, Category string, Text string")
    row = dataset.prepare_dataset(df, lambda t: gazetteer_spans(t, [("PERSON", "Ann")])).first()
    assert (row.Mapped_Category, row.Text) == ("Technology", "[PERSON] at [EMAIL], [ADDRESS]")


def test_stream_answers_each_request_once(spark, tmp_path):
    inbox = tmp_path / "in"
    inbox.mkdir()

    def land(name, *rows):
        (inbox / name).write_text("\n".join(json.dumps({"request_id": i, "text": t}) for i, t in rows))

    def run():
        requests.answer(
            requests.landed_requests(spark, str(inbox)),
            lambda batch: analyze.clean_resumes(batch, "request_id", "text"), str(tmp_path / "out"), str(tmp_path / "cp"),
        ).awaitTermination()
        got = spark.read.parquet(str(tmp_path / "out")).collect()
        return sorted((r.request_id, r.cleaned_resume) for r in got)

    land("a.json", (1, "Zip 60614."), (2, " "))
    assert run() == [(1, "Zip [ZIP].")]
    land("b.json", (3, "ok"))
    assert run() == [(1, "Zip [ZIP]."), (3, "ok")]


@pytest.mark.parametrize("folds", [2, 3, 5, 10])
def test_folds_come_from_training_rows(spark, folds):
    rows = spark.createDataFrame([(i, "ab"[i % 3 == 0], "t") for i in range(157)], "id long, class string, text string")
    made = train.parts(rows, "id", "class", "text", folds)
    assert made.where("is_test and fold is not null").count() == 0
    sizes = {}
    for r in made.where("not is_test").groupBy("class", "fold").count().collect():
        sizes.setdefault(r["class"], []).append(r["count"])
    assert all(len(n) == folds and max(n) - min(n) <= 1 for n in sizes.values())


def test_dictionary_round_trip(spark, tmp_path):
    rows = [("phrase", "ms excel"), ("preferred", "excel"), ("py", "python")]
    files.sink_skill_map(spark.createDataFrame(rows, "phrase string, preferred string"), str(tmp_path / "d"))
    assert sorted(map(tuple, files.scan_skill_map(spark, str(tmp_path / "d")).collect())) == rows
    (tmp_path / "m.json").write_text('{"phrase": "a", "preferred": "b"}\n{"py": "python"}\n')
    with pytest.raises(ValueError, match="lack a phrase"):
        files.scan_skill_map(spark, str(tmp_path / "m.json"))


def test_no_row_is_lost(spark):
    rows = spark.createDataFrame([(1, "python"), (None, "x"), (3, " \t"), (4, None)], "id long, t string")
    assert sorted(analyze.statuses(rows, "id", "t").collect(), key=str) == sorted(
        [(1, "answered"), (None, "null id"), (3, "blank"), (4, "null")], key=str)
    assert analyze.rejects(rows, "id", "t").count() == 3
