"""Classifier training: split, embed, tune, report."""

from dataclasses import dataclass, replace

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talentspark.functions import patterns as P
from talentspark.functions.scores import label_rank
from talentspark.operators import learning as L
from talentspark.operators import metrics as M
from talentspark.operators import svm, term_svm
from talentspark.operators.features import hashed_embedding, term_lists
from talentspark.operators.splits import stratified_kfold, stratified_split
from talentspark.session import settle_table


@dataclass(frozen=True)
class Training:
    model: PipelineModel
    scores: DataFrame
    train_predictions: DataFrame
    test_predictions: DataFrame

    def report(self, part: str = "test") -> DataFrame:
        """Per-class and average precision, recall and F1 of the train or test rows."""
        rows = self.train_predictions if part == "train" else self.test_predictions
        return M.classification_report(rows, "class", "category")

    def topk(self, ks: tuple[int, ...] = (1, 2, 3, 4, 5)) -> DataFrame:
        rank = label_rank(L.decision_scores(self.test_predictions), F.col("label").cast("int"))
        return M.topk_accuracy(self.test_predictions, rank, list(ks))


def fit_text_model(
    rows: DataFrame, class_col: str, text_col: str, max_iter: int = L.MAX_ITER, steps: list | None = None, **settings
) -> PipelineModel:
    """A classifier of texts with fixed ``settings`` (``C``, ``classWeight``, ``penalty``). Every iteration reads
    the vectors, so they are computed once and kept. ``steps`` (see ``operators.stages``) prepare the texts and
    are saved with the model."""
    steps = steps or []
    words = hashed_embedding(steps[-1].getOutputCol() if steps else text_col)
    features = Pipeline(stages=[*steps, *words.getStages()]).fit(rows)
    labels = L.index_labels(rows, class_col)
    vectors = settle_table(labels.transform(features.transform(rows)).select("label", "features"), "vectors")
    return L.text_model(features, [svm.BlockSvm(maxIter=max_iter, **settings).fit(vectors)], labels.labels)


def parts(dataset, id_col, class_col, text_col, folds, synthetic=None) -> DataFrame:
    """(id, class, text, is_test, fold); rows without a class are left out, synthetic rows train only.

    Folds are drawn from the training rows alone, in an order of their own; test rows have none.
    """
    rows = dataset.where(F.col(class_col).isNotNull()).select(
        id_col, F.col(class_col).alias("class"), F.col(text_col).alias("text")
    )
    split = stratified_split(rows, "class", id_col)
    training = stratified_kfold(split.where("not is_test"), "class", id_col, folds, seed=P.SEED + 1)
    rows = training.unionByName(split.where("is_test").withColumn("fold", F.lit(None).cast("int")))
    if synthetic is None:
        return rows
    return rows.unionByName(synthetic.select(
        F.lit(None).cast(rows.schema[id_col].dataType).alias(id_col), "class", "text",
        F.lit(False).alias("is_test"), F.pmod(F.xxhash64("text"), F.lit(folds)).cast("int").alias("fold"),
    ))


def _trained(vectors, features, labels, fitted, scores) -> Training:
    model = L.text_model(features, fitted, labels.labels)

    def predict(part: DataFrame) -> DataFrame:
        for stage in model.stages[len(features.stages):]:
            part = stage.transform(part)
        return part

    return Training(model, scores, predict(vectors.where("not is_test")), predict(vectors.where("is_test")))


def train_classifier(
    dataset: DataFrame, id_col: str, class_col: str, text_col: str, costs=L.COSTS,
    class_weights=L.CLASS_WEIGHTS, penalties=L.PENALTIES, folds: int = P.FOLDS, max_iter: int = L.MAX_ITER,
    synthetic: DataFrame | None = None, embed=None,
) -> Training:
    """Train on 70 % of each class with the best settings of the grid, on embeddings.

    Vectors are computed once and kept as a table; all points of the grid and all folds are fitted in
    shared passes over them, then the best point once more on all training rows.
    ``synthetic`` (text, class) is added to the training rows only. ``embed`` (text column ->
    array<float>, see ``embed_with``) takes the place of the hashed words; the model then starts
    from a column ``features``.
    """
    rows = parts(dataset, id_col, class_col, text_col, folds, synthetic)
    labels = L.index_labels(rows, "class")
    if embed is None:
        features = hashed_embedding("text").fit(rows)
    else:
        features = PipelineModel(stages=[])
        rows = rows.withColumn("features", array_to_vector(embed(F.col("text"))))
    vectors = settle_table(
        labels.transform(features.transform(rows)).select("class", "label", "is_test", "fold", "features"), "vectors"
    )
    points = L.svm_points(costs, class_weights, penalties)
    train = vectors.where("not is_test")
    scores = svm.grid_scores(train, points, "features", "label", "fold", max_iter)
    # on equal means the first point, as a grid search reports it
    best = max(range(len(points)), key=lambda i: (sum(scores[i]), -i))
    fitted = svm.BlockSvm(maxIter=max_iter, **points[best]).fit(train)
    return _trained(vectors, features, labels, [fitted], L.point_scores(points, scores))


def train_on_terms(
    dataset: DataFrame, id_col: str, class_col: str, text_col: str, folds: int = P.FOLDS,
    max_iter: int = L.MAX_ITER, synthetic: DataFrame | None = None, max_ns=L.TERM_NGRAMS, min_dfs=L.TERM_MIN_DFS,
    sizes=L.TERM_FEATURES, costs=L.TERM_COSTS,
) -> Training:
    """The same on TF-IDF weights. The vocabulary belongs to the fit, so each fold has its own; all folds and
    points are fitted in shared passes (``operators.term_svm``)."""
    rows = parts(dataset, id_col, class_col, text_col, folds, synthetic)
    features, labels = term_lists("text").fit(rows), L.index_labels(rows, "class")
    # the grams would take many times the room of the texts; who asks for predictions gets them row by row
    texts = settle_table(labels.transform(rows).select("class", "label", "is_test", "fold", "text"), "texts")
    terms = features.transform(texts).select("class", "label", "is_test", "fold", "grams1", "grams2", "grams3")
    train = texts.where("not is_test").withColumn("lower", F.lower("text"))
    points = L.term_points(max_ns, min_dfs, sizes, costs)
    spaces = term_svm.spaces(train, "lower", "fold", max_ns, min_dfs, sizes, costs)
    blocks, counts = term_svm.packed(train, "lower", "label", "fold", spaces), svm.counted(train, "label", "fold")
    by_point = term_svm.grid_scores(blocks, spaces, counts, max_iter)
    scores = [by_point[tuple(p[k] for k in ("max_n", "min_df", "size", "C"))] for p in points]
    # on equal means the first point, as a grid search reports it
    best = points[max(range(len(points)), key=lambda i: (sum(scores[i]), -i))]
    space = next(s for s in spaces if (s.held, s.max_n, s.min_df, s.size) == (term_svm.NO_FOLD, best["max_n"], best["min_df"], best["size"]))
    space = replace(space, costs=[best["C"]])
    weights = term_svm.solve(blocks, [space], counts, max_iter)[0]
    return _trained(terms, features, labels, term_svm.stages(space, weights), L.point_scores(points, scores))
