"""Label counts, class weights and classification metrics."""

from pyspark.ml.evaluation import Evaluator
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def label_distribution(df: DataFrame, class_col: str, part_col: str) -> DataFrame:
    """(part, label, n): rows per class and in total, for each part and for all parts.

    A missing ``part`` or ``label`` stands for all of them.
    """
    counts = df.groupBy(part_col, class_col).agg(F.count(F.lit(1)).alias("n"))
    return (
        counts.cube(part_col, class_col).agg(F.sum("n").alias("n"))
        .select(F.col(part_col).alias("part"), F.col(class_col).alias("label"), "n")
    )


def class_weights(df: DataFrame, class_col: str) -> DataFrame:
    """(label, n, weight): balanced weight total / (classes * n). One row per class is windowed."""
    counts = df.where(F.col(class_col).isNotNull()).groupBy(F.col(class_col).alias("label")).agg(
        F.count(F.lit(1)).alias("n")
    )
    all_classes = Window.partitionBy()
    weight = F.sum("n").over(all_classes) / (F.count(F.lit(1)).over(all_classes) * F.col("n"))
    return counts.withColumn("weight", weight)


def confusion_counts(df: DataFrame, label: str, prediction: str) -> DataFrame:
    return df.groupBy(F.col(label).alias("label"), F.col(prediction).alias("prediction")).agg(
        F.count(F.lit(1)).alias("n")
    )


def confusion_matrix(df: DataFrame, label: str, prediction: str, classes: list) -> DataFrame:
    """One row per true class, one column ``p_<class>`` per predicted class."""
    return df.groupBy(F.col(label).alias("label")).agg(
        *[F.count(F.when(F.col(prediction) == c, 1)).alias(f"p_{c}") for c in classes]
    )


def _share(part: Column, whole: Column) -> Column:
    return F.coalesce(F.try_divide(part, whole), F.lit(0.0))


def _per_class(df: DataFrame, label: str, prediction: str) -> DataFrame:
    """(label, precision, recall, f1, support, hits) from one count of (label, prediction)."""
    cells = confusion_counts(df, label, prediction)
    hit = F.when(F.col("label") == F.col("prediction"), F.col("n")).otherwise(0)
    sides = cells.select(F.inline(F.array(
        F.struct(F.col("label").alias("label"), F.col("n").alias("support"), F.lit(0).cast("long").alias("chosen"),
                 hit.cast("long").alias("hits")),
        F.struct(F.col("prediction").alias("label"), F.lit(0).cast("long").alias("support"),
                 F.col("n").alias("chosen"), F.lit(0).cast("long").alias("hits")),
    )))
    sums = sides.groupBy("label").agg(*[F.sum(c).alias(c) for c in ("support", "chosen", "hits")])
    shares = sums.select(
        "*", _share(F.col("hits"), F.col("chosen")).alias("precision"),
        _share(F.col("hits"), F.col("support")).alias("recall"),
    )
    total = F.col("support") + F.col("chosen")
    return shares.withColumn("f1", _share(F.col("hits") * 2, total))


def classification_report(df: DataFrame, label: str, prediction: str) -> DataFrame:
    """(label, precision, recall, f1, support): a row per class, then accuracy (as f1) and the
    macro and weighted averages."""
    per_class = _per_class(df, label, prediction)
    names = ("precision", "recall", "f1")
    support = F.sum("support")
    rolled = per_class.rollup("label").agg(
        F.grouping("label").alias("all"), support.alias("support"),
        *[F.avg(c).alias(f"m_{c}") for c in names],
        *[_share(F.sum(F.col(c) * F.col("support")), support).alias(f"w_{c}") for c in names],
        _share(F.sum("hits"), support).alias("accuracy"),
    )

    def row(name: Column, p, r, f) -> Column:
        return F.struct(
            name.cast("string").alias("label"), p.alias("precision"), r.alias("recall"), f.alias("f1"),
            F.col("support").alias("support"),
        )

    none = F.lit(None).cast("double")
    summary = F.array(
        row(F.lit("accuracy"), none, none, F.col("accuracy")),
        row(F.lit("macro avg"), *[F.col(f"m_{c}") for c in names]),
        row(F.lit("weighted avg"), *[F.col(f"w_{c}") for c in names]),
    )
    one = F.array(row(F.col("label"), *[F.col(f"m_{c}") for c in names]))
    return rolled.select(F.inline(F.when(F.col("all") == 1, summary).otherwise(one)))


def topk_accuracy(df: DataFrame, rank: Column, ks: list[int]) -> DataFrame:
    """(k, accuracy): share of rows whose true class ranks among the k best, one pass for all k."""
    shares = df.agg(*[F.avg((rank <= k).cast("double")).alias(f"k{k}") for k in ks])
    return shares.select(F.inline(F.array(
        *[F.struct(F.lit(k).alias("k"), F.col(f"k{k}").alias("accuracy")) for k in ks]
    )))


class MacroF1(Evaluator):
    """Unweighted mean of the per-class F1 scores."""

    def __init__(self, label: str = "label", prediction: str = "prediction"):
        super().__init__()
        self.label, self.prediction = label, prediction

    def _evaluate(self, dataset: DataFrame) -> float:
        return _per_class(dataset, self.label, self.prediction).agg(F.avg("f1")).first()[0]

    def isLargerBetter(self) -> bool:
        return True
