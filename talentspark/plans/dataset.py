"""Resume data preparation."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talentspark.functions import patterns as P
from talentspark.functions.redact import redact_dataset, redact_spans


def map_categories(df: DataFrame, pairs: list[tuple[str, str]] = P.CATEGORY_PAIRS) -> DataFrame:
    """Add ``Mapped_Category`` by exact, case-sensitive lookup; unknown labels give null."""
    table = df.sparkSession.createDataFrame(pairs, "Category string, Mapped_Category string")
    return df.join(F.broadcast(table), "Category", "left")


def prepare_dataset(resumes: DataFrame, entity_spans=None, labels=None, known=None) -> DataFrame:
    """Map the categories and redact ``Text``; without ``entity_spans`` by pattern only.

    ``labels`` are the entities to redact, ``known`` those that the finder can give; others are refused.
    """
    text = redact_dataset(F.col("Text"))
    mapped = map_categories(resumes).withColumn("Text", text)
    if entity_spans is None:
        return mapped
    return mapped.withColumn("Text", redact_spans(F.col("Text"), entity_spans(F.col("Text")), labels, known))


def augment(train: DataFrame, synthetic: DataFrame) -> DataFrame:
    """Append synthetic rows (Resume_str, Category) to the training rows (Text, Mapped_Category)."""
    extra = synthetic.select(F.col("Resume_str").alias("Text"), F.col("Category").alias("Mapped_Category"))
    return train.select("Text", "Mapped_Category").unionByName(extra)
