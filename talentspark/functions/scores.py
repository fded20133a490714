"""Column functions on arrays of class scores."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def top_k_classes(scores: Column, classes: list[str], k: int = 2) -> Column:
    """The k classes with the highest scores, best first; ties go to the lower class index."""
    if not 1 <= k <= len(classes):
        raise ValueError(f"k = {k}: there are {len(classes)} classes to choose from")
    keyed = F.transform(scores, lambda s, i: F.struct((-s).alias("key"), i.alias("idx")))
    best = F.slice(F.array_sort(keyed), 1, k)
    names = F.array(*[F.lit(c) for c in classes])
    return F.transform(best, lambda b: F.get(names, b["idx"]))


def label_rank(scores: Column, label_index: Column) -> Column:
    """1-based rank of the true class among the scores (ties go to the lower index)."""
    own = F.get(scores, label_index)
    ahead = F.transform(
        scores, lambda s, i: ((s > own) | ((s == own) & (i < label_index))).cast("int")
    )
    return F.aggregate(ahead, F.lit(1), lambda acc, x: acc + x)


def argmax(scores: Column) -> Column:
    """Index of the highest score, the lower index on ties."""
    return (F.array_position(scores, F.array_max(scores)) - 1).cast("int")
