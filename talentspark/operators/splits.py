"""Stratified splits that move no data: each row is compared with the cut keys of its class."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from talentspark.functions import patterns as P
from talentspark.operators.joins import lookup_join
from talentspark.session import settle


def hash_key(id_col: str, seed: int) -> Column:
    """The order within a class: md5 of seed and id, the id itself on ties."""
    return F.struct(F.md5(F.concat(F.lit(f"{seed}:"), F.col(id_col).cast("string"))).alias("h"), F.col(id_col).alias("id"))


def _cut_keys(df: DataFrame, class_col: str, id_col: str, seed: int, cut_ranks) -> DataFrame:
    """(class, cuts, zeros): per class the keys at the ranks ``cut_ranks(total)``, exact.

    Counting keys by their first four hex digits finds the one bucket that holds a rank; only
    the rows of those buckets (about one in 65536 of a class each) are sorted.
    """
    keyed = df.select(F.col(class_col).alias("c"), hash_key(id_col, seed).alias("key")).withColumn(
        "b", F.substring("key.h", 1, 4)
    )
    # at most 65536 rows per class from here on
    per_class = Window.partitionBy("c")
    counts = (
        keyed.groupBy("c", "b").agg(F.count(F.lit(1)).alias("n"))
        .withColumn("before", F.sum("n").over(per_class.orderBy("b")) - F.col("n"))
        .withColumn("total", F.sum("n").over(per_class))
    )
    ranks = cut_ranks(F.col("total"))
    zeros = F.size(F.filter(ranks, lambda r: r == 0))
    inside = F.filter(ranks, lambda r: (r > F.col("before")) & (r <= F.col("before") + F.col("n")))
    wanted = counts.select(
        "c", "b", zeros.alias("zeros"), F.transform(inside, lambda r: r - F.col("before")).alias("local")
    ).where(F.size("local") > 0)
    in_bucket = F.row_number().over(Window.partitionBy("c", "b").orderBy("key"))
    return (
        lookup_join(keyed, settle(wanted), ["c", "b"], spread_by=["key"]).withColumn("_rank", in_bucket)
        # a small class may have several cuts at one rank
        .select("c", "key", "zeros", F.explode(F.filter("local", lambda r: r == F.col("_rank"))))
        .groupBy(F.col("c").alias(class_col))
        .agg(F.sort_array(F.collect_list("key")).alias("_cuts"), F.max("zeros").alias("_zeros"))
    )


def _part_number(df: DataFrame, class_col: str, id_col: str, seed: int, cut_ranks) -> DataFrame:
    """Add ``_part``: how many cuts of its class lie below a row. The cuts are one row per class."""
    cuts = _cut_keys(df, class_col, id_col, seed, cut_ranks)
    key = hash_key(id_col, seed)
    below = F.size(F.filter("_cuts", lambda cut: cut < key)) + F.col("_zeros")
    return lookup_join(df, settle(cuts), [class_col], spread_by=[id_col]).withColumn("_part", below).drop("_cuts", "_zeros")


def stratified_split(
    df: DataFrame, class_col: str, id_col: str, test_percent: int = round(100 * P.TEST_SHARE), seed: int = P.SEED
) -> DataFrame:
    """Add ``is_test``: exactly ceil(share * n) rows of each class. Rows without a class drop out."""
    def cut(total: Column) -> Column:
        return F.array(F.ceil(total * test_percent / 100).cast("long"))

    return _part_number(df, class_col, id_col, seed, cut).withColumn("is_test", F.col("_part") == 0).drop("_part")


def stratified_kfold(
    df: DataFrame, class_col: str, id_col: str, folds: int = P.FOLDS, seed: int = P.SEED
) -> DataFrame:
    """Add ``fold`` (0..folds-1): per class, fold sizes differ by at most one."""
    def cuts(total: Column) -> Column:
        return F.array(*[F.floor(total * k / folds).cast("long") for k in range(1, folds)])

    return _part_number(df, class_col, id_col, seed, cuts).withColumnRenamed("_part", "fold")
