"""Lookup joins that broadcast a checked small side and salt anything larger."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talentspark.session import settle

BROADCAST_ROWS = 1_000_000
BROADCAST_BYTES = 64 << 20
SALTS = 32


def fits_broadcast(df: DataFrame, max_rows: int = BROADCAST_ROWS, max_bytes: int = BROADCAST_BYTES) -> bool:
    """Measure rows and bytes of ``df`` (one aggregate job) against the broadcast bounds."""
    row_bytes = F.octet_length(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns])))
    rows, size = df.agg(F.count(F.lit(1)), F.coalesce(F.sum(row_bytes), F.lit(0))).first()
    return rows <= max_rows and size <= max_bytes


def salted_join(
    big: DataFrame, small: DataFrame, on: list[str], how: str, spread_by: list[str], salts: int = SALTS
) -> DataFrame:
    """Equi-join in which each key of ``big`` is cut into ``salts`` parts.

    ``small`` is copied once per salt, so a key that holds a third of ``big`` is worked on by
    many tasks. Valid for inner, left, left_semi and left_anti. The salt hashes row columns,
    so a re-run task gives the same rows.
    """
    salt = F.pmod(F.xxhash64(*spread_by), F.lit(salts)).cast("int")
    copies = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return big.withColumn("_salt", salt).join(copies, [*on, "_salt"], how).drop("_salt")


def lookup_join(
    big: DataFrame,
    small: DataFrame,
    on: list[str],
    how: str = "inner",
    spread_by: list[str] | None = None,
    max_rows: int = BROADCAST_ROWS,
) -> DataFrame:
    """Join ``big`` with a table expected to be small, whatever its real size."""
    if fits_broadcast(small, max_rows):
        return big.join(F.broadcast(small), on, how)
    return salted_join(big, small, on, how, spread_by or big.columns)


def skew_join(
    big: DataFrame, other: DataFrame, on: list[str], how: str, spread_by: list[str], hot_rows: int = 5_000_000
) -> DataFrame:
    """Equi-join of two large tables where a few keys of ``big`` may hold most of its rows.

    Keys with more than ``hot_rows`` rows (at most rows / hot_rows of them, so their list is
    small by construction) are joined salted, all others by a plain shuffle join.
    """
    hot = settle(big.groupBy(*on).count().where(F.col("count") > hot_rows).select(*on))
    if hot.isEmpty():
        return big.join(other, on, how)
    hot = F.broadcast(hot)
    cold_rows = big.join(hot, on, "left_anti").join(other, on, how)
    hot_part = salted_join(
        big.join(hot, on, "left_semi"), other.join(hot, on, "left_semi"), on, how, spread_by
    )
    return cold_rows.unionByName(hot_part)
