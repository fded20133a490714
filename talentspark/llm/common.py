"""What several operators share: word hashes, packed arrays, tree sums and connected components."""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from talentspark.session import settle, settle_table

MIX_1, MIX_2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
CACHE_WORDS = 200_000
FAN_IN = 32


class WordHash(dict):
    """64-bit hash of a word (bytes), remembered per task."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE_WORDS:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def released(run: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]) -> Callable:
    """``run`` for ``mapInPandas``; at its end free memory goes back to the system. A worker process lives on after its
    task, and the C library and Arrow would keep what the task had at its peak."""
    def whole(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        yield from run(batches)
        trim()

    return whole


def trim() -> None:
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only some C libraries have it
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * MIX_1
    x = (x ^ (x >> np.uint64(27))) * MIX_2
    return x ^ (x >> np.uint64(31))


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The integers start .. start + length - 1 of each pair, one after the other."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return np.arange(total) + np.repeat(starts - (ends - lengths), lengths)


def with_id(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text) with the text's nulls as empty strings; other columns are left behind."""
    return docs.select(
        F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text")
    )


def tree_sum(parts: DataFrame) -> np.ndarray | None:
    """Sum equally long double vectors (``key int``, ``v binary``); each step adds up ``FAN_IN``
    of them in a task, so neither a task nor the driver sees more than that many."""
    schema = "key int, v binary"

    def add(frame: pd.DataFrame) -> pd.DataFrame:
        total = np.sum([np.frombuffer(v) for v in frame["v"]], axis=0)
        return pd.DataFrame({"key": [int(frame["key"].iloc[0]) // FAN_IN], "v": [total.tobytes()]})

    parts = settle(parts)
    top = parts.agg(F.max("key")).first()[0]
    if top is None:
        return None
    while top >= FAN_IN:
        grouped = parts.withColumn("group", F.floor(F.col("key") / FAN_IN)).groupBy("group")
        parts, top = settle(grouped.applyInPandas(add, schema)), top // FAN_IN
    return np.sum([np.frombuffer(r["v"]) for r in parts.collect()], axis=0)


def counted_join(
    big: DataFrame, keyed: DataFrame, on: list[str], n: str, parts: int = 100_000, total: int | None = None
) -> DataFrame:
    """Inner join with ``keyed``, a settled table of one row per key, whose column ``n`` is the key's number of rows in ``big``.

    Keys of more than one in ``parts`` of all rows are fewer than ``parts``, which bounds what is broadcast for
    them whatever the input; the others are joined by a shuffle, in which no key is hot.
    """
    if total is None:
        total = keyed.agg(F.sum(n)).first()[0] or 0
    hot = F.col(n) * parts > total
    common = big.join(F.broadcast(keyed.where(hot)), on)
    rest = big.join(F.broadcast(keyed.where(hot).select(*on)), on, "left_anti").join(keyed.where(~hot), on)
    return common.unionByName(rest)


def numbered(rows: DataFrame, group: str, order: list[str], name: str) -> DataFrame:
    """The rows with ``pos``, their place (from 0) in their group by ``order`` (nulls first; equal rows in any order).

    Rows are dealt to tasks by ranges of (group, order), so a group of any size is numbered by many tasks: each
    counts its own rows, and a group that reaches over several tasks, of which there are at most one per
    boundary, starts at the sum of the counts before.
    """
    order = [*order, "_row"]
    dealt = rows.withColumn("_row", F.monotonically_increasing_id()).repartitionByRange(group, *order)
    dealt = settle_table(dealt.withColumn("_part", F.spark_partition_id()), name)
    parts = dealt.groupBy(group, "_part").count().groupBy(group).agg(F.sort_array(F.collect_list(F.struct("_part", "count"))).alias("c"))
    before = F.transform("c", lambda x: F.struct(
        x["_part"].alias("_part"),
        F.aggregate(F.filter("c", lambda y: y["_part"] < x["_part"]), F.lit(0).cast("long"), lambda t, y: t + y["count"]).alias("_before"),
    ))
    offsets = parts.where(F.size("c") > 1).select(group, F.inline(before))
    within = F.row_number().over(Window.partitionBy("_part", group).orderBy(*order))
    joined = dealt.withColumn("pos", within - F.lit(1).cast("long")).join(F.broadcast(offsets), [group, "_part"], "left")
    return joined.withColumn("pos", F.col("pos") + F.coalesce("_before", F.lit(0))).drop("_part", "_row", "_before")


def components(edges: DataFrame) -> DataFrame:
    """(id, component_id): connected components of ``edges`` (a, b), named by their smallest id.

    Alternating large and small stars; every round is checkpointed. Only ids on an edge are returned.
    """
    def star(pairs: DataFrame, large: bool) -> DataFrame:
        pairs = pairs.select("u", "v")
        if large:
            pairs = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # the hub of a large component has most of the rows
        least = settle(pairs.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count(F.lit(1)).alias("n")))
        joined = counted_join(pairs, least, ["u"], "n")
        if large:
            linked = joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        else:
            # a row (u, m) appears by way of v = m
            linked = joined.select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        return linked.where("u > v").distinct()

    mark = F.struct(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")).alias("s")).alias("mark")
    pairs = settle(
        edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    )
    before, now = None, pairs.agg(mark).first()["mark"]
    while now["n"] and before != now:
        pairs = settle(star(settle(star(pairs, True)), False))
        before, now = now, pairs.agg(mark).first()["mark"]
    members = pairs.select(F.col("u").alias("id"), F.col("v").alias("component_id"))
    roots = pairs.select(F.col("v").alias("id"), F.col("v").alias("component_id")).distinct()
    return members.unionByName(roots)
