"""Best-fit packing of token sequences, in a hierarchy.

Texts are tokenised and cut into pieces of at most ``size`` tokens. Each task packs its pieces by
best fit in descending order of length and emits the bins that are nearly full. What is left in an
underfull bin goes on as one item to the next round, where ``FAN_IN`` tasks meet in one, until a single
group is left. Bins above half full cannot join each other, and best fit leaves at most one other bin in a
group; so at most ``FAN_IN`` bins of a length can find a partner in a round, and a group carries on ``KEPT`` of
each length: as many as all rounds to come can use. What more there is of a length stays a sequence of its own,
as it would if it were carried on. A node thus holds a bounded number of bins whatever the input.

Edge cases: a null text is empty and gives one piece that holds the end token only; texts longer than
``size`` give pieces of exactly ``size`` tokens after a first one that may be shorter; rows without an
id and repeated rows give pieces like any other; pieces of equal length are packed in the order in which their
task read them; further columns are left behind.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talentspark.llm.common import released
from talentspark.llm.tokens import KEPT_PIECES, Encoder
from talentspark.session import settle_table

SIZE = 1024
END = 2
SLACK = 4
FAN_IN = 16
KEPT = FAN_IN * 8  # eight rounds join 16 ** 8 tasks
ROWS = 512
PIECES = "doc_id long, piece int, start long, length int, ids_crc32 long, ids array<int>"


def cuts(count: int, size: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of ``count`` tokens; only the first may be shorter than ``size``."""
    if count <= size:
        return [(0, count)]
    first = count % size
    return ([(0, first)] if first else []) + [(a, size) for a in range(first, count, size)]


def pieces(
    docs: DataFrame, path: str, leading: bool = True, size: int = SIZE, end: int = END, with_ids: bool = True,
    kept: int = KEPT_PIECES,
) -> DataFrame:
    """The pieces of each text: doc_id, piece, start, length, ids_crc32 and, where asked for, ids. A task remembers the
    ids of ``kept`` pieces of text."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tokens = Encoder(path, leading, kept)
        for batch in batches:
            for at in range(0, len(batch), ROWS):
                part = batch.iloc[at:at + ROWS]
                rows = []
                for i, ids in zip(part["doc_id"], tokens.encode(part["text"].fillna("").tolist()), strict=True):
                    ids = np.r_[ids, end].astype("<u4")
                    for k, (a, n) in enumerate(cuts(len(ids), size)):
                        own = ids[a:a + n]
                        rows.append((i, k, a, n, zlib.crc32(own.tobytes()), own.tolist() if with_ids else None))
                out = pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32", "ids"])
                yield out.astype({"doc_id": "Int64"})

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInPandas(released(run), PIECES)


def best_fit(lengths: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bin of each item, offset in it, tokens in each bin): longest first, each into the fullest bin it fits."""
    where, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    used: list[int] = []
    room: list[list[int]] = [[] for _ in range(size + 1)]
    open_ = 0  # bit r is set while some bin has room r
    for item in np.argsort(-lengths, kind="stable").tolist():
        need = int(lengths[item])
        fits = open_ >> need
        if fits:
            free = need + (fits & -fits).bit_length() - 1
            bin_ = room[free].pop()
            if not room[free]:
                open_ &= ~(1 << free)
        else:
            free, bin_ = size, len(used)
            used.append(0)
        where[item], offset[item] = bin_, used[bin_]
        used[bin_] += need
        if free > need:
            room[free - need].append(bin_)
            open_ |= 1 << (free - need)
    return where, offset, np.array(used, np.int64)


def _packed(items: np.ndarray, lengths: np.ndarray, size: int, prefix: int, group: int, last: bool) -> pd.DataFrame:
    """Placed items and, with no bin of their own, the bins to be carried on."""
    where, offset, used = best_fit(lengths, size)
    names = prefix + np.arange(len(used))
    placed = pd.DataFrame({"item": items, "bin": names[where], "offset": offset, "length": lengths, "group": -1})
    under = np.zeros(0, np.int64) if last else np.flatnonzero(used < size - SLACK)
    under = under[np.argsort(used[under], kind="stable")]
    first = np.searchsorted(used[under], used[under])  # of the bins with the same length
    under = under[np.arange(len(under)) - first < KEPT]
    carried = pd.DataFrame({"item": names[under], "bin": -1, "offset": 0, "length": used[under], "group": group})
    return pd.concat([placed, carried])


def _round(size: int, level: int, last: bool) -> Callable[[pd.DataFrame], pd.DataFrame]:
    def again(frame: pd.DataFrame) -> pd.DataFrame:
        group = int(frame["group"].iloc[0]) // FAN_IN
        return _packed(frame["item"].to_numpy(), frame["length"].to_numpy(np.int64), size, (level << 56) + (group << 32), group, last)

    return again


def pack(items: DataFrame, size: int = SIZE) -> DataFrame:
    """(item, sequence_id, offset) for ``items`` (item long, unique; length int, at most ``size``)."""
    schema = "item long, bin long, offset long, length long, group long"

    def first(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        frames = [b for b in batches if len(b)]
        if frames:
            frame, part = pd.concat(frames), TaskContext.get().partitionId()
            yield _packed(frame["item"].to_numpy(), frame["length"].to_numpy(np.int64), size, part << 32, part, False)

    table = settle_table(items.select("item", "length").mapInPandas(first, schema), "packing")
    top = table.agg(F.max("group")).first()[0]
    placed, level = table.where("bin >= 0").select("item", F.col("bin").alias("sequence_id"), "offset"), 1
    while top is not None and top >= 0:
        last = top < FAN_IN

        carried = table.where("bin < 0").withColumn("meet", F.floor(F.col("group") / FAN_IN))
        table = settle_table(carried.groupBy("meet").applyInPandas(_round(size, level, last), schema), "packing")
        moved = table.where("bin >= 0").select(F.col("item").alias("sequence_id"), F.col("bin").alias("into"), F.col("offset").alias("by"))
        placed = placed.join(moved, "sequence_id", "left").select(
            "item", F.coalesce("into", "sequence_id").alias("sequence_id"), (F.col("offset") + F.coalesce("by", F.lit(0))).alias("offset")
        )
        top, level = None if last else table.where("bin < 0").agg(F.max("group")).first()[0], level + 1
    return placed


def packed_pieces(docs: DataFrame, path: str, size: int = SIZE, end: int = END, kept: int = KEPT_PIECES) -> DataFrame:
    """Per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    cut = pieces(docs, path, True, size, end, with_ids=False, kept=kept).drop("ids")
    cut = settle_table(cut.withColumn("item", F.monotonically_increasing_id()), "pieces")
    full = cut.where(F.col("length") == size).withColumn("sequence_id", -1 - F.col("item")).withColumn("offset", F.lit(0).cast("long"))
    rest = cut.where(F.col("length") < size)
    packed = full.unionByName(rest.join(pack(rest, size), "item"))
    return packed.select("doc_id", "piece", "start", F.col("length").cast("long").alias("length"), "ids_crc32", "sequence_id", "offset")


def sequences(docs: DataFrame, path: str, size: int = SIZE, end: int = END) -> DataFrame:
    """The packed training sequences: sequence_id, ids (at most ``size``) and the doc_id of each token run."""
    cut = settle_table(
        pieces(docs, path, True, size, end).withColumn("item", F.monotonically_increasing_id()), "pieces"
    )
    full = cut.where(F.col("length") == size).select("item", (-1 - F.col("item")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    placed = full.unionByName(pack(cut.where(F.col("length") < size), size))
    runs = F.sort_array(F.collect_list(F.struct("offset", "doc_id", "ids")))
    return cut.join(placed, "item").groupBy("sequence_id").agg(runs.alias("runs")).select(
        "sequence_id", F.flatten("runs.ids").alias("ids"), F.transform("runs", lambda r: F.struct(r.offset.alias("offset"), r.doc_id.alias("doc_id"))).alias("documents")
    )
