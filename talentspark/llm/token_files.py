"""Token ids as compressed binary blocks, written in ascending order of the documents.

A shard is a run of documents by id; its token stream is cut into blocks of ``BLOCK`` ids, each coded by
itself with all statistics reset. Three models predict an id: order 0 as four hexadecimal digits of adaptive
chances; order 2 and order 1 give an adaptive chance to the id that followed the two ids, or the one id, before
it last, and share out the rest as order 0 does. Their probabilities are mixed with weights, which after each
id move to the models that gave it the higher probability; every confidence of the two has weights of its own.
A range coder codes by the mixed probabilities: first whether the id is that of order 2, that of order 1 or
another, and another one by its digits, from which alone order 0 learns. The blocks of a task are coded in
step, as numpy lanes; the arithmetic is in integers, or in
quotients of doubles with the same whole part, so any machine reads what another wrote.

The format is a Parquet folder, which any store can hold, with two kinds of rows: ``block`` (shard, block,
count, crc32 of the ids as little-endian unsigned 32-bit integers, payload) and ``document`` (shard,
doc_id, start within the shard, count). A block that does not match its checksum is reported, not used.

Edge cases: null and empty texts hold the end id only; equal ids follow each other; a null id sorts
first; an empty table gives an empty folder and no rows; further columns are left behind.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from talentspark.llm.tokens import Encoder
from talentspark.session import scratch_path

END = 2
BLOCK = 4096
LANES = 1536
SHARD_CHARS = 32 << 20
ROWS = 256
HASH_1, HASH_2 = 2048, 4096
RATE = 4
ONE, RAREST = 1 << 15, 8
LEAST_WEIGHT = 400  # of ONE
LEAST, LOW_32, LOW_48, BITS = np.uint64(1 << 32), np.uint64((1 << 32) - 1), np.uint64((1 << 48) - 1), np.uint64(15)
STORED = "shard int, kind string, block int, doc_id long, start long, count long, crc long, payload binary"


class Lanes:
    """Range coders, one per block; ``narrow`` does one decision of some of them."""

    def __init__(self, count: int, payloads: list[bytes] | None = None):
        self.span, self.at = np.full(count, 1 << 48, np.uint64), np.zeros(count, np.int64)
        self.reads = payloads is not None
        if payloads is None:
            self.words = np.zeros((count, BLOCK), "<u2")
            self.low = np.zeros(count, np.uint64)
        else:
            width = max(len(p) // 2 for p in payloads) + 1
            self.words = np.zeros((count, width), "<u2")
            for i, p in enumerate(payloads):
                self.words[i, :len(p) // 2] = np.frombuffer(p, "<u2")
            first = self.words[:, :3].astype(np.uint64)
            self.low, self.at[:] = (first[:, 0] << np.uint64(32)) | (first[:, 1] << np.uint64(16)) | first[:, 2], 3

    def found(self, span: np.ndarray, low: np.ndarray) -> np.ndarray:
        """While reading: where in 1/32768 of its span each lane is. The quotient is below 2 ** 15 and no nearer to the
        next integer than 2 ** -33, so that of doubles has the same whole part."""
        return np.minimum(low.astype(np.float64) / (span >> BITS).astype(np.float64), ONE - 1).astype(np.int16)

    def narrow(
        self, lanes: np.ndarray, span: np.ndarray, low: np.ndarray, begin: np.ndarray, chance: np.ndarray
    ) -> tuple[np.ndarray, np.ndarray]:
        """The ``span`` and ``low`` of ``lanes`` after a symbol of this ``chance``, those before it having ``begin``, in
        1/32768. While reading, ``low`` is what has been read above the low end of the span.
        """
        part = span >> BITS
        step, span = part * begin.astype(np.uint64), part * chance.astype(np.uint64)
        if self.reads:
            low = low - step
        else:
            low = low + step
            over = np.flatnonzero(low > LOW_48)
            if len(over):
                self._carry(lanes[over])
                low[over] &= LOW_48
        small = np.flatnonzero(span < LEAST)
        if len(small):
            own, moved = lanes[small], low[small]
            place = self.at[own]
            if self.reads:
                low[small] = (moved << np.uint64(16)) | self.words[own, place]
            else:
                if place.max() + 4 >= self.words.shape[1]:
                    self.words = np.hstack([self.words, np.zeros_like(self.words)])
                self.words[own, place] = (moved >> np.uint64(32)).astype(np.uint16)
                low[small] = (moved & LOW_32) << np.uint64(16)
            self.at[own] = place + 1
            span[small] <<= np.uint64(16)
        return span, low

    def _carry(self, lanes: np.ndarray) -> None:
        place = self.at[lanes] - 1
        while len(lanes):
            self.words[lanes, place] += np.uint16(1)
            full = self.words[lanes, place] == 0
            lanes, place = lanes[full], place[full] - 1

    def payloads(self) -> list[bytes]:
        self.words = np.hstack([self.words, np.zeros((len(self.words), 4), "<u2")])
        every = np.arange(len(self.at))
        for shift in (32, 16, 0):
            self.words[every, self.at] = ((self.low >> np.uint64(shift)) & np.uint64(0xFFFF)).astype(np.uint16)
            self.at += 1
        return [self.words[i, :n].tobytes() for i, n in enumerate(self.at)]


class Chances:
    """Adaptive chances of 16 symbols in each context, one table per lane: a row has, for each symbol, the chance of a
    smaller one in 1/32768. It begins with 0, which stands for 32768 where a symbol ends the row before."""

    def __init__(self, lanes: int, contexts: int):
        self.contexts = contexts
        self.table = np.empty((lanes * contexts, 16), np.int16)
        self.table[:] = np.arange(16) * (ONE // 16)
        self.flat = self.table.reshape(-1)
        symbol, k = np.arange(16)[:, None], np.arange(16)[None, :]
        # where a symbol's arrival moves the row to; no chance falls to nothing
        self.towards = np.where(k <= symbol, k * RAREST, ONE - (16 - k) * RAREST).astype(np.int16)

    def code(
        self, coder: Lanes, lanes: np.ndarray, span: np.ndarray, low: np.ndarray, before: np.ndarray, symbols: np.ndarray | None
    ) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Write ``symbols`` or read them: symbols, chances, span and low. ``before`` are the digits before them."""
        row = lanes * self.contexts + (before & (self.contexts - 1))
        rows = self.table.take(row, 0)
        if symbols is None:
            # each symbol up to the one in question is a byte of 1
            smaller = (rows <= coder.found(span, low)[:, None]).view(np.uint64)
            symbols = np.bitwise_count(smaller).sum(1, dtype=np.int64) - 1
        begin, chance = _chances(rows.reshape(-1), np.arange(0, 16 * len(row), 16) + symbols)
        rows += (self.towards.take(symbols, 0) - rows) >> RATE
        self.table[row] = rows
        return symbols, chance, *coder.narrow(lanes, span, low, begin, chance)

    def of(self, lanes: np.ndarray, before: np.ndarray, symbols: np.ndarray) -> np.ndarray:
        """The chances of ``symbols``."""
        return _chances(self.flat, (lanes * self.contexts + (before & (self.contexts - 1))) * 16 + symbols)[1]


def _chances(flat: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The begins and the chances of the symbols at these places."""
    begin = flat.take(at)
    return begin, ((flat.take(at + 1, mode="wrap") - begin) & np.int16(ONE - 1)).astype(np.int64)


class Digits:
    """Order 0: an id as four hexadecimal digits, each under those before it. Chances of ids are in 1 / 2 ** 30."""

    def __init__(self, lanes: int):
        self.chances = [Chances(lanes, contexts) for contexts in (1, 16, 256, 1024)]

    def of(self, lanes: np.ndarray, ids: np.ndarray) -> np.ndarray:
        out = 1 << 30
        for chances, shift in zip(self.chances, (12, 8, 4, 0), strict=True):
            digits = ids >> shift
            out = out * chances.of(lanes, digits >> 4, digits & 15) >> 15
        return out

    def code(self, coder: Lanes, lanes: np.ndarray, ids: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
        spelled, all_chance = np.zeros(len(lanes), np.int64), 1 << 30
        span, low = coder.span[lanes], coder.low[lanes]
        for chances, shift in zip(self.chances, (12, 8, 4, 0), strict=True):
            digit = None if ids is None else (ids >> shift) & 15
            digit, chance, span, low = chances.code(coder, lanes, span, low, spelled, digit)
            spelled, all_chance = spelled * 16 + digit, all_chance * chance >> 15
        coder.span[lanes], coder.low[lanes] = span, low
        return spelled, all_chance


class Mixture:
    """Weights of order 2 and order 1 (order 0 has the rest of ``ONE``) by the confidences of both, and the chances
    in 1/32768 that their ids are right, each by its own confidence."""

    def __init__(self, lanes: int):
        self.weights = np.full((lanes, 16, 2), ONE // 3, np.int64)
        self.right = np.tile(np.array([ONE // 16, ONE // 4, ONE // 2, ONE * 3 // 4], np.int64), (lanes, 2, 1))

    def update(
        self, lanes: np.ndarray, sure: tuple[np.ndarray, np.ndarray], hits: tuple[np.ndarray, np.ndarray], zero: np.ndarray
    ) -> None:
        """``hits``: whether order 2 and order 1 had the id; ``zero``: its chance by order 0."""
        own = (lanes * 16 + sure[0] * 4 + sure[1]) * 2
        flat, shares, right = self.weights.reshape(-1), [], self.right.reshape(-1)
        weights = [flat.take(own), flat.take(own + 1)]
        for k in (0, 1):
            at = lanes * 8 + (4 * k + sure[k])
            c = right.take(at)
            shares.append(weights[k] * (np.where(hits[k], c << 15, 0) + ((ONE - c) * zero >> 15)))
            c += (np.where(hits[k], ONE, 0) - c) >> RATE
            right[at] = np.minimum(np.maximum(c, RAREST), ONE - 4 * RAREST)
        total = np.maximum(shares[0] + shares[1] + (ONE - weights[0] - weights[1]) * zero, 1)
        whole = np.maximum(total >> 15, 1).astype(np.float64)
        for k in (0, 1):
            # what the id says of the model's weight, followed slowly; no weight falls to nothing. Below 2 ** 47 the
            # quotient of doubles has the same whole part as that of integers
            told = LEAST_WEIGHT + (((ONE - 3 * LEAST_WEIGHT) * (shares[k] >> 15)) / whole).astype(np.int64)
            flat[own + k] = weights[k] + ((told - weights[k]) >> RATE)


class Guesses:
    """The id that followed a context last, and how often in a row it did (up to 3), as 4 * id + times."""

    def __init__(self, lanes: int, contexts: int):
        self.contexts, self.table = contexts, np.zeros(lanes * contexts, np.int32)
        self.then = np.array([0, 0, 1, 2, 1, 2, 3, 3])  # times after a wrong id, after a right one

    def of(self, lanes: np.ndarray, context: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        found = self.table.take(lanes * self.contexts + context).astype(np.int64)
        return found >> 2, found & 3

    def update(self, lanes: np.ndarray, context: np.ndarray, guess: np.ndarray, sure: np.ndarray, ids: np.ndarray) -> None:
        right = guess == ids
        self.table[lanes * self.contexts + context] = np.where(right | (sure > 0), guess, ids) * 4 + self.then.take(sure + 4 * right)


def _code(lengths: np.ndarray, ids: np.ndarray | None, payloads: list[bytes] | None) -> tuple[np.ndarray, Lanes]:
    """Code ``ids`` (position, lane), or read them from ``payloads``. The longest lanes are first, so those that go on are
    the first ones at each position."""
    count = len(lengths)
    coder = Lanes(count, payloads)
    second, first = Guesses(count, HASH_2), Guesses(count, HASH_1)
    mixture, digits = Mixture(count), Digits(count)
    weights, right = mixture.weights.reshape(-1), mixture.right.reshape(-1)
    out = np.zeros((int(lengths.max()), count), np.uint16) if ids is None else ids
    one, two = np.zeros(count, np.int64), np.zeros(count, np.int64)
    going = np.searchsorted(-lengths, -np.arange(len(out)))
    every = np.arange(count)
    for t, m in enumerate(going.tolist()):
        lanes, a, b = every[:m], one[:m], two[:m]
        c2, c1 = (a * 31 + b * 7919) % HASH_2, a % HASH_1
        (g2, s2), (g1, s1) = second.of(lanes, c2), first.of(lanes, c1)
        same = g1 == g2
        # the mixed probabilities of the two ids
        own, eighth = (lanes * 16 + s2 * 4 + s1) * 2, lanes * 8
        by2 = weights.take(own) * right.take(eighth + s2) >> 15
        by1 = weights.take(own + 1) * right.take(eighth + 4 + s1) >> 15
        zero2, zero1 = digits.of(lanes, np.stack([g2, g1]))
        rest = ONE - by2 - by1
        p2 = np.minimum(np.maximum(by2 + by1 * same + (rest * zero2 >> 30), RAREST), ONE - 2 * RAREST)
        p1 = np.minimum(np.maximum(by1 + (rest * zero1 >> 30), RAREST), ONE - RAREST - p2) * ~same
        both, span, low = p2 + p1, coder.span[:m], coder.low[:m]
        if ids is None:
            found = coder.found(span, low)
            is2, other = found < p2, found >= both
        else:
            real = ids[t, :m].astype(np.int64)
            is2 = real == g2
            other = ~is2 & (real != g1)
        begin = np.where(is2, 0, np.where(other, both, p2))
        coder.span[:m], coder.low[:m] = coder.narrow(lanes, span, low, begin, np.where(is2, p2, np.where(other, ONE - both, p1)))
        value, chance = np.where(is2, g2, g1), np.where(is2, zero2, zero1)
        others = np.flatnonzero(other)
        if len(others):
            value[others], chance[others] = digits.code(coder, others, None if ids is None else real[others])
        if ids is None:
            out[t, :m] = value
        mixture.update(lanes, (s2, s1), (g2 == value, g1 == value), chance)
        second.update(lanes, c2, g2, s2, value)
        first.update(lanes, c1, g1, s1, value)
        two, one = a, value
    return out, coder


def compress(blocks: list[np.ndarray]) -> list[bytes]:
    """One payload per block of ids (below 65,536)."""
    out: list[bytes] = [b""] * len(blocks)
    for k in range(0, len(blocks), LANES):
        lengths = np.array([len(x) for x in blocks[k:k + LANES]])
        order = np.argsort(-lengths, kind="stable")
        ids = np.zeros((int(lengths.max()), len(lengths)), np.uint16)
        for lane, i in enumerate(order.tolist()):
            ids[:lengths[i], lane] = blocks[k + i]
        for i, x in zip(order.tolist(), _code(lengths[order], ids, None)[1].payloads(), strict=True):
            out[k + i] = x
    return out


def expand(payloads: list[bytes], counts: list[int]) -> list[np.ndarray]:
    """The ids of each payload."""
    out = [np.zeros(0, np.int32)] * len(payloads)
    for k in range(0, len(payloads), LANES):
        lengths = np.array(counts[k:k + LANES])
        order = np.argsort(-lengths, kind="stable").tolist()
        ids = _code(lengths[order], None, [payloads[k + i] for i in order])[0]
        for lane, i in enumerate(order):
            out[k + i] = ids[:lengths[i], lane].astype(np.int32)
    return out


def crc32(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())


def write(docs: DataFrame, tokenizer: str, leading: bool, folder: str, end: int = END) -> None:
    """Tokenise the texts and write the files."""
    chars = docs.agg(F.sum(F.length("text"))).first()[0] or 0
    shards = max(1, chars // SHARD_CHARS)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tokens, shard, at, block, left = Encoder(tokenizer, leading), TaskContext.get().partitionId(), 0, 0, np.zeros(0, np.int32)
        names = [c.split()[0] for c in STORED.split(", ")]
        waiting: list[np.ndarray] = []

        def coded(blocks: list[np.ndarray]) -> pd.DataFrame:
            rows = [
                (shard, "block", block + i, None, None, len(x), crc32(x), p) for i, (x, p) in enumerate(zip(blocks, compress(blocks), strict=True))
            ]
            return pd.DataFrame(rows, columns=names).astype({"doc_id": "Int64", "start": "Int64"})

        for batch in batches:
            for k in range(0, len(batch), ROWS):
                part = batch.iloc[k:k + ROWS]
                rows = []
                stream = [left]
                for i, ids in zip(part["doc_id"], tokens.encode(part["text"].fillna("").tolist()), strict=True):
                    stream.append(np.r_[ids, end].astype(np.int32))
                    rows.append((shard, "document", None, i, at, len(stream[-1]), None, None))
                    at += len(stream[-1])
                yield pd.DataFrame(rows, columns=names).astype({"doc_id": "Int64", "block": "Int32", "crc": "Int64"})
                flat = np.concatenate(stream)
                whole = len(flat) // BLOCK * BLOCK
                waiting += list(flat[:whole].reshape(-1, BLOCK))
                left = flat[whole:]
                while len(waiting) >= LANES:
                    yield coded(waiting[:LANES])
                    block, waiting = block + LANES, waiting[LANES:]
        if len(left):
            waiting.append(left)
        if waiting:
            yield coded(waiting)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").repartitionByRange(shards, "doc_id")
    rows.sortWithinPartitions("doc_id").mapInPandas(run, STORED).write.parquet(folder)


def read(spark: SparkSession, folder: str, ids: bool = False) -> DataFrame:
    """Per document: doc_id, start (ids of all documents before it), n_tokens, ids_crc32 and, where
    asked for, ids. Raises on a block that does not match its checksum."""
    stored = spark.read.schema(STORED).parquet(folder)

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        blocks = frame[frame["kind"] == "block"].sort_values("block")
        rows = frame[frame["kind"] == "document"].sort_values("start", kind="stable")
        counts = blocks["count"].astype(int).tolist()
        parts = expand(blocks["payload"].tolist(), counts)
        for name, crc, part in zip(blocks["block"], blocks["crc"], parts, strict=True):
            if crc32(part) != crc:
                raise ValueError(f"block {name} of shard {frame['shard'].iloc[0]} does not match its checksum")
        flat = np.concatenate(parts).astype("<u4") if parts else np.zeros(0, "<u4")
        starts, sizes = rows["start"].astype(int).tolist(), rows["count"].astype(int).tolist()
        own = [flat[a:a + n] for a, n in zip(starts, sizes, strict=True)]
        return pd.DataFrame({
            "shard": rows["shard"], "doc_id": rows["doc_id"].astype("Int64"), "at": starts, "n_tokens": sizes,
            "ids_crc32": [zlib.crc32(x.tobytes()) for x in own], "ids": [x.tolist() if ids else None for x in own],
        })

    # one row per shard
    totals = stored.where("kind = 'document'").groupBy("shard").agg(F.sum("count").alias("n"))
    found = stored.groupBy("shard").applyInPandas(run, "shard int, doc_id long, at long, n_tokens long, ids_crc32 long, ids array<long>")
    sums, total = {}, 0
    for row in totals.orderBy("shard").toLocalIterator():
        sums[row["shard"]], total = total, total + row["n"]
    first = spark.createDataFrame(list(sums.items()), "shard int, first long")
    out = found.join(first, "shard").withColumn("start", F.col("at") + F.col("first"))
    return out.select("doc_id", "start", "n_tokens", "ids_crc32", *(["ids"] if ids else []))


def round_trip(docs: DataFrame, tokenizer: str, leading: bool) -> DataFrame:
    """Write the files into the shared folder and read them back."""
    folder = scratch_path(docs.sparkSession, "token-files")
    write(docs, tokenizer, leading, folder)
    return read(docs.sparkSession, folder)
