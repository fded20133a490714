"""Benchmark decontamination: which documents hold a passage within a small edit distance of a
benchmark item.

Texts and items are sequences of lower-cased words (``\\w+``). A passage matches an item of n words if
their word edit distance is at most ``DIFFER`` of n. Steps, on blocks of concatenated texts:

1. lossless filters, which spare most windows the walks: d edits leave at least n - 1 - 2d of the item's word
   pairs, so a window counts only in a stretch that holds as many pairs of items of the length, then of one item;
2. CGK walks (``walks.py``) embed every item-sized window of these stretches, from whichever word it starts, and
   the items; windows and items meet in buckets of sampled steps. The number of walks of each length
   follows from ``RECALL``, the share of altered passages at ``DIFFER`` that have a bucket in common with the item;
   the number of steps in a bucket grows with the logarithm of the items of that length;
3. exact verification of all that met: the best alignment of the item to any passage around the stretch.

So what is returned is exact, and what lies within the distance is found at ``RECALL`` or more: there are several
windows for each passage, and fewer edits miss fewer. Unaltered passages are always found.

The benchmark travels to the tasks; above ``ITEM_BYTES`` it does so in blocks, one column each.

Edge cases: null and empty texts match nothing; null items match nothing, nor do items of fewer than ``min_words``
words (a parameter: so few words occur in clean texts); equal items are reported each; rows without an id are
judged like others; ``without`` keeps all columns, ``matches`` returns the id only.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talentspark.llm.common import mix, ranges
from talentspark.llm.walks import BANDS, ITEM_END, WINDOW_END, Walks, walks_for

DIFFER = 0.2
RECALL = 0.999
MIN_WORDS = 5
# of two unrelated words, the share that are equal, and the bits of a bucket number by which windows are told apart first
CHANCE = 0.05
BUCKET_BITS = 20
ITEM_BYTES = 16 << 20
BLOCK_WORDS = 800_000
PAIR_BITS = 20
LIST_ENTRIES = 4_000_000
WORD = re.compile(r"\w+")
MATCH = "array<struct<item_id:bigint,start:int,end:int,distance:int,n_words:int>>"


def words(text: str | None) -> list[str]:
    return WORD.findall((text or "").lower())


def edits(n: int, differ: float = DIFFER) -> int:
    return int(math.floor(differ * n + 1e-9))


def pieces(at: np.ndarray, lengths: np.ndarray, size: int) -> list[slice]:
    """Cuts of ascending places into parts of about ``LIST_ENTRIES``, where places lie ``size`` or more apart."""
    free = np.flatnonzero(np.diff(at) >= size) + 1
    number = np.cumsum(lengths)[free - 1] // LIST_ENTRIES
    cuts = free[np.flatnonzero(np.diff(number, prepend=0))].tolist()
    return [slice(a, b) for a, b in zip([0, *cuts], [*cuts, len(at)], strict=True)]


def align(item: np.ndarray, passage: np.ndarray) -> tuple[int, int, int]:
    """(distance, first, end) of the passage part that is nearest to the item; the earliest, shortest one of several."""
    cost, origin = [0] * (len(passage) + 1), list(range(len(passage) + 1))
    there = passage.tolist()
    for i, word in enumerate(item.tolist(), 1):
        last_cost, last_origin = cost, origin
        cost, origin = [i], [0]
        for j, other in enumerate(there):
            best, start = last_cost[j] + (word != other), last_origin[j]
            if last_cost[j + 1] + 1 < best:
                best, start = last_cost[j + 1] + 1, last_origin[j + 1]
            if cost[j] + 1 < best:
                best, start = cost[j] + 1, origin[j]
            cost.append(best)
            origin.append(start)
    end = min(range(len(cost)), key=lambda j: (cost[j], j))
    return cost[end], origin[end], end


def near_parts(item: np.ndarray, passage: np.ndarray, d: int) -> list[tuple[int, int, int]]:
    """The nearest part within ``d`` edits of the item, and those of what lies before it."""
    out = []
    while len(passage) >= len(item) - d:
        distance, first, end = align(item, passage)
        if distance > d:
            break
        out.append((distance, first, end))
        passage = passage[:first]
    return out


class Buckets:
    """The buckets of the items of one length."""

    def __init__(self, items: np.ndarray, numbers: list[int], walks: int, sample: int):
        self.walks = Walks(items.shape[1], walks, sample)
        size, owner = self.walks.chunk(), np.array(numbers)
        keys = np.concatenate([self.walks.buckets(items[i:i + size], ITEM_END) for i in range(0, len(items), size)], 1)
        order = np.argsort(keys, axis=None, kind="stable")
        self.keys, self.owner = keys.ravel()[order], np.tile(owner, walks * BANDS)[order]
        self.used = np.zeros(1 << BUCKET_BITS, bool)
        self.used[self.keys >> np.uint64(64 - BUCKET_BITS)] = True

    def meet(self, symbols: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(window start, item) of all windows that share a bucket with an item, each once."""
        n, size, out = self.walks.n, self.walks.chunk(), [np.zeros((0, 2), np.int64)]
        for i in range(0, len(starts), size):
            some = starts[i:i + size]
            keys = self.walks.buckets(symbols[some[:, None] + np.arange(n)], WINDOW_END)
            # a window whose numbers no item's begin like needs no search
            row, column = np.nonzero(self.used[keys >> np.uint64(64 - BUCKET_BITS)])
            key = keys[row, column]
            first = np.searchsorted(self.keys, key)
            count = np.searchsorted(self.keys, key, "right") - first
            met = np.stack([np.repeat(some[column], count), self.owner[ranges(first, count)]], 1)
            out.append(np.unique(met, axis=0))
        both = np.concatenate(out)
        return both[:, 0], both[:, 1]


@dataclass
class Benchmark:
    """Word numbers, pair table and the pairs' inverted lists of a block of items."""

    ids: list[int]
    items: list[list[str]]

    def settle_plan(self) -> None:
        """(walks, sampled steps of a bucket) of each item length."""
        self.plan = {}
        for n, count in Counter(map(len, self.items)).items():
            sample = max(2, math.ceil(math.log(count) / -math.log(CHANCE)))
            self.plan[n] = walks_for(n, DIFFER, RECALL, sample), sample

    def prepare(self) -> None:
        self.number = {}
        self.coded = [np.array([self.number.setdefault(w, len(self.number)) for w in item], np.int64) for item in self.items]
        # one bit per item length (modulo 64): the pairs of items of that length
        self.pairs = np.zeros(1 << PAIR_BITS, np.uint64)
        for item in self.coded:
            self.pairs[self.pair(item[:-1], item[1:])] |= np.uint64(1 << len(item) % 64)
        lengths = sorted({len(item) for item in self.coded})
        self.need = {n: max(n - 1 - 2 * edits(n), 1) for n in lengths}
        # some stretch as long as the shortest item's has at least this many of the pairs
        self.short = lengths[0] + edits(lengths[0])
        self.gate = min(-(-self.need[n] // -(-(n + edits(n)) // self.short)) for n in lengths)
        self.by_length = {n: [k for k, item in enumerate(self.coded) if len(item) == n] for n in lengths}
        self.holders = {n: self.inverted(members) for n, members in self.by_length.items()}
        # a hash for each word, the last one for all words that no item has
        self.symbols = mix(np.arange(1, len(self.number) + 2, dtype=np.uint64))
        self.buckets = {
            n: Buckets(self.symbols[np.stack([self.coded[k] for k in members])], members, *self.plan[n])
            for n, members in self.by_length.items()
        }

    def inverted(self, members: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct pairs of the items, where the list of each begins (and the last one ends), and the lists of items."""
        pairs = np.concatenate([self.pair(self.coded[k][:-1], self.coded[k][1:]) for k in members])
        owner = np.repeat(members, [len(self.coded[k]) - 1 for k in members])
        both = np.unique(np.stack([pairs, owner], 1), axis=0)
        keys, first = np.unique(both[:, 0], return_index=True)
        return keys, np.r_[first, len(both)], both[:, 1]

    def pair(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        h = mix((a.astype(np.uint64) << np.uint64(32)) + b.astype(np.uint64))
        return (h >> np.uint64(64 - PAIR_BITS)).astype(np.int64)

    def candidates(self, codes: np.ndarray) -> set[tuple[int, int]]:
        """(first pair, item number) of the stretches that hold enough pairs of the item."""
        both = (codes[:-1] >= 0) & (codes[1:] >= 0)
        held = np.zeros(len(codes), np.uint64)
        held[:-1][both] = self.pairs[self.pair(codes[:-1][both], codes[1:][both])]

        def within(hit: np.ndarray, size: int) -> np.ndarray:
            total = np.r_[0, np.cumsum(hit)]
            return total[np.minimum(np.arange(len(hit)) + size, len(hit))] - total[:-1]

        found: set[tuple[int, int]] = set()
        near = np.flatnonzero(within(held > 0, self.short) >= self.gate)
        if not len(near):
            return found
        # go on with the surroundings of such stretches only
        reach = 2 * max(self.by_length)
        cut = np.flatnonzero(np.diff(near) > 2 * reach)
        low = np.maximum(near[np.r_[0, cut + 1]] - reach, 0)
        high = np.minimum(near[np.r_[cut, len(near) - 1]] + reach, len(codes))
        spots = np.concatenate([np.r_[np.arange(a, b), np.full(reach, -1)] for a, b in zip(low, high, strict=True)])
        codes, held = np.where(spots < 0, -1, codes[spots]), np.where(spots < 0, np.uint64(0), held[spots])
        code = np.zeros(len(codes), np.int64)
        code[:-1] = self.pair(codes[:-1], codes[1:])
        for n, need in self.need.items():
            of_length = (held >> np.uint64(n % 64)) & np.uint64(1)
            size = n + edits(n)
            enough = within(of_length, size) >= need
            # the pairs within some such window
            covered = np.cumsum(np.r_[enough, np.zeros(size, bool)].astype(np.int64) - np.r_[np.zeros(size, bool), enough])[:len(codes)] > 0
            at = np.flatnonzero(covered & (of_length > 0))
            keys, begin, items = self.holders[n]
            where = np.minimum(np.searchsorted(keys, code[at]), len(keys) - 1)
            known = keys[where] == code[at]
            at, where = at[known], where[known]
            # a bounded number of list entries at a time, cut where no window reaches over
            lengths = begin[where + 1] - begin[where]
            for part in pieces(at, lengths, size):
                item, place = items[ranges(begin[where[part]], lengths[part])], np.repeat(at[part], lengths[part])
                order = np.argsort(item, kind="stable")
                item, place = item[order], place[order]
                last = np.arange(len(item)) + need - 1
                first = np.flatnonzero(last < len(item))
                last = last[first]
                # n + d words hold pairs that begin at most n + d - 2 words apart
                hit = first[(item[last] == item[first]) & (place[last] - place[first] <= size - 2)]
                found.update(zip(spots[place[hit]].tolist(), item[hit].tolist(), strict=True))
        return found

    def met(self, codes: np.ndarray, stretches: list[tuple[int, int, int]]) -> np.ndarray:
        """Which of the (item, first, last window start) hold a window that shares a bucket with the item."""
        out = np.zeros(len(stretches), bool)
        if not stretches:
            return out
        symbols = self.symbols[codes]
        item, first, last = np.array(stretches).T
        length = np.array([len(c) for c in self.coded])[item]
        for n in np.unique(length).tolist():
            of = np.flatnonzero(length == n)
            starts = np.unique(ranges(first[of], last[of] - first[of] + 1))
            start, k = self.buckets[n].meet(symbols, starts)
            known = np.sort(k * len(codes) + start)
            at = np.searchsorted(known, item[of] * len(codes) + first[of])
            out[of] = np.r_[known, np.iinfo(np.int64).max][at] <= item[of] * len(codes) + last[of]
        return out

    def matches(self, texts: list[str | None]) -> list[list[tuple]]:
        """Per text, its matches in ascending order: (item id, first and end character, distance, words of the item)."""
        out: list[list[tuple]] = []
        block: list[str | None] = []
        size = 0
        for text in texts:
            block.append(text)
            size += len(text or "")
            if size >= 6 * BLOCK_WORDS:
                out += self._block(block)
                block, size = [], 0
        return out + self._block(block)

    def _block(self, texts: list[str | None]) -> list[list[tuple]]:
        out: list[list[tuple]] = [[] for _ in texts]
        longest = max(self.by_length) if self.by_length else 0
        # between texts, enough unknown words that no alignment reaches over
        gap = np.full(2 * longest + 2, -1, np.int64)
        parts, begin, at = [gap], [], len(gap)
        get = self.number.get
        for text in texts:
            found = words(text)
            begin.append(at)
            parts += [np.fromiter(map(get, found, repeat(-1)), np.int64, len(found)), gap]
            at += len(found) + len(gap)
        codes, begin = np.concatenate(parts), np.array(begin + [at])
        reached: dict[tuple[int, int], int] = {}
        starts: dict[tuple[int, int], list[int]] = {}
        for start, k in sorted(self.candidates(codes)):
            starts.setdefault((int(np.searchsorted(begin, start, "right")) - 1, k), []).append(start)
        # neighbouring stretches are verified together; each edit keeps at most two words before the first pair
        groups: list[tuple[int, int, int, int]] = []
        for (doc, k), own in starts.items():
            n, d, at = len(self.items[k]), edits(len(self.items[k])), 0
            while at < len(own):
                low, at = own[at], int(np.searchsorted(own, own[at] + n // 2, "right"))
                groups.append((doc, k, max(low - 2 * d, int(begin[doc])), own[at - 1]))
        for (doc, k, low, last), ok in zip(groups, self.met(codes, [g[1:] for g in groups]), strict=True):
            if not ok or last < reached.get((doc, k), 0):
                continue
            item, d = self.coded[k], edits(len(self.coded[k]))
            low = max(low, reached.get((doc, k), 0))
            passage = codes[low:min(last + len(item) + 2 * d, int(begin[doc + 1]) - len(gap))]
            if np.isin(item, passage).sum() < len(item) - d:
                continue
            for distance, first, end in near_parts(item, passage, d):
                reached[doc, k] = max(low + end, reached.get((doc, k), 0))
                out[doc].append((k, low + first - int(begin[doc]), low + end - int(begin[doc]), distance))
        for doc, found in enumerate(out):
            if found:
                places = [m.span() for m in WORD.finditer((texts[doc] or "").lower())]
                out[doc] = sorted(
                    (self.ids[k], places[a][0], places[b - 1][1], distance, len(self.coded[k])) for k, a, b, distance in found
                )
        return out


def benchmarks(benchmark: DataFrame, item_bytes: int = ITEM_BYTES, min_words: int = MIN_WORDS) -> list[Benchmark]:
    """The items in blocks of at most ``item_bytes`` (a single longer item is a block of its own)."""
    blocks, size = [Benchmark([], [])], 0
    rows = benchmark.where(F.col("item_id").isNotNull() & F.col("text").isNotNull()).select("item_id", "text").orderBy("item_id", "text")
    for row in rows.toLocalIterator():
        item = words(row["text"])
        if len(item) < max(min_words, 2):
            continue
        if size and size + len(row["text"]) > item_bytes:
            blocks.append(Benchmark([], []))
            size = 0
        blocks[-1].ids.append(row["item_id"])
        blocks[-1].items.append(item)
        size += len(row["text"])
    blocks = [b for b in blocks if b.items]
    for block in blocks:
        block.settle_plan()
    return blocks


def found(text: Column, block: Benchmark) -> Column:
    """The matches of a text as an array of ``MATCH`` structs; offsets count characters of the lower-cased text."""
    @F.pandas_udf(MATCH)
    def run(texts: pd.Series) -> pd.Series:
        if not hasattr(block, "buckets"):
            block.prepare()
        names = ("item_id", "start", "end", "distance", "n_words")
        return pd.Series([[dict(zip(names, m, strict=True)) for m in row] for row in block.matches(texts.tolist())])

    return run(text)


def matches(docs: DataFrame, benchmark: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """One row per match: doc_id, item_id, start, end, distance, n_words."""
    rows = docs.select("doc_id", "text")
    none = rows.select("doc_id", F.explode(F.expr(f"CAST(array() AS {MATCH})")).alias("m"))
    parts = [rows.select("doc_id", F.explode(found(F.col("text"), b)).alias("m")) for b in benchmarks(benchmark, min_words=min_words)]
    for part in parts:
        none = none.unionByName(part) if len(parts) > 1 else part
    return none.select("doc_id", "m.*")


def without(docs: DataFrame, benchmark: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` without the rows that hold a passage of the benchmark."""
    for block in benchmarks(benchmark, min_words=min_words):
        docs = docs.where(F.size(found(F.col("text"), block)) == 0)
    return docs
