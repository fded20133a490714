"""Exact substring deduplication: every byte covered by a ``SPAN``-byte string that also starts
elsewhere (same document included) is removed.

The index is built column-wise for many strings at once: one symbol of each string is inserted per
round, and the collection's Burrows-Wheeler transform (symbol and predecessor of each suffix) and its
common prefixes are updated by merging the round's sorted insertions into them in one sequential pass.
Run on whole documents this takes as many rounds as the longest document has bytes, each over all that
is there already. So the texts are first cut into short strings, without losing a match:

* each SPAN-byte window has an anchor, its gram of the smallest hash; equal windows have equal anchors
  at equal offsets, and neighbouring windows with the same anchor form one string of under 2 x SPAN bytes;
* strings whose anchor gram occurs only once in the corpus cannot match and are left out;
* equal strings are kept once, with their number;
* the rest goes to tasks by anchor, symbols being eight bytes counted from the anchor, so that 50
  rounds are enough. A window that starts e bytes before a symbol border is found by a common prefix of
  SPAN - e bytes and e equal bytes of the preceding symbol, which the transform holds.

Anchors with more than ``HOT`` bytes of different strings are counted window by window instead.

Edge cases: a null text is empty; texts below SPAN bytes keep everything; equal rows count as
occurrences of each other; ids play no part in matching and may be null; further columns are kept by
``clean`` and left behind by ``report``. A text whose remaining bytes are no valid UTF-8 (a removed run
cut a character) has the broken bytes dropped in ``clean``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talentspark.llm.common import mix, ranges, released
from talentspark.session import settle, settle_table

SPAN = 200
GRAM = 64
PIECE = 1 << 20  # windows handled at once; longer texts are cut, with an overlap
HOT = 64 << 20
TASK_BYTES = 8 << 20
BASE = 0x9E3779B97F4A7C15
PLACE = np.uint64((1 << 24) - 1)
DOCS_PER_BUCKET = 8_000


def _powers(count: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = np.full(count, BASE, np.uint64), np.full(count, pow(BASE, -1, 1 << 64), np.uint64)
    up[0] = down[0] = 1
    return np.cumprod(up), np.cumprod(down)


class Anchors:
    """Anchor runs of concatenated pieces."""

    def __init__(self) -> None:
        self.up, self.down = _powers(2 * PIECE + 4 * SPAN)

    def runs(self, data: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, ...]:
        """(piece, first window, last window, anchor place, gram hash) of each run; places within the piece."""
        n = len(data)
        offset = np.cumsum(sizes) - sizes
        count = np.maximum(sizes - SPAN + 1, 0)
        windows = ranges(offset, count)
        if not len(windows):
            return (np.zeros(0, np.int64),) * 4 + (np.zeros(0, np.uint64),)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * self.down[:n], out=sums[1:])
        grams = mix((sums[GRAM:] - sums[:-GRAM]) * self.up[:n - GRAM + 1])
        low = (grams & ~PLACE) | np.arange(len(grams), dtype=np.uint64)
        width, reach = 1, SPAN - GRAM + 1
        while 2 * width <= reach:
            low = np.minimum(low[:len(low) - width], low[width:])
            width *= 2
        if width < reach:
            low = np.minimum(low[:len(low) - (reach - width)], low[reach - width:])
        place = (low[windows] & PLACE).astype(np.int64)
        first = np.flatnonzero(np.r_[True, (place[1:] != place[:-1]) | (windows[1:] != windows[:-1] + 1)])
        last = np.r_[first[1:], len(place)] - 1
        piece = np.repeat(np.arange(len(sizes)), count)[first]
        at = place[first]
        return piece, windows[first] - offset[piece], windows[last] - offset[piece], at - offset[piece], grams[at]


def pieces(rows: Iterator[tuple]) -> Iterator[tuple[list[tuple], np.ndarray, np.ndarray]]:
    """Group (key, text bytes, ...) rows: [(key, first byte of the piece, ...)], bytes, sizes."""
    heads, parts, size = [], [], 0
    for key, data, *rest in rows:
        for at in range(0, max(len(data) - SPAN + 1, 0), PIECE):
            part = data[at:at + PIECE + SPAN - 1]
            heads.append((key, at, *rest))
            parts.append(part)
            size += len(part)
            if size >= PIECE:
                yield heads, np.frombuffer(b"".join(parts), np.uint8), np.array(list(map(len, parts)))
                heads, parts, size = [], [], 0
    if heads:
        yield heads, np.frombuffer(b"".join(parts), np.uint8), np.array(list(map(len, parts)))


def _utf8(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "replace")


def anchor_rows(rows: DataFrame, buckets: int) -> DataFrame:
    """kind 1: grams of a hash bucket, each once per chunk, with the text it is in or, where it is
    repeated within the chunk, 0; kind 2: texts and the grams repeated within their chunk."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        anchors = Anchors()
        source = ((k, _utf8(t)) for batch in batches for k, t in zip(batch["k"], batch["text"], strict=True))
        for heads, data, sizes in pieces(source):
            piece, _, _, _, gram = anchors.runs(data, sizes)
            key = np.array([h[0] for h in heads], np.int64)[piece]
            order = np.argsort(gram, kind="stable")
            gram, key = gram[order], key[order]
            first = np.flatnonzero(np.r_[True, gram[1:] != gram[:-1]]) if len(gram) else np.zeros(0, np.int64)
            many = np.diff(np.r_[first, len(gram)]) > 1
            again = np.repeat(many, np.diff(np.r_[first, len(gram)]))
            out = [(2, 0, gram[again].tobytes(), key[again].tobytes())]
            gram, key = gram[first], np.where(many, 0, key[first])
            bucket = (gram % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            for part in np.split(order, np.flatnonzero(np.diff(bucket[order])) + 1) if len(order) else []:
                out.append((1, int(bucket[part[0]]), gram[part].tobytes(), key[part].tobytes()))
            yield pd.DataFrame(out, columns=["kind", "bucket", "gram", "key"])

    return rows.mapInPandas(released(run), "kind int, bucket int, gram binary, key binary")


def repeated(frame: pd.DataFrame) -> pd.DataFrame:
    """Of one bucket, the grams that come from several chunks or were repeated in one."""
    gram = np.concatenate([np.frombuffer(x, np.uint64) for x in frame["gram"]])
    key = np.concatenate([np.frombuffer(x, np.int64) for x in frame["key"]])
    order = np.argsort(gram, kind="stable")
    gram, key = gram[order], key[order]
    same = gram[1:] == gram[:-1]
    keep = (np.r_[same, False] | np.r_[False, same]) & (key != 0)
    return pd.DataFrame({"gram": [gram[keep].tobytes()], "key": [key[keep].tobytes()]})


def _unpack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for gram, key in zip(batch["gram"], batch["key"], strict=True):
            frame = pd.DataFrame({"k": np.frombuffer(key, np.int64), "gram": np.frombuffer(gram, np.uint64)})
            frame = frame.drop_duplicates().sort_values("k", kind="stable")
            yield pd.DataFrame([(k, g.to_numpy().tobytes()) for k, g in frame.groupby("k")["gram"]], columns=["k", "grams"])


STRINGS = "id binary, gram long, anchor int, string binary, keys array<bigint>, places array<bigint>"


def strings(flagged: DataFrame) -> DataFrame:
    """The anchor strings of (k, text, grams): each different one once per chunk, with where it was found."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        anchors = Anchors()
        source = (
            (k, _utf8(t), np.frombuffer(b"".join(g), np.uint64))
            for batch in batches for k, t, g in zip(batch["k"], batch["text"], batch["grams"], strict=True)
        )
        for heads, data, sizes in pieces(source):
            piece, first, last, at, gram = anchors.runs(data, sizes)
            offset = np.cumsum(sizes) - sizes
            wanted = np.zeros(len(gram), bool)
            edge = np.searchsorted(piece, np.arange(len(heads) + 1))
            for p, head in enumerate(heads):
                wanted[edge[p]:edge[p + 1]] = np.isin(gram[edge[p]:edge[p + 1]], head[2])
            raw, found = data.tobytes(), {}
            for i in np.flatnonzero(wanted):
                key, base, _ = heads[piece[i]]
                start = offset[piece[i]] + first[i]
                string = raw[start:offset[piece[i]] + last[i] + SPAN]
                entry = found.setdefault(xxhash.xxh3_128_digest(string), (int(gram[i].view(np.int64)), int(at[i] - first[i]), string, [], []))
                entry[3].append(key)
                entry[4].append(int(base + first[i]))
            yield pd.DataFrame([(d, *e) for d, e in found.items()], columns=["id", "gram", "anchor", "string", "keys", "places"])

    return flagged.mapInPandas(released(run), STRINGS)


class Columns:
    """Burrows-Wheeler transform and common prefixes of a collection, built one symbol per string and
    round, from the strings' ends. ``symbol[x]`` is the first symbol of the suffix of rank x, ``tail[x]``
    the rank of what follows it, ``common[x]`` the symbols it shares with the suffix before it."""

    def __init__(self, columns: list[tuple[np.ndarray, np.ndarray]], count: int):
        self.symbol, self.tail = np.zeros(count, np.int64), np.arange(count)
        self.common, self.owner, self.left = np.zeros(count, np.int64), np.arange(count), np.zeros(count, np.int64)
        rank = np.arange(count)  # of each string's longest suffix so far
        for i, (strings_, symbols) in enumerate(columns):
            self._insert(strings_, symbols, rank, i + 1)

    def _insert(self, strings_: np.ndarray, symbols: np.ndarray, rank: np.ndarray, length: int) -> None:
        size = len(self.symbol)
        keys = (symbols << 32) | rank[strings_]
        order = np.argsort(keys, kind="stable")
        keys, strings_ = keys[order], strings_[order]
        slot = np.searchsorted((self.symbol << 32) | self.tail, keys)
        target = slot + np.arange(len(slot))
        fresh = np.zeros(size + len(slot), bool)
        fresh[target] = True
        old = np.flatnonzero(~fresh)

        def merged(before: np.ndarray, new: np.ndarray) -> np.ndarray:
            out = np.empty(len(fresh), before.dtype)
            out[old], out[target] = before, new
            return out

        symbol, tail = merged(self.symbol, keys >> 32), merged(self.tail, keys & 0xFFFFFFFF)
        common = merged(self.common, np.zeros(len(slot), np.int64))
        # only the new suffixes and those right behind them have a new neighbour
        changed = np.flatnonzero(fresh | np.r_[False, fresh[:-1]])
        changed = changed[changed > 0]
        shared = np.zeros(len(changed), np.int64)
        equal = (symbol[changed] == symbol[changed - 1]) & (symbol[changed] > 0)
        x = changed[equal]
        if len(x):
            bounds = np.stack([tail[x - 1] + 1, tail[x] + 1], 1).ravel()
            shared[equal] = 1 + np.minimum.reduceat(np.r_[self.common, 0], bounds)[::2]
        common[changed] = shared
        self.symbol, self.common = symbol, common
        self.tail = np.where(symbol > 0, old[tail], np.cumsum(symbol == 0) - 1)
        self.owner, self.left = merged(self.owner, strings_), merged(self.left, np.full(len(slot), length))
        rank[:] = old[rank]
        rank[strings_] = target


def repeats(texts: list[bytes], anchors: np.ndarray, grams: np.ndarray, counts: np.ndarray) -> list[np.ndarray]:
    """Of each string, the starts of its SPAN-byte windows that occur at least twice."""
    found: list[np.ndarray] = [np.zeros(0, np.int64)] * len(texts)
    group, size = np.unique(grams, return_inverse=True, return_counts=True)[1:]
    alone = size[group] == 1
    for i in np.flatnonzero(alone & (counts > 1)):
        found[i] = np.arange(len(texts[i]) - SPAN + 1)
    work = np.flatnonzero(~alone)
    if not len(work):
        return found
    # symbols of eight bytes, counted from the anchor; zeros fill the first and the last one
    lead = (-anchors[work]) % 8
    lengths = np.array([len(texts[i]) for i in work])
    blocks = -(-(lead + lengths) // 8)
    first = np.cumsum(blocks) - blocks
    data = np.zeros(int(blocks.sum()) * 8, np.uint8)
    data[ranges(first * 8 + lead, lengths)] = np.frombuffer(b"".join(texts[i] for i in work), np.uint8)
    word = data.view(">u8").astype(np.uint64)
    names = np.unique(word, return_inverse=True)[1] + 1
    most = int(blocks.max())
    columns = []
    for k in range(most):
        has = np.flatnonzero(blocks > k)
        columns.append((has, names[first[has] + blocks[has] - 1 - k]))
    index = Columns(columns, len(work))
    del columns

    # suffixes in order, without those that begin with their string's padding or are too short
    begin = 8 * (blocks[index.owner] - index.left) - lead[index.owner]
    rest = lengths[index.owner] - begin
    at = first[index.owner] + blocks[index.owner] - index.left
    word = np.r_[word, np.uint64(0)]
    here, there = np.minimum(at + index.common, len(word) - 1), np.minimum(np.r_[0, at[:-1]] + index.common, len(word) - 1)
    differ = word[here] ^ word[there]
    extra = np.zeros(len(differ), np.int64)
    for b in range(1, 8):
        extra += differ < np.uint64(1 << (64 - 8 * b))
    shared = np.minimum(8 * index.common + extra, np.minimum(rest, np.r_[0, rest[:-1]]))
    shared[0] = 0
    before = word[np.maximum(at - 1, 0)]
    hits: list[list[np.ndarray]] = [[] for _ in work]
    for e in range(8):
        run = np.cumsum(shared < SPAN - e)
        use = np.flatnonzero((rest >= SPAN - e) & (begin >= e))
        if not len(use):
            continue
        tip = before[use] & np.uint64((1 << (8 * e)) - 1)
        order = np.lexsort((tip, run[use]))
        use, tip = use[order], tip[order]
        start = np.r_[True, (run[use][1:] != run[use][:-1]) | (tip[1:] != tip[:-1])]
        number = np.cumsum(start) - 1
        twice = (np.bincount(number, counts[work][index.owner[use]]) > 1)[number]
        owner, window = index.owner[use][twice], (begin[use] - e)[twice]
        order = np.argsort(owner, kind="stable")
        owner, window = owner[order], window[order]
        cuts = np.flatnonzero(np.diff(owner)) + 1
        for part, mine in zip(np.split(window, cuts), np.split(owner, cuts), strict=True):
            if len(mine):
                hits[mine[0]].append(part)
    for i, parts in zip(work, hits, strict=True):
        if parts:
            found[i] = np.unique(np.concatenate(parts))
    return found


def spans(windows: np.ndarray) -> tuple[list[int], list[int]]:
    """Maximal byte runs [start, end) covered by windows at ascending places."""
    if not len(windows):
        return [], []
    cut = np.flatnonzero(np.diff(windows) > SPAN) + 1
    return windows[np.r_[0, cut]].tolist(), (windows[np.r_[cut - 1, len(windows) - 1]] + SPAN).tolist()


def _search(frame: pd.DataFrame) -> pd.DataFrame:
    found = repeats(
        frame["string"].tolist(), frame["anchor"].to_numpy(np.int64), frame["gram"].to_numpy(), frame["n"].to_numpy(np.int64)
    )
    covered = [spans(w) for w in found]
    out = pd.DataFrame({"id": frame["id"], "first": [c[0] for c in covered], "last": [c[1] for c in covered]})
    return out[out["first"].map(len) > 0]


def _windows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for i, s, n in zip(batch["id"], batch["string"], batch["n"], strict=True):
            places = range(len(s) - SPAN + 1)
            yield pd.DataFrame({"id": i, "place": places, "n": n, "w": [xxhash.xxh3_128_digest(s[p:p + SPAN]) for p in places]})


def removed(docs: DataFrame, key: list[Column], hot: int = HOT) -> DataFrame:
    """``docs`` (text and others) with ``_first`` and ``_last``: byte runs to remove (unmerged, null
    where there are none). Rows with an equal ``key``, which includes the text, are treated alike."""
    docs = docs.withColumn("_k", F.xxhash64(F.lit(1), *key))
    rows = docs.select(F.col("_k").alias("k"), "text")
    buckets = max(16, docs.count() // DOCS_PER_BUCKET)
    made = settle_table(anchor_rows(rows, buckets), "suffix-anchors")
    again = made.where("kind = 1").groupBy("bucket").applyInPandas(repeated, "gram binary, key binary")
    again = again.unionByName(made.where("kind = 2").select("gram", "key")).mapInPandas(_unpack, "k long, grams binary")
    flags = again.groupBy("k").agg(F.collect_list("grams").alias("grams"))
    found = settle_table(strings(rows.join(flags, "k")), "suffix-strings")

    counted = found.groupBy("id", "gram").agg(
        F.first("anchor").alias("anchor"), F.first("string").alias("string"), F.sum(F.size("keys")).alias("n")
    )
    sizes = found.groupBy("gram").agg(F.sum(F.length("string")).alias("size")).where(F.col("size") > hot)
    # at most (bytes of all strings / hot) anchors
    hot_grams = settle(sizes.select("gram"))
    total = found.agg(F.sum(F.length("string"))).first()[0] or 0
    task = F.pmod(F.xxhash64("gram"), F.lit(max(16, total // TASK_BYTES)))
    out = "id binary, first array<bigint>, last array<bigint>"
    if hot_grams.isEmpty():
        covered = counted.withColumn("task", task).groupBy("task").applyInPandas(_search, out)
    else:
        covered = counted.join(F.broadcast(hot_grams), "gram", "left_anti").withColumn("task", task).groupBy("task").applyInPandas(_search, out)
        each = counted.join(F.broadcast(hot_grams), "gram", "left_semi").select("id", "string", "n").mapInPandas(
            _windows, "id binary, place long, n long, w binary"
        )
        twice = each.join(each.groupBy("w").agg(F.sum("n").alias("m")).where("m > 1").select("w"), "w")
        covered = covered.unionByName(twice.groupBy("id").agg(
            F.sort_array(F.collect_set("place")).alias("first")
        ).withColumn("last", F.transform("first", lambda x: x + SPAN)))
    covered = settle_table(covered, "suffix-covered")
    where = found.select("id", F.explode(F.arrays_zip("keys", "places")).alias("o")).join(covered, "id").select(
        F.col("o.keys").alias("_k"), F.transform("first", lambda x: x + F.col("o.places")).alias("first"),
        F.transform("last", lambda x: x + F.col("o.places")).alias("last"),
    )
    # a repeated row finds each of its places once per copy
    where = where.groupBy("_k").agg(
        F.flatten(F.collect_set("first")).alias("_first"), F.flatten(F.collect_set("last")).alias("_last")
    )
    return docs.join(where, "_k", "left").drop("_k")


def cut(text: str | None, first: np.ndarray | None, last: np.ndarray | None) -> tuple[int, list[tuple[int, int]], bytes]:
    """(bytes, merged runs, remaining bytes) of a text."""
    data = _utf8(text)
    if first is None or not len(first):
        return len(data), [], data
    runs: list[list[int]] = []
    for a, b in zip(np.sort(first).tolist(), np.sort(last).tolist(), strict=True):
        if runs and a <= runs[-1][1]:
            runs[-1][1] = max(runs[-1][1], b)
        else:
            runs.append([a, b])
    edges = [0, *[x for run in runs for x in run], len(data)]
    return len(data), [(a, b) for a, b in runs], b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))


def report(docs: DataFrame, hot: int = HOT) -> DataFrame:
    """Per row: doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            parts = [cut(*x) for x in zip(batch["text"], batch["_first"], batch["_last"], strict=True)]
            yield pd.DataFrame({
                "doc_id": batch["doc_id"].astype("Int64"), "n_bytes": [n for n, _, _ in parts],
                "n_removed": [n - len(kept) for n, _, kept in parts], "n_spans": [len(runs) for _, runs, _ in parts],
                "kept_sha256": [hashlib.sha256(kept).hexdigest() for _, _, kept in parts],
            })

    return removed(docs.select("doc_id", "text"), [F.col("doc_id"), F.col("text")], hot).mapInPandas(
        run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    )


def clean(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with the repeated bytes gone from the text; untouched texts, nulls too, stay as they are."""
    @F.pandas_udf("string")
    def left(text: pd.Series, first: pd.Series, last: pd.Series) -> pd.Series:
        return pd.Series([
            t if a is None or not len(a) else cut(t, a, b)[2].decode("utf-8", "ignore")
            for t, a, b in zip(text, first, last, strict=True)
        ])

    # the other columns travel in a struct, so their names do not matter
    others = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != text_col], F.lit(0).alias("_"))
    boxed = docs.select(others.alias("row"), F.col(f"`{text_col}`").alias("text"))
    marked = removed(boxed, [F.col("row"), F.col("text")])
    kept = marked.select("row", left(F.col("text"), F.col("_first"), F.col("_last")).alias("text"))
    return kept.select(*[(F.col("text") if c == text_col else F.col("row").getField(c)).alias(c) for c in docs.columns])
