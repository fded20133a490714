"""N-gram Jaccard self-join by T-occurrence search.

1. Lossless blocks: in an order of all shingles by the number of documents that hold them, two sets of
   similarity >= t share one of the n - ceil(t n) + 1 rarest shingles of either (prefix filter). A shingle that no
   other document holds needs no list, so a document with more than 1 - t of its own words sends none at all, and
   a passage that many documents share links only those that consist of little else. Documents with a shared
   rare shingle are connected; connected documents form a block.
2. In a block, an inverted index; each document's lists are split as DivideSkip does: the short ones are
   merged and counted, the long ones are probed by binary search for the documents that can still reach
   the overlap T. What reaches it is compared exactly (100 * intersection >= t * union).

Equal sets are one class from the start and are worked on once. Blocks above ``BLOCK`` shingles are cut
into pieces that are compared two by two, each pair of documents in one task only. All links are verified
and counted; a task reports the number of links of each document and a spanning forest, never all pairs.

Edge cases: texts that are null or without words have an empty set and link with nothing; with fewer
than n words the whole sequence is the one shingle; rows that share an id are one document; a row
without an id is returned unlinked with a null component; further columns are left behind.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talentspark.llm.common import WordHash, components, mix, released, trim, with_id
from talentspark.operators.joins import lookup_join
from talentspark.session import settle, settle_table

CHUNK_WORDS = 250_000
BLOCK = 1_500_000
BUCKET_BYTES = 8 << 20  # of texts; a task counts the shingles of that many
SKIP = 0.0085  # weight of a probe against a merge step
ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]


def shingles(text: str, n: int, cache: WordHash) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the n-word shingles of ``text``, A-Z lower-cased."""
    words = text.encode("utf-8", "replace").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    h = cache.of(words)
    if len(words) < n:
        total = np.full(1, len(words), np.uint64) * ODD[-1]
    else:
        total = np.zeros(len(h) - n + 1, np.uint64)
    for i in range(min(n, len(words))):
        total = total + (h[i:i + 1] if len(words) < n else h[i:len(h) - n + 1 + i]) * ODD[i % 4] * np.uint64(2 * (i // 4) + 1)
    return np.unique(mix(total))


def packed(values: np.ndarray) -> bytes:
    """Integers byte by byte, the low bytes of all first: the high ones, mostly zeros, take no room when written."""
    return values.view(np.uint8).reshape(len(values), -1).T.tobytes()


def unpacked(data: bytes, kind: type) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.frombuffer(data, np.uint8).reshape(size, -1).T.copy().view(kind).ravel()


def by_bucket(bucket: np.ndarray) -> list[np.ndarray]:
    """Places of each bucket in an ascending array."""
    return np.split(np.arange(len(bucket)), np.flatnonzero(np.diff(bucket)) + 1) if len(bucket) else []


def signatures(docs: DataFrame, n: int, buckets: int) -> DataFrame:
    """One pass over the texts, in chunks of documents. kind 0: a document (``no`` in its chunk), its set's size and digest;
    kind 1: the shingles of a hash bucket (32 bits of them, ascending) with the numbers of their documents."""
    columns = {"kind": "int32", "chunk": "int64", "bucket": "int64", "no": "int64", "doc_id": "Int64", "n": "int64", "d1": "int64", "d2": "int64"}

    def signed(s: np.ndarray) -> int:
        return int(s.sum(dtype=np.uint64).view(np.int64)) if len(s) else 0

    def chunk(number: int, ids: list[int], sets: list[np.ndarray]) -> pd.DataFrame:
        rows: list[tuple] = [
            (0, number, 0, no, i, len(s), signed(mix(s)), signed(mix(s * ODD[3])), None, None)
            for no, (i, s) in enumerate(zip(ids, sets, strict=True))
        ]
        values = np.concatenate(sets)
        owner = np.repeat(np.arange(len(sets)), [0 if i is None else len(s) for i, s in zip(ids, sets, strict=True)]).astype(np.uint16)
        values = values[np.repeat([i is not None for i in ids], [len(s) for s in sets])] if None in ids else values
        bucket, short = (values % np.uint64(buckets)).astype(np.int64), (values >> np.uint64(32)).astype(np.uint32)
        order = np.lexsort((short, bucket))
        bucket, short, owner = bucket[order], short[order], owner[order]
        for part in by_bucket(bucket):
            gaps = np.diff(short[part], prepend=np.uint32(0))
            rows.append((1, number, int(bucket[part[0]]), 0, None, 0, 0, 0, packed(gaps), packed(owner[part])))
        return pd.DataFrame(rows, columns=[*columns, "x", "y"]).astype(columns)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cache, ids, sets, size = WordHash(), [], [], 0
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            for i, text in zip(batch["doc_id"], batch["text"], strict=True):
                ids.append(None if pd.isna(i) else int(i))
                sets.append(shingles(text, n, cache))
                size += len(sets[-1])
                if size >= CHUNK_WORDS or len(ids) >= 20_000:
                    yield chunk(number, ids, sets)
                    ids, sets, size, number = [], [], 0, number + 1
        if ids:
            yield chunk(number, ids, sets)

    schema = "kind int, chunk long, bucket long, no long, doc_id long, n long, d1 long, d2 long, x binary, y binary"
    return docs.mapInPandas(released(run), schema)


def shared(frame: pd.DataFrame) -> pd.DataFrame:
    """Of one bucket the shingles that several documents hold, with their number of documents, for each chunk."""
    parts = [np.cumsum(unpacked(x, np.uint32), dtype=np.uint32) for x in frame["x"]]
    every = np.sort(np.concatenate(parts))
    starts = np.flatnonzero(np.r_[True, every[1:] != every[:-1]])
    counts = np.diff(np.r_[starts, len(every)])
    values, counts = every[starts[counts > 1]], counts[counts > 1].astype(np.uint32)
    rows = []
    for chunk, bucket, part, y in zip(frame["chunk"], frame["bucket"], parts, frame["y"], strict=True):
        at = np.searchsorted(values, part)
        held = np.flatnonzero(at < len(values))
        held = held[values[at[held]] == part[held]]
        if len(held):
            rows.append((chunk, bucket, packed(part[held]), packed(unpacked(y, np.uint16)[held]), packed(counts[at[held]])))
    trim()
    return pd.DataFrame(rows, columns=["chunk", "bucket", "x", "y", "z"])


def prefix(sizes: np.ndarray, percent: int) -> np.ndarray:
    """How many of its rarest elements a set has to show."""
    return sizes + (-percent * sizes) // 100 + 1


def rare_keys(owner: np.ndarray, key: np.ndarray, held_by: np.ndarray, sizes: np.ndarray, percent: int) -> np.ndarray:
    """Which of the shared shingles (documents ``owner``, ``key``, documents that hold it) belong to the prefixes of their documents."""
    order = np.lexsort((key, held_by, owner))
    mine = np.bincount(owner, minlength=len(sizes))
    rank = np.arange(len(order)) - np.repeat(np.cumsum(mine) - mine, mine)
    alone = sizes - mine
    return order[rank < (prefix(sizes, percent) - alone)[owner[order]]]


def keys_of(percent: int):
    """The prefixes' shared shingles of a chunk, by bucket: (bucket, keys, ids)."""
    def run(frame: pd.DataFrame) -> pd.DataFrame:
        docs, lists = frame[frame["no"].notna()], frame[frame["no"].isna()]
        ids = np.zeros(65_536, np.int64)
        sizes = np.zeros(65_536, np.int64)
        no = docs["no"].to_numpy(np.int64)
        ids[no], sizes[no] = docs["doc_id"].to_numpy(np.int64), docs["n"].to_numpy(np.int64)
        if not len(lists):
            return pd.DataFrame({"bucket": [], "x": [], "y": []})
        short, owner, held_by = (np.concatenate([unpacked(v, t) for v in lists[c]]) for c, t in (("x", np.uint32), ("y", np.uint16), ("z", np.uint32)))
        bucket = np.repeat(lists["bucket"].to_numpy(np.int64), [len(v) // 4 for v in lists["x"]])
        use = sizes[owner] > 0  # one document of equal ones
        bucket, short, owner, held_by = bucket[use], short[use], owner[use], held_by[use]
        key = (bucket.astype(np.uint64) << np.uint64(32)) | short
        kept = rare_keys(owner, key, held_by, sizes, percent)
        kept = kept[np.argsort(bucket[kept], kind="stable")]
        rows = [(int(bucket[kept[p[0]]]), key[kept[p]].tobytes(), ids[owner[kept[p]]].tobytes()) for p in by_bucket(bucket[kept])]
        return pd.DataFrame(rows, columns=["bucket", "x", "y"])

    return run


def meet(buckets: int):
    """Documents of one bucket that share a key, each tied to the smallest one: (part, ids, smaller ids)."""
    def run(frame: pd.DataFrame) -> pd.DataFrame:
        keys = np.concatenate([np.frombuffer(x, np.uint64) for x in frame["x"]])
        ids = np.concatenate([np.frombuffer(y, np.int64) for y in frame["y"]])
        order = np.lexsort((ids, keys))
        keys, ids = keys[order], ids[order]
        first = np.r_[True, keys[1:] != keys[:-1]]
        least = ids[first][np.cumsum(first) - 1]
        edges = np.unique(np.stack([ids, least], 1)[ids != least], axis=0)
        part = edges[:, 0] % buckets
        edges = edges[np.argsort(part, kind="stable")]
        rows = [(int(edges[p[0], 0] % buckets), edges[p, 0].tobytes(), edges[p, 1].tobytes()) for p in by_bucket(np.sort(part))]
        return pd.DataFrame(rows, columns=["part", "x", "y"])

    return run


def distinct_pairs(frame: pd.DataFrame) -> pd.DataFrame:
    """The pairs that several buckets found, once."""
    pairs = np.stack([np.concatenate([np.frombuffer(v, np.int64) for v in frame[c]]) for c in ("x", "y")], 1)
    return pd.DataFrame(np.unique(pairs, axis=0), columns=["a", "b"])


def candidates(made: DataFrame, reps: DataFrame, percent: int, buckets: int) -> DataFrame:
    """(a, b): documents tied by a shared rare shingle, each to the smallest document of the shingle."""
    lists = made.where("kind = 1").select("chunk", "bucket", "x", "y").groupBy("bucket").applyInPandas(
        shared, "chunk long, bucket long, x binary, y binary, z binary"
    )
    one = made.where("kind = 0 AND n > 0").join(reps.select(F.col("rep").alias("doc_id")), "doc_id", "left_semi")
    both = lists.unionByName(one.select("chunk", "no", "doc_id", "n"), allowMissingColumns=True)
    keys = both.groupBy("chunk").applyInPandas(keys_of(percent), "bucket long, x binary, y binary")
    met = keys.groupBy("bucket").applyInPandas(meet(buckets), "part long, x binary, y binary")
    return met.groupBy("part").applyInPandas(distinct_pairs, "a long, b long")


class Index:
    """Inverted lists of a few sets; each list ascends by set number."""

    def __init__(self, sets: list[np.ndarray]):
        self.sizes = np.array([len(s) for s in sets], np.int64)
        owner = np.repeat(np.arange(len(sets)), self.sizes)
        _, token = np.unique(np.concatenate(sets), return_inverse=True)
        self.tokens = np.split(token, np.cumsum(self.sizes)[:-1])
        order = np.lexsort((owner, token))
        self.docs = owner[order]
        self.entries = token[order] * len(sets) + self.docs
        self.length = np.bincount(token)
        self.start = np.cumsum(self.length) - self.length

    def at_least(self, q: int, percent: int, use: np.ndarray) -> np.ndarray:
        """Sets before ``q`` that reach the similarity, of those that ``use`` marks."""
        own, size, count = self.tokens[q], self.sizes[q], len(self.sizes)
        need = -(-percent * size // 100)
        own = own[self.length[own] > 1]
        if len(own) < need:
            return np.zeros(0, np.int64)
        own = own[np.argsort(self.length[own], kind="stable")]
        longest = int(self.length[own[-1]])
        skipped = min(int(need / (SKIP * np.log2(longest) + 1)), need - 1, len(own) - 1)
        short, long = own[:len(own) - skipped], own[len(own) - skipped:]
        merged = self.docs[_spans(self.start[short], self.length[short])]
        hits = np.bincount(merged[merged < q], minlength=0)
        found = np.flatnonzero(hits >= max(need - skipped, 1))
        found = found[use[found] & (100 * np.minimum(self.sizes[found], size) >= percent * np.maximum(self.sizes[found], size))]
        if not len(found):
            return found
        total = hits[found]
        for lists in np.array_split(long, max(1, len(long) * len(found) // 1_000_000)):
            wanted = lists[:, None] * count + found[None, :]
            at = np.minimum(np.searchsorted(self.entries, wanted), len(self.entries) - 1)
            total = total + (self.entries[at] == wanted).sum(0)
        return found[100 * total >= percent * (size + self.sizes[found] - total)]


def _spans(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    ends = np.cumsum(length)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(start - (ends - length), length)


def linked(
    sets: list[np.ndarray], percent: int, copies: np.ndarray, cut: np.ndarray, across: bool
) -> tuple[list[tuple[int, int]], np.ndarray]:
    """Links that connect exactly what the links of similarity >= percent connect, and how many documents each
    set links with, of ``copies`` a set. Only pairs of different (``across``) or of equal cuts are compared."""
    index, group = Index(sets), np.arange(len(sets))
    links, number = [], np.zeros(len(sets), np.int64)
    for q in range(len(sets)):
        others = index.at_least(q, percent, (cut[:q] != cut[q]) == across)
        number[q] += copies[others].sum()
        number[others] += copies[q]
        for g in np.unique(group[others]).tolist():
            if g != group[q]:
                links.append((q, int(others[group[others] == g][0])))
                group[group == group[q]] = g
    return links, number


def classes(docs: DataFrame, n: int = 3, percent: int = 90) -> DataFrame:
    """Per row of ``docs``: doc_id, n_shingles, component_id (smallest doc_id reachable by links) and n_links
    (other documents of similarity >= percent, equal ones among them)."""
    rows = with_id(docs)
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(16, size // BUCKET_BYTES)
    made = settle_table(signatures(rows, n, buckets), "ngram-signatures")
    info = made.where("kind = 0").select("doc_id", "n", "d1", "d2")
    digest = ["n", "d1", "d2"]
    reps = settle(
        info.where("n > 0 AND doc_id IS NOT NULL").groupBy(*digest).agg(
            F.min("doc_id").alias("rep"), F.count_distinct("doc_id").alias("copies")
        )
    )
    blocks = components(candidates(made, reps, percent, buckets))
    members = blocks.join(reps.select(F.col("rep").alias("id"), "n", "copies"), "id")
    sizes = members.groupBy("component_id").agg(F.count(F.lit(1)).alias("m"), F.sum("n").alias("total")).where("m > 1")
    members = members.join(sizes, "component_id").withColumn("cuts", F.ceil(F.col("total") / BLOCK).cast("int"))
    cut = F.pmod(F.xxhash64("id"), F.col("cuts")).cast("int")
    members = members.withColumn("cut", cut).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("cuts") - 1)))
    whole = F.col("cuts") == 1
    tasks = members.select(
        F.col("id").alias("doc_id"), "copies", "cut",
        F.when(whole, F.pmod(F.xxhash64("component_id"), F.lit(buckets * 4))).otherwise(F.col("component_id")).alias("task"),
        whole.alias("whole"), F.least("cut", "other").alias("i"), F.greatest("cut", "other").alias("j"),
    )
    tasks = settle(tasks.groupBy("doc_id").agg(F.collect_list(F.struct("task", "whole", "i", "j", "cut", "copies")).alias("tasks")))

    def sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cache = WordHash()
        for batch in batches:
            yield pd.DataFrame({
                "doc_id": batch["doc_id"], "tasks": batch["tasks"], "s": [shingles(t, n, cache).tobytes() for t in batch["text"]]
            })

    task = "array<struct<task:bigint,whole:boolean,i:int,j:int,cut:int,copies:bigint>>"
    shipped = lookup_join(rows.where("doc_id IS NOT NULL"), tasks, ["doc_id"], spread_by=["doc_id"]).mapInPandas(
        released(sets), f"doc_id long, tasks {task}, s binary"
    ).select("doc_id", "s", F.explode("tasks").alias("t")).select("doc_id", "s", "t.*")

    def search(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.drop_duplicates(["doc_id", "s"])
        ids = frame["doc_id"].to_numpy()
        sets, copies, cut = [np.frombuffer(s, np.uint64) for s in frame["s"]], frame["copies"].to_numpy(), frame["cut"].to_numpy()
        # a pair of one cut is also in the cut's tasks with the others
        links, number = linked(sets, percent, copies, cut, bool(frame["i"].iloc[0] != frame["j"].iloc[0]))
        out = [(ids[a], ids[b], 0) for a, b in links] + [(v, v, c) for v, c in zip(ids, number, strict=True) if c]
        return pd.DataFrame(out, columns=["a", "b", "links"]).astype("int64")

    links = settle_table(
        shipped.groupBy("task", "whole", "i", "j").applyInPandas(search, "a long, b long, links long"), "ngram-links"
    )
    linked_to = components(links.select("a", "b")).select(F.col("id").alias("rep"), "component_id")
    counts = links.where("a = b").groupBy(F.col("a").alias("rep")).agg(F.sum("links").alias("links"))
    found = info.join(reps, digest, "left").join(linked_to, "rep", "left").join(counts, "rep", "left")
    known = F.col("doc_id").isNotNull()
    return found.select(
        "doc_id", F.col("n").alias("n_shingles"),
        F.when(known, F.coalesce("component_id", "rep", "doc_id")).alias("component_id"),
        F.when(known & F.col("rep").isNotNull(), F.coalesce("links", F.lit(0)) + F.col("copies") - 1).otherwise(0).cast("long").alias("n_links"),
    )
