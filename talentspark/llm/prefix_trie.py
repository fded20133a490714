"""The trie of conversation prefixes, built by cutting sequences at half depth.

Turns become 128-bit digests; texts are read once and never shuffled. A sequence is cut at half its depth, each
half again, and so on (the van Emde Boas layout): every aligned run of 2, 4, 8 ... turns gets a digest from its two
halves, and the name of a prefix is made from the runs that its cuts leave, so equal prefixes have equal names in
all conversations without comparing any two of them. Up to ``CHUNK`` turns of a conversation are named inside one task;
the names of whole chunks are the symbols of the next level, which is named the same way.

A node is a name with its smallest member; (smallest member, depth) identifies it. Totals are grafted upward over
the same cuts, all levels at once: a node below a cut counts for the one node just above that cut (the root of its
lower tree), whose sum then goes to the nodes above it in the upper tree. Each pair of an ancestor and a
descendant is parted by exactly one cut, so it is counted once, with a number of steps that grows with the
logarithm of the depth.

Names that many conversations share (a common first turn, the root) are counted by partial sums and joined by
a broadcast of those few names; ids of the conversations that end at a node are packed by ranges of ids and
hashed as a stream.

Edge cases: rows without a conversation id are left out; null role or text is empty, a null turn comes first;
rows of equal turn are ordered by their digests; repeated rows are turns of their own; other columns are ignored,
whatever their names; no conversations, no nodes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talentspark.llm.common import counted_join, mix, numbered
from talentspark.session import settle_table

CHUNK = 1024  # a power of two
ID_RANGE = 4096
SALTS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F], np.uint64)
ROOT = bytes(16)
NO_ENDS = hashlib.sha256(b"").hexdigest()


def turns(conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, pos, g, bytes): each turn's place, digest and bytes of text."""
    role, text = (F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in (role, text))
    whole = F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)
    rows = conversations.where(F.col(f"`{conv}`").isNotNull()).select(
        F.col(f"`{conv}`").cast("long").alias("conv_id"), F.col(f"`{turn}`").cast("long").alias("turn"),
        F.unhex(F.md5(whole)).alias("g"), F.octet_length(text).cast("long").alias("bytes"),
    )
    return numbered(rows, "conv_id", ["turn", "g"], "trie-turns").select("conv_id", "pos", "g", "bytes")


def rebuilt(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Conversations that start with the first turns of the first one of their group of five ids.

    Returns their turns (conv_id, depth, g, bytes) and the conversations (conv_id, depth), those without turns too.
    """
    rows = settle_table(rows, "trie-numbered")
    sizes = settle_table(rows.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n")), "trie-sizes")
    first = F.col("conv_id") - F.pmod("conv_id", F.lit(5))
    head = F.crc32(F.col("conv_id").cast("string")) % 9
    bases = sizes.where(F.pmod("conv_id", F.lit(5)) == 0).select(F.col("conv_id").alias("base"), F.col("n").alias("n_base"))
    convs = settle_table(
        sizes.withColumn("base", first).withColumn("h", head).join(bases, "base", "left")
        .select("conv_id", "n", "h", F.least("h", F.coalesce("n_base", F.lit(0))).alias("lent")), "trie-conversations",
    )
    own = counted_join(rows.where(F.col("pos") >= head), convs, ["conv_id"], "n").select(
        "conv_id", (F.col("pos") - F.col("h") + F.col("lent") + 1).alias("depth"), "g", "bytes"
    )
    lent = rows.where((F.pmod("conv_id", F.lit(5)) == 0) & (F.col("pos") < 8)).select(
        F.explode(F.sequence("conv_id", F.col("conv_id") + 4)).alias("conv_id"), (F.col("pos") + 1).alias("depth"), "g", "bytes"
    )
    lent = lent.where(F.col("depth") <= head).join(convs.select("conv_id"), "conv_id", "left_semi")
    ends = convs.select("conv_id", (F.col("lent") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("depth"))
    return own.unionByName(lent), ends


def paired(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Digests (two 64-bit lanes) of pairs of digests."""
    return mix(a + mix(b + SALTS))


def prefix_names(g: np.ndarray, p: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Names of the prefixes that end at each row: ``g`` digests, ``p`` places in the sequence, ``n`` its length.

    Rows of a sequence follow each other from place 0.
    """
    halves, size = [g], 1
    while size < (int(n.max()) if len(n) else 0):
        whole = np.flatnonzero((p % (2 * size) == 0) & (p + 2 * size <= n))
        runs = np.zeros_like(g)
        runs[whole] = paired(halves[-1][whole], halves[-1][whole + size])
        halves.append(runs)
        size *= 2
    start, length = np.arange(len(p)) - p, p + 1
    names, done = np.zeros_like(g), np.zeros_like(p)
    for k in range(len(halves) - 1, -1, -1):
        cut = np.flatnonzero(length >> k & 1)
        names[cut] = paired(names[cut], halves[k][start[cut] + done[cut]])
        done[cut] += 1 << k
    return names


def named(rows: DataFrame) -> DataFrame:
    """``rows`` (conv_id, depth from 1, g, bytes) with ``name``, which equal prefixes share."""
    size = CHUNK

    def each(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept = None

        def name(frame: pd.DataFrame) -> pd.DataFrame:
            conv, chunk = frame["conv_id"].to_numpy(), (frame["depth"].to_numpy() - 1) // size
            starts = np.flatnonzero(np.r_[True, (conv[1:] != conv[:-1]) | (chunk[1:] != chunk[:-1])])
            lengths = np.diff(np.r_[starts, len(frame)])
            g = np.frombuffer(b"".join(frame["g"]), np.uint64).reshape(-1, 2)
            names = prefix_names(g, np.arange(len(frame)) - np.repeat(starts, lengths), np.repeat(lengths, lengths))
            whole = names.tobytes()
            return frame.drop(columns="g").assign(name=[whole[i:i + 16] for i in range(0, len(whole), 16)])

        for frame in frames:
            frame = frame if kept is None else pd.concat([kept, frame], ignore_index=True)
            if not len(frame):
                continue
            # the last chunk may go on in the next batch
            conv, chunk = frame["conv_id"].to_numpy(), (frame["depth"].to_numpy() - 1) // size
            last = (conv == conv[-1]) & (chunk == chunk[-1])
            kept = frame[last].reset_index(drop=True)
            if not last.all():
                yield name(frame[~last])
        if kept is not None and len(kept):
            yield name(kept)

    chunk = F.floor((F.col("depth") - 1) / size)
    dealt = rows.repartition("conv_id", chunk).sortWithinPartitions("conv_id", "depth")
    inner = settle_table(dealt.mapInPandas(each, "conv_id long, depth long, bytes long, name binary"), "trie-names")
    if (inner.agg(F.max("depth")).first()[0] or 0) <= size:
        return inner
    wholes = inner.where(F.col("depth") % size == 0).select(
        "conv_id", (F.col("depth") / size).cast("long").alias("depth"), F.col("name").alias("g"), F.lit(0).cast("long").alias("bytes")
    )
    before = named(wholes).select("conv_id", F.col("depth").alias("chunk"), F.col("name").alias("before"))
    return inner.withColumn("chunk", chunk).join(before, ["conv_id", "chunk"], "left").select(
        "conv_id", "depth", "bytes", F.when(F.col("before").isNull(), F.col("name")).otherwise(F.unhex(F.md5(F.concat("before", "name")))).alias("name")
    )


def grafted(nodes: DataFrame, members: DataFrame, values: list[str]) -> DataFrame:
    """(conv_id, depth, values): the values of all nodes below each node, summed; nodes without any are left out.

    ``nodes`` holds (conv_id, depth, values), ``members`` the smallest member ``rep`` of every conversation's prefixes.
    """
    sums = [F.sum(v).alias(v) for v in values]

    def at_members(rows: DataFrame) -> DataFrame:
        return rows.join(members, ["conv_id", "depth"]).drop("conv_id").withColumnRenamed("rep", "conv_id")

    levels = F.expr("filter(sequence(0, 62), k -> shiftright(depth, k) % 2 = 1)")
    below = nodes.select("conv_id", "depth", F.explode(levels).alias("k"), *values)
    cut = F.expr("shiftleft(shiftright(depth, k), k) - 1")
    lower = at_members(below.withColumn("depth", cut).groupBy("conv_id", "depth", "k").agg(*sums))
    roots = lower.groupBy("conv_id", "depth", "k").agg(*sums)
    above = F.explode(F.expr("sequence(depth - shiftleft(1L, k) + 1, depth)"))
    upper = at_members(roots.select("conv_id", above.alias("depth"), *values))
    return upper.groupBy("conv_id", "depth").agg(*sums)


def ends_digest(ends: DataFrame) -> DataFrame:
    """(conv_id, depth, ends_sha256) of ``ends`` (id, conv_id, depth): the ids in order, hashed as a stream."""
    ids = F.array_join(F.transform(F.array_sort(F.collect_list("id")), lambda x: x.cast("string")), ",")
    packed = ends.groupBy("conv_id", "depth", F.floor(F.col("id") / ID_RANGE).alias("range")).agg(ids.alias("ids"))

    def each(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, digest = None, None

        def out() -> pd.DataFrame:
            return pd.DataFrame({"conv_id": [key[0]], "depth": [key[1]], "ends_sha256": [digest.hexdigest()]})

        for frame in frames:
            done = []
            for conv, depth, ids in zip(frame["conv_id"], frame["depth"], frame["ids"], strict=True):
                if (conv, depth) == key:
                    digest.update(b"," + ids.encode())
                    continue
                if key is not None:
                    done.append((*key, digest.hexdigest()))
                key, digest = (conv, depth), hashlib.sha256(ids.encode())
            yield pd.DataFrame(done, columns=["conv_id", "depth", "ends_sha256"])
        if key is not None:
            yield out()

    dealt = packed.repartition("conv_id", "depth").sortWithinPartitions("conv_id", "depth", "range")
    return dealt.mapInPandas(each, "conv_id long, depth long, ends_sha256 string")


def trie(rows: DataFrame, conversations: DataFrame) -> DataFrame:
    """The nodes of ``rows`` (conv_id, depth, g, bytes); ``conversations`` (conv_id, depth) names all of them with their numbers of turns."""
    zero = F.lit(0).cast("long")
    root = conversations.select("conv_id", zero.alias("depth"), zero.alias("bytes"), F.lit(ROOT).alias("name"))
    prefixes = settle_table(named(rows).unionByName(root), "trie-prefixes")
    names = settle_table(
        prefixes.groupBy("depth", "name").agg(F.min("conv_id").alias("rep"), F.count(F.lit(1)).alias("n_convs"), F.max("bytes").alias("bytes")),
        "trie-nodes",
    )
    members = settle_table(
        counted_join(prefixes.drop("bytes"), names.drop("bytes"), ["depth", "name"], "n_convs").select("conv_id", "depth", "rep"), "trie-members"
    )
    nodes = names.select(F.col("rep").alias("conv_id"), "depth", "n_convs", "bytes")
    up = members.select("conv_id", (F.col("depth") + 1).alias("depth"), F.col("rep").alias("parent_conv_id"))
    nodes = nodes.join(up, ["conv_id", "depth"], "left")
    children = nodes.where("depth > 0").groupBy(F.col("parent_conv_id").alias("conv_id"), (F.col("depth") - 1).alias("depth")).agg(
        F.count(F.lit(1)).alias("n_children")
    )
    nodes = nodes.join(children, ["conv_id", "depth"], "left").fillna(0, ["n_children"])
    nodes = settle_table(nodes.select(
        "*", (F.col("n_children") == 0).cast("long").alias("leaves"), ((F.col("n_convs") - 1) * F.col("bytes")).alias("saved")
    ), "trie-own")
    sums = grafted(nodes, members, ["leaves", "saved"]).withColumnsRenamed({"leaves": "leaves_below", "saved": "saved_below"})
    ends = conversations.join(members, ["conv_id", "depth"]).select(F.col("conv_id").alias("id"), F.col("rep").alias("conv_id"), "depth")
    whole = nodes.join(sums, ["conv_id", "depth"], "left").join(ends_digest(ends), ["conv_id", "depth"], "left")
    return whole.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children",
        (F.col("leaves") + F.coalesce("leaves_below", zero)).alias("n_leaves"),
        (F.col("saved") + F.coalesce("saved_below", zero)).alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(NO_ENDS)).alias("ends_sha256"),
    )


def report(conversations: DataFrame) -> DataFrame:
    """The trie of the rebuilt conversations."""
    return trie(*rebuilt(turns(conversations)))
