"""Conversation structure repair: the cheapest edits that make roles alternate and drop empty or repeated turns.

A conversation is a walk through a lattice of (turns used up, state of the grammar ``(s?(ua)+)?``) whose steps are
Keep, Rerole, Delete and Insert. A forward heap from the start and a reverse heap from the accepting ends meet;
crossings of equal cost are all finished, and the least audit (initials of the edits) among them wins. Audits of
equal cost that lead to one place of the lattice are never prefixes of each other, since an audit alone
fixes its walk; so the least audit of a whole is made of least parts, and parts can be searched apart.

That is how long conversations are worked on: turns are numbered by ranges (``common.numbered``), each run of
``SEGMENT`` turns is searched between every two states by whatever task holds it, and only the costs and audits of
runs are put together per conversation. The texts are read twice and shuffled once, for the digest of the
repaired conversation, which by its definition reads them in order: they pass through as a stream, with
nothing held but the audit.

Edge cases: null roles and texts are one space each, a null turn sorts first and does not count for gaps; rows of
equal turn are ordered by their digests; an empty role, like any other that does not begin with s, u or a, has
to be changed or deleted; rows with a null id are a conversation of their own; conversations that lost all rows give zeros, an
empty audit and the digest of an empty text; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Callable, Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talentspark.llm.common import counted_join, numbered
from talentspark.session import settle_table

SEGMENT = 256
CACHED = 50_000
SPACE = " \t\n\x0b\x0c\r"
DELETE, INSERT, REROLE, TRUNCATED = 3, 2, 2, 1  # costs
START, SYSTEM, USER, ASSISTANT = range(4)  # states: what came last
ENDS = (START, ASSISTANT)
STEP = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
LEGAL = {"su", "ua", "au"}
NO_TEXT = hashlib.sha256(b"").hexdigest()

Place = tuple[int, int]


def moves(turns: str, state: int, i: int) -> Iterator[tuple[int, str, int, int]]:
    """(cost, edit, state, turns used) after each edit of turn ``i`` in ``state``; a turn is its role's initial and a digit: its fault."""
    n = len(turns) // 2
    if i < n:
        initial, fault = turns[2 * i], turns[2 * i + 1]
        yield DELETE, "D", state, i + 1
        if fault in "03":
            extra = TRUNCATED if fault == "3" else 0
            if (state, initial) in STEP:
                yield extra, "K", STEP[state, initial], i + 1
            for role in "ua":
                if role != initial and (state, role) in STEP:
                    yield REROLE + extra, "R", STEP[state, role], i + 1
    for role in "ua":
        if (state, role) in STEP:
            yield INSERT, "I", STEP[state, role], i


def moves_back(turns: str, state: int, i: int) -> Iterator[tuple[int, str, int, int]]:
    """The edits that lead to ``state`` with ``i`` turns used: (cost, edit, state before, turns used before)."""
    for before in range(4):
        for at in (i - 1, i):
            if at >= 0:
                for cost, edit, state_after, used in moves(turns, before, at):
                    if (state_after, used) == (state, i):
                        yield cost, edit, before, at


@lru_cache(maxsize=CACHED)
def search(turns: str, start: int = START, ends: tuple[int, ...] = ENDS) -> tuple[int, str] | None:
    """Cost and least audit of the cheapest edits from ``start`` to one of ``ends`` over all turns."""
    n = len(turns) // 2
    # without steps there is nothing to cross
    best: tuple[int, str] | None = (0, "") if n == 0 and start in ends else None
    # a heap orders by cost, then so that free steps (Keep) come after what they start from, then by audit
    ahead, back = [(0, 0, "", start)], [(0, -n, "", end) for end in ends]
    heapq.heapify(back)
    seen: dict[Place, tuple[int, str]] = {}
    seen_back: dict[Place, tuple[int, str]] = {}
    while ahead and back and (best is None or ahead[0][0] + back[0][0] <= best[0]):
        if ahead[0][0] <= back[0][0]:
            cost, i, audit, state = heapq.heappop(ahead)
            if (i, state) in seen:
                continue
            seen[i, state] = cost, audit
            for more, edit, after, at in moves(turns, state, i):
                if (at, after) in seen_back:
                    rest, tail = seen_back[at, after]
                    crossing = cost + more + rest, audit + edit + tail
                    best = crossing if best is None else min(best, crossing)
                if (at, after) not in seen:
                    heapq.heappush(ahead, (cost + more, at, audit + edit, after))
        else:
            cost, i, tail, state = heapq.heappop(back)
            i = -i
            if (i, state) in seen_back:
                continue
            seen_back[i, state] = cost, tail
            for more, edit, before, at in moves_back(turns, state, i):
                if (at, before) in seen:
                    spent, audit = seen[at, before]
                    crossing = spent + more + cost, audit + edit + tail
                    best = crossing if best is None else min(best, crossing)
                if (at, before) not in seen_back:
                    heapq.heappush(back, (cost + more, -at, edit + tail, before))
    return best


def damage(rows: DataFrame) -> DataFrame:
    """Faults of (conv_id, turn, role, text) rows, chosen by their ids."""
    key = F.concat_ws(":", *(F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")))
    fault = F.col("_fault")
    text = F.when(fault == 1, "").when(fault == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    copies = F.array_repeat(F.lit(0), F.when(fault == 3, 2).otherwise(1))
    return rows.withColumn("_fault", F.crc32(key) % 20).where(fault != 0).select(
        "conv_id", "turn", F.when(fault == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), F.explode(copies).alias("_copy")
    ).drop("_copy")


def classified(rows: DataFrame) -> DataFrame:
    """(conv, turn, g, initial, blank, open): the rows without their texts."""
    core = F.rtrim("text", F.lit(SPACE))
    initial = F.substring("role", 1, 1)
    return rows.select(
        "conv", "turn", "g", F.when(initial.isin("s", "u", "a"), initial).otherwise("?").alias("initial"),
        (core == "").alias("blank"), (~F.right(core, F.lit(1)).isin(".", "!", "?")).alias("open"),
    )


def with_faults(rows: DataFrame) -> DataFrame:
    """The numbered rows with ``fault``: 0 none, 1 blank, 2 duplicate, 3 truncated."""
    rows = settle_table(numbered(rows, "conv", ["turn", "g"], "repair-turns"), "repair-numbered")
    firsts = rows.groupBy("conv", "g").agg(F.min("pos").alias("first"), F.count(F.lit(1)).alias("n"))
    rows = counted_join(rows, settle_table(firsts, "repair-firsts"), ["conv", "g"], "n")
    fault = F.when(F.col("blank"), 1).when(F.col("pos") > F.col("first"), 2).when(F.col("open"), 3).otherwise(0)
    return rows.select("conv", "turn", "pos", "initial", fault.alias("fault"))


def runs(rows: DataFrame) -> DataFrame:
    """(conv, run, turns, ways): runs of ``SEGMENT`` turns and their cheapest edits between every two states (a number
    of a pair of states, cost, audit); a conversation of a single run needs only those from start to end, number -1."""
    def each(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            ways = []
            for turns, alone in zip(frame["turns"], frame["alone"], strict=True):
                if alone:
                    ways.append([(-1, *search(turns))])
                    continue
                pairs = [(a * 4 + b, search(turns, a, (b,))) for a in range(4) for b in range(4)]
                ways.append([(p, *found) for p, found in pairs if found is not None])
            yield frame.drop(columns="alone").assign(ways=ways)

    run = F.floor(F.col("pos") / SEGMENT).cast("long").alias("run")
    listed = F.sort_array(F.collect_list(F.struct("pos", F.concat("initial", "fault").alias("code"))))
    # how long a conversation is shows in the next run: a run with a successor, or not the first, is not alone
    packed = rows.groupBy("conv", run).agg(F.array_join(F.transform(listed, lambda x: x["code"]), "").alias("turns"))
    longer = packed.where("run > 0").select("conv").distinct().withColumn("longer", F.lit(True))
    packed = packed.join(longer, "conv", "left").select("conv", "run", "turns", F.col("longer").isNull().alias("alone"))
    return packed.mapInPandas(each, "conv string, run long, turns string, ways array<struct<pair:int,cost:long,audit:string>>")


def folded(parts: DataFrame) -> DataFrame:
    """(conv, illegal, cost, audit) of the runs put together in order."""
    def illegal(turns: str) -> int:
        roles = turns[::2]
        return sum(roles[i:i + 2] not in LEGAL for i in range(len(roles) - 1))

    def each(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        conv, labels, bad, last = None, {}, 0, ""

        def result() -> tuple:
            return conv, bad, *min(labels[s] for s in ENDS if s in labels)

        for frame in frames:
            done = []
            for c, turns, ways in zip(frame["conv"], frame["turns"], frame["ways"], strict=True):
                if c != conv:
                    if conv is not None:
                        done.append(result())
                    conv, labels, bad, last = c, {START: (0, "")}, 0, ""
                bad += illegal(last + turns)
                last, after = turns[-2:], {}
                for way in ways:
                    pair, cost, audit = way["pair"], int(way["cost"]), way["audit"]
                    before, state = (START, ASSISTANT) if pair < 0 else divmod(pair, 4)
                    if before in labels:
                        label = labels[before][0] + cost, labels[before][1] + audit
                        after[state] = min(after.get(state, label), label)
                labels = after
            yield pd.DataFrame(done, columns=["conv", "illegal", "cost", "audit"])
        if conv is not None:
            yield pd.DataFrame([result()], columns=["conv", "illegal", "cost", "audit"])

    dealt = parts.repartition("conv").sortWithinPartitions("conv", "run")
    return dealt.mapInPandas(each, "conv string, illegal long, cost long, audit string")


class Repaired:
    """The digest of one conversation as its turns pass by."""

    def __init__(self, audit: str):
        self.audit, self.at, self.state, self.digest = audit, 0, START, hashlib.sha256()
        self.empty = True

    def emit(self, role: str, text: str) -> None:
        self.state = STEP[self.state, role[0]]
        self.digest.update(("" if self.empty else "\n").encode() + f"{role}:{text}".encode())
        self.empty = False

    def due(self) -> str:
        return "assistant" if self.state == USER else "user"

    def insert(self) -> None:
        while self.audit[self.at:self.at + 1] == "I":
            self.emit(self.due(), "")
            self.at += 1

    def add(self, role: str, text: str) -> None:
        self.insert()
        edit = self.audit[self.at]
        self.at += 1
        if edit != "D":
            self.emit(role if edit == "K" else self.due(), text)

    def sha256(self) -> str:
        self.insert()
        return self.digest.hexdigest()


def digests(rows: DataFrame, audits: DataFrame) -> DataFrame:
    """(conv, repaired_sha256) of the texts, edited as ``audits`` (conv, audit) say."""
    def each(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        conv, talk = None, None
        for frame in frames:
            done = []
            for c, audit, role, text in zip(frame["conv"], frame["audit"], frame["role"], frame["text"], strict=True):
                if c != conv:
                    # an audit comes before the texts
                    if conv is not None:
                        done.append((conv, talk.sha256()))
                    conv, talk = c, Repaired(audit)
                else:
                    talk.add(role, text)
            yield pd.DataFrame(done, columns=["conv", "repaired_sha256"])
        if conv is not None:
            yield pd.DataFrame([(conv, talk.sha256())], columns=["conv", "repaired_sha256"])

    first = audits.select("conv", F.lit(0).alias("kind"), "audit")
    both = rows.select("conv", "turn", "g", "role", "text", F.lit(1).alias("kind")).unionByName(first, allowMissingColumns=True)
    dealt = both.repartition("conv").sortWithinPartitions("conv", "kind", "turn", "g").select("conv", "audit", "role", "text")
    return dealt.mapInPandas(each, "conv string, repaired_sha256 string")


def report(
    conversations: DataFrame, before: Callable[[DataFrame], DataFrame] | None = None,
    conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
) -> DataFrame:
    """Faults, cheapest edits and the digest of the repaired texts of each conversation; ``before`` may change
    the rows first, conversations that it empties are still returned."""
    space = F.lit(" ")
    rows = conversations.select(
        F.col(f"`{conv}`").alias("conv_id"), F.col(f"`{turn}`").cast("long").alias("turn"),
        *(F.coalesce(F.col(f"`{c}`").cast("string"), space).alias(n) for c, n in ((role, "role"), (text, "text"))),
    )
    key = F.when(F.col("conv_id").isNull(), "").otherwise(F.concat(F.lit(":"), F.col("conv_id").cast("string"))).alias("conv")
    ids = rows.select(key).distinct()
    rows = before(rows) if before else rows
    digest = F.unhex(F.md5(F.concat(F.octet_length("role").cast("string"), F.lit(":"), "role", "text")))
    rows = rows.select(key, "turn", "role", "text", digest.alias("g"))
    found = settle_table(with_faults(classified(rows)), "repair-faults")
    counts = found.groupBy("conv").agg(
        F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn"), F.lit(0)).alias("gaps"),
        *(F.count(F.when(F.col("fault") == k, 1)).alias(n) for k, n in ((1, "blank"), (2, "duplicate"), (3, "truncated"))),
    )
    edits = settle_table(folded(settle_table(runs(found), "repair-runs")), "repair-edits")
    whole = ids.join(counts, "conv", "left").join(edits, "conv", "left").join(digests(rows, edits.select("conv", "audit")), "conv", "left")
    numbers = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    kind = conversations.schema[conv].dataType
    return whole.select(
        F.when(F.col("conv") != "", F.substr("conv", F.lit(2))).cast(kind).alias(conv),
        *(F.coalesce(n, F.lit(0)).cast("long").alias(n) for n in numbers),
        F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(NO_TEXT)).alias("repaired_sha256"),
    )
