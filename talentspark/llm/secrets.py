"""Secrets in texts: fixed patterns, and how many owners hold a value corpus-wide.

Every text is scanned for three kinds of its own (assignments of passwords and keys, access ids, long
hexadecimal runs) and for bare tokens of letters and digits. The values' hashes are then counted over the
whole corpus by distinct owners and repositories. A value that many owners hold is a copied example; one that
a single owner holds and that looks alive (long, many different characters, no placeholder) is reported as
a span of kind ``owned`` even without a key word beside it, and so is a bare occurrence of a value that some
other text assigns to a key word, unless it is a copied example. Spans of the fixed patterns always stay.

Texts are read by one pass in Python, which leaves only the spans and 128-bit hashes; counts go through
partial sums over (value, owner, repository), so a value in a third of all texts is a few rows per task.

Edge cases: a null text is empty; texts without a span give zero counts and the hash of an empty string; a null
owner (or repository) is one owner of its own; each input row gives one row, repeated rows and null ids
included; an empty table gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talentspark.llm.common import counted_join
from talentspark.session import settle_table, spread

# fixed values: the patterns and least lengths of the contract
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")  # a run of 32 is found where `[0-9a-f]+` finds it
KINDS = ["assign", "access", "hex", "owned"]
MIN_ASSIGN, MIN_ACCESS = 8, 16

# a maximal run of token characters with a digit in it
BARE = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z+/_=-]*+[0-9][A-Za-z0-9+/_=-]*+")
LETTER = re.compile(r"[A-Za-z]")
MIN_BARE, MIN_LIVE, MIN_DISTINCT = 8, 20, 10
PLACEHOLDER = re.compile(r"example|sample|dummy|changeme|placeholder|your|test|xxxx|0000|1234", re.IGNORECASE | re.ASCII)
SHARED_OWNERS = 3  # a value of so many owners is a copied example

SPAN = "struct<start:long,kind:int,end:long,value:binary,live:boolean>"


def spans(text: str) -> list[tuple[int, int, int, str]]:
    """(start, kind, end, value) of the fixed patterns, and of bare tokens (kind 3) outside of them."""
    found = []
    if ":" in text or "=" in text:
        found += [(m.start(), 0, m.end(), m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= MIN_ASSIGN]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end(), m[0]) for m in ACCESS.finditer(text) if len(m[0]) >= MIN_ACCESS]
    found += [(m.start(), 2, m.end(), m[0]) for m in HEX.finditer(text)]
    found.sort()
    bare, at, reach = [], 0, 0
    for m in BARE.finditer(text):
        if m.end() - m.start() < MIN_BARE or not LETTER.search(m[0]):
            continue
        while at < len(found) and found[at][0] < m.end():
            reach, at = max(reach, found[at][2]), at + 1
        if reach <= m.start():
            bare.append((m.start(), 3, m.end(), m[0]))
    return sorted(found + bare)


def looks_alive(value: str) -> bool:
    return len(value) >= MIN_LIVE and len(set(value)) >= MIN_DISTINCT and not PLACEHOLDER.search(value)


def scan(docs: DataFrame, id_col: str, text_col: str, owner_col: str, repo_col: str) -> DataFrame:
    """(row, doc_id, owner, repo, found): each input row with its spans; ``row`` numbers the rows."""

    def each(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            yield pd.Series([
                [(s, k, e, hashlib.md5(v.encode()).digest(), looks_alive(v)) for s, k, e, v in spans(t)] for t in batch.fillna("")
            ])

    found = F.pandas_udf(each, f"array<{SPAN}>")
    named = spread(docs.select(*(
        F.col(f"`{c}`").alias(n) for c, n in ((id_col, "doc_id"), (owner_col, "owner"), (repo_col, "repo"), (text_col, "text"))
    )))
    # the numbers of rows are fixed by writing the table
    return settle_table(
        named.select(F.monotonically_increasing_id().alias("row"), "doc_id", "owner", "repo", found("text").alias("found")), "secret-spans"
    )


def candidates(scanned: DataFrame) -> DataFrame:
    """One row per span."""
    return scanned.select("row", "doc_id", "owner", "repo", F.explode("found").alias("s")).select("row", "doc_id", "owner", "repo", "s.*")


def ownership(spans_of_rows: DataFrame) -> DataFrame:
    """(value, n, n_assigned, n_repos, n_owners): occurrences, those in a fixed pattern, distinct repositories and owners."""
    total = [F.sum(c).alias(c) for c in ("n", "n_assigned")]
    repos = spans_of_rows.groupBy("value", "owner", "repo").agg(
        F.count(F.lit(1)).alias("n"), F.sum((F.col("kind") < 3).cast("long")).alias("n_assigned")
    )
    owners = repos.groupBy("value", "owner").agg(*total, F.count(F.lit(1)).alias("n_repos"))
    return owners.groupBy("value").agg(*total, F.sum("n_repos").alias("n_repos"), F.count(F.lit(1)).alias("n_owners"))


def judged(spans_of_rows: DataFrame) -> DataFrame:
    """The spans with the counts of their values and ``verdict``: ``example`` (many owners), ``live`` (one owner,
    looks alive) or ``unclear``; ``kept`` is false for bare tokens that are neither live nor assigned elsewhere."""
    values = settle_table(ownership(spans_of_rows), "secret-values")
    rows = counted_join(spans_of_rows, values, ["value"], "n")
    verdict = (
        F.when(F.col("n_owners") >= SHARED_OWNERS, "example")
        .when((F.col("n_owners") == 1) & F.col("live"), "live").otherwise("unclear")
    )
    kept = F.expr("kind < 3 OR verdict = 'live' OR (n_assigned > 0 AND verdict <> 'example')")
    return rows.withColumn("verdict", verdict).withColumn("kept", kept)


def listed(column: str | F.Column) -> F.Column:
    """``kind:start:end`` of the spans, joined by commas."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(column, lambda s: F.concat_ws(
        ":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string")
    )), ",")


def report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source", repo_col: str = "doc_id") -> DataFrame:
    """Each row's numbers of spans by kind, the digest of the fixed ones, all spans, and how many look live or are copied examples."""
    scanned = scan(docs, id_col, text_col, owner_col, repo_col)
    found = judged(candidates(scanned))
    # a row's spans are at most what its own text holds
    kept = F.collect_list(F.when(F.col("kept"), F.struct("start", "kind", "end", "verdict")))
    rows = found.groupBy("row", "doc_id").agg(F.sort_array(kept).alias("spans"))
    nothing = F.array().cast("array<struct<start:long,kind:int,end:long,verdict:string>>")
    without = scanned.where(F.size("found") == 0).select("row", "doc_id", nothing.alias("spans"))

    def n(test) -> F.Column:
        return F.size(F.filter("spans", test)).cast("long")

    def of_kind(k: int):
        return lambda s: s["kind"] == k

    return rows.unionByName(without).select(
        "doc_id",
        *(n(of_kind(k)).alias(f"n_{KINDS[k]}") for k in range(4)),
        F.sha2(listed(F.filter("spans", lambda s: s["kind"] < 3)).cast("binary"), 256).alias("base_sha256"),
        listed("spans").alias("spans"),
        n(lambda s: s["verdict"] == "live").alias("n_live"),
        n(lambda s: s["verdict"] == "example").alias("n_example"),
    )
