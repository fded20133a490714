"""Secrets against a plain search of each text and plain counts of owners."""

import collections
import hashlib
import random
import re

from hypothesis import given, settings
from hypothesis import strategies as st

from talentspark.llm import secrets

SCHEMA = "doc_id long, text string, source string, kind string, row string, value binary"
KEYED = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)


def plain(text):
    """Spans and values of the three fixed kinds, as the contract words them."""
    out = [(m.start(), 0, m.end(), m[2]) for m in KEYED.finditer(text) if len(m[2]) >= 8]
    out += [(m.start(), 1, m.end(), m[0]) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    out += [(m.start(), 2, m.end(), m[0]) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
    return sorted(out)


def plain_tokens(text, base):
    """Bare tokens with a letter and a digit that touch no fixed span."""
    for m in re.finditer(r"[A-Za-z0-9+/_=-]+", text):
        v = m[0]
        if len(v) >= 8 and re.search("[0-9]", v) and re.search("[A-Za-z]", v):
            if not any(s < m.end() and m.start() < e for s, _, e, _ in base):
                yield m.start(), 3, m.end(), v


def joined(found):
    return ",".join(f"{secrets.KINDS[k]}:{s}:{e}" for s, k, e in found)


def plain_report(rows):
    owners, assigned, all_spans = collections.defaultdict(set), set(), []
    for _, text, source in rows:
        base = plain(text or "")
        found = sorted(base + list(plain_tokens(text or "", base)))
        all_spans.append(found)
        for _, k, _, v in found:
            owners[v].add(source)
            if k < 3:
                assigned.add(v)
    out = []
    for (doc_id, _, _), found in zip(rows, all_spans, strict=True):
        def verdict(v):
            alive = len(v) >= 20 and len(set(v)) >= 10 and not secrets.PLACEHOLDER.search(v)
            return "example" if len(owners[v]) >= 3 else "live" if alive and len(owners[v]) == 1 else "unclear"
        kept = [(s, k, e, v) for s, k, e, v in found if k < 3 or verdict(v) == "live" or v in assigned and verdict(v) != "example"]
        base = joined([x[:3] for x in kept if x[1] < 3])
        n = collections.Counter(x[1] for x in kept)
        m = collections.Counter(verdict(x[3]) for x in kept)
        out.append((
            doc_id, n[0], n[1], n[2], n[3], hashlib.sha256(base.encode()).hexdigest(), joined([x[:3] for x in kept]), m["live"], m["example"],
        ))
    return sorted(out, key=repr)


def texts():
    rng = random.Random(3)
    values = ["".join(rng.choice("abcdefghkmnpqrstABCDEFGHJK23456789") for _ in range(rng.choice([8, 12, 24, 40]))) for _ in range(30)]
    hexes = ["".join(rng.choice("0123456789abcdef") for _ in range(n)) for n in (31, 32, 40, 64)]
    ids = ["AKIA" + "".join(rng.choice("ABCDEFGH234567") for _ in range(n)) for n in (11, 12, 16)]
    forms = ["token = \"{}\"", "API_KEY:'{}'", "the Secret={}", "passwd : {}", "{}", "see {}, é{}", "{}{}"]
    out = []
    for _ in range(150):
        parts = [rng.choice(forms).format(*[rng.choice(values + hexes + ids)] * 2) for _ in range(rng.randrange(4))]
        out.append(" äöü ".join(["prose with no digits:", *parts, "2024-01-02", "end="]))
    return [*out, None, "", " \n", "password: token: abcdefghijk", "x" * 60_000, "a1" * 30_000, "ſecret=abcdefghi1", "toKen=abcdefghi1", "AKIA" * 8]


def test_report_equals_a_plain_search_and_plain_counts(spark):
    rng = random.Random(4)
    rows = [(i, t, rng.choice(["a", "a", "a", "b", "c", "d", None])) for i, t in enumerate(texts())]
    rows += rows[:3] + [(None, "token=\"ownvalue77\"", "z"), (None, "again ownvalue77.", "y")]
    docs = spark.createDataFrame([(i, t, s, "k", "r", b"v") for i, t, s in rows], SCHEMA)
    got = sorted((tuple(r) for r in secrets.report(docs).collect()), key=repr)
    assert got == plain_report(rows)
    assert sum(r[4] for r in got) and sum(r[7] for r in got) and sum(r[8] for r in got)


def test_no_rows_no_report(spark):
    assert secrets.report(spark.createDataFrame([], SCHEMA)).collect() == []


@settings(max_examples=300, deadline=None)
@given(st.text(st.sampled_from("tokensecret_=:'\" AKI0123fgéZ"), max_size=120))
def test_spans_of_any_text(text):
    base = plain(text)
    assert secrets.spans(text) == sorted(base + list(plain_tokens(text, base)))
