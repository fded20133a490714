"""Repair of conversations against a plain search over all edits, turn by turn."""

import hashlib
import random
import re
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from talentspark.llm import repair

SCHEMA = "conv_id long, turn long, role string, text string, conv string, g string, kind string, audit string"
NAMES = {"u": "user", "a": "assistant"}


def legal(roles):
    return re.fullmatch("(s?(ua)+)?", roles) is not None


def hopeful(roles):
    """Whether the roles can still be completed."""
    return re.fullmatch("(s?(ua)*u?)?", roles) is not None


def cheapest(turns):
    """(cost, audit, output) over all edits: dynamic programming on (turns used, last roles), every equal-cost audit kept apart."""
    def inserts(states):
        for _ in range(3):
            new = dict(states)
            for roles, (cost, audit, out) in states.items():
                for r in "ua":
                    if hopeful(roles + r):
                        keep(new, roles + r, (cost + 2, audit + "I", (*out, (NAMES[r], ""))))
            states = new
        return states

    def keep(states, roles, label):
        key = roles if len(roles) < 2 else roles[:1].replace("u", "") + ("ua" if roles[-1] == "a" else "u")
        if key not in states or label < states[key]:
            states[key] = label

    states = inserts({"": (0, "", ())})
    for role, text, fault in turns:
        new = {}
        for roles, (cost, audit, out) in states.items():
            keep(new, roles, (cost + 3, audit + "D", out))
            if fault in ("", "truncated"):
                more = 1 if fault else 0
                if role[:1] in ("s", "u", "a") and hopeful(roles + role[0]):
                    keep(new, roles + role[0], (cost + more, audit + "K", (*out, (role, text))))
                for r in "ua":
                    if hopeful(roles + r):
                        keep(new, roles + r, (cost + 2 + more, audit + "R", (*out, (NAMES[r], text))))
        states = inserts(new)
    return min(label for roles, label in states.items() if legal(roles))


def plain(rows):
    damaged, out = {c: [] for c, *_ in rows}, []
    for c, turn, role, text in rows:
        key = ":".join(" " if v is None else str(v) for v in (c, turn))
        role, text, fault = " " if role is None else role, " " if text is None else text, zlib.crc32(key.encode()) % 20
        if fault:
            text = "" if fault == 1 else re.sub("[.!?]", "", text) if fault == 2 else text
            damaged[c] += [(turn, "user" if fault == 4 else role, text)] * (2 if fault == 3 else 1)
    for c, some in damaged.items():
        some.sort(key=lambda r: (r[0] is not None, r[0] or 0, hashlib.md5(f"{len(r[1].encode())}:{r[1]}{r[2]}".encode()).digest()))
        turns, seen = [], set()
        for _, role, text in some:
            core = text.rstrip(repair.SPACE)
            fault = "blank" if not core else "duplicate" if (role, text) in seen else "" if core[-1] in ".!?" else "truncated"
            seen.add((role, text))
            turns.append((role, text, fault))
        known = {t for t, *_ in some if t is not None}
        faults = [t[2] for t in turns]
        pairs = [a[0][:1] + b[0][:1] for a, b in zip(turns, turns[1:])]
        cost, audit, kept = cheapest(turns)
        out.append((
            c, max(known) - min(known) + 1 - len(known) if known else 0, faults.count("blank"), faults.count("duplicate"), faults.count("truncated"),
            sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, hashlib.sha256("\n".join(f"{r}:{t}" for r, t in kept).encode()).hexdigest(),
        ))
    return sorted(out, key=repr)


def got(spark, rows, before=repair.damage):
    frame = spark.createDataFrame([(*r, "c", "g", "k", "a") for r in rows], SCHEMA)
    return sorted((tuple(r) for r in repair.report(frame, before).collect()), key=repr)


def talk(rng, n_convs):
    rows = []
    for c in range(n_convs):
        for i in range(rng.choice([1, 2, 5, 8])):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", None, ""])
            text = rng.choice(["Yes.", "no", "What?", "", " \n\x0b", None, "\xa0", "ends. ", "é!\n", f"own {i}."])
            rows.append((c, None if rng.random() < 0.05 else i * rng.choice([1, 1, 2]), role, text))
    rows += [(None, 0, "user", "Hi."), (None, 1, "assistant", "Ho."), (1 << 60, None, "user", "x")]
    rows += [(77_000, i, rng.choice(["user", "assistant"]), f"turn {i}" + rng.choice([".", ""])) for i in range(700)]
    rows += [(77_001, i, "system", "same.") for i in range(300)] + rows[:4]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("segment", [3, 256])
def test_report_equals_dynamic_programming(spark, monkeypatch, segment):
    monkeypatch.setattr(repair, "SEGMENT", segment)
    rows = talk(random.Random(segment), 120)
    assert got(spark, rows) == plain(rows)


def test_no_rows(spark):
    assert got(spark, []) == []
    # crc32("0:3") % 20 is 0: the only turn goes, the conversation stays
    lost = next(t for t in range(1000) if zlib.crc32(f"0:{t}".encode()) % 20 == 0)
    assert got(spark, [(0, lost, "user", "Hi.")]) == [(0, 0, 0, 0, 0, 0, 0, "", repair.NO_TEXT)]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.tuples(st.sampled_from("sua?"), st.sampled_from("0012333")), max_size=12))
def test_search_finds_the_least_audit(turns):
    faults = {"0": "", "1": "blank", "2": "duplicate", "3": "truncated"}
    want = cheapest([(r if r != "?" else "tool", str(i), faults[f]) for i, (r, f) in enumerate(turns)])
    assert repair.search("".join(r + f for r, f in turns)) == want[:2]
