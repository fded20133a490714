"""The prefix trie against dictionaries of whole prefixes."""

import collections
import hashlib
import random
import zlib

import numpy as np
import pytest

from talentspark.llm import prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string, depth string, name string, g string"


def plain(rows):
    own = collections.defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            digest = hashlib.md5(f"{len(role.encode())}:{role}{text}".encode()).digest()
            own[c].append((turn is not None, turn or 0, digest, role, text))
    own = {c: [t[3:] for t in sorted(v)] for c, v in own.items()}
    heads = {c: zlib.crc32(str(c).encode()) % 9 for c in own}
    built = {c: tuple(own.get(c - c % 5, [])[:heads[c]] + own[c][heads[c]:]) for c in own}
    members = collections.defaultdict(list)
    for c in sorted(built):
        for d in range(len(built[c]) + 1):
            members[built[c][:d]].append(c)
    children, leaves, saved = collections.Counter(), collections.Counter(), collections.Counter()
    for node in members:
        children[node[:-1]] += bool(node)
    for node, some in members.items():
        for d in range(len(node) + 1):
            leaves[node[:d]] += not children[node]
            saved[node[:d]] += (len(some) - 1) * (len(node[-1][1].encode()) if node else 0)
    return sorted(
        (some[0], len(node), members[node[:-1]][0] if node else -1, len(some), children[node], leaves[node], saved[node],
         hashlib.sha256(",".join(str(c) for c in some if len(built[c]) == len(node)).encode()).hexdigest())
        for node, some in members.items()
    )


def got(spark, rows):
    frame = spark.createDataFrame([(*r, "d", "n", "g") for r in rows], SCHEMA)
    return sorted(tuple(-1 if v is None else v for v in r) for r in prefix_trie.report(frame).collect())


def talk(rng, n_convs):
    rows, earlier = [], [[("system", "be kind"), ("user", "hé"), ("assistant", "")]]
    for c in range(n_convs):
        if rng.random() < 0.1:
            continue
        some = rng.choice(earlier)[: rng.randrange(8)]
        some = some + [(rng.choice(["user", "assistant", None]), rng.choice(["yes.", "no", None, "ü" * 5])) for _ in range(rng.randrange(1, 9))]
        earlier.append(some)
        rows += [(c, None if rng.random() < 0.03 else 2 * i, r, t) for i, (r, t) in enumerate(some)]
        rows += rows[-1:] if rng.random() < 0.1 else []
    # one conversation without turns when rebuilt, a third of all with the same first turns, a null id
    rows += [(1_000_003, 0, "user", "alone"), (None, 0, "user", "nobody"), (-7, 0, "user", "x"), (1_000_007, 5, "", "")]
    rows += [(c, i, "user", f"common {i}") for c in range(2_000, 2_080) for i in range(5)]
    rows += [(3_000, i, "user", f"turn {i % 7}") for i in range(150)] + [(3_001, i, "user", f"turn {i % 7}") for i in range(90)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("chunk", [4, 1024])
def test_trie_equals_dictionaries_of_prefixes(spark, monkeypatch, chunk):
    monkeypatch.setattr(prefix_trie, "CHUNK", chunk)
    rows = talk(random.Random(chunk), 60)
    assert got(spark, rows) == plain(rows)


def test_no_conversations_no_nodes(spark):
    assert got(spark, []) == [] and got(spark, [(None, 1, "user", "x")]) == []


def test_names_of_prefixes_tell_them_apart():
    rng = np.random.default_rng(1)
    rows, where = [], {}
    for n in (1, 2, 3, 7, 8, 100, 257):
        for _ in range(20):
            rows.append(rng.integers(0, 2, n))
    g = np.concatenate(rows).astype(np.uint64)[:, None] * np.ones((1, 2), np.uint64) + prefix_trie.SALTS
    p = np.concatenate([np.arange(len(r)) for r in rows])
    names = prefix_trie.prefix_names(g, p, np.concatenate([np.full(len(r), len(r)) for r in rows]))
    at = 0
    for r in rows:
        for d in range(1, len(r) + 1):
            where.setdefault(names[at].tobytes(), set()).add(tuple(r[:d]))
            at += 1
    assert all(len(v) == 1 for v in where.values())
    assert len(where) == len({tuple(r[:d]) for r in rows for d in range(1, len(r) + 1)})
