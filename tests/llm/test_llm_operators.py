"""The operators against brute force, round trips and edge cases, on small tables."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from talentspark.llm import (
    chat, decontaminate, language, lm_score, ngram_join, packing, quality, queries, suffix_dedup, token_files, tokens, vectors,
)

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
COMMON = "the of and to in a is that for on with as by from at it are this".split()


def prose(rng, n):
    return " ".join(rng.choice(COMMON) if rng.random() < 0.3 else f"w{rng.randrange(4000)}x" for _ in range(n))


def frame(spark, texts, ids=None):
    rows = [(i, t, "en", "s", 0) for i, t in zip(ids or range(len(texts)), texts, strict=True)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(5)
    base = [prose(rng, rng.choice([1, 2, 3, 30, 120, 400])) for _ in range(40)]
    near = []
    for t in base[:25]:
        for rate in (0.01, 0.02, 0.05):
            near.append(" ".join(w if rng.random() > rate else "changed" for w in t.split()))
    shared = prose(rng, 70)
    holding = [prose(rng, 60) + " " + shared + " " + prose(rng, 40) for _ in range(12)]
    return base + near + holding + base[:5] + [None, "", " \n", "x" * 150_000, "é" * 500 + "ü" * 500, "é" * 400]


EDGE = [None, "", " ", "one", "\\### </turn>", "long " * 30_000, "same text here", "same text here"]


def linked(sets, percent):
    inverted = collections.defaultdict(list)
    for i, s in sets.items():
        for x in s:
            inverted[x].append(i)
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, s in sets.items():
        hits = collections.Counter(j for x in s for j in inverted[x] if j < i)
        for j, n in hits.items():
            if 100 * n >= percent * (len(s) + len(sets[j]) - n):
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    return {i: root(i) for i in sets}


def shingle_sets(texts, n=3):
    out = {}
    for i, t in enumerate(texts):
        w = (t or "").encode().lower().split()
        out[i] = {tuple(w[k:k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} - {()}
    return out


@pytest.mark.parametrize("block", [ngram_join.BLOCK, 300])
def test_ngram_join(spark, texts, monkeypatch, block):
    monkeypatch.setattr(ngram_join, "BLOCK", block)
    sets = shingle_sets(texts)
    root = linked(sets, 90)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.classes(frame(spark, texts)).collect()}
    assert got == {i: (len(s), root[i]) for i, s in sets.items()}


def test_ngram_join_prefixes_lose_no_pair():
    rng = np.random.default_rng(1)
    for percent in (80, 90):
        for n in (1, 2, 5, 10, 25, 57, 200):
            held_by = rng.integers(1, 5, 5000)  # documents that hold a shingle; one: no list
            one = np.sort(rng.choice(5000, n, replace=False))
            for drop in range(n // 4 + 1):
                other = np.unique(np.r_[rng.choice(one, n - drop, replace=False), rng.choice(5000, rng.integers(0, drop + 1))])
                both = np.intersect1d(one, other)
                if 100 * len(both) < percent * (len(one) + len(other) - len(both)):
                    continue
                held = held_by.copy()
                held[both] = np.maximum(held[both], 2)
                found = []
                for some in (one, other):
                    lists = some[held[some] > 1]
                    kept = ngram_join.rare_keys(np.zeros(len(lists), int), lists, held[lists], np.array([len(some)]), percent)
                    found.append(set(lists[kept].tolist()))
                assert found[0] & found[1]


def test_ngram_join_packs_what_it_unpacks():
    rng = np.random.default_rng(2)
    for kind in (np.uint16, np.uint32):
        some = rng.integers(0, np.iinfo(kind).max, 1000).astype(kind)
        assert (ngram_join.unpacked(ngram_join.packed(some), kind) == some).all()


def test_ngram_join_of_five_words(spark, texts):
    """At 0.8 too, with texts that share passages only; those are in no block."""
    rng = random.Random(11)
    passage, some = prose(rng, 60), list(texts)
    for _ in range(60):
        some.append(prose(rng, 50) + " " + passage + " " + prose(rng, 50))
    base = prose(rng, 200).split()
    for rate in (0.0, 0.01, 0.02, 0.03, 0.05):
        for _ in range(6):
            some.append(" ".join(w if rng.random() > rate else f"new{rng.random()}" for w in base))
    for k in range(0, 60, 4):
        some.append(" ".join(base[k:]))
    sets = shingle_sets(some, 5)
    root = linked(sets, 80)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.classes(frame(spark, some), 5, 80).collect()}
    assert got == {i: (len(s), root[i]) for i, s in sets.items()}
    made = ngram_join.signatures(ngram_join.with_id(frame(spark, some)), 5, 16).cache()
    reps = made.where("kind = 0 AND n > 0").groupBy("n", "d1", "d2").agg(F.min("doc_id").alias("rep"))
    near = ngram_join.candidates(made, reps, 80, 16).collect()
    assert near and not {i for r in near for i in r} & set(range(len(texts), len(texts) + 60))


def brute_repeats(texts):
    data = [(t or "").encode() for t in texts]
    count = collections.Counter(d[k:k + 200] for d in data for k in range(len(d) - 199))
    out = []
    for d in data:
        gone, spans, last = np.zeros(len(d), bool), 0, -1
        for k in range(len(d) - 199):
            if count[d[k:k + 200]] > 1:
                spans += k > last
                gone[k:k + 200], last = True, k + 200
        out.append((len(d), int(gone.sum()), spans, hashlib.sha256(np.frombuffer(d, np.uint8)[~gone].tobytes()).hexdigest()))
    return out


@pytest.mark.parametrize("hot", [suffix_dedup.HOT, 2000])
def test_suffix_dedup(spark, texts, hot):
    some = [t if t is None or len(t) < 10_000 else t[:3000] for t in texts]
    got = {r.doc_id: tuple(r)[1:] for r in suffix_dedup.report(frame(spark, some), hot=hot).collect()}
    assert got == dict(enumerate(brute_repeats(some)))


def test_suffix_dedup_long_texts_and_clean(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "PIECE", 500)
    rng = random.Random(3)
    part = prose(rng, 300)
    some = [prose(rng, 400) + part, part + prose(rng, 200), None, "", part]
    rows = frame(spark, some).withColumn("_first", F.lit(1)).withColumn("gram", F.lit(2))
    kept = {r.doc_id: r.text for r in suffix_dedup.clean(rows).collect()}
    assert suffix_dedup.clean(rows).columns == rows.columns
    assert [len((kept[i] or "").encode()) for i in range(5)] == [a - b for a, b, _, _ in brute_repeats(some)]
    assert kept[2] is None


def test_decontaminate(spark, texts):
    rng = random.Random(9)
    items = [prose(rng, rng.randrange(12, 50)) for _ in range(30)]
    bench = spark.createDataFrame([*enumerate(items), (90, None), (91, "too short"), (None, "x y z u v w")], "item_id long, text string")
    docs, want = [], set()
    for i, item in enumerate(items):
        w = item.split()
        if i % 3 == 1:
            w[len(w) // 2] = "changed"
        if i % 3 == 2:
            w[rng.randrange(1, len(w) - 1)] = ""
        docs.append(prose(rng, 200) + " " + " ".join(w).upper() + ".\n" + prose(rng, 100))
        want.add((i, i))
    rows = frame(spark, docs + EDGE + [prose(rng, 300) for _ in range(30)])
    found = decontaminate.matches(rows, bench).collect()
    exact = {(i, i) for i in range(0, 30, 3)}
    got = {(r.doc_id, r.item_id) for r in found}
    assert exact <= got <= want and len(got) >= 0.95 * len(want)
    for r in found:
        assert r.distance <= 0.2 * r.n_words and docs[r.doc_id].lower()[r.start:r.end].split()
    wide = rows.withColumn("item_id", F.lit(0))
    assert decontaminate.without(wide, bench).columns == wide.columns
    left = {r.doc_id for r in decontaminate.without(wide, bench).collect()}
    assert left == set(range(rows.count())) - {d for d, _ in got}
    assert decontaminate.matches(rows, bench.limit(0)).count() == 0


def test_quality(spark):
    rng = random.Random(2)
    good = [prose(rng, rng.randrange(5, 200)) + "." for _ in range(150)]
    bad = [" ".join(w + rng.choice(["***", "$$$", "!!"]) for w in prose(rng, rng.randrange(5, 200)).split()) for _ in range(100)]
    docs = frame(spark, good + bad + EDGE).withColumn("s", F.lit(1)).withColumn("y", F.lit(1))
    labels = spark.createDataFrame([(i, int(i < 150), 0) for i in range(250)] + [(None, 1, 0), (7, None, 0)], "doc_id long, quality int, toxic int")
    rows = quality.classify(docs, labels).collect()
    out = [r for r in rows if r.held_out and r.doc_id < 250]
    assert len(rows) == 258 and len(out) > 30 and all(0 <= r.score <= 1 for r in rows)
    assert np.mean([r.predicted == (r.doc_id < 150) for r in out]) > 0.95
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    assert {r.score for r in quality.classify(docs, labels.limit(0)).collect()} == {1.0}
    x, y = quality.isotonic(np.arange(4.0), np.array([0.0, 0.6, 0.4, 1.0]), np.ones(4))
    assert y.tolist() == [0, 0.5, 1]


def test_language(spark):
    rng = random.Random(4)
    words = {k: [f"{k}{rng.randrange(900)}".translate(str.maketrans("0123456789", "abcdefghij")) for _ in range(200)] for k in ("aa", "bo", "cu")}
    rows = [(i, " ".join(rng.choice(words[k]) for _ in range(40)), k) for i, k in enumerate(list(words) * 40)]
    rows += [(500, None, "aa"), (501, "", "bo"), (502, "12 34 !", None), (503, "x " * 50_000, None)]
    out = language.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()
    truth = {i: k for i, _, k in rows}
    held = [r for r in out if r.held_out and r.doc_id < 500]
    assert np.mean([r.lang_pred == truth[r.doc_id] for r in held]) > 0.95
    assert {r.doc_id for r in out if r.lang_pred == "und"} == {500, 501, 502} and all(0 <= r.score <= 1 for r in out)
    none = spark.createDataFrame([(1, "word", None)], "doc_id long, text string, lang string")
    assert language.identify(none).first().lang_pred == "und"


def test_chat(spark):
    nasty = ["a\\b#c", "</turn>", "<\\/turn>", "### user ###\n", "\\", "", None, "x\n### y ###\nz</turn>\n", "é\\u00e9"]
    rows = [(c, t, ["user", "assistant", "odd # role\n", None][(c + t) % 4], nasty[(c * 3 + t) % len(nasty)]) for c in range(6) for t in range(9)]
    turns = spark.createDataFrame([(None if c == 5 else c, *r) for c, *r in rows], "conv_id long, turn long, role string, text string")
    out = {r.conv_id: r for r in chat.digests(turns).collect()}
    for c in range(6):
        own = sorted((t, r or "", x or "") for k, t, r, x in rows if k == c)
        said = "".join(x for _, r, x in own if r == "assistant")
        r = out[None if c == 5 else c]
        assert r.n_turns == 9 and r.turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for _, a, b in own).encode()).hexdigest()
        assert (r.loss_chars, r.loss_sha256) == (len(said), hashlib.sha256(said.encode()).hexdigest())
    assert chat.digests(turns.limit(0)).count() == 0
    log = spark.createDataFrame([
        (1, 1, 3, "delta", None, "lo"), (1, 1, 2, "delta", None, "hel"), (1, 1, 0, "open", "user", None), (1, 2, 5, "open", "assistant", ""),
        (1, 2, 6, "delta", None, "draft"), (1, 2, 7, "regenerate", None, None), (1, 2, 8, "delta", None, "new"), (1, 3, 9, "open", "user", ""),
        (1, 3, 10, "delta", None, "typo"), (1, 3, 11, "edit", None, "text"), (1, 3, 12, "delta", None, "!"),
    ], "conv_id long, msg long, seq long, kind string, role string, text string")
    assert sorted((r.msg, r.role, r.text) for r in chat.messages(log).collect()) == [
        (1, "user", "hello"), (2, "assistant", "new"), (3, "user", "text!")]


@pytest.mark.parametrize(("name", "leading"), [("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)])
def test_tokens(texts, name, leading):
    own = tokens.Encoder(public_tokenizers.path(name), leading)
    some = [t or "" for t in texts] + ["a  b", " a b ", "a\n b", "a \n b <|endoftext|> c", "<|startoftext|>x", "  ", "it's I'LL", "a\t b  c"]
    want = [e.ids for e in own.tokenizer.encode_batch(some, add_special_tokens=False)]
    assert [x.tolist() for x in own.encode(some)] == want == [x.tolist() for x in own.encode(some)]


@pytest.mark.parametrize(("name", "leading"), [("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)])
def test_tokens_word_by_word(name, leading, monkeypatch):
    """Pieces that share their words are not each encoded anew, and cutting them changes no id."""
    own = tokens.Encoder(public_tokenizers.path(name), leading)
    rng, marks = random.Random(5), ["", ".", ",", "!!", "***", ".\n", "\n", "7", "'s", "\n\n", "|", "\u0301", "\u00a0", "\u0130"]
    words = ["anantion", "Éanouier", "ladodoezie", "SS", "ñtaes", "ß", "İx", "ж"]
    texts = [" ".join(rng.choice(words) + rng.choice(marks) + rng.choice(["", *words]) for _ in range(9)) for _ in range(600)]
    texts += [x for c in map(chr, range(0x180)) for x in (f"a{c}b {c}b a{c}", f"{c}a\n{c}", c)]
    want = [e.ids for e in own.tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert [x.tolist() for x in own.encode(texts)] == want
    given, whole = [], own._whole
    monkeypatch.setattr(own, "_whole", lambda some: given.extend(some) or whole(some))
    pieces = [f"{a}{m}{b}" for a in words[:5] for m in (".", "-", ".\n", "\n", "+7/") for b in words[:5]]
    text = "x " + " ".join(pieces)
    assert own.encode([text])[0].tolist() == own.tokenizer.encode(text, add_special_tokens=False).ids
    assert sum(map(len, given)) < 0.1 * len(text)


def test_token_files(spark, texts, tmp_path):
    path = public_tokenizers.path("word_bpe_49k.json")
    docs = frame(spark, texts).unionByName(frame(spark, ["again", None], [3, None]))
    token_files.write(docs, path, False, str(tmp_path / "f"))
    out = token_files.read(spark, str(tmp_path / "f"), ids=True).collect()
    encode = tokens.Encoder(path, False).tokenizer
    want = {i: encode.encode(t or "", add_special_tokens=False).ids + [2] for i, t in enumerate(texts)}
    at = 0
    for r in sorted(out, key=lambda r: r.start):
        assert r.start == at and r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
        at += r.n_tokens
        if r.doc_id is not None and r.doc_id != 3:
            assert r.ids == want[r.doc_id]
    assert len(out) == len(texts) + 2
    assert token_files.round_trip(docs.limit(0), path, False).count() == 0


def test_codec_round_trip():
    rng = np.random.default_rng(0)
    blocks = [rng.zipf(1.3, n).clip(0, 65535) for n in (1, 50, 4096, 4096, 7)] + [np.arange(300) % 3, np.full(4096, 65535)]
    coded = token_files.compress(blocks)
    assert all((a == b).all() for a, b in zip(token_files.expand(coded, list(map(len, blocks))), blocks, strict=True))
    assert len(coded[-1]) < 600


def test_codec_keeps_its_format():
    """Blocks of any lengths in any order are coded to the bytes that earlier versions wrote."""
    blocks = [(np.arange(n) * 7919 % 49_408) % (97 if n % 2 else 49_408) for n in (3, 700, 0, 41, 4096, 1, 699)]
    coded = token_files.compress(blocks)
    assert all((a == b).all() for a, b in zip(token_files.expand(coded, list(map(len, blocks))), blocks, strict=True))
    assert hashlib.sha256(b"".join(coded)).hexdigest() == "9b7cc752db966e27f1af645a5f2672378ec5b27fc1ed70571992795c2b7b9308"


def test_codec_mixes_the_orders():
    """Ids that one order alone foretells, and blocks of all three kinds: each order's knowledge counts."""
    rng = np.random.default_rng(1)
    follows = rng.integers(0, 40_000, 500)
    chain = [0]
    for x in rng.random(4095):
        chain.append(int((chain[-1] * 7 + 3) % 500) if x < 0.9 else int(rng.integers(500)))
    one = follows[np.array(chain)]  # mostly told by the id before
    pattern = [1, 2, 1, 3, 1, 4]
    two = np.array(pattern * 683)[:4096]  # told by two ids only
    zero = rng.choice(np.array([7, 8, 9, 10]), 4096, p=[0.7, 0.1, 0.1, 0.1])  # told by frequency only
    bits = [8 * len(x) / 4096 for x in token_files.compress([one, two, zero])]
    assert bits[0] < 7 and bits[1] < 0.5 and bits[2] < 1.8
    mixture = token_files.Mixture(1)
    lane, never, always, chance = np.zeros(1, np.int64), np.zeros(1, bool), np.ones(1, bool), np.full(1, 1 << 20)
    for _ in range(200):
        mixture.update(lane, (np.zeros(1, np.int8), np.zeros(1, np.int8)), (always, never), chance)
    two_weight, one_weight = mixture.weights[0, 0]
    assert two_weight > 0.9 * token_files.ONE > one_weight >= 0 and two_weight + one_weight < token_files.ONE


def test_packing_carries_what_can_still_be_joined(spark, monkeypatch):
    """Many groups, few bins of a length carried on: no more sequences than with all of them, and nearly as few as one best fit."""
    rng = random.Random(8)
    lengths = [rng.choice([20, 35, 51, 52, 60, 61, 70, 88]) for _ in range(6000)]
    items = spark.createDataFrame(list(enumerate(lengths)), "item long, length int").repartition(60)
    monkeypatch.setattr(packing, "SLACK", 0)
    found = []
    for kept in (packing.KEPT, 10**9):
        monkeypatch.setattr(packing, "KEPT", kept)
        rows = packing.pack(items, 100).collect()
        used = collections.Counter()
        for r in rows:
            used[r.sequence_id] += lengths[r.item]
        assert len(rows) == 6000 and max(used.values()) <= 100
        found.append(len(used))
    alone = len(packing.best_fit(np.array(lengths), 100)[2])
    assert found[0] == found[1] <= alone * 1.02


def test_packing(spark, texts):
    docs = frame(spark, texts)
    path = public_tokenizers.path("byte_bpe_50k.json")
    rows = packing.packed_pieces(docs.repartition(20), path, size=128).collect()
    bins, own = collections.defaultdict(list), collections.defaultdict(list)
    encode = tokens.Encoder(path, True).tokenizer
    for r in rows:
        bins[r.sequence_id].append((r.offset, r.length))
        own[r.doc_id].append(r)
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 128
    total = 0
    for i, t in enumerate(texts):
        ids = encode.encode(t or "", add_special_tokens=False).ids + [2]
        total += len(ids)
        found = sorted(own[i], key=lambda r: r.piece)
        assert [r.start for r in found] == list(np.cumsum([0] + [r.length for r in found])[:-1])
        assert sum(r.length for r in found) == len(ids) and all(r.length == 128 for r in found[1:])
        for r in found:
            assert r.ids_crc32 == zlib.crc32(np.array(ids[r.start:r.start + r.length], "<u4").tobytes())
    assert len(bins) <= 1.02 * -(-total // 128) + 2
    made = packing.sequences(docs, path, size=128)
    assert made.agg(F.sum(F.size("ids"))).first()[0] == total
    assert packing.packed_pieces(docs.limit(0), path).count() == 0


def test_vectors(spark):
    rng = np.random.default_rng(6)
    base = rng.normal(size=(120, 16))
    rows = [(i, (base[i % 40] + 0.04 * rng.normal(size=16)).tolist(), i % 3) for i in range(600)]
    rows += [(700, rows[0][1], 0), (701, None, 0), (702, [0.0] * 16, 0), (703, [float("nan")] * 16, 0), (704, rows[0][1], None),
             (705, [1.0, 2.0], 0), (706, [1.0, 2.01], 0), (707, [], 0), (None, rows[0][1], 0)]
    out = {r.vec_id: r for r in vectors.near(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).collect()}
    fine = [(i, np.float32(v).astype(float), k) for i, v, k in rows if i is not None and v and k is not None and np.isfinite(v).all() and any(v)]
    links = collections.Counter()
    for i, v, k in fine:
        links[i] = sum(k == m and len(v) == len(u) and i != j and v @ u >= 0.98 * np.linalg.norm(v) * np.linalg.norm(u) for j, u, m in fine)
    assert sum(r.n_links for r in out.values()) >= 0.99 * sum(links.values())
    assert all(out[i].n_links <= links[i] for i, _, _ in fine) and out[705].component_id == 705 == out[706].component_id
    assert all(out[i].n_links == 0 and out[i].kept for i in (701, 702, 703, 704, 707)) and not out[None].kept
    assert vectors.near(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0


def test_lm_score(spark):
    rng = random.Random(8)
    docs = [" ".join(rng.choice(COMMON if i % 2 else [f"t{k}" for k in range(20)]) for _ in range(100)) for i in range(60)] + EDGE
    rows = frame(spark, docs).withColumn("target", F.lit(1))
    ids = spark.createDataFrame([(i,) for i in range(1, 40, 2)] + [(None,), (1,)], "doc_id long")
    out = {r.doc_id: r for r in lm_score.score(rows, ids).collect()}
    assert len(out) == len(docs) and out[60].n_tokens == 0 and out[60].difference is None
    assert max(out[i].difference for i in range(41, 60, 2)) < min(out[i].difference for i in range(40, 60, 2))
    assert lm_score.score(rows, ids.limit(0)).where("abs(difference) > 1e-9").count() == 0


def test_pipeline_keeps_clean_documents(spark, sf, tmp_path):
    docs = queries.load(spark, sf, "documents")
    extra = frame(spark, [None, ""], [10_001, None])
    rows, kept = docs.unionByName(extra), []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, rows, sf).write.parquet(str(tmp_path / str(k)))
        rows = spark.read.parquet(str(tmp_path / str(k)))
        kept.append(rows.count())
        if k < 4:
            assert rows.columns == docs.columns
    assert kept[0] >= kept[1] == kept[2] >= kept[3] > 0.5 * docs.count()
    items = [" ".join(decontaminate.words(r.text)) for r in queries.load(spark, sf, "benchmark").collect()]
    last = spark.read.parquet(str(tmp_path / "3"))
    for r in last.collect():
        text = " ".join(re.findall(r"\w+", (r.text or "").lower()))
        assert not any(i in text for i in items)
    assert {r.doc_id for r in rows.select("doc_id").distinct().collect()} == {r.doc_id for r in last.collect()}


def test_tokens_after_forgetting(texts):
    whole = [t or "" for t in texts] * 2
    expected = tokens.Encoder(public_tokenizers.path("word_bpe_49k.json"), False).encode(whole)
    encoder = tokens.Encoder(public_tokenizers.path("word_bpe_49k.json"), False, kept=50)
    found = [encoder.encode([t])[0] for t in whole]
    assert all(np.array_equal(a, b) for a, b in zip(expected, found, strict=True))
    assert len(encoder.number) < len({p for t in whole for p in t.split(" ")})
