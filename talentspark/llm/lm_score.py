"""Cross-entropy difference of two n-gram models with one vocabulary.

The target model counts the target documents, the background model all documents; its counts are
scaled to the target's number of tokens, so that the lower orders weigh alike in both. Words, pairs and
triples are counted by hashes, each by its own: what is gathered grows with the input. A hash has ``SPARE``
bits more than the number of all n-grams has (64 at most), so at every size about one n-gram in a
million shares its hash with another.

1. Documents are dealt by a hash of their id into chunks of about ``CHUNK`` characters, and the ids of the target
   documents go to the same chunks as marks, so no list of them is sent to the tasks. The rows of an id that would
   fill a chunk are dealt by their texts too; these ids, of which there are at most ``HOT`` a chunk, are looked up.
   A chunk sends each of its distinct n-grams once, with its counts, to the n-gram's bucket; so a frequent n-gram
   costs a bucket no more than one entry a chunk. Hashes travel as compressed differences of ascending values, and a
   chunk sends nothing to a bucket that it has no n-gram for, so rows are never more than n-grams.
2. A bucket sums up and answers each chunk with what the other chunks counted, in the order of what the
   chunk sent; for the many n-grams of one chunk alone that is 0 and takes hardly any room. One more bucket sums up
   the tokens of all chunks.
3. A chunk adds its own counts, puts the sums to its tokens again, and each document gets its mean loss per token under
   either model (triples backed off to pairs, words and a uniform share of the distinct words).

What a model counted of a document is taken off its counts while the document is scored.

Edge cases: null and empty texts have no tokens and null losses; without target documents both models
are uniform and every difference is 0; rows without an id are scored and counted as background only;
repeated rows count as often as they occur
(and a text is discounted once); further columns are left behind.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talentspark.llm.common import WordHash, mix
from talentspark.session import settle, shuffles_dropped

PRIOR = (0.5, 8.0, 4.0)  # weight of the next lower order
CHUNK = 4_000_000
LEAST_PARTS = 64  # chunks and buckets of a small input
SPARE = 20
HOT = 4  # an id with more rows than this part of a chunk's mean is dealt over all chunks
# rows of a chunk: a text whose id's mark decides, one that is no target, one that is, one without an id, and an id's mark
OPEN, OTHER, TARGET, NAMELESS, MARK = range(5)
ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]
COUNTS = "chunk int, bucket int, keys binary, target binary, whole binary"
SCORES = "doc_id long, n_tokens long, target_loss double, background_loss double, difference double"


def pack(x: np.ndarray) -> bytes:
    """Unsigned integers, byte plane after byte plane without the high ones that none uses, compressed."""
    x = x.astype("<u8")
    width = -(-int(x.max()).bit_length() // 8) if len(x) else 0
    planes = x.view(np.uint8).reshape(-1, 8).T[:width].tobytes()
    return len(x).to_bytes(8, "little") + zstandard.ZstdCompressor(level=1).compress(planes)


def unpack(v: bytes) -> np.ndarray:
    size, planes = int.from_bytes(v[:8], "little"), zstandard.ZstdDecompressor().decompress(v[8:])
    out = np.zeros((size, 8), np.uint8)
    if planes:
        planes = np.frombuffer(planes, np.uint8).reshape(-1, size)
        out[:, :len(planes)] = planes.T
    return out.view("<u8").ravel()


def key_bits(keys: int) -> int:
    """Bits of a hash that tells ``keys`` keys apart."""
    return min(keys.bit_length() + SPARE, 64)


def grams(texts: list[str | None], cache: WordHash, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys (3, tokens) of each token's word, pair and triple (with the tokens before it), and the tokens of each text.

    The upper ``bits`` of a key are its hash, the others are 0.
    """
    split = [(t or "").lower().encode("utf-8", "replace").split() for t in texts]
    sizes = np.fromiter(map(len, split), np.int64, len(split))
    first = (np.cumsum(sizes) - sizes)[sizes > 0]

    def before(x: np.ndarray) -> np.ndarray:
        out = np.empty_like(x)
        out[1:] = x[:-1]
        out[first] = 0
        return out

    word = mix(cache.of([w for s in split for w in s]) + ODD[0])
    pair = mix(mix(before(word) + ODD[1]) + word)
    triple = mix(mix(before(pair) + ODD[2]) + word)
    spare = np.uint64(64 - bits)
    return (np.stack([word, pair, triple]) >> spare) << spare, sizes


def tally(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys in ascending order and how often each occurs."""
    keys = np.sort(keys)
    at = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, np.int64)
    return keys[at], np.diff(np.r_[at, len(keys)])


def runs(keys: np.ndarray, buckets: int) -> Iterator[tuple[int, slice]]:
    """(bucket, its part) of ascending keys."""
    bucket = ((keys >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
    ends = np.cumsum(np.bincount(bucket, minlength=buckets))
    for b in np.unique(bucket).tolist():
        yield b, slice(int(ends[b - 1]) if b else 0, int(ends[b]))


def first_of(bucket: int, buckets: int) -> np.uint64:
    """The least key that ``runs`` gives to the bucket."""
    return np.uint64(-(-(bucket << 32) // buckets) << 32)


def measure(rows: DataFrame, buckets: int, bits: int) -> tuple[int, int]:
    """Tokens and distinct words of the texts."""
    spare = np.uint64(64 - bits)

    def words(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cache, seen, whole = WordHash(), set(), 0

        def send() -> pd.DataFrame:
            keys = np.sort(cache.of(list(seen))) >> spare << spare
            out = [(b, pack(np.diff(keys[part] >> spare, prepend=first_of(b, buckets) >> spare)), 0) for b, part in runs(keys, buckets)]
            out.append((0, pack(keys[:0]), whole))
            return pd.DataFrame(out, columns=["bucket", "keys", "whole"])

        for batch in batches:
            for text in batch["text"]:
                found = (text or "").lower().encode("utf-8", "replace").split()
                seen.update(found)
                whole += len(found)
            if len(seen) >= 200_000:
                yield send()
                seen, whole = set(), 0
        yield send()

    def distinct(frame: pd.DataFrame) -> pd.DataFrame:
        keys = np.concatenate([np.cumsum(unpack(v), dtype=np.uint64) for v in frame["keys"]])
        return pd.DataFrame({"words": [len(np.unique(keys))], "whole": [frame["whole"].sum()]})

    sent = rows.select("text").mapInPandas(words, "bucket int, keys binary, whole long")
    sums = sent.groupBy("bucket").applyInPandas(distinct, "words long, whole long")
    return tuple(x or 0 for x in sums.agg(F.sum("whole"), F.sum("words")).first())


def dealt(docs: DataFrame, targets: DataFrame, parts: int, total: int) -> DataFrame:
    """(doc_id, text, role, chunk): the texts and the marks of the target documents, which meet in the chunk of their id."""
    ids = targets.select(F.col("doc_id").cast("long").alias("doc_id")).where("doc_id IS NOT NULL").distinct()
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    per_id = rows.select("doc_id", F.lit(1).alias("n"), F.lit(OTHER).alias("known")).unionByName(
        ids.select("doc_id", F.lit(0).alias("n"), F.lit(TARGET).alias("known"))
    ).where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.sum("n").alias("n"), F.max("known").alias("known"))
    # fewer than HOT * parts ids whatever the input
    hot = F.broadcast(settle(per_id.where(F.col("n") * (HOT * parts) > total).select("doc_id", "known")))
    role = F.coalesce("known", F.when(F.col("doc_id").isNull(), F.lit(NAMELESS)).otherwise(F.lit(OPEN))).alias("role")
    by_id = F.pmod(F.xxhash64("doc_id"), F.lit(parts)).cast("int")
    by_text = F.pmod(F.xxhash64("doc_id", "text"), F.lit(parts)).cast("int")
    texts = rows.join(hot, "doc_id", "left").select("doc_id", "text", role, by_id.alias("by_id"), by_text.alias("by_text")).select(
        F.coalesce("doc_id", F.lit(0).cast("long")).alias("doc_id"), "text", "role",
        F.when(F.col("role") == OPEN, F.col("by_id")).otherwise(F.col("by_text")).alias("chunk"),
    )
    return texts.unionByName(ids.select("doc_id", F.lit(None).cast("string").alias("text"), F.lit(MARK).alias("role"), by_id.alias("chunk")))


def told(frame: pd.DataFrame) -> tuple[pd.DataFrame, np.ndarray]:
    """The texts of a chunk, and which of them are targets."""
    role, ids = frame["role"].to_numpy(), frame["doc_id"].to_numpy()
    marks = role == MARK
    chosen = (role == TARGET) | (role == OPEN) & np.isin(ids, ids[marks])
    return frame[~marks], chosen[~marks]


def count(chunks: DataFrame, buckets: int, bits: int) -> DataFrame:
    """Per chunk and bucket, how often all other chunks have the chunk's distinct n-grams, in ascending order of their keys;
    in the last bucket, how many tokens all other chunks have."""
    spare = np.uint64(64 - bits)

    def send(frame: pd.DataFrame) -> pd.DataFrame:
        texts, chosen = told(frame)
        keys, sizes = grams(texts["text"].tolist(), WordHash(), bits)
        found, whole = tally(keys.ravel())
        some, number = tally(keys[:, np.repeat(chosen, sizes)].ravel())
        target = np.zeros(len(found), np.int64)
        target[np.searchsorted(found, some)] = number
        chunk = int(frame["chunk"].iloc[0])
        out = [
            (chunk, b, pack(np.diff(found[part] >> spare, prepend=first_of(b, buckets) >> spare)), pack(target[part]), pack(whole[part]))
            for b, part in runs(found, buckets)
        ]
        if len(texts):
            out.append((chunk, buckets, pack(np.zeros(1, np.uint64)), pack(sizes[chosen].sum(keepdims=True)), pack(sizes.sum(keepdims=True))))
        return pd.DataFrame(out, columns=["chunk", "bucket", "keys", "target", "whole"])

    def add(frame: pd.DataFrame) -> pd.DataFrame:
        # all keys of a bucket are counted from the same one
        parts = [np.cumsum(unpack(v), dtype=np.uint64) for v in frame["keys"]]
        ends = np.cumsum([len(p) for p in parts])[:-1]
        _, at = np.unique(np.concatenate(parts), return_inverse=True)
        out = frame[["chunk", "bucket"]].assign(keys=b"")
        for name in ("target", "whole"):
            # sums of whole numbers, exact below 2 ** 53
            own = np.concatenate([unpack(v) for v in frame[name]])
            total = np.bincount(at, own).astype(np.uint64)
            out[name] = [pack(x) for x in np.split(total[at] - own, ends)]
        return out

    sent = chunks.groupBy("chunk").applyInPandas(send, COUNTS)
    return sent.groupBy("bucket").applyInPandas(add, COUNTS).select("chunk", "bucket", "target", "whole")


def own_counts(slot: np.ndarray, owner: np.ndarray, size: int) -> np.ndarray:
    """How often each token's slot occurs in its own text."""
    _, at, number = np.unique(owner * size + slot, return_inverse=True, return_counts=True)
    return number[at]


def losses(
    counts: np.ndarray, own: np.ndarray, owner: np.ndarray, inside: np.ndarray, tokens: tuple[int, int], words: int
) -> np.ndarray:
    """Loss in bits of each token under each model, from its n-grams' counts (model, order, token) and those
    in its own text. ``inside[model, text]``: the model counted the text; what it counted there is taken off
    again, so no text is scored by itself. ``tokens``: how many each model counted; the second is scaled to the first."""
    n = np.bincount(owner, minlength=inside.shape[1])[owner]
    first = np.r_[True, owner[1:] != owner[:-1]]
    out = []
    for model, counted, size in zip(counts, inside, tokens, strict=True):
        scale = tokens[0] / size if size else 0.0
        less = counted[owner].astype(np.int64)
        rest = np.maximum(model - less * own, 0) * scale
        p = (rest[0] + PRIOR[0]) / ((size - less * n) * scale + PRIOR[0] * words)
        for order in (1, 2):
            # how often the last word, or the last pair, before the token was seen
            seen = np.r_[0, model[order - 1][:-1]] - less * np.r_[0, own[order - 1][:-1]]
            seen = np.maximum(seen, 0) * scale
            p = np.where(first, p, (np.minimum(rest[order], seen) + PRIOR[order] * p) / (seen + PRIOR[order]))
        out.append(-np.log2(p))
    return np.array(out)


def score(docs: DataFrame, targets: DataFrame) -> DataFrame:
    """Per row: doc_id, n_tokens, target_loss, background_loss and difference (low: like the targets).

    ``targets`` holds the doc_id of the target documents.
    """
    total, chars = docs.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.length("text")), F.lit(0))).first()
    parts = max(LEAST_PARTS, chars // CHUNK)
    # a word and the space after it are two characters at least
    with shuffles_dropped(docs.sparkSession):
        in_all, words = measure(docs, parts, key_bits(chars // 2 + 1))
    bits = key_bits(3 * in_all)
    chunks = dealt(docs, targets, parts, total)

    def run(frame: pd.DataFrame, sums: pd.DataFrame) -> pd.DataFrame:
        frame, chosen = told(frame)
        keys, sizes = grams(frame["text"].tolist(), WordHash(), bits)
        owner = np.repeat(np.arange(len(sizes)), sizes)
        found, at = np.unique(keys.ravel(), return_inverse=True)
        at = at.reshape(keys.shape)
        sums = sums.sort_values("bucket")
        lost = np.zeros((2, 0))
        if len(found):
            counts = np.stack([np.concatenate([unpack(v) for v in sums[c]]).astype(np.int64) for c in ("target", "whole")])
            counts, in_target = counts[:, :-1], int(counts[0, -1] + sizes[chosen].sum())
            counts += [np.bincount(x.ravel(), minlength=len(found)) for x in (at[:, np.repeat(chosen, sizes)], at)]
            own = np.stack([own_counts(x, owner, len(found)) for x in at])
            inside = np.stack([chosen, np.ones(len(frame), bool)])
            lost = losses(counts[:, at], own, owner, inside, (in_target, in_all), words)
        mean = [np.bincount(owner, x, len(sizes)) / np.where(sizes, sizes, np.nan) for x in lost]
        out = pd.DataFrame({
            "doc_id": frame["doc_id"].astype("Int64").mask(frame["role"] == NAMELESS).array, "n_tokens": sizes,
            "target_loss": mean[0], "background_loss": mean[1], "difference": mean[0] - mean[1],
        })
        return out.astype({c: "Float64" for c in ("target_loss", "background_loss", "difference")})

    return chunks.groupBy("chunk").cogroup(count(chunks, parts, bits).groupBy("chunk")).applyInPandas(run, SCORES)
