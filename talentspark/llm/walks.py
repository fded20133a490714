"""CGK random walks over word sequences, and samples of what they see.

A walk reads a sequence step by step: it notes the word it stands on and, by a random bit of (step, word),
stays or goes on. Two sequences that are few edits apart see the same words at many steps, as a walk that
was thrown out of step by an edit meets the other again: edit distance becomes Hamming distance. A bucket is
a few sampled steps of a walk; sequences share it if they agree on all of them.

How many walks sequences of a length need follows from the recall asked for (``walks_for``): altered copies
are drawn at the full number of edits, for one half at any places and for the other at the beginning, where an
edit throws a walk out of step for longest, and walks are added until the share of copies that have a bucket in
common with their original reaches it in both halves. Words of drawn copies are all different, the case with
the fewest chance agreements.
"""

from __future__ import annotations

from functools import cache

import numpy as np

from talentspark.llm.common import mix

BANDS = 16
TRIALS = 1_000
CELLS = 4_000_000
# what a walk notes behind the last word; an item's end and a window's do not agree, so no bucket is shared for its ends
ITEM_END, WINDOW_END = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def steps_for(n: int) -> int:
    """A walk goes on at every second step, so this many seldom reach the end of ``n`` words."""
    return max(3 * n // 2, 2)


class Walks:
    """``walks`` random walks over windows of ``n`` words, with ``BANDS`` buckets of ``sample`` steps each."""

    def __init__(self, n: int, walks: int, sample: int):
        rng = np.random.default_rng([n, sample])
        self.n, self.steps, self.sample = n, steps_for(n), sample
        # drawn walk by walk, so that the first walks are the same however many there are
        drawn = [self._draw(rng) for _ in range(walks)]
        self.turn = np.stack([t for t, _ in drawn], 1)
        self.at = np.stack([p for _, p in drawn])
        self.salt = mix(np.arange(1, walks * BANDS + 1, dtype=np.uint64)).reshape(walks, BANDS, 1)

    def _draw(self, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
        odd = rng.integers(0, 1 << 63, self.steps, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        return odd, rng.integers(0, self.steps, (BANDS, self.sample))

    def chunk(self) -> int:
        """Windows whose walks fit ``CELLS`` noted words."""
        return max(CELLS // (self.steps * len(self.at)), 1)

    def buckets(self, windows: np.ndarray, end: np.uint64) -> np.ndarray:
        """(walks x BANDS, windows) bucket numbers of rows of word hashes; words behind the ``n``-th are not read."""
        m = len(windows)
        # a walk makes fewer steps than a row has words, the last of which mark the end
        rows = np.full((m, self.steps + 1), end, np.uint64)
        width = min(self.n, self.steps + 1, windows.shape[1])
        rows[:, :width] = windows[:, :width]
        flat, place = rows.ravel(), np.tile(np.arange(m) * (self.steps + 1), (len(self.at), 1))
        seen = np.empty((self.steps, len(self.at), m), np.uint64)
        for step, turn in enumerate(self.turn):
            np.take(flat, place, out=seen[step])
            place += ((seen[step] * turn[:, None]) >> np.uint64(63)).astype(np.int64)
        keys, walk = self.salt, np.arange(len(self.at))[:, None]
        for i in range(self.sample):
            keys = mix(keys + seen[self.at[:, :, i], walk])
        return keys.reshape(-1, m)


def altered(rng: np.random.Generator, n: int, d: int, reach: int) -> tuple[np.ndarray, np.ndarray]:
    """A sequence of ``n`` different words, and what stands there after ``d`` random edits of its first ``reach`` words,
    with other words behind it."""
    fresh = iter(rng.integers(1, 1 << 63, 2 * n + 2 * d + 1, dtype=np.uint64).tolist())
    item = [next(fresh) for _ in range(n)]
    copy = list(item)
    for _ in range(d):
        kind, place = int(rng.integers(3)), int(rng.integers(min(reach, len(copy))))
        copy[place:place + (kind != 1)] = [next(fresh)] if kind < 2 else []
    copy += [next(fresh) for _ in range(n + d - len(copy))]
    return np.array(item, np.uint64), np.array(copy[:n], np.uint64)


@cache
def walks_at(n: int, d: int, recall: float, sample: int) -> int:
    """The least power of two of walks by which drawn copies ``d`` edits away share a bucket at the rate ``recall``."""
    rng = np.random.default_rng([n, d, 1])
    pairs = [altered(rng, n, d, reach) for reach in (n + d, 2 * d + 1) for _ in range(TRIALS)]
    items, copies = (np.stack(side) for side in zip(*pairs, strict=True))
    walks = 1
    while True:
        family = Walks(n, walks, sample)
        size = family.chunk()
        met = np.concatenate([
            (family.buckets(items[i:i + size], ITEM_END) == family.buckets(copies[i:i + size], WINDOW_END)).any(0)
            for i in range(0, len(items), size)
        ])
        if met.reshape(2, TRIALS).mean(1).min() >= recall:
            return walks
        walks *= 2


def walks_for(n: int, differ: float, recall: float, sample: int) -> int:
    """The walks that windows of ``n`` words need at a share ``differ`` of edits: the larger number of the two lengths
    around ``n`` in a row of lengths that grow by half."""
    low = high = 4
    while high < n:
        low, high = high, high + high // 2
    return max(walks_at(m, int(differ * m + 1e-9), recall, sample) for m in {low, high})
