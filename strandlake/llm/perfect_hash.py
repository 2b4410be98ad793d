"""A minimal perfect hash of 128-bit keys, in shards whose arrays are NumPy bytes.

A key is two unsigned 64-bit halves.  Level by level, the keys that are alone in their place of a bit array settle
there; the others go on to the next level.  A settled key's slot is the number of settled bits before it, so n keys
fill the slots 0 to n - 1 (Limasset et al., 2017).  Slots of strangers are arbitrary: fingerprints tell them apart.
"""

from __future__ import annotations

import numpy as np

#: Bits of a level for each key that is left.
ROOM = 2
MAX_LEVELS = 256


def _place(first: np.ndarray, second: np.ndarray, level: int, bits: int) -> np.ndarray:
    """Place of every key in a level: both halves are mixed, so keys that share one half part in some level."""
    with np.errstate(over="ignore"):
        h = first ^ second * np.uint64(2 * level + 1) ^ np.uint64((level * 0x9E3779B97F4A7C15) & (2**64 - 1))
        h = (h ^ (h >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
        return (h ^ (h >> np.uint64(33))) % np.uint64(bits)


def build(first: np.ndarray, second: np.ndarray) -> tuple[list[int], np.ndarray]:
    """(bits of every level, the bit arrays one after the other as bytes) of distinct keys."""
    sizes, parts = [], []
    while len(first):
        if len(sizes) == MAX_LEVELS:
            raise ValueError("keys are not distinct")
        bits = max(64, -(-ROOM * len(first) // 64) * 64)
        at = _place(first, second, len(sizes), bits)
        alone = np.bincount(at.astype(np.int64), minlength=bits) == 1
        sizes.append(bits)
        parts.append(np.packbits(alone, bitorder="little"))
        left = ~alone[at]
        first, second = first[left], second[left]
    return sizes, np.concatenate(parts) if parts else np.zeros(0, np.uint8)


class PerfectHash:
    """Slots of keys, from what build() made."""

    def __init__(self, sizes: list[int], data: np.ndarray):
        self.sizes, self.words = list(sizes), np.frombuffer(data.tobytes(), "<u8")
        self.before = np.concatenate(([0], np.cumsum(np.bitwise_count(self.words).astype(np.int64))))
        self.n = int(self.before[-1])

    def slots(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        """The slot of every key; of one that was not built in, any slot or -1."""
        out, left, base = np.full(len(first), -1, np.int64), np.arange(len(first)), 0
        for level, bits in enumerate(self.sizes):
            if not len(left):
                break
            at = _place(first[left], second[left], level, bits)
            word, bit = (at >> np.uint64(6)).astype(np.int64) + base, at & np.uint64(63)
            here = self.words[word] >> bit & np.uint64(1) == 1
            below = self.words[word] & ((np.uint64(1) << bit) - np.uint64(1))
            out[left[here]] = (self.before[word] + np.bitwise_count(below))[here]
            left, base = left[~here], base + bits // 64
        return out
