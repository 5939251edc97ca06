"""Minimal perfect hashing of 64-bit keys in numpy."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

GAMMA = 2
MAX_LEVELS = 48
GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def mixed(keys: np.ndarray, level: int) -> np.ndarray:
    """The keys scattered anew for each level (the finaliser of splitmix64)."""
    with np.errstate(over="ignore"):
        z = keys + GOLDEN * np.uint64(level + 1)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return z ^ (z >> np.uint64(31))


@dataclass
class PerfectHash:
    """Numbers 0 to n - 1 for n keys, from about three bits a key.

    Each level is a bitmap of twice as many bits as there are keys left. A key that
    has a bit for itself is placed there; keys that share one go on to the next
    level. A key's number is the count of set bits before its own. Keys left after
    the last level (equal 64-bit hashes) are listed in ``rest`` by their order.
    """

    levels: list[np.ndarray]
    rest: np.ndarray

    @classmethod
    def build(cls, keys: np.ndarray) -> tuple[PerfectHash, np.ndarray]:
        """The function, and the number it gives each key (equal keys in turn)."""
        left, levels = np.arange(len(keys)), []
        slots, placed = np.empty(len(keys), np.int64), 0
        while len(left) and len(levels) < MAX_LEVELS:
            size = GAMMA * len(left)
            at = (mixed(keys[left], len(levels)) % np.uint64(size)).astype(np.int64)
            alone = np.bincount(at, minlength=size) == 1
            levels.append(alone)
            before = np.cumsum(alone) - alone
            own = alone[at]
            slots[left[own]] = placed + before[at[own]]
            placed += int(alone.sum())
            left = left[~own]
        left = left[np.argsort(keys[left], kind="stable")]
        slots[left] = placed + np.arange(len(left))
        return cls(levels, keys[left]), slots

    def find(self, keys: np.ndarray) -> np.ndarray:
        """A number for every key; for keys it was not built from, any number or -1."""
        slots = np.full(len(keys), -1, np.int64)
        left, placed = np.arange(len(keys)), 0
        for level, bits in enumerate(self.levels):
            at = (mixed(keys[left], level) % np.uint64(len(bits))).astype(np.int64)
            own = bits[at]
            slots[left[own]] = placed + (np.cumsum(bits) - bits)[at[own]]
            placed += int(bits.sum())
            left = left[~own]
        if len(self.rest) and len(left):
            at = np.searchsorted(self.rest, keys[left])
            hit = self.rest[np.minimum(at, len(self.rest) - 1)] == keys[left]
            slots[left[hit]] = placed + at[hit]
        return slots

    def dump(self) -> tuple[list[int], list[bytes], bytes]:
        """Bits, packed bitmap of each level, and the keys left."""
        packed = [np.packbits(b).tobytes() for b in self.levels]
        return [len(b) for b in self.levels], packed, self.rest.astype("<u8").tobytes()

    @classmethod
    def load(cls, sizes, packed, rest) -> PerfectHash:
        levels = [
            np.unpackbits(np.frombuffer(p, np.uint8), count=n).astype(bool)
            for n, p in zip(sizes, packed)
        ]
        return cls(levels, np.frombuffer(rest, "<u8"))
