"""A minimal perfect hash of keys that are two 64-bit hashes, in shards of bounded size.

Each shard is built by one task: level by level the keys that have a bit of the level to themselves
take it, the others go on to the next, until none is left; a key's slot is the number of set bits
before its own. A key that is not in the shard also finds a slot, or none: the stored second hash of
the slot's owner tells. What a process holds at a time is a group of shards, at most GROUP_KEYS keys
by expectation; more keys mean more groups, each looked up in a pass of its own.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SHARD_KEYS = 50_000
GROUP_KEYS = 2_000_000
#: Bits of a level for each key that reaches it.
GAMMA = 2.0
GOLDEN = 0x9E3779B97F4A7C15
INDEX_SCHEMA = "shard int, n long, sizes binary, bits binary, stored binary"


def mix(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values: each bit of the result depends on all bits (a published finaliser)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _place(a: np.ndarray, b: np.ndarray, level: int, bits: np.ndarray | int) -> np.ndarray:
    """Bit of each key on a level of so many bits."""
    h = mix(a ^ mix(b + np.uint64((GOLDEN * (level + 1)) & 0xFFFFFFFFFFFFFFFF)))
    return (((h >> np.uint64(32)) * np.asarray(bits, np.uint64)) >> np.uint64(32)).astype(np.int64)


def build(a: np.ndarray, b: np.ndarray, most_levels: int = 64) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bits of each level, the set bits of all levels as 64-bit words, the second hash by slot."""
    sizes, levels, owners = [], [], []
    ka, kb = a, b
    while ka.size:
        if len(sizes) == most_levels:
            raise ValueError("keys repeat")
        size = max(64, int(np.ceil(ka.size * GAMMA / 64)) * 64)
        at = _place(ka, kb, len(sizes), size)
        alone = np.bincount(at, minlength=size) == 1
        mine = alone[at]
        owner = np.empty(size, np.uint64)
        owner[at[mine]] = kb[mine]
        sizes.append(size)
        levels.append(alone)
        owners.append(owner[alone])
        ka, kb = ka[~mine], kb[~mine]
    if not sizes:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    packed = np.packbits(np.concatenate(levels), bitorder="little").view(np.uint64)
    return np.array(sizes, np.int64), packed, np.concatenate(owners)


def shards_for(keys: int) -> int:
    return max(1, -(-keys // SHARD_KEYS))


def shard_of(a: np.ndarray, shards: int) -> np.ndarray:
    return a.view(np.int64) % shards


def build_shards(keys: DataFrame, shards: int) -> DataFrame:
    """INDEX_SCHEMA of the distinct keys a, b (bigint): one task holds one shard at a time."""

    def one(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        sizes, bits, stored = build(rows["a"].to_numpy(np.int64).view(np.uint64), rows["b"].to_numpy(np.int64).view(np.uint64))
        return pd.DataFrame({"shard": [key[0]], "n": [len(rows)], "sizes": [sizes.tobytes()], "bits": [bits.tobytes()], "stored": [stored.tobytes()]})

    return keys.select("a", "b", F.pmod("a", F.lit(shards)).cast("int").alias("shard")).groupBy("shard").applyInPandas(one, INDEX_SCHEMA)


class Group:
    """Some shards of an index, side by side: looks keys up, for arrays of keys at once.

    A slot counts from 0 over the group's shards; first[k] is the first slot of its k-th shard.
    """

    def __init__(self, rows: list, shards: int):
        rows = sorted(rows, key=lambda r: r["shard"])
        self.shards, self.ids = shards, np.array([r["shard"] for r in rows], np.int64)
        self.local = np.full(shards, -1, np.int64)
        self.local[self.ids] = np.arange(len(rows))
        sizes = [np.frombuffer(r["sizes"], np.int64) for r in rows]
        self.levels = max(map(len, sizes), default=0)
        self.size = np.zeros((len(rows), self.levels), np.int64)
        self.start = np.zeros((len(rows), self.levels), np.int64)
        at = 0
        for k, s in enumerate(sizes):
            self.size[k, : len(s)] = s
            self.start[k, : len(s)] = at + np.cumsum(s) - s
            at += int(s.sum())
        self.bits = np.concatenate([np.frombuffer(r["bits"], np.uint64) for r in rows]) if rows else np.zeros(0, np.uint64)
        ones = np.bitwise_count(self.bits).astype(np.int64)
        self.rank = np.cumsum(ones) - ones
        self.stored = np.concatenate([np.frombuffer(r["stored"], np.uint64) for r in rows]) if rows else np.zeros(0, np.uint64)
        n = np.array([r["n"] for r in rows], np.int64)
        self.first = np.concatenate([[0], np.cumsum(n)]).astype(np.int64)

    def slots(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Slot of each key, -1 for what is no key of the group."""
        out = np.full(a.size, -1, np.int64)
        shard = self.local[shard_of(a, self.shards)]
        left = np.flatnonzero(shard >= 0)
        for level in range(self.levels):
            if not left.size:
                break
            s = shard[left]
            size = self.size[s, level]
            if not size.all():
                left, s, size = left[size > 0], s[size > 0], size[size > 0]
            at = self.start[s, level] + _place(a[left], b[left], level, size)
            word, bit = self.bits[at >> 6], (at & 63).astype(np.uint64)
            hit = (word >> bit) & np.uint64(1) == 1
            below = word & ((np.uint64(1) << bit) - np.uint64(1))
            slot = self.rank[at >> 6] + np.bitwise_count(below)
            found = hit & (self.stored[np.where(hit, slot, 0)] == b[left])
            out[left[found]] = slot[found]
            left = left[~hit]
        return out


def groups_of(shards: int) -> list[range]:
    """Shards that are looked up together."""
    step = max(1, GROUP_KEYS // SHARD_KEYS)
    return [range(k, min(k + step, shards)) for k in range(0, shards, step)]


def group(index: DataFrame, part: range, shards: int) -> Group:
    """The shards of one group, read by the driver: about 9 bytes for each of at most GROUP_KEYS keys."""
    return Group(index.filter(F.col("shard").between(part.start, part.stop - 1)).collect(), shards)
