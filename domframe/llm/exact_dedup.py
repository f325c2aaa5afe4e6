"""Exact deduplication through minimal perfect hashes over the digests of documents seen before.

Digests of history are dealt to shards of bounded size. Each shard has a minimal perfect hash, whose slots hold the full
digest, the winner (its largest doc_id) and the number of rows. New digests, aggregated first, are looked up in their
shard; a slot counts only if all its 32 bytes agree. Digests of no slot form groups of their own.
"""
from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

#: Digests of a shard, on average.
SHARD_KEYS = 50_000
#: Bits of a level for each key left, and levels, before the few keys left are kept sorted.
SPREAD, LEVELS = 2, 24
NONE = -(1 << 63)


class PerfectHash:
    """Minimal perfect hash of distinct 32-byte digests: bit levels, each for the keys that clash in those before."""

    def __init__(self, digests: np.ndarray):
        """digests: (n, 32) bytes."""
        self.levels: list[np.ndarray] = []
        left = digests
        while len(left) and len(self.levels) < LEVELS:
            size = max(64, SPREAD * len(left))
            at = self._place(left, len(self.levels), size)
            bits = np.bincount(at, minlength=size) == 1
            self.levels.append(bits)
            left = left[~bits[at]]
        order = np.lexsort(left.T[::-1]) if len(left) else np.zeros(0, int)
        self.rest = left[order]
        sums = [int(b.sum()) for b in self.levels]
        self.starts = np.concatenate(([0], np.cumsum(sums))).astype(np.int64)
        self.ranks = [np.cumsum(b) - 1 for b in self.levels]

    @staticmethod
    def _place(digests: np.ndarray, level: int, size: int) -> np.ndarray:
        words = np.ascontiguousarray(digests).view(np.uint64).reshape(-1, 4)
        mixed = words[:, level % 4] ^ (words[:, (level + 1) % 4] * np.uint64(2 * level + 0x9E3779B97F4A7C15))
        return ((mixed >> np.uint64(11)) % np.uint64(size)).astype(np.int64)

    def __len__(self) -> int:
        return int(self.starts[-1]) + len(self.rest)

    def slots(self, digests: np.ndarray) -> np.ndarray:
        """Slot of each digest; -1 or another's slot for nonmembers."""
        out = np.full(len(digests), -1, np.int64)
        open_ = np.arange(len(digests))
        for level, bits in enumerate(self.levels):
            at = self._place(digests[open_], level, len(bits))
            hit = bits[at]
            out[open_[hit]] = self.starts[level] + self.ranks[level][at[hit]]
            open_ = open_[~hit]
        if len(self.rest) and len(open_):
            index = {bytes(d): i for i, d in enumerate(self.rest)}
            for i in open_:
                out[i] = self.starts[-1] + index.get(bytes(digests[i]), -1 - self.starts[-1])
        return out


def _matrix(digests: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(map(bytes, digests)), np.uint8).reshape(-1, 32)


def resolve(old: pd.DataFrame, new: pd.DataFrame) -> pd.DataFrame:
    """One shard: classes of history old and of new (digest, keep_id, n; distinct each), looked up by perfect hash."""
    nothing = pd.DataFrame({"digest": [], "keep_id": np.zeros(0, np.int64), "n": np.zeros(0, np.int64)})
    old, new = (x if "digest" in x.columns else nothing for x in (old, new))  # a side without rows comes without columns
    known = _matrix(old["digest"])
    table = PerfectHash(known)
    slot = table.slots(known)
    stored = np.zeros((len(table), 32), np.uint8)
    winner, number = np.full(len(table), NONE, np.int64), np.zeros(len(table), np.int64)
    stored[slot], winner[slot], number[slot] = known, old["keep_id"], old["n"]
    asked = _matrix(new["digest"])
    at = table.slots(asked)
    member = at >= 0
    member[member] = (stored[at[member]] == asked[member]).all(axis=1)
    winner[at[member]] = np.maximum(winner[at[member]], new["keep_id"].to_numpy()[member])
    number[at[member]] += new["n"].to_numpy()[member]
    rest = new[~member]
    return pd.DataFrame({"digest": [bytes(d) for d in stored] + list(rest["digest"]), "keep_id": np.concatenate((winner, rest["keep_id"])), "n": np.concatenate((number, rest["n"]))})


def exact_dedup(docs: DataFrame, seen: Column, shard_keys: int = SHARD_KEYS) -> DataFrame:
    """Per row of docs(doc_id, text): doc_id, keep_id, group_size, kept, text_sha256.

    seen: which rows are history; it decides only by which path a row is found, not the result. Null texts count as
    empty. Of equal texts the largest doc_id stays; rows that repeat its doc_id and text stay with it. Null doc_ids lose
    to all others; a group of nothing else has keep_id null and stays. An empty table gives an empty result; other columns
    are ignored. Groups are aggregated before they are shuffled; shards hold distinct digests only.
    """
    rows = common.written(docs.select(F.col("doc_id").cast("bigint"), F.unhex(F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256)).alias("digest"), F.coalesce(seen, F.lit(False)).alias("old")), "digests")
    classes = common.written(rows.groupBy("digest", "old").agg(F.coalesce(F.max("doc_id"), F.lit(NONE)).alias("keep_id"), F.count("*").alias("n")), "classes")
    shards = max(1, -(-classes.count() // (2 * shard_keys)))
    dealt = classes.withColumn("shard", F.pmod(F.xxhash64("digest"), F.lit(shards)))
    old, new = (dealt.where(c).select("shard", "digest", "keep_id", "n").groupBy("shard") for c in ("old", "not old"))
    found = old.cogroup(new).applyInPandas(resolve, "digest binary, keep_id bigint, n bigint")
    keep = F.when(F.col("keep_id") != NONE, F.col("keep_id"))
    return rows.join(found, "digest").select("doc_id", keep.alias("keep_id"), F.col("n").alias("group_size"), F.col("doc_id").eqNullSafe(keep).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))
