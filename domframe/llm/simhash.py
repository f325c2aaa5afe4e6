"""SimHash near-duplicates through Golay-code fuzzy hashing.

Fingerprints of 64 bits are cut into segments of 23, 23 and 18 bits. The perfect binary Golay code gives each segment
the codewords within four bits: one if its own codeword is at most two bits away, else six. Segments that differ in at
most two bits share such a codeword; if they differ in at most one, the nearest codeword of either is among the other's.

Of two fingerprints within four bits, by the pigeonhole principle, either one segment is equal and another differs in
at most two bits (keys "exact": that segment's bits and a codeword of the other), or all three differ and two of them
by one bit each (keys "near": nearest codewords of two segments against all combinations of both). Joined pairs are
checked by their true distance, so that links are neither missed nor wrong.

The third segment of a "near" pair differs in at most two bits, so it shares a codeword too. With very many fingerprints
that codeword joins the key, which then has 36 bits: more keys for each fingerprint, but some 84 times fewer candidates.
"""
from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common
from .components import components

#: Production parameters.
SHINGLE, MAX_BITS = 4, 4
SEGMENTS = ((0, 23), (23, 23), (46, 18))
#: Distinct fingerprints from which wide keys are worth their number: candidates by 24-bit keys, 2.5e-5 times the square of
#: the number (measured), then outweigh the 380 keys more.
WIDE_FROM = 20_000_000
#: Generator polynomial of the binary Golay code of length 23: x^11 + x^9 + x^7 + x^6 + x^5 + x + 1.
GOLAY = 0b101011100011
_LANES = np.uint64(0x0101010101010101)


def shingle_hashes(texts: list[bytes], width: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """XXH64 (seed 42) of each text's shingles, and the index of each text's first."""
    words = common.Words(texts, lower=True)
    n = words.counts()
    per = np.where(n >= width, n - width + 1, np.minimum(n, 1))
    first = np.concatenate(([0], np.cumsum(per)))
    at = np.repeat(words.first[:-1] - first[:-1], per) + np.arange(first[-1])
    last = np.minimum(at + width - 1, np.repeat(words.first[1:] - 1, per))
    buf, digest = words.buf.tobytes(), xxhash.xxh64_intdigest
    h = [digest(buf[s:e], 42) for s, e in zip(words.start[at].tolist(), words.end[last].tolist(), strict=True)]
    return np.array(h, dtype=np.uint64), first


def majority(h: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Per text the 64 bits that are set in over half of its hashes; 0 without any."""
    n = np.diff(first)
    out = np.zeros(len(n), dtype=np.uint64)
    full = np.flatnonzero(n)
    if not len(full):
        return out
    pieces = -(-n[full] // 255)  # byte-wide counters hold 255
    piece_first = np.concatenate(([0], np.cumsum(pieces)))
    at = np.repeat(first[full] - piece_first[:-1] * 255, pieces) + np.arange(piece_first[-1]) * 255
    for bit in range(8):
        lanes = np.add.reduceat((h >> np.uint64(bit)) & _LANES, at).view(np.uint8).reshape(-1, 8)
        sums = np.add.reduceat(lanes.astype(np.int64), piece_first[:-1], axis=0)
        over = (2 * sums > n[full][:, None]).astype(np.uint64)
        out[full] |= (over << (np.arange(8, dtype=np.uint64) * np.uint64(8) + np.uint64(bit))).sum(axis=1, dtype=np.uint64)
    return out


def fingerprints(docs: DataFrame, width: int = SHINGLE) -> DataFrame:
    """doc_id and fp (bigint) of each row of docs(doc_id, text); texts without a word and null texts have 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [majority(*shingle_hashes(texts, width)) for _, _, texts in common.text_slices(batch)]
            fp = np.concatenate(parts).view(np.int64) if parts else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fp)], names=["doc_id", "fp"])

    return common.texts_of(docs, F.col("doc_id").cast("bigint"), "text").mapInArrow(run, "doc_id bigint, fp bigint")


@lru_cache(1)
def code() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each 11-bit syndrome: error patterns of weight 4 at most (nearest first), their number; syndromes of all low and high 12-bit halves."""

    def syndrome(v: int) -> int:
        for b in range(22, 10, -1):
            if v >> b & 1:
                v ^= GOLAY << (b - 11)
        return v

    unit = [syndrome(1 << b) for b in range(23)]
    patterns: list[list[int]] = [[] for _ in range(2048)]
    weight = [9] * 2048
    for w in range(5):
        for bits in combinations(range(23), w):
            s = 0
            for b in bits:
                s ^= unit[b]
            if w < 4:
                weight[s] = w
            if w < 4 or weight[s] == 3:
                patterns[s].append(sum(1 << b for b in bits))
    number = np.array([len(p) for p in patterns])
    errors = np.array([p + [p[0]] * (6 - len(p)) for p in patterns], dtype=np.int64)
    halves = np.zeros((2, 4096), dtype=np.int64)
    for v in range(4096):
        halves[0, v] = syndrome(v & 0xFFF)
        halves[1, v] = syndrome((v << 12) & 0x7FFFFF)
    return errors, number, halves


def codewords(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """12-bit indices of the codewords near each 23-bit value, nearest first (n, 6), and how many count (1 or 6)."""
    errors, number, halves = code()
    s = halves[0, v & 0xFFF] ^ halves[1, v >> 12]
    return (v[:, None] ^ errors[s]) >> 11, number[s]


def set_bits(h: np.ndarray, first: np.ndarray) -> np.ndarray:
    """How many hashes of each text have each of the 64 bits set (n, 64); no text may be without any."""
    n = np.diff(first)
    pieces = -(-n // 255)  # byte-wide counters hold 255
    piece_first = np.concatenate(([0], np.cumsum(pieces)))
    at = np.repeat(first[:-1] - piece_first[:-1] * 255, pieces) + np.arange(piece_first[-1]) * 255
    out = np.empty((len(n), 64), np.int64)
    for bit in range(8):
        lanes = np.add.reduceat((h >> np.uint64(bit)) & _LANES, at).view(np.uint8).reshape(-1, 8)
        out[:, bit::8] = np.add.reduceat(lanes.astype(np.int64), piece_first[:-1], axis=0)
    return out


@lru_cache(1)
def flips() -> np.ndarray:
    """Of each syndrome's six error patterns: the bits that they flip, 23 for none (2048, 6, 4)."""
    out = np.full((2048, 6, 4), 23, dtype=np.int64)
    for s, patterns in enumerate(code()[0].tolist()):
        for k, pattern in enumerate(patterns):
            bits = [b for b in range(23) if pattern >> b & 1]
            out[s, k, : len(bits)] = bits
    return out


def likely_codewords(margin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The two likeliest codewords of each row of margins (n, 23), a bit being set where its margin is positive, and whether
    there is a second one.

    Of the codewords within four bits, those whose flipped bits have the least margins: bits in which similar texts differ.
    """
    errors, number, halves = code()
    v = ((margin > 0) * (1 << np.arange(23))).sum(axis=1)
    s = halves[0, v & 0xFFF] ^ halves[1, v >> 12]
    weight = np.concatenate((np.abs(margin), np.zeros((len(margin), 1), margin.dtype)), axis=1)
    cost = weight[np.arange(len(v))[:, None, None], flips()[s]].sum(axis=2)
    best = np.argsort(cost, axis=1, kind="stable")[:, :2]
    return (v[:, None] ^ np.take_along_axis(errors[s], best, 1)) >> 11, number[s] > 1


def keys(fp: np.ndarray, build: bool, wide: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Row of each key and the keys (bigint): of one side of the join, or the other. Kinds 0-5: exact, 6-8: near."""
    u = fp.view(np.uint64)
    seg = [((u >> np.uint64(lo)) & np.uint64((1 << n) - 1)).astype(np.int64) for lo, n in SEGMENTS]
    near = [codewords(s) for s in seg]
    rows, out = [], []
    six = np.arange(6)
    for kind, (i, j) in enumerate((i, j) for i in range(3) for j in range(3) if i != j):
        words, n = near[j]
        r, c = np.nonzero(six[None, :] < n[:, None])
        rows.append(r)
        out.append((kind << 56) | (seg[i][r] << 12) | words[r, c])
    for kind, (i, j) in enumerate(((0, 1), (0, 2), (1, 2)), start=6):
        (a, na), (b, nb), (third, n) = near[i], near[j], near[3 - i - j]
        if build:
            na, nb = np.minimum(na, 1), np.minimum(nb, 1)
        inner = n if wide else np.minimum(n, 1)
        r, x, y, z = np.nonzero((six[None, :, None, None] < na[:, None, None, None]) & (six[None, None, :, None] < nb[:, None, None, None]) & (six < inner[:, None])[:, None, None, :])
        key = (kind << 56) | (a[r, x] << 12) | b[r, y]
        rows.append(r)
        out.append(key | (third[r, z] << 24) if wide else key)
    return np.concatenate(rows), np.concatenate(out)


def _side(fps: DataFrame, build: bool, wide: bool, columns: tuple[str, str]) -> DataFrame:
    """key and columns: fingerprint and root of fps(fp, root), a row for each key of one side of the join.

    Spark reckons its size as that of fps, though it has 151 to 529 rows for each of those; joins of it carry a hint, so that
    it is never taken for a small table and broadcast through the driver.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp, root = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for lo in range(0, len(fp), 4096):
                rows, key = keys(fp[lo : lo + 4096], build, wide)
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(fp[lo : lo + 4096][rows]), pa.array(root[lo : lo + 4096][rows])], names=["key", *columns])

    return fps.select("fp", "root").mapInArrow(run, f"key bigint, {columns[0]} bigint, {columns[1]} bigint")


def _bits(mask: int) -> Column:
    mask = mask - (1 << 64) if mask >> 63 else mask
    return F.bit_count(F.col("a").bitwiseXOR(F.col("b")).bitwiseAND(F.lit(mask)))


def links(fps: DataFrame, wide: bool = False) -> DataFrame:
    """Pairs a < b of the distinct fingerprints fps(fp, root) that differ in 1 to 4 bits and in root, each once.

    wide changes only the keys. Without a column root all pairs count.
    """
    n = [_bits(((1 << width) - 1) << lo) for lo, width in SEGMENTS]
    first = F.when(F.lit(False), F.lit(-1))
    for kind, (i, j) in enumerate((i, j) for i in range(3) for j in range(3) if i != j):
        first = first.when((n[i] == 0) & (n[j] <= 2), kind)
    first = first.when((n[0] <= 1) & (n[1] <= 1), 6).when((n[0] <= 1) & (n[2] <= 1), 7).otherwise(8)
    fps = fps if "root" in fps.columns else fps.withColumn("root", F.col("fp"))
    a, b = _side(fps, False, wide, ("a", "_r")), _side(fps, True, wide, ("b", "_s"))
    true = (n[0] + n[1] + n[2] <= MAX_BITS) & (F.col("a") < F.col("b")) & (F.col("_r") != F.col("_s")) & (F.shiftright(a["key"], 56) == first)
    return a.join(b.hint("merge"), (a["key"] == b["key"]) & true).select("a", "b").distinct()


def leader_links(fps: DataFrame, wide: bool = False) -> DataFrame:
    """Pairs of fps(fp) within 4 bits of which one is the least of a key's: a row for each member of a key at most."""
    fps = fps.withColumn("root", F.col("fp"))
    a = _side(fps, False, wide, ("a", "_r")).select("key", "a")
    least = _side(fps, True, wide, ("b", "_s")).groupBy("key").agg(F.min("b").alias("b"))
    near = a.join(least.hint("merge"), "key").where((F.col("a") != F.col("b")) & (_bits((1 << 64) - 1) <= MAX_BITS))
    return near.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def roots_of(fps: DataFrame, wide: bool = False) -> DataFrame:
    """node and root of the fingerprints fps(fp) that are linked to others.

    Links with the least of each key come first; then those between fingerprints that these have not joined yet, so that
    a dense cluster of any size gives a few pairs for each of its members.
    """
    first = common.written(leader_links(fps, wide), "leaders")
    now = components(first)
    known = common.written(fps.join(now, fps["fp"] == now["node"], "left").select("fp", F.coalesce("root", "fp").alias("root")), "roots")
    out = components(first.unionByName(links(known, wide)))
    common.discard(first, known)
    return out


def near_duplicates(docs: DataFrame, width: int = SHINGLE) -> DataFrame:
    """Per row of docs(doc_id, text): doc_id, fingerprint (16 hex digits), component_id (least doc_id of those linked).

    Null and word-less texts have fingerprint zero, and link like any other. A null doc_id gets the least known one of
    its component; of ties there is nothing to choose. Equal fingerprints are one node, so copies never make pairs. Very
    long texts are hashed whole, one at a time. Rows repeat as in docs; an empty table gives an empty result; other
    columns are ignored.
    """
    fp = common.written(fingerprints(docs, width), "fingerprints")
    classes = common.written(fp.groupBy("fp").agg(F.min("doc_id").alias("least")), "classes")
    roots = roots_of(classes.select("fp"), classes.count() >= WIDE_FROM)
    named = classes.join(roots, classes["fp"] == roots["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    labelled = named.select("fp", "root").join(least, "root").select("fp", "component_id")
    return fp.join(labelled, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
