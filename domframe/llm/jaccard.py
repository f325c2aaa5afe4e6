"""Near duplicates by SimHash links, confirmed by the Jaccard similarity of word shingles.

Texts with one set of shingles are one node, so copies never make pairs. At the least similarity 15 of 100 SimHash bits
differ, too many for the segments of simhash.links(), which find pairs within four bits of 64. So a fingerprint has 1,024
bits here, and its segments of 23 bits, chosen at random, are decoded by the Golay code with the bits' margins: those in
which similar texts differ are mostly those whose hashes were almost even. The likeliest codewords of two segments are a key
of 24 bits. Pairs that share a key are linked if their fingerprints differ in LINK_BITS bits at most (FEW_BITS for few shingles), and are duplicates if
their whole sets are similar; star components join them.

Shingles that no other node has cannot be shared, so that the number of a node's other shingles bounds its similarity to any
node: many members of a group of near copies have changed too much to resemble any other, and go before pairs are made.

A bucket's most popular node, whose keys most others have, is most likely the text that near copies were made from. In each
round a node is compared with one node, the most popular of all its buckets that it has not met, so that a round joins a group
of any size by one row for each member. What links have joined needs no further comparison. In buckets that still hold several
components all other pairs are compared in blocks of bounded size: first sizes and plain fingerprints, then the sets of the
members that these leave; a pair is emitted only where it joins two components. Tables between these steps have a row for
each node or for each node and key, never for each pair.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from . import common
from .components import components
from .simhash import likely_codewords, majority, set_bits, shingle_hashes

#: Words of a shingle, least similarity, rounds of one comparison for each node.
WIDTH, LEAST, ROUNDS = 5, 0.8, 2
#: 64-bit words of a fingerprint, its segments of 23 bits, most differing bits of a link, and of one of a set of few shingles: pairs of the least similarity have 154
#: on average, with a deviation of 11 (192 and 13 for sets of five and four shingles), others 512.
WORDS, SEGMENTS, LINK_BITS, FEW_BITS = 16, 112, 224, 288
#: Most differing bits of the plain 64-bit fingerprints, which are looked at first: pairs of the least similarity pass with a
#: probability over 0.9999. Those of few shingles are not compared, and have more keys. Members of a block; members of a bucket compared at once.
MOST_BITS, FEW, BLOCK, PLACES = 26, 24, 512, 4
_RANDOM = np.random.default_rng(42)
_FACTORS = _RANDOM.integers(1, 1 << 63, WORDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: The bits of each segment: every bit is in three of them at most.
_BITS = np.concatenate([_RANDOM.permutation(64 * WORDS)[: 64 * WORDS // 23 * 23] for _ in range(3)]).reshape(-1, 23)[:SEGMENTS]
#: Taken from each bit's margin, so that even bits are unset, and equal margins have one order in all texts.
_EVEN = (0.01 + _RANDOM.random(64 * WORDS) / 2).astype(np.float32)
_NONE = 0xFFFF


def shingle_sets(texts: list[bytes]) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    h, first = shingle_hashes(texts, WIDTH)
    return [np.unique(h[lo:hi]) for lo, hi in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)]


def node(grams: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(grams.tobytes(), 7)


def margins(sets: list[np.ndarray]) -> np.ndarray:
    """Of each set and each of 64 * WORDS bits: hashes with that bit less those without; over 0 is a bit of the fingerprint."""
    h, first = np.concatenate(sets), np.concatenate(([0], np.cumsum([len(x) for x in sets])))
    out = np.empty((len(sets), 64 * WORDS), np.float32)
    for k, factor in enumerate(_FACTORS):
        x = (h ^ (h >> np.uint64(32))) * factor
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0xFF51AFD7ED558CCD)
        out[:, 64 * k : 64 * k + 64] = 2 * set_bits(x ^ (x >> np.uint64(32)), first) - np.diff(first)[:, None]
    return out - _EVEN


def band_keys(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The two likeliest codewords of each set's SEGMENTS segments (_NONE for no second), and the bytes of its fingerprint.

    No set may be empty.
    """
    codes, short = np.zeros((len(sets), SEGMENTS, 2), np.uint16), np.zeros((len(sets), 8 * WORDS), np.uint8)
    for lo in range(0, len(sets), 256):
        m = margins(sets[lo : lo + 256])
        found, second = likely_codewords(m[:, _BITS].reshape(-1, 23))
        found[~second, 1] = _NONE
        codes[lo : lo + 256] = found.reshape(-1, SEGMENTS, 2)
        short[lo : lo + 256] = np.packbits(m > 0, axis=1)
    return codes, short


def code_keys(codes: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row of each key and the keys (int) of codes (sets, SEGMENTS, 2) of sets of n shingles.

    Of each two neighbouring segments the likeliest codewords of both, and either one's second with the likeliest of the other.
    Sets that may resemble one of few shingles have both seconds too, and the same of each segment and the next but one: their
    margins are small numbers, which tell less.
    """
    own, few = codes.astype(np.uint32), n * LEAST < FEW
    rows, out = [], []
    for step in (1, 2):
        then, place = np.roll(own, -step, axis=1), (np.arange(SEGMENTS, dtype=np.uint32) + SEGMENTS * (step - 1)) << 24
        for i, j in ((0, 0), (1, 0), (0, 1), (1, 1)):
            x, y = own[:, :, i], then[:, :, j]
            r, c = np.nonzero((x != _NONE) & (y != _NONE) & (few[:, None] | (step == 1 and i * j == 0)))
            rows.append(r)
            out.append(place[c] | (x[r, c] << 12) | y[r, c])
    return np.concatenate(rows), np.concatenate(out).astype(np.uint32).view(np.int32)


def signatures(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, node, n, fp, short, codes of each row of docs(doc_id, text): number of shingles, plain and wide
    fingerprint, codewords.

    Texts without words have an empty wide fingerprint and no codewords.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, texts in common.text_slices(batch):
                sets = shingle_sets(texts)
                size = np.array([len(x) for x in sets], np.int64)
                short, codes = [b""] * len(sets), [b""] * len(sets)
                fp = majority(np.concatenate(sets), np.concatenate(([0], np.cumsum(size)))).view(np.int64)
                full = np.flatnonzero(size).tolist()
                if full:
                    for i, c, b in zip(full, *band_keys([sets[i] for i in full]), strict=True):
                        codes[i], short[i] = c.tobytes(), b.tobytes()
                nodes = np.array([node(x) for x in sets], np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(lo, hi - lo), batch.column("text_hash").slice(lo, hi - lo), pa.array(nodes), pa.array(size), pa.array(fp), pa.array(short, pa.binary()), pa.array(codes, pa.binary())], names=["doc_id", "text_hash", "node", "n", "fp", "short", "codes"])

    return common.texts_of(docs, F.col("doc_id").cast("bigint"), F.xxhash64("text").alias("text_hash"), "text").mapInArrow(run, "doc_id bigint, text_hash bigint, node bigint, n bigint, fp bigint, short binary, codes binary")


def _close(n: Column, fp: Column, m: Column, gp: Column) -> Column:
    """Whether sizes and plain fingerprints of two sets allow the least similarity."""
    return (F.least(n, m) >= F.lit(LEAST) * F.greatest(n, m)) & ((F.bit_count(fp.bitwiseXOR(gp)) <= MOST_BITS) | (F.least(n, m) < FEW))


def _fits(n: Column, core: Column, m: Column, heart: Column) -> Column:
    """Whether the numbers of shingles that other nodes have too (core, heart) allow the least similarity of sets of n and m."""
    return F.least(core, heart) >= F.lit(LEAST) * (n + m - F.least(core, heart))


def with_keys(classes: DataFrame) -> DataFrame:
    """node, n, fp, keys (array) of classes(node, n, fp, codes) with codewords."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                rows, key = code_keys(np.frombuffer(b"".join(batch.column("codes").to_pylist()), np.uint16).reshape(-1, SEGMENTS, 2), batch.column("n").to_numpy())
                first = np.concatenate(([0], np.cumsum(np.bincount(rows, minlength=len(batch))))).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(first), pa.array(key[np.argsort(rows, kind="stable")].astype(np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column("node"), batch.column("n"), batch.column("fp"), lists], names=["node", "n", "fp", "keys"])

    return classes.where(F.length("codes") > 0).select("node", "n", "fp", "codes").mapInArrow(run, "node bigint, n bigint, fp bigint, keys array<bigint>")


def shared_keys(classes: DataFrame) -> DataFrame:
    """node and fame of the nodes of classes(node, n, fp, codes) with a key of another node that may be similar.

    In buckets of PLACES + 1 members at most each two are compared, so that random meetings go at once; larger ones stay whole.
    The fame of a node is the number of members of its buckets together.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, key = code_keys(np.frombuffer(b"".join(batch.column("codes").to_pylist()), np.uint16).reshape(-1, SEGMENTS, 2), batch.column("n").to_numpy())
            yield pa.RecordBatch.from_arrays([pa.array(key), *[batch.column(c).take(pa.array(rows)) for c in ("node", "n", "fp")]], names=["key", "node", "n", "fp"])

    every = classes.where(F.length("codes") > 0).select("node", F.col("n").cast("int").alias("n"), "fp", "codes").mapInArrow(run, "key int, node bigint, n int, fp bigint")
    own = W.partitionBy("key").orderBy("node")
    met = every.withColumn("_m", F.count("*").over(own.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))).where("_m > 1")
    near = F.col("_m") > PLACES + 1
    for k in range(1, PLACES + 1):
        for at in (F.lag, F.lead):
            near = near | F.coalesce(_close(F.col("n"), F.col("fp"), at("n", k).over(own), at("fp", k).over(own)), F.lit(False))
    return met.withColumn("_near", near).where("_near").groupBy("node").agg(F.sum("_m").alias("fame"))


def _sets(texts: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, slice_ in common.text_slices(batch):
                sets = shingle_sets(slice_)
                nodes = np.array([node(x) for x in sets], np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array([x.view(np.int64) for x in sets], pa.list_(pa.int64()))], names=["node", "grams"])

    return common.texts_of(texts, "text").mapInArrow(run, "node bigint, grams array<bigint>")


def _similar(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Those of pairs(a, b) whose whole sets are similar enough."""
    a, b = (sets.select(F.col("node").alias(c), F.col("grams").alias(f"_{c}")) for c in "ab")
    both = F.size(F.array_intersect("_a", "_b"))
    return pairs.join(a, "a").join(b, "b").where(both >= F.lit(LEAST) * (F.size("_a") + F.size("_b") - both)).select("a", "b")


def _linked(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """Those of pairs(a, b) whose wide fingerprints are linked."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                far = differing(_bytes(batch.column("_a").to_pylist()), _bytes(batch.column("_b").to_pylist()))
                yield batch.select(["a", "b"]).filter(pa.array(far <= most_bits(batch.column("_n").to_numpy())))

    a, b = (classes.select(F.col("node").alias(c), F.col("short").alias(f"_{c}"), F.col("n").alias(f"_n{c}")) for c in "ab")
    return pairs.join(a, "a").join(b, "b").select("a", "b", "_a", "_b", F.least("_na", "_nb").alias("_n")).mapInArrow(run, "a bigint, b bigint")


def most_bits(n: np.ndarray) -> np.ndarray:
    """Most differing bits of a link whose smaller set has n shingles."""
    return np.where(n < FEW, FEW_BITS, LINK_BITS)


def differing(short: np.ndarray, shirt: np.ndarray) -> np.ndarray:
    """Number of differing bits of wide fingerprints (bytes), row by row."""
    return np.bitwise_count(short ^ shirt).sum(axis=1, dtype=np.int64)


def may_link(n: np.ndarray, core: np.ndarray, fp: np.ndarray, m: np.ndarray, heart: np.ndarray, gp: np.ndarray) -> np.ndarray:
    """Whether sets may be similar, row by row: sizes, shared shingles and plain fingerprints of one side and the other."""
    both = np.minimum(core, heart)
    fine = (np.minimum(n, m) >= LEAST * np.maximum(n, m)) & (both >= LEAST * (n + m - both))
    return fine & ((np.bitwise_count((fp ^ gp).view(np.uint64)) <= MOST_BITS) | (np.minimum(n, m) < FEW))


def _bytes(column: pd.Series | list) -> np.ndarray:
    return np.frombuffer(b"".join(column), np.uint8).reshape(len(column), -1)


def _met(own: pd.DataFrame) -> pd.DataFrame:
    """Members of the blocks of a group that another one of their bucket, with another root, may resemble."""
    out = []
    for _, at in own.groupby(["key", "i", "j"], sort=False).indices.items():
        n, core, fp, root, one, two = (own[c].to_numpy()[at] for c in ("n", "core", "fp", "root", "one", "two"))
        first, second = np.flatnonzero(one), np.flatnonzero(two)
        fine = may_link(n[first, None], core[first, None], fp[first, None], n[None, second], core[None, second], fp[None, second]) & (root[first, None] != root[None, second])
        found = np.zeros(len(at), bool)
        found[first] |= fine.any(axis=1)
        found[second] |= fine.any(axis=0)
        out.append(at[found])
    return own.iloc[np.concatenate(out)][["key", "node", "root", "n", "core", "fp"]]


def _within(own: pd.DataFrame) -> pd.DataFrame:
    """Similar pairs within one block, or between two blocks of a bucket, enough of them to join the roots that they join."""
    out = []
    for _, group in own.groupby(["key", "i", "j"], sort=False):
        first, second = group[group["one"]], group[group["two"]]
        n, core, fp, root, node_ = (second[c].to_numpy() for c in ("n", "core", "fp", "root", "node"))
        short, grams = _bytes(second["short"]), second["grams"].to_numpy()
        number = {r: k for k, r in enumerate(set(group["root"].tolist()))}
        joined = np.arange(len(number))  # of each root: those that pairs have joined here have one number
        of = np.array([number[r] for r in root.tolist()], np.int64)
        for x in first.itertuples():
            mine = number[x.root]
            at = np.flatnonzero(joined[of] != joined[mine])
            at = at[may_link(n[at], core[at], fp[at], np.int64(x.n), np.int64(x.core), np.int64(x.fp))]
            at = at[differing(short[at], np.frombuffer(x.short, np.uint8)) <= most_bits(np.minimum(n[at], x.n))]
            for k in at.tolist():
                if joined[of[k]] != joined[mine]:
                    both = len(np.intersect1d(x.grams, grams[k], assume_unique=True))
                    if both >= LEAST * (x.n + n[k] - both):
                        out.append((min(x.node, node_[k]), max(x.node, node_[k])))
                        joined[joined == joined[of[k]]] = joined[mine]
    return pd.DataFrame(out, columns=["a", "b"]).astype("int64")


def _blocks(named: DataFrame) -> DataFrame:
    """named(key, node, ...), written before, with group, i, j, one, two: a row for each pair of blocks that a node is in.

    Buckets are cut into blocks by a hash of the node. A pair of blocks, or several small buckets, is a group of bounded size.
    """
    groups = max(1, named.count() // BLOCK)
    blocks = F.ceil(F.count("*").over(W.partitionBy("key")) / BLOCK).cast("int")
    placed = named.withColumn("blocks", blocks)
    whole = placed.where("blocks = 1").withColumn("at", F.lit(0)).withColumn("other", F.lit(0))
    cut = placed.where("blocks > 1").withColumn("at", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    each = whole.unionByName(cut).withColumn("i", F.least("at", "other")).withColumn("j", F.greatest("at", "other"))
    group = F.when(F.col("blocks") == 1, F.pmod(F.xxhash64("key"), F.lit(groups))).otherwise(F.xxhash64("key", "i", "j"))
    return each.select(group.alias("group"), "i", "j", (F.col("at") == F.col("i")).alias("one"), (F.col("at") == F.col("j")).alias("two"), *named.columns)


def _all_pairs(named: DataFrame, classes: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs a < b that join the roots in the buckets of named(key, node, root, n, core, fp) as all similar pairs do.

    A group of blocks compares all its members, and emits a pair only where that joins two roots. Whole sets are looked up
    only for members that another one may resemble.
    """
    met = _blocks(named).groupBy("group").applyInPandas(_met, "key bigint, node bigint, root bigint, n bigint, core bigint, fp bigint")
    met = common.written(met.distinct(), "met")
    wide = sets.join(classes.select("node", "short"), "node")
    out = common.written(_blocks(met).join(wide, "node").groupBy("group").applyInPandas(_within, "a bigint, b bigint").distinct(), "pairs")
    common.discard(met)
    return out


def cores(classes: DataFrame, sets: DataFrame) -> DataFrame:
    """classes with core, the number of shingles that another node of sets(node, grams) has too, of nodes for which it allows a similar one."""
    once = sets.select("node", F.explode("grams").alias("gram")).groupBy("gram").agg(F.count("*").alias("_m"), F.min("node").alias("node")).where("_m = 1")
    alone = once.groupBy("node").agg(F.count("*").alias("_alone"))
    return classes.join(alone, "node", "left").withColumn("core", F.col("n") - F.coalesce("_alone", F.lit(0))).drop("_alone").where(F.col("core") >= F.lit(LEAST) * F.col("n"))


def links(buckets: DataFrame, classes: DataFrame, sets: DataFrame) -> DataFrame:
    """Similar pairs among the nodes of buckets(key, node), enough of them for the components of all.

    classes(node, n, fp, short), sets(node, grams).
    """
    size = buckets.withColumn("_m", F.count("*").over(W.partitionBy("key")))
    keyed = size.groupBy("node").agg(F.sum("_m").alias("fame"), F.collect_list(F.col("key").cast("bigint")).alias("keys"))
    return links_of(cores(keyed.join(classes.select("node", "n", "fp"), "node"), sets), classes, sets)


def links_of(keyed: DataFrame, classes: DataFrame, sets: DataFrame) -> DataFrame:
    """links() of the buckets that the nodes of keyed(node, n, fp, core, fame, keys) form; keys are a bounded array."""
    live = common.written(keyed.select("node", "n", "fp", "core", "fame", "keys", F.lit(None).cast("struct<fame:bigint,node:bigint>").alias("met")), "live")
    held, found = [live], None
    for k in range(ROUNDS + 1):
        named = live.withColumn("root", F.col("node")) if found is None else live.join(components(found), "node", "left").withColumn("root", F.coalesce("root", "node"))
        each = named.select(F.explode("keys").alias("key"), "node", "root", "n", "core", "fp", *(["fame", "met"] if k < ROUNDS else []))
        own = W.partitionBy("key")
        if k == ROUNDS:
            open_ = each.withColumn("_lo", F.min("root").over(own)).withColumn("_hi", F.max("root").over(own)).where("_lo != _hi").drop("_lo", "_hi")
            open_ = common.written(open_, "open")
            held.append(open_)
            new = _all_pairs(open_, classes, sets)
            held.append(new)
        else:
            top = F.max(F.struct("fame", "node", "root", "n", "core", "fp")).over(own)
            other = each.withColumn("top", top).where("root != top.root").where(F.col("met").isNull() | (F.struct("top.fame", "top.node") < F.col("met")))
            other = other.where(_close(*map(F.col, ("n", "fp", "top.n", "top.fp"))) & _fits(*map(F.col, ("n", "core", "top.n", "top.core"))))
            asked = common.written(other.groupBy("node").agg(F.max(F.struct("top.fame", "top.node")).alias("now")), "asked")
            new = _similar(_linked(asked.select(F.least("node", "now.node").alias("a"), F.greatest("node", "now.node").alias("b")), classes), sets)
            live = common.written(live.join(asked, "node", "left").withColumn("met", F.coalesce("now", "met")).drop("now"), "live")
            held += [asked, live]
        found = common.written(new if found is None else found.unionByName(new), "links")
        held.append(found)
    common.discard(*[x for x in held if x is not found])
    return found


def near_duplicates(docs: DataFrame) -> DataFrame:
    """Per row of docs(doc_id, text): doc_id, text_hash, component (a node's number), component_id (its least doc_id).

    Null texts have no words, and all texts without words are one node. Rows repeat as in docs; equal texts of any number
    are one node; very long texts are shingled whole. Other columns are ignored; an empty table gives an empty result.
    """
    own = common.written(signatures(docs), "signatures")
    classes = own.groupBy("node").agg(F.min("doc_id").alias("least"), F.min("text_hash").alias("text_hash"), *[F.first(c).alias(c) for c in ("n", "fp", "short", "codes")])
    classes = common.written(classes, "classes")
    shared = common.written(shared_keys(classes), "shared")
    wanted = classes.join(shared, "node", "left_semi").select(F.col("text_hash").alias("_h"))
    texts = docs.select(F.col("text").alias("text"), F.xxhash64("text").alias("_t"))
    texts = texts.join(wanted, texts["_t"] == wanted["_h"], "left_semi").groupBy("_t").agg(F.first("text").alias("text"))
    sets = common.written(_sets(texts), "sets")
    near = common.written(cores(classes.join(shared, "node").select("node", "n", "fp", "codes", "fame"), sets), "near")
    keyed = with_keys(near).join(near.select("node", "core", "fame"), "node")
    roots = components(links_of(keyed, classes, sets))
    common.discard(shared, sets, near)
    named = classes.join(roots, "node", "left").select("node", "least", F.coalesce("root", "node").alias("component"))
    least = named.groupBy("component").agg(F.min("least").alias("component_id"))
    return own.select("doc_id", "text_hash", "node").join(named.select("node", "component"), "node").join(least, "component").select("doc_id", "text_hash", "component", "component_id")
