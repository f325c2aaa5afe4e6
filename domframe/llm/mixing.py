"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

Sources are cut into blocks by a hash of doc_id, in a random order each. A source's target gives its quota of blocks:
whole passes over all of them, then the first ones in order, the last of these in part. A binary tree over the output
shards splits the vector of quotas: each node draws, from the multivariate hypergeometric distribution, how many blocks
of each source go left. A leaf has an exact quota of each source; leaves take disjoint runs of the permuted blocks, and
each shard is shuffled locally. All draws are seeded by their place, so that reruns agree, and so that the tree's lower
part is drawn in many tasks. Shards and blocks grow with the number of words; blocks are numbered in ranges of bounded
size, so that no source is sorted in one task.
"""
from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from . import common

#: Weights by the sources' order, share of all words, most passes over a source.
WEIGHTS, SHARE, MOST, SEED = (5, 2, 1), 1.5, 2.0, 20_240_501
#: Words of an output shard, until there are so many shards that they grow instead; blocks for each shard; leaves of the
#: part of the tree that one task draws.
SHARD_WORDS, MANY_SHARDS, SHARD_BLOCKS, SUBTREE = 4_000_000, 65_536, 256, 256


class Shape(NamedTuple):
    """Number of output shards and of blocks."""

    shards: int
    blocks: int


def shape(n_words: int) -> Shape:
    """By the words of a corpus: shards of SHARD_WORDS, beyond MANY_SHARDS of them larger ones."""
    shards = min(MANY_SHARDS, max(8, -(-int(n_words * SHARE) // SHARD_WORDS)))
    return Shape(shards, shards * SHARD_BLOCKS)


def words(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(common.WORD)), F.lit(0)).cast("bigint")


def targets(sources: DataFrame) -> DataFrame:
    """source, sid, source_size, target of sources(source, source_size): weights by code-point order, excess over the most shared anew.

    sid is the place in that order. With sources sorted by size per weight, those at their most come first: the share of
    the others follows from sums. One row for each source is sorted, never documents.
    """
    rank = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())).cast("bigint")
    weight = F.element_at(F.array(*[F.lit(float(x)) for x in WEIGHTS]), ((F.col("sid") - 1) % len(WEIGHTS) + 1).cast("int"))
    most = F.col("source_size") * F.lit(MOST)
    every = W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    by_limit = W.orderBy("limit", "sid")
    ranked = sources.withColumn("sid", rank).withColumn("weight", weight).withColumn("limit", most / F.col("weight"))
    left = F.sum("source_size").over(every) * F.lit(SHARE) - F.coalesce(F.sum(most).over(by_limit.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
    level = left / F.sum("weight").over(by_limit.rowsBetween(0, W.unboundedFollowing))
    leveled = ranked.withColumn("level", level).withColumn("open", F.col("level") <= F.col("limit"))
    chosen = F.first(F.when(F.col("open"), F.col("level")), ignorenulls=True).over(by_limit.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    return leveled.withColumn("chosen", chosen).select("source", "sid", "source_size", F.coalesce(F.least(most, F.col("chosen") * F.col("weight")), most).alias("target"))


Node = tuple[int, int, np.ndarray, np.ndarray]


def nodes(root: Node, width: int, seed: int) -> list[Node]:
    """(from shard, to shard, first unit, number of units, both by source) of the nodes below root over `width` shards at most."""
    out, open_ = [], [root]
    while open_:
        lo, hi, first, left = open_.pop()
        if hi - lo <= width:
            out.append((lo, hi, first, left))
            continue
        mid = (lo + hi) // 2
        total = int(left.sum())
        drawn = np.zeros_like(left)
        some = np.flatnonzero(left)
        if len(some):
            take = (total * (mid - lo) + (hi - lo) // 2) // (hi - lo)
            drawn[some] = np.random.default_rng([seed, lo, hi]).multivariate_hypergeometric(left[some], take, method="marginals")
        open_ += [(lo, mid, first, drawn), (mid, hi, first + drawn, left - drawn)]
    return out


def split(quotas: np.ndarray, shards: int, seed: int) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """(shard, first unit, number of units, both by source) of each leaf of the tree over shards."""
    return [(lo, first, left) for lo, _, first, left in nodes((0, shards, np.zeros_like(quotas), quotas), 1, seed)]


def _tree(number: DataFrame, shards: int, seed: int) -> DataFrame:
    """sid, n, shard, first, units of number(sid, n, quota): the upper nodes in one task, with one number for each source; each lower subtree in one."""

    def rows(found: list[Node], sid: np.ndarray, n: np.ndarray) -> pd.DataFrame:
        parts = [(lo, hi, s) for lo, hi, _, left in found for s in np.flatnonzero(left)]
        first, left = ({lo: x[k] for lo, x in ((x[0], x) for x in found)} for k in (2, 3))
        at = np.array([s for _, _, s in parts], np.int64)
        return pd.DataFrame({"sid": sid[at], "n": n[at], "lo": [p[0] for p in parts], "hi": [p[1] for p in parts], "first": [int(first[lo][s]) for lo, _, s in parts], "units": [int(left[lo][s]) for lo, _, s in parts]})

    def upper(all_: pd.DataFrame) -> pd.DataFrame:
        all_ = all_.sort_values("sid")
        quota = all_["quota"].to_numpy(np.int64)
        return rows(nodes((0, shards, np.zeros_like(quota), quota), SUBTREE, seed), all_["sid"].to_numpy(), all_["n"].to_numpy())

    def lower(own: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values("sid")
        root = (int(own["lo"].iloc[0]), int(own["hi"].iloc[0]), own["first"].to_numpy(np.int64), own["units"].to_numpy(np.int64))
        return rows(nodes(root, 1, seed), own["sid"].to_numpy(), own["n"].to_numpy())

    kind = "sid bigint, n bigint, lo bigint, hi bigint, first bigint, units bigint"
    top = number.groupBy(F.lit(1).alias("one")).applyInPandas(upper, kind)
    return top.groupBy("lo").applyInPandas(lower, kind).select("sid", "n", F.col("lo").cast("int").alias("shard"), "first", "units")


def plan(sized: DataFrame, seed: int = SEED) -> tuple[DataFrame, Shape]:
    """The blocks that a mix takes of sized(doc_id, source, size), and the mix's shape.

    Columns: source, source_size, target, n_blocks (hash range), block, passes (array of whole or partial passes with
    their shard), cut (in the last pass, documents up to this hash are taken; null: all). One row for each block, taken or
    not: blocks grow with the words of the corpus, not with the number of documents.
    """
    sizes = common.written(sized.groupBy("source").agg(F.sum("size").alias("source_size")), "source-sizes")
    total = sizes.agg(F.sum("source_size")).first()[0] or 0
    made = shape(total)
    share = F.ceil(F.lit(made.blocks) * F.col("source_size") / F.lit(max(total, 1))).cast("bigint")
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("bigint")
    sources = targets(sizes).withColumn("n_blocks", F.greatest(F.lit(1), share)).withColumn("whole", whole).withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size"))
    sources = common.written(sources, "sources")
    keyed = placed(sized, sources, seed)
    in_block = keyed.groupBy("sid", "block").agg(F.sum("size").alias("words"))
    ranked = common.running(in_block.withColumn("place", F.xxhash64("block", F.lit(seed))), ["sid"], ["place", "block"], "words")
    sums = ranked.join(sources, "sid")
    kind = F.when(F.col("upto") <= F.col("rest"), 1).when((F.col("upto") - F.col("words") < F.col("rest")), 2).otherwise(0)
    sums = common.written(sums.withColumn("kind", kind), "blocks")
    # within the block that the target ends in: documents by hash, as far as their middle is not beyond
    ends = sums.where("kind = 2").select("sid", "block", (F.col("rest") - F.col("upto") + F.col("words")).alias("room"))
    # equal hashes go together
    same = keyed.join(ends, ["sid", "block"]).groupBy("sid", "room", "h").agg(F.sum("size").alias("size"))
    upto = F.sum("size").over(W.partitionBy("sid").orderBy("h"))
    cuts = same.withColumn("upto", upto).where(F.col("upto") - F.col("size") / 2 <= F.col("room")).groupBy("sid").agg(F.max("h").alias("cut"))
    number = sums.groupBy("sid").agg(F.count("*").alias("n"), (F.count("*") * F.max("whole") + F.count_if(F.col("kind") > 0)).alias("quota"))
    unit = _tree(number, made.shards, seed).select("sid", "n", "shard", F.explode(F.sequence("first", F.col("first") + F.col("units") - 1)).alias("unit"))
    passes = unit.groupBy("sid", (F.col("unit") % F.col("n")).alias("rank")).agg(F.array_sort(F.collect_list(F.struct(F.floor(F.col("unit") / F.col("n")).cast("int").alias("turn"), "shard"))).alias("passes"))
    out = sums.join(passes, ["sid", "rank"], "left").join(cuts.withColumn("kind", F.lit(2)), ["sid", "kind"], "left")
    none = F.array().cast("array<struct<turn:int,shard:int>>")
    out = out.select("source", "sid", "source_size", "target", "n_blocks", "block", F.coalesce("passes", none).alias("passes"), "whole", F.when(F.col("kind") == 2, F.coalesce("cut", F.lit(-(1 << 63)))).alias("cut"))
    found = common.written(out, "plan")
    common.discard(sizes, sources, sums, ranked)
    return found, made


def placed(docs: DataFrame, sources: DataFrame, seed: int = SEED) -> DataFrame:
    """docs(doc_id, source, ...) with its source's columns, a hash h of doc_id, and its block."""
    s = sources.select(F.col("source").alias("_s"), *[c for c in sources.columns if c != "source"])
    h = F.xxhash64("doc_id", F.lit(seed))
    return docs.join(s, docs["source"].eqNullSafe(s["_s"])).drop("_s").withColumn("h", h).withColumn("block", F.pmod(F.xxhash64("h"), F.col("n_blocks")))


def drawn(docs: DataFrame, blocks: DataFrame, seed: int = SEED) -> DataFrame:
    """docs(doc_id, source, row) with source_size, target, and passes: an array of (turn, shard), one for each copy that the mix takes."""
    sources = blocks.select("source", "sid", "source_size", "target", "n_blocks").distinct()
    out = placed(docs.select("doc_id", "source", "row"), sources, seed).join(blocks.select("sid", "block", "passes", "whole", "cut"), ["sid", "block"])
    taken = F.filter("passes", lambda p: (p["turn"] < F.col("whole")) | F.col("cut").isNull() | (F.col("h") <= F.col("cut")))
    return out.select("doc_id", "source", "row", "source_size", "target", taken.alias("passes"))


def mix_sizes(docs: DataFrame) -> DataFrame:
    """Per row of docs(doc_id, source, text): doc_id, size, source_size, target, taken, shards (of each copy).

    Null texts have size 0; null is a source of its own, the last. Rows that repeat a doc_id are drawn together, null
    doc_ids too. Equal hashes are taken together. Empty tables give empty results; other columns are ignored. Of a text
    only its number of words is used, so that very long ones need no memory; a source misses its target by half a
    document at most, where hashes differ.
    """
    sized = common.written(docs.select(F.col("doc_id").cast("bigint"), "source", words().alias("size")), "sizes")
    blocks, _ = plan(sized)
    out = drawn(sized.withColumn("row", F.col("size")), blocks)
    return out.select("doc_id", F.col("row").alias("size"), "source_size", F.col("target").cast("double"), (F.col("row") * F.size("passes")).alias("taken"), F.col("passes.shard").alias("shards"))


def mix(docs: DataFrame) -> DataFrame:
    """The mix itself: rows of docs(doc_id, source, text, ...), each as often as it is taken, by shard and shuffled there.

    All columns come back as they are, whatever their names; the rest is as in mix_sizes().
    """
    sized = common.written(docs.select(F.col("doc_id").cast("bigint"), "source", words().alias("size")), "sizes")
    blocks, made = plan(sized)
    common.discard(sized)
    packed = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("source").alias("source"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    copies = drawn(packed, blocks).select("doc_id", "row", F.explode("passes").alias("pass"))
    order = F.xxhash64("doc_id", "pass.turn", "pass.shard", F.lit(SEED))
    return copies.select("row", F.col("pass.shard").alias("shard"), order.alias("order")).repartitionById(made.shards, F.col("shard")).sortWithinPartitions("order").select("row.*")
