"""Tree operators on any table with node_id, parent_id, tag, sib_pos and (where noted) interval ends and ancestor arrays."""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..sources.scratch import discard, written


def same_tag_index(nodes: DataFrame, tree: str = "page_id") -> DataFrame:
    """Index from 0 among siblings of one tag; null for an only one."""
    w = W.partitionBy(tree, "parent_id", "tag")
    n = F.count("*").over(w)
    return nodes.withColumn("same_tag_index", F.when(n > 1, F.row_number().over(w.orderBy("sib_pos", "node_id")) - 1))


def xpath_element(tag: Column, same: Column) -> Column:
    return F.concat(F.lit("/"), F.when(tag == "-text", "text()").otherwise(tag), F.when(same.isNotNull(), F.concat(F.lit("["), (same + 1).cast("string"), F.lit("]"))).otherwise(""))


def with_paths(nodes: DataFrame, tree: str = "page_id") -> DataFrame:
    """Adds depth, xpath, index_path, anc_ids and anc_tags, for trees of any depth.

    Each round doubles the stretch of ancestors that a node knows, by one join on its farthest known one; the rows of a
    round are written, and only nodes that have not reached their root take part in the next. A node whose parent has no
    row is a root.
    """
    indexed = same_tag_index(nodes, tree)
    own = F.struct(F.col("node_id").cast("bigint").alias("id"), "tag", xpath_element(F.col("tag"), F.col("same_tag_index")).alias("step"), F.col("sib_pos").cast("int").alias("pos"))
    now = written(indexed.withColumn("_chain", F.array(own)).withColumn("_up", F.col("parent_id").cast("bigint")), "paths")
    done = []
    while True:
        done.append(now.where("_up is null"))
        above = now.select(tree, F.col("node_id").cast("bigint").alias("_up"), F.col("_chain").alias("_c"), F.col("_up").alias("_u"))
        for before in done[:-1]:
            above = above.unionByName(before.select(tree, F.col("node_id").cast("bigint").alias("_up"), F.col("_chain").alias("_c"), F.col("_up").alias("_u")))
        left = now.where("_up is not null")
        after = written(left.join(above, [tree, "_up"], "left").withColumn("_chain", F.when(F.col("_c").isNull(), F.col("_chain")).otherwise(F.concat("_c", "_chain"))).withColumn("_up", F.col("_u")).select(*now.columns), "paths")
        if after.isEmpty():
            discard(after)
            break
        now = after
    found = reduce(DataFrame.unionByName, done)
    anc = F.slice("_chain", 1, F.size("_chain") - 1)
    return found.select(
        *indexed.columns, (F.size("_chain") - 1).alias("depth"), F.array_join(F.col("_chain.step"), "").alias("xpath"), F.slice("_chain.pos", 2, F.size("_chain")).alias("index_path"), F.transform(anc, lambda x: x["id"]).alias("anc_ids"), F.transform(anc, lambda x: x["tag"]).alias("anc_tags")
    )


def ancestors(anc: Column, n: int) -> Column:
    """Up to n ancestors, from the parent upward."""
    return F.slice(F.reverse(anc), 1, n)


def ancestor_chain(anc: Column, own: Column, n: int) -> Column:
    """Exactly n ancestors, farthest first; the root (of a root: itself) is repeated in front."""
    root = F.coalesce(F.get(anc, F.lit(0)), own)
    some = F.reverse(ancestors(anc, n))
    return F.concat(F.array_repeat(root, F.lit(n) - F.size(some)), some)


def all_ancestors(anc: Column, own: Column) -> Column:
    return F.concat(anc, F.array(own))


def distance(a: Column, b: Column) -> Column:
    return F.abs(a - b)


def descendants(nodes: DataFrame, tops: DataFrame, tree: str = "page_id", leaves: bool = False) -> DataFrame:
    """top_id and node_id of all nodes below tops(tree, top_id).

    Nodes in preorder with end_id, their subtree's last number, need no paths: a top's interval covers up to three blocks as
    wide as itself (by powers of two), and meets the nodes of those alone. Nodes with anc_ids only are found by equality with
    one of their ancestors.
    """
    own = nodes.where("is_leaf") if leaves else nodes
    if "end_id" in nodes.columns:
        first, last = F.col("top_id").cast("bigint"), F.col("end_id").cast("bigint")
        ends = tops.select(tree, "top_id").join(nodes.select(tree, F.col("node_id").alias("top_id"), "end_id"), [tree, "top_id"]).where(last > first)
        ends = ends.withColumn("_level", F.floor(F.log2((last - first).cast("double"))).cast("int"))
        levels = sorted(r[0] for r in ends.select("_level").distinct().collect())  # 63 at most
        block = lambda c, level: F.floor(c / F.pow(F.lit(2.0), level)).cast("bigint")
        wide = ends.select(tree, "top_id", "end_id", "_level", F.explode(F.sequence(block(first, F.col("_level")), block(last, F.col("_level")))).alias("_block"))
        place = F.explode(F.array(*[F.struct(F.lit(k).alias("_level"), block(F.col("node_id"), F.lit(k)).alias("_block")) for k in levels or [0]]))
        each = own.select(tree, "node_id", place.alias("_at")).select(tree, "node_id", "_at.*")
        return each.join(wide, [tree, "_level", "_block"]).where("node_id > top_id and node_id <= end_id").select(tree, "top_id", "node_id")
    up = own.select(tree, "node_id", F.explode("anc_ids").alias("top_id"))
    return up.join(tops.select(tree, "top_id"), [tree, "top_id"]).select(tree, "top_id", "node_id")


def unwrapped(nodes: DataFrame, tags: tuple[str, ...] = ("span", "div"), tree: str = "page_id") -> DataFrame:
    """semantic_id and semantic_tag: a text's parent, then upward while the node has one of tags and is an only child.

    node_id numbers each tree in preorder, so that an only child follows its parent at once: a chain of wrappers of any
    length ends at the last node before it that is none.
    """
    wraps = F.col("tag").isin(*tags) & F.col("parent_id").isNotNull()
    base = nodes.select(tree, "node_id", "parent_id", "tag", (wraps & (F.count("*").over(W.partitionBy(tree, "parent_id")) == 1)).alias("_wrapper"))
    upto = W.partitionBy(tree).orderBy("node_id").rowsBetween(W.unboundedPreceding, W.currentRow)
    ends = base.select(tree, F.col("node_id").alias("_up"), F.last(F.when(~F.col("_wrapper"), F.struct(F.col("node_id").alias("id"), "tag")), ignorenulls=True).over(upto).alias("_end"))
    now = base.select(tree, "node_id", F.when(F.col("tag") == "-text", F.coalesce("parent_id", "node_id")).when(wraps, F.col("parent_id")).otherwise(F.col("node_id")).alias("_up"), F.when((F.col("tag") != "-text") & ~wraps, F.struct(F.col("node_id").alias("id"), "tag")).alias("_own"))
    found = now.join(ends, [tree, "_up"]).withColumn("_end", F.coalesce("_own", "_end"))
    return found.select(tree, "node_id", F.col("_end.id").alias("semantic_id"), F.col("_end.tag").alias("semantic_tag"))


def text_or_tag(tag: Column, text: Column) -> Column:
    return F.when(tag == "-text", F.concat(F.lit("="), text)).otherwise(F.concat(F.lit("<"), tag, F.lit(">")))
