"""Gold labels of nodes, variable nodes of websites, and validation of pages."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.text import normalize_node_text
from .tree import descendants


def by_text(nodes: DataFrame, labels: DataFrame) -> DataFrame:
    """page_id, label_key, group_idx, node_id: text nodes whose normal text equals a value of labels(page_id, label_key, values)."""
    wanted = labels.select("page_id", "label_key", F.posexplode("values").alias("group_idx", "value")).withColumn("_t", normalize_node_text(F.col("value")))
    own = nodes.where("is_text").select("page_id", "node_id", normalize_node_text(F.col("text")).alias("_t"))
    return own.join(wanted, ["page_id", "_t"]).select("page_id", "label_key", "group_idx", "node_id")


def expanded(nodes: DataFrame, gold: DataFrame, leaves: bool = True) -> DataFrame:
    """gold with the leaves (or all descendants) of inner nodes in their stead."""
    tops = gold.select("page_id", F.col("node_id").alias("top_id")).distinct()
    below = descendants(nodes, tops, leaves=leaves)
    g = gold.withColumnRenamed("node_id", "top_id")
    joined = g.join(below, ["page_id", "top_id"], "left")
    return joined.select("page_id", "label_key", "group_idx", F.coalesce("node_id", "top_id").alias("node_id")).distinct()


def variable_xpaths(nodes: DataFrame, gold: DataFrame | None = None, least: int = 5, most: int = 300) -> DataFrame:
    """website, xpath of text nodes(website, page_id, xpath, text): XPaths of more than `least` distinct texts, the most
    varied first, up to `most` of a website; labelled ones always count, and use up the quota. With gold(website, xpath)."""
    stats = nodes.where("is_text").groupBy("website", "xpath").agg(F.count_distinct("text").alias("texts"), F.min(F.struct("page_id", "node_id")).alias("seen"))
    if gold is not None:
        stats = stats.join(gold.select("website", "xpath").distinct().withColumn("labeled", F.lit(True)), ["website", "xpath"], "left")
    else:
        stats = stats.withColumn("labeled", F.lit(False))
    stats = stats.withColumn("labeled", F.coalesce("labeled", F.lit(False)))
    wanted = (F.col("texts") > least) | F.col("labeled")
    w = W.partitionBy("website").orderBy(F.col("texts").desc(), "seen").rowsBetween(W.unboundedPreceding, 0)
    taken = F.sum(wanted.cast("int")).over(w)
    return stats.withColumn("taken", taken).where(F.col("labeled") | (wanted & (F.col("taken") <= most))).select("website", "xpath", "texts", "labeled")


def checks(pages: DataFrame, nodes: DataFrame, labels: DataFrame, gold: DataFrame) -> DataFrame:
    """One row for each page with a boolean for each rule, and valid = all of them."""
    values = labels.select("page_id", "label_key", F.size("values").alias("n_values"))
    found = gold.groupBy("page_id", "label_key").agg(F.count_distinct("node_id").alias("n_nodes"))
    enough = values.join(found, ["page_id", "label_key"], "left").groupBy("page_id").agg(F.every(F.coalesce("n_nodes", F.lit(0)) >= F.col("n_values")).alias("enough_nodes"), F.coalesce(F.sum("n_nodes"), F.lit(0)).alias("n_gold"))
    held = gold.join(nodes.select("page_id", "node_id", "is_text", "is_leaf", "text", *(["box"] if "box" in nodes.columns else [])), ["page_id", "node_id"], "left")
    empty = F.when(F.col("is_text"), normalize_node_text(F.col("text")) == "").otherwise(F.col("is_leaf"))
    keys = held.groupBy("page_id", "node_id").agg(F.count_distinct("label_key").alias("n_keys"), F.some(F.coalesce(empty, F.lit(True))).alias("empty"), *([F.every(F.col("box").isNotNull()).alias("boxed")] if "box" in nodes.columns else [F.lit(True).alias("boxed")]))
    per = keys.groupBy("page_id").agg(F.every(F.col("n_keys") == 1).alias("one_label"), F.every(~F.col("empty")).alias("no_empty"), F.every("boxed").alias("all_boxed"))
    out = pages.select("page_id", *(["visuals"] if "visuals" in pages.columns else [])).join(enough, "page_id", "left").join(per, "page_id", "left")
    has = F.col("visuals").isNotNull() if "visuals" in pages.columns else F.lit(True)
    rules = {
        "enough_nodes": F.coalesce("enough_nodes", F.lit(True)), "no_empty": F.coalesce("no_empty", F.lit(True)), "some_gold": F.coalesce("n_gold", F.lit(0)) > 0,
        "one_label": F.coalesce("one_label", F.lit(True)), "has_visuals": has, "all_boxed": F.coalesce("all_boxed", F.lit(True)),
    }
    flags = out.select("page_id", *[c.alias(n) for n, c in rules.items()])
    valid = F.lit(True)
    for n in rules:
        valid = valid & F.col(n)
    return flags.withColumn("valid", valid)


def summary(checked: DataFrame) -> DataFrame:
    return checked.agg(F.count_if(~F.col("valid")).alias("invalid"), F.count("*").alias("tested"))


def first_invalid(pages: DataFrame, check: Callable[[DataFrame], DataFrame], most: int, key: str = "page_id", first: int = 64) -> tuple[list, int, int]:
    """The first `most` invalid pages by key, how many pages were tested up to the last of them, and the slices read.

    check(pages) gives key and valid. Pages are checked in slices by ranges of the key, the first of `first` keys, each
    next twice as wide; once enough are found, later pages are not read. Keys are integers; the driver sees `most` of them.
    """
    ends = pages.agg(F.min(key), F.max(key)).first()
    found, tested, slices, wide = [], 0, 0, first
    lo = ends[0]
    while lo is not None and lo <= ends[1] and len(found) < most:
        own = pages.where((F.col(key) >= lo) & (F.col(key) < lo + wide))
        bad = sorted(r[0] for r in check(own).where("not valid").select(key).orderBy(key).limit(most - len(found)).collect())
        found += bad
        tested += own.where(F.col(key) <= bad[-1]).count() if len(found) >= most else own.count()
        lo, wide, slices = lo + wide, wide * 2, slices + 1
    return found, tested, slices
