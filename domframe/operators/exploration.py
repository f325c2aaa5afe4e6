"""Projections of labelled and predicted nodes for people who look at them, and predicted labels in place of gold."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import humanize, normalize_node_text
from .inputs import attribute_text
from .tree import text_or_tag

KEY = ["page_id", "node_id"]


def predicted_gold(nodes: DataFrame, predictions: DataFrame) -> DataFrame:
    """page_id, label_key, group_idx, node_id, value: predictions(page_id, node_id, label_key, confidence) in gold's place.

    Each predicted node is a group of its own, the most confident first (then by node); value is its normal text.
    """
    own = predictions.join(nodes.select(*KEY, "text"), KEY)
    item = F.struct((-F.col("confidence")).alias("o"), "node_id", normalize_node_text(F.coalesce("text", F.lit(""))).alias("value"))
    listed = own.groupBy("page_id", "label_key").agg(F.array_sort(F.collect_list(item)).alias("x"))
    return listed.select("page_id", "label_key", F.posexplode("x").alias("group_idx", "e")).select("page_id", "label_key", "group_idx", "e.node_id", "e.value")


def explored(nodes: DataFrame, gold: DataFrame) -> DataFrame:
    """page_id, label_key, xpath, text, tag, box of gold(page_id, label_key, node_id); nodes may lack box."""
    box = F.col("box") if "box" in nodes.columns else F.lit(None).cast("struct<x: double, y: double, w: double, h: double>").alias("box")
    return gold.select("page_id", "label_key", "node_id").distinct().join(nodes.select(*KEY, "xpath", "text", "tag", box), KEY).drop("node_id")


def wide(nodes: DataFrame, gold: DataFrame, urls: DataFrame, styles: list[str], attributes: list[str] | None = None, ancestors: int = 0, edges: DataFrame | None = None, neighbors: int = 0) -> DataFrame:
    """One row for each labelled node, as a model sees it: label_key (the least), value, url, a column for each of styles,
    attrs (humanised attribute text), anc_0 (the parent) to anc_<ancestors - 1> as <tag>[attributes], and neighbor_0 on as texts.

    nodes hold style where visuals were attached. urls(page_id, url); edges(page_id, node_id, neighbor_id, rank from 1).
    """
    attr = humanize(attribute_text(attributes)) if attributes else F.lit("")
    shown = text_or_tag(F.col("tag"), normalize_node_text(F.coalesce("text", F.lit(""))))
    value = F.regexp_replace(shown, "^=", "")
    own = nodes.join(gold.groupBy(*KEY).agg(F.min("label_key").alias("label_key")), KEY).join(urls.select("page_id", "url"), "page_id", "left")
    style = [(F.col("style")[s] if "style" in nodes.columns else F.lit(None).cast("string")).alias(s) for s in styles]
    out = own.select(*KEY, "label_key", value.alias("value"), "url", *style, attr.alias("attrs"), F.reverse("anc_ids").alias("_up"))
    if ancestors:
        above = nodes.select("page_id", F.col("node_id").alias("_anc"), F.concat(F.lit("<"), "tag", F.lit(">["), attr, F.lit("]")).alias("_shown"))
        each = out.select(*KEY, F.posexplode(F.slice("_up", 1, ancestors)).alias("_at", "_anc")).join(above, ["page_id", "_anc"])
        by = each.groupBy(*KEY).agg(*[F.max(F.when(F.col("_at") == k, F.col("_shown"))).alias(f"anc_{k}") for k in range(ancestors)])
        out = out.join(by, KEY, "left")
    if neighbors:
        other = nodes.select("page_id", F.col("node_id").alias("neighbor_id"), value.alias("_near"))
        near = edges.where(F.col("rank") <= neighbors).join(other, ["page_id", "neighbor_id"])
        by = near.groupBy(*KEY).agg(*[F.max(F.when(F.col("rank") == k + 1, F.col("_near"))).alias(f"neighbor_{k}") for k in range(neighbors)])
        out = out.join(by, KEY, "left")
    return out.drop("_up")


def tag_histogram(nodes: DataFrame, gold: DataFrame, sites: DataFrame, pages: int = 5) -> DataFrame:
    """website, tag, n: on how many of `pages` pages of a website, chosen by a hash, the label's nodes have this tag.

    gold(page_id, node_id) is of one label; sites(page_id, website).
    """
    from .relational import ranked

    chosen = ranked(sites.withColumn("_hash", F.xxhash64("page_id")), ["website"], ["_hash", "page_id"], "_place").where(F.col("_place") <= pages)
    tags = gold.join(nodes.select(*KEY, "tag"), KEY).select("page_id", "tag").distinct()
    return tags.join(chosen.select("page_id", "website"), "page_id").groupBy("website", "tag").agg(F.count("*").alias("n"))


def length_estimate(nodes: DataFrame, pages: DataFrame, prior: int = 2000) -> DataFrame:
    """One row: pages read and in all, and the nodes to expect in all: those seen, and the mean (or the prior) for each other page."""
    seen = nodes.groupBy("page_id").agg(F.count("*").alias("n")).agg(F.count("*").alias("read"), F.coalesce(F.sum("n"), F.lit(0)).alias("nodes"))
    total = pages.agg(F.count_distinct("page_id").alias("pages"))
    mean = F.when(F.col("read") > 0, F.col("nodes") / F.col("read")).otherwise(F.lit(float(prior)))
    return seen.join(total).select("read", "pages", F.round(F.col("nodes") + mean * (F.col("pages") - F.col("read"))).cast("bigint").alias("expected"))


def availability(pages: DataFrame, by: list[str], has: str) -> DataFrame:
    """by, n, available, share: pages, and those with visuals, of each group."""
    return pages.groupBy(*by).agg(F.count("*").alias("n"), F.count_if(F.col(has)).alias("available")).withColumn("share", F.col("available") / F.col("n"))
