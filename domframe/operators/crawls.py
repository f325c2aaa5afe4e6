"""States and counts of a crawl as tables: what its requests became, which pages are extracted, and what extraction did."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .visuals import blended, visual_rows

#: Outcomes of a request that are counted by name; all others by their status.
OUTCOMES = ("undef", "aborted", "unhandled", "offline", "live", "ignored", "disabled", "timeout")


def request_counts(requests: DataFrame, outcome: str = "outcome", status: str = "status") -> DataFrame:
    """counter and n of requests(outcome, status): each outcome by name, each status by its number; those that occur."""
    counters = F.array_compact(F.array(F.when(F.col(outcome).isin(*OUTCOMES), F.col(outcome)), F.col(status).cast("string")))
    return requests.select(F.explode(counters).alias("counter")).groupBy("counter").agg(F.count("*").alias("n"))


def request_summary(counts: DataFrame) -> DataFrame:
    """One row: summary, the counters that are not zero, names in their fixed order before statuses in numeric order."""
    place = F.array_position(F.array(*[F.lit(x) for x in OUTCOMES]), F.col("counter"))
    order = F.struct(F.when(place > 0, place).otherwise(len(OUTCOMES) + 1).alias("a"), F.expr("try_cast(counter AS int)").alias("b"), F.format_string("%s: %d", "counter", "n").alias("s"))
    return counts.where("n > 0").agg(F.array_join(F.transform(F.array_sort(F.collect_list(order)), lambda x: x["s"]), ", ").alias("summary"))


def style_counts(requests: DataFrame, kind: Column, failed: Column, by: str = "page_id") -> DataFrame:
    """by, css_success, css_error: style sheets of each page that came and that failed; a page without any has zeros."""
    return requests.groupBy(by).agg(F.count_if(kind & ~failed).alias("css_success"), F.count_if(kind & failed).alias("css_error"))


VALID, NO_HTML, NO_JSON = "Valid", "HtmlNonExistent", "JsonNonExistent"


def validated(pages: DataFrame, htmls: DataFrame, jsons: DataFrame, keys: list[str]) -> DataFrame:
    """keys and result of pages(keys): whether the page of this version was kept, then whether its attributes were."""
    held = lambda df, name: df.select(*keys).distinct().withColumn(name, F.lit(True))
    out = pages.select(*keys).join(held(htmls, "_html"), keys, "left").join(held(jsons, "_json"), keys, "left")
    return out.select(*keys, F.when(F.col("_html").isNull(), NO_HTML).when(F.col("_json").isNull(), NO_JSON).otherwise(VALID).alias("result"))


def versioned(rows: DataFrame, by: list[str], version: str = "version") -> DataFrame:
    """One row of each page for the latest version: the exact one where it exists, else the latest; others are left out."""
    order = F.when(F.col(version) == "exact", 0).when(F.col(version) == "latest", 1)
    known = rows.withColumn("_order", order).where("_order is not null")
    least = known.groupBy(*by).agg(F.min("_order").alias("_order"))
    return known.join(least, [*by, "_order"], "left_semi").drop("_order")


def blend_only(pages: DataFrame, exact: DataFrame, nodes_of, key: str = "page_id") -> DataFrame:
    """blended() rows of pages(key, html, visuals) that have visuals: on exact(key, html) where it exists, else on their own html.

    nodes_of(pages) makes the nodes, as html.dom_nodes does.
    """
    own = pages.where("visuals is not null").join(exact.select(key, F.col("html").alias("_exact")), key, "left").withColumn("html", F.coalesce("_exact", "html")).drop("_exact")
    return blended(nodes_of(own), visual_rows(own))


def extraction_counts(nodes: DataFrame, only_text: bool, also_tags: list[str] | None = None, by: str = "page_id") -> DataFrame:
    """by, evaluated, skipped: nodes whose attributes an extraction reads. With only_text these are texts, their parents, and
    elements of also_tags; else all."""
    wanted = F.lit(True)
    if only_text:
        parents = nodes.where("is_text").select(by, F.col("parent_id").alias("node_id")).distinct().withColumn("_holds", F.lit(True))
        nodes = nodes.join(parents, [by, "node_id"], "left")
        wanted = F.col("is_text") | F.coalesce("_holds", F.lit(False)) | (F.col("tag").isin(*also_tags) if also_tags else F.lit(False))
    return nodes.groupBy(by).agg(F.count_if(wanted).alias("evaluated"), F.count_if(~wanted).alias("skipped"))
