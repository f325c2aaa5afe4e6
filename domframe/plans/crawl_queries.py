"""Queries of crawl states and counts, exploration of labels, registries, and nested sinks."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import normalize_node_text
from ..operators import crawls, exploration, features, labels, neighbors, visuals
from ..sources.scratch import written
from . import dom_sql
from .dom_queries import _nodes, _title_labels, _visual_pages
from .registry import Tables, query
from .text_queries import BASIC, BERT

COUNTER = "CASE event_type WHEN 'click' THEN 'live' WHEN 'view' THEN 'offline' WHEN 'error' THEN 'timeout' END"


@query("A19", f"SELECT counter, count(*) AS n FROM (SELECT {COUNTER} AS counter FROM events UNION ALL SELECT CASE WHEN event_type <> 'error' THEN (200 + event_id % 3)::VARCHAR END FROM events) WHERE counter IS NOT NULL GROUP BY counter")
def request_counts(t: Tables) -> DataFrame:
    """Events as requests: clicks live, views offline, errors without an answer."""
    kind = F.col("event_type")
    rows = t.events.select(F.when(kind == "click", "live").when(kind == "view", "offline").when(kind == "error", "timeout").alias("outcome"), F.when(kind != "error", 200 + F.col("event_id") % 3).alias("status"))
    return crawls.request_counts(rows)


@query("A19", "SELECT user_id AS page_id, count(*) FILTER (WHERE event_type = 'view' AND event_id % 5 > 0) AS css_success, count(*) FILTER (WHERE event_type = 'view' AND event_id % 5 = 0) AS css_error FROM events GROUP BY user_id")
def style_counts(t: Tables) -> DataFrame:
    rows = t.events.withColumnRenamed("user_id", "page_id")
    return crawls.style_counts(rows, F.col("event_type") == "view", F.col("event_id") % 5 == 0)


@query("C6 C8 I12", "SELECT page_id, CASE WHEN page_id % 4 = 0 THEN 'HtmlNonExistent' WHEN page_id % 3 = 0 THEN 'JsonNonExistent' ELSE 'Valid' END AS result FROM pages")
def validate_only(t: Tables) -> DataFrame:
    """Which pages have been extracted, by what was kept of them."""
    p = t.pages.select("page_id")
    return crawls.validated(p, p.where("page_id % 4 > 0"), p.where("page_id % 3 > 0"), ["page_id"])


@query("C8 I19 I22")
def blend_only(t: Tables) -> DataFrame:
    """Pages with visuals blended, every second on its exact version."""
    from ..operators import html

    pages = t.pages.select("page_id", "html").join(_visual_pages(t), "page_id")
    exact = pages.where("page_id % 2 = 0").select("page_id", F.concat("html", F.lit("<footer>exact</footer>")).alias("html"))
    out = crawls.blend_only(pages.withColumn("visuals", F.when(F.col("page_id") % 5 > 0, F.col("visuals"))), exact, html.dom_nodes)
    return out.groupBy("page_id").agg(F.count("*").alias("rows"), F.count_if("styled").alias("styled"), F.count_if(F.col("tag") == "footer").alias("footers"))


@query("C12", dom_sql.EXTRACTION)
def extraction_counts(t: Tables) -> DataFrame:
    return crawls.extraction_counts(_nodes(t), True, ["a", "br"])


@query("I3", dom_sql.PREDICTED)
def predicted_labels(t: Tables) -> DataFrame:
    """Headings' texts and links as predictions, and these as gold."""
    n = written(_nodes(t), "nodes")
    said = n.where("is_text").withColumn("label_key", F.when(F.element_at("anc_tags", -1) == "h1", "title").when(F.element_at("anc_tags", -1) == "a", "link")).where("label_key is not null")
    return exploration.predicted_gold(n, said.select("page_id", "node_id", "label_key", (F.col("node_id") % 7).alias("confidence")))


@query("P24 D20")
def explore_wide(t: Tables) -> DataFrame:
    """What a model sees of each labelled node: attributes, two ancestors and two neighbours in the document."""
    n = written(visuals.attached(_nodes(t), visuals.visual_rows(_visual_pages(t))), "nodes")
    gold = labels.by_text(n, _title_labels(t))
    places = n.where("is_text").select("page_id", "node_id", F.col("node_id").cast("double").alias("x"), F.lit(0.0).alias("y"), F.lit(0.0).alias("w"), F.lit(0.0).alias("h"))
    edges = neighbors.knn_center(places, 2)
    return exploration.wide(n, gold, t.pages.select("page_id", "url"), ["color", "fontSize"], ["class", "id"], 2, edges, 2)


@query("P25", dom_sql.EXPLORED)
def explore_labels(t: Tables) -> DataFrame:
    n = written(visuals.attached(_nodes(t), visuals.visual_rows(_visual_pages(t))), "nodes")
    out = exploration.explored(n, labels.by_text(n, _title_labels(t)))
    return out.select("page_id", "label_key", "xpath", normalize_node_text(F.col("text")).alias("text"), "tag", F.col("box.w").alias("width"))


@query("A23")
def label_tags(t: Tables) -> DataFrame:
    """Tags of the elements that hold a page's heading, on five pages of each website."""
    from ..functions import urls

    n = written(_nodes(t), "nodes")
    sites = t.pages.select(F.col("page_id").cast("bigint").alias("page_id"), urls.host(F.col("url")).alias("website"))
    gold = labels.by_text(n, _title_labels(t)).select("page_id", "node_id")
    up = n.select("page_id", "node_id", "parent_id").join(gold, ["page_id", "node_id"], "left_semi").select("page_id", F.col("parent_id").alias("node_id"))
    return exploration.tag_histogram(n, up, sites)


@query("A25", "SELECT count(DISTINCT l_orderkey) FILTER (WHERE l_orderkey % 4 > 0) AS read, count(DISTINCT l_orderkey) AS pages, round(count(*) FILTER (WHERE l_orderkey % 4 > 0) + count(*) FILTER (WHERE l_orderkey % 4 > 0)::DOUBLE / count(DISTINCT l_orderkey) FILTER (WHERE l_orderkey % 4 > 0) * (count(DISTINCT l_orderkey) - count(DISTINCT l_orderkey) FILTER (WHERE l_orderkey % 4 > 0)))::BIGINT AS expected FROM lineitem")
def length_estimate(t: Tables) -> DataFrame:
    """Line items to expect in all orders when three of four have been read."""
    items = t.lineitem.select(F.col("l_orderkey").alias("page_id"))
    return exploration.length_estimate(items.where("page_id % 4 > 0"), items)


@query("S34", "SELECT lang, source, count(*) AS n, count(*) FILTER (WHERE n_chars > 500) AS available, count(*) FILTER (WHERE n_chars > 500) / count(*) AS share FROM documents GROUP BY lang, source")
def visual_availability(t: Tables) -> DataFrame:
    """Documents of some length as pages with visuals, by language and source as vertical and category."""
    return exploration.availability(t.documents.withColumn("has", F.col("n_chars") > 500), ["lang", "source"], "has")


@query("X5 F5 F6", f"SELECT 'basic' AS tokenizer, sum(len({BASIC}))::BIGINT AS tokens FROM documents UNION ALL SELECT 'bert', sum(len({BERT}))::BIGINT FROM documents UNION ALL SELECT 'spaces', sum(len(list_filter(string_split(text, ' '), lambda x: x <> '')))::BIGINT FROM documents")
def tokenizer_choice(t: Tables) -> DataFrame:
    """Tokens of all documents by each tokenizer of the registry that SQL knows."""
    out = None
    for name in ("basic", "bert", "spaces"):
        own = t.documents.select(F.lit(name).alias("tokenizer"), F.size(features.tokenizer(name)(F.col("text"))).alias("n")).groupBy("tokenizer").agg(F.sum("n").cast("bigint").alias("tokens"))
        out = own if out is None else out.unionByName(own)
    return out


@query("X6 A26", "SELECT l_orderkey, " + ", ".join(f"round({f}(embedding[{k}]::DOUBLE), 5) AS {f}_{k}" for f in ("sum", "max", "min") for k in (1, 64)) + " FROM lineitem JOIN embeddings ON vec_id = l_partkey GROUP BY l_orderkey")
def vector_aggregates(t: Tables) -> DataFrame:
    """Sum, maximum and minimum of the vectors of an order's parts."""
    words, out = t.lineitem.select("l_orderkey", F.col("l_partkey").alias("vec_id")), None
    for how in ("sum", "max", "min"):
        v = features.vector_aggregate(words, "l_orderkey", t.embeddings, "vec_id", "embedding", how)
        own = v.select("l_orderkey", *[F.round(F.element_at("vector", k), 5).alias(f"{how}_{k}") for k in (1, 64)])
        out = own if out is None else out.join(own, "l_orderkey")
    return out


@query("F8", "SELECT o_custkey, array_to_string(list(o_orderpriority ORDER BY o_orderkey), '|') AS tokens FROM orders GROUP BY o_custkey")
def tokens_by_id(t: Tables) -> DataFrame:
    """Priorities of a customer's orders as numbers of a vocabulary, and the words of these numbers again."""
    rows = t.orders.groupBy("o_custkey").agg(F.transform(F.array_sort(F.collect_list(F.struct("o_orderkey", "o_orderpriority"))), lambda x: x["o_orderpriority"]).alias("words"))
    vocabulary = features.tag_dictionary(t.orders.select(F.col("o_orderpriority").alias("tag"))).select(F.col("tag").alias("token"), "id")
    ids = features.token_ids(rows, "o_custkey", "words", vocabulary)
    return features.tokens_by_id(ids, "o_custkey", "ids", vocabulary).select("o_custkey", F.array_join("tokens", "|").alias("tokens"))


@query("S27 D33")
def nested_xml(t: Tables) -> DataFrame:
    """Pages and their visuals as one nested XML text each."""
    return visuals.nested_xml(visuals.blended(_nodes(t), visuals.visual_rows(_visual_pages(t))))


@query("S27 S16", dom_sql.ROUND_TRIP)
def visuals_round_trip(t: Tables) -> DataFrame:
    """Visuals read to rows, written as recursive JSON, and read again."""
    again = visuals.nested_json(visuals.visual_rows(_visual_pages(t)))
    rows = visuals.visual_rows(again)
    return rows.select("page_id", "xpath", F.col("box.h").alias("height"), F.to_json(F.map_from_entries(F.array_sort(F.map_entries("attrs")))).alias("attrs"))
