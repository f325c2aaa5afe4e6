"""Queries on parsed pages, visuals, the classifier and the request stream."""
from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import urls, visual
from ..functions.text import normalize_node_text
from ..operators import css, evaluate, features, html, labels, model, neighbors, tree, visuals
from ..sources.scratch import shared_dir, written
from ..streaming import inference
from . import dom_sql
from .registry import Tables, query
from .tree_queries import KNN_SQL, boxes


def _nodes(t: Tables) -> DataFrame:
    return html.dom_nodes(t.pages)


@query("D1 D2 D12 P8-P10", dom_sql.NODES)
def dom_nodes(t: Tables) -> DataFrame:
    return _nodes(t).groupBy("page_id").agg(F.count("*").alias("nodes"), F.count_if("is_text").alias("texts"), F.max("depth").alias("depth"), F.max("end_id").alias("last"))


@query("D5 D6 D34", dom_sql.XPATHS)
def dom_xpath(t: Tables) -> DataFrame:
    return _nodes(t).select("page_id", "node_id", "xpath", F.array_join(F.col("index_path").cast("array<string>"), ".").alias("index_path"))


@query("D3 D13 D14 D15 D16 F10", dom_sql.TAGS)
def dom_semantic(t: Tables) -> DataFrame:
    n = _nodes(t)
    up = tree.unwrapped(n.select("page_id", "node_id", "parent_id", "tag"))
    return n.join(up, ["page_id", "node_id"]).select("page_id", "node_id", tree.text_or_tag(F.col("tag"), normalize_node_text(F.col("text"))).alias("shown"), F.col("attrs")["class"].alias("class"), "semantic_tag")


@query("D26 S20 P14 A4", dom_sql.VARIABLE)
def dom_variable_xpaths(t: Tables) -> DataFrame:
    sites = t.pages.select(F.col("page_id").cast("bigint").alias("page_id"), urls.host(F.col("url")).alias("website"))
    return labels.variable_xpaths(_nodes(t).join(sites, "page_id"))


@query("D17 J7 M4")
def dom_friends(t: Tables) -> DataFrame:
    texts = _nodes(t).where("is_text").select("page_id", F.col("node_id").cast("bigint").alias("node_id"), F.col("anc_ids").cast("array<bigint>").alias("anc_ids"))
    pairs = neighbors.friends(texts)
    return pairs.groupBy("page_id", "node_id").agg(F.array_sort(F.collect_list("friend_id")).alias("friends"))


def _title_labels(t: Tables) -> DataFrame:
    """The text of a page's heading is the value of its title label."""
    title = normalize_node_text(F.regexp_extract("html", r"(?s)<h1[^>]*>([^<]*)", 1))
    return t.pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.lit("title").alias("label_key"), F.array(title).alias("values"))


@query("D22 D23 D25 J1 J13", dom_sql.LABELS)
def dom_labels(t: Tables) -> DataFrame:
    return labels.by_text(_nodes(t), _title_labels(t))


@query("V1-V5 V7 V9 A18 A24", dom_sql.VALID)
def dom_validate(t: Tables) -> DataFrame:
    n, wanted = _nodes(t), _title_labels(t)
    return labels.checks(t.pages.select(F.col("page_id").cast("bigint").alias("page_id")), n, wanted, labels.by_text(n, wanted))


@query("V1-V5 V7", dom_sql.VALID_VISUALS)
def dom_validate_visuals(t: Tables) -> DataFrame:
    """All rules, with visuals and boxes: every third page has no visuals, and only headings of pages of even number have boxes."""
    wanted = _title_labels(t)
    boxed = F.when(F.col("page_id") % 2 == 0, '{"/html":{"/body":{"/article":{"/h1":{"/text()":{"box":[0,0,9,9]}}}}}}').otherwise("{}")
    pages = t.pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.when(F.col("page_id") % 3 != 0, boxed).alias("visuals"))
    n = written(visuals.attached(_nodes(t), visuals.visual_rows(pages)), "nodes")
    return labels.checks(pages, n, wanted, labels.by_text(n, wanted))


@query("D24 D21", dom_sql.SELECTORS)
def css_select(t: Tables) -> DataFrame:
    wanted = F.array(*[F.struct(F.lit(k).alias("label_key"), F.lit(s).alias("selector")) for k, s in (("links", "nav li > a[href]"), ("title", "article h1"), ("ads", "div.ad"), ("after", "h1 + p"), ("bad", "p:nope"))])
    return css.select_pages(t.pages, wanted)


def _visual_pages(t: Tables) -> DataFrame:
    """Pages with a visuals text: boxes for html, body and article, one element too many."""
    body = F.format_string('{"/html":{"box":[0,0,1000,%d],"/body":{"box":[0,0,1000,900],"fontSize":%d,"/article":{"box":[10,20,800,600],"color":"#ff0000ff","border":"2px solid red"},"/aside":{"box":[0,0,1,1]}}}}', F.lit(1000) + F.col("page_id"), F.col("page_id") % 30)
    return t.pages.select(F.col("page_id").cast("bigint").alias("page_id"), body.alias("visuals"))


@query("D27 D29 D30 J2 S16 G7 G15")
def visuals_attached(t: Tables) -> DataFrame:
    """Elements with a style, and the text fragments that have it from their parents."""
    rows = visuals.visual_rows(_visual_pages(t))
    n = visuals.attached(_nodes(t), rows).where("style is not null")
    named = {a.name: a for a in visual.ATTRIBUTES}
    style = F.col("style")
    return n.select("page_id", "node_id", "tag", F.col("box.w").alias("width"), visual.parsed(style, named["fontSize"]).alias("font_size"), visual.parsed(style, named["lineHeight"]).alias("line_height"), visual.loaded(style, named["color"]).alias("color"), visual.border_widths(style).alias("border"))


@query("P15 P22", dom_sql.SELECTED)
def visuals_selected(t: Tables) -> DataFrame:
    """Nodes with a box, and labelled ones without; of the attributes all but the disabled of the enabled."""
    rows = visuals.projected(visuals.visual_rows(_visual_pages(t)), enabled=["color", "fontSize", "border"], disabled=["border"])
    n = written(_nodes(t), "nodes")
    out = visuals.sought(n, rows, labels.by_text(n, _title_labels(t)))
    return out.select("page_id", "xpath", "tag", F.col("box").isNotNull().alias("boxed"), F.to_json(F.map_from_entries(F.array_sort(F.map_entries("style")))).alias("style"))


@query("D28 V6 V8", dom_sql.MISMATCHES)
def visuals_mismatches(t: Tables) -> DataFrame:
    return visuals.mismatches(_nodes(t), visuals.visual_rows(_visual_pages(t)))


@query("D33 J14 S27", dom_sql.BLENDED)
def visuals_blended(t: Tables) -> DataFrame:
    out = visuals.blended(_nodes(t), visuals.visual_rows(_visual_pages(t)))
    return out.select("page_id", "xpath", "tag", F.to_json(F.map_from_entries(F.array_sort(F.map_entries("attrs")))).alias("attrs"))


@query("M6 M7 M8 E8 E9 E10 G14 P28")
def mlp_train_predict(t: Tables) -> DataFrame:
    """Headings among text nodes, from depth, length and ancestor tags; fitted on pages of even number."""
    n = _nodes(t).where("is_text")
    up = features.ancestor_tags(F.col("anc_tags"), ["nav", "article", "footer", "p", "a"])
    rows = n.select("page_id", "node_id", F.col("depth").cast("double").alias("f0"), F.length(normalize_node_text(F.col("text"))).cast("double").alias("f1"), *[F.get(up, F.lit(k)).alias(f"f{k + 2}") for k in range(5)], F.array_contains("anc_tags", "h1").cast("double").alias("y"))
    fitted = model.fit(rows.where("page_id % 2 = 0"), [f"f{k}" for k in range(7)], "y", 2, hidden=(10,), steps=30)
    out = model.predict(fitted, rows.where("page_id % 2 = 1"))
    return out.select("page_id", "node_id", "predicted", F.col("y").cast("int").alias("gold"), F.round(F.element_at("probabilities", 2), 4).alias("probability"))


@query("A13 A14 M8")
def mlp_scores(t: Tables) -> DataFrame:
    return evaluate.node_micro(mlp_train_predict(t), "predicted", "gold")


@query("M5 D18 D20", KNN_SQL + ", e AS (SELECT k.page_id, k.node_id, exp(-distance / 10) AS w, o.x, o.y FROM k JOIN b o ON o.page_id = k.page_id AND o.node_id = k.neighbor_id) SELECT page_id, node_id, round(sum(w * x) / sum(w), 6) AS x, round(sum(w * y) / sum(w), 6) AS y FROM e GROUP BY ALL")
def neighbor_attention(t: Tables) -> DataFrame:
    """Mean of the vectors of the two nearest line items, weighted by nearness."""
    near = neighbors.center_lists(boxes(t), 2)
    v = near.select("page_id", "node_id", features.weighted_list(F.col("near"), lambda n: -n["distance"] / 10, lambda n: F.array(n["x"], n["y"])).alias("vector"))
    return v.select("page_id", "node_id", *[F.round(F.element_at("vector", k), 6).alias(c) for k, c in ((1, "x"), (2, "y"))])


def _classified(t: Tables) -> tuple[DataFrame, DataFrame]:
    """Nodes of pages of even and of odd number with their class y: 1 texts of headings, 2 links."""
    y = F.when(F.col("is_text") & (F.element_at("anc_tags", -1) == "h1"), 1).when(F.col("tag") == "a", 2).otherwise(0)
    n = written(_nodes(t).withColumn("y", y), "nodes")
    return n.where("page_id % 2 = 0"), n.where("page_id % 2 = 1")


@query("X1 E8 E9 E10 S23")
def training_epochs(t: Tables) -> DataFrame:
    """Two epochs with validation; the best checkpoint is read back, and predicts the validation pages."""
    train, val = _classified(t)
    path = f"{shared_dir(t.spark)}/training-{uuid.uuid4().hex}"
    model.train(train, val, features.NodeFeatures().prepare(train), "y", ["title", "link"], path, epochs=2, steps=15, hidden=(8,))
    best = model.load_checkpoint(t.spark, path)
    out = model.predict(best.model, features.NodeFeatures.restored(best.features).compute(val))
    return out.select("page_id", "node_id", "y", F.get(F.array(F.lit("none"), *[F.lit(x) for x in best.labels]), F.col("predicted")).alias("label"))


@query("S25 S15 E7 P25 P26 P17")
def stream_inference(t: Tables) -> DataFrame:
    """Pages as JSON requests, answered with a fitted classifier's predictions by a stream that runs until all are read."""
    spark = t.spark
    base = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    asked = t.pages.join(_visual_pages(t), "page_id").select(F.col("page_id").cast("string").alias("request_id"), "url", "html", "visuals")
    asked.write.json(f"{base}/in")
    train, val = _classified(t)
    best = model.train(train, val, features.NodeFeatures().prepare(train), "y", ["title", "link"], f"{base}/model", epochs=1, steps=15, hidden=(8,))
    inference.serve(spark, f"{base}/in", f"{base}/out", f"{base}/state", features.NodeFeatures.restored(best.features), best.model, best.labels).awaitTermination()
    return spark.read.schema("request_id string, response string, batch int").json(f"{base}/out").select("request_id", "response")


@query("W4 D18 J6", "SELECT label, vec_id, neighbor_id, round(d, 6) AS distance, rank::BIGINT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY label, vec_id ORDER BY round(d, 6), neighbor_id) AS rank FROM (SELECT a.label, a.vec_id, b.vec_id AS neighbor_id, list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS d FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id <> b.vec_id)) WHERE rank <= 4")
def knn_embeddings(t: Tables) -> DataFrame:
    """Four nearest vectors of the same label by Euclidean distance."""
    return neighbors.knn_vectors(t.embeddings, "label", "vec_id", "embedding", 4).withColumn("rank", F.col("rank").cast("bigint"))
