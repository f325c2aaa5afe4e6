"""The request loop as a stream: JSON lines in, the classifier's extractions out, keyed by request. Stateless."""
from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.text import normalize_node_text
from ..functions.visual import is_positive
from ..operators import html as dom
from ..operators import model as classifier
from ..operators import visuals as styles
from ..operators.features import NodeFeatures

REQUEST = "request_id string, url string, html string, visuals string, screenshot string, _corrupt string"


def requests(spark: SparkSession, path: str, streaming: bool = True) -> DataFrame:
    reader = spark.readStream if streaming else spark.read
    return reader.schema(REQUEST).option("columnNameOfCorruptRecord", "_corrupt").json(path)


def predictions(asked: DataFrame, features: NodeFeatures, model: PipelineModel, labels: list[str]) -> DataFrame:
    """request_id, label, text, url, xpath, confidence, probability, box of the nodes of asked(request_id, html, visuals).

    labels: names of the classes from 1; class 0 is no label. Nodes with a box outside the screen are left out. confidence
    is the class's logit, url the node's src attribute, text that of text nodes only.
    """
    nodes = dom.dom_nodes(asked.where("html is not null"), key="request_id")
    rows = styles.visual_rows(asked.where("html is not null and visuals is not null"), key="request_id")
    boxed = styles.attached(nodes, rows, key="request_id")
    seen = boxed.where(F.col("box").isNull() | is_positive(*[F.col(f"box.{c}") for c in "xywh"]))
    out = classifier.predict(model, features.compute(seen)).where("predicted > 0")
    name = F.element_at(F.array(*[F.lit(x) for x in labels]), F.col("predicted"))
    place = F.col("predicted") + 1
    return out.select(
        "request_id", name.alias("label"), F.when(F.col("is_text"), normalize_node_text(F.col("text"))).alias("text"), F.col("attrs")["src"].alias("url"), "xpath", F.round(F.element_at("logits", place), 6).alias("confidence"), F.round(F.element_at("probabilities", place), 6).alias("probability"), F.when(F.col("box").isNotNull(), F.array(*[F.col(f"box.{c}") for c in "xywh"])).alias("box")
    )


def responses(asked: DataFrame, features: NodeFeatures, model: PipelineModel, labels: list[str]) -> DataFrame:
    """request_id and response (JSON) of each request: its predictions by label, the most confident first, or its error."""
    broken = styles.visual_rows(asked.where("visuals is not null"), key="request_id").where("error is not null").groupBy("request_id").agg(F.min("error").alias("_broken"))
    item = F.struct("text", "url", "xpath", "confidence", "probability", "box")
    order = F.struct((-F.col("confidence")).alias("o"), "xpath", item.alias("item"))
    by_label = predictions(asked, features, model, labels).groupBy("request_id", "label").agg(F.transform(F.array_sort(F.collect_list(order)), lambda x: x["item"]).alias("items"))
    found = by_label.groupBy("request_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("label", "items")))).alias("page"))
    error = F.when(F.col("_corrupt").isNotNull(), "unreadable request").when(F.col("html").isNull(), "no html").when(F.col("_broken").isNotNull(), F.concat(F.lit("unreadable visuals: "), F.col("_broken")))
    out = asked.join(broken, "request_id", "left").join(found, "request_id", "left").withColumn("error", error)
    pages = F.when(F.col("page").isNotNull(), F.array("page")).otherwise(F.array(F.create_map().cast(dict(found.dtypes)["page"])))
    body = F.when(F.col("error").isNotNull(), F.to_json(F.struct("error"))).otherwise(F.to_json(F.struct(pages.alias("pages"))))
    return out.select("request_id", body.alias("response"))


def serve(spark: SparkSession, source: str, sink: str, checkpoint: str, features: NodeFeatures, model: PipelineModel, labels: list[str]) -> StreamingQuery:
    """Answers all requests in `source` and appends JSON lines to `sink`; exactly once per batch id."""

    def write(batch: DataFrame, number: int) -> None:
        responses(batch, features, model, labels).write.mode("overwrite").json(f"{sink}/batch={number}")

    return requests(spark, source).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
