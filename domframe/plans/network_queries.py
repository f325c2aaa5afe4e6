"""Queries of the node network: encoders of words and paths, and a network trained on pages."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import basic_tokenize
from ..operators import encoders, features, html, inputs, neighbors, network, paths, training
from ..operators import relational as rel
from ..sources.scratch import written
from . import dom_sql
from .registry import Tables, query


def _rounded(c: str = "vector", digits: int = 6):
    return F.transform(c, lambda v: F.round(v, digits) + F.lit(0.0))


def document_words(t: Tables) -> DataFrame:
    """doc_id and ids: the numbers of all words of each document, by the dictionary of all documents; [0] without words."""
    docs = written(t.documents.select("doc_id", basic_tokenize(F.coalesce("text", F.lit(""))).alias("tk")), "tokens")
    counts = docs.select(F.explode("tk").alias("token")).groupBy("token").agg(F.count("*").alias("n"))
    ranked = rel.numbered(counts.withColumn("order", F.struct((-F.col("n")).alias("n"), "token")), "order")
    return features.token_ids(docs, "doc_id", "tk", ranked.select("token", (F.col("_number") + 1).alias("id")))


#: Of the word encoder's table: words by their number modulo this, so that its size is bounded; 0 stays nothing.
BUCKETS = 4096
ENCODER = network.Settings(BUCKETS + 1, 1, 2, word_dim=8, lstm_dim=8)


@query("M2 M3 M9 F11 F12 X6")
def word_encoder(t: Tables) -> DataFrame:
    """Whole documents through the recurrent word encoder: the mean of the states of both directions over true lengths."""
    words = document_words(t).select("doc_id", F.transform("ids", lambda i: F.when(i == 0, 0).otherwise(i % BUCKETS + 1).cast("int")).alias("ids"))
    out = encoders.encoded(words, "doc_id", "ids", ENCODER, network.initial(ENCODER, 7))
    return out.select("doc_id", _rounded().alias("vector"))


def _nodes(t: Tables) -> DataFrame:
    return html.dom_nodes(t.pages)


@query("M6 D10")
def path_encoder(t: Tables) -> DataFrame:
    """The tag path of each node through the recurrent path encoder, each distinct prefix once."""
    n = written(_nodes(t).select("page_id", "node_id", F.concat("anc_tags", F.array("tag")).alias("path")), "paths")
    tags = features.tag_dictionary(n.select(F.element_at("path", -1).alias("tag")))
    s = network.Settings(1, tags.count() + 1, 2, path_dim=6)
    out = paths.encoded_paths(n, tags, network.initial(s, 7), ["page_id", "node_id"])
    return out.select("page_id", "node_id", _rounded().alias("vector"))


def labelled(n: DataFrame) -> DataFrame:
    """Text nodes with y: 1 the text of a heading, 2 the first text after one, else 0."""
    from pyspark.sql import Window as W

    heading = F.when(F.col("is_text"), F.struct((F.element_at("anc_tags", -1) == "h1").alias("h")))
    before = F.last(heading, ignorenulls=True).over(W.partitionBy("page_id").orderBy("node_id").rowsBetween(W.unboundedPreceding, -1))
    y = F.when(heading["h"], 1).when(before["h"], 2).otherwise(0)
    return n.withColumn("y", F.when(F.col("is_text"), y))


#: Words of the pages' dictionary, the most frequent ones.
MOST_WORDS = 2000


@query("M1 M2 M3 M4 M5 M6 M7 M8 F13 E9 X1 X6")
def network_train_predict(t: Tables) -> DataFrame:
    """A network with word, friend, neighbour and path encoders (of tags and attribute words), trained on pages of even number; its classes for all pages.

    A text has its parent's tag, so that its neighbours show what they stand in.
    """
    n = written(labelled(_nodes(t)).withColumn("tag", F.when(F.col("is_text"), F.element_at("anc_tags", -1)).otherwise(F.col("tag"))), "nodes")
    known = n.where("page_id % 2 = 0")
    words = inputs.vocabulary(known, 2).where(F.col("id") <= MOST_WORDS)
    tags = features.tag_dictionary(known)
    texts = n.where("is_text").select("page_id", F.col("node_id").cast("bigint").alias("node_id"), F.col("anc_ids").cast("array<bigint>").alias("anc_ids"))
    rows = inputs.assembled(n.where("is_text"), words, tags, attributes=["class", "id"], dense=[F.col("depth") / 10], friends=neighbors.friends(texts), partners=neighbors.partners(texts), edges=inputs.document_edges(n, 1), y=F.col("y"), around=n)
    rows = written(rows.repartition("page_id").sortWithinPartitions(*inputs.KEY), "rows")  # so that batches have whole pages
    s = network.Settings(MOST_WORDS + 1, tags.count() + 1, 3, dense=1, word_dim=8, tag_dim=4, lstm_dim=6, lists=3, attrs=True, neighbors=True, path_tag_dim=4, path_dim=4, path_attrs=True, hidden=(24,), dropout=0.1, head_dropout=0.1, smoothing=0.05)
    folder = training.sliced(rows.where("page_id % 2 = 0"), ["page_id", "node_id"], 4, together=["page_id"])
    state, _ = training.train(t.spark, folder, None, s, training.Optimizer(rate=0.03, clip=5.0), training.started(s), 8, 4)
    out = training.predict(rows, s, state.params, ["page_id", "node_id", "y"])
    return out.select("page_id", "node_id", "y", "predicted", F.round(F.array_max("probabilities"), 6).alias("probability"))


@query("F11 F13 I8", dom_sql.WORDS)
def node_word_ids(t: Tables) -> DataFrame:
    """Word numbers of each node: its text's first 15 by the pages' dictionary, and those of its class and id that are known."""
    n = written(_nodes(t), "nodes")
    rows = inputs.assembled(n, inputs.vocabulary(n), features.tag_dictionary(n), attributes=["class", "id"])
    text = lambda c: F.array_join(F.col(c).cast("array<string>"), " ")
    return rows.select("page_id", "node_id", F.array_join(F.flatten("words").cast("array<string>"), " ").alias("ids"), text("attrs").alias("attr_ids"), text("path").alias("path"))
