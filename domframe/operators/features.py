"""Features of nodes: dictionaries fitted on training rows, vectors by built-in functions."""
from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.text import basic_tokenize, bert_tokenize, normalize_node_text, tokens_of
from ..functions.visual import min_max
from .relational import numbered


class NodeFeatures:
    """Features of DOM nodes in three steps: prepare() on training nodes only, freeze(), then compute() on any nodes.

    Depth and length are scaled by the training rows' range; ancestors and the node's own tag are counted by a dictionary
    of all training tags, or of the `most` most frequent ones.
    """

    def __init__(self, most: int | None = None):
        self.most, self.state, self.frozen = most, None, False

    def prepare(self, nodes: DataFrame) -> NodeFeatures:
        """Fits ranges and dictionary by two aggregations; the driver sees the distinct tags and one row."""
        if self.frozen:
            raise RuntimeError("frozen features are not fitted again")
        length = F.length(normalize_node_text(F.coalesce("text", F.lit(""))))
        counts = nodes.groupBy("tag").count()
        tags = (counts if self.most is None else counts.orderBy(F.col("count").desc(), "tag").limit(self.most)).collect()
        r = nodes.agg(F.min("depth").alias("d0"), F.max("depth").alias("d1"), F.min(length).alias("l0"), F.max(length).alias("l1")).first()
        self.state = {"tags": sorted(x["tag"] for x in tags), "depth": [r["d0"], r["d1"]], "length": [r["l0"], r["l1"]]}
        return self

    def freeze(self) -> str:
        """The fitted state as JSON; after this nothing is fitted any more."""
        if self.state is None:
            raise RuntimeError("features were not prepared")
        self.frozen = True
        return json.dumps(self.state, sort_keys=True)

    @classmethod
    def restored(cls, text: str) -> NodeFeatures:
        out = cls()
        out.state, out.frozen = json.loads(text), True
        return out

    @property
    def names(self) -> list[str]:
        if self.state is None:
            raise RuntimeError("features were not prepared")
        return ["f_depth", "f_length", "f_text", *[f"f_tag_{i}" for i in range(len(self.state["tags"]))]]

    def compute(self, nodes: DataFrame) -> DataFrame:
        """nodes(tag, depth, text, is_text, anc_tags) with the columns of names; other tags than the dictionary's count nowhere."""
        if not self.frozen:
            raise RuntimeError("features are computed after freeze() only")
        scaled = lambda c, ends: F.coalesce(min_max(c.cast("double"), F.lit(float(ends[0] or 0)), F.lit(float(ends[1] or 0))), F.lit(0.0))
        length = F.length(normalize_node_text(F.coalesce("text", F.lit(""))))
        up = ancestor_tags(F.concat("anc_tags", F.array("tag")), self.state["tags"])
        values = [scaled(F.col("depth"), self.state["depth"]), scaled(length, self.state["length"]), F.col("is_text").cast("double"), *[F.get(up, F.lit(i)) for i in range(len(self.state["tags"]))]]
        return nodes.select("*", *[v.alias(n) for v, n in zip(values, self.names, strict=True)])


def dictionary(df: DataFrame, value: str, order: str) -> DataFrame:
    """value, n and id from 1 in order of first sight, numbered by ranges: one row for each distinct value."""
    seen = df.where(F.col(value).isNotNull()).groupBy(value).agg(F.count("*").alias("n"), F.min(order).alias("_first"))
    return numbered(seen.select(value, "n", F.struct("_first", value).alias("_order")), "_order").select(value, "n", (F.col("_number") + 1).alias("id"))


def tag_dictionary(df: DataFrame, tag: str = "tag") -> DataFrame:
    return numbered(df.select(tag).distinct(), tag).select(tag, (F.col("_number") + 1).alias("id"))


def batch_ids(lists: Column) -> Column:
    """The ids of several texts of one node one after the other; [0] if there is none."""
    flat = F.flatten(F.coalesce(lists, F.array().cast("array<array<bigint>>")))
    return F.when(F.size(flat) > 0, flat).otherwise(F.array(F.lit(0).cast("bigint")))


def ranges(df: DataFrame, vector: str) -> DataFrame:
    """slot, low and high of each place of an array column."""
    slots = df.select(F.posexplode(vector).alias("slot", "v"))
    return slots.groupBy("slot").agg(F.min("v").alias("low"), F.max("v").alias("high"))


def token_ids(df: DataFrame, key: str | list[str], tokens: str, vocabulary: DataFrame, most: int | None = None, known_only: bool = False) -> DataFrame:
    """key and ids: vocabulary(token, id) numbers of tokens in order, 0 if unknown (or left out); the first `most`.

    Each row of df stays: one without tokens, or without known ones where only those count, has [0].
    """
    keys = [key] if isinstance(key, str) else list(key)
    spread = df.select(*keys, F.posexplode(tokens).alias("pos", "token"))
    found = spread.join(vocabulary.select("token", "id"), "token", "left").select(*keys, "pos", F.coalesce("id", F.lit(0)).cast("bigint").alias("id"))
    if known_only:
        found = found.where("id <> 0")
    listed = found.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "id"))), lambda s: s["id"]).alias("ids"))
    own = F.array(F.when(F.col("ids").isNotNull(), F.slice("ids", 1, most) if most else F.col("ids")))
    return df.select(*keys).distinct().join(listed, keys, "left").select(*keys, batch_ids(F.filter(own, lambda x: x.isNotNull())).alias("ids"))


def vector_mean(df: DataFrame, key: str, vectors: DataFrame, on: str, vector: str, total: bool = False) -> DataFrame:
    """Mean (or sum) of the vectors of each key's items; whole vectors are summed before the shuffle."""
    items = df.select(key, on).join(vectors.select(on, array_to_vector(F.col(vector).cast("array<double>")).alias("_v")), on)
    return items.groupBy(key).agg((Summarizer.sum if total else Summarizer.mean)(F.col("_v")).alias("_v")).select(key, vector_to_array("_v").alias("vector"))


#: Aggregations of vectors by name.
AGGREGATES = {"mean": Summarizer.mean, "sum": Summarizer.sum, "max": Summarizer.max, "min": Summarizer.min}
#: Tokenizers by name: functions of a text column.
TOKENIZERS = {"basic": basic_tokenize, "bert": bert_tokenize, "bert_symbols": lambda c: bert_tokenize(c, True), "spaces": tokens_of}


def vector_aggregate(df: DataFrame, key: str, vectors: DataFrame, on: str, vector: str, how: str) -> DataFrame:
    """key and vector of each key's items, by an aggregation of AGGREGATES; whole vectors are merged before the shuffle."""
    if how not in AGGREGATES:
        raise ValueError(f"unknown aggregation {how}: one of {', '.join(AGGREGATES)}")
    items = df.select(key, on).join(vectors.select(on, array_to_vector(F.col(vector).cast("array<double>")).alias("_v")), on)
    return items.groupBy(key).agg(AGGREGATES[how](F.col("_v")).alias("_v")).select(key, vector_to_array("_v").alias("vector"))


def tokenizer(name: str):
    if name not in TOKENIZERS:
        raise ValueError(f"unknown tokenizer {name}: one of {', '.join(TOKENIZERS)}")
    return TOKENIZERS[name]


def tokens_by_id(df: DataFrame, key: str, ids: str, vocabulary: DataFrame, unknown: str = "[UNK]") -> DataFrame:
    """key and tokens: the tokens of df's ids in order, by vocabulary(token, id); an id that it lacks gives `unknown`."""
    spread = df.select(key, F.posexplode(ids).alias("pos", "id")).join(vocabulary.select("token", "id"), "id", "left")
    listed = spread.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", F.coalesce("token", F.lit(unknown)).alias("token")))), lambda x: x["token"]).alias("tokens"))
    return df.select(key).distinct().join(listed, key, "left").select(key, F.coalesce("tokens", F.array().cast("array<string>")).alias("tokens"))


def ancestor_tags(anc_tags: Column, tags: list[str]) -> Column:
    """Counts of the listed tags among a node's ancestors."""
    return F.transform(F.array(*[F.lit(t) for t in tags]), lambda t: F.size(F.filter(anc_tags, lambda x: x == t)).cast("double"))


def weighted_neighbors(edges: DataFrame, vectors: DataFrame, softmax: bool = True) -> DataFrame:
    """Attention over edges(page_id, node_id, neighbor_id, score): mean of neighbour vectors by normalised scores."""
    w = W.partitionBy("page_id", "node_id")
    weight = F.exp(F.col("score") - F.max("score").over(w)) if softmax else F.col("score")
    norm = F.sum("_w").over(w) if softmax else F.sqrt(F.sum(F.col("_w") * F.col("_w")).over(w))
    weighted = edges.withColumn("_w", weight).withColumn("weight", F.coalesce(F.try_divide(F.col("_w"), norm), F.lit(0.0)))
    v = vectors.select("page_id", F.col("node_id").alias("neighbor_id"), "vector")
    slots = weighted.join(v, ["page_id", "neighbor_id"]).select("page_id", "node_id", "weight", F.posexplode("vector").alias("slot", "x"))
    per = slots.groupBy("page_id", "node_id", "slot").agg(F.sum(F.col("weight") * F.col("x")).alias("x"))
    return per.groupBy("page_id", "node_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("slot", "x"))), lambda s: s["x"]).alias("vector"))


def weighted_list(near: Column, score: Callable[[Column], Column], vector: Callable[[Column], Column], softmax: bool = True) -> Column:
    """weighted_neighbors() of neighbours that stand in one list of their node: the mean of their vectors, row by row."""
    scores = F.transform(near, score)
    top = F.array_max(scores)
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda a, x: a + x)
    weights = F.transform(scores, lambda x: F.exp(x - top)) if softmax else scores
    norm = total(weights) if softmax else F.sqrt(total(F.transform(weights, lambda x: x * x)))
    shares = F.transform(weights, lambda x: F.coalesce(F.try_divide(x, norm), F.lit(0.0)))
    each = F.zip_with(shares, F.transform(near, vector), lambda share, v: F.transform(v, lambda x: share * x))
    return F.aggregate(F.slice(each, 2, F.greatest(F.size(each) - 1, F.lit(0))), F.get(each, F.lit(0)), lambda a, v: F.zip_with(a, v, lambda x, y: x + y))
