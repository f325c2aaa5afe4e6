"""Encodings of tag paths from the root, computed once for each distinct path and prefix.

The paths of all nodes form a trie. The state of a recurrent encoder after a prefix depends on the prefix alone, so that it
is computed level by level: a join gives each prefix its parent's state, and one step leads to its own. Work grows with
distinct prefixes, not with nodes. The other direction reads a path from its end, and is computed once for each path.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import discard, written
from .network import Lists, Tape, Var

_STATE = "prefix string, h array<double>, c array<double>, total array<double>"


def path_key(tags: Column) -> Column:
    """A path as text; tags hold no slash."""
    return F.array_join(tags, "/")


def prefixes(paths: DataFrame) -> DataFrame:
    """prefix, parent, tag, level of all distinct beginnings of paths(path: array of tags); the root's parent is null."""
    cut = F.explode(F.sequence(F.lit(1), F.size("path")))
    each = paths.where(F.size("path") > 0).select("path", cut.alias("level")).withColumn("own", F.slice("path", 1, F.col("level")))
    parent = F.when(F.col("level") > 1, path_key(F.slice("path", 1, F.col("level") - 1)))
    return each.select(path_key("own").alias("prefix"), parent.alias("parent"), F.element_at("own", -1).alias("tag"), F.col("level").cast("int")).distinct()


def _step(params: dict, name: str, x: np.ndarray, h: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One step of rows side by side, as the first of a list each."""
    size = h.shape[1]
    z = x @ params[f"{name}.x"] + h @ params[f"{name}.h"] + params[f"{name}.b"]
    gate = lambda v: 0.5 * (np.tanh(0.5 * v) + 1)
    c = gate(z[:, size : 2 * size]) * c + gate(z[:, :size]) * np.tanh(z[:, 2 * size : 3 * size])
    return gate(z[:, 3 * size :]) * np.tanh(c), c


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    flat = column.fill_null([0.0] * width).flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(-1, width)


def forward_states(trie: DataFrame, tags: DataFrame, params: dict[str, np.ndarray], name: str = "path") -> DataFrame:
    """prefix and the mean of its states so far, of prefixes(); tags(tag, id), unknown ones are 0."""
    spark, size = trie.sparkSession, params[f"{name}.ahead.h"].shape[0]
    held = spark.sparkContext.broadcast({k: params[k] for k in ("path_tags", f"{name}.ahead.x", f"{name}.ahead.h", f"{name}.ahead.b")})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = held.value
        for batch in batches:
            h, c = _step(p, f"{name}.ahead", p["path_tags"][batch.column("id").to_numpy(zero_copy_only=False)], _matrix(batch.column("h"), size), _matrix(batch.column("c"), size))
            total = _matrix(batch.column("total"), size) + h
            yield pa.RecordBatch.from_arrays([batch.column("prefix"), *[pa.array(list(x), pa.list_(pa.float64())) for x in (h, c, total)]], names=["prefix", "h", "c", "total"])

    numbered = written(trie.join(tags.select("tag", "id"), "tag", "left").select("prefix", "parent", "level", F.coalesce("id", F.lit(0)).cast("int").alias("id")), "trie")
    depth = numbered.agg(F.max("level")).first()[0] or 0
    before = spark.createDataFrame([], _STATE)
    out, levels = None, []
    for level in range(1, depth + 1):
        now = numbered.where(F.col("level") == level)
        states = now.join(before.select(F.col("prefix").alias("parent"), "h", "c", "total"), "parent", "left")
        before = written(states.select("prefix", "id", "h", "c", "total").mapInArrow(run, _STATE), "states")
        levels.append(before)
        own = before.select("prefix", F.transform("total", _over(level)).alias("ahead"))
        out = own if out is None else out.unionByName(own)
    if out is None:
        return spark.createDataFrame([], "prefix string, ahead array<double>")
    result = written(out, "ahead")
    discard(*levels, numbered)
    return result


def _over(level: int):
    return lambda v: v / F.lit(float(level))


def backward_means(paths: DataFrame, tags: DataFrame, params: dict[str, np.ndarray], name: str = "path") -> DataFrame:
    """prefix and the mean of the states from the end, of each distinct path of paths(path)."""
    held = paths.sparkSession.sparkContext.broadcast({k: params[k] for k in ("path_tags", f"{name}.back.x", f"{name}.back.h", f"{name}.back.b")})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = Lists.of(batch.column("ids").to_pylist())
            t = Tape(held.value, keep=False)
            states = t.lstm(Var(held.value["path_tags"][lists.ids]), lists.first, f"{name}.back", True)
            mean = t.gathered(states, lists.first, True).value
            yield pa.RecordBatch.from_arrays([batch.column("prefix"), pa.array(list(mean), pa.list_(pa.float64()))], names=["prefix", "back"])

    own = paths.where(F.size("path") > 0).select(path_key("path").alias("prefix"), "path").distinct()
    each = own.select("prefix", F.posexplode("path").alias("pos", "tag")).join(tags.select("tag", "id"), "tag", "left")
    listed = each.groupBy("prefix").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", F.coalesce("id", F.lit(0)).cast("int").alias("id")))), lambda x: x["id"]).alias("ids"))
    return listed.mapInArrow(run, "prefix string, back array<double>")


def encoded_paths(nodes: DataFrame, tags: DataFrame, params: dict[str, np.ndarray], keys: list[str]) -> DataFrame:
    """keys and vector of nodes(keys, path: tags from the root to the node): as network.path_vectors() of each alone.

    An empty path has zeros.
    """
    paths = written(nodes.select("path").distinct(), "paths")
    ahead = forward_states(prefixes(paths), tags, params)
    both = ahead.join(backward_means(paths, tags, params), "prefix").select("prefix", F.concat("ahead", "back").alias("vector"))
    width = 2 * params["path.ahead.h"].shape[0]
    found = nodes.withColumn("prefix", path_key("path")).join(both, "prefix", "left")
    return found.select(*keys, F.coalesce("vector", F.array_repeat(F.lit(0.0), width)).alias("vector"))
