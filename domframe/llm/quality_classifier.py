"""Quality classifier with hierarchical empirical Bayes over sites.

A logistic regression on hashed words and plain shares of a text gives each document's own evidence. Hosts (here the
source) and paths below them (here source and language) have Beta posteriors of the mean evidence of their documents: the
label where one was learned from, else the classifier's probability. The prior of hosts is the global mean with a strength
fitted to how much hosts differ, that of paths their host's posterior. Sparse sites thus shrink toward the level above.
The final score adds the log-odds of the document's path, relative to the global ones, to the document's; what a document
itself brought to its path and host is taken out first, so that it counts once.
"""
from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

#: Labelled rows, and bytes of their texts, that are learned from at most, chosen by a hash of doc_id; sites that are
#: broadcast at most, beyond which documents are joined with them.
MOST_ROWS, MOST_BYTES, MOST_SITES = 4_000, 64_000_000, 200_000
#: Bytes of text whose features are made at once.
SLICE = 500_000
BUCKETS, EPOCHS, PACE, PENALTY, FOLDS = 1 << 15, 12, 0.3, 1e-5, 5
SHARES = 10
#: Weakest and strongest prior, in documents.
WEAKEST, STRONGEST = 2.0, 1000.0


def features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Shares of each text (texts, SHARES); table rows, weights and bounds of its distinct hashed words."""
    words = common.Words(texts)
    index, distinct = words.encoded()
    n = words.counts()
    row = np.array([zlib.crc32(w.lower()) % BUCKETS for w in distinct], np.int64)
    odd = np.array([[any(c in b"#*$%&|<>{}" for c in w), w[-1:] in b".,;:!?", w.isupper(), any(48 <= c < 58 for c in w), len(w) <= 2, len(w) >= 12, w[-1:] in b"!?"] for w in distinct], float).reshape(-1, 7)
    shares = np.zeros((len(texts), SHARES))
    some = np.maximum(n, 1)
    for k in range(7):
        shares[:, k] = common.segment_sums(odd[index, k], words.first) / some
    text_of = np.repeat(np.arange(len(texts)), n)
    pair, times = np.unique(text_of * max(len(distinct), 1) + index, return_counts=True)
    of, word = pair // max(len(distinct), 1), pair % max(len(distinct), 1)
    bounds = np.searchsorted(of, np.arange(len(texts) + 1))
    shares[:, 7] = np.diff(bounds) / some
    shares[:, 8] = np.log1p(n) / 10
    shares[:, 9] = n > 0
    weight = np.log1p(times) / np.sqrt(np.maximum(np.diff(bounds), 1))[of]
    return shares, row[word] if len(distinct) else np.zeros(0, np.int64), weight, bounds


def fit(shares: np.ndarray, rows: np.ndarray, weight: np.ndarray, bounds: np.ndarray, labels: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Adagrad on the mean logistic loss over groups of texts."""
    dense, table, bias = np.zeros(SHARES), np.zeros(BUCKETS), 0.0
    s_dense, s_table, s_bias = np.full(SHARES, 1e-3), np.full(BUCKETS, 1e-3), 1e-3
    rng = np.random.default_rng(5)
    for _ in range(EPOCHS if len(labels) else 0):
        order = rng.permutation(len(labels))
        for lo in range(0, len(order), 64):
            g = order[lo : lo + 64]
            at = np.concatenate([np.arange(bounds[i], bounds[i + 1]) for i in g])
            of = np.repeat(np.arange(len(g)), bounds[g + 1] - bounds[g])
            z = np.bincount(of, table[rows[at]] * weight[at], len(g)) + shares[g] @ dense + bias
            error = (1 / (1 + np.exp(-np.clip(z, -40, 40))) - labels[g]) / len(g)
            grad = np.bincount(rows[at], error[of] * weight[at], BUCKETS) + PENALTY * table
            s_table += grad**2
            table -= PACE * grad / np.sqrt(s_table)
            d = error @ shares[g]
            s_dense += d**2
            dense -= PACE * d / np.sqrt(s_dense)
            s_bias += error.sum() ** 2
            bias -= PACE * error.sum() / np.sqrt(s_bias)
    return dense, table.astype(np.float32), float(bias)


def _fold(doc_id: Column) -> Column:
    return F.pmod(F.crc32(doc_id.cast("bigint").cast("string").cast("binary")), F.lit(FOLDS))


def trained(docs: DataFrame, labels: DataFrame, most: int = MOST_ROWS) -> tuple[np.ndarray, np.ndarray, float]:
    """Fits on labelled texts outside the held-out fold, `most` at most; features are made on executors."""
    rows = common.learning_rows(docs, labels, "quality", most, MOST_BYTES, FOLDS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, texts in common.text_slices(batch, most=SLICE):
                shares, row, weight, bounds = features(texts)
                cut = list(zip(bounds[:-1], bounds[1:], strict=True))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(lo, hi - lo), batch.column("_y").slice(lo, hi - lo), pa.array(shares.tolist(), pa.list_(pa.float64())), pa.array([row[a:b].astype(np.int32).tobytes() for a, b in cut], pa.binary()), pa.array([weight[a:b].astype(np.float32).tobytes() for a, b in cut], pa.binary())], names=["doc_id", "y", "shares", "rows", "weight"])

    table = rows.mapInArrow(run, "doc_id bigint, y int, shares array<double>, rows binary, weight binary").toArrow().sort_by("doc_id").to_pylist()
    rows_ = [np.frombuffer(r["rows"], np.int32) for r in table]
    empty = np.zeros(0)
    return fit(
        np.array([r["shares"] for r in table], float).reshape(-1, SHARES),
        np.concatenate([np.zeros(0, np.int32), *rows_]).astype(np.int64),
        np.concatenate([empty, *[np.frombuffer(r["weight"], np.float32) for r in table]]),
        np.cumsum([0, *map(len, rows_)]),
        np.array([r["y"] for r in table], float),
    )


def evidence(docs: DataFrame, net: tuple[np.ndarray, np.ndarray, float]) -> DataFrame:
    """doc_id, host, path, p of each row of docs(doc_id, text, source, lang): the document classifier alone."""
    held = docs.sparkSession.sparkContext.broadcast(net)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dense, table, bias = held.value
        for batch in batches:
            parts = [np.zeros(0)]
            for _, _, texts in common.text_slices(batch, most=SLICE):
                shares, rows, weight, bounds = features(texts)
                z = common.segment_sums(table[rows] * weight, bounds) + shares @ dense + bias
                parts.append(1 / (1 + np.exp(-np.clip(z, -12, 12))))
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("doc_id", "host", "path")], pa.array(np.concatenate(parts))], names=["doc_id", "host", "path", "p"])

    named = common.texts_of(docs, F.col("doc_id").cast("bigint"), F.coalesce("source", F.lit("")).alias("host"), F.coalesce("lang", F.lit("")).alias("path"), "text")
    return named.mapInArrow(run, "doc_id bigint, host string, path string, p double")


def _strength(mean: str) -> Column:
    """Prior documents by moments, groups weighted by their documents: of the spread of group means, what numbers do not explain."""
    n, x = F.col("n"), F.col(mean)
    m = F.sum(n * x) / F.sum("n")
    v = F.sum(n * x * x) / F.sum("n") - m * m - F.sum(n * x * (1 - x) / (n + 1)) / F.sum("n")
    fitted = F.when(v > 0, m * (1 - m) / v - 1).otherwise(STRONGEST)
    return F.coalesce(F.least(F.greatest(fitted, F.lit(WEAKEST)), F.lit(STRONGEST)), F.lit(STRONGEST))


def combined(scores: DataFrame) -> DataFrame:
    """scores(doc_id, host, path, p, e) with host_posterior, path_posterior and score; e: evidence for the site.

    Sites are summed before any join, and posteriors are without the document's own evidence.
    """
    paths = scores.groupBy("host", "path").agg(F.count("*").alias("n"), F.sum("e").alias("sum"))
    paths = common.written(paths.withColumn("mean", F.col("sum") / F.col("n")), "paths")
    hosts = paths.groupBy("host").agg(F.sum("n").alias("n"), F.sum("sum").alias("sum")).withColumn("mean", F.col("sum") / F.col("n"))
    top = hosts.agg((F.sum("sum") / F.sum("n")).alias("all"), _strength("mean").alias("k")).first()
    mean, k = float(top["all"] if top["all"] is not None else 0.5), float(top["k"])
    k_path = float(paths.agg(_strength("mean").alias("k")).first()["k"])
    sites = paths.select("host", "path", F.col("n").alias("n_path"), F.col("sum").alias("s_path")).join(hosts.select("host", F.col("n").alias("n_host"), F.col("sum").alias("s_host")), "host")
    if paths.count() <= MOST_SITES:
        sites = F.broadcast(sites)

    def odds(p: Column) -> Column:
        p = F.least(F.greatest(p, F.lit(1e-6)), F.lit(1 - 1e-6))
        return F.log(p / (1 - p))

    host = (F.lit(k * mean) + F.col("s_host") - F.col("e")) / (F.lit(k) + F.col("n_host") - 1)
    path = (F.lit(k_path) * F.col("host_posterior") + F.col("s_path") - F.col("e")) / (F.lit(k_path) + F.col("n_path") - 1)
    z = odds(F.col("p")) + odds(F.col("path_posterior")) - odds(F.lit(mean))
    return scores.join(sites, ["host", "path"]).withColumn("host_posterior", host).withColumn("path_posterior", path).withColumn("score", 1 / (1 + F.exp(-z))).drop("n_path", "s_path", "n_host", "s_host")


def quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per row of docs(doc_id, text, source, lang): doc_id, held_out, document_score, host_posterior, path_posterior, score, kept.

    Null texts have no words and are scored by their site and the bias; a null source or language is a site of its own.
    Labels without a text are left out; without any label all documents have 0.5. Rows repeat as in docs; other columns
    are ignored; an empty table gives an empty result. Very long texts are read whole. A repeated label counts once. Kept:
    score of 0.5 or more.
    """
    known = labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("quality").cast("double").alias("_y")).where(F.col("_y").isNotNull() & (_fold(F.col("doc_id")) != 0)).groupBy("doc_id").agg(F.min("_y").alias("_y"))
    scores = evidence(docs, trained(docs, labels)).join(known, "doc_id", "left").withColumn("e", F.coalesce("_y", "p")).drop("_y")
    out = combined(common.written(scores, "evidence"))
    return out.select("doc_id", F.coalesce(_fold(F.col("doc_id")) == 0, F.lit(False)).alias("held_out"), F.col("p").alias("document_score"), "host_posterior", "path_posterior", "score", (F.col("score") >= 0.5).alias("kept"))
