"""Toxicity: a convolutional text classifier in numpy.

Words have hashed embeddings: the mean of those of the whole word and of its first five and four bytes, which covers
inflected and unseen forms. Filters of width 1, 2 and 3 slide over the whole text; each filter's maximum enters a linear
output. Thresholds are calibrated by language, which is guessed from the text's own function words, never read from a
column; the score is shifted so that 0.5 is the threshold of the text's language. Each half of the learning rows is
scored by a network fitted on the other one, and thresholds come from these scores; the network itself is fitted on all.
"""
from __future__ import annotations

import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Labelled rows, and bytes of their texts, that are learned from at most, chosen by a hash of doc_id.
MOST_ROWS, MOST_BYTES = 6_000, 64_000_000
BUCKETS, WIDE, WIDTHS, FILTERS = 1 << 16, 12, (1, 2, 3), 8
EPOCHS, BATCH, PACE, SEED, FOLDS = 4, 16, 0.08, 11, 5
PAD = max(WIDTHS) - 1
COLUMNS = sum(WIDTHS) * FILTERS
#: Function words by language.
FUNCTION_WORDS = {
    "en": ("the", "of", "and", "to", "is", "that", "it", "was", "for", "with"),
    "de": ("der", "die", "und", "das", "nicht", "mit", "ein", "eine", "ist", "zu"),
    "fr": ("le", "les", "et", "une", "dans", "pour", "des", "est", "pas", "du"),
    "es": ("el", "los", "y", "del", "con", "una", "por", "las", "para", "su"),
}
LANGUAGES = (*FUNCTION_WORDS, "other")


def word_rows(words: list[bytes]) -> np.ndarray:
    """Three table rows of each word, without its outer punctuation."""
    out = np.empty((len(words), 3), np.int32)
    for i, w in enumerate(words):
        w = w.strip(b".,;:!?\"'()[]{}#*$%&|<>-") or w
        out[i] = zlib.crc32(w) % BUCKETS, zlib.crc32(w[:5], 1) % BUCKETS, zlib.crc32(w[:4], 2) % BUCKETS
    return out


class Network(NamedTuple):
    table: np.ndarray  # (BUCKETS, WIDE)
    filters: np.ndarray  # (WIDE, COLUMNS): width by width, place by place
    bias: np.ndarray  # (filters of all widths)
    out: np.ndarray
    out_bias: float
    thresholds: dict[str, float]


def _places() -> Iterator[tuple[int, int, slice, slice]]:
    """Width number, place in the window, columns of filters, columns of outputs."""
    at = 0
    for i, width in enumerate(WIDTHS):
        for place in range(width):
            yield i, place, slice(at, at + FILTERS), slice(i * FILTERS, (i + 1) * FILTERS)
            at += FILTERS


def activations(by_word: np.ndarray, index: np.ndarray, bias: np.ndarray) -> np.ndarray:
    """Filter values at each place of padded texts: by_word (words, COLUMNS), index of each place's word."""
    z = np.tile(bias, (len(index), 1))
    for _, place, columns, outs in _places():
        part = by_word[:, columns][index[place:]] if place else by_word[:, columns][index]
        z[: len(index) - place, outs] += part
    return z


def padded(index: np.ndarray, first: np.ndarray, pad: int) -> tuple[np.ndarray, np.ndarray]:
    """Word indices with PAD empty words after each text, and where each text begins."""
    n = np.diff(first)
    start = first[:-1] + PAD * np.arange(len(n))
    out = np.full(len(index) + PAD * len(n), pad, np.int64)
    out[np.repeat(start - first[:-1], n) + np.arange(len(index))] = index
    return out, start


def logits(net: Network, rows: np.ndarray, index: np.ndarray, first: np.ndarray) -> np.ndarray:
    n = np.diff(first)
    best = np.zeros((len(n), len(net.bias)), np.float32)
    full = np.flatnonzero(n)
    if len(full):
        by_word = np.concatenate((net.table[rows].mean(axis=1) @ net.filters, np.zeros((1, COLUMNS), np.float32)))
        seq, start = padded(index, first, len(rows))
        z = activations(by_word, seq, net.bias)
        edges = np.column_stack((start[full], start[full] + n[full])).ravel()
        best[full] = np.maximum(np.maximum.reduceat(z, edges, axis=0)[::2], 0)
    return best @ net.out + net.out_bias


def fit(texts: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray) -> Network:
    """Trains on texts (table rows of distinct words, index of each word); labels 0 or 1. Adagrad on the logistic loss."""
    rng = np.random.default_rng(SEED)
    table = rng.normal(0, 0.1, (BUCKETS, WIDE)).astype(np.float32)
    filters = rng.normal(0, 0.5, (WIDE, COLUMNS)).astype(np.float32)
    bias, out, out_bias = np.zeros(len(WIDTHS) * FILTERS, np.float32), rng.normal(0, 0.5, len(WIDTHS) * FILTERS).astype(np.float32), 0.0
    speed = {"table": np.full_like(table, 0.1), "filters": np.full_like(filters, 0.1), "bias": np.full_like(bias, 0.1), "out": np.full_like(out, 0.1)}
    positive = max(float(labels.mean()), 1e-3) if len(labels) else 0.5
    scale = np.where(labels == 1, 0.5 / positive, 0.5 / max(1 - positive, 1e-3)) if len(labels) else np.zeros(0)
    used = [i for i in range(len(texts)) if len(texts[i][1])]
    for _ in range(EPOCHS):
        order = rng.permutation(used) if used else []
        for lo in range(0, len(order), BATCH):
            group = order[lo : lo + BATCH]
            rows = np.concatenate([texts[i][0] for i in group])
            shift = np.cumsum([0] + [len(texts[i][0]) for i in group])
            first = np.cumsum([0] + [len(texts[i][1]) for i in group])
            seq, start = padded(np.concatenate([texts[i][1] + s for i, s in zip(group, shift, strict=False)]), first, len(rows))
            vectors = np.concatenate((table[rows].mean(axis=1), np.zeros((1, WIDE), np.float32)))
            z = activations(vectors @ filters, seq, bias)
            at = np.array([s + z[s : s + n].argmax(axis=0) for s, n in zip(start, np.diff(first), strict=True)])  # (texts, filters)
            top = np.take_along_axis(z, at, axis=0)
            best = np.maximum(top, 0)
            error = ((1 / (1 + np.exp(-(best @ out + out_bias))) - labels[group]) * scale[group]).astype(np.float32)
            d_top = error[:, None] * out * (top > 0)
            g_filters, g_words = np.zeros_like(filters), np.zeros((len(vectors), WIDE), np.float32)
            for _, place, columns, outs in _places():
                word = seq[at[:, outs] + place]
                g_filters[:, columns] = np.einsum("bf,bfd->df", d_top[:, outs], vectors[word])
                np.add.at(g_words, word, d_top[:, outs, None] * filters[:, columns].T[None])
            grads = {"filters": g_filters, "bias": d_top.sum(axis=0), "out": error @ best}
            for name, value in (("filters", filters), ("bias", bias), ("out", out)):
                speed[name] += grads[name] ** 2
                value -= PACE * grads[name] / np.sqrt(speed[name])
            out_bias -= PACE * float(error.mean())
            hit = np.flatnonzero(np.abs(g_words[:-1]).sum(axis=1))
            touched, back = np.unique(rows[hit], return_inverse=True)
            g = np.zeros((len(touched), WIDE), np.float32)
            np.add.at(g, back.ravel(), np.repeat(g_words[hit] / 3, 3, axis=0))
            speed["table"][touched] += g**2
            table[touched] -= PACE * g / np.sqrt(speed["table"][touched])
    return Network(table, filters, bias, out, out_bias, {})


def guessed_language(words: list[bytes], index: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Number in LANGUAGES of each text: most function words; of equals the first, of none the last."""
    sets = [{w.encode() for w in ws} for ws in FUNCTION_WORDS.values()]
    hits = np.array([[w in s for s in sets] for w in words], np.int64).reshape(-1, len(sets))
    sums = np.column_stack([common.segment_sums(hits[index, k], first) for k in range(len(sets))])
    return np.where(sums.max(axis=1, initial=0) > 0, sums.argmax(axis=1), len(sets))


def calibrated(scores: np.ndarray, labels: np.ndarray, languages: np.ndarray, few: int = 5) -> dict[str, float]:
    """Threshold of each language: the cut of best F1, midway between its neighbours; with few positive texts that of all."""

    def cut(s: np.ndarray, y: np.ndarray) -> float:
        order = np.argsort(-s, kind="stable")
        s, y = s[order], y[order]
        hits = np.cumsum(y)
        f1 = 2 * hits / (np.arange(1, len(s) + 1) + y.sum())
        k = int(f1.argmax())
        return float((s[k] + s[k + 1]) / 2) if k + 1 < len(s) else float(s[k]) - 1e-6

    every = cut(scores, labels) if labels.sum() else 0.0
    return {name: cut(scores[languages == i], labels[languages == i]) if labels[languages == i].sum() >= few else every for i, name in enumerate(LANGUAGES)}


def trained(docs: DataFrame, labels: DataFrame, most: int = MOST_ROWS) -> Network:
    """Fits on the labelled texts outside the held-out fold, `most` at most; see common.learning_rows()."""
    rows = common.learning_rows(docs, labels, "toxic", most, MOST_BYTES, FOLDS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, texts in common.text_slices(batch):
                out = []
                for t in texts:
                    words = common.Words([t], lower=True)
                    index, distinct = words.encoded()
                    out.append((word_rows(distinct).tobytes(), index.astype(np.int32).tobytes(), int(guessed_language(distinct, index, words.first)[0])))
                r, i, g = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(lo, hi - lo), batch.column("_y").slice(lo, hi - lo).cast(pa.int32()), pa.array(r, pa.binary()), pa.array(i, pa.binary()), pa.array(g, pa.int32())], names=["doc_id", "y", "rows", "index", "lang"])

    table = rows.mapInArrow(run, "doc_id bigint, y int, rows binary, index binary, lang int").toArrow().sort_by("doc_id").to_pylist()
    texts = [(np.frombuffer(r["rows"], np.int32).reshape(-1, 3), np.frombuffer(r["index"], np.int32).astype(np.int64)) for r in table]
    y, lang = np.array([r["y"] for r in table], float), np.array([r["lang"] for r in table], int)
    net, scores, half = fit(texts, y), np.zeros(len(texts)), np.arange(len(texts)) % 2
    for side in (0, 1) if len(texts) > 1 else ():
        learned = np.flatnonzero(half != side)
        other = fit([texts[i] for i in learned], y[learned])
        for k in np.flatnonzero(half == side):
            rows_, index = texts[k]
            scores[k] = float(logits(other, rows_, index, np.array([0, len(index)]))[0])
    return net._replace(thresholds=calibrated(scores, y, lang) if len(y) else dict.fromkeys(LANGUAGES, 0.0))


def scored(docs: DataFrame, net: Network) -> DataFrame:
    """Per row of docs(doc_id, text): doc_id, held_out, score, predicted. Null and word-less texts are scored like any other."""
    held = docs.sparkSession.sparkContext.broadcast(net)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = held.value
        cuts = np.array([n.thresholds[x] for x in LANGUAGES])
        for batch in batches:
            parts = [np.zeros(0)]
            for _, _, texts in common.text_slices(batch, most=500_000):
                words = common.Words(texts, lower=True)
                index, distinct = words.encoded()
                z = logits(n, word_rows(distinct), index, words.first) - cuts[guessed_language(distinct, index, words.first)]
                parts.append(1 / (1 + np.exp(-np.clip(z, -40, 40))))
            score = np.concatenate(parts)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(score)], names=["doc_id", "score"])

    out = common.texts_of(docs, F.col("doc_id").cast("bigint"), "text").mapInArrow(run, "doc_id bigint, score double")
    held_out = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(FOLDS)) == 0, F.lit(False))
    return out.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """scored() with a network fitted on labels(doc_id, toxic).

    Labels without a text, and null labels, are left out; without any label all scores follow from the initial network.
    A repeated label counts once. Rows repeat as in docs; extra columns are ignored; an empty table gives an empty result.
    A null doc_id is not held out. Very long texts are scored whole, one at a time; scores have no ties to break.
    """
    return scored(docs, trained(docs, labels))
