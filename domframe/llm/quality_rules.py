"""Quality rules: plain counts of a text, then perplexity under an n-gram model of its language with an accepted band.

The model is an interpolated modified Kneser-Ney model of characters, order 4, over words joined by one space. A text's
probability is a product over its units: each word (its characters after the first and the space that ends it, given the
word so far) and each boundary (a word's first character given the two last ones of the word before and the space).

All steps grow with the corpus and none has a cap. Spark counts the distinct units of each language, then their n-grams;
discounts, continuation counts and back-off weights are grouped aggregations over whole n-grams. The probabilities of
n-grams lie in sorted arrays of 64-bit hashes, in shards of bounded size. Distinct units are dealt to batches; a batch
asks each shard once for the n-grams it holds, and each unit is scored once. Texts then take the most frequent units from
a broadcast array of bounded size, and the others by a join on their hash. Values are sums of integers, so that reruns
agree. Bands come from histograms over all documents that pass the plain rules, by language.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from . import common

#: Order of the model; n-grams of a shard, units of a batch, and units that are broadcast at most; batches for each shard.
ORDER, SHARD, BATCH, HOT, ASKING = 4, 1_000_000, 25_000, 400_000, 8
#: Parts of a log-probability's unit: sums are exact in these.
PARTS = 1e6
#: Least words, most repeated words in per cent; width of windows; width of a histogram's bin.
LEAST_WORDS, MOST_REPEATED, WINDOW, BIN = 50, 50, 3, 0.005
#: Bands around the median of ln(perplexity): so many robust standard deviations of a text of this length, and so far
#: at least. The deviation falls with the square root of the number of words.
BELOW, ABOVE, MARGIN = 5.0, 4.0, 0.03
#: Bytes of text whose distinct units are counted at once.
COUNT_BYTES = 3_000_000
_SYMBOLS = np.zeros(256, bool)
_SYMBOLS[list(b"#*$%&|<>")] = True
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def _by_language(batch: pa.RecordBatch, lo: int, hi: int, texts: list[bytes]) -> Iterator[tuple[str, list[int], list[bytes]]]:
    langs = batch.column("lang").slice(lo, hi - lo).to_pylist()
    for lang in sorted({x or "" for x in langs}):
        rows = [i for i, x in enumerate(langs) if (x or "") == lang]
        yield lang, rows, [texts[i] for i in rows]


def _coded(values: list[str]) -> tuple[np.ndarray, list[str]]:
    number: dict[str, int] = {}
    return np.array([number.setdefault(v, len(number)) for v in values], np.int64), list(number)


def boundaries(words: list[str], index: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, list[str]]:
    """Number of each word's boundary, and the distinct ones: the two characters before, a space, and the first character.

    words: the distinct ones; index: of each word; first: of each text's first word.
    """
    tail, tails = _coded([*((" " + w)[-2:] for w in words), "  "])
    head, heads = _coded([w[0] for w in words])
    before = np.concatenate(([len(words)], index[:-1])) if len(index) else index
    before[first[:-1][np.diff(first) > 0]] = len(words)
    code, distinct = pd.factorize(tail[before] * max(len(heads), 1) + head[index])
    return code, [tails[c // len(heads)] + " " + heads[c % len(heads)] for c in distinct.tolist()]


def units(docs: DataFrame) -> DataFrame:
    """lang, unit, n: the words of docs(lang, text), and their boundaries (which alone hold a space)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, texts in common.text_slices(batch, most=COUNT_BYTES):
                for lang, _, own in _by_language(batch, lo, hi, texts):
                    words = common.Words(own)
                    index, distinct = words.encoded()
                    names = [w.decode("utf-8", "replace") for w in distinct]
                    code, edges = boundaries(names, index, words.first)
                    n = np.concatenate((np.bincount(index, minlength=len(names)), np.bincount(code, minlength=len(edges))))
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(n), pa.string()), pa.array(names + edges, pa.string()), pa.array(n)], names=["lang", "unit", "n"])

    return common.texts_of(docs, "lang", "text").mapInArrow(run, "lang string, unit string, n bigint").groupBy("lang", "unit").agg(F.sum("n").alias("n"))


def language_hash(lang: str) -> int:
    return xxhash.xxh64_intdigest(lang.encode(), 42)


def unit_hash(lang: str, names: list[str]) -> np.ndarray:
    seed, digest = language_hash(lang), xxhash.xxh64_intdigest
    return np.array([digest(u.encode("utf-8", "replace"), seed) for u in names], np.uint64).view(np.int64)


def grams(names: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points (n, ORDER) of the n-grams that units predict, the predicted one last, and the unit of each."""
    edge = [" " in u for u in names]
    parts = [u if e else "   " + u + " " for u, e in zip(names, edge, strict=True)]
    points = np.frombuffer("".join(parts).encode("utf-32-le", "replace"), np.uint32)
    size = np.fromiter(map(len, parts), np.int64, len(parts))
    n = np.where(edge, 1, size - 4)
    begin = np.cumsum(size) - n
    at = np.repeat(begin - np.cumsum(n) + n, n) + np.arange(n.sum())
    return np.column_stack([points[at - k] for k in range(ORDER - 1, -1, -1)]) if len(at) else np.zeros((0, ORDER), np.uint32), np.repeat(np.arange(len(names)), n)


def gram_hash(langs: np.ndarray, points: np.ndarray) -> np.ndarray:
    """64-bit keys of n-grams: langs (hash of each one's language), points (n, ORDER)."""
    x = langs.astype(np.uint64)
    for k in range(ORDER):
        x = (x ^ points[:, k].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    return (x ^ (x >> np.uint64(32))).view(np.int64)


def _language_hashes(langs: list[str]) -> np.ndarray:
    known = {x: language_hash(x) for x in set(langs)}
    return np.array([known[x] for x in langs], np.uint64)


def gram_counts(counted: DataFrame) -> DataFrame:
    """lang, gram, n: n-grams of the highest order in counted(lang, unit, n), as strings."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs = batch.column("lang").to_pylist()
            points, unit = grams(batch.column("unit").to_pylist())
            _, some, back = np.unique(gram_hash(_language_hashes(langs)[unit], points), return_index=True, return_inverse=True)
            n = np.bincount(back, batch.column("n").to_numpy()[unit], len(some)).astype(np.int64)
            text = points[some].astype("<u4").tobytes().decode("utf-32-le", "replace")
            yield pa.RecordBatch.from_arrays([pa.array([langs[u] for u in unit[some].tolist()], pa.string()), pa.array([text[k : k + ORDER] for k in range(0, len(text), ORDER)], pa.string()), pa.array(n)], names=["lang", "gram", "n"])

    return counted.mapInArrow(run, "lang string, gram string, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def probabilities(counts: DataFrame) -> DataFrame:
    """lang, gram, p of counts(lang, gram, n): interpolated modified Kneser-Ney probability of each n-gram's last character.

    Lower orders count in how many longer n-grams each stands last. The order below the first is uniform over the
    language's characters and one more. Tables by language have a row for each, and are broadcast.
    """
    levels = {ORDER: counts}
    for k in range(ORDER - 1, 0, -1):
        levels[k] = common.written(levels[k + 1].groupBy("lang", F.substring("gram", 2, k).alias("gram")).agg(F.count("*").alias("n")), "level")
    lower = levels[1].groupBy("lang").agg((1 / (F.count("*") + 1)).alias("lower"))
    for k in range(1, ORDER + 1):
        f = [F.count_if(F.col("n") == i) for i in range(1, 5)]
        y = F.coalesce(F.try_divide(f[0], f[0] + 2 * f[1]), F.lit(0.5))
        d = [F.least(F.greatest(F.coalesce(F.lit(i) - (i + 1) * y * F.try_divide(f[i], f[i - 1]), F.lit(0.5 * i)), F.lit(0.1)), F.lit(i - 0.05)) for i in (1, 2, 3)]
        discount = levels[k].groupBy("lang").agg(*[x.alias(f"d{i}") for i, x in enumerate(d, 1)])
        off = F.when(F.col("n") == 1, F.col("d1")).when(F.col("n") == 2, F.col("d2")).otherwise(F.col("d3"))
        own = levels[k].join(F.broadcast(discount), "lang").select("lang", "gram", "n", off.alias("off"), F.substring("gram", 1, k - 1).alias("context"))
        context = own.groupBy("lang", "context").agg(F.sum("n").alias("total"), (F.sum("off") / F.sum("n")).alias("weight"))
        joined = own.join(context, ["lang", "context"])
        joined = joined.join(F.broadcast(lower), "lang") if k == 1 else joined.withColumn("suffix", F.substring("gram", 2, k - 1)).join(lower, ["lang", "suffix"])
        now = joined.select("lang", "gram", ((F.col("n") - F.col("off")) / F.col("total") + F.col("weight") * F.col("lower")).alias("p"))
        lower = now.select("lang", F.col("gram").alias("suffix"), F.col("p").alias("lower"))
    return now


def _shard(h: str, shards: int) -> Column:
    return F.pmod(F.col(h), F.lit(shards)).cast("int")


def sorted_arrays(found: DataFrame, shards: int) -> DataFrame:
    """shard, keys, parts of found(lang, gram, p): sorted hashes (int64) and log-probabilities (int32, in PARTS) of each shard."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = "".join(batch.column("gram").to_pylist())
            points = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32).reshape(-1, ORDER)
            yield pa.RecordBatch.from_arrays([pa.array(gram_hash(_language_hashes(batch.column("lang").to_pylist()), points)), pa.array(np.round(np.log(batch.column("p").to_numpy()) * PARTS).astype(np.int32))], names=["h", "v"])

    def packed(own: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values("h")
        return pd.DataFrame({"shard": own["shard"].iloc[:1], "keys": [own["h"].to_numpy().tobytes()], "parts": [own["v"].to_numpy(np.int32).tobytes()]})

    hashes = found.mapInArrow(hashed, "h bigint, v int").withColumn("shard", _shard("h", shards))
    return hashes.groupBy("shard").applyInPandas(packed, "shard int, keys binary, parts binary")


def looked_up(keys: np.ndarray, values: np.ndarray, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Values of hashes in a sorted array, by bisection, and whether each is there."""
    if not len(keys):
        return np.zeros(len(asked), values.dtype), np.zeros(len(asked), bool)
    at = np.minimum(np.searchsorted(keys, asked), len(keys) - 1)
    return values[at], keys[at] == asked


def unit_scores(counted: DataFrame, arrays: DataFrame, shards: int, n_units: int) -> DataFrame:
    """h, n, v of counted(lang, unit, n): hash, count, and log-probability (in PARTS) of each unit."""
    batches = max(1, -(-n_units // BATCH))
    dealt = counted.withColumn("batch", F.pmod(F.xxhash64("unit", "lang"), F.lit(batches)).cast("int"))

    def own_grams(own: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
        points, unit = grams(own["unit"].tolist())
        return gram_hash(_language_hashes(own["lang"].tolist())[unit], points), unit

    def request(own: pd.DataFrame) -> pd.DataFrame:
        asked = np.unique(own_grams(own)[0])
        shard = np.mod(asked, shards)
        found = np.unique(shard)
        return pd.DataFrame({"batch": own["batch"].iloc[0], "shard": found, "asked": [asked[shard == s].tobytes() for s in found]})

    def answer(asked: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        if not len(asked) or not len(held):
            return pd.DataFrame({"batch": [], "asked": [], "parts": []})
        keys, values = np.frombuffer(held["keys"].iloc[0], np.int64), np.frombuffer(held["parts"].iloc[0], np.int32)
        return pd.DataFrame({"batch": asked["batch"], "asked": asked["asked"], "parts": [looked_up(keys, values, np.frombuffer(a, np.int64))[0].tobytes() for a in asked["asked"]]})

    def score(own: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        keys = np.frombuffer(b"".join(answers["asked"]), np.int64)
        order = np.argsort(keys)
        values = np.frombuffer(b"".join(answers["parts"]), np.int32)[order]
        h, unit = own_grams(own)
        v = np.bincount(unit, looked_up(keys[order], values, h)[0], len(own)).astype(np.int64)
        langs, out = own["lang"].to_numpy(object), np.zeros(len(own), np.int64)
        for lang in set(langs.tolist()):
            at = np.flatnonzero(langs == lang)
            out[at] = unit_hash(lang, own["unit"].iloc[at].tolist())
        return pd.DataFrame({"h": out, "n": own["n"].to_numpy(), "v": v})

    asked = dealt.groupBy("batch").applyInPandas(request, "batch int, shard int, asked binary")
    answers = asked.groupBy("shard").cogroup(arrays.groupBy("shard")).applyInPandas(answer, "batch int, asked binary, parts binary")
    return dealt.groupBy("batch").cogroup(answers.groupBy("batch")).applyInPandas(score, "h bigint, n bigint, v bigint")


def base_counts(texts: list[bytes], words: common.Words, index: np.ndarray) -> dict[str, np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of each text."""
    n = words.counts()
    raw = np.frombuffer(b"".join(texts), np.uint8)
    bounds = np.concatenate(([0], np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)))))
    in_words = common.segment_sums(words.end - words.start, words.first)
    inner = np.diff(np.searchsorted(np.flatnonzero((raw & 0xC0) == 0x80), bounds))
    dup = np.zeros(len(texts), np.int64)
    for i, t in enumerate(texts):
        if b"\n" in t:
            lines = [x for x in t.split(b"\n") if x.strip(b" \t\n\x0b\x0c\r")]
            dup[i] = len(lines) - len(set(lines))
    found = np.zeros(len(index) + WINDOW, np.int64)
    if len(index) >= WINDOW:
        key, wide = index[: len(index) - WINDOW + 1], int(index.max()) + 1
        for k in range(1, WINDOW):
            key = key * wide + index[k : len(index) - WINDOW + 1 + k]
            if k + 1 < WINDOW and wide ** (k + 2) >= 1 << 63:
                key = pd.factorize(key)[0]
        key = pd.factorize(key)[0]
        text_of = np.repeat(np.arange(len(texts)), n)
        inside = (text_of[: len(key)] == text_of[WINDOW - 1 :]) & (np.bincount(key) > 1)[key]  # the others are found once
        at = np.flatnonzero(inside)
        same = pd.factorize(text_of[at] * (len(key) + 1) + key[at])[0]
        again = at[(np.bincount(same) > 1)[same]] if len(at) else at
        found += np.bincount(again, minlength=len(found)) - np.bincount(again + WINDOW, minlength=len(found))
    repeat = (np.cumsum(found)[: len(index)] > 0).astype(np.int64)
    symbols = np.diff(np.searchsorted(np.flatnonzero(_SYMBOLS[raw]), bounds))
    return {"n_words": n.astype(np.int64), "word_chars": in_words - inner, "n_symbols": symbols, "n_dup_lines": dup, "n_repeat_words": common.segment_sums(repeat, words.first)}


def scored(docs: DataFrame, keys: np.ndarray, values: np.ndarray) -> DataFrame:
    """row, doc_id, text_hash, lang, the base counts, hot and cold of each row of docs(doc_id, lang, text).

    hot: log-probability (in PARTS) of the units that keys (sorted) and values hold; cold: hashes of the others.
    """
    held = docs.sparkSession.sparkContext.broadcast((keys, values))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, values = held.value
        for batch in batches:
            for lo, hi, texts in common.text_slices(batch):
                counts = {c: np.zeros(len(texts), np.int64) for c in COUNTS}
                hot, cold = np.zeros(len(texts), np.int64), [np.zeros(0, np.int64)] * len(texts)
                for lang, rows, own in _by_language(batch, lo, hi, texts):
                    words = common.Words(own)
                    index, distinct = words.encoded()
                    for c, v in base_counts(own, words, index).items():
                        counts[c][rows] = v
                    names = [w.decode("utf-8", "replace") for w in distinct]
                    code, edges = boundaries(names, index, words.first)
                    missing = []
                    for found, at in ((names, index), (edges, code)):
                        h = unit_hash(lang, found)
                        v, known = looked_up(keys, values, h)
                        hot[rows] += common.segment_sums(np.where(known, v, 0).astype(np.int64)[at], words.first)
                        lost = np.flatnonzero(~known[at])
                        missing.append((h[at[lost]], np.searchsorted(lost, words.first)))
                    for i, row in enumerate(rows):
                        cold[row] = np.concatenate([h[cut[i] : cut[i + 1]] for h, cut in missing])
                offsets = np.concatenate(([0], np.cumsum([len(c) for c in cold]))).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(cold) if cold else np.zeros(0, np.int64)))
                yield pa.RecordBatch.from_arrays([*[batch.column(c).slice(lo, hi - lo) for c in ("row", "doc_id", "text_hash")], batch.column("lang").slice(lo, hi - lo).fill_null(""), *[pa.array(counts[c]) for c in COUNTS], pa.array(hot), lists], names=["row", "doc_id", "text_hash", "lang", *COUNTS, "hot", "cold"])

    named = common.texts_of(docs, F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("bigint"), F.xxhash64("text").alias("text_hash"), "lang", "text")
    return named.mapInArrow(run, "row bigint, doc_id bigint, text_hash bigint, lang string, " + ", ".join(f"{c} bigint" for c in COUNTS) + ", hot bigint, cold array<bigint>")


def perplexities(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, lang, the base counts and ln_perplexity (null without words) of each row of docs(doc_id, lang, text)."""
    counted = common.written(units(docs), "units")
    n_units = counted.count()
    counts = common.written(gram_counts(counted), "grams")
    # a shard is of bounded size, and so are the requests of all batches that one shard answers
    shards = max(1, -(-counts.count() // SHARD), -(-n_units // (ASKING * BATCH)))
    arrays = common.written(sorted_arrays(probabilities(counts), shards), "arrays")
    by_unit = common.written(unit_scores(counted, arrays, shards, n_units), "unit-scores")
    common.discard(counts, arrays, counted)
    # frequent units, by steps of a 64th of a power of two, as many as HOT takes
    step = F.floor(F.log2("n") * 64)
    least, total = 1 << 20, 0
    for x in sorted(by_unit.groupBy(step.alias("step")).count().collect(), key=lambda x: -x["step"]):
        if (total := total + x["count"]) > HOT:
            break
        least = x["step"]
    top = by_unit.where(step >= least).select("h", "v").toArrow()
    keys, values = top.column("h").to_numpy(), top.column("v").to_numpy()
    order = np.argsort(keys)
    found = common.written(scored(docs, keys[order], values[order]), "scores")
    rest = by_unit.where(step < least).select("h", "v")
    # both sides grow with the input: merged at any size
    cold = found.select("row", F.explode("cold").alias("h")).join(rest.hint("merge"), "h").groupBy("row").agg(F.sum("v").alias("rest"))
    total = F.col("hot") + F.coalesce("rest", F.lit(0))
    ln = F.when(F.col("n_words") > 0, -total / F.lit(PARTS) / (F.col("word_chars") + F.col("n_words")))
    out = found.drop("cold").join(cold.hint("merge"), "row", "left").withColumn("ln_perplexity", ln).drop("row", "hot", "rest")
    out = common.written(out, "perplexities")
    common.discard(by_unit, found)
    return out


def bands(scores: DataFrame) -> DataFrame:
    """lang, center, spread of scores(lang, n_words, ln_perplexity): the median, and the robust deviation of a text of one word.

    Both medians are read from histograms with bins of fixed width.
    """

    def median(table: DataFrame, value: str) -> DataFrame:
        bins = table.groupBy("lang", F.floor(F.col(value) / BIN).alias("bin")).agg(F.count("*").alias("n"))
        w = W.partitionBy("lang")
        upto = F.sum("n").over(w.orderBy("bin").rowsBetween(W.unboundedPreceding, 0))
        return bins.withColumn("upto", upto).withColumn("all", F.sum("n").over(w)).where("2 * upto >= all").groupBy("lang").agg(((F.min("bin") + 0.5) * BIN).alias("m"))

    center = median(scores, "ln_perplexity").withColumnRenamed("m", "center")
    off = scores.join(F.broadcast(center), "lang").withColumn("off", F.abs(F.col("ln_perplexity") - F.col("center")) * F.sqrt("n_words"))
    spread = median(off, "off").select("lang", (F.col("m") * 1.4826).alias("spread"))
    return center.join(spread, "lang")


def judged(docs: DataFrame) -> DataFrame:
    """Per row of docs(doc_id, lang, text): doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, ln_perplexity.

    Null texts have no words; null languages are one language, "". Texts of fewer than 50 words, or with over half of the
    words in repeated windows, fail; others are kept if ln_perplexity lies within their language's band, which comes from
    those others. Very long texts are handled whole, one at a time. Rows repeat as in docs; extra columns are ignored; an
    empty table gives an empty result.
    """
    scores = perplexities(docs)
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    marked = scores.withColumn("base_failed", failed)
    band = bands(marked.where("not base_failed"))
    unit = F.col("spread") / F.sqrt(F.greatest(F.col("n_words"), F.lit(1)))
    low, high = F.col("center") - F.greatest(unit * BELOW, F.lit(MARGIN)), F.col("center") + F.greatest(unit * ABOVE, F.lit(MARGIN))
    ranged = marked.join(F.broadcast(band), "lang", "left").withColumn("low", low).withColumn("high", high)
    within = F.col("ln_perplexity").between(F.col("low"), F.col("high"))
    return ranged.select("doc_id", *COUNTS, "base_failed", (~F.col("base_failed") & F.coalesce(within, F.lit(False))).alias("kept"), "ln_perplexity", "low", "high", F.col("lang").alias("language"), "text_hash")


def kept(docs: DataFrame) -> DataFrame:
    """The rows of docs(doc_id, lang, text, ...) that judged() keeps, with their columns."""
    good = judged(docs).where("kept").select(F.col("doc_id").alias("_d"), F.col("text_hash").alias("_h"), F.col("language").alias("_l"))
    same = docs["doc_id"].cast("bigint").eqNullSafe(good["_d"]) & (F.xxhash64(docs["text"]) == good["_h"]) & (F.coalesce(docs["lang"], F.lit("")) == good["_l"])
    return docs.join(good, same, "left_semi")
