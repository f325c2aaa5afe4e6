"""Divergence of the sources of each language by joint histograms of term counts.

Documents become counts of terms by language and source. For two sources of a language, only how many terms have which
pair of counts matters: tasks tally the pairs of counts that both have above zero, cells with a zero follow from each
source's own histogram and the number of kept terms, and the divergence is evaluated once for each cell and taken as
often as the cell has terms.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from . import common

#: Scale of the proportions, documents of a language that keep a term, ranks of the term report.
SCALE, LEAST_DOCS, REPORT = 1_000_000_000, 3, 200
#: Bytes of text that are tallied at once, pairs of counts that are expanded at once, cells that a task holds.
SLICE, EXPAND, HOLD = 4_000_000, 1_000_000, 1_000_000
#: Counts from here on are multiplied as decimals.
WIDE = 9_000_000_000

_LETTER = np.zeros(256, dtype=bool)
_LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20


def term_counts(texts: list[bytes], groups: np.ndarray) -> tuple[np.ndarray, pa.Array, np.ndarray, np.ndarray]:
    """Of texts and their group numbers: group, term, occurrences and documents of each group's distinct terms."""
    raw = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    inside = _LETTER[raw]
    edge = np.flatnonzero(np.diff(np.concatenate(([False], inside, [False])).astype(np.int8)))
    start, size = edge[::2], edge[1::2] - edge[::2]
    offsets = np.concatenate(([0], np.cumsum(size))).astype(np.int64)
    terms = pa.Array.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(offsets), pa.py_buffer(_LOWER[raw[inside]])])
    coded = terms.dictionary_encode()
    code, words = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary
    bounds = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1)
    text = np.searchsorted(bounds, start, side="right")
    in_text, times = np.unique(text * max(1, len(words)) + code, return_counts=True)
    key = groups[in_text // max(1, len(words))] * max(1, len(words)) + in_text % max(1, len(words))
    order = np.argsort(key, kind="stable")
    key, times = key[order], times[order]
    first = np.flatnonzero(np.diff(key, prepend=-1))
    n = np.add.reduceat(times, first) if len(first) else np.zeros(0, np.int64)
    return key[first] // max(1, len(words)), words.take(pa.array(key[first] % max(1, len(words)))), n.astype(np.int64), np.diff(np.append(first, len(key)))


def counts(docs: DataFrame) -> DataFrame:
    """lang, source, term, n, docs of docs(text, lang, source); each group has a row of the empty term too, without counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lang, source = batch.column("lang").to_pylist(), batch.column("source").to_pylist()
            for lo, hi, texts in common.text_slices(batch, most=SLICE):
                number: dict[tuple[str, str], int] = {}
                groups = np.array([number.setdefault(x, len(number)) for x in zip(lang[lo:hi], source[lo:hi], strict=True)], np.int64)
                names = list(number)
                group, term, n, docs_ = term_counts(texts, groups)
                group = np.concatenate((group, np.arange(len(names))))
                zero = np.zeros(len(names), np.int64)
                terms = pa.concat_arrays([term.cast(pa.large_string()), pa.array([""] * len(names), pa.large_string())]).cast(pa.string())
                columns = [pa.array([x[k] for x in names], pa.string()).take(pa.array(group)) for k in (0, 1)]
                yield pa.RecordBatch.from_arrays([*columns, terms, pa.array(np.concatenate((n, zero))), pa.array(np.concatenate((docs_, zero)))], names=["lang", "source", "term", "n", "docs"])

    read = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")]
    own = common.texts_of(docs, *read, "text").mapInArrow(run, "lang string, source string, term string, n bigint, docs bigint")
    return own.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


class _Tally:
    """How many terms have which pair of counts above zero in which two sources (a before b), with a bounded number of cells."""

    def __init__(self):
        self.parts: list[pa.Table] = []

    def add(self, a: np.ndarray, b: np.ndarray, ca: np.ndarray, cb: np.ndarray) -> None:
        cells = pa.table({"a": a, "b": b, "ca": ca, "cb": cb}).group_by(["a", "b", "ca", "cb"], use_threads=False).aggregate([([], "count_all")])
        self.parts.append(cells.rename_columns(["a", "b", "ca", "cb", "m"]))

    def cells(self) -> pa.Table:
        out = pa.concat_tables(self.parts).group_by(["a", "b", "ca", "cb"], use_threads=False).aggregate([("m", "sum")]).rename_columns(["a", "b", "ca", "cb", "m"])
        self.parts = [out]
        return out


def pairs_of(size: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of both members of all pairs within lists of these sizes that stand one after the other, EXPAND or one member's pairs at once."""
    end = np.cumsum(size)
    left = np.repeat(end, size) - 1 - np.arange(int(end[-1]) if len(end) else 0)  # partners after each place
    total = np.cumsum(left)
    lo = 0
    while lo < len(left):
        hi = max(lo + 1, int(np.searchsorted(total, (total[lo - 1] if lo else 0) + EXPAND, side="right")))
        own = left[lo:hi]
        one = np.repeat(np.arange(lo, hi), own)
        skip = np.cumsum(own) - own
        yield one, one + 1 + np.arange(len(one)) - np.repeat(skip, own)
        lo = hi


def joint(kept: DataFrame) -> DataFrame:
    """lang, a, b, ca, cb, m: number of kept terms of each pair of counts above zero in sources a < b of a language.

    kept(lang, sources: array of (source, n)) has a row for each term. Tasks tally before anything is shuffled.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number: dict[tuple[str, str], int] = {}
        tally = _Tally()

        def told(cells: pa.Table) -> Iterator[pa.RecordBatch]:
            names = list(number)
            for part in cells.to_batches(max_chunksize=100_000):
                a, b = part.column("a"), part.column("b")
                lang, source = (pa.array([x[k] for x in names], pa.string()) for k in (0, 1))
                yield pa.RecordBatch.from_arrays([lang.take(a), source.take(a), source.take(b), *[part.column(c) for c in ("ca", "cb", "m")]], names=["lang", "a", "b", "ca", "cb", "m"])

        for batch in batches:
            lists = batch.column("sources")
            size = np.diff(lists.offsets.to_numpy())
            items = lists.flatten()
            langs, sources = batch.column("lang").dictionary_encode(), items.field("source").dictionary_encode()
            lang = np.repeat(langs.indices.to_numpy(zero_copy_only=False), size)
            which = lang.astype(np.int64) * max(1, len(sources.dictionary)) + sources.indices.to_numpy(zero_copy_only=False)
            found, back = np.unique(which, return_inverse=True)
            l_names, s_names = langs.dictionary.to_pylist(), sources.dictionary.to_pylist()
            ids = np.array([number.setdefault((l_names[x // len(s_names)], s_names[x % len(s_names)]), len(number)) for x in found.tolist()], np.int64)
            group, n = ids[back] if len(found) else np.zeros(0, np.int64), items.field("n").to_numpy(zero_copy_only=False)
            rank = np.argsort(np.argsort(np.array([x[1].encode() for x in number], object), kind="stable")) if number else np.zeros(0, np.int64)
            for one, two in pairs_of(size):
                swap = rank[group[one]] > rank[group[two]]
                first, second = np.where(swap, two, one), np.where(swap, one, two)
                tally.add(group[first], group[second], n[first], n[second])
                if sum(p.num_rows for p in tally.parts) > 2 * HOLD and tally.cells().num_rows > HOLD:
                    yield from told(tally.cells())
                    tally = _Tally()
        if tally.parts:
            yield from told(tally.cells())

    own = kept.select("lang", "sources").mapInArrow(run, "lang string, a string, b string, ca bigint, cb bigint, m bigint")
    return own.groupBy("lang", "a", "b", "ca", "cb").agg(F.sum("m").alias("m"))


def proportion(count: Column, total: Column) -> Column:
    """1 + floor(SCALE * (count + 1) / total), exactly."""
    wide = F.lit(SCALE).cast("decimal(10,0)") * (count + 1).cast("decimal(19,0)")
    as_decimal = F.call_function("div", wide, total.cast("decimal(19,0)"))
    return F.lit(1) + F.when(count < WIDE, F.call_function("div", F.lit(SCALE) * (count + 1), total)).otherwise(as_decimal)


def divergence(p: Column, q: Column) -> Column:
    """floor((p - q)^2 / q); the square of a difference of proportions fits a bigint."""
    return F.call_function("div", (p - q) * (p - q), q)


def audit(docs: DataFrame) -> DataFrame:
    """lang, source, part, item, value, rank: how far each source of a language is from its others, and by which terms.

    docs(text, lang, source): nulls are read as empty strings, which are a language and a source like others. A term is a
    run of letters (ASCII, lower-cased, or any character beyond ASCII); a language keeps the terms in LEAST_DOCS of its
    rows. Part pair: each other source of the language by falling divergence, 0 without kept terms. Part term: the REPORT
    terms that a source overuses most against its language. Ties go by the item's UTF-8 bytes. Repeated rows count as often
    as they stand; texts are read whole; other columns are ignored; an empty table gives an empty result.
    """
    own = common.written(counts(docs), "counts")
    kept = own.where("n > 0").groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("n"), F.collect_list(F.struct("source", "n")).alias("sources")).where(F.col("docs") >= LEAST_DOCS)
    kept = common.written(kept.select("lang", "term", "n", "sources"), "kept")
    each = kept.select("lang", "term", F.col("n").alias("all_n"), F.explode("sources").alias("s")).select("lang", "term", "all_n", "s.source", "s.n")
    # totals: one row for each language and for each source of one
    langs = own.groupBy("lang").agg(F.lit(None).cast("bigint").alias("_")).select("lang")
    langs = langs.join(kept.groupBy("lang").agg(F.count("*").alias("v"), F.sum("n").alias("lang_n")), "lang", "left").fillna(0)
    sums = each.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count("*").alias("terms"))
    groups = own.where("term = ''").select("lang", "source").join(sums, ["lang", "source"], "left").fillna(0, ["total", "terms"])
    groups = common.written(groups.join(langs, "lang"), "groups")
    side = lambda c: groups.select("lang", F.col("source").alias(c), F.col("total").alias(f"n_{c}"), F.col("terms").alias(f"t_{c}"), *(["v"] if c == "a" else []))
    pairs = common.written(side("a").join(side("b"), "lang").where("a < b"), "pairs")
    # cells with a zero: what a source's own histogram has beyond the cells of both
    both = common.written(joint(kept), "joint")
    histogram = each.groupBy("lang", "source", F.col("n").alias("c")).agg(F.count("*").alias("m"))
    cell = lambda ca, cb, m: F.struct(ca.alias("ca"), cb.alias("cb"), m.alias("m"))
    ca, cb, m, zero = F.col("ca"), F.col("cb"), F.col("m"), F.lit(0).cast("bigint")
    corrected = both.select("lang", "a", "b", F.explode(F.array(cell(ca, cb, m), cell(ca, zero, -m), cell(zero, cb, -m), cell(zero, zero, m))).alias("s")).select("lang", "a", "b", "s.*")
    ends = pairs.select("lang", "a", "b")
    edges = [ends.join(histogram.withColumnRenamed("source", c), ["lang", c]).select("lang", "a", "b", *((F.col("c").alias("ca"), zero.alias("cb")) if c == "a" else (zero.alias("ca"), F.col("c").alias("cb"))), "m") for c in "ab"]
    nothing = pairs.select("lang", "a", "b", zero.alias("ca"), zero.alias("cb"), (F.col("v") - F.col("t_a") - F.col("t_b")).alias("m"))
    cells = corrected.unionByName(edges[0]).unionByName(edges[1]).unionByName(nothing).groupBy("lang", "a", "b", "ca", "cb").agg(F.sum("m").alias("m")).where("m > 0")
    # one evaluation for each cell, in both directions
    p, q = proportion(ca, F.col("n_a") + F.col("v")), proportion(cb, F.col("n_b") + F.col("v"))
    valued = cells.join(pairs, ["lang", "a", "b"]).select("lang", "a", "b", "m", p.alias("p"), q.alias("q"))
    ab, ba = m * divergence(F.col("p"), F.col("q")), m * divergence(F.col("q"), F.col("p"))
    found = valued.groupBy("lang", "a", "b").agg(F.sum(ab).alias("ab"), F.sum(ba).alias("ba"))
    told = pairs.select("lang", "a", "b").join(found, ["lang", "a", "b"], "left").fillna(0, ["ab", "ba"])
    row = lambda a, b, v: F.struct(F.col(a).alias("source"), F.col(b).alias("item"), F.col(v).alias("value"))
    pair_rows = told.select("lang", F.explode(F.array(row("a", "b", "ab"), row("b", "a", "ba"))).alias("s")).select("lang", "s.source", F.lit("pair").alias("part"), "s.item", "s.value")
    # terms that a source has more of than its language
    p, q = proportion(F.col("n"), F.col("total") + F.col("v")), proportion(F.col("all_n"), F.col("lang_n") + F.col("v"))
    over = each.join(groups.select("lang", "source", "total", "v", "lang_n"), ["lang", "source"]).select("lang", "source", F.col("term").alias("item"), p.alias("p"), q.alias("q")).where("p > q")
    term_rows = over.select("lang", "source", F.lit("term").alias("part"), "item", divergence(F.col("p"), F.col("q")).alias("value"))
    place = F.row_number().over(W.partitionBy("lang", "source", "part").orderBy(F.col("value").desc(), "item"))
    top = term_rows.withColumn("rank", place).where(F.col("rank") <= REPORT)
    return pair_rows.withColumn("rank", place).unionByName(top)
