"""Line deduplication by a distributed suffix array over line ids.

The corpus is the sequence of all documents' lines, each document closed by an end of its own. Only suffixes that begin
with a line found elsewhere are sorted. Prefix doubling refines their ranks: in round j the pair of ranks at a place and
2^j lines later is sorted by range, so that a group of any size spreads over tasks; a suffix alone in its group is done.
Longest common prefixes of neighbours follow from line ids at the places where they are irreducible, and by subtraction
elsewhere. A sweep over the suffix array in both directions, with a stack of ever earlier candidates, gives each place the
longest run of lines there that also occurs earlier: the least interval of common prefixes with an earlier member. From
partition to partition only the earliest place of each length of common prefix is handed on, so that equal lines in any
number are one entry. Runs of enough words are deleted; the earliest copy stays.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from . import common

#: Words that a repeated run of lines must have to go; suffixes of a partition; a common prefix with itself.
MIN_WORDS, PART, FOREVER = 40, 250_000, (1 << 62)


def _lines(text: str = "text") -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _text_hash(text: str = "text") -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")), F.crc32(F.coalesce(text, F.lit("")).cast("binary")))


def _flat(lists: pa.ListArray, *names: str) -> list[np.ndarray]:
    """Bounds of the lists of structs, and their fields one after the other."""
    rows = lists.flatten()
    first = np.concatenate(([0], np.cumsum(lists.value_lengths().to_numpy())))
    return [first, *[rows.field(n).to_numpy(zero_copy_only=False).astype(np.int64) for n in names]]


def _lists(values: list[np.ndarray], kind: type) -> pa.ListArray:
    offsets = np.concatenate(([0], np.cumsum([len(v) for v in values]))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([np.zeros(0, kind), *values]).astype(kind)))


def _parts(n: int) -> int:
    return max(1, -(-n // PART))


def refined(pairs: DataFrame, n: int) -> tuple[DataFrame, DataFrame]:
    """New ranks of pairs(g, r, s): r and the number of members of its group with a smaller s; whether others share it.

    Rows are sorted by range and numbered within their partition; the driver sees one row of each partition. Returns
    (g, r, active) and the table that it reads.
    """

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if len(b)]
        if not held:
            return
        t = pa.Table.from_batches(held)
        r, s = t.column("r").to_numpy(), t.column("s").to_numpy()
        new_r = np.concatenate(([True], r[1:] != r[:-1]))
        new_s = new_r | np.concatenate(([True], s[1:] != s[:-1]))
        at_r, at_s = np.flatnonzero(new_r), np.flatnonzero(new_s)
        fr = at_r[np.cumsum(new_r) - 1]
        fs = at_s[np.cumsum(new_s) - 1]
        size = np.diff(np.append(at_s, len(r)))[np.cumsum(new_s) - 1]
        out = pa.table({"part": t.column("part"), "g": t.column("g"), "r": r, "s": s, "fr": fr, "fs": fs, "size": size})
        yield from out.to_batches()

    keys = ["r", "s", "g"]
    ranged = pairs.select(*keys).repartitionByRange(_parts(n), *keys).sortWithinPartitions(*keys).withColumn("part", F.spark_partition_id())
    numbered = common.written(ranged.mapInArrow(number, "part int, g bigint, r bigint, s bigint, fr bigint, fs bigint, size bigint"), "sorted")
    parts = numbered.groupBy("part").agg(
        F.count("*").alias("n"), F.min(F.struct("r", "s")).alias("lo"), F.max(F.struct("r", "s")).alias("hi"), F.max("fr").alias("fr"), F.max("fs").alias("fs"), F.max(F.when(F.col("fs") == 0, F.col("size"))).alias("head"), F.max_by("size", "fs").alias("tail")
    )
    rows = sorted(parts.collect(), key=lambda x: (tuple(x["lo"]), x["part"]))
    offset, before, edges, chain = 0, None, [], []
    for x in rows:
        lo, hi = tuple(x["lo"]), tuple(x["hi"])
        gr = before[1] if before and before[0][0] == lo[0] else offset
        joined = before is not None and before[0] == lo
        gs = before[2] if joined else offset
        if not joined:
            chain = []
        edge = {"part": x["part"], "offset": offset, "gr": gr, "gs": gs, "last": x["fs"], "head": x["head"], "tail": x["tail"]}
        chain.append((edge, "head"))
        chain_sum = (before[3] if joined else 0) + x["head"]
        for e, k in chain:
            e[k + "_all"] = chain_sum
        if lo != hi:
            chain, chain_sum = [(edge, "tail")], x["tail"]
            edge["tail_all"] = chain_sum
        else:
            edge["tail_all"] = chain_sum
            chain.append((edge, "tail"))
        before = (hi, gr if lo[0] == hi[0] else offset + x["fr"], gs if lo == hi else offset + x["fs"], chain_sum)
        offset += x["n"]
        edges.append(edge)
    table = [(e["part"], e["offset"], e["gr"], e["gs"], e["last"], e["head_all"], e["tail_all"]) for e in edges] or [(-1, 0, 0, 0, 0, 0, 0)]
    spread = numbered.join(F.broadcast(numbered.sparkSession.createDataFrame(table, "part int, offset bigint, gr bigint, gs bigint, last bigint, head bigint, tail bigint")), "part")
    first_r = F.when(F.col("fr") == 0, F.col("gr")).otherwise(F.col("offset") + F.col("fr"))
    first_s = F.when(F.col("fs") == 0, F.col("gs")).otherwise(F.col("offset") + F.col("fs"))
    size = F.when(F.col("fs") == 0, F.col("head")).when(F.col("fs") == F.col("last"), F.col("tail")).otherwise(F.col("size"))
    return spread.select("g", (F.col("r") + first_s - first_r).alias("r"), (size > 1).alias("active")), numbered


def suffix_array(places: DataFrame, bits: int) -> DataFrame:
    """g, id, r, level of places(g, id): r is the rank of the suffix at g, level the last round in which it was shared.

    bits: those of a line's number in its document; no text has 2^bits lines.
    """
    n = places.count()
    ranks, numbered = refined(places.select("g", F.lit(0).cast("bigint").alias("r"), F.col("id").alias("s")), n)
    now = common.written(ranks.withColumn("level", F.lit(-1)), "ranks")
    common.discard(numbered)
    step, level = 1, 0
    while (left := now.where("active").count()) and level < bits + 2:
        later = now.select((F.col("g") - step).alias("g"), F.col("r").alias("s"))
        pairs = now.where("active").select("g", "r").join(later, "g", "left").select("g", "r", F.coalesce("s", -F.col("g") - step - 1).alias("s"))
        ranks, numbered = refined(pairs, left)
        done = now.where("not active").unionByName(ranks.withColumn("level", F.lit(level)))
        after = common.written(done, "ranks")
        common.discard(now, numbered)
        now, step, level = after, step * 2, level + 1
    out = common.written(now.join(places, "g").select("g", "id", "r", "level"), "suffixes")
    common.discard(now)
    return out


def common_prefixes(suffixes: DataFrame, bits: int) -> DataFrame:
    """g, r, lcp of suffixes(g, id, r, level): lines that each suffix has in common with the one before it in the array."""
    doc, pos = F.shiftright("g", bits), F.col("g").bitwiseAND(F.lit((1 << bits) - 1)).cast("int")
    pairs = suffixes.select("g", "r", "id", "level").join(suffixes.select((F.col("r") + 1).alias("r"), F.col("g").alias("p"), F.col("id").alias("p_id")), "r", "left")
    ids = suffixes.select((F.col("g") + 1).alias("p"), F.col("id").alias("before_p"))
    own = suffixes.select((F.col("g") + 1).alias("g"), F.col("id").alias("before"))
    pairs = common.written(pairs.join(ids, "p", "left").join(own, "g", "left"), "pairs")
    fresh = pairs.where((F.col("id") == F.col("p_id")) & ~F.coalesce(F.col("before") == F.col("before_p"), F.lit(False)))

    def dense(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, (first, at, ids) = [], _flat(batch.column("x"), "at", "id")
            for lo, hi in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
                own = np.full(int(at[lo:hi].max()) + 1, -1, np.int64)
                own[at[lo:hi]] = ids[lo:hi]
                out.append(own)
            yield pa.RecordBatch.from_arrays([batch.column("doc"), _lists(out, np.int64)], names=["doc", "ids"])

    arrays = suffixes.select(doc.alias("doc"), pos.alias("at"), "id").groupBy("doc").agg(F.collect_list(F.struct("at", "id")).alias("x")).mapInArrow(dense, "doc bigint, ids array<bigint>")
    arrays = common.written(arrays, "arrays")
    length = F.pow(F.lit(2.0), F.col("level") + 1).cast("int")

    def part(place: str) -> Column:
        return F.slice("ids", F.col(place).bitwiseAND(F.lit((1 << bits) - 1)).cast("int") + 1, F.col("length"))

    one = fresh.select("g", "p", length.alias("length"), doc.alias("doc")).join(arrays, "doc").select("g", "p", "length", part("g").alias("a"), F.shiftright("p", bits).alias("doc"))
    two = one.join(arrays, "doc").select("g", "a", part("p").alias("b"))
    same = F.zip_with("a", "b", lambda x, y: F.coalesce((x == y) & (x >= 0), F.lit(False)))
    end = F.array_position(same, F.lit(False))
    known = two.select("g", F.when(end > 0, end - 1).otherwise(F.size(same)).cast("bigint").alias("own"))
    joined = pairs.join(known, "g", "left").withColumn("doc", doc)
    last = F.last(F.col("g") + F.col("own"), ignorenulls=True).over(W.partitionBy("doc").orderBy("g").rowsBetween(W.unboundedPreceding, 0))
    out = common.written(joined.select("g", "r", F.when(F.col("id") == F.col("p_id"), last - F.col("g")).otherwise(0).alias("lcp")), "prefixes")
    common.discard(pairs, arrays)
    return out


Stack = list[tuple[int, int]]


def sweep(g: np.ndarray, lcp: np.ndarray, stack: Stack) -> np.ndarray:
    """Longest common prefix of each suffix with an earlier-placed one before it; lcp[i] is with the suffix before.

    stack: (place, common prefix with the entry below), the nearest last; it is left as it is after these suffixes.
    """
    out = np.zeros(len(g), np.int64)
    for i, (place, now) in enumerate(zip(g.tolist(), lcp.tolist(), strict=True)):
        if now <= 0:
            stack.clear()
            now = 0
        while stack and stack[-1][0] > place:
            now = min(now, stack.pop()[1])
        if not stack or now == 0:
            stack.clear()
            now = 0
        out[i] = now
        stack.append((place, now))
    return out


def frontier(g: np.ndarray, lcp: np.ndarray) -> Stack:
    """(place, common prefix with the last suffix), nearest first: the earliest place of each length, if earlier than nearer ones."""
    v = np.concatenate(([FOREVER], np.minimum.accumulate(lcp[:0:-1])))
    place = g[::-1]
    fine = (np.concatenate(([FOREVER], np.minimum.accumulate(place)[:-1])) > place) & (v > 0)
    v, place = v[fine], place[fine]
    last = np.append(v[1:] != v[:-1], True)
    return list(zip(place[last].tolist(), v[last].tolist(), strict=True))


def carried(into: Stack, own: Stack, whole: int) -> Stack:
    """The frontier after a partition, from the one before it; whole: the least common prefix of its suffixes, the first's with the suffix before."""
    out = list(own)
    for place, v in into:
        v = min(v, whole)
        if v > 0 and place < out[-1][0]:
            if out[-1][1] == v:
                out.pop()
            out.append((place, v))
    return out


def stack_of(into: Stack) -> Stack:
    """The stack that a sweep begins with, from a frontier."""
    below = [v for _, v in into[1:]] + [0] * (len(into) > 0)
    return [(place, v) for (place, _), v in zip(into, below, strict=True)][::-1]


def earlier_runs(prefixes: DataFrame) -> DataFrame:
    """g and run (lines, at least 1) of prefixes(g, r, lcp): the longest run at g that also begins at an earlier place.

    The driver sees a frontier of each partition in either direction: an entry for each different length of common prefix
    with its last suffix, whatever the number of copies.
    """
    n = prefixes.count()
    parted = common.written(prefixes.repartitionByRange(_parts(n), "r").withColumn("part", F.spark_partition_id()), "array")

    def fronts(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("r")
        g, lcp = pdf["g"].to_numpy(), pdf["lcp"].to_numpy()
        flat = [[x for e in f for x in e] for f in (frontier(g, lcp), frontier(g[::-1], np.append(lcp[1:], 0)[::-1]))]
        return pd.DataFrame({"part": [pdf["part"].iloc[0]], "least": [pdf["r"].iloc[0]], "first": [lcp[0]], "inner": [lcp[1:].min(initial=FOREVER)], "left": [flat[0]], "right": [flat[1]]})

    rows = parted.groupBy("part").applyInPandas(fronts, "part int, least bigint, first bigint, inner bigint, left array<bigint>, right array<bigint>").collect()
    rows = sorted(rows, key=lambda x: x["least"])
    into: list[list] = [[x["part"], 0, [], []] for x in rows]
    for at, side in ((2, "left"), (3, "right")):
        now: Stack = []
        order = range(len(rows)) if side == "left" else range(len(rows) - 1, -1, -1)
        for i in order:
            x, gap = rows[i], rows[i + 1]["first"] if i + 1 < len(rows) else 0
            into[i][1], into[i][at] = gap, [y for e in now for y in e]
            now = carried(now, list(zip(x[side][::2], x[side][1::2], strict=True)), min(x["inner"], x["first"] if side == "left" else gap))

    def runs(pdf: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("r")
        left, right = (stack_of(list(zip(x[::2].tolist(), x[1::2].tolist(), strict=True))) for x in (np.asarray(held["left"].iloc[0]), np.asarray(held["right"].iloc[0])))
        g, lcp = pdf["g"].to_numpy(), pdf["lcp"].to_numpy()
        back = np.append(lcp[1:], held["gap"].iloc[0])
        run = np.maximum(sweep(g, lcp, left), sweep(g[::-1], back[::-1], right)[::-1])
        return pd.DataFrame({"g": g[run > 0], "run": run[run > 0]})

    held = parted.sparkSession.createDataFrame(into, "part int, gap bigint, left array<bigint>, right array<bigint>")
    out = parted.groupBy("part").cogroup(held.groupBy("part")).applyInPandas(runs, "g bigint, run bigint")
    out.written_path = parted.written_path
    return out


def removed_lines(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """doc_id, text_hash, removed (line numbers from 0, ascending) of docs(doc_id, text) that lose lines."""
    lines = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), _text_hash().alias("text_hash"), F.posexplode(_lines()).alias("pos", "line"))
    lines = lines.select("doc_id", "text_hash", "pos", F.unhex(F.md5("line")).alias("h"), F.regexp_count("line", F.lit(common.WORD)).alias("words"))
    lines = common.written(lines, "lines")
    again = common.with_index(lines.groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select("h"), "id")
    held = common.written(lines.join(again, "h").select("doc_id", "text_hash", "pos", "id", "words").distinct(), "repeated")
    order = common.with_index(held.select("doc_id", "text_hash").distinct().orderBy(F.col("doc_id").asc_nulls_last(), "text_hash"), "doc")
    top = held.agg(F.max("pos")).first()[0]
    bits = int((top or 0) + 2).bit_length()
    if order.count() >> (62 - bits):
        raise ValueError(f"too many documents for lines numbered in {bits} bits")
    o = order.select(F.col("doc_id").alias("_d"), F.col("text_hash").alias("_h"), "doc")
    placed = held.join(o, held["doc_id"].eqNullSafe(o["_d"]) & (held["text_hash"] == o["_h"])).select((F.shiftleft("doc", bits) + F.col("pos")).alias("g"), "id", "words")
    places = common.written(placed, "places")
    common.discard(lines, again, held)
    suffixes = suffix_array(places, bits)
    prefixes = common_prefixes(suffixes, bits)
    runs = earlier_runs(prefixes)
    own = places.join(runs, "g", "left").groupBy(F.shiftright("g", bits).alias("doc")).agg(F.collect_list(F.struct(F.col("g").bitwiseAND(F.lit((1 << bits) - 1)).alias("pos"), "words", F.coalesce("run", F.lit(0)).alias("run"))).alias("x"))

    def chosen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, (first, pos, words, run) = [], _flat(batch.column("x"), "pos", "words", "run")
            for lo, hi in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
                p, r = pos[lo:hi], run[lo:hi]
                size = int(p.max()) + 2
                held = np.zeros(size + 1, np.int64)
                held[p + 1] = words[lo:hi]
                upto = np.cumsum(held)
                some = r > 0
                p, end = p[some], (p + r)[some]
                long = upto[end] - upto[p] >= min_words
                gone = np.bincount(p[long], minlength=size) - np.bincount(end[long], minlength=size)
                out.append(np.flatnonzero(np.cumsum(gone) > 0))
            yield pa.RecordBatch.from_arrays([batch.column("doc"), _lists(out, np.int32)], names=["doc", "removed"])

    gone = own.mapInArrow(chosen, "doc bigint, removed array<int>").where(F.size("removed") > 0)
    out = common.written(gone.join(order, "doc").select("doc_id", "text_hash", "removed"), "removed")
    common.discard(order, places, suffixes, prefixes, runs)
    return out


def line_dedup(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """docs(doc_id, text, ...) with its own columns, the text without repeated runs, and n_lines and removed (line numbers).

    A run of lines goes if it has min_words words or more and also begins at an earlier place: at a smaller doc_id (null
    last), or above in the same text. Rows that repeat both doc_id and text are one document and get one result. Null
    texts are one empty line and become empty; a text may lose all lines and become empty. Texts of any number of lines
    are handled whole. n_lines and removed replace columns of those names; all others come back. An empty table gives an
    empty result.
    """
    gone = removed_lines(docs.select("doc_id", "text"), min_words)
    names = [c for c in docs.columns if c not in ("text", "n_lines", "removed")]
    packed = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), _text_hash().alias("text_hash"), F.col("text").alias("text"), F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"))
    r = gone.select(F.col("doc_id").alias("_d"), F.col("text_hash").alias("_h"), F.col("removed").alias("gone"))
    # what is removed grows with the input: it is merged at any size, never broadcast
    out = packed.join(r.hint("merge"), packed["doc_id"].eqNullSafe(r["_d"]) & (packed["text_hash"] == r["_h"]), "left")
    lines = _lines()
    kept = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), "gone")
    text = F.when(F.col("gone").isNull(), F.coalesce("text", F.lit(""))).otherwise(F.array_join(F.transform(kept, lambda i: F.get(lines, i)), "\n"))
    return out.select("row.*", text.alias("text"), F.size(lines).alias("n_lines"), F.coalesce("gone", F.array().cast("array<int>")).alias("removed"))
