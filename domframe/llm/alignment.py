"""Alignment of two tokenizations of each text, and corpus-wide counts of aligned token pairs.

Tokens of A and B whose bytes overlap are the edges of a bipartite graph. Its connected components, found by union-find,
are the minimal groups: runs of tokens of both sides that begin and end together. The members of a component expand into
its links. Each document's distinct linked pairs are counted over the corpus; a second pass weighs the links by these
counts: pairs that many documents hold from a broadcast array of bounded size, all others by a join.

Texts are cut into units where neither tokenizer can join what stands before and after: before a single space, and around
a line break, next to characters that are no white space. Distinct units of a slice are tokenized once, joined by line
breaks to one text.
"""
from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Bytes of text that are aligned at once, and pairs of token ids that are broadcast with their counts.
SLICE, FREQUENT = 3_000_000, 1_000_000
#: Units over this many bytes are tokenized alone.
LONG = 1_000
#: Fixed value: how byte-level vocabularies of this kind split texts.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_MARK = "▁".encode()


def cuts(raw: np.ndarray) -> np.ndarray:
    """Whether a unit begins at each byte of texts, each with a space in front and a line break behind."""
    space, line = raw == 0x20, raw == 0x0A
    white = space | line | (raw == 0x09) | ((raw >= 0x0B) & (raw <= 0x0D)) | ((raw >= 0x1C) & (raw <= 0x1F))
    first, last = white, white  # of characters of white space: their first and last bytes
    leads = np.flatnonzero((raw == 0xC2) | ((raw >= 0xE1) & (raw <= 0xE3)))
    if len(leads):
        padded = np.append(raw, [0, 0]).astype(np.int64)
        two, three = padded[leads] << 8 | padded[leads + 1], padded[leads] << 16 | padded[leads + 1] << 8 | padded[leads + 2]
        # White space beyond ASCII, as UTF-8.
        is_two = np.isin(two, [0xC285, 0xC2A0])
        is_three = np.isin(three, [0xE19A80, *range(0xE28080, 0xE2808B), 0xE280A8, 0xE280A9, 0xE280AF, 0xE2819F, 0xE38080])
        first, last = white.copy(), white.copy()
        first[leads[is_two | is_three]] = True
        last[np.concatenate((leads[is_two] + 1, leads[is_three] + 2))] = True
    before = lambda x, edge: np.concatenate(([edge], x[:-1]))
    word_next = np.append(~first[1:], False)
    return (space & word_next & ~before(space, True)) | (line & (word_next | ~before(last, True))) | (before(line, True) & ~first)


class Aligned(NamedTuple):
    """Of several units: numbers of tokens and groups, whether both sides give the unit's bytes, groups as text, and links.

    The links of unit i are link[first[i]:first[i + 1]], as a * (size of B) + b.
    """

    n_a: np.ndarray
    n_b: np.ndarray
    n_groups: np.ndarray
    fine: np.ndarray
    shown: list[str]
    first: np.ndarray
    link: np.ndarray


def union(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least node of each node's component under the edges (a, b): roots are hooked to lesser ones, then paths halved."""
    parent = np.arange(n)
    while True:
        x, y = parent[a], parent[b]
        open_ = x != y
        if not open_.any():
            return parent
        np.minimum.at(parent, np.maximum(x, y)[open_], np.minimum(x, y)[open_])
        while True:
            up = parent[parent]
            if (up == parent).all():
                break
            parent = up


class Aligner:
    """Two tokenizers of these files: byte-level A (JSON) and merge-type B with byte fallback (model)."""

    def __init__(self, a_file: bytes, b_file: bytes):
        import sentencepiece
        import tiktoken
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_str(a_file.decode())
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_proto=b_file)
        plain = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or b >= 0xAE]
        byte_of = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in plain)}
        spec = json.loads(a_file)
        vocabulary = spec["model"]["vocab"]
        self.a_bytes = [b""] * max(self.a.get_vocab_size(), max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            self.a_bytes[i] = bytes(byte_of[c] for c in token) if all(c in byte_of for c in token) else b""
        # ids that follow the order of merges are ranks: short units are then encoded by these, with the same result
        merged = [vocabulary["".join(m.split(" ") if isinstance(m, str) else m)] for m in spec["model"]["merges"]]
        most = max(merged)
        ranks = {t: i for i, t in enumerate(self.a_bytes) if t and i <= most}
        plain_split = spec["pre_tokenizer"] | {"trim_offsets": True} == {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}
        self.ranked = tiktoken.Encoding("a", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}) if merged == sorted(merged) and not spec.get("normalizer") and plain_split else None
        self.b_bytes = []
        for i in range(self.b.get_piece_size()):
            piece = self.b.id_to_piece(i)
            self.b_bytes.append(bytes([int(piece[3:5], 16)]) if self.b.is_byte(i) else b"" if self.b.is_control(i) else piece.replace("▁", " ").encode())
        self.a_size, self.b_size = (np.array(list(map(len, x)), np.int64) for x in (self.a_bytes, self.b_bytes))
        line = self.b.encode("\n")
        if len(line) != 2 or not self.b.is_byte(line[1]) or line[1] != self.b.piece_to_id("<0x0A>"):
            raise ValueError("only models that encode a line break by its byte are supported")
        # each id as text, by what follows it: in its side, between the sides, between groups
        self.words = [f"{i}{end}" for size, ends in ((len(self.a_bytes), ",|"), (len(self.b_bytes), ",;")) for end in ends for i in range(size)]

    def ids(self, text: str, short: bool = False) -> tuple[list[int], list[int]]:
        """Ids of A and of B; text stands after a line break, so that B adds no space. short: of short units."""
        return self.ranked.encode_ordinary(text) if short and self.ranked else self.a.encode(text, add_special_tokens=False).ids, self.b.encode("\n" + text, num_threads=1)[2:]

    def align(self, units: list[bytes]) -> Aligned:
        """Groups and links of units, which tokenize as they do where cuts() has cut them."""
        n = len(units)
        bad = np.array([_MARK in u for u in units], bool)
        spaces = b" \t\n\v\f\r\x1c\x1d\x1e\x1f"
        plain = [u[-1:].isascii() and u[-1] not in spaces and (u[0] not in spaces if u[:1] != b" " else len(u) > 1 and u[1] not in spaces) and u.isascii() or self._clean(u) for u in units]
        joined = [i for i in range(n) if plain[i] and not bad[i] and len(units[i]) <= LONG]
        alone = [i for i in range(n) if not bad[i] and (not plain[i] or len(units[i]) > LONG)]
        a_ids, b_ids, a_unit, b_unit = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        if joined:
            text = b"\n".join([units[i] for i in joined])
            ends = np.cumsum([len(units[i]) + 1 for i in joined])  # each with the line break after it
            a, b = (np.array(x, np.int64) for x in self.ids(text.decode(), True))
            if self.a_size[a].sum() == len(text) == self.b_size[b].sum():
                numbers = np.array(joined)
                for ids, size, all_ids, all_units in ((a, self.a_size, a_ids, a_unit), (b, self.b_size, b_ids, b_unit)):
                    end = np.cumsum(size[ids])
                    unit = np.searchsorted(ends, end, side="left")  # the line break ends where its unit's part does
                    within = end != ends[unit]
                    all_ids.append(ids[within])
                    all_units.append(numbers[unit[within]])
            else:
                alone = sorted(joined + alone)
        for i in alone:
            a, b = self.ids(units[i].decode("utf-8", "replace"))
            if b"".join([self.a_bytes[x] for x in a]) != units[i] or b"".join([self.b_bytes[x] for x in b]) != units[i]:
                bad[i] = True
                continue
            for ids, all_ids, all_units in ((a, a_ids, a_unit), (b, b_ids, b_unit)):
                all_ids.append(np.array(ids, np.int64))
                all_units.append(np.full(len(ids), i))
        a, b, au, bu = (np.concatenate(x) for x in (a_ids, b_ids, a_unit, b_unit))
        by_a, by_b = np.argsort(au, kind="stable"), np.argsort(bu, kind="stable")
        a, au, b, bu = a[by_a], au[by_a], b[by_b], bu[by_b]
        return self._graph(n, ~bad, a, au, b, bu)

    @staticmethod
    def _clean(unit: bytes) -> bool:
        """Whether a unit may stand between line breaks: no white space at its end, at most one space at its start."""
        text = unit.decode("utf-8", "replace")
        head = text[1:2] if text[:1] == " " else text[:1]
        return bool(head) and not head.isspace() and not text[-1].isspace()

    def _graph(self, n: int, fine: np.ndarray, a: np.ndarray, au: np.ndarray, b: np.ndarray, bu: np.ndarray) -> Aligned:
        a_end, b_end = np.cumsum(self.a_size[a]), np.cumsum(self.b_size[b])
        ends = np.union1d(a_end, b_end)  # between two neighbouring ends, one token of each side covers the bytes: an edge
        x, y = np.searchsorted(a_end, ends, side="left"), np.searchsorted(b_end, ends, side="left")
        root = union(len(a) + len(b), x, y + len(a))
        component = np.unique(root, return_inverse=True)[1] if len(root) else root
        ca, cb = component[: len(a)], component[len(a) :]
        link = a[x] * len(self.b_bytes) + b[y]
        first = np.searchsorted(au[x] if len(x) else x, np.arange(n + 1))
        count = int(component.max()) + 1 if len(component) else 0
        unit_of = np.zeros(count, np.int64)
        unit_of[ca] = au
        # tokens in order of their groups, A's before B's, each as its text
        order = np.argsort(np.concatenate((2 * ca, 2 * cb + 1)), kind="stable")
        last_a, last_b = np.append(np.diff(ca) != 0, True)[: len(a)], np.append(np.diff(cb) != 0, True)[: len(b)]
        word = np.concatenate((a + len(self.a_bytes) * last_a, 2 * len(self.a_bytes) + b + len(self.b_bytes) * last_b))[order]
        bounds = np.searchsorted(np.concatenate((au, bu))[order], np.arange(n + 1)).tolist()
        texts = list(map(self.words.__getitem__, word.tolist()))
        shown = ["".join(texts[lo:hi]) for lo, hi in zip(bounds[:-1], bounds[1:], strict=True)]
        return Aligned(np.bincount(au, minlength=n), np.bincount(bu, minlength=n), np.bincount(unit_of, minlength=n), fine, shown, first, link)


class Documents(NamedTuple):
    """Numbers of each of several documents, and the distinct links of document i with their numbers of occurrences."""

    numbers: np.ndarray
    digest: list[str]
    first: np.ndarray
    pair: np.ndarray
    times: np.ndarray


def documents(aligner: Aligner, texts: list[bytes]) -> Documents:
    """n_a, n_b, n_groups, n_links of texts (columns of numbers), digests of their groups, and links."""
    raw = np.frombuffer(b"".join([b" %s\n" % t for t in texts]), np.uint8)
    size = np.fromiter(map(len, texts), np.int64, len(texts)) + 2
    starts = np.cumsum(size) - size
    begins = cuts(raw)
    begins[starts] = True
    begins[starts + size - 1] = True  # the line break between texts is no unit
    at = np.flatnonzero(begins)
    arr = pa.Array.from_buffers(pa.large_binary(), len(at), [None, pa.py_buffer(np.append(at, len(raw)).astype(np.int64)), pa.py_buffer(raw)])
    of = np.searchsorted(starts, at, side="right") - 1
    inner = (at != starts[of] + size[of] - 1) & (size[of] > 2)  # an empty text has no units
    coded = arr.filter(pa.array(inner)).dictionary_encode()
    of, code, n = of[inner], coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), len(texts)
    d = aligner.align(coded.dictionary.to_pylist())
    units = len(d.fine)
    good = np.ones(n, bool)
    np.logical_and.at(good, of, d.fine[code])
    keep = good[of]
    of, code = of[keep], code[keep]
    n_links = np.diff(d.first)
    numbers = np.stack([np.bincount(of, x[code], n).astype(np.int64) for x in (d.n_a, d.n_b, d.n_groups, n_links)], axis=1) if units else np.zeros((n, 4), np.int64)
    bounds = np.searchsorted(of, np.arange(n + 1)).tolist()
    parts = list(map(d.shown.__getitem__, code.tolist()))
    digest = [hashlib.sha256("".join(parts[lo:hi])[:-1].encode()).hexdigest() if hi > lo else "" for lo, hi in zip(bounds[:-1], bounds[1:], strict=True)]
    held, times = np.unique(of * max(1, units) + code, return_counts=True)  # units of documents, expanded into links
    doc, unit = held // max(1, units), held % max(1, units)
    spread = n_links[unit]
    link = d.link[np.repeat(d.first[:-1][unit], spread) + np.arange(int(spread.sum())) - np.repeat(np.cumsum(spread) - spread, spread)]
    pairs, number = np.unique(link, return_inverse=True)
    key = np.repeat(doc, spread) * max(1, len(pairs)) + number
    order = np.argsort(key, kind="stable")
    key, weight = key[order], np.repeat(times, spread)[order]
    new = np.flatnonzero(np.diff(key, prepend=-1))
    times = np.add.reduceat(weight, new) if len(new) else np.zeros(0, np.int64)
    key = key[new]
    return Documents(numbers, digest, np.searchsorted(key // max(1, len(pairs)), np.arange(n + 1)), pairs[key % max(1, len(pairs))], times)


_ALIGNERS: dict[bytes, Aligner] = {}


def aligner(a_file: bytes, b_file: bytes) -> Aligner:
    key = hashlib.sha256(a_file + b_file).digest()
    if key not in _ALIGNERS:
        _ALIGNERS[key] = Aligner(a_file, b_file)
    return _ALIGNERS[key]


COUNTS = ["n_a", "n_b", "n_groups", "n_links"]


def aligned(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """Per row of docs(doc_id, text): doc_id, n_a, n_b, n_groups, n_links, groups_sha256, pairs and times (arrays).

    pairs are the distinct links of a document, a * (size of B) + b, times how often each occurs in it.
    """
    read = []
    for path in (a_path, b_path):
        with open(path, "rb") as f:
            read.append(docs.sparkSession.sparkContext.broadcast(f.read()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = aligner(read[0].value, read[1].value)
        for batch in batches:
            for lo, hi, texts in common.text_slices(batch, most=SLICE):
                d = documents(a, texts)
                lists = [pa.ListArray.from_arrays(pa.array(d.first, pa.int32()), pa.array(x, kind)) for x, kind in ((d.pair, pa.int64()), (d.times, pa.int32()))]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(lo, hi - lo), *[pa.array(d.numbers[:, k]) for k in range(4)], pa.array(d.digest, pa.string()), *lists], names=["doc_id", *COUNTS, "groups_sha256", "pairs", "times"])

    kinds = "doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string, pairs array<bigint>, times array<int>"
    return common.texts_of(docs, F.col("doc_id").cast("bigint"), "text").mapInArrow(run, kinds)


def pair_counts(rows: DataFrame, b_size: int) -> DataFrame:
    """a, pair, docs, best: how many rows(pairs) hold each pair, and whether that is the highest of its A id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pair, n = np.unique(batch.column("pairs").flatten().to_numpy(zero_copy_only=False), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(pair.astype(np.int64)), pa.array(n.astype(np.int64))], names=["pair", "docs"])

    own = rows.select("pairs").mapInArrow(run, "pair bigint, docs bigint").groupBy("pair").agg(F.sum("docs").alias("docs"))
    own = common.written(own.withColumn("a", F.call_function("div", F.col("pair"), F.lit(b_size))), "pairs")
    most = own.groupBy("a").agg(F.max("docs").alias("most"))
    out = own.join(most, "a").select("a", "pair", "docs", (F.col("docs") == F.col("most")).alias("best"))
    out.written_path = own.written_path
    return out


def weighed(rows: DataFrame, counted: DataFrame, frequent: int = FREQUENT) -> DataFrame:
    """rows(row, pairs, times, ...) with n_best and count_sum in the place of the arrays.

    The `frequent` pairs that most rows hold are broadcast; the others' counts come by a join on the pair, and are summed
    by row.
    """
    order = [F.col("docs").desc(), F.col("pair")]
    top = counted.select("pair", "docs", "best").orderBy(*order).limit(frequent).toArrow()
    known = [top.column(c).to_numpy() for c in ("pair", "docs", "best")]
    by_pair = np.argsort(known[0])
    table = rows.sparkSession.sparkContext.broadcast([x[by_pair] for x in known])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, docs, best = table.value
        for batch in batches:
            lists = batch.column("pairs")
            first = lists.offsets.to_numpy().astype(np.int64)
            first = first - first[0]
            own, times = lists.flatten().to_numpy(zero_copy_only=False), batch.column("times").flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            at = np.minimum(np.searchsorted(pair, own), max(0, len(pair) - 1))
            hit = pair[at] == own if len(pair) else np.zeros(len(own), bool)
            n = np.where(hit, docs[at], 0) if len(pair) else np.zeros(len(own), np.int64)
            good = hit & best[at] if len(pair) else hit
            rest = ~hit
            left = np.concatenate(([0], np.cumsum(rest)))[first]
            lists = [pa.ListArray.from_arrays(pa.array(left, pa.int32()), pa.array(x[rest])) for x in (own, times)]
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(common.segment_sums(times * good, first)), pa.array(common.segment_sums(times * n, first)), *lists], names=["row", "n_best", "count_sum", "pairs", "times"])

    sums = rows.select("row", "pairs", "times").mapInArrow(run, "row bigint, n_best bigint, count_sum bigint, pairs array<bigint>, times array<bigint>")
    if top.num_rows == frequent:
        sums = common.written(sums, "sums")
        rare = sums.select("row", F.explode(F.arrays_zip("pairs", "times")).alias("s")).select("row", F.col("s.pairs").alias("pair"), F.col("s.times").alias("times"))
        found = rare.join(counted.select("pair", "docs", "best"), "pair").groupBy("row").agg(F.sum(F.col("times") * F.col("docs")).alias("_c"), F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("_b"))
        sums = sums.join(found, "row", "left").select("row", (F.col("n_best") + F.coalesce("_b", F.lit(0))).alias("n_best"), (F.col("count_sum") + F.coalesce("_c", F.lit(0))).alias("count_sum"))
    return rows.drop("pairs", "times").join(sums.select("row", "n_best", "count_sum"), "row").drop("row")


def alignment(docs: DataFrame, a_path: str, b_path: str, frequent: int = FREQUENT) -> DataFrame:
    """Per row of docs(doc_id, text): doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    A reads a space before the text, B adds one itself; special strings are ordinary text. Null and empty texts, and texts
    that either side does not give back byte by byte (with U+2581), have no tokens: zeros and an empty digest, and they hold
    no pair. Rows stay as they are, repeats included, each a document of its own; other columns are ignored; an empty table
    gives an empty result. Texts are tokenized whole, one at a time where they are long.
    """
    import sentencepiece

    rows = common.written(aligned(docs, a_path, b_path).withColumn("row", F.monotonically_increasing_id()), "aligned")
    size = sentencepiece.SentencePieceProcessor(model_file=b_path).get_piece_size()
    out = weighed(rows, pair_counts(rows, size), frequent)
    return out.select("doc_id", *COUNTS, "n_best", "count_sum", "groups_sha256")
