"""Exact SentencePiece (merge-type) encoding by backtracking, and decoding.

Texts are cut where no merge can cross: before each run of the space mark, and around characters of no piece. In a
section, the longest Aho-Corasick match is tried first; a token stays if it fits the one before (merging both texts
again gives just the two); else its next shorter prefix is tried, and positions that led nowhere are flagged in a field
so that none is tried twice. Runs of several space marks, whose pieces share one score, are merged by definition.
"""
from __future__ import annotations

import hashlib
import re
import struct
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .bpe import MergeVocabulary

SPACE = "▁"
#: Sections longer than this are not remembered; of others, so many at once in each worker.
REMEMBER_CHARS, REMEMBER = 48, 200_000
#: Piece types of the model format (fixed values).
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6


def fields(data: bytes) -> Iterator[tuple[int, object]]:
    """Field numbers and raw values of a protocol-buffer message."""
    at = 0

    def number() -> int:
        nonlocal at
        out = shift = 0
        while True:
            byte = data[at]
            at += 1
            out |= (byte & 127) << shift
            if byte < 128:
                return out
            shift += 7

    while at < len(data):
        tag = number()
        if tag & 7 == 0:
            yield tag >> 3, number()
        else:
            size = {1: 8, 5: 4}.get(tag & 7) or number()
            yield tag >> 3, data[at : at + size]
            at += size


class PieceModel:
    """A merge-type model with byte fallback and without a normalisation table, from its file's bytes."""

    def __init__(self, data: bytes):
        pieces, kinds, scores = [], [], []
        self.end, self.dummy = 2, True
        for field, value in fields(data):
            if field == 1:
                piece = dict(fields(value))
                pieces.append(piece[1].decode())
                kinds.append(piece.get(3, NORMAL))
                scores.append(struct.unpack("<f", piece[2])[0] if 2 in piece else 0.0)
            elif field == 2:
                self.end = dict(fields(value)).get(42, 2)
                if dict(fields(value)).get(3, 1) != 2:
                    raise ValueError("only merge-type models are supported")
            elif field == 3:
                spec = dict(fields(value))
                if spec.get(2) or spec.get(4, 1):
                    raise ValueError("models with a normalisation table or space removal are not supported")
                self.dummy = bool(spec.get(3, 1))
        self.pieces, self.kinds = pieces, kinds
        self.byte = {int(p[3:5], 16): i for i, (p, k) in enumerate(zip(pieces, kinds, strict=True)) if k == BYTE}
        if len(self.byte) != 256 or any(k in (USER_DEFINED, UNUSED) for k in kinds):
            raise ValueError("models without byte fallback, or with user-defined or unused pieces, are not supported")
        normal = {p: i for i, (p, k) in enumerate(zip(pieces, kinds, strict=True)) if k == NORMAL}
        texts = list(pieces)
        symbol = {}
        for c in sorted({c for p in normal for c in p}):
            if c not in normal:  # a character that only longer pieces have
                texts.append(c)
            symbol[c] = normal.get(c, len(texts) - 1)
        by_text = normal | {c: i for c, i in symbol.items()}
        priority = [-s for s in scores] + [0.0] * (len(texts) - len(scores))

        def pair(a: int, b: int) -> tuple[float, int] | None:
            found = normal.get(texts[a] + texts[b])
            return None if found is None else (priority[found], found)

        usable = [t if t in by_text and by_text[t] == i else "" for i, t in enumerate(texts)]
        self.vocabulary = MergeVocabulary(usable, symbol, pair)
        self.texts, self.symbol = texts, symbol
        if any(SPACE in p.lstrip(SPACE) for p in normal):
            raise ValueError("pieces with a space mark after other characters are not supported")
        self.automaton = ahocorasick.Automaton()
        valid = self.vocabulary.valid
        for i in valid:
            self.automaton.add_word(texts[i], (len(texts[i]) - 1, i))
        self.automaton.make_automaton()
        self.sizes = list(map(len, texts))
        self.shorter = [-1] * len(texts)
        for i in valid:
            t = texts[i]
            self.shorter[i] = next((by_text[t[:n]] for n in range(len(t) - 1, 0, -1) if by_text.get(t[:n]) in valid), -1)
        self.known = set(symbol).issuperset
        odd = "".join(re.escape(c) for c in "\n\t\r" if c not in symbol)
        self.sections = re.compile(f"{SPACE}+[^{SPACE}{odd}]*|[{odd}]|[^{SPACE}{odd}]+" if odd else f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+")
        self.remembered = _Remembered(self.both_texts)

    def _backtrack(self, text: str) -> list[int]:
        """Tokens of a text of known characters."""
        longest = {end - size: token for end, (size, token) in self.automaton.iter(text)}  # the last of a start is its longest
        sizes, shorter, known, fits = self.sizes, self.shorter, self.vocabulary.known, self.vocabulary.fits
        out: list[int] = []
        at, last, n = 0, -1, len(text)
        failed = bytearray(n + 1)  # a flag for each position, so that marking one costs the same anywhere
        token = longest[0]
        while True:
            end = at + sizes[token]
            if not failed[end]:
                fine = last < 0 or known.get((last, token))
                if fine or fine is None and fits(last, token):
                    out.append(token)
                    if end == n:
                        return out
                    at, last, token = end, token, longest[end]
                    continue
            while (token := shorter[token]) < 0:
                failed[at] = 1
                token = out.pop()
                at -= sizes[token]
                last = out[-1] if out else -1

    def section(self, text: str) -> list[int]:
        """Ids of one section, with byte fallback."""
        if self.known(text) and SPACE * 2 not in text:
            out = self._backtrack(text)
            if max(out) < len(self.pieces):
                return out
        out = []
        symbol, n, at = self.symbol, len(text), 0
        while at < n:
            to = at
            while to < n and text[to] in symbol:
                to += 1
            if to > at:
                run = text[at:to]
                tokens = self.vocabulary.merge([symbol[c] for c in run]) if SPACE * 2 in run else self._backtrack(run)
                for t in tokens:
                    if t < len(self.pieces):
                        out.append(t)
                    else:
                        out.extend(self.byte[b] for b in self.texts[t].encode())
            if to < n:
                out.extend(self.byte[b] for b in text[to].encode("utf-8", "replace"))
                to += 1
            at = to
        return out

    def cut(self, text: str) -> list[str]:
        if not text:
            return []
        return self.sections.findall((SPACE if self.dummy else "") + text.replace(" ", SPACE))

    def encode(self, text: str) -> list[int]:
        """All ids of a text, the end id last."""
        return [i for s in self.cut(text) for i in self.section(s)] + [self.end]

    def both_texts(self, section: str) -> tuple[str, str | None]:
        """Ids joined by a space, and what they decode to; None for the section with spaces for its marks, as is usual."""
        ids = self.section(section)
        shown = self.surface(ids)
        return " ".join(map(str, ids)), None if shown == section.replace(SPACE, " ") else shown

    def surface(self, ids: list[int]) -> str:
        """Text of ids: control ids are empty, byte ids are UTF-8, each byte of an invalid sequence U+FFFD."""
        kinds = self.kinds
        if all([kinds[i] == NORMAL for i in ids]):
            return "".join([self.pieces[i] for i in ids]).replace(SPACE, " ")
        out: list[str] = []
        pending = bytearray()
        for i in [*ids, None]:
            if i is not None and self.kinds[i] == BYTE:
                pending.append(int(self.pieces[i][3:5], 16))
                continue
            at = 0
            while at < len(pending):
                for size in range(4, 0, -1):
                    try:
                        out.append(bytes(pending[at : at + size]).decode() if at + size <= len(pending) and len(bytes(pending[at : at + size]).decode()) == 1 else 1 / 0)
                        at += size
                        break
                    except (UnicodeDecodeError, ZeroDivisionError):
                        continue
                else:
                    out.append("�")
                    at += 1
            pending.clear()
            if i is not None and self.kinds[i] == NORMAL:
                out.append(self.pieces[i].replace(SPACE, " "))
            elif i is not None and self.kinds[i] == UNKNOWN:
                out.append(" ⁇ ")
        return "".join(out)

    def decode(self, ids: list[int]) -> str:
        """As surface(), without the space mark that encoding put in front."""
        text = self.surface(ids)
        first = next((i for i in ids if self.kinds[i] != CONTROL), None)
        return text[1:] if self.dummy and first is not None and self.pieces[first].startswith(SPACE) else text

    def digests(self, text: str) -> tuple[int, str, str]:
        """Number of ids, SHA-256 of the ids joined by a space, and SHA-256 of their decoded text."""
        cut = self.cut(text)
        parts = list(map(self.remembered.__getitem__, cut))
        ids = " ".join([*[p[0] for p in parts], str(self.end)])
        if any([p[1] is not None for p in parts]):
            decoded = "".join([c.replace(SPACE, " ") if p[1] is None else p[1] for c, p in zip(cut, parts, strict=True)])
        else:
            decoded = "".join(cut).replace(SPACE, " ")
        if self.dummy and decoded and cut[0].startswith(SPACE):
            decoded = decoded[1:]
        return ids.count(" ") + 1, hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()


class _Remembered(dict):
    """Results of make by section, in two generations: those not met again while a new one fills go."""

    def __init__(self, make):
        super().__init__()
        self.make, self.older = make, {}

    def __missing__(self, key: str) -> tuple[str, str | None]:
        value = self.older.get(key) or self.make(key)
        if len(key) <= REMEMBER_CHARS:
            if len(self) >= REMEMBER:
                self.older = dict(self)
                self.clear()
            self[key] = value
        return value


_MODELS: dict[str, PieceModel] = {}


def model(data: bytes) -> PieceModel:
    key = hashlib.sha256(data).hexdigest()
    if key not in _MODELS:
        _MODELS[key] = PieceModel(data)
    return _MODELS[key]


def encoded(docs: DataFrame, path: str) -> DataFrame:
    """Per row of docs(doc_id, text): doc_id, n_tokens, ids_sha256, decoded_sha256; path is the model file on the driver.

    Null texts count as empty and have the end id only. Rows stay as they are, repeats included; other columns are
    ignored; an empty table gives an empty result. Each text is encoded whole, in memory for one text at a time.
    """
    with open(path, "rb") as f:
        data = docs.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(data.value)
        for batch in batches:
            rows = [m.digests(t.decode("utf-8", "replace")) for _, _, texts in common.text_slices(batch) for t in texts]
            n, ids, decoded = zip(*rows, strict=True) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return common.texts_of(docs, F.col("doc_id").cast("bigint"), "text").mapInArrow(run, "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string")


def encoded_ids(docs: DataFrame, path: str) -> DataFrame:
    """Per row of docs(doc_id, text): doc_id, ids (array of int, the end id last) and the decoded text."""
    with open(path, "rb") as f:
        data = docs.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(data.value)
        for batch in batches:
            for lo, hi, texts in common.text_slices(batch):
                ids = [m.encode(t.decode("utf-8", "replace")) for t in texts]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(lo, hi - lo), pa.array(ids, pa.list_(pa.int32())), pa.array([m.decode(i) for i in ids], pa.string())], names=["doc_id", "ids", "decoded"])

    return common.texts_of(docs, F.col("doc_id").cast("bigint"), "text").mapInArrow(run, "doc_id bigint, ids array<int>, decoded string")
