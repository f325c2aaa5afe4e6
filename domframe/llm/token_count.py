"""Token counts by compiled finite-state transducers, without making tokens.

Two deterministic transducers, both with counts on their transitions:

* the cutter runs over classes of characters and counts the sections that the vocabulary's split pattern begins. It has
  few states, so a text is cut into chunks of equal length; for all chunks at once each character maps the vector of
  states (one for every possible entry state), the chunks' maps compose through a parallel prefix scan, and a second run
  from the now known entry states gives the places of the cuts;
* the counter runs over the bytes of a section. Its state is the Aho-Corasick node of the longest suffix that begins a
  token, with the last token and the relative count at each place from which a token may still be open. Its transitions
  carry the change in the number of tokens. States and transitions are compiled when first met. A chunk's map takes a
  state before it to the state after it and the tokens it emits; maps compose, states by application and counts by sum.
  Every section begins in the first state, so that a short one is a chunk whose map is needed there alone. A long one is
  cut into chunks. Each one's map begins with the state that its predecessor's last bytes lead to from nowhere (states
  forget what lies longer back than a token or two), and the maps compose through a prefix scan; a map that is asked for
  another state learns it then.

Distinct sections are counted once and summed by text.
"""
from __future__ import annotations

import hashlib
import json
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .bpe import MergeVocabulary

#: Documents over this many tokens are marked.
LIMIT = 1024
#: Characters of a chunk; sections up to REMEMBER_BYTES are remembered, so many in each of two generations; states before
#: the counter starts anew.
CHUNK, REMEMBER_BYTES, REMEMBER, MOST_STATES = 256, 64, 200_000, 120_000
#: Bytes of a chunk of a long section, bytes before a chunk that give its likely first state, and chunks that are scanned
#: together: between such blocks only a state is handed on, so that a section of any length needs bounded memory.
LONG, WARM, BLOCK = 1024, 96, 256

#: Classes: end of a text, number, other, apostrophe, space, other white space, and letters by their part in contractions.
END, NUMBER, OTHER, APOSTROPHE, SPACE, WHITE, LETTER, LETTER_STMD, LETTER_RV, LETTER_L, LETTER_E = range(11)
#: States of the cutter, by what the section has so far.
(AT_START, IN_LETTERS, IN_NUMBERS, IN_OTHERS, ON_APOSTROPHE, ON_RV, ON_L, ONE_SPACE, MORE_SPACE, ONE_WHITE, MORE_WHITE) = range(11)
#: Emitted: a cut before this character, a cut before the previous one.
HERE, BEFORE = 1, 2
_LETTERS = (LETTER, LETTER_STMD, LETTER_RV, LETTER_L, LETTER_E)


def compile_cutter() -> tuple[np.ndarray, np.ndarray]:
    """Next state and emission by [state, class], for the split pattern of byte-level vocabularies.

    The pattern: 's|'t|'re|'ve|'m|'ll|'d| ?letters| ?numbers| ?others|white space not before a word|white space.
    """
    go, cut = np.zeros((11, 11), np.uint8), np.zeros((11, 11), np.uint8)
    begin = {NUMBER: IN_NUMBERS, OTHER: IN_OTHERS, APOSTROPHE: ON_APOSTROPHE, SPACE: ONE_SPACE, WHITE: ONE_WHITE, END: AT_START} | dict.fromkeys(_LETTERS, IN_LETTERS)
    joins = {IN_LETTERS: _LETTERS, IN_NUMBERS: (NUMBER,), IN_OTHERS: (OTHER, APOSTROPHE), ON_APOSTROPHE: (OTHER, APOSTROPHE)}
    for state in range(11):
        for kind in range(11):
            to, out = begin[kind], HERE
            if state in joins and kind in joins[state]:
                to, out = IN_OTHERS if state == ON_APOSTROPHE else state, 0
            elif state == ON_APOSTROPHE and kind in (LETTER_STMD, LETTER_RV, LETTER_L):
                to, out = {LETTER_STMD: AT_START, LETTER_RV: ON_RV, LETTER_L: ON_L}[kind], 0
            elif (state, kind) in ((ON_RV, LETTER_E), (ON_L, LETTER_L)):
                to, out = AT_START, 0
            elif state in (ON_RV, ON_L):  # no contraction: the letter before began a section
                out = BEFORE | (0 if kind in _LETTERS else HERE)
            elif state in (ONE_SPACE, MORE_SPACE, ONE_WHITE, MORE_WHITE) and kind in (SPACE, WHITE):
                to, out = MORE_SPACE if kind == SPACE else MORE_WHITE, 0
            elif state in (ONE_SPACE, MORE_SPACE) and kind != END:  # the last space goes with the word
                to, out = IN_OTHERS if kind == APOSTROPHE else begin[kind], BEFORE if state == MORE_SPACE else 0
            elif state == MORE_WHITE and kind != END:
                out = BEFORE | HERE
            go[state, kind], cut[state, kind] = to, out
    return go, cut


def character_classes() -> np.ndarray:
    """Class of every code point."""
    out = np.full(0x110000, OTHER, np.uint8)
    for point in range(0x110000):
        kind = unicodedata.category(chr(point))[0]
        if kind in "LN":
            out[point] = LETTER if kind == "L" else NUMBER
    out[[0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]] = WHITE
    out[0x20], out[0x27] = SPACE, APOSTROPHE
    for letters, kind in (("stmd", LETTER_STMD), ("rv", LETTER_RV), ("l", LETTER_L), ("e", LETTER_E)):
        out[[ord(c) for c in letters]] = kind
    return out


class ChunkMap:
    """From the states before a chunk that were asked for to the state after it and the tokens it emits."""

    def __init__(self, counter: Counter, text: bytes):
        self.counter, self.text, self.known = counter, text, {}

    def apply(self, state: int) -> tuple[int, int]:
        found = self.known.get(state)
        if found is None:
            found = self.known[state] = self.counter.run(state, self.text)
        return found


class Composed:
    """The map of one run of chunks and of the one after it."""

    def __init__(self, first: ChunkMap | Composed, second: ChunkMap | Composed):
        self.first, self.second, self.known = first, second, {}
        for state in first.known:
            self.apply(state)

    def apply(self, state: int) -> tuple[int, int]:
        found = self.known.get(state)
        if found is None:
            middle, n = self.first.apply(state)
            after, m = self.second.apply(middle)
            found = self.known[state] = after, n + m
        return found


class Counter:
    """Cutter and counter of a byte-level vocabulary file (JSON with a merge list)."""

    def __init__(self, data: bytes):
        spec = json.loads(data)
        if spec.get("normalizer") or spec["pre_tokenizer"]["type"] != "ByteLevel" or spec["pre_tokenizer"]["add_prefix_space"] or spec["model"]["type"] != "BPE":
            raise ValueError("only byte-level vocabularies without a normaliser or prefix space are supported")
        plain = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or b >= 0xAE]
        byte_of = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in plain)}
        ids = spec["model"]["vocab"]
        texts = [b""] * (max(ids.values()) + 1)
        for text, i in ids.items():
            if all(c in byte_of for c in text):
                texts[i] = bytes(byte_of[c] for c in text)
        merges = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        pairs = {(ids[a], ids[b]): (float(rank), ids[a + b]) for rank, (a, b) in enumerate(merges)}
        symbol = {b: ids[c] for c, b in byte_of.items()}
        self.vocabulary = MergeVocabulary(texts, symbol, lambda a, b: pairs.get((a, b)))
        #: Strings that the library takes for one token wherever they stand; there is one at most here.
        self.specials = [a["content"].encode() for a in spec.get("added_tokens", [])]
        if len(self.specials) > 1:
            raise ValueError("vocabularies with several added tokens are not supported")
        self.classes, (self.go, self.cut) = character_classes(), compile_cutter()
        self._trie(texts)
        self.remembered: dict[bytes, int] = {}
        self.older: dict[bytes, int] = {}
        self._start()

    def _trie(self, texts: list[bytes]) -> None:
        """Aho-Corasick nodes: children, failure links, the depths of all suffixes that begin tokens, and tokens that end."""
        child: dict[int, int] = {}
        depth, own = [0], [-1]
        for token in self.vocabulary.valid:
            node = 0
            for b in texts[token]:
                key = node << 8 | b
                if key not in child:
                    child[key] = len(depth)
                    depth.append(depth[node] + 1)
                    own.append(-1)
                node = child[key]
            own[node] = token
        fail = [0] * len(depth)
        for key, node in sorted(child.items(), key=lambda x: depth[x[1]]):
            parent, b = key >> 8, key & 255
            if parent:
                f = fail[parent]
                while f and f << 8 | b not in child:
                    f = fail[f]
                fail[node] = child.get(f << 8 | b, 0)
        self.child, self.depth, self.own, self.fail = child, depth, own, fail

    def _start(self, keep: int = 0) -> int:
        """Forgets all compiled states but the first and the one to keep; the new number of that one."""
        kept = self.states[keep] if keep else None
        self.states: list[tuple[int, dict[int, tuple[int, int]]]] = [(0, {0: (-1, 0)})]
        self.numbers: dict[tuple, int] = {}
        self.moves: dict[int, tuple[int, int]] = {}
        if kept is None:
            return 0
        self.numbers[(kept[0], *kept[1].values())] = 1
        self.states.append(kept)
        return 1

    def _compile(self, state: int, b: int) -> tuple[int, int]:
        """The transition of a state on a byte: the next state and the change in the number of tokens."""
        node, places = self.states[state]
        child, fail, depth, own = self.child, self.fail, self.depth, self.own
        while node and node << 8 | b not in child:
            node = fail[node]
        node = child.get(node << 8 | b, 0)
        at = node
        while True:  # the one token that can end here fits the last token before it
            token = own[at]
            if token >= 0:
                last, count = places[depth[at] - 1]
                if last < 0 or self.vocabulary.fits(last, token):
                    break
            at = fail[at]
        change = count + 1
        new = {0: (token, 0)}
        at = node
        while at:
            last, count = places[depth[at] - 1]
            new[depth[at]] = (last, count - change)
            at = fail[at]
        key = (node, *new.values())
        to = self.numbers.get(key)
        if to is None:
            to = self.numbers[key] = len(self.states)
            self.states.append((node, new))
        self.moves[state << 8 | b] = (to, change)
        return to, change

    def run(self, state: int, text: bytes) -> tuple[int, int]:
        """State after text, and tokens emitted, from a state."""
        total, moves = 0, self.moves
        for b in text:
            move = moves.get(state << 8 | b)
            if move is None:
                move = self._compile(state, b)
            state = move[0]
            total += move[1]
        return state, total

    def section(self, text: bytes) -> int:
        """Number of tokens of one section."""
        total = self.run(0, text)[1] if len(text) <= LONG else self._long(text)
        if len(self.states) > MOST_STATES:
            self._start()
        return total

    def _long(self, text: bytes) -> int:
        """Number of tokens of a long section, block by block."""
        total = state = 0
        for lo in range(0, len(text), BLOCK * LONG):
            state, n = self._scan(text[lo : lo + BLOCK * LONG], state)
            total += n
            if len(self.states) > MOST_STATES:
                state = self._start(state)
        return total

    def _scan(self, text: bytes, state: int) -> tuple[int, int]:
        """State after a block, and its tokens, from a state: maps of its chunks, composed by a prefix scan."""
        maps = [ChunkMap(self, text[lo : lo + LONG]) for lo in range(0, len(text), LONG)]
        maps[0].apply(state)
        for k, m in enumerate(maps[1:], 1):
            m.apply(self.run(0, text[max(0, k * LONG - WARM) : k * LONG])[0])
        step = 1
        while step < len(maps):  # after a round each entry maps the run of 2 * step chunks that ends with it
            maps = [Composed(maps[k - step], m) if k >= step else m for k, m in enumerate(maps)]
            step *= 2
        return maps[-1].apply(state)

    def cuts(self, classes: np.ndarray) -> np.ndarray:
        """Whether a section begins at each character; ends of texts are sections of their own."""
        n = len(classes)
        rows = -(-n // CHUNK)
        padded = np.zeros(rows * CHUNK, np.uint8)
        padded[:n] = classes
        columns = np.ascontiguousarray(padded.reshape(rows, CHUNK).T)
        go, cut = self.go.ravel(), self.cut.ravel()
        maps = np.tile(np.arange(11, dtype=np.uint8), (rows, 1))
        for column in columns:  # a chunk's map: the state after it, by the state before it
            maps = go[maps * np.uint8(11) + column[:, None]]
        step = 1
        while step < rows:  # prefix scan: maps of ever longer runs of chunks
            maps[step:] = np.take_along_axis(maps[step:], maps[:-step].astype(np.intp), axis=1)
            step *= 2
        state = np.zeros(rows, np.uint8)
        state[1:] = maps[:-1, AT_START]
        emitted = np.empty((CHUNK, rows), np.uint8)
        for k, column in enumerate(columns):
            at = state * np.uint8(11) + column
            emitted[k] = cut[at]
            state = go[at]
        flat = emitted.T.ravel()[:n]
        begins = (flat & HERE).astype(bool)
        begins[:-1] |= (flat[1:] & BEFORE).astype(bool)
        begins[0] = True
        return begins

    def counts(self, texts: list[bytes]) -> np.ndarray:
        """Number of tokens of each text (UTF-8)."""
        for special in self.specials:
            if any(special in t for t in texts):  # counted alone; the texts around it are cut apart
                parts = [t.split(special) for t in texts]
                number = np.fromiter(map(len, parts), np.int64, len(parts))
                each = self._counts([p for ps in parts for p in ps])
                return common.segment_sums(each, np.concatenate(([0], np.cumsum(number)))) + number - 1
        return self._counts(texts)

    def _counts(self, texts: list[bytes]) -> np.ndarray:
        joined = (b"\0".join(texts) + b"\0").decode("utf-8", "replace")
        points = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        classes = self.classes[points]
        wide = 1 + (points > 0x7F).astype(np.int64) + (points > 0x7FF) + (points > 0xFFFF)
        ends = np.cumsum(wide)
        raw = joined.encode()
        lengths = np.fromiter((len(t.decode("utf-8", "replace").encode()) for t in texts), np.int64, len(texts)) + 1
        bounds = np.cumsum(lengths)
        last = np.searchsorted(ends, bounds)  # the characters that end texts
        classes[last] = END
        begins = np.flatnonzero(self.cuts(classes))
        offsets = np.append(ends[begins] - wide[begins], len(raw))
        coded = pa.Array.from_buffers(pa.large_binary(), len(begins), [None, pa.py_buffer(offsets), pa.py_buffer(raw)]).dictionary_encode()
        if len(self.remembered) > REMEMBER:
            self.older, self.remembered = self.remembered, {}
        remembered, older, section = self.remembered, self.older, self.section
        by_section = []
        for text in coded.dictionary.to_pylist():
            n = remembered.get(text)
            if n is None:
                n = older.get(text)
                if n is None:
                    n = section(text)
                if len(text) <= REMEMBER_BYTES:
                    remembered[text] = n
            by_section.append(n)
        number = np.array(by_section, np.int64)[coded.indices.to_numpy(zero_copy_only=False)]
        number[np.searchsorted(begins, last)] = 0
        return common.segment_sums(number, np.concatenate(([0], np.searchsorted(begins, last) + 1)))


_COUNTERS: dict[str, Counter] = {}


def counter(data: bytes) -> Counter:
    key = hashlib.sha256(data).hexdigest()
    if key not in _COUNTERS:
        _COUNTERS[key] = Counter(data)
    return _COUNTERS[key]


def token_counts(docs: DataFrame, path: str, limit: int = LIMIT) -> DataFrame:
    """Per row of docs(doc_id, text): doc_id, n_bytes, n_tokens, over_limit; path is the vocabulary file on the driver.

    Null texts count as empty: no bytes, no tokens. Rows stay as they are, repeats included; other columns are ignored;
    an empty table gives an empty result. Texts are never cut off; memory is bounded by a slice or one longer text.
    """
    with open(path, "rb") as f:
        data = docs.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = counter(data.value)
        for batch in batches:
            size, tokens = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for _, _, texts in common.text_slices(batch):
                size.append(np.fromiter(map(len, texts), np.int64, len(texts)))
                tokens.append(c.counts(texts))
            n = np.concatenate(tokens)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.concatenate(size)), pa.array(n), pa.array(n > limit)], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return common.texts_of(docs, F.col("doc_id").cast("bigint"), "text").mapInArrow(run, "doc_id bigint, n_bytes bigint, n_tokens bigint, over_limit boolean")
