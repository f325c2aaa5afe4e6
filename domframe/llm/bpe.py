"""Merge-type (byte-pair) vocabularies: merge trees, compatibility of adjacent tokens, and their Aho-Corasick trie."""
from __future__ import annotations

import heapq
from collections.abc import Callable, Sequence

NEVER = float("inf")


class MergeVocabulary:
    """Tokens numbered from 0 with their texts (str or bytes).

    pair(a, b) gives (priority, token) of the merge of two adjacent tokens, or None; merges run by rising priority, the
    leftmost first. symbol: the token of each single character or byte.
    """

    def __init__(self, texts: Sequence, symbol: dict, pair: Callable[[int, int], tuple[float, int] | None]):
        self.texts, self.symbol, self.pair = texts, symbol, pair
        #: Left and right part and priority of each token's last merge; tokens that their own text does not encode to lack one.
        self.tree: dict[int, tuple[int, int, float]] = {}
        self.valid = set(symbol.values())
        for token in sorted(range(len(texts)), key=lambda t: len(texts[t])):
            text = texts[token]
            if len(text) > 1 and all(c in symbol for c in text):
                made: dict[int, tuple[int, int, float]] = {}
                if self.merge([symbol[c] for c in text], made) == [token]:
                    self.valid.add(token)
                    self.tree[token] = made[token]
        self._spines: dict[tuple[int, bool], list[tuple[int, float, float]]] = {}
        #: What fits() has found, by pair.
        self.known: dict[tuple[int, int], bool] = {}

    def merge(self, tokens: list[int], made: dict | None = None) -> list[int]:
        """Runs all merges by their definition, with a heap of candidate pairs."""
        n, pair = len(tokens), self.pair
        token, after, before = list(tokens), list(range(1, n + 1)), list(range(-1, n - 1))
        heap: list[tuple[float, int, int, int, int]] = []

        def offer(i: int) -> None:
            j = after[i]
            if j < n and (m := pair(token[i], token[j])) is not None:
                heapq.heappush(heap, (m[0], i, token[i], token[j], m[1]))

        for i in range(n - 1):
            offer(i)
        while heap:
            priority, i, a, b, m = heapq.heappop(heap)
            j = after[i]
            if token[i] != a or j >= n or token[j] != b:
                continue
            if made is not None:
                made[m] = (a, b, priority)
            token[i], token[j], after[i] = m, -1, after[j]
            if after[j] < n:
                before[after[j]] = i
            offer(i)
            if before[i] >= 0:
                offer(before[i])
        return [t for t in token if t >= 0]

    def _spine(self, token: int, right: bool) -> list[tuple[int, float, float]]:
        """Tokens that stand at the right or left edge while token is merged: each with the priorities that make and absorb it."""
        found = self._spines.get((token, right))
        if found is None:
            found, absorbed = [], NEVER
            at = token
            while True:
                parts = self.tree.get(at)
                found.append((at, parts[2] if parts else -NEVER, absorbed))
                if not parts:
                    break
                absorbed, at = parts[2], parts[1 if right else 0]
            self._spines[token, right] = found
        return found

    def fits(self, a: int, b: int) -> bool:
        """Whether merging the text of a and b again leaves just these two: no merge across them comes in time."""
        known = self.known.get((a, b))
        if known is None:
            known, pair, left, right = True, self.pair, self._spine(a, True), self._spine(b, False)
            i = j = 0
            while True:  # along the pairs that stand next to each other at some time, the last first
                x, made_x, gone_x = left[i]
                y, made_y, gone_y = right[j]
                if (m := pair(x, y)) is not None and m[0] < gone_x and m[0] <= gone_y:
                    known = False
                    break
                if made_x == made_y == -NEVER:
                    break
                if made_x >= made_y:
                    i += 1
                else:
                    j += 1
            if len(self.known) > 400_000:
                self.known.clear()
            self.known[a, b] = known
        return known
