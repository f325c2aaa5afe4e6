"""The node network as numpy layers with gradients: what a task computes on its rows.

Words and ancestors are sequences of any length; they stand one after the other, without padding, and a recurrent step
works on the sequences that still last. Parameters are a dict of matrices; lookup tables get gradients by row.
"""
from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

import numpy as np
import pyarrow as pa


class Settings(NamedTuple):
    """Shape of the network. words, tags: rows of the lookup tables, 0 for unknown ones and for nothing; of words, row 0 stays zero.

    word_function: how the words of a text become one vector: lstm (both directions, their mean), mean, or sum. lists: word
    lists of a node: 1, or 3 with its partner and its friends, whose encodings stand side by side. path_dim: width of the
    encoder of a node's ancestors, 0 for none. normalize: softmax or vector (by Euclidean length).
    """

    words: int
    tags: int
    classes: int
    dense: int = 0
    word_dim: int = 16
    tag_dim: int = 8
    lstm_dim: int = 16
    word_function: str = "lstm"
    lists: int = 1
    attrs: bool = False
    neighbors: bool = False
    edge: int = 3
    normalize: str = "softmax"
    path_tag_dim: int = 8
    path_dim: int = 0
    path_attrs: bool = False
    hidden: tuple[int, ...] = (100, 10)
    layer_norm: bool = False
    dropout: float = 0.3
    head_dropout: float = 0.5
    smoothing: float = 0.0

    @property
    def node_width(self) -> int:
        word = 0 if self.word_function == "none" else 2 * self.lstm_dim if self.word_function == "lstm" else self.word_dim
        return self.tag_dim + self.dense + word * self.lists + (self.word_dim if self.attrs else 0)


def initial(s: Settings, seed: int = 42, vectors: np.ndarray | None = None) -> dict[str, np.ndarray]:
    """Parameters before training; vectors: known word vectors for the rows of words from 1 on."""
    r = np.random.default_rng(seed)
    uniform = lambda rows, columns, fan: r.uniform(-1, 1, (rows, columns)) / np.sqrt(fan)
    out = {"words": r.normal(size=(s.words, s.word_dim)), "tags": r.normal(size=(s.tags, s.tag_dim))}
    if vectors is not None:
        out["words"][1:] = vectors
    out["words"][0] = 0

    def lstm(name: str, width: int, state: int) -> None:
        for way in ("ahead", "back"):
            out[f"{name}.{way}.x"] = uniform(width, 4 * state, state)
            out[f"{name}.{way}.h"] = uniform(state, 4 * state, state)
            out[f"{name}.{way}.b"] = uniform(1, 4 * state, state)

    if s.word_function == "lstm":
        lstm("text", s.word_dim, s.lstm_dim)
    width = s.node_width
    if s.neighbors:
        out["attention.w"], out["attention.b"] = uniform(2 * width + s.edge, 1, 2 * width + s.edge), uniform(1, 1, 2 * width + s.edge)
        width *= 2
    if s.path_dim:
        out["path_tags"] = r.normal(size=(s.tags, s.path_tag_dim))
        lstm("path", s.path_tag_dim + (s.word_dim if s.path_attrs else 0), s.path_dim)
        width += 2 * s.path_dim
    for k, (before, after) in enumerate(zip((width, *s.hidden), (*s.hidden, s.classes), strict=True)):
        out[f"head{k}.w"], out[f"head{k}.b"] = uniform(before, after, before), uniform(1, after, before)
        if s.layer_norm and k < len(s.hidden):
            out[f"head{k}.gain"], out[f"head{k}.shift"] = np.ones((1, after)), np.zeros((1, after))
    return out


#: Lookup tables, whose gradients go by row.
TABLES = ("words", "tags", "path_tags")


class Lists(NamedTuple):
    """Lists one after the other: list i is ids[first[i]:first[i + 1]]."""

    first: np.ndarray
    ids: np.ndarray

    @classmethod
    def of(cls, lists) -> Lists:
        size = np.fromiter((len(x) for x in lists), np.int64, len(lists))
        flat = [np.asarray(x) for x in lists if len(x)]
        return cls(np.concatenate(([0], np.cumsum(size))).astype(np.int64), np.concatenate(flat).astype(np.int64) if flat else np.zeros(0, np.int64))


class Nodes(NamedTuple):
    """Features of nodes: words has `lists` lists for each."""

    words: Lists
    tag: np.ndarray
    dense: np.ndarray
    attrs: Lists


class Batch(NamedTuple):
    """Nodes to classify, then their neighbours: node i has those from first[i] to first[i + 1], each with an edge vector.

    path: tags from the root to the node; path_attrs: word lists of the same places.
    """

    nodes: Nodes
    count: int
    first: np.ndarray
    edge: np.ndarray
    path: Lists
    path_attrs: Lists
    y: np.ndarray


def sigmoid(z: np.ndarray) -> None:
    """1 / (1 + exp(z)) in place of z, which is the negative of what the sigmoid is taken of."""
    np.exp(z, out=z)
    z += 1
    np.reciprocal(z, out=z)


def segment_sum(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    out = np.zeros((len(first) - 1, *values.shape[1:]))
    full = np.flatnonzero(np.diff(first))
    if len(full):
        out[full] = np.add.reduceat(values, first[full], axis=0)
    return out


def summed_by(at: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct numbers of at, and the sum of the values of each."""
    order = np.argsort(at, kind="stable")
    ids, first = np.unique(at[order], return_index=True)
    return ids, np.add.reduceat(values[order], first, axis=0) if len(ids) else np.zeros((0, *values.shape[1:]))


def distinct(lists: Lists) -> tuple[Lists, np.ndarray]:
    """The lists without those that are like an earlier one, and the place of each list among these."""
    ids = np.ascontiguousarray(lists.ids, np.int64)
    texts = pa.Array.from_buffers(pa.large_binary(), len(lists.first) - 1, [None, pa.py_buffer(lists.first.astype(np.int64) * ids.itemsize), pa.py_buffer(ids)])
    at = texts.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
    own = np.unique(at, return_index=True)[1]
    start, size = lists.first[own], np.diff(lists.first)[own]
    first = np.concatenate(([0], np.cumsum(size))).astype(np.int64)
    return Lists(first, ids[np.arange(first[-1]) + np.repeat(start - first[:-1], size)]), at


class Var:
    __slots__ = ("grad", "value")

    def __init__(self, value: np.ndarray):
        self.value, self.grad = value, None

    def add(self, grad: np.ndarray) -> None:
        self.grad = grad if self.grad is None else self.grad + grad


class Tape:
    """Computes forward, and notes how gradients go back (unless keep is false); rng: drops units out, if given."""

    def __init__(self, params: dict[str, np.ndarray], rng: np.random.Generator | None = None, keep: bool = True):
        self.params, self.rng, self.keep = params, rng, keep
        self.used: dict[str, Var] = {}
        self.looked_up: list[tuple[str, np.ndarray, Var]] = []
        self.steps: list[tuple[Var, Callable[[np.ndarray], None]]] = []

    def _note(self, value: np.ndarray, back: Callable[[np.ndarray], None]) -> Var:
        out = Var(value)
        if self.keep:
            self.steps.append((out, back))
        return out

    def param(self, name: str) -> Var:
        return self.used.setdefault(name, Var(self.params[name]))

    def rows(self, name: str, ids: np.ndarray) -> Var:
        out = Var(self.params[name][ids])
        self.looked_up.append((name, ids, out))
        return out

    def linear(self, x: Var, name: str) -> Var:
        w, b = self.param(f"{name}.w"), self.param(f"{name}.b")

        def back(g: np.ndarray) -> None:
            x.add(g @ w.value.T)
            w.add(x.value.T @ g)
            b.add(g.sum(axis=0, keepdims=True))

        return self._note(x.value @ w.value + b.value, back)

    def concat(self, parts: list[Var]) -> Var:
        if len(parts) == 1:
            return parts[0]
        cut = np.cumsum([p.value.shape[1] for p in parts])[:-1]

        def back(g: np.ndarray) -> None:
            for p, own in zip(parts, np.split(g, cut, axis=1), strict=True):
                p.add(own)

        return self._note(np.concatenate([p.value for p in parts], axis=1), back)

    def take(self, x: Var, at: np.ndarray) -> Var:
        def back(g: np.ndarray) -> None:
            out = np.zeros_like(x.value)
            rows, sums = summed_by(at, g)
            out[rows] = sums
            x.add(out)

        return self._note(x.value[at], back)

    def reshape(self, x: Var, width: int) -> Var:
        shape = x.value.shape
        return self._note(x.value.reshape(-1, width), lambda g: x.add(g.reshape(shape)))

    def relu(self, x: Var) -> Var:
        return self._note(np.maximum(x.value, 0), lambda g: x.add(g * (x.value > 0)))

    def dropout(self, x: Var, share: float) -> Var:
        if self.rng is None or not share:
            return x
        keep = (self.rng.random(x.value.shape) >= share) / (1 - share)
        return self._note(x.value * keep, lambda g: x.add(g * keep))

    def layer_norm(self, x: Var, name: str) -> Var:
        gain, shift = self.param(f"{name}.gain"), self.param(f"{name}.shift")
        scale = 1 / np.sqrt(x.value.var(axis=1, keepdims=True) + 1e-5)
        unit = (x.value - x.value.mean(axis=1, keepdims=True)) * scale

        def back(g: np.ndarray) -> None:
            gain.add((g * unit).sum(axis=0, keepdims=True))
            shift.add(g.sum(axis=0, keepdims=True))
            d = g * gain.value
            x.add(scale * (d - d.mean(axis=1, keepdims=True) - unit * (d * unit).mean(axis=1, keepdims=True)))

        return self._note(unit * gain.value + shift.value, back)

    def gathered(self, x: Var, first: np.ndarray, mean: bool) -> Var:
        """Sum or mean of the rows of each list, by its true length; zero for empty ones."""
        size = np.diff(first)
        share = 1 / np.maximum(size, 1)[:, None] if mean else np.ones((len(size), 1))
        return self._note(segment_sum(x.value, first) * share, lambda g: x.add(np.repeat(g * share, size, axis=0)))

    def lstm(self, x: Var, first: np.ndarray, name: str, back_to_front: bool) -> Var:
        """The states of each list's places. Lists are taken longest first, so that a step's lists are the leading ones."""
        wx, wh, b = (self.param(f"{name}.{k}") for k in "xhb")
        size = np.diff(first)
        order = np.argsort(-size, kind="stable")
        start, size = first[:-1][order], size[order]
        state = wh.value.shape[0]
        lasting = [int(np.searchsorted(-size, -t, side="left")) for t in range(int(size[0]) if len(size) else 0)]
        at = [start[:k] + (size[:k] - 1 - t if back_to_front else t) for t, k in enumerate(lasting)]
        # A step's lists are the leading ones of the step before. It has blocks of its own, with a column for each place.
        place = np.concatenate(at) if at else np.zeros(0, np.int64)
        low = np.concatenate(([0], np.cumsum(lasting))).astype(np.int64).tolist()
        step = [slice(lo, hi) for lo, hi in zip(low[:-1], low[1:], strict=True)]
        power = np.repeat([-1.0, -1.0, -2.0, -1.0], state)[:, None]  # sigmoid(x) = 1 / (1 + exp(-x)), tanh(x) = 2 * sigmoid(2x) - 1
        inward, across, shift = wx.value.T * power, wh.value.T * power, b.value.T * power
        inner = x.value[place]
        out = np.zeros((len(x.value), state))
        held: list[tuple[np.ndarray, ...]] = []
        h = c = np.zeros((state, 0))
        with np.errstate(over="ignore"):  # beyond the largest number a gate is shut
            for own, k in zip(step, lasting, strict=True):
                z = inward @ inner[own].T
                z += shift
                if held:
                    z += across @ h[:, :k]
                sigmoid(z)
                i, f, g, o = z.reshape(4, state, k)
                g *= 2
                g -= 1
                now = i * g
                if held:
                    now += f * c[:, :k]
                c, bent = now, now * -2
                sigmoid(bent)
                bent *= 2
                bent -= 1
                h = o * bent
                out[place[own]] = h.T
                held.append((z, c, bent, h) if self.keep else ())

        def back(grad: np.ndarray) -> None:
            grad = grad[place]
            dx, dwx, dwh, db = np.zeros_like(x.value), np.zeros_like(wx.value), np.zeros_like(wh.value), np.zeros((4 * state, 1))
            dh = dc = np.zeros((state, 0))
            for t in range(len(step) - 1, -1, -1):
                own, k = step[t], lasting[t]
                z, _, bent, _ = held[t]
                i, f, g, o = z.reshape(4, state, k)
                d = np.ascontiguousarray(grad[own].T)
                d[:, : dh.shape[1]] += dh
                e = d * o
                e *= 1 - bent * bent
                e[:, : dc.shape[1]] += dc
                dz = np.empty((4, state, k))
                np.multiply(e, g, out=dz[0])
                np.multiply(e, i, out=dz[2])
                np.multiply(d, bent, out=dz[3])
                dz[0] *= i * (1 - i)
                dz[2] *= 1 - g * g
                dz[3] *= o * (1 - o)
                if t:
                    np.multiply(e, held[t - 1][1][:, :k], out=dz[1])
                    dz[1] *= f * (1 - f)
                else:
                    dz[1] = 0
                dz = dz.reshape(4 * state, k)
                if t:
                    dwh += held[t - 1][3][:, :k] @ dz.T
                    dh, dc = wh.value @ dz, e * f
                dx[place[own]] = (wx.value @ dz).T
                dwx += inner[own].T @ dz.T
                db += dz.sum(axis=1, keepdims=True)
            x.add(dx)
            wx.add(dwx)
            wh.add(dwh)
            b.add(db.T)

        return self._note(out, back)

    def normalized(self, x: Var, first: np.ndarray, kind: str) -> Var:
        """Scores (one column) of each list by softmax, or divided by their Euclidean length."""
        size = np.diff(first)
        wide = lambda v: np.repeat(v, size, axis=0)
        if kind == "softmax":
            top = np.full((len(size), 1), -np.inf)
            np.maximum.at(top, np.repeat(np.arange(len(size)), size), x.value)
            e = np.exp(x.value - wide(top))
            p = e / wide(segment_sum(e, first))
            return self._note(p, lambda g: x.add(p * (g - wide(segment_sum(g * p, first)))))
        length = np.sqrt(segment_sum(x.value**2, first))
        low = np.maximum(length, 1e-12)
        p = x.value / wide(low)
        return self._note(p, lambda g: x.add((g - p * wide(np.where(length > 1e-12, segment_sum(g * p, first), 0.0))) / wide(low)))

    def weighted(self, weight: Var, x: Var, first: np.ndarray) -> Var:
        """Sum of the rows of each list, by their weights (one column)."""
        size = np.diff(first)

        def back(g: np.ndarray) -> None:
            own = np.repeat(g, size, axis=0)
            weight.add((own * x.value).sum(axis=1, keepdims=True))
            x.add(own * weight.value)

        return self._note(segment_sum(weight.value * x.value, first), back)

    def loss(self, logits: Var, y: np.ndarray, smoothing: float) -> float:
        """Sum of the cross entropies; smoothing: share of the target that all classes have alike. Starts the way back."""
        z = logits.value - logits.value.max(axis=1, keepdims=True)
        log_p = z - np.log(np.exp(z).sum(axis=1, keepdims=True))
        target = np.full_like(z, smoothing / z.shape[1])
        target[np.arange(len(y)), y] += 1 - smoothing
        logits.add(np.exp(log_p) - target)
        return float(-(target * log_p).sum())

    def gradients(self) -> tuple[dict[str, np.ndarray], dict[str, tuple[np.ndarray, np.ndarray]]]:
        """Of whole parameters, and of rows of lookup tables: their distinct numbers and summed gradients."""
        for out, back in reversed(self.steps):
            if out.grad is not None:
                back(out.grad)
        dense = {n: v.grad for n, v in self.used.items() if v.grad is not None}
        sparse: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        for name in TABLES:
            own = [(ids, v.grad) for n, ids, v in self.looked_up if n == name and v.grad is not None]
            if own:
                ids, grad = summed_by(np.concatenate([i for i, _ in own]), np.concatenate([g for _, g in own]))
                fine = ids > 0 if name == "words" else np.ones(len(ids), bool)
                sparse[name] = ids[fine], grad[fine]
        return dense, sparse


def both_ways(t: Tape, x: Var, first: np.ndarray, name: str) -> Var:
    return t.concat([t.lstm(x, first, f"{name}.ahead", False), t.lstm(x, first, f"{name}.back", True)])


def text_vectors(t: Tape, s: Settings, words: Lists) -> Var:
    """One vector for each word list. Lists that are alike are encoded once, with one mask of dropout."""
    words, at = distinct(words)
    x = t.dropout(t.rows("words", words.ids), s.dropout)
    if s.word_function == "lstm":
        return t.dropout(t.take(t.gathered(both_ways(t, x, words.first, "text"), words.first, True), at), s.dropout)
    return t.take(t.gathered(x, words.first, s.word_function == "mean"), at)


def node_vectors(t: Tape, s: Settings, n: Nodes) -> Var:
    parts = [t.rows("tags", n.tag)]
    if s.attrs:
        parts.append(t.dropout(t.gathered(t.dropout(t.rows("words", n.attrs.ids), s.dropout), n.attrs.first, True), s.dropout))
    if s.dense:
        parts.append(Var(n.dense))
    if s.word_function != "none":
        text = text_vectors(t, s, n.words)
        parts.append(t.reshape(text, text.value.shape[1] * s.lists))
    return t.concat(parts)


def path_vectors(t: Tape, s: Settings, path: Lists, attrs: Lists) -> Var:
    x = t.dropout(t.rows("path_tags", path.ids), s.dropout)
    if s.path_attrs:
        x = t.concat([x, t.gathered(t.dropout(t.rows("words", attrs.ids), s.dropout), attrs.first, True)])
    return t.dropout(t.gathered(both_ways(t, x, path.first, "path"), path.first, True), s.dropout)


def logits(t: Tape, s: Settings, b: Batch) -> Var:
    every = node_vectors(t, s, b.nodes)
    own = np.arange(b.count)
    parts = [t.take(every, own)]
    if s.neighbors:
        around = t.take(every, np.arange(b.count, len(every.value)))
        mine = t.take(every, np.repeat(own, np.diff(b.first)))
        score = t.linear(t.concat([mine, around, Var(b.edge)]), "attention")
        parts.append(t.dropout(t.weighted(t.normalized(score, b.first, s.normalize), around, b.first), s.dropout))
    if s.path_dim:
        parts.append(path_vectors(t, s, b.path, b.path_attrs))
    x = t.concat(parts)
    for k in range(len(s.hidden)):
        x = t.linear(x, f"head{k}")
        if s.layer_norm:
            x = t.layer_norm(x, f"head{k}")
        x = t.dropout(t.relu(x), s.head_dropout)
    return t.linear(x, f"head{len(s.hidden)}")
