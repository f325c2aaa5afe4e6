"""CSS selectors on DOM node rows of one page, and labels by selector."""
from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .html import flatten, parse

_TOKEN = re.compile(r"""\s*([>+~,])\s*|(\s+)|(\*|[A-Za-z_][\w-]*)|#([\w-]+)|\.([\w-]+)|\[\s*([\w-]+)\s*(?:([~|^$*]?=)\s*(?:"([^"]*)"|'([^']*)'|([^\]\s]+))\s*)?\]|:([\w-]+)(\()?""")


class SelectorError(ValueError):
    pass


@lru_cache(1024)
def compile_selector(text: str) -> list[list[tuple[str, list[tuple]]]]:
    """Alternatives, each a list of (combinator, tests); the first combinator is '' ."""
    alternatives: list[list[tuple[str, list[tuple]]]] = [[("", [])]]
    at, text = 0, text.strip()
    if not text:
        raise SelectorError("empty selector")
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m or m.end() == at:
            raise SelectorError(f"not understood: {text[at:]!r}")
        at = m.end()
        joint, space, tag, id_, klass, attr, op, v1, v2, v3, pseudo, bracket = m.groups()
        tests = alternatives[-1][-1][1]
        if joint == ",":
            alternatives.append([("", [])])
        elif joint or space:
            if not tests and not (joint and alternatives[-1] == [("", [])]):
                raise SelectorError(f"misplaced combinator in {text!r}")
            alternatives[-1].append((joint or " ", []))
        elif tag:
            tests.append(("tag", tag.lower()))
        elif id_:
            tests.append(("attr", "id", "=", id_))
        elif klass:
            tests.append(("attr", "class", "~=", klass))
        elif attr:
            tests.append(("attr", attr.lower(), op, next((v for v in (v1, v2, v3) if v is not None), None)))
        elif bracket:
            depth, end = 1, at
            while end < len(text) and depth:
                depth += {"(": 1, ")": -1}.get(text[end], 0)
                end += 1
            if depth:
                raise SelectorError(f"open bracket in {text!r}")
            inner, at = text[at : end - 1], end
            if pseudo in ("has", "not", "is", "where"):
                tests.append((pseudo, compile_selector(inner)))
            elif pseudo in ("nth-child", "nth-of-type"):
                tests.append((pseudo, inner.strip()))
            else:
                raise SelectorError(f"unknown :{pseudo}()")
        elif pseudo in ("first-child", "last-child", "only-child", "empty", "root"):
            tests.append((pseudo,))
        else:
            raise SelectorError(f"unknown :{pseudo}")
    if any(not tests for alt in alternatives for _, tests in alt[1:]) or any(not alt[-1][1] for alt in alternatives):
        raise SelectorError(f"incomplete: {text!r}")
    return alternatives


class Page:
    """Rows of one page by node id."""

    def __init__(self, rows: list[dict]):
        self.rows = {r["node_id"]: r for r in rows}
        self.children: dict[int | None, list[int]] = {}
        for r in rows:
            if r["tag"] != "-text":
                self.children.setdefault(None if pd.isna(r["parent_id"]) else int(r["parent_id"]), []).append(r["node_id"])
        self.all_children: set[int] = {int(r["parent_id"]) for r in rows if not pd.isna(r["parent_id"])}

    def parent(self, n: int) -> int | None:
        p = self.rows[n]["parent_id"]
        return None if pd.isna(p) else int(p)

    def test(self, n: int, t: tuple) -> bool:
        row, kind = self.rows[n], t[0]
        siblings = self.children.get(self.parent(n), [n])
        if kind == "tag":
            return t[1] in ("*", row["tag"])
        if kind == "attr":
            own = dict(row["attrs"]).get(t[1])
            if own is None or t[2] is None:
                return own is not None
            want = t[3]
            return {"=": own == want, "~=": want in own.split(), "|=": own == want or own.startswith(want + "-"), "^=": bool(want) and own.startswith(want), "$=": bool(want) and own.endswith(want), "*=": bool(want) and want in own}[t[2]]
        if kind in ("not", "is", "where"):
            return any(self.matches(n, a) for a in t[1]) != (kind == "not")
        if kind == "has":
            return any(self._relative(n, a) for a in t[1])
        if kind in ("nth-child", "nth-of-type"):
            row_tag = row["tag"]
            same = siblings if kind == "nth-child" else [s for s in siblings if self.rows[s]["tag"] == row_tag]
            return _nth(t[1], same.index(n) + 1)
        return {"first-child": siblings[0] == n, "last-child": siblings[-1] == n, "only-child": len(siblings) == 1, "empty": n not in self.all_children, "root": self.parent(n) is None}[kind]

    def _relative(self, n: int, alt: list[tuple[str, list[tuple]]]) -> bool:
        joint = alt[1][0] if not alt[0][1] and len(alt) > 1 else " "
        rest = alt[1:] if not alt[0][1] and len(alt) > 1 else alt
        rest = [("", rest[0][1]), *rest[1:]]
        end = self.rows[n]["end_id"]
        for m in self.rows:
            if self.rows[m]["tag"] == "-text" or not self.matches(m, rest):
                continue
            if joint == " " and n < m <= end or joint == ">" and self.parent(m) == n or joint in "+~" and m in self.next_siblings(n, joint):
                return True
        return False

    def next_siblings(self, n: int, joint: str) -> list[int]:
        siblings = self.children.get(self.parent(n), [n])
        after = siblings[siblings.index(n) + 1 :]
        return after[:1] if joint == "+" else after

    def matches(self, n: int, alt: list[tuple[str, list[tuple]]]) -> bool:
        joint, tests = alt[-1]
        if not all(self.test(n, t) for t in tests):
            return False
        if len(alt) == 1:
            return True
        before = alt[:-1]
        if joint == ">":
            p = self.parent(n)
            return p is not None and self.matches(p, before)
        if joint == " ":
            p = self.parent(n)
            while p is not None:
                if self.matches(p, before):
                    return True
                p = self.parent(p)
            return False
        siblings = self.children.get(self.parent(n), [n])
        earlier = siblings[: siblings.index(n)]
        return any(self.matches(s, before) for s in (earlier[-1:] if joint == "+" else earlier))

    def select(self, selector: str) -> list[int]:
        compiled = compile_selector(selector)
        return [n for n, r in sorted(self.rows.items()) if r["tag"] != "-text" and any(self.matches(n, a) for a in compiled)]


def _nth(formula: str, k: int) -> bool:
    formula = {"odd": "2n+1", "even": "2n"}.get(formula, formula.replace(" ", ""))
    m = re.fullmatch(r"([+-]?\d*)n([+-]\d+)?|([+-]?\d+)", formula)
    if not m:
        raise SelectorError(f"unknown position {formula!r}")
    if m[3]:
        return k == int(m[3])
    a = int(m[1] + "1") if m[1] in ("", "+", "-") else int(m[1])
    b = int(m[2] or 0)
    return k == b if a == 0 else (k - b) % a == 0 and (k - b) // a >= 0


def patched(selector: str) -> str:
    """Adjacent siblings are sought among all later ones, as label selectors of the corpus need it."""
    return re.sub(r"\s*\+\s*", " ~ ", selector)


SCHEMA = "page_id bigint, label_key string, node_id bigint, error string"


def matched(page: Page, label_key: str, selector: str, patch: bool) -> list[tuple[str, int | None, str | None]]:
    """label_key, node_id, error of one selector. Of several matches empty ones are left out."""
    try:
        found = page.select(patched(selector) if patch else selector)
        if len(found) > 1:
            found = [n for n in found if n in page.all_children]
        return [(label_key, n, None) for n in found] or [(label_key, None, "no match")]
    except SelectorError as e:
        return [(label_key, None, str(e))]


def select(nodes: DataFrame, selectors: DataFrame, patch: bool = True) -> DataFrame:
    """page_id, label_key, node_id, error of nodes and selectors(page_id, label_key, selector).

    An unreadable selector gives one row with its error and no node. Of several matches empty ones are left out.
    """

    def run(key: tuple, rows: pd.DataFrame, wanted: pd.DataFrame) -> Iterator[pd.DataFrame] | pd.DataFrame:
        page = Page(rows.to_dict("records"))
        out = [(key[0], *x) for w in wanted.itertuples() for x in matched(page, w.label_key, w.selector, patch)]
        return pd.DataFrame(out, columns=["page_id", "label_key", "node_id", "error"]).astype({"node_id": "Int64"})

    return nodes.select("page_id", "node_id", "end_id", "parent_id", "tag", "attrs").groupBy("page_id").cogroup(selectors.groupBy("page_id")).applyInPandas(run, SCHEMA)


def select_pages(pages: DataFrame, selectors: Column, patch: bool = True) -> DataFrame:
    """As select(), matched while pages(page_id, html) are parsed, without a shuffle of nodes.

    selectors: an array of structs (label_key, selector) for each page.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for page_id, html, wanted in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                page = Page(flatten(parse(html or "")))
                out += [(page_id, *x) for w in wanted or () for x in matched(page, w["label_key"], w["selector"], patch)]
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], kind) for k, kind in enumerate(kinds)], names=["page_id", "label_key", "node_id", "error"])

    return pages.select(F.col("page_id").cast("bigint"), "html", selectors.alias("wanted")).mapInArrow(run, SCHEMA)
