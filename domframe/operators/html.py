"""HTML pages to a table of DOM nodes: one row for each node, in preorder with interval ends.

Trees are built per page in Arrow batches, by the rules of HTML that pages need: implied html, head and body, void and
raw-text elements, implied end tags, reconstruction of formatting elements left open, and the modes of tables, where what
may not stand between cells goes before the table.
"""
from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HEAD_ONLY = frozenset("base link meta title style script noscript template".split())
FORMATTING = frozenset("a b big code em font i nobr s small strike strong tt u".split())
CLOSES_P = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section summary table ul".split()
)
SCOPE = frozenset("html table td th caption template marquee object applet button".split())
SIBLINGS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "option": ("option",)}
#: Elements across which no list item is closed: the standard's special ones but address, div and p (fixed values).
SPECIAL = frozenset(
    "applet area article aside base basefont bgsound blockquote body br button caption center col colgroup dd details dir dl dt embed fieldset figcaption figure footer form frame frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html iframe img input keygen li link listing main marquee menu meta nav noembed noframes noscript object ol param plaintext pre script search section select source style summary table tbody td template textarea tfoot th thead title tr track ul wbr xmp".split()
)
BOUNDS = {"li": SPECIAL, "dt": SPECIAL, "dd": SPECIAL, "option": ("select",)}
SECTIONS, CELLS = ("tbody", "thead", "tfoot"), ("td", "th")
#: Elements that stand in tables only, and those that hold no text themselves.
TABLE_PARTS = frozenset(("caption", "col", "colgroup", "tr", *SECTIONS, *CELLS))
TABLE_LIKE = frozenset(("table", "tr", *SECTIONS))
#: The mode that the nearest of these open elements sets, and for each mode where its parts are put.
MODES = {"select": "select", "td": "cell", "th": "cell", "tr": "row", "tbody": "section", "thead": "section", "tfoot": "section", "caption": "caption", "colgroup": "columns", "table": "table", "body": "body", "html": "body"}
CONTEXTS = {"table": frozenset(("table", "template", "html")), "section": frozenset((*SECTIONS, "template", "html")), "row": frozenset(("tr", "template", "html"))}
#: What a first part inside a template makes of it.
TEMPLATE_MODES = {"td": "row", "th": "row", "tr": "section", "tbody": "table", "thead": "table", "tfoot": "table", "caption": "table", "colgroup": "table", "col": "columns"}
#: Elements that are removed with all that they hold.
STRIPPED = frozenset(("script", "style", "head", "noscript", "iframe", "svg"))
TEXT = "-text"
#: Pages whose nodes leave the parser at once.
PAGES = 16
SCHEMA = (
    "page_id bigint, node_id int, end_id int, parent_id int, depth int, sib_pos int, tag string, same_tag_index int, text string, "
    "attrs map<string,string>, index_path array<int>, anc_ids array<int>, anc_tags array<string>, xpath string, is_text boolean, is_leaf boolean"
)
_BLANK = {0x0B, 0x85, 0xA0, 0x1680, 0x2028, 0x2029, 0x202F, 0x205F, 0x3000, *range(0x1C, 0x20), *range(0x2000, 0x200C)}


def blank(text: str) -> bool:
    return all(c in " \t\n\r\f" or ord(c) in _BLANK for c in text)


class Node:
    __slots__ = ("attrs", "children", "parent", "tag", "text")

    def __init__(self, tag: str, attrs: dict[str, str], parent: Node | None, text: str = ""):
        self.tag, self.attrs, self.parent, self.text, self.children = tag, attrs, parent, text, []


class TreeBuilder(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = Node("html", {}, None)
        self.head: Node | None = None
        self.body: Node | None = None
        self.open: list[Node] = [self.root]
        self.formatting: list[Node | None] = []  # None: a cell, caption or template began here
        self.templates: dict[Node, str] = {}
        self.foster = False

    def _place(self) -> tuple[Node, int]:
        """Where the next node goes: into the open element, or before the table where that may not hold it."""
        here = self.open[-1]
        return self._before_table() if self.foster and here.tag in TABLE_LIKE else (here, len(here.children))

    def _before_table(self) -> tuple[Node, int]:
        for node in reversed(self.open):
            if node.tag == "template":
                return node, len(node.children)
            if node.tag == "table":
                return node.parent, node.parent.children.index(node)
        return self.root, len(self.root.children)

    def _add(self, tag: str, attrs: dict[str, str]) -> Node:
        parent, at = self._place()
        node = Node(tag, attrs, parent)
        parent.children.insert(at, node)
        return node

    def _mode(self) -> str:
        for node in reversed(self.open):
            if node.tag == "template":
                return self.templates.get(node, "template")
            if node.tag in MODES:
                return MODES[node.tag]
        return "body"

    def _clear_to(self, mode: str) -> None:
        while self.open[-1].tag not in CONTEXTS[mode]:
            self.open.pop()

    def _in_table(self, *tags: str) -> bool:
        for node in reversed(self.open):
            if node.tag in tags:
                return True
            if node.tag in ("html", "table", "template"):
                return False
        return False

    def _pop_to(self, *tags: str) -> None:
        while self.open.pop().tag not in tags:
            pass

    def _forget_formatting(self) -> None:
        while self.formatting and self.formatting.pop() is not None:
            pass

    def _since_marker(self) -> list[Node]:
        """Active formatting elements since the last cell, caption or template."""
        at = len(self.formatting)
        while at and self.formatting[at - 1] is not None:
            at -= 1
        return self.formatting[at:]

    def _leave(self, mode: str) -> bool:
        """Closes the part of a table that sets the mode; false where there is none."""
        if mode == "cell" or mode == "caption":
            if not self._in_table(*(CELLS if mode == "cell" else ("caption",))):
                return False
            self._pop_to(*(CELLS if mode == "cell" else ("caption",)))
            self._forget_formatting()
        elif mode == "columns":
            if self.open[-1].tag != "colgroup":
                return False
            self.open.pop()
        elif mode == "row" or mode == "section":
            if not self._in_table(*(("tr",) if mode == "row" else SECTIONS)):
                return False
            self._clear_to(mode)
            self.open.pop()
        return True

    def _table_part(self, tag: str, attrs: dict[str, str]) -> None:
        """A start tag of TABLE_PARTS: what stands open is closed, and what is left out is put in, until it has its place."""
        while True:
            mode = self._mode()
            if mode == "template":
                self.templates[next(n for n in reversed(self.open) if n.tag == "template")] = mode = TEMPLATE_MODES[tag]
            if mode in ("cell", "caption") or mode == "columns" and tag != "col" or mode == "row" and tag not in CELLS or mode == "section" and tag not in ("tr", *CELLS):
                if not self._leave(mode):
                    return
                continue
            if mode == "body":
                return  # no table is open
            if mode != "columns":
                self._clear_to(mode)
            if mode == "table" and (tag == "tr" or tag in CELLS):
                self.open.append(self._add("tbody", {}))
            elif mode == "table" and tag == "col":
                self.open.append(self._add("colgroup", {}))
            elif mode == "section" and tag in CELLS:
                self.open.append(self._add("tr", {}))
            else:
                node = self._add(tag, attrs)
                if tag != "col":
                    self.open.append(node)
                if tag in CELLS or tag == "caption":
                    self.formatting.append(None)
                return

    def _table_end(self, tag: str) -> None:
        while True:
            mode = self._mode()
            own = {"cell": CELLS, "row": ("tr",), "section": SECTIONS, "caption": ("caption",), "columns": ("colgroup",), "table": ("table",)}.get(mode, ())
            if tag in own:
                if mode == "table":
                    self._pop_to("table")
                elif mode == "cell":
                    if self._in_table(tag):
                        self._pop_to(tag)
                        self._forget_formatting()
                elif mode != "section" or self._in_table(tag):
                    self._leave(mode)
                return
            outer = {"cell": ("table", "tr", *SECTIONS), "row": ("table", *SECTIONS), "section": ("table",), "caption": ("table",), "columns": ("table", "tr", *SECTIONS, *CELLS, "caption")}.get(mode, ())
            if tag not in outer or tag not in ("table",) and not self._in_table(tag) or not self._leave(mode):
                return

    def _select_start(self, tag: str, attrs: dict[str, str]) -> bool:
        """A start tag inside select; false if it closes the select and is to be seen again."""
        if tag in ("option", "optgroup", "hr"):
            if self.open[-1].tag == "option":
                self.open.pop()
            if tag != "option" and self.open[-1].tag == "optgroup":
                self.open.pop()
            node = self._add(tag, attrs)
            if tag != "hr":
                self.open.append(node)
        elif tag in ("script", "template"):
            self._open(tag, attrs)
        elif tag == "select":
            self._pop_to("select")
        elif tag in ("input", "keygen", "textarea") or (tag in TABLE_PARTS or tag == "table") and any(n.tag == "table" for n in self.open):
            self._pop_to("select")
            return False
        return True

    def _open(self, tag: str, attrs: dict[str, str]) -> None:
        self.open.append(self._add(tag, attrs))
        if tag == "template":
            self.formatting.append(None)

    def _in_body(self) -> None:
        if self.body is None:
            if self.head is None:
                self.head = self._add_to(self.root, "head")
            self.body = self._add_to(self.root, "body")
            self.open = [self.root, self.body]

    def _add_to(self, parent: Node, tag: str, attrs: dict[str, str] | None = None) -> Node:
        node = Node(tag, attrs or {}, parent)
        parent.children.append(node)
        return node

    def _reopen(self) -> None:
        """Opens again the formatting elements that were closed by others than their own end tags."""
        last = len(self.formatting)
        while last and self.formatting[last - 1] is not None and self.formatting[last - 1] not in self.open:
            last -= 1
        for i in range(last, len(self.formatting)):
            old = self.formatting[i]
            node = self._add(old.tag, dict(old.attrs))
            self.open.append(node)
            self.formatting[i] = node

    def _close(self, names: tuple[str, ...], bounds: frozenset[str] | tuple[str, ...]) -> bool:
        for i in range(len(self.open) - 1, 1, -1):
            if self.open[i].tag in names:
                del self.open[i:]
                return True
            if self.open[i].tag in bounds:
                return False
        return False

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        own = {}
        for k, v in attrs:
            own.setdefault(k, v or "")
        if tag == "html":
            self.root.attrs = own | self.root.attrs
            return
        if tag == "head":
            if self.head is None:
                self.head = self._add_to(self.root, "head", own)
                self.open = [self.root, self.head]
            return
        if tag == "body":
            if self.body is None:
                self._in_body()
            self.body.attrs = own | self.body.attrs
            return
        if self.body is None and tag in HEAD_ONLY:
            if self.head is None:
                self.head = self._add_to(self.root, "head")
            if self.head not in self.open:
                self.open = [self.root, self.head]
            node = self._add(tag, own)
            if tag not in VOID:
                self.open.append(node)
            return
        self._in_body()
        mode = self._mode()
        if mode == "select":
            if self._select_start(tag, own):
                return
            mode = self._mode()
        if tag in TABLE_PARTS:
            self._table_part(tag, own)
            return
        if mode == "columns" and tag != "template":
            if not self._leave(mode):
                return
            mode = self._mode()
        if mode == "template":
            self.templates[next(n for n in reversed(self.open) if n.tag == "template")] = "body"
        if mode in ("table", "section", "row"):
            if tag in ("style", "script", "template"):
                self._open(tag, own)
                return
            if tag == "table":
                if not self._in_table("table"):
                    return
                self._pop_to("table")
            elif tag == "form" or tag == "input" and own.get("type", "").lower() == "hidden":
                if tag == "input" or not any(n.tag == "form" for n in self.open):
                    self._add(tag, own)
                return
            else:
                self.foster = True
        self._start_in_body(tag, own)
        self.foster = False

    def _start_in_body(self, tag: str, own: dict[str, str]) -> None:
        if tag == "template":
            self._open(tag, own)
            return
        if tag in CLOSES_P:
            self._close(("p",), SCOPE)
        if tag in SIBLINGS:
            self._close(SIBLINGS[tag], BOUNDS[tag])
        if tag in ("h1", "h2", "h3", "h4", "h5", "h6") and self.open[-1].tag in ("h1", "h2", "h3", "h4", "h5", "h6"):
            self.open.pop()
        if tag == "a" and (old := next((n for n in reversed(self._since_marker()) if n.tag == "a"), None)):
            self._end_formatting("a")
            for held in (self.formatting, self.open):
                if old in held:
                    held.remove(old)
        if tag in FORMATTING or tag not in CLOSES_P and tag not in SIBLINGS and tag not in HEAD_ONLY:
            self._reopen()
        node = self._add(tag, own)
        if tag in VOID:
            return
        self.open.append(node)
        if tag in FORMATTING:
            same = [n for n in self._since_marker() if n.tag == tag and n.attrs == own]
            if len(same) >= 3:
                self.formatting.remove(same[0])
            self.formatting.append(node)

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag: str) -> None:
        if tag in ("html", "body"):
            return
        if tag == "head":
            if self.head is not None and self.body is None:
                self.open = [self.root]
            return
        if tag == "br":
            self.handle_starttag("br", [])
            return
        if self.body is None:
            self._close_plain(tag)
            return
        mode = self._mode()
        if mode == "select":
            if tag == "optgroup" and [n.tag for n in self.open[-2:]] == ["optgroup", "option"]:
                self.open.pop()
            if tag in ("option", "optgroup") and self.open[-1].tag == tag:
                self.open.pop()
            if tag == "select" or tag in ("table", "tr", *SECTIONS, *CELLS, "caption") and self._select_in_table(tag):
                self._pop_to("select")
            if tag not in ("table", "tr", *SECTIONS, *CELLS, "caption") or self._mode() == "select":
                return
        if tag == "template":
            if any(n.tag == "template" for n in self.open):
                self._pop_to("template")
                self._forget_formatting()
            return
        if tag == "table" or tag in TABLE_PARTS:
            self._table_end(tag)
            return
        self.foster = mode in ("table", "section", "row")
        if tag == "p" and not any(n.tag == "p" for n in self.open):
            self.open.append(self._add("p", {}))
        if tag in FORMATTING:
            self._end_formatting(tag)
        else:
            self._close_plain(tag)
        self.foster = False

    def _select_in_table(self, tag: str) -> bool:
        """Whether an end tag of a table, met inside select, is that of an element around the select."""
        above = self.open[: max(k for k, n in enumerate(self.open) if n.tag == "select")]
        for node in reversed(above):
            if node.tag == tag:
                return True
            if node.tag in ("html", "table", "template"):
                return False
        return False

    def _close_plain(self, tag: str) -> None:
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i].tag == tag:
                del self.open[max(i, 1) :]
                return
            if self.open[i].tag in ("table", "td", "th", "body") and tag not in ("table", "tr", "tbody", "thead", "tfoot", "td", "th"):
                return

    def _end_formatting(self, tag: str) -> None:
        """The adoption agency: an element closed while blocks are open inside it is cut around the blocks."""
        for _ in range(8):
            element = next((n for n in reversed(self._since_marker()) if n.tag == tag), None)
            if element is None:
                self._close_plain(tag)
                return
            if element not in self.open:
                self.formatting.remove(element)
                return
            at = self.open.index(element)
            if any(n.tag in SCOPE and n.tag != "button" for n in self.open[at + 1 :]):
                return
            block = next((i for i in range(at + 1, len(self.open)) if self.open[i].tag not in FORMATTING and self.open[i].tag not in ("span",)), None)
            if block is None:
                del self.open[at:]
                self.formatting.remove(element)
                return
            furthest, parent = self.open[block], self.open[at - 1]
            furthest.parent.children.remove(furthest)
            furthest.parent, place = (parent, len(parent.children)) if parent.tag not in TABLE_LIKE else self._before_table()
            furthest.parent.children.insert(place, furthest)
            copy = Node(element.tag, dict(element.attrs), furthest)
            copy.children, furthest.children = furthest.children, [copy]
            for c in copy.children:
                c.parent = copy
            place = self.formatting.index(element)
            self.formatting[place] = copy
            self.open = [*self.open[:at], furthest, copy, *self.open[block + 1 :]]

    def handle_data(self, data: str) -> None:
        here = self.open[-1].tag
        if self.body is None:
            if here in HEAD_ONLY or not data.strip(" \t\n\r\f"):
                if here in HEAD_ONLY:
                    self._text(data)
                return
            self._in_body()
        mode, inked = self._mode(), data.strip(" \t\n\r\f")
        if mode == "columns" and inked:
            head = data[: len(data) - len(data.lstrip(" \t\n\r\f"))]
            if head:
                self._text(head)
                data = data[len(head) :]
            if not self._leave(mode):
                return
            mode = self._mode()
        if inked:
            self.foster = mode in ("table", "section", "row")
            if mode not in ("select", "columns"):
                self._reopen()
        self._text(data)
        self.foster = False

    def _text(self, data: str) -> None:
        parent, at = self._place()
        if at and parent.children[at - 1].tag == TEXT:
            parent.children[at - 1].text += data
        else:
            parent.children.insert(at, Node(TEXT, {}, parent, data))

    def handle_comment(self, data: str) -> None:
        pass


def parse(html: str) -> Node:
    builder = TreeBuilder()
    builder.feed(html)
    builder.close()
    builder._in_body()
    return builder.root


def flatten(root: Node, stripped: frozenset[str] = STRIPPED, keep_blank: bool = False) -> list[dict]:
    """Rows of all nodes in preorder, without stripped elements and (unless wanted) blank text fragments."""
    out: list[dict] = []

    def elements(node: Node) -> list[Node]:
        return [c for c in node.children if c.tag not in stripped and (keep_blank or c.tag != TEXT or not blank(c.text))]

    stack: list[tuple[Node, dict | None, int, int | None]] = [(root, None, 0, None)]
    while stack:
        node, above, at, same = stack.pop()
        children = elements(node)
        is_text = node.tag == TEXT
        step = "/text()" if is_text else "/" + node.tag
        row = {
            "node_id": len(out), "end_id": len(out), "parent_id": above["node_id"] if above else None, "depth": above["depth"] + 1 if above else 0, "sib_pos": at, "tag": node.tag, "same_tag_index": same, "text": node.text if is_text else None, "attrs": node.attrs,
            "index_path": [*above["index_path"], at] if above else [], "anc_ids": [*above["anc_ids"], above["node_id"]] if above else [], "anc_tags": [*above["anc_tags"], above["tag"]] if above else [],
            "xpath": (above["xpath"] if above else "") + step + (f"[{same + 1}]" if same is not None else ""), "is_text": is_text, "is_leaf": not children,
        }
        out.append(row)
        total: dict[str, int] = {}
        for c in children:
            total[c.tag] = total.get(c.tag, 0) + 1
        seen: dict[str, int] = {}
        nexts = []
        for i, c in enumerate(children):
            k = seen.get(c.tag, 0)
            seen[c.tag] = k + 1
            nexts.append((c, row, i, k if total[c.tag] > 1 else None))
        stack.extend(reversed(nexts))
    for row in reversed(out):
        if row["parent_id"] is not None:
            parent = out[row["parent_id"]]
            parent["end_id"] = max(parent["end_id"], row["end_id"])
    return out


def columns_of(roots: list[Node], stripped: frozenset[str] = STRIPPED, keep_blank: bool = False) -> tuple[dict[str, list], list[int]]:
    """Columns of the nodes of several pages one after the other, as in SCHEMA, and the number of nodes of each page."""
    end, parent, depth, place, tags, same, texts, attrs, paths, ancs, names, xpaths, is_leaf, node = ([] for _ in range(14))
    sizes = []
    for root in roots:
        base = len(tags)
        stack = [(root, -1, 0, None)]
        while stack:
            n, up, at, k = stack.pop()
            me = len(tags)
            is_text = n.tag == TEXT
            children = [c for c in n.children if c.tag not in stripped and (keep_blank or c.tag != TEXT or not blank(c.text))]
            step = ("/text()" if is_text else "/" + n.tag) + (f"[{k + 1}]" if k is not None else "")
            node.append(me - base)
            end.append(me - base)
            place.append(at)
            tags.append(n.tag)
            same.append(k)
            texts.append(n.text if is_text else None)
            attrs.append(n.attrs)
            is_leaf.append(not children)
            if up < 0:
                parent.append(None)
                depth.append(0)
                paths.append([])
                ancs.append([])
                names.append([])
                xpaths.append(step)
            else:
                parent.append(up - base)
                depth.append(depth[up] + 1)
                paths.append([*paths[up], at])
                ancs.append([*ancs[up], up - base])
                names.append([*names[up], tags[up]])
                xpaths.append(xpaths[up] + step)
            if children:
                total: dict[str, int] = {}
                for c in children:
                    total[c.tag] = total.get(c.tag, 0) + 1
                seen: dict[str, int] = {}
                below = []
                for i, c in enumerate(children):
                    if total[c.tag] > 1:
                        j = seen[c.tag] = seen.get(c.tag, -1) + 1
                    else:
                        j = None
                    below.append((c, me, i, j))
                below.reverse()
                stack += below
        for me in range(len(tags) - 1, base, -1):
            up = parent[me] + base
            if end[me] > end[up]:
                end[up] = end[me]
        sizes.append(len(tags) - base)
    return {
        "node_id": node, "end_id": end, "parent_id": parent, "depth": depth, "sib_pos": place, "tag": tags, "same_tag_index": same, "text": texts, "attrs": attrs,
        "index_path": paths, "anc_ids": ancs, "anc_tags": names, "xpath": xpaths, "is_text": [t == TEXT for t in tags], "is_leaf": is_leaf,
    }, sizes


_ARROW = {"int": pa.int32(), "bigint": pa.int64(), "string": pa.string(), "boolean": pa.bool_(), "array<int>": pa.list_(pa.int32()), "array<string>": pa.list_(pa.string()), "map<string,string>": pa.map_(pa.string(), pa.string())}
_KINDS = dict(c.strip().split(" ") for c in SCHEMA.split(", "))


def _array(name: str, values: list) -> pa.Array:
    kind = _KINDS[name]
    if kind.startswith("array") or kind.startswith("map"):
        offsets = pa.array([0, *accumulate(map(len, values))], pa.int32())
        if kind.startswith("map"):
            return pa.MapArray.from_arrays(offsets, pa.array([k for v in values for k in v], pa.string()), pa.array([x for v in values for x in v.values()], pa.string()))
        return pa.ListArray.from_arrays(offsets, pa.array([x for v in values for x in v], _ARROW[kind].value_type))
    return pa.array(values, _ARROW[kind])


def dom_nodes(pages: DataFrame, stripped: frozenset[str] = STRIPPED, keep_blank: bool = False, key: str = "page_id") -> DataFrame:
    """Nodes of pages(key, html); a null html is an empty page (html and body). A batch of nodes is of several pages.

    page_id is a bigint; another key keeps its type.
    """
    kind = "bigint" if key == "page_id" else dict(pages.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, htmls = batch.columns
            for lo in range(0, len(batch), PAGES):
                part = ids.slice(lo, PAGES)
                held, sizes = columns_of([parse(h or "") for h in htmls.slice(lo, PAGES).to_pylist()], stripped, keep_blank)
                which = pa.array([i for i, n in enumerate(sizes) for _ in range(n)], pa.int32())
                yield pa.RecordBatch.from_arrays([part.take(which), *[_array(c, v) for c, v in held.items()]], names=[key, *held])

    return pages.select(F.col(key).cast(kind), "html").mapInArrow(run, SCHEMA.replace("page_id bigint", f"{key} {kind}"))
