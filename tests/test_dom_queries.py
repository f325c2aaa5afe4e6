"""DOM queries on the test pages against a second, plain tree builder made for the few constructs of these pages."""
import html
import json
import re

import duckdb
import pytest

from domframe.plans.catalogue import QUERIES

SF = "/root/testdata/sf0.001"
SPACE = " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0     　" + "".join(map(chr, range(0x2000, 0x200C)))
VOID = {"br"}


class Node:
    def __init__(self, tag, up, attrs=None, text=None):
        self.tag, self.up, self.attrs, self.text, self.below = tag, up, attrs or {}, text, []
        if up:
            up.below.append(self)


def built(page):
    """Tree of a page: paragraphs close each other, bold type goes on until it is closed, at most three times."""
    page = re.sub(r"(?s)<!--.*?-->|<!DOCTYPE[^>]*>|<head>.*?</head>", "", page)
    root, bold = Node("html", None), []
    open_ = [root]

    def reopen():
        for i, b in enumerate(bold):
            if b not in open_:
                bold[i] = Node("b", open_[-1])
                open_.append(bold[i])

    for part in re.findall(r"<[^>]*>|[^<]+", page):
        m = re.fullmatch(r"<(/?)(\w+)([^>]*)>", part)
        if not m:
            if part.strip(SPACE):
                reopen()
                Node("-text", open_[-1], text=html.unescape(part))
            continue
        end, tag, attrs = m[1], m[2], dict(re.findall(r'(\w+)="([^"]*)"', m[3]))
        if tag == "html":
            root.attrs = root.attrs or attrs
        elif end:
            assert tag not in ("b",), "not made for this"
            if tag != "body" and any(n.tag == tag for n in open_):
                while open_.pop().tag != tag:
                    pass
        else:
            if tag in ("p", "article", "footer", "div", "ul", "nav", "h1") and any(n.tag == "p" for n in open_):
                while open_.pop().tag != "p":
                    pass
            if tag in ("b", "br", "a"):
                reopen()
            node = Node(tag, open_[-1], attrs)
            if tag not in VOID:
                open_.append(node)
            if tag == "b":
                bold[:] = [*bold, node][-3:]
    return root


def flat(root):
    """Rows in preorder: (xpath, node, ancestors)."""
    out = []

    def walk(node, path, above):
        out.append((path, node, above))
        for c in node.below:
            same = [x for x in node.below if x.tag == c.tag]
            step = ("/text()" if c.tag == "-text" else "/" + c.tag) + (f"[{same.index(c) + 1}]" if len(same) > 1 else "")
            walk(c, path + step, [*above, node])

    walk(root, "/html", [])
    return out


@pytest.fixture(scope="module")
def pages():
    rows = duckdb.sql(f"SELECT page_id, html FROM '{SF}/pages.parquet'").fetchall()
    return {p: (h, flat(built(h))) for p, h in rows}


def normal(text):
    return re.sub(f"[{SPACE}]+", " ", text).strip(" ")


def number(rows):
    return {id(n): i for i, (_, n, _) in enumerate(rows)}


def test_nodes_and_paths(spark, pages):
    got = {(r.page_id, r.node_id): r.xpath for r in QUERIES["dom_xpath"].plan(spark, SF).collect()}
    assert got == {(p, i): x for p, (_, rows) in pages.items() for i, (x, _, _) in enumerate(rows)}
    sums = {r.page_id: (r.nodes, r.texts, r.depth, r["last"]) for r in QUERIES["dom_nodes"].plan(spark, SF).collect()}
    assert sums == {p: (len(rows), sum(n.tag == "-text" for _, n, _ in rows), max(len(a) for _, _, a in rows), len(rows) - 1) for p, (_, rows) in pages.items()}


def test_semantic(spark, pages):
    got = {(r.page_id, r.node_id): (r.shown, r["class"], r.semantic_tag) for r in QUERIES["dom_semantic"].plan(spark, SF).collect()}
    want = {}
    for p, (_, rows) in pages.items():
        for i, (_, n, _) in enumerate(rows):
            at = n.up if n.tag == "-text" else n
            while at.up and at.tag in ("span", "div") and (at is n or len(at.up.below) == 1):
                at = at.up
            want[p, i] = ("=" + normal(n.text) if n.tag == "-text" else f"<{n.tag}>", n.attrs.get("class"), at.tag)
    assert got == want


def title(page):
    return normal(html.unescape(re.search(r"(?s)<h1[^>]*>([^<]*)", page)[1]))


def test_labels_and_validation(spark, pages):
    raw = {p: normal(re.search(r"(?s)<h1[^>]*>([^<]*)", h)[1]) for p, (h, _) in pages.items()}
    want = {(p, i) for p, (_, rows) in pages.items() for i, (_, n, _) in enumerate(rows) if n.tag == "-text" and normal(n.text) == raw[p]}
    got = {(r.page_id, r.node_id) for r in QUERIES["dom_labels"].plan(spark, SF).collect()}
    assert got == want and got
    checked = {r.page_id: r for r in QUERIES["dom_validate"].plan(spark, SF).collect()}
    assert len(checked) == len(pages) and all(r.some_gold == any(p == q for q, _ in want) and r.valid == r.some_gold for p, r in checked.items())
    total = QUERIES["validation_summary"].plan(spark, SF).first()
    assert (total.invalid, total.tested) == (sum(not r.valid for r in checked.values()), len(pages))


def test_selectors(spark, pages):
    got = {(r.page_id, r.label_key, r.node_id, r.error) for r in QUERIES["css_select"].plan(spark, SF).collect()}
    want = set()
    for p, (_, rows) in pages.items():
        found = {k: [] for k in ("links", "title", "ads", "after")}
        for i, (_, n, above) in enumerate(rows):
            tags = [a.tag for a in above]
            if n.tag == "a" and "href" in n.attrs and tags[-1] == "li" and "nav" in tags[:-1]:
                found["links"].append((i, n))
            if n.tag == "h1" and "article" in tags:
                found["title"].append((i, n))
            if n.tag == "div" and "ad" in n.attrs.get("class", "").split():
                found["ads"].append((i, n))
            if n.tag == "p" and any(s.tag == "h1" for s in n.up.below[: n.up.below.index(n)]):
                found["after"].append((i, n))
        for k, held in found.items():
            held = [(i, n) for i, n in held if n.below] if len(held) > 1 else held
            want |= {(p, k, i, None) for i, _ in held} or {(p, k, None, "no match")}
        want.add((p, "bad", None, next(e for q, k, _, e in got if q == p and k == "bad")))
    assert got == want and all(e for _, k, _, e in got if k == "bad")


def test_friends(spark, pages):
    got = {(r.page_id, r.node_id): list(r.friends) for r in QUERIES["dom_friends"].plan(spark, SF).collect()}
    want = {}
    for p, (_, rows) in pages.items():
        texts = [(i, {id(a) for a in above[-5:]}) for i, (_, n, above) in enumerate(rows) if n.tag == "-text"]
        for i, up in texts:
            near = sorted((abs(i - j), j) for j, other in texts if j != i and up & other)[:10]
            if near:
                want[p, i] = sorted(j for _, j in near)
    assert got == want


def test_variable_paths(spark, pages):
    host = dict(duckdb.sql(f"SELECT page_id, regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1) FROM '{SF}/pages.parquet'").fetchall())
    texts = {}
    for p, (_, rows) in pages.items():
        for x, n, _ in rows:
            if n.tag == "-text":
                texts.setdefault((host[p], x), set()).add(n.text)
    got = {(r.website, r.xpath): r.texts for r in QUERIES["dom_variable_xpaths"].plan(spark, SF).collect()}
    assert got == {k: len(v) for k, v in texts.items() if len(v) > 5}


def test_visuals(spark, pages):
    drawn = lambda p: {"/html": {"box": [0, 0, 1000, 1000 + p]}, "/html/body": {"box": [0, 0, 1000, 900], "fontSize": str(p % 30)}, "/html/body/article": {"box": [10, 20, 800, 600], "color": "#ff0000ff", "border": "2px solid red"}, "/html/body/aside": {"box": [0, 0, 1, 1]}}
    lost = {(r.page_id, r.xpath, r.problem) for r in QUERIES["visuals_mismatches"].plan(spark, SF).collect()}
    assert lost == {(p, x, "no visuals") for p, (_, rows) in pages.items() for x, _, _ in rows if x not in drawn(p)} | {(p, "/html/body/aside", "unused") for p in pages}
    blend = {(r.page_id, r.xpath): (r.tag, json.loads(r.attrs)) for r in QUERIES["visuals_blended"].plan(spark, SF).collect()}
    for p, (_, rows) in pages.items():
        for x, n, _ in rows:
            style = {"_" + k: v for k, v in drawn(p).get(x, {}).items() if k != "box"}
            assert blend[p, x] == (n.tag, n.attrs | style)
    assert len(blend) == sum(len(rows) + 1 for _, rows in pages.values())
    styled = {(r.page_id, r.node_id): (r.tag, r.width, r.font_size, list(r.border)) for r in QUERIES["visuals_attached"].plan(spark, SF).collect()}
    for p, (_, rows) in pages.items():
        for i, (x, n, above) in enumerate(rows):
            owner = x.rsplit("/", 1)[0] if n.tag == "-text" else x
            if owner in drawn(p):
                tag, width, _, border = styled.pop((p, i))
                assert (tag, width) == (n.tag, float(drawn(p)[x]["box"][2]) if x in drawn(p) else None) and border == ([2.0] * 4 if owner.endswith("article") else [0.0] * 4)
    assert not styled
    kept = {(r.page_id, r.xpath): (r.boxed, json.loads(r.style) if r.style else {}) for r in QUERIES["visuals_selected"].plan(spark, SF).collect()}
    gold = {(r.page_id, r.node_id) for r in QUERIES["dom_labels"].plan(spark, SF).collect()}
    want = {(p, x): (x in drawn(p), {k: v for k, v in drawn(p).get(x if n.tag != "-text" else x.rsplit("/", 1)[0], {}).items() if k == "fontSize" or k == "color"}) for p, (_, rows) in pages.items() for i, (x, n, _) in enumerate(rows) if x in drawn(p) or (p, i) in gold}
    assert kept == want


def test_stream_answers_every_page(spark, pages):
    got = {int(r.request_id): json.loads(r.response) for r in QUERIES["stream_inference"].plan(spark, SF).collect()}
    assert set(got) == set(pages)
    hits = sum([x["text"] for x in r["pages"][0].get("title", [])] == [title(pages[p][0])] for p, r in got.items())
    assert hits > 0.9 * len(pages)
    for p, r in got.items():
        places = {x for x, _, _ in pages[p][1]}
        for items in r["pages"][0].values():
            assert all(i["xpath"] in places and 0 <= i["probability"] <= 1 for i in items)
            assert [i["confidence"] for i in items] == sorted((i["confidence"] for i in items), reverse=True)


def test_training_beats_chance(spark):
    rows = QUERIES["training_epochs"].plan(spark, SF).collect()
    names = {0: "none", 1: "title", 2: "link"}
    assert sum(r.label == names[r.y] for r in rows) > 0.95 * len(rows) and {r.page_id % 2 for r in rows} == {1}
