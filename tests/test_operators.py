"""Goldens and brute-force comparisons of operators."""
import json
import math
import random

import pytest
from pyspark.sql import functions as F

from domframe.functions import text as tx
from domframe.functions import urls, visual
from domframe.operators import css, evaluate, features, html, labels, model, neighbors, routing, tree, visuals
from domframe.operators import relational as rel
from domframe.streaming import inference


def one(spark, expression, **values):
    row = spark.createDataFrame([tuple(values.values())], list(values)) if values else spark.range(1)
    return row.select(expression.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("given", "basic", "bert"),
    [
        ("$20,750.00", "$ 20 , 750 . 00", "$ 20 , 750 . 00"),
        ("2.0L I4, 16 valves, 138 hp @ 6000 rpm", "2 . 0l i4 , 16 valves , 138 hp @ 6000 rpm", "2 . 0l i4 , 16 valves , 138 hp @ 6000 rpm"),
        ("$ 2000", "$ 2000", "$ 2000"),
        ("£20", "£20", "£20"),
        ("MSRP Price:", "msrp price", "msrp price :"),
        ("it's \"x\"", "it ' s x", "it ' s \" x \""),
        ("Café", "café", "cafe"),
        ("a​b", "a b", "ab"),
    ],
)
def test_tokenizers(spark, given, basic, bert):
    got = one(spark, tx.basic_tokenize(F.col("c")), c=given)
    assert " ".join(got) == basic.replace("a​b", "a b")
    assert " ".join(one(spark, tx.bert_tokenize(F.col("c")), c=given)) == bert


def test_symbols_split(spark):
    assert one(spark, tx.bert_tokenize(F.col("c"), True), c="£20 €30") == ["£", "20", "€", "30"]


def test_small_text_functions(spark):
    c = F.col("c")
    assert one(spark, tx.humanize(c), c="SnapShotControlvehicle") == "Snap shot controlvehicle"
    assert one(spark, tx.humanize(c), c="yat-market-pricing-bd") == "Yat market pricing bd"
    assert one(spark, tx.normalize_node_text(c), c=" a ​\n b ") == "a b"
    assert one(spark, tx.is_blank(c), c="​ ") is True
    assert one(spark, tx.font_family(c), c='"Open Sans", Arial') == "open sans"
    assert one(spark, tx.font_family(c), c="") == ""
    assert one(spark, tx.duration(c), c=90061) == "1d 01:01:01"
    assert one(spark, tx.xpath_tag(c), c="/div[2]") == "div"
    assert one(spark, tx.slug(c, 8), c="Él niño grande!") == "el-nino"
    assert one(spark, tx.percentage(c), c=0.9951) == "99.51%"


def test_urls(spark):
    c = F.col("c")
    assert one(spark, urls.normalize_url(c), c="HTTP://A.b:80") == "http://a.b/"
    assert one(spark, urls.normalize_url(c), c="not a url") == "not a url"
    a = urls.archive_url(F.lit("20110601000000"), c)
    assert one(spark, a, c="http://a.b/") == "https://web.archive.org/web/20110601000000id_/http://a.b/"
    stamp, original = urls.parse_archive_url(a)
    assert (one(spark, stamp, c="http://a.b/"), one(spark, original, c="http://a.b/")) == ("20110601000000", "http://a.b/")


def test_archive_redirects(spark):
    u = "https://web.archive.org/web/2011id_/http://a.b/x"
    rows = [(u, ["HTTP://A.B:80/x"], "http://a.b/x"), (u, [], None), (u, ["http://a.b/x", u], None), (u, ["http://c/"], None), ("http://a.b/x", ["http://a.b/x"], None)]
    df = spark.createDataFrame(rows, "u string, chain array<string>, want string").select("want", urls.archive_redirect(F.col("u"), F.col("chain")).alias("got"))
    assert all(r.got == r.want for r in df.collect())


def test_visual_functions(spark):
    c = F.col("c")
    assert [one(spark, x, c="#ff0000ff") for x in visual.color(c)] == [0.0, 1.0, 1.0]
    assert [one(spark, x, c="#00000000") for x in visual.color(c)] == [0.0, 0.0, 0.0]
    m = F.create_map(F.lit("border"), c)
    assert one(spark, visual.border_widths(m), c="2px solid red") == [2.0] * 4
    assert one(spark, visual.border_widths(m), c="none") == [0.0] * 4
    side = F.create_map(F.lit("borderLeft"), c)
    assert one(spark, visual.border_widths(side), c="3px solid red") == [0.0, 0.0, 0.0, 3.0]
    assert one(spark, visual.border_widths(side, strict=True), c="3px solid red") == [0.0] * 4
    assert [one(spark, visual.z_index_kind(c), c=x) for x in ("10", "auto", "-1")] == ["number", "auto", "-1"]
    box = [F.lit(float(v)) for v in (-5, 0, 5, 3)]
    assert one(spark, visual.is_positive(*box)) is True
    assert one(spark, visual.is_positive(*[F.lit(float(v)) for v in (-5, 0, 4, 9)])) is False
    p = one(spark, visual.position(*[F.lit(float(v)) for v in (10, 20, 50, 5, 100, 200)]))
    assert [round(v, 6) for v in p] == [0.1, 0.1, -0.693147, -3.688879]
    assert one(spark, visual.css_color(c), c="rgba(255, 0, 16, 0.5)") == "#ff001080"
    assert one(spark, visual.one_hot(F.lit(0), 2)) == [0.0, 0.0]


TINY = "<html><body><b>b</b><i>i</i></body></html>"


def test_tiny_page(spark):
    rows = html.dom_nodes(spark.createDataFrame([(1, TINY), (2, None)], "page_id bigint, html string")).orderBy("page_id", "node_id").collect()
    first = [r for r in rows if r.page_id == 1]
    assert [r.tag for r in first] == ["html", "body", "b", "-text", "i", "-text"]
    assert [r.xpath for r in first] == ["/html", "/html/body", "/html/body/b", "/html/body/b/text()", "/html/body/i", "/html/body/i/text()"]
    assert [r.index_path for r in first] == [[], [0], [0, 0], [0, 0, 0], [0, 1], [0, 1, 0]]
    assert [r.tag for r in rows if r.page_id == 2] == ["html", "body"]
    boxes = spark.createDataFrame([(1, 3, 0.0, 0.0, 1.0, 1.0), (1, 5, 1.0, 1.0, 2.0, 2.0)], "page_id bigint, node_id bigint, x double, y double, w double, h double")
    r = neighbors.knn_center(boxes, 1).where("node_id = 3").first()
    assert (r.neighbor_id, r.dx, r.dy, round(r.distance, 4)) == (5, 1.5, 1.5, 2.1213)
    texts = spark.createDataFrame([(1, x.node_id, x.anc_ids) for x in first if x.is_text], "page_id bigint, node_id bigint, anc_ids array<bigint>")
    assert {(x.node_id, x.friend_id) for x in neighbors.friends(texts).collect()} == {(3, 5), (5, 3)}
    assert {(x.node_id, x.partner_id) for x in neighbors.partners(texts).collect()} == {(3, 5), (5, 3)}


def shape(node):
    return node.text if node.tag == "-text" else (node.tag, [shape(c) for c in node.children])


def test_formatting_is_opened_again():
    body = shape(html.parse("<article><p><b>T<br><p>A</p></article><footer>F</footer>"))[1][1]
    assert body == ("body", [("article", [("p", [("b", ["T", ("br", [])])]), ("p", [("b", ["A"])])]), ("footer", [("b", ["F"])])])


def test_parser_cases():
    def body(text):
        return shape(html.parse(text))[1][1][1]

    assert body("<ul><li>a<li>b</ul>") == [("ul", [("li", ["a"]), ("li", ["b"])])]
    assert body("<table><tr><td>a<td>b</table>") == [("table", [("tbody", [("tr", [("td", ["a"]), ("td", ["b"])])])])]
    assert body("a &amp; b&copy;") == ["a & b©"]
    assert body("<b>1<p>2</b>3</p>") == [("b", ["1"]), ("p", [("b", ["2"]), "3"])]
    rows = html.flatten(html.parse("<body><script>var a = '</p>';</script><p>x<!-- c --></p><svg><g/></svg></body>"))
    assert [r["tag"] for r in rows] == ["html", "body", "p", "-text"]


def test_intervals_nest():
    rows = html.flatten(html.parse("<div><p>a<p>b<b>c</b></div><p>d"))
    for r in rows:
        below = [x["node_id"] for x in rows if r["node_id"] in x["anc_ids"]]
        assert below == list(range(r["node_id"] + 1, r["end_id"] + 1))
    assert len({r["xpath"] for r in rows}) == len(rows)


def test_css():
    page = css.Page(html.flatten(html.parse('<section><div data-testid="vertical-hero-carousel">a</div></section><section><div class="pb2">div-in-section2</div></section><nav aria-label="breadcrumb">nav-test</nav>')))
    assert [page.rows[n]["tag"] for n in page.select('nav[aria-label="breadcrumb"]')] == ["nav"]
    found = page.select('section:has([data-testid="vertical-hero-carousel"]) + section div.pb2')
    assert found == page.select(css.patched('section:has([data-testid="vertical-hero-carousel"]) + section div.pb2')) and len(found) == 1
    assert len(page.select("section:nth-of-type(2n+1)")) == 1 and len(page.select("section, nav")) == 3
    assert page.select("section:not(:first-child)") == [5]
    for bad in ("", "p:nope", "a >", "p[", "!x"):
        with pytest.raises(css.SelectorError):
            page.select(bad)


def test_ancestor_chain(spark):
    chain = tree.ancestor_chain(F.array(F.lit(0)), F.lit(1), 3)
    assert one(spark, chain) == [0, 0, 0]


def test_variable_nodes(spark):
    rows = [("w", p, i, f"P{k}", f"t{p if p < n else 0}", True) for i, (k, n) in enumerate([(1, 7), (2, 6), (3, 5), (4, 1)]) for p in range(7)]
    nodes = spark.createDataFrame(rows, "website string, page_id bigint, node_id int, xpath string, text string, is_text boolean")
    gold = spark.createDataFrame([("w", "P4")], "website string, xpath string")
    assert {r.xpath for r in labels.variable_xpaths(nodes, gold).collect()} == {"P1", "P2", "P4"}
    assert {r.xpath for r in labels.variable_xpaths(nodes, gold, most=1).collect()} == {"P1", "P4"}


def test_evaluation_golden(spark):
    p = spark.createDataFrame([(1, "price", 1, 2.0), (1, "price", 2, 1.0), (2, "price", 3, 0.5), (1, "name", 6, 1.0)], "page_id bigint, label_key string, node_id bigint, confidence double")
    g = spark.createDataFrame([(1, "price", 0, 1), (2, "price", 0, 4), (3, "price", 0, 5), (1, "name", 0, 6), (1, "name", 0, 7)], "page_id bigint, label_key string, group_idx int, node_id bigint")

    def scores(**kw):
        s = evaluate.label_scores(evaluate.page_flags(p, g, **kw))
        m = evaluate.macro(s).first()
        return {r.label_key: (round(r.precision, 4), round(r.recall, 4), round(r.f1, 4)) for r in s.collect()}, tuple(round(x, 4) for x in m)

    assert scores() == ({"price": (0.5, 1.0, 0.6667), "name": (1.0, 1.0, 1.0)}, (0.75, 1.0, 0.8333))
    assert scores(exact=True) == ({"price": (0.5, 1.0, 0.6667), "name": (0.0, 0.0, 0.0)}, (0.25, 0.5, 0.3333))
    assert scores(count_unpredicted=True)[0]["price"] == (0.5, 0.5, 0.5)


def test_ranges_and_folds(spark):
    df = spark.createDataFrame([(x,) for x in (1, 2, 3, 7, 8)], "k bigint").withColumn("g", F.lit(1))
    assert {(r["first"], r["last"]) for r in rel.to_ranges(df, "k", ["g"]).collect()} == {(1, 3), (7, 8)}
    assert rel.cyclic_folds(4, 3) == [[0, 1, 2], [1, 2, 3], [2, 3, 0], [3, 0, 1]]
    gaps = rel.missing_range(df, "k", F.lit(1), F.lit(10))
    assert sorted(r.k for r in gaps.collect()) == [4, 5, 6, 9, 10]


def test_visuals(spark):
    text = '{"/html":{"box":[0,0,9,9],"/body":{"id":"x","fontSize":0}}}'
    pages = spark.createDataFrame([(1, text), (2, "{"), (3, None)], "page_id bigint, visuals string")
    rows = visuals.visual_rows(pages).orderBy("page_id", "xpath").collect()
    assert [(r.page_id, r.xpath) for r in rows if r.error is None] == [(1, "/html"), (1, "/html/body")]
    assert [r.page_id for r in rows if r.error] == [2]
    nodes = spark.createDataFrame([(1, "/html", {}), (1, "/html/body", {"id": "y"}), (1, "/html/p", {})], "page_id bigint, xpath string, attrs map<string,string>")
    found = {(r.xpath, r.problem) for r in visuals.mismatches(nodes, visuals.visual_rows(pages.where("page_id = 1"))).collect()}
    assert found == {("/html/body", "id differs"), ("/html/p", "no visuals")}
    blended = visuals.blended(nodes.withColumn("tag", F.lit("t")).withColumn("text", F.lit("")), visuals.visual_rows(pages.where("page_id = 1")))
    assert {r.xpath: r.attrs for r in blended.collect()}["/html/body"] == {"id": "y", "_id": "x", "_fontSize": "0"}


def test_unwrapped_climbs_to_the_end(spark):
    rows = [(1, 0, None, "body"), (1, 1, 0, "p"), *[(1, k, k - 1, "div" if k % 2 else "span") for k in range(2, 32)], (1, 32, 31, "-text"), (1, 33, 0, "div"), (1, 34, 33, "div"), (1, 35, 33, "span"), (1, 36, 35, "-text"), (2, 0, None, "div"), (2, 1, 0, "-text")]
    nodes = spark.createDataFrame(rows, "page_id bigint, node_id int, parent_id int, tag string")
    got = {(r.page_id, r.node_id): (r.semantic_id, r.semantic_tag) for r in tree.unwrapped(nodes).collect()}
    by = {r[:2]: r for r in rows}
    children = [(r[0], r[2]) for r in rows]

    def climbed(page, n):
        start = n
        while by[page, n][2] is not None and (by[page, n][3] == "-text" or (by[page, n][3] in ("span", "div") and (n == start or children.count((page, by[page, n][2])) == 1))):
            n = by[page, n][2]
        return n, by[page, n][3]

    assert got == {k: climbed(*k) for k in by} and got[1, 32] == (1, "p")


def test_paths_of_deep_trees(spark):
    r = random.Random(4)
    rows = [(1, k, k - 1 if k else None, "p" if k % 3 else "div", 0) for k in range(200)] + [(2, 0, None, "html", 0)]
    rows += [(2, k, r.randrange(max(0, k - 3), k), r.choice("ab"), k) for k in range(1, 120)]
    nodes = spark.createDataFrame(rows, "page_id bigint, node_id int, parent_id int, tag string, sib_pos int")
    by, want = {x[:2]: x for x in rows}, {}
    for page, node, up, tag, pos in rows:
        same = [x[1] for x in rows if x[0] == page and x[2] == up and x[3] == tag]
        step = f"/{tag}" + (f"[{same.index(node) + 1}]" if len(same) > 1 else "")
        above = want.get((page, up), (-1, "", [], [], []))
        want[page, node] = (above[0] + 1, above[1] + step, [*above[2], pos] if up is not None else [], [*above[3], up] if up is not None else [], [*above[4], by[page, up][3]] if up is not None else [])
    paths = tree.with_paths(nodes)
    assert {(x.page_id, x.node_id): (x.depth, x.xpath, x.index_path, x.anc_ids, x.anc_tags) for x in paths.collect()} == want
    below = tree.descendants(paths, spark.createDataFrame([(1, 190), (2, 0), (2, 7)], "page_id bigint, top_id bigint")).collect()
    assert sorted((x.page_id, x.top_id, x.node_id) for x in below) == sorted((p, top, n) for p, top in ((1, 190), (2, 0), (2, 7)) for (q, n), w in want.items() if q == p and top in w[3])


def test_neighbors_against_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(neighbors, "CELLS", 300)
    r = random.Random(2)
    rows = [(page, n, float(r.randrange(9)), float(r.randrange(9)), float(r.randrange(4)), 1.0) for page, size in ((1, 40), (2, 1), (3, 3), (4, 90)) for n in r.sample(range(1000), size)]
    boxes = spark.createDataFrame(rows, "page_id bigint, node_id bigint, x double, y double, w double, h double")
    center = lambda b: (b[2] + b[4] / 2, b[3] + b[5] / 2)
    corner = lambda b: [(b[2] + i * b[4], b[3] + j * b[5]) for i in (0, 1) for j in (0, 1)]
    want_c, want_r = set(), set()
    for a in rows:
        others = [b for b in rows if b[0] == a[0] and b[1] != a[1]]
        by_center = sorted((math.dist(center(a), center(b)) if len(others) >= 4 else abs(a[1] - b[1]), b[1], b) for b in others)[:4]
        while by_center and len(by_center) < 4:
            by_center.append(by_center[-1])
        want_c |= {(a[0], a[1], k + 1, b[1], round(math.dist(center(a), center(b)), 6)) for k, (_, _, b) in enumerate(by_center)}
        by_rect = sorted((min(math.dist(p, q) for p in corner(a) for q in corner(b)), b[1]) for b in others)[:4]
        want_r |= {(a[0], a[1], k + 1, n, round(d, 6)) for k, (d, n) in enumerate(by_rect)}
    assert {(x.page_id, x.node_id, x["rank"], x.neighbor_id, round(x.distance, 6)) for x in neighbors.knn_center(boxes, 4).collect()} == want_c
    assert {(x.page_id, x.node_id, x["rank"], x.neighbor_id, round(x.distance, 6)) for x in neighbors.knn_rect(boxes, 4).collect()} == want_r


def test_vector_neighbors_in_blocks(spark):
    r = random.Random(6)
    rows = [(r.choice(["a", "a", "b", None]), i, [float(r.randrange(5)) for _ in range(3)]) for i in range(120)] + [("alone", 500, [0.0] * 3)]
    df = spark.createDataFrame(rows, "label string, vec_id bigint, v array<double>")
    want = set()
    for g, i, v in rows:
        near = sorted((round(math.dist(v, w), 6), j) for h, j, w in rows if h == g and j != i)[:4]
        want |= {(g, i, j, d, k) for k, (d, j) in enumerate(near, 1)}
    for block in (7, 1024):
        got = neighbors.knn_vectors(df, "label", "vec_id", "v", 4, block=block).collect()
        assert {(x.label, x.vec_id, x.neighbor_id, x.distance, x["rank"]) for x in got} == want and len(got) == len(want)


def test_friends_against_all_pairs(spark):
    r = random.Random(3)
    rows = [(page, n, [r.randrange(2), *(r.randrange(10 + 5 * k) + 100 * k for k in range(1, r.randrange(1, 8)))]) for page in (1, 2) for n in r.sample(range(500), 60)]
    want = set()
    for page, n, up in rows:
        near = [m for q, m, other in rows if q == page and m != n and set(up[-5:]) & set(other[-5:])]
        want |= {(page, n, m) for m in sorted(near, key=lambda m: (abs(n - m), m))[:10]}
    got = neighbors.friends(spark.createDataFrame(rows, "page_id bigint, node_id bigint, anc_ids array<bigint>")).collect()
    assert {(x.page_id, x.node_id, x.friend_id) for x in got} == want


def test_texts_have_their_parents_style(spark):
    nodes = html.dom_nodes(spark.createDataFrame([(1, "<body><p>a<i>b</i></p>")], "page_id bigint, html string"))
    seen = '{"/html":{"/body":{"/p":{"color":"red","box":[0,0,1,1],"/text()":{"box":[1,2,3,4]}}}}}'
    rows = visuals.visual_rows(spark.createDataFrame([(1, seen)], "page_id bigint, visuals string"))
    got = {x.xpath: x for x in visuals.attached(nodes, rows).collect()}
    assert got["/html/body/p/text()"].style == {"color": "red"} and got["/html/body/p/text()"].box.x == 1
    assert got["/html/body/p"].style == {"color": "red"} and got["/html/body/p/i"].style is None and got["/html/body/p/i/text()"].box is None
    assert {x.xpath for x in visuals.sought(nodes, rows).collect()} == {"/html/body/p", "/html/body/p/text()"}
    some = visuals.projected(rows, enabled=["color", "x"], disabled=["x"]).where("xpath = '/html/body/p'").first()
    assert some.attrs == {"color": "red"}


def test_guards_close_a_page(spark):
    rows = [(1, k, "http://a/" if k % 2 else f"http://b/{k}") for k in range(40)] + [(2, k, "http://ads/x") for k in range(30)]
    df = spark.createDataFrame(rows, "page_id bigint, request_id bigint, url string")
    got = {(x.page_id, x.request_id): x.guard for x in routing.guarded(df, F.col("url").contains("ads"), same_url=5, same_page=1000).collect()}
    assert all(got[2, k] is None for k in range(30)) and all((got[1, k] == "url") == (k >= 11) for k in range(40))
    got = {x.request_id: x.guard for x in routing.guarded(df.where("page_id = 1"), F.lit(False), same_page=20).collect()}
    assert all(got[k] == ("page" if k >= 20 else None) for k in range(40))


def test_feature_contract(spark):
    nodes = html.dom_nodes(spark.createDataFrame([(1, TINY), (2, "<body><h1>long heading</h1><u>x</u>")], "page_id bigint, html string"))
    f = features.NodeFeatures(3)
    with pytest.raises(RuntimeError):
        f.compute(nodes)
    state = f.prepare(nodes.where("page_id = 1")).freeze()
    with pytest.raises(RuntimeError):
        f.prepare(nodes)
    again = features.NodeFeatures.restored(state)
    assert again.names == f.names and len(f.names) == 6 and f.compute(nodes).collect() == again.compute(nodes).collect()
    top = {x.xpath: x for x in f.compute(nodes).where("page_id = 2").collect()}
    assert top["/html"].f_depth == 0 and top["/html/body/u/text()"].f_depth == 1 and top["/html/body/h1/text()"].f_text == 1


def test_stream_answers_as_the_batch(spark, tmp_path):
    pages = [(str(k), "u", f"<body><h1>Title {k}</h1><p>text {k}</p><img src='i{k}'>", '{"/html":{"box":[0,0,9,9],"/body":{"/img":{"box":[-9,0,1,1]}}}}' if k % 2 else None) for k in range(8)]
    asked = spark.createDataFrame([*pages, ("none", "u", None, None), ("bad", "u", "<p>x", "{")], "request_id string, url string, html string, visuals string")
    asked.write.json(f"{tmp_path}/in")
    with open(f"{tmp_path}/in/part-x.json", "w") as out:
        out.write("{not json\n")
    nodes = html.dom_nodes(spark.createDataFrame([(int(p[0]), p[2]) for p in pages], "page_id bigint, html string")).withColumn("y", F.when(F.col("is_text") & (F.element_at("anc_tags", -1) == "h1"), 1).when(F.col("tag") == "img", 2).otherwise(0))
    best = model.train(nodes, nodes, features.NodeFeatures().prepare(nodes), "y", ["title", "image"], f"{tmp_path}/model", epochs=3, steps=30, hidden=(6,))
    held = model.load_checkpoint(spark, f"{tmp_path}/model")
    assert (held.epoch, held.step, held.best, held.labels) == (best.epoch, best.step, best.best, ["title", "image"]) and best.best == 1.0
    f = features.NodeFeatures.restored(held.features)
    inference.serve(spark, f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/state", f, held.model, held.labels).awaitTermination()
    got = {x.request_id: json.loads(x.response) for x in spark.read.schema("request_id string, response string").json(f"{tmp_path}/out").collect()}
    batch = {x.request_id: json.loads(x.response) for x in inference.responses(inference.requests(spark, f"{tmp_path}/in", False).cache(), f, held.model, held.labels).collect()}
    assert got == batch and len(got) == 11
    assert "error" in got["none"] and "error" in got["bad"] and "error" in got[None]
    for k in range(8):
        page = got[str(k)]["pages"][0]
        assert [x["text"] for x in page["title"]] == [f"Title {k}"] and 0.5 < page["title"][0]["probability"] <= 1
        assert ("image" in page) == (k % 2 == 0) and (k % 2 or page["image"][0]["url"] == f"i{k}")


def test_attention_takes_one_shuffle(spark):
    from domframe.plans.catalogue import QUERIES

    plan = QUERIES["neighbor_attention"].plan(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


@pytest.mark.parametrize("levels", [1, 3])
def test_friends_of_any_tree(spark, levels):
    r = random.Random(5)
    rows = []
    for page in range(3):
        anc = [[]]
        for node in range(1, 60):
            anc.append([*anc[up := r.randrange(max(0, node - 9), node)], up])
        rows += [(page, node, a) for node, a in enumerate(anc)]
    nodes = spark.createDataFrame(rows, "page_id bigint, node_id bigint, anc_ids array<bigint>")
    want, found = neighbors.friends(nodes, levels, 3), neighbors.friends_of_any_tree(nodes, levels, 3)
    assert sorted(found.collect()) == sorted(want.collect())
    assert "MapInArrow" not in found._jdf.queryExecution().executedPlan().toString()
