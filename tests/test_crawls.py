"""Crawl states, exploration of labels, registries, and nested sinks."""
import json
import xml.etree.ElementTree as ET

import pytest
from pyspark.sql import functions as F

from domframe.operators import crawls, exploration, features, html, visuals
from domframe.plans.catalogue import QUERIES

SF = "/root/testdata/sf0.001"
NODE = "page_id bigint, node_id int, parent_id int, tag string, text string, is_text boolean, xpath string, attrs map<string,string>, anc_ids array<int>, style map<string,string>"


def tree(spark):
    rows = [
        (1, 0, None, "html", None, False, "/html", {}, [], None), (1, 1, 0, "div", None, False, "/html/div", {"class": "mainBox", "id": ""}, [0], {"color": "red"}),
        (1, 2, 1, "-text", " A  b ", True, "/html/div/text()", {}, [0, 1], {"color": "red"}), (1, 3, 0, "img", None, False, "/html/img", {"id": "x"}, [0], None), (2, 0, None, "html", None, False, "/html", {}, [], None),
    ]
    return spark.createDataFrame(rows, NODE)


def test_request_summary(spark):
    rows = spark.createDataFrame([("live", 200), ("live", 404), ("offline", 200), ("other", None), (None, 200), ("undef", None)], "outcome string, status int")
    counts = crawls.request_counts(rows)
    assert {r.counter: r.n for r in counts.collect()} == {"live": 2, "offline": 1, "undef": 1, "200": 3, "404": 1}
    assert crawls.request_summary(counts).first().summary == "undef: 1, offline: 1, live: 2, 200: 3, 404: 1"
    assert crawls.request_summary(counts.limit(0)).first().summary == ""


def test_versions_and_validation(spark):
    rows = spark.createDataFrame([(1, "latest"), (1, "exact"), (2, "latest"), (3, "2011"), (4, "exact")], "p int, version string")
    assert sorted(map(tuple, crawls.versioned(rows, ["p"]).collect())) == [(1, "exact"), (2, "latest"), (4, "exact")]
    both = crawls.validated(rows, rows.where("p != 2"), rows.where("p < 4 and version != '2011'"), ["p", "version"])
    assert {(r.p, r.version): r.result for r in both.collect()} == {(1, "latest"): "Valid", (1, "exact"): "Valid", (2, "latest"): "HtmlNonExistent", (3, "2011"): "JsonNonExistent", (4, "exact"): "JsonNonExistent"}


def test_extraction_counts(spark):
    got = {r.page_id: (r.evaluated, r.skipped) for r in crawls.extraction_counts(tree(spark), True, ["img"]).collect()}
    assert got == {1: (3, 1), 2: (0, 1)}
    assert {r.page_id: r.skipped for r in crawls.extraction_counts(tree(spark), False).collect()} == {1: 0, 2: 0}


def test_blend_only_takes_exact_pages(spark):
    pages = spark.createDataFrame([(1, "<p>a", '{"/html":{}}'), (2, "<p>b", None), (3, "<p>c", '{"/html":{}}')], "page_id bigint, html string, visuals string")
    exact = spark.createDataFrame([(3, "<p>exact"), (2, "<p>never")], "page_id bigint, html string")
    out = crawls.blend_only(pages, exact, html.dom_nodes)
    assert {(r.page_id, r.text) for r in out.where("text is not null").collect()} == {(1, "a"), (3, "exact")}
    got = {r.page_id: r.footers for r in QUERIES["blend_only"].plan(spark, SF).collect()}
    assert got and all(n == 1 + (p % 2 == 0) for p, n in got.items()) and all(p % 5 for p in got)


def test_predictions_as_gold(spark):
    said = spark.createDataFrame([(1, 2, "name", 0.5), (1, 1, "name", 0.9), (1, 3, "pic", 0.1)], "page_id bigint, node_id int, label_key string, confidence double")
    got = sorted(map(tuple, exploration.predicted_gold(tree(spark), said).collect()))
    assert got == [(1, "name", 0, 1, ""), (1, "name", 1, 2, "A b"), (1, "pic", 0, 3, "")]


def test_wide_and_plain_projection(spark):
    gold = spark.createDataFrame([(1, "name", 2), (1, "also", 2), (1, "pic", 3)], "page_id bigint, label_key string, node_id int")
    urls = spark.createDataFrame([(1, "u1")], "page_id bigint, url string")
    edges = spark.createDataFrame([(1, 2, 3, 1), (1, 2, 1, 2), (1, 2, 0, 3)], "page_id bigint, node_id int, neighbor_id int, rank int")
    got = {r.node_id: r.asDict() for r in exploration.wide(tree(spark), gold, urls, ["color"], ["class", "id"], 2, edges, 2).collect()}
    assert got[2] == {"page_id": 1, "node_id": 2, "label_key": "also", "value": "A b", "url": "u1", "color": "red", "attrs": "", "anc_0": "<div>[Main box]", "anc_1": "<html>[]", "neighbor_0": "<img>", "neighbor_1": "<div>"}
    assert got[3]["value"] == "<img>" and got[3]["attrs"] == "X" and got[3]["anc_0"] == "<html>[]" and got[3]["anc_1"] is None and got[3]["neighbor_0"] is None
    plain = exploration.explored(tree(spark), gold)
    assert plain.columns == ["page_id", "label_key", "xpath", "text", "tag", "box"] and plain.count() == 3


def test_tags_of_a_label(spark):
    nodes = spark.createDataFrame([(p, 1, "img" if p % 2 else "a") for p in range(20)] + [(0, 2, "a")], "page_id bigint, node_id int, tag string")
    sites = spark.createDataFrame([(p, f"w{p // 10}") for p in range(20)], "page_id bigint, website string")
    got = exploration.tag_histogram(nodes, nodes.select("page_id", "node_id"), sites, 4).groupBy("website").agg(F.sum("n").alias("n")).collect()
    assert {r.website: r.n for r in got} == {"w0": 4, "w1": 4}  # each page has one tag, though page 0 has two nodes


def test_length_estimate(spark):
    nodes = spark.createDataFrame([(1, 1), (1, 2), (2, 1)], "page_id int, node_id int")
    pages = spark.createDataFrame([(k,) for k in range(1, 7)], "page_id int")
    assert tuple(exploration.length_estimate(nodes, pages).first()) == (2, 6, 9)
    assert tuple(exploration.length_estimate(nodes.limit(0), pages).first()) == (0, 6, 12000)


def test_registries(spark):
    for find in (features.tokenizer, lambda n: features.vector_aggregate(None, "k", None, "o", "v", n)):
        with pytest.raises(ValueError, match="unknown"):
            find("nothing")
    rows = spark.createDataFrame([(1, [2, 9, 1]), (2, [])], "k bigint, ids array<bigint>")
    words = spark.createDataFrame([("a", 1), ("b", 2)], "token string, id bigint")
    assert {r.k: list(r.tokens) for r in features.tokens_by_id(rows, "k", "ids", words).collect()} == {1: ["b", "[UNK]", "a"], 2: []}


PAGE = "<body><p id='a&b' 1x='y'>x &lt; y</p><svg><g></g></svg><ul>" + "".join(f"<li>{k}</li>" for k in range(12)) + "</ul><div>gone<b>gone</b></div>"


def test_nested_xml(spark, tmp_path):
    drawn = {"/html": {"box": [0, 0, 9, 9], "/body": {"/p": {"color": "red", "id": "a&b", "box": [0, 0.5, 1, 2], "/text()": {"whiteSpace": True}}, "/ul": {f"/li[{k + 1}]": {"/text()": {}} for k in range(12)}, "/none": {}}}}
    pages = spark.createDataFrame([(1, PAGE, json.dumps(drawn))], "page_id bigint, html string, visuals string")
    rows = visuals.blended(html.dom_nodes(pages, frozenset(("head",))), visuals.visual_rows(pages))
    root = ET.fromstring(visuals.nested_xml(rows, f"{tmp_path}/xml").first().xml)
    body = root.find("body")
    assert root.tag == "html" and root.get("_box") == "0 0 9 9" and [c.tag for c in body] == ["p", "ul"]  # div has no visuals, svg is left out
    assert body[0].attrib == {"id": "a&b", "_1x": "y", "_color": "red", "_box": "0 0.5 1 2"} and body[0][0].attrib == {"_text": "x < y"}
    assert [li[0].get("_text") for li in body[1]] == [str(k) for k in range(12)]
    assert ET.fromstring(spark.read.text(f"{tmp_path}/xml", wholetext=True).first().value) is not None
    flat = ET.fromstring(visuals.as_xml(rows, f"{tmp_path}/flat").first().xml)
    items = [n.get("xpath") for n in flat if n.get("xpath", "").endswith("]") and "/li[" in n.get("xpath")]
    assert items == [f"/html/body/ul/li[{k + 1}]" for k in range(12)]  # in order of the document, not of the text


def test_visuals_written_and_read(spark):
    drawn = {"/html": {"box": [0, 0, 9, 9], "fontSize": 12, "/body": {"color": "red", "whiteSpace": True, "transform": [1, "a"], "/p[1]": {}, "/p[2]": {"id": "5"}}}}
    rows = visuals.visual_rows(spark.createDataFrame([(1, json.dumps(drawn))], "page_id bigint, visuals string"))
    again = visuals.visual_rows(visuals.nested_json(rows))
    assert sorted(map(str, rows.collect())) == sorted(map(str, again.collect()))
    got = QUERIES["visuals_round_trip"].plan(spark, SF)
    assert got.count() == 4 * spark.read.parquet(f"{SF}/pages.parquet").count() and got.where("xpath = '/html/body/article' and attrs like '%#ff0000ff%'").count() > 0


def test_predicted_labels_of_pages(spark):
    n = html.dom_nodes(spark.read.parquet(f"{SF}/pages.parquet"))
    got = QUERIES["predicted_labels"].plan(spark, SF)
    assert got.count() == n.where("is_text and element_at(anc_tags, -1) in ('h1', 'a')").count()
    assert got.groupBy("page_id", "label_key").agg((F.count("*") - F.max("group_idx")).alias("d")).where("d != 1").count() == 0


def test_rules_with_visuals(spark):
    got = {r.page_id: r for r in QUERIES["dom_validate_visuals"].plan(spark, SF).collect()}
    assert all(r.has_visuals == (p % 3 != 0) for p, r in got.items())
    plain = {r.page_id: r for r in QUERIES["dom_validate"].plan(spark, SF).collect()}
    labelled = {p for p, r in plain.items() if r.some_gold}
    assert {p for p, r in got.items() if not r.all_boxed} >= {p for p in labelled if p % 2 or p % 3 == 0}
    assert any(r.valid for r in got.values()) and all(not r.valid for p, r in got.items() if p % 3 == 0 or p % 2 and p in labelled)


def test_orphans_stay(spark):
    from domframe.operators import tree as trees

    nodes = spark.createDataFrame([(1, 0, None, "html", 0), (1, 1, 0, "p", 0), (1, 5, 4, "b", 0), (1, 6, 5, "-text", 0)], "page_id bigint, node_id int, parent_id int, tag string, sib_pos int")
    got = {r.node_id: (r.xpath, r.depth, list(r.anc_ids)) for r in trees.with_paths(nodes).collect()}
    assert got == {0: ("/html", 0, []), 1: ("/html/p", 1, [0]), 5: ("/b", 0, []), 6: ("/b/text()", 1, [5])}


def test_descendants_by_intervals(spark):
    import random

    from domframe.operators import tree as trees

    r = random.Random(6)
    rows = []
    for page, n in ((1, 300), (2, 1), (3, 40)):
        parent = [None] + [r.randrange(max(0, k - 4), k) for k in range(1, n)]
        chain = []
        order, up = [0], {0: None}
        below = {k: [j for j in range(n) if parent[j] == k] for k in range(n)}
        order, stack = [], [0]
        while stack:
            k = stack.pop()
            order.append(k)
            stack += reversed(below[k])
        number = {k: i for i, k in enumerate(order)}
        for k in order:
            chain, at = [], parent[k]
            while at is not None:
                chain.append(number[at])
                at = parent[at]
            rows.append([page, number[k], number[k], not below[k], chain[::-1], up.get(k)])
        for x in sorted((x for x in rows if x[0] == page), key=lambda x: -x[1]):
            for y in rows:
                if y[0] == page and y[1] in x[4]:
                    y[2] = max(y[2], x[1])
    nodes = spark.createDataFrame([x[:5] for x in rows], "page_id bigint, node_id int, end_id int, is_leaf boolean, anc_ids array<int>")
    tops = nodes.select("page_id", F.col("node_id").alias("top_id"))
    for leaves in (False, True):
        got = sorted(map(tuple, trees.descendants(nodes, tops, leaves=leaves).collect()))
        want = sorted(map(tuple, trees.descendants(nodes.drop("end_id"), tops, leaves=leaves).collect()))
        assert got == want and got
