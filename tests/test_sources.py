"""Round trips of sources and sinks."""
import json

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from domframe.operators import relational as rel
from domframe.sources import corpora, store


def test_html_folder(spark, tmp_path):
    site = tmp_path / "auto" / "auto-aol(3)"
    site.mkdir(parents=True)
    (site / "0000.htm").write_text('﻿<base href="http://a.b/0"/>\n<p>x</p>\n')
    (site / "0001.htm").write_text("<p>no base</p>")
    (site / "0000-exact.htm").write_text('<base href="http://a.b/e"/>\n<p>e</p>')
    other = tmp_path / "movie" / "movie-x(1)"
    other.mkdir(parents=True)
    (other / "0000.htm").write_text('<base href="http://m/"/>\n')
    rows = corpora.read_html_folder(spark, str(tmp_path)).orderBy("page_index").collect()
    assert [(r.website, r.page_count, r.page_index, r.html) for r in rows] == [("aol", 3, 0, "<p>x</p>\n"), ("aol", 3, 1, "<p>no base</p>")]
    assert rows[0].url == "http://a.b/0" and rows[1].url.startswith("file:")
    assert corpora.read_html_folder(spark, str(tmp_path), "-exact").first().url == "http://a.b/e"


def test_ground_truth(spark, tmp_path):
    (tmp_path / "auto-aol-model.txt").write_text("auto\taol\tmodel\n3\t2\t2\t0\n0\t1\tAudi &amp; A4\n1\t0\t<NULL>\n2\t2\tX\tY\n")
    rows = corpora.read_ground_truth(spark, str(tmp_path)).orderBy("page_index").collect()
    assert [r["values"] for r in rows] == [["Audi & A4"], [], ["X", "Y"]]
    (tmp_path / "auto-aol-model.txt").write_text("auto\taol\tmodel\n1\t1\t1\t0\n0\t2\tX\n")
    with pytest.raises(PySparkException):
        corpora.read_ground_truth(spark, str(tmp_path)).collect()


def test_records(spark, tmp_path):
    (tmp_path / "d.json").write_text(json.dumps([{"url": "u", "localizedHtml": "h", "name": "n", "selector_name": ".n", "junk": 1}, {"url": "v", "localizedHtml": "h", "name": "bad", "selector_name": "", "junk": 1}]))
    r = corpora.read_records(spark, str(tmp_path / "d.json"))
    assert corpora.slim(r).columns == ["url", "name", "selector_name"]
    assert {(x.url, x.valid) for x in corpora.record_labels(r).collect()} == {("u", True), ("v", False)}


def test_page_store(spark, tmp_path):
    s = store.PageStore(spark, str(tmp_path / "store"))
    assert len(s) == 0
    s.add(spark.createDataFrame([(0, "u", "h", None), (1, "v", "h", "{}")], store.PAGES))
    s.replace(spark.createDataFrame([(1, "w", "h2", None)], store.PAGES))
    assert len(s) == 2 and s.get(1)["url"] == "w" and s.get(0)["url"] == "u"
    with pytest.raises(RuntimeError):
        s.get(7)


def test_sqlite(spark, tmp_path):
    path = str(tmp_path / "p.db")
    pages = spark.range(250).select("id", F.format_string("u%d", "id").alias("url"), F.lit("h").alias("html"), F.lit(None).cast("string").alias("visuals"))
    assert store.write_sqlite(pages, path) == 250
    spark.dataSource.register(store.SqlitePages)
    back = spark.read.format("sqlite_pages").option("parts", 3).load(path)
    assert back.count() == 250 and back.exceptAll(pages).count() == 0


def test_assets(spark):
    a = spark.createDataFrame([("t", "u", 200, "x"), ("t", "v", 404, None), ("t", "w", 200, "x")], "timestamp string, url string, status int, body string")
    entries, blobs = store.cache_assets(a)
    assert blobs.count() == 1
    asked = spark.createDataFrame([("t", "u"), ("t", "v"), ("t", "z")], "timestamp string, url string")
    assert {r.url: r.outcome for r in store.lookup_assets(asked, entries, blobs).collect()} == {"u": "hit", "v": "aborted", "z": "miss"}


def test_params_and_vectors(spark, tmp_path):
    path = str(tmp_path / "p.json")
    assert store.load_params(path, {"a": 1}) == {"a": 1} == store.load_params(path, {"a": 2}) | {"a": 1}
    assert store.params_difference({"a": 1, "b": 2}, {"a": 1, "b": 3, "c": 4}, ("c",)) == {"b": (2, 3)}
    assert store.next_version(str(tmp_path)).endswith("v1") and store.next_version(str(tmp_path)).endswith("v2")
    (tmp_path / "g.txt").write_text("the 0.5 1\nof 1 2\n")
    assert [(r.token, r.id, list(r.vector)) for r in store.read_word_vectors(spark, str(tmp_path / "g.txt")).orderBy("id").collect()] == [("the", 1, [0.5, 1.0]), ("of", 2, [1.0, 2.0])]


def test_conversion_and_decisions(spark, tmp_path):
    assert [store.opening(*x) for x in ((True, False, True, False), (False, True, True, False), (False, False, True, True), (True, True, False, True), (True, True, False, False))] == [store.USE_STORE, store.CONVERT_SLIM, store.CONVERT_FULL, store.READ_SLIM, store.READ_FULL]
    pages = spark.createDataFrame([(k, f"u{k}", f"h{k}", None if k == 2 else "{}") for k in range(5)], "index bigint, url string, html string, visuals string")
    exact = spark.createDataFrame([("u1", "exact")], "url string, html string")
    s = store.PageStore(spark, f"{tmp_path}/store")
    got = {r.id: (r.url, r.html) for r in store.converted(s, pages, exact, with_visuals_only=True).collect()}
    assert got == {0: ("u0", "h0"), 1: ("u1", "exact"), 2: ("u3", "h3"), 3: ("u4", "h4")}
    assert store.converted(s, pages).count() == 4
    store.reloaded(s, spark.createDataFrame([(0, "u0", "new", "{}"), (1, "u1", "no", "{}")], "id bigint, url string, html string, visuals string"), [0, 3])
    assert {r.id: r.html for r in s.read().collect()} == {0: "new", 1: "exact", 2: "h3", 3: "h4"}
    store.write_records(pages, f"{tmp_path}/records")
    assert spark.read.schema(pages.schema).json(f"{tmp_path}/records").exceptAll(pages).count() == 0


def test_numbered_over_several_parts(spark):
    df = spark.createDataFrame([(f"k{i:04d}",) for i in range(1000)], "k string").repartition(5)
    rows = rel.numbered(df, "k", most=90).collect()
    assert sorted((r._number, r.k) for r in rows) == [(i, f"k{i:04d}") for i in range(1000)]
    assert rel.numbered(df.limit(0), "k").count() == 0


def test_versions_results_and_caches(spark, tmp_path):
    for name, value in (("v2", 0.5), ("v10", 0.75), ("v9", None)):
        (tmp_path / "log" / name).mkdir(parents=True)
        (tmp_path / "log" / name / "info.json").write_text(f'{{"name": "{name}"}}')
        (tmp_path / "log" / name / "params.json").write_text("{}")
        store.write_results(f"{tmp_path}/log/{name}", {"f1": value})
    path, info, params = store.latest_model(f"{tmp_path}/log")
    assert path.endswith("v10") and info == {"name": "v10"} and params == {}
    assert [(r.run, r.value) for r in store.read_results(spark, f"{tmp_path}/log").orderBy("place").collect()] == [("v2", 0.5), ("v9", None), ("v10", 0.75)]
    made = []

    def make():
        made.append(1)
        return spark.createDataFrame([("w", "/a", 6, False)], "website string, xpath string, texts bigint, labeled boolean")

    first, second = (store.cached_xpaths(spark, f"{tmp_path}/xpaths", make).collect() for _ in range(2))
    assert first == second and made == [1]


def test_word_vectors_are_numbered_by_line(spark, tmp_path):
    (tmp_path / "v").mkdir()
    for k in range(3):
        (tmp_path / "v" / f"{k}.txt").write_text("".join(f"t{k}_{i} {i}.5 2\n" for i in range(4)))
    rows = store.read_word_vectors(spark, f"{tmp_path}/v").collect()
    assert sorted(r.id for r in rows) == list(range(1, 13)) and all(list(r.vector) == [int(r.token[-1]) + 0.5, 2] for r in rows)
    assert all(by[i].id + 1 == by[i + 1].id for k in range(3) for by in [sorted((r for r in rows if r.token.startswith(f"t{k}_")), key=lambda r: r.token)] for i in range(3))


def test_xml_sink(spark, tmp_path):
    from domframe.operators import html, visuals

    pages = spark.createDataFrame([(1, "<body><p id='a&b'>x &lt; y", '{"/html":{"/body":{"/p":{"color":"red","box":[0,0,1,2]}}}}')], "page_id bigint, html string, visuals string")
    text = visuals.as_xml(visuals.blended(html.dom_nodes(pages), visuals.visual_rows(pages)), f"{tmp_path}/xml").first().xml
    import xml.etree.ElementTree as ET

    found = {n.get("xpath"): n for n in ET.fromstring(text)}
    assert found["/html/body/p"].attrib == {"xpath": "/html/body/p", "id": "a&b", "_color": "red", "_box": "0.0 0.0 1.0 2.0"}
    assert found["/html/body/p/text()"].text == "x < y"


def test_ranked_over_several_parts(spark):
    rows = [(None if i % 5 == 0 else f"g{i % 3}", i) for i in range(1000)]
    df = spark.createDataFrame(rows, "g string, k int").repartition(4)
    got = {r.k: r.place for r in rel.ranked(df, ["g"], ["k"], "place", most=60).collect()}
    assert all(got[k] == 1 + sum(h == g and j < k for h, j in rows) for g, k in rows) and len(got) == 1000


def test_website_folders_and_selection(spark, tmp_path):
    for name, n in (("auto-aol(2)", 2), ("auto-msn(3)", 1), ("auto-empty(4)", 0)):
        (tmp_path / "auto" / name).mkdir(parents=True)
        for k in range(n):
            (tmp_path / "auto" / name / f"{k:04d}.htm").write_text("<p>")
    found = {r.website: (r.page_count, r.files, r.agrees) for r in corpora.website_folders(spark, str(tmp_path)).collect()}
    assert found == {"aol": (2, 2, True), "msn": (3, 1, False), "empty": (4, 0, False)}
    sites = corpora.website_folders(spark, str(tmp_path))
    assert [r.website for r in corpora.selected(sites, websites=["a"], prefix=True).collect()] == ["aol"]
    assert {r.website for r in corpora.selected(sites, verticals=["auto"], excluded=["msn"]).collect()} == {"aol", "empty"}
    assert corpora.page_files(spark, f"{tmp_path}/auto/*/0000.htm") == sorted(corpora.page_files(spark, f"{tmp_path}/auto/*/0000.htm")) and len(corpora.page_files(spark, f"{tmp_path}/auto/*/*.htm")) == 3
    listing = tmp_path / "list.txt"
    listing.write_text("b.htm\n\na.htm\n")
    assert corpora.page_files(spark, str(listing)) == ["a.htm", "b.htm"]
