"""Data sources with pushed filters, the store's writer, versions and record files."""
import json

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from domframe.sources import corpora, files, folders, store


@pytest.fixture
def corpus(tmp_path):
    for vertical, site, n in (("auto", "aol", 5), ("auto", "msn", 3), ("book", "abe", 2), ("movie", "x", 1), ("job", "careerbuilder", 1)):
        folder = tmp_path / vertical / f"{vertical}-{site}({n})"
        folder.mkdir(parents=True)
        for k in range(n):
            (folder / f"{k:04d}.htm").write_text(f'﻿<base href="http://{site}/{k}"/>\r\n<p>{site} é {k}\n')
        (folder / "0000-exact.htm").write_text("<p>no base")
    return str(tmp_path)


@pytest.fixture
def pushing(spark):
    spark.dataSource.register(folders.PageFolders)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    yield spark
    spark.conf.unset("spark.sql.python.filterPushdown.enabled")


def test_folders_equal_the_plain_reader(spark, corpus):
    spark.dataSource.register(folders.PageFolders)
    for suffix in ("", "-exact"):
        got = spark.read.format("page_folders").option("suffix", suffix).option("pages", 2).load(corpus)
        want = corpora.read_html_folder(spark, corpus, suffix)
        plain = lambda df: sorted((*r[:4], r.url.replace("file:///", "file:/"), r.html) for r in df.select("vertical", "website", "page_count", "page_index", "url", "html").collect())
        assert plain(got) == plain(want) and len(plain(got)) == (10 if not suffix else 3)
    asked = spark.read.format("page_folders").option("verticals", "auto,book").option("websites", "aol,abe").option("first", 1).option("last", 3).load(corpus)
    assert sorted((r.website, r.page_index) for r in asked.collect()) == [("abe", 1), ("aol", 1), ("aol", 2), ("aol", 3)] and asked.rdd.getNumPartitions() == 2


def test_folders_take_filters(pushing, corpus):
    files.make_dir(f"{corpus}/book/book-broken(1)")
    with open(f"{corpus}/book/book-broken(1)/0000.htm", "wb") as f:
        f.write(b"\xff\xfe broken")  # would fail if it were read
    loaded = lambda: pushing.read.format("page_folders").option("push", "true").load(corpus)
    some = loaded().where("vertical = 'auto' and website in ('aol', 'msn') and page_index >= 1 and page_index < 3 and length(html) > 0")
    assert sorted((r.website, r.page_index) for r in some.collect()) == [("aol", 1), ("aol", 2), ("msn", 1), ("msn", 2)]
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert "length(html" in plan and "vertical" not in plan.split("Filter", 1)[-1].split("\n", 1)[0]
    assert some.rdd.getNumPartitions() == 2
    assert loaded().where("website = 'none'").count() == 0
    with pytest.raises(PySparkException):
        loaded().collect()


def rows_of(spark, ids, text="h"):
    return spark.createDataFrame([(i, f"u{i}", f"{text}{i}", None if i % 2 else "{}") for i in ids], store.PAGES)


def test_store_files_by_ranges(spark, tmp_path):
    path = f"{tmp_path}/pages"
    assert store.write_sqlite(rows_of(spark, range(100)), path, parts=4) == 100
    held = files.read_json(f"{path}/manifest.json")["files"]
    assert len(held) == 4 and all(a["high"] < b["low"] for a, b in zip(held, held[1:], strict=False) if a["low"] < b["low"])
    read = lambda: {r.id: (r.url, r.html, r.visuals) for r in spark.read.format("sqlite_pages").option("parts", 3).load(path).collect()}
    assert read() == {i: (f"u{i}", f"h{i}", None if i % 2 else "{}") for i in range(100)}
    rows_of(spark, range(90, 120), "new").write.format("sqlite_pages").mode("append").save(path)  # the last one counts
    assert len(read()) == 120 and read()[95][1] == "new95" and read()[89][1] == "h89"
    rows_of(spark, [7]).write.format("sqlite_pages").mode("overwrite").save(path)
    assert read() == {7: ("u7", "h7", None)}
    assert store.write_sqlite(rows_of(spark, range(100)).limit(0), f"{tmp_path}/none") == 0
    assert spark.read.format("sqlite_pages").load(f"{tmp_path}/none").count() == 0


def test_failed_write_shows_nothing(spark, tmp_path):
    spark.dataSource.register(store.SqlitePages)
    path = f"{tmp_path}/pages"
    store.write_sqlite(rows_of(spark, range(10)), path, parts=2)
    before = files.read(f"{path}/manifest.json")
    bad = rows_of(spark, range(100)).repartition(4, "id").withColumn("html", F.when(F.col("id") == 57, F.raise_error(F.lit("lost"))).otherwise(F.col("html")))
    with pytest.raises(PySparkException):
        bad.select("id", "url", F.col("html").cast("string").alias("html"), "visuals").write.format("sqlite_pages").mode("append").save(path)
    assert files.read(f"{path}/manifest.json") == before
    assert spark.read.format("sqlite_pages").load(path).count() == 10


def test_attempts_of_one_task_count_once(tmp_path):
    w = store._SqliteWriter(f"{tmp_path}/s", ["id", "url", "html", "visuals"], True)
    rows = [(k, "u", "h", None) for k in range(5)]
    first, again = w.write(iter(rows)), w.write(iter(rows))  # the first attempt's message was lost
    w.commit([again])
    assert first.name != again.name and [x["name"] for x in files.read_json(f"{tmp_path}/s/manifest.json")["files"]] == [again.name]
    w.abort([first, None])
    assert files.read(f"{tmp_path}/s/{first.name}") is None


def test_versions(tmp_path):
    root = f"{tmp_path}/log"
    assert store.Version.created(root).folder == "v1" == store.Version.created(root).folder  # an unnamed one is used again
    assert store.Version.created(root, "base").folder == "v2-base"
    with pytest.raises(RuntimeError):
        store.Version.created(root, "base")
    assert store.Version.created(root).folder == "v3" and [v.number for v in store.Version.all(root)] == [1, 2, 3]
    store.write_card(f"{root}/v2-base", ["title"], "auto", [{"name": "aol", "prefix": "http://a/"}])
    store.Version.all(root)[0].trashed()
    assert [v.folder for v in store.Version.all(root)] == ["v2-base", "v3"] and files.listed(f"{root}-trash", folders=True)[0].startswith("v1-")
    assert store.copied_versions(root, f"{tmp_path}/other", 10, dry=True)[0][1].endswith("v10-base") and not files.listed(f"{tmp_path}/other", folders=True)
    store.copied_versions(root, f"{tmp_path}/other", 10)
    assert files.listed(f"{tmp_path}/other", folders=True) == ["v10-base", "v11"]
    assert files.read_json(f"{tmp_path}/other/v10-base/info.json")["labels"] == ["title"]


def test_parameters_for_inference():
    own = {"validate_data": True, "classify_only_variable_nodes": True, "epochs": 3}
    assert store.for_inference(own) == {"validate_data": False, "classify_only_variable_nodes": False, "epochs": 3} and own["validate_data"]
    assert set(store.params_difference(own, store.for_inference(own))) == {"validate_data", "classify_only_variable_nodes"}


def test_record_arrays(spark, tmp_path):
    df = spark.createDataFrame([(k, None if k % 3 else f'"{k}\n') for k in range(20)], "a bigint, b string").repartition(3)
    store.write_record_arrays(df, f"{tmp_path}/r")
    held = [r for p in sorted((tmp_path / "r").glob("part-*")) if p.stat().st_size for r in json.loads(p.read_text())]
    assert sorted((r["a"], r["b"]) for r in held) == sorted(((r.a, r.b) for r in df.collect()), key=lambda x: x[0])
    assert corpora.read_records(spark, f"{tmp_path}/r").select("a", "b").exceptAll(df).count() == 0
