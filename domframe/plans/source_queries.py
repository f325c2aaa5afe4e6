"""Queries of page stores, their conversion and caches."""
from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import labels
from ..sources import corpora, store
from ..sources.scratch import shared_dir
from . import dom_sql
from .dom_queries import dom_validate, dom_variable_xpaths
from .registry import Tables, query
from .text_queries import VARIABLE_SQL, variable_fragments


def _store(t: Tables) -> store.PageStore:
    return store.PageStore(t.spark, f"{shared_dir(t.spark)}/store-{uuid.uuid4().hex}")


def _records(t: Tables) -> DataFrame:
    return t.pages.select((F.col("page_id") * 10).alias("index"), "url", "html", F.when(F.col("page_id") % 4 > 0, "{}").alias("visuals"))


@query("S10 S11 S12 P4 W7", "SELECT row_number() OVER (ORDER BY page_id) - 1 AS id, url, md5(html) AS html FROM pages WHERE page_id % 4 > 0")
def store_conversion(t: Tables) -> DataFrame:
    """Pages with visuals converted to a new store, numbered anew."""
    pages = store.converted(_store(t), _records(t), with_visuals_only=True)
    return pages.select("id", "url", F.md5("html").alias("html"))


@query("S4 W2", "SELECT page_id - 10 AS id, url FROM pages WHERE page_id >= 10 AND page_id < 30")
def store_window(t: Tables) -> DataFrame:
    """The twenty pages of one website in a store of several."""
    s = _store(t)
    s.add(t.pages.select(F.col("page_id").alias("id"), "url", "html", F.lit(None).cast("string").alias("visuals")))
    return s.window(10, 20).select("id", "url")


@query("S14", "SELECT page_id AS id, CASE WHEN page_id IN (3, 5) THEN 'fresh' ELSE md5(html) END AS html FROM pages")
def store_reload(t: Tables) -> DataFrame:
    """Two pages taken anew from their files."""
    s = _store(t)
    rows = t.pages.select(F.col("page_id").alias("id"), "url", "html", F.lit(None).cast("string").alias("visuals"))
    s.add(rows)
    store.reloaded(s, rows.withColumn("html", F.lit("fresh")), [3, 5])
    return s.read().select("id", F.when(F.col("html") == "fresh", "fresh").otherwise(F.md5("html")).alias("html"))


@query("S17 P18", "WITH f AS (SELECT url, min(page_id) AS p FROM pages GROUP BY url) SELECT url, CASE WHEN p % 3 = 0 THEN 'store' WHEN p % 3 = 1 THEN 'exact' ELSE 'dataset' END AS html FROM f")
def page_resolution(t: Tables) -> DataFrame:
    """A page's text from the store, else an exact file, else the dataset."""
    f = t.pages.groupBy("url").agg(F.min("page_id").alias("p"))
    own = f.select("url", F.when(F.col("p") % 3 == 0, "store").alias("html"))
    exact = f.where("p % 3 = 1").select("url", F.lit("exact").alias("html"))
    return corpora.resolved(own, exact, f.select("url", F.lit("dataset").alias("html")))


@query("S20 D26", VARIABLE_SQL)
def xpath_cache(t: Tables) -> DataFrame:
    """Variable places of websites from their cache, which is filled on the first and read on the second call."""
    path = f"{shared_dir(t.spark)}/variable-{uuid.uuid4().hex}"
    for _ in range(2):
        out = store.cached_xpaths(t.spark, path, lambda: variable_fragments(t))
    return out


@query("A18 V9", dom_sql.SUMMARY)
def validation_summary(t: Tables) -> DataFrame:
    return labels.summary(dom_validate(t))


@query("S20 D26 P14", dom_sql.VARIABLE)
def variable_xpath_cache(t: Tables) -> DataFrame:
    """Variable XPaths of websites from their cache, which is filled on the first and read on the second call."""
    path = f"{shared_dir(t.spark)}/xpaths-{uuid.uuid4().hex}"
    for _ in range(2):
        out = store.cached_xpaths(t.spark, path, lambda: dom_variable_xpaths(t))
    return out


@query("S17 P18 C6", "WITH f AS (SELECT url, arg_min(html, page_id) AS html, min(page_id) AS p FROM pages GROUP BY url) SELECT url, md5(CASE WHEN p % 3 = 0 THEN html WHEN p % 3 = 1 THEN html || ' exact' ELSE html || ' dataset' END) AS html FROM f")
def page_texts(t: Tables) -> DataFrame:
    """Whole texts of pages from the store, else an exact version, else the dataset."""
    f = t.pages.groupBy("url").agg(F.min_by("html", "page_id").alias("html"), F.min("page_id").alias("p"))
    own = f.select("url", F.when(F.col("p") % 3 == 0, F.col("html")).alias("html"))
    other = lambda name: f.select("url", F.concat("html", F.lit(f" {name}")).alias("html"))
    out = corpora.resolved(own, other("exact").join(f.where("p % 3 = 1").select("url"), "url", "left_semi"), other("dataset"))
    return out.select("url", F.md5("html").alias("html"))


@query("S14", "SELECT page_id AS id, md5(CASE WHEN page_id IN (SELECT n_nationkey * 3 FROM nation) THEN html || ' anew' ELSE html END) AS html FROM pages")
def store_reload_listed(t: Tables) -> DataFrame:
    """The pages that a table lists taken anew from their files."""
    s = _store(t)
    rows = t.pages.select(F.col("page_id").cast("bigint").alias("id"), "url", "html", F.lit(None).cast("string").alias("visuals"))
    s.add(rows)
    store.reloaded(s, rows.withColumn("html", F.concat("html", F.lit(" anew"))), t.nation.select((F.col("n_nationkey") * 3).cast("bigint").alias("id")))
    return s.read().select("id", F.md5("html").alias("html"))
