"""Queries of the request stream, the metric log, the store's writer, early stops and comparison of trees."""
from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import labels, structure, visuals
from ..sources import metrics, store
from ..sources.scratch import shared_dir, written
from ..streaming import router
from . import dom_sql
from .dom_queries import _nodes, _visual_pages
from .registry import QUERIES, Tables, query
from .relational_queries import routing_tables


def _folder(t: Tables, name: str) -> str:
    """A new folder in the shared one, deleted when the application ends."""
    path = f"{shared_dir(t.spark)}/{name}-{uuid.uuid4().hex}"
    p = t.spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(t.spark._jsc.hadoopConfiguration())
    fs.mkdirs(p)
    fs.deleteOnExit(p)
    return path


@query("C2 C3 W8", QUERIES["request_routing"].sql)
def request_stream(t: Tables) -> DataFrame:
    """request_routing as a stream with state: its requests arrive in four parts, and after each the stream starts again."""
    asked, pages, assets = routing_tables(t)
    base = _folder(t, "requests")
    low, high = asked.agg(F.min("request_id"), F.max("request_id")).first()
    step = (high - low) // 4 + 1 if low is not None else 1
    before = t.spark.conf.get(router.PROVIDER[0], None)
    t.spark.conf.set(*router.PROVIDER)
    try:
        for k in range(4):
            part = asked if low is None else asked.where(F.floor((F.col("request_id") - low) / step) == k)
            part.write.mode("append").parquet(f"{base}/in")
            stream = t.spark.readStream.schema(asked.schema).parquet(f"{base}/in")
            out = router.routed_stream(stream, pages, assets, ["http://ads."], same_url=3, same_page=12)
            out.writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start().awaitTermination()
    finally:
        t.spark.conf.unset(router.PROVIDER[0]) if before is None else t.spark.conf.set(router.PROVIDER[0], before)
    return t.spark.read.parquet(f"{base}/out").select("request_id", "normal_url", "route")


@query("S30 A12", "SELECT l_returnflag AS run, l_linenumber::BIGINT AS step, 'quantity' AS name, sum(l_quantity)::DOUBLE AS value FROM lineitem GROUP BY ALL")
def metric_log(t: Tables) -> DataFrame:
    """Quantities of line items as a metric of runs, written in two batches, of which one is written again."""
    path = _folder(t, "metrics")
    rows = written(t.lineitem.groupBy(F.col("l_returnflag").alias("run"), F.col("l_linenumber").alias("step")).agg(F.sum("l_quantity").cast("double").alias("value")).withColumn("name", F.lit("quantity")), "metrics")
    for batch in (0, 1, 0):
        metrics.append(rows.where(F.col("step") % 2 == batch), path, batch)
    return metrics.read(t.spark, path)


@query("S10 S11", "SELECT page_id AS id, url, md5(html) AS html FROM pages")
def store_parts(t: Tables) -> DataFrame:
    """Pages written to a store of SQLite files by ranges, and read back by others."""
    path = _folder(t, "pages")
    pages = t.pages.select(F.col("page_id").cast("bigint").alias("id"), "url", "html", F.lit(None).cast("string").alias("visuals"))
    store.write_sqlite(pages, path, parts=6)
    return t.spark.read.format("sqlite_pages").option("parts", 4).load(path).select("id", "url", F.md5("html").alias("html"))


@query("V9", "WITH b AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) AS n, o_orderstatus = 'P' AS bad FROM orders), f AS (SELECT o_orderkey, n FROM b WHERE bad ORDER BY o_orderkey LIMIT 50) SELECT o_orderkey AS invalid, (SELECT max(n) FROM f) AS tested FROM f")
def first_invalid(t: Tables) -> DataFrame:
    """The first fifty orders in process, and the orders tested up to the last of them."""
    found, tested, _ = labels.first_invalid(t.orders, lambda own: own.select("o_orderkey", (F.col("o_orderstatus") != "P").alias("valid")), 50, "o_orderkey", 256)
    return t.spark.createDataFrame([(int(x), tested) for x in found], "invalid bigint, tested bigint")


@query("D28 V6", "SELECT n_regionkey::BIGINT AS page_id, '/nation[' || (n_nationkey + 1) || ']/customer[' || (c_custkey + 1) || ']' AS xpath, CASE WHEN c_acctbal < 0 THEN 'only first' ELSE 'value' END AS problem FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_acctbal < 0 OR c_acctbal > 9000")
def tree_differences(t: Tables) -> DataFrame:
    """Regions' trees of nations and customers against those without debtors, in which rich customers have another name."""
    nations = t.nation.select(F.col("n_regionkey").cast("bigint").alias("page_id"), "n_nationkey", F.concat(F.lit("/nation["), (F.col("n_nationkey") + 1).cast("string"), F.lit("]")).alias("up"))
    tops = nations.select("page_id", F.col("up").alias("xpath"), F.lit("").alias("value"), F.lit(0).alias("pos"), F.lit(0.0).alias("balance"))
    own = t.customer.join(nations, F.col("c_nationkey") == F.col("n_nationkey"))
    leaves = own.select("page_id", F.concat("up", F.lit("/customer["), (F.col("c_custkey") + 1).cast("string"), F.lit("]")).alias("xpath"), F.col("c_name").alias("value"), F.lit(0).alias("pos"), F.col("c_acctbal").cast("double").alias("balance"))
    rows = tops.unionByName(leaves)
    changed = rows.where("balance >= 0").withColumn("value", F.when(F.col("balance") > 9000, F.concat("value", F.lit("!"))).otherwise(F.col("value")))
    return structure.differences(structure.digested(rows), structure.digested(changed))[0]


@query("D28 V6 V8", dom_sql.DIFFERENCES)
def visuals_differences(t: Tables) -> DataFrame:
    """Pages' trees against their visuals by digests; below a node that has no visuals nothing more is told."""
    nodes = _nodes(t).select("page_id", "xpath", F.col("attrs")["id"].alias("value"), F.lit(0).alias("pos"))
    drawn = visuals.visual_rows(_visual_pages(t)).where("error is null").select("page_id", "xpath", F.col("attrs")["id"].alias("value"), F.lit(0).alias("pos"))
    return structure.differences(structure.digested(nodes), structure.digested(drawn))[0]
