"""Requests of a crawl as tables: what answers each, which are refused, and the archived capture nearest to a wanted time."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.urls import ignored, normalize_url, parse_archive_url

#: Requests of one URL, and of one page, that are handled before the page is given up (fixed values).
SAME_URL, SAME_PAGE = 10, 1000


def guarded(requests: DataFrame, refused: Column, by: str = "page_id", order: str = "request_id", same_url: int = SAME_URL, same_page: int = SAME_PAGE) -> DataFrame:
    """requests(by, order, url) with normal_url and guard: null, "url" or "page" from the request on that exceeds a limit.

    refused: requests that are turned away before they count. All requests after a page's first offence have its guard.
    """
    counted = requests.withColumn("normal_url", normalize_url(F.col("url"))).withColumn("_counts", (~refused).cast("int"))
    same, every = W.partitionBy(by, "normal_url").orderBy(order), W.partitionBy(by).orderBy(order)
    upto = lambda w: F.sum("_counts").over(w.rowsBetween(W.unboundedPreceding, 0))
    offence = F.when((F.col("_counts") == 1) & (F.col("_url") > same_url), "url").when((F.col("_counts") == 1) & (F.col("_page") > same_page), "page")
    marked = counted.withColumn("_url", upto(same)).withColumn("_page", upto(every)).withColumn("_offence", offence)
    first = F.first("_offence", ignorenulls=True).over(every.rowsBetween(W.unboundedPreceding, 0))
    return marked.withColumn("guard", first).drop("_counts", "_url", "_page", "_offence")


def routed(requests: DataFrame, pages: DataFrame, assets: DataFrame, prefixes: list[str], pattern: str | None = None, by: str = "page_id", order: str = "request_id", offline: bool = True, same_url: int = SAME_URL, same_page: int = SAME_PAGE) -> DataFrame:
    """requests(by, order, url) with normal_url and route, by the first of these that fits:

    ignored (URL list), closed (a guard has closed the page), page or archived_page (the page's own address, by offline),
    local (file), aborted or cached (known to assets(url, body)), redirect (an archive's own address), live.
    pages(by, page_url).
    """
    refused = ignored(F.col("url"), prefixes, pattern)
    return answered(guarded(requests, refused, by, order, same_url, same_page), refused, pages, assets, by, offline).select(*requests.columns, "normal_url", "route")


def answered(known: DataFrame, refused: Column, pages: DataFrame, assets: DataFrame, by: str = "page_id", offline: bool = True) -> DataFrame:
    """known(by, url, normal_url, guard) with route, as routed() has it; known may be a stream, beside which the tables stand."""
    own = pages.select(by, normalize_url(F.col("page_url")).alias("_own"))
    held = assets.groupBy(normalize_url(F.col("url")).alias("normal_url")).agg(F.count("body").alias("_bodies"), F.lit(True).alias("_held"))
    out = known.join(own, by, "left").join(held, "normal_url", "left")
    stamp, _ = parse_archive_url(F.col("url"))
    route = (
        F.when(refused, "ignored").when(F.col("guard").isNotNull(), "closed").when(F.col("normal_url") == F.col("_own"), "page" if offline else "archived_page").when(F.col("normal_url").startswith("file://"), "local")
        .when(F.col("_held") & (F.col("_bodies") == 0), "aborted").when(F.col("_held"), "cached").when(stamp.isNotNull(), "redirect").otherwise("live")
    )
    return out.select(*known.columns, route.alias("route"))


def nearest_capture(requests: DataFrame, captures: DataFrame, on: str, at: str, tie: str) -> DataFrame:
    """requests with capture and captured: tie and at of the capture of the same key that is nearest in time.

    Of two equally near the earlier counts, of several at one time the least `tie`; null without any capture. Both sides
    are laid on one line of time for each key, so that each request looks only at its neighbours there.
    """
    one = captures.groupBy(on, at).agg(F.min(tie).alias("_tie"))
    line = requests.withColumn("_side", F.lit(1)).withColumn("_tie", F.lit(None).cast(dict(captures.dtypes)[tie]))
    both = line.unionByName(one.withColumn("_side", F.lit(0)), allowMissingColumns=True)
    hit = F.when(F.col("_side") == 0, F.struct(F.col(at).alias("at"), F.col("_tie").alias("tie")))
    before = F.last(hit, ignorenulls=True).over(W.partitionBy(on).orderBy(at, "_side").rowsBetween(W.unboundedPreceding, 0))
    after = F.first(hit, ignorenulls=True).over(W.partitionBy(on).orderBy(at, "_side").rowsBetween(0, W.unboundedFollowing))
    found = both.withColumn("_b", before).withColumn("_a", after).where("_side = 1")
    gap = lambda c: F.abs(F.unix_micros(F.col(f"{c}.at").cast("timestamp")) - F.unix_micros(F.col(at).cast("timestamp")))
    best = F.when(F.col("_b").isNull() | (gap("_a") < gap("_b")), F.col("_a")).otherwise(F.col("_b"))
    return found.withColumn("_best", best).select(*requests.columns, F.col("_best.tie").alias("capture"), F.col("_best.at").alias("captured"))
