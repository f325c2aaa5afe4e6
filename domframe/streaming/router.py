"""Routing of a live stream of requests: state for each page counts its requests, and each asset is fetched once at a time.

A stream gives the same routes as operators.routing.routed() over all its requests, however they are cut into batches, if
a page's requests come in order from batch to batch. Streams with state need the RocksDB state store provider.
"""
from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions.urls import ignored, normalize_url
from ..operators.routing import SAME_PAGE, SAME_URL, answered

#: The setting that streams with state need.
PROVIDER = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
_GUARDED = "page_id bigint, request_id bigint, url string, normal_url string, refused boolean, guard string"


class _Guard(StatefulProcessor):
    """Of each page: requests that counted, by URL and in all, until an offence closes it; then only the offence is kept."""

    def __init__(self, same_url: int, same_page: int):
        self.same_url, self.same_page = same_url, same_page

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.total = handle.getValueState("total", "n bigint, guard string")
        self.by_url = handle.getMapState("urls", "url string", "n bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        n, guard = self.total.get() if self.total.exists() else (0, None)
        batch = pd.concat(list(rows)).sort_values("request_id", kind="stable")
        guards = []
        for url, refused in zip(batch["normal_url"], batch["refused"], strict=True):
            if guard is None and not refused:
                seen = (self.by_url.getValue((url,))[0] if self.by_url.containsKey((url,)) else 0) + 1
                n += 1
                guard = "url" if seen > self.same_url else "page" if n > self.same_page else None
                if guard is None:
                    self.by_url.updateValue((url,), (seen,))
                else:
                    self.by_url.clear()
            guards.append(guard)
        self.total.update((n, guard))
        yield batch.assign(guard=pd.Series(guards, index=batch.index, dtype=object))[[c.split(" ")[0] for c in _GUARDED.split(", ")]]

    def close(self) -> None:
        pass


def routed_stream(requests: DataFrame, pages: DataFrame, assets: DataFrame, prefixes: list[str], pattern: str | None = None, offline: bool = True, same_url: int = SAME_URL, same_page: int = SAME_PAGE) -> DataFrame:
    """page_id, request_id, url, normal_url, route of the stream requests(page_id, request_id, url); the others are tables."""
    refused: Column = F.coalesce(ignored(F.col("url"), prefixes, pattern), F.lit(False))
    own = requests.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("request_id").cast("bigint").alias("request_id"), "url", normalize_url(F.col("url")).alias("normal_url"), refused.alias("refused"))
    known = own.groupBy("page_id").transformWithStateInPandas(statefulProcessor=_Guard(same_url, same_page), outputStructType=_GUARDED, outputMode="Append", timeMode="None")
    return answered(known, F.col("refused"), pages, assets, "page_id", offline).select("page_id", "request_id", "url", "normal_url", "route")


_FETCH = "timestamp string, url string, request_id bigint, asked_ms bigint, fetch boolean, of_request bigint"


class _InFlight(StatefulProcessor):
    """Of each asset: the request that fetches it, and until when others wait for that one."""

    def __init__(self, lasting_ms: int):
        self.lasting = lasting_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.fetch = handle.getValueState("fetch", "request_id bigint, until_ms bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        now = self.fetch.get() if self.fetch.exists() else None
        batch = pd.concat(list(rows)).sort_values(["asked_ms", "request_id"], kind="stable")
        fetch, of = [], []
        for request, asked in zip(batch["request_id"].tolist(), batch["asked_ms"].tolist(), strict=True):
            first = now is None or asked >= now[1]
            if first:
                now = (request, asked + self.lasting)
            fetch.append(first)
            of.append(now[0])
        self.fetch.update(now)
        yield batch.assign(fetch=fetch, of_request=of)[[c.split(" ")[0] for c in _FETCH.split(", ")]]

    def close(self) -> None:
        pass


def fetched_once(requests: DataFrame, lasting_ms: int) -> DataFrame:
    """requests(timestamp, url, request_id, asked_ms) with fetch, and of_request: the request whose fetch answers it.

    Of the requests for one asset the first fetches it, those within lasting_ms after that wait for it, and a later one
    fetches it again.
    """
    own = requests.select("timestamp", "url", F.col("request_id").cast("bigint").alias("request_id"), F.col("asked_ms").cast("bigint").alias("asked_ms"))
    return own.groupBy("timestamp", "url").transformWithStateInPandas(statefulProcessor=_InFlight(lasting_ms), outputStructType=_FETCH, outputMode="Append", timeMode="None")
