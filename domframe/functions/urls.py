"""URL functions: normal form, ignore list, archive addresses, common prefixes and domains."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_PARTS = r"^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)([^?#]*)(\?[^#]*)?(#.*)?$"
ARCHIVE = "https://web.archive.org/web/"


def normalize_url(c: Column) -> Column:
    """Lower-case scheme and host, no default port, at least "/" as path; what is no absolute URL stays as it is."""
    scheme = F.lower(F.regexp_extract(c, _PARTS, 1))
    host = F.lower(F.regexp_extract(c, _PARTS, 2))
    host = F.when(scheme == "http", F.regexp_replace(host, ":80$", "")).when(scheme == "https", F.regexp_replace(host, ":443$", "")).otherwise(host)
    path = F.regexp_extract(c, _PARTS, 3)
    rest = F.concat(F.regexp_extract(c, _PARTS, 4), F.regexp_extract(c, _PARTS, 5))
    return F.when(scheme != "", F.concat(scheme, F.lit("://"), host, F.when(path == "", "/").otherwise(path), rest)).otherwise(c)


def urls_equal(a: Column, b: Column) -> Column:
    return normalize_url(a) == normalize_url(b)


def ignored(c: Column, prefixes: list[str], pattern: str | None = None) -> Column:
    """Whether the normal form begins with one of prefixes or matches pattern."""
    url = normalize_url(c)
    out = F.lit(False)
    for p in prefixes:
        out = out | url.startswith(p)
    return out | url.rlike(pattern) if pattern else out


def archive_url(timestamp: Column, url: Column) -> Column:
    return F.concat(F.lit(ARCHIVE), timestamp, F.lit("id_/"), url)


def parse_archive_url(c: Column) -> tuple[Column, Column]:
    """Timestamp and original URL; null where c is no archive address."""
    pattern = r"^https?://web\.archive\.org/web/(\d+)([a-z]+_)?/(.*)$"
    stamp, url = F.regexp_extract(c, pattern, 1), F.regexp_extract(c, pattern, 3)
    return F.when(stamp != "", stamp), F.when(stamp != "", url)


def archive_redirect(url: Column, chain: Column) -> Column:
    """The original address if url is an archive's and chain (addresses redirected before) holds just that address; else null."""
    _, original = parse_archive_url(normalize_url(url))
    return F.when((F.size(chain) == 1) & urls_equal(F.get(chain, F.lit(0)), original), original)


def host(c: Column) -> Column:
    return F.regexp_extract(c, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)


def short_domain(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(c, r"^www\.", ""), r"\.(com|co\.uk)$", "")


def common_prefix(a: Column, b: Column) -> Column:
    """Longest common prefix: of a group, that of its least and greatest member."""
    n = F.least(F.length(a), F.length(b))
    same = F.size(F.filter(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: (i <= n) & (F.substr(a, F.lit(1), i) == F.substr(b, F.lit(1), i))))
    return F.substr(a, F.lit(1), same)


def url_prefixes(pages: DataFrame, website: str = "website") -> DataFrame:
    """Common URL prefix and its host of each website, by one aggregation."""
    ends = pages.groupBy(website).agg(F.min("url").alias("_lo"), F.max("url").alias("_hi"))
    return ends.select(website, common_prefix(F.col("_lo"), F.col("_hi")).alias("prefix")).withColumn("domain", host(F.col("prefix")))
