"""Page corpora: a folder of HTML files with tab-separated ground truth, and JSON records with selectors."""
import html
import re

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Verticals and websites that are left out (fixed values).
EXCLUDED_VERTICALS, EXCLUDED_WEBSITES = ("movie",), (("job", "careerbuilder"),)
_BASE = r'^<base href="([^\n]*)"/>$'


def read_html_folder(spark: SparkSession, root: str, suffix: str = "", verticals: list[str] | None = None, websites: list[str] | None = None) -> DataFrame:
    """vertical, website, page_count, page_index, url, html of files <vertical>/<vertical>-<site>(<count>)/NNNN<suffix>.htm.

    The first line is a base element with the page's URL; a byte-order mark goes. Files that lack it get a file URL.
    """
    files = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", f"*{suffix}.htm").text(root, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.regexp_replace("value", "^﻿", "").alias("content"))
    path = F.url_decode(F.regexp_replace("path", r"\+", "%2B"))
    pattern = r"/([^/]+)/\1-([^/(]+)\((\d+)\)/(\d{4})(-[^/.]+)?\.htm$"
    parts = files.withColumn("p", path).select("*", *[F.regexp_extract("p", pattern, k).alias(n) for k, n in enumerate(("vertical", "website", "page_count", "page_index", "suffix"), 1)])
    first = F.regexp_replace(F.substring_index("content", "\n", 1), "\r$", "")
    url = F.regexp_extract(first, _BASE, 1)
    html = F.when(first.rlike(_BASE), F.substr("content", F.length(F.substring_index("content", "\n", 1)) + 2)).otherwise(F.col("content"))
    out = parts.where((F.col("website") != "") & (F.col("suffix") == suffix)).select("vertical", "website", F.col("page_count").cast("int"), F.col("page_index").cast("int"), F.when(url != "", url).otherwise(F.col("path")).alias("url"), html.alias("html"))
    out = out.where(~F.col("vertical").isin(*EXCLUDED_VERTICALS))
    for v, w in EXCLUDED_WEBSITES:
        out = out.where(~((F.col("vertical") == v) & (F.col("website") == w)))
    if verticals:
        out = out.where(F.col("vertical").isin(*verticals))
    return out.where(F.col("website").isin(*websites)) if websites else out


def website_folders(spark: SparkSession, root: str) -> DataFrame:
    """vertical, website, page_count, files, agrees of the folders <vertical>/<vertical>-<site>(<count>), empty ones too, sorted."""
    top = spark._jvm.org.apache.hadoop.fs.Path(root)
    fs = top.getFileSystem(spark._jsc.hadoopConfiguration())
    rows = []
    for folder in fs.globStatus(spark._jvm.org.apache.hadoop.fs.Path(root, "*/*-*(*)")) or []:
        vertical, name = folder.getPath().getParent().getName(), folder.getPath().getName()
        m = re.fullmatch(re.escape(vertical) + r"-([^(]+)\((\d+)\)", name)
        if m and folder.isDirectory():
            files = sum(1 for f in fs.listStatus(folder.getPath()) if re.fullmatch(r"\d{4}\.htm", f.getPath().getName()))
            rows.append((vertical, m[1], int(m[2]), files, files == int(m[2])))
    return spark.createDataFrame(sorted(rows), "vertical string, website string, page_count int, files int, agrees boolean")


def page_files(spark: SparkSession, source: str) -> list[str]:
    """Sorted paths: the lines of a list file (.txt), or what a pattern matches."""
    if source.endswith(".txt"):
        return sorted(r["value"] for r in spark.read.text(source).where("value <> ''").collect())
    pattern = spark._jvm.org.apache.hadoop.fs.Path(source)
    return sorted(f.getPath().toString() for f in pattern.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(pattern) or [])


def selected(sites: DataFrame, verticals: list[str] | None = None, websites: list[str] | None = None, excluded: list[str] | None = None, prefix: bool = False) -> DataFrame:
    """Rows of sites(vertical, website, ...) of the listed verticals and websites but the excluded; prefix: websites begin with a listed one."""
    out = sites.where(F.col("vertical").isin(*verticals)) if verticals is not None else sites
    if websites is not None:
        fits = F.lit(False)
        for w in websites:
            fits = fits | (F.col("website").startswith(w) if prefix else F.col("website") == w)
        out = out.where(fits)
    return out.where(~F.col("website").isin(*excluded)) if excluded else out


def parse_ground_truth(lines: DataFrame) -> DataFrame:
    """vertical, website, label_key, page_index, values of lines(path, line_no, value); a wrong count fails the query."""
    cells = F.split("value", "\t")
    head = lines.where("line_no = 0").select("path", *[F.get(cells, F.lit(k)).alias(n) for k, n in enumerate(("vertical", "website", "label_key"))])
    rows = lines.where("line_no >= 2 and value <> ''").select("path", "line_no", F.get(cells, F.lit(0)).cast("int").alias("page_index"), F.get(cells, F.lit(1)).cast("int").alias("n"), F.slice(cells, 3, 1 << 20).alias("all"))
    values = F.when((F.size("all") == 1) & (F.get("all", F.lit(0)) == "<NULL>"), F.array().cast("array<string>")).otherwise(F.col("all"))
    wrong = F.when((F.size(values) != F.col("n")) | (F.col("page_index") != F.col("line_no") - 2), F.raise_error(F.concat(F.lit("ground truth does not agree: "), F.col("path"))))
    checked = rows.select("path", "page_index", F.coalesce(wrong.cast("array<string>"), values).alias("values"))
    return checked.join(head, "path").select("vertical", "website", "label_key", "page_index", unescaped("values").alias("values"))


def unescaped(values: str):
    """HTML entities of label values as characters."""

    @F.pandas_udf("array<string>")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda v: None if v is None else [html.unescape(x) for x in v])

    return run(F.col(values))


def read_ground_truth(spark: SparkSession, path: str) -> DataFrame:
    text = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.txt").text(path, wholetext=True)
    lines = text.select(F.col("_metadata.file_path").alias("path"), F.posexplode(F.split("value", "\r?\n")).alias("line_no", "value"))
    return parse_ground_truth(lines)


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """Records of an array of JSON objects."""
    return spark.read.option("multiLine", True).json(path)


def label_keys(records: DataFrame) -> list[str]:
    return sorted(c.removeprefix("selector_") for c in records.columns if c.startswith("selector_"))


def slim(records: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """url, selectors and the value columns that belong to them, of the requested keys."""
    keys = [k for k in label_keys(records) if keys is None or k in keys]
    return records.select("url", *[c for k in keys for c in (k, f"selector_{k}") if c in records.columns])


def record_labels(records: DataFrame) -> DataFrame:
    """url, label_key, selector, value, valid: an empty selector means no label, and its value must be empty."""
    entries = F.array(*[F.struct(F.lit(k).alias("label_key"), F.col(f"selector_{k}").cast("string").alias("selector"), F.col(k).cast("string").alias("value")) for k in label_keys(records)])
    e = records.select("url", F.explode(entries).alias("e")).select("url", "e.*")
    absent = F.coalesce(F.col("selector"), F.lit("")) == ""
    return e.withColumn("valid", ~absent | (F.coalesce("value", F.lit("")) == "")).where(~absent | ~F.col("valid"))


def patched_records(df: DataFrame, rules: list[tuple[str, str, str]]) -> DataFrame:
    """Rewrites by (column, pattern, replacement), one after the other."""
    for column, pattern, replacement in rules:
        df = df.withColumn(column, F.regexp_replace(column, pattern, replacement))
    return df


def resolved(pages: DataFrame, *others: DataFrame) -> DataFrame:
    """pages(url, html) filled from other tables(url, html), the first that has it wins."""
    out = pages
    for i, o in enumerate(others):
        out = out.join(o.select("url", F.col("html").alias(f"_h{i}")), "url", "left")
    return out.withColumn("html", F.coalesce("html", *[f"_h{i}" for i in range(len(others))])).drop(*[f"_h{i}" for i in range(len(others))])
