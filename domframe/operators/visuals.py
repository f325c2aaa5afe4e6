"""Rendered attributes of nodes from recursive JSON, joined by XPath."""
from __future__ import annotations

import json
import re
from collections.abc import Iterator
from xml.sax.saxutils import quoteattr

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


#: Characters that XML texts may not hold.
_INVALID = re.compile("[^\t\n\r\x20-\ud7ff\ue000-\ufffd\U00010000-\U0010ffff]")


def _pairs(entries) -> list[tuple[str, str]]:
    """Keys and values of a map's entries as they reach a task."""
    return [(e["key"], e["value"]) for e in entries]


def flatten(visuals: str | None) -> list[tuple[str, list[float] | None, dict[str, str]]]:
    """XPath, box and other attributes of each element of a visuals text; keys that begin with / are children."""
    out = []
    stack = [("", json.loads(visuals))] if visuals else []
    while stack:
        path, here = stack.pop()
        attrs = {k: v if isinstance(v, str) else json.dumps(v) for k, v in here.items() if not k.startswith("/") and k != "box"}
        if path:
            out.append((path, [float(x) for x in here["box"]] if here.get("box") else None, attrs))
        stack += [(path + k, v) for k, v in here.items() if k.startswith("/") and isinstance(v, dict)]
    return out


def visual_rows(pages: DataFrame, key: str = "page_id") -> DataFrame:
    """key, xpath, box, attrs, error of pages(key, visuals); unreadable JSON gives one row with its error."""
    kind = "bigint" if key == "page_id" else dict(pages.dtypes)[key]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for page_id, text in zip(batch[key], batch["visuals"], strict=True):
                try:
                    rows += [(page_id, x, dict(zip("xywh", b, strict=True)) if b else None, a, None) for x, b, a in flatten(text)]
                except (ValueError, AttributeError, TypeError) as e:
                    rows.append((page_id, None, None, None, str(e)))
            yield pd.DataFrame(rows, columns=[key, "xpath", "box", "attrs", "error"])

    return pages.select(F.col(key).cast(kind), "visuals").mapInPandas(run, f"{key} {kind}, xpath string, box struct<x:double,y:double,w:double,h:double>, attrs map<string,string>, error string")


def attached(nodes: DataFrame, visuals: DataFrame, key: str = "page_id") -> DataFrame:
    """nodes with box and style attributes; a text fragment has its parent's style and its own box. Missing ones are null."""
    v = visuals.where("error is null").select(key, "xpath", "box", F.col("attrs").alias("style"))
    of = v.select(key, F.col("xpath").alias("_of"), "style")
    owner = F.when(F.col("is_text"), F.regexp_replace("xpath", r"/[^/]*$", "")).otherwise(F.col("xpath"))
    return nodes.withColumn("_of", owner).join(v.select(key, "xpath", "box"), [key, "xpath"], "left").join(of, [key, "_of"], "left").drop("_of")


def sought(nodes: DataFrame, visuals: DataFrame, gold: DataFrame | None = None) -> DataFrame:
    """nodes with a box only, as neighbours need it; gold(page_id, node_id) ones without a box stay."""
    held = attached(nodes, visuals)
    if gold is None:
        return held.where("box is not null")
    wanted = gold.select("page_id", "node_id").distinct().withColumn("_gold", F.lit(True))
    return held.join(wanted, ["page_id", "node_id"], "left").where(F.col("box").isNotNull() | F.col("_gold")).drop("_gold")


def projected(visuals: DataFrame, enabled: list[str] | None = None, disabled: list[str] | None = None) -> DataFrame:
    """visuals with the enabled attributes only (null: all), without the disabled ones."""
    keep = F.lit(True)
    wanted = lambda k: (k.isin(*enabled) if enabled is not None else keep) & ~(k.isin(*disabled) if disabled else F.lit(False))
    return visuals.withColumn("attrs", F.map_filter("attrs", lambda k, _: wanted(k)))


def as_xml(blend: DataFrame, path: str, key: str = "page_id") -> DataFrame:
    """key and xml: one element for each row of blended() in document order (rows without a node last), with its attributes; written to path as text.

    The rows of a page are one document's. Names that XML does not allow have "_" in place of other characters.
    """
    escape = lambda c: F.replace(F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;")), F.lit('"'), F.lit("&quot;"))
    name = lambda c: F.regexp_replace(F.regexp_replace(c, r"[^A-Za-z0-9_.-]", "_"), r"^(?=[^A-Za-z_])", "_")
    box = F.when(F.col("box").isNotNull(), F.concat(F.lit(' _box="'), F.concat_ws(" ", *[F.col(f"box.{c}").cast("string") for c in "xywh"]), F.lit('"'))).otherwise("")
    attrs = F.array_join(F.transform(F.array_sort(F.map_entries("attrs")), lambda e: F.concat(F.lit(" "), name(e["key"]), F.lit('="'), escape(e["value"]), F.lit('"'))), "")
    element = F.concat(F.lit('  <node xpath="'), escape(F.col("xpath")), F.lit('"'), box, attrs, F.when(F.col("text").isNotNull(), F.concat(F.lit(">"), escape(F.col("text")), F.lit("</node>"))).otherwise("/>"))
    rows = blend.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col("node_id").isNull().alias("none"), "node_id", "xpath", element.alias("e")))), lambda x: x["e"]), "\n").alias("body"))
    out = rows.select(key, F.concat(F.lit('<page id="'), F.col(key).cast("string"), F.lit('">\n'), F.col("body"), F.lit("\n</page>")).alias("xml"))
    out.select("xml").write.mode("overwrite").text(path)
    return out


def mismatches(nodes: DataFrame, visuals: DataFrame, ignored: tuple[str, ...] = ("script", "style", "head", "noscript", "iframe", "svg")) -> DataFrame:
    """page_id, xpath, problem: nodes without visuals, unused visuals (but of ignored elements), and unlike ids."""
    n = nodes.select("page_id", "xpath", F.col("attrs")["id"].alias("node_attr_id"), F.lit(True).alias("_n"))
    v = visuals.select("page_id", "xpath", F.col("attrs")["id"].alias("visual_id"), F.lit(True).alias("_v"))
    both = n.join(v, ["page_id", "xpath"], "full")
    skipped = F.col("xpath").rlike(r"/(" + "|".join(ignored) + r")(\[\d+\])?(/|$)")
    problem = F.when(F.col("_v").isNull(), "no visuals").when(F.col("_n").isNull() & ~skipped, "unused").when(F.col("visual_id").isNotNull() & F.col("node_attr_id").isNotNull() & (F.col("visual_id") != F.col("node_attr_id")), "id differs")
    return both.select("page_id", "xpath", problem.alias("problem")).where("problem is not null")


def blended(nodes: DataFrame, visuals: DataFrame) -> DataFrame:
    """One row for each XPath of either side: the node's tag and attributes with style attributes under "_" + name ("__" if taken)."""
    node = F.col("node_id") if "node_id" in nodes.columns else F.lit(None).cast("int").alias("node_id")
    n = nodes.select("page_id", "xpath", node, "tag", "text", F.col("attrs").alias("html_attrs"))
    v = visuals.where("error is null").select("page_id", "xpath", "box", F.col("attrs").alias("style"))
    both = n.join(v, ["page_id", "xpath"], "full")
    own = F.coalesce("html_attrs", F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>")))
    style = F.coalesce("style", F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>")))
    named = F.transform_keys(style, lambda k, _: F.concat(F.when(F.map_contains_key(own, F.concat(F.lit("_"), k)), "__").otherwise("_"), k))
    return both.select("page_id", "xpath", "tag", "text", "box", F.map_concat(own, named).alias("attrs"), "node_id", F.col("style").isNotNull().alias("styled"))


def nested_xml(blend: DataFrame, path: str | None = None, key: str = "page_id") -> DataFrame:
    """key and xml of blended() rows: elements nested as in the page, of nodes that both sides have, down from the root.

    Visuals are attributes under "_" and their name, boxes under _box; a text fragment is an element text with _text. A node
    that one side lacks goes with all below it, and so do svg and noscript. With path, written there as text. The rows of a
    page are one document's.
    """

    def name(text: str) -> str:
        own = re.sub(r"[^A-Za-z0-9_.-]", "_", text)
        return own if own[:1].isalpha() or own[:1] == "_" else f"_{own}"

    def build(rows: list[dict]) -> str:
        out, open_ = [], []
        for r in rows:
            steps = r["xpath"].split("/")[1:]
            while len(open_) >= len(steps):
                out.append(f"</{open_.pop()[1]}>")
            if [x for x, _ in open_] != steps[:-1] or r["tag"] in ("svg", "noscript"):
                continue  # something above is left out
            tag = "text" if r["tag"] == "-text" else name(r["tag"])
            attrs = {k: v for k, v in _pairs(r["attrs"]) if k not in ("_id", "_whiteSpace")} | ({"_box": " ".join(f"{r['box'][c]:g}" for c in "xywh")} if r["box"] else {}) | ({"_text": r["text"]} if r["tag"] == "-text" else {})
            out.append(f"<{tag}" + "".join(f" {name(k)}={quoteattr(_INVALID.sub('', v))}" for k, v in sorted(attrs.items())) + ">")
            open_.append((steps[-1], tag))
        return "".join(out) + "".join(f"</{t}>" for _, t in reversed(open_))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({key: batch[key], "xml": [build(list(rows)) for rows in batch["rows"]]})

    kind = dict(blend.dtypes)[key]
    rows = blend.where("styled and node_id is not null").groupBy(key).agg(F.array_sort(F.collect_list(F.struct("node_id", "xpath", "tag", "text", "box", F.map_entries("attrs").alias("attrs")))).alias("rows"))
    out = rows.mapInPandas(run, f"{key} {kind}, xml string")
    if path:
        out.select("xml").write.mode("overwrite").text(path)
    return out


def nested_json(visuals: DataFrame, key: str = "page_id") -> DataFrame:
    """key and visuals: the recursive JSON text that visual_rows() has read, from its rows; attributes before children."""

    def build(rows: list[dict]) -> str:
        top: dict = {}
        for r in rows:
            here = top
            for step in r["xpath"].split("/")[1:]:
                here = here.setdefault(f"/{step}", {})
            here |= ({"box": [r["box"][c] for c in "xywh"]} if r["box"] else {}) | {k: json.loads(v) if v[:1] in "[{" or v in ("true", "false", "null") else v for k, v in sorted(_pairs(r["attrs"]))}
        return json.dumps(top)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({key: batch[key], "visuals": [build(list(rows)) for rows in batch["rows"]]})

    kind = dict(visuals.dtypes)[key]
    rows = visuals.where("error is null").groupBy(key).agg(F.array_sort(F.collect_list(F.struct("xpath", "box", F.map_entries("attrs").alias("attrs")))).alias("rows"))
    return rows.mapInPandas(run, f"{key} {kind}, visuals string")
