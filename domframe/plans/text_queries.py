"""Text, URL and lexical HTML queries."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import text as tx
from ..functions import urls
from .registry import Tables, query

WS = tx.WS
#: One rewrite of the tokenizers in SQL.
BASIC = rf"list_filter(string_split(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(text), '([.,()!?$''])', ' \1 ', 'g'), '\"', '', 'g'), '<br />|[;:]', ' ', 'g'), '{WS}+', ' ', 'g'), ' '), lambda x: x <> '')"
BERT = r"list_filter(string_split(regexp_replace(regexp_replace(strip_accents(lower(regexp_replace(regexp_replace(text, '[\t\n\r]', ' ', 'g'), '[\p{Cc}\p{Cf}]', '', 'g'))), '([!-/:-@\[-`{-~\p{P}])', ' \1 ', 'g'), '[ \x{a0}\x{1680}\x{2000}-\x{200a}\x{202f}\x{205f}\x{3000}\x{2028}\x{2029}]+', ' ', 'g'), ' '), lambda x: x <> '')"
HOST = r"regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)"
NORMAL_URL = r"(lower(regexp_extract(url, '^([A-Za-z]+)://', 1)) || '://' || lower(" + HOST + r") || CASE WHEN regexp_extract(url, '^[A-Za-z]+://[^/?#]*([^?#]*)', 1) = '' THEN '/' ELSE regexp_extract(url, '^[A-Za-z]+://[^/?#]*([^?#]*)', 1) END || regexp_extract(url, '^[A-Za-z]+://[^/?#]*[^?#]*(\?[^#]*)?', 1) || regexp_extract(url, '(#.*)$', 1))"
PIECES = r"regexp_extract_all(regexp_replace(html, '(?s)<(script|style)[^>]*>.*?</(script|style)>', '', 'g'), '<[^>]*>|[^<]+')"


def pieces(html: str = "html"):
    """Tags and texts of a page in order, without the content of scripts and styles."""
    return F.regexp_extract_all(F.regexp_replace(html, r"(?s)<(script|style)[^>]*>.*?</(script|style)>", ""), F.lit("<[^>]*>|[^<]+"), F.lit(0))


@query("F1-F4", f"SELECT doc_id, md5(trim(regexp_replace(text, '{WS}+', ' ', 'g'))) AS normal, length(regexp_replace(text, '{WS}', '', 'g')) AS n_inked, regexp_full_match(text, '{WS}*') AS is_blank FROM documents")
def text_normalize(t: Tables) -> DataFrame:
    c = F.col("text")
    return t.documents.select("doc_id", F.md5(tx.normalize_node_text(c)).alias("normal"), F.length(tx.remove_whitespace(c)).cast("bigint").alias("n_inked"), tx.is_blank(c).alias("is_blank"))


@query("F5", f"SELECT doc_id, len({BASIC}) AS n_tokens, md5(array_to_string({BASIC}, ' ')) AS tokens FROM documents")
def basic_tokenize_counts(t: Tables) -> DataFrame:
    tokens = t.documents.select("doc_id", tx.basic_tokenize(F.col("text")).alias("tokens"))
    return tokens.select("doc_id", F.size("tokens").cast("bigint").alias("n_tokens"), F.md5(F.array_join("tokens", " ")).alias("tokens"))


@query("F6 F7", f"SELECT doc_id, len({BERT}) AS n_tokens, md5(array_to_string({BERT}, ' ')) AS tokens FROM documents")
def bert_tokenize_counts(t: Tables) -> DataFrame:
    tokens = t.documents.select("doc_id", tx.bert_tokenize(F.col("text")).alias("tokens"))
    return tokens.select("doc_id", F.size("tokens").cast("bigint").alias("n_tokens"), F.md5(F.array_join("tokens", " ")).alias("tokens"))


@query("F9", r"SELECT p_partkey, upper(left(h, 1)) || substr(h, 2) AS human FROM (SELECT p_partkey, regexp_replace(regexp_replace(lower(regexp_replace(regexp_replace(regexp_replace(p_type || 'Size-' || p_name || '_id', '([A-Z\d]+)([A-Z][a-z])', '\1_\2', 'g'), '([a-z\d])([A-Z])', '\1_\2', 'g'), '-', '_', 'g')), '_id$', ''), '_', ' ', 'g') AS h FROM part)")
def humanize_names(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", tx.humanize(F.concat("p_type", F.lit("Size-"), "p_name", F.lit("_id"))).alias("human"))


@query("F17", "SELECT page_id, regexp_replace(regexp_replace(lower(strip_accents(url)), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug FROM pages")
def slugify_urls(t: Tables) -> DataFrame:
    return t.pages.select("page_id", tx.slug(F.col("url")).alias("slug"))


@query("F27 F28 F19", "SELECT event_id, CASE WHEN s >= 86400 THEN (s // 86400)::VARCHAR || 'd ' ELSE '' END || printf('%02d:%02d:%02d', s % 86400 // 3600, s % 3600 // 60, s % 60) AS took, 'page-' || event_id::VARCHAR || '-full.png' AS shot FROM (SELECT event_id, event_id * 977 AS s FROM events)")
def durations(t: Tables) -> DataFrame:
    name = F.concat(F.lit("page-"), F.col("event_id").cast("string"), F.lit(".htm"))
    return t.events.select("event_id", tx.duration(F.col("event_id") * 977).alias("took"), tx.add_suffix(tx.replace_extension(name, ".png"), "-full").alias("shot"))


@query("F25", "SELECT doc_id, sha256(text) AS sha, md5(base64(encode(text))) AS coded, coalesce(try_cast(regexp_extract(source, '([0-9]+)$', 1) AS BIGINT), -1) AS n FROM documents")
def hashes_and_codes(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.sha2("text", 256).alias("sha"), F.md5(F.regexp_replace(F.base64(F.encode("text", "UTF-8")), "[\r\n]", "")).alias("coded"), tx.int_or(F.regexp_extract("source", r"([0-9]+)$", 1), -1).alias("n"))


@query("O5 O9 F25", "SELECT source, row_number() OVER (ORDER BY regexp_extract(source, '^([^0-9]*)', 1), CAST(regexp_extract(source, '([0-9]+)$', 1) AS BIGINT)) AS place FROM (SELECT DISTINCT source FROM documents)")
def natural_order(t: Tables) -> DataFrame:
    return t.documents.select("source").distinct().select("source", F.row_number().over(W.orderBy(tx.natural_key(F.col("source")))).cast("bigint").alias("place"))


@query("F21", f"SELECT page_id, {NORMAL_URL} AS normal FROM pages")
def url_normalize(t: Tables) -> DataFrame:
    return t.pages.select("page_id", urls.normalize_url(F.col("url")).alias("normal"))


@query("F22", "SELECT page_id, 'https://web.archive.org/web/20110601000000id_/' || url AS archived, '20110601000000' AS stamp, url AS original FROM pages")
def archive_urls(t: Tables) -> DataFrame:
    archived = urls.archive_url(F.lit("20110601000000"), F.col("url"))
    stamp, original = urls.parse_archive_url(archived)
    return t.pages.select("page_id", archived.alias("archived"), stamp.alias("stamp"), original.alias("original"))


@query("P19 P20", f"SELECT {HOST} AS host, count(*) AS pages, count(*) FILTER (WHERE url LIKE '%utm_%' OR starts_with({HOST}, 'm.')) AS ignored FROM pages GROUP BY 1")
def url_ignore_filter(t: Tables) -> DataFrame:
    ignored = urls.ignored(F.col("url"), ["http://m.", "https://m."], "utm_")
    return t.pages.groupBy(urls.host(F.col("url")).alias("host")).agg(F.count("*").alias("pages"), F.count_if(ignored).alias("ignored"))


@query("D31 A17 S24", f"SELECT website, substr(lo, 1, len(list_filter(range(1, least(length(lo), length(hi)) + 1), lambda i: substr(lo, 1, i) = substr(hi, 1, i)))) AS prefix FROM (SELECT {HOST} AS website, min(url) AS lo, max(url) AS hi FROM pages GROUP BY 1)")
def url_common_prefix(t: Tables) -> DataFrame:
    return urls.url_prefixes(t.pages.withColumn("website", urls.host(F.col("url")))).select("website", "prefix")


@query("D31 F24", f"SELECT regexp_replace(regexp_replace({HOST}, '^www\\.', ''), '\\.(com|co\\.uk)$', '') AS domain, count(*) AS pages FROM pages GROUP BY 1")
def url_domain_counts(t: Tables) -> DataFrame:
    return t.pages.groupBy(urls.short_domain(urls.host(F.col("url"))).alias("domain")).agg(F.count("*").alias("pages"))


@query("P8 D1 A23", rf"SELECT tag, count(*) AS n, count(DISTINCT page_id) AS pages FROM (SELECT page_id, regexp_extract(piece, '^<([a-z0-9]+)', 1) AS tag FROM (SELECT page_id, unnest({PIECES}) AS piece FROM pages)) WHERE tag <> '' GROUP BY tag")
def html_lexical_tags(t: Tables) -> DataFrame:
    tags = t.pages.select("page_id", F.explode(pieces()).alias("piece")).select("page_id", F.regexp_extract("piece", "^<([a-z0-9]+)", 1).alias("tag"))
    return tags.where("tag <> ''").groupBy("tag").agg(F.count("*").alias("n"), F.count_distinct("page_id").alias("pages"))


@query("P10 F3", rf"SELECT page_id, count(*) AS fragments, sum(length(f))::BIGINT AS chars FROM (SELECT page_id, trim(regexp_replace(piece, '{WS}+', ' ', 'g')) AS f FROM (SELECT page_id, unnest({PIECES}) AS piece FROM pages) WHERE NOT starts_with(piece, '<')) WHERE f <> '' GROUP BY page_id")
def html_text_fragments(t: Tables) -> DataFrame:
    f = t.pages.select("page_id", F.explode(pieces()).alias("piece")).where(~F.col("piece").startswith("<")).select("page_id", tx.normalize_node_text(F.col("piece")).alias("f"))
    return f.where("f <> ''").groupBy("page_id").agg(F.count("*").alias("fragments"), F.sum(F.length("f")).cast("bigint").alias("chars"))


VARIABLE_SQL = rf"""
WITH p AS (SELECT page_id, {HOST} AS website, list_filter(list_transform(list_filter({PIECES}, lambda x: NOT starts_with(x, '<')), lambda x: trim(regexp_replace(x, '{WS}+', ' ', 'g'))), lambda x: x <> '') AS f FROM pages),
e AS (SELECT website, page_id, unnest(range(1, len(f) + 1)) AS place, unnest(f) AS fragment FROM p),
s AS (SELECT website, place, count(DISTINCT fragment) AS texts FROM e GROUP BY ALL)
SELECT website, place, texts FROM (SELECT *, row_number() OVER (PARTITION BY website ORDER BY texts DESC, place) AS rn FROM s WHERE texts > 5) WHERE rn <= 300
"""


@query("D26 A4 O1 P14", VARIABLE_SQL)
def variable_fragments(t: Tables) -> DataFrame:
    """Places of a website whose text differs between its pages."""
    clean = F.filter(F.transform(F.filter(pieces(), lambda x: ~x.startswith("<")), tx.normalize_node_text), lambda x: x != "")
    e = t.pages.select("page_id", urls.host(F.col("url")).alias("website"), F.posexplode(clean).alias("place", "fragment"))
    s = e.groupBy("website", (F.col("place") + 1).cast("bigint").alias("place")).agg(F.count_distinct("fragment").alias("texts")).where("texts > 5")
    w = W.partitionBy("website").orderBy(F.col("texts").desc(), "place")
    return s.withColumn("rn", F.row_number().over(w)).where("rn <= 300").drop("rn")
