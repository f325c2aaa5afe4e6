"""Joins, aggregations, windows, sets, samples and evaluation on the relational tables."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import visual
from ..functions.text import basic_tokenize
from ..operators import evaluate, features, routing
from ..operators import relational as rel
from ..sources import corpora, store
from ..sources.scratch import written
from .registry import Tables, query
from .text_queries import BASIC

TYPES = "['buy', 'cart', 'click', 'error', 'login', 'logout', 'purchase', 'refund', 'search', 'signup', 'view']"


# joins and sets


@query("J8 P7 J5", "SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')")
def semi_list(t: Tables) -> DataFrame:
    listed = t.orders.where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey"))
    return rel.restrict(t.customer, listed, "c_custkey").select("c_custkey", "c_name")


@query("J8 P21 P16", "SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')")
def anti_existing(t: Tables) -> DataFrame:
    return rel.missing(t.customer, t.orders.where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey")), "c_custkey").select("c_custkey", "c_name")


@query("J10", "SELECT l_suppkey FROM (SELECT unnest(range(lo, hi + 1)) AS l_suppkey FROM (SELECT min(l_suppkey * 3) AS lo, max(l_suppkey * 3) AS hi FROM lineitem)) WHERE l_suppkey NOT IN (SELECT l_suppkey * 3 FROM lineitem)")
def range_missing(t: Tables) -> DataFrame:
    keys = t.lineitem.select((F.col("l_suppkey") * 3).alias("l_suppkey"))
    return rel.missing_range(keys, "l_suppkey", F.min("l_suppkey"), F.max("l_suppkey"))


@query("J11 U3 E12", "WITH a AS (SELECT DISTINCT p_partkey AS k, p_size AS v FROM part), b AS (SELECT DISTINCT l_partkey AS k, l_quantity::INTEGER AS v FROM lineitem) (SELECT *, 'left' AS side FROM (SELECT * FROM a EXCEPT SELECT * FROM b)) UNION ALL (SELECT *, 'right' AS side FROM (SELECT * FROM b EXCEPT SELECT * FROM a))")
def params_symdiff(t: Tables) -> DataFrame:
    a = t.part.select(F.col("p_partkey").alias("k"), F.col("p_size").cast("int").alias("v")).distinct()
    b = t.lineitem.select(F.col("l_partkey").alias("k"), F.col("l_quantity").cast("int").alias("v")).distinct()
    return rel.symmetric_difference(a, b)


@query("J12 A1", "SELECT s_name AS website, k.o_orderstatus AS label_key, coalesce(n, 0) AS n FROM (SELECT n_name AS s_name FROM nation) CROSS JOIN (SELECT DISTINCT o_orderstatus FROM orders) k LEFT JOIN (SELECT n_name, o_orderstatus, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE o_totalprice > 300000 GROUP BY ALL) x ON x.n_name = s_name AND x.o_orderstatus = k.o_orderstatus")
def zero_fill_cross(t: Tables) -> DataFrame:
    dear = t.orders.where("o_totalprice > 300000").join(t.customer, F.col("o_custkey") == F.col("c_custkey")).join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"))
    counts = dear.groupBy(F.col("n_name").alias("website"), F.col("o_orderstatus").alias("label_key")).agg(F.count("*").alias("n"))
    sites, keys = t.nation.select(F.col("n_name").alias("website")), t.orders.select(F.col("o_orderstatus").alias("label_key")).distinct()
    return rel.zero_filled(sites, keys, counts, "website", "label_key", "n")


@query("J9 F11", "SELECT p_partkey, coalesce(id, 0) AS id FROM part LEFT JOIN (SELECT p_brand, row_number() OVER (ORDER BY p_brand) AS id FROM (SELECT DISTINCT o_orderpriority AS p_brand FROM orders UNION SELECT min(p_brand) FROM part UNION SELECT max(p_brand) FROM part)) USING (p_brand)")
def left_default_lookup(t: Tables) -> DataFrame:
    ends = t.part.agg(F.min("p_brand").alias("lo"), F.max("p_brand").alias("hi")).select(F.explode(F.array("lo", "hi")).alias("p_brand"))
    ids = features.tag_dictionary(t.orders.select(F.col("o_orderpriority").alias("p_brand")).unionByName(ends), "p_brand")
    return rel.lookup(t.part, ids, "p_brand", "id", 0).select("p_partkey", F.col("id").cast("bigint").alias("id"))


@query("S10", "SELECT c_custkey, CASE WHEN c_custkey % 7 = 0 THEN 'new ' || c_name ELSE c_name END AS c_name FROM customer")
def upsert_replace(t: Tables) -> DataFrame:
    old = t.customer.select("c_custkey", "c_name")
    new = old.where("c_custkey % 7 = 0").select("c_custkey", F.concat(F.lit("new "), "c_name").alias("c_name"))
    return rel.upsert(old, new, "c_custkey")


@query("U2 U4 U5 S19", "SELECT DISTINCT k FROM (SELECT o_custkey AS k FROM orders WHERE o_orderstatus = 'F' UNION ALL SELECT c_custkey FROM customer WHERE c_acctbal < 0) WHERE k NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')")
def invalid_list(t: Tables) -> DataFrame:
    failed, broke = t.orders.where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("k")), t.customer.where("c_acctbal < 0").select(F.col("c_custkey").alias("k"))
    return store.updated_list(failed, broke, t.orders.where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("k")), "k")


@query("U1 U6", "SELECT lang, array_to_string(list_sort(list_filter(list_distinct(list(source)), lambda x: x NOT IN ('src0', 'src1'))), ',') AS without, array_to_string(list_filter(['src3', 'src0', 'src99'], lambda x: list_contains(list(source), x)), ',') AS both FROM documents GROUP BY lang")
def array_sets(t: Tables) -> DataFrame:
    s = t.documents.groupBy("lang").agg(F.collect_set("source").alias("s"))
    known = F.array(*[F.lit(x) for x in ("src3", "src0", "src99")])
    return s.select("lang", F.array_join(F.array_sort(F.array_except("s", F.array(F.lit("src0"), F.lit("src1")))), ",").alias("without"), F.array_join(F.array_intersect(known, "s"), ",").alias("both"))


# aggregations


@query("A1 A2", "SELECT coalesce(n_name, 'total') AS website, count(*) FILTER (WHERE o_orderstatus = 'F') AS f, count(*) FILTER (WHERE o_orderstatus = 'O') AS o, count(*) FILTER (WHERE o_orderstatus = 'P') AS p FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY ROLLUP (n_name)")
def label_counts_total(t: Tables) -> DataFrame:
    o = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"))
    sums = [F.count_if(F.col("o_orderstatus") == x).alias(x.lower()) for x in "FOP"]
    return o.rollup("n_name").agg(*sums).select(F.coalesce("n_name", F.lit("total")).alias("website"), "f", "o", "p")


@query("A1 A5", "SELECT lang, count(*) FILTER (WHERE quality = 1) AS \"1\", count(*) FILTER (WHERE quality = 0) AS \"0\", count(*) FILTER (WHERE quality IS NULL) AS \"None\" FROM documents LEFT JOIN labels USING (doc_id) GROUP BY lang")
def label_counts_pivot(t: Tables) -> DataFrame:
    d = t.documents.join(t.labels, "doc_id", "left").select("lang", F.coalesce(F.col("quality").cast("string"), F.lit("None")).alias("key"))
    return d.groupBy("lang").pivot("key", ["1", "0", "None"]).agg(F.count("key")).na.fill(0)


@query("A3", "WITH n AS (SELECT o_custkey, o_orderkey, count(*) AS n FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY ALL), m AS (SELECT o_custkey, floor(median(n)) AS m FROM n GROUP BY 1) SELECT count(*) AS websites, round(avg(m), 6) AS mean, round(stddev_samp(m), 6) AS std FROM m")
def node_median(t: Tables) -> DataFrame:
    n = t.orders.join(t.lineitem, F.col("o_orderkey") == F.col("l_orderkey")).groupBy("o_custkey", "o_orderkey").agg(F.count("*").alias("n"))
    m = n.groupBy("o_custkey").agg(F.floor(F.median("n")).cast("double").alias("m"))
    return m.agg(F.count("*").alias("websites"), F.round(F.avg("m"), 6).alias("mean"), F.round(F.stddev_samp("m"), 6).alias("std"))


@query("A6 A8 O4 A11", "SELECT p_type, count(*) AS n, row_number() OVER (ORDER BY min(p_partkey), p_type) AS id FROM part GROUP BY p_type")
def categorical_dictionary(t: Tables) -> DataFrame:
    return features.dictionary(t.part, "p_type", "p_partkey").select("p_type", "n", F.col("id").cast("bigint").alias("id"))


@query("A7 A30", "SELECT slot, round(min(v), 6) AS low, round(max(v), 6) AS high FROM (SELECT unnest(range(len(embedding)))::BIGINT AS slot, unnest(embedding)::DOUBLE AS v FROM embeddings) GROUP BY slot")
def vector_ranges(t: Tables) -> DataFrame:
    r = features.ranges(t.embeddings, "embedding")
    return r.select(F.col("slot").cast("bigint").alias("slot"), *[F.round(F.col(c).cast("double"), 6).alias(c) for c in ("low", "high")])


@query("G9 G10", "SELECT p_partkey, round((p_retailprice - lo) / nullif(hi - lo, 0), 6) AS scaled, 0.0::DOUBLE AS constant FROM part, (SELECT min(p_retailprice) AS lo, max(p_retailprice) AS hi FROM part)")
def minmax_scale(t: Tables) -> DataFrame:
    bounds = t.part.agg(F.min("p_retailprice").alias("lo"), F.max("p_retailprice").alias("hi"))
    return t.part.join(F.broadcast(bounds)).select("p_partkey", F.round(visual.min_max(F.col("p_retailprice"), F.col("lo"), F.col("hi")), 6).alias("scaled"), visual.min_max(F.lit(3.0), F.lit(3.0), F.lit(3.0)).alias("constant"))


@query("G8 A10 M1", "SELECT r_regionkey, array_to_string(list_transform(range(1, 7), lambda i: CASE WHEN i = r_regionkey THEN 1 ELSE 0 END), '') AS hot FROM region")
def one_hot(t: Tables) -> DataFrame:
    v = visual.one_hot(F.col("r_regionkey"), 6)
    return t.region.select("r_regionkey", F.array_join(F.transform(v, lambda x: x.cast("int").cast("string")), "").alias("hot"))


@query("A9 F12", f"SELECT lang, max(least(len({BASIC}), 400))::BIGINT AS most FROM documents GROUP BY lang")
def max_words(t: Tables) -> DataFrame:
    n = F.least(F.size(basic_tokenize(F.col("text"))), F.lit(400))
    return t.documents.groupBy("lang").agg(F.max(n).cast("bigint").alias("most"))


VOCAB_SQL = f"WITH k AS (SELECT doc_id, {BASIC} AS tk FROM documents), e AS (SELECT doc_id, unnest(range(1, len(tk) + 1)) AS pos, unnest(tk) AS token FROM k), v AS (SELECT token, row_number() OVER (ORDER BY n DESC, token) AS id FROM (SELECT token, count(*) AS n FROM e GROUP BY token))\n"


@query("F11 F12 J9 A9 M2", VOCAB_SQL + "SELECT doc_id, array_to_string(list(coalesce(id, 0) ORDER BY pos), ' ') AS ids FROM e LEFT JOIN v USING (token) WHERE pos <= 15 GROUP BY doc_id")
def token_ids_cutoff(t: Tables) -> DataFrame:
    """The first 15 tokens of each text, by the dictionary of all texts' tokens; texts are tokenised once."""
    docs = written(t.documents.select("doc_id", basic_tokenize(F.col("text")).alias("tk")), "tokens")
    counts = docs.select(F.explode("tk").alias("token")).groupBy("token").agg(F.count("*").alias("n"))
    ranked = rel.numbered(counts.withColumn("order", F.struct((-F.col("n")).alias("n"), "token")), "order")
    vocabulary = ranked.select("token", (F.col("_number") + 1).alias("id"))
    ids = features.token_ids(docs.select("doc_id", F.slice("tk", 1, 15).alias("tk")), "doc_id", "tk", vocabulary, 15)
    return ids.select("doc_id", F.array_join(F.col("ids").cast("array<string>"), " ").alias("ids"))


@query("A26 A27 M3 M4 X6", "SELECT l_orderkey, round(avg(embedding[1]::DOUBLE), 5) AS first, round(avg(embedding[64]::DOUBLE), 5) AS last FROM lineitem JOIN embeddings ON vec_id = l_partkey GROUP BY l_orderkey")
def word_vector_mean(t: Tables) -> DataFrame:
    words = t.lineitem.select("l_orderkey", F.col("l_partkey").alias("vec_id"))
    m = features.vector_mean(words, "l_orderkey", t.embeddings, "vec_id", "embedding")
    return m.select("l_orderkey", F.round(F.element_at("vector", 1), 5).alias("first"), F.round(F.element_at("vector", 64), 5).alias("last"))


@query("A19", f"SELECT event_type, count(*) AS n, count(*) FILTER (WHERE value > 50) AS high FROM events GROUP BY event_type")
def status_histogram(t: Tables) -> DataFrame:
    return t.events.groupBy("event_type").agg(F.count("*").alias("n"), F.count_if(F.col("value") > 50).alias("high"))


@query("A20", "SELECT source, lang, array_to_string(list(doc_id ORDER BY doc_id), ',') AS nodes, count(*) AS n FROM documents GROUP BY ALL")
def gather_predictions(t: Tables) -> DataFrame:
    g = t.documents.groupBy("source", "lang").agg(F.array_sort(F.collect_list("doc_id")).alias("d"))
    return g.select("source", "lang", F.array_join(F.col("d").cast("array<string>"), ",").alias("nodes"), F.size("d").cast("bigint").alias("n"))


@query("A29 A25", "SELECT lang, count(*) AS n, count(*) FILTER (WHERE n_chars > 500) AS long, round(avg(n_chars), 6) AS mean FROM documents GROUP BY lang")
def availability_counts(t: Tables) -> DataFrame:
    return t.documents.groupBy("lang").agg(F.count("*").alias("n"), F.count_if(F.col("n_chars") > 500).alias("long"), F.round(F.avg("n_chars"), 6).alias("mean"))


# windows, order, samples


@query("A21 O3 W3", "SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rn FROM orders) WHERE rn = 1")
def argmax_row(t: Tables) -> DataFrame:
    return rel.arg_max(t.orders, ["o_custkey"], "o_totalprice", "o_orderkey").select("o_custkey", "o_orderkey", "o_totalprice")


@query("A22 W6", "SELECT o_orderstatus, min(o_orderkey) AS first, max(o_orderkey) AS last FROM (SELECT o_orderstatus, o_orderkey, o_orderkey - row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey) AS i FROM (SELECT DISTINCT o_orderstatus, o_orderkey FROM orders)) GROUP BY o_orderstatus, i")
def to_ranges(t: Tables) -> DataFrame:
    distinct = t.orders.select("o_orderstatus", "o_orderkey").distinct()
    return rel.to_ranges(distinct, "o_orderkey", ["o_orderstatus"])


@query("O6 D7", "SELECT doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS turn FROM documents")
def interleave_groups(t: Tables) -> DataFrame:
    return rel.interleaved(t.documents.select("source", "doc_id"), "source", "doc_id").select("doc_id", F.col("turn").cast("bigint").alias("turn"))


@query("W5 P6 O8", "SELECT source, doc_id FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS rn FROM documents) WHERE rn <= 3")
def first_n_per_group(t: Tables) -> DataFrame:
    return rel.first_n(t.documents, 3, ["source"], "doc_id").select("source", "doc_id")


@query("W2", "SELECT source, coalesce(sum(n) OVER (ORDER BY source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS \"offset\" FROM (SELECT source, count(*) AS n FROM documents GROUP BY source)")
def running_offsets(t: Tables) -> DataFrame:
    return rel.offsets(t.documents.groupBy("source").agg(F.count("*").alias("n")), "n", "source").select("source", "offset")


@query("P4 W7", "SELECT doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS new_index FROM documents")
def reindex(t: Tables) -> DataFrame:
    return rel.reindexed(t.documents.select("source", "doc_id"), ["source"], "doc_id").select("doc_id", F.col("new_index").cast("bigint").alias("new_index"))


@query("P5", "SELECT doc_id FROM documents ORDER BY doc_id LIMIT 50 OFFSET 20")
def offset_limit(t: Tables) -> DataFrame:
    return t.documents.select("doc_id").orderBy("doc_id").offset(20).limit(50)


@query("W8", "SELECT user_id, event_type, count(*) AS allowed FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS k FROM events) WHERE k <= 10 GROUP BY ALL")
def duplicate_guard(t: Tables) -> DataFrame:
    k = F.row_number().over(W.partitionBy("user_id", "event_type").orderBy("event_id"))
    return t.events.withColumn("k", k).where("k <= 10").groupBy("user_id", "event_type").agg(F.count("*").alias("allowed"))


@query("E1 E5", "SELECT source, doc_id FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY md5('42:' || doc_id), doc_id) AS rn FROM documents) WHERE rn <= 5")
def subset_sample(t: Tables) -> DataFrame:
    return rel.sampled(t.documents, 5, ["source"], "doc_id").select("source", "doc_id")


@query("P13 P11 P12", "SELECT doc_id FROM documents LEFT JOIN labels USING (doc_id) WHERE quality IS NOT NULL OR ('0x' || substr(md5(doc_id::VARCHAR), 1, 8))::BIGINT % 100000 < 30000")
def none_cutoff(t: Tables) -> DataFrame:
    d = t.documents.join(t.labels, "doc_id", "left")
    return rel.cut_off(d, "doc_id", 30_000, F.col("quality").isNull()).select("doc_id")


@query("E2 E6 Q23", "SELECT doc_id, CASE WHEN rank <= 15 THEN 'train' ELSE 'val' END AS part FROM documents JOIN (SELECT source, row_number() OVER (ORDER BY source) AS rank FROM (SELECT DISTINCT source FROM documents)) USING (source)")
def split_by_group(t: Tables) -> DataFrame:
    ranks = features.tag_dictionary(t.documents, "source")
    return t.documents.join(ranks, "source").select("doc_id", F.when(F.col("id") <= 15, "train").otherwise("val").alias("part"))


@query("E3 E4", "WITH s AS (SELECT source, row_number() OVER (ORDER BY source) - 1 AS k, count(*) OVER () AS n FROM (SELECT DISTINCT source FROM documents)), f AS (SELECT source, k, n, unnest(range(n)) AS fold FROM s) SELECT fold, source, CASE WHEN (k - fold + n) % n < 4 THEN 'train' ELSE 'val' END AS part FROM f")
def cyclic_folds(t: Tables) -> DataFrame:
    return rel.folds(t.documents, "source", 4)


@query("O7", "SELECT doc_id, row_number() OVER (ORDER BY md5('42:' || doc_id), doc_id) AS place FROM documents")
def seeded_shuffle(t: Tables) -> DataFrame:
    """The place of each row in a shuffle by hash: sorted by range, so that no task gets all rows."""
    keyed = t.documents.select("doc_id", F.struct(F.md5(F.concat(F.lit("42:"), F.col("doc_id").cast("string"))), "doc_id").alias("order"))
    return rel.numbered(keyed, "order").select("doc_id", (F.col("_number") + 1).alias("place"))


# sources and routing in relational form


@query("S28 C3 C4 J16", "SELECT sha256(text) AS sha256, count(*) AS entries, min(doc_id) AS first FROM documents GROUP BY 1")
def asset_cache_dedup(t: Tables) -> DataFrame:
    assets = t.documents.select(F.col("doc_id").alias("timestamp"), F.col("source").alias("url"), F.lit(200).alias("status"), F.col("text").alias("body"))
    entries, blobs = store.cache_assets(assets)
    return entries.join(blobs.select("sha256"), "sha256", "left_semi").groupBy("sha256").agg(F.count("*").alias("entries"), F.min("timestamp").alias("first"))


ROUTE_SQL = """
WITH r AS (SELECT event_id AS request_id, user_id AS page_id, CASE WHEN event_type = 'error' THEN 'http://ads.example.com/' WHEN event_type = 'login' THEN 'file:///x' WHEN event_type = 'view' THEN 'https://web.archive.org/web/2011id_/http://e.com/' ELSE 'http://Host' || user_id % 3 || '.example.com:80/' || event_type END AS url FROM events),
n AS (SELECT *, replace(replace(url, ':80/', '/'), 'Host', 'host') AS normal_url, event_type = 'error' AS refused FROM r JOIN events ON event_id = request_id),
c AS (SELECT *, sum(CASE WHEN refused THEN 0 ELSE 1 END) OVER (PARTITION BY page_id, normal_url ORDER BY request_id) AS same, sum(CASE WHEN refused THEN 0 ELSE 1 END) OVER (PARTITION BY page_id ORDER BY request_id) AS upto FROM n),
g AS (SELECT *, bool_or(NOT refused AND (same > 3 OR upto > 12)) OVER (PARTITION BY page_id ORDER BY request_id) AS closed FROM c),
a AS (SELECT 'http://host' || n_nationkey % 3 || '.example.com/' || k AS u, max(CASE WHEN n_nationkey % 3 = 1 THEN 1 ELSE 0 END) AS bodies FROM nation, (VALUES ('cart'), ('refund')) v(k) GROUP BY 1)
SELECT request_id, normal_url, CASE WHEN refused THEN 'ignored' WHEN closed THEN 'closed' WHEN normal_url = 'http://host' || page_id % 3 || '.example.com/click' THEN 'page' WHEN starts_with(normal_url, 'file://') THEN 'local' WHEN u IS NOT NULL AND bodies = 0 THEN 'aborted' WHEN u IS NOT NULL THEN 'cached' WHEN starts_with(url, 'https://web.archive.org/') THEN 'redirect' ELSE 'live' END AS route FROM g LEFT JOIN a ON u = normal_url
"""


@query("C2 C4 C6 J16 P19 W8", ROUTE_SQL)
def request_routing(t: Tables) -> DataFrame:
    """Events as the requests of users' pages, three of one URL and twelve of one page at most."""
    asked, pages, assets = routing_tables(t)
    return routing.routed(asked, pages, assets, ["http://ads."], same_url=3, same_page=12).select("request_id", "normal_url", "route")


def routing_tables(t: Tables) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Requests, pages and assets."""
    kind = F.col("event_type")
    site = lambda k: F.concat(F.lit("http://Host"), (k % 3).cast("string"), F.lit(".example.com:80/"))
    url = F.when(kind == "error", "http://ads.example.com/").when(kind == "login", "file:///x").when(kind == "view", "https://web.archive.org/web/2011id_/http://e.com/").otherwise(F.concat(site(F.col("user_id")), kind))
    asked = t.events.select(F.col("event_id").alias("request_id"), F.col("user_id").alias("page_id"), url.alias("url"))
    pages = t.events.select(F.col("user_id").alias("page_id")).distinct().withColumn("page_url", F.concat(site(F.col("page_id")), F.lit("click")))
    assets = t.nation.select("n_nationkey", F.explode(F.array(F.lit("cart"), F.lit("refund"))).alias("k")).select(F.concat(site(F.col("n_nationkey")), "k").alias("url"), F.when(F.col("n_nationkey") % 3 == 1, "x").alias("body"))
    return asked, pages, assets


@query("S29 F22", "SELECT o_orderkey, f_key AS capture, f_date AS captured FROM (SELECT o.o_orderkey, f.f_key, f.f_date, row_number() OVER (PARTITION BY o.o_orderkey ORDER BY abs(epoch_us(f.f_date) - epoch_us(o.o_orderdate)) NULLS LAST, f.f_date) AS rn FROM orders o LEFT JOIN (SELECT o_custkey AS ck, o_orderdate AS f_date, min(o_orderkey) AS f_key FROM orders WHERE o_orderstatus = 'F' GROUP BY ALL) f ON f.ck = o.o_custkey) WHERE rn = 1")
def archive_nearest(t: Tables) -> DataFrame:
    """Each order as a wanted time of its customer's address, finished orders as captures."""
    captures = t.orders.where("o_orderstatus = 'F'").select("o_custkey", "o_orderdate", F.col("o_orderkey").alias("key"))
    out = routing.nearest_capture(t.orders.select("o_orderkey", "o_custkey", "o_orderdate"), captures, "o_custkey", "o_orderdate", "key")
    return out.select("o_orderkey", "capture", "captured")


@query("S6 V11 F18", "SELECT o_custkey AS page_index, array_to_string(list('v' || o_orderkey ORDER BY o_orderkey), '|') AS vals FROM orders GROUP BY o_custkey")
def groundtruth_parse(t: Tables) -> DataFrame:
    """Orders of a customer written as ground-truth lines, and parsed again."""
    per = t.orders.groupBy("o_custkey").agg(F.array_sort(F.collect_list("o_orderkey")).alias("k"))
    line = F.concat_ws("\t", F.col("o_custkey").cast("string"), F.size("k").cast("string"), F.array_join(F.transform("k", lambda x: F.concat(F.lit("v"), x.cast("string"))), "\t"))
    rows = per.select(F.lit("p").alias("path"), (F.col("o_custkey") + 2).alias("line_no"), line.alias("value"))
    head = per.sparkSession.createDataFrame([("p", 0, "a\tb\tc")], "path string, line_no bigint, value string")
    return corpora.parse_ground_truth(rows.unionByName(head)).select(F.col("page_index").cast("bigint").alias("page_index"), F.array_join("values", "|").alias("vals"))


@query("S7 S8 P1 V10", "SELECT c_name AS url, 'segment' AS label_key, c_mktsegment AS value FROM customer WHERE c_acctbal >= 0 UNION ALL SELECT c_name, 'nation', c_nationkey::VARCHAR FROM customer")
def slim_projection(t: Tables) -> DataFrame:
    r = t.customer.select(F.col("c_name").alias("url"), F.when(F.col("c_acctbal") >= 0, F.col("c_mktsegment")).otherwise("").alias("segment"), F.when(F.col("c_acctbal") >= 0, ".s").otherwise("").alias("selector_segment"), F.col("c_nationkey").alias("nation"), F.lit(".n").alias("selector_nation"), F.col("c_acctbal").alias("junk"))
    return corpora.record_labels(corpora.slim(r)).select("url", "label_key", "value")


@query("S32", "SELECT p_partkey, regexp_replace(regexp_replace(p_type, 'A', 'X', 'g'), '^(.)', '<\\1>') AS kind FROM part")
def patch_rules(t: Tables) -> DataFrame:
    return corpora.patched_records(t.part.select("p_partkey", F.col("p_type").alias("kind")), [("kind", "A", "X"), ("kind", "^(.)", "<$1>")])


@query("D27 D29 S16 Q4", "SELECT event_id, coalesce(nullif(json_extract(props, '$.k')::BIGINT, 0), 16) AS font_size FROM events")
def json_attributes(t: Tables) -> DataFrame:
    k = F.try_variant_get(F.try_parse_json("props"), "$.k", "bigint")
    return t.events.select("event_id", F.coalesce(F.nullif(k, F.lit(0).cast("bigint")), F.lit(16).cast("bigint")).alias("font_size"))


COLOR_SQL = """
WITH c AS (SELECT p_partkey, p_partkey * 37 % 256 AS r, p_partkey * 91 % 256 AS g, p_partkey * 53 % 256 AS b, p_partkey % 256 AS a FROM part),
d AS (SELECT *, greatest(r, g, b) AS mx, least(r, g, b) AS mn FROM c),
h AS (SELECT *, CASE WHEN mx = mn THEN 0 WHEN r = mx THEN ((mx - b) - (mx - g)) / (mx - mn)::DOUBLE WHEN g = mx THEN 2.0 + ((mx - r) - (mx - b)) / (mx - mn)::DOUBLE ELSE 4.0 + ((mx - g) - (mx - r)) / (mx - mn)::DOUBLE END / 6.0 AS t FROM d)
SELECT p_partkey, round(t - floor(t), 6) AS hue, round(mx / 255.0::DOUBLE, 6) AS brightness, round(a / 255.0::DOUBLE, 6) AS alpha, a = 0 AS transparent FROM h
"""


@query("G3 G4 G13", COLOR_SQL)
def color_features(t: Tables) -> DataFrame:
    byte = lambda c: F.lpad(F.lower(F.hex(c.cast("bigint"))), 2, "0")
    k = F.col("p_partkey")
    p = t.part.select("p_partkey", F.concat(F.lit("#"), byte(k * 37 % 256), byte(k * 91 % 256), byte(k * 53 % 256), byte(k % 256)).alias("c"))
    hue, brightness, alpha = visual.color(F.col("c"))
    return p.select("p_partkey", F.round(hue, 6).alias("hue"), F.round(brightness, 6).alias("brightness"), F.round(alpha, 6).alias("alpha"), visual.is_transparent(F.col("c")).alias("transparent"))


@query("G5 G6 G7 F14 F15", "SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN p_size ELSE 0 END::DOUBLE AS border, lower(p_brand) AS family, CASE WHEN p_size % 3 = 0 THEN 'number' ELSE 'auto' END AS z FROM part")
def border_parse(t: Tables) -> DataFrame:
    size = F.col("p_size").cast("string")
    border = F.when(F.col("p_size") % 2 == 0, F.concat(size, F.lit("px solid red"))).otherwise("none")
    attrs = F.create_map(F.lit("border"), border)
    family = F.concat(F.lit("'"), "p_brand", F.lit("', Arial"))
    return t.part.select("p_partkey", F.get(visual.border_widths(attrs), F.lit(2)).alias("border"), visual.font_family(family).alias("family"), visual.z_index_kind(F.when(F.col("p_size") % 3 == 0, size).otherwise("auto")).alias("z"))


# evaluation and decoding


EVAL_SQL = """
WITH p AS (SELECT doc_id % 100 AS page_id, lang AS label_key, doc_id AS node_id, n_chars / 100.0::DOUBLE AS confidence FROM documents),
g AS (SELECT doc_id % 100 AS page_id, lang AS label_key, doc_id % 3 AS group_idx, doc_id AS node_id FROM documents JOIN labels USING (doc_id) WHERE quality = 1),
top AS (SELECT page_id, label_key, node_id FROM (SELECT *, row_number() OVER (PARTITION BY page_id, label_key ORDER BY confidence DESC, node_id) AS rn FROM p) WHERE rn = 1)
"""
SCORE_SQL = """
, s AS (SELECT label_key, sum(tp) AS tp, sum(fp) AS fp, sum(fn) AS fn FROM f GROUP BY label_key),
r AS (SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp)::DOUBLE ELSE 0 END AS p, CASE WHEN tp + fn > 0 THEN tp / (tp + fn)::DOUBLE ELSE 0 END AS r FROM s)
SELECT label_key, tp::BIGINT AS tp, fp::BIGINT AS fp, fn::BIGINT AS fn, round(p, 6) AS precision, round(r, 6) AS recall, round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END, 6) AS f1 FROM r
"""


def _predictions(t: Tables) -> tuple[DataFrame, DataFrame]:
    page = (F.col("doc_id") % 100).alias("page_id")
    p = t.documents.select(page, F.col("lang").alias("label_key"), F.col("doc_id").alias("node_id"), (F.col("n_chars") / 100.0).alias("confidence"))
    g = t.documents.join(t.labels.where("quality = 1"), "doc_id").select(page, F.col("lang").alias("label_key"), (F.col("doc_id") % 3).alias("group_idx"), F.col("doc_id").alias("node_id"))
    return p, g


def _rounded(df: DataFrame) -> DataFrame:
    return df.select(*[F.round(c, 6).alias(c) if kind == "double" else F.col(c) for c, kind in df.dtypes])


@query("A14 J4 Q2 Q3", EVAL_SQL + ", f AS (SELECT label_key, CASE WHEN hit THEN 1 ELSE 0 END AS tp, CASE WHEN hit THEN 0 ELSE 1 END AS fp, 0 AS fn FROM (SELECT top.*, EXISTS (SELECT 1 FROM g WHERE g.page_id = top.page_id AND g.label_key = top.label_key AND g.node_id = top.node_id) AS hit FROM top))" + SCORE_SQL)
def top1_eval(t: Tables) -> DataFrame:
    return _rounded(evaluate.label_scores(evaluate.page_flags(*_predictions(t))))


@query("A15 Q2 Q27", EVAL_SQL + ", w AS (SELECT g.page_id, g.label_key, group_idx, bool_and(p.node_id IS NOT NULL) AS ok FROM g LEFT JOIN p ON g.page_id = p.page_id AND g.label_key = p.label_key AND g.node_id = p.node_id GROUP BY ALL), h AS (SELECT page_id, label_key, bool_or(ok) AS ok FROM w GROUP BY ALL), f AS (SELECT top.label_key, CASE WHEN coalesce(ok, false) THEN 1 ELSE 0 END AS tp, CASE WHEN coalesce(ok, false) THEN 0 ELSE 1 END AS fp, 0 AS fn FROM top LEFT JOIN h USING (page_id, label_key) UNION ALL SELECT h.label_key, 0, 0, 1 FROM h ANTI JOIN top USING (page_id, label_key))" + SCORE_SQL)
def exact_match_eval(t: Tables) -> DataFrame:
    return _rounded(evaluate.label_scores(evaluate.page_flags(*_predictions(t), exact=True, count_unpredicted=True)))


@query("A13 A12", "WITH x AS (SELECT CASE WHEN n_chars > 1500 THEN 1 ELSE 0 END AS p, quality AS g FROM documents JOIN labels USING (doc_id)), s AS (SELECT count(*) FILTER (WHERE p = g AND g > 0) AS tp, count(*) FILTER (WHERE p <> g AND p > 0) AS fp, count(*) FILTER (WHERE p <> g AND g > 0) AS fn FROM x), r AS (SELECT *, tp / (tp + fp)::DOUBLE AS p, tp / (tp + fn)::DOUBLE AS r FROM s) SELECT tp, fp, fn, round(p, 6) AS precision, round(r, 6) AS recall, round(2 * p * r / (p + r), 6) AS f1 FROM r")
def node_micro_f1(t: Tables) -> DataFrame:
    d = t.documents.join(t.labels, "doc_id").select(F.when(F.col("n_chars") > 1500, 1).otherwise(0).alias("p"), F.col("quality").alias("g"))
    return _rounded(evaluate.node_micro(d, "p", "g"))


@query("A16", "SELECT event_type AS metric, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std, count(value) AS n, round(min(value), 6) AS min, round(max(value), 6) AS max FROM events GROUP BY event_type")
def crossval_stats(t: Tables) -> DataFrame:
    return _rounded(evaluate.run_statistics(t.events.select(F.col("user_id").alias("run"), F.col("event_type").alias("metric"), "value")))


@query("A28", "WITH s AS (SELECT event_type, user_id % 4 AS v, avg(value) AS m, stddev_pop(value) AS s FROM events GROUP BY ALL) SELECT v AS vertical, round(avg(m), 6) AS mean, round(sqrt(avg(s * s)), 6) AS std FROM s GROUP BY v")
def results_combined(t: Tables) -> DataFrame:
    s = t.events.groupBy("event_type", (F.col("user_id") % 4).alias("vertical")).agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"))
    return _rounded(evaluate.combined(s, "vertical"))


@query("F24 A28", "SELECT lang, printf('%.2f ± %.2f', round(avg(p) * 100, 2), round(stddev_pop(p) * 100, 2)) AS shown FROM (SELECT lang, CASE WHEN n_chars > 1500 THEN 1.0::DOUBLE ELSE 0.0 END AS p FROM documents) GROUP BY lang")
def mean_with_std(t: Tables) -> DataFrame:
    p = F.when(F.col("n_chars") > 1500, 1.0).otherwise(0.0)
    return t.documents.groupBy("lang").agg(F.format_string("%.2f ± %.2f", F.round(F.avg(p) * 100, 2), F.round(F.stddev_pop(p) * 100, 2)).alias("shown"))


@query("G14", "SELECT vec_id, round(exp(embedding[1]::DOUBLE - m) / t, 6) AS first, list_position(embedding, list_max(embedding)) - 1 AS best FROM (SELECT vec_id, embedding, list_max(embedding)::DOUBLE AS m, list_sum(list_transform(embedding, lambda x: exp(x::DOUBLE - list_max(embedding)::DOUBLE))) AS t FROM embeddings)")
def softmax_argmax(t: Tables) -> DataFrame:
    v = F.col("embedding").cast("array<double>")
    return t.embeddings.select("vec_id", F.round(F.element_at(visual.softmax(v), 1), 6).alias("first"), visual.arg_max(v).alias("best"))


@query("P27 P17 P24 P25", "SELECT doc_id % 50 AS page_id, array_to_string(list(printf('''%s''(%.2f)', source, n_chars / 100.0) ORDER BY n_chars DESC, doc_id), '; ') AS pred FROM documents GROUP BY 1")
def decode_predictions(t: Tables) -> DataFrame:
    item = F.format_string("'%s'(%.2f)", F.col("source"), F.col("n_chars") / 100.0)
    g = t.documents.groupBy((F.col("doc_id") % 50).alias("page_id")).agg(F.array_sort(F.collect_list(F.struct((-F.col("n_chars")).alias("o"), "doc_id", item.alias("s")))).alias("x"))
    return g.select("page_id", F.array_join("x.s", "; ").alias("pred"))


@query("O3 P26 P28", "SELECT doc_id, rank() OVER (PARTITION BY lang ORDER BY n_chars DESC, doc_id) AS place, '{\"text\":\"' || source || '\",\"confidence\":' || n_chars || '}' AS body FROM documents")
def ranked_predictions(t: Tables) -> DataFrame:
    d = t.documents.select("doc_id", "lang", "source", "n_chars", (-F.col("n_chars")).alias("order"))
    body = F.to_json(F.struct(F.col("source").alias("text"), F.col("n_chars").alias("confidence")))
    return rel.ranked(d, ["lang"], ["order", "doc_id"], "place").select("doc_id", "place", body.alias("body"))
