"""Tree and neighbour queries on a relational hierarchy: regions, their nations, customers and orders."""
from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..operators import neighbors, tree
from ..sources.scratch import written
from .registry import Tables, query

TREE_SQL = """
WITH raw AS (
  SELECT r_regionkey::BIGINT AS page_id, -1 AS nk, -1 AS ck, -1 AS ok, 'region' AS tag FROM region
  UNION ALL SELECT n_regionkey, n_nationkey, -1, -1, 'nation' FROM nation
  UNION ALL SELECT n_regionkey, n_nationkey, c_custkey, -1, c_mktsegment FROM customer JOIN nation ON c_nationkey = n_nationkey
  UNION ALL SELECT n_regionkey, n_nationkey, c_custkey, o_orderkey, o_orderstatus FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey),
num AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY nk, ck, ok) - 1 AS node_id FROM raw),
link AS (SELECT page_id, node_id, tag,
  CASE WHEN nk = -1 THEN NULL WHEN ck = -1 THEN 0 WHEN ok = -1 THEN min(node_id) OVER (PARTITION BY page_id, nk) ELSE min(node_id) OVER (PARTITION BY page_id, nk, ck) END AS parent_id,
  CASE WHEN nk = -1 THEN max(node_id) OVER (PARTITION BY page_id) WHEN ck = -1 THEN max(node_id) OVER (PARTITION BY page_id, nk) WHEN ok = -1 THEN max(node_id) OVER (PARTITION BY page_id, nk, ck) ELSE node_id END AS end_id FROM num),
tree AS (SELECT *, row_number() OVER (PARTITION BY page_id, parent_id ORDER BY node_id) - 1 AS sib_pos,
  CASE WHEN count(*) OVER (PARTITION BY page_id, parent_id, tag) > 1 THEN row_number() OVER (PARTITION BY page_id, parent_id, tag ORDER BY node_id) - 1 END AS same FROM link),
path AS (
  WITH RECURSIVE r AS (
    SELECT page_id, node_id, end_id, parent_id, tag, same, sib_pos, 0 AS depth, '/' || tag AS xpath, []::BIGINT[] AS anc, []::BIGINT[] AS ip FROM tree WHERE parent_id IS NULL
    UNION ALL SELECT t.page_id, t.node_id, t.end_id, t.parent_id, t.tag, t.same, t.sib_pos, r.depth + 1, r.xpath || '/' || t.tag || coalesce('[' || (t.same + 1) || ']', ''), list_append(r.anc, r.node_id), list_append(r.ip, t.sib_pos)
    FROM tree t JOIN r ON t.page_id = r.page_id AND t.parent_id = r.node_id)
  SELECT * FROM r)
"""


def hierarchy(t: Tables) -> DataFrame:
    """page_id, node_id, end_id, parent_id, tag, sib_pos: a tree for each region, numbered in preorder."""
    key = lambda c: F.col(c).cast("bigint")
    none = F.lit(-1).cast("bigint")
    nation = t.nation
    customer = t.customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    orders = t.orders.join(customer, F.col("o_custkey") == F.col("c_custkey"))
    levels = [
        t.region.select(key("r_regionkey").alias("page_id"), none.alias("nk"), none.alias("ck"), none.alias("ok"), F.lit("region").alias("tag")),
        nation.select(key("n_regionkey"), key("n_nationkey"), none, none, F.lit("nation")),
        customer.select(key("n_regionkey"), key("n_nationkey"), key("c_custkey"), none, "c_mktsegment"),
        orders.select(key("n_regionkey"), key("n_nationkey"), key("c_custkey"), key("o_orderkey"), "o_orderstatus"),
    ]
    raw = reduce(DataFrame.union, levels)
    num = raw.withColumn("node_id", (F.row_number().over(W.partitionBy("page_id").orderBy("nk", "ck", "ok")) - 1).cast("bigint"))
    by = [W.partitionBy("page_id"), W.partitionBy("page_id", "nk"), W.partitionBy("page_id", "nk", "ck")]
    level = F.when(F.col("nk") == -1, 0).when(F.col("ck") == -1, 1).when(F.col("ok") == -1, 2).otherwise(3)
    link = num.select(
        "page_id", "node_id", "tag",
        F.when(level == 1, F.lit(0).cast("bigint")).when(level == 2, F.min("node_id").over(by[1])).when(level == 3, F.min("node_id").over(by[2])).alias("parent_id"),
        F.when(level == 0, F.max("node_id").over(by[0])).when(level == 1, F.max("node_id").over(by[1])).when(level == 2, F.max("node_id").over(by[2])).otherwise(F.col("node_id")).alias("end_id"),
    )
    return link.withColumn("sib_pos", F.row_number().over(W.partitionBy("page_id", "parent_id").orderBy("node_id")) - 1)


@query("D2 D3 W1", TREE_SQL + "SELECT page_id, node_id, tag, same AS same_tag_index FROM tree")
def tree_same_tag_index(t: Tables) -> DataFrame:
    return tree.same_tag_index(hierarchy(t)).select("page_id", "node_id", "tag", F.col("same_tag_index").cast("bigint").alias("same_tag_index"))


@query("D5 D34", TREE_SQL + "SELECT page_id, node_id, depth, xpath FROM path")
def tree_xpath(t: Tables) -> DataFrame:
    return tree.with_paths(hierarchy(t)).select("page_id", "node_id", "depth", "xpath")


@query("D6 J3", TREE_SQL + "SELECT page_id, node_id, array_to_string(ip, '.') AS index_path FROM path")
def tree_index_path(t: Tables) -> DataFrame:
    return tree.with_paths(hierarchy(t)).select("page_id", "node_id", F.array_join(F.col("index_path").cast("array<string>"), ".").alias("index_path"))


@query("D8 D10", TREE_SQL + "SELECT page_id, node_id, array_to_string(list_reverse(anc)[1:2], '.') AS two_up, array_to_string(list_append(anc, node_id), '.') AS all_up FROM path")
def tree_ancestors(t: Tables) -> DataFrame:
    n = tree.with_paths(hierarchy(t))
    text = lambda c: F.array_join(c.cast("array<string>"), ".")
    return n.select("page_id", "node_id", text(tree.ancestors(F.col("anc_ids"), 2)).alias("two_up"), text(tree.all_ancestors(F.col("anc_ids"), F.col("node_id"))).alias("all_up"))


@query("D9", TREE_SQL + "SELECT page_id, node_id, array_to_string(list_concat(list_resize([]::BIGINT[], 3 - least(len(anc), 3), coalesce(anc[1], node_id)), CASE WHEN len(anc) > 3 THEN anc[len(anc) - 2:] ELSE anc END), '.') AS chain FROM path")
def tree_ancestor_chain(t: Tables) -> DataFrame:
    n = tree.with_paths(hierarchy(t))
    return n.select("page_id", "node_id", F.array_join(tree.ancestor_chain(F.col("anc_ids"), F.col("node_id"), 3).cast("array<string>"), ".").alias("chain"))


@query("D4 D21 J15", TREE_SQL + "SELECT a.page_id, a.node_id AS top_id, count(*) AS below, sum(n.node_id)::BIGINT AS checksum FROM tree a JOIN tree n ON a.page_id = n.page_id AND n.node_id > a.node_id AND n.node_id <= a.end_id WHERE a.tag = 'nation' GROUP BY ALL")
def tree_descendants(t: Tables) -> DataFrame:
    n = written(hierarchy(t), "tree")
    tops = n.where("tag = 'nation'").select("page_id", F.col("node_id").alias("top_id"))
    return tree.descendants(n, tops).groupBy("page_id", "top_id").agg(F.count("*").alias("below"), F.sum("node_id").alias("checksum"))


@query("D11 D12 D16 D7", TREE_SQL + "SELECT page_id, node_id, abs(node_id - coalesce(parent_id, node_id)) AS distance, node_id = end_id AS is_leaf, parent_id IS NULL AS is_root, '<' || tag || '>' AS shown FROM tree")
def tree_distance(t: Tables) -> DataFrame:
    own, up = F.col("node_id"), F.coalesce("parent_id", "node_id")
    return hierarchy(t).select("page_id", "node_id", tree.distance(own, up).alias("distance"), (own == F.col("end_id")).alias("is_leaf"), F.col("parent_id").isNull().alias("is_root"), tree.text_or_tag(F.col("tag"), F.lit("")).alias("shown"))


UNWRAP_SQL = TREE_SQL + """
, c AS (SELECT *, count(*) OVER (PARTITION BY page_id, parent_id) AS n FROM tree),
u1 AS (SELECT a.page_id, a.node_id, CASE WHEN a.tag IN ('O', 'F', 'P') AND a.parent_id IS NOT NULL THEN a.parent_id ELSE a.node_id END AS up, a.tag IN ('O', 'F', 'P') AS moved FROM c a),
u2 AS (SELECT u1.page_id, u1.node_id, CASE WHEN moved AND c.tag IN ('BUILDING', 'MACHINERY') AND c.n = 1 THEN c.parent_id ELSE u1.up END AS up FROM u1 JOIN c ON u1.page_id = c.page_id AND u1.up = c.node_id)
SELECT u2.page_id, u2.node_id, u2.up AS semantic_id, c.tag AS semantic_tag FROM u2 JOIN c ON u2.page_id = c.page_id AND u2.up = c.node_id
"""


@query("D13 D14", UNWRAP_SQL)
def tree_semantic_unwrap(t: Tables) -> DataFrame:
    n = hierarchy(t)
    out = tree.unwrapped(n, ("O", "F", "P"))
    return out


@query("D17 J7 W4 O2", TREE_SQL + """
, s AS (SELECT page_id, node_id, list_reverse(anc)[1:2] AS up FROM path WHERE tag = 'O' OR tag = 'F'),
e AS (SELECT page_id, node_id, unnest(up) AS anc FROM s),
p AS (SELECT DISTINCT a.page_id, a.node_id, b.node_id AS friend_id FROM e a JOIN e b ON a.page_id = b.page_id AND a.anc = b.anc AND a.node_id <> b.node_id WHERE a.anc IN (SELECT node_id FROM tree WHERE tag NOT IN ('nation', 'region') AND tree.page_id = a.page_id))
SELECT page_id, node_id, friend_id, abs(node_id - friend_id) AS distance FROM (SELECT *, row_number() OVER (PARTITION BY page_id, node_id ORDER BY abs(node_id - friend_id), friend_id) AS rn FROM p) WHERE rn <= 10
""")
def friend_cycles(t: Tables) -> DataFrame:
    """Orders of one customer are friends."""
    n = tree.with_paths(hierarchy(t)).where("tag in ('O', 'F')")
    return neighbors.friends_of_any_tree(n, most_levels=1, most=10)


@query("D17", TREE_SQL + """
, e AS (SELECT page_id, node_id, anc[len(anc)] AS a FROM path WHERE tag IN ('O', 'F')),
two AS (SELECT page_id, a, min(node_id) AS x, max(node_id) AS y FROM e GROUP BY ALL HAVING count(*) = 2)
SELECT e.page_id, e.node_id, CASE WHEN e.node_id = x THEN y ELSE x END AS partner_id FROM e JOIN two USING (page_id, a)
""")
def friend_partner(t: Tables) -> DataFrame:
    n = tree.with_paths(hierarchy(t)).where("tag in ('O', 'F')")
    return neighbors.partners(n, most_levels=1)


def boxes(t: Tables) -> DataFrame:
    """Line items of an order as boxes on a page."""
    rows = t.lineitem.withColumn("page_id", F.col("l_orderkey"))  # the key of the later shuffles too, so that one serves all
    place = F.row_number().over(W.partitionBy("page_id").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity"))
    return rows.withColumn("node_id", place.cast("bigint")).select("page_id", "node_id", (F.col("l_quantity") * 7 % 50).alias("x"), (F.col("l_extendedprice").cast("bigint") % 97).cast("double").alias("y"), F.col("l_quantity").alias("w"), (F.col("l_linenumber") * 3.0).alias("h"))


BOX_SQL = "WITH b AS (SELECT l_orderkey AS page_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity) AS node_id, l_quantity * 7 % 50 AS x, (trunc(l_extendedprice)::BIGINT % 97)::DOUBLE AS y, l_quantity AS w, l_linenumber * 3.0::DOUBLE AS h FROM lineitem)\n"


KNN_SQL = BOX_SQL + """
, c AS (SELECT page_id, node_id, x + w / 2 AS cx, y + h / 2 AS cy, count(*) OVER (PARTITION BY page_id) AS n FROM b),
p AS (SELECT a.page_id, a.node_id, o.node_id AS neighbor_id, a.n, o.cx - a.cx AS dx, o.cy - a.cy AS dy FROM c a JOIN c o ON a.page_id = o.page_id AND a.node_id <> o.node_id),
r AS (SELECT *, sqrt(dx * dx + dy * dy) AS distance, row_number() OVER (PARTITION BY page_id, node_id ORDER BY CASE WHEN n > 2 THEN sqrt(dx * dx + dy * dy) ELSE abs(node_id - neighbor_id) END, neighbor_id) AS rank FROM p),
k AS (SELECT * FROM r WHERE rank <= 2 UNION ALL SELECT page_id, node_id, neighbor_id, n, dx, dy, distance, 2 FROM r WHERE n = 2)
"""


@query("D18 D20 J6 G1", KNN_SQL + "SELECT page_id, node_id, rank::BIGINT AS rank, neighbor_id, round(distance, 6) AS distance, round(dx, 6) AS dx, round(dy, 6) AS dy FROM k")
def knn_center(t: Tables) -> DataFrame:
    return neighbors.knn_center(boxes(t), 2).select("page_id", "node_id", F.col("rank").cast("bigint").alias("rank"), "neighbor_id", *[F.round(c, 6).alias(c) for c in ("distance", "dx", "dy")])


@query("D19 J6 G1", BOX_SQL + """
, c AS (SELECT page_id, node_id, unnest([x, x + w, x, x + w]) AS cx, unnest([y, y, y + h, y + h]) AS cy FROM b),
p AS (SELECT a.page_id, a.node_id, o.node_id AS neighbor_id, min(sqrt((a.cx - o.cx) * (a.cx - o.cx) + (a.cy - o.cy) * (a.cy - o.cy))) AS distance FROM c a JOIN c o ON a.page_id = o.page_id AND a.node_id <> o.node_id GROUP BY ALL)
SELECT page_id, node_id, rank::BIGINT AS rank, neighbor_id, round(distance, 6) AS distance FROM (SELECT *, row_number() OVER (PARTITION BY page_id, node_id ORDER BY distance, neighbor_id) AS rank FROM p) WHERE rank <= 2
""")
def knn_rect(t: Tables) -> DataFrame:
    return neighbors.knn_rect(boxes(t), 2).select("page_id", "node_id", F.col("rank").cast("bigint").alias("rank"), "neighbor_id", F.round("distance", 6).alias("distance"))


@query("D20 G11 G12", BOX_SQL + """
, o AS (SELECT b.*, max(x + w) OVER (PARTITION BY page_id) AS pw, max(y + h) OVER (PARTITION BY page_id) AS ph FROM b)
SELECT page_id, node_id, round(x / pw, 6) AS px, round(y / ph, 6) AS py, round(CASE WHEN w / pw > 0 THEN ln(w / pw) ELSE 0 END, 6) AS pw, round(CASE WHEN h / ph > 0 THEN ln(h / ph) ELSE 0 END, 6) AS ph, (x + w > 0 OR (x + w = 0 AND y + h > 0)) AS positive FROM o
""")
def position_vector(t: Tables) -> DataFrame:
    from ..functions import visual

    w = W.partitionBy("page_id")
    b = boxes(t).withColumn("_pw", F.max(F.col("x") + F.col("w")).over(w)).withColumn("_ph", F.max(F.col("y") + F.col("h")).over(w))
    box = [F.col(c) for c in "xywh"]
    v = visual.position(*box, F.col("_pw"), F.col("_ph"))
    return b.select("page_id", "node_id", *[F.round(F.get(v, F.lit(k)), 6).alias(n) for k, n in enumerate(("px", "py", "pw", "ph"))], visual.is_positive(*box).alias("positive"))
