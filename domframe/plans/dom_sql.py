"""SQL that builds the trees of pages, as far as the given pages need it, to check the DOM queries.

One step of a recursion takes each page's next tag or text: paragraphs close each other, bold type goes on in later blocks
until it is closed, three times at most, and all else nests as it is written.
"""
from __future__ import annotations

from .text_queries import BASIC, WS

_LAST = "len({0}) - list_position(list_reverse({0}), {1})"


def normal(c: str) -> str:
    return f"trim(regexp_replace({c}, '{WS}+', ' ', 'g'))"


TREE = rf"""
WITH RECURSIVE src AS (SELECT page_id, url, html, regexp_replace(regexp_replace(html, '<!--.*?-->|<!DOCTYPE[^>]*>', '', 'gs'), '<head>.*?</head>', '', 'gs') AS body FROM pages),
raw AS (SELECT page_id, regexp_extract_all(body, '<[^>]*>|[^<]+') AS parts FROM src),
tok AS (SELECT page_id, k, part, CASE WHEN starts_with(part, '</') THEN 'E' WHEN starts_with(part, '<') THEN 'S' WHEN regexp_full_match(part, '{WS}*') THEN 'N' ELSE 'T' END AS kind, regexp_extract(part, '^</?([a-z0-9]+)', 1) AS tag
  FROM (SELECT page_id, unnest(range(1, len(parts) + 1)) AS k, unnest(parts) AS part FROM raw)),
run AS (
  SELECT page_id, 0::BIGINT AS k, 1 AS n, [0] AS ids, ['html'] AS tags, []::INT[] AS bold, [{{'id': 0, 'parent': NULL::INT, 'tag': 'html', 'depth': 0, 'part': ''}}] AS made FROM src
  UNION ALL
  SELECT page_id, k, n + m + own, CASE WHEN push THEN list_append(ids, n + m) ELSE ids END, CASE WHEN push THEN list_append(tags, tag) ELSE tags END,
    CASE WHEN push AND tag = 'b' THEN list_append(bold, n + m)[-3:] ELSE bold END,
    list_concat(list_transform(range(m), lambda i: {{'id': (n + i)::INT, 'parent': CASE WHEN i = 0 THEN top ELSE (n + i - 1)::INT END, 'tag': 'b', 'depth': (depth + i)::INT, 'part': ''}}),
      CASE WHEN own = 1 THEN [{{'id': n + m, 'parent': ids[-1], 'tag': CASE WHEN kind = 'T' THEN '-text' ELSE tag END, 'depth': len(ids)::INT, 'part': part}}] ELSE [] END)
  FROM (
    SELECT *, len(missing)::INT AS m, ids0[-1] AS top, len(ids0)::INT AS depth, list_concat(ids0, list_transform(range(len(missing)), lambda i: (n + i)::INT)) AS ids, list_concat(tags0, list_transform(range(len(missing)), lambda i: 'b')) AS tags,
      list_transform(bold0, lambda x: CASE WHEN list_contains(missing, x) THEN (n + list_position(missing, x) - 1)::INT ELSE x END) AS bold,
      CASE WHEN kind = 'T' OR kind = 'S' AND tag <> 'html' THEN 1 ELSE 0 END AS own, kind = 'S' AND tag NOT IN ('html', 'br') AS push
    FROM (
      SELECT *, CASE WHEN kind = 'T' OR kind = 'S' AND tag IN ('b', 'br', 'a') THEN list_filter(bold0, lambda x: NOT list_contains(ids0, x)) ELSE [] END AS missing
      FROM (
        SELECT page_id, k, n, kind, tag, part, bold0, ids1[1:cut] AS ids0, tags1[1:cut] AS tags0
        FROM (
          SELECT r.page_id, t.k, r.n, t.kind, t.tag, t.part, r.bold AS bold0, r.ids AS ids1, r.tags AS tags1,
            CASE WHEN t.kind = 'E' AND t.tag <> 'body' AND list_contains(r.tags, t.tag) THEN {_LAST.format('r.tags', 't.tag')} WHEN t.kind = 'S' AND t.tag IN ('p', 'article', 'footer', 'div', 'ul', 'nav', 'h1') AND list_contains(r.tags, 'p') THEN {_LAST.format('r.tags', "'p'")} ELSE len(r.tags) END AS cut
          FROM run r JOIN tok t ON t.page_id = r.page_id AND t.k = r.k + 1))))),
made AS (SELECT page_id, unnest(made) AS x FROM run),
flat AS (SELECT page_id, x.id AS node_id, x.parent AS parent_id, x.tag AS tag, x.depth AS depth, x.part AS part, x.tag = '-text' AS is_text FROM made),
node AS (SELECT *, count(*) OVER (PARTITION BY page_id, parent_id, tag) AS same, row_number() OVER (PARTITION BY page_id, parent_id, tag ORDER BY node_id) AS nth, row_number() OVER (PARTITION BY page_id, parent_id ORDER BY node_id) - 1 AS pos, count(*) OVER (PARTITION BY page_id, parent_id) AS siblings,
  CASE WHEN is_text THEN regexp_replace(replace(replace(replace(part, '&copy;', '©'), '&middot;', '·'), '&quot;', '"'), '&amp;?', '&', 'g') END AS text FROM flat),
step AS (
  SELECT page_id, node_id, '/html' AS xpath, '' AS index_path, NULL::VARCHAR AS parent_tag FROM node WHERE parent_id IS NULL
  UNION ALL
  SELECT n.page_id, n.node_id, s.xpath || '/' || CASE WHEN n.is_text THEN 'text()' ELSE n.tag END || CASE WHEN n.same > 1 THEN '[' || n.nth || ']' ELSE '' END, CASE WHEN s.index_path = '' THEN '' ELSE s.index_path || '.' END || n.pos, p.tag
  FROM node n JOIN step s ON s.page_id = n.page_id AND s.node_id = n.parent_id JOIN node p ON p.page_id = n.page_id AND p.node_id = n.parent_id),
dom AS (SELECT n.*, s.xpath, s.index_path, s.parent_tag FROM node n JOIN step s USING (page_id, node_id)),
title AS (SELECT page_id, {normal("regexp_extract(html, '(?s)<h1[^>]*>([^<]*)', 1)")} AS title FROM src),
gold AS (SELECT d.page_id, 'title' AS label_key, 0 AS group_idx, d.node_id FROM dom d JOIN title USING (page_id) WHERE is_text AND {normal("text")} = title),
valid AS (SELECT page_id, count(g.node_id) AS n FROM src LEFT JOIN gold g USING (page_id) GROUP BY page_id)
"""

NODES = TREE + "SELECT page_id, count(*) AS nodes, count(*) FILTER (WHERE is_text) AS texts, max(depth) AS depth, max(node_id) AS last FROM dom GROUP BY page_id"
XPATHS = TREE + "SELECT page_id, node_id, xpath, index_path FROM dom"
LABELS = TREE + "SELECT page_id, label_key, group_idx, node_id FROM gold"
VALID = TREE + "SELECT page_id, n >= 1 AS enough_nodes, true AS no_empty, n > 0 AS some_gold, true AS one_label, true AS has_visuals, true AS all_boxed, n > 0 AS valid FROM valid"
SUMMARY = TREE + "SELECT count(*) FILTER (WHERE n = 0) AS invalid, count(*) AS tested FROM valid"
MISMATCHES = TREE + """
SELECT page_id, xpath, 'no visuals' AS problem FROM dom WHERE xpath NOT IN ('/html', '/html/body', '/html/body/article') UNION ALL SELECT page_id, '/html/body/aside', 'unused' FROM src"""
VARIABLE = TREE + r"""
SELECT website, xpath, texts, false AS labeled FROM (SELECT *, row_number() OVER (PARTITION BY website ORDER BY texts DESC, seen) AS rn FROM (
  SELECT regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1) AS website, xpath, count(DISTINCT text) AS texts, min((page_id, node_id)) AS seen FROM dom JOIN src USING (page_id) WHERE is_text GROUP BY ALL) WHERE texts > 5) WHERE rn <= 300"""
EXTRACTION = TREE + """
, held AS (SELECT DISTINCT page_id, parent_id AS node_id FROM dom WHERE is_text)
SELECT page_id, count(*) FILTER (WHERE w) AS evaluated, count(*) FILTER (WHERE NOT w) AS skipped FROM (SELECT d.page_id, d.is_text OR h.node_id IS NOT NULL OR d.tag IN ('a', 'br') AS w FROM dom d LEFT JOIN held h ON h.page_id = d.page_id AND h.node_id = d.node_id) GROUP BY page_id"""
PREDICTED = TREE + f"""
SELECT page_id, label_key, (row_number() OVER (PARTITION BY page_id, label_key ORDER BY node_id % 7 DESC, node_id) - 1)::INT AS group_idx, node_id, value FROM (SELECT page_id, node_id, CASE parent_tag WHEN 'h1' THEN 'title' ELSE 'link' END AS label_key, {normal("text")} AS value FROM dom WHERE is_text AND parent_tag IN ('h1', 'a'))"""
TAGS = TREE + """
, up AS (SELECT page_id, node_id, parent_id, tag, siblings FROM node),
own AS (SELECT page_id, node_id, tag, CASE WHEN tag = '-text' THEN parent_id WHEN tag IN ('span', 'div') AND parent_id IS NOT NULL THEN parent_id ELSE node_id END AS top FROM up),
climb AS (SELECT page_id, node_id, top FROM own UNION ALL SELECT c.page_id, c.node_id, u.parent_id FROM climb c JOIN up u ON u.page_id = c.page_id AND u.node_id = c.top WHERE u.tag IN ('span', 'div') AND u.siblings = 1 AND u.parent_id IS NOT NULL),
ends AS (SELECT page_id, node_id, min(top) AS top FROM climb GROUP BY ALL)
SELECT d.page_id, d.node_id, CASE WHEN d.is_text THEN '=' || """ + normal("d.text") + """ ELSE '<' || d.tag || '>' END AS shown, CASE WHEN NOT d.is_text AND contains(d.part, 'class="') THEN regexp_extract(d.part, 'class="([^"]*)"', 1) END AS class, u.tag AS semantic_tag
FROM dom d JOIN ends e ON e.page_id = d.page_id AND e.node_id = d.node_id JOIN up u ON u.page_id = d.page_id AND u.node_id = e.top"""

EXPLORED = TREE + f"""
SELECT g.page_id, label_key, xpath, {normal("text")} AS text, tag, NULL::DOUBLE AS width FROM gold g JOIN dom d ON d.page_id = g.page_id AND d.node_id = g.node_id"""
VALID_VISUALS = TREE + """
, held AS (SELECT g.page_id, bool_and(d.xpath = '/html/body/article/h1/text()' AND g.page_id % 2 = 0 AND g.page_id % 3 <> 0) AS boxed FROM gold g JOIN dom d ON d.page_id = g.page_id AND d.node_id = g.node_id GROUP BY g.page_id)
SELECT page_id, n >= 1 AS enough_nodes, true AS no_empty, n > 0 AS some_gold, true AS one_label, page_id % 3 <> 0 AS has_visuals, coalesce(boxed, true) AS all_boxed, n > 0 AND page_id % 3 <> 0 AND coalesce(boxed, true) AS valid FROM valid LEFT JOIN held USING (page_id)"""
#: Attributes of the drawn elements, as the queries' visuals have them.
DRAWN = """
, drawn AS (SELECT page_id, '/html' AS xpath, 1000.0::DOUBLE + page_id AS height, []::VARCHAR[] AS style FROM src UNION ALL SELECT page_id, '/html/body', 900, ['fontSize":"' || page_id % 30] FROM src
  UNION ALL SELECT page_id, '/html/body/article', 600, ['border":"2px solid red', 'color":"#ff0000ff'] FROM src UNION ALL SELECT page_id, '/html/body/aside', 1, [] FROM src)
"""
_JSON = "'{{' || array_to_string(list_transform(list_sort({}), lambda x: '\"' || x || '\"'), ',') || '}}'"
ROUND_TRIP = TREE + DRAWN + f"SELECT page_id, xpath, height, {_JSON.format('style')} AS attrs FROM drawn"
SELECTED = TREE + DRAWN + f"""
SELECT d.page_id, d.xpath, d.tag, s.xpath IS NOT NULL AS boxed, CASE WHEN s.xpath IS NOT NULL THEN {_JSON.format("list_filter(s.style, lambda x: NOT starts_with(x, 'border'))")} END AS style
FROM dom d LEFT JOIN drawn s ON s.page_id = d.page_id AND s.xpath = d.xpath LEFT JOIN gold g ON g.page_id = d.page_id AND g.node_id = d.node_id WHERE s.xpath IS NOT NULL OR g.node_id IS NOT NULL"""
DIFFERENCES = TREE + DRAWN + """
SELECT d.page_id, d.xpath, 'only first' AS problem FROM dom d LEFT JOIN drawn s ON s.page_id = d.page_id AND s.xpath = d.xpath WHERE s.xpath IS NULL AND regexp_replace(d.xpath, '/[^/]*$', '') IN ('/html', '/html/body', '/html/body/article') UNION ALL SELECT page_id, '/html/body/aside', 'only second' FROM src"""
BLENDED = TREE + DRAWN + f"""
, tags AS (SELECT d.page_id, d.xpath, d.tag, CASE WHEN d.node_id = 0 THEN regexp_extract(s.body, '<html[^>]*>') WHEN d.is_text THEN '' ELSE d.part END AS part FROM dom d JOIN src s USING (page_id)),
own AS (SELECT page_id, xpath, tag, list_transform(regexp_extract_all(part, '\\w+="[^"]*"'), lambda x: regexp_extract(x, '^(\\w+)=', 1) || '":"' || regexp_extract(x, '="(.*)"$', 1)) AS attrs FROM tags)
SELECT coalesce(o.page_id, s.page_id) AS page_id, coalesce(o.xpath, s.xpath) AS xpath, o.tag, {_JSON.format("list_concat(coalesce(o.attrs, []), list_transform(coalesce(s.style, []), lambda x: '_' || x))")} AS attrs FROM own o FULL JOIN drawn s ON s.page_id = o.page_id AND s.xpath = o.xpath"""

#: Texts of nodes, their classes and ids, and the numbers of their tags' path.
WORDS = TREE + f"""
, num AS (SELECT tag, row_number() OVER (ORDER BY tag) AS id FROM (SELECT DISTINCT tag FROM dom)),
way AS (SELECT d.page_id, d.node_id, n.id::VARCHAR AS path FROM dom d JOIN num n USING (tag) WHERE parent_id IS NULL UNION ALL SELECT d.page_id, d.node_id, w.path || ' ' || n.id FROM dom d JOIN way w ON w.page_id = d.page_id AND w.node_id = d.parent_id JOIN num n ON n.tag = d.tag),
said AS (SELECT page_id, node_id, 0 AS kind, {normal("text")} AS text FROM dom WHERE is_text UNION ALL SELECT page_id, node_id, 1, trim(regexp_extract(part, 'class="([^"]*)"', 1) || ' ' || regexp_extract(part, ' id="([^"]*)"', 1)) FROM dom WHERE NOT is_text),
lists AS (SELECT page_id, node_id, kind, {BASIC} AS tk FROM said),
words AS (SELECT page_id, node_id, kind, unnest(range(1, len(tk) + 1)) AS place, unnest(tk) AS token FROM lists),
voc AS (SELECT token, row_number() OVER (ORDER BY n DESC, token) AS id FROM (SELECT token, count(*) AS n FROM words WHERE kind = 0 GROUP BY token)),
got AS (SELECT page_id, node_id, string_agg(id::VARCHAR, ' ' ORDER BY place) FILTER (WHERE kind = 0 AND place <= 15) AS ids, string_agg(id::VARCHAR, ' ' ORDER BY place) FILTER (WHERE kind = 1) AS attr_ids FROM words JOIN voc USING (token) GROUP BY ALL)
SELECT w.page_id, w.node_id, coalesce(ids, '0') AS ids, coalesce(attr_ids, '0') AS attr_ids, w.path FROM way w LEFT JOIN got g ON g.page_id = w.page_id AND g.node_id = w.node_id"""
SELECTORS = TREE + r"""
, plain AS (SELECT d.page_id, d.node_id, d.parent_id, d.tag, d.part, regexp_replace(d.xpath, '\[\d+\]', '', 'g') AS path, EXISTS (SELECT 1 FROM flat c WHERE c.page_id = d.page_id AND c.parent_id = d.node_id) AS full_, EXISTS (SELECT 1 FROM flat h WHERE h.page_id = d.page_id AND h.parent_id = d.parent_id AND h.tag = 'h1' AND h.node_id < d.node_id) AS late FROM dom d),
hit AS (SELECT page_id, node_id, full_, 'links' AS label_key FROM plain WHERE tag = 'a' AND contains(part, ' href="') AND regexp_matches(path, '/nav/(.*/)?li/a$')
  UNION ALL SELECT page_id, node_id, full_, 'title' FROM plain WHERE tag = 'h1' AND contains(path, '/article/')
  UNION ALL SELECT page_id, node_id, full_, 'ads' FROM plain WHERE tag = 'div' AND list_contains(string_split(regexp_extract(part, 'class="([^"]*)"', 1), ' '), 'ad')
  UNION ALL SELECT page_id, node_id, full_, 'after' FROM plain WHERE tag = 'p' AND late),
kept AS (SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY page_id, label_key) AS n FROM hit) WHERE n = 1 OR full_)
SELECT page_id, label_key, node_id::BIGINT AS node_id, NULL::VARCHAR AS error FROM kept
UNION ALL SELECT page_id, label_key, NULL, 'no match' FROM src, (VALUES ('links'), ('title'), ('ads'), ('after')) v(label_key) WHERE NOT EXISTS (SELECT 1 FROM kept k WHERE k.page_id = src.page_id AND k.label_key = v.label_key)
UNION ALL SELECT page_id, 'bad', NULL, 'unknown :nope' FROM src"""
