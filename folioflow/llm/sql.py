"""SQL of the operators that SQL can express."""

OP6_SQL = r"""
WITH RECURSIVE texts AS (
  SELECT doc_id, coalesce(text, '') AS text FROM documents),
classes AS (
  SELECT text, min(doc_id) AS id, count(*) AS copies, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w FROM texts GROUP BY text),
grams AS (
  SELECT id, unnest(CASE WHEN len(w) >= 5 THEN list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')))
    WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS gram FROM classes),
sizes AS (
  SELECT id, count(*) AS n FROM grams GROUP BY id),
shared AS (
  SELECT a.id AS a, b.id AS b, count(*) AS both_ FROM grams a JOIN grams b ON a.gram = b.gram AND a.id < b.id GROUP BY ALL),
linked AS (
  SELECT a, b FROM shared JOIN sizes x ON x.id = a JOIN sizes y ON y.id = b WHERE 5 * both_ >= 4 * (x.n + y.n - both_)),
sides AS (
  SELECT a, b FROM linked UNION ALL SELECT b, a FROM linked),
reach(id, other) AS (
  SELECT id, id FROM classes UNION SELECT r.id, s.b FROM reach r JOIN sides s ON s.a = r.other),
labels_ AS (
  SELECT id, min(other) AS class_id FROM reach GROUP BY id),
counts AS (
  SELECT s.a AS id, cast(sum(c.copies) AS BIGINT) AS n, count(*) AS m FROM sides s JOIN classes c ON c.id = s.b GROUP BY s.a)
SELECT doc_id, class_id, copies - 1 + coalesce(n, 0) AS n_links, coalesce(m, 0) AS n_class_links
FROM texts JOIN classes USING (text) JOIN labels_ USING (id) LEFT JOIN counts USING (id)
"""

OP3_SQL = """
WITH bytes AS (
  SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
windows AS (
  SELECT doc_id, s, md5(substr(h, 2 * s + 1, 800)) AS m FROM (SELECT doc_id, h, unnest(range(0, length(h) // 2 - 399)) AS s FROM bytes)),
repeated AS (
  SELECT doc_id, s FROM windows WHERE m IN (SELECT m FROM windows GROUP BY m HAVING count(*) > 1)),
marked AS (
  SELECT doc_id, s, CASE WHEN s - lag(s) OVER (PARTITION BY doc_id ORDER BY s) <= 400 THEN 0 ELSE 1 END AS new FROM repeated),
spans AS (
  SELECT doc_id, min(s) AS a, max(s) + 400 AS z FROM (SELECT doc_id, s, sum(new) OVER (PARTITION BY doc_id ORDER BY s) AS k FROM marked) GROUP BY doc_id, k),
gaps AS (
  SELECT doc_id, a, z, coalesce(lag(z) OVER (PARTITION BY doc_id ORDER BY a), 0) AS before FROM spans),
cut AS (
  SELECT doc_id, count(*) AS n_spans, cast(sum(z - a) AS BIGINT) AS n_removed, max(z) AS last, string_agg(substr(h, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) AS kept FROM gaps JOIN bytes USING (doc_id) GROUP BY doc_id)
SELECT doc_id, length(h) // 2 AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
  sha256(unhex(coalesce(kept, '') || substr(h, 2 * coalesce(last, 0) + 1))) AS kept_sha256
FROM bytes LEFT JOIN cut USING (doc_id)
"""


def crc32_sql(x: str) -> str:
    """CRC-32 of a string of ASCII characters, bit by bit."""
    step = "lambda a, b: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END"
    codes = f"list_transform(string_split({x}, ''), lambda c: cast(ascii(c) AS BIGINT))"
    return f"xor(list_reduce(list_prepend(4294967295, {codes}), lambda crc, c: list_reduce(list_prepend(xor(crc, c), range(8)), {step})), 4294967295)"


OP11_SQL = f"""
WITH own AS (
  SELECT conv_id, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(strlen(role) || ':' || role || text)) - 1 AS place
  FROM (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL)),
convs AS (
  SELECT conv_id, count(*) AS n, {crc32_sql("cast(conv_id AS VARCHAR)")} % 9 AS h, conv_id - conv_id % 5 AS base FROM own GROUP BY conv_id),
turns AS (
  SELECT c.conv_id, place, role, text FROM convs c JOIN own o ON o.conv_id = c.base WHERE place < h
  UNION ALL
  SELECT c.conv_id, place - c.h + least(c.h, coalesce(b.n, 0)), role, text FROM convs c JOIN own o ON o.conv_id = c.conv_id LEFT JOIN convs b ON b.conv_id = c.base WHERE place >= c.h),
rebuilt AS (
  SELECT conv_id, coalesce(list({{'role': role, 'text': text}} ORDER BY place) FILTER (place IS NOT NULL), []) AS s FROM convs LEFT JOIN turns USING (conv_id) GROUP BY conv_id),
paths AS (
  SELECT conv_id AS member, d AS depth, s[1:d] AS prefix, d = len(s) AS ended, CASE WHEN d = 0 THEN 0 ELSE strlen(s[d].text) END AS size
  FROM (SELECT conv_id, s, unnest(range(0, len(s) + 1)) AS d FROM rebuilt)),
nodes AS (
  SELECT depth, prefix, min(member) AS conv_id, count(*) AS n_convs, (count(*) - 1) * max(size) AS saved, coalesce(string_agg(cast(member AS VARCHAR), ',' ORDER BY member) FILTER (ended), '') AS ends
  FROM paths GROUP BY depth, prefix),
lines AS (
  SELECT member, depth, n.conv_id AS node FROM paths JOIN nodes n USING (depth, prefix)),
linked AS (
  SELECT n.conv_id, n.depth, n_convs, saved, ends, p.node AS parent FROM nodes n LEFT JOIN lines p ON p.member = n.conv_id AND p.depth = n.depth - 1),
children AS (
  SELECT parent AS conv_id, depth - 1 AS depth, count(*) AS n_children FROM linked WHERE parent IS NOT NULL GROUP BY ALL),
counted AS (
  SELECT linked.*, coalesce(n_children, 0) AS n_children FROM linked LEFT JOIN children USING (conv_id, depth)),
below AS (
  SELECT l.node AS conv_id, l.depth, count(*) FILTER (n_children = 0) AS n_leaves, cast(sum(saved) AS BIGINT) AS saved_tokens
  FROM counted c JOIN lines l ON l.member = c.conv_id AND l.depth <= c.depth GROUP BY ALL)
SELECT conv_id, depth, parent AS parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, sha256(ends) AS ends_sha256 FROM counted JOIN below USING (conv_id, depth)
"""


def _leaf_sql(text: str) -> str:
    field = lambda c: f"coalesce(strlen(cast({c} AS VARCHAR)) || ':' || {c}, '-')"
    return f"sha256({' || '.join(map(field, ('doc_id', 'source', 'lang', 'n_chars', text)))})"


_BESIDE = """coalesce(lag(h, 2) OVER w, '') || coalesce(lag(h) OVER w, '') AS before, coalesce(lead(h) OVER w, '') || coalesce(lead(h, 2) OVER w, '') AS after"""
OP12_SQL = f"""
WITH RECURSIVE rows_ AS (
  SELECT doc_id, source, {_leaf_sql("text")} AS leaf, CASE WHEN {crc32_sql("cast(doc_id AS VARCHAR)")} % 2 = 0 THEN {_leaf_sql("replace(text, chr(10), '')")} ELSE {_leaf_sql("text")} END AS claimed FROM documents),
leaves AS (
  SELECT *, row_number() OVER o - 1 AS i, count(*) OVER (PARTITION BY source) AS n FROM rows_ WINDOW o AS (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf)),
nodes AS (
  SELECT source, 0 AS level, i, n, leaf AS h FROM leaves
  UNION ALL
  SELECT source, level + 1, i // 3, any_value((n + 2) // 3), sha256(string_agg(h, '' ORDER BY i)) FROM nodes WHERE n > 1 GROUP BY source, level, i // 3),
subroots AS (
  SELECT source, h, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS i, count(*) OVER () AS n FROM nodes WHERE n = 1),
upper_ AS (
  SELECT 0 AS level, i, n, h FROM subroots
  UNION ALL
  SELECT level + 1, i // 3, any_value((n + 2) // 3), sha256(string_agg(h, '' ORDER BY i)) FROM upper_ WHERE n > 1 GROUP BY level, i // 3),
beside AS (
  SELECT source, level, i, n, {_BESIDE} FROM nodes WINDOW w AS (PARTITION BY source, level, i // 3 ORDER BY i)),
upper_beside AS (
  SELECT level, i, n, {_BESIDE} FROM upper_ WINDOW w AS (PARTITION BY level, i // 3 ORDER BY i)),
climbs AS (
  SELECT l.source, l.i AS leaf_i, 0 AS level, l.i, claimed AS h, '' AS proof FROM leaves l
  UNION ALL
  SELECT c.source, leaf_i, c.level + 1, c.i // 3, sha256(before || c.h || after), proof || before || after
  FROM climbs c JOIN beside b ON b.source IS NOT DISTINCT FROM c.source AND b.level = c.level AND b.i = c.i WHERE b.n > 1),
arrived AS (
  SELECT source, leaf_i, arg_max(h, level) AS h, arg_max(proof, level) AS proof FROM climbs GROUP BY source, leaf_i),
upper_climbs AS (
  SELECT a.source, leaf_i, 0 AS level, s.i, a.h, proof FROM arrived a JOIN subroots s ON s.source IS NOT DISTINCT FROM a.source
  UNION ALL
  SELECT source, leaf_i, c.level + 1, c.i // 3, sha256(before || c.h || after), proof || before || after
  FROM upper_climbs c JOIN upper_beside b ON b.level = c.level AND b.i = c.i WHERE b.n > 1),
ended AS (
  SELECT source, leaf_i, arg_max(h, level) AS h, arg_max(proof, level) AS proof FROM upper_climbs GROUP BY source, leaf_i)
SELECT l.doc_id, l.leaf, s.h AS subroot, u.h AS root, sha256(e.proof) AS proof_sha256, e.h AS folded_root, e.h = u.h AS verified
FROM leaves l JOIN subroots s ON s.source IS NOT DISTINCT FROM l.source JOIN ended e ON e.source IS NOT DISTINCT FROM l.source AND e.leaf_i = l.i
JOIN (SELECT h FROM upper_ WHERE n = 1) u ON true
"""
