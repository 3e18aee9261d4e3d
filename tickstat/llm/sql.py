"""DuckDB SQL for those queries that SQL can express."""

from __future__ import annotations

OP10 = r"""
WITH dw AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
iw AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
win AS (
  SELECT DISTINCT item_id, m, array_to_string(w[s:s + m - 1], ' ') AS g
  FROM (SELECT item_id, w, least(10, len(w)) AS m, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS s FROM iw WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT m FROM win),
dg AS (
  SELECT doc_id, m, s, array_to_string(w[s:s + m - 1], ' ') AS g
  FROM (SELECT doc_id, w, m, unnest(range(1, len(w) - m + 2)) AS s FROM dw, sizes WHERE len(w) >= m)),
hit AS (SELECT doc_id, m, s, item_id FROM dg JOIN win USING (m, g)),
pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + m)) AS p FROM (SELECT DISTINCT doc_id, m, s FROM hit)) GROUP BY doc_id),
ids AS (SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS l FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS i FROM hit) GROUP BY doc_id)
SELECT dw.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(l, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN pos USING (doc_id) LEFT JOIN ids USING (doc_id)
"""

OP5 = r"""
WITH RECURSIVE dw AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sh AS (
  SELECT DISTINCT doc_id, array_to_string(w[s:s + 2], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 1, 2))) AS s FROM dw WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
link AS (
  SELECT a.doc_id AS x, b.doc_id AS y FROM sh a JOIN sh b ON a.g = b.g AND a.doc_id <> b.doc_id JOIN n na ON na.doc_id = a.doc_id JOIN n nb ON nb.doc_id = b.doc_id
  WHERE least(na.n, nb.n) * 100 >= 90 * greatest(na.n, nb.n)
  GROUP BY x, y, na.n, nb.n HAVING 100 * count(*) >= 90 * (na.n + nb.n - count(*))),
reach(x, y) AS (SELECT doc_id, doc_id FROM n UNION SELECT reach.x, link.y FROM reach JOIN link ON reach.y = link.x)
SELECT dw.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, CAST(coalesce(min(y), dw.doc_id) AS BIGINT) AS component_id
FROM dw LEFT JOIN n USING (doc_id) LEFT JOIN reach ON reach.x = dw.doc_id GROUP BY dw.doc_id, n.n
"""

#: crc32 (as in RFC 1952) of a text's UTF-8 bytes, from a 256-entry table made by rule.
CRC = "tab AS (SELECT list(list_reduce(list_prepend(i, list_transform(range(8), lambda k: 0::BIGINT)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS t FROM range(256) x(i))"


def _crc(text: str) -> str:
    """SQL of the unsigned crc32 of a text expression; ``tab`` has to be in scope."""
    octets = f"list_transform(range(octet_length(encode({text}))), lambda i: ('0x' || substr(hex(encode({text})), 2 * i + 1, 2))::BIGINT)"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {octets}), lambda a, b: xor(a >> 8, t[1 + (xor(a, b) & 255)])), 4294967295)"


OP12 = rf"""
WITH RECURSIVE {CRC},
run AS (
  SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS d, translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS r
  FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z\x{{00C0}}-\x{{00FF}}]+')) AS x FROM documents) WHERE length(x) >= 7),
hashed AS (SELECT r, {_crc("d || ':' || r")} AS h FROM run, tab),
w AS (
  SELECT x AS word, count(*) AS n
  FROM (SELECT CASE WHEN h % 31 = 0 THEN substr(r, 1, h % length(r)) || substr(r, h % length(r) + 2) ELSE r END AS x FROM hashed)
  WHERE length(x) >= 7 GROUP BY x HAVING count(*) >= 2),
cut AS (SELECT word, n, i, substr(word, 1, i - 1) AS a, substr(word, i + 1) AS b FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM w)),
pair AS (
  SELECT x.word AS s, y.word AS r, y.n FROM cut x JOIN cut y ON x.i = y.i AND x.a = y.a AND x.b = y.b AND x.word <> y.word
  UNION SELECT cut.word, w.word, w.n FROM cut JOIN w ON w.word = a || b
  UNION SELECT w.word, cut.word, cut.n FROM cut JOIN w ON w.word = a || b),
best AS (SELECT s, count(*) AS n_near, arg_min(r, row(-n, r)) AS r, max(n) AS n FROM pair GROUP BY s),
form AS (SELECT word, w.n, n_near, CASE WHEN best.n >= 10 * w.n THEN r END AS form, CASE WHEN best.n >= 10 * w.n THEN best.n END AS form_n FROM w LEFT JOIN best ON s = word),
chain AS (SELECT word, word AS got, 0 AS step FROM form UNION ALL SELECT chain.word, form.form, step + 1 FROM chain JOIN form ON form.word = chain.got WHERE form.form IS NOT NULL),
root AS (SELECT word, arg_max(got, step) AS root FROM chain GROUP BY word)
SELECT word, form, root, CAST(n AS BIGINT) AS n, CAST(coalesce(n_near, 0) AS BIGINT) AS n_near, CAST(form_n AS BIGINT) AS form_n FROM form JOIN root USING (word)
"""

OP13 = rf"""
WITH {CRC},
turn AS (SELECT conv_id AS c, coalesce(role, '') AS r, coalesce(text, '') AS x, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS p FROM conversations WHERE conv_id IS NOT NULL),
size AS (SELECT c, count(*) AS n FROM turn GROUP BY c),
plan AS (SELECT c, c - c % 5 AS base, {_crc("CAST(c AS VARCHAR)")} % 9 AS h FROM size, tab),
cut AS (SELECT plan.*, least(h, coalesce(n, 0)) AS k FROM plan LEFT JOIN size ON size.c = plan.base),
again AS (
  SELECT cut.c, p, r, x FROM cut JOIN turn ON turn.c = cut.base AND p <= h
  UNION ALL SELECT cut.c, k + p - h, r, x FROM cut JOIN turn ON turn.c = cut.c AND p > h),
path AS (SELECT cut.c, coalesce(list([r, x] ORDER BY p) FILTER (p IS NOT NULL), []) AS l FROM cut LEFT JOIN again ON again.c = cut.c GROUP BY cut.c),
pre AS (SELECT c, len(l) AS n, d, l[1:d] AS k FROM (SELECT c, l, unnest(range(0, len(l) + 1)) AS d FROM path)),
node AS (SELECT d, k, min(c) AS conv_id, count(*) AS n_convs, (count(*) - 1) * octet_length(encode(coalesce(k[-1][2], ''))) AS saved, string_agg(c, ',' ORDER BY c) FILTER (n = d) AS ends FROM pre GROUP BY d, k),
named AS (SELECT pre.c, pre.d, node.conv_id FROM pre JOIN node ON node.d = pre.d AND node.k = pre.k),
edge AS (SELECT node.*, named.conv_id AS parent_conv_id FROM node LEFT JOIN named ON named.c = node.conv_id AND named.d = node.d - 1),
kids AS (SELECT parent_conv_id AS conv_id, d - 1 AS d, count(*) AS n FROM edge WHERE d > 0 GROUP BY ALL),
val AS (SELECT edge.*, coalesce(kids.n, 0) AS n_children FROM edge LEFT JOIN kids USING (conv_id, d)),
total AS (
  SELECT named.conv_id, named.d, count(*) FILTER (n_children = 0) AS n_leaves, sum(saved) AS saved_tokens
  FROM val JOIN named ON named.c = val.conv_id AND named.d <= val.d GROUP BY named.conv_id, named.d)
SELECT conv_id, CAST(d AS BIGINT) AS depth, parent_conv_id, n_convs, n_children, CAST(n_leaves AS BIGINT) AS n_leaves, CAST(saved_tokens AS BIGINT) AS saved_tokens, sha256(coalesce(ends, '')) AS ends_sha256
FROM val JOIN total USING (conv_id, d)
"""

SQL: dict[str, str] = {
    "op5_jaccard": OP5,
    "op10_decontaminate": OP10,
    "op12_variants": OP12,
    "op13_trie": OP13,
}
