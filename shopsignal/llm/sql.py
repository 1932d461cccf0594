"""DuckDB SQL with the results of the queries that SQL can express."""

_WORDS = r"coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), [])"
_LETTERS = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
_BENCH_WORDS = rf"coalesce(regexp_extract_all(translate(text, {_LETTERS}), '[0-9a-z\x{{80}}-\x{{10FFFF}}]+'), [])"

OP1 = f"""
WITH w AS (SELECT doc_id, {_WORDS} AS ws FROM documents),
windows AS (
  SELECT doc_id, unnest(range(1, len(ws) - 33)) AS i,
         unnest(list_transform(range(1, len(ws) - 33), lambda i: md5(array_to_string(ws[i:i + 34], ' ')))) AS k
  FROM w WHERE len(ws) >= 35),
repeated AS (SELECT k FROM windows GROUP BY k HAVING count(*) > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 35)) AS j FROM windows WHERE k IN (SELECT k FROM repeated)),
words AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS j FROM w),
kept AS (
  SELECT words.doc_id, count(gone.j) AS n_removed, string_agg(CASE WHEN gone.j IS NULL THEN word END, ' ' ORDER BY words.j) AS t
  FROM words LEFT JOIN gone USING (doc_id, j) GROUP BY words.doc_id)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM w LEFT JOIN kept ON w.doc_id = kept.doc_id
"""

OP2 = f"""
WITH d AS (SELECT doc_id, source, CAST(len({_WORDS}) AS BIGINT) AS size FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
r AS (SELECT source, source_size, 2 * source_size AS cap, row_number() OVER (ORDER BY source NULLS LAST) AS pos,
             [5, 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS w FROM s),
c AS (SELECT *, sum(cap) OVER o - cap AS caps, sum(w) OVER o - w AS ws, sum(w) OVER () AS all_w, sum(source_size) OVER () AS total
      FROM r WINDOW o AS (ORDER BY cap * (10 // w), pos ROWS UNBOUNDED PRECEDING)),
f AS (SELECT *, 2 * cap * (all_w - ws) <= w * (3 * total - 2 * caps) AS stop FROM c),
t AS (SELECT source, source_size,
             CASE WHEN stop THEN CAST(cap AS DOUBLE) ELSE CAST(w * (3 * total - 2 * coalesce(sum(cap) FILTER (WHERE stop) OVER (), 0)) AS DOUBLE)
                  / CAST(2 * (all_w - coalesce(sum(w) FILTER (WHERE stop) OVER (), 0)) AS DOUBLE) END AS target FROM f),
e AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target) AS BIGINT) // source_size ELSE 0 END AS epochs FROM t),
p AS (SELECT doc_id, source, size,
             sum(size) OVER (PARTITION BY source ORDER BY left(md5('mix' || coalesce(CAST(doc_id AS VARCHAR), '')), 16), doc_id NULLS FIRST, size
                             ROWS UNBOUNDED PRECEDING) - size AS before FROM d)
SELECT p.doc_id, p.size, e.source_size, e.target,
       CAST(e.epochs * p.size + greatest(0, least(p.size, CAST(floor(e.target) AS BIGINT) - e.epochs * e.source_size - p.before)) AS BIGINT) AS taken
FROM p JOIN e ON p.source IS NOT DISTINCT FROM e.source
"""

OP8 = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS c FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, d.vec_id, CAST(list_dot_product(q.c, d.c) AS BIGINT) AS score
  FROM v q JOIN v d ON q.vec_id <> d.vec_id AND len(q.c) = len(d.c) WHERE q.vec_id % 50 = 0),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
SELECT * FROM r WHERE rank <= 5
"""

OP9 = f"""
WITH b AS (SELECT DISTINCT CAST(item_id AS VARCHAR) AS item, {_BENCH_WORDS} AS ws FROM benchmark WHERE item_id IS NOT NULL),
patterns AS (
  SELECT DISTINCT item, least(13, len(ws)) AS m,
         unnest(list_transform(range(1, len(ws) - least(13, len(ws)) + 2), lambda i: array_to_string(ws[i:i + least(13, len(ws)) - 1], ' '))) AS k
  FROM b WHERE len(ws) > 0),
d AS (SELECT doc_id, {_BENCH_WORDS} AS ws FROM documents),
windows AS (
  SELECT doc_id, m, unnest(range(1, len(ws) - m + 2)) AS i,
         unnest(list_transform(range(1, len(ws) - m + 2), lambda i: array_to_string(ws[i:i + m - 1], ' '))) AS k
  FROM d, (SELECT DISTINCT m FROM patterns) WHERE len(ws) >= m),
found AS (SELECT doc_id, i, m, item FROM windows JOIN patterns USING (m, k)),
hit AS (SELECT doc_id, count(*) AS n FROM (SELECT DISTINCT doc_id, unnest(range(i, i + m)) AS j FROM found) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS t FROM (SELECT DISTINCT doc_id, item FROM found) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(hit.n, 0) AS BIGINT) AS n_hit, CAST(coalesce(items.n, 0) AS BIGINT) AS n_items,
       sha256(coalesce(items.t, '')) AS items_sha256, coalesce(hit.n, 0) > 0 AND 20 * coalesce(hit.n, 0) >= len(ws) AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN items USING (doc_id)
"""

_JUNK = "casino|poker|free-bets|cheap-pills|adult|porn|xxx|ads-track|adserver|spam|spam-farm"

OP13 = rf"""
WITH u AS (SELECT page_id, url, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) END AS a FROM pages),
p AS (SELECT page_id, url, a, translate(coalesce(regexp_extract(a, '^[^/?#]*'), ''), {_LETTERS}) AS host,
             coalesce(regexp_extract(a, '^[^/?#]*([^?#]*)', 1), '') AS path FROM u),
rules(h, p, rule, verdict) AS (VALUES ('com', '/', 'com/', 'allow'), ('example.com', '/en/', 'example.com/en/', 'block'),
  ('www.example.com', '/en/', 'www.example.com/en/', 'allow'), ('net', '/es/', 'net/es/', 'block'), ('net', '/fr/', 'net/fr/', 'block')),
r AS (SELECT page_id, url, host, path, a,
             (SELECT max_by(struct_pack(rule, verdict), length(rule)) FROM rules
              WHERE (host = rules.h OR ends_with(host, '.' || rules.h)) AND starts_with(path, rules.p)) AS won FROM p)
SELECT page_id, host, path, won.rule AS rule,
       coalesce(won.verdict, CASE WHEN regexp_matches(translate(coalesce(a, url), {_LETTERS}), '^([^/?#]*\.)?({_JUNK})([^a-z0-9]|$)') THEN 'block' ELSE 'allow' END) AS verdict
FROM r
"""

#: the table of the reflected CRC-32, and the checksum of a text of ASCII characters
_CRC_TABLE = """crc_table AS (
  SELECT list_transform(range(256), lambda i: list_reduce([i] || range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END)) AS t)"""


def _crc32(text: str) -> str:
    return (f"xor(4294967295, list_reduce([4294967295::BIGINT] || list_transform(string_split({text}, ''), lambda ch: ord(ch)::BIGINT), "
            f"lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])))")


OP11 = f"""
WITH {_CRC_TABLE},
ids AS (SELECT DISTINCT conv_id, conv_id - conv_id % 5 AS base, {_crc32("CAST(conv_id AS VARCHAR)")} % 9 AS h FROM conversations, crc_table WHERE conv_id IS NOT NULL),
t AS (SELECT conv_id, md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS m, strlen(coalesce(text, '')) AS bytes, turn
      FROM conversations WHERE conv_id IS NOT NULL),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, m) AS pos FROM t),
r AS (SELECT ids.conv_id, 0 AS part, pos, m, bytes FROM ids JOIN o ON o.conv_id = ids.base AND pos <= h
      UNION ALL SELECT o.conv_id, 1, pos, m, bytes FROM ids JOIN o ON o.conv_id = ids.conv_id AND pos > h),
d AS (SELECT conv_id, m, bytes, row_number() OVER w AS depth, string_agg(m, ',') OVER (w ROWS UNBOUNDED PRECEDING) AS k FROM r WINDOW w AS (PARTITION BY conv_id ORDER BY part, pos)),
paths AS (SELECT conv_id, depth, k, bytes, CASE WHEN depth > 1 THEN left(k, -33) ELSE '' END AS up FROM d UNION ALL SELECT conv_id, 0, '', 0, NULL FROM ids),
nodes AS (SELECT k, depth, min(conv_id) AS conv_id, count(*) AS n, any_value(bytes) AS bytes, any_value(up) AS up FROM paths GROUP BY k, depth),
kids AS (SELECT up AS k, count(*) AS children FROM nodes WHERE up IS NOT NULL GROUP BY up),
sums AS (
  SELECT a.k, sum((n.n - 1) * n.bytes) AS saved, count(*) FILTER (kids.children IS NULL) AS leaves
  FROM nodes n LEFT JOIN kids USING (k) JOIN paths a ON a.conv_id = n.conv_id AND a.depth <= n.depth GROUP BY a.k),
lens AS (SELECT conv_id, max_by(k, depth) AS k FROM paths GROUP BY conv_id),
ends AS (SELECT k, sha256(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id)) AS e FROM lens GROUP BY k)
SELECT n.conv_id, CAST(n.depth AS BIGINT) AS depth, p.conv_id AS parent_conv_id, n.n AS n_convs, coalesce(children, 0) AS n_children, leaves AS n_leaves,
       CAST(saved AS BIGINT) AS saved_tokens, coalesce(e, sha256('')) AS ends_sha256
FROM nodes n LEFT JOIN nodes p ON p.k = n.up LEFT JOIN kids ON kids.k = n.k JOIN sums ON sums.k = n.k LEFT JOIN ends ON ends.k = n.k
"""

_BLANKS = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

OP12 = f"""
WITH RECURSIVE {_CRC_TABLE},
k AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
             {_crc32("coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ')")} % 20 AS k FROM conversations, crc_table),
d AS (SELECT conv_id, turn, CASE WHEN k = 4 THEN 'user' ELSE role END AS role,
             CASE k WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
             unnest(range(CASE WHEN k = 3 THEN 2 ELSE 1 END)) AS copy FROM k WHERE k <> 0),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(text), copy) AS pos, rtrim(text, {_BLANKS}) AS ends FROM d),
f AS (SELECT *, CASE WHEN ends = '' THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY pos) > 1 THEN 'duplicate'
                     WHEN right(ends, 1) NOT IN ('.', '!', '?') THEN 'truncated' END AS fault, left(role, 1) AS c,
             lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY pos) || left(role, 1) AS pair FROM o),
s AS (SELECT *, coalesce(fault IN ('blank', 'duplicate'), false) AS gone, CASE WHEN fault = 'truncated' THEN 3 ELSE 0 END AS x FROM f),
ids AS (SELECT DISTINCT conv_id FROM conversations),
totals AS (
  SELECT ids.conv_id, count(pos) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
         count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
         count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal
  FROM ids LEFT JOIN s ON ids.conv_id IS NOT DISTINCT FROM s.conv_id GROUP BY ids.conv_id),
togo AS (
  SELECT conv_id, n AS i, 0::BIGINT AS g0, 6::BIGINT AS g1, 3::BIGINT AS g2, 0::BIGINT AS g3 FROM totals
  UNION ALL
  SELECT conv_id, i, least(h0, 3 + h2, 6 + h3), least(h1, 3 + h2, 6 + h3), least(h2, 3 + h3), least(h3, 3 + h2)
  FROM (SELECT togo.conv_id, i - 1 AS i,
               least(4 + g0, CASE WHEN NOT gone THEN x + 3 + g2 END, CASE WHEN NOT gone AND c = 's' THEN x + g1 END, CASE WHEN NOT gone AND c = 'u' THEN x + g2 END) AS h0,
               least(4 + g1, CASE WHEN NOT gone THEN x + 3 + g2 END, CASE WHEN NOT gone AND c = 'u' THEN x + g2 END) AS h1,
               least(4 + g2, CASE WHEN NOT gone THEN x + 3 + g3 END, CASE WHEN NOT gone AND c = 'a' THEN x + g3 END) AS h2,
               least(4 + g3, CASE WHEN NOT gone THEN x + 3 + g2 END, CASE WHEN NOT gone AND c = 'u' THEN x + g2 END) AS h3
        FROM togo JOIN s ON togo.conv_id IS NOT DISTINCT FROM s.conv_id AND s.pos = togo.i)),
g AS (SELECT conv_id, i, [g0, g1, g2, g3] AS g FROM togo),
trace AS (
  SELECT conv_id, 0::BIGINT AS i, 0 AS st, '' AS audit, []::VARCHAR[] AS lines, false AS done FROM totals
  UNION ALL
  SELECT conv_id, CASE WHEN e IN ('I', 'E') THEN i ELSE i + 1 END, CASE e WHEN 'D' THEN st WHEN 'E' THEN st WHEN 'K' THEN ks ELSE nx END,
         CASE WHEN e = 'E' THEN audit ELSE audit || e END,
         CASE e WHEN 'K' THEN lines || [role || ':' || text] WHEN 'R' THEN lines || [nr || ':' || text] WHEN 'I' THEN lines || [nr || ':'] ELSE lines END,
         e = 'E'
  FROM (
    SELECT *, CASE WHEN pos IS NULL AND st IN (0, 3) THEN 'E' WHEN pos IS NULL THEN 'I'
                   WHEN 4 + g1[st + 1] = g0[st + 1] THEN 'D' WHEN 3 + g0[nx + 1] = g0[st + 1] THEN 'I'
                   WHEN NOT gone AND ks IS NOT NULL AND x + g1[ks + 1] = g0[st + 1] THEN 'K' ELSE 'R' END AS e
    FROM (
      SELECT t.*, s.pos, s.gone, s.x, s.role, s.text, a.g AS g0, b.g AS g1, CASE WHEN st = 2 THEN 3 ELSE 2 END AS nx,
             CASE WHEN st = 2 THEN 'assistant' ELSE 'user' END AS nr,
             CASE WHEN st = 0 AND c = 's' THEN 1 WHEN st IN (0, 1, 3) AND c = 'u' THEN 2 WHEN st = 2 AND c = 'a' THEN 3 END AS ks
      FROM trace t JOIN g a ON t.conv_id IS NOT DISTINCT FROM a.conv_id AND a.i = t.i
           LEFT JOIN g b ON t.conv_id IS NOT DISTINCT FROM b.conv_id AND b.i = t.i + 1
           LEFT JOIN s ON t.conv_id IS NOT DISTINCT FROM s.conv_id AND s.pos = t.i + 1
      WHERE NOT t.done)))
SELECT totals.conv_id, gaps, blank, duplicate, truncated, illegal, g.g[1] AS cost, audit, sha256(array_to_string(lines, chr(10))) AS repaired_sha256
FROM totals JOIN trace ON totals.conv_id IS NOT DISTINCT FROM trace.conv_id AND trace.done
     JOIN g ON totals.conv_id IS NOT DISTINCT FROM g.conv_id AND g.i = 0
"""

ORACLE_SQL = {"op1_substring_dedup": OP1, "op2_source_mix": OP2, "op8_exact_topk": OP8, "op9_decontamination": OP9, "op11_prefix_trie": OP11, "op12_conversation_repair": OP12, "op13_url_filter": OP13}
