"""DuckDB SQL for the operators that SQL can express, over the same whole tables."""

from __future__ import annotations

BLANK = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"

OP1 = f"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS chars, sha256(regexp_replace(coalesce(text, ''), '{BLANK}', '', 'g')) AS sha FROM documents
)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY sha) AS group_size,
       doc_id = first_value(doc_id) OVER w AS kept, sha AS text_sha256
FROM d WINDOW w AS (PARTITION BY sha ORDER BY chars DESC, doc_id)
"""

OP6 = f"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{WORD}'))::BIGINT AS size, md5('mix:' || doc_id) AS draw FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size, 2.0::DOUBLE * sum(size)::DOUBLE AS cap,
         [3.0::DOUBLE, 1.0::DOUBLE, 2.0::DOUBLE][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS weight
  FROM d GROUP BY source
), f AS (
  SELECT *, coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
         sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open
  FROM s
), r AS (
  SELECT *, (1.5::DOUBLE * (SELECT sum(source_size)::DOUBLE FROM s) - before) / open AS rate FROM f
), one AS (
  SELECT arg_min(rate, cap / weight) AS rate FROM r WHERE rate * weight <= cap
), t AS (
  SELECT source, source_size, CASE WHEN one.rate IS NULL THEN cap ELSE least(cap, one.rate * weight) END AS target FROM r, one
), q AS (
  SELECT d.*, t.source_size, t.target, sum(size) OVER (PARTITION BY d.source ORDER BY draw, size, doc_id ROWS UNBOUNDED PRECEDING) AS upto
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
), o AS (
  SELECT q.*, (2 * (upto + e.e * source_size) - size)::DOUBLE / (2.0::DOUBLE * target) AS finish
  FROM q, (VALUES (0), (1)) e(e) WHERE size > 0
), k AS (
  SELECT doc_id, count(*) AS copies FROM (
    SELECT *, sum(size) OVER (ORDER BY finish, source NULLS LAST, draw, size, doc_id ROWS UNBOUNDED PRECEDING) AS after FROM o
  ) WHERE after - size / 2.0 <= (SELECT sum(target) FROM t) GROUP BY doc_id
)
SELECT q.doc_id, size, source_size, target, (size * coalesce(copies, 0))::BIGINT AS taken FROM q LEFT JOIN k ON q.doc_id = k.doc_id
"""

OP7 = f"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORD}') AS ws FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN []::VARCHAR[] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
         ELSE [array_to_string(ws[i:i+4], ' ') FOR i IN range(1, len(ws) - 3)] END) AS x FROM w
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), links AS (
  SELECT p.a, p.b FROM (
    SELECT s.doc_id AS a, t.doc_id AS b, count(*) AS k FROM s JOIN s t ON s.x = t.x AND s.doc_id <> t.doc_id GROUP BY 1, 2
  ) p JOIN n na ON p.a = na.doc_id JOIN n nb ON p.b = nb.doc_id WHERE 100 * k >= 80 * (na.n + nb.n - k)
), reach AS (
  SELECT doc_id AS v, doc_id AS r FROM n UNION SELECT l.b, reach.r FROM reach JOIN links l ON l.a = reach.v
), c AS (
  SELECT v, min(r) AS component_id FROM reach GROUP BY v
)
SELECT documents.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, coalesce(c.component_id, documents.doc_id) AS component_id
FROM documents LEFT JOIN n ON documents.doc_id = n.doc_id LEFT JOIN c ON documents.doc_id = c.v
"""

OP8 = f"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{WORD}') AS w,
         regexp_replace(coalesce(text, ''), '{BLANK}', '', 'g') AS bare,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '{WORD}')) AS lines FROM documents
), win AS (
  SELECT doc_id, i, array_to_string(w[i:i+7], ' ') AS x FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM d WHERE len(w) >= 8)
), twice AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, x) AS k FROM win) WHERE k > 1
), rep AS (
  SELECT doc_id, count(*) AS n FROM (SELECT DISTINCT doc_id, unnest(range(i, i + 8)) AS p FROM twice) GROUP BY doc_id
), m AS (
  SELECT d.doc_id, len(w)::BIGINT AS n_words, length(bare)::BIGINT AS word_chars,
         len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols, len(lines) AS n_lines,
         (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words,
         length(regexp_replace(bare, '\\P{{Lu}}+', '', 'g')) AS n_upper, length(bare) - length(regexp_replace(bare, '\\p{{L}}+', '', 'g')) AS n_letters
  FROM d LEFT JOIN rep ON d.doc_id = rep.doc_id
), r AS (
  SELECT *, n_words < 20 AS r0, 100 * n_repeat_words > 30 * n_words AS r1, 2 * n_dup_lines > n_lines AND n_lines >= 4 AS r2,
         10 * n_symbols > n_words AND n_symbols >= 10 AS r3, word_chars < 2 * n_words AS r4, word_chars > 20 * n_words AND n_words > 0 AS r5,
         2 * n_upper > word_chars AND word_chars >= 40 AS r6, 2 * n_letters < word_chars AND word_chars >= 40 AS r7 FROM m
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, r0 OR r1 AS base_failed, NOT (r0 OR r1 OR r2 OR r3 OR r4 OR r5) AS kept,
       (r0::INT + 2 * r1::INT + 4 * r2::INT + 8 * r3::INT + 16 * r4::INT + 32 * r5::INT + 64 * r6::INT + 128 * r7::INT)::BIGINT AS failed FROM r
"""

#: CRC-32 by its table, which is made here too.
OP12 = f"""
WITH tab AS (
  SELECT [list_reduce([n, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) FOR n IN range(256)] AS t
), turns AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) - 1 AS p, coalesce(role, '') AS role, coalesce(text, '') AS text
  FROM conversations WHERE conv_id IS NOT NULL
), convs AS (
  SELECT conv_id, n, xor(4294967295, list_reduce(list_prepend(4294967295, [ascii(x) FOR x IN string_split(conv_id::VARCHAR, '')]), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]))) % 4 AS h
  FROM (SELECT conv_id, count(*) AS n FROM turns GROUP BY conv_id), tab
), rebuilt AS (
  SELECT c.conv_id, t.p, t.role, t.text FROM convs c JOIN turns t ON t.conv_id = c.conv_id - c.conv_id % 20 WHERE t.p < c.h
  UNION ALL SELECT c.conv_id, t.p - c.h + least(c.h, coalesce(b.n, 0)), t.role, t.text FROM convs c JOIN turns t ON t.conv_id = c.conv_id LEFT JOIN convs b ON b.conv_id = c.conv_id - c.conv_id % 20 WHERE t.p >= c.h
), keyed AS (
  SELECT conv_id, p + 1 AS depth, len(regexp_extract_all(text, '{WORD}')) AS words, string_agg(md5(length(role) || ':' || role || text), '') OVER (PARTITION BY conv_id ORDER BY p ROWS UNBOUNDED PRECEDING) AS k FROM rebuilt
  UNION ALL SELECT conv_id, 0, 0, '' FROM convs
), nodes AS (
  SELECT k, depth, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(words) AS words FROM keyed GROUP BY k, depth
), kids AS (
  SELECT left(k, 32 * (depth - 1)) AS k, count(*) AS n FROM nodes WHERE depth > 0 GROUP BY 1
), sums AS (
  SELECT left(n.k, 32 * d) AS k, count(*) FILTER (kids.n IS NULL) AS n_leaves, sum((n_convs - 1) * words) AS saved FROM (SELECT *, unnest(range(depth + 1)) AS d FROM nodes) n LEFT JOIN kids ON kids.k = n.k GROUP BY 1
), ends AS (
  SELECT k, string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) AS ids FROM (SELECT * FROM keyed QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY depth DESC) = 1) GROUP BY k
)
SELECT n.conv_id, n.depth, p.conv_id AS parent_conv_id, n.n_convs, coalesce(kids.n, 0)::BIGINT AS n_children, s.n_leaves::BIGINT AS n_leaves, s.saved::BIGINT AS saved_tokens, sha256(coalesce(e.ids, '')) AS ends_sha256
FROM nodes n JOIN sums s ON s.k = n.k LEFT JOIN kids ON kids.k = n.k LEFT JOIN ends e ON e.k = n.k LEFT JOIN nodes p ON n.depth > 0 AND p.k = left(n.k, 32 * (n.depth - 1))
"""

OP13 = """
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, encode(coalesce(text, '')) AS b FROM documents
), w AS (
  SELECT r, i, md5(b[i + 1:i + 200]) AS x FROM (SELECT r, b, unnest(range(0, octet_length(b) - 199)) AS i FROM d)
), twice AS (
  SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY x) AS n FROM w) WHERE n > 1
), runs AS (
  SELECT r, min(i) AS a, max(i) + 200 AS z FROM (
    SELECT *, sum(fresh) OVER (PARTITION BY r ORDER BY i) AS run FROM (SELECT *, CASE WHEN i - lag(i) OVER (PARTITION BY r ORDER BY i) <= 200 THEN 0 ELSE 1 END AS fresh FROM twice)
  ) GROUP BY r, run
), gone AS (
  SELECT r, sum(z - a)::BIGINT AS n_removed, count(*) AS n_spans FROM runs GROUP BY r
), cuts AS (
  SELECT r, 0 AS z FROM d UNION ALL SELECT r, z FROM runs
), kept AS (
  SELECT c.r, string_agg(hex(b[c.z + 1:coalesce(c.a, octet_length(b))]), '' ORDER BY c.z) AS h FROM (
    SELECT r, z, (SELECT min(a) FROM runs WHERE runs.r = cuts.r AND a >= cuts.z) AS a FROM cuts
  ) c JOIN d ON d.r = c.r GROUP BY c.r
)
SELECT d.doc_id, octet_length(b)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans, sha256(unhex(h)) AS kept_sha256
FROM d JOIN kept ON kept.r = d.r LEFT JOIN gone ON gone.r = d.r
"""

ORACLES = {"op1_exact_dedup": OP1, "op6_source_mix": OP6, "op7_ngram_join": OP7, "op8_quality_rules": OP8, "op12_prefix_trie": OP12, "op13_suffix_dedup": OP13}
