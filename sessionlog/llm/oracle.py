"""DuckDB SQL of the queries that SQL can express."""

from __future__ import annotations

_OP4 = r"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws FROM d),
pos AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS i FROM w),
win AS (
  SELECT doc_id, i, word, lead(word, 1) OVER o AS b, lead(word, 2) OVER o AS c, lead(word, 3) OVER o AS d,
         lead(word, 4) OVER o AS e FROM pos WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
again AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, word, b, c, d, e) AS n
                         FROM win WHERE e IS NOT NULL) WHERE n > 1),
rep AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM again, range(5) r(k) GROUP BY doc_id),
facts AS (
  SELECT d.doc_id, d.source, CAST(len(w.ws) AS BIGINT) AS n_words,
    CAST(length(regexp_replace(d.text, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
    CAST(length(regexp_replace(d.text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(len(list_filter(string_split(d.text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')))
       - len(list_distinct(list_filter(string_split(d.text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]'))))
       AS BIGINT) AS n_dup_lines,
    CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words
  FROM d JOIN w USING (doc_id) LEFT JOIN rep USING (doc_id)),
judged AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM facts),
hosts AS (SELECT source, count(*) AS n, count(*) FILTER (base_failed) AS f FROM judged GROUP BY source),
sums AS (SELECT sum(n)::DOUBLE AS docs, sum(f)::DOUBLE AS failed, count(*) AS hosts,
                sum(f::DOUBLE * f / n) AS squares FROM hosts),
moments AS (SELECT failed / docs AS p, squares / docs - (failed / docs) * (failed / docs)
              - (failed / docs) * (1 - failed / docs) * hosts / docs AS spread FROM sums),
prior AS (SELECT p, CASE WHEN spread > 0 THEN greatest(1.0, least(1e6, p * (1 - p) / spread - 1)) ELSE 1e6 END AS m
          FROM moments),
rates AS (SELECT source, (f + p * m) / (n + m) AS rate FROM hosts, prior)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND rate <= 0.5 AS kept, round(rate, 6) AS host_rate
FROM judged JOIN rates ON judged.source IS NOT DISTINCT FROM rates.source
"""

_OP11 = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''),
         'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
lists AS (SELECT lang, row_number() OVER () AS id, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM pieces),
w AS (SELECT lang, id, unnest(ws) AS w1, generate_subscripts(ws, 1) AS i FROM lists),
runs AS (SELECT lang, w1, lead(w1, 1) OVER o AS w2, lead(w1, 2) OVER o AS w3, lead(w1, 3) OVER o AS w4, lead(w1, 4) OVER o AS w5
         FROM w WINDOW o AS (PARTITION BY id ORDER BY i)),
grams AS (
  SELECT lang, [w1] AS ws FROM runs
  UNION ALL SELECT lang, [w1, w2] FROM runs WHERE w2 IS NOT NULL
  UNION ALL SELECT lang, [w1, w2, w3] FROM runs WHERE w3 IS NOT NULL
  UNION ALL SELECT lang, [w1, w2, w3, w4] FROM runs WHERE w4 IS NOT NULL
  UNION ALL SELECT lang, [w1, w2, w3, w4, w5] FROM runs WHERE w5 IS NOT NULL),
f AS (SELECT lang, ws, len(ws) AS k, count(*) AS a FROM grams GROUP BY lang, ws HAVING count(*) >= 100),
totals AS (SELECT lang, count(*) AS n FROM w GROUP BY lang),
cuts AS (SELECT f.*, unnest(range(1, k)) AS at FROM f WHERE k > 1),
scored AS (
  SELECT c.lang, c.ws, c.a, l.a AS l, r.a AS r, t.n, c.at,
         (CAST(1000 AS HUGEINT) * c.a * t.n) // (CAST(l.a AS HUGEINT) * r.a) AS score
  FROM cuts c JOIN f l ON l.lang = c.lang AND l.ws = c.ws[1:c.at] JOIN f r ON r.lang = c.lang AND r.ws = c.ws[c.at + 1:]
       JOIN totals t ON t.lang = c.lang
  QUALIFY row_number() OVER (PARTITION BY c.lang, c.ws ORDER BY score, c.at) = 1),
starts AS (SELECT lang, ws, k, a, unnest(range(1, k)) AS s FROM f WHERE k > 2),
inner_runs AS (SELECT lang, ws[s : s + size - 1] AS ws, max(a) AS longer
               FROM (SELECT *, unnest(range(2, k)) AS size FROM starts) WHERE s + size - 1 <= k GROUP BY ALL)
SELECT s.lang, row_number() OVER (PARTITION BY s.lang ORDER BY s.score DESC, s.a DESC, array_to_string(s.ws, ' ')) AS rank,
       array_to_string(s.ws, ' ') AS phrase, s.a, s.l, s.r, s.n, CAST(s.score AS BIGINT) AS score
FROM scored s LEFT JOIN inner_runs i ON i.lang = s.lang AND i.ws = s.ws
WHERE i.longer IS NULL OR 100 * i.longer < 100 * s.a QUALIFY rank <= 2000"""

# The checksum of a decimal, byte by byte and bit by bit.
_CRC = """xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(CAST(conv_id AS VARCHAR), ''),
    lambda x: CAST(ascii(x) AS BIGINT))), lambda acc, b: list_reduce([xor(acc, b), 0, 0, 0, 0, 0, 0, 0, 0],
    lambda x, none: xor(x >> 1, (x & 1) * 3988292384))), 4294967295)"""

_OP12 = f"""
WITH t AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (
             PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS i
           FROM conversations WHERE conv_id IS NOT NULL),
sizes AS (SELECT conv_id, count(*) AS n FROM t GROUP BY conv_id),
c AS (SELECT s.conv_id, s.conv_id - s.conv_id % 5 AS base, s.h, least(s.h, coalesce(b.n, 0)) AS taken
      FROM (SELECT conv_id, {_CRC} % 9 AS h FROM sizes) s LEFT JOIN sizes b ON b.conv_id = s.conv_id - s.conv_id % 5),
rebuilt AS (
  SELECT c.conv_id, t.i AS depth, t.role, t.text FROM c JOIN t ON t.conv_id = c.base AND t.i <= c.h
  UNION ALL SELECT c.conv_id, t.i - c.h + c.taken, t.role, t.text FROM c JOIN t ON t.conv_id = c.conv_id AND t.i > c.h),
prefixes AS (SELECT conv_id, depth, strlen(text) AS bytes, string_agg(md5(strlen(role) || ':' || role || text), ',') OVER (
               PARTITION BY conv_id ORDER BY depth) AS way FROM rebuilt),
m AS (SELECT conv_id, depth, bytes, md5(way) AS node, lag(md5(way), 1, 'root') OVER (PARTITION BY conv_id ORDER BY depth) AS up
      FROM prefixes UNION ALL SELECT conv_id, 0, 0, 'root', NULL FROM c),
nodes AS (SELECT node, depth, min(conv_id) AS conv_id, any_value(up) AS up, count(*) AS n_convs, any_value(bytes) AS bytes
          FROM m GROUP BY node, depth),
children AS (SELECT up AS node, count(*) AS n FROM nodes WHERE up IS NOT NULL GROUP BY up),
ends AS (SELECT node, sha256(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id)) AS sha FROM (
           SELECT conv_id, arg_max(node, depth) AS node FROM m GROUP BY conv_id) GROUP BY node),
below AS (SELECT a.node, sum((v.n_convs - 1) * v.bytes) AS saved, count(*) FILTER (k.n IS NULL) AS leaves
          FROM nodes v LEFT JOIN children k ON k.node = v.node JOIN m a ON a.conv_id = v.conv_id AND a.depth <= v.depth GROUP BY a.node)
SELECT n.conv_id, CAST(n.depth AS BIGINT) AS depth, p.conv_id AS parent_conv_id, n.n_convs, coalesce(k.n, 0) AS n_children,
       b.leaves AS n_leaves, CAST(b.saved AS BIGINT) AS saved_tokens, coalesce(e.sha, sha256('')) AS ends_sha256
FROM nodes n LEFT JOIN nodes p ON p.node = n.up LEFT JOIN children k ON k.node = n.node LEFT JOIN ends e ON e.node = n.node
     JOIN below b ON b.node = n.node"""

ORACLE: dict[str, str] = {"op4_host_rules": _OP4, "op11_dic_phrases": _OP11, "op12_zfast_trie": _OP12}