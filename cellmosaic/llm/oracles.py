"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

SOURCE_MIX = r"""
WITH RECURSIVE sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         (('0x' || substr(md5('mix:' || doc_id::VARCHAR), 1, 13))::BIGINT + 0.5::DOUBLE) / 4503599627370496::DOUBLE AS u
  FROM documents),
totals AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
weighed AS (SELECT *, ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::BIGINT AS weight FROM totals),
fill AS (
  SELECT *, sum(source_size) OVER ()::BIGINT AS total,
         coalesce(sum(source_size) OVER (ORDER BY source_size / weight, source NULLS LAST
                  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before,
         sum(weight) OVER (ORDER BY source_size / weight, source NULLS LAST
                  ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)::BIGINT AS rest,
         row_number() OVER (ORDER BY source_size / weight, source NULLS LAST) AS place
  FROM weighed),
levels AS (SELECT *, (total - 3 * before)::DOUBLE / rest AS level FROM fill),
share AS (SELECT arg_min(level, place) AS level FROM levels WHERE weight * level <= 3 * source_size),
targets AS (
  SELECT f.source, f.source_size, least((3 * f.source_size)::DOUBLE, f.weight * s.level) AS target
  FROM levels f, share s),
split AS (
  SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS ratio FROM targets),
ranked AS (
  SELECT d.doc_id, d.source, d.size, s.source_size, s.target, floor(s.ratio) AS whole,
         s.target - (floor(s.ratio) * s.source_size)::DOUBLE AS budget,
         CASE WHEN s.ratio > floor(s.ratio) AND d.size > 0 THEN
           d.u / (1 - d.u) / ((s.ratio - floor(s.ratio)) / (1 - (s.ratio - floor(s.ratio))) * sqrt(d.size::DOUBLE)) END AS value
  FROM sized d JOIN split s ON d.source IS NOT DISTINCT FROM s.source),
cut AS (
  SELECT *, value IS NOT NULL AND sum(CASE WHEN value IS NOT NULL THEN size ELSE 0 END)
           OVER (PARTITION BY source ORDER BY value NULLS LAST, doc_id, size) <= budget AS extra
  FROM ranked),
gap1 AS (SELECT source, any_value(budget) - sum(CASE WHEN extra THEN size ELSE 0 END) AS gap FROM cut GROUP BY source),
pick1 AS (
  SELECT c.source, arg_min(c.doc_id, (abs(g.gap - c.size), c.value, c.doc_id)) AS doc_id
  FROM cut c JOIN gap1 g ON c.source IS NOT DISTINCT FROM g.source
  WHERE c.value IS NOT NULL AND NOT c.extra AND c.size < 2 * g.gap GROUP BY c.source),
cut2 AS (
  SELECT c.* REPLACE (c.extra OR p.doc_id IS NOT NULL AS extra)
  FROM cut c LEFT JOIN pick1 p ON c.source IS NOT DISTINCT FROM p.source AND c.doc_id = p.doc_id),
gap2 AS (SELECT source, any_value(budget) - sum(CASE WHEN extra THEN size ELSE 0 END) AS gap FROM cut2 GROUP BY source),
pick2 AS (
  SELECT c.source, arg_min(c.doc_id, (abs(g.gap - c.size), c.value, c.doc_id)) AS doc_id
  FROM cut2 c JOIN gap2 g ON c.source IS NOT DISTINCT FROM g.source
  WHERE c.value IS NOT NULL AND NOT c.extra AND c.size < 2 * g.gap GROUP BY c.source)
SELECT c.doc_id, c.size, c.source_size, c.target,
       ((c.whole + CASE WHEN c.extra OR p.doc_id IS NOT NULL THEN 1 ELSE 0 END) * c.size)::BIGINT AS taken
FROM cut2 c LEFT JOIN pick2 p ON c.source IS NOT DISTINCT FROM p.source AND c.doc_id = p.doc_id
"""

DECONTAMINATION = r"""
WITH docs AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[0-9a-z\x{80}-\x{10FFFF}]+') AS w FROM documents),
items AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                     '[0-9a-z\x{80}-\x{10FFFF}]+') AS w FROM benchmark),
windows AS (
  SELECT item_id, least(len(w), 13) AS size, array_to_string(w[i : i + least(len(w), 13) - 1], ' ') AS win
  FROM (SELECT *, unnest(range(1, greatest(len(w) - 13 + 1, 1) + 1)) AS i FROM items WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT size FROM windows),
runs AS (
  SELECT doc_id, i, size, array_to_string(w[i : i + size - 1], ' ') AS win
  FROM (SELECT d.doc_id, d.w, s.size, unnest(range(1, len(d.w) - s.size + 2)) AS i
        FROM docs d, sizes s WHERE len(d.w) >= s.size)),
found AS (SELECT r.doc_id, r.i, r.size, w.item_id FROM runs r JOIN windows w ON r.size = w.size AND r.win = w.win),
words AS (
  SELECT doc_id, count(DISTINCT p)::BIGINT AS n_hit
  FROM (SELECT doc_id, unnest(range(i, i + size)) AS p FROM (SELECT DISTINCT doc_id, i, size FROM found)) GROUP BY doc_id),
listed AS (
  SELECT doc_id, count(*)::BIGINT AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM found) GROUP BY doc_id)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(h.n_hit, 0)::BIGINT AS n_hit,
       coalesce(l.n_items, 0)::BIGINT AS n_items, sha256(coalesce(l.items, '')) AS items_sha256,
       coalesce(h.n_hit > 0 AND 20 * h.n_hit >= len(d.w), false) AS contaminated
FROM docs d LEFT JOIN words h USING (doc_id) LEFT JOIN listed l USING (doc_id)
"""

WARC_REVISITS = r"""
WITH raw AS (
  SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS hex FROM pages),
digests AS (
  SELECT page_id, payload_bytes,
         translate(upper(to_base(('0x' || hex[1:10])::BIGINT, 32, 8) || to_base(('0x' || hex[11:20])::BIGINT, 32, 8)
                         || to_base(('0x' || hex[21:30])::BIGINT, 32, 8) || to_base(('0x' || hex[31:40])::BIGINT, 32, 8)),
                   '0123456789ABCDEFGHIJKLMNOPQRSTUV', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567') AS payload_digest
  FROM raw),
kept AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS kept FROM digests)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN page_id = kept THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> kept THEN kept END AS refers_to
FROM kept
"""

MERKLE_MANIFEST = r"""
WITH RECURSIVE t0 AS (SELECT i, i::BIGINT AS c FROM range(256) r(i)),
bits AS (  -- the table of crc32, one bit a round
  SELECT i, c, 0 AS round FROM t0
  UNION ALL
  SELECT i, CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END, round + 1 FROM bits WHERE round < 8),
crc_table AS (SELECT list(c ORDER BY i) AS t FROM bits WHERE round = 8),
docs AS (
  SELECT row_number() OVER () AS rid, doc_id, lang, text,
         coalesce(octet_length(encode(doc_id::VARCHAR)) || ':' || doc_id, '-') || coalesce(octet_length(encode(source)) || ':' || source, '-')
         || coalesce(octet_length(encode(lang)) || ':' || lang, '-') || coalesce(octet_length(encode(n_chars::VARCHAR)) || ':' || n_chars, '-') AS head
  FROM documents),
digits AS (
  SELECT rid, 1 AS pos, doc_id::VARCHAR AS digits, 4294967295::BIGINT AS c FROM docs WHERE doc_id IS NOT NULL
  UNION ALL
  SELECT rid, pos + 1, digits, xor(c >> 8, t[(xor(c, ascii(substr(digits, pos, 1))) & 255) + 1])
  FROM digits, crc_table WHERE pos <= length(digits)),
crc AS (SELECT rid, xor(c, 4294967295) AS crc FROM digits WHERE pos = length(digits) + 1),
hashed AS (
  SELECT d.rid, d.doc_id, d.lang, sha256(head || coalesce(octet_length(encode(text)) || ':' || text, '-')) AS leaf,
         CASE WHEN crc % 3 = 0 THEN sha256(head || coalesce(octet_length(encode(text)) || ':'
           || translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '-')) END AS seen
  FROM docs d LEFT JOIN crc USING (rid)),
placed AS (
  SELECT *, coalesce('=' || lang, '-') AS tree, row_number() OVER w - 1 AS pos,
         count(*) OVER (PARTITION BY lang) AS n
  FROM hashed WINDOW w AS (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf)),
lower_tree AS (
  SELECT tree, 0 AS level, pos, n, leaf AS digest FROM placed
  UNION ALL
  SELECT tree, level + 1, pos // 8, (any_value(n) + 7) // 8, sha256(string_agg(digest, '' ORDER BY pos))
  FROM lower_tree WHERE n > 1 GROUP BY tree, level, pos // 8),
subroots AS (
  SELECT tree, digest AS subroot, level AS height, row_number() OVER (ORDER BY tree) - 1 AS pos, count(*) OVER () AS n
  FROM lower_tree WHERE n = 1),
upper_tree AS (
  SELECT 0 AS level, pos, n, subroot AS digest FROM subroots
  UNION ALL
  SELECT level + 1, pos // 8, (any_value(n) + 7) // 8, sha256(string_agg(digest, '' ORDER BY pos))
  FROM upper_tree WHERE n > 1 GROUP BY level, pos // 8),
root AS (SELECT digest AS root FROM upper_tree WHERE n = 1),
nodes AS (  -- levels of the last tree follow those of a lang
  SELECT tree, level AS step, pos, digest, (8 ** level)::BIGINT AS span, false AS last FROM lower_tree WHERE n > 1
  UNION ALL
  SELECT s.tree, s.height + u.level, u.pos, u.digest, (8 ** u.level)::BIGINT, true FROM subroots s, upper_tree u WHERE u.n > 1),
own AS (
  SELECT p.rid, n.step, string_agg(n.digest, '' ORDER BY n.pos) FILTER (WHERE n.pos < m.mine) AS lefts,
         string_agg(n.digest, '' ORDER BY n.pos) FILTER (WHERE n.pos > m.mine) AS rights
  FROM placed p JOIN subroots s USING (tree) JOIN nodes n USING (tree),
       LATERAL (SELECT (CASE WHEN n.last THEN s.pos ELSE p.pos END // n.span)::BIGINT AS mine) m
  WHERE n.pos // 8 = m.mine // 8 GROUP BY p.rid, n.step),
proofs AS (SELECT rid, string_agg(coalesce(lefts, '') || coalesce(rights, ''), '' ORDER BY step) AS proof FROM own GROUP BY rid),
fold AS (
  SELECT rid, 0 AS step, coalesce(seen, leaf) AS digest FROM placed
  UNION ALL
  SELECT f.rid, f.step + 1, sha256(coalesce(o.lefts, '') || f.digest || coalesce(o.rights, ''))
  FROM fold f JOIN own o ON f.rid = o.rid AND f.step = o.step),
last_fold AS (SELECT rid, arg_max(digest, step) AS folded_root FROM fold GROUP BY rid)
SELECT p.doc_id, p.leaf, s.subroot, r.root, sha256(coalesce(q.proof, '')) AS proof_sha256, l.folded_root, l.folded_root = r.root AS verified
FROM placed p JOIN subroots s USING (tree) JOIN last_fold l ON l.rid = p.rid LEFT JOIN proofs q ON q.rid = p.rid, root r
"""

PHRASES = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents),
split AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
grams AS (
  SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS phrase
  FROM split, range(1, 5) r(k)),
f AS (SELECT lang, k, phrase, count(*) AS n FROM grams GROUP BY ALL),
totals AS (SELECT lang, sum(len(w))::BIGINT AS n FROM split GROUP BY lang),
candidates AS (SELECT lang, k, phrase, n AS a, string_split(phrase, ' ') AS w FROM f WHERE k > 1 AND n >= 30),
inner_parts AS (
  SELECT lang, a, unnest(list_transform(range(1, k - j + 2), lambda i: array_to_string(w[i:i + j - 1], ' '))) AS phrase
  FROM candidates, range(2, 4) r(j) WHERE j < k),
held AS (SELECT lang, phrase, max(a) AS b FROM inner_parts GROUP BY ALL),
kept AS (
  SELECT c.* FROM candidates c LEFT JOIN held h ON c.lang = h.lang AND c.phrase = h.phrase
  WHERE h.b IS NULL OR 100::HUGEINT * h.b < 80::HUGEINT * c.a),
cuts AS (
  SELECT c.lang, c.phrase, c.a, j, x.n AS l, y.n AS r, (2000000::HUGEINT * c.a // (x.n::HUGEINT + y.n))::BIGINT AS score
  FROM kept c, range(1, 4) t(j), f x, f y
  WHERE j < c.k AND x.lang = c.lang AND x.phrase = array_to_string(c.w[1:j], ' ')
    AND y.lang = c.lang AND y.phrase = array_to_string(c.w[j + 1:c.k], ' ')),
weakest AS (SELECT lang, phrase, a, unnest(arg_min({'l': l, 'r': r, 'score': score}, {'s': score, 'j': j})) FROM cuts GROUP BY lang, phrase, a),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM weakest)
SELECT r.lang, r.rank, r.phrase, r.a, r.l, r.r, t.n, r.score FROM ranked r JOIN totals t USING (lang) WHERE rank <= 2000
"""

NEAR_DUPLICATES = r"""
WITH RECURSIVE split AS (
  SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
sets AS (
  SELECT rid, doc_id, CASE WHEN len(w) >= 2 THEN list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) ELSE w END AS s
  FROM split),
sized AS (SELECT *, len(s)::BIGINT AS n FROM sets),
tokens AS (SELECT rid, n, unnest(s) AS token FROM sized),
counts AS (SELECT token, count(*) AS c FROM tokens GROUP BY token),
ranked AS (  -- sets that link share one of their n - ceil(0.8 n) + 1 rarest tokens
  SELECT rid, n, token, row_number() OVER (PARTITION BY rid ORDER BY c, token) AS place FROM tokens JOIN counts USING (token)),
heads AS (SELECT rid, n, token FROM ranked WHERE place <= n - (80 * n + 99) // 100 + 1),
pairs AS (
  SELECT DISTINCT a.rid AS a, b.rid AS b FROM heads a JOIN heads b USING (token)
  WHERE a.rid < b.rid AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)),
shared AS (
  SELECT a, b, x.n AS na, y.n AS nb, len(list_intersect(x.s, y.s)) AS i
  FROM pairs JOIN sized x ON x.rid = a JOIN sized y ON y.rid = b),
links AS (SELECT a, b FROM shared WHERE 100 * i >= 80 * (na + nb - i)),
both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (
  SELECT rid AS a, rid AS b FROM sized
  UNION
  SELECT r.a, l.b FROM reach r JOIN both_ways l ON r.b = l.a),
classes AS (SELECT r.a AS rid, min(d.doc_id) AS component_id FROM reach r JOIN sized d ON d.rid = r.b GROUP BY r.a)
SELECT s.doc_id, s.n AS n_shingles, c.component_id, s.doc_id = c.component_id AS kept FROM sized s JOIN classes c USING (rid)
"""
