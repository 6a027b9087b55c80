"""DuckDB SQL for the training-data queries that SQL can express."""

from __future__ import annotations

_WORDS = r"len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))"

OP2 = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, lang, coalesce(text, '') AS text FROM documents),
w AS (SELECT rid, unnest(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS w,
             generate_subscripts(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), 1) AS i FROM d),
g AS (SELECT rid, i, lead(w, 4) OVER p IS NOT NULL AS full5,
             concat_ws(' ', w, lead(w, 1) OVER p, lead(w, 2) OVER p, lead(w, 3) OVER p, lead(w, 4) OVER p) AS gram
      FROM w WINDOW p AS (PARTITION BY rid ORDER BY i)),
t AS (SELECT rid, i, count(*) OVER (PARTITION BY rid, gram) AS n FROM g WHERE full5),
r AS (SELECT rid, count(DISTINCT i + k) AS n_repeat_words FROM t, range(5) AS x(k) WHERE n > 1 GROUP BY rid),
l AS (SELECT rid, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines
      FROM (SELECT rid, unnest(string_split(text, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY rid),
s AS (SELECT rid, doc_id, lang, len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS n_words,
             length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS word_chars,
             length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
             coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words,
             coalesce(n_lines, 0) AS n_lines, length(regexp_replace(text, '[^A-Z]', '', 'g')) AS n_capitals
      FROM d LEFT JOIN r USING (rid) LEFT JOIN l USING (rid)),
b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM s),
grid AS (SELECT unnest([20, 35, 50, 75, 100, 150, 200, 300, 400, 500, 600, 700, 800, 900]) AS cutoff),
x AS (SELECT rid, lang, unnest(['symbols', 'dup_lines', 'repeats', 'capitals']) AS rule,
             unnest([n_symbols, n_dup_lines, n_repeat_words, n_capitals]) AS top,
             unnest([word_chars, n_lines, n_words, word_chars]) AS size
      FROM b WHERE NOT base_failed),
good AS (SELECT x.* FROM x JOIN b USING (rid) WHERE b.doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)),
tested AS (SELECT good.lang, rule, cutoff, count(*) AS n, count(*) FILTER (WHERE 1000 * top > cutoff * size) AS rejected
           FROM good, grid GROUP BY ALL),
m AS (SELECT 4 * count(*) AS tests FROM (SELECT DISTINCT lang FROM tested)),
bound AS (SELECT t.*, (SELECT sum(exp(lgamma(n + 1) - lgamma(j + 1) - lgamma(n - j + 1) + j * ln(0.005::DOUBLE) + (n - j) * ln(0.995::DOUBLE)))
                       FROM range(t.rejected + 1) AS q(j)) AS cdf FROM tested AS t),
cut AS (SELECT lang, rule, min(cutoff) AS cutoff FROM bound, m WHERE cdf <= 0.05::DOUBLE / tests GROUP BY lang, rule),
bad AS (SELECT DISTINCT rid FROM x JOIN cut ON x.rule = cut.rule AND x.lang IS NOT DISTINCT FROM cut.lang WHERE 1000 * top > cutoff * size)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols,
       n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words, base_failed,
       NOT base_failed AND rid NOT IN (SELECT rid FROM bad) AS kept
FROM b
"""

OP4 = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, source, {_WORDS}::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, 3.0::DOUBLE * sum(size) AS cap,
             ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::DOUBLE AS weight FROM d GROUP BY source),
f AS (SELECT a.source, sum(least(b.cap, a.cap / a.weight * b.weight)) < sum(b.source_size) AS capped FROM s AS a, s AS b GROUP BY a.source),
g AS (SELECT s.*, capped FROM s JOIN f ON s.source IS NOT DISTINCT FROM f.source),
lv AS (SELECT (sum(source_size) - coalesce(sum(cap) FILTER (WHERE capped), 0)) / sum(weight) FILTER (WHERE NOT capped) AS level FROM g),
t AS (SELECT source, source_size, CASE WHEN capped OR level IS NULL THEN cap ELSE least(cap, level * weight) END AS target FROM g, lv),
q AS (SELECT d.doc_id, d.source, d.size, source_size, target,
             coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY md5(coalesce(doc_id::VARCHAR, '')), doc_id, size, rid
                                      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, source,
       (greatest(0, least(size, floor(target)::BIGINT - before)) + greatest(0, least(size, floor(target)::BIGINT - source_size - before))
        + greatest(0, least(size, floor(target)::BIGINT - 2 * source_size - before)))::BIGINT AS taken,
       CASE WHEN target > 0 THEN (before + size) / target END AS first_finish
FROM q
"""

OP5 = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, octet_length(encode(coalesce(text, '')))::BIGINT AS bytes, md5(coalesce(text, '')) AS key,
         row_number() OVER (PARTITION BY doc_id, text) - 1 AS i FROM documents),
h AS (SELECT doc_id, bytes, ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || '|' || key || '|' || i), 1, 15))::BIGINT AS hash FROM d),
b AS (
  SELECT 0 AS depth, 0::BIGINT AS prefix, sum(bytes)::BIGINT AS shard_bytes, count(*) AS shard_rows FROM h
  UNION ALL
  SELECT depth, prefix, sum(bytes)::BIGINT, count(*) FROM (
    SELECT b.depth + 1 AS depth, h.hash >> (59 - b.depth) AS prefix, h.bytes
    FROM b JOIN h ON h.hash >> (60 - b.depth) = b.prefix
    WHERE b.shard_bytes > 1048576 AND b.shard_rows > 1 AND b.depth < 60) GROUP BY depth, prefix)
SELECT doc_id, bytes, depth, prefix, shard_bytes, shard_rows
FROM h JOIN b ON hash >> (60 - depth) = prefix
WHERE (shard_bytes <= 1048576 OR shard_rows = 1 OR depth = 60)
"""

OP9 = r"""
WITH u AS (SELECT DISTINCT lower(regexp_extract(url, '^[a-z]+://([^/?#:]+)', 1)) AS host,
                  list_filter(string_split(lower(regexp_extract(url, '^[a-z]+://[^/?#]+([^?#]*)', 1)), '/'), lambda s: s <> '') AS steps FROM pages),
l AS (SELECT *, string_split(host, '.') AS labels FROM u),
names AS (SELECT array_to_string(labels[i:], '.') AS entry FROM (SELECT labels, unnest(range(1, len(labels) + 1)) AS i FROM l)
          UNION SELECT host || '/' || array_to_string(steps[:i], '/') FROM (SELECT host, steps, unnest(range(1, len(steps) + 1)) AS i FROM l)),
e AS (SELECT entry, md5(entry) AS h FROM names WHERE regexp_matches(entry, '^[^./]+[.][^./]+[.]') AND left(md5(entry), 1) IN ('0', '1', '2', '3', '4')),
n AS (SELECT entry, ('0x' || substr(h, 2, 4))::INT % 280 AS first, ('0x' || substr(h, 6, 2))::INT % 3 AS kind, ('0x' || substr(h, 8, 2))::INT % 50 + 5 AS gap,
             substr(h, 10, 1) = '0' AS same FROM e),
changes AS (SELECT entry, DATE '2024-01-01' + first AS day, CASE WHEN same THEN 0 ELSE 1 END AS act FROM n
            UNION ALL SELECT entry, DATE '2024-01-01' + first + gap, 0 FROM n WHERE kind > 0
            UNION ALL SELECT entry, DATE '2024-01-01' + first + gap + 20, 1 FROM n WHERE kind = 2),
p AS (SELECT page_id, url, TIMESTAMP '2024-01-01' + to_days((page_id * 37 % 366)::INT) + to_hours(page_id % 24) AS fetched_at,
             lower(regexp_extract(url, '^[a-z]+://([^/?#:]+)', 1)) AS host, lower(regexp_extract(url, '^[a-z]+://([^?#]*)', 1)) AS rest FROM pages),
active AS (SELECT p.page_id, p.url, p.fetched_at, c.entry, c.day, c.act,
                row_number() OVER (PARTITION BY p.page_id, p.url, c.entry ORDER BY c.day DESC) AS latest
         FROM p JOIN changes AS c ON c.day <= p.fetched_at::DATE
          AND CASE WHEN c.entry LIKE '%/%' THEN (rtrim(p.rest, '/') || '/') LIKE (c.entry || '/%')
                   ELSE p.host = c.entry OR ends_with(p.host, '.' || c.entry) END),
hit AS (SELECT page_id, url, entry, day, row_number() OVER (PARTITION BY page_id, url ORDER BY length(entry) DESC, entry) AS k
        FROM active WHERE latest = 1 AND act = 1)
SELECT p.page_id, p.url, p.fetched_at, p.host, hit.entry IS NOT NULL AS blocked, hit.entry, hit.day AS listed_on
FROM p LEFT JOIN hit ON p.page_id = hit.page_id AND p.url = hit.url AND k = 1
"""

OP11 = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS u,
                  sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
x AS (SELECT doc_id, t, u, len(u) AS n, ('0x' || h[1:8])::BIGINT % (len(u) + 1) AS a, ('0x' || h[9:16])::BIGINT % (len(u) + 1) AS b,
             CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR ('0x' || h[17:24])::BIGINT % 100 >= 90 THEN 'plain'
                  WHEN ('0x' || h[25:32])::BIGINT % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM d),
y AS (SELECT *, array_to_string(u[1:least(a, b)], '') AS p, array_to_string(u[least(a, b) + 1:greatest(a, b)], '') AS m,
             array_to_string(u[greatest(a, b) + 1:], '') AS s FROM x)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(p) END::BIGINT AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END::BIGINT AS middle_chars,
       sha256(CASE form WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m WHEN 'spm' THEN '<S>' || s || '<P>' || p || '<M>' || m ELSE t END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM y
"""

OP12 = r"""
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY h) AS first FROM p)
SELECT page_id, payload_bytes,
       array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
         ((('0x' || substr(h, 5 * (i // 4) + 1, 5))::BIGINT >> (15 - 5 * (i % 4))) & 31) + 1, 1)), '') AS payload_digest,
       CASE WHEN page_id IS NOT DISTINCT FROM first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id IS DISTINCT FROM first THEN first END AS refers_to, true AS intact
FROM f
"""

OP13 = r"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM p),
s AS (SELECT lang, unnest(ws) AS w1, unnest(ws[2:] || [NULL]) AS w2, unnest(ws[3:] || [NULL, NULL]) AS w3 FROM w WHERE len(ws) > 0),
f AS (SELECT lang, w1 AS phrase, 1 AS k, count(*) AS f FROM s WHERE w1 IS NOT NULL GROUP BY ALL
      UNION ALL SELECT lang, w1 || ' ' || w2, 2, count(*) FROM s WHERE w1 IS NOT NULL AND w2 IS NOT NULL GROUP BY ALL
      UNION ALL SELECT lang, w1 || ' ' || w2 || ' ' || w3, 3, count(*) FROM s WHERE w1 IS NOT NULL AND w2 IS NOT NULL AND w3 IS NOT NULL GROUP BY ALL),
total AS (SELECT lang, sum(f)::BIGINT AS n FROM f WHERE k = 1 GROUP BY lang),
c AS (SELECT lang, phrase, k, f AS a, string_split(phrase, ' ') AS ws FROM f WHERE k > 1 AND f >= 10),
inner2 AS (SELECT lang, phrase, max(a) AS within FROM (SELECT lang, a, unnest([ws[1] || ' ' || ws[2], ws[2] || ' ' || ws[3]]) AS phrase FROM c WHERE k = 3) GROUP BY ALL),
kept AS (SELECT c.* FROM c LEFT JOIN inner2 USING (lang, phrase) WHERE within IS NULL OR 100 * within < 50 * a),
cuts AS (SELECT lang, phrase, a, i, array_to_string(ws[:i], ' ') AS front, array_to_string(ws[i + 1:], ' ') AS back
         FROM (SELECT *, unnest(range(1, k)) AS i FROM kept)),
scored AS (SELECT cuts.lang, cuts.phrase, a, i, l.f AS l, r.f AS r, (1000000::HUGEINT * a * a // (l.f::HUGEINT * r.f))::BIGINT AS score
           FROM cuts JOIN f AS l ON l.lang = cuts.lang AND l.phrase = front JOIN f AS r ON r.lang = cuts.lang AND r.phrase = back),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, i) = 1)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase)::BIGINT AS rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n, score
FROM best JOIN total USING (lang) QUALIFY rank <= 2000
"""
