"""DuckDB SQL for the queries that SQL can express."""

DECONTAMINATE = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
b AS (
  SELECT CAST(item_id AS VARCHAR) AS item,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark WHERE item_id IS NOT NULL),
pat AS (
  SELECT DISTINCT item, n, array_to_string(w[i:i + n - 1], ' ') AS win
  FROM (SELECT item, w, n, unnest(range(1, len(w) - n + 2)) AS i
        FROM (SELECT item, w, least(13, len(w)) AS n FROM b WHERE len(w) > 0))),
sizes AS (SELECT DISTINCT n FROM pat),
win AS (
  SELECT r, i, n, array_to_string(w[i:i + n - 1], ' ') AS win
  FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n)),
found AS (SELECT r, i, win.n, item FROM win JOIN pat ON win.n = pat.n AND win.win = pat.win),
hit AS (
  SELECT r, count(DISTINCT p) AS n_hit
  FROM (SELECT r, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT r, i, n FROM found)) GROUP BY r),
items AS (
  SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names
  FROM (SELECT DISTINCT r, item FROM found) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(names, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hit USING (r) LEFT JOIN items USING (r)
"""

LINE_DEDUP = r"""
WITH d AS (SELECT row_number() OVER () AS r, * FROM documents),
l AS (
  SELECT r, doc_id, source, pos, line, trim(line, ' ' || chr(9) || chr(13)) AS t
  FROM (SELECT r, doc_id, source, unnest(string_split(text, chr(10))) AS line,
               unnest(range(len(string_split(text, chr(10))))) AS pos FROM d)),
b AS (
  SELECT t, min(struct_pack(a := doc_id, b := pos)) AS first
  FROM l WHERE t <> '' GROUP BY t HAVING count(DISTINCT source) >= 10),
k AS (
  SELECT l.*, b.t IS NOT NULL AND NOT (l.doc_id = b.first.a AND l.pos = b.first.b) AS gone
  FROM l LEFT JOIN b ON l.t = b.t),
g AS (
  SELECT r, count(*) FILTER (WHERE t <> '') AS n_lines, count(*) FILTER (WHERE gone) AS n_removed,
         coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '') AS cleaned
  FROM k GROUP BY r)
SELECT doc_id, CAST(coalesce(n_lines, 0) AS BIGINT) AS n_lines, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed,
       sha256(cleaned) AS text_sha256
FROM d LEFT JOIN g USING (r)
"""

RESAMPLE = r"""
WITH RECURSIVE steps AS (
  SELECT i, i AS c, 0 AS k FROM (SELECT CAST(unnest(range(256)) AS BIGINT) AS i)
  UNION ALL
  SELECT i, CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM steps WHERE k < 8),
crc AS (SELECT list(c ORDER BY i) AS tab FROM steps WHERE k = 8),
d AS (
  SELECT row_number() OVER () AS r, 0 AS kind, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
b AS (
  SELECT row_number() OVER () AS r, 1 AS kind,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
texts AS (SELECT r, kind, w FROM d UNION ALL SELECT r, kind, w FROM b),
grams AS (
  SELECT r, kind, array_to_string(w[i:i + m - 1], ' ') AS gram
  FROM (SELECT r, kind, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM texts, (SELECT unnest([1, 2, 3]) AS m) WHERE len(w) >= m)),
counted AS (SELECT r, kind, gram, count(*) AS n FROM grams GROUP BY r, kind, gram),
hashed AS (
  SELECT gram, xor(list_reduce(list_prepend(4294967295, bytes),
                               lambda c, x: xor(c >> 8, tab[(xor(c, x) & 255) + 1])), 4294967295) % 10000 AS bucket
  FROM (SELECT gram, list_transform(range(0, octet_length(encode(gram))),
                                    lambda p: CAST(('0x' || substr(hex(encode(gram)), 2 * p + 1, 2)) AS BIGINT)) AS bytes
        FROM (SELECT DISTINCT gram FROM counted)), crc),
per AS (SELECT r, kind, bucket, sum(n) AS n FROM counted JOIN hashed USING (gram) GROUP BY r, kind, bucket),
sums AS (SELECT bucket, coalesce(sum(n) FILTER (WHERE kind = 0), 0) AS s, coalesce(sum(n) FILTER (WHERE kind = 1), 0) AS t FROM per GROUP BY bucket),
gains AS (
  SELECT bucket, floor(1000 * ln((t + 1)::DOUBLE * ((SELECT sum(s) FROM sums) + 10000)
                                 / ((s + 1)::DOUBLE * ((SELECT sum(t) FROM sums) + 10000)))) AS gain FROM sums),
weights AS (SELECT r, sum(n) AS n_features, sum(n * gain) AS weight FROM per JOIN gains USING (bucket) WHERE kind = 0 GROUP BY r),
scored AS (
  SELECT r, doc_id, len(w) AS n_words, CAST(coalesce(n_features, 0) AS BIGINT) AS n_features, CAST(coalesce(weight, 0) AS BIGINT) AS weight,
         CAST(coalesce(weight, 0) + floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) + 0.5::DOUBLE)
                                                         / 4294967296::DOUBLE))) AS BIGINT) AS score
  FROM d LEFT JOIN weights USING (r)),
fit AS (SELECT r, row_number() OVER (ORDER BY score DESC, doc_id) AS place, count(*) OVER () AS n FROM scored WHERE n_words >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= 5 * n // 100 THEN place END AS rank
FROM scored LEFT JOIN fit USING (r)
"""

WARC = r"""
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha256(coalesce(html, '')) AS digest, coalesce(html, '') AS payload FROM pages),
f AS (SELECT *, CASE WHEN n >= 100 THEN min(page_id) OVER (PARTITION BY payload) END AS first FROM p)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, digest AS payload_digest,
       CASE WHEN first IS NOT NULL AND first IS DISTINCT FROM page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN first IS NOT NULL AND first IS DISTINCT FROM page_id THEN first END AS refers_to
FROM f
"""
