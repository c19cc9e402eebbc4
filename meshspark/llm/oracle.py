"""DuckDB SQL of the operators that SQL can express, beside op8's."""

#: The table of the unsigned crc32, made from its polynomial.
CRC = """crc(b, c) AS (
  SELECT b, list_reduce(range(9), lambda c, k: CASE WHEN k = 0 THEN c WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, b) FROM range(256) t(b)
), steps AS (
  SELECT list(c ORDER BY b) AS table256 FROM crc
)"""
WORDS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

OP11_SQL = f"""
WITH {CRC}, texts AS (
  SELECT 0 AS kind, row_number() OVER () AS row, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORDS}') AS words FROM documents
  UNION ALL
  SELECT 1, 0, NULL, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORDS}') FROM benchmark
), features AS (
  SELECT kind, row, unnest(words || list_transform(range(1, len(words)), lambda i: words[i] || ' ' || words[i + 1])) AS feature FROM texts
), counts AS (
  SELECT kind, row, feature, count(*) AS n FROM features GROUP BY ALL
), hashed AS (
  SELECT feature, hex(encode(feature)) AS bytes FROM (SELECT DISTINCT feature FROM counts)
), bucketed AS (
  SELECT feature, xor(4294967295, list_reduce(list_transform(range(len(bytes) // 2), lambda i: CAST('0x' || substr(bytes, 2 * i + 1, 2) AS BIGINT)),
    lambda c, b: xor(c // 256, table256[CAST(xor(c % 256, b) AS INTEGER) + 1]), 4294967295)) % 10000 AS bucket FROM hashed, steps
), sums AS (
  SELECT bucket, sum(n) FILTER (kind = 0) AS s, sum(n) FILTER (kind = 1) AS t FROM counts JOIN bucketed USING (feature) GROUP BY bucket
), total AS (
  SELECT CAST(coalesce(sum(s), 0) AS DOUBLE) AS all_s, CAST(coalesce(sum(t), 0) AS DOUBLE) AS all_t FROM sums
), gains AS (
  SELECT bucket, CAST(floor(1000 * ln((coalesce(t, 0) + 1) * (all_s + 10000) / ((coalesce(s, 0) + 1) * (all_t + 10000)))) AS BIGINT) AS gain FROM sums, total
), weighed AS (
  SELECT row, sum(n) AS n, sum(n * gain) AS gain FROM counts JOIN bucketed USING (feature) JOIN gains USING (bucket) WHERE kind = 0 GROUP BY row
), scored AS (
  SELECT doc_id, len(words) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_features, CAST(coalesce((gain - ((gain % n) + n) % n) // n, 0) AS BIGINT) AS weight,
    CAST(CAST('0x' || substr(sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) AS DOUBLE) AS h
  FROM texts LEFT JOIN weighed USING (row) WHERE kind = 0
), final AS (
  SELECT doc_id, n_words, n_features, weight, weight + CAST(floor(-1000 * ln(-ln((h + 0.5) / 4294967296))) AS BIGINT) AS score FROM scored
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY n_words >= 20 ORDER BY score DESC, doc_id NULLS FIRST) AS place, count(*) FILTER (n_words >= 20) OVER () AS eligible FROM final
)
SELECT doc_id, n_words, n_features, weight, score, CASE WHEN n_words >= 20 AND place <= eligible * 25 // 100 THEN place END AS rank FROM placed
"""

OP12_SQL = f"""
WITH {CRC}, t AS (
  SELECT conv_id, strlen(coalesce(text, '')) AS size, sha256(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS k,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS pos FROM conversations WHERE conv_id IS NOT NULL
), own AS (
  SELECT conv_id, count(*) AS n FROM t GROUP BY conv_id
), c AS (
  SELECT a.conv_id, a.conv_id - a.conv_id % 5 AS base, coalesce(b.n, 0) AS base_n,
    xor(4294967295, list_reduce(list_transform(range(strlen(CAST(a.conv_id AS VARCHAR))), lambda i: CAST(ascii(substr(CAST(a.conv_id AS VARCHAR), i + 1, 1)) AS BIGINT)),
      lambda c, b: xor(c // 256, table256[CAST(xor(c % 256, b) AS INTEGER) + 1]), 4294967295)) % 9 AS h
  FROM own a LEFT JOIN own b ON b.conv_id = a.conv_id - a.conv_id % 5, steps
), rebuilt AS (
  SELECT c.conv_id, t.pos AS d, k, size FROM c JOIN t ON t.conv_id = c.base AND t.pos <= c.h
  UNION ALL SELECT c.conv_id, least(h, base_n) + t.pos - h, k, size FROM c JOIN t USING (conv_id) WHERE t.pos > h
), paths AS (
  SELECT conv_id, 0 AS d, '' AS path, 0 AS size FROM c
  UNION ALL SELECT conv_id, d, string_agg(k, '') OVER (PARTITION BY conv_id ORDER BY d), size FROM rebuilt
), marked AS (
  SELECT *, d = max(d) OVER (PARTITION BY conv_id) AS at_end FROM paths
), nodes AS (
  SELECT path, d, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(size) AS size, coalesce(string_agg(conv_id, ',' ORDER BY conv_id) FILTER (at_end), '') AS ends FROM marked GROUP BY path, d
), up AS (
  SELECT n.*, p.conv_id AS parent_conv_id, p.path AS parent FROM nodes n LEFT JOIN nodes p ON n.d > 0 AND p.path = substr(n.path, 1, 64 * (n.d - 1))
), kids AS (
  SELECT parent AS path, count(*) AS n_children FROM up WHERE d > 0 GROUP BY parent
), below AS (
  SELECT substr(n.path, 1, 64 * a) AS path, count(*) FILTER (n_children IS NULL) AS n_leaves, sum((n_convs - 1) * size) AS saved_tokens FROM nodes n LEFT JOIN kids USING (path), LATERAL (SELECT unnest(range(n.d + 1)) AS a) GROUP BY 1
)
SELECT up.conv_id, CAST(d AS BIGINT) AS depth, parent_conv_id, n_convs, CAST(coalesce(n_children, 0) AS BIGINT) AS n_children, CAST(n_leaves AS BIGINT) AS n_leaves, CAST(saved_tokens AS BIGINT) AS saved_tokens, sha256(ends) AS ends_sha256
FROM up LEFT JOIN kids USING (path) JOIN below USING (path)
"""

OP13_SQL = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS payload, sha1(coalesce(html, '')) AS hex FROM pages
), q AS (
  SELECT *, min(page_id) OVER (PARTITION BY payload) AS head FROM p
)
SELECT page_id, strlen(payload) AS payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST((CAST('0x' || substr(hex, 5 * (i // 4) + 1, 5) AS BIGINT) >> (15 - 5 * (i % 4))) & 31 AS INTEGER), 1)), '') AS payload_digest,
  CASE WHEN page_id IS NOT DISTINCT FROM head THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id IS NOT DISTINCT FROM head THEN NULL ELSE head END AS refers_to
FROM q
"""
