"""DuckDB SQL of the queries that SQL can express, over the same tables."""

# The numbers in op11 and op13 are the operators' budgets, block and costs.
ORACLES: dict[str, str] = {
    "op1_suffix_dedup": r"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT doc_id, i, substr(h, 2 * i + 1, 200) AS s FROM (SELECT doc_id, h, unnest(range(0, length(h) // 2 - 99)) AS i FROM d) x),
later AS (SELECT doc_id, i FROM (SELECT doc_id, i, rank() OVER (PARTITION BY s ORDER BY doc_id, i) AS r FROM w) x WHERE r > 1),
runs AS (SELECT doc_id, i, count(*) FILTER (fresh) OVER (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS run
  FROM (SELECT doc_id, i, coalesce(i > lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 100, TRUE) AS fresh FROM later) x),
spans AS (SELECT doc_id, run, min(i) AS a, max(i) + 100 AS b FROM runs GROUP BY ALL),
pieces AS (SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS done FROM spans),
cut AS (SELECT doc_id, count(*) AS n_spans, sum(b - a) AS n_removed, max(b) AS last, string_agg(substr(h, 2 * done + 1, 2 * (a - done)), '' ORDER BY a) AS kept
  FROM pieces JOIN d USING (doc_id) GROUP BY doc_id)
SELECT doc_id, CAST(length(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans,
  sha256(unhex(coalesce(kept, '') || substr(h, 2 * coalesce(last, 0) + 1))) AS kept_sha256
FROM d LEFT JOIN cut USING (doc_id)""",
    "op5_warc": r"""
WITH own AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
first AS (SELECT html, min(page_id) AS first FROM own WHERE strlen(html) >= 100 GROUP BY html)
SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes, sha256(html) AS payload_digest,
  CASE WHEN coalesce(first, page_id) = page_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN first <> page_id THEN first END AS refers_to
FROM own LEFT JOIN first USING (html)""",
    "op6_top_k_search": r"""
WITH v AS (SELECT vec_id, [floor(256 * CAST(x AS DOUBLE)) FOR x IN embedding] AS v FROM embeddings),
s AS (SELECT q.vec_id AS query_id, d.vec_id AS vec_id, CAST(list_dot_product(q.v, d.v) AS BIGINT) AS score
      FROM v q JOIN v d ON q.vec_id <> d.vec_id WHERE q.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS place FROM s)
SELECT query_id, CAST(place AS INTEGER) AS rank, vec_id, score FROM r WHERE place <= 5""",
    "op9_substring_dedup": r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
windows AS (SELECT doc_id, i, array_to_string(w[i:i + 34], ' ') AS win FROM (SELECT doc_id, w, unnest(range(1, len(w) - 33)) AS i FROM d) x),
again AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY win) AS n FROM windows) x WHERE n > 1),
covered AS (SELECT DISTINCT doc_id, i + k AS i FROM again, (SELECT unnest(range(0, 35)) AS k) r),
kept AS (SELECT doc_id, i, word FROM (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM d) x ANTI JOIN covered USING (doc_id, i)),
texts AS (SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY i) AS kept FROM kept GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed,
  sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN texts USING (doc_id)""",
    "op11_chat_windows": r"""
WITH RECURSIVE given AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, k, CASE k WHEN 0 THEN 'user' ELSE 'assistant' END, '\### Assistant: </turn> ok' FROM (SELECT unnest([0, 1]) AS k) t),
t AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS k, 4 + len(regexp_extract_all(role, ' ?\p{L}{1,5}|\p{N}{1,3}|[^\t\n\v\f\r \p{L}\p{N}]|[\t\n\v\f\r ]+'))
  + len(regexp_extract_all(text, ' ?\p{L}{1,5}|\p{N}{1,3}|[^\t\n\v\f\r \p{L}\p{N}]|[\t\n\v\f\r ]+')) AS tokens,
  15 + length(replace(replace(replace(replace(role, '\', '\b'), '<turn>', '\lturn>'), '</turn>', '\l/turn>'), chr(10), '\n'))
  + length(replace(replace(replace(text, '\', '\b'), '<turn>', '\lturn>'), '</turn>', '\l/turn>')) AS size FROM given),
p AS (SELECT *, sum(tokens) OVER (PARTITION BY conv_id ORDER BY k) - tokens AS at, sum(tokens) OVER (PARTITION BY conv_id) AS total,
  first_value(CASE WHEN role = 'system' THEN tokens ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY k) AS lead FROM t),
walk AS (SELECT conv_id, k, TRUE AS starts, CASE WHEN lead > 0 THEN 0 ELSE tokens END AS used FROM p WHERE k = 0
  UNION ALL SELECT n.conv_id, n.k, fresh, CASE WHEN fresh THEN n.tokens ELSE used + n.tokens END
  FROM (SELECT n.*, w.used, w.used + n.tokens > greatest(1792 - n.lead, 1) OR (n.total > 65536 AND n.at // 65536 <> b.at // 65536) AS fresh
    FROM walk w JOIN p n ON n.conv_id = w.conv_id AND n.k = w.k + 1 JOIN p b ON b.conv_id = w.conv_id AND b.k = w.k) n),
again AS (SELECT w.conv_id, sum(r.size) AS chars FROM walk w JOIN p s ON s.conv_id = w.conv_id AND s.k = w.k
  JOIN p r ON r.conv_id = w.conv_id AND r.k < w.k AND ((r.k = 0 AND r.lead > 0) OR r.at >= s.at - 256) WHERE w.starts GROUP BY 1)
SELECT p.conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY k)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY k) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(size) + coalesce(any_value(chars), 0) AS BIGINT) AS formatted_chars
FROM p LEFT JOIN again ON again.conv_id = p.conv_id GROUP BY p.conv_id""",
    "op13_conversation_repair": r"""
WITH RECURSIVE given AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
  coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS key FROM conversations),
kinds AS (SELECT *, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(key, ''), lambda c: CAST(ascii(c) AS BIGINT))),
  lambda crc, byte: list_reduce(list_prepend(xor(crc, byte), list_transform(range(8), lambda z: CAST(z AS BIGINT))),
    lambda a, z: xor(a >> 1, CAST(3988292384 AS BIGINT) * (a & 1)))), 4294967295) % 20 AS kind FROM given),
damaged AS (SELECT conv_id, turn, CASE kind WHEN 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text,
  unnest(range(CASE kind WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM kinds),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, copy) AS k, left(role, 1) AS init,
  rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS body FROM damaged),
rows AS (SELECT *, CASE WHEN body = '' THEN 1 WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY k) > 1 THEN 2
  WHEN right(body, 1) NOT IN ('.', '!', '?') THEN 3 ELSE 0 END AS fault, lag(init) OVER (PARTITION BY conv_id ORDER BY k) AS before FROM placed),
walk AS (SELECT conv_id, max(k) + 1 AS k, '00000000' AS b0, '00000010II' AS b1, '00000005I' AS b2, '00000000' AS b3 FROM rows GROUP BY conv_id
 UNION ALL
 SELECT conv_id, k, least(c0, r2i) AS b0, least(c1, r2i) AS b1, r2 AS b2, least(c3, c2i) AS b3 FROM (
  SELECT *, lpad(CAST(CAST(left(r2, 8) AS INT) + 5 AS VARCHAR), 8, '0') || 'I' || substr(r2, 9) AS r2i FROM (
   SELECT *, least(c2, lpad(CAST(CAST(left(c3, 8) AS INT) + 5 AS VARCHAR), 8, '0') || 'I' || substr(c3, 9)) AS r2,
     lpad(CAST(CAST(left(c2, 8) AS INT) + 5 AS VARCHAR), 8, '0') || 'I' || substr(c2, 9) AS c2i FROM (
    SELECT conv_id, k, cs[1] AS c0, cs[2] AS c1, cs[3] AS c2, cs[4] AS c3 FROM (
     SELECT w.conv_id, o.k, list_transform([
       [{'c': 2, 'l': 'D', 's': b0}, {'c': 1 + x, 'l': 'R', 's': b2}, {'c': x, 'l': 'K', 's': CASE init WHEN 's' THEN b1 WHEN 'u' THEN b2 END}],
       [{'c': 2, 'l': 'D', 's': b1}, {'c': 1 + x, 'l': 'R', 's': b2}, {'c': x, 'l': 'K', 's': CASE init WHEN 'u' THEN b2 END}],
       [{'c': 2, 'l': 'D', 's': b2}, {'c': 1 + x, 'l': 'R', 's': b3}, {'c': x, 'l': 'K', 's': CASE init WHEN 'a' THEN b3 END}],
       [{'c': 2, 'l': 'D', 's': b3}, {'c': 1 + x, 'l': 'R', 's': b2}, {'c': x, 'l': 'K', 's': CASE init WHEN 'u' THEN b2 END}]],
       lambda options: list_min(list_transform(list_filter(options, lambda e: e.s IS NOT NULL AND (e.l = 'D' OR o.fault IN (0, 3))),
         lambda e: lpad(CAST(CAST(left(e.s, 8) AS INT) + e.c AS VARCHAR), 8, '0') || e.l || substr(e.s, 9)))) AS cs
     FROM walk w JOIN (SELECT *, CASE fault WHEN 3 THEN 5 ELSE 0 END AS x FROM rows) o ON o.conv_id = w.conv_id AND o.k = w.k - 1) a) b) c) d),
best AS (SELECT conv_id, CAST(left(b0, 8) AS BIGINT) AS cost, substr(b0, 9) AS audit FROM walk WHERE k = 1),
letters AS (SELECT conv_id, i, audit[i] AS letter FROM (SELECT conv_id, audit, unnest(range(1, length(audit) + 1)) AS i FROM best) a),
applied AS (SELECT *, count(*) FILTER (letter <> 'I') OVER so_far AS k, count(*) FILTER (letter <> 'D') OVER so_far AS m,
  count(*) FILTER (letter <> 'D') OVER (PARTITION BY conv_id) AS total FROM letters WINDOW so_far AS (PARTITION BY conv_id ORDER BY i)),
lines AS (SELECT a.conv_id, string_agg(CASE WHEN letter = 'K' THEN role WHEN (m - total % 2) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' ||
  CASE letter WHEN 'I' THEN '' ELSE text END, chr(10) ORDER BY i) AS repaired
  FROM applied a LEFT JOIN rows r ON r.conv_id = a.conv_id AND r.k = a.k AND letter <> 'I' WHERE letter <> 'D' GROUP BY a.conv_id),
counts AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 1) AS blank,
  count(*) FILTER (fault = 2) AS duplicate, count(*) FILTER (fault = 3) AS truncated,
  count(*) FILTER (before IS NOT NULL AND before || init NOT IN ('su', 'ua', 'au')) AS illegal FROM rows GROUP BY conv_id)
SELECT c.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
  coalesce(illegal, 0) AS illegal, coalesce(cost, 0) AS cost, coalesce(audit, '') AS audit, sha256(coalesce(repaired, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN counts ON counts.conv_id = c.conv_id LEFT JOIN best ON best.conv_id = c.conv_id
LEFT JOIN lines ON lines.conv_id = c.conv_id""",
}
