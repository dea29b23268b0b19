"""DuckDB SQL for the queries that SQL can express."""

OP6 = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (
  SELECT doc_id, CASE WHEN len(ws) >= 4 THEN list_distinct(list_transform(range(1, len(ws) - 2), lambda i: array_to_string(ws[i:i + 3], ' '))) WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END AS shingles FROM w),
n AS (SELECT doc_id, len(shingles) AS n FROM s),
g AS (SELECT doc_id, unnest(shingles) AS shingle FROM s),
pair AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS common FROM g a JOIN g b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY ALL),
link AS (SELECT u, v FROM pair JOIN n a ON a.doc_id = u JOIN n b ON b.doc_id = v WHERE 100 * common >= 85 * (a.n + b.n - common)),
both_ways AS (SELECT u, v FROM link UNION SELECT v, u FROM link),
reach AS (SELECT doc_id AS u, doc_id AS v FROM n UNION SELECT r.u, b.v FROM reach r JOIN both_ways b ON b.u = r.v)
SELECT doc_id, n::BIGINT AS n_shingles, (SELECT min(v) FROM reach WHERE u = doc_id)::BIGINT AS component_id FROM n
"""

OP7 = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
t AS (
  SELECT *, row_number() OVER w AS pos, count(*) OVER (PARTITION BY conv_id) AS n,
    17 + 2 * length(role) - length(regexp_replace(role, '[\\<\[\n]', '', 'g')) + 2 * length(text) - length(regexp_replace(text, '[\\<\[]', '', 'g')) AS chars
  FROM c WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)),
u AS (SELECT *, sum(chars) OVER (PARTITION BY conv_id ORDER BY pos) AS upto, role = 'assistant' AS said FROM t)
SELECT conv_id, count(*)::BIGINT AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY pos)) AS turns_sha256,
  length(coalesce(string_agg(text, '' ORDER BY pos) FILTER (WHERE said), ''))::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY pos) FILTER (WHERE said), '')) AS loss_sha256,
  (sum(upto) FILTER (WHERE said OR pos = n))::BIGINT AS formatted_chars
FROM u GROUP BY conv_id
"""

ORACLES = {"op6_jaccard_join": OP6, "op7_chat_format": OP7}
