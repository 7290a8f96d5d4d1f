"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

OP7 = r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS digest,
                  CAST(strlen(coalesce(html, '')) AS BIGINT) AS size FROM pages),
g AS (SELECT digest, max(page_id) AS top FROM p WHERE size >= 1000 GROUP BY digest)
SELECT p.page_id, size AS payload_bytes, p.digest AS payload_digest,
       CASE WHEN top IS NULL OR top = p.page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN top <> p.page_id THEN top END AS refers_to
FROM p LEFT JOIN g ON p.digest = g.digest AND size >= 1000
"""

OP8 = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
e AS (SELECT *, length(replace(replace(text, '\', '\b'), '<', '\l')) AS body,
             length(replace(replace(replace(role, '\', '\b'), '<', '\l'), '>', '\g')) AS head FROM t),
g AS (SELECT conv_id, count(*) AS n_turns,
        string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS whole,
        coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '') AS lost,
        sum(head + body + length('<turn >') + 1 + length('</turn>') + 1) AS size
      FROM e GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(whole) AS turns_sha256, length(lost) AS loss_chars,
       sha256(lost) AS loss_sha256, CAST(size AS BIGINT) AS formatted_chars
FROM g
"""

OP10 = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS n_tokens,
         CAST('0x' || substr(md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) AS place
  FROM documents),
s AS (SELECT source, CAST(sum(n_tokens) AS DOUBLE) AS tokens FROM d GROUP BY source),
t AS (SELECT sum(tokens) AS n FROM s),
p AS (SELECT list(tokens / n ORDER BY tokens) AS p FROM s, t WHERE tokens > 0),
b AS (
  SELECT 0 AS i, p, 0.0::DOUBLE AS elo, 1.0::DOUBLE AS ehi, 0.0::DOUBLE AS rlo, 1.0::DOUBLE AS rhi FROM p
  UNION ALL
  SELECT i + 1, p,
    CASE WHEN hold_e THEN (elo + ehi) / 2 ELSE elo END, CASE WHEN hold_e THEN ehi ELSE (elo + ehi) / 2 END,
    CASE WHEN hold_r THEN (rlo + rhi) / 2 ELSE rlo END, CASE WHEN hold_r THEN rhi ELSE (rlo + rhi) / 2 END
  FROM (SELECT *,
      ln(list_sum(list_transform(p, lambda x: pow(x, (elo + ehi) / 2))))
        - (elo + ehi) / 2 * list_sum(list_transform(p, lambda x: pow(x, (elo + ehi) / 2) * ln(x)))
          / list_sum(list_transform(p, lambda x: pow(x, (elo + ehi) / 2))) >= 0.9 * ln(len(p)) AS hold_e,
      pow(p[1], (rlo + rhi) / 2 - 1) / list_sum(list_transform(p, lambda x: pow(x, (rlo + rhi) / 2))) > 4.0 AS hold_r
    FROM b WHERE i < 50)),
e AS (
  SELECT greatest(
    CASE WHEN - list_sum(list_transform(p, lambda x: x * ln(x))) / list_sum(p) + ln(list_sum(p)) >= 0.9 * ln(len(p)) THEN 1.0 ELSE elo END,
    CASE WHEN 1.0 / list_sum(p) > 4.0 THEN 1.0 ELSE rlo END) AS e
  FROM b WHERE i = 50),
w AS (SELECT source, tokens, pow(tokens / n, e) / (SELECT sum(pow(tokens / n, e)) FROM s, t, e WHERE tokens > 0) AS weight, n
      FROM s, t, e WHERE tokens > 0),
q AS (SELECT source, tokens, CAST(floor(round(weight * n, 3)) AS BIGINT) AS quota FROM w),
r AS (SELECT source, CAST(floor(quota / tokens) AS BIGINT) AS passes, quota - CAST(floor(quota / tokens) AS BIGINT) * tokens AS rest FROM q),
c AS (SELECT d.*, passes, rest, sum(n_tokens) OVER (PARTITION BY d.source ORDER BY place) AS upto
      FROM d LEFT JOIN r ON d.source IS NOT DISTINCT FROM r.source)
SELECT doc_id, source, CAST(n_tokens AS BIGINT) AS n_tokens,
       CAST(coalesce(passes, 0) + CASE WHEN upto <= rest THEN 1 ELSE 0 END AS BIGINT) AS copies
FROM c
"""

OP13 = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS t
  FROM documents),
s AS (SELECT count(*) AS n_docs, CAST(sum(len(t)) AS BIGINT) AS n_terms FROM d WHERE len(t) > 0),
q AS (
  SELECT DISTINCT item_id, term FROM (
    SELECT item_id, unnest(regexp_extract_all(
      translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark)),
p AS (
  SELECT rid, term, count(*) AS tf FROM (SELECT rid, unnest(t) AS term FROM d)
  WHERE term IN (SELECT term FROM q) GROUP BY rid, term),
w AS (SELECT term, CAST(floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * count(*) + 1))) AS BIGINT) AS w FROM p, s GROUP BY term, n_docs),
m AS (SELECT rid, doc_id, 100 - 90 + (90 * len(t) * n_docs) // n_terms AS m FROM d, s WHERE len(t) > 0),
r AS (
  SELECT item_id, doc_id, rid, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * m))) AS BIGINT) AS score
  FROM q JOIN w USING (term) JOIN p USING (term) JOIN m USING (rid) GROUP BY item_id, doc_id, rid),
o AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS FIRST) AS INTEGER) AS rank, doc_id, score
      FROM r WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM o WHERE rank <= 10
"""

ORACLE_SQL: dict[str, str] = {"op13_hybrid_taat_daat": OP13, "op7_warc_writer": OP7, "op8_event_sourced": OP8, "op10_temperature_mix": OP10}
