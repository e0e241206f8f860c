"""SQL of the operators that SQL can express, for DuckDB."""

#: The table of the checksum's polynomial, by rule.
_CRC_TABLE = """crc_table AS (SELECT list(c ORDER BY b) AS t FROM (
  SELECT b, list_reduce([b, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM (SELECT unnest(range(256)) AS b)))"""


def _crc(numbers: str) -> str:
    """crc32 of a list of byte values."""
    return f"xor(list_reduce(list_prepend(4294967295, {numbers}), lambda c, b: xor(c >> 8, t[xor(c & 255, b) + 1])), 4294967295)"


_HEX = "'0123456789ABCDEF'"
_BYTES = f"list_transform(range(1, len(x) // 2 + 1), lambda i: (strpos({_HEX}, x[2 * i - 1]) - 1) * 16 + strpos({_HEX}, x[2 * i]) - 1)"
_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP11 = f"""
WITH {_CRC_TABLE},
corpus AS (SELECT doc_id, row_number() OVER () AS r, {_WORDS} AS w FROM documents),
doc_words AS (SELECT r, unnest(w) AS word FROM corpus),
target_words AS (SELECT unnest({_WORDS}) AS word FROM benchmark),
words AS (SELECT word, hex(encode(word)) AS x FROM (SELECT word FROM doc_words UNION SELECT word FROM target_words)),
buckets AS (SELECT word, {_crc(_BYTES)} % 10000 AS bucket FROM words, crc_table),
s AS (SELECT bucket, count(*) AS s FROM doc_words JOIN buckets USING (word) GROUP BY bucket),
t AS (SELECT bucket, count(*) AS t FROM target_words JOIN buckets USING (word) GROUP BY bucket),
gains AS (SELECT bucket, floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * (coalesce((SELECT sum(s) FROM s), 0) + 10000) / ((coalesce(s, 0) + 1)::DOUBLE * (coalesce((SELECT sum(t) FROM t), 0) + 10000))))::BIGINT AS gain
  FROM s FULL JOIN t USING (bucket)),
totals AS (SELECT r, sum(gain)::BIGINT AS total FROM doc_words JOIN buckets USING (word) JOIN gains USING (bucket) GROUP BY r),
weights AS (SELECT doc_id, r, len(w)::BIGINT AS n_features, CASE WHEN len(w) = 0 THEN 0 ELSE floor(total::DOUBLE / len(w))::BIGINT END AS weight,
  ('0x' || substr(sha256('2024:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT AS h FROM corpus LEFT JOIN totals USING (r)),
scored AS (SELECT *, weight + floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score FROM weights),
ranked AS (SELECT *, CASE WHEN n_features >= 20 THEN row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id NULLS FIRST) END AS place, sum((n_features >= 20)::INT) OVER () * 10 // 100 AS n_drawn FROM scored)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= n_drawn THEN place END AS rank FROM ranked"""

_KEY_BYTES = "list_transform(string_split(k, ''), lambda c: ascii(c))"
_SPACES = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

OP12 = f"""
WITH RECURSIVE {_CRC_TABLE},
kinds AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k, {_crc(_KEY_BYTES)} % 20 AS kind FROM conversations, crc_table),
damaged AS (SELECT conv_id, turn, CASE kind WHEN 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM (SELECT *, unnest(range(CASE kind WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM kinds)),
numbered AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i, rtrim(text, {_SPACES}) AS body FROM damaged),
faults AS (SELECT *, CASE WHEN body = '' THEN 'b' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'd' WHEN body[-1] NOT IN ('.', '!', '?') THEN 't' ELSE '' END AS fault,
  lag(role) OVER (PARTITION BY conv_id ORDER BY i) AS before FROM numbered),
counts AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'b') AS blank, count(*) FILTER (fault = 'd') AS duplicate, count(*) FILTER (fault = 't') AS truncated,
  count(*) FILTER (before IS NOT NULL AND before[1] || role[1] NOT IN ('su', 'ua', 'au')) AS illegal, max(i) AS n FROM faults GROUP BY conv_id),
inserts(p, n, q, lines) AS (VALUES (0, 0, 0, NULL), (0, 1, 2, 'user:'), (0, 2, 3, 'user:' || chr(10) || 'assistant:'), (1, 0, 1, NULL), (1, 1, 2, 'user:'), (1, 2, 3, 'user:' || chr(10) || 'assistant:'),
  (2, 0, 2, NULL), (2, 1, 3, 'assistant:'), (2, 2, 2, 'assistant:' || chr(10) || 'user:'), (3, 0, 3, NULL), (3, 1, 2, 'user:'), (3, 2, 3, 'user:' || chr(10) || 'assistant:')),
edits(q, initial, letter, z, role) AS (VALUES (0, NULL, 'D', 0, NULL), (1, NULL, 'D', 1, NULL), (2, NULL, 'D', 2, NULL), (3, NULL, 'D', 3, NULL), (0, 's', 'K', 1, NULL), (0, 'u', 'K', 2, NULL), (1, 'u', 'K', 2, NULL), (3, 'u', 'K', 2, NULL), (2, 'a', 'K', 3, NULL),
  (0, NULL, 'R', 2, 'user'), (1, NULL, 'R', 2, 'user'), (3, NULL, 'R', 2, 'user'), (2, NULL, 'R', 3, 'assistant')),
walk(conv_id, i, p, cost, audit, repaired) AS (
  SELECT DISTINCT conv_id, 0::BIGINT, 0, 0::BIGINT, '', NULL::VARCHAR FROM conversations
  UNION ALL
  SELECT conv_id, i, z, cost, audit, repaired FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, z ORDER BY cost, audit) AS best FROM (
    SELECT w.conv_id, f.i, e.z, w.cost + 3 * x.n + CASE e.letter WHEN 'D' THEN 4 WHEN 'R' THEN 3 ELSE 0 END + CASE WHEN e.letter <> 'D' AND f.fault = 't' THEN 3 ELSE 0 END AS cost, w.audit || repeat('I', x.n) || e.letter AS audit,
      nullif(concat_ws(chr(10), w.repaired, x.lines, CASE e.letter WHEN 'D' THEN NULL ELSE coalesce(e.role, f.role) || ':' || f.text END), '') AS repaired
    FROM walk w JOIN faults f ON f.conv_id IS NOT DISTINCT FROM w.conv_id AND f.i = w.i + 1 JOIN inserts x ON x.p = w.p JOIN edits e ON e.q = x.q
    WHERE e.letter = 'D' OR f.fault NOT IN ('b', 'd') AND (e.letter = 'R' OR e.initial = f.role[1]))) WHERE best = 1),
ends AS (SELECT w.conv_id, w.cost + 3 * x.n AS cost, w.audit || repeat('I', x.n) AS audit, coalesce(concat_ws(chr(10), w.repaired, x.lines), '') AS repaired, c.gaps, c.blank, c.duplicate, c.truncated, c.illegal,
  row_number() OVER (PARTITION BY w.conv_id ORDER BY w.cost + 3 * x.n, w.audit || repeat('I', x.n)) AS best
  FROM walk w JOIN inserts x ON x.p = w.p AND x.q IN (0, 3) LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM w.conv_id WHERE w.i = coalesce(c.n, 0))
SELECT conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, cost, audit, sha256(repaired) AS repaired_sha256
FROM ends WHERE best = 1"""
