"""DuckDB SQL of the queries that SQL can express."""

from __future__ import annotations

from .quality import STOP_WORDS

CHAT = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text,
    CASE WHEN conv_id IS NULL THEN row_number() OVER () END AS own FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok', NULL
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok', NULL
), t AS (
  SELECT *, row_number() OVER w AS i, count(*) OVER (PARTITION BY conv_id, own) AS n,
    19 + 2 * length(role) - length(regexp_replace(role, '[\\<#:]', '', 'g'))
       + 2 * length(text) - length(regexp_replace(text, '[\\<#]', '', 'g')) AS chars
  FROM c WINDOW w AS (PARTITION BY conv_id, own ORDER BY turn, role, text)
), u AS (
  SELECT *, sum(chars) OVER (PARTITION BY conv_id, own ORDER BY i) AS upto FROM t
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY i)) AS turns_sha256,
  coalesce(sum(CASE WHEN role = 'assistant' THEN length(text) END), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY i), '')) AS loss_sha256,
  sum(chars)::BIGINT AS formatted_chars,
  sum(CASE WHEN role = 'assistant' OR i = n THEN upto END)::BIGINT AS example_chars,
  count(*) FILTER (WHERE role = 'assistant' OR i = n) AS n_examples
FROM u GROUP BY conv_id, own
"""

QUALITY = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text FROM documents
), s AS (
  SELECT doc_id, text, list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words,
    list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM d
), g AS (
  SELECT doc_id, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS gram
  FROM (SELECT doc_id, words, unnest(range(1, len(words) - 1)) AS i FROM s)
), twice AS (
  SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, gram) AS n FROM g) WHERE n > 1
), r AS (
  SELECT doc_id, count(DISTINCT p) AS n_repeat_words
  FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM twice) GROUP BY doc_id
), m AS (
  SELECT s.doc_id, len(words) AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols, len(lines) AS n_lines,
    len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words,
    len(list_filter(words, lambda x: lower(x) IN (STOPS))) AS n_stop,
    len(list_filter(lines, lambda x: regexp_matches(x, '^\s*[-*•]'))) AS n_bullet,
    len(list_filter(lines, lambda x: regexp_matches(x, '(\.\.\.|…)\s*$'))) AS n_ellipsis
  FROM s LEFT JOIN r USING (doc_id)
), v AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, concat_ws(',',
    CASE WHEN n_words < 50 OR n_words > 1000000 THEN 'length' END,
    CASE WHEN n_words = 0 OR word_chars / n_words < 2 OR word_chars / n_words > 20 THEN 'word_length' END,
    CASE WHEN n_words > 0 AND n_symbols / n_words > 0.25 THEN 'symbols' END,
    CASE WHEN n_words = 0 OR n_stop / n_words < 0.01 THEN 'stop_words' END,
    CASE WHEN n_lines > 0 AND n_dup_lines / n_lines > 0.5 THEN 'repeated_lines' END,
    CASE WHEN n_lines > 0 AND n_bullet / n_lines > 0.9 THEN 'bullet_lines' END,
    CASE WHEN n_lines > 0 AND n_ellipsis / n_lines > 0.5 THEN 'ellipsis_lines' END) AS failed_rules
  FROM m
)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols,
  n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words, base_failed,
  NOT base_failed AND failed_rules = '' AS kept, failed_rules
FROM v
""".replace("STOPS", ", ".join(f"'{w}'" for w in dict.fromkeys(STOP_WORDS)))

NEGATIVES = r"""
WITH e AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    [floor(256 * c::DOUBLE) FOR c IN embedding] AS x
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len([c FOR c IN embedding IF c IS NULL OR NOT isfinite(c)]) = 0
), s AS (
  SELECT a.vec_id AS anchor_id, r.vec_id, a.label = r.label AS same, list_inner_product(a.x, r.x)::BIGINT AS score
  FROM e a JOIN e r ON a.vec_id <> r.vec_id WHERE a.vec_id % 100 = 0
), p AS (
  SELECT * FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
)
SELECT anchor_id, p.vec_id AS positive_id,
  row_number() OVER (PARTITION BY anchor_id, p.vec_id ORDER BY n.score DESC, n.vec_id)::INTEGER AS rank,
  n.vec_id AS negative_id, p.score AS positive_score, n.score AS negative_score
FROM p JOIN s n USING (anchor_id)
WHERE NOT n.same AND 80 * p.score <= 100 * n.score AND n.score <= p.score
QUALIFY row_number() OVER (PARTITION BY anchor_id, p.vec_id ORDER BY n.score DESC, n.vec_id) <= 5
"""

ORACLES = {"op6_chat": CHAT, "op10_quality": QUALITY, "op13_hard_negatives": NEGATIVES}
