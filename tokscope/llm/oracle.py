"""DuckDB SQL for the corpus queries that SQL can express.

The others (mined rules, trained models, packing, HTML, byte-level repeats,
SimHash) are tested against brute force, round trips or held-out labels.
Constants are stated here again, so that a wrong value in an operator shows.
"""

from __future__ import annotations

_SPACE = r"[\x20\x09-\x0D]"
_STRIP = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_LOWER = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"

_LINE_DEDUP = f"""
WITH lines AS (
  SELECT doc_id, unnest(ls) AS line, unnest(range(len(ls))) AS i
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents)),
keyed AS (SELECT *, translate(trim(line, {_STRIP}), {_LOWER}) AS key FROM lines),
often AS (
  SELECT key, max(doc_id) AS last FROM keyed WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
marked AS (SELECT k.*, o.key IS NOT NULL AND k.doc_id <> o.last AS gone FROM keyed k LEFT JOIN often o ON o.key = k.key)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (WHERE gone)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id"""

_NGRAM_JOIN = f"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), {_LOWER}), '{_SPACE}+'), lambda w: w <> '') AS w FROM documents),
grams AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 4
    THEN list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))
    WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM words),
sizes AS (SELECT doc_id, count(*)::BIGINT AS n FROM grams GROUP BY doc_id),
shared AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM grams a JOIN grams b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (
  SELECT s.a, s.b FROM shared s JOIN sizes x ON x.doc_id = s.a JOIN sizes y ON y.doc_id = s.b
  WHERE 100 * s.i >= 85 * (x.n + y.n - s.i)),
sides AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach(doc_id, other) AS (
  SELECT doc_id, doc_id FROM documents
  UNION
  SELECT r.doc_id, l.b FROM reach r JOIN sides l ON l.a = r.other)
SELECT r.doc_id, coalesce(any_value(s.n), 0)::BIGINT AS n_shingles, min(r.other) AS component_id
FROM reach r LEFT JOIN sizes s ON s.doc_id = r.doc_id GROUP BY r.doc_id"""

_PHRASES = (
    "all rights reserved|terms of use|terms of service|privacy policy|cookie policy|uses cookies|accept cookies|released under the|"
    "licensed under|subscribe to our|sign up for|click here|alle rechte vorbehalten|datenschutzerklärung|tous droits réservés|"
    "politique de confidentialité|todos los derechos reservados|política de privacidad|lorem ipsum|enable javascript"
)

_QUALITY_RULES = f"""
WITH base AS (
  SELECT doc_id, coalesce(text, '') AS t FROM documents),
words AS (SELECT doc_id, t, list_filter(string_split_regex(t, '{_SPACE}+'), lambda w: w <> '') AS w FROM base),
windows AS (
  SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM words)),
twice AS (SELECT doc_id, g FROM windows GROUP BY doc_id, g HAVING count(*) > 1),
covered AS (
  SELECT doc_id, count(DISTINCT p)::BIGINT AS n_repeat_words
  FROM (SELECT v.doc_id, unnest([v.i, v.i + 1, v.i + 2]) AS p FROM windows v JOIN twice USING (doc_id, g)) GROUP BY doc_id),
lines AS (
  SELECT doc_id, unnest(string_split(t, chr(10))) AS x FROM base),
judged AS (
  SELECT doc_id, x, regexp_matches(x, '[^\\x20\\x09-\\x0D]') AS filled,
         string_split_regex(trim(x, ' '), '{_SPACE}+') AS ws, len(ws) AS n,
         list_sort(ws)[n // 2 + 1] AS middle, len(list_filter(ws, lambda w: w = middle)) AS same,
         len(regexp_extract_all(x, '(?i)({_PHRASES})')) AS phrases,
         len(regexp_extract_all(x, '[#*$%&<>]{{2,}}|[!?]{{2,}}')) AS marks, len(regexp_extract_all(x, '[|»›·]')) AS seps
  FROM lines),
lost AS (
  SELECT doc_id, count(*) FILTER (WHERE filled) - count(DISTINCT x) FILTER (WHERE filled) AS n_dup_lines,
         sum(CASE WHEN marks > 0.3 * n OR (seps >= 2 AND seps * 4 >= n) OR phrases * 400 > length(x) OR (n >= 10 AND same > 0.5 * n)
             THEN length(regexp_replace(x, '{_SPACE}', '', 'g')) ELSE 0 END) AS chars
  FROM judged GROUP BY doc_id),
counts AS (
  SELECT w.doc_id, len(w.w)::BIGINT AS n_words, length(array_to_string(w.w, ''))::BIGINT AS word_chars,
         len(regexp_extract_all(w.t, '[#*$%&|<>]'))::BIGINT AS n_symbols, l.n_dup_lines::BIGINT AS n_dup_lines,
         coalesce(c.n_repeat_words, 0)::BIGINT AS n_repeat_words, l.chars
  FROM words w JOIN lost l USING (doc_id) LEFT JOIN covered c USING (doc_id)),
verdict AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM counts)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND chars / greatest(word_chars, 1) <= 0.5 AS kept FROM verdict"""

_LEXICAL_SEARCH = f"""
WITH pattern AS (SELECT '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+' AS p),
doc_terms AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, {_LOWER}), p)) AS term FROM documents, pattern),
sizes AS (SELECT doc_id, count(*)::BIGINT AS n FROM doc_terms GROUP BY doc_id),
corpus AS (SELECT count(*)::BIGINT AS big_n, sum(n)::BIGINT AS big_l FROM sizes),
tfs AS (SELECT doc_id, term, count(*)::BIGINT AS tf FROM doc_terms GROUP BY doc_id, term),
dfs AS (SELECT term, count(*)::BIGINT AS df FROM tfs GROUP BY term),
asked AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, {_LOWER}), p)) AS term FROM benchmark, pattern),
scored AS (
  SELECT a.item_id, t.doc_id,
         sum(floor(1000 * ln((2 * big_n + 2)::DOUBLE / (2 * df + 1)::DOUBLE))::BIGINT
             * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + ((90 * n * big_n) // big_l)))))::BIGINT AS score
  FROM asked a JOIN tfs t USING (term) JOIN dfs USING (term) JOIN sizes s ON s.doc_id = t.doc_id, corpus
  GROUP BY a.item_id, t.doc_id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS r FROM scored WHERE score > 0)
SELECT item_id, r::INTEGER AS rank, doc_id, score FROM ranked WHERE r <= 10"""

_HARD_NEGATIVES = """
WITH rows AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
pairs AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same,
         list_sum(list_transform(list_zip(a.v, b.v), lambda z: z[1] * z[2]))::BIGINT AS score
  FROM rows a JOIN rows b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
positives AS (
  SELECT anchor_id, other_id AS positive_id, score AS positive_score
  FROM (SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) AS r FROM pairs WHERE same) WHERE r <= 5),
ranked AS (
  SELECT p.anchor_id, p.positive_id, n.other_id AS negative_id, p.positive_score, n.score AS negative_score,
         row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY n.score DESC, n.other_id) AS r
  FROM positives p JOIN pairs n ON n.anchor_id = p.anchor_id AND NOT n.same
  WHERE 80 * p.positive_score <= 100 * n.score AND n.score <= p.positive_score)
SELECT anchor_id, positive_id, r::INTEGER AS rank, negative_id, positive_score, negative_score FROM ranked WHERE r <= 5"""

ORACLE_SQL: dict[str, str] = {
    "op1_line_dedup": _LINE_DEDUP,
    "op3_ngram_join": _NGRAM_JOIN,
    "op6_quality_rules": _QUALITY_RULES,
    "op12_lexical_search": _LEXICAL_SEARCH,
    "op13_hard_negatives": _HARD_NEGATIVES,
}
