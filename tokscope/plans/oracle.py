"""DuckDB oracle SQL for every registered query (test-side only).

The oracle re-derives each result independently of Spark: BPE runs as a
recursive CTE that folds the inlined merge list over each distinct piece,
byte matches come from one row per byte plus ``lag``/``lead`` n-grams,
the merge closure is a recursive ``UNION``. The vocabulary and merges of
the fixture tokenizer are inlined as ``VALUES``.
"""

from __future__ import annotations

import json
from functools import lru_cache

from tokscope.plans import queries as Q
from tokscope.session import FIXTURE_BYTE_LEVEL_TOKENIZER, FIXTURE_TOKENIZER, FIXTURE_UNIGRAM_TOKENIZER, FIXTURE_WORDPIECE_TOKENIZER


# Stated here again, not imported: a wrong value in the engine must show.
PRETOKEN = r" ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+"
SENTINEL = "-100000000.0"


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


@lru_cache(maxsize=4)
def _tokenizer(path: str = FIXTURE_TOKENIZER):
    with open(path, encoding="utf-8") as f:
        d = json.load(f)
    model = d["model"]
    vocab = dict(model["vocab"])
    special = {a["content"]: a["id"] for a in d.get("added_tokens", [])}
    merges = [tuple(m) if not isinstance(m, str) else tuple(m.split(" ", 1)) for m in model["merges"]]
    unk = model.get("unk_token")
    unk_id = special.get(unk, vocab.get(unk)) if unk is not None else None
    return vocab, special, merges, unk_id


def _base_ctes(path: str = FIXTURE_TOKENIZER) -> str:
    vocab, special, merges, unk_id = _tokenizer(path)
    by_id = {i: t for t, i in vocab.items()}
    for t, i in special.items():
        by_id[i] = t
    vocab_rows = ",\n  ".join(f"({i}, {_q(t)}, {'true' if t in special else 'false'})" for i, t in sorted(by_id.items()))
    merge_rows = ",\n  ".join(f"({r}, {_q(a)}, {_q(b)})" for r, (a, b) in enumerate(merges, start=1))
    n = len(merges)
    unk = str(unk_id) if unk_id is not None else "NULL"
    return f"""
vocab_all(token_id, token, special) AS (VALUES
  {vocab_rows}),
merges(rank, a, b) AS (VALUES
  {merge_rows}),
docs AS (SELECT doc_id, text FROM documents WHERE text IS NOT NULL AND length(text) > 0),
pieces AS (
  SELECT piece, count(*)::BIGINT AS n
  FROM (SELECT unnest(regexp_extract_all(text, {_q(PRETOKEN)})) AS piece FROM docs)
  GROUP BY piece),
fold(piece, n, step, s) AS (
  SELECT piece, n, 0, regexp_replace(piece, '(?s)(.)', chr(1) || '\\1' || chr(2), 'g') FROM pieces
  UNION ALL
  SELECT f.piece, f.n, f.step + 1,
         replace(f.s, chr(1) || m.a || chr(2) || chr(1) || m.b || chr(2), chr(1) || m.a || m.b || chr(2))
  FROM fold f JOIN merges m ON m.rank = f.step + 1),
folded AS (
  SELECT piece, n, string_split(substr(s, 2, length(s) - 2), chr(2) || chr(1)) AS toks
  FROM fold WHERE step = {n}),
tok_rows AS (
  SELECT piece, n, unnest(toks) AS token, unnest(range(1, len(toks) + 1)) AS i FROM folded),
tok_ids AS (
  SELECT t.piece, t.n, t.i, t.token, coalesce(v.token_id, {unk}) AS token_id
  FROM tok_rows t LEFT JOIN (SELECT token, token_id FROM vocab_all WHERE NOT special) v ON v.token = t.token),
freq AS (SELECT token_id::INTEGER AS token_id, sum(n)::BIGINT AS count FROM tok_ids GROUP BY token_id),
filled AS (
  SELECT coalesce(v.token_id, f.token_id)::INTEGER AS token_id, coalesce(f.count, 0)::BIGINT AS freq
  FROM (SELECT DISTINCT token_id FROM vocab_all) v FULL OUTER JOIN freq f ON v.token_id = f.token_id),
edges AS (
  SELECT DISTINCT ancestor::INTEGER AS ancestor, descendant::INTEGER AS descendant FROM (
    SELECT l.token_id AS ancestor, mm.token_id AS descendant
    FROM merges m JOIN vocab_all l ON l.token = m.a JOIN vocab_all r ON r.token = m.b
         JOIN vocab_all mm ON mm.token = m.a || m.b
    UNION ALL
    SELECT r.token_id, mm.token_id
    FROM merges m JOIN vocab_all l ON l.token = m.a JOIN vocab_all r ON r.token = m.b
         JOIN vocab_all mm ON mm.token = m.a || m.b)),
closure(ancestor, descendant) AS (
  SELECT ancestor, descendant FROM edges
  UNION
  SELECT c.ancestor, e.descendant FROM closure c JOIN edges e ON c.descendant = e.ancestor),
with_desc AS (
  SELECT f.token_id, f.freq, coalesce(d.dsum, 0)::BIGINT AS descendant_freq
  FROM filled f LEFT JOIN (
    SELECT c.ancestor, sum(f2.freq) AS dsum FROM closure c JOIN filled f2 ON f2.token_id = c.descendant
    GROUP BY c.ancestor) d ON d.ancestor = f.token_id),
rarest AS (
  SELECT w.token_id, v.token, w.freq, w.descendant_freq
  FROM with_desc w JOIN vocab_all v ON v.token_id = w.token_id
  WHERE regexp_matches(v.token, '[\\x{{C0}}-\\x{{FF}}]'))"""


DEFAULT_PAT = "pat AS (SELECT DISTINCT hex(encode(token)) AS h, octet_length(encode(token)) AS plen FROM vocab_all WHERE token <> '')"


def _byte_ctes(path: str = FIXTURE_TOKENIZER, pat_sql: str = DEFAULT_PAT, lengths: list[int] | None = None) -> str:
    vocab, special, merges, unk_id = _tokenizer(path)
    if lengths is None:
        lengths = sorted({len(t.encode("utf-8")) for t in list(vocab) + list(special) if t})
    maxlen = max(lengths)
    leads = ",\n         ".join(f"lead(x, {k}) OVER w AS x{k + 1}" for k in range(1, maxlen + 1))
    cands = "\n    UNION ALL\n    ".join(
        f"SELECT {L} AS plen, {' || '.join(f'x{j}' for j in range(1, L + 1))} AS h, lft, x{L + 1} AS rgt "
        f"FROM grams WHERE x{L} IS NOT NULL"
        for L in lengths
    )
    return f""",
{pat_sql},
byte_rows AS (
  SELECT doc_id, unnest(xs) AS x, unnest(range(1, len(xs) + 1)) AS pos
  FROM (SELECT doc_id, regexp_extract_all(hex(encode(text)), '..') AS xs FROM docs)),
grams AS (
  SELECT doc_id, pos, lag(x) OVER w AS lft, x AS x1,
         {leads}
  FROM byte_rows WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
cand AS (
    {cands}),
matches AS (SELECT c.h, c.lft, c.rgt FROM cand c JOIN pat p ON p.plen = c.plen AND p.h = c.h),
hist AS (
  SELECT h, side, byte, count(*)::BIGINT AS c FROM (
    SELECT h, 'L' AS side, ('0x' || lft)::INTEGER AS byte FROM matches WHERE lft IS NOT NULL
    UNION ALL
    SELECT h, 'R' AS side, ('0x' || rgt)::INTEGER AS byte FROM matches WHERE rgt IS NOT NULL)
  GROUP BY h, side, byte),
ent AS (
  SELECT h, log2(sum(c)) - sum(c * log2(c)) / sum(c) AS entropy FROM hist GROUP BY h),
stats AS (
  SELECT h, count(*)::BIGINT AS freq,
         count(*) FILTER (WHERE lft IS NOT NULL AND rgt IS NOT NULL
                          AND NOT (lft BETWEEN '20' AND '7E') AND NOT (rgt BETWEEN '20' AND '7E'))::BIGINT AS standalone
  FROM matches GROUP BY h),
metrics AS (
  SELECT v.token_id::INTEGER AS token_id, v.token,
         coalesce(s.freq, 0)::BIGINT AS freq_in_corpus,
         coalesce(s.standalone, 0) / (coalesce(s.freq, 0) + 1e-6) AS standalone_ratio,
         coalesce(e.entropy, 0.0)::DOUBLE AS entropy,
         octet_length(encode(v.token))::INTEGER AS length_bytes,
         regexp_matches(v.token, '[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F]') AS ctrl
  FROM vocab_all v LEFT JOIN stats s ON s.h = hex(encode(v.token)) LEFT JOIN ent e ON e.h = hex(encode(v.token)))"""


def _byte_level_pat(path: str) -> tuple[str, list[int]]:
    """CTEs giving ``pat`` for a byte-level vocabulary: each character of a
    token stands for one byte by the public byte-level alphabet rule,
    applied here in SQL, so partial UTF-8 sequences stay as they are."""
    with open(path, encoding="utf-8") as f:
        vocab = json.load(f)["model"]["vocab"]
    rows = ",\n  ".join(f"({i}, {_q(t)})" for t, i in sorted(vocab.items(), key=lambda kv: kv[1]))
    cp = "unicode(ch)"
    byte = (
        f"CASE WHEN {cp} < 256 THEN {cp} WHEN {cp} - 256 <= 32 THEN {cp} - 256 "
        f"WHEN {cp} - 256 <= 66 THEN {cp} - 256 - 33 + 127 ELSE 173 END"
    )
    sql = f"""bl_vocab(token_id, token) AS (VALUES
  {rows}),
bl_chars AS (
  SELECT token_id, unnest(string_split(token, '')) AS ch, unnest(range(1, length(token) + 1)) AS i FROM bl_vocab),
pat AS (
  SELECT DISTINCT h, length(h) // 2 AS plen FROM (
    SELECT token_id, string_agg(printf('%02X', {byte}), '' ORDER BY i) AS h FROM bl_chars GROUP BY token_id))"""
    return sql, sorted({len(t) for t in vocab if t})


_BYTE = "('0x' || x)::INTEGER"
_BYTE_CHAR = (
    f"chr(CASE WHEN {_BYTE} BETWEEN 33 AND 126 OR {_BYTE} BETWEEN 161 AND 172 OR {_BYTE} >= 174 THEN {_BYTE} "
    f"WHEN {_BYTE} <= 32 THEN {_BYTE} + 256 WHEN {_BYTE} <= 160 THEN {_BYTE} - 127 + 289 ELSE 323 END)"
)


def _byte_level_pieces() -> str:
    """CTEs ending in ``spelled(piece, n, cs)``: pieces of the byte-level split, as characters of the byte alphabet.

    The look-ahead of the public pattern (white space leaves its last
    character to the next word) is replayed on the pieces of the pattern
    without it: a run of white space before more text gives up its last
    character, which joins the next piece if it is a space.
    """
    pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+"
    return f"""
raw AS (
  SELECT doc_id, unnest(ps) AS p, unnest(range(len(ps))) AS i FROM (
    SELECT doc_id, regexp_extract_all(text, {_q(pattern)}) AS ps FROM documents WHERE text IS NOT NULL AND length(text) > 0)),
around AS (
  SELECT *, lag(p) OVER w AS before, lead(p) OVER w AS after FROM raw WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
flags AS (
  SELECT *, regexp_full_match(p, '\\s+') AND length(p) > 1 AND after IS NOT NULL AS gives,
         regexp_full_match(before, '\\s+') AND length(before) > 1 AS takes FROM around),
shifted AS (
  SELECT CASE WHEN gives THEN substr(p, 1, length(p) - 1) WHEN takes AND right(before, 1) = ' ' THEN ' ' || p ELSE p END AS piece FROM flags
  UNION ALL
  SELECT right(p, 1) FROM flags WHERE gives AND right(p, 1) <> ' '),
pieces AS (SELECT piece, count(*)::BIGINT AS n FROM shifted GROUP BY piece),
spelled AS (
  SELECT piece, n, list_transform(regexp_extract_all(hex(encode(piece)), '..'), lambda x: {_BYTE_CHAR}) AS cs FROM pieces)"""


def _byte_level_frequency(path: str) -> str:
    """Token counts of the byte-level vocabulary."""
    vocab, special, merges, _ = _tokenizer(path)
    vocab_rows = ",\n  ".join(f"({i}, {_q(t)})" for t, i in sorted({**vocab, **special}.items(), key=lambda kv: kv[1]))
    merge_rows = ",\n  ".join(f"({r}, {_q(a)}, {_q(b)})" for r, (a, b) in enumerate(merges, start=1))
    return f"""WITH RECURSIVE vocab(token_id, token) AS (VALUES
  {vocab_rows}),
merges(rank, a, b) AS (VALUES
  {merge_rows}),{_byte_level_pieces()},
fold(piece, n, step, s) AS (
  SELECT piece, n, 0, list_aggregate(list_transform(cs, lambda c: chr(1) || c || chr(2)), 'string_agg', '') FROM spelled
  UNION ALL
  SELECT f.piece, f.n, f.step + 1,
         replace(f.s, chr(1) || m.a || chr(2) || chr(1) || m.b || chr(2), chr(1) || m.a || m.b || chr(2))
  FROM fold f JOIN merges m ON m.rank = f.step + 1),
tokens AS (
  SELECT n, unnest(string_split(substr(s, 2, length(s) - 2), chr(2) || chr(1))) AS token FROM fold WHERE step = {len(merges)})
SELECT v.token_id::INTEGER AS token_id, sum(t.n)::BIGINT AS count FROM tokens t JOIN vocab v ON v.token = t.token GROUP BY v.token_id"""


def _rank_file_frequency() -> str:
    """Token counts by a public rank file: every step joins, in each piece, the first pair whose union has the lowest rank."""
    import public_tokenizers

    path = _q(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    ranks = f"""ranks AS (
  SELECT rank, list_aggregate(list_transform(regexp_extract_all(hex(from_base64(token)), '..'), lambda x: {_BYTE_CHAR}), 'string_agg', '') AS token
  FROM read_csv({path}, delim=' ', header=false, quote='', escape='', columns={{'token': 'VARCHAR', 'rank': 'INTEGER'}}))"""
    return f"""WITH RECURSIVE {ranks},{_byte_level_pieces()},
fold(piece, n, toks, pair) AS (
  SELECT piece, n, CASE WHEN r.token IS NULL THEN cs ELSE [r.token] END, 0::BIGINT
  FROM spelled LEFT JOIN ranks r ON r.token = list_aggregate(cs, 'string_agg', '')
  UNION ALL
  SELECT piece, any_value(n), any_value(toks[:i - 1] || [toks[i] || toks[i + 1]] || toks[i + 2:] ORDER BY rank, i), any_value(i ORDER BY rank, i)
  FROM (SELECT f.piece, f.n, f.toks, i, r.rank,
               row_number() OVER (PARTITION BY f.piece ORDER BY r.rank, i) AS k
        FROM (SELECT *, unnest(range(1, len(toks))) AS i FROM fold) f JOIN ranks r ON r.token = f.toks[i] || f.toks[i + 1])
  WHERE k = 1 GROUP BY piece),
last AS (SELECT piece, any_value(n) AS n, arg_min(toks, len(toks)) AS toks FROM fold GROUP BY piece),
tokens AS (SELECT n, unnest(toks) AS token FROM last)
SELECT r.rank::INTEGER AS token_id, sum(t.n)::BIGINT AS count FROM tokens t JOIN ranks r ON r.token = t.token GROUP BY r.rank"""


def _wordpiece(path: str) -> str:
    """Ids of every document: lower case without accents, words and marks, longest match first, between [CLS] and [SEP]."""
    with open(path, encoding="utf-8") as f:
        vocab = json.load(f)["model"]["vocab"]
    rows = ",\n  ".join(f"({i}, {_q(t)})" for t, i in vocab.items() if i > 2)
    longest = max(len(t.removeprefix("##")) for t in vocab)
    mark = r"[!-/:-@\[-`{-~\p{P}]"
    return f"""WITH RECURSIVE vocab(token_id, token) AS (VALUES
  {rows}),
words AS (
  SELECT doc_id, unnest(ws) AS w, unnest(range(len(ws))) AS i FROM (
    SELECT doc_id, regexp_extract_all(lower(strip_accents(regexp_replace(text, '[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\x7F]', '', 'g'))), {_q(mark + "|[^" + mark[1:-1] + r"\s\x{A0}\x{85}\x{2000}-\x{200A}\x{3000}]+")}) AS ws
    FROM documents WHERE text IS NOT NULL AND length(text) > 0)),
walk(w, pos, ids) AS (
  SELECT DISTINCT w, 1, []::INTEGER[] FROM words WHERE length(w) <= 100
  UNION ALL
  SELECT w, pos + k, ids || [token_id] FROM (
    SELECT x.w, x.pos, x.ids, x.k, v.token_id, row_number() OVER (PARTITION BY x.w ORDER BY x.k DESC) AS best
    FROM (SELECT *, unnest(range(1, least({longest}, length(w) - pos + 1) + 1)) AS k FROM walk WHERE pos <= length(w)) x
    JOIN vocab v ON v.token = CASE WHEN x.pos > 1 THEN '##' ELSE '' END || substr(x.w, x.pos, x.k)) WHERE best = 1),
done AS (SELECT w, ids FROM walk WHERE pos = length(w) + 1),
rows AS (SELECT doc_id, i, coalesce(ids, [0]) AS ids FROM words LEFT JOIN done USING (w)),
lists AS (SELECT doc_id, flatten(list(ids ORDER BY i)) AS ids FROM rows GROUP BY doc_id)
SELECT doc_id, (len(ids) + 2)::INTEGER AS n_tokens, array_to_string([1] || ids || [2], ',') AS ids
FROM (SELECT doc_id, coalesce(ids, []) AS ids FROM (SELECT doc_id FROM documents WHERE text IS NOT NULL AND length(text) > 0) LEFT JOIN lists USING (doc_id))"""


def _unigram(path: str) -> str:
    """Ids of every document: marked words, each by the best-scoring path (earlier start on equal scores), unknown runs as one."""
    with open(path, encoding="utf-8") as f:
        vocab = json.load(f)["model"]["vocab"]
    rows = ",\n  ".join(f"({i}, {_q(t)}, {x!r})" for i, (t, x) in enumerate(vocab) if i > 0)
    unknown = min(x for _, x in vocab) - 10
    longest = max(len(t) for t, _ in vocab)
    return f"""WITH RECURSIVE vocab(token_id, token, score) AS (VALUES
  {rows}),
marked AS (
  SELECT doc_id, replace(regexp_replace(nfc_normalize(text), '[\\t\\n\\r]', ' ', 'g'), ' ', '▁') AS t FROM documents WHERE text IS NOT NULL AND length(text) > 0),
words AS (
  SELECT doc_id, unnest(ws) AS w, unnest(range(len(ws))) AS i FROM (
    SELECT doc_id, regexp_extract_all(CASE WHEN starts_with(t, '▁') THEN t ELSE '▁' || t END, '▁[^▁]*') AS ws FROM marked)),
pieces AS (SELECT DISTINCT w FROM words),
places AS (
  SELECT w, s, s + k - 1 AS e, v.token_id, v.score
  FROM (SELECT w, s, unnest(range(1, least({longest}, length(w) - s + 1) + 1)) AS k FROM (SELECT w, unnest(range(1, length(w) + 1)) AS s FROM pieces)) x
  JOIN vocab v ON v.token = substr(x.w, x.s, x.k)),
steps AS (
  SELECT w, s, e, token_id, score FROM places
  UNION ALL
  SELECT w, s, s, 0, {unknown!r} FROM (SELECT w, unnest(range(1, length(w) + 1)) AS s FROM pieces) a
  WHERE NOT EXISTS (SELECT 1 FROM places p WHERE p.w = a.w AND p.s = a.s AND p.e = a.s)),
per_end AS (SELECT w, e, list(struct_pack(s := s, token_id := token_id, score := score::DOUBLE) ORDER BY s) AS come FROM steps GROUP BY w, e),
best(w, e, scores, paths) AS (
  SELECT w, 0, [0.0::DOUBLE], [[]::INTEGER[]] FROM pieces
  UNION ALL
  SELECT b.w, b.e + 1, b.scores || [b.scores[pick.s] + pick.score], b.paths || [b.paths[pick.s] || [pick.token_id]]
  FROM (SELECT b.*, list_reduce(p.come, lambda x, y: CASE WHEN b.scores[y.s] + y.score > b.scores[x.s] + x.score THEN y ELSE x END) AS pick
        FROM best b JOIN per_end p ON p.w = b.w AND p.e = b.e + 1) b),
done AS (
  SELECT w, list_transform(list_filter(range(1, len(ids) + 1), lambda j: NOT (ids[j] = 0 AND j > 1 AND ids[j - 1] = 0)), lambda j: ids[j]) AS ids
  FROM (SELECT w, paths[len(paths)] AS ids FROM best WHERE e = length(w))),
lists AS (SELECT doc_id, flatten(list(ids ORDER BY i)) AS ids FROM words JOIN done USING (w) GROUP BY doc_id)
SELECT doc_id, len(ids)::INTEGER AS n_tokens, array_to_string(ids, ',') AS ids FROM lists"""


def _with(body: str, byte: bool = False) -> str:
    ctes = _base_ctes() + (_byte_ctes() if byte else "")
    return f"WITH RECURSIVE {ctes}\n{body}"


R = Q.ROUND


def oracle_sql() -> dict[str, str]:
    sentinel = SENTINEL
    ratio = (
        f"round(coalesce(CASE WHEN freq + descendant_freq <> 0 THEN freq / (freq + descendant_freq) END, {sentinel}), {R})"
    )
    meaningless = "(freq_in_corpus = 0 OR ctrl OR (entropy < 0.5 AND standalone_ratio < 0.05 AND freq_in_corpus < 10))"
    sql = {
        "pretoken_count": _with("SELECT piece, n FROM pieces"),
        "token_frequency": _with("SELECT token_id, count FROM freq"),
        "top_tokens_report": _with(f"SELECT token_id, count FROM freq ORDER BY count DESC, token_id LIMIT {Q.TOP_K}"),
        "distinct_token_count": _with("SELECT count(DISTINCT token_id)::BIGINT AS n_distinct FROM freq"),
        "encode_distinct": _with(
            "SELECT piece, n, count(*)::INTEGER AS n_tokens, string_agg(token_id::VARCHAR, ',' ORDER BY i) AS ids "
            "FROM tok_ids GROUP BY piece, n"
        ),
        "bpe_fold": _with(
            "SELECT piece, n, len(toks)::INTEGER AS n_tokens, array_to_string(toks, '|') AS tokens FROM folded"
        ),
        "merge_edges": _with(
            "SELECT e.ancestor, e.descendant, fa.freq AS ancestor_freq, fd.freq AS descendant_freq "
            "FROM edges e JOIN filled fa ON fa.token_id = e.ancestor JOIN filled fd ON fd.token_id = e.descendant"
        ),
        "merge_closure": _with(
            "SELECT c.ancestor::INTEGER AS ancestor, c.descendant::INTEGER AS descendant, f.freq AS descendant_freq "
            "FROM closure c JOIN filled f ON f.token_id = c.descendant"
        ),
        "closure_adjacency": _with(
            "SELECT c.ancestor::INTEGER AS ancestor, count(*)::BIGINT AS n_descendants, "
            "string_agg(c.descendant::VARCHAR, ',' ORDER BY c.descendant) AS descendants, "
            "count(*) FILTER (WHERE f.freq > 0)::BIGINT AS n_used "
            "FROM closure c JOIN filled f ON f.token_id = c.descendant GROUP BY c.ancestor"
        ),
        "closure_to_text": _with(
            "SELECT c.ancestor::INTEGER AS token_id, va.token, "
            "string_agg(vd.token, '|' ORDER BY c.descendant) AS descendants, any_value(f.freq) AS freq "
            "FROM closure c JOIN vocab_all va ON va.token_id = c.ancestor "
            "JOIN vocab_all vd ON vd.token_id = c.descendant JOIN filled f ON f.token_id = c.ancestor "
            "GROUP BY c.ancestor, va.token"
        ),
        "zero_fill": _with("SELECT token_id, freq FROM filled"),
        "descendant_frequency": _with("SELECT token_id, freq, descendant_freq FROM with_desc"),
        "rarest_script_tokens": _with(
            "SELECT token_id::INTEGER AS token_id, token, freq, descendant_freq, "
            "(row_number() OVER (ORDER BY freq, token_id) - 1)::BIGINT AS rank FROM rarest ORDER BY rank"
        ),
        "rank_by_survival_ratio": _with(
            "SELECT token_id, token, freq, descendant_freq, ratio, "
            "(row_number() OVER (ORDER BY ratio, freq, token_id) - 1)::BIGINT AS rank FROM ("
            f"SELECT token_id::INTEGER AS token_id, token, freq, descendant_freq, {ratio} AS ratio FROM rarest) ORDER BY rank"
        ),
        "byte_token_frequency": _with("SELECT h AS token_hex, freq FROM stats", byte=True),
        "standalone_frequency": _with("SELECT h AS token_hex, standalone FROM stats", byte=True),
        "neighbor_counts": _with("SELECT h AS token_hex, side, byte, c AS count FROM hist", byte=True),
        "neighbor_entropy": _with(f"SELECT h AS token_hex, round(entropy, {R}) AS entropy FROM ent", byte=True),
        "token_metrics": _with(
            f"SELECT token_id, token, freq_in_corpus, round(standalone_ratio, {R}) AS standalone_ratio, "
            f"round(entropy, {R}) AS entropy, length_bytes, {meaningless} AS meaningless FROM metrics",
            byte=True,
        ),
        "entropy_rank_curve": _with(
            f"SELECT (row_number() OVER (ORDER BY entropy DESC) - 1)::BIGINT AS x, round(entropy, {R}) AS y FROM metrics",
            byte=True,
        ),
        "drop_empty_text": "SELECT doc_id, length(text)::INTEGER AS n_chars FROM documents WHERE text IS NOT NULL AND length(text) > 0",
        "contains_script": "SELECT doc_id, regexp_matches(text, '[\\x{C0}-\\x{FF}]') AS has_script "
        "FROM documents WHERE text IS NOT NULL AND length(text) > 0",
        "filter_script_tokens": _with("SELECT piece, n FROM pieces WHERE regexp_matches(piece, '[\\x{C0}-\\x{FF}]')"),
        "has_control_byte": "SELECT doc_id, regexp_matches(text, '[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F]') AS has_control "
        "FROM documents WHERE text IS NOT NULL AND length(text) > 0",
        "byte_length": "SELECT doc_id, octet_length(encode(text))::INTEGER AS n_bytes, length(text)::INTEGER AS n_chars "
        "FROM documents WHERE text IS NOT NULL AND length(text) > 0",
        "chunk_fixed": (
            f"SELECT doc_id, chunk_no::INTEGER AS chunk_no, substr(text, chunk_no * {Q.CHUNK_CHARS} + 1, {Q.CHUNK_CHARS}) AS chunk "
            f"FROM (SELECT doc_id, text, unnest(range(0, ceil(length(text) / {Q.CHUNK_CHARS}.0)::BIGINT)) AS chunk_no "
            "FROM documents WHERE text IS NOT NULL AND length(text) > 0)"
        ),
        "batch_by_count": (
            "SELECT batch_no, count(*)::BIGINT AS n_docs, string_agg(text, ' ' ORDER BY doc_id) AS text FROM ("
            f"SELECT doc_id, text, ((row_number() OVER (ORDER BY doc_id) - 1) // {Q.BATCH_DOCS})::BIGINT AS batch_no "
            "FROM documents WHERE text IS NOT NULL AND length(text) > 0) GROUP BY batch_no"
        ),
        "batch_docs_newline": (
            "SELECT batch_no, count(*)::BIGINT AS n_docs, string_agg(text, chr(10) ORDER BY doc_id) AS text FROM ("
            f"SELECT doc_id, text, ((row_number() OVER (ORDER BY doc_id) - 1) // {Q.NEWLINE_BATCH_DOCS})::BIGINT AS batch_no "
            "FROM documents WHERE text IS NOT NULL AND length(text) > 0) GROUP BY batch_no"
        ),
        "batch_by_chars": (
            "WITH RECURSIVE r AS (SELECT doc_id, text, length(text) AS len, row_number() OVER (ORDER BY doc_id) AS rn "
            "FROM documents WHERE text IS NOT NULL AND length(text) > 0), "
            "pk(rn, pack_no, acc) AS (SELECT rn, 0, len FROM r WHERE rn = 1 UNION ALL "
            f"SELECT r.rn, CASE WHEN pk.acc >= {Q.PACK_THRESHOLD} THEN pk.pack_no + 1 ELSE pk.pack_no END, "
            f"CASE WHEN pk.acc >= {Q.PACK_THRESHOLD} THEN r.len ELSE pk.acc + r.len END "
            "FROM pk JOIN r ON r.rn = pk.rn + 1) "
            "SELECT pack_no::BIGINT AS pack_no, pack_no::BIGINT AS batch_no, count(*)::BIGINT AS n_docs, "
            "sum(r.len)::BIGINT AS n_chars, string_agg(r.text, ' ' ORDER BY r.rn) AS text "
            "FROM pk JOIN r USING (rn) GROUP BY pack_no"
        ),
        "scan_conversations": (
            "SELECT conv_id, text AS content FROM ("
            "SELECT conv_id, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k FROM conversations) "
            "WHERE k = 1 AND text IS NOT NULL"
        ),
        "line_count": "SELECT coalesce(sum(length(text) - length(replace(text, chr(10), ''))), 0)::BIGINT AS n_lines "
        "FROM documents WHERE text IS NOT NULL AND length(text) > 0",
        "shuffle_rows": "SELECT doc_id, length(text)::INTEGER AS n_chars FROM documents WHERE text IS NOT NULL AND length(text) > 0",
    }
    sql["running_token_frequency"] = sql["token_frequency"]
    sql["write_frequencies"] = sql["token_frequency"]
    sql["progress_metrics"] = _with(
        "SELECT b.k::INTEGER AS batch_id, (SELECT count(*) FROM docs WHERE doc_id % 4 = b.k)::BIGINT AS n_docs, "
        "(SELECT count(DISTINCT t.token_id) FROM tok_ids t JOIN (SELECT DISTINCT unnest("
        f"regexp_extract_all(text, {_q(PRETOKEN)})) AS piece, doc_id % 4 AS k FROM docs) p ON p.piece = t.piece WHERE p.k <= b.k)::BIGINT AS unique_tokens "
        "FROM (SELECT unnest(range(4)) AS k) b"
    )
    sql["write_metrics"] = _with(
        f"SELECT token, freq_in_corpus, round(standalone_ratio, {R}) AS standalone_ratio, "
        f"round(entropy, {R}) AS entropy, length_bytes, {meaningless} AS meaningless FROM metrics",
        byte=True,
    )
    sql["write_ranked"] = _with(
        f"SELECT token_id::INTEGER AS token_id, token, freq, descendant_freq, ratio, "
        "(row_number() OVER (ORDER BY ratio, freq, token_id) - 1)::BIGINT AS rank "
        f"FROM (SELECT token_id, token, freq, descendant_freq, {ratio} AS ratio FROM rarest)"
    )
    sql["corpus_from_jsonl_tree"] = "SELECT text FROM documents"
    bl_pat, bl_lengths = _byte_level_pat(FIXTURE_BYTE_LEVEL_TOKENIZER)
    sql["byte_level_frequency"] = (
        f"WITH RECURSIVE {_base_ctes()}{_byte_ctes(pat_sql=bl_pat, lengths=bl_lengths)}\n"
        "SELECT h AS token_hex, freq, standalone FROM stats"
    )
    sql["scan_text"] = (
        "SELECT sum(length(text) - length(replace(text, chr(10), '')) + 1)::BIGINT AS n_lines, sum(length(text) + 1)::BIGINT AS n_chars "
        "FROM documents WHERE text IS NOT NULL"
    )
    sql["scan_bytes"] = (
        "SELECT sum(octet_length(encode(text)) + 2)::BIGINT AS n_bytes, "
        "sum(length(text) - length(replace(text, chr(10), '')) + 1)::BIGINT AS n_newlines, "
        "sum(length(text) - length(replace(text, chr(13), '')) + 1)::BIGINT AS n_returns FROM documents WHERE text IS NOT NULL"
    )
    sql["scan_table"] = "SELECT doc_id, lang AS text FROM documents"
    sql["skip_malformed"] = (
        "WITH f AS (SELECT conv_id, text FROM (SELECT conv_id, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k "
        "FROM conversations) WHERE k = 1), "
        "r AS (SELECT text IS NOT NULL AS ok FROM f UNION ALL SELECT false FROM f WHERE conv_id % 5 = 0 "
        "UNION ALL SELECT false FROM f WHERE conv_id % 7 = 0) SELECT ok, count(*)::BIGINT AS n FROM r GROUP BY ok"
    )
    # Characters by the piece in which their first byte lies; a piece that starts or ends inside one shows a mark there
    # (of a cut character, every byte but the first is invalid by itself at the start of the next piece).
    sql["replace_invalid"] = (
        "WITH chars AS (SELECT doc_id, unnest(string_split(text, '')) AS ch, unnest(range(length(text))) AS i FROM documents "
        "WHERE text IS NOT NULL AND length(text) > 0), "
        "sized AS (SELECT *, octet_length(encode(ch)) AS w, (sum(octet_length(encode(ch))) OVER (PARTITION BY doc_id ORDER BY i) - octet_length(encode(ch)))::BIGINT AS b FROM chars), "
        f"parts AS (SELECT doc_id, i, unnest(range(b // {Q.CUT_BYTES}, (b + w - 1) // {Q.CUT_BYTES} + 1)) AS piece, ch, w, b FROM sized), "
        f"shown AS (SELECT doc_id, piece, i, CASE WHEN b // {Q.CUT_BYTES} = (b + w - 1) // {Q.CUT_BYTES} THEN ch "
        f"WHEN b // {Q.CUT_BYTES} = piece THEN chr(65533) "
        f"ELSE repeat(chr(65533), (b + w - piece * {Q.CUT_BYTES})::INTEGER) END AS x FROM parts) "
        "SELECT doc_id, piece::INTEGER AS piece, string_agg(x, '' ORDER BY i) AS text FROM shown GROUP BY doc_id, piece"
    )
    sql["encode_wordpiece"] = _wordpiece(FIXTURE_WORDPIECE_TOKENIZER)
    sql["encode_unigram"] = _unigram(FIXTURE_UNIGRAM_TOKENIZER)
    sql["encode_gpt"] = _rank_file_frequency()
    sql["flatten"] = "SELECT unnest(string_split(text, chr(10))) AS line FROM documents WHERE text IS NOT NULL AND length(text) > 0"
    sql["empty_result_check"] = (
        "SELECT count(*)::BIGINT AS n_docs, count(*) > 0 AS some_written, false AS none_written "
        "FROM documents WHERE text IS NOT NULL AND length(text) > 0"
    )
    sql["reuse_closure"] = sql["merge_closure"]
    sql["extend_closure"] = (
        "WITH RECURSIVE words AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS w FROM documents), "
        "steps AS (SELECT w, unnest(range(2, length(w) + 1)) AS i FROM words), "
        "edges AS (SELECT DISTINCT unnest([w[1:i - 1], w[i:i]]) AS ancestor, w[1:i] AS descendant FROM steps), "
        "closure(ancestor, descendant) AS (SELECT ancestor, descendant FROM edges UNION "
        "SELECT c.ancestor, e.descendant FROM closure c JOIN edges e ON c.descendant = e.ancestor) "
        "SELECT ancestor, count(*)::BIGINT AS n_descendants, sum(length(descendant))::BIGINT AS n_chars, "
        "max(descendant) AS last_descendant FROM closure GROUP BY ancestor"
    )
    by_source = f"WITH p AS (SELECT source, unnest(regexp_extract_all(text, {_q(PRETOKEN)})) AS piece FROM documents) "
    sql["distinct_pieces_sketched"] = (
        by_source + "SELECT source, false AS is_total, count(DISTINCT piece)::BIGINT AS n_distinct, true AS within_error FROM p GROUP BY source "
        "UNION ALL SELECT NULL, true, count(DISTINCT piece)::BIGINT, true FROM p"
    )
    sql["heavy_pieces"] = by_source + f"SELECT piece, count(*)::BIGINT AS count FROM p GROUP BY piece ORDER BY count DESC, piece LIMIT {Q.TOP_K}"
    sql["stateful_token_frequency"] = sql["token_frequency"]
    sql["token_frequency_byte_level"] = _byte_level_frequency(FIXTURE_BYTE_LEVEL_TOKENIZER)
    sql["write_merge_closure"] = _with(
        "SELECT c.ancestor::INTEGER AS ancestor, c.descendant::INTEGER AS descendant, f.freq AS descendant_freq, v.token AS descendant_text "
        "FROM closure c JOIN filled f ON f.token_id = c.descendant JOIN vocab_all v ON v.token_id = c.descendant"
    )
    sql["sort_by_frequency_desc"] = _with("SELECT token_id, count FROM freq ORDER BY count DESC, token_id")
    sql["batch_lines"] = (
        "SELECT batch_no, count(*)::BIGINT AS n_lines, string_agg(line, chr(10) ORDER BY doc_id, i) AS text FROM ("
        f"SELECT doc_id, i, line, ((row_number() OVER (ORDER BY doc_id, i) - 1) // {Q.LINE_BATCH})::BIGINT AS batch_no FROM ("
        "SELECT doc_id, unnest(ls) AS line, unnest(range(0, len(ls))) AS i FROM ("
        "SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL AND length(text) > 0)) "
        "WHERE length(line) > 0) GROUP BY batch_no"
    )
    sql["decode_sequence"] = "SELECT doc_id, text FROM documents WHERE text IS NOT NULL AND length(text) > 0"
    return sql
