"""Building blocks of the DuckDB statements that check the registered queries."""

from __future__ import annotations

# The same white space as the Spark side, in RE2 spelling.
WS = r"[\s\x0b\x1c-\x1f\x{85}\pZ]+"


def literal(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def words(text: str) -> str:
    return f"list_filter(regexp_split_to_array({text}, '{WS}'), lambda x: x <> '')"


def n_words(text: str) -> str:
    return f"CAST(len({words(text)}) AS INTEGER)"


def strip(text: str) -> str:
    return f"regexp_replace(regexp_replace({text}, '\\A{WS}', ''), '{WS}\\z', '')"


def flat(text: str) -> str:
    return f"array_to_string({words(text)}, ' ')"


def truncate(text: str, budget: str | int) -> str:
    w = words(text)
    return f"CASE WHEN len({w}) <= {budget} THEN {text} ELSE array_to_string(({w})[1:{budget}], ' ') END"


def tokens(text: str) -> str:
    return f"regexp_extract_all(lower(coalesce({text}, '')), '[a-z0-9]+')"


def uwords(text: str) -> str:
    return f"regexp_extract_all(lower({text}), '[\\p{{L}}\\p{{N}}_'']+')"


def sentences(text: str, trim_parts: bool = True) -> str:
    parts = f"string_split(regexp_replace({strip(text)}, '([.!?]){WS}', '\\1' || chr(1), 'g'), chr(1))"
    if trim_parts:
        parts = f"list_transform({parts}, lambda s: {strip('s')})"
    return f"list_filter({parts}, lambda s: s <> '')"


def scoring_lines(text: str) -> str:
    return f"regexp_replace({flat(f'coalesce({text}, {chr(39)*2})')}, '([.!?]) ', '\\1' || chr(10), 'g')"


def prompt(query: str, transcript: str) -> str:
    head = (
        "You are given a meeting transcript and a query. Answer the query with a "
        "concise summary based only on the transcript."
    )
    return (
        f"'{head}' || chr(10) || chr(10) || 'Query: ' || {query} || chr(10) || chr(10) || 'Transcript:' || chr(10) "
        f"|| {transcript} || chr(10) || chr(10) || 'Summary:'"
    )


CHAT_LINES = """
lines AS (SELECT CAST(conv_id AS VARCHAR) AS meeting_id, CAST(turn AS INTEGER) AS utt_idx,
                 role || ': ' || text AS line, {n} AS n FROM conversations)
""".format(n=n_words("role || ': ' || text"))

DOC_LINES = """
split_docs AS (SELECT doc_id, source, string_split(text, chr(10)) AS parts FROM documents),
doc_parts AS (SELECT doc_id, source, unnest(parts) AS text, generate_subscripts(parts, 1) - 1 AS utt_idx
              FROM split_docs),
lines AS (SELECT CAST(doc_id AS VARCHAR) AS meeting_id, CAST(utt_idx AS INTEGER) AS utt_idx,
                 source || ': ' || text AS line, {n} AS n FROM doc_parts)
""".format(n=n_words("source || ': ' || text"))

CHAT_QUERIES = """
queries AS (
  SELECT u.conv_id, u.turn, CAST(u.conv_id AS VARCHAR) || '_' ||
         CASE WHEN (u.conv_id + u.turn) % 5 = 0 THEN 'g' ELSE 's' END || u.turn AS query_id,
         CAST(u.conv_id AS VARCHAR) AS meeting_id, u.text AS query, a.text AS reference,
         (u.conv_id + u.turn) % 5 <> 0 AS is_specific
  FROM conversations u JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1
  WHERE u.role = 'user' AND a.role = 'assistant')
"""

DOC_QUERIES = """
queries AS (SELECT CAST(doc_id AS VARCHAR) || '_g0' AS query_id, CAST(doc_id AS VARCHAR) AS meeting_id,
                   parts[1] AS query, parts[-1] AS reference, false AS is_specific FROM split_docs)
"""


def windows(budget: int) -> str:
    """CTEs `win`: greedy windows over `lines`."""
    return f"""
fold AS (
  SELECT meeting_id, utt_idx, n AS used, 0 AS win FROM lines WHERE utt_idx = 0
  UNION ALL
  SELECT l.meeting_id, l.utt_idx,
         CASE WHEN f.used + l.n > {budget} THEN l.n ELSE f.used + l.n END,
         CASE WHEN f.used + l.n > {budget} THEN f.win + 1 ELSE f.win END
  FROM fold f JOIN lines l ON l.meeting_id = f.meeting_id AND l.utt_idx = f.utt_idx + 1),
win AS (
  SELECT meeting_id, f.win AS win_idx, min(utt_idx) AS s, max(utt_idx) AS e, CAST(sum(n) AS INTEGER) AS n_words,
         string_agg(line, chr(10) ORDER BY utt_idx) AS text
  FROM fold f JOIN lines USING (meeting_id, utt_idx) GROUP BY ALL)
"""


# Gold lines of a chat query: the answer, the turn behind it, and line 0 when asked later on.
CHAT_GOLD = """
n_lines AS (SELECT meeting_id, max(utt_idx) AS last_line FROM lines GROUP BY 1),
gold AS (
  SELECT DISTINCT query_id, unnest(CASE WHEN turn >= 2 THEN [turn + 1, least(turn + 2, last_line), 0]
                                        ELSE [turn + 1, least(turn + 2, last_line)] END) AS line_no
  FROM queries JOIN n_lines USING (meeting_id) WHERE is_specific)
"""

CHAT_LABEL = """CASE WHEN is_specific AND ((s <= turn + 2 AND e >= turn + 1) OR (turn >= 2 AND s = 0))
     THEN 1 ELSE 0 END"""


LEXICAL = f"len(list_intersect(list_distinct({tokens('query')}), list_distinct({tokens('text')})))"


def packed(budget: int, label: str = "0", score: str = LEXICAL, joins: str = "") -> str:
    """CTEs `pairs` and `picked`, with the lexical score unless another is given."""
    return f"""
pairs AS (
  SELECT query_id, meeting_id, query, win_idx, s, e, n_words, text, {label} AS label,
         {score} AS score
  FROM queries JOIN win USING (meeting_id) {joins}),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, s DESC) AS r FROM pairs),
pk AS (
  SELECT query_id, r, n_words AS used, true AS taken FROM ranked WHERE r = 1
  UNION ALL
  SELECT x.query_id, x.r, CASE WHEN p.used + x.n_words <= {budget} THEN p.used + x.n_words ELSE p.used END,
         p.used + x.n_words <= {budget}
  FROM pk p JOIN ranked x ON x.query_id = p.query_id AND x.r = p.r + 1),
picked AS (SELECT ranked.* FROM ranked JOIN pk USING (query_id, r) WHERE taken)
"""


def with_ctes(*ctes: str, select: str) -> str:
    return "WITH RECURSIVE " + ",\n".join(c.strip().rstrip(",") for c in ctes) + "\n" + select
