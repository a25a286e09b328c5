"""SQL text of stemmed overlap: the stemmer's steps as CASE columns over distinct words, and matches between sentences."""

from __future__ import annotations

from convolens.functions.stemmer import IRREGULAR, STEP2, STEP3, STEP4
from convolens.plans import oracle as O

_SHAPE = """list_reduce(list_prepend('', string_split(w, '')), lambda acc, ch: acc || CASE
    WHEN ch IN ('a', 'e', 'i', 'o', 'u') OR (ch = 'y' AND right(acc, 1) = 'c') THEN 'v' ELSE 'c' END)"""


def _cut(k: int, of: str = "w") -> str:
    return f"substr({of}, 1, greatest(length(w) - {k}, 0))"


def _measure(k: int) -> str:
    s = _cut(k, "s")
    return f"((length({s}) - length(replace({s}, 'vc', ''))) // 2)"


def _ends(*suffixes: str) -> str:
    return "(" + " OR ".join(f"suffix(w, '{x}')" for x in suffixes) + ")"


def _short(k: int) -> str:
    s = _cut(k, "s")
    return f"({s} = 'vc' OR (suffix({s}, 'cvc') AND substr(w, length(w) - {k}, 1) NOT IN ('w', 'x', 'y')))"


def _case(*arms: tuple[str, str]) -> str:
    return "CASE " + " ".join(f"WHEN {when} THEN {then}" for when, then in arms) + " ELSE w END"


def _table(rows) -> list[tuple[str, str]]:
    return [(_ends(x), f"CASE WHEN {_measure(len(x))} > 0 THEN {_cut(len(x))} || '{new}' ELSE w END") for x, new in rows]


def _by_length(suffix: str) -> tuple[str, str]:
    return _ends(suffix), f"CASE WHEN length(w) = 4 THEN {_cut(1)} ELSE {_cut(2)} END"


_LAST = "substr(w, length(w) - 1, 1)"
_STEPS = [
    _case((_ends("sses"), _cut(2)), _by_length("ies"), (f"{_ends('s')} AND NOT {_ends('ss')}", _cut(1))),
    # A bar stands behind what lost its ending and may have to be mended.
    _case(
        _by_length("ied"), (_ends("eed"), f"CASE WHEN {_measure(3)} > 0 THEN {_cut(1)} ELSE w END"),
        *[(f"{_ends(x)} AND contains({_cut(len(x), 's')}, 'v')", f"{_cut(len(x))} || '|'") for x in ("ed", "ing")],
    ),
    _case(
        (f"NOT {_ends('|')}", "w"), (_ends("at|", "bl|", "iz|"), f"{_cut(1)} || 'e'"),
        (
            f"length(w) > 2 AND {_LAST} = substr(w, length(w) - 2, 1) AND suffix({_cut(1, 's')}, 'c')",
            f"CASE WHEN {_LAST} IN ('l', 's', 'z') THEN {_cut(1)} ELSE {_cut(2)} END",
        ),
        (f"{_measure(1)} = 1 AND {_short(1)}", f"{_cut(1)} || 'e'"), ("true", _cut(1)),
    ),
    _case((f"{_ends('y')} AND length(w) > 2 AND suffix({_cut(1, 's')}, 'c')", f"{_cut(1)} || 'i'")),
    _case((f"{_ends('alli')} AND {_measure(4)} > 0", _cut(2))),
    _case(*_table(STEP2), (f"{_ends('logi')} AND {_measure(3)} > 0", _cut(1))),
    _case(*_table(STEP3)),
    _case(*[
        (_ends(x), f"CASE WHEN {_measure(len(x))} > 1{' AND ' + _ends('sion', 'tion') if x == 'ion' else ''} THEN {_cut(len(x))} ELSE w END") for x in STEP4
    ]),
    _case((f"{_ends('e')} AND ({_measure(1)} > 1 OR ({_measure(1)} = 1 AND NOT {_short(1)}))", _cut(1))),
    _case((f"{_ends('ll')} AND {_measure(1)} > 1", _cut(1))),
]


def stems(words: str) -> str:
    """CTE `stems` (word, stem) of the rows `word` of `words`."""
    out = [f"step0 AS (SELECT DISTINCT word, word AS w FROM {words} WHERE length(word) > 3)"]
    for k, step in enumerate(_STEPS, 1):
        out.append(f"step{k} AS (SELECT word, {step} AS w FROM (SELECT *, {_SHAPE} AS s FROM step{k - 1}))")
    fixed = " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in IRREGULAR.items())
    return ",\n".join([*out, f"stems AS (SELECT word, CASE word {fixed} ELSE w END AS stem FROM step{len(_STEPS)})"])


#: CTE `sents` (query_id, side, s, t): the stems of each sentence of system b's predictions (side p) and of references (r).
SENTENCES = f"""
sides AS (
  SELECT query_id, 'p' AS side, prediction AS text FROM preds WHERE system = 'b'
  UNION ALL SELECT query_id, 'r', reference FROM preds WHERE system = 'b'),
raw_lines AS (SELECT query_id, side, unnest(string_split({O.scoring_lines('text')}, chr(10))) AS line, generate_subscripts(string_split({O.scoring_lines('text')}, chr(10)), 1) AS s FROM sides),
raw_words AS (SELECT query_id, side, s, unnest({O.tokens('line')}) AS word, generate_subscripts({O.tokens('line')}, 1) AS i FROM raw_lines),
{stems('raw_words')},
sents AS (
  SELECT query_id, side, s, list(coalesce(stem, word) ORDER BY i) AS t FROM raw_words LEFT JOIN stems USING (word) GROUP BY ALL),
flat AS (SELECT query_id, side, flatten(list(t ORDER BY s)) AS t FROM sents GROUP BY ALL),
"""

#: CTE `lsum` (query_id, h): tokens of reference sentences on a longest common subsequence with any predicted sentence.
UNION_LCS = """
pairs AS (
  SELECT r.query_id, r.s AS a, p.s AS b, r.t AS rt, p.t AS pt FROM sents r JOIN sents p USING (query_id)
  WHERE r.side = 'r' AND p.side = 'p' AND list_has_any(r.t, p.t)),
-- The table of lengths, a row per token of the reference sentence.
tab(query_id, a, b, i, line) AS (
  SELECT query_id, a, b, 0, list_transform(range(len(pt) + 1), lambda x: 0) FROM pairs
  UNION ALL
  SELECT query_id, a, b, i, list_transform(range(1, len(v) + 1), lambda j: list_max(v[1:j])) FROM (
    SELECT query_id, a, b, i + 1 AS i, list_prepend(0, list_transform(range(1, len(pt) + 1), lambda j: CASE WHEN pt[j] = rt[i + 1] THEN line[j] + 1 ELSE line[j + 1] END)) AS v
    FROM tab JOIN pairs USING (query_id, a, b) WHERE i < len(rt))),
-- Back from its end: a match is taken, else a predicted token is skipped only for a longer match.
way(query_id, a, b, i, j, hit) AS (
  SELECT query_id, a, b, len(rt), len(pt), NULL::BIGINT FROM pairs
  UNION ALL
  SELECT query_id, a, b, CASE WHEN same OR NOT left_ THEN i - 1 ELSE i END, CASE WHEN same OR left_ THEN j - 1 ELSE j END, CASE WHEN same THEN i END
  FROM (
    SELECT w.query_id, w.a, w.b, w.i, w.j, rt[w.i] = pt[w.j] AS same, t.line[w.j] > u.line[w.j + 1] AS left_
    FROM way w JOIN pairs p ON w.query_id = p.query_id AND w.a = p.a AND w.b = p.b
      JOIN tab t ON w.query_id = t.query_id AND w.a = t.a AND w.b = t.b AND w.i = t.i
      JOIN tab u ON w.query_id = u.query_id AND w.a = u.a AND w.b = u.b AND w.i - 1 = u.i
    WHERE w.i > 0 AND w.j > 0)),
found AS (SELECT DISTINCT query_id, a, hit FROM way WHERE hit IS NOT NULL),
taken AS (SELECT f.query_id, s.t[hit] AS g, count(*) AS c FROM found f JOIN sents s ON f.query_id = s.query_id AND f.a = s.s AND s.side = 'r' GROUP BY ALL),
there AS (SELECT query_id, g, count(*) AS c FROM (SELECT query_id, unnest(t) AS g FROM flat WHERE side = 'p') GROUP BY ALL),
lsum AS (SELECT query_id, sum(least(taken.c, there.c)) AS h FROM taken JOIN there USING (query_id, g) GROUP BY ALL),
"""
