"""Windows, packing, prompts, recall and text functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from convolens import protocol
from convolens.functions import text as T
from convolens.operators import prompts, retrieval
from convolens.operators.windows import build_windows
from convolens.plans import oracle as O
from convolens.plans import views as V
from convolens.plans.catalogue import register

# Chat turns are short, so the chat queries use small budgets; documents use the protocol's.
CHUNK = 60
SPAN = 120


def _chat(spark, sf):
    return V.chat_utterances(spark, sf), V.chat_queries(spark, sf)


def _located(spark, sf, budgets=SPAN):
    utts, queries = _chat(spark, sf)
    return retrieval.locate(utts, queries, chunk_words=CHUNK, budgets=budgets)


WINDOW_COLUMNS = "SELECT meeting_id, win_idx, s AS \"start\", e AS \"end\", n_words, text FROM win"
PACK_COLUMNS = """
SELECT query_id, CAST(sum(n_words) AS INTEGER) AS used_words, count(*) AS n_picked,
       string_agg(CAST(s AS VARCHAR), ',' ORDER BY s) AS starts,
       string_agg(text, chr(10) ORDER BY s) AS text FROM picked GROUP BY query_id
"""


def _pack_columns(packed, *more):
    return packed.select(
        "query_id",
        "used_words",
        F.size("picks").cast("bigint").alias("n_picked"),
        F.array_join(F.transform("picks", lambda p: p["start"].cast("string")), ",").alias("starts"),
        F.array_join(F.transform("picks", lambda p: p["text"]), "\n").alias("text"),
        *more,
    )


@register("windows", O.with_ctes(O.CHAT_LINES, O.windows(CHUNK), select=WINDOW_COLUMNS))
def windows(spark, sf):
    return build_windows(V.chat_utterances(spark, sf), CHUNK)


@register("document_windows", O.with_ctes(O.DOC_LINES, O.windows(protocol.CHUNK_WORDS), select=WINDOW_COLUMNS))
def document_windows(spark, sf):
    return build_windows(V.document_meetings(spark, sf))


_CHAT_PACK = [O.CHAT_LINES, O.CHAT_QUERIES, O.windows(CHUNK), O.packed(SPAN, O.CHAT_LABEL.replace("turn", "queries.turn"))]


@register("pack", O.with_ctes(*_CHAT_PACK, select=PACK_COLUMNS))
def pack(spark, sf):
    return _pack_columns(_located(spark, sf))


@register(
    "document_pack",
    O.with_ctes(
        O.DOC_LINES, O.DOC_QUERIES, O.windows(protocol.CHUNK_WORDS), O.packed(protocol.SPAN_WORDS), select=PACK_COLUMNS
    ),
)
def document_pack(spark, sf):
    return _pack_columns(
        retrieval.locate(V.document_meetings(spark, sf), V.document_queries(spark, sf))
    )


@register(
    "locator_pairs",
    O.with_ctes(
        *_CHAT_PACK,
        select="SELECT query, text, label, query_id, s AS \"start\", e AS \"end\" FROM pairs "
        "WHERE query_id LIKE '%\\_s%' ESCAPE '\\'",
    ),
)
def locator_pairs(spark, sf):
    return retrieval.locator_pairs(retrieval.transcript_pairs(*_chat(spark, sf), CHUNK)[0])


@register(
    "window_ranking",
    O.with_ctes(*_CHAT_PACK, select="SELECT query_id, s AS \"start\", CAST(score AS DOUBLE) AS score, r AS rank FROM ranked"),
)
def window_ranking(spark, sf):
    pairs, hot = retrieval.transcript_pairs(*_chat(spark, sf), CHUNK)
    return retrieval.rank_windows(retrieval.lexical_scorer(pairs), hot).select("query_id", "start", "score", "rank")


_PACKED_TEXT = "string_agg(text, chr(10) ORDER BY s)"


@register(
    "located_prompt",
    O.with_ctes(
        *_CHAT_PACK,
        f"joined AS (SELECT query_id, any_value(query) AS query, {_PACKED_TEXT} AS t FROM picked GROUP BY 1)",
        select=f"SELECT query_id, {O.prompt('query', O.truncate('t', SPAN))} AS prompt FROM joined",
    ),
)
def located_prompt(spark, sf):
    return retrieval.packed_prompts(_located(spark, sf))


_WHOLE = "whole AS (SELECT meeting_id, string_agg(line, chr(10) ORDER BY utt_idx) AS t FROM lines GROUP BY 1)"


@register(
    "zero_shot_prompt",
    O.with_ctes(
        O.CHAT_LINES,
        O.CHAT_QUERIES,
        _WHOLE,
        select=f"SELECT query_id, {O.prompt('query', O.truncate('t', SPAN))} AS prompt FROM queries JOIN whole USING (meeting_id)",
    ),
)
def zero_shot_prompt(spark, sf):
    return prompts.zero_shot_prompts(*_chat(spark, sf), SPAN)


@register(
    "hosted_prompt",
    O.with_ctes(
        O.DOC_LINES,
        O.DOC_QUERIES,
        _WHOLE,
        select=f"SELECT query_id, {O.prompt('query', O.truncate('t', protocol.HOSTED_PROMPT_WORDS))} AS prompt "
        "FROM queries JOIN whole USING (meeting_id)",
    ),
)
def hosted_prompt(spark, sf):
    return prompts.hosted_prompts(V.document_meetings(spark, sf), V.document_queries(spark, sf))


@register(
    "seq2seq_input",
    O.with_ctes(
        O.CHAT_LINES,
        O.CHAT_QUERIES,
        _WHOLE,
        select=f"SELECT query_id, query || ' </s> ' || {O.truncate('t', SPAN)} AS input FROM queries JOIN whole USING (meeting_id)",
    ),
)
def seq2seq_input(spark, sf):
    return prompts.seq2seq_inputs(*_chat(spark, sf), SPAN)


_GOT = """
hits AS (SELECT query_id, count(*) AS n_picked, sum(label) AS got FROM picked GROUP BY 1),
golds AS (SELECT query_id, sum(label) AS n_gold FROM pairs GROUP BY 1),
recalls AS (SELECT query_id, got / n_gold AS recall, CAST(n_gold AS BIGINT) AS n_gold, n_picked
            FROM hits JOIN golds USING (query_id) WHERE n_gold > 0)
"""


@register(
    "recall_windows",
    O.with_ctes(*_CHAT_PACK, _GOT, select="SELECT query_id, recall, n_gold, n_picked FROM recalls"),
)
def recall_windows(spark, sf):
    return retrieval.window_recall(_located(spark, sf)).drop("budget")


@register(
    "recall_skips",
    O.with_ctes(
        *_CHAT_PACK,
        _GOT,
        select="""SELECT CAST(count_if(query_id LIKE '%\\_g%' ESCAPE '\\') AS BIGINT) AS skipped_general,
          CAST(count_if(query_id LIKE '%\\_s%' ESCAPE '\\' AND recall IS NULL) AS BIGINT) AS skipped_no_gold_window,
          count(recall) AS n_scored, round(avg(recall), 6) AS mean_recall
          FROM queries LEFT JOIN recalls USING (query_id)""",
    ),
)
def recall_skips(spark, sf):
    out = retrieval.recall_skips(_located(spark, sf)).drop("budget")
    return out.withColumn("mean_recall", F.round("mean_recall", 6))


_LINE_RECALL = """
got_lines AS (SELECT DISTINCT query_id, unnest(generate_series(s, e)) AS line_no FROM picked),
line_recalls AS (SELECT g.query_id, count(l.line_no) / count(*) AS recall, count(*) AS n_gold_lines
   FROM gold g LEFT JOIN got_lines l ON l.query_id = g.query_id AND l.line_no = g.line_no GROUP BY 1)
"""


@register(
    "recall_utterances",
    O.with_ctes(
        *_CHAT_PACK, O.CHAT_GOLD, _LINE_RECALL, select="SELECT query_id, recall, n_gold_lines FROM line_recalls"
    ),
)
def recall_utterances(spark, sf):
    return retrieval.utterance_recall(_located(spark, sf)).drop("budget")


SWEEP = {"base": 60, "fine": 25}
SWEEP_BUDGETS = (80, 120)


def _sweep_sql() -> str:
    parts = []
    for name, chunk in SWEEP.items():
        for budget in SWEEP_BUDGETS:
            body = O.with_ctes(
                O.CHAT_LINES,
                O.CHAT_QUERIES,
                O.windows(chunk),
                O.packed(budget, O.CHAT_LABEL.replace("turn", "queries.turn")),
                _GOT,
                O.CHAT_GOLD,
                _LINE_RECALL,
                select=f"""SELECT '{name}' AS variant, {chunk} AS chunk_words, {budget} AS budget,
                  (SELECT avg(recall) FROM recalls) AS window_recall,
                  (SELECT avg(recall) FROM line_recalls) AS utterance_recall""",
            )
            parts.append(f"SELECT * FROM ({body})")
    rows = " UNION ALL ".join(parts)
    return f"""WITH s AS ({rows}) SELECT s.variant, s.chunk_words, s.budget,
      round(s.window_recall, 6) AS window_recall, round(s.utterance_recall, 6) AS utterance_recall,
      round(s.utterance_recall - b.utterance_recall, 6) + 0.0 AS gain
      FROM s JOIN s b ON b.variant = 'base' AND b.budget = s.budget"""


@register("locator_sweep", _sweep_sql())
def locator_sweep(spark, sf):
    variants = {name: (chunk, retrieval.lexical_scorer) for name, chunk in SWEEP.items()}
    out = retrieval.locator_sweep(*_chat(spark, sf), variants, SWEEP_BUDGETS)
    return out.select(
        "variant",
        "chunk_words",
        "budget",
        *[F.round(c, 6).alias(c) for c in ("window_recall", "utterance_recall", "gain")],
    )


_VEC = """
vec AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v, (SELECT count(*) FROM embeddings) AS n_vec FROM embeddings)
"""
_COSINE = """CASE WHEN list_dot_product(wv.v, wv.v) > 0 AND list_dot_product(qv.v, qv.v) > 0
       THEN list_dot_product(wv.v, qv.v) / sqrt(list_dot_product(qv.v, qv.v) * list_dot_product(wv.v, wv.v)) ELSE 0 END"""
_VEC_JOINS = """
       JOIN vec wv ON wv.vec_id = (CAST(meeting_id AS BIGINT) * 31 + s) % wv.n_vec
       JOIN vec qv ON qv.vec_id = (CAST(meeting_id AS BIGINT) * 17 + queries.turn) % qv.n_vec"""


@register(
    "embedding_pack",
    O.with_ctes(
        O.CHAT_LINES,
        O.CHAT_QUERIES,
        _VEC,
        O.windows(CHUNK),
        O.packed(SPAN, O.CHAT_LABEL.replace("turn", "queries.turn"), _COSINE, _VEC_JOINS),
        select="""SELECT query_id, CAST(sum(n_words) AS INTEGER) AS used_words, count(*) AS n_picked,
          string_agg(CAST(s AS VARCHAR), ',' ORDER BY s) AS starts, string_agg(text, chr(10) ORDER BY s) AS text,
          round(max(score), 6) + 0.0 AS best_score FROM picked GROUP BY query_id""",
    ),
)
def embedding_pack(spark, sf):
    """Every line, as a window's start, and every query gets a stored vector; windows are ranked by cosine and packed."""
    utterances, queries = _chat(spark, sf)
    stored = V.table(spark, sf, "embeddings")
    n = F.broadcast(stored.agg(F.count(F.lit(1)).alias("n_vec")))  # one row
    meeting = F.col("meeting_id").cast("bigint")

    def placed(rows, keys, number):
        at = rows.select(*keys, number.alias("number")).crossJoin(n).withColumn("vec_id", F.col("number") % F.col("n_vec"))
        return at.join(stored, "vec_id").select(*keys, F.col("embedding").alias("vector"))

    lines = placed(utterances.withColumnRenamed("utt_idx", "start"), ["meeting_id", "start"], meeting * 31 + F.col("start"))
    turn = F.regexp_extract("query_id", "([0-9]+)$", 1).cast("bigint")
    asked = placed(queries, ["query_id"], meeting * 17 + turn)
    packed = retrieval.locate(
        utterances, queries, retrieval.embedding_scorer, chunk_words=CHUNK, budgets=SPAN, vectors=(lines, asked)
    )
    best = F.round(F.array_max(F.transform("picks", lambda p: p["score"])), 6) + F.lit(0.0)
    return _pack_columns(packed, best.alias("best_score"))


@register(
    "embedding_ranking",
    """
WITH q AS (SELECT label, min(vec_id) AS query_id FROM embeddings GROUP BY label),
s AS (SELECT q.query_id, v.vec_id, list_dot_product(CAST(a.embedding AS DOUBLE[]), CAST(v.embedding AS DOUBLE[]))
        / sqrt(list_dot_product(CAST(a.embedding AS DOUBLE[]), CAST(a.embedding AS DOUBLE[]))
               * list_dot_product(CAST(v.embedding AS DOUBLE[]), CAST(v.embedding AS DOUBLE[]))) AS score
      FROM q JOIN embeddings a ON a.vec_id = q.query_id JOIN embeddings v ON v.label = q.label AND v.vec_id <> q.query_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id DESC) AS rank FROM s)
SELECT query_id, vec_id, CAST(rank AS INTEGER) AS rank, round(score, 6) AS score FROM r WHERE rank <= 10
""",
)
def embedding_ranking(spark, sf):
    vectors = V.table(spark, sf, "embeddings").withColumnRenamed("embedding", "vector")
    queries = vectors.groupBy("label").agg(F.min_by("vector", "vec_id").alias("vector"), F.min("vec_id").alias("query_id"))
    top = retrieval.top_vectors(queries, vectors, "label", 10)
    return top.withColumn("score", F.round("score", 6))


# --- text functions over whole documents -------------------------------------------------------


@register(
    "sentence_split",
    f"""SELECT doc_id, len({O.sentences('text')}) AS n_trimmed, len({O.sentences('text', False)}) AS n_plain,
        md5(array_to_string({O.sentences('text')}, '|')) AS trimmed, md5({O.scoring_lines('text')}) AS scoring
        FROM documents""",
)
def sentence_split(spark, sf):
    text = F.col("text")
    return V.table(spark, sf, "documents").select(
        "doc_id",
        F.size(T.sentences(text)).cast("bigint").alias("n_trimmed"),
        F.size(T.sentences(text, trim_parts=False)).cast("bigint").alias("n_plain"),
        F.md5(F.array_join(T.sentences(text), "|")).alias("trimmed"),
        F.md5(T.scoring_lines(text)).alias("scoring"),
    )


@register(
    "word_tokens",
    f"""SELECT doc_id, len({O.words('text')}) AS n_words, len({O.tokens('text')}) AS n_tokens,
        len({O.uwords('text')}) AS n_unicode_words, md5({O.truncate('text', 100)}) AS truncated,
        length(text) / 4.0 + 512 AS estimated_tokens FROM documents""",
)
def word_tokens(spark, sf):
    text = F.col("text")
    return V.table(spark, sf, "documents").select(
        "doc_id",
        T.word_count(text).cast("bigint").alias("n_words"),
        F.size(T.alnum_tokens(text)).cast("bigint").alias("n_tokens"),
        F.size(T.unicode_words(text)).cast("bigint").alias("n_unicode_words"),
        F.md5(T.truncate_words(text, 100)).alias("truncated"),
        T.estimate_tokens(text).alias("estimated_tokens"),
    )


@register(
    "repeat_4gram",
    f"""
WITH w AS (SELECT doc_id, {O.uwords('text')} AS w FROM documents),
g AS (SELECT doc_id, w, list_zip(w, w[2:], w[3:], w[4:], true) AS g FROM w)
SELECT doc_id, CASE WHEN len(w) < 4 THEN 0.0 ELSE (len(g) - len(list_distinct(g))) / len(g) END AS repeat_4gram,
       CASE WHEN len(w) = 0 THEN 0.0 ELSE len(list_distinct(w)) / len(w) END AS type_token_ratio FROM g
""",
)
def repeat_4gram(spark, sf):
    text = F.col("text")
    return V.table(spark, sf, "documents").select(
        "doc_id", T.self_repeat(text).alias("repeat_4gram"), T.type_token_ratio(text).alias("type_token_ratio")
    )
