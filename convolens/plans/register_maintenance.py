"""Run names, request settings, stored rows, chunks and probes."""

from __future__ import annotations

from pyspark.sql import functions as F

from convolens.functions import text as T
from convolens.operators import chunks, costs, maintenance
from convolens.plans import oracle as O
from convolens.plans import views as V
from convolens.plans.catalogue import register
from convolens.plans.register_scoring import RUNS
from convolens.sources import readers, writers

_MODEL = "m AS (SELECT DISTINCT event_id, model, CASE WHEN event_id % 3 = 0 THEN 'low' ELSE 'off' END AS thinking, "
_NAMES = _MODEL + """CASE event_id % 4 WHEN 0 THEN NULL WHEN 1 THEN 40000 ELSE 14000 END AS budget
  FROM (SELECT query_id AS event_id, model FROM runs))"""


def _named(spark, sf):
    i = F.col("query_id")
    return V.event_runs(spark, sf).select(
        i,
        "model",
        F.when(i % 3 == 0, "low").otherwise("off").alias("thinking"),
        F.when(i % 4 == 1, 40000).when(i % 4 != 0, 14000).alias("budget"),
    )


@register(
    "run_names",
    O.with_ctes(
        RUNS,
        _NAMES,
        select="""SELECT event_id AS query_id,
          model || CASE WHEN budget = 14000 THEN '-w14000' ELSE '' END || CASE WHEN thinking = 'low' THEN '-thinklow' ELSE '' END AS run_tag,
          model || '__judge-gpt-5.6-sol' || CASE WHEN budget IS NULL THEN '' ELSE '__n' || budget END AS facts_tag,
          'x__judge-' || model || CASE WHEN thinking = 'low' THEN '__grounded' ELSE '' END AS judge_tag,
          CASE WHEN model LIKE 'gpt%' THEN 'openai' WHEN model LIKE 'claude%' THEN 'anthropic' ELSE 'google' END AS vendor FROM m""",
    ),
)
def run_names(spark, sf):
    mode = F.when(F.col("thinking") == "low", "grounded").otherwise("preference")
    return _named(spark, sf).select(
        "query_id",
        costs.run_tag(F.col("model"), F.col("budget"), F.col("thinking")).alias("run_tag"),
        costs.facts_tag(F.col("model"), F.lit("gpt-5.6-sol"), F.col("budget")).alias("facts_tag"),
        costs.judge_tag(F.lit("x"), F.col("model"), mode).alias("judge_tag"),
        costs.vendor_of(F.upper("model")).alias("vendor"),
    )


@register(
    "request_settings",
    O.with_ctes(
        RUNS,
        _NAMES,
        select="""SELECT event_id AS query_id,
          CASE WHEN thinking = 'off' THEN '512' ELSE '4096' END AS max_tokens,
          CASE WHEN model IN ('gpt-5.6-sol', 'gpt-5.6-luna', 'claude-opus-5') THEN NULL ELSE '0.0' END AS temperature,
          CASE WHEN model IN ('gpt-5.6-sol', 'gpt-5.6-luna') THEN CASE WHEN thinking = 'off' THEN 'none' ELSE thinking END END AS effort,
          CASE WHEN model = 'claude-opus-5' THEN CASE WHEN thinking = 'off' THEN 'disabled' ELSE 'adaptive' END END AS thinking_mode
          FROM m""",
    ),
)
def request_settings(spark, sf):
    chat = costs.request_settings(F.col("model"), F.col("thinking"))
    message = costs.messages_settings(F.col("model"), F.col("thinking"))
    rows = _named(spark, sf).withColumn("c", chat).withColumn("m", message)
    return rows.select(
        "query_id",
        F.col("c")["max_completion_tokens"].alias("max_tokens"),
        F.col("c")["temperature"].alias("temperature"),
        F.col("c")["reasoning_effort"].alias("effort"),
        F.col("m")["thinking"].alias("thinking_mode"),
    )


@register(
    "leak_scan",
    "SELECT page_id FROM pages WHERE regexp_matches(html, '(?i)</?(thinking|antml|internal|scratchpad)\\b')"
    " OR regexp_matches(replace(html, '<p', '<internal'), '(?i)</?(thinking|antml|internal|scratchpad)\\b')",
)
def leak_scan(spark, sf):
    html = F.col("html")
    opened = F.replace(html, F.lit("<p"), F.lit("<internal"))
    return V.table(spark, sf, "pages").where(T.has_leaked_tag(html) | T.has_leaked_tag(opened)).select("page_id")


_ROWS = """
per AS (SELECT 'run-' || user_id AS run_id, CASE WHEN user_id % 2 = 0 THEN 'test' ELSE 'val' END AS split, count(*) AS n,
  count(*) FILTER (event_type = 'click') / count(*) AS rouge1, count(*) FILTER (event_type = 'view') / count(*) AS rouge2,
  count(*) FILTER (event_type = 'error') / count(*) AS rougeL, count(*) FILTER (event_type = 'signup') / count(*) AS rougeLsum,
  CASE WHEN user_id % 3 = 0 THEN NULL ELSE max(value) / 1000 END AS bertscore_f1,
  CASE WHEN user_id % 4 = 0 THEN NULL ELSE CAST(count(*) AS DOUBLE) END AS cost_usd_total, user_id FROM events GROUP BY user_id)
"""


def _score_rows(spark, sf):
    e = V.table(spark, sf, "events")
    share = lambda t: F.count_if(F.col("event_type") == t) / F.count(F.lit(1))
    u = F.col("user_id")
    return (
        e.groupBy("user_id")
        .agg(
            F.count(F.lit(1)).alias("n"),
            share("click").alias("rouge1"),
            share("view").alias("rouge2"),
            share("error").alias("rougeL"),
            share("signup").alias("rougeLsum"),
            F.max("value").alias("top"),
        )
        .select(
            F.concat(F.lit("run-"), u.cast("string")).alias("run_id"),
            F.when(u % 2 == 0, "test").otherwise("val").alias("split"),
            "n",
            "rouge1",
            "rouge2",
            "rougeL",
            "rougeLsum",
            F.when(u % 3 != 0, F.col("top") / 1000).alias("bertscore_f1"),
            F.when(u % 4 != 0, F.col("n").cast("double")).alias("cost_usd_total"),
            F.lit(None).cast("double").alias("latency_s_mean"),
            F.lit(None).cast("double").alias("peak_vram_gb_max"),
            "user_id",
        )
    )


@register(
    "chart_rows",
    O.with_ctes(
        _ROWS,
        select="""SELECT run_id, split, CAST(n AS VARCHAR) AS n, printf('%.3f', rouge1) AS rouge1, printf('%.3f', rouge2) AS rouge2,
          printf('%.3f', rougeLsum) AS rougeLsum, coalesce(printf('%.3f', bertscore_f1), '') AS bertscore_f1,
          coalesce(printf('%.2f', cost_usd_total), '') AS cost_usd, '' AS s_per_query, '' AS peak_gb FROM per""",
    ),
)
def chart_rows(spark, sf):
    return writers.chart_rows(_score_rows(spark, sf))


@register(
    "cost_backfill",
    O.with_ctes(
        _ROWS,
        select="""SELECT run_id, CASE WHEN cost_usd_total IS NOT NULL OR run_id IN ('run-4', 'run-8') THEN cost_usd_total
          WHEN user_id % 8 = 0 THEN 2.5 ELSE 0.0 END AS cost_usd_total FROM per""",
    ),
)
def cost_backfill(spark, sf):
    rows = _score_rows(spark, sf)
    known = rows.where(F.col("user_id") % 8 == 0).select("run_id", F.lit(2.5).alias("cost"))
    return costs.backfill_costs(rows, known, ["run-4", "run-8"]).select("run_id", "cost_usd_total")


def _moved(rows):
    """The same rows computed again: every fifth lost, every seventh drifted."""
    u = F.col("user_id")
    return (
        rows.where(u % 5 != 0)
        .withColumn("rouge1", F.col("rouge1") + F.when(u % 7 == 0, 0.01).otherwise(0.0))
        .withColumn("rougeLsum", F.col("rougeLsum") + 0.125)
    )


@register(
    "rescored_rows",
    O.with_ctes(
        _ROWS,
        select="""SELECT run_id, CASE WHEN user_id % 5 = 0 THEN 'no predictions' WHEN user_id % 7 = 0 THEN 'drifted' ELSE 'ok' END AS status,
          CASE WHEN user_id % 5 <> 0 THEN round(rougeLsum + 0.125 - rougeLsum, 6) + 0.0 END AS delta FROM per""",
    ),
)
def rescored_rows(spark, sf):
    rows = _score_rows(spark, sf)
    return maintenance.rescored_rows(rows, _moved(rows), strict=False).select("run_id", "status", F.round("delta", 6).alias("delta"))


@register(
    "model_score_backfill",
    O.with_ctes(
        _ROWS,
        select="""SELECT run_id, CASE WHEN user_id % 5 = 0 THEN 'no predictions' WHEN user_id % 7 = 0 THEN 'drifted'
          WHEN bertscore_f1 IS NULL THEN 'backfilled' ELSE 'control ok' END AS status,
          round(coalesce(bertscore_f1, CASE WHEN user_id % 5 <> 0 THEN rouge2 END), 6) AS bertscore_f1 FROM per""",
    ),
)
def model_score_backfill(spark, sf):
    rows = _score_rows(spark, sf)
    new = _moved(rows).withColumn("rougeLsum", F.col("rougeLsum") - 0.125)
    new = new.withColumn("bertscore_f1", F.coalesce("bertscore_f1", "rouge2"))
    out = maintenance.backfilled_model_score(rows, new, strict=False)
    return out.withColumn("bertscore_f1", F.round("bertscore_f1", 6))


@register("longest_rows", "SELECT doc_id, n_chars FROM documents ORDER BY n_chars DESC, doc_id LIMIT 25")
def longest_rows(spark, sf):
    return maintenance.longest_rows(V.table(spark, sf, "documents").select("doc_id", "n_chars"), "n_chars", 25, "doc_id")


@register(
    "length_spread",
    """WITH r AS (SELECT doc_id, n_chars, row_number() OVER (ORDER BY n_chars, doc_id) - 1 AS rank, count(*) OVER () AS n FROM documents)
    SELECT doc_id, n_chars, rank FROM r WHERE rank IN (SELECT CAST(round_even(k.range * ((n - 1) / 11.0), 0) AS BIGINT) FROM range(12) k)""",
)
def length_spread(spark, sf):
    rows = V.table(spark, sf, "documents").select("doc_id", "n_chars")
    return maintenance.length_spread_sample(rows, "n_chars", "doc_id", 12)


# Word lengths stand in for token ids.
SIZE, MOST = 512, 32
_IDS = f"""
ids AS (SELECT doc_id, list_transform({O.words('text')}, lambda w: CAST(len(w) AS INTEGER)) AS t, (doc_id % 7) + 1 AS np FROM documents),
w AS (SELECT doc_id, np, {SIZE} - np AS width, t[1:{MOST} * ({SIZE} - np)] AS t FROM ids),
-- Both passes as (pass, first token, number of chunks).
p AS (SELECT doc_id, np, width, t, 0 AS pass, {MOST} AS k FROM w
  UNION ALL SELECT doc_id, np, width, t[width // 2 + 1:width // 2 + {MOST - 1} * width], 1, {MOST - 1} FROM w)
"""


@register(
    "chunk_tokens",
    O.with_ctes(
        _IDS,
        f"""c AS (SELECT doc_id, pass, range AS k, np, width, t[range * width + 1:range * width + width] AS part FROM p, range({MOST}) WHERE range < k),
        f AS (SELECT doc_id, pass, k, array_to_string(list_concat(list_concat(list_resize(CAST([] AS INTEGER[]), np, 9), part),
             list_resize(CAST([] AS INTEGER[]), width - len(part), 1)), ' ') AS ids, np + len(part) AS ones FROM c)""",
        select="""SELECT doc_id, count(*) AS n_chunks, CAST(sum(ones) AS BIGINT) AS mask_total,
          md5(string_agg(ids, '|' ORDER BY pass, k)) AS ids FROM f GROUP BY 1""",
    ),
)
def chunk_tokens(spark, sf):
    docs = V.table(spark, sf, "documents").select(
        "doc_id",
        F.array_repeat(F.lit(9), (F.col("doc_id") % 7 + 1).cast("int")).alias("prefix"),
        F.transform(T.words(F.col("text")), F.length).alias("tokens"),
    )
    rows = docs.select("doc_id", chunks.chunk_tokens(F.col("prefix"), F.col("tokens"), SIZE, MOST).alias("c"))
    # Written as one text, [[9,2],[9,1]], which takes a quarter of the time of a step for each number.
    shown = F.replace(F.replace(F.to_json("c.ids"), F.lit("],["), F.lit("|")), F.lit(","), F.lit(" "))
    shown = F.trim(shown, F.lit("[]"))
    ones = F.size(F.array_remove(F.flatten("c.mask"), 0))
    return rows.select(
        "doc_id", F.size("c").cast("bigint").alias("n_chunks"), ones.cast("bigint").alias("mask_total"), F.md5(shown).alias("ids")
    )


@register(
    "padded_batches",
    f"""WITH e AS (SELECT doc_id, doc_id // 16 AS batch, CAST(least(len({O.words('text')}) + 5, {SIZE * MOST}) AS BIGINT) AS n,
        5 AS np FROM documents),
    m AS (SELECT batch, max(n) AS top FROM e GROUP BY 1)
    SELECT doc_id, top AS width, n AS ones, top - n + np AS ignored FROM e JOIN m USING (batch)""",
)
def padded_batches(spark, sf):
    docs = V.table(spark, sf, "documents").select(
        "doc_id",
        F.floor(F.col("doc_id") / 16).alias("batch"),
        chunks.masked_example(
            F.array_repeat(F.lit(7), 5), F.transform(T.words(F.col("text")), F.length), SIZE * MOST
        ).alias("e"),
    )
    rows = chunks.padded_batches(docs.select("doc_id", "batch", "e.*"), ["batch"], 0)
    count = lambda c, v: F.size(F.filter(c, lambda x: x == v)).cast("bigint")
    return rows.select(
        "doc_id",
        F.size("input_ids").cast("bigint").alias("width"),
        count("attention_mask", 1).alias("ones"),
        count("labels", chunks.IGNORED).alias("ignored"),
    )


@register(
    "clock",
    """SELECT event_id, printf('%02dh %02dm %02ds', CAST(floor(value * 100) AS BIGINT) // 3600 % 24,
      CAST(floor(value * 100) AS BIGINT) % 3600 // 60, CAST(floor(value * 100) AS BIGINT) % 60) AS shown FROM events""",
)
def clock(spark, sf):
    return V.table(spark, sf, "events").select("event_id", T.clock(F.col("value") * 100).alias("shown"))


@register(
    "merged_reports",
    """SELECT doc_id, quality, toxic FROM labels""",
)
def merged_reports(spark, sf):
    old = F.create_map(F.lit("quality"), F.lit(-1), F.lit("toxic"), F.col("toxic"))
    new = F.create_map(F.lit("quality"), F.col("quality"))
    rows = V.table(spark, sf, "labels").select("doc_id", writers.merge_reports(old, new).alias("m"))
    return rows.select("doc_id", F.col("m")["quality"].alias("quality"), F.col("m")["toxic"].alias("toxic"))


# --- the raw form, built row by row from documents ----------------------------------------------


def _raw(spark, sf):
    parts = F.split("text", "\n")
    span = F.array(F.array(F.lit("0"), F.lit("1")), F.array(F.lit("3"), F.lit("3")))
    return V.table(spark, sf, "documents").select(
        F.concat(F.lit("val_"), F.col("doc_id").cast("string")).alias("meeting_id"),
        F.lit("val").alias("split"),
        F.transform(parts, lambda x: F.struct(F.col("source").alias("speaker"), x.alias("content"))).alias("meeting_transcripts"),
        F.array(F.struct(parts[0].alias("query"), F.element_at(parts, -1).alias("answer"))).alias("general_query_list"),
        F.transform(
            parts,
            lambda x: F.struct(x.alias("query"), F.concat(F.lit("re: "), x).alias("answer"), F.when(F.length(x) % 2 == 0, span).alias("relevant_text_span")),
        ).alias("specific_query_list"),
    )


@register(
    "normalize_utterances",
    O.with_ctes(
        O.DOC_LINES, select="SELECT 'val_' || meeting_id AS meeting_id, utt_idx, line FROM lines"
    ),
)
def normalize_utterances(spark, sf):
    rows = readers.normalize_utterances(_raw(spark, sf))
    return rows.select("meeting_id", "utt_idx", T.speaker_line(F.col("speaker"), F.col("text")).alias("line"))


@register(
    "normalize_queries",
    O.with_ctes(
        O.DOC_LINES,
        """k AS (SELECT doc_id, text, utt_idx FROM doc_parts)""",
        select="""SELECT 'val_' || doc_id || '_g0' AS query_id, 'general' AS query_type, parts[1] AS query, parts[-1] AS reference,
            '' AS spans FROM split_docs
          UNION ALL SELECT 'val_' || doc_id || '_s' || utt_idx, 'specific', text, 're: ' || text,
            CASE WHEN length(text) % 2 = 0 THEN '0-1,3-3' ELSE '' END FROM k""",
    ),
)
def normalize_queries(spark, sf):
    shown = F.array_join(F.transform("gold_spans", lambda g: F.concat_ws("-", g["s"].cast("string"), g["e"].cast("string"))), ",")
    return readers.normalize_queries(_raw(spark, sf)).select("query_id", "query_type", "query", "reference", shown.alias("spans"))


@register(
    "transcript_render",
    O.with_ctes(
        O.DOC_LINES,
        select="SELECT meeting_id, md5(string_agg(line, chr(10) ORDER BY utt_idx)) AS rendered FROM lines GROUP BY 1",
    ),
)
def transcript_render(spark, sf):
    rows = _raw(spark, sf).select(
        F.substring("meeting_id", 5, 100).alias("meeting_id"),
        F.transform("meeting_transcripts", lambda u: F.struct(u["speaker"].alias("speaker"), u["content"].alias("text"))).alias("u"),
    )
    return rows.select("meeting_id", F.md5(T.format_transcript(F.col("u"))).alias("rendered"))


_PAYLOAD = """
p AS (SELECT event_id, event_type, event_id % 4 AS r, CAST(props->>'k' AS BIGINT) AS k FROM events)
"""


@register(
    "batch_results",
    O.with_ctes(
        _PAYLOAD,
        select="""SELECT CAST(event_id AS VARCHAR) AS query_id, CASE WHEN r < 2 THEN 'ok' WHEN r = 2 THEN '429' ELSE 'expired' END AS outcome,
          CASE WHEN r < 2 THEN 'answer ' || event_type END AS prediction, CASE WHEN r < 2 THEN k END AS prompt_tokens,
          CASE WHEN r < 2 THEN k * 2 END AS completion_tokens, CASE WHEN r = 0 THEN k END AS reasoning_tokens FROM p""",
    ),
)
def batch_results(spark, sf):
    e = V.table(spark, sf, "events").select(
        F.col("event_id").cast("string").alias("id"),
        (F.col("event_id") % 4).alias("r"),
        "event_type",
        F.get_json_object("props", "$.k").cast("bigint").alias("k"),
    )
    body = F.struct(
        F.lit("m").alias("model"),
        F.array(
            F.struct(
                F.struct(F.concat(F.lit("answer "), "event_type").alias("content")).alias("message"),
                F.lit("stop").alias("finish_reason"),
            )
        ).alias("choices"),
        F.struct(
            F.col("k").alias("prompt_tokens"),
            (F.col("k") * 2).alias("completion_tokens"),
            F.when(F.col("r") == 0, F.struct(F.col("k").alias("reasoning_tokens"))).alias("completion_tokens_details"),
        ).alias("usage"),
    )
    lines = e.select(
        F.to_json(
            F.struct(
                F.col("id").alias("custom_id"),
                F.struct(F.when(F.col("r") == 2, 429).otherwise(200).alias("status_code"), body.alias("body")).alias("response"),
                F.when(F.col("r") == 3, "expired").alias("error"),
            )
        ).alias("value")
    )
    good, bad = costs.batch_results(lines)
    kept = costs.cache_entries(good, "batch", 40000).select(
        "query_id", F.lit("ok").alias("outcome"), "prediction", "prompt_tokens", "completion_tokens", "reasoning_tokens"
    )
    lost = bad.select("query_id", F.col("error").alias("outcome"))
    return kept.unionByName(lost, allowMissingColumns=True)


@register(
    "message_entries",
    O.with_ctes(
        _PAYLOAD,
        select="""SELECT CAST(event_id AS VARCHAR) AS query_id, event_type || '!' AS prediction, k AS prompt_tokens, k * 2 AS completion_tokens FROM p""",
    ),
)
def message_entries(spark, sf):
    k = F.get_json_object("props", "$.k").cast("bigint")
    block = lambda kind, text: F.struct(F.lit(kind).alias("type"), text.alias("text"))
    body = F.struct(
        F.lit("m").alias("model"),
        F.array(block("thinking", F.lit("hm")), block("text", F.col("event_type")), block("text", F.lit("!"))).alias("content"),
        F.struct(k.alias("input_tokens"), (k * 2).alias("output_tokens")).alias("usage"),
    )
    rows = V.table(spark, sf, "events").select(F.col("event_id").cast("string").alias("query_id"), F.to_json(body).alias("body"))
    return costs.message_entries(rows, "sync", 40000).select("query_id", "prediction", "prompt_tokens", "completion_tokens")


@register(
    "content_hashes",
    "SELECT page_id, sha256(replace(html, chr(13) || chr(10), chr(10))) AS sha256 FROM pages",
)
def content_hashes(spark, sf):
    return V.table(spark, sf, "pages").select("page_id", readers.text_hash(F.col("html")).alias("sha256"))
