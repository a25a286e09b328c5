"""Spark DDL of the data model. Transcripts live in long form: one row per utterance."""

UTTERANCES = "meeting_id STRING, utt_idx INT, speaker STRING, text STRING"
MEETINGS = "meeting_id STRING, utterances ARRAY<STRUCT<speaker: STRING, text: STRING>>"
GOLD_SPANS = "ARRAY<STRUCT<s: INT, e: INT>>"
QUERIES = (
    "query_id STRING, meeting_id STRING, split STRING, query_type STRING, query STRING, "
    f"reference STRING, gold_spans {GOLD_SPANS}"
)
QUERIES_JSON = QUERIES.replace(GOLD_SPANS, "ARRAY<ARRAY<INT>>")
RAW_MEETING = (
    "meeting_transcripts ARRAY<STRUCT<speaker: STRING, content: STRING>>, "
    "general_query_list ARRAY<STRUCT<query: STRING, answer: STRING>>, "
    "specific_query_list ARRAY<STRUCT<query: STRING, answer: STRING, "
    "relevant_text_span: ARRAY<ARRAY<STRING>>>>"
)
PREDICTIONS = (
    "query_id STRING, prediction STRING, cost_usd DOUBLE, latency_s DOUBLE, locate_s DOUBLE, "
    "generate_s DOUBLE, prompt_tokens BIGINT, completion_tokens BIGINT, thoughts_tokens BIGINT, "
    "new_tokens BIGINT, warmup BOOLEAN, mode STRING, device STRING, model_snapshot STRING, "
    "called_at STRING, peak_vram_gb DOUBLE, peak_vram_reserved_gb DOUBLE"
)
SCORE_ROWS = (
    "run_id STRING, split STRING, n BIGINT, rouge1 DOUBLE, rouge2 DOUBLE, rougeL DOUBLE, "
    "rougeLsum DOUBLE, bertscore_f1 DOUBLE, cost_usd_total DOUBLE, latency_s_mean DOUBLE, "
    "locate_s_mean DOUBLE, generate_s_mean DOUBLE, latency_n_timed BIGINT, peak_vram_gb_max DOUBLE, "
    "peak_vram_gb_median DOUBLE, peak_vram_gb_p95 DOUBLE, peak_vram_reserved_gb_max DOUBLE, "
    "device STRING, billing_mode STRING, notes STRING"
)
RUN_REF = "STRUCT<run_id: STRING, preds: STRING, sha256: STRING>"
INTERVALS = (
    "record_version INT, generated STRING, label STRING, metric STRING, split STRING, "
    f"resampling_unit STRING, draws INT, seed BIGINT, a {RUN_REF}, b {RUN_REF}, n_shared BIGINT, "
    "n_clusters BIGINT, a_mean DOUBLE, b_mean DOUBLE, observed_diff DOUBLE, ci95_low DOUBLE, "
    "ci95_high DOUBLE, p_b_better DOUBLE, per_query_b_wins BIGINT, per_query_a_wins BIGINT, "
    "per_query_ties BIGINT, median_abs_per_query_diff DOUBLE, crosses_zero BOOLEAN"
)
MARKING = (
    "covered_fact_numbers ARRAY<STRING>, summary_claims ARRAY<STRING>, "
    "unsupported_claim_numbers ARRAY<STRING>"
)
FACT_ITEMS = (
    "query_id STRING, n_facts INT, n_covered INT, n_claims INT, n_unsupported INT, "
    "incoherent BOOLEAN, recall DOUBLE, precision DOUBLE"
)
JUDGE_ITEMS = "query_id STRING, swap BOOLEAN, verdict STRING, winner STRING, truncated BOOLEAN"
