"""The data model derived from the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


# Tables whose rows are long texts.
TEXT_TABLES = ("documents", "conversations", "pages")


# What was found out about a path: its schema, and whether it has fewer splits than cores.
_KNOWN: dict[str, tuple] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table; long texts in fewer splits than cores are spread before they are worked on.

    A table of cluster size has far more splits than cores and is read as it lies.
    """
    path = f"{sf_dir}/{name}.parquet"
    cores = spark.sparkContext.defaultParallelism
    if path not in _KNOWN:
        df = spark.read.parquet(path)
        _KNOWN[path] = (df.schema, name in TEXT_TABLES and df.rdd.getNumPartitions() < cores)
    schema, few = _KNOWN[path]
    df = spark.read.schema(schema).parquet(path)
    return df.repartition(cores) if few else df


def chat_utterances(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select(
        F.col("conv_id").cast("string").alias("meeting_id"),
        F.col("turn").cast("int").alias("utt_idx"),
        F.col("role").alias("speaker"),
        "text",
    )


def chat_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A query per user turn that an assistant turn answers; the answer is its reference.

    The gold spans are the answer with the turn behind it and, later in a conversation, its opening.
    One query in five asks about the whole conversation and has no spans.
    """
    conv = table(spark, sf_dir, "conversations")
    asked = conv.where(F.col("role") == "user").select("conv_id", "turn", F.col("text").alias("query"))
    answer = conv.where(F.col("role") == "assistant").select(
        "conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("reference")
    )
    general = (F.col("conv_id") + F.col("turn")) % 5 == 0
    span = lambda s, e: F.struct(s.cast("int").alias("s"), e.cast("int").alias("e"))
    t = F.col("turn")
    spans = F.when(t >= 2, F.array(span(t + 1, t + 2), span(F.lit(0), F.lit(0)))).otherwise(F.array(span(t + 1, t + 2)))
    none = F.array().cast("array<struct<s:int,e:int>>")
    return asked.join(answer, ["conv_id", "turn"]).select(
        F.concat_ws("_", "conv_id", F.concat(F.when(general, "g").otherwise("s"), "turn")).alias("query_id"),
        F.col("conv_id").cast("string").alias("meeting_id"),
        F.lit("test").alias("split"),
        F.when(general, "general").otherwise("specific").alias("query_type"),
        "query",
        "reference",
        F.when(general, none).otherwise(spans).alias("gold_spans"),
        "conv_id",
        "turn",
    )


def scored_pairs(spark: SparkSession, sf_dir: str, system: str) -> DataFrame:
    """`query_id, meeting_id, query, prediction, reference` of one system.

    System `a` repeats the conversation's last assistant turn, `b` puts the query before it, and `c`
    answers with the conversation's first turn.
    """
    conv = table(spark, sf_dir, "conversations")
    if system == "c":
        last = conv.where(F.col("turn") == 0).select("conv_id", F.col("text").alias("last"))
    else:
        last = conv.where(F.col("role") == "assistant").groupBy("conv_id").agg(F.max_by("text", "turn").alias("last"))
    text = F.concat_ws(" ", "query", "last") if system == "b" else F.col("last")
    return spread(
        chat_queries(spark, sf_dir)
        .join(last, "conv_id")
        .select("query_id", "meeting_id", "conv_id", "turn", "query", "reference", text.alias("prediction")),
        "conv_id",
        "turn",
    )


def spread(rows: DataFrame, *keys: str) -> DataFrame:
    """Rows over all shuffle partitions: the optimizer, which goes by bytes, gives texts that take long to few tasks."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def predictions(spark: SparkSession, sf_dir: str, system: str) -> DataFrame:
    return scored_pairs(spark, sf_dir, system).select("query_id", "prediction")


def document_meetings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as transcripts in array form: a line is an utterance, the source its speaker."""
    line = lambda x: F.struct(F.col("source").alias("speaker"), x.alias("text"))
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").cast("string").alias("meeting_id"), F.transform(F.split("text", "\n"), line).alias("utterances")
    )


def document_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document is asked for its own first line; the last line is its reference."""
    parts = F.split("text", "\n")
    return table(spark, sf_dir, "documents").select(
        F.concat(F.col("doc_id").cast("string"), F.lit("_g0")).alias("query_id"),
        F.col("doc_id").cast("string").alias("meeting_id"),
        F.lit("test").alias("split"),
        F.lit("general").alias("query_type"),
        F.element_at(parts, 1).alias("query"),
        F.element_at(parts, -1).alias("reference"),
        F.array().cast("array<struct<s:int,e:int>>").alias("gold_spans"),
    )


# --- runs, replies and markings, derived from the tables by rule ------------------------------

# Two contestants from different vendors, marked by a judge of each vendor.
CONTESTANTS = ("gpt-5.6-luna", "claude-haiku-4-5")
JUDGES = ("gpt-5.6-sol", "claude-opus-5")
MODELS = {
    "click": "gpt-5.6-sol",
    "view": "gpt-5.6-luna",
    "purchase": "claude-opus-5",
    "signup": "claude-haiku-4-5",
    "error": "gemini-3.6-flash",
}


def event_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as prediction rows: the type is the system, the value a latency and a memory peak."""
    e = table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("bigint")
    i = F.col("event_id")
    model = F.create_map(*[F.lit(x) for kv in MODELS.items() for x in kv])[F.col("event_type")]
    return e.select(
        i.alias("query_id"),
        F.col("event_type").alias("system"),
        "user_id",
        model.alias("model"),
        (k * 100).alias("prompt_tokens"),
        k.alias("completion_tokens"),
        F.when(i % 5 == 0, k % 7).alias("thoughts_tokens"),
        F.when(i % 3 == 0, "batch").when(i % 3 == 1, "sync").alias("mode"),
        F.when(i % 7 != 0, F.col("value")).alias("latency_s"),
        F.when(i % 7 != 0, F.col("value") / 8).alias("locate_s"),
        F.when((i % 11 != 0) | (F.col("event_type") != "error"), F.col("value") / 4).alias("generate_s"),
        (i < 10).alias("warmup"),
        F.when(F.col("user_id") % 2 == 0, "gpu-a").when(F.col("event_type") != "view", "gpu-b").alias("device"),
        F.when(i % 4 != 0, F.col("value") / 16).alias("peak_vram_gb"),
    )


def judge_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One stored reply per query, contestant and judge; verdicts follow the ids and text lengths."""
    q = chat_queries(spark, sf_dir)
    pairs = [(c, ci, j, ji) for ci, c in enumerate(CONTESTANTS) for ji, j in enumerate(JUDGES)]
    runs = F.explode(
        F.array(
            *[
                F.struct(
                    F.lit(c).alias("contestant"),
                    F.lit(ci).alias("ci"),
                    F.lit(j).alias("judge_model"),
                    F.lit(ji).alias("ji"),
                )
                for c, ci, j, ji in pairs
            ]
        )
    )
    rows = q.select("query_id", "conv_id", "turn", F.length("reference").alias("len"), runs.alias("r")).select("*", "r.*")
    h = (F.col("conv_id") * 7 + F.col("turn") * 3 + F.col("len") + F.col("ci") * 5 + F.col("ji") * (F.col("conv_id") % 2)) % 10
    line = (
        F.when(h < 4, "VERDICT: A")
        .when(h < 7, " verdict below\nVERDICT: B ")
        .when(h == 7, "VERDICT: tie")
        .when(h == 8, "VERDICT: A.")
        .otherwise("no verdict")
    )
    return rows.select(
        "query_id",
        "contestant",
        "judge_model",
        ((F.col("conv_id") + F.col("turn") / 2) % 2 == 1).alias("swap"),
        F.concat(F.lit("VERDICT: B\nOn second thought\n"), line).alias("text"),
        (h == 9).alias("truncated"),
        F.when(h != 3, F.col("len")).alias("prompt_tokens"),
        (h + 1).alias("completion_tokens"),
        F.lit("sync").alias("mode"),
        F.col("judge_model").alias("model"),
    )


def fact_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The reference's sentences as its facts."""
    from convolens.functions.text import sentences

    return chat_queries(spark, sf_dir).select("query_id", sentences(F.col("reference")).alias("facts"))


def marking_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Marking replies per system: the claims are the prediction's sentences, and every number whose
    sum with the conversation's id is even is listed, some of it as strings and out of range."""
    from convolens.functions.text import sentences

    out = None
    for si, system in enumerate(("a", "c")):
        rows = scored_pairs(spark, sf_dir, system).select(
            "query_id",
            F.lit(system).alias("system"),
            (F.col("conv_id") + F.col("turn") + si).alias("k"),
            F.size(sentences(F.col("reference"))).alias("nf"),
            sentences(F.col("prediction")).alias("claims"),
        )
        part = rows
        out = part if out is None else out.unionByName(part)
    even = lambda n, k: F.filter(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: (i + k) % 2 == 0)
    as_list = lambda xs: F.array_join(F.transform(xs, lambda i: F.concat(F.lit('"'), i.cast("string"), F.lit('"'))), ", ")
    body = F.concat(
        F.lit('Here is my marking: {"covered_fact_numbers": [0, 9999, "x", '),
        as_list(F.concat(even(F.col("nf"), F.col("k")), F.array(F.lit(0)))),
        F.lit('], "summary_claims": '),
        F.to_json("claims"),
        F.lit(', "unsupported_claim_numbers": ['),
        as_list(even(F.size("claims"), F.col("k") + F.size("claims"))),
        F.lit("]} Done."),
    )
    text = F.when(F.col("k") % 13 == 0, F.lit("I cannot mark this {")).otherwise(body)
    return out.select("query_id", "system", text.alias("text"))
