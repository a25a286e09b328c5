"""Read transcripts, queries, predictions, rows and records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from convolens import schemas
from convolens.functions.text import strip
from convolens.operators.indexing import number_in_order


def _ordered_lines(spark: SparkSession, path: str) -> DataFrame:
    """Non-blank lines with what gives their order: file, where the split starts, place in the split."""
    return (
        spark.read.text(path)
        .select(
            "value",
            F.col("_metadata.file_path").alias("file"),
            F.col("_metadata.file_block_start").alias("at"),
            F.monotonically_increasing_id().alias("place"),
        )
        .where(strip(F.col("value")) != "")
    )


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """`line_no, value` of the non-blank lines in file order, files by name.

    A scan hands out its splits by size, so lines are numbered split by split and shifted.
    """
    lines = number_in_order(_ordered_lines(spark, path), ["file"], F.col("at"), [F.col("place")], "__n")
    # One row per file.
    ahead = W.orderBy("file").rowsBetween(W.unboundedPreceding, -1)
    shift = lines.groupBy("file").count().select("file", F.coalesce(F.sum("count").over(ahead), F.lit(0)).alias("__shift"))
    return lines.join(shift, "file").select((F.col("__n") + F.col("__shift")).alias("line_no"), "value")


def read_meetings(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.MEETINGS).json(path)


def spans(pairs: Column) -> Column:
    """Pairs of line numbers, given as numbers or strings, as `{s, e}`; NULL is no span."""
    none = F.array().cast(schemas.GOLD_SPANS.lower())
    return F.coalesce(
        F.transform(pairs, lambda p: F.struct(p[0].cast("int").alias("s"), p[1].cast("int").alias("e"))), none
    )


def read_queries(spark: SparkSession, path: str) -> DataFrame:
    df = spark.read.schema(schemas.QUERIES_JSON).json(path)
    return df.withColumn("gold_spans", spans(F.col("gold_spans")))


def read_predictions(spark: SparkSession, path: str) -> DataFrame:
    """Prediction rows; of several lines with one id the last stays."""
    fields = F.from_json("value", schemas.PREDICTIONS)
    rows = _ordered_lines(spark, path).select(F.struct("file", "at", "place").alias("k"), fields.alias("p"))
    return rows.groupBy("p.query_id").agg(F.max_by("p", "k").alias("p")).select("p.*")


def read_text_predictions(spark: SparkSession, path: str, file_id: str) -> DataFrame:
    """One prediction per line, trimmed, blank lines dropped, in file order: `file_id, i, text`."""
    return numbered_lines(spark, path).select(
        F.lit(file_id).alias("file_id"), F.col("line_no").alias("i"), strip(F.col("value")).alias("text")
    )


def _whole_json(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path, wholetext=True).select("value", F.col("_metadata.file_name").alias("file_name"))


# Fixed names: what every score row must carry, even if its value is null.
ROW_KEYS = (
    "run_id", "split", "n", "rouge1", "rouge2", "rougeLsum", "bertscore_f1", "cost_usd_total", "latency_s_mean",
)


def read_score_rows(spark: SparkSession, path: str) -> DataFrame:
    """Score rows, one JSON object per file. A malformed or incomplete file fails by name."""
    rows = _whole_json(spark, path).withColumn("__keys", F.json_object_keys("value"))
    missing = F.array_except(F.array(*[F.lit(k) for k in ROW_KEYS]), F.coalesce("__keys", F.array().cast("array<string>")))
    fail = F.raise_error(F.concat(F.lit("bad row file "), F.col("file_name"), F.lit(": "), F.array_join(missing, ", ")))
    checked = F.when(F.size(missing) > 0, fail.cast("string")).otherwise(F.col("value"))
    return rows.select("file_name", F.from_json(checked, schemas.SCORE_ROWS).alias("r")).select("file_name", "r.*")


def with_seed(rows: DataFrame) -> DataFrame:
    """The training seed that a row's file name ends with."""
    return rows.withColumn("seed", F.nullif(F.regexp_extract("file_name", r"seed(\d+)", 1), F.lit("")).cast("bigint"))


def read_interval_records(spark: SparkSession, path: str) -> DataFrame:
    return _whole_json(spark, path).select(F.from_json("value", schemas.INTERVALS).alias("r")).select("r.*")


def read_training_records(spark: SparkSession, path: str) -> DataFrame:
    """Records of real training runs: dry runs are left out."""
    rec = "run_name STRING, seed BIGINT, dry_run BOOLEAN, wall_clock_hms STRING, wall_clock_s DOUBLE, peak_vram_gb DOUBLE, peak_vram_reserved_gb DOUBLE"
    rows = _whole_json(spark, path).select("file_name", F.from_json("value", rec).alias("r")).select("file_name", "r.*")
    return rows.where(~F.coalesce("dry_run", F.lit(False)))


def read_fact_runs(spark: SparkSession, path: str) -> DataFrame:
    """Stored fact runs as items; files without items or system are something else."""
    run = f"system STRING, judge_model STRING, judge_provider STRING, fact_f1 DOUBLE, unparsed BIGINT, items ARRAY<STRUCT<{schemas.FACT_ITEMS}>>"
    rows = _whole_json(spark, path).select("file_name", F.from_json("value", run).alias("r")).select("file_name", "r.*")
    return rows.where(F.col("items").isNotNull() & F.col("system").isNotNull())


def read_recalls(spark: SparkSession, path: str) -> DataFrame:
    """Per-query recall from its JSON report."""
    body = "per_query MAP<STRING, STRUCT<recall: DOUBLE, n_gold: BIGINT, n_picked: BIGINT>>"
    rows = _whole_json(spark, path).select(F.from_json("value", body)["per_query"].alias("m"))
    return rows.select(F.explode("m").alias("query_id", "v")).select("query_id", "v.*")


def existing_runs(wanted: DataFrame, present: DataFrame, key: str = "file_name") -> DataFrame:
    """Of the wanted (system, judge) runs those whose file exists."""
    return wanted.join(present.select(key).distinct(), key, "left_semi")


def text_hash(text: Column) -> Column:
    """SHA-256 of a text whose Windows line ends count as plain ones."""
    return F.sha2(F.replace(text, F.lit("\r\n"), F.lit("\n")), 256)


def content_hash(spark: SparkSession, path: str) -> DataFrame:
    """`path, sha256` of files, with Windows line ends read as plain ones."""
    as_text = F.decode("content", "ISO-8859-1")
    plain = F.encode(F.replace(as_text, F.lit("\r\n"), F.lit("\n")), "ISO-8859-1")
    return spark.read.format("binaryFile").load(path).select("path", F.sha2(plain, 256).alias("sha256"))


def verify_artifacts(files: DataFrame, expected: DataFrame) -> DataFrame:
    """Files whose content is not the pinned one, or which are not there."""
    return expected.join(files, "path", "left").where(~F.col("expected_sha256").eqNullSafe(F.col("sha256")))


def directory_bytes(spark: SparkSession, path: str) -> DataFrame:
    """Total bytes of a folder and its largest file; contents are never read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length")
    return files.agg(
        F.sum("length").alias("total_bytes"), F.max_by("path", "length").alias("largest"), F.max("length").alias("largest_bytes")
    )


# --- the raw benchmark form -------------------------------------------------------------------


def read_raw_meetings(spark: SparkSession, path: str, split: str) -> DataFrame:
    rows = numbered_lines(spark, path)
    return rows.select(
        F.concat(F.lit(split), F.lit("_"), F.col("line_no").cast("string")).alias("meeting_id"),
        F.lit(split).alias("split"),
        F.from_json("value", schemas.RAW_MEETING).alias("m"),
    ).select("meeting_id", "split", "m.*")


def normalize_utterances(raw: DataFrame) -> DataFrame:
    return raw.select("meeting_id", F.posexplode("meeting_transcripts").alias("utt_idx", "u")).select(
        "meeting_id", "utt_idx", F.col("u.speaker").alias("speaker"), F.col("u.content").alias("text")
    )


def normalize_queries(raw: DataFrame) -> DataFrame:
    """General and specific queries of every meeting in one table; ids count within their kind."""

    def part(kind: str, letter: str, column: str, gold: Column) -> DataFrame:
        rows = raw.select("meeting_id", "split", F.posexplode(column).alias("k", "q"))
        return rows.select(
            F.concat(F.col("meeting_id"), F.lit(f"_{letter}"), F.col("k").cast("string")).alias("query_id"),
            "meeting_id",
            "split",
            F.lit(kind).alias("query_type"),
            F.col("q.query").alias("query"),
            F.col("q.answer").alias("reference"),
            gold.alias("gold_spans"),
        )

    none = F.array().cast(schemas.GOLD_SPANS.lower())
    return part("general", "g", "general_query_list", none).unionByName(
        part("specific", "s", "specific_query_list", spans(F.col("q.relevant_text_span")))
    )
