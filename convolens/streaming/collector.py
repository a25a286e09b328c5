"""Collect batch results as they land: what was a polling loop is a file stream that can stop and resume."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from convolens.operators.costs import batch_results, cache_entries

CACHE = (
    "query_id STRING, prediction STRING, prompt_tokens BIGINT, completion_tokens BIGINT, reasoning_tokens BIGINT, "
    "finish_reason STRING, model_snapshot STRING, prompt_word_budget INT, thinking STRING, mode STRING"
)


def read_cache(spark: SparkSession, path: str) -> DataFrame:
    """The response cache; empty before anything was collected."""
    try:
        return spark.read.parquet(path).drop("epoch")
    except Exception as error:
        if "PATH_NOT_FOUND" not in str(error) and "UNABLE_TO_INFER_SCHEMA" not in str(error):
            raise
        return spark.createDataFrame([], CACHE)


def collect_results(
    spark: SparkSession, landing: str, cache: str, errors: str, checkpoint: str, budget: int, thinking: str = "off"
) -> StreamingQuery:
    """Move every result line that has landed into the cache and stop.

    Each round writes its own folder, so a round that is run again replaces itself. A query is
    cached once; failures go to `errors` and stay pending.
    """

    def store(lines: DataFrame, epoch: int) -> None:
        good, bad = batch_results(lines)
        entries = cache_entries(good.dropDuplicates(["query_id"]), "batch", budget, thinking)
        # Not what this same round may have written before it was interrupted.
        seen = read_cache_before(spark, cache, epoch)
        new = entries.join(seen.select("query_id"), "query_id", "left_anti")
        new.write.mode("overwrite").parquet(f"{cache}/epoch={epoch}")
        bad.write.mode("overwrite").parquet(f"{errors}/epoch={epoch}")

    return (
        spark.readStream.format("text")
        .load(landing)
        .writeStream.foreachBatch(store)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def read_cache_before(spark: SparkSession, path: str, epoch: int) -> DataFrame:
    try:
        return spark.read.parquet(path).where(F.col("epoch") < epoch)
    except Exception as error:
        if "PATH_NOT_FOUND" not in str(error) and "UNABLE_TO_INFER_SCHEMA" not in str(error):
            raise
        return spark.createDataFrame([], CACHE)
