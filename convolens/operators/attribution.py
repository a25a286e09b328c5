"""How much of a score gap is retrieval: buckets of recall, their controls, and what survives."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from convolens import protocol
from convolens.functions.marking import per_query_f1
from convolens.session import keep

MISS, PARTIAL, MOST, HIT = protocol.RECALL_BUCKETS


def recall_bucket(recall: Column) -> Column:
    return (
        F.when(recall.isNull(), F.lit(None).cast("string"))
        .when(recall == 0, F.lit(MISS))
        .when(recall < 0.5, F.lit(PARTIAL))
        .when(recall < 1.0, F.lit(MOST))
        .otherwise(F.lit(HIT))
    )


def item_score(metric: str) -> Column:
    """One number per fact item; F uses the per-query form, where a total failure is 0."""
    return per_query_f1(F.col("precision"), F.col("recall")) if metric == "f1" else F.col(metric)


def _every_bucket(stats: DataFrame) -> DataFrame:
    """Empty buckets are reported too."""
    spark = stats.sparkSession
    dim = spark.createDataFrame([(b,) for b in protocol.RECALL_BUCKETS], "bucket string")
    return dim.join(stats, "bucket", "left")


def bucket_by_recall(recalls: DataFrame, scores: DataFrame) -> DataFrame:
    """Mean of `score` per recall bucket. Queries that lack either number are left out."""
    joined = scores.join(recalls.select("query_id", F.col("recall").alias("__r")), "query_id")
    stats = (
        joined.where(F.col("__r").isNotNull() & F.col("score").isNotNull())
        .groupBy(recall_bucket(F.col("__r")).alias("bucket"))
        .agg(F.count(F.lit(1)).alias("n"), F.avg("score").alias("mean"))
    )
    return _every_bucket(stats).select("bucket", F.coalesce("n", F.lit(0)).alias("n"), "mean")


def zero_rates(recalls: DataFrame, scores: DataFrame) -> DataFrame:
    """Share of queries that score exactly zero, per bucket."""
    joined = scores.join(recalls.select("query_id", F.col("recall").alias("__r")), "query_id")
    stats = (
        joined.where(F.col("__r").isNotNull() & F.col("score").isNotNull())
        .groupBy(recall_bucket(F.col("__r")).alias("bucket"))
        .agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("score") == 0).alias("zero"))
    )
    return _every_bucket(stats).select(
        "bucket",
        F.coalesce("n", F.lit(0)).alias("n"),
        F.coalesce("zero", F.lit(0)).alias("zero"),
        (F.col("zero") / F.col("n")).alias("rate"),
    )


def _long(items: DataFrame, metrics: Sequence[str]) -> DataFrame:
    """`query_id, metric, score`: every metric in one pass over the items."""
    cells = [F.struct(F.lit(m).alias("metric"), item_score(m).cast("double").alias("score")) for m in metrics]
    return items.select("query_id", F.explode(F.array(*cells)).alias("c")).select("query_id", "c.metric", "c.score")


def flatness(recalls: DataFrame, baseline: DataFrame, metrics: Sequence[str]) -> DataFrame:
    """How far the baseline's bucket means lie apart: it never saw the retrieval, so they should not.

    `spread` and `stdev` are NULL with fewer than two filled buckets.
    """
    return _flatness(recalls, _long(baseline, metrics))


def _flatness(recalls: DataFrame, scores: DataFrame) -> DataFrame:
    joined = scores.join(recalls.select("query_id", F.col("recall").alias("__r")), "query_id")
    means = (
        joined.where(F.col("__r").isNotNull() & F.col("score").isNotNull())
        .groupBy("metric", recall_bucket(F.col("__r")).alias("bucket"))
        # Bucket means are compared as they are reported, at four places.
        .agg(F.round(F.avg("score"), 4).alias("m"))
    )
    enough = F.count(F.lit(1)) > 1
    return means.groupBy("metric").agg(
        F.when(enough, F.round(F.max("m") - F.min("m"), 4)).alias("spread"),
        F.when(enough, F.round(F.stddev_pop("m"), 4)).alias("stdev"),
    )


def decomposition_buckets(
    recalls: DataFrame, ours: DataFrame, baseline: DataFrame, metrics: Sequence[str] = ("recall", "precision", "f1")
) -> DataFrame:
    """metric, side, bucket, n, mean, spread, stdev: both sides' bucket means, every bucket of each, and the control.

    The control says how far the baseline's means lie apart; it is NULL on our side, and with fewer than two filled
    buckets. Queries that lack a recall or a score are left out.
    """
    recalls = keep(recalls.select("query_id", F.col("recall").alias("__r")))
    base = keep(_long(baseline, metrics))
    scores = _long(ours, metrics).withColumn("side", F.lit("ours")).unionByName(base.withColumn("side", F.lit("baseline")))
    stats = (
        scores.join(recalls, "query_id")
        .where(F.col("__r").isNotNull() & F.col("score").isNotNull())
        .groupBy("metric", "side", recall_bucket(F.col("__r")).alias("bucket"))
        .agg(F.count(F.lit(1)).alias("n"), F.avg("score").alias("mean"))
    )
    # Metrics, sides and buckets are a handful of names.
    names = [(m, side, b) for m in metrics for side in ("ours", "baseline") for b in protocol.RECALL_BUCKETS]
    every = recalls.sparkSession.createDataFrame(names, "metric string, side string, bucket string")
    control = _flatness(recalls.withColumnRenamed("__r", "recall"), base).withColumn("side", F.lit("baseline"))
    return (
        every.join(stats, ["metric", "side", "bucket"], "left")
        .join(F.broadcast(control), ["metric", "side"], "left")
        .select("metric", "side", "bucket", F.coalesce("n", F.lit(0)).alias("n"), "mean", "spread", "stdev")
    )


def attribution(
    recalls: DataFrame, ours: DataFrame, baseline: DataFrame, metrics: Sequence[str] = ("recall", "precision", "f1")
) -> DataFrame:
    """Per metric the gap over all queries, the gap under perfect retrieval, and the share that survives.

    `survival` is NULL with its reasons whenever it would not mean anything.
    """
    recalls = keep(recalls.select("query_id", "recall"))
    base = keep(_long(baseline, metrics))
    o = _long(ours, metrics).withColumnRenamed("score", "o")
    b = base.withColumnRenamed("score", "b")
    r = recalls.where(F.col("recall").isNotNull()).select("query_id", F.col("recall").alias("r"))
    hit = F.col("r") == 1.0
    stats = (
        o.join(b, ["query_id", "metric"])
        .join(r, "query_id")
        .groupBy("metric")
        .agg(
            F.count(F.lit(1)).alias("n_shared"),
            F.count_if(hit).alias("n_perfect_retrieval"),
            F.avg("o").alias("ours_all"),
            F.avg("b").alias("baseline_all"),
            F.avg(F.when(hit, F.col("o"))).alias("ours_perfect"),
            F.avg(F.when(hit, F.col("b"))).alias("baseline_perfect"),
        )
    )
    gap, gap_hit, spread = F.col("gap_all"), F.col("gap_perfect"), F.col("spread")
    reasons = F.filter(
        F.array(
            F.when(gap.isNull() | gap_hit.isNull(), F.lit("empty bucket")).when(
                gap < protocol.MIN_GAP, F.format_string(f"gap %.4f below noise of {protocol.MIN_GAP}", gap)
            ),
            F.when(
                spread.isNotNull() & (gap >= protocol.MIN_GAP) & (spread > protocol.MAX_CONTROL_SPREAD * gap),
                F.format_string("control failed: baseline varies by %.4f over buckets, against a gap of %.4f", spread, gap),
            ),
        ),
        lambda x: x.isNotNull(),
    )
    # One row per metric on either side.
    return (
        stats.join(F.broadcast(_flatness(recalls, base)), "metric", "left")
        .withColumn("gap_all", F.col("baseline_all") - F.col("ours_all"))
        .withColumn("gap_perfect", F.col("baseline_perfect") - F.col("ours_perfect"))
        .withColumn("uninterpretable_because", reasons)
        .withColumn("survival", F.when(F.size("uninterpretable_because") == 0, gap_hit / gap))
    )
