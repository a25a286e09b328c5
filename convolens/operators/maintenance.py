"""Keep stored rows honest: rescoring with drift checks, backfills, probes of inputs."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from convolens import protocol
from convolens.operators.indexing import bucket_of, number_in_order, range_cuts

ROUGE_KEYS = ("rouge1", "rouge2", "rougeL")


def _drifted(keys: Sequence[str]) -> Column:
    parts = [F.abs(F.col(k) - F.col(f"new_{k}")) > protocol.DRIFT_TOLERANCE for k in keys]
    out = parts[0]
    for p in parts[1:]:
        out = out | p
    return out


def _with_new(stored: DataFrame, recomputed: DataFrame, keys: Sequence[str]) -> DataFrame:
    new = recomputed.select("run_id", F.col("n").alias("new_n"), *[F.col(k).alias(f"new_{k}") for k in keys])
    return stored.join(new, "run_id", "left")


def rescored_rows(stored: DataFrame, recomputed: DataFrame, strict: bool = True) -> DataFrame:
    """What a rescoring changes in ROUGE-Lsum. The other three must not move.

    With `strict` a row that drifted fails the query; otherwise it says so.
    """
    rows = _with_new(stored, recomputed, [*ROUGE_KEYS, "rougeLsum"])
    status = F.when(F.col("new_n").isNull(), "no predictions").when(_drifted(ROUGE_KEYS), "drifted").otherwise("ok")
    rows = rows.withColumn("status", status)
    if strict:
        fail = F.raise_error(F.concat(F.lit("scores moved that segmentation cannot move: "), F.col("run_id")))
        rows = rows.withColumn("status", F.when(F.col("status") == "drifted", fail.cast("string")).otherwise(F.col("status")))
    return rows.select(
        "run_id",
        "status",
        F.col("n").alias("n_old"),
        F.col("new_n").alias("n_new"),
        F.col("rougeLsum").alias("old"),
        F.col("new_rougeLsum").alias("new"),
        (F.col("new_rougeLsum") - F.col("rougeLsum")).alias("delta"),
    )


def backfilled_model_score(stored: DataFrame, recomputed: DataFrame, strict: bool = True) -> DataFrame:
    """Fill missing model scores; rows that have one are controls and must reproduce."""
    keys = [*ROUGE_KEYS, "rougeLsum"]
    rows = _with_new(stored, recomputed, [*keys, "bertscore_f1"])
    broken = _drifted(keys) | (F.abs(F.col("bertscore_f1") - F.col("new_bertscore_f1")) > protocol.DRIFT_TOLERANCE)
    status = (
        F.when(F.col("new_n").isNull(), "no predictions")
        .when(F.coalesce(broken, F.lit(False)), "drifted")
        .when(F.col("bertscore_f1").isNull(), "backfilled")
        .otherwise("control ok")
    )
    rows = rows.withColumn("status", status)
    if strict:
        fail = F.raise_error(F.concat(F.lit("stored scores do not reproduce: "), F.col("run_id")))
        rows = rows.withColumn("status", F.when(F.col("status") == "drifted", fail.cast("string")).otherwise(F.col("status")))
    return rows.select(
        "run_id", "status", F.coalesce("bertscore_f1", "new_bertscore_f1").alias("bertscore_f1")
    )


def with_model_score(pairs: DataFrame, load: Callable, name: str, column: str = "score") -> DataFrame:
    """Score `prediction, reference` with a model such as BERTScore; raw texts, no segmentation."""

    @F.pandas_udf("double")
    def score(pred: pd.Series, ref: pd.Series) -> pd.Series:
        from convolens.functions import plugins

        return pd.Series(plugins.once(name, load)(pred.tolist(), ref.tolist()), dtype="float64")

    return pairs.withColumn(column, score("prediction", "reference"))


# --- inputs of probes -------------------------------------------------------------------------


def longest_rows(rows: DataFrame, length: str, n: int, tie: str) -> DataFrame:
    return rows.orderBy(F.desc(length), tie).limit(n)


def probe_ranks(total: int, points: int) -> list[int]:
    """Ranks evenly spaced over a length order, from the first to the last; a single one is the last."""
    spots = min(points, total)
    last = total - 1
    # Fixed value: halves round to even, as the protocol's do.
    return [last] if spots <= 1 else sorted({round(k * last / (spots - 1)) for k in range(spots)})


def length_spread_sample(rows: DataFrame, length: str, order: str, points: int) -> DataFrame:
    """Rows spread evenly over the lengths that occur, with their ranks. `order` breaks ties."""
    cuts = range_cuts(rows, length)
    ranked = number_in_order(rows, [], bucket_of(F.col(length), cuts), [F.col(length), F.col(order)], "rank")
    total = rows.count()
    return ranked if points >= total else ranked.where(F.col("rank").isin(probe_ranks(total, points)))
