"""Score rows of prediction sets: guards, quality means, cost, latency, memory and length."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from convolens import protocol
from convolens.functions import text as T
from convolens.functions.rouge import METRICS, with_rouge
from convolens.operators.indexing import (
    averaged_median,
    lower_median_rank,
    order_statistics,
    p95_rank,
    upper_median_rank,
)
from convolens.session import keep


class IncompleteRun(ValueError):
    """A prediction set that must not be scored."""


# --- guards -----------------------------------------------------------------------------------


def duplicate_ids(predictions: DataFrame, key: str = "query_id") -> DataFrame:
    return predictions.groupBy(key).agg(F.count(F.lit(1)).alias("copies")).where(F.col("copies") > 1)


def missing_ids(expected: DataFrame, present: DataFrame, key: str = "query_id") -> DataFrame:
    return expected.select(key).join(present.select(key), key, "left_anti")


def guard_run(predictions: DataFrame, queries: DataFrame, allow_partial: bool = False) -> None:
    """Reject duplicates, gaps and an empty overlap before anything is scored."""
    twice = [r[0] for r in duplicate_ids(predictions).orderBy("query_id").limit(3).collect()]
    if twice:
        raise IncompleteRun(f"duplicate query ids, such as {twice}; remove repeats before scoring")
    if not allow_partial:
        gaps = [r[0] for r in missing_ids(queries, predictions).orderBy("query_id").limit(3).collect()]
        if gaps:
            raise IncompleteRun(f"queries without a prediction, such as {gaps}")
    if predictions.join(queries.select("query_id"), "query_id", "left_semi").isEmpty():
        raise IncompleteRun("no prediction belongs to a query of this split")


def guard_prompts(examples: DataFrame, prompts: DataFrame) -> None:
    gaps = [r[0] for r in missing_ids(examples, prompts).orderBy("query_id").limit(3).collect()]
    if gaps:
        raise IncompleteRun(f"examples without a prompt, such as {gaps}")


def matched(predictions: DataFrame, queries: DataFrame) -> DataFrame:
    """Predictions of known queries with their reference; foreign ones drop out of every figure."""
    return predictions.join(queries.select("query_id", "meeting_id", "reference"), "query_id")


def last_predictions(lines: DataFrame, order: str) -> DataFrame:
    """One prediction per query; of repeated ones the last line counts."""
    return lines.groupBy("query_id").agg(F.max_by("prediction", order).alias("prediction"))


# --- aggregates -------------------------------------------------------------------------------


def quality_means(scored: DataFrame, by: Sequence[str] = (), metrics: Sequence[str] = METRICS) -> DataFrame:
    """Mean over queries of each query's own F."""
    return scored.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), *[F.avg(F.col(f"{m}.f")).alias(m) for m in metrics]
    )


def _joined_set(column: str) -> Column:
    """Distinct non-empty values, sorted and joined by plus signs; NULL when there are none."""
    text = F.array_join(F.sort_array(F.collect_set(F.when(F.col(column) != "", F.col(column)))), "+")
    return F.nullif(text, F.lit(""))


def _timed_mean(column: str, timed: Column) -> Column:
    """Mean over the timed rows, NULL when any of them lacks the value."""
    value = F.when(timed, F.col(column))
    return F.when(F.count(value) == F.count_if(timed), F.round(F.avg(value), 3))


def run_figures(rows: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Cost, latency, devices and billing modes of prediction rows."""
    timed = F.col("latency_s").isNotNull() & ~F.coalesce(F.col("warmup"), F.lit(False))
    return rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        F.round(F.sum("cost_usd"), 6).alias("cost_usd_total"),
        *[_timed_mean(c, timed).alias(f"{c}_mean") for c in ("latency_s", "locate_s", "generate_s")],
        F.nullif(F.count_if(timed), F.lit(0)).alias("latency_n_timed"),
        _joined_set("device").alias("device"),
        _joined_set("mode").alias("billing_mode"),
    )


def peak_summary(rows: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """max, min, n, averaged median and p95 of the measured values; groups without any drop out."""
    stats = order_statistics(
        rows,
        by,
        value,
        {
            "min": F.lit(0),
            "max": F.col("n") - 1,
            "lower": lower_median_rank(),
            "upper": upper_median_rank(),
            "p95": p95_rank(),
        },
    )
    median = F.when(F.col("n") % 2 == 1, F.col("upper")).otherwise(F.round(averaged_median("lower", "upper"), 3))
    return stats.select(*by, "max", median.alias("median"), "p95", "min", "n")


def score_row(
    predictions: DataFrame,
    queries: DataFrame,
    run_id: str,
    split: str,
    notes: str = "",
    metrics: Sequence[str] = METRICS,
    stemmed: bool = True,
    allow_partial: bool = False,
) -> DataFrame:
    """The one-row summary of a run. Validation and test runs must be complete."""
    guard_run(predictions, queries, allow_partial or split not in ("val", "test"))
    rows = matched(predictions, queries)
    # Texts become numbers in one pass; all figures are taken from those.
    rows = keep(with_rouge(rows, metrics, stemmed).drop("prediction", "reference", "meeting_id"))
    quality = quality_means(rows, (), metrics)
    figures = run_figures(rows).drop("n")
    peaks = []
    for column, figures_of in (("peak_vram_gb", ("max", "median", "p95")), ("peak_vram_reserved_gb", ("max",))):
        peaks.append(
            peak_summary(rows.withColumn("__all", F.lit(1)), ["__all"], column).agg(
                *[F.max(k).alias(f"{column}_{k}") for k in figures_of]
            )
        )
    # Each side is one row.
    out = quality.crossJoin(figures)
    for p in peaks:
        out = out.crossJoin(p)
    return out.select(
        F.lit(run_id).alias("run_id"), F.lit(split).alias("split"), *out.columns, F.lit(notes).alias("notes")
    )


def precision_recall(scored: DataFrame, references: DataFrame, metric: str = "rouge1") -> DataFrame:
    """Per system: mean P, R and F, the upper median length and its ratio to the references' median.

    `scored` holds `system, prediction` and the metric struct; `references` one row per query.
    """
    means = scored.groupBy("system").agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(f"{metric}.p").alias("precision"),
        F.avg(f"{metric}.r").alias("recall"),
        F.avg(f"{metric}.f").alias("fmeasure"),
    )
    mid = {"median_words": upper_median_rank()}
    lengths = scored.select("system", T.word_count(F.coalesce("prediction", F.lit(""))).alias("w"))
    medians = order_statistics(lengths, ["system"], "w", mid).drop("n")
    ref = order_statistics(references.select(T.word_count(F.col("reference")).alias("w")), [], "w", mid)
    ref_words = ref.select(F.col("median_words").alias("reference_median_words"))
    return (
        means.join(medians, "system")
        .crossJoin(ref_words)
        .withColumn("length_vs_reference", F.col("median_words") / F.col("reference_median_words"))
    )


# --- shape of a prediction set ----------------------------------------------------------------


def text_profile(rows: DataFrame, by: Sequence[str], reference: str | None = None) -> DataFrame:
    """Length, repetition and variety of the texts in `prediction`, per group."""
    # One pass over the text; every figure below is taken from these few numbers per row.
    text = F.coalesce("prediction", F.lit(""))
    shape = keep(rows.select(
        *by,
        F.size(T.unicode_words(text)).alias("wc"),
        F.size(T.sentences(text, trim_parts=False)).alias("sc"),
        T.self_repeat(text).alias("rep"),
        T.type_token_ratio(text).alias("ttr"),
        *([F.size(T.unicode_words(F.col(reference))).alias("ref_wc")] if reference else []),
    ))
    out = shape.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg("wc").alias("words_mean"),
        F.avg("rep").alias("repeat_4gram_mean"),
        F.count_if(F.col("rep") > protocol.DEGENERATE_REPEAT).alias("degenerate_rows"),
        F.avg("ttr").alias("type_token_ratio_mean"),
        *(
            [F.avg(F.col("wc") / F.greatest(F.col("ref_wc"), F.lit(1))).alias("length_vs_reference")]
            if reference
            else []
        ),
    )
    mids = {"lower": lower_median_rank(), "upper": upper_median_rank()}
    for column, name in (("wc", "words_median"), ("sc", "sentences_median"), ("ref_wc", "ref_words_median")):
        if column in shape.columns:
            m = order_statistics(shape, by, column, mids)
            out = out.join(m.select(*by, averaged_median("lower", "upper").alias(name)), list(by))
    return out


def screening_verdicts(profiles: DataFrame, baseline: str, by: str = "system") -> DataFrame:
    """Whether each other profile is worth paying for, with every reason against it."""
    base = profiles.where(F.col(by) == baseline).select(
        F.col("repeat_4gram_mean").alias("base_repeat"), F.col("words_median").alias("base_words")
    )
    reasons = F.filter(
        F.array(
            F.when(F.col("degenerate_rows") > protocol.DEGENERATE_SHARE * F.col("n"), F.lit("degenerate rows")),
            F.when(
                F.col("repeat_4gram_mean") > 2 * F.greatest(F.col("base_repeat"), F.lit(protocol.REPEAT_FLOOR)),
                F.lit("self-repeat doubled"),
            ),
            F.when(F.col("words_median") <= F.col("base_words") * protocol.LENGTH_GAIN, F.lit("length barely moved")),
        ),
        lambda r: r.isNotNull(),
    )
    # The baseline is one row.
    return (
        profiles.where(F.col(by) != baseline)
        .crossJoin(F.broadcast(base))
        .select(by, (F.size(reasons) == 0).alias("worth_marking"), reasons.alias("blocked_because"))
    )


# --- runs against runs ------------------------------------------------------------------------


def self_agreement(a: DataFrame, b: DataFrame, metrics: Sequence[str] = ("rouge1", "rougeL"), stemmed: bool = True) -> DataFrame:
    """How far two prediction sets agree with each other: exact matches and overlap of a against b."""
    both = a.select("query_id", F.coalesce("prediction", F.lit("")).alias("prediction")).join(
        b.select("query_id", F.coalesce("prediction", F.lit("")).alias("reference")), "query_id"
    )
    scored = with_rouge(both, metrics, stemmed)
    return scored.agg(
        F.avg((F.col("prediction") == F.col("reference")).cast("double")).alias("exact_match_rate"),
        *[F.avg(F.col(f"{m}.f")).alias(f"self_{m}") for m in metrics],
    )


def latency_probe(rows: DataFrame, by: Sequence[str]) -> DataFrame:
    stats = order_statistics(
        rows, by, "latency_s", {"lower": lower_median_rank(), "upper": upper_median_rank()}
    ).select(*by, averaged_median("lower", "upper").alias("median"))
    return (
        rows.groupBy(*by)
        .agg(F.avg("latency_s").alias("mean"), F.min("latency_s").alias("min"), F.max("latency_s").alias("max"))
        .join(stats, list(by))
        .withColumn("spread_ratio", _ratio(F.col("max"), F.col("min")))
    )


def _ratio(top: Column, bottom: Column) -> Column:
    """top / bottom of doubles, where a bottom of 0 gives infinity, or NaN below a top of 0, as floating point has it."""
    beyond = F.when(top == 0, F.lit(float("nan"))).otherwise(F.signum(top) * float("inf"))
    return F.when(bottom == 0, beyond).otherwise(top / bottom)


def seed_spread(runs: DataFrame, by: Sequence[str], metric: str, order: str = "seed") -> DataFrame:
    """Extremes with their seeds, range, mean and sample deviation; groups of one run drop out.

    Of equal extremes the run that comes first in `order` is named.
    """
    return (
        runs.where(F.col(metric).isNotNull())
        .groupBy(*by)
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.min(F.struct(F.col(metric).alias("v"), F.col(order).alias("o"), F.col("seed").alias("seed"))).alias("lo"),
            F.min(F.struct((-F.col(metric)).alias("v"), F.col(order).alias("o"), F.col("seed").alias("seed"))).alias("hi"),
            F.avg(metric).alias("mean"),
            F.stddev_samp(metric).alias("stdev"),
        )
        .where(F.col("n") >= 2)
        .select(
            *by,
            "n",
            F.col("lo.v").alias("min"),
            F.col("lo.seed").alias("min_seed"),
            (-F.col("hi.v")).alias("max"),
            F.col("hi.seed").alias("max_seed"),
            (-F.col("hi.v") - F.col("lo.v")).alias("range"),
            "mean",
            "stdev",
        )
    )


def seed_verdict(range_points: Column) -> Column:
    """Which reading a seed range in ROUGE-1 points commits to."""
    return (
        F.when(range_points >= protocol.SEED_SPREAD_CHECKPOINT, F.lit("BRANCH A"))
        .when(range_points >= protocol.SEED_SPREAD_FLOOR, F.lit("BRANCH A (weaker form)"))
        .otherwise(F.lit("BRANCH B"))
    )


def worst_case(rows: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """The largest measurement per configuration."""
    return rows.groupBy(*by).agg(F.max(value).alias(f"{value}_worst"))
