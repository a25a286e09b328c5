"""Fact-level judging over stored replies, claim veracity, and probes of the marking itself."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from convolens import protocol
from convolens.functions import marking as M
from convolens.functions.text import let
from convolens.operators import prompts
from convolens.operators.indexing import number_in_order


def extraction_requests(queries: DataFrame) -> DataFrame:
    return queries.select("query_id", prompts.extract_prompt(F.col("query"), F.col("reference")).alias("prompt"))


def extracted_facts(replies: DataFrame) -> DataFrame:
    """`query_id, facts` of the extraction replies that parse; the rest is reported as failed."""
    return replies.select("query_id", M.fact_list(F.col("text")).alias("facts"))


def marking_requests(queries: DataFrame, facts: DataFrame, predictions: DataFrame) -> DataFrame:
    rows = facts.where(F.col("facts").isNotNull()).join(queries.select("query_id", "query"), "query_id").join(
        predictions.select("query_id", "prediction"), "query_id"
    )
    return rows.select("query_id", prompts.mark_prompt(F.col("query"), F.col("facts"), F.col("prediction")).alias("prompt"))


def fact_items(replies: DataFrame, facts: DataFrame) -> DataFrame:
    """Stored marking replies scored against the shared fact lists.

    `parsed` is false for replies that are not a JSON object; those are counted, not scored.
    """
    rows = replies.join(facts.select("query_id", F.size("facts").alias("__n")), "query_id")
    mark = M.marking(F.col("text"))
    item = let(mark, lambda m: F.when(m.isNotNull(), M.score_marking(m, F.col("__n"))))
    keep = [c for c in replies.columns if c != "text"]
    return rows.withColumn("__i", item).select(*keep, F.col("__i").isNotNull().alias("parsed"), "__i.*")


def fact_summary(items: DataFrame, by: Sequence[str]) -> DataFrame:
    """Mean precision, recall and per-query F, with the F of the means beside it for audit."""
    ok = F.col("parsed")
    f = M.per_query_f1(F.col("precision"), F.col("recall"))
    return (
        items.groupBy(*by)
        .agg(
            F.count_if(ok).alias("n_scored"),
            F.count_if(~ok).alias("unparsed"),
            F.count_if(F.col("incoherent")).alias("incoherent_markings"),
            F.avg(F.col("incoherent").cast("double")).alias("incoherent_rate"),
            F.avg(F.when(F.col("n_claims") > 0, F.col("n_claims"))).alias("mean_claims_denominator"),
            F.avg("precision").alias("fact_precision"),
            F.avg("recall").alias("fact_recall"),
            F.avg(f).alias("fact_f1"),
            F.count_if(f == 0.0).alias("zero_queries"),
            F.avg("n_facts").alias("mean_facts_per_query"),
            F.avg("n_claims").alias("mean_claims_per_summary"),
        )
        .withColumn("fact_f1_of_means", M.f1_of_means(F.col("fact_precision"), F.col("fact_recall")))
    )


def rescored_facts(items: DataFrame, stored: DataFrame, by: Sequence[str]) -> DataFrame:
    """Re-aggregate stored items and show the old figure beside the new one."""
    new = fact_summary(items, by)
    return new.join(stored.select(*by, F.col("fact_f1").alias("old_fact_f1")), list(by), "left").select(
        *by,
        F.col("n_scored").alias("n"),
        "old_fact_f1",
        F.col("fact_f1").alias("new_fact_f1"),
        F.col("fact_f1_of_means").alias("f1_of_means"),
        "zero_queries",
    )


# --- veracity ---------------------------------------------------------------------------------


def unsupported_claims(replies: DataFrame) -> DataFrame:
    """Claims that a marking found no support for, one row each."""
    m = M.marking(F.col("text"))
    claims = let(
        m,
        lambda x: F.when(
            x.isNotNull(),
            M.claims_at(
                F.coalesce(x["summary_claims"], F.array().cast("array<string>")),
                F.transform(
                    F.coalesce(x["unsupported_claim_numbers"], F.array().cast("array<string>")),
                    lambda i: i.try_cast("int"),
                ),
            ),
        ),
    )
    keep = [c for c in replies.columns if c != "text"]
    return replies.select(*keep, F.explode(claims).alias("claim"))


def blinded_claims(pool: DataFrame, seed: int = protocol.SEED) -> DataFrame:
    """Number the pooled claims of every query in a seeded order that does not show their source.

    `pool` holds `query_id, source, claim`. The key's first digits spread a query's claims.
    """
    key = F.md5(F.concat_ws("|", F.lit(str(seed)), "query_id", "source", "claim"))
    numbered = number_in_order(
        pool.withColumn("__h", key), ["query_id"], F.conv(F.substring("__h", 1, 2), 16, 10).cast("int"), [F.col("__h"), F.col("source"), F.col("claim")], "__k"
    )
    return numbered.select(
        F.concat(F.col("query_id"), F.lit("__c"), F.format_string("%02d", F.col("__k") + 1)).alias("claim_id"),
        "query_id",
        "source",
        "claim",
    )


def claim_packets(key: DataFrame, queries: DataFrame) -> DataFrame:
    """What a verifier sees: the claims without their sources. Transcripts are joined by meeting."""
    return key.join(queries.select("query_id", "meeting_id", "query"), "query_id").select(
        "query_id", "meeting_id", "query", "claim_id", "claim"
    )


def veracity(key: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Share of claims true of the transcript per source, void unless the reference's own claims hold.

    Claims without a verdict are left out.
    """
    label = F.col("label")
    counts = [F.count_if(label == name).alias(name.lower()) for name in protocol.VERACITY_LABELS]
    true = label.isin(*protocol.VERACITY_TRUE)
    known = label.isin(*protocol.VERACITY_LABELS)
    rows = (
        key.join(verdicts.select("claim_id", "label").where(label.isNotNull()), "claim_id")
        .groupBy("source")
        .agg(
            F.count(F.lit(1)).alias("n"),
            *counts,
            F.count_if(~known).alias("unlabelled"),
            F.avg(true.cast("double")).alias("true_rate"),
        )
    )
    gold = rows.agg(
        F.coalesce(
            F.max(F.when(F.col("source") == protocol.GOLD_SOURCE, F.round("true_rate", 4))) >= protocol.GOLD_CONTROL_FLOOR,
            F.lit(False),
        ).alias("control_passed")
    )
    # The control is one row.
    return rows.crossJoin(F.broadcast(gold)).withColumn(
        "usable_rate", F.when(F.col("control_passed"), F.col("true_rate"))
    )


# --- probes -----------------------------------------------------------------------------------


def probe_rows(replies: DataFrame, n_facts: int = 1) -> DataFrame:
    """Score marking replies of a probe: whether its fact counts as covered and any claim as supported."""
    facts = replies.select(F.col("text"), *[c for c in replies.columns if c != "text"])
    item = let(M.marking(F.col("text")), lambda m: F.when(m.isNotNull(), M.score_marking(m, F.lit(n_facts))))
    rows = facts.withColumn("__i", item)
    return rows.select(
        *[c for c in replies.columns if c != "text"],
        (F.coalesce(F.col("__i.n_covered"), F.lit(0)) > 0).alias("fact_covered"),
        F.coalesce(F.col("__i.n_claims") > F.col("__i.n_unsupported"), F.lit(False)).alias("any_claim_supported"),
        F.coalesce(F.col("__i.incoherent"), F.lit(False)).alias("incoherent"),
    )


def probe_summary(rows: DataFrame, by: Sequence[str] = ("judge", "condition")) -> DataFrame:
    return rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if("fact_covered").alias("fact_covered"),
        F.count_if("any_claim_supported").alias("claim_supported"),
        F.count_if("incoherent").alias("incoherent"),
    )
