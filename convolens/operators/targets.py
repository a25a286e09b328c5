"""Training data: full-transcript examples, fused spans, per-window targets, span sources."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from convolens import protocol
from convolens.functions import text as T
from convolens.functions.rouge import rouge
from convolens.operators.indexing import number_in_order
from convolens.operators.prompts import zero_shot_prompts
from convolens.operators.retrieval import has_gold, transcript_pairs
from convolens.operators.scoring import guard_prompts
from convolens.operators.windows import BLOCK_LINES
from convolens.session import keep

TRAINING_SPLITS = ("train", "val")
# Lines of a transcript that one step of a running count looks at.
CHUNK_LINES = 4096


def training_queries(queries: DataFrame) -> DataFrame:
    """Queries training data may be built from: never the test split."""
    return queries.where(F.col("split").isin(*TRAINING_SPLITS))


def transcript_examples(utterances: DataFrame, queries: DataFrame, budget: int = protocol.TRANSCRIPT_WORDS) -> DataFrame:
    prompts = zero_shot_prompts(utterances, queries, budget)
    return prompts.join(queries.select("query_id", F.col("reference").alias("response")), "query_id")


def gold_windows(
    utterances: DataFrame, queries: DataFrame, chunk_words: int | None = None, block_lines: int = BLOCK_LINES
) -> DataFrame:
    """Windows that touch a gold span of a query, with the query and its reference."""
    pairs, _ = transcript_pairs(utterances, queries.where(has_gold()), chunk_words, block_lines)
    return pairs.where(F.col("label") == 1).select("query_id", "query", "reference", "start", "n_words", "text")


def span_sources(gold: DataFrame, budget: int = protocol.SPAN_WORDS) -> DataFrame:
    """Gold windows of a query joined in order and cut to the budget.

    A query may mark a whole transcript. Only the windows that begin within the budget reach the
    text, and every window has a word, so the first budget + 1 of them decide it; the running sum
    that finds them is taken per thousand windows first.
    """
    chunk = F.floor(F.col("start") / CHUNK_LINES)
    part = gold.withColumn("__c", chunk)
    sums = part.groupBy("query_id", "__c").agg(F.sum("n_words").alias("w"))
    ahead = W.partitionBy("query_id").orderBy("__c").rowsBetween(W.unboundedPreceding, -1)
    before = sums.select("query_id", "__c", F.coalesce(F.sum("w").over(ahead), F.lit(0)).alias("before"))
    # Chunks that start behind the budget cannot matter; what is left of a query is bounded by it.
    near = part.join(before.where(F.col("before") <= budget), ["query_id", "__c"])
    inside = W.partitionBy("query_id", "__c").orderBy("start").rowsBetween(W.unboundedPreceding, -1)
    head = near.withColumn("__b", F.col("before") + F.coalesce(F.sum("n_words").over(inside), F.lit(0))).where(
        F.col("__b") <= budget
    )
    return (
        head.groupBy("query_id", "query", "reference")
        .agg(F.sort_array(F.collect_list(F.struct("start", "text"))).alias("ws"))
        .select(
            "query_id",
            "query",
            T.truncate_words(F.array_join(F.transform("ws", lambda w: w["text"]), "\n"), budget).alias("source"),
            F.col("reference").alias("target"),
        )
    )


def fusion_examples(sources: DataFrame) -> DataFrame:
    return sources.select(
        "query_id", T.summary_prompt(F.col("query"), F.col("source")).alias("prompt"), F.col("target").alias("response")
    )


def coarse_examples(gold: DataFrame, stemmed: bool = True) -> DataFrame:
    """Per gold window, the reference sentences that it captures best.

    Only for queries with several gold windows. A sentence goes to the window with the highest
    recall of its words, to the first of equals; windows that get no sentence drop out.
    """
    gold = keep(gold)
    pairs = gold.select(
        "query_id", "start", "text", F.posexplode(T.sentences(F.col("reference"))).alias("sent_no", "sentence")
    )
    recall = rouge(F.col("text"), F.col("sentence"), ["rouge1"], stemmed)["rouge1"]["r"]
    scored = pairs.withColumn("recall", recall)
    # The best window of a sentence is an aggregate, so windows of a hot query meet pre-reduced.
    best = scored.groupBy("query_id", "sent_no").agg(
        F.max_by(F.struct("start", "sentence"), F.struct("recall", (-F.col("start")).alias("k"))).alias("b")
    )
    aligned = (
        best.groupBy("query_id", F.col("b.start").alias("start"))
        .agg(F.sort_array(F.collect_list(F.struct("sent_no", F.col("b.sentence").alias("s")))).alias("ss"))
        .withColumn("response", F.array_join(F.transform("ss", lambda x: x["s"]), " "))
    )
    several = gold.groupBy("query_id").agg(F.count(F.lit(1)).alias("n_gold")).where(F.col("n_gold") > 1)
    numbered = number_in_order(gold, ["query_id"], F.floor(F.col("start") / CHUNK_LINES), [F.col("start")], "place")
    hit = aligned.join(numbered, ["query_id", "start"]).join(several, "query_id")
    return hit.select(
        F.concat(F.col("query_id"), F.lit("_w"), F.col("place").cast("string")).alias("query_id"),
        T.summary_prompt(F.col("query"), F.col("text")).alias("prompt"),
        "response",
    )


def rebuilt_prompts(examples: DataFrame, prompts: DataFrame) -> DataFrame:
    """The same examples with prompts from another set; a missing prompt is an error."""
    guard_prompts(examples, prompts)
    return examples.select("query_id", "response").join(prompts.select("query_id", "prompt"), "query_id")


def recipe_mismatches(sources: DataFrame, examples: DataFrame) -> DataFrame:
    """Where span sources and fused examples tell different stories, with the kind of difference."""
    want = T.summary_prompt(F.col("query"), F.col("source"))
    joined = sources.join(examples.select("query_id", "prompt", "response", F.lit(True).alias("__have")), "query_id", "left")
    kinds = F.when(F.col("__have").isNull(), F.array(F.lit("absent"))).otherwise(
        F.filter(
            F.array(
                F.when(~F.col("prompt").eqNullSafe(want), F.lit("prompt")),
                F.when(~F.col("response").eqNullSafe(F.col("target")), F.lit("target")),
            ),
            lambda k: k.isNotNull(),
        )
    )
    return joined.select("query_id", F.explode(kinds).alias("kind"))
