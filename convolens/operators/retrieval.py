"""Score, rank and pack transcript windows for a query, and measure what the packing recalls."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from convolens import protocol
from convolens.functions.text import alnum_tokens, let, summary_prompt, truncate_words
from convolens.operators.indexing import bucket_of, number_in_order, range_cuts
from convolens.operators.windows import BLOCK_LINES, build_windows, is_multi_block
from convolens.session import keep

# Windows of one transcript that one task may see when transcripts are long enough to need it.
HOT_WINDOWS = 256
# Queries of one transcript that one task may see.
CROWD = 512

Scorer = Callable[[DataFrame], DataFrame]


def overlaps_gold(start: Column, end: Column, gold_spans: Column) -> Column:
    """Whether an inclusive line range touches any gold span."""
    return F.exists(gold_spans, lambda g: ~((end < g["s"]) | (start > g["e"])))


def has_gold() -> Column:
    return (F.col("query_type") == "specific") & (F.size("gold_spans") > 0)


def is_crowded(queries: DataFrame) -> bool:
    """Whether any transcript has so many queries that one task should not see them all."""
    most = queries.groupBy("meeting_id").count().agg(F.max("count")).first()[0]
    return most is not None and most > CROWD


def query_windows(windows: DataFrame, queries: DataFrame, hot: bool = False, crowded: bool = False) -> DataFrame:
    """Every query with every window of its own transcript, labelled by gold overlap.

    Windows are built once per transcript and only then meet the queries. When some transcripts are
    `hot`, their windows go to several tasks and the few queries are copied to each. When some are
    `crowded`, their queries go to several tasks and the windows of those transcripts are copied.
    """
    own = [c for c in ("__qv",) if c in queries.columns]
    q = queries.select("query_id", "meeting_id", "query_type", "query", "reference", "gold_spans", *own)
    # Tokens once per query and once per window; what no scorer reads is pruned.
    q = q.withColumn("__q", F.array_distinct(alnum_tokens(F.col("query"))))
    w = windows.withColumn("__w", F.array_distinct(alnum_tokens(F.col("text"))))
    keys = ["meeting_id"]
    if hot:
        # Each transcript by its own number of parts: short ones stay whole.
        salts = windows.groupBy("meeting_id").agg(F.ceil(F.count(F.lit(1)) / HOT_WINDOWS).cast("int").alias("salts"))
        w = w.join(salts, "meeting_id").withColumn("salt", F.col("win_idx") % F.col("salts")).drop("salts")
        q = q.join(salts, "meeting_id").withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).drop("salts")
        keys.append("salt")
    if crowded:
        parts = (
            queries.groupBy("meeting_id")
            .agg(F.ceil(F.count(F.lit(1)) / CROWD).cast("int").alias("parts"))
            .where(F.col("parts") > 1)
        )
        n = F.coalesce("parts", F.lit(1))
        q = q.join(parts, "meeting_id", "left").withColumn("part", F.pmod(F.xxhash64("query_id"), n)).drop("parts")
        w = (
            w.join(parts, "meeting_id", "left")
            .withColumn("part", F.explode(F.sequence(F.lit(0).cast("bigint"), n.cast("bigint") - 1)))
            .drop("parts")
        )
        keys.append("part")
    joined = w.join(q, keys)
    if not hot:
        joined = joined.withColumn("salt", F.lit(0))
    if not crowded:
        joined = joined.withColumn("part", F.lit(0).cast("bigint"))
    label = F.when(has_gold(), overlaps_gold(F.col("start"), F.col("end"), F.col("gold_spans"))).otherwise(False)
    return joined.withColumn("label", label.cast("int"))


def locator_pairs(pairs: DataFrame) -> DataFrame:
    """Labelled training pairs: specific queries with gold spans only."""
    return pairs.where(has_gold()).select("query", "text", "label", "query_id", "start", "end")


# --- scorers: a DataFrame of (query, window) pairs in, the same with `score` out ---------------


def lexical_scorer(pairs: DataFrame) -> DataFrame:
    """Distinct shared tokens. The deterministic stand-in where no model is at hand."""
    return pairs.withColumn("score", F.size(F.array_intersect("__q", "__w")).cast("double")).drop("__q", "__w")


def model_scorer(load: Callable[[], Callable[[list[str], list[str]], Sequence[float]]], name: str) -> Scorer:
    """Wrap a cross-encoder: `load` runs once per Python worker and name, then scores Arrow batches."""

    def score(pairs: DataFrame) -> DataFrame:
        @F.pandas_udf("double")
        def predict(query: pd.Series, text: pd.Series) -> pd.Series:
            from convolens.functions import plugins

            model = plugins.once(name, load)
            return pd.Series(model(query.tolist(), text.tolist()), dtype="float64")

        return pairs.drop("__q", "__w").withColumn("score", predict("query", "text"))

    return score


def _dot(x: Column, y: Column) -> Column:
    return F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors: dot product over the product of their lengths."""
    return _dot(a, b) / F.sqrt(_dot(a, a) * _dot(b, b))


def with_vectors(rows: DataFrame, vectors: DataFrame, keys: list[str], name: str) -> DataFrame:
    """The rows that have a stored vector without nulls, with it and its square as the struct `name`.

    Vectors meet windows and queries before those meet each other, so no pair is shuffled for them.
    """
    whole = F.col("vector").isNotNull() & ~F.exists("vector", lambda x: x.isNull())
    own = vectors.where(whole).select(*keys, F.struct("vector", _dot(F.col("vector"), F.col("vector")).alias("square")).alias(name))
    return rows.join(own, keys)


def embedding_scorer(pairs: DataFrame) -> DataFrame:
    """Cosine of the vectors that `locate` was given; 0 where one of them has no length or their lengths differ."""
    w, q = F.col("__wv"), F.col("__qv")
    usable = (w["square"] > 0) & (q["square"] > 0) & (F.size(w["vector"]) == F.size(q["vector"]))
    score = F.when(usable, _dot(w["vector"], q["vector"]) / F.sqrt(q["square"] * w["square"])).otherwise(0.0)
    return pairs.withColumn("score", score).drop("__q", "__w", "__qv", "__wv")


def rank_windows(scored: DataFrame, hot: bool = False) -> DataFrame:
    """Rank within a query, best first; of equal scores the later window ranks higher.

    For `hot` transcripts a query's windows are cut into score ranges, and a range that holds one
    score only into stretches of lines; each piece is numbered apart.
    """
    best_first = [F.desc("score"), F.desc("start")]
    if not hot:
        return scored.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(*best_first)).cast("bigint"))
    cuts = range_cuts(scored, "score")
    own = {a for a, b in zip(cuts, cuts[1:]) if b == math.nextafter(a, math.inf)}
    stretch = F.when(F.col("score").isin(*own), F.floor(F.col("start") / BLOCK_LINES)).otherwise(0) if own else F.lit(0)
    # Higher ranges, and within one score later lines, come first.
    bucket = -(bucket_of(F.col("score"), cuts).cast("bigint") * F.lit(2**40) + stretch)
    return number_in_order(scored, ["query_id"], bucket, best_first, "rank").withColumn("rank", F.col("rank") + 1)


# --- packing ----------------------------------------------------------------------------------


def _prune(scored: DataFrame, budget: int) -> DataFrame:
    """Drop windows that packing can never take, without changing what it takes.

    Room only shrinks while packing. So of all windows of one length n it takes the best few,
    never skipping one, and no more than budget / n of them. (A window longer than the whole
    budget is taken only if it is the very first.) Keeping that many per length, first within
    each salt and then within the query, bounds a query's candidates by its budget alone.
    """
    most = F.greatest(F.floor(F.lit(budget) / F.col("n_words")), F.lit(1))
    order = [F.desc("score"), F.desc("start")]
    near = F.row_number().over(W.partitionBy("query_id", "salt", "n_words").orderBy(*order))
    kept = scored.withColumn("__r", near).where(F.col("__r") <= most)
    far = F.row_number().over(W.partitionBy("query_id", "n_words").orderBy(*order))
    return kept.withColumn("__r", far).where(F.col("__r") <= most).drop("__r")


def _greedy_pack(ranked: Column, budget: Column) -> Column:
    """Starts taken from windows in rank order: the first always, later ones while they fit."""
    empty = F.struct(F.array().cast("array<int>").alias("starts"), F.lit(0).alias("used"))

    def step(acc: Column, x: Column) -> Column:
        fits = (F.size(acc["starts"]) == 0) | (acc["used"] + x["n_words"] <= budget)
        return F.struct(
            F.when(fits, F.concat(acc["starts"], F.array(x["start"]))).otherwise(acc["starts"]).alias("starts"),
            F.when(fits, acc["used"] + x["n_words"]).otherwise(acc["used"]).alias("used"),
        )

    return F.aggregate(ranked, empty, step)


def pack_windows(
    scored: DataFrame, budgets: int | Sequence[int] | None = None, hot: bool = False
) -> DataFrame:
    """One row per query and budget with the packed windows in transcript order.

    Columns: `query_id, meeting_id, query, query_type, reference, gold_spans, budget, n_windows,
    n_gold, n_lines, used_words, picks`. Several budgets share one ranking.
    """
    asked = [protocol.SPAN_WORDS] if budgets is None else [budgets] if isinstance(budgets, int) else list(budgets)
    # `part` follows from the query; it only keeps the rows where the join has put them.
    keys = ["meeting_id", "part", "query_id"]
    item = F.struct("score", "start", "end", "n_words", "label", "text")
    totals = [
        F.count(F.lit(1)).alias("n_windows"),
        F.sum("label").alias("n_gold"),
        (F.max("end") + 1).alias("n_lines"),
        *[F.first(c).alias(c) for c in ("query", "query_type", "reference", "gold_spans")],
    ]
    ranked = F.sort_array(F.collect_list(item), asc=False).alias("ranked")
    if hot:
        rows = scored.groupBy(*keys).agg(*totals).join(
            _prune(scored, max(asked)).groupBy(*keys).agg(ranked), keys
        )
    else:
        # Every transcript fits one block here, so its windows for a query are one bounded array.
        rows = scored.groupBy(*keys).agg(*totals, ranked)
    rows = rows.withColumn("budget", F.explode(F.array(*[F.lit(b) for b in asked])))

    def chosen(fold: Column) -> Column:
        return F.struct(
            fold["used"].alias("used"),
            F.array_sort(
                F.transform(
                    F.filter("ranked", lambda x: F.array_contains(fold["starts"], x["start"])),
                    lambda x: F.struct(x["start"], x["end"], x["n_words"], x["score"], x["label"], x["text"]),
                )
            ).alias("picks"),
        )

    packed = rows.withColumn("__p", let(_greedy_pack(F.col("ranked"), F.col("budget")), chosen))
    return packed.select(
        "query_id",
        "meeting_id",
        "query",
        "query_type",
        "reference",
        "gold_spans",
        "budget",
        "n_windows",
        "n_gold",
        "n_lines",
        F.col("__p.used").alias("used_words"),
        F.col("__p.picks").alias("picks"),
    )


def transcript_pairs(
    utterances: DataFrame,
    queries: DataFrame,
    chunk_words: int | None = None,
    block_lines: int = BLOCK_LINES,
    vectors: tuple[DataFrame, DataFrame] | None = None,
) -> tuple[DataFrame, bool]:
    """Labelled (query, window) pairs, spread as the transcripts need it, and whether any is hot.

    `vectors` are those of windows, `(meeting_id, start, vector)`, and of queries, `(query_id, vector)`; windows and
    queries without one then take no part.
    """
    hot = is_multi_block(utterances, chunk_words or protocol.CHUNK_WORDS, block_lines)
    wins = build_windows(utterances, chunk_words, block_lines, multi=hot)
    if vectors:
        wins = with_vectors(wins, vectors[0], ["meeting_id", "start"], "__wv")
        queries = with_vectors(queries, vectors[1], ["query_id"], "__qv")
    return query_windows(wins, queries, hot, is_crowded(queries)), hot


def locate(
    utterances: DataFrame,
    queries: DataFrame,
    scorer: Scorer = lexical_scorer,
    chunk_words: int | None = None,
    budgets: int | Sequence[int] | None = None,
    block_lines: int = BLOCK_LINES,
    vectors: tuple[DataFrame, DataFrame] | None = None,
) -> DataFrame:
    """Windows, scores and packing in one go; `vectors` are for `embedding_scorer`."""
    pairs, hot = transcript_pairs(utterances, queries, chunk_words, block_lines, vectors)
    return pack_windows(scorer(pairs), budgets, hot)


def packed_text(budget: Column | None = None) -> Column:
    """The packed windows as one text, cut to the budget once more after joining."""
    joined = F.array_join(F.transform("picks", lambda p: p["text"]), "\n")
    return truncate_words(joined, F.col("budget") if budget is None else budget)


def packed_prompts(packed: DataFrame) -> DataFrame:
    return packed.select("query_id", summary_prompt(F.col("query"), packed_text()).alias("prompt"))


# --- recall -----------------------------------------------------------------------------------


def window_recall(packed: DataFrame) -> DataFrame:
    """Share of a query's gold windows that were packed, for queries that have any."""
    got = F.size(F.filter("picks", lambda p: p["label"] == 1))
    return packed.where(has_gold() & (F.col("n_gold") > 0)).select(
        "query_id",
        "budget",
        (got / F.col("n_gold")).alias("recall"),
        F.col("n_gold").cast("bigint").alias("n_gold"),
        F.size("picks").cast("bigint").alias("n_picked"),
    )


def recall_skips(packed: DataFrame) -> DataFrame:
    """How many queries have no defined recall, by reason, and the macro average of the rest."""
    scored = has_gold() & (F.col("n_gold") > 0)
    got = F.size(F.filter("picks", lambda p: p["label"] == 1))
    return packed.groupBy("budget").agg(
        F.count_if(~has_gold()).alias("skipped_general"),
        F.count_if(has_gold() & (F.col("n_gold") == 0)).alias("skipped_no_gold_window"),
        F.count_if(scored).alias("n_scored"),
        F.avg(F.when(scored, got / F.col("n_gold"))).alias("mean_recall"),
    )


def _merged(spans: Column, last_line: Column) -> Column:
    """Spans clipped to the transcript, sorted, and joined where they touch."""
    clipped = F.filter(
        F.transform(spans, lambda g: F.struct(g["s"].alias("s"), F.least(g["e"], last_line).alias("e"))),
        lambda g: g["s"] <= g["e"],
    )
    none = F.array().cast("array<struct<s:int,e:int>>")

    def step(acc: Column, x: Column) -> Column:
        top = F.get(acc, F.size(acc) - 1)
        touches = (F.size(acc) > 0) & (x["s"] <= top["e"] + 1)
        grown = F.struct(top["s"].alias("s"), F.greatest(top["e"], x["e"]).alias("e"))
        return F.when(touches, F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(grown))).otherwise(
            F.concat(acc, F.array(x))
        )

    return F.aggregate(F.array_sort(clipped), none, step)


def _line_counts() -> Column:
    """Gold lines of a packed row, and how many of them were packed.

    Ranges are intersected as ranges, so a span over a whole transcript costs no more than a short one.
    """
    width = lambda g: g["e"] - g["s"] + 1
    shared = lambda g, p: F.greatest(F.least(g["e"], p["end"]) - F.greatest(g["s"], p["start"]) + 1, F.lit(0))
    total = lambda xs, f: F.aggregate(F.transform(xs, f), F.lit(0), lambda a, v: a + v)
    # `let` reads the merged spans once; a plain column would be spelled out at every use.
    return let(
        _merged(F.col("gold_spans"), F.col("n_lines") - 1),
        lambda m: F.struct(
            total(m, width).alias("gold"),
            total(m, lambda g: total(F.col("picks"), lambda p: shared(g, p))).alias("got"),
        ),
    )


def utterance_recall(packed: DataFrame) -> DataFrame:
    """Share of gold lines inside the packed windows; comparable between window sizes."""
    return (
        packed.where(has_gold())
        .withColumn("__c", _line_counts())
        .where(F.col("__c.gold") > 0)
        .select(
            "query_id",
            "budget",
            (F.col("__c.got") / F.col("__c.gold")).alias("recall"),
            F.col("__c.gold").cast("bigint").alias("n_gold_lines"),
        )
    )


def mean_recalls(packed: DataFrame) -> DataFrame:
    """Both recalls per budget in one pass, each over the queries that define it."""
    hits = F.size(F.filter("picks", lambda p: p["label"] == 1))
    rows = packed.where(has_gold()).select(
        "budget", (hits / F.nullif(F.col("n_gold"), F.lit(0))).alias("w"), _line_counts().alias("c")
    )
    return rows.groupBy("budget").agg(
        F.avg("w").alias("window_recall"),
        F.avg(F.col("c.got") / F.nullif(F.col("c.gold"), F.lit(0))).alias("utterance_recall"),
    )


def locator_sweep(
    utterances: DataFrame,
    queries: DataFrame,
    variants: dict[str, tuple[int | None, Scorer]],
    budgets: Sequence[int] = protocol.SWEEP_BUDGETS,
    base: str = "base",
) -> DataFrame:
    """Both recalls of every variant and budget, and the line-recall gain over the base variant."""
    parts = None
    for name, (chunk_words, scorer) in variants.items():
        means = mean_recalls(locate(utterances, queries, scorer, chunk_words, budgets))
        part = means.select(
            F.lit(name).alias("variant"),
            F.lit(chunk_words or protocol.CHUNK_WORDS).alias("chunk_words"),
            "budget",
            "window_recall",
            "utterance_recall",
        )
        parts = part if parts is None else parts.unionByName(part)
    # One row per variant and budget.
    parts = keep(parts)
    ref = parts.where(F.col("variant") == base).select("budget", F.col("utterance_recall").alias("__base"))
    return parts.join(ref, "budget", "left").withColumn("gain", F.col("utterance_recall") - F.col("__base")).drop("__base")


# --- stored vectors without transcripts -------------------------------------------------------


def top_vectors(queries: DataFrame, vectors: DataFrame, by: str, k: int, salts: int = 16) -> DataFrame:
    """The k nearest stored vectors of every query in its own group, the later id first on ties.

    Groups are salted: each salt keeps its best k before the query's best k are chosen.
    """
    q = queries.select(by, "query_id", F.col("vector").alias("__q"))
    v = vectors.withColumn("salt", F.pmod(F.xxhash64("vec_id"), F.lit(salts)).cast("int"))
    scored = (
        v.join(q.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))), [by, "salt"])
        .where(F.col("vec_id") != F.col("query_id"))
        .withColumn("score", cosine(F.col("__q"), F.col("vector")))
        .select("query_id", "vec_id", "salt", "score")
    )
    order = [F.desc("score"), F.desc("vec_id")]
    near = scored.withColumn("r", F.row_number().over(W.partitionBy("query_id", "salt").orderBy(*order))).where(
        F.col("r") <= k
    )
    return (
        near.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(*order)))
        .where(F.col("rank") <= k)
        .select("query_id", "vec_id", "rank", "score")
    )
