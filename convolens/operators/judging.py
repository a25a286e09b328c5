"""Pairwise judging over stored replies: requests, tallies, agreement, panel and length bias."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from convolens import protocol
from convolens.functions.marking import parse_verdict, winner
from convolens.operators import prompts
from convolens.operators.costs import judge_tag, vendor_of
from convolens.operators.indexing import with_row_index
from convolens.operators.resampling import seeded_sample
from convolens.session import keep

# Judge model per provider.
DEFAULT_JUDGES = {"gpt": "gpt-5.6-sol", "claude": "claude-opus-5", "gemini": "gemini-3.6-flash"}
RUN = ["contestant", "judge_model"]


def judge_sample(a: DataFrame, b: DataFrame, n: int | None = protocol.JUDGE_SAMPLE) -> DataFrame:
    """Queries both systems answered, with the position swap on every second one.

    With n the protocol's seeded sample; without it every shared query.
    """
    shared = keep(a.select("query_id").join(b.select("query_id"), "query_id"))
    if n is None:
        placed = with_row_index(shared, "query_id", "place")
    else:
        placed = seeded_sample(shared, n)
    return placed.select("query_id", (F.col("place") % 2 == 1).alias("swap"))


def judge_requests(sample: DataFrame, queries: DataFrame, a: DataFrame, b: DataFrame, mode: str = "preference") -> DataFrame:
    """Blind prompts; the orientation is part of a reply's cache key."""
    if mode not in ("preference", "grounded"):
        raise ValueError(f"unknown judge mode {mode!r}")
    rows = (
        sample.join(queries.select("query_id", "query", "reference"), "query_id")
        .join(a.select("query_id", F.col("prediction").alias("pa")), "query_id")
        .join(b.select("query_id", F.col("prediction").alias("pb")), "query_id")
    )
    first = F.when(F.col("swap"), F.col("pb")).otherwise(F.col("pa"))
    second = F.when(F.col("swap"), F.col("pa")).otherwise(F.col("pb"))
    prompt = prompts.judge_prompt(F.col("query"), first, second, F.col("reference") if mode == "grounded" else None)
    return rows.select("query_id", "swap", cache_key(F.col("query_id"), F.col("swap")).alias("cache_key"), prompt.alias("prompt"))


def panel_runs(spark: SparkSession, contestants: Sequence[str], judges: Sequence[str], modes: Sequence[str]) -> DataFrame:
    """Every combination of mode, contestant and judge, in the order runs are declared."""
    rows = [(m, c, j) for m in modes for c in contestants for j in judges]
    cols = "mode string, contestant string, judge_model string, run_order int"
    runs = spark.createDataFrame([(*r, k) for k, r in enumerate(rows)], cols)
    return runs.withColumn("run", judge_tag(F.col("contestant"), F.col("judge_model"), F.col("mode")))


def panel_requests(runs: DataFrame, requests: DataFrame) -> DataFrame:
    """The requests of every run; `requests` holds `contestant, mode` beside the prompts.

    The table of runs is a handful of names.
    """
    return requests.join(F.broadcast(runs), ["contestant", "mode"]).withColumn(
        "cache_key", F.concat_ws("/", "run", "cache_key")
    )


def cache_key(query_id: Column, swap: Column) -> Column:
    return F.concat(query_id, F.lit("-"), F.when(swap, "ba").otherwise("ab"))


def pending_requests(requests: DataFrame, replies: DataFrame) -> DataFrame:
    return requests.join(replies.select("cache_key"), "cache_key", "left_anti")


def judge_items(replies: DataFrame, strict: bool = False) -> DataFrame:
    """Stored replies (`query_id, swap, text` and more) with their verdict and winner."""
    v = parse_verdict(F.col("text"))
    return replies.withColumn("verdict", v).withColumn("winner", winner(F.col("verdict"), F.col("swap"), strict))


def judge_tally(items: DataFrame, by: Sequence[str] = RUN) -> DataFrame:
    """Wins, ties, unreadable and truncated replies, and what they cost, per run."""
    w = F.col("winner")
    return (
        items.groupBy(*by)
        .agg(
            F.count(F.lit(1)).alias("n_sampled"),
            F.count_if(w == "a").alias("a_wins"),
            F.count_if(w == "b").alias("b_wins"),
            F.count_if(w == "tie").alias("ties"),
            F.count_if(w.isNull()).alias("unparsed"),
            F.count_if(F.col("truncated")).alias("truncated"),
            F.count_if(F.col("prompt_tokens").isNull() | F.col("completion_tokens").isNull()).alias("entries_without_usage"),
            F.round(F.sum(F.coalesce("cost_usd", F.lit(0.0))), 4).alias("cost_usd"),
        )
        .withColumn("n_decided", F.col("a_wins") + F.col("b_wins") + F.col("ties"))
    )


def self_preference_risk(judge_model: Column, contestant_vendors: Column) -> Column:
    """Whether the judge comes from the vendor of either contestant."""
    vendor = vendor_of(judge_model)
    return F.coalesce(F.array_contains(contestant_vendors, vendor), F.lit(False))


def win_rate(wins: Column, decided: Column) -> Column:
    return wins / F.nullif(decided, F.lit(0))


def kappa_stats(pairs: DataFrame, by: Sequence[str], left: str, right: str, categories: Sequence[str]) -> DataFrame:
    """Raw agreement and Cohen's kappa of two raters: one pass, the counts of a small square."""
    x, y = F.col(left), F.col(right)
    sums = [F.count(F.lit(1)).alias("n_comparable"), F.count_if(x == y).alias("same")]
    for i, c in enumerate(categories):
        sums += [F.count_if(x == c).alias(f"l{i}"), F.count_if(y == c).alias(f"r{i}")]
    n = F.col("n_comparable")
    expected = None
    for i in range(len(categories)):
        term = (F.col(f"l{i}") / n) * (F.col(f"r{i}") / n)
        expected = term if expected is None else expected + term
    observed = F.col("same") / n
    return (
        pairs.groupBy(*by)
        .agg(*sums)
        .withColumn("__e", expected)
        .select(
            *by,
            "n_comparable",
            observed.alias("raw"),
            F.when(F.col("__e") != 1, (observed - F.col("__e")) / (1 - F.col("__e"))).alias("kappa"),
        )
    )


def agreement(items: DataFrame, judge_a: str, judge_b: str, by: Sequence[str] = ("contestant",)) -> DataFrame:
    """Agreement of two judges on the items both decided."""
    pick = lambda judge, name: items.where((F.col("judge_model") == judge) & F.col("winner").isNotNull()).select(
        *by, "query_id", F.col("winner").alias(name)
    )
    both = pick(judge_a, "x").join(pick(judge_b, "y"), [*by, "query_id"])
    return kappa_stats(both, by, "x", "y", ["a", "b", "tie"])


def panel_summary(runs: DataFrame, panel: Sequence[str] = ()) -> DataFrame:
    """Per contestant: the neutral judge's result, the same-vendor judge's, and the gap between them.

    `runs` are tallies with `self_preference_risk` and `run_order`, the order runs were declared in.
    """
    risk = F.col("self_preference_risk")
    cols = ["judge_model", "a_wins", "b_wins", "ties", "unparsed", "n_decided"]
    first = lambda cond: F.min_by(F.struct(*cols), F.when(cond, F.col("run_order")))
    rows = runs.groupBy("contestant").agg(
        F.max(F.when(~risk, 1)).alias("has_clean"),
        F.max(F.when(risk, 1)).alias("has_dirty"),
        first(~risk).alias("c"),
        first(risk).alias("d"),
        F.round(F.sum("cost_usd"), 4).alias("cost_usd"),
        F.min("run_order").alias("first_seen"),
    )
    clean = F.when(F.col("has_clean") == 1, F.col("c"))
    dirty = F.when(F.col("has_dirty") == 1, F.col("d"))
    rows = rows.withColumn("c", clean).withColumn("d", dirty)
    both = F.col("c").isNotNull() & F.col("d").isNotNull()
    rate = lambda side, col: win_rate(F.col(f"{side}.{col}"), F.col(f"{side}.n_decided"))
    place = F.lit(99)
    for i, name in reversed(list(enumerate(panel))):
        place = F.when(F.col("contestant") == name, i).otherwise(place)
    return rows.select(
        "contestant",
        F.col("c.judge_model").alias("clean_judge"),
        F.col("d.judge_model").alias("same_vendor_judge"),
        F.col("c.a_wins").alias("ours_wins"),
        F.col("c.b_wins").alias("theirs_wins"),
        F.col("c.ties").alias("ties"),
        F.col("c.unparsed").alias("unparsed"),
        F.col("c.n_decided").alias("n_decided"),
        rate("c", "a_wins").alias("ours_win_rate"),
        ((F.col("c.a_wins") + F.col("c.ties")) / F.nullif(F.col("c.n_decided"), F.lit(0))).alias("ours_wins_or_ties"),
        F.when(both, rate("c", "b_wins")).alias("contestant_win_rate_clean_judge"),
        F.when(both, rate("d", "b_wins")).alias("contestant_win_rate_same_vendor_judge"),
        F.when(both, rate("d", "b_wins") - rate("c", "b_wins")).alias("self_preference_delta"),
        "cost_usd",
        place.alias("panel_place"),
    )


def panel_totals(summary: DataFrame) -> DataFrame:
    return summary.agg(
        F.count_if(F.col("ours_win_rate") > 0.5).alias("pairs_won"),
        F.count("ours_win_rate").alias("pairs_judged"),
        F.avg("self_preference_delta").alias("mean_self_preference_delta"),
        F.round(F.sum("cost_usd"), 4).alias("total_cost_usd"),
    )


def compare_modes(preference: DataFrame, grounded: DataFrame) -> DataFrame:
    """What showing the judge the reference changes, per contestant."""
    g = grounded.select("contestant", F.col("ours_win_rate").alias("ours_win_rate_grounded"))
    both = preference.join(g, "contestant").where(
        F.col("ours_win_rate").isNotNull() & F.col("ours_win_rate_grounded").isNotNull()
    )
    return both.select(
        "contestant",
        "clean_judge",
        F.col("ours_win_rate").alias("ours_win_rate_preference"),
        "ours_win_rate_grounded",
        (F.col("ours_win_rate_grounded") - F.col("ours_win_rate")).alias("grounding_lift"),
    )


def control_summary(tallies: DataFrame) -> DataFrame:
    """The reference as a contestant: how often it wins."""
    return tallies.select(
        *RUN,
        F.col("a_wins").alias("reference_wins"),
        F.col("b_wins").alias("contestant_wins"),
        "ties",
        "n_decided",
        win_rate(F.col("a_wins"), F.col("n_decided")).alias("reference_win_rate"),
    )


def reference_predictions(queries: DataFrame) -> DataFrame:
    return queries.select("query_id", F.col("reference").alias("prediction"))


def length_bias(
    items: DataFrame,
    ours_words: DataFrame,
    theirs_words: DataFrame,
    by: Sequence[str] = RUN,
    tolerance: int = protocol.LENGTH_TOLERANCE,
) -> DataFrame:
    """How often the longer summary won, where lengths really differ. Word counts are `query_id, n`."""
    rows = (
        items.where(F.col("winner").isin("a", "b"))
        .join(ours_words.select("query_id", F.col("n").alias("la")), "query_id")
        .join(theirs_words.select("contestant", "query_id", F.col("n").alias("lb")), ["contestant", "query_id"])
        .where(F.abs(F.col("la") - F.col("lb")) > tolerance)
    )
    a_longer = (F.col("winner") == "a") & (F.col("la") > F.col("lb"))
    b_longer = (F.col("winner") == "b") & (F.col("lb") > F.col("la"))
    return rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_comparable"),
        F.count_if(a_longer | b_longer).alias("picked_longer"),
        F.avg((a_longer | b_longer).cast("double")).alias("p_picked_longer"),
        F.count_if(a_longer).alias("ours_longer_and_won"),
        F.count_if(b_longer).alias("theirs_longer_and_won"),
    )
