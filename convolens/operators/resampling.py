"""Paired resampling intervals over per-query scores.

A draw takes as many units as there are, with replacement. Units are numbered and cut into blocks; a seeded binomial
tree says how many of a draw's picks fall into each block, and the picks are made inside the block. All of it is
integer and plain floating-point arithmetic on (draw, position), so any engine can repeat it, and what leaves a
block is one sum per draw.

The unit of work is a run of neighbouring blocks, up to GROUP_ROWS units, and a range of draws. Few runs are given to
several tasks, each with other draws; many runs are a task each. A run goes down the tree once for all of its blocks.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from convolens import protocol
from convolens.operators.indexing import (
    averaged_median,
    lower_median_rank,
    order_statistics,
    upper_median_rank,
    with_row_index,
)
from convolens.session import keep

TREE_BLOCK = 65_536
#: Units of smaller blocks that one task takes together.
GROUP_ROWS = 65_536
#: Tasks that few runs of blocks are spread over, by ranges of draws, and no more than so many partitions at once.
TASKS = 32
MAX_PARTITIONS = 4096
#: Picks that a task makes at a time.
AT_ONCE = 1 << 18
PRIME = 2_147_483_647


def hashed(a: Column, b: Column, seed: int) -> Column:
    """A value in 0..PRIME-1 from two integers. Squares break up the lattice of a linear step."""
    p = F.lit(PRIME).cast("bigint")
    x = (a * 48271 + b * 69621 + F.lit(seed % PRIME)) % p
    y = (x * x + a * 16807 + 12345) % p
    z = (y * y + b * 40692 + x) % p
    return (z * 48271 + y) % p


def hashed_sql(a: str, b: str, seed: int) -> str:
    """The same in SQL."""
    x = f"((CAST({a} AS BIGINT) * 48271 + CAST({b} AS BIGINT) * 69621 + {seed % PRIME}) % {PRIME})"
    y = f"(({x} * {x} + CAST({a} AS BIGINT) * 16807 + 12345) % {PRIME})"
    z = f"(({y} * {y} + CAST({b} AS BIGINT) * 40692 + {x}) % {PRIME})"
    return f"(({z} * 48271 + {y}) % {PRIME})"


def hashed_array(a: np.ndarray, b: np.ndarray, seed: int) -> np.ndarray:
    """The same for arrays of 64-bit integers."""
    x = (a * 48271 + b * 69621 + seed % PRIME) % PRIME
    y = (x * x + a * 16807 + 12345) % PRIME
    z = (y * y + b * 40692 + x) % PRIME
    return (z * 48271 + y) % PRIME


def interval_ranks(draws: int, conf: int = 95) -> tuple[int, int]:
    """0-based ranks of the interval's ends among the sorted draws. Fixed value: truncated as the protocol does."""
    return int((100 - conf) / 2 / 100 * draws), int((1 - (100 - conf) / 2 / 100) * draws) - 1


def pair_scores(a: DataFrame, b: DataFrame, key: str = "query_id") -> DataFrame:
    """Scores of two systems on the queries both have."""
    return a.select(key, F.col("score").alias("a")).join(b.select(key, F.col("score").alias("b")), key)


def with_clusters(scores: DataFrame, clusters: DataFrame, key: str = "query_id") -> DataFrame:
    """Attach cluster ids; a score without one fails the query."""
    joined = scores.join(clusters.select(key, F.col("cluster_id").alias("__c")), key, "left")
    fail = F.raise_error(F.concat(F.lit("no cluster for "), F.col(key).cast("string"))).cast("string")
    return joined.withColumn("cluster_id", F.when(F.col("__c").isNull(), fail).otherwise(F.col("__c").cast("string"))).drop("__c")


# --- drawing ----------------------------------------------------------------------------------


def _split(draws: np.ndarray, node: int, picks: np.ndarray, share: float, seed: int) -> np.ndarray:
    """How many of each draw's picks go to a node's first half: binomial, as a normal of twelve hashed uniforms."""
    z = sum(hashed_array(draws * 16 + j, np.int64(node), seed + 1) / PRIME for j in range(12)) - 6.0
    near = np.floor(picks * share + z * np.sqrt(picks * share * (1.0 - share)) + 0.5)
    return np.clip(near, 0, picks).astype(np.int64)


def _tree_shares(
    seed: int, n_rows: int, n_blocks: int, blocks: range, every: np.ndarray, size: int
) -> Iterator[tuple[int, np.ndarray]]:
    """For each of some neighbouring blocks, in order: how many of a draw's n_rows picks fall into it, for some draws.

    Splits depend on their place alone, so every task finds the same ones on its own; one above several blocks is made
    once for all of them. A node is its first block times 2^20 plus its last.
    """
    rows = lambda lo, hi: min(hi * size, n_rows) - lo * size
    # Only the way down is held: the halves still to come, a few for each level.
    todo = [(0, n_blocks, np.full(len(every), n_rows, dtype=np.int64))]
    while todo:
        lo, hi, here = todo.pop()
        if hi <= blocks.start or lo >= blocks.stop:
            continue
        if hi - lo == 1:
            yield lo, here
            continue
        mid = (lo + hi) // 2
        first = _split(every, lo * (1 << 20) + hi, here, rows(lo, mid) / rows(lo, hi), seed)
        todo += [(mid, hi, here - first), (lo, mid, first)]


def _tree_share(seed: int, n_rows: int, n_blocks: int, block: int, every: np.ndarray, size: int) -> np.ndarray:
    """How many of a draw's n_rows picks fall into one block, for each of some draws."""
    return next(_tree_shares(seed, n_rows, n_blocks, range(block, block + 1), every, size))[1]


def draw_sums(units: DataFrame, key: str, values: Sequence[str], draws: int, seed: int, block: int = TREE_BLOCK) -> DataFrame:
    """Sums of each value over as many units, drawn with replacement, as there are; one row per draw."""
    n = units.count()
    if n == 0:
        raise ValueError("nothing to resample: the two systems share no query")
    indexed = with_row_index(units, key, rows=n).select("idx", *values)
    n_blocks = -(-n // block)
    # Small blocks go together, so a sum of each draw leaves a task once for many blocks.
    per = max(1, GROUP_ROWS // block)
    n_groups = -(-n_blocks // per)
    names = list(values)

    spread = max(1, min(draws, -(-TASKS // n_groups)))

    def resample(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        group, part = int(key[0]), int(key[1])
        inside = rows.sort_values("idx")[names].to_numpy(dtype=np.float64)
        every = np.arange(part * draws // spread, (part + 1) * draws // spread, dtype=np.int64)
        out = np.zeros((len(every), len(names)))
        blocks = range(group * per, min((group + 1) * per, n_blocks))
        for here, share in _tree_shares(seed, n, n_blocks, blocks, every, block):
            data = inside[(here - blocks.start) * block : (here - blocks.start + 1) * block]
            ends = np.cumsum(share)
            first = 0
            while first < len(every):
                last = max(first + 1, int(np.searchsorted(ends, ends[first] - share[first] + AT_ONCE, side="right")))
                own = share[first:last]
                start = np.cumsum(own) - own
                # Positions of different blocks do not meet: a block's picks stay below four times its size.
                at = np.arange(int(own.sum()), dtype=np.int64) - np.repeat(start, own) + here * 4 * block
                some = np.flatnonzero(own)
                if len(some):
                    picked = data[hashed_array(np.repeat(every[first:last], own), at, seed) % len(data)]
                    out[first + some] += np.add.reduceat(picked, start[some], axis=0)
                first = last
        frame = pd.DataFrame(out, columns=names)
        frame.insert(0, "draw", every)
        return frame

    schema = "draw bigint, " + ", ".join(f"{v} double" for v in names)
    ranges = F.explode(F.sequence(F.lit(0), F.lit(spread - 1)))
    parts = indexed.withColumn("__group", F.floor(F.col("idx") / (block * per))).withColumn("__part", ranges)
    # The narrow rows are too small for the optimizer to deal out by the work that they make.
    parts = parts.repartition(min(n_groups * spread, MAX_PARTITIONS), "__group", "__part")
    parts = parts.groupBy("__group", "__part").applyInPandas(resample, schema)
    return parts.groupBy("draw").agg(*[F.sum(v).alias(v) for v in names])


def _interval(sums: DataFrame, diff: Column, draws: int, conf: int) -> DataFrame:
    """One row from one value per draw; the number of draws is a parameter, not data."""
    lo, hi = interval_ranks(draws, conf)
    return (
        sums.select(diff.alias("d"))
        .agg(F.sort_array(F.collect_list("d")).alias("ds"), F.count_if(F.col("d") > 0).alias("wins"))
        .select(
            F.get("ds", F.lit(lo)).alias(f"ci{conf}_low"),
            F.get("ds", F.lit(hi)).alias(f"ci{conf}_high"),
            (F.col("wins") / draws).alias("p_b_better"),
        )
    )


def _observed(scores: DataFrame) -> DataFrame:
    diff = F.col("b") - F.col("a")
    stats = scores.agg(
        F.count(F.lit(1)).alias("n_shared"),
        F.avg("a").alias("a_mean"),
        F.avg("b").alias("b_mean"),
        (F.avg("b") - F.avg("a")).alias("observed_diff"),
        F.count_if(diff > 0).alias("per_query_b_wins"),
        F.count_if(diff < 0).alias("per_query_a_wins"),
        F.count_if(diff == 0).alias("per_query_ties"),
    )
    mid = order_statistics(
        scores.select(F.abs(diff).alias("d")), [], "d", {"lower": lower_median_rank(), "upper": upper_median_rank()}
    ).select(averaged_median("lower", "upper").alias("median_abs_per_query_diff"))
    return stats.crossJoin(mid)


def paired_bootstrap(
    scores: DataFrame,
    draws: int = protocol.BOOTSTRAP_DRAWS,
    seed: int = protocol.SEED,
    conf: int = 95,
    block: int = TREE_BLOCK,
    key: str = "query_id",
) -> DataFrame:
    """Interval of mean(b) - mean(a), resampling queries. One row."""
    scores = keep(scores.select(key, "a", "b"))
    sums = draw_sums(scores.select(key, (F.col("b") - F.col("a")).alias("d"), F.lit(1.0).alias("one")), key, ["d", "one"], draws, seed, block)
    out = _observed(scores).crossJoin(_interval(sums, F.col("d") / F.col("one"), draws, conf))
    lo, hi = f"ci{conf}_low", f"ci{conf}_high"
    return out.withColumn("crosses_zero", (F.col(lo) <= 0) & (F.col(hi) >= 0))


def paired_cluster_bootstrap(
    scores: DataFrame,
    draws: int = protocol.BOOTSTRAP_DRAWS,
    seed: int = protocol.SEED,
    conf: int = 95,
    block: int = TREE_BLOCK,
) -> DataFrame:
    """The same, resampling whole clusters; a draw's statistic is the mean over its queries.

    Clusters are summed first, so one that holds a third of all queries is still one row.
    """
    scores = keep(scores.select("cluster_id", "a", "b"))
    clusters = scores.groupBy("cluster_id").agg(
        F.sum(F.col("b") - F.col("a")).alias("d"), F.count(F.lit(1)).cast("double").alias("m")
    )
    sums = draw_sums(clusters, "cluster_id", ["d", "m"], draws, seed, block)
    out = (
        _observed(scores)
        .crossJoin(clusters.agg(F.count(F.lit(1)).alias("n_clusters")))
        .crossJoin(_interval(sums, F.col("d") / F.col("m"), draws, conf))
    )
    lo, hi = f"ci{conf}_low", f"ci{conf}_high"
    return out.withColumn("crosses_zero", (F.col(lo) <= 0) & (F.col(hi) >= 0))


# --- subsamples without replacement -----------------------------------------------------------


#: Rounds of the permutation; each mixes one half of a number into the other.
ROUNDS = 4


def permuted(draw: np.ndarray, position: np.ndarray, n: int, seed: int) -> np.ndarray:
    """Where a draw's own permutation of 0..n-1 takes each position.

    A Feistel network permutes the square of the least side that holds n; what falls beyond n walks on along its
    cycle until it is below. Equal draws and different positions never meet, and every number can be reached.
    """
    side = math.isqrt(max(n - 1, 0)) + 1
    x = position.astype(np.int64)
    todo = np.arange(len(x))
    while len(todo):
        left, right = x[todo] // side, x[todo] % side
        for k in range(ROUNDS):
            left, right = right, (left + hashed_array(draw[todo].astype(np.int64) * ROUNDS + k, right, seed)) % side
        x[todo] = left * side + right
        todo = todo[x[todo] >= n]
    return x


def permuted_sql(positions: str, seed: int) -> str:
    """CTE `picks` (draw, idx) of the rows (draw, pos, n) of `positions`, for a recursive WITH."""
    step = "SELECT draw, pos, n, side, x // side AS l, x % side AS r FROM walk WHERE moved = 0 OR x >= n"
    for k in range(ROUNDS):
        step = f"SELECT draw, pos, n, side, r AS l, (l + {hashed_sql(f'(draw * {ROUNDS} + {k})', 'r', seed)}) % side AS r FROM ({step})"
    return f"""
        walk(draw, pos, n, side, x, moved) AS (
          SELECT draw, pos, n, CAST(ceil(sqrt(n)) AS BIGINT), pos, 0 FROM {positions}
          UNION ALL
          SELECT draw, pos, n, side, l * side + r, 1 FROM ({step})),
        picks AS (SELECT draw, x AS idx FROM walk WHERE moved = 1 AND x < n)"""


def subsample_distribution(
    scores: DataFrame,
    k: int,
    draws: int = protocol.BOOTSTRAP_DRAWS,
    seed: int = protocol.SEED,
    thresholds: Sequence[float] = protocol.SUBSAMPLE_THRESHOLDS,
    key: str = "query_id",
) -> DataFrame:
    """Means of k-query subsets: their spread, and the share of subsets above each threshold.

    A draw's subset is the first k places of its permutation. The picks number draws x k whatever the run's size, so
    they go to the scores and not the other way round. The upper end has no -1 here, unlike the bootstrap.
    """
    scores = keep(scores.select(key, "score"))
    n = scores.count()
    if n < k:
        raise ValueError(f"only {n} scores, {k} needed")
    indexed = with_row_index(scores, key, rows=n)

    @F.pandas_udf("bigint")
    def place(draw: pd.Series, position: pd.Series) -> pd.Series:
        return pd.Series(permuted(draw.to_numpy(), position.to_numpy(), n, seed))

    picks = scores.sparkSession.range(draws).select(F.col("id").alias("draw"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(k - 1).cast("long"))).alias("position"))
    picks = picks.select("draw", place("draw", "position").alias("idx"))
    means = picks.join(indexed.select("idx", "score"), "idx").groupBy("draw").agg(F.avg("score").alias("m"))
    lo, hi = int(0.025 * draws), int(0.975 * draws)
    return scores.agg(F.count(F.lit(1)).alias("n"), F.avg("score").alias("full_mean")).crossJoin(
        means.agg(
            F.avg("m").alias("draw_mean"),
            F.sort_array(F.collect_list("m")).alias("ms"),
            *[F.avg((F.col("m") > t).cast("double")).alias(f"above_{t:.3f}".replace(".", "_")) for t in thresholds],
        )
        .withColumn("low", F.get("ms", F.lit(lo)))
        .withColumn("high", F.get("ms", F.lit(hi)))
        .withColumn("min", F.array_min("ms"))
        .withColumn("max", F.array_max("ms"))
        .drop("ms")
    )


def sample_key(seed: int, key: Column) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")))


def seeded_sample(ids: DataFrame, n: int, seed: int = protocol.SEED, key: str = "query_id") -> DataFrame:
    """n ids, or all if there are fewer, by a seeded hash, with each one's place among them in order of id.

    Which ids are taken depends on the seed and the ids alone. No more than n rows leave a task.
    """
    taken = ids.orderBy(sample_key(seed, F.col(key)), key).limit(n)
    return taken.withColumn("place", (F.row_number().over(W.orderBy(key)) - 1).cast("int"))


# --- declared comparisons ---------------------------------------------------------------------


def interval_records(
    scores: DataFrame,
    comparisons: Sequence[dict],
    clusters: DataFrame | None = None,
    draws: int = protocol.BOOTSTRAP_DRAWS,
    seed: int = protocol.SEED,
    block: int = TREE_BLOCK,
) -> DataFrame:
    """One row per declared comparison `{a, b, metric, split, resampling_unit?, label?}`.

    `scores` holds `run_id, metric, split, query_id, score`; every run is scored once and kept.
    """
    scores = keep(scores)
    out = None
    for c in comparisons:
        here = scores.where((F.col("metric") == c["metric"]) & (F.col("split") == c["split"]))
        pair = pair_scores(here.where(F.col("run_id") == c["a"]), here.where(F.col("run_id") == c["b"]))
        unit = c.get("resampling_unit", "query")
        if unit == "meeting":
            rec = paired_cluster_bootstrap(with_clusters(pair, clusters), draws, seed, block=block)
        else:
            rec = paired_bootstrap(pair, draws, seed, block=block).withColumn("n_clusters", F.lit(None).cast("bigint"))
        rec = rec.select(
            F.lit(c["a"]).alias("run_a"),
            F.lit(c["b"]).alias("run_b"),
            F.lit(c.get("label", "")).alias("label"),
            F.lit(c["metric"]).alias("metric"),
            F.lit(c["split"]).alias("split"),
            F.lit(unit).alias("resampling_unit"),
            F.lit(draws).alias("draws"),
            F.lit(seed).cast("bigint").alias("seed"),
            *sorted(rec.columns),
        )
        out = rec if out is None else out.unionByName(rec)
    return out


def interval_index(records: DataFrame) -> DataFrame:
    """All records by metric, the largest difference first."""
    return records.orderBy("metric", F.desc("observed_diff"))
