"""Dense row numbers and exact order statistics that never sort a whole table in one task."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from convolens.session import keep

# Up to this many rows one sorted task is cheaper than two passes.
SMALL_ROWS = 200_000
# Beyond it every bucket is sized to hold about this many rows.
BUCKET_ROWS = 1_000_000
MAX_BUCKETS = 4096


def _boundaries(df: DataFrame, key: str, rows: int) -> list:
    """Sorted split points taken from a hash sample of the keys, so they do not depend on partitioning."""
    wanted = min(MAX_BUCKETS, max(8, rows // BUCKET_ROWS))
    keep_one_in = max(1, rows // (wanted * 8))
    sample = (
        df.select(key)
        .where(F.pmod(F.xxhash64(key), F.lit(keep_one_in)) == 0)
        .distinct()
        .collect()
    )
    keys = sorted(r[0] for r in sample)
    step = max(1, len(keys) // wanted)
    return keys[step::step]


def bucket_of(key: Column, boundaries: Sequence) -> Column:
    """How many boundaries are not above the key, by bisection; 0 for NULL."""

    def halves(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(key < F.lit(boundaries[mid]), halves(lo, mid)).otherwise(halves(mid + 1, hi))

    return F.when(key.isNull(), 0).otherwise(halves(0, len(boundaries)))


def with_row_index(
    df: DataFrame, key: str, name: str = "idx", small_rows: int = SMALL_ROWS, rows: int | None = None
) -> DataFrame:
    """Add 0..n-1 in the order of a unique key.

    A small table is numbered in one sorted task. A large one is split at boundaries taken from
    its own keys: every bucket is numbered apart and shifted by the sizes of the buckets before it.
    """
    if rows is None:
        rows = df.count()
    if rows <= small_rows:
        return df.withColumn(name, (F.row_number().over(W.orderBy(key)) - 1).cast("bigint"))
    cuts = _boundaries(df, key, rows)
    bucketed = df.withColumn("__bucket", bucket_of(F.col(key), cuts))
    sizes = {r["__bucket"]: r["count"] for r in bucketed.groupBy("__bucket").count().collect()}
    shift, before = [], 0
    for b in range(len(cuts) + 1):
        shift.append(before)
        before += sizes.get(b, 0)
    offset = F.element_at(F.array(*[F.lit(s).cast("bigint") for s in shift]), F.col("__bucket") + 1)
    within = F.row_number().over(W.partitionBy("__bucket").orderBy(key)) - 1
    return bucketed.withColumn(name, (offset + within).cast("bigint")).drop("__bucket")


def value_histogram(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """Distinct values with their counts; equal values meet before the shuffle."""
    return df.where(F.col(value).isNotNull()).groupBy(*by, F.col(value).alias("value")).agg(
        F.count(F.lit(1)).alias("weight")
    )


def order_statistics(
    df: DataFrame, by: Sequence[str], value: str, ranks: dict[str, Column], buckets: int = 256
) -> DataFrame:
    """Exact order statistics per group, in one row per group.

    `ranks` maps a result name to a 0-based rank, written with the group's row count `n`.
    Values are counted first, so a value that fills a third of the table is one row; the
    counted values are then cut into ranges and only the range that holds a rank is sorted.
    """
    by = list(by)
    hist = keep(value_histogram(df, by, value))
    cuts = hist.agg(
        F.percentile_approx("value", [i / buckets for i in range(1, buckets)], 10 * buckets).alias("c")
    ).first()["c"]
    cuts = sorted(set(cuts or []))
    hist = hist.withColumn("__range", bucket_of(F.col("value"), cuts))
    ranges = hist.groupBy(*by, "__range").agg(F.sum("weight").alias("w"))
    run = W.partitionBy(*by).orderBy("__range")
    spans = (
        ranges.withColumn("n", F.sum("w").over(W.partitionBy(*by)))
        .withColumn("hi", F.sum("w").over(run.rowsBetween(W.unboundedPreceding, 0)))
        .withColumn("lo", F.col("hi") - F.col("w"))
    )
    asked = F.array(*[F.struct(F.lit(k).alias("name"), r.cast("bigint").alias("rank")) for k, r in ranks.items()])
    targets = (
        spans.withColumn("ask", F.filter(asked, lambda a: (a["rank"] >= F.col("lo")) & (a["rank"] < F.col("hi"))))
        .where(F.size("ask") > 0)
        .select(*by, "__range", "lo", "n", "ask")
    )
    inside = W.partitionBy(*by, "__range").orderBy("value").rowsBetween(W.unboundedPreceding, 0)
    # An ungrouped call has only the range to join on, which spreads just as well.
    hits = (
        hist.join(targets, [*by, "__range"])
        .withColumn("upto", F.col("lo") + F.sum("weight").over(inside))
        .withColumn("hit", F.filter("ask", lambda a: (a["rank"] >= F.col("upto") - F.col("weight")) & (a["rank"] < F.col("upto"))))
        .where(F.size("hit") > 0)
        .select(*by, "value", "n", F.explode("hit").alias("h"))
    )
    picked = [F.max(F.when(F.col("h.name") == k, F.col("value"))).alias(k) for k in ranks]
    return hits.groupBy(*by).agg(F.max("n").alias("n"), *picked)


def upper_median_rank() -> Column:
    """The upper of the two middle ranks."""
    return F.floor(F.col("n") / 2)


def lower_median_rank() -> Column:
    return F.floor((F.col("n") - 1) / 2)


def p95_rank() -> Column:
    """Rank nearest to 95% of the way, halves to even, as the protocol reports it."""
    return F.least(F.col("n") - 1, F.bround(F.lit(0.95) * (F.col("n") - 1), 0).cast("bigint"))


def averaged_median(lower: str, upper: str) -> Column:
    return (F.col(lower) + F.col(upper)) / 2


def number_in_order(df: DataFrame, by: Sequence[str], bucket: Column, order: Sequence[Column], name: str) -> DataFrame:
    """Add 0, 1, 2.. within each group without sorting a group in one task.

    `bucket` is a number that never falls along `order`. Buckets are counted and numbered apart,
    then shifted by what lies before them, so a group of any size is spread over its buckets.
    """
    by = list(by)
    part = df.withColumn("__b", bucket)
    ahead = W.partitionBy(*by).orderBy("__b").rowsBetween(W.unboundedPreceding, -1)
    before = (
        part.groupBy(*by, "__b")
        .agg(F.count(F.lit(1)).alias("__m"))
        .select(*by, "__b", F.coalesce(F.sum("__m").over(ahead), F.lit(0)).alias("__before"))
    )
    within = F.row_number().over(W.partitionBy(*by, "__b").orderBy(*order)) - 1
    return (
        part.withColumn("__in", within)
        .join(before, [*by, "__b"])
        .withColumn(name, F.col("__before") + F.col("__in"))
        .drop("__b", "__in", "__before")
    )


def range_cuts(df: DataFrame, value: str, buckets: int = 256) -> list[float]:
    """Boundaries of about equal shares. A value that fills several shares gets a range of its own."""
    points = df.agg(F.percentile_approx(value, [i / buckets for i in range(1, buckets)], 10 * buckets)).first()[0] or []
    heavy = {a for a, b in zip(points, points[1:]) if a == b}
    return sorted(set(points) | {math.nextafter(v, math.inf) for v in heavy})
