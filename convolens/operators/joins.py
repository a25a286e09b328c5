"""Joins that a few very common keys cannot slow down."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Keys with more than one in this many of all rows go out as a broadcast: there are fewer of them than this.
HOT = 1000


def join_by_weight(rows: DataFrame, sides: DataFrame, keys: Sequence[str], weight: str, total: Column | int) -> DataFrame:
    """`rows` left-joined with `sides`, one row per key, where `weight` says how many of `total` rows have the key.

    Common keys meet their rows where they lie, the others in a shuffle that none of them dominates.
    """
    hot = F.broadcast(sides.where(F.col(weight) * HOT > total))
    cold = sides.where(F.col(weight) * HOT <= total).drop(weight)
    return rows.join(hot.drop(weight), list(keys)).unionByName(
        rows.join(hot.select(*keys), list(keys), "left_anti").join(cold, list(keys), "left")
    )
