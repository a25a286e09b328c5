"""Rendezvous hashing of record keys over weighted shards, in DataFrame functions alone.

Every shard draws a number from the record's key and its own; the best draw takes the record. A shard more draws
for itself and changes no other draw, so records move only into it: a weight's share of them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Bits of a draw; a double holds them all.
BITS = 52
#: Parts of a shard that are numbered apart from one another.
CELLS = 256


def _hex(x: Column, start: int, digits: int) -> Column:
    return F.conv(F.substring(x, start, digits), 16, 10).cast("long")


def draw(key: Column, shard: int, weight: float) -> Column:
    """Exponential waiting time with the shard's weight as its rate: the least wins."""
    number = _hex(F.md5(F.concat(key, F.lit(f":{shard}"))), 1, BITS // 4)
    return -F.log((number + F.lit(0.5)) / F.lit(float(1 << BITS))) / F.lit(float(weight))


def shard_of(key: Column, weights: Sequence[float]) -> Column:
    """The shard of each key. Equal draws, which 52 bits all but rule out, go to the smaller number."""
    if not weights or any(not w > 0 for w in weights):
        raise ValueError("weights must be positive")
    if len(weights) == 1:
        return F.lit(0)
    return F.array_min(F.array(*[F.struct(draw(key, i, w).alias("d"), F.lit(i).alias("shard")) for i, w in enumerate(weights)]))["shard"]


def assign(df: DataFrame, key_col: str, weights: Sequence[float], grown: Sequence[float] | None = None) -> DataFrame:
    """Add shard and slot, and grown_shard where other weights are to follow.

    The shard depends on the key's text and the weights alone; a null key counts as the empty text, so rows that share a
    key share a shard. Slots run from 0 without gaps in each shard, in order of cell and key; rows that share a
    key take neighbouring slots in any order. Columns of `df` named like the added ones, or __cell, are replaced.

    A shard is numbered in cells by the key's hash. Only the cells' sizes meet: no task holds a shard.
    """
    key = F.coalesce(F.col(key_col).cast("string"), F.lit(""))
    out = df.withColumns({"shard": shard_of(key, weights), "__cell": _hex(F.md5(key), 1, 2).cast("int")})
    if grown is not None:
        out = out.withColumn("grown_shard", shard_of(key, grown))
    sizes = out.groupBy("shard", "__cell").agg(F.count("*").alias("__n"))
    before = Window.partitionBy("shard").orderBy("__cell")
    sizes = sizes.select("shard", "__cell", (F.sum("__n").over(before) - F.col("__n")).alias("__before"))
    within = Window.partitionBy("shard", "__cell").orderBy(key)
    return (
        out.join(sizes, ["shard", "__cell"])
        .withColumn("slot", F.col("__before") + F.row_number().over(within) - 1)
        .drop("__cell", "__before")
    )
