"""Mixing sources to target weights by capped water-filling.

Every source asks for its share of the mix by weight. Sources whose share is more than `epochs` times what they hold
are clamped there, and what they leave is shared by weight among the others, until no one is above. Each round is one
sum over the sources; the driver sees two numbers of it.

A source's target becomes whole repetitions of all its documents, and for what is left a further one of the first of
them in a seeded order. Of the last of these only as many words are taken as the target has left, so a source meets its
target to the word. The order is split into cells: cells before the one where the target is met are taken,
those behind it are not, and only that one cell's documents are sorted.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from convolens.llm import common as C

#: Hexadecimal digits of the seeded order that name a cell: 4,096 cells a source.
CELL_DIGITS = 3
#: Sources with more than one row in this many: there are fewer of them than this, so they can be broadcast.
HOT = 1000
_KEY = ["missing", "name"]


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def _rows(docs: DataFrame, seed: int, id_col: str, text_col: str, source_col: str, carry: bool) -> DataFrame:
    """id, missing and name (the source), size, order; with `carry` also row, a structure of all columns."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))).cast("binary"))
    return docs.select(
        F.col(id_col).alias("id"), F.col(source_col).isNull().alias("missing"), F.coalesce(F.col(source_col).cast("string"), F.lit("")).alias("name"),
        n_words(F.col(text_col).cast("string")).alias("size"), digest.alias("order"), *[F.struct(*[F.col(c) for c in docs.columns]).alias("row")] * carry,
    )


def numbered(sources: DataFrame) -> DataFrame:
    """The sources with `rank` from 0 by code point, null last; sorted in ranges, so no task holds them all."""
    ranged = C.staged(sources.repartitionByRange(*_KEY).withColumn("part", F.spark_partition_id()), "sources")
    # One row per partition.
    counts = ranged.groupBy("part").agg(F.count("*").alias("n"))
    shift = counts.select("part", (F.sum("n").over(W.orderBy("part")) - F.col("n")).alias("shift"))
    within = F.row_number().over(W.partitionBy("part").orderBy(*_KEY)) - 1
    return ranged.join(F.broadcast(shift), "part").withColumn("rank", F.col("shift") + within).drop("part", "shift")


def targets(sources: DataFrame, weights: Sequence[float] = (5, 2, 1), share: float = 1.5, epochs: float = 2.0) -> DataFrame:
    """`sources` (missing, name, source_size) with target: words of the mix from each, by capped water-filling.

    The mix holds `share` times all sizes. Sources in order of code point, null last, weigh as `weights` say, which
    repeat. If `share` is over `epochs`, every source is clamped and the mix is smaller. A source without words
    gets 0.
    """
    if not weights or min(weights) <= 0 or share < 0 or epochs <= 0:
        raise ValueError("weights and epochs must be above 0, share at least 0")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    held = C.staged(numbered(sources).withColumn("weight", weight).withColumn("most", F.col("source_size") * F.lit(float(epochs))), "weights")
    wanted = share * float(held.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0])
    left, open_weight = wanted, None
    while True:
        clamped = F.lit(False) if open_weight is None else F.col("most") * open_weight <= F.lit(left) * F.col("weight")
        full, rest = held.agg(F.sum(F.when(clamped, F.col("most"))), F.sum(F.when(~clamped, F.col("weight")))).first()
        now = (wanted - (full or 0.0), rest or 0.0)
        if now == (left, open_weight) or not now[1]:
            break
        left, open_weight = now
    return held.withColumn("target", F.when(clamped, F.col("most")).otherwise(F.lit(left) * F.col("weight") / F.lit(open_weight or 1.0)))


def _planned(rows: DataFrame, narrow: DataFrame, weights: Sequence[float], share: float, epochs: float) -> DataFrame:
    """rows with source_size, target, copies (whole repetitions) and part (words of a further one)."""
    cell = F.substring("order", 1, CELL_DIGITS)
    cells = C.staged(narrow.groupBy(*_KEY, cell.alias("cell")).agg(F.sum("size").alias("words"), F.count("*").alias("n")), "cells")
    sources = cells.groupBy(*_KEY).agg(F.sum("words").alias("source_size"), F.sum("n").alias("n"))
    plan = C.staged(targets(sources, weights, share, epochs), "targets")
    size = F.col("source_size")
    whole = F.when(size > 0, F.floor(F.col("target") / size)).otherwise(0).cast("long")
    plan = plan.withColumn("copies", whole).withColumn("extra", F.floor("target") - F.col("copies") * size)
    # The cell in which a source's order meets its target, and how many words are left for it.
    running = F.sum("words").over(W.partitionBy(*_KEY).orderBy("cell"))
    met = cells.withColumn("before", running - F.col("words")).join(plan.select(*_KEY, "extra"), _KEY)
    met = met.filter((F.col("before") < F.col("extra")) & (F.col("extra") <= F.col("before") + F.col("words")))
    met = met.select(*_KEY, F.col("cell").alias("cut"), (F.col("extra") - F.col("before")).alias("left"))
    plan = C.staged(plan.join(met, _KEY, "left").select(*_KEY, "n", "source_size", "target", "copies", "cut", "left"), "plan")
    total = plan.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    hot = F.broadcast(plan.filter(F.col("n") * HOT > total).select(*_KEY, F.struct("source_size", "target", "copies", "cut", "left").alias("of")))
    cold = plan.filter(F.col("n") * HOT <= total).select(*_KEY, F.struct("source_size", "target", "copies", "cut", "left").alias("of"))
    first = rows.join(hot, _KEY, "left")
    placed = first.filter("of IS NOT NULL").unionByName(first.filter("of IS NULL").drop("of").join(cold, _KEY))
    placed = placed.select(*rows.columns, "of.*", cell.alias("cell"))
    here = F.coalesce(F.col("cell") == F.col("cut"), F.lit(False))
    far = placed.filter(~here).withColumn("part", F.when(F.col("cell") < F.col("cut"), F.col("size")).otherwise(0).cast("long"))
    before = F.sum("size").over(W.partitionBy(*_KEY).orderBy("order", "size").rowsBetween(W.unboundedPreceding, -1))
    near = placed.filter(here).withColumn("part", F.greatest(F.lit(0), F.least("size", F.col("left") - F.coalesce(before, F.lit(0)))).cast("long"))
    return far.unionByName(near).drop("cell", "cut", "left")


def mix(
    docs: DataFrame, weights: Sequence[float] = (5, 2, 1), share: float = 1.5, epochs: float = 2.0, seed: int = 1,
    id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
) -> DataFrame:
    """How often the mix takes each document: id_col, source_col, size, source_size, target, copies, part, taken.

    size is the number of words, 0 for null; `copies` whole repetitions and the first `part` words once more make
    `taken` words, never more than `epochs` times the size. A source's words come to its target, rounded down.
    A null source is one of its own, and the last; a null id is drawn like an empty one. Rows of one id lie together in
    the seeded order, by size; equal rows are told apart at random at most where the target is met. The same input gives
    the same rows however it is partitioned. An empty table gives none.
    """
    rows = C.staged(_rows(docs, seed, id_col, text_col, source_col, False), "sizes")
    out = _planned(rows, rows, weights, share, epochs)
    return out.select(
        F.col("id").alias(id_col), F.when(~F.col("missing"), F.col("name")).alias(source_col), "size", "source_size", "target", "copies", "part",
        (F.col("copies") * F.col("size") + F.col("part")).alias("taken"),
    )


def mixed(
    docs: DataFrame, weights: Sequence[float] = (5, 2, 1), share: float = 1.5, epochs: float = 2.0, seed: int = 1,
    id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
) -> DataFrame:
    """The mix itself: the rows of `docs`, each as often as `mix` says; a part keeps the text up to its last word taken.

    Documents without words are in no mix.
    """
    rows = _rows(docs, seed, id_col, text_col, source_col, True)
    out = _planned(rows, rows.drop("row"), weights, share, epochs)
    partly = (F.col("part") > 0) & (F.col("part") < F.col("size"))
    times = F.col("copies") + F.when(F.col("part") > 0, 1).otherwise(0)
    out = out.filter("size > 0").withColumn("turn", F.explode(F.when(times > 0, F.sequence(F.lit(1).cast("long"), times))))
    text = F.col("row")[text_col]
    last = partly & (F.col("turn") > F.col("copies"))
    words = F.slice(F.regexp_extract_all(text, F.lit(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+"), F.lit(0)), F.lit(1), F.col("part").cast("int"))
    cut = F.when(last, F.array_join(words, "")).otherwise(text)
    return out.select(*[(cut if c == text_col else F.col("row")[c]).alias(c) for c in docs.columns])
