"""Connected components by contraction: every node goes to its least neighbour, links move to those, until none is left."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from convolens.llm import common as C


def components(links: DataFrame) -> DataFrame:
    """node, root for each node of `links` (a, b): the least node that links reach from it.

    A round joins the links with one number per node and halves the nodes that are left at least; nodes with very
    many links meet in partial minima. Rows may repeat, in either direction; links of a node with itself count for
    nothing. No links, no rows.
    """
    spark = links.sparkSession
    steps: list[DataFrame] = []
    links, before = links.filter("a <> b"), []
    while True:
        links = C.staged(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
        C.discard(*before)
        before = [links]
        if not links.take(1):
            break
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        step = C.staged(both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("node"), F.least("a", "b").alias("root")), "roots")
        steps.append(step)
        at = lambda end: step.select(F.col("node").alias(end), F.col("root").alias(f"{end}_root"))
        links = links.join(at("a"), "a").join(at("b"), "b").select(F.col("a_root").alias("a"), F.col("b_root").alias("b")).filter("a <> b")
    if not steps:
        return spark.createDataFrame([], "node long, root long")
    # A step's roots that move on in a later step take their nodes along.
    found = steps[-1]
    for step in reversed(steps[:-1]):
        later = found.select(F.col("node").alias("root"), F.col("root").alias("next"))
        found = step.join(later, "root", "left").select("node", F.coalesce("next", "root").alias("root"))
    found = C.staged(found, "components")
    C.discard(*steps, *before)
    return found
