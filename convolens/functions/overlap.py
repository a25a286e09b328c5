"""Clipped n-gram overlap of token arrays, in the JVM: no token is shuffled, no Python worker started."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from convolens.functions.text import let

def prf(hits: Column, n_pred: Column, n_ref: Column) -> Column:
    """p, r and f; 0 where a side has nothing."""
    p, r = hits / F.greatest(n_pred, F.lit(1)), hits / F.greatest(n_ref, F.lit(1))
    f = let(F.struct(p.alias("p"), r.alias("r")), lambda s: F.when(s["p"] + s["r"] > 0, 2 * s["p"] * s["r"] / (s["p"] + s["r"])).otherwise(0.0))
    return F.struct(p.alias("p"), r.alias("r"), f.alias("f"))


def grams(tokens: Column, n: int) -> Column:
    """Runs of n tokens, joined by spaces; none of a shorter array."""
    if n == 1:
        return tokens
    joined = lambda x, i: F.concat_ws(" ", x, *[F.get(tokens, i + k) for k in range(1, n)])
    return F.when(F.size(tokens) < n, F.array().cast("array<string>")).otherwise(F.transform(F.slice(tokens, F.lit(1), F.greatest(F.size(tokens) - (n - 1), F.lit(0))), joined))


def shared(a: Column, b: Column) -> Column:
    """How many elements two arrays have in common, copies counted: one pass over both, sorted together."""
    tagged = lambda x, side: F.transform(x, lambda t: F.struct(t.alias("t"), F.lit(side).alias("s")))
    state = lambda t, ca, cb, hits: F.struct(t.alias("t"), ca.alias("a"), cb.alias("b"), hits.alias("hits"))

    def step(acc: Column, x: Column) -> Column:
        return F.when(acc["t"] == x["t"], state(acc["t"], acc["a"] + 1 - x["s"], acc["b"] + x["s"], acc["hits"])).otherwise(
            state(x["t"], 1 - x["s"], x["s"], acc["hits"] + F.least(acc["a"], acc["b"]))
        )

    start = state(F.lit(""), F.lit(0), F.lit(0), F.lit(0))
    # Tokens are never empty, so the first one differs from the start.
    return F.aggregate(F.array_sort(F.concat(tagged(a, 0), tagged(b, 1))), start, step, lambda acc: acc["hits"] + F.least(acc["a"], acc["b"]))


def ngram_overlap(pred: Column, ref: Column, n: int) -> Column:
    count = lambda t: F.greatest(F.size(t) - (n - 1), F.lit(0))
    return prf(shared(grams(ref, n), grams(pred, n)), count(pred), count(ref))
