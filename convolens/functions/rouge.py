"""Overlap scores of a prediction against a reference, computed row by row in Arrow batches.

A pair of texts is scored where it lies: no token is ever shuffled. Tokens go to Python as one text per side.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from convolens.functions import overlap
from convolens.functions.stemmer import stem
from convolens.functions.text import alnum_tokens, scoring_lines

METRICS = ("rouge1", "rouge2", "rougeL", "rougeLsum")
_TOKEN = re.compile(r"[a-z0-9]+")
_GAP = re.compile(r"(?<=[.!?])\s+")
SCORE = "struct<p: double, r: double, f: double>"


def tokenize(text: str, stemmed: bool) -> list[str]:
    found = _TOKEN.findall(text.lower())
    return [stem(t) if len(t) > 3 else t for t in found] if stemmed else found


def split_sentences(text: str | None) -> list[str]:
    flat = " ".join((text or "").split())
    return [s for s in _GAP.split(flat) if s]


def prf(hits: int, n_pred: int, n_ref: int) -> tuple[float, float, float]:
    p, r = hits / max(n_pred, 1), hits / max(n_ref, 1)
    return p, r, 2 * p * r / (p + r) if p + r > 0 else 0.0


def ngram_overlap(ref: Sequence[str], pred: Sequence[str], n: int) -> tuple[float, float, float]:
    hits = shared_grams(ref, pred, n)
    return prf(hits, max(len(pred) - n + 1, 0), max(len(ref) - n + 1, 0))


def lcs_length(a: Sequence[str], b: Sequence[str]) -> int:
    """Longest common subsequence by whole-word bit operations on one big integer per row."""
    if not a or not b:
        return 0
    at = _positions(a)
    full = (1 << len(a)) - 1
    row = full
    for t in b:
        m = at.get(t, 0)
        u = row & m
        row = ((row + u) | (row - u)) & full
    return len(a) - row.bit_count()


def _positions(tokens: Sequence[str]) -> dict[str, int]:
    """The places of every token as a bit mask."""
    at: dict[str, int] = {}
    for i, t in enumerate(tokens):
        at[t] = at.get(t, 0) | (1 << i)
    return at


def lcs_members(ref: Sequence[str], pred: Sequence[str], at: dict[str, int] | None = None) -> set[int]:
    """Positions of the reference on one longest common subsequence with the prediction.

    Of equally long ones, walking back from the ends skips a prediction token only where that
    keeps a strictly longer match. The table's rows are bit vectors: a zero bit is a step up.
    """
    at = _positions(pred) if at is None else at
    # A reference token the prediction lacks repeats its row, and the way back skips it at once.
    hits = [(i, at[t]) for i, t in enumerate(ref) if t in at]
    full = (1 << len(pred)) - 1
    rows = [full]
    for _, m in hits:
        row = rows[-1]
        u = row & m
        rows.append(((row + u) | (row - u)) & full)
    height = lambda row, j: j - (row & ((1 << j) - 1)).bit_count()
    out = set()
    i, j = len(hits), len(pred)
    while i and j:
        place, m = hits[i - 1]
        if m >> (j - 1) & 1:
            out.add(place)
            i, j = i - 1, j - 1
        elif height(rows[i], j - 1) > height(rows[i - 1], j):
            j -= 1
        else:
            i -= 1
    return out


def summary_overlap(ref: list[list[str]], pred: list[list[str]]) -> tuple[float, float, float]:
    """Per reference sentence, the union of its matches with every predicted sentence."""
    return prf(summary_hits(ref, pred), sum(map(len, pred)), sum(map(len, ref)))


def summary_hits(ref: list[list[str]], pred: list[list[str]]) -> int:
    masks = [(s, _positions(s)) for s in pred if s]
    left_ref = Counter(t for s in ref for t in s)
    left_pred = Counter(t for s in pred for t in s)
    hits = 0
    for sent in ref:
        known = set(sent)
        union: set[int] = set()
        for s, at in masks:
            if not known.isdisjoint(at):
                union |= lcs_members(sent, s, at)
        for k in sorted(union):
            t = sent[k]
            if left_pred[t] > 0 and left_ref[t] > 0:
                hits += 1
                left_pred[t] -= 1
                left_ref[t] -= 1
    return hits


def score_pair(
    prediction: str | None, reference: str | None, metrics: Sequence[str], stemmed: bool = True
) -> dict[str, tuple[float, float, float]]:
    ref_sents = pred_sents = []
    if "rougeLsum" in metrics:
        ref_sents = [tokenize(s, stemmed) for s in split_sentences(reference)]
        pred_sents = [tokenize(s, stemmed) for s in split_sentences(prediction)]
    # Sentences end at white space, so cutting them moves no token.
    ref, pred = tokenize(reference or "", stemmed), tokenize(prediction or "", stemmed)
    out = {}
    for m in metrics:
        if m == "rouge1":
            out[m] = ngram_overlap(ref, pred, 1)
        elif m == "rouge2":
            out[m] = ngram_overlap(ref, pred, 2)
        elif m == "rougeL":
            out[m] = prf(lcs_length(ref, pred), len(pred), len(ref)) if ref and pred else (0.0, 0.0, 0.0)
        elif m == "rougeLsum":
            out[m] = summary_overlap(ref_sents, pred_sents)
        else:
            raise ValueError(f"unknown metric {m!r}")
    return out


def rouge(prediction: Column, reference: Column, metrics: Sequence[str] = METRICS, stemmed: bool = True) -> Column:
    """A struct of `p, r, f` per metric."""
    wanted = tuple(metrics)

    @F.pandas_udf("struct<" + ", ".join(f"{m}: {SCORE}" for m in wanted) + ">")
    def score(pred: pd.Series, ref: pd.Series) -> pd.DataFrame:
        rows = [score_pair(p, r, wanted, stemmed) for p, r in zip(pred, ref)]
        return pd.DataFrame({m: [dict(zip("prf", row[m])) for row in rows] for m in wanted})

    return score(prediction, reference)


def with_rouge(pairs: DataFrame, metrics: Sequence[str] = METRICS, stemmed: bool = True) -> DataFrame:
    """Add one `p, r, f` struct column per metric to `prediction, reference` rows.

    Stems are those of a vocabulary: each distinct word once (`operators/stems.py`). Matches are counted row by row in
    Arrow batches: n-grams by their counts, the subsequences of L and Lsum by bit operations on whole rows.
    """
    from convolens.operators.stems import stemmed_sentences

    unknown = set(metrics) - set(METRICS)
    if unknown:
        raise ValueError(f"unknown metrics {sorted(unknown)}")
    rows = pairs.select(F.struct(*pairs.columns).alias("row"), F.col("prediction").alias("pred"), F.col("reference").alias("ref"))
    rows = stemmed_sentences(rows, ["pred", "ref"]) if stemmed else rows.select("row", *[token_sentences(F.col(c)).alias(c) for c in ("pred", "ref")])
    # Sentences end at white space, so cutting them moves no token. A token has no white space: a side is one text, which
    # takes a tenth of the memory that an object for each token takes in Python.
    lines = lambda c: F.array_join(F.transform(c, lambda s: F.array_join(s, " ")), "\n")
    tokens = lambda c: F.aggregate(c, F.lit(0), lambda n, s: n + F.size(s))
    rows = rows.select("row", tokens("pred").alias("p"), tokens("ref").alias("r"), _hits(metrics)(lines("pred"), lines("ref")).alias("hits"))
    count = lambda side, m: F.greatest(F.col(side) - (1 if m == "rouge2" else 0), F.lit(0))
    return rows.select("row.*", *[overlap.prf(F.col("hits")[m], count("p", m), count("r", m)).alias(m) for m in metrics])


def _hits(metrics: Sequence[str]):
    """Matches of two texts of tokens, a sentence in each line, as one number per metric."""
    wanted = tuple(metrics)

    @F.pandas_udf("struct<" + ", ".join(f"{m}: int" for m in wanted) + ">")
    def hits(pred: pd.Series, ref: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([pair_hits(p, r, wanted) for p, r in zip(pred, ref)], columns=list(wanted))

    return hits


def pair_hits(pred: str, ref: str, metrics: Sequence[str]) -> list[int]:
    p, r = pred.split(), ref.split()
    lines = lambda text: [s.split(" ") for s in text.split("\n")] if text else []
    out = []
    for m in metrics:
        if m in ("rouge1", "rouge2"):
            out.append(shared_grams(p, r, int(m[-1])))
        else:
            out.append(lcs_length(r, p) if m == "rougeL" else summary_hits(lines(ref), lines(pred)))
    return out


def shared_grams(a: Sequence[str], b: Sequence[str], n: int) -> int:
    """N-grams in common, copies counted."""
    a, b = (Counter(x if n == 1 else zip(*(x[i:] for i in range(n)))) for x in (a, b))
    return sum(min(c, b[g]) for g, c in a.items() if g in b)


def token_sentences(text: Column) -> Column:
    """Tokens of every sentence; line breaks are flattened first, and sentences without tokens left out."""
    return F.filter(F.transform(F.split(scoring_lines(text), "\n"), alnum_tokens), lambda s: F.size(s) > 0)


def token_f1(a: Column, b: Column) -> Column:
    """Multiset overlap F of two token arrays; 0 where either is empty or nothing is shared."""
    return overlap.ngram_overlap(a, b, 1)["f"]
