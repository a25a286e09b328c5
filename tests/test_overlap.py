"""N-grams in the JVM, the vocabulary pass, and joins with common keys."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from convolens.functions import overlap
from convolens.functions import rouge as R
from convolens.functions.stemmer import stem
from convolens.operators.joins import join_by_weight
from convolens.operators.stems import stemmed_sentences, vocabulary


def test_shared_counts_copies(spark):
    rng = random.Random(1)
    rows = [([rng.choice("abcd") for _ in range(rng.randrange(12))], [rng.choice("abce") for _ in range(rng.randrange(12))]) for _ in range(200)]
    df = spark.createDataFrame(rows, "a array<string>, b array<string>")
    for n in (1, 2, 3):
        grams = lambda t: Counter(tuple(t[i : i + n]) for i in range(len(t) - n + 1))
        got = df.select("a", "b", overlap.shared(overlap.grams(F.col("a"), n), overlap.grams(F.col("b"), n)).alias("h")).collect()
        assert all(r.h == sum((grams(r.a) & grams(r.b)).values()) for r in got)


def test_scores_in_columns_are_those_of_plain_python(spark):
    rng = random.Random(2)
    words = ["running", "runs", "cats", "cat", "agreed", "agree", "the", "a", "x9", "meetings", "discussed"]
    text = lambda: "".join(rng.choice(words).title() + rng.choice([" ", " ", ". ", "!\n", ", "]) for _ in range(rng.randrange(40)))
    rows = [(i, text(), text()) for i in range(60)] + [(100, None, "a b"), (101, "a", None), (102, "", " ! "), (103, "x " * 300, "x " * 200)]
    df = spark.createDataFrame(rows, "i int, prediction string, reference string").repartition(3)
    for stemmed in (False, True):
        got = {r.i: r for r in R.with_rouge(df, R.METRICS, stemmed).collect()}
        assert len(got) == len(rows)
        for i, p, r in rows:
            want = R.score_pair(p, r, R.METRICS, stemmed)
            assert all(tuple(got[i][m]) == pytest.approx(want[m]) for m in R.METRICS)
    with pytest.raises(ValueError):
        R.with_rouge(df, ["rouge9"])


def test_each_distinct_word_is_stemmed_once(spark):
    words = ["meetings"] * 5 + ["sky", "skies", "discussed"]
    got = {r.word: (r.stem, r.n) for r in vocabulary(spark.createDataFrame([(w,) for w in words], "word string")).collect()}
    assert got == {w: (stem(w), words.count(w)) for w in set(words)}


def test_sentences_of_stems_keep_their_order(spark):
    rows = [(1, "Meetings ran. Cats agreed!", None), (2, "", "one\ntwo. Meetings"), (3, "Meetings ran. Cats agreed!", "...")]
    df = spark.createDataFrame(rows, "k int, a string, b string")
    got = {r.k: (r.a, r.b) for r in stemmed_sentences(df, ["a", "b"]).collect()}
    first = [["meet", "ran"], ["cat", "agre"]]
    assert got == {1: (first, []), 2: ([], [["one", "two"], ["meet"]]), 3: (first, [])}


def test_join_by_weight_is_a_left_join(spark):
    keys = ["hot"] * 3000 + [f"k{i}" for i in range(500)] + ["none"] * 3
    rows = spark.createDataFrame([(k, i) for i, k in enumerate(keys)], "k string, i int")
    sides = rows.where("k <> 'none'").groupBy("k").agg(F.count("*").alias("n"), F.max("i").alias("v"))
    want = rows.join(sides.select("k", "v"), "k", "left")
    got = join_by_weight(rows, sides, ["k"], "n", len(keys))
    assert got.columns == want.columns and sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
