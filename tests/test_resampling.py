import random
import statistics
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from convolens.operators import indexing as I
from convolens.operators import resampling as R
from tests import models


def _scores(spark, a, b):
    rows = [(f"q{i:04d}", x, y) for i, (x, y) in enumerate(zip(a, b))]
    return spark.createDataFrame(rows, "query_id string, a double, b double").repartition(5)


def _random(n, seed=1):
    rng = random.Random(seed)
    return [rng.random() for _ in range(n)]


def test_observed_figures(spark):
    a, b = _random(40, 1), _random(40, 2)
    got = R.paired_bootstrap(_scores(spark, a, b), draws=400, seed=7).first()
    assert got.n_shared == 40 and got.observed_diff == pytest.approx(statistics.mean(b) - statistics.mean(a))
    assert got.median_abs_per_query_diff == pytest.approx(statistics.median(abs(y - x) for x, y in zip(a, b)))
    assert got.per_query_b_wins == sum(y > x for x, y in zip(a, b))


@pytest.mark.parametrize("block", [65536, 8])
def test_identical_systems_do_not_differ(spark, block):
    a = _random(30)
    got = R.paired_bootstrap(_scores(spark, a, a), draws=200, block=block).first()
    assert got.observed_diff == 0 and got.ci95_low == 0 and got.ci95_high == 0
    assert got.p_b_better == 0 and got.per_query_ties == 30 and got.crosses_zero


@pytest.mark.parametrize("block", [65536, 8])
def test_a_uniform_shift_excludes_zero(spark, block):
    a = _random(30)
    got = R.paired_bootstrap(_scores(spark, a, [x + 0.1 for x in a]), draws=200, block=block).first()
    assert got.ci95_low == pytest.approx(0.1) and got.ci95_high == pytest.approx(0.1) and got.p_b_better == 1
    assert not got.crosses_zero


def test_blocks_agree_with_the_sequential_generator_on_the_interval(spark):
    a, b = _random(200, 3), _random(200, 4)
    lo, hi, _ = models.bootstrap(a, b, 3000, 7)
    for block in (65536, 32):
        r = R.paired_bootstrap(_scores(spark, a, b), draws=3000, block=block).first()
        assert abs(r.ci95_low - lo) < 0.15 * (hi - lo) and abs(r.ci95_high - hi) < 0.15 * (hi - lo)


def test_many_blocks_draw_n_of_n():
    n, size = 150, 16
    shares = [R._tree_share(5, n, -(-n // size), b, np.arange(300), size) for b in range(-(-n // size))]
    assert all(sum(s[d] for s in shares) == n for d in range(300))
    assert shares[0].mean() == pytest.approx(16, rel=0.1)
    assert shares[-1].mean() == pytest.approx(n % 16, rel=0.15)
    # A share's variance is that of n trials.
    assert shares[0].var() == pytest.approx(n * (16 / n) * (1 - 16 / n), rel=0.35)


def test_shares_of_very_many_units_reach_every_block():
    n = 2**33
    blocks = -(-n // R.TREE_BLOCK)
    for b in (0, blocks // 2, blocks - 1):
        assert R._tree_share(5, n, blocks, b, np.arange(20), R.TREE_BLOCK).mean() == pytest.approx(R.TREE_BLOCK, rel=0.02)
    high = R.hashed_array(np.int64(3), np.arange(2000, dtype=np.int64) + (blocks - 1) * 4 * R.TREE_BLOCK, 1) % R.TREE_BLOCK
    assert high.min() < 1000 and high.max() > R.TREE_BLOCK - 1000


def test_clusters_are_equally_likely_and_keep_their_queries(spark):
    rows = [(f"q{i}", "big" if i < 10 else "small", 0.0, 1.0 if i < 10 else 0.0) for i in range(11)]
    df = spark.createDataFrame(rows, "query_id string, cluster_id string, a double, b double")
    got = R.paired_cluster_bootstrap(df, draws=500).first()
    assert got.n_clusters == 2 and got.n_shared == 11
    assert got.observed_diff == pytest.approx(10 / 11)
    # A draw is big+big, small+small, or one of each: means 1, 0 and 10/11.
    assert (got.ci95_low, got.ci95_high) == (0.0, 1.0)
    assert got.p_b_better == pytest.approx(0.75, abs=0.08)


def test_a_missing_cluster_fails(spark):
    df = _scores(spark, [1.0, 2.0], [1.0, 2.0])
    clusters = spark.createDataFrame([("q0000", "m")], "query_id string, cluster_id string")
    with pytest.raises(Exception, match="no cluster for q0001"):
        R.with_clusters(df, clusters).collect()


def test_subsample_draws_distinct_members(spark):
    picks = R.permuted(np.repeat(np.arange(2000), 5), np.tile(np.arange(5), 2000), 20, 11).reshape(-1, 5)
    assert all(len(set(p)) == 5 for p in picks.tolist()) and picks.min() >= 0 and picks.max() < 20
    seen = Counter(picks.ravel().tolist())
    assert max(seen.values()) / min(seen.values()) < 1.4
    for n in (1, 2, 3, 16, 17, 1000):
        assert sorted(R.permuted(np.full(n, 7), np.arange(n), n, 3).tolist()) == list(range(n))
    # Beyond 2^31 every part is reached alike, and no number twice.
    n = 2**33
    far = R.permuted(np.zeros(40_000, np.int64), np.arange(40_000), n, 5)
    assert len(set(far.tolist())) == 40_000 and far.max() < n
    parts = np.bincount(far * 16 // n, minlength=16)
    assert parts.min() > 2200 and parts.max() < 2800
    scores = spark.createDataFrame([(f"q{i}", float(i)) for i in range(20)], "query_id string, score double")
    out = R.subsample_distribution(scores, 20, draws=50).first()
    assert out.low == out.high == out.full_mean == 9.5
    with pytest.raises(ValueError):
        R.subsample_distribution(scores, 21)


def test_hashed_picks_are_uniform_and_equal_in_sql(spark):
    import duckdb

    rows = spark.range(40000).select((F.floor(F.col("id") / 200)).alias("a"), (F.col("id") % 200).alias("b"))
    got = rows.select("a", "b", R.hashed(F.col("a"), F.col("b"), 20260723).alias("h")).collect()
    want = duckdb.connect().execute(
        f"SELECT a, b, {R.hashed_sql('a', 'b', 20260723)} FROM (SELECT range // 200 AS a, range % 200 AS b FROM range(40000))"
    ).fetchall()
    assert sorted(tuple(r) for r in got) == sorted(want)
    counts = Counter(r.h % 97 for r in got)
    chi2 = sum((counts[k] - 40000 / 97) ** 2 / (40000 / 97) for k in range(97))
    assert chi2 < 150  # 96 degrees of freedom: the mean is 96, the deviation 14


def test_seeded_sample_depends_on_seed_and_ids_alone(spark):
    df = spark.createDataFrame([(f"id{i:03d}",) for i in range(200)], "query_id string").repartition(7)
    take = lambda frame, n, seed: [r.query_id for r in R.seeded_sample(frame, n, seed).orderBy("place").collect()]
    one = take(df, 25, 1)
    assert one == sorted(one) == take(df.repartition(3), 25, 1) and len(one) == 25
    assert one != take(df, 25, 2) and take(df, 500, 1) == sorted(r.query_id for r in df.collect())


def test_interval_records(spark):
    rng = random.Random(2)
    rows = [(run, "rouge1", "test", f"q{i}", rng.random() + k) for k, run in enumerate(["x", "y"]) for i in range(20)]
    scores = spark.createDataFrame(rows, "run_id string, metric string, split string, query_id string, score double")
    clusters = spark.createDataFrame([(f"q{i}", f"m{i % 4}") for i in range(20)], "query_id string, cluster_id string")
    todo = [
        {"a": "x", "b": "y", "metric": "rouge1", "split": "test"},
        {"a": "y", "b": "x", "metric": "rouge1", "split": "test", "resampling_unit": "meeting"},
    ]
    out = R.interval_index(R.interval_records(scores, todo, clusters, draws=100)).collect()
    assert [(r.run_a, r.n_clusters) for r in out] == [("x", None), ("y", 4)]
    assert out[0].observed_diff == pytest.approx(-out[1].observed_diff)


# --- numbering and order statistics ---------------------------------------------------------------


def test_row_index_in_buckets_equals_plain_order(spark, monkeypatch):
    monkeypatch.setattr(I, "BUCKET_ROWS", 100)
    rng = random.Random(8)
    keys = rng.sample(range(10**6), 3000)
    df = spark.createDataFrame([(k, f"s{k:07d}") for k in keys], "k bigint, s string").repartition(9)
    for col in ("k", "s"):
        got = [r[0] for r in I.with_row_index(df, col, small_rows=10).orderBy("idx").select(col).collect()]
        assert got == sorted(got)
        idx = [r.idx for r in I.with_row_index(df, col, small_rows=10).orderBy("idx").collect()]
        assert idx == list(range(3000))


def test_order_statistics_match_python(spark):
    rng = random.Random(5)
    groups = {"a": [rng.choice([0.0, 0.0, 0.0, rng.random()]) for _ in range(501)], "b": [3.0] * 40, "c": [1.0, 2.0]}
    df = spark.createDataFrame([(g, v) for g, vs in groups.items() for v in vs] + [("c", None)], "g string, v double")
    ranks = {"lo": I.lower_median_rank(), "hi": I.upper_median_rank(), "p95": I.p95_rank(), "top": F.col("n") - 1}
    got = {r.g: r for r in I.order_statistics(df, ["g"], "v", ranks, buckets=16).collect()}
    for g, vs in groups.items():
        s, n = sorted(vs), len(vs)
        assert got[g].n == n
        assert (got[g].lo + got[g].hi) / 2 == statistics.median(s)
        assert got[g].hi == s[n // 2]
        assert got[g].p95 == s[min(n - 1, int(round(0.95 * (n - 1))))]
        assert got[g].top == s[-1]
