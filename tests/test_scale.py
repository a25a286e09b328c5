"""Odd values, and steps whose work or memory must not grow faster than their input."""

import math

import numpy as np
from pyspark.sql import functions as F

from convolens.functions import rouge
from convolens.operators import alignment, chunks, resampling, scoring
from convolens.plans import views as V


def test_a_fastest_run_of_no_time_has_an_infinite_spread(spark):
    rows = [("a", 0.0), ("a", 2.0), ("a", None), ("b", 0.0), ("b", 0.0), ("c", 1.0), ("c", 4.0), ("d", None)]
    df = spark.createDataFrame(rows, "system string, latency_s double")
    got = {r.system: r.spread_ratio for r in scoring.latency_probe(df, ["system"]).collect()}
    assert math.isnan(got.pop("b")) and got == {"a": math.inf, "c": 4.0}


def test_small_blocks_go_down_the_tree_together(spark, monkeypatch):
    plain, names = resampling._split, ["d", "one"]
    monkeypatch.setattr(resampling, "GROUP_ROWS", 64)
    monkeypatch.setattr(resampling, "TASKS", 1)
    units = spark.range(300).select(F.format_string("%04d", "id").alias("k"), (F.col("id") % 17).cast("double").alias("d"), F.lit(1.0).alias("one"))
    got = {r.draw: (r.d, r.one) for r in resampling.draw_sums(units, "k", names, 40, 3, block=8).collect()}
    # One block after the other, as the blocks of a run had been done.
    every, n, blocks = np.arange(40), 300, 38
    want = np.zeros((40, 2))
    for b in range(blocks):
        data = np.array([[i % 17, 1.0] for i in range(b * 8, min(b * 8 + 8, n))])
        for k, c in enumerate(resampling._tree_share(3, n, blocks, b, every, 8)):
            at = np.arange(c) + b * 32
            want[k] += data[resampling.hashed_array(np.full(c, k), at, 3) % len(data)].sum(axis=0)
    assert got == {k: tuple(v) for k, v in enumerate(want)} and all(one == n for _, one in got.values())
    # A run of 8 blocks makes its own 7 splits and the few above, not as many for each block as the tree is deep.
    calls = []
    monkeypatch.setattr(resampling, "_split", lambda *a: calls.append(1) or plain(*a))
    assert [b for b, _ in resampling._tree_shares(3, 4096, 512, range(8, 16), every, 8)] == list(range(8, 16))
    assert len(calls) == 6 + 7


def test_chunks_of_padding_are_made_once(spark):
    rows = [(1, [7], []), (2, [7, 7], list(range(9))), (3, [7], list(range(40))), (4, [7], None)]
    df = spark.createDataFrame(rows, "k int, p array<int>, t array<int>")
    for pad in (True, False):
        got = {r.k: r.c for r in df.select("k", chunks.chunk_tokens(F.col("p"), F.col("t"), 6, 4, pad=pad).alias("c")).collect()}
        assert got[4] is None
        for k, p, t in rows[:3]:
            want = []
            for some, most in ((t[: 4 * (6 - len(p))], 4), (t[(6 - len(p)) // 2 :][: 3 * (6 - len(p))], 3)):
                size = 6 - len(p)
                for i in range(most if pad else -(-len(some) // size)):
                    part = some[i * size : (i + 1) * size]
                    want.append((p + part + [1] * (size - len(part)), [1] * (len(p) + len(part)) + [0] * (size - len(part))))
            assert [(list(c.ids), list(c["mask"])) for c in got[k]] == want
    # The plan builds the padding outside the step that cuts tokens, once for all of its chunks.
    plan = df.select(chunks.chunk_tokens(F.col("p"), F.col("t"), 6, 4, stride=False).alias("c"))._jdf.queryExecution().analyzed().toString()
    assert "array_repeat(struct(ids" in plan.replace("named_struct", "struct")


def _conversations(spark, folder, n):
    """n conversations of three turns."""
    words = "the cat sat on a mat and the dog ran".split()
    text = lambda i, t: " ".join(words[(i + t + k) % 10] for k in range(5 + (i + t) % 4)) + "."
    roles = ("user", "assistant", "user")
    rows = [(i, t, roles[t], text(i, t)) for i in range(n) for t in range(3)]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    df.write.parquet(f"{folder}/conversations.parquet")
    return rows


def test_scored_pairs_fill_all_shuffle_partitions(spark, tmp_path):
    _conversations(spark, tmp_path, 60)
    pairs = V.scored_pairs(spark, str(tmp_path), "b")
    assert pairs.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert pairs.count() == 60


def test_tokens_go_to_python_as_text(spark):
    rows = [(1, "The cat. The cat sat!", "the cat sat"), (2, None, "a b"), (3, "a", " . ! ")]
    df = spark.createDataFrame(rows, "i int, prediction string, reference string")
    scored = rouge.with_rouge(df, ["rouge1", "rouge2", "rougeL", "rougeLsum"], stemmed=False)
    plan = scored._jdf.queryExecution().optimizedPlan().toString()
    assert "ArrowEvalPython" in plan and "array_sort" not in plan
    got = {r.i: r for r in scored.collect()}
    assert all(tuple(got[i][m]) == rouge.score_pair(p, q, [m], False)[m] for i, p, q in rows for m in rouge.METRICS)
    assert rouge.pair_hits("the cat\nthe cat sat", "the cat sat", rouge.METRICS) == [3, 2, 3, 3]
    assert rouge.pair_hits("", "a", rouge.METRICS) == [0, 0, 0, 0]


def test_short_files_are_aligned_together(spark, monkeypatch):
    words = "the cat sat on a mat and one dog ran".split()
    text = lambda f, j: " ".join(words[(f * 3 + j * k + k) % 10] for k in range(1, 7)) + f" w{f}x{j}"
    sizes = {f"f{f:02d}": 3 + f % 4 if f else 40 for f in range(30)}
    refs = [(f, j, text(int(f[1:]), j)) for f, n in sizes.items() for j in range(n)]
    gone = {f: n // 3 for f, n in sizes.items()}
    preds = [(f, j - (j > gone[f]), t) for f, j, t in refs if j != gone[f]]
    p = spark.createDataFrame(preds, "file_id string, i bigint, text string")
    r = spark.createDataFrame(refs, "file_id string, j bigint, text string")
    band = alignment.band(p, r)
    mapping = alignment.align(band)
    assert "FlatMapGroupsInPandas [g#" in mapping._jdf.queryExecution().optimizedPlan().toString()
    want = {(f, j - (j > gone[f])): j for f, j, _ in refs if j != gone[f]}
    assert {(x.file_id, x.i): x.j for x in mapping.collect()} == want
    stats = lambda: {(x.file_id, x.i): x for x in alignment.rank_statistics(p, r, mapping, band).collect()}
    got = stats()
    assert set(got) == set(want) and all(got[f, i].others == sizes[f] - 1 for f, i in want)
    assert all(x.ahead == 0 and x.beaten == x.others for x in got.values())
    # A file of several blocks stays on its own beside the short ones.
    monkeypatch.setattr(alignment, "PRED_BLOCK", 10)
    monkeypatch.setattr(alignment, "REF_BLOCK", 15)
    again = stats()
    assert {k: (x.beaten, x.ahead, x.others, round(x.total, 9)) for k, x in again.items()} == {
        k: (x.beaten, x.ahead, x.others, round(x.total, 9)) for k, x in got.items()
    }
