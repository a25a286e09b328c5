"""Similarity join, leaks and search against plain code."""

import math
import random
import re

import numpy as np
import pytest

from pyspark.sql import functions as F

from convolens.llm import common, components, decontaminate, group_join, mtree


def shingles(text, k=5):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return [tuple(w[i : i + k]) for i in range(len(w) - k + 1)] or ([tuple(w)] if w else [])


def plain_components(nodes, links):
    root = {x: x for x in nodes}
    find = lambda x: x if root[x] == x else find(root[x])
    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {x: find(x) for x in nodes}


def near_texts(seed, n):
    rng = random.Random(seed)
    base = [[f"w{rng.randrange(40)}" for _ in range(rng.choice([3, 5, 8, 20, 60, 200]))] for _ in range(12)]
    out = []
    for _ in range(n):
        w = list(rng.choice(base))
        for _ in range(rng.randrange(3)):
            w[rng.randrange(len(w))] = f"w{rng.randrange(40)}"
        if rng.random() < 0.3:
            w += ["more"] * rng.randrange(4)
        out.append(" ".join(w).upper() if rng.random() < 0.2 else " ".join(w))
    return out + ["", None, "one", "one", "ONE", " \n"]


def test_components_of_chains_stars_and_rings(spark):
    rng = random.Random(1)
    links = [(i, i + 1) for i in range(0, 40)] + [(100, i) for i in range(101, 160)] + [(rng.randrange(200, 260), rng.randrange(200, 260)) for _ in range(50)] + [(7, 7), (300, 300)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    want = plain_components({x for l in links for x in l}, links)
    assert got == {k: v for k, v in want.items() if k in got} and set(want) - set(got) == {300}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("seed, rounds, few", [(1, 2, 0), (2, 3, 16)])
def test_join_links_what_is_similar(spark, monkeypatch, seed, rounds, few):
    monkeypatch.setattr(group_join, "ROUNDS", rounds)
    monkeypatch.setattr(group_join, "FEW", few)
    rows = [(3 * i % 1000, t) for i, t in enumerate(near_texts(seed, 90))]
    sets = {i: set(shingles(t)) for i, t in rows}
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    want = plain_components(sets, links)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in group_join.link_components(df).collect()}
    assert got == {i: (len(s), want[i]) for i, s in sets.items()}
    kept = sorted(r.doc_id for r in group_join.representatives(df).collect())
    assert kept == sorted(set(want.values()))


def test_join_takes_nulls_repeats_and_clashing_names(spark):
    t = " ".join(f"x{i}" for i in range(30))
    rows = [(5, t, 1), (5, t, 1), (9, t + " end", 2), (None, t, 3), (7, None, 4)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n long")
    got = sorted((r.doc_id or 0, r.n_shingles, r.component_id or 0) for r in group_join.link_components(df).collect())
    assert got == [(0, 26, 0), (5, 26, 5), (5, 26, 5), (7, 0, 7), (9, 27, 5)]
    assert sorted((r.doc_id or 0, r.n) for r in group_join.representatives(df).collect()) == [(0, 3), (5, 1), (7, 4)]
    assert group_join.link_components(df.limit(0)).count() == 0


def test_sets_of_one_id_are_one_node(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(30)) for x in "abc")
    rows = [(3, a), (5, a), (5, b), (7, b), (8, c), (9, c + " end"), (9, c + " other"), (10, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("twice", F.lit(1)).withColumn("id", F.lit("x"))
    got = sorted((r.doc_id, r.component_id) for r in group_join.link_components(df).collect())
    assert got == [(3, 3), (5, 3), (5, 3), (7, 3), (8, 8), (9, 8), (9, 8), (10, 10)]
    kept = group_join.representatives(df)
    assert sorted(r.doc_id for r in kept.collect()) == [3, 8, 10] and kept.columns == df.columns


def shuffled(plan):
    """Rows that the plan's shuffles wrote, of those that carry whole rows of documents."""
    name = plan.getClass().getSimpleName()
    if name == "AdaptiveSparkPlanExec":
        return shuffled(plan.executedPlan())
    if name.endswith("QueryStageExec"):
        return shuffled(plan.plan())
    own = 0
    if name == "ShuffleExchangeExec" and "row#" in plan.output().mkString(","):
        own = plan.metrics().apply("shuffleRecordsWritten").value()
    below = plan.children()
    return own + sum(shuffled(below.apply(i)) for i in range(below.size()))


def test_rows_that_surely_stay_are_not_shuffled(spark):
    rows = [(i, " ".join(f"x{i}y{k}" for k in range(12))) for i in range(400)] + [(1000 + i, " ".join(f"x{i}y{k}" for k in range(12))) for i in range(20)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        kept = group_join.representatives(df)
        assert sorted(r.doc_id for r in kept.collect()) == list(range(400))
        assert 20 <= shuffled(kept._jdf.queryExecution().executedPlan()) < 60
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


@pytest.mark.parametrize("slots", [1 << 24, 64])
def test_hits_miss_no_key(spark, monkeypatch, slots):
    monkeypatch.setattr(common, "SLOTS", slots)
    rows = [(i * 37 - 900, i) for i in range(3000)] + [(None, -1)]
    df, keys = spark.createDataFrame(rows, "id long, at long"), spark.createDataFrame([(i * 74 - 900,) for i in range(20)] * 2, "id long")
    got = {r.at: r.hit for r in common.hits(df, "id", keys).collect()}
    assert len(got) == len(rows) and all(got[2 * i] for i in range(20))
    assert sum(got.values()) < (25 if slots > 64 else 1500)
    assert not any(r.hit for r in common.hits(df, "id", keys.limit(0)).collect())


def weighted(a, b):
    from collections import Counter

    a, b = Counter(a), Counter(b)
    return sum((a & b).values()) / sum((a | b).values())


def plain_leaks(docs, items):
    """From the contract: every window of an item's number of words, or the whole of a shorter document."""
    split = lambda t: re.findall(r"[^\x20\x09-\x0D]+", (t or "").lower())
    out = set()
    for d, t in docs:
        w = split(t)
        for i, x in items:
            size = len(split(x))
            for at in range(max(1, len(w) - size + 1) if size and w else 0):
                if weighted(shingles(" ".join(w[at : at + size])), shingles(x)) >= 0.8:
                    out.add((d, i))
    return out


def test_leaks_in_short_documents_and_of_short_items(spark):
    fifty = [f"w{k}" for k in range(50)]
    items = [(1, " ".join(fifty)), (2, "four words of it"), (3, "one"), (4, "four words of it"), (None, "no id")]
    docs = [
        (1, " ".join(fifty[:49])), (2, " ".join(fifty[:40])), (3, " ".join(fifty[1:49])), (4, "here are Four words of it again, four words of it"), (5, "four words of"),
        (6, "four words of it"), (7, "One"), (8, "x one y"), (9, ""), (10, "words no id here"), (6, "four words of it"), (None, "and one"),
    ]
    df = spark.createDataFrame([(d, t, 0) for d, t in docs], "doc_id long, text string, item_id int")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.leaks(df, bench).collect()
    want = plain_leaks(list(enumerate(t for _, t in docs)), list(enumerate(x for _, x in items)))
    assert sorted((str(r.doc_id), str(r.item_id)) for r in got) == sorted((str(docs[d][0]), str(items[i][0])) for d, i in want)
    assert {(1, 1), (3, 1), (4, 2), (7, 3), (8, 3)} <= {(r.doc_id, r.item_id) for r in got} and (2, 1) not in {(r.doc_id, r.item_id) for r in got}
    assert [(r.first_word, r.n_words) for r in got if (r.doc_id, r.item_id) == (4, 2)] == [(2, 4)]
    kept = decontaminate.clean(df, bench)
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["2", "5", "9"] and kept.columns == df.columns


def test_leaks_are_all_windows_near_an_item(spark):
    rng = random.Random(4)
    word = lambda: f"w{rng.randrange(60)}"
    items = [(i, " ".join(word() for _ in range(rng.choice([3, 15, 30, 50])))) for i in range(12)] + [(50, ""), (51, None)]
    docs = []
    for d in range(60):
        w = [word() for _ in range(rng.randrange(120))]
        for _ in range(rng.randrange(3)):
            own = rng.choice(items)[1] or ""
            own = own.split()
            if own and rng.random() < 0.6:
                own[rng.randrange(len(own))] = word()
            if rng.random() < 0.3:
                own = own[1:]
            at = rng.randrange(len(w) + 1)
            w[at:at] = own
        docs.append((d, " ".join(w).title()))
    docs += [(100, items[0][1]), (101, None), (102, "")]
    df, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.leaks(df, bench).collect()}
    want = plain_leaks(docs, items)
    assert len(want) > 15 and got == want
    left = {r.doc_id for r in decontaminate.clean(df, bench).collect()}
    assert left == {d for d, _ in docs} - {d for d, _ in want}
    assert decontaminate.leaks(df, bench.limit(0)).count() == 0 and decontaminate.leaks(df.limit(0), bench).count() == 0
    monkey = decontaminate.AT_ONCE
    decontaminate.AT_ONCE = 300
    try:
        assert {(r.doc_id, r.item_id) for r in decontaminate.leaks(df, bench).collect()} == want
        assert {r.doc_id for r in decontaminate.clean(df, bench).collect()} == left
    finally:
        decontaminate.AT_ONCE = monkey


def plain_top(rows, k):
    good = [(i, np.floor(64 * np.array(v, float))) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    width = max((len(v) for _, v in good), default=0)
    good = [(i, np.pad(v, (0, width - len(v)))) for i, v in good]
    out = []
    for q, v in good:
        if q % 20 == 0:
            best = sorted(((-int(v @ x), i) for i, x in good if i != q))[:k]
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(best)]
    return sorted(out)


@pytest.mark.parametrize("page, leaf, block", [(4096, 64, 512), (40, 4, 3)])
def test_search_is_exact(spark, monkeypatch, page, leaf, block):
    for name, value in (("PAGE", page), ("LEAF", leaf), ("BLOCK", block)):
        monkeypatch.setattr(mtree, name, value)
    rng = np.random.default_rng(2)
    centre = rng.normal(size=(6, 8))
    rows = [(i, [float(x) for x in centre[i % 6] + 0.2 * rng.normal(size=8)]) for i in range(300)]
    rows += [(1000 + i, [0.5] * 8) for i in range(60)] + [(2000, None), (2020, [1.0, None]), (2040, [float("nan")] * 8), (None, [1.0] * 8), (2060, [9.0]), (2080, [float("inf")] * 8), (2100, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)
    rows = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows]
    got = sorted(tuple(r) for r in mtree.top_products(df, lambda i: i % 20 == 0, 7).collect())
    assert got == plain_top(rows, 7)


def test_search_of_few_or_no_rows(spark):
    df = spark.createDataFrame([(20, [1.0, 2.0], "x"), (21, [3.0, -1.0], "y"), (21, [3.0, -1.0], "y")], "vec_id long, embedding array<double>, score string")
    got = [tuple(r) for r in mtree.top_products(df, lambda i: i % 20 == 0).collect()]
    assert sorted(got) == [(20, 1, 21, 4096), (20, 2, 21, 4096)]
    assert mtree.top_products(df.limit(0), lambda i: i % 20 == 0).count() == 0
    assert mtree.top_products(df.filter("vec_id = 21"), lambda i: i % 20 == 0).count() == 0


def test_large_components(spark):
    """Components beyond 32-bit products, ids of several vectors, and a vector whose own product no long holds."""
    rows = [(i, [float((i * 7919 + k * 104729) % 9973) * 10.0 ** (i % 4) * (-1) ** (i * k)  for k in range(5)]) for i in range(120)]
    rows += [(3, [1e6, -1e6, 5e5, 2.5, 0.0]), (40, [-3e6] * 5), (41, [1e30] * 5), (42, [1.7e308] * 5)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    whole = [(i, [math.floor(64 * c) for c in v]) for i, v in rows if max(map(abs, v)) < 1e29]
    want = []
    for q, x in [(i, v) for i, v in whole if i % 40 == 0 and i != 40]:
        scores = sorted((-sum(a * b for a, b in zip(x, y)), i) for i, y in whole if i != q)[:9]
        want += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scores)]
    got = mtree.top_products(df, lambda i: (i % 40 == 0) & (i != 40), 9).collect()
    assert sorted(map(tuple, got)) == sorted(want)


def test_parities_part_unlike_sets_and_no_similar_ones(spark):
    rng = np.random.default_rng(5)
    rows, similar = [], []
    for k in range(300):
        n = int(rng.integers(1, 400))
        a = np.unique(rng.integers(0, 2**63, n, dtype=np.uint64))
        keep = int(len(a) * rng.uniform(0.7, 1))
        b = np.unique(np.concatenate([a[:keep], rng.integers(0, 2**63, int(rng.integers(0, max(1, len(a) // 5) + 1)), dtype=np.uint64)]))
        both = len(np.intersect1d(a, b))
        similar.append(100 * both >= 80 * (len(a) + len(b) - both))
        # Beside it a set that shares a tenth, as texts with one common line do.
        c = np.unique(np.concatenate([a[: len(a) // 10], rng.integers(0, 2**63, len(a), dtype=np.uint64)]))
        sides = [[int(v) for v in group_join.parities(x)] for x in (a, b, c)]
        rows.append((k, len(a), len(b), len(c), *sides))
    bits = "struct<b0: bigint, b1: bigint, b2: bigint, b3: bigint>"
    df = spark.createDataFrame([(*r[:4], *map(tuple, r[4:])) for r in rows], f"k int, n int, m int, o int, a {bits}, b {bits}, c {bits}")
    near = lambda end, n: group_join.alike("a", end, F.col("n"), F.col(n), 80)
    got = {r.k: r for r in df.select("k", "n", near("b", "m").alias("near"), near("c", "o").alias("far")).collect()}
    assert 30 < sum(similar) < 270 and all(got[k].near for k, x in enumerate(similar) if x)
    assert not any(r.far for r in got.values() if 20 <= r.n)
