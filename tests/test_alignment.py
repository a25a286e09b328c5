import random

import pytest

from convolens.functions.rouge import ngram_overlap
from convolens.operators import alignment as A


def _f1(a, b):
    return ngram_overlap(b.split(), a.split(), 1)[2]


def _brute(sim):
    """Every order-preserving mapping, by dynamic programming over pairs (i, j)."""
    n, m = len(sim), len(sim[0])
    neg = float("-inf")
    best = [[neg] * (m + 1) for _ in range(n + 1)]
    best[0] = [0.0] * (m + 1)
    for i in range(1, n + 1):
        for j in range(i, m + 1):
            best[i][j] = max(best[i - 1][j - 1] + sim[i - 1][j - 1], best[i][j - 1])
    out, j = [], m
    for i in range(n, 0, -1):
        while best[i - 1][j - 1] + sim[i - 1][j - 1] < best[i][j]:
            j -= 1
        out.append(j - 1)
        j -= 1
    return out[::-1]


def _files(spark, texts):
    p = [(f, i, t) for f, (ps, _) in texts.items() for i, t in enumerate(ps)]
    r = [(f, j, t, f"{f}_q{j}") for f, (_, rs) in texts.items() for j, t in enumerate(rs)]
    return (
        spark.createDataFrame(p, "file_id string, i bigint, text string"),
        spark.createDataFrame(r, "file_id string, j bigint, text string, query_id string"),
    )


def _texts(seed, n, drop, noise=6):
    rng = random.Random(seed)
    refs = [" ".join(f"w{rng.randrange(30)}" for _ in range(noise)) for _ in range(n)]
    gone = set(rng.sample(range(n), drop))
    preds = [" ".join(rng.sample(t.split(), 4)) for k, t in enumerate(refs) if k not in gone]
    return preds, refs


@pytest.mark.parametrize("min_block", [2048, 7])
def test_mapping_matches_brute_force(spark, min_block):
    texts = {f"f{k}": _texts(k, n, d) for k, (n, d) in enumerate([(1, 0), (12, 1), (30, 0), (40, 5), (55, 3)])}
    preds, refs = _files(spark, texts)
    got = {}
    for r in A.align(A.band(preds, refs), min_block=min_block).collect():
        got.setdefault(r.file_id, {})[r.i] = r.j
    for f, (ps, rs) in texts.items():
        want = _brute([[_f1(p, r) for r in rs] for p in ps])
        assert [got[f][i] for i in range(len(ps))] == want, f


def test_equal_texts_go_to_the_later_reference(spark):
    preds, refs = _files(spark, {"f": (["a b"], ["a b", "a b", "x"])})
    assert [r.j for r in A.align(A.band(preds, refs)).collect()] == [1]


def test_controls_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(A, "PRED_BLOCK", 7)
    monkeypatch.setattr(A, "REF_BLOCK", 9)
    ps, rs = _texts(3, 40, 1)
    preds, refs = _files(spark, {"f": (ps, rs)})
    rows = A.band(preds, refs)
    got = A.verify(preds, refs, A.align(rows), rows).first()
    sim = [[_f1(p, r) for r in rs] for p in ps]
    m = _brute(sim)
    n, k = len(ps), len(rs)
    assert got.mean_matched_similarity == pytest.approx(round(sum(sim[i][m[i]] for i in range(n)) / n, 4))
    pct = sum(sum(1 for j in range(k) if j != m[i] and sim[i][j] < sim[i][m[i]]) / (k - 1) for i in range(n)) / n
    assert got.mean_matched_percentile == pytest.approx(round(pct, 4))
    top = sum(max(range(k), key=lambda j: sim[i][j]) == m[i] for i in range(n)) / n
    assert got.top1_recovery == pytest.approx(round(top, 4))
    other = [sim[i][j] for i in range(n) for j in range(k) if j != m[i]]
    assert got.mean_unmatched_similarity == pytest.approx(round(sum(other) / len(other), 4))
    rigid = max(sum(sim[i][i + o] for i in range(n)) / n for o in range(k - n + 1))
    assert got.best_rigid_offset_similarity == pytest.approx(round(rigid, 4))
    assert got.monotone and got.slack == 1


def test_build_names_the_skipped_reference_and_withholds_bad_files(spark):
    refs = [f"topic{k} alpha{k} beta{k} gamma{k}" for k in range(20)]
    preds = [t for k, t in enumerate(refs) if k != 7]
    p, r = _files(spark, {"f": (preds, refs)})
    aligned, skipped, report = A.build_alignment(p, r)
    assert [x.query_id for x in skipped.collect()] == ["f_q7"]
    assert aligned.count() == 19 and report.first().gate == "similarity_heuristics"
    junk, r2 = _files(spark, {"f": (["zzz yyy"] * 19, refs)})
    with pytest.raises(A.AlignmentRefused):
        A.build_alignment(junk, r2)
    assert A.build_alignment(junk, r2, force=True)[0].count() == 19
    # A published score decides over the heuristics, in both directions.
    assert A.build_alignment(p, r, expected_rouge1=99.0)[2].first().passed
    with pytest.raises(A.AlignmentRefused):
        A.build_alignment(p, r, expected_rouge1=50.0)


def test_more_predictions_than_references_fail(spark):
    p, r = _files(spark, {"f": (["a", "b"], ["a"])})
    with pytest.raises(Exception, match="more predictions than references"):
        A.band(p, r).collect()
