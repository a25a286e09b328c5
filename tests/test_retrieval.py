import random

import pytest
from pyspark.sql import functions as F

from convolens.operators import prompts, retrieval, targets
from convolens.operators.windows import build_windows
from tests import models

UTT = "meeting_id string, utt_idx int, speaker string, text string"
QRY = (
    "query_id string, meeting_id string, split string, query_type string, query string, reference string, "
    "gold_spans array<struct<s:int,e:int>>"
)


def _data(seed, sizes, per_meeting):
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(40)}"
    utts = {
        f"m{k}": [(f"S{rng.randrange(3)}", " ".join(word() for _ in range(rng.choice([1, 3, 6, 14])))) for _ in range(n)]
        for k, n in enumerate(sizes)
    }
    queries = []
    for m, us in utts.items():
        for j in range(per_meeting):
            spans = []
            for _ in range(rng.randrange(0, 3)):
                s = rng.randrange(len(us))
                spans.append((s, s + rng.randrange(0, 12)))
            queries.append((f"{m}_q{j}", m, "val", "specific" if j % 4 else "general", f"{word()} {word()} {word()}", "r", spans))
    return utts, queries


def _frames(spark, utts, queries):
    u = spark.createDataFrame([(m, i, s, t) for m, us in utts.items() for i, (s, t) in enumerate(us)], UTT)
    return u, spark.createDataFrame(queries, QRY)


def _score(query, text):
    import re

    t = lambda s: set(re.findall("[a-z0-9]+", s.lower()))
    return float(len(t(query) & t(text)))


def _expected(utts, queries, chunk, budget):
    out = {}
    for qid, m, _, kind, query, _, spans in queries:
        wins = models.windows(utts[m], chunk)
        picked = models.pack([(_score(query, t), s, len(t.split())) for s, e, t in wins], budget)
        rec = line_rec = None
        if kind == "specific" and spans:
            gold = [s for s, e, _ in wins if any(not (e < a or s > b) for a, b in spans)]
            if gold:
                rec = len(set(gold) & set(picked)) / len(gold)
            lines = {i for a, b in spans for i in range(a, min(b, len(utts[m]) - 1) + 1)}
            got = {i for s, e, _ in wins if s in picked for i in range(s, e + 1)}
            if lines:
                line_rec = len(lines & got) / len(lines)
        out[qid] = (picked, rec, line_rec)
    return out


@pytest.mark.parametrize("chunk,budget,block", [(12, 30, 4096), (12, 30, 16), (5, 17, 8), (20, 20, 24)])
def test_locate_matches_model(spark, monkeypatch, chunk, budget, block):
    # A small block makes transcripts hot; a small crowd makes their queries crowded.
    monkeypatch.setattr(retrieval, "CROWD", 3 if block < 4096 else 512)
    utts, queries = _data(chunk + block, [1, 9, 60, 200], 7)
    u, q = _frames(spark, utts, queries)
    packed = retrieval.locate(u, q, chunk_words=chunk, budgets=budget, block_lines=block).cache()
    want = _expected(utts, queries, chunk, budget)
    got = {r.query_id: [p.start for p in r.picks] for r in packed.collect()}
    assert got == {k: v[0] for k, v in want.items()}
    recalls = {r.query_id: r.recall for r in retrieval.window_recall(packed).collect()}
    assert recalls == pytest.approx({k: v[1] for k, v in want.items() if v[1] is not None})
    lines = {r.query_id: r.recall for r in retrieval.utterance_recall(packed).collect()}
    assert lines == pytest.approx({k: v[2] for k, v in want.items() if v[2] is not None})
    mean = retrieval.mean_recalls(packed).first()
    known = [v[1] for v in want.values() if v[1] is not None]
    assert mean.window_recall == pytest.approx(sum(known) / len(known))


def test_several_budgets_share_a_ranking(spark):
    utts, queries = _data(5, [80], 5)
    u, q = _frames(spark, utts, queries)
    packed = retrieval.locate(u, q, chunk_words=10, budgets=[15, 40], block_lines=16)
    for budget in (15, 40):
        want = {k: v[0] for k, v in _expected(utts, queries, 10, budget).items()}
        got = {r.query_id: [p.start for p in r.picks] for r in packed.where(F.col("budget") == budget).collect()}
        assert got == want


def test_first_window_is_taken_over_budget_and_later_ones_skip(spark):
    rows = [("q", "m", 0, s, s, n, "", 0, sc) for s, n, sc in [(0, 50, 9.0), (1, 5, 8.0), (2, 3, 7.0)]]
    cols = "query_id string, meeting_id string, salt int, start int, end int, n_words int, text string, label int, score double"
    df = spark.createDataFrame(rows, cols).selectExpr(
        "*", "0L part", "'' query", "'general' query_type", "'' reference", "array(struct(1 s, 1 e)) gold_spans"
    )
    for hot in (False, True):
        take = lambda b: [p.start for p in retrieval.pack_windows(df, b, hot).first().picks]
        assert take(10) == [0]
        assert take(54) == [0, 2]
        assert take(55) == [0, 1]
        assert take(58) == [0, 1, 2]


def test_ranks_agree_with_and_without_spreading(spark):
    rng = random.Random(3)
    rows = [("q%d" % (i % 2), i, float(rng.choice([0, 0, 0, 0, 1, 2, rng.random()]))) for i in range(3000)]
    df = spark.createDataFrame(rows, "query_id string, start int, score double")
    plain = {(r.query_id, r.start): r["rank"] for r in retrieval.rank_windows(df).collect()}
    spread = {(r.query_id, r.start): r["rank"] for r in retrieval.rank_windows(df, hot=True).collect()}
    assert plain == spread


def test_transcript_prompts_keep_white_space_within_budget(spark):
    utts = {"m0": [("A", "one  two"), ("B", "three\tfour")], "m1": [("A", "w " * 9)] * 5}
    u, _ = _frames(spark, utts, [("x", "m0", "val", "general", "q", "r", [])])
    got = {r.meeting_id: r.transcript for r in prompts.budgeted_transcripts(u, 8).collect()}
    assert got["m0"] == "A: one  two\nB: three\tfour"
    assert got["m1"] == "A: " + " ".join(["w"] * 7)
    assert {r.meeting_id: r.transcript for r in prompts.budgeted_transcripts(u, 5).collect()}["m0"] == "A: one two B: three"


def test_a_model_scorer_sees_batches(spark):
    utts, queries = _data(6, [30], 2)
    u, q = _frames(spark, utts, queries)
    scorer = retrieval.model_scorer(lambda: lambda qs, ts: [float(len(t)) for t in ts], "length")
    rows = scorer(retrieval.query_windows(build_windows(u, 10), q)).collect()
    assert rows and all(r.score == len(r.text) for r in rows)


def test_model_sources_keep_lines_as_they_are(spark):
    utts = {"m0": [("A", "one  two"), ("B", "three"), ("C", "four")]}
    u, q = _frames(spark, utts, [("x", "m0", "val", "general", "q", "r", [])])
    assert prompts.model_sources(u, q, "full").first().source == "A: one  two\nB: three\nC: four"
    long, ql = _frames(spark, {"m0": [("A", "w " * 30)] * 1000}, [("x", "m0", "val", "general", "q", "r", [])])
    assert len(prompts.model_sources(long, ql, "full").first().source.split()) == 31_000
    packed = retrieval.locate(u, q, chunk_words=3, budgets=5)
    assert prompts.model_sources(u, q, "spans", packed).count() == 1
    with pytest.raises(ValueError):
        prompts.model_sources(u, q, "spans")


def test_training_targets_do_not_depend_on_the_spreading(spark, monkeypatch):
    utts, queries = _data(12, [9, 80, 200], 6)
    u, q = _frames(spark, utts, queries)
    q = q.withColumn("reference", F.lit("w1 w2 w3. W4 w5! w6 w7 w8 w9? w10."))

    def examples(block):
        gold = targets.gold_windows(u, q, 12, block)
        rows = targets.fusion_examples(targets.span_sources(gold, 40)).unionByName(targets.coarse_examples(gold, stemmed=False))
        return sorted(map(tuple, rows.select("query_id", "prompt", "response").collect()))

    plain = examples(4096)
    monkeypatch.setattr(retrieval, "CROWD", 2)
    monkeypatch.setattr(targets, "CHUNK_LINES", 16)
    assert examples(16) == plain and any("_w" in r[0] for r in plain)
    for qid, m, _, kind, _, _, spans in queries:
        texts = [t for s, e, t in models.windows(utts[m], 12) if any(not (e < a or s > b) for a, b in spans)]
        if kind == "specific" and texts:
            words = "\n".join(texts).split()
            want = "\n".join(texts) if len(words) <= 40 else " ".join(words[:40])
            assert f"Transcript:\n{want}\n\nSummary:" in dict((r[0], r[1]) for r in plain)[qid]


def test_stored_vectors_rank_and_pack(spark):
    rng = random.Random(5)
    utts, queries = _data(5, [30, 12, 1], 4)
    u, q = _frames(spark, utts, queries)
    line = {(m, i): [rng.gauss(0, 1) for _ in range(4)] for m, us in utts.items() for i in range(len(us))}
    asked = {row[0]: [rng.gauss(0, 1) for _ in range(4)] for row in queries}
    line["m0", 0] = [0.0] * 4  # without length: scores 0
    asked["m1_q1"] = [1.0] * 3  # of another length: scores 0 everywhere
    gone, lost = ("m0", 5), "m0_q2"
    lines = [(m, i, None if (m, i) == gone else v) for (m, i), v in line.items()]
    wv = spark.createDataFrame(lines, "meeting_id string, start int, vector array<double>")
    qv = spark.createDataFrame([(k, v if k != lost else [1.0, None]) for k, v in asked.items()], "query_id string, vector array<double>")
    got = retrieval.locate(u, q, retrieval.embedding_scorer, chunk_words=10, budgets=40, vectors=(wv, qv)).collect()

    def cos(a, b):
        dot = lambda x, y: sum(p * r for p, r in zip(x, y))
        return dot(a, b) / (dot(a, a) * dot(b, b)) ** 0.5 if len(a) == len(b) and dot(a, a) * dot(b, b) > 0 else 0.0

    assert {r.query_id for r in got} == set(asked) - {lost}
    windows = {}
    for w in build_windows(u, 10).collect():
        windows.setdefault(w.meeting_id, []).append(w)
    for r in got:
        have = [w for w in windows[r.meeting_id] if (w.meeting_id, w.start) != gone]
        best = sorted(have, key=lambda w: (-cos(asked[r.query_id], line[w.meeting_id, w.start]), -w.start))
        used, picks = best[0].n_words, [best[0].start]
        for w in best[1:]:
            if used + w.n_words <= 40:
                used, picks = used + w.n_words, [*picks, w.start]
        assert (r.used_words, [p.start for p in r.picks]) == (used, sorted(picks))
