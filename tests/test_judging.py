import json

import pytest
from pyspark.sql import functions as F

from convolens.functions import marking as M
from convolens.operators import attribution, costs, facts, judging, prompts


def _one(spark, col, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values))
    return df.select(col.alias("x")).first().x


@pytest.mark.parametrize(
    "text,want",
    [
        ("because\nVERDICT: A", "A"),
        ("VERDICT: A\nno wait\n  VERDICT: b  \n", "B"),
        ("VERDICT: tie", "TIE"),
        ("verdict: A", "UNPARSED"),
        ("the VERDICT: A", "UNPARSED"),
        ("VERDICT: A: strongly\u2028done", "A: STRONGLY"),
        ("x\r\nVERDICT: TIE\r\n", "TIE"),
        ("", "UNPARSED"),
        (None, "UNPARSED"),
    ],
)
def test_verdicts(spark, text, want):
    assert _one(spark, M.parse_verdict(F.col("t")), t=text) == want


def test_winner_undoes_the_swap(spark):
    rows = [("A", False), ("A", True), ("B", False), ("B", True), ("TIE", True), ("UNPARSED", False), ("A.", False), ("A.", True)]
    df = spark.createDataFrame(rows, "v string, s boolean")
    got = [tuple(r) for r in df.select(M.winner(F.col("v"), F.col("s")), M.winner(F.col("v"), F.col("s"), strict=True)).collect()]
    assert [g[0] for g in got] == ["a", "b", "b", "a", "tie", None, "b", "a"]
    assert [g[1] for g in got][-2:] == [None, None]


def _mark(spark, reply, n_facts):
    df = spark.createDataFrame([("q", reply, ["f"] * n_facts)], "query_id string, text string, facts array<string>")
    return facts.fact_items(df.select("query_id", "text"), df.select("query_id", "facts")).first()


def test_marking_counts_only_numbers_in_range(spark):
    reply = "ok " + json.dumps(
        {
            "covered_fact_numbers": [1, "2", " 3 ", 3, 9, 0, -1, "x", 2.5, None],
            "summary_claims": ["a", "b", "c", "d"],
            "unsupported_claim_numbers": ["4", 7],
        }
    )
    r = _mark(spark, reply + " bye", 5)
    assert (r.n_facts, r.n_covered, r.n_claims, r.n_unsupported) == (5, 3, 4, 1)
    assert r.recall == pytest.approx(0.6) and r.precision == pytest.approx(0.75) and not r.incoherent


def test_marking_without_claims_or_json(spark):
    r = _mark(spark, '{"covered_fact_numbers": [1], "summary_claims": []}', 2)
    assert r.parsed and r.precision is None and r.recall == 0.5 and not r.incoherent
    for bad in ("no json", "{broken", "[1, 2]", '{"a": }', None):
        assert not _mark(spark, bad, 2).parsed
    r = _mark(spark, '{"covered_fact_numbers": [1], "summary_claims": ["a"], "unsupported_claim_numbers": [1]}', 2)
    assert r.incoherent and r.precision == 0.0


def test_failures_score_zero_and_only_unmeasured_is_null(spark):
    rows = [(None, None), (None, 0.5), (0.0, 0.0), (0.5, 0.5), (0.5, None)]
    df = spark.createDataFrame(rows, "p double, r double")
    got = df.select(M.per_query_f1(F.col("p"), F.col("r")).alias("q"), M.f1_of_means(F.col("p"), F.col("r")).alias("m")).collect()
    assert [g.q for g in got] == [None, 0.0, 0.0, 0.5, None]
    assert [g.m for g in got] == [None, None, None, 0.5, None]


def test_kappa_by_hand(spark):
    pairs = [("a", "a")] * 4 + [("b", "b")] * 3 + [("a", "b")] * 2 + [("tie", "a")]
    df = spark.createDataFrame(pairs, "x string, y string")
    r = judging.kappa_stats(df, [], "x", "y", ["a", "b", "tie"]).first()
    expected = 0.6 * 0.5 + 0.3 * 0.5
    assert r.raw == pytest.approx(0.7) and r.kappa == pytest.approx((0.7 - expected) / (1 - expected))
    same = spark.createDataFrame([("a", "a")] * 3, "x string, y string")
    assert judging.kappa_stats(same, [], "x", "y", ["a", "b", "tie"]).first().kappa is None


def test_panel_tells_neutral_from_own_vendor(spark):
    cols = (
        "contestant string, judge_model string, a_wins bigint, b_wins bigint, ties bigint, unparsed bigint, "
        "n_decided bigint, cost_usd double, self_preference_risk boolean, run_order int"
    )
    rows = [
        ("gpt-x", "gpt-5.6-sol", 2, 8, 0, 0, 10, 1.0, True, 0),
        ("gpt-x", "claude-opus-5", 6, 4, 0, 1, 10, 2.0, False, 1),
        ("solo", "claude-opus-5", 0, 0, 0, 5, 0, 0.5, False, 1),
    ]
    summary = judging.panel_summary(spark.createDataFrame(rows, cols), ["solo", "gpt-x"])
    got = {r.contestant: r for r in summary.collect()}
    assert got["gpt-x"].clean_judge == "claude-opus-5" and got["gpt-x"].ours_win_rate == 0.6
    assert got["gpt-x"].self_preference_delta == pytest.approx(0.4)
    assert got["solo"].ours_win_rate is None and got["solo"].same_vendor_judge is None
    assert got["solo"].panel_place == 0
    total = judging.panel_totals(summary).first()
    assert (total.pairs_won, total.pairs_judged, total.total_cost_usd) == (1, 1, 3.5)
    lift = judging.compare_modes(summary, summary).collect()
    assert [(r.contestant, r.grounding_lift) for r in lift] == [("gpt-x", 0.0)]


def test_prompts_are_blind_and_the_cache_key_keeps_the_orientation(spark):
    q = spark.createDataFrame([("q1", "Why?", "Because."), ("q2", "Who?", "Me.")], "query_id string, query string, reference string")
    a = spark.createDataFrame([("q1", "AAA"), ("q2", "AAA")], "query_id string, prediction string")
    b = spark.createDataFrame([("q1", "BBB"), ("q2", "BBB")], "query_id string, prediction string")
    sample = judging.judge_sample(a, b, None)
    reqs = {r.query_id: r for r in judging.judge_requests(sample, q, a, b, "grounded").collect()}
    assert reqs["q1"].cache_key == "q1-ab" and "Summary A:\nAAA" in reqs["q1"].prompt
    assert reqs["q2"].cache_key == "q2-ba" and "Summary A:\nBBB" in reqs["q2"].prompt
    assert "Reference answer:\nBecause." in reqs["q1"].prompt
    plain = judging.judge_requests(sample, q, a, b).first().prompt
    assert "Reference" not in plain
    with pytest.raises(ValueError):
        judging.judge_requests(sample, q, a, b, "other")
    done = spark.createDataFrame([("q1-ab",)], "cache_key string")
    left = judging.pending_requests(judging.judge_requests(sample, q, a, b), done).collect()
    assert [r.query_id for r in left] == ["q2"]


def test_mark_prompt_numbers_facts_from_one(spark):
    df = spark.createDataFrame([("Q", ["x", "y"], "S")], "q string, f array<string>, s string")
    text = df.select(prompts.mark_prompt(F.col("q"), F.col("f"), F.col("s")).alias("p")).first().p
    assert text.endswith("Query: Q\n\nReference facts:\n1. x\n2. y\n\nSummary:\nS")


def test_veracity_is_void_when_the_gold_claims_fail(spark):
    key = spark.createDataFrame(
        [(f"c{i}", "GOLD-REFERENCE" if i < 10 else "ours") for i in range(15)], "claim_id string, source string"
    )
    label = lambda good: spark.createDataFrame(
        [(f"c{i}", "SUPPORTED_FULL" if i < good or i > 12 else "CONTRADICTED") for i in range(14)], "claim_id string, label string"
    )
    ok = {r.source: r for r in facts.veracity(key, label(9)).collect()}
    assert ok["ours"].n == 4 and ok["ours"].usable_rate == 0.25 and ok["GOLD-REFERENCE"].true_rate == 0.9
    void = {r.source: r for r in facts.veracity(key, label(8)).collect()}
    assert void["ours"].usable_rate is None and not void["ours"].control_passed


def test_blinding_numbers_every_claim_once(spark):
    pool = spark.createDataFrame([("q", f"s{i % 2}", f"claim {i}") for i in range(130)], "query_id string, source string, claim string")
    got = facts.blinded_claims(pool).collect()
    assert len({r.claim for r in got}) == 130
    assert sorted(r.claim_id for r in got) == sorted(f"q__c{i:02d}" for i in range(1, 131))


def _items(spark, rows):
    return spark.createDataFrame(rows, "query_id string, precision double, recall double")


def test_survival_is_reported_or_withheld_with_reasons(spark):
    recalls = spark.createDataFrame([(f"q{i}", 1.0 if i < 5 else 0.0) for i in range(10)], "query_id string, recall double")
    ours = _items(spark, [(f"q{i}", 0.5, 0.4 if i < 5 else 0.2) for i in range(10)])
    flat = _items(spark, [(f"q{i}", 0.5, 0.6) for i in range(10)])
    r = attribution.attribution(recalls, ours, flat, ["recall"]).first()
    assert r.gap_all == pytest.approx(0.3) and r.survival == pytest.approx(0.2 / 0.3) and not r.uninterpretable_because
    steep = _items(spark, [(f"q{i}", 0.5, 0.9 if i < 5 else 0.3) for i in range(10)])
    r = attribution.attribution(recalls, ours, steep, ["recall"]).first()
    assert r.survival is None and [x.split(":")[0] for x in r.uninterpretable_because] == ["control failed"]
    r = attribution.attribution(recalls, flat, flat, ["recall"]).first()
    assert r.survival is None and [x[-19:] for x in r.uninterpretable_because] == ["below noise of 0.02"]
    r = attribution.attribution(recalls.where("recall < 1"), ours, flat, ["recall"]).first()
    assert r.survival is None and r.uninterpretable_because == ["empty bucket"]


def test_buckets_report_empty_ones(spark):
    recalls = spark.createDataFrame([("a", 0.0), ("b", 0.3), ("c", 1.0), ("d", None)], "query_id string, recall double")
    scores = spark.createDataFrame([("a", 0.0), ("b", 0.4), ("c", None), ("d", 1.0), ("z", 1.0)], "query_id string, score double")
    got = {r.bucket: (r.n, r.mean) for r in attribution.bucket_by_recall(recalls, scores).collect()}
    assert got == {"miss (0.0)": (1, 0.0), "partial (0-0.5)": (1, 0.4), "most (0.5-1.0)": (0, None), "hit (1.0)": (0, None)}
    zero = {r.bucket: (r.n, r.zero, r.rate) for r in attribution.zero_rates(recalls, scores).collect()}
    assert zero["miss (0.0)"] == (1, 1, 1.0) and zero["hit (1.0)"] == (0, 0, None)


# --- costs ------------------------------------------------------------------------------------


def test_each_row_is_billed_in_its_own_mode(spark):
    rows = [("gpt-5.6-sol", 1_000_000, 10, "batch", 2), ("gpt-5.6-sol", 1_000_000, 10, None, None)]
    df = spark.createDataFrame(rows, "model string, prompt_tokens bigint, completion_tokens bigint, mode string, thoughts_tokens bigint")
    got = [r.cost_usd for r in costs.with_cost(df, costs.price_table(spark)).collect()]
    assert got == pytest.approx([2.5 + 12 * 15e-6, 5.0 + 10 * 30e-6])
    for model in ("gpt-5.4", "unknown"):
        bad = df.limit(1).withColumn("model", F.lit(model))
        with pytest.raises(Exception, match=f"no confirmed price for {model}"):
            costs.with_cost(bad, costs.price_table(spark)).collect()


def test_price_file_must_be_verified(spark, tmp_path):
    path = tmp_path / "p.json"
    rates = {"input_per_1m": 1, "output_per_1m": 2.5}
    path.write_text(json.dumps({"_verified_on": "2026-01-01", "m": rates}))
    assert [tuple(r) for r in costs.load_prices(spark, str(path)).collect()] == [("m", 1.0, 2.5, None, None)]
    path.write_text(json.dumps({"m": rates}))
    with pytest.raises(Exception, match="_verified_on"):
        costs.load_prices(spark, str(path)).collect()


def test_run_names_and_vendors(spark):
    df = spark.createDataFrame([("m", None, "off"), ("m", 40000, "low"), ("m", 9, "off")], "m string, b int, t string")
    got = [r[0] for r in df.select(costs.run_tag(F.col("m"), F.col("b"), F.col("t"))).collect()]
    assert got == ["m", "m-thinklow", "m-w9"]
    names = ["GPT-x", "o1-mini", "claude-z", "gemini-1", "llm", None]
    v = [r[0] for r in spark.createDataFrame([(n,) for n in names], "m string").select(costs.vendor_of(F.col("m"))).collect()]
    assert v == ["openai", "openai", "anthropic", "google", None, None]


def test_batch_prefix_always_sends_one(spark, monkeypatch):
    df = spark.createDataFrame([(i, e) for i, e in enumerate([900.0, 600.0, 700.0, 512.0])], "ord int, est_tokens double")

    def first(cap):
        monkeypatch.setitem(costs.ENQUEUE_CAPS, "model", cap)
        return [r.ord for r in costs.batch_prefix(df, "ord", "model").orderBy("ord").collect()]

    assert first(100) == [0]
    assert first(2000) == [0, 1]
    assert first(4000) == [0, 1, 2, 3]
    with pytest.raises(Exception, match="estimate below"):
        costs.batch_prefix(spark.createDataFrame([(0, 5.0)], "ord int, est_tokens double"), "ord").collect()


def test_request_settings(spark):
    df = spark.createDataFrame([("gpt-5.6-sol", "off"), ("gpt-5.6-sol", "low"), ("other", "off")], "m string, t string")
    got = [r[0] for r in df.select(costs.request_settings(F.col("m"), F.col("t"))).collect()]
    assert got[0] == {"max_completion_tokens": "512", "reasoning_effort": "none"}
    assert got[1] == {"max_completion_tokens": "4096", "reasoning_effort": "low"}
    assert got[2] == {"max_completion_tokens": "512", "temperature": "0.0"}
