import hashlib
import json

import pytest
from pyspark.sql import functions as F

from convolens.functions import plugins
from convolens.operators import chunks, maintenance, scoring, targets
from convolens.sources import readers, writers
from convolens.streaming import collector


def _write(path, rows):
    path.write_text("\n".join(json.dumps(r, ensure_ascii=False) for r in rows) + "\n", encoding="utf-8")
    return str(path)


def test_normalising_raw_meetings(spark, tmp_path):
    raw = [
        {
            "meeting_transcripts": [{"speaker": "A", "content": f"é {k}"}, {"speaker": "B", "content": "x"}],
            "general_query_list": [{"query": "all?", "answer": "yes"}],
            "specific_query_list": [
                {"query": "one?", "answer": "1", "relevant_text_span": [["0", "1"], ["3", "3"]]},
                {"query": "two?", "answer": "2", "relevant_text_span": None},
            ],
        }
        for k in range(3)
    ]
    df = readers.read_raw_meetings(spark, _write(tmp_path / "val.jsonl", raw), "val")
    utts = readers.normalize_utterances(df).orderBy("meeting_id", "utt_idx").collect()
    assert [(u.meeting_id, u.utt_idx, u.text) for u in utts][:2] == [("val_0", 0, "é 0"), ("val_0", 1, "x")]
    q = {r.query_id: r for r in readers.normalize_queries(df).collect()}
    assert sorted(q)[:3] == ["val_0_g0", "val_0_s0", "val_0_s1"] and len(q) == 9
    assert [(g.s, g.e) for g in q["val_2_s0"].gold_spans] == [(0, 1), (3, 3)]
    assert q["val_1_s1"].gold_spans == [] and q["val_1_g0"].gold_spans == []
    assert q["val_1_g0"].split == "val" and q["val_1_g0"].query_type == "general"


def test_queries_and_predictions(spark, tmp_path):
    q = readers.read_queries(
        spark, _write(tmp_path / "q.jsonl", [{"query_id": "a", "meeting_id": "m", "gold_spans": [[1, 2]]}, {"query_id": "b"}])
    )
    got = {r.query_id: [(g.s, g.e) for g in r.gold_spans] for r in q.collect()}
    assert got == {"a": [(1, 2)], "b": []}
    path = tmp_path / "p.jsonl"
    path.write_text('{"query_id": "a", "prediction": "old"}\n\n{"query_id": "b", "prediction": "x", "cost_usd": 1.5}\n{"query_id": "a", "prediction": "new"}\n')
    p = {r.query_id: r for r in readers.read_predictions(spark, str(path)).collect()}
    assert p["a"].prediction == "new" and p["b"].cost_usd == 1.5 and p["a"].latency_s is None


def test_plain_predictions_keep_file_order(spark, tmp_path):
    path = tmp_path / "plain.txt"
    path.write_text("\n".join(["  first ", "", "second", "   "] + [f"line {k}" for k in range(500)]) + "\n")
    got = [r.text for r in readers.read_text_predictions(spark, str(path), "f").orderBy("i").collect()]
    assert got == ["first", "second"] + [f"line {k}" for k in range(500)]


def test_lines_are_numbered_across_splits_and_files(spark, tmp_path):
    (tmp_path / "b.txt").write_text("".join(f"b{k}\n" for k in range(3000)))
    (tmp_path / "a.txt").write_text("".join(f"a{k}\n\n" for k in range(5000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        got = [r.value for r in readers.numbered_lines(spark, str(tmp_path)).orderBy("line_no").collect()]
        nos = [r.line_no for r in readers.numbered_lines(spark, str(tmp_path)).orderBy("line_no").collect()]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert got == [f"a{k}" for k in range(5000)] + [f"b{k}" for k in range(3000)]
    assert nos == list(range(8000))


ROW = {
    "run_id": "r", "split": "val", "n": 3, "rouge1": 0.21249, "rouge2": 0.1, "rougeLsum": 0.2, "bertscore_f1": None,
    "cost_usd_total": 2.0, "latency_s_mean": None,
}


def test_score_rows_and_charts(spark, tmp_path):
    for k, (run, r1) in enumerate([("x-seed7-val", 0.2), ("y", 0.2125)]):
        (tmp_path / f"{run}.json").write_text(json.dumps({**ROW, "run_id": run, "rouge1": r1, "peak_vram_gb_max": 1.5 if k else None}, indent=2))
    rows = readers.read_score_rows(spark, str(tmp_path))
    chart = writers.chart_rows(rows).collect()
    assert [(r.run_id, r.rouge1, r.bertscore_f1, r.cost_usd, r.s_per_query, r.peak_gb) for r in chart] == [
        ("y", "0.212", "", "2.00", "", "1.50"), ("x-seed7-val", "0.200", "", "2.00", "", ""),
    ]
    assert {r.run_id: r.seed for r in readers.with_seed(rows).collect()} == {"x-seed7-val": 7, "y": None}
    text = writers.markdown(writers.chart_rows(rows), "Chart")
    assert text.splitlines()[0] == "# Chart" and "| y | val | 3 | 0.212 |" in text
    svg = writers.bar_chart(rows.withColumn("run_id", F.concat("run_id", F.lit("<&"))), "run_id", "rouge1", "T")
    assert svg == writers.bar_chart(rows.withColumn("run_id", F.concat("run_id", F.lit("<&"))), "run_id", "rouge1", "T")
    assert svg.index("y&lt;&amp;") < svg.index("x-seed7")
    (tmp_path / "broken.json").write_text(json.dumps({k: v for k, v in ROW.items() if k != "rouge2"}))
    with pytest.raises(Exception, match="bad row file broken.json: rouge2"):
        readers.read_score_rows(spark, str(tmp_path)).collect()


def test_other_records(spark, tmp_path):
    (tmp_path / "t1.json").write_text(json.dumps({"run_name": "a", "seed": 1, "dry_run": False}))
    (tmp_path / "t2.json").write_text(json.dumps({"run_name": "b", "seed": 2, "dry_run": True}))
    assert [r.run_name for r in readers.read_training_records(spark, str(tmp_path)).collect()] == ["a"]
    rec = tmp_path / "recall.json"
    rec.write_text(json.dumps({"split": "test", "per_query": {"q1": {"recall": 0.5, "n_gold": 2, "n_picked": 3}}}))
    assert [tuple(r) for r in readers.read_recalls(spark, str(rec)).collect()] == [("q1", 0.5, 2, 3)]
    run = tmp_path / "facts.json"
    item = {"query_id": "q", "n_facts": 2, "n_covered": 1, "n_claims": 0, "n_unsupported": 0, "incoherent": False, "recall": 0.5, "precision": None}
    run.write_text(json.dumps({"system": "s", "items": [item]}))
    got = readers.read_fact_runs(spark, str(run)).first()
    assert got["items"][0].recall == 0.5 and got["items"][0].precision is None
    assert readers.read_fact_runs(spark, str(rec)).count() == 0


def test_interval_records_and_index(spark, tmp_path):
    base = {"metric": "rouge1", "observed_diff": 0.012, "ci95_low": -0.001, "ci95_high": 0.02, "crosses_zero": True, "a": {"run_id": "x"}, "b": {"run_id": "y"}}
    (tmp_path / "1.json").write_text(json.dumps(base))
    (tmp_path / "2.json").write_text(json.dumps({**base, "metric": "bertscore", "resampling_unit": "meeting", "crosses_zero": False}))
    rows = writers.index_rows(readers.read_interval_records(spark, str(tmp_path))).collect()
    assert [(r.metric, r.resampling, r["diff"], r.interval, r.verdict) for r in rows] == [
        ("bertscore", "meeting", "+0.0120", "[-0.0010, +0.0200]", "excludes zero"),
        ("rouge1", "query", "+1.20", "[-0.10, +2.00]", "crosses zero"),
    ]


def test_content_hash_reads_line_ends_alike(spark, tmp_path):
    body = "é\nline\x50\xd0\n".encode("latin-1") + bytes(range(256))
    (tmp_path / "unix").write_bytes(body)
    (tmp_path / "dos").write_bytes(body.replace(b"\n", b"\r\n"))
    got = {r.sha256 for r in readers.content_hash(spark, str(tmp_path)).collect()}
    assert got == {hashlib.sha256(body).hexdigest()}
    files = readers.content_hash(spark, str(tmp_path)).withColumn("path", F.regexp_extract("path", r"[^/]+$", 0))
    want = spark.createDataFrame([("unix", got.pop()), ("dos", "0"), ("gone", "1")], "path string, expected_sha256 string")
    assert sorted(r.path for r in readers.verify_artifacts(files, want).collect()) == ["dos", "gone"]
    size = readers.directory_bytes(spark, str(tmp_path)).first()
    assert size.total_bytes == 2 * len(body) + body.count(b"\n") and size.largest.endswith("dos")


def test_json_lines_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("a", "é ü"), ("b", None)], "query_id string, prediction string")
    writers.write_jsonl(df, str(tmp_path / "out"))
    assert sorted(map(tuple, spark.read.schema("query_id string, prediction string").json(str(tmp_path / "out")).collect()), key=str) == [("a", "é ü"), ("b", None)]
    writers.write_row(df.where("query_id = 'b'"), str(tmp_path / "row"))
    text = next((tmp_path / "row").glob("*.json")).read_text()
    assert json.loads(text) == {"query_id": "b", "prediction": None}


# --- plug-ins and the collector ---------------------------------------------------------------


def test_only_transient_failures_are_tried_again():
    calls, naps = [], []

    def flaky():
        calls.append(1)
        if len(calls) < 3:
            raise plugins.Transient()
        return "ok"

    assert plugins.persistent(flaky, sleep=naps.append) == "ok"
    assert len(naps) == 2 and 2 <= naps[0] <= 3 and 4 <= naps[1] <= 6
    with pytest.raises(KeyError):
        plugins.persistent(lambda: {}["x"], sleep=naps.append)
    assert len(naps) == 2
    with pytest.raises(plugins.Transient):
        plugins.persistent(lambda: (_ for _ in ()).throw(plugins.Transient()), (0.5,), naps.append)
    assert len(naps) == 3


def test_generator_and_client(spark):
    prompts = spark.createDataFrame([(f"q{i}", f"p{i}") for i in range(6)], "query_id string, prompt string").coalesce(1)
    out = plugins.generate(prompts, lambda: lambda p: {"text": f" {p}! ", "new_tokens": 2}, "echo").collect()
    assert sorted(r.prediction for r in out) == [f"p{i}!" for i in range(6)]
    assert all(r.generate_s >= 0 and r.new_tokens == 2 and r.prompt_tokens is None for r in out)
    reqs = prompts.selectExpr("query_id cache_key", "'m' model", "prompt")
    got = plugins.call_client(reqs, lambda: lambda m, p: {"text": p, "truncated": p == "p1"}, "client").collect()
    assert {r.cache_key: r.truncated for r in got}["q1"] and len(got) == 6


def _line(qid, code=200, error=None):
    body = {
        "model": "m-1",
        "choices": [{"message": {"content": f"text of {qid}"}, "finish_reason": "stop"}],
        "usage": {"prompt_tokens": 10, "completion_tokens": 4, "completion_tokens_details": {"reasoning_tokens": 1}},
    }
    return {"custom_id": qid, "response": {"status_code": code, "body": body}, "error": error}


def test_results_are_cached_once_and_failures_stay_pending(spark, tmp_path):
    landing = tmp_path / "landing"
    landing.mkdir()
    dirs = [str(tmp_path / d) for d in ("cache", "errors", "checkpoint")]
    run = lambda: collector.collect_results(spark, str(landing), *dirs, budget=40000).awaitTermination(120)
    _write(landing / "a.jsonl", [_line("q1"), _line("q2", code=500), _line("q1"), _line("q3", error="expired")])
    run()
    got = {r.query_id: r for r in collector.read_cache(spark, dirs[0]).collect()}
    assert set(got) == {"q1"} and got["q1"].prediction == "text of q1" and got["q1"].reasoning_tokens == 1
    assert {r.query_id: r.error for r in spark.read.parquet(dirs[1]).collect()} == {"q2": "500", "q3": "expired"}
    _write(landing / "b.jsonl", [_line("q1"), _line("q2")])
    run()
    assert sorted(r.query_id for r in collector.read_cache(spark, dirs[0]).collect()) == ["q1", "q2"]


# --- score rows and targets -------------------------------------------------------------------


def _run(spark, rows):
    return spark.createDataFrame(
        rows,
        "query_id string, prediction string, cost_usd double, latency_s double, locate_s double, generate_s double, "
        "warmup boolean, mode string, device string, peak_vram_gb double, peak_vram_reserved_gb double",
    )


def _queries(spark, ids, split="val"):
    return spark.createDataFrame([(i, "m", split, "same words here", "q") for i in ids], "query_id string, meeting_id string, split string, reference string, query string")


def test_score_row_leaves_foreign_rows_out_of_everything(spark):
    rows = [
        ("a", "same words here", 1.0, 9.0, 1.0, 8.0, True, "sync", "g1", 2.0, None),
        ("b", "same words here", 2.0, 3.0, 1.0, 2.0, None, "batch", "g1", 4.0, None),
        ("foreign", "x", 50.0, 99.0, 1.0, 2.0, None, "other", "g9", 90.0, None),
    ]
    r = scoring.score_row(_run(spark, rows), _queries(spark, "ab"), "run", "val").first()
    assert r.n == 2 and r.rouge1 == 1.0 and r.rougeLsum == 1.0 and r.cost_usd_total == 3.0
    assert r.latency_s_mean == 3.0 and r.latency_n_timed == 1
    assert r.device == "g1" and r.billing_mode == "batch+sync"
    assert (r.peak_vram_gb_max, r.peak_vram_gb_median, r.peak_vram_reserved_gb_max) == (4.0, 3.0, None)


def test_figures_that_were_not_measured_are_null(spark):
    rows = [("a", "x", None, None, None, None, None, None, None, None, None), ("b", "x", None, 1.0, None, 2.0, None, None, "", None, None)]
    r = scoring.run_figures(_run(spark, rows)).first()
    assert r.cost_usd_total is None and r.locate_s_mean is None and r.device is None and r.billing_mode is None
    assert r.latency_s_mean == 1.0 and r.generate_s_mean == 2.0


def test_guards(spark):
    row = lambda i: (i, "x", None, None, None, None, None, None, None, None, None)
    for rows, what in [(["a", "a"], "duplicate"), (["a"], "without a prediction")]:
        with pytest.raises(scoring.IncompleteRun, match=what):
            scoring.score_row(_run(spark, [row(i) for i in rows]), _queries(spark, "ab"), "r", "test")
    with pytest.raises(scoring.IncompleteRun, match="no prediction"):
        scoring.score_row(_run(spark, [row("z")]), _queries(spark, "ab"), "r", "train")
    assert scoring.score_row(_run(spark, [row("a")]), _queries(spark, "ab"), "r", "val", allow_partial=True).first().n == 1


def test_training_data_never_sees_the_test_split(spark):
    q = _queries(spark, "a", "test").unionByName(_queries(spark, "b", "train"))
    assert [r.query_id for r in targets.training_queries(q).collect()] == ["b"]
    with pytest.raises(scoring.IncompleteRun, match="without a prompt"):
        targets.rebuilt_prompts(
            spark.createDataFrame([("a", "p", "r")], "query_id string, prompt string, response string"),
            spark.createDataFrame([("b", "p")], "query_id string, prompt string"),
        )


def test_span_sources_of_a_whole_transcript_stop_at_the_budget(spark, monkeypatch):
    monkeypatch.setattr(targets, "CHUNK_LINES", 8)
    gold = spark.createDataFrame(
        [("q", "?", "r", k, 3, f"a{k} b{k} c{k}") for k in range(100)],
        "query_id string, query string, reference string, start int, n_words int, text string",
    )
    all_words = [w for k in range(100) for w in (f"a{k}", f"b{k}", f"c{k}")]
    for budget in (1, 24, 50, 299):
        assert targets.span_sources(gold, budget).first().source == " ".join(all_words[:budget])
    assert targets.span_sources(gold, 300).first().source.count("\n") == 99


def test_strict_rescoring_fails_on_drift(spark):
    cols = "run_id string, n bigint, rouge1 double, rouge2 double, rougeL double, rougeLsum double"
    old = spark.createDataFrame([("r", 2, 0.1, 0.2, 0.3, 0.4)], cols)
    assert maintenance.rescored_rows(old, old.withColumn("rougeLsum", F.lit(0.5))).first().delta == pytest.approx(0.1)
    with pytest.raises(Exception, match="scores moved"):
        maintenance.rescored_rows(old, old.withColumn("rouge2", F.lit(0.5))).collect()


def test_spread_sample_orders_by_length_and_then_by_any_id(spark):
    df = spark.createDataFrame([(1, 2**33), (2, 5), (1, 7), (3, 2**40), (2, 2**35)], "n int, id bigint")
    got = sorted((r["rank"], r.n, r.id) for r in maintenance.length_spread_sample(df, "n", "id", 9).collect())
    assert got == [(0, 1, 7), (1, 1, 2**33), (2, 2, 5), (3, 2, 2**35), (4, 3, 2**40)]
    assert sorted(r["rank"] for r in maintenance.length_spread_sample(df, "n", "id", 3).collect()) == [0, 2, 4]


def test_long_tables_are_written_as_markdown(spark, tmp_path):
    df = spark.range(12_000).selectExpr("id", "CASE WHEN id = 3 THEN 'a|b' END AS t").coalesce(2).orderBy("id")
    writers.write_markdown(df, str(tmp_path / "md"), "T", ["note"])
    lines = "".join(p.read_text() for p in sorted((tmp_path / "md").glob("part-*"))).splitlines()
    assert lines[:4] == ["# T", "", "| id | t |", "|---|---|"] and lines[7] == "| 3 | a\\|b |"
    assert len(lines) == 12_006 and lines[-1] == "- note"


def test_probe_ranks_round_halves_to_even():
    assert maintenance.probe_ranks(10, 1) == [9]
    assert maintenance.probe_ranks(4, 9) == [0, 1, 2, 3]
    assert maintenance.probe_ranks(10, 4) == sorted({round(k * 3.0) for k in range(4)})
    assert maintenance.probe_ranks(6, 3) == [0, 2, 5]


def test_chunks(spark):
    df = spark.createDataFrame([([7, 7], list(range(10, 23)))], "p array<int>, t array<int>")
    pick = lambda **kw: [(list(c.ids), list(c.mask)) for c in df.select(chunks.chunk_tokens(F.col("p"), F.col("t"), 6, 4, **kw).alias("c")).first().c]
    full = pick()
    assert len(full) == 7
    assert full[0] == ([7, 7, 10, 11, 12, 13], [1] * 6) and full[3] == ([7, 7, 22, 1, 1, 1], [1, 1, 1, 0, 0, 0])
    assert full[4] == ([7, 7, 12, 13, 14, 15], [1] * 6) and full[6][0] == [7, 7, 20, 21, 22, 1]
    assert [len(c[0]) for c in pick(pad=False)] == [6] * 7
    assert len(pick(stride=False)) == 4
    short = spark.createDataFrame([([7], [1])], "p array<int>, t array<int>")
    c = short.select(chunks.chunk_tokens(F.col("p"), F.col("t"), 4, 3, pad=False).alias("c")).first().c
    assert [list(x.ids) for x in c] == [[7, 1, 1, 1]]


def test_masked_examples(spark):
    df = spark.createDataFrame([([1, 2], [3, 4, 5]), ([1], [2])], "p array<int>, r array<int>")
    ex = df.select(F.lit(0).alias("b"), chunks.masked_example(F.col("p"), F.col("r"), 4).alias("e")).select("b", "e.*")
    got = sorted((r.input_ids, r.labels, r.attention_mask) for r in chunks.padded_batches(ex, ["b"], 0).collect())
    assert got == [([1, 2, 0, 0], [-100, 2, -100, -100], [1, 1, 0, 0]), ([1, 2, 3, 4], [-100, -100, 3, 4], [1, 1, 1, 1])]
