import random

import pytest

from convolens.operators.windows import build_windows, explode_meetings
from tests import models

UTT = "meeting_id string, utt_idx int, speaker string, text string"


def _meetings(seed, sizes, most=30):
    rng = random.Random(seed)
    out = {}
    for k, n in enumerate(sizes):
        out[f"m{k}"] = [
            (f"S{rng.randrange(3)}", " ".join(f"w{rng.randrange(50)}" for _ in range(rng.choice([1, 2, 5, most]))))
            for _ in range(n)
        ]
    return out


def _frame(spark, meetings):
    rows = [(m, i, s, t) for m, us in meetings.items() for i, (s, t) in enumerate(us)]
    return spark.createDataFrame(rows, UTT)


def _collect(df):
    got = {}
    for r in df.orderBy("meeting_id", "win_idx").collect():
        got.setdefault(r.meeting_id, []).append((r.win_idx, r.start, r.end, r.text, r.n_words))
    return got


def _expected(meetings, budget):
    return {
        m: [(k, s, e, t, len(t.split())) for k, (s, e, t) in enumerate(models.windows(us, budget))]
        for m, us in meetings.items()
        if us
    }


@pytest.mark.parametrize("budget", [1, 7, 25, 60])
def test_single_block_matches_model(spark, budget):
    meetings = _meetings(1, [1, 2, 17, 40])
    assert _collect(build_windows(_frame(spark, meetings), budget)) == _expected(meetings, budget)


@pytest.mark.parametrize("budget,block", [(7, 8), (25, 25), (20, 32)])
def test_many_blocks_match_model(spark, budget, block):
    # One transcript spans well over FAN_IN blocks, so the tree of functions has several levels.
    sizes = [1, block, block + 1, 64 * block, 64 * block + 1, 66 * block + 3, 3 * block - 1]
    meetings = _meetings(budget, sizes)
    got = _collect(build_windows(_frame(spark, meetings), budget, block_lines=block))
    assert got == _expected(meetings, budget)


def test_deep_tree(spark):
    meetings = _meetings(9, [64 * 64 * 4 + 70, 5], most=3)
    got = _collect(build_windows(_frame(spark, meetings), 4, block_lines=4))
    assert got == _expected(meetings, 4)


def test_windows_tile(spark):
    meetings = _meetings(3, [50])
    wins = _collect(build_windows(_frame(spark, meetings), 40))["m0"]
    assert wins[0][1] == 0 and wins[-1][2] == 49
    assert all(a[2] + 1 == b[1] for a, b in zip(wins, wins[1:]))


def test_default_budget_and_array_form(spark):
    df = spark.createDataFrame(
        [("m", [("A", "x " * 99) for _ in range(30)])],
        "meeting_id string, utterances array<struct<speaker:string,text:string>>",
    )
    for form in (df, explode_meetings(df)):
        wins = _collect(build_windows(form))["m"]
        assert [(w[1], w[2]) for w in wins] == [(0, 8), (9, 17), (18, 26), (27, 29)]


def test_array_form_matches_model(spark):
    meetings = _meetings(5, [1, 30, 77])
    rows = [(m, us) for m, us in meetings.items()]
    df = spark.createDataFrame(rows, "meeting_id string, utterances array<struct<speaker:string,text:string>>")
    assert _collect(build_windows(df, 25)) == _expected(meetings, 25)
