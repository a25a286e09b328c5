import random

import pytest
from pyspark.sql import functions as F

from convolens.functions import rouge as R
from convolens.functions.stemmer import stem
from convolens.functions.text import alnum_tokens

# Published examples of the algorithm and of the irregular forms.
STEMS = """caresses caress|ponies poni|ties tie|cats cat|feed feed|agreed agre|plastered plaster|bled bled|
motoring motor|sing sing|conflated conflat|troubled troubl|sized size|hopping hop|tanned tan|falling fall|
hissing hiss|fizzed fizz|failing fail|filing file|happy happi|sky sky|relational relat|conditional condit|
rational ration|valenci valenc|hesitanci hesit|digitizer digit|radicalli radic|differentli differ|vileli vile|
analogousli analog|vietnamization vietnam|predication predic|operator oper|feudalism feudal|decisiveness decis|
hopefulness hope|callousness callous|formaliti formal|sensitiviti sensit|sensibiliti sensibl|triplicate triplic|
formative form|formalize formal|electriciti electr|electrical electr|hopeful hope|goodness good|revival reviv|
allowance allow|inference infer|airliner airlin|gyroscopic gyroscop|adjustable adjust|defensible defens|
irritant irrit|replacement replac|adjustment adjust|dependent depend|adoption adopt|homologou homolog|
communism commun|activate activ|angulariti angular|homologous homolog|effective effect|bowdlerize bowdler|
probate probat|rate rate|cease ceas|controll control|roll roll|dying die|news news|enjoy enjoy|cry cri|by by|
say say|died die|spied spi|dies die|proceed proceed|skies sky|used use|geology geolog|meetings meet|discussed discuss"""


def test_stemmer_vocabulary():
    for pair in STEMS.replace("\n", "").split("|"):
        word, want = pair.split()
        assert stem(word) == want, word


def _brute_lcs(a, b):
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
    return best[-1][-1]


def _brute_members(a, b):
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
    i, j, out = len(a), len(b), set()
    while i and j:
        if a[i - 1] == b[j - 1]:
            out.add(i - 1)
            i, j = i - 1, j - 1
        elif best[i][j - 1] > best[i - 1][j]:
            j -= 1
        else:
            i -= 1
    return out


def test_lcs_matches_brute_force():
    rng = random.Random(4)
    for _ in range(200):
        a = [rng.choice("abcde") for _ in range(rng.randrange(0, 30))]
        b = [rng.choice("abcde") for _ in range(rng.randrange(0, 30))]
        want = _brute_lcs(a, b)
        assert R.lcs_length(a, b) == want
        if a and b:
            assert R.lcs_members(a, b) == _brute_members(a, b)


def test_hand_computed_scores():
    s = R.score_pair("the cat sat on the mat", "the cat was on the mat", R.METRICS, stemmed=False)
    assert s["rouge1"] == pytest.approx((5 / 6, 5 / 6, 5 / 6))
    assert s["rouge2"] == pytest.approx((3 / 5, 3 / 5, 3 / 5))
    assert s["rougeL"] == pytest.approx((5 / 6, 5 / 6, 5 / 6))
    # Union over sentences: "w1 w2 w3 w4 w5" against "w1 w2 w6 w7 w8" and "w1 w3 w8 w9 w5" matches 4 of 5.
    s = R.score_pair("w1 w2 w6 w7 w8. w1 w3 w8 w9 w5.", "w1 w2 w3 w4 w5", ["rougeLsum"], stemmed=False)
    assert s["rougeLsum"] == pytest.approx((4 / 10, 4 / 5, 2 * 0.4 * 0.8 / 1.2))


def test_layout_does_not_change_the_score():
    one = "We met today. It went well! Did it? Yes."
    para = "We met today.\n\nIt went well!\nDid it?\r\n Yes."
    ref = "They met today. Things went well."
    assert R.score_pair(one, ref, R.METRICS) == R.score_pair(para, ref, R.METRICS)


def test_empty_and_missing():
    for p, r in [("", "a b"), (None, "a b"), ("a b", ""), (None, None), ("!!", "??")]:
        assert all(v == (0.0, 0.0, 0.0) for v in R.score_pair(p, r, R.METRICS).values())


def test_identity_and_symmetry(spark):
    rows = [("a b. c d.", "a b. c d."), ("running fast", "he runs fast. so fast"), (None, "x")]
    df = spark.createDataFrame(rows, "prediction string, reference string")
    got = R.with_rouge(df).collect()
    assert all(got[0][m]["f"] == 1.0 for m in R.METRICS)
    flipped = R.with_rouge(df.selectExpr("reference as prediction", "prediction as reference")).collect()
    for x, y in zip(got, flipped):
        for m in ("rouge1", "rouge2", "rougeL"):
            assert x[m]["p"] == pytest.approx(y[m]["r"]) and x[m]["f"] == pytest.approx(y[m]["f"])


def test_token_f1_in_the_jvm(spark):
    rng = random.Random(7)
    rows = [
        (" ".join(rng.choices("abcd", k=rng.randrange(0, 9))), " ".join(rng.choices("abcd", k=rng.randrange(0, 9))))
        for _ in range(60)
    ]
    df = spark.createDataFrame(rows, "a string, b string")
    got = df.select("a", "b", R.token_f1(alnum_tokens(F.col("a")), alnum_tokens(F.col("b"))).alias("f")).collect()
    for r in got:
        assert r.f == pytest.approx(R.ngram_overlap(r.b.split(), r.a.split(), 1)[2])
