"""Mixing, fill-in-middle and conversation repair against plain Python."""

import hashlib
import heapq
import itertools
import random
import re
import zlib
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from convolens.llm import fim, mixing, turns

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_targets(sizes, weights, share, epochs):
    """Targets of sources in order, in fractions."""
    open_, out = set(range(len(sizes))), {}
    left = Fraction(share) * sum(sizes)
    while open_:
        total = sum(weights[k % len(weights)] for k in open_)
        over = {k for k in open_ if left * weights[k % len(weights)] >= epochs * sizes[k] * total}
        if not over:
            return [float(out[k]) if k in out else float(left * weights[k % len(weights)] / total) for k in range(len(sizes))]
        for k in over:
            out[k] = Fraction(epochs) * sizes[k]
            left -= out[k]
        open_ -= over
    return [float(out[k]) for k in range(len(sizes))]


def mixing_rows(seed):
    rng = random.Random(seed)
    names = ["b", "a", "é", "", None, "zz", "𐐀", "ｚ"]
    rows = []
    for i in range(300):
        source = "b" if rng.random() < 0.4 else rng.choice(names)
        text = rng.choice([None, "", " \n ", "one", " ".join(["w"] * rng.randrange(1, 80)), "x y  z\t" * rng.randrange(5)])
        rows.append((rng.choice([i, i, None, 7]), text, source, i))
    return rows + [(1000, "w " * 9000, "b", 0), rows[0], rows[0]]


@pytest.mark.parametrize("seed, weights, share, epochs", [(1, (5, 2, 1), 1.5, 2), (2, (1,), 0.5, 1), (3, (7, 1), 2.5, 4), (4, (3, 2), 0.0, 2), (5, (1, 9), 3.0, 2)])
def test_mix(spark, seed, weights, share, epochs):
    rows = mixing_rows(seed)
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, size int")
    got = mixing.mix(df.repartition(5), weights, share, epochs).collect()
    again = mixing.mix(df.repartition(2), weights, share, epochs).collect()
    assert sorted(map(str, got)) == sorted(map(str, again)) and len(got) == len(rows)
    n = lambda t: len(WORD.findall(t or ""))
    names = sorted({r[2] for r in rows}, key=lambda s: (s is None, (s or "").encode()))
    sizes = [sum(n(r[1]) for r in rows if r[2] == s) for s in names]
    want = dict(zip(names, plain_targets(sizes, weights, share, epochs)))
    for s, size in zip(names, sizes):
        own = [r for r in got if r.source == s]
        assert {r.source_size for r in own} == {size} and [r.target for r in own] == pytest.approx([want[s]] * len(own))
        assert sum(r.taken for r in own) == int(own[0].target)
        assert all(r.taken <= epochs * r.size and r.taken == r.copies * r.size + r.part for r in own)
        # Whole repetitions but for one document.
        assert sum(0 < r.part < r.size for r in own) <= 1
    assert sorted((r.doc_id or -1, r.size) for r in got) == sorted((r[0] or -1, n(r[1])) for r in rows)


def test_mixed_rows_hold_the_words_taken(spark):
    rows = mixing_rows(6)
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, size int")
    out = mixing.mixed(df).collect()
    taken = mixing.mix(df).groupBy("source").agg(F.sum("taken").alias("n")).collect()
    words = lambda s: sum(len(WORD.findall(r.text or "")) for r in out if r.source == s)
    assert all(words(r.source) == r.n for r in taken) and out[0].asDict().keys() == set(df.columns)
    assert mixing.mix(df.limit(0)).count() == 0 and mixing.mixed(df.limit(0)).count() == 0


def test_mixing_with_many_sources_and_bad_parameters(spark):
    df = spark.range(3000).select(F.col("id").alias("doc_id"), F.concat(F.lit("s"), F.col("id") % 1500).alias("source"), F.expr("repeat('w ', cast(id % 7 as int))").alias("text"))
    got = mixing.mix(df).collect()
    total = sum(r.size for r in got)
    by = {}
    for r in got:
        by.setdefault(r.source, []).append(r)
    assert len(by) == 1500 and all(sum(r.taken for r in v) == int(v[0].target) for v in by.values())
    assert sum(v[0].target for v in by.values()) == pytest.approx(1.5 * total)
    for bad in ({"weights": ()}, {"weights": (1, 0)}, {"epochs": 0}, {"share": -1}):
        with pytest.raises(ValueError):
            mixing.mix(df, **bad)


def plain_fim(i, text):
    text = text or ""
    h = hashlib.sha256(f"1:{'' if i is None else i}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * k : 8 * k + 8], 16) for k in range(4))
    n = len(text)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    if not text or any(s in text for s in fim.SENTINELS) or h3 % 100 >= 90:
        return (i, n, "plain", None, None, text)
    pre, mid, suf = text[:a], text[a:b], text[b:]
    if h4 % 100 < 20:
        return (i, n, "spm", a, b - a, f"<S>{suf}<P>{pre}<M>{mid}")
    return (i, n, "psm", a, b - a, f"<P>{pre}<S>{suf}<M>{mid}")


def test_fill_in_middle(spark):
    rng = random.Random(3)
    letters = "abéß漢𐐀 <PSM>\n"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randrange(60))) for _ in range(400)]
    texts += [None, "", "x", "a<P>b", "<S>", "<M", "<<P", "long é " * 50_000, texts[0]]
    rows = list(enumerate(texts)) + [(None, "no id"), (3, "again"), (3, "again")]
    df = spark.createDataFrame([(i, t, "o", "f") for i, t in rows], "doc_id long, text string, output string, form string").repartition(3)
    out = fim.transform(df)
    got = sorted(((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in out.collect()), key=str)
    assert got == sorted((plain_fim(*r) for r in rows), key=str)
    assert {r[2] for r in got} == {"plain", "psm", "spm"}
    back = sorted(r.restored for r in fim.restore(out).collect())
    assert back == sorted(t or "" for _, t in rows)
    assert fim.transform(df.limit(0)).count() == 0


def test_fill_in_middle_parameters(spark):
    df = spark.createDataFrame([(i, f"text {i}") for i in range(200)], "doc_id long, text string")
    forms = lambda **k: {r.form for r in fim.transform(df, **k).collect()}
    assert forms(plain_percent=0, spm_percent=100) == {"spm"} and forms(plain_percent=100) == {"plain"}
    other = fim.transform(df, seed=2, sentinels=("[pre]", "[suf]", "[mid]"))
    assert sorted(r.restored for r in fim.restore(other, ("[pre]", "[suf]", "[mid]")).collect()) == sorted(f"text {i}" for i in range(200))
    for bad in (("<P>", "<P>", "<M>"), ("<P>", "", "<M>"), ("<P", "<P<S", "x")):
        with pytest.raises(ValueError):
            fim.transform(df, sentinels=bad)


@pytest.mark.parametrize("n", [0, 1, 2, 3, 65_535, 65_536, 200_001])
def test_exchange_in_place(n):
    import numpy as np

    for m in {0, n // 3, n}:
        data = np.arange(n) % 251
        want = np.concatenate([data[m:], data[:m]])
        fim.exchange(data, 0, m, n)
        assert (data == want).all()


def plain_edits(rows):
    """Cheapest cost and least letters by Dijkstra over (row, state), letters carried along. rows: (letter of fault, initial)."""
    heap, done = [(0, "", 0, 0)], set()
    while heap:
        cost, way, i, state = heapq.heappop(heap)
        if i == len(rows) and state in (0, 3):
            return cost, way
        if (i, state) in done:
            continue
        done.add((i, state))
        need = 3 if state == 2 else 2
        heapq.heappush(heap, (cost + 3, way + "I", i, need))
        if i < len(rows):
            fault, initial = rows[i]
            heapq.heappush(heap, (cost + 4, way + "D", i + 1, state))
            if fault not in "bd":
                extra = 3 * (fault == "t")
                keep = 1 if state == 0 and initial == "s" else need if initial == ("a" if state == 2 else "u") else None
                if keep:
                    heapq.heappush(heap, (cost + extra, way + "K", i + 1, keep))
                heapq.heappush(heap, (cost + 3 + extra, way + "R", i + 1, need))


def plain_repair(rows):
    """All conversations of (conv, turn, role, text), damaged and repaired from the contract."""
    out = {}
    for conv, turn, role, text in rows:
        out.setdefault(conv, [])
        k = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if k == 0:
            continue
        text = "" if k == 1 else re.sub("[.!?]", "", text) if k == 2 else text
        out[conv] += [(turn, "user" if k == 4 else role, text)] * (2 if k == 3 else 1)
    result = []
    for conv, held in out.items():
        key = lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.md5(f"{len(r[1])}:{r[1]}{r[2]}".encode()).hexdigest())
        held.sort(key=key)
        seen, faults = set(), []
        for _, role, text in held:
            bare = text.rstrip(" \t\n\v\f\r")
            faults.append("b" if not bare else "d" if (role, text) in seen else "t" if bare[-1] not in ".!?" else "-")
            seen.add((role, text))
        known = [t for t, _, _ in held if t is not None]
        pairs = [x[1][:1] + y[1][:1] for x, y in zip(held, held[1:])]
        cost, way = plain_edits([(f, r[1][:1]) for f, r in zip(faults, held)])
        lines, state, i = [], 0, 0
        for e in way:
            if e == "D":
                i += 1
                continue
            need = 3 if state == 2 else 2
            if e == "K" and state == 0 and held[i][1][:1] == "s":
                need = 1
            role = held[i][1] if e == "K" else ("user", "assistant")[need == 3]
            lines.append(f"{role}:{'' if e == 'I' else held[i][2]}")
            i += e != "I"
            state = need
        gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
        result.append((
            conv, gaps, faults.count("b"), faults.count("d"), faults.count("t"), sum(p not in ("su", "ua", "au") for p in pairs), cost, way,
            hashlib.sha256("\n".join(lines).encode()).hexdigest(),
        ))
    return sorted(result, key=str)


def test_prices_are_cheapest_costs():
    rng = random.Random(5)
    letters = "dsuaxSUAX"
    forms = ["".join(p) for n in range(4) for p in itertools.product(letters, repeat=n)]
    forms += ["".join(rng.choice(letters) for _ in range(rng.randrange(4, 40))) for _ in range(300)] + ["u" * 200, "d" * 100, "sua" * 50]
    for form in forms:
        rows = [("d" if c == "d" else "t" if c.isupper() else "-", c.lower()) for c in form]
        assert turns.cheapest(form) == plain_edits(rows), form


def test_matrix_holds_the_ways_through_a_piece():
    for form in ("", "d", "s", "su", "ddu", "asUx", "uau" * 3):
        rows = [("d" if c == "d" else "t" if c.isupper() else "-", c.lower()) for c in form]
        m = turns.matrix(form)
        assert min(m[0] + turns.END[0], *(m[e] + turns.END[e] for e in range(1, 4))) == plain_edits(rows)[0]
        assert all(m[4 * a + b] >= turns.NONE for a in range(4) for b in range(2) if a > b)


def conversations(seed):
    rng = random.Random(seed)
    rows = []
    for conv in [*range(40), None]:
        for turn in range(rng.randrange(9)):
            turn = rng.choice([turn, turn, turn, turn + 3, None])
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None])
            rows.append((conv, turn, role, rng.choice([None, "", "\n \t", "Hi.", "Hi. ", "no end", "Ask? {}".format(rng.random()), "a\nb!", "wide "])))
    # One conversation with a third of all rows, full of repeats.
    rows += [(99, t, ("user", "assistant")[rng.random() < 0.4], rng.choice(["Yes.", "No!", "why", f"It is {t}."])) for t in range(130)]
    return rows + rows[:5] + [(77, 5, "user", "Same."), (77, 5, "user", "Same."), (78, None, "user", "Same.")]


@pytest.mark.parametrize("seed, size", [(1, 512), (2, 1), (3, 7)])
def test_repair(spark, seed, size):
    rows = conversations(seed)
    schema = "conv_id long, turn long, role string, text string, live int, part string"
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], schema).repartition(3)
    got = sorted((tuple(r[c] for c in ("conv", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")) for r in turns.repair(turns.damaged(df), size).collect()), key=str)
    assert got == plain_repair(rows)


def test_repaired_lines_and_empty_tables(spark):
    rows = conversations(4)
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(2)
    lines = {}
    for r in sorted(turns.repaired(turns.damaged(df), 5).collect(), key=lambda r: (r.part, r.seq, r.pos)):
        lines.setdefault(r.conv, []).append(r.line)
    for conv, *_, digest in plain_repair(rows):
        assert hashlib.sha256("\n".join(lines.get(conv, [])).encode()).hexdigest() == digest
    assert turns.repair(turns.damaged(df.limit(0))).count() == 0
    gone = spark.createDataFrame([(1, 1, "user", "x")], "conv_id long, turn long, role string, text string").select("*").withColumn("turn", F.lit(None).cast("long"))
    assert len(turns.repair(turns.damaged(gone)).collect()) == 1
