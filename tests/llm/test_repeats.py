"""Both substring operators against plain counting of windows."""

import random
from collections import Counter

import numpy as np
import pytest

from convolens.llm import anchors, repeats, seed_extend, suffix_bwt
from convolens.llm import common as C


def texts(seed, n, words, vocabulary=30):
    """Texts of few words, with passages that they share, copies, and very repetitive ones."""
    rng = random.Random(seed)
    passages = [[f"w{rng.randrange(vocabulary)}" for _ in range(words + rng.randrange(2 * words))] for _ in range(4)]
    out = []
    for _ in range(n):
        t = []
        for _ in range(rng.randrange(5)):
            t += rng.choice(passages) if rng.random() < 0.6 else [f"w{rng.randrange(vocabulary)}" for _ in range(rng.randrange(3 * words))]
            if t and rng.random() < 0.4:
                t[rng.randrange(len(t))] = "edit"
        out.append(rng.choice([" ", "\n", "  "]).join(t))
    return out + ["", None, "ha " * (4 * words), "ha " * (2 * words), out[0], out[0]]


def plain_words(rows, length):
    first = {}
    split = [(i, (t or "").encode().split()) for i, t in rows]
    for i, w in split:
        for k in range(len(w) - length + 1):
            key = tuple(w[k : k + length])
            first[key] = min(first.get(key, i), i)
    out = []
    for i, w in split:
        gone = set()
        for k in range(len(w) - length + 1):
            if first[tuple(w[k : k + length])] < i:
                gone.update(range(k, k + length))
        out.append((i, len(w), len(gone), b" ".join(x for k, x in enumerate(w) if k not in gone).decode()))
    return sorted(out)


def plain_bytes(rows, length):
    data = [(i, (t or "").encode()) for i, t in rows]
    count = Counter(b[k : k + length] for _, b in data for k in range(len(b) - length + 1))
    out = []
    for i, b in data:
        gone = np.zeros(len(b) + 2, bool)
        for k in range(len(b) - length + 1):
            if count[b[k : k + length]] > 1:
                gone[k + 1 : k + 1 + length] = True
        spans = int((gone[1:] & ~gone[:-1]).sum())
        out.append((i, len(b), int(gone.sum()), spans, bytes(x for k, x in enumerate(b) if not gone[k + 1])))
    return sorted(out)


@pytest.mark.parametrize("seed, length, gram, crowd", [(1, 6, 2, 4096), (2, 6, 3, 0), (3, 9, 4, 2), (4, 1, 10, 4096)])
def test_word_windows(spark, monkeypatch, seed, length, gram, crowd):
    kind = repeats.Kind
    monkeypatch.setattr(repeats, "Kind", lambda *a: kind(*a, crowd))
    rows = list(enumerate(texts(seed, 30, length)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted((r.doc_id, r.n_words, r.n_removed, r.kept) for r in seed_extend.dedup(df, length, gram).collect())
    assert got == plain_words(rows, length)


@pytest.mark.parametrize("seed, length, gram, crowd", [(1, 16, 5, 4096), (2, 24, 9, 0), (3, 10, 3, 2), (4, 7, 40, 4096)])
def test_byte_windows(spark, monkeypatch, seed, length, gram, crowd):
    kind = repeats.Kind
    monkeypatch.setattr(repeats, "Kind", lambda *a: kind(*a, crowd))
    rows = list(enumerate([t and t.replace("w1", "é") for t in texts(seed, 25, 6)]))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in suffix_bwt.dedup(df, length, gram).collect())
    assert got == plain_bytes(rows, length)


def test_ids_that_are_null_or_repeat_and_clashing_columns(spark):
    a, b = " ".join(f"a{i}" for i in range(12)), " ".join(f"b{i}" for i in range(12))
    rows = [(None, a, "x"), (1, a, "y"), (1, a, "y"), (1, b, "y"), (2, b + " end", "z"), (None, b, "x"), (None, "n " * 30, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, doc string")
    got = sorted((r.doc_id or 0, r.n_removed, r.kept) for r in seed_extend.dedup(df, 10, 3).collect())
    # Rows of an id do not thin each other; rows without one come last and are thinned.
    assert got == sorted([(1, 0, a), (1, 0, a), (1, 0, b), (2, 12, "end"), (0, 12, ""), (0, 12, ""), (0, 0, " ".join(["n"] * 30))])
    thin = sorted((r.doc_id or 0, r.text, r.doc) for r in seed_extend.thinned(df, 10, 3).collect())
    assert (2, "end", "z") in thin and (0, "n " * 30, "x") in thin and len(thin) == len(rows)
    removed = sorted((r.doc_id or 0, r.n_removed, r.n_spans) for r in suffix_bwt.dedup(df, 30, 5).collect())
    assert [x for x in removed if x[0] == 1] == [(1, len(a), 1)] * 2 + [(1, len(b), 1)]
    assert seed_extend.dedup(df.limit(0)).count() == 0 and suffix_bwt.dedup(df.limit(0)).count() == 0


def test_very_long_texts_are_cut_without_losing_windows(monkeypatch):
    rng = np.random.default_rng(5)
    symbols = C.numbers(9, 20)[rng.integers(0, 20, 5000)]
    whole = anchors.runs(symbols, np.array([0, 5000]), 12, 4)
    pieces = list(anchors.chunked(np.array([0, 5000]), 12, 300))
    assert len(pieces) > 10
    starts = lambda r, base: [(base + p + k, int(a), base + p + l) for p, w, l, a in zip(r.pos, r.windows, r.lead, r.anchor) for k in range(w)]
    cut = sorted(x for lo, hi, at, _, before in pieces for x in starts(anchors.runs(symbols[lo:hi], at, 12, 4), before))
    assert cut == sorted(starts(whole, 0)) and len(cut) == 5000 - 11


def test_transform_and_common_prefixes_are_those_of_sorted_suffixes():
    rng = np.random.default_rng(1)
    for _ in range(60):
        strings = [bytes(rng.integers(97, 99, rng.integers(0, 12)).astype(np.uint8)) for _ in range(rng.integers(1, 8))]
        symbols = np.frombuffer(b"".join(strings), np.uint8)
        bwt, lcp = suffix_bwt.collection(symbols, np.cumsum([0, *map(len, strings)]), 5)
        order = sorted((tuple(x + 1 for x in s[i:]) + (0, k), k, i) for k, s in enumerate(strings) for i in range(len(s) + 1))
        assert list(bwt) == [strings[k][i - 1] if i else 255 for _, k, i in order]
        common = [0] + [min(5, next(j for j in range(99) if a[0][j] != b[0][j] or a[0][j] == 0)) for a, b in zip(order, order[1:])]
        assert list(lcp) == common
