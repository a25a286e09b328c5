"""BPE and rANS against the tokenizers library."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from convolens.llm import bpe, queries, rans
from convolens.llm import common as C

PATH = public_tokenizers.path("byte_bpe_50k.json")
TEXTS = [
    "", " ", "a", "Hello world", "  two  spaces\n\n tab\t", "don't I'll we've", "x<|endoftext|>y<|endoftext|><|endoftext|> z", "日本語 テキスト 123 ４５",
    "é 😀😀 \x00\x1c\x85  x", "a" * 3000, "ab" * 1500, "֘ ࢏ new", "!!'s ''s", "\n", "x" * 70 + " " + "y" * 70,
]
rows = lambda texts: [(i, t) for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def test_segment_tree_gives_the_librarys_ids(library):
    own = bpe.codec(PATH)
    rng = random.Random(3)
    texts = TEXTS + ["".join(chr(rng.choice([rng.randrange(32, 127), rng.randrange(0xA0, 0x250), rng.randrange(0x4E00, 0x5000), rng.randrange(0x1F600, 0x1F640), rng.randrange(0x10000, 0x1FFF0)])) for _ in range(60)) for _ in range(400)]
    for text, want in zip(texts, library.encode_batch(texts, add_special_tokens=False)):
        assert own.encode(text) == want.ids
        assert own.decode(want.ids) == library.decode(want.ids, skip_special_tokens=False)


def test_characters_that_are_cut_alike_are_those_of_every_unicode_version(library):
    own = bpe.codec(PATH).cutter
    for c in [*range(0x20, 0x3000), *range(0x1F300, 0x1F650)]:
        text = f"a{chr(c)}1{chr(c)}!{chr(c)} "
        if not bpe.AGREED.search(text):
            assert own.findall(text) == [text[a:b] for _, (a, b) in library.pre_tokenizer.pre_tokenize_str(text)]


def test_encode_takes_nulls_repeats_and_clashing_names(spark, library):
    df = spark.createDataFrame([(1, None, "p"), (None, "a b", "q"), (1, "a b", "r"), (1, "a b", "r")], "doc_id long, text string, ids string")
    got = sorted((r.doc_id is not None, r.doc_id or 0, r.ids, r.decoded) for r in bpe.encode(df, PATH, decoded=True).collect())
    ids = library.encode("a b").ids
    assert got == sorted([(True, 1, [], ""), (False, 0, ids, "a b"), (True, 1, ids, "a b"), (True, 1, ids, "a b")])
    assert bpe.encode(df.limit(0), PATH).count() == 0
    back = bpe.decode(bpe.encode(df, PATH), PATH).collect()
    assert sorted(r.text for r in back) == ["", "a b", "a b", "a b"]


def test_bpe_query(spark, sf_dir, library):
    got = {r.doc_id: r for r in queries.QUERIES["op9_bpe"](spark, sf_dir).collect()}
    for r in C.documents(spark, sf_dir).collect():
        ids = library.encode(r.text or "", add_special_tokens=False).ids
        assert got[r.doc_id].n_tokens == len(ids)
        assert got[r.doc_id].ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert got[r.doc_id].decoded_sha256 == hashlib.sha256((r.text or "").encode()).hexdigest()


def test_texts_cut_together_get_the_librarys_ids(library):
    rng = random.Random(5)
    letters = ["'"] * 6 + list("stmdrevlLx \n\t ") + [" "] * 4 + ["  ", "é", "\u3000", "\u2003", "\x85", "\xa0", "1", "٣", "²", "!", "😀", "日", "\x1c"]
    rare = ["\0", "࢏", "<|endoftext|>"]
    texts = [None, *TEXTS, *("".join(rng.choice(letters if i % 8 else letters + rare) for _ in range(rng.randrange(30))) for i in range(5000)), None, ""]
    want = [x.ids for x in library.encode_batch([t or "" for t in texts], add_special_tokens=False)]
    own = rans.Ids(PATH)
    column = pa.array(texts)
    assert [x.tolist() for x in own.encode(column)] == want
    for a, b in ((0, 0), (0, 1), (7, 1200), (1200, 4000), (len(texts) - 2, len(texts))):
        assert [x.tolist() for x in own.encode(column.slice(a, b - a))] == want[a:b]


def test_a_distinct_piece_is_merged_once(library, monkeypatch):
    own = rans.Ids(PATH)
    seen = []
    merged = own.merged
    monkeypatch.setattr(own, "merged", lambda pieces: seen.extend(pieces.split("\0")) or merged(pieces))
    texts = ["unremarkable words, unremarkably repeated", "repeated words"] * 100
    want = [x.ids for x in library.encode_batch(texts, add_special_tokens=False)]
    for _ in range(2):
        assert [x.tolist() for x in own.encode(pa.array(texts))] == want
    assert sorted(seen) == [" repeated", " unremarkably", " words", ",", "repeated", "unremarkable"]
    monkeypatch.setattr(bpe, "REMEMBERED", 3)
    assert [x.tolist() for x in own.encode(pa.array(texts[1:2]))] == want[1:2]
    assert list(own.known) == ["repeated", " words"] and len(own.lists) == 2


@pytest.mark.parametrize("n", [1, 2, 63, 65, 500, 5000, 70000])
def test_blocks_round_trip_from_every_checkpoint(n):
    rng = np.random.default_rng(n)
    ids = (rng.zipf(1.3, n) % 50257).astype(np.uint32)
    known, count = np.unique(ids, return_counts=True)
    freqs = rans.Table.scaled(known.astype(np.int64), count)
    assert freqs.sum() == 1 << rans.SCALE and freqs.min() >= 1
    table = rans.Table(known.astype(np.int64), freqs)
    for lanes, steps in ((512, 128), (7, 3), (64, 1)):
        got_lanes, marks, words = rans.encode_block(ids, table, lanes, steps)
        assert (rans.decode_block(n, got_lanes, marks, words, table, steps) == ids).all()
    bits = -(count / n * np.log2(count / n)).sum() * n
    assert 32 * len(words) <= 1.05 * bits + 64 * got_lanes


def test_more_rare_ids_than_fit_in_proportion():
    count = np.array([10**12] + [1] * 200_000)
    freqs = rans.Table.scaled(np.arange(len(count)), count)
    assert freqs.sum() == 1 << rans.SCALE and freqs.min() == 1


def test_files_hold_all_ids_in_order(spark, library):
    texts = TEXTS + ["word " * 400, None]
    df = spark.createDataFrame([*[(i * 3 % 19, t, 0) for i, t in enumerate(texts)], (4, "same", 0), (4, "same", 0)], "doc_id long, text string, n long")
    path = C.new_path(spark, "test")
    rans.write(df, path, PATH, block=100)
    got = sorted(rans.read(spark, path).collect(), key=lambda r: r.start)
    want = sorted(((r.doc_id, r.text or "") for r in df.collect()))
    assert [r.doc_id for r in got] == [d for d, _ in want]
    at = 0
    for r in got:
        assert r.start == at and r.n == len(r.ids) // 4
        at += r.n
    ids = lambda t: np.array(library.encode(t, add_special_tokens=False).ids + [0], "<u4").tobytes()
    assert sorted((r.doc_id, bytes(r.ids)) for r in got) == sorted((d, ids(t)) for d, t in want)


def test_empty_table_and_damage(spark):
    df = spark.createDataFrame([(1, "some words here")], "doc_id long, text string")
    path = C.new_path(spark, "empty")
    rans.write(df.limit(0), path, PATH)
    assert rans.read(spark, path).count() == 0
    path = C.new_path(spark, "damaged")
    rans.write(df, path, PATH)
    blocks = spark.read.parquet(f"{path}/blocks")
    other = C.new_path(spark, "damaged")
    spark.read.parquet(f"{path}/table").write.parquet(f"{other}/table")
    blocks.selectExpr("part", "seq", "start", "n", "lanes", "checkpoints", "words", "checksum + 1 AS checksum", "docs").write.parquet(f"{other}/blocks")
    with pytest.raises(Exception, match="damaged"):
        rans.read(spark, other).collect()


def test_rans_query(spark, sf_dir, library):
    got = {r.doc_id: r for r in queries.QUERIES["op1_rans"](spark, sf_dir).collect()}
    at = 0
    for r in C.documents(spark, sf_dir).orderBy("doc_id").collect():
        ids = np.array(library.encode(r.text or "", add_special_tokens=False).ids + [0], "<u4")
        assert (got[r.doc_id].start, got[r.doc_id].n_tokens, got[r.doc_id].ids_crc32) == (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
