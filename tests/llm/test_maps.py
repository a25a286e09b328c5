"""Main text, shards, toxicity and the pipeline."""

import hashlib
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from convolens.llm import common as C
from convolens.llm import html_text, queries, sharding, toxicity
from tests.llm.test_pairs import plain_components, plain_leaks, shingles
from tests.llm.test_repeats import plain_words

LONG = "A sentence of the article that goes on for a while, as sentences do. " * 4


@pytest.mark.parametrize(
    "html, text",
    [
        (None, ""), ("", ""), ("just words", "just words"), ("<p></p><div> </div>", ""),
        (f"<nav><ul><li>Menu</li></ul></nav><article><h1>T &amp; U</h1><p>a  b\n c<br>d</p><p>x</p></article><footer>F</footer>", "T & U a b c d x"),
        (f"<div class='top-menu'>m</div><div id=content><p>{LONG}</p><p>Short.</p><aside>s</aside><div class=comments><p>{LONG}</p></div></div><div class=sidebar>{LONG}</div>", f"{LONG.strip()} Short."),
        (f"<main><header>H</header><p>{LONG}<form>f<input></form> tail</p><script>var t = '</p>';</script></main>", f"{LONG.strip()} tail"),
        ("<article><p>un<b>cl</i>os<p>ed &#8212; &nbsp; &eacute;", "unclos ed — é"),
        (f"<article class=comment>{LONG}</article><article><p>Own.</p><div class='cookie-notice'>c</div></article>", "Own."),
        (f"<div class='content with-sidebar'><p>{LONG}</p><p>end</p></div>", f"{LONG.strip()} end"),
    ],
)
def test_main_text(html, text):
    assert html_text.extract(html) == text


def test_content_letters_choose_the_region():
    teaser = "<article><h3>Read this</h3><p>Teaser words.</p></article>"
    long = f"<p>{LONG}</p>" * 6
    for page in (f"<div>{long}</div>{teaser}", f"<div>{teaser}</div><main>{long}</main>", f"<main>{long}{teaser}</main>", f"<body><div><div>{long}</div>{teaser}</div></body>"):
        assert html_text.extract(page).count(LONG.strip()) == 6
    parts = "".join(f"<article><h2>Part {k}</h2>{f'<p>{LONG}</p>' * k}</article>" for k in (1, 9, 3)) + "<article><p>The end.</p></article>"
    for page in (parts, f"<main><div>{parts}</div></main>"):
        text = html_text.extract(page)
        assert text.count(LONG.strip()) == 13 and all(f"Part {k}" in text for k in (1, 9, 3)) and text.endswith("The end.")


@pytest.mark.parametrize("n", [3, 250, 5000])
def test_elements_end_without_end_tags(n):
    article = f"<article><h1>T</h1><p>{LONG}</article>"
    whole = f"T {LONG.strip()}"
    for excluded in (
        f"<nav><ul>{'<li><a href=x>Menu</a>' * n}</ul></nav>", f"<div class=sidebar><dl>{'<dt>a<dd>b' * n}</dl></div>", f"<div class=ad>{'<p>x' * n}</div>",
        f"<select>{'<option>x' * n}</select>", f"<div class=widget><table>{'<tr><td>a<th>b' * n}</table></div>", f"<div class=menu>{'<div>x' * n}{'</div>' * n}</div>",
    ):
        assert html_text.extract(excluded + article) == whole
    for open_one, rest in (
        (f"<p class=ad>x<p>{LONG}<p>y", ""), (f"<p class=ad>x<div>{LONG}</div><p>y", ""), (f"<ul><li class=ad>x<li>{LONG}<li>y</ul>", ""), (f"<dl><dt class=promo>x<dd>{LONG}<dt>y</dl>", ""),
        (f"<table><tr><td class=ad>x<td>{LONG}<tr><td>y</table>", ""), (f"<table><tr class=ad><td>x<tr><td>{LONG}<tr><th>y</table>", ""),
        (f"<ul><li>{LONG}<ul class=related><li>x<li>x</li></li></ul>y</ul>", ""), (f"<table><tr><td>{LONG}<table class=ad><tr><td>x<td>x</td></td></tr></table>y</table>", ""),
    ):
        assert html_text.extract(f"<article>{open_one}</article>{rest}") == f"{LONG.strip()} y"


@pytest.mark.parametrize(
    "html",
    [
        f"<div class=post><h1>Title</h1><p>Lead.</p><div class=body>{f'<p>{LONG}</p>' * 9}</div></div>",
        f"<div class=post><div><h1>Title</h1></div><div>Lead.</div><div class=body>{f'<p>{LONG}</p>' * 9}</div></div>",
        f"<div class=post><div class=top><h1>Title</h1><p>Lead.</p></div><div><div class=body>{f'<p>{LONG}</p>' * 9}</div></div></div>",
        f"<main><h1>Title</h1><p>Lead.</p><article>{f'<p>{LONG}</p>' * 9}</article></main>",
        f"<h1>Title</h1><p>Lead.</p><article>{f'<p>{LONG}</p>' * 9}</article>",
    ],
)
def test_headings_and_leads_outside_the_body_stay(html):
    menu = "<ul>" + "<li><a href=x>Menu</a>" * 12 + "</ul>"
    assert html_text.extract(f"<body>{menu}{html}{menu}</body>") == " ".join(["Title Lead.", *[LONG.strip()] * 9])


def test_content_outside_the_main_child_stays():
    html = f"<div><div>{f'<p>{LONG}</p>' * 12}</div><div><p>Last: {LONG}</p></div><p>End.</p></div>"
    assert html_text.extract(html) == " ".join([*[LONG.strip()] * 12, f"Last: {LONG.strip()}", "End."])


def test_main_text_of_tables(spark):
    df = spark.createDataFrame([(1, "u", "<p>a</p>", "t"), (None, None, None, None), (1, "u", "<p>a</p>", "t")], "page_id long, url string, html string, text string")
    assert sorted((r.page_id or 0, r.text) for r in html_text.main_text(df).collect()) == [(0, ""), (1, "a"), (1, "a")]
    assert html_text.main_text(df.limit(0)).count() == 0


def test_pages_lose_what_is_not_the_article(spark, sf_dir):
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    for r in queries.QUERIES["op2_html_text"](spark, sf_dir).collect():
        assert r.n_chars == len(r.text) > 0 and "&copy;" not in r.text and "track(" not in r.text
        h1 = pages[r.page_id].split("<h1>")[1].split("</h1>")[0]
        assert r.text.startswith(__import__("html").unescape(h1))


def test_smoothing_keeps_the_mean_of_equal_lines():
    assert html_text.smoothed([2.0] * 5) == pytest.approx([2.0] * 5)
    assert html_text.content_lines([("x" * 100, 1, 0)] * 5 + [("x", 5, 0)] * 5)[:4] == [True] * 4


def test_shards_grow_only_into_the_new_one_and_fill_by_weight(spark):
    df = spark.range(6000).selectExpr("id AS doc_id", "'x' AS slot", "id AS __n")
    weights = [1.0, 2.0, 3.0]
    rows = sharding.assign(df, "doc_id", weights, [*weights, 2.0]).collect()
    assert all(r.grown_shard in (r.shard, 3) for r in rows)
    share = Counter(r.shard for r in rows)
    assert [round(share[i] / 6000 * 6) for i in range(3)] == [1, 2, 3]
    assert abs(sum(r.grown_shard == 3 for r in rows) / 6000 - 0.25) < 0.03
    for s in range(3):
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(share[s]))


def test_shards_take_nulls_and_repeats(spark):
    df = spark.createDataFrame([(None,), (None,), (3,), (3,)], "doc_id long")
    rows = sharding.assign(df, "doc_id", [1.0] * 5).collect()
    assert len({r.shard for r in rows if r.doc_id is None}) == len({r.shard for r in rows if r.doc_id == 3}) == 1
    assert sorted((r.shard, r.slot) for r in rows) == sorted({(r.shard, r.slot) for r in rows})
    assert sharding.assign(df.limit(0), "doc_id", [1.0]).count() == 0
    with pytest.raises(ValueError):
        sharding.shard_of(F.col("doc_id"), [1.0, 0.0])


def test_shard_query_sums(spark, sf_dir):
    texts = {r.doc_id: (r.text or "").encode() for r in C.documents(spark, sf_dir).collect()}
    for r in queries.QUERIES["op3_rendezvous"](spark, sf_dir).collect():
        assert (r.size, r.text_crc32, r.law) == (len(texts[r.doc_id]) + 8, zlib.crc32(texts[r.doc_id]), "key")
        draw = lambda i: hashlib.md5(f"{r.doc_id}:{i}".encode()).hexdigest()[:13]
        assert r.shard == max(range(24), key=draw) and r.grown_shard == max(range(25), key=draw)


def test_chain_tells_held_out_documents_apart(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = C.documents(spark, sf), spark.read.parquet(f"{sf}/labels.parquet")
    seen = labels.filter("doc_id % 3 <> 0")
    got = toxicity.judged(docs, seen).join(labels.filter("doc_id % 3 = 0").select("doc_id", F.col("toxic").alias("label")), "doc_id")
    count = Counter((r.label, r.toxic) for r in got.collect())
    # A few hundred toxic rows to learn from, some of which hold nothing but junk.
    assert count[1, True] >= 0.8 * (count[1, True] + count[1, False])
    assert count[0, False] >= 0.99 * (count[0, False] + count[0, True])


def test_later_models_use_earlier_categories():
    rng = np.random.default_rng(0)
    n = 2000
    first = rng.random(n) < 0.4
    rows, found = np.flatnonzero(first), np.full(int(first.sum()), 7)
    labels = np.column_stack([first, first ^ (rng.random(n) < 0.02)]).astype(float)
    models, outside = toxicity.fit_chain(rows, found, np.arange(n) % 5, labels)
    assert ((outside > 0.5) == labels).mean() > 0.97 and models[1].chain[0] > 0


def test_labels_of_one_class_none_or_null(spark):
    docs = spark.createDataFrame([(i, f"word{i % 3} other", 0) for i in range(30)] + [(None, None, 0), (1, "word1", 0)], "doc_id long, text string, toxic int")
    label = lambda rows: spark.createDataFrame(rows, "doc_id long, quality int, toxic int")
    for rows, want in (([], False), ([(i, 1, 0) for i in range(30)], False), ([(i, 0, 1) for i in range(30)], True), ([(None, 1, 1), (3, None, 1), (99, 1, 1)], False)):
        got = toxicity.judged(docs, label(rows)).collect()
        assert len(got) == 32 and all(r.toxic == want for r in got)
        assert toxicity.accepted(docs, label(rows)).count() == (0 if want else 32)
    assert toxicity.judged(docs.limit(0), label([])).count() == 0


def test_pipeline_against_plain_code(spark, sf_dir):
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    docs = C.documents(spark, sf_dir)
    whole = docs.count()
    for name, stage in corpus_pipeline.STAGES:
        before = [(r.doc_id, r.text) for r in docs.collect()]
        docs = C.staged(stage(spark, docs, sf_dir), name)
        after = docs.collect()
        if name == "toxicity":
            gone = {d for d, _ in before} - {r.doc_id for r in after}
            assert all(labels.get(d) != 0 for d in gone) and gone
        elif name == "ngram_jaccard_join":
            sets = {i: set(shingles(t)) for i, t in before}
            links = [(a, b) for a in sets for b in sets if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
            assert sorted(r.doc_id for r in after) == sorted(set(plain_components(sets, links).values()))
        elif name == "substring_dedup":
            want = {i: kept for i, _, removed, kept in plain_words(before, 50) if removed}
            assert {r.doc_id: r.text for r in after} == {i: want.get(i, t) for i, t in before}
            assert all(r.n_chars == len(r.text) for r in after)
        elif name == "benchmark_decontamination":
            items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
            assert {d for d, _ in before} - {r.doc_id for r in after} == {d for d, _ in plain_leaks(before, items)}
        else:
            assert sorted((r.doc_id, r.text) for r in after) == sorted(before) and all(r.n_tokens == len(r.ids) for r in after)
    assert 0 < docs.count() < whole


def test_shared_folder_without_the_setting():
    """Without spark.checkpoint.dir a local session takes a temporary folder, once; a cluster is told."""

    class Session:
        def __init__(self, master, named=None):
            self.sparkContext = type("Context", (), {"master": master, "applicationId": f"app-{master}"})
            self.conf = type("Conf", (), {"get": staticmethod(lambda key, default=None: named or default)})

    local = Session("local[2]")
    assert C.shared_dir(local) == C.shared_dir(local) and C.shared_dir(local).startswith("file:///")
    assert C.shared_dir(Session("spark://x:7077", "s3a://y/z/")) == "s3a://y/z"
    with pytest.raises(ValueError):
        C.shared_dir(Session("spark://x:7077"))
