"""Registered queries of the operators, with DuckDB SQL where SQL can say the same."""

from __future__ import annotations

import functools
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from convolens.llm import common as C
from convolens.llm import bpe, decontaminate, fim, group_join, html_text, mixing, mtree, rans, seed_extend, sharding, suffix_bwt, toxicity, turns
from convolens.session import ship

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        @functools.wraps(fn)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship(spark)
            return fn(spark, sf_dir)

        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"


#: The tokenizer of the queries; the operators take any path.
TOKENIZER = "byte_bpe_50k.json"


@register("op1_rans")
def op1_rans(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = C.new_path(spark, "rans")
    rans.write(C.documents(spark, sf_dir), path, public_tokenizers.path(TOKENIZER))
    return rans.read(spark, path).select("doc_id", "start", F.col("n").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))


@register("op2_html_text")
def op2_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = html_text.main_text(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    return out.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


SHARDS = 24


def _best(n: int) -> str:
    """The shard, of n, with the largest of 13 hexadecimal digits: the least waiting time at equal weights."""
    draws = ", ".join(f"substr(md5(k || ':{i}'), 1, 13)" for i in range(n))
    return f"list_position([{draws}], list_max([{draws}]))::INTEGER - 1"


@register(
    "op3_rendezvous",
    f"""
WITH RECURSIVE steps(i, c, k) AS (
  SELECT range, range::BIGINT, 0 FROM range(256)
  UNION ALL
  SELECT i, CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, k + 1 FROM steps WHERE k < 8),
crc AS (SELECT list(c ORDER BY i) AS step FROM steps WHERE k = 8),
d AS (
  SELECT doc_id, coalesce(doc_id::VARCHAR, '') AS k, hex(encode(coalesce(text, ''))) AS x FROM documents),
sums AS (
  SELECT doc_id, k, length(x) // 2 + 8 AS size,
    xor(list_reduce(
      list_prepend(4294967295::BIGINT, list_transform(range(length(x) // 2), lambda i: ('0x' || substr(x, 2 * i + 1, 2))::BIGINT)),
      lambda a, b: xor(a // 256, step[xor(a % 256, b) + 1])), 4294967295) AS text_crc32
  FROM d, crc),
placed AS (SELECT *, {_best(SHARDS)} AS shard, {_best(SHARDS + 1)} AS grown_shard FROM sums)
SELECT doc_id, size::BIGINT AS size, text_crc32::BIGINT AS text_crc32, 'key' AS law, shard::INTEGER AS shard,
  row_number() OVER (PARTITION BY shard ORDER BY substr(md5(k), 1, 2), k) - 1 AS slot, grown_shard::INTEGER AS grown_shard
FROM placed
""",
)
def op3_rendezvous(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = C.documents(spark, sf_dir).select(
        "doc_id", (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.lit("key").alias("law")
    )
    out = sharding.assign(rows, "doc_id", [1.0] * SHARDS, [1.0] * (SHARDS + 1))
    return out.select("doc_id", "size", "text_crc32", "law", "shard", F.col("slot").cast("long").alias("slot"), "grown_shard")


@register(
    "op6_group_join",
    """
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS words
  FROM documents),
s AS (
  SELECT doc_id, CASE WHEN len(words) >= 5
      THEN list_distinct(list_transform(range(1, len(words) - 3), lambda i: md5(array_to_string(words[i:i + 4], ' '))))
      WHEN len(words) > 0 THEN [md5(array_to_string(words, ' '))] ELSE [] END AS shingles
  FROM w),
each AS (SELECT doc_id, len(shingles) AS n, unnest(shingles) AS g FROM s),
links AS (
  SELECT a.doc_id AS x, b.doc_id AS y FROM each a JOIN each b ON a.g = b.g AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
reach(doc_id, y) AS (
  SELECT doc_id, doc_id FROM s
  UNION
  SELECT doc_id, links.y FROM reach JOIN links ON reach.y = links.x)
SELECT doc_id, len(shingles)::BIGINT AS n_shingles, min(y) AS component_id
FROM s JOIN reach USING (doc_id) GROUP BY doc_id, shingles
""",
)
def op6_group_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return group_join.link_components(C.documents(spark, sf_dir)).select("doc_id", "n_shingles", "component_id")


@register("op7_decontaminate")
def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(C.documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


@register("op8_toxicity")
def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.judged(C.documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


@register("op9_bpe")
def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = bpe.encode(C.documents(spark, sf_dir), public_tokenizers.path(TOKENIZER), decoded=True)
    return out.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


@register(
    "op4_mtree",
    """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM p)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
""",
)
def op4_mtree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mtree.top_products(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), lambda i: i % 20 == 0, 20)


@register(
    "op5_seed_extend",
    f"""
WITH w AS (SELECT doc_id, {WORDS} AS words FROM documents),
win AS (
  SELECT doc_id, i, md5(array_to_string(words[i:i + 49], ' ')) AS h
  FROM (SELECT doc_id, words, unnest(range(1, greatest(len(words) - 48, 1))) AS i FROM w)),
firsts AS (SELECT h, min(doc_id) AS first_doc FROM win GROUP BY h),
hits AS (SELECT doc_id, i FROM win JOIN firsts USING (h) WHERE first_doc < doc_id),
each AS (SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) AS i FROM w),
covered AS (
  SELECT doc_id, i, word, max(CASE WHEN hits.i IS NULL THEN 0 ELSE 1 END)
    OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) AS gone
  FROM each LEFT JOIN hits USING (doc_id, i)),
kept AS (
  SELECT doc_id, sum(gone) AS n_removed, string_agg(CASE WHEN gone = 0 THEN word END, ' ' ORDER BY i) AS kept
  FROM covered GROUP BY doc_id)
SELECT w.doc_id, len(words)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (doc_id)
""",
)
def op5_seed_extend(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = seed_extend.dedup(C.documents(spark, sf_dir))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


@register(
    "op10_suffix_bwt",
    """
WITH t AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
win AS (
  SELECT doc_id, i, md5(substr(x, 2 * i + 1, 400)) AS h
  FROM (SELECT doc_id, x, unnest(range(0, greatest(length(x) // 2 - 199, 0))) AS i FROM t)),
twice AS (SELECT h FROM win GROUP BY h HAVING count(*) > 1),
hits AS (SELECT doc_id, i FROM win SEMI JOIN twice USING (h)),
marked AS (SELECT doc_id, i, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS before FROM hits),
runs AS (
  SELECT doc_id, i, sum(CASE WHEN before IS NULL OR i > before + 200 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS run
  FROM marked),
spans AS (SELECT doc_id, run, min(i) AS a, max(i) + 200 AS b FROM runs GROUP BY doc_id, run),
gaps AS (
  SELECT doc_id, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS a, a AS b FROM spans
  UNION ALL
  SELECT t.doc_id, coalesce(max(b), 0), any_value(length(x) // 2) FROM t LEFT JOIN spans USING (doc_id) GROUP BY t.doc_id),
kept AS (
  SELECT doc_id, string_agg(substr(x, 2 * a + 1, 2 * (b - a)), '' ORDER BY a) AS kept FROM gaps JOIN t USING (doc_id) GROUP BY doc_id),
counts AS (SELECT doc_id, count(*) AS n_spans, sum(b - a) AS n_removed FROM spans GROUP BY doc_id)
SELECT t.doc_id, (length(x) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed,
  coalesce(n_spans, 0)::BIGINT AS n_spans, sha256(unhex(kept)) AS kept_sha256
FROM t JOIN kept USING (doc_id) LEFT JOIN counts USING (doc_id)
""",
)
def op10_suffix_bwt(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffix_bwt.dedup(C.documents(spark, sf_dir))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


@register(
    "op11_mixing",
    f"""
WITH d AS (
  SELECT doc_id, source, len({WORDS})::BIGINT AS size, md5('1:' || coalesce(doc_id::VARCHAR, '')) AS o FROM documents),
s AS (
  SELECT source, sum(size)::BIGINT AS source_size, [5, 2, 1][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS w
  FROM d GROUP BY source),
-- Sources by how soon they are full: one is clamped if the level of those not before it is above its own.
f AS (
  SELECT *, 2 * source_size AS most, 1.5::DOUBLE * (SELECT sum(source_size) FROM s)::DOUBLE
      - coalesce(sum(2 * source_size) OVER (ORDER BY source_size / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE AS remaining,
    sum(w) OVER (ORDER BY source_size / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)::DOUBLE AS weight
  FROM s),
c AS (SELECT *, most * weight <= remaining * w AS clamped FROM f),
level AS (SELECT arg_min(remaining, most / w) AS remaining, arg_min(weight, most / w) AS weight FROM c WHERE NOT clamped),
t AS (
  SELECT source, source_size, CASE WHEN clamped THEN most::DOUBLE ELSE (SELECT remaining FROM level) * w / (SELECT weight FROM level) END AS target FROM c),
p AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END::BIGINT AS copies FROM t),
r AS (
  SELECT doc_id, size, source_size, target, copies, floor(target)::BIGINT - copies * source_size AS extra,
    coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY o, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before
  FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source)
SELECT doc_id, size, source_size, target, (copies * size + greatest(0, least(size, extra - before)))::BIGINT AS taken FROM r
""",
)
def op11_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(C.documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


@register(
    "op12_fill_in_middle",
    """
WITH t AS (SELECT doc_id, coalesce(text, '') AS x, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
h AS (
  SELECT doc_id, x, length(x)::BIGINT AS n, ('0x' || substr(h, 1, 8))::BIGINT AS h1, ('0x' || substr(h, 9, 8))::BIGINT AS h2,
    ('0x' || substr(h, 17, 8))::BIGINT AS h3, ('0x' || substr(h, 25, 8))::BIGINT AS h4 FROM t),
c AS (
  SELECT doc_id, x, n, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
    CASE WHEN x = '' OR contains(x, '<P>') OR contains(x, '<S>') OR contains(x, '<M>') OR h3 % 100 >= 90 THEN 'plain'
      WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM h),
p AS (SELECT *, '<P>' || substr(x, 1, a) AS pre, '<S>' || substr(x, b + 1) AS suf, '<M>' || substr(x, a + 1, b - a) AS mid FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
  sha256(CASE form WHEN 'psm' THEN pre || suf || mid WHEN 'spm' THEN suf || pre || mid ELSE x END) AS output_sha256,
  sha256(x) AS restored_sha256
FROM p
""",
)
def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = fim.transform(C.documents(spark, sf_dir)).withColumn("output_sha256", F.sha2("output", 256))
    back = fim.restore(out.select("output", "doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256"))
    return back.withColumn("restored_sha256", F.sha2("restored", 256)).drop("restored")


_CRC_STEPS = """steps(i, c, k) AS (
  SELECT range, range::BIGINT, 0 FROM range(256)
  UNION ALL
  SELECT i, CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, k + 1 FROM steps WHERE k < 8),
crc AS (SELECT list(c ORDER BY i) AS step FROM steps WHERE k = 8)"""


def _least(*ways: str) -> str:
    """The cheapest of ways to a state, ties to the least letters."""
    return f"list_min([{', '.join(ways)}])"


def _way(state: int, letter: str, cost: str, when: str = "") -> str:
    """One edit from a state of the step before."""
    way = f"{{'c': s[{state + 1}].c + {cost}, 'a': s[{state + 1}].a || '{letter}'}}"
    return f"CASE WHEN {when} THEN {way} END" if when else way


_MAY = "f NOT IN ('b', 'd')"
_EXTRA = "CASE WHEN f = 't' THEN 3 ELSE 0 END"
_NEXT = [
    _least(_way(0, "D", "4")),
    _least(_way(1, "D", "4"), _way(0, "K", _EXTRA, f"{_MAY} AND ini = 's'")),
    _least(_way(2, "D", "4"), *[_way(k, "K", _EXTRA, f"{_MAY} AND ini = 'u'") for k in (0, 1, 3)], *[_way(k, "R", f"3 + {_EXTRA}", _MAY) for k in (0, 1, 3)]),
    _least(_way(3, "D", "4"), _way(2, "K", _EXTRA, f"{_MAY} AND ini = 'a'"), _way(2, "R", f"3 + {_EXTRA}", _MAY)),
]


@register(
    "op13_turns",
    f"""
WITH RECURSIVE {_CRC_STEPS},
src AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    hex(encode(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '))) AS x FROM conversations),
hit AS (
  SELECT conv_id, turn, role, text, xor(list_reduce(
      list_prepend(4294967295::BIGINT, list_transform(range(length(x) // 2), lambda i: ('0x' || substr(x, 2 * i + 1, 2))::BIGINT)),
      lambda a, b: xor(a // 256, step[xor(a % 256, b) + 1])), 4294967295) % 20 AS k
  FROM src, crc),
dam AS (
  SELECT conv_id, turn, CASE WHEN k = 4 THEN 'user' ELSE role END AS role,
    CASE WHEN k = 1 THEN '' WHEN k = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM (SELECT *, unnest(range(CASE WHEN k = 3 THEN 2 ELSE 1 END)) FROM hit WHERE k <> 0)),
num AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(length(role) || ':' || role || text)) AS i,
    rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS cut, substr(role, 1, 1) AS ini FROM dam),
flt AS (
  SELECT *, CASE WHEN cut = '' THEN 'b' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'd'
      WHEN right(cut, 1) NOT IN ('.', '!', '?') THEN 't' ELSE '-' END AS f,
    lag(ini) OVER (PARTITION BY conv_id ORDER BY i) AS before FROM num),
walk(conv_id, i, s) AS (
  SELECT conv_id, 0::BIGINT, [{{'c': 0::BIGINT, 'a': ''}}, {{'c': 1000000000, 'a': ''}}, {{'c': 3, 'a': 'I'}}, {{'c': 6, 'a': 'II'}}] FROM (SELECT DISTINCT conv_id FROM conversations)
  UNION ALL
  SELECT conv_id, i, [p0, p1,
    list_min([p2, {{'c': p0.c + 3, 'a': p0.a || 'I'}}, {{'c': p1.c + 3, 'a': p1.a || 'I'}}, {{'c': p3.c + 3, 'a': p3.a || 'I'}}]),
    list_min([p3, {{'c': p2.c + 3, 'a': p2.a || 'I'}}, {{'c': p0.c + 6, 'a': p0.a || 'II'}}, {{'c': p1.c + 6, 'a': p1.a || 'II'}}])]
  FROM (
    SELECT conv_id, flt.i, {_NEXT[0]} AS p0, {_NEXT[1]} AS p1, {_NEXT[2]} AS p2, {_NEXT[3]} AS p3
    FROM walk JOIN flt USING (conv_id) WHERE flt.i = walk.i + 1)),
lastw AS (SELECT conv_id, max_by(s, i) AS s FROM walk GROUP BY conv_id),
best AS (SELECT conv_id, list_min([s[1], s[4]]) AS w FROM lastw),
counts AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (f = 'b') AS blank, count(*) FILTER (f = 'd') AS duplicate,
    count(*) FILTER (f = 't') AS truncated, count(*) FILTER (before || ini NOT IN ('su', 'ua', 'au')) AS illegal
  FROM flt GROUP BY conv_id),
-- One row per edit, with the row it takes and the role it gives.
edits AS (
  SELECT conv_id, j, substr(w.a, j, 1) AS e, length(replace(substr(w.a, 1, j), 'I', '')) AS i
  FROM (SELECT conv_id, w, unnest(range(1, length(w.a) + 1)) AS j FROM best)),
lines AS (
  SELECT e.conv_id, j, e, f.role, f.text, row_number() OVER (PARTITION BY e.conv_id ORDER BY j)
      - (first_value(CASE WHEN e = 'K' AND f.ini = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY e.conv_id ORDER BY j)) AS place
  FROM edits e LEFT JOIN flt f ON e.conv_id = f.conv_id AND e.i = f.i AND e.e <> 'I' WHERE e <> 'D'),
joined AS (
  SELECT conv_id, string_agg(CASE WHEN e = 'K' THEN role WHEN place % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || CASE WHEN e = 'I' THEN '' ELSE text END, chr(10) ORDER BY j) AS t
  FROM lines GROUP BY conv_id)
SELECT conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated,
  coalesce(illegal, 0)::BIGINT AS illegal, w.c::BIGINT AS cost, w.a AS audit, sha256(coalesce(t, '')) AS repaired_sha256
FROM best LEFT JOIN counts USING (conv_id) LEFT JOIN joined USING (conv_id)
""",
)
def op13_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = turns.damaged(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    return turns.repair(rows).withColumnRenamed("conv", "conv_id")
