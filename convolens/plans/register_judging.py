"""Judging, facts, veracity, attribution, alignment and training targets."""

from __future__ import annotations

from pyspark.sql import functions as F

from convolens import protocol
from convolens.functions import rouge as R
from convolens.operators import alignment, attribution, costs, facts, judging, prompts, resampling, retrieval, targets
from convolens.plans import oracle as O
from convolens.plans import views as V
from convolens.plans.catalogue import ORACLES, register
from convolens.plans.register_retrieval import _CHAT_PACK, _GOT, CHUNK, SPAN, _located
from convolens.plans.register_scoring import LAST, overlap_ctes, r6

# --- pairwise judging -------------------------------------------------------------------------

REPLIES = f"""
r0 AS (SELECT query_id, conv_id, turn, length(reference) AS len, c.contestant, c.ci, j.judge_model, j.ji
  FROM queries,
  (VALUES ('{V.CONTESTANTS[0]}', 0), ('{V.CONTESTANTS[1]}', 1)) c(contestant, ci),
  (VALUES ('{V.JUDGES[0]}', 0), ('{V.JUDGES[1]}', 1)) j(judge_model, ji)),
replies AS (SELECT *, (conv_id * 7 + turn * 3 + len + ci * 5 + ji * (conv_id % 2)) % 10 AS h,
  (conv_id + turn / 2) % 2 = 1 AS swap FROM r0),
items AS (SELECT *, CASE WHEN h < 4 THEN 'A' WHEN h < 7 THEN 'B' WHEN h = 7 THEN 'TIE' WHEN h = 8 THEN 'A.' ELSE 'B' END AS verdict
  FROM replies),
won AS (SELECT *, CASE WHEN verdict = 'TIE' THEN 'tie' WHEN (verdict = 'A') <> swap THEN 'a' ELSE 'b' END AS winner FROM items)
"""


def _items(spark, sf):
    replies = V.judge_replies(spark, sf)
    known = F.col("prompt_tokens").isNotNull() & F.col("completion_tokens").isNotNull()
    priced = costs.with_cost(replies.where(known), costs.price_table(spark))
    unknown = replies.where(~known).withColumn("cost_usd", F.lit(None).cast("double"))
    return judging.judge_items(priced.unionByName(unknown))


@register(
    "judge_items",
    O.with_ctes(O.CHAT_QUERIES, REPLIES, select="SELECT query_id, contestant, judge_model, swap, verdict, winner FROM won"),
)
def judge_items(spark, sf):
    return _items(spark, sf).select("query_id", "contestant", "judge_model", "swap", "verdict", "winner")


_TALLY = f"""
tally AS (SELECT contestant, judge_model, count(*) AS n_sampled, CAST(count_if(winner = 'a') AS BIGINT) AS a_wins,
  CAST(count_if(winner = 'b') AS BIGINT) AS b_wins, CAST(count_if(winner = 'tie') AS BIGINT) AS ties,
  CAST(0 AS BIGINT) AS unparsed, CAST(count_if(h = 9) AS BIGINT) AS truncated,
  CAST(count_if(h = 3) AS BIGINT) AS entries_without_usage,
  round(sum(CASE WHEN h <> 3 THEN len / 1e6 * 5.0 + (h + 1) / 1e6 * CASE judge_model WHEN 'gpt-5.6-sol' THEN 30.0 ELSE 25.0 END
       ELSE 0 END), 4) AS cost_usd, count(*) AS n_decided FROM won GROUP BY ALL)
"""


@register("judge_tally", O.with_ctes(O.CHAT_QUERIES, REPLIES, _TALLY, select="SELECT * FROM tally"))
def judge_tally(spark, sf):
    return judging.judge_tally(_items(spark, sf))


def _vendor_risk(tally):
    return tally.withColumn(
        "self_preference_risk",
        judging.self_preference_risk(F.col("judge_model"), F.array(costs.vendor_of(F.col("contestant")))),
    ).withColumn("run_order", F.when(F.col("judge_model") == V.JUDGES[0], 0).otherwise(1))


@register(
    "judge_panel",
    O.with_ctes(
        O.CHAT_QUERIES,
        REPLIES,
        _TALLY,
        """c AS (SELECT * FROM tally WHERE (contestant LIKE 'gpt%') <> (judge_model LIKE 'gpt%')),
        d AS (SELECT * FROM tally WHERE (contestant LIKE 'gpt%') = (judge_model LIKE 'gpt%'))""",
        select="""SELECT c.contestant, c.judge_model AS clean_judge, d.judge_model AS same_vendor_judge,
          c.a_wins AS ours_wins, c.b_wins AS theirs_wins, c.ties, c.n_decided,
          round(c.a_wins / c.n_decided, 6) AS ours_win_rate,
          round((c.a_wins + c.ties) / c.n_decided, 6) AS ours_wins_or_ties,
          round(d.b_wins / d.n_decided - c.b_wins / c.n_decided, 6) + 0.0 AS self_preference_delta
          FROM c JOIN d USING (contestant)""",
    ),
)
def judge_panel(spark, sf):
    out = judging.panel_summary(_vendor_risk(judging.judge_tally(_items(spark, sf))), V.CONTESTANTS)
    return out.select(
        "contestant",
        "clean_judge",
        "same_vendor_judge",
        "ours_wins",
        "theirs_wins",
        "ties",
        "n_decided",
        *r6("ours_win_rate", "ours_wins_or_ties", "self_preference_delta"),
    )


def _kappa_sql(source: str, x: str, y: str, cats: list[str], by: str = "") -> str:
    group = f"{by}, " if by else ""
    expected = " + ".join(
        f"(count_if({x} = {c}) / count(*)) * (count_if({y} = {c}) / count(*))" for c in cats
    )
    observed = f"count_if({x} = {y}) / count(*)"
    tail = f"GROUP BY {by}" if by else ""
    return f"""SELECT {group}count(*) AS n_comparable, round({observed}, 6) AS raw,
      round(({observed} - ({expected})) / (1 - ({expected})), 6) + 0.0 AS kappa FROM {source} {tail}"""


@register(
    "kappa",
    O.with_ctes(
        O.CHAT_QUERIES,
        REPLIES,
        f"""both_judges AS (SELECT a.contestant, a.winner AS x, b.winner AS y FROM won a JOIN won b USING (query_id, contestant)
          WHERE a.judge_model = '{V.JUDGES[0]}' AND b.judge_model = '{V.JUDGES[1]}')""",
        select=_kappa_sql("both_judges", "x", "y", ["'a'", "'b'", "'tie'"], "contestant"),
    ),
)
def kappa(spark, sf):
    return judging.agreement(_items(spark, sf), *V.JUDGES).select("contestant", "n_comparable", *r6("raw", "kappa"))


@register("label_kappa", _kappa_sql("labels", "quality", "toxic", ["0", "1"]))
def label_kappa(spark, sf):
    return judging.kappa_stats(V.table(spark, sf, "labels"), [], "quality", "toxic", [0, 1]).select(
        "n_comparable", *r6("raw", "kappa")
    )


@register(
    "length_bias",
    O.with_ctes(
        O.CHAT_QUERIES,
        LAST,
        REPLIES,
        f"""wc AS (SELECT system, query_id, {O.n_words('prediction')} AS n FROM preds),
        cmp AS (SELECT contestant, judge_model, winner, a.n AS la, b.n AS lb FROM won
          JOIN wc a ON a.query_id = won.query_id AND a.system = 'a'
          JOIN wc b ON b.query_id = won.query_id AND b.system = CASE WHEN contestant LIKE 'gpt%' THEN 'b' ELSE 'c' END
          WHERE winner IN ('a', 'b') AND abs(a.n - b.n) > 5)""",
        select="""SELECT contestant, judge_model, count(*) AS n_comparable,
          CAST(count_if((winner = 'a') = (la > lb)) AS BIGINT) AS picked_longer,
          round(avg(CASE WHEN (winner = 'a') = (la > lb) THEN 1.0 ELSE 0.0 END), 6) AS p_picked_longer,
          CAST(count_if(winner = 'a' AND la > lb) AS BIGINT) AS ours_longer_and_won,
          CAST(count_if(winner = 'b' AND lb > la) AS BIGINT) AS theirs_longer_and_won FROM cmp GROUP BY ALL""",
    ),
)
def length_bias(spark, sf):
    from convolens.functions.text import word_count

    words = lambda s: V.predictions(spark, sf, s).select("query_id", word_count(F.col("prediction")).alias("n"))
    theirs = (
        words("b").withColumn("contestant", F.lit(V.CONTESTANTS[0]))
        .unionByName(words("c").withColumn("contestant", F.lit(V.CONTESTANTS[1])))
    )
    out = judging.length_bias(_items(spark, sf), words("a"), theirs)
    return out.withColumn("p_picked_longer", F.round("p_picked_longer", 6))


@register(
    "control_summary",
    O.with_ctes(
        O.CHAT_QUERIES,
        REPLIES,
        _TALLY,
        select="""SELECT contestant, judge_model, a_wins AS reference_wins, b_wins AS contestant_wins, ties, n_decided,
          round(a_wins / n_decided, 6) AS reference_win_rate FROM tally""",
    ),
)
def control_summary(spark, sf):
    out = judging.control_summary(judging.judge_tally(_items(spark, sf)))
    return out.withColumn("reference_win_rate", F.round("reference_win_rate", 6))


@register(
    "position_swap",
    "SELECT CAST(doc_id AS VARCHAR) AS query_id, (row_number() OVER (ORDER BY CAST(doc_id AS VARCHAR)) - 1) % 2 = 1 AS swap FROM labels",
)
def position_swap(spark, sf):
    ids = lambda t: V.table(spark, sf, t).select(F.col("doc_id").cast("string").alias("query_id"))
    return judging.judge_sample(ids("documents"), ids("labels"), n=None)


_SHOWN = """chr(10) || chr(10) || 'Summary A:' || chr(10) || CASE WHEN swap THEN b.prediction ELSE a.prediction END
            || chr(10) || chr(10) || 'Summary B:' || chr(10) || CASE WHEN swap THEN a.prediction ELSE b.prediction END"""


@register(
    "judge_prompts",
    O.with_ctes(
        O.CHAT_QUERIES,
        LAST,
        """o AS (SELECT query_id, (row_number() OVER (ORDER BY query_id) - 1) % 2 = 1 AS swap FROM queries)""",
        select=f"""SELECT a.query_id, o.swap, a.query_id || '-' || CASE WHEN swap THEN 'ba' ELSE 'ab' END AS cache_key,
          {O.literal(prompts.GROUNDED)} || a.query || chr(10) || chr(10) || 'Reference answer:' || chr(10) || a.reference || {_SHOWN} AS grounded,
          {O.literal(prompts.BLIND)} || a.query || {_SHOWN} AS preference
          FROM preds a JOIN preds b USING (query_id) JOIN o USING (query_id) WHERE a.system = 'a' AND b.system = 'c'""",
    ),
)
def judge_prompts(spark, sf):
    a, c = V.predictions(spark, sf, "a"), V.predictions(spark, sf, "c")
    sample = judging.judge_sample(a, c, n=None)
    asked = lambda mode: judging.judge_requests(sample, V.chat_queries(spark, sf), a, c, mode).withColumnRenamed("prompt", mode)
    return asked("grounded").join(asked("preference").select("query_id", "preference"), "query_id")


# --- facts ------------------------------------------------------------------------------------

MARKS = f"""
m0 AS (SELECT query_id, system, conv_id + turn + CASE system WHEN 'a' THEN 0 ELSE 1 END AS k,
  len({O.sentences('reference')}) AS nf, len({O.sentences('prediction')}) AS nc FROM preds WHERE system IN ('a', 'c')),
m1 AS (SELECT *, k % 13 <> 0 AS parsed,
  len(list_filter(range(1, nf + 1), lambda i: (i + k) % 2 = 0)) AS covered,
  len(list_filter(range(1, nc + 1), lambda i: (i + k + nc) % 2 = 0)) AS unsupported FROM m0),
marks AS (SELECT query_id, system, parsed, CASE WHEN parsed THEN nf END AS n_facts, CASE WHEN parsed THEN covered END AS n_covered,
  CASE WHEN parsed THEN nc END AS n_claims, CASE WHEN parsed THEN unsupported END AS n_unsupported,
  CASE WHEN parsed THEN covered > 0 AND nc > 0 AND nc = unsupported END AS incoherent,
  CASE WHEN parsed AND nf > 0 THEN covered / nf END AS recall,
  CASE WHEN parsed AND nc > 0 THEN (nc - unsupported) / nc END AS precision FROM m1),
scored AS (SELECT *, CASE WHEN recall IS NULL THEN NULL WHEN precision IS NULL OR precision + recall = 0 THEN 0.0
  ELSE 2 * precision * recall / (precision + recall) END AS f FROM marks)
"""


def _fact_items(spark, sf):
    return facts.fact_items(V.marking_replies(spark, sf), V.fact_lists(spark, sf))


@register(
    "fact_marking",
    O.with_ctes(
        O.CHAT_QUERIES,
        LAST,
        MARKS,
        select="""SELECT query_id, system, parsed, CAST(n_facts AS INTEGER) AS n_facts, CAST(n_covered AS INTEGER) AS n_covered,
          CAST(n_claims AS INTEGER) AS n_claims, CAST(n_unsupported AS INTEGER) AS n_unsupported, incoherent,
          round(recall, 6) AS recall, round(precision, 6) AS precision FROM marks""",
    ),
)
def fact_marking(spark, sf):
    out = _fact_items(spark, sf)
    return out.select(*[F.round(c, 6).alias(c) if c in ("recall", "precision") else F.col(c) for c in out.columns])


_FACT_SUMMARY = """SELECT system, CAST(count_if(parsed) AS BIGINT) AS n_scored, CAST(count_if(NOT parsed) AS BIGINT) AS unparsed,
  CAST(count_if(incoherent) AS BIGINT) AS incoherent_markings,
  round(avg(CASE WHEN incoherent THEN 1.0 WHEN NOT incoherent THEN 0.0 END), 6) AS incoherent_rate,
  round(avg(CASE WHEN n_claims > 0 THEN n_claims END), 6) AS mean_claims_denominator,
  round(avg(precision), 6) AS fact_precision, round(avg(recall), 6) AS fact_recall, round(avg(f), 6) AS fact_f1,
  CAST(count_if(f = 0) AS BIGINT) AS zero_queries, round(avg(n_facts), 6) AS mean_facts_per_query,
  round(avg(n_claims), 6) AS mean_claims_per_summary,
  round(2 * avg(precision) * avg(recall) / (avg(precision) + avg(recall)), 6) AS fact_f1_of_means
  FROM scored GROUP BY 1"""


@register("fact_summary", O.with_ctes(O.CHAT_QUERIES, LAST, MARKS, select=_FACT_SUMMARY))
def fact_summary(spark, sf):
    out = facts.fact_summary(_fact_items(spark, sf), ["system"])
    whole = ("system", "n_scored", "unparsed", "incoherent_markings", "zero_queries")
    return out.select(*[F.col(c) if c in whole else F.round(c, 6).alias(c) for c in out.columns])


CLAIMS = f"""u0 AS (SELECT query_id, system, conv_id + turn + CASE system WHEN 'a' THEN 0 ELSE 1 END AS k,
              {O.sentences('prediction')} AS claims FROM preds WHERE system IN ('a', 'c')),
        u1 AS (SELECT query_id, system, unnest(list_filter(list_transform(range(1, len(claims) + 1), lambda i:
              CASE WHEN (i + k + len(claims)) % 2 = 0 THEN claims[i] END), lambda x: x IS NOT NULL)) AS claim FROM u0 WHERE k % 13 <> 0)"""


@register(
    "unsupported_claims",
    O.with_ctes(
        O.CHAT_QUERIES,
        LAST,
        CLAIMS,
        select="SELECT query_id, system, claim FROM u1",
    ),
)
def unsupported_claims(spark, sf):
    return facts.unsupported_claims(V.marking_replies(spark, sf))


def _claim_pool(spark, sf):
    ours = facts.unsupported_claims(V.marking_replies(spark, sf)).select(
        "query_id", F.concat(F.lit("system-"), "system").alias("source"), "claim"
    )
    gold = V.fact_lists(spark, sf).select("query_id", F.lit(protocol.GOLD_SOURCE).alias("source"), F.explode("facts").alias("claim"))
    return ours.unionByName(gold)


@register(
    "claim_packets",
    O.with_ctes(
        O.CHAT_QUERIES,
        LAST,
        f"""{CLAIMS},
        gold AS (SELECT query_id, '{protocol.GOLD_SOURCE}' AS source, unnest({O.sentences('reference')}) AS claim FROM queries),
        pool AS (SELECT query_id, 'system-' || system AS source, claim FROM u1 UNION ALL SELECT * FROM gold),
        numbered AS (SELECT *, row_number() OVER (PARTITION BY query_id
            ORDER BY md5('{protocol.SEED}|' || query_id || '|' || source || '|' || claim), source, claim) AS k FROM pool)""",
        select="""SELECT query_id, meeting_id, query, query_id || '__c' || lpad(CAST(k AS VARCHAR), CAST(greatest(2, len(CAST(k AS VARCHAR))) AS INTEGER), '0') AS claim_id, claim
        FROM numbered JOIN queries USING (query_id)""",
    ),
)
def claim_packets(spark, sf):
    return facts.claim_packets(facts.blinded_claims(_claim_pool(spark, sf)), V.chat_queries(spark, sf))


@register(
    "veracity",
    f"""WITH k AS (SELECT doc_id AS claim_id, CASE doc_id % 3 WHEN 0 THEN 'GOLD-REFERENCE' WHEN 1 THEN 'ours' ELSE 'theirs' END AS source FROM documents),
    v AS (SELECT doc_id AS claim_id, CASE WHEN quality = 1 THEN 'SUPPORTED_FULL' WHEN toxic = 1 THEN 'CONTRADICTED'
          WHEN doc_id % 2 = 0 THEN 'SUPPORTED_PARTIAL' WHEN doc_id % 7 = 0 THEN 'odd' ELSE 'NOT_IN_TRANSCRIPT' END AS label FROM labels),
    j AS (SELECT source, label, label IN ('SUPPORTED_FULL', 'SUPPORTED_PARTIAL') AS ok FROM k JOIN v USING (claim_id)),
    g AS (SELECT coalesce(round(avg(CASE WHEN ok THEN 1.0 ELSE 0.0 END) FILTER (source = 'GOLD-REFERENCE'), 4) >= 0.85, false) AS passed FROM j)
    SELECT source, count(*) AS n, {', '.join(f"CAST(count_if(label = '{x}') AS BIGINT) AS {x.lower()}" for x in protocol.VERACITY_LABELS)},
      CAST(count_if(label = 'odd') AS BIGINT) AS unlabelled, round(avg(CASE WHEN ok THEN 1.0 ELSE 0.0 END), 6) AS true_rate,
      any_value(passed) AS control_passed,
      CASE WHEN any_value(passed) THEN round(avg(CASE WHEN ok THEN 1.0 ELSE 0.0 END), 6) END AS usable_rate
    FROM j CROSS JOIN g GROUP BY source""",
)
def veracity(spark, sf):
    i = F.col("doc_id")
    source = F.when(i % 3 == 0, protocol.GOLD_SOURCE).when(i % 3 == 1, "ours").otherwise("theirs")
    key = V.table(spark, sf, "documents").select(i.alias("claim_id"), source.alias("source"))
    label = (
        F.when(F.col("quality") == 1, "SUPPORTED_FULL")
        .when(F.col("toxic") == 1, "CONTRADICTED")
        .when(i % 2 == 0, "SUPPORTED_PARTIAL")
        .when(i % 7 == 0, "odd")
        .otherwise("NOT_IN_TRANSCRIPT")
    )
    verdicts = V.table(spark, sf, "labels").select(i.alias("claim_id"), label.alias("label"))
    out = facts.veracity(key, verdicts)
    return out.select(*[F.round(c, 6).alias(c) if c in ("true_rate", "usable_rate") else F.col(c) for c in out.columns])


@register(
    "probe_summary",
    O.with_ctes(
        O.CHAT_QUERIES,
        LAST,
        MARKS,
        """p AS (SELECT system AS condition, coalesce(nc > unsupported, false) AND parsed AS sup, parsed,
             k % 2 = 1 AND parsed AS cov, nc, unsupported FROM m1)""",
        select="""SELECT condition, count(*) AS n, CAST(count_if(cov) AS BIGINT) AS fact_covered,
          CAST(count_if(sup) AS BIGINT) AS claim_supported,
          CAST(count_if(cov AND nc > 0 AND nc = unsupported) AS BIGINT) AS incoherent FROM p GROUP BY 1""",
    ),
)
def probe_summary(spark, sf):
    replies = V.marking_replies(spark, sf).withColumnRenamed("system", "condition")
    return facts.probe_summary(facts.probe_rows(replies), ["condition"])


# --- attribution ------------------------------------------------------------------------------


def _recalls(spark, sf):
    return retrieval.window_recall(_located(spark, sf)).select("query_id", "recall")


def _f_scores(spark, sf, system):
    pairs = V.scored_pairs(spark, sf, system).select("query_id", "prediction", "reference")
    return R.with_rouge(pairs, ["rouge1"], stemmed=False).select("query_id", F.col("rouge1.f").alias("score"))


_BUCKET = """CASE WHEN recall = 0 THEN 'miss (0.0)' WHEN recall < 0.5 THEN 'partial (0-0.5)'
  WHEN recall < 1.0 THEN 'most (0.5-1.0)' ELSE 'hit (1.0)' END"""
_BUCKETS = "dim(bucket) AS (VALUES " + ", ".join(f"('{b}')" for b in protocol.RECALL_BUCKETS) + ")"


@register(
    "recall_buckets",
    O.with_ctes(
        *_CHAT_PACK,
        _GOT,
        LAST,
        overlap_ctes(1),
        _BUCKETS,
        f"b AS (SELECT {_BUCKET} AS bucket, count(*) AS n, avg(f) AS mean FROM recalls JOIN sc USING (query_id) WHERE system = 'b' GROUP BY 1)",
        select="SELECT bucket, coalesce(n, 0) AS n, round(mean, 6) AS mean FROM dim LEFT JOIN b USING (bucket)",
    ),
)
def recall_buckets(spark, sf):
    out = attribution.bucket_by_recall(_recalls(spark, sf), _f_scores(spark, sf, "b"))
    return out.withColumn("mean", F.round("mean", 6))


@register(
    "zero_rates",
    O.with_ctes(
        *_CHAT_PACK,
        _GOT,
        LAST,
        MARKS,
        _BUCKETS,
        f"""b AS (SELECT {_BUCKET.replace('recall', 'recalls.recall')} AS bucket, count(*) AS n, CAST(count_if(f = 0) AS BIGINT) AS zero
          FROM recalls JOIN scored USING (query_id) WHERE system = 'a' AND f IS NOT NULL GROUP BY 1)""",
        select="""SELECT bucket, coalesce(n, 0) AS n, coalesce(zero, 0) AS zero, round(zero / n, 6) AS rate
          FROM dim LEFT JOIN b USING (bucket)""",
    ),
)
def zero_rates(spark, sf):
    items = _fact_items(spark, sf).where((F.col("system") == "a") & F.col("parsed"))
    out = attribution.zero_rates(_recalls(spark, sf), items.select("query_id", attribution.item_score("f1").alias("score")))
    return out.withColumn("rate", F.round("rate", 6))


def _attribution_sql() -> str:
    parts = []
    for metric, col in (("recall", "recall"), ("precision", "precision"), ("f1", "f")):
        o, b = f"o.{col}", f"b.{col}"
        parts.append(
            f"""SELECT '{metric}' AS metric, count(*) AS n_shared, CAST(count_if(r.recall = 1) AS BIGINT) AS n_perfect_retrieval,
            avg({o}) AS oa, avg({b}) AS ba, avg({o}) FILTER (r.recall = 1) AS op, avg({b}) FILTER (r.recall = 1) AS bp,
            (SELECT CASE WHEN count(*) > 1 THEN round(max(m) - min(m), 4) + 0.0 END FROM
              (SELECT round(avg(s.{col}), 4) AS m FROM scored s JOIN recalls q USING (query_id)
               WHERE system = 'a' AND s.{col} IS NOT NULL AND s.parsed GROUP BY {_BUCKET.replace('recall', 'q.recall')})) AS spread
            FROM scored o JOIN scored b ON b.query_id = o.query_id AND o.system = 'c' AND b.system = 'a' AND o.parsed AND b.parsed
            JOIN recalls r ON r.query_id = o.query_id"""
        )
    body = " UNION ALL ".join(parts)
    reasons = """array_to_string(list_filter([CASE WHEN ba - oa IS NULL OR bp - op IS NULL THEN 'empty bucket'
        WHEN ba - oa < 0.02 THEN printf('gap %.4f below noise of 0.02', ba - oa) END,
        CASE WHEN spread IS NOT NULL AND ba - oa >= 0.02 AND spread > 0.5 * (ba - oa)
          THEN printf('control failed: baseline varies by %.4f over buckets, against a gap of %.4f', spread, ba - oa) END],
        lambda x: x IS NOT NULL), '; ')"""
    return O.with_ctes(
        *_CHAT_PACK,
        _GOT,
        LAST,
        MARKS,
        f"g AS ({body})",
        select=f"""SELECT metric, n_shared, n_perfect_retrieval, round(oa, 6) AS ours_all, round(ba, 6) AS baseline_all,
          round(ba - oa, 6) + 0.0 AS gap_all, round(bp - op, 6) + 0.0 AS gap_perfect, spread,
          {reasons} AS uninterpretable_because,
          CASE WHEN {reasons} = '' THEN round((bp - op) / (ba - oa), 6) + 0.0 END AS survival FROM g""",
    )


def _bucket_sql() -> str:
    cells = " UNION ALL ".join(
        f"SELECT '{metric}' AS metric, CASE system WHEN 'c' THEN 'ours' ELSE 'baseline' END AS side, {_BUCKET.replace('recall', 'q.recall')} AS bucket, s.{col} AS v"
        " FROM scored s JOIN recalls q USING (query_id) WHERE system IN ('a', 'c') AND s.parsed AND q.recall IS NOT NULL"
        for metric, col in (("recall", "recall"), ("precision", "precision"), ("f1", "f"))
    )
    return O.with_ctes(
        *_CHAT_PACK, _GOT, LAST, MARKS, _BUCKETS,
        f"""cells AS ({cells}),
        st AS (SELECT metric, side, bucket, count(*) AS n, avg(v) AS mean FROM cells WHERE v IS NOT NULL GROUP BY ALL),
        flat AS (SELECT metric, side, CASE WHEN count(*) > 1 THEN round(max(m) - min(m), 4) + 0.0 END AS spread,
            CASE WHEN count(*) > 1 THEN round(stddev_pop(m), 4) + 0.0 END AS stdev
          FROM (SELECT metric, side, round(mean, 4) AS m FROM st WHERE side = 'baseline') GROUP BY ALL),
        every AS (SELECT metric, side, bucket FROM (VALUES ('recall'), ('precision'), ('f1')) m(metric), (VALUES ('ours'), ('baseline')) s(side), dim)""",
        select="""SELECT metric, side, bucket, coalesce(n, 0) AS n, round(mean, 6) AS mean, spread, stdev
          FROM every LEFT JOIN st USING (metric, side, bucket) LEFT JOIN flat USING (metric, side)""",
    )


@register("decomposition_buckets", _bucket_sql())
def decomposition_buckets(spark, sf):
    items = _fact_items(spark, sf).where("parsed")
    ours, base = items.where(F.col("system") == "c"), items.where(F.col("system") == "a")
    out = attribution.decomposition_buckets(_recalls(spark, sf), ours, base)
    return out.withColumn("mean", F.round("mean", 6))


@register("attribution", _attribution_sql())
def attribution_query(spark, sf):
    items = _fact_items(spark, sf).where("parsed")
    ours, base = items.where(F.col("system") == "c"), items.where(F.col("system") == "a")
    out = attribution.attribution(_recalls(spark, sf), ours, base)
    return out.select(
        "metric",
        "n_shared",
        "n_perfect_retrieval",
        *r6("ours_all", "baseline_all", "gap_all", "gap_perfect"),
        "spread",
        F.array_join("uninterpretable_because", "; ").alias("uninterpretable_because"),
        *r6("survival"),
    )


# --- alignment --------------------------------------------------------------------------------


def _alignment_files(spark, sf):
    """A file for each conversation: its turns are the references, and the predictions are all but one of them."""
    turns = V.table(spark, sf, "conversations").select(F.col("conv_id").cast("string").alias("file_id"), F.col("turn").alias("j"), "text")
    gone = turns.groupBy("file_id").agg(F.floor(F.count("*") / 3).alias("gone"))
    i = F.when(F.col("j") > F.col("gone"), F.col("j") - 1).otherwise(F.col("j"))
    preds = turns.join(gone, "file_id").where(F.col("j") != F.col("gone")).select("file_id", i.alias("i"), "text")
    return preds, turns


_FILES = f"""
refs AS (SELECT CAST(conv_id AS VARCHAR) AS file_id, turn AS j, text, count(*) OVER (PARTITION BY conv_id) AS nr FROM conversations),
apreds AS (SELECT file_id, CASE WHEN j > nr // 3 THEN j - 1 ELSE j END AS i, text FROM refs WHERE j <> nr // 3),
pt AS (SELECT file_id, i, {O.tokens('text')} AS t FROM apreds),
rt AS (SELECT file_id, j, nr, {O.tokens('text')} AS t FROM refs),
pcnt AS (SELECT file_id, i, tok, count(*) AS c FROM (SELECT file_id, i, unnest(t) AS tok FROM pt) GROUP BY ALL),
rcnt AS (SELECT file_id, j, tok, count(*) AS c FROM (SELECT file_id, j, unnest(t) AS tok FROM rt) GROUP BY ALL),
shared AS (SELECT file_id, i, j, sum(least(pcnt.c, rcnt.c)) AS h FROM pcnt JOIN rcnt USING (file_id, tok) GROUP BY ALL),
sim AS (SELECT pt.file_id, pt.i, rt.j, rt.nr, coalesce(h, 0) AS h, CASE WHEN coalesce(h, 0) = 0 THEN 0.0 ELSE
   2 * (h / len(pt.t)) * (h / len(rt.t)) / (h / len(pt.t) + h / len(rt.t)) END AS sim
   FROM pt JOIN rt ON rt.file_id = pt.file_id LEFT JOIN shared ON shared.file_id = pt.file_id AND shared.i = pt.i AND shared.j = rt.j)
"""


@register(
    "similarity_band",
    O.with_ctes(_FILES, select="SELECT file_id, i, CAST(j - i AS INTEGER) AS o, round(sim, 6) AS sim FROM sim WHERE j - i IN (0, 1)"),
)
def similarity_band(spark, sf):
    return alignment.band(*_alignment_files(spark, sf)).select("file_id", "i", "o", F.round("sim", 6).alias("sim"))


# With one reference gone the best mapping is the best place to switch from offset 0 to 1.
_SWITCH = """
b AS (SELECT file_id, i, max(sim) FILTER (j = i) AS s0, max(sim) FILTER (j = i + 1) AS s1 FROM sim WHERE j - i IN (0, 1) GROUP BY 1, 2),
t AS (SELECT file_id, i, coalesce(sum(s0) OVER (PARTITION BY file_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
           + sum(s1) OVER (PARTITION BY file_id ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS total FROM b),
best AS (SELECT file_id, arg_max(i, (round(total, 9), -i)) AS sw FROM t GROUP BY 1),
map AS (SELECT file_id, i, CASE WHEN i >= sw THEN i + 1 ELSE i END AS j FROM b JOIN best USING (file_id))
"""


@register("align", O.with_ctes(_FILES, _SWITCH, select="SELECT file_id, i, CAST(j AS BIGINT) AS j FROM map"))
def align(spark, sf):
    return alignment.align(alignment.band(*_alignment_files(spark, sf)))


_RIGID = "SELECT file_id, greatest(max(m), 0.0) AS rigid FROM (SELECT file_id, j - i AS o, avg(sim) AS m FROM sim WHERE j - i IN (0, 1) GROUP BY 1, 2) GROUP BY 1"


@register("rigid_offset", O.with_ctes(_FILES, select=f"SELECT file_id, round(rigid, 6) AS rigid FROM ({_RIGID})"))
def rigid_offset(spark, sf):
    rows = alignment.band(*_alignment_files(spark, sf))
    return alignment.rigid_offset(rows).select("file_id", F.round("rigid", 6).alias("rigid"))


@register(
    "alignment_controls",
    O.with_ctes(
        _FILES,
        _SWITCH,
        f"""m AS (SELECT s.file_id, s.i, s.j, s.sim, s.nr FROM map JOIN sim s USING (file_id, i, j)),
        per AS (SELECT m.file_id, m.i, any_value(m.nr) AS nr, any_value(m.sim) AS sim, count_if(s.j <> m.j AND s.sim < m.sim) / (any_value(m.nr) - 1) AS pct,
            sum(s.sim) FILTER (s.j <> m.j) AS other,
            count_if(s.j <> m.j AND (s.sim > m.sim OR (s.sim = m.sim AND s.j < m.j))) = 0 AS top
          FROM m JOIN sim s ON s.file_id = m.file_id AND s.i = m.i GROUP BY 1, 2),
        rig AS ({_RIGID}),
        f AS (SELECT file_id, count(*) AS n_predictions, any_value(nr) AS n_references, any_value(nr) - count(*) AS slack,
            round(avg(sim), 4) AS mean_matched_similarity, round(avg(pct), 4) AS mean_matched_percentile,
            round(sum(other) / (count(*) * (any_value(nr) - 1)), 4) AS mean_unmatched_similarity,
            round(avg(CASE WHEN top THEN 1.0 ELSE 0.0 END), 4) AS top1_recovery,
            round(avg(CASE WHEN top THEN 1.0 ELSE 0.0 END) * any_value(nr), 2) AS top1_lift_over_chance,
            round(any_value(rigid), 4) AS best_rigid_offset_similarity,
            CASE WHEN any_value(rigid) > 0 THEN round(avg(sim) / any_value(rigid), 4) END AS margin_over_rigid, true AS monotone
          FROM per JOIN rig USING (file_id) GROUP BY 1)""",
        select=f"""SELECT *, mean_matched_similarity >= {protocol.MIN_MEAN_SIM} AND mean_matched_percentile >= {protocol.MIN_MEAN_PERCENTILE}
          AND top1_lift_over_chance >= {protocol.MIN_TOP1_LIFT} AND coalesce(margin_over_rigid, 0.0) >= {protocol.MIN_MARGIN} AS passed FROM f""",
    ),
)
def alignment_controls(spark, sf):
    preds, refs = _alignment_files(spark, sf)
    rows = alignment.band(preds, refs)
    return alignment.verify(preds, refs, alignment.align(rows), rows)


# --- training targets -------------------------------------------------------------------------


def _gold(spark, sf):
    return targets.gold_windows(V.chat_utterances(spark, sf), V.chat_queries(spark, sf), CHUNK)


_SOURCES = f"""
src AS (SELECT query_id, any_value(query) AS query, string_agg(text, chr(10) ORDER BY s) AS t FROM pairs WHERE label = 1 GROUP BY 1)
"""


@register(
    "span_sources",
    O.with_ctes(
        *_CHAT_PACK,
        _SOURCES,
        select=f"""SELECT query_id, src.query, {O.truncate('t', SPAN)} AS source, reference AS target FROM src JOIN queries USING (query_id)""",
    ),
)
def span_sources(spark, sf):
    return targets.span_sources(_gold(spark, sf), SPAN)


@register(
    "fusion_examples",
    O.with_ctes(
        *_CHAT_PACK,
        _SOURCES,
        select=f"""SELECT query_id, {O.prompt('src.query', O.truncate('t', SPAN))} AS prompt, reference AS response
          FROM src JOIN queries USING (query_id)""",
    ),
)
def fusion_examples(spark, sf):
    return targets.fusion_examples(targets.span_sources(_gold(spark, sf), SPAN))


@register(
    "transcript_examples",
    O.with_ctes(
        O.CHAT_LINES,
        O.CHAT_QUERIES,
        "whole AS (SELECT meeting_id, string_agg(line, chr(10) ORDER BY utt_idx) AS t FROM lines GROUP BY 1)",
        select=f"""SELECT query_id, {O.prompt('query', O.truncate('t', protocol.TRANSCRIPT_WORDS))} AS prompt, reference AS response
          FROM queries JOIN whole USING (meeting_id)""",
    ),
)
def transcript_examples(spark, sf):
    return targets.transcript_examples(V.chat_utterances(spark, sf), V.chat_queries(spark, sf))


@register(
    "coarse_examples",
    O.with_ctes(
        *_CHAT_PACK,
        f"""gw AS (SELECT p.query_id, p.query, q.reference, p.s, p.text, row_number() OVER (PARTITION BY p.query_id ORDER BY p.s) - 1 AS place,
              count(*) OVER (PARTITION BY p.query_id) AS n_gold FROM pairs p JOIN queries q USING (query_id) WHERE label = 1),
        parts AS (SELECT query_id, reference, {O.sentences('reference')} AS ss FROM (SELECT DISTINCT query_id, reference FROM gw WHERE n_gold > 1)),
        sents AS (SELECT query_id, unnest(ss) AS sentence, generate_subscripts(ss, 1) AS no FROM parts),
        stok AS (SELECT query_id, no, tok, count(*) AS c FROM (SELECT query_id, no, unnest({O.tokens('sentence')}) AS tok FROM sents) GROUP BY ALL),
        wtok AS (SELECT query_id, s, tok, count(*) AS c FROM (SELECT query_id, s, unnest({O.tokens('text')}) AS tok FROM gw) GROUP BY ALL),
        hits AS (SELECT query_id, no, s, sum(least(stok.c, wtok.c)) AS h FROM stok JOIN wtok USING (query_id, tok) GROUP BY ALL),
        cand AS (SELECT x.query_id, x.no, x.sentence, g.s, g.place, coalesce(h, 0) AS h FROM sents x JOIN gw g USING (query_id)
                 LEFT JOIN hits USING (query_id, no, s)),
        best AS (SELECT *, row_number() OVER (PARTITION BY query_id, no ORDER BY h DESC, s) AS r FROM cand),
        ans AS (SELECT query_id, s, string_agg(sentence, ' ' ORDER BY no) AS response FROM best WHERE r = 1 GROUP BY ALL)""",
        select=f"""SELECT query_id || '_w' || place AS query_id, {O.prompt('query', 'text')} AS prompt, response
          FROM ans JOIN gw USING (query_id, s)""",
    ),
)
def coarse_examples(spark, sf):
    return targets.coarse_examples(_gold(spark, sf), stemmed=False)


@register(
    "recipe_mismatches",
    O.with_ctes(
        *_CHAT_PACK,
        _SOURCES,
        f"""x AS (SELECT query_id, conv_id, {O.truncate('t', SPAN)} AS a, {O.truncate('t', 60)} AS b FROM src JOIN queries USING (query_id))""",
        select="""SELECT query_id, 'absent' AS kind FROM x WHERE conv_id % 4 = 0
          UNION ALL SELECT query_id, 'prompt' FROM x WHERE conv_id % 4 <> 0 AND a <> b
          UNION ALL SELECT query_id, 'target' FROM x WHERE conv_id % 4 = 1""",
    ),
)
def recipe_mismatches(spark, sf):
    gold = _gold(spark, sf)
    conv = F.split("query_id", "_")[0].cast("bigint")
    other = targets.fusion_examples(targets.span_sources(gold, 60)).where(conv % 4 != 0)
    other = other.withColumn("response", F.when(conv % 4 == 1, F.concat("response", F.lit("!"))).otherwise(F.col("response")))
    return targets.recipe_mismatches(targets.span_sources(gold, SPAN), other)


@register(
    "rebuilt_prompts",
    O.with_ctes(
        *_CHAT_PACK,
        "joined AS (SELECT query_id, any_value(query) AS query, string_agg(text, chr(10) ORDER BY s) AS t FROM picked GROUP BY 1)",
        _SOURCES,
        select=f"""SELECT query_id, {O.prompt('joined.query', O.truncate('joined.t', SPAN))} AS prompt, reference AS response
          FROM src JOIN joined USING (query_id) JOIN queries USING (query_id)""",
    ),
)
def rebuilt_prompts(spark, sf):
    examples = targets.fusion_examples(targets.span_sources(_gold(spark, sf), SPAN))
    return targets.rebuilt_prompts(examples, retrieval.packed_prompts(_located(spark, sf)))


# --- prompts of the fact judge, stored rescoring, modes -----------------------------------------


@register(
    "fact_prompts",
    O.with_ctes(
        O.CHAT_QUERIES,
        LAST,
        f"""f AS (SELECT query_id, query, reference, prediction, {O.sentences('reference')} AS ss FROM preds WHERE system = 'a'),
        n AS (SELECT *, array_to_string(list_transform(ss, lambda s, i: i || '. ' || s), chr(10)) AS numbered FROM f)""",
        select=f"""SELECT query_id, {O.literal(prompts.MARK)} || query || chr(10) || chr(10) || 'Reference facts:' || chr(10) || numbered
            || chr(10) || chr(10) || 'Summary:' || chr(10) || prediction AS mark,
          {O.literal(prompts.EXTRACT)} || query || chr(10) || chr(10) || 'Reference answer:' || chr(10) || reference AS extract FROM n""",
    ),
)
def fact_prompts(spark, sf):
    q = V.chat_queries(spark, sf)
    marks = facts.marking_requests(q, V.fact_lists(spark, sf), V.predictions(spark, sf, "a"))
    extracts = facts.extraction_requests(q).select("query_id", F.col("prompt").alias("extract"))
    return marks.join(extracts, "query_id").select("query_id", F.col("prompt").alias("mark"), "extract")


@register(
    "rescored_facts",
    O.with_ctes(
        O.CHAT_QUERIES,
        LAST,
        MARKS,
        select="""SELECT system, CAST(count_if(parsed) AS BIGINT) AS n, 0.5 AS old_fact_f1, round(avg(f), 6) AS new_fact_f1,
          round(2 * avg(precision) * avg(recall) / (avg(precision) + avg(recall)), 6) AS f1_of_means,
          CAST(count_if(f = 0) AS BIGINT) AS zero_queries FROM scored GROUP BY 1""".replace("0.5 AS", "CAST(0.5 AS DOUBLE) AS"),
    ),
)
def rescored_facts(spark, sf):
    items = _fact_items(spark, sf)
    stored = items.select("system").distinct().withColumn("fact_f1", F.lit(0.5))
    out = facts.rescored_facts(items, stored, ["system"])
    return out.select("system", "n", "old_fact_f1", *r6("new_fact_f1", "f1_of_means"), "zero_queries")


@register(
    "compare_modes",
    O.with_ctes(
        O.CHAT_QUERIES,
        REPLIES,
        _TALLY,
        """c AS (SELECT contestant, judge_model, a_wins / n_decided AS p FROM tally WHERE (contestant LIKE 'gpt%') <> (judge_model LIKE 'gpt%')),
        g AS (SELECT contestant, count_if(winner = 'a') / count(*) AS p FROM won
              WHERE (contestant LIKE 'gpt%') <> (judge_model LIKE 'gpt%') AND turn = 0 GROUP BY 1)""",
        select="""SELECT contestant, c.judge_model AS clean_judge, round(c.p, 6) AS ours_win_rate_preference,
          round(g.p, 6) AS ours_win_rate_grounded, round(g.p - c.p, 6) + 0.0 AS grounding_lift FROM c JOIN g USING (contestant)""",
    ),
)
def compare_modes(spark, sf):
    items = _items(spark, sf)
    summary = lambda rows: judging.panel_summary(_vendor_risk(judging.judge_tally(rows)), V.CONTESTANTS)
    # The replies to opening turns play the grounded mode.
    opening = F.split("query_id", "_")[1].isin("g0", "s0")
    out = judging.compare_modes(summary(items), summary(items.where(opening)))
    return out.select("contestant", "clean_judge", *r6("ours_win_rate_preference", "ours_win_rate_grounded", "grounding_lift"))


@register(
    "reproduction_check",
    O.with_ctes(
        O.CHAT_QUERIES,
        LAST,
        overlap_ctes(1),
        select="""SELECT CAST(50.0 AS DOUBLE) AS author_rouge1, round(avg(f) * 100, 6) AS our_rouge1, round(avg(f) * 100 - 50, 6) + 0.0 AS delta,
          abs(avg(f) * 100 - 50) <= 3.0 AS passed FROM sc WHERE system = 'b'""",
    ),
)
def reproduction_check(spark, sf):
    out = alignment.reproduction_check(V.scored_pairs(spark, sf, "b").select("prediction", "reference"), 50.0, stemmed=False)
    return out.select("author_rouge1", *r6("our_rouge1", "delta"), "passed")


@register(
    "model_sources",
    O.with_ctes(
        O.CHAT_LINES,
        O.CHAT_QUERIES,
        "whole AS (SELECT meeting_id, string_agg(line, chr(10) ORDER BY utt_idx) AS t FROM lines GROUP BY 1)",
        select="SELECT query_id, query, t AS source FROM queries JOIN whole USING (meeting_id)",
    ),
)
def model_sources(spark, sf):
    return prompts.model_sources(V.chat_utterances(spark, sf), V.chat_queries(spark, sf), "full")


def _records_sql() -> str:
    cols = ("n_shared", "a_mean", "b_mean", "observed_diff", "median_abs_per_query_diff", "ci95_low", "ci95_high", "p_b_better", "crosses_zero")
    part = lambda unit, name, n: (
        f"SELECT 'c' AS run_a, 'b' AS run_b, '{unit}' AS resampling_unit, {n} AS n_clusters, {', '.join(cols)} FROM ({ORACLES[name]})"
    )
    return (
        part("query", "paired_bootstrap", "CAST(NULL AS BIGINT)") + " UNION ALL " + part("meeting", "cluster_bootstrap", "n_clusters")
    )


@register("interval_records", _records_sql())
def interval_records(spark, sf):
    scores = None
    for run in ("b", "c"):
        pairs = V.scored_pairs(spark, sf, run).select("query_id", "prediction", "reference")
        rows = R.with_rouge(pairs, ["rouge1"], stemmed=False).select(
            F.lit(run).alias("run_id"), F.lit("rouge1").alias("metric"), F.lit("test").alias("split"), "query_id", F.col("rouge1.f").alias("score")
        )
        scores = rows if scores is None else scores.unionByName(rows)
    todo = [
        {"a": "c", "b": "b", "metric": "rouge1", "split": "test"},
        {"a": "c", "b": "b", "metric": "rouge1", "split": "test", "resampling_unit": "meeting"},
    ]
    clusters = V.chat_queries(spark, sf).select("query_id", F.col("meeting_id").alias("cluster_id"))
    out = resampling.interval_records(scores, todo, clusters)
    return out.select(
        "run_a",
        "run_b",
        "resampling_unit",
        "n_clusters",
        "n_shared",
        *r6("a_mean", "b_mean", "observed_diff", "median_abs_per_query_diff", "ci95_low", "ci95_high"),
        "p_b_better",
        "crosses_zero",
    )
