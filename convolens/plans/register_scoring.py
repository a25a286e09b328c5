"""Overlap metrics, score rows, costs and resampling."""

from __future__ import annotations

from pyspark.sql import functions as F

from convolens import protocol
from convolens.functions import rouge as R
from convolens.functions import text as T
from convolens.operators import costs, resampling, scoring
from convolens.plans import oracle as O
from convolens.plans import stems_sql
from convolens.plans import views as V
from convolens.plans.catalogue import register


def r6(*columns):
    return [F.round(c, 6).alias(c) for c in columns]


LAST = """
lasts AS (SELECT conv_id, max_by(text, turn) AS last FROM conversations WHERE role = 'assistant' GROUP BY 1),
firsts AS (SELECT conv_id, text AS last FROM conversations WHERE turn = 0),
preds AS (
  SELECT 'a' AS system, query_id, meeting_id, conv_id, turn, query, reference, last AS prediction
  FROM queries JOIN lasts USING (conv_id)
  UNION ALL
  SELECT 'b', query_id, meeting_id, conv_id, turn, query, reference, query || ' ' || last FROM queries JOIN lasts USING (conv_id)
  UNION ALL
  SELECT 'c', query_id, meeting_id, conv_id, turn, query, reference, last FROM queries JOIN firsts USING (conv_id))
"""


def overlap_ctes(n: int = 1) -> str:
    """CTE `ov`: shared n-grams and both totals for every prediction."""
    gram = lambda t: t if n == 1 else f"list_transform(range(1, greatest(len({t}), 1)), lambda i: ({t})[i] || ' ' || ({t})[i + 1])"
    return f"""
toks AS (SELECT system, query_id, {O.tokens('prediction')} AS p, {O.tokens('reference')} AS r FROM preds),
grams AS (SELECT system, query_id, {gram('p')} AS p, {gram('r')} AS r FROM toks),
pc AS (SELECT system, query_id, g, count(*) AS c FROM (SELECT system, query_id, unnest(p) AS g FROM grams) GROUP BY ALL),
rc AS (SELECT system, query_id, g, count(*) AS c FROM (SELECT system, query_id, unnest(r) AS g FROM grams) GROUP BY ALL),
hit AS (SELECT system, query_id, sum(least(pc.c, rc.c)) AS h FROM pc JOIN rc USING (system, query_id, g) GROUP BY ALL),
ov AS (SELECT g.system, g.query_id, coalesce(h, 0) AS h, len(p) AS np, len(r) AS nr,
              coalesce(h, 0) / greatest(len(p), 1) AS prec, coalesce(h, 0) / greatest(len(r), 1) AS rec
       FROM grams g LEFT JOIN hit USING (system, query_id)),
sc AS (SELECT *, CASE WHEN prec + rec > 0 THEN 2 * prec * rec / (prec + rec) ELSE 0.0 END AS f FROM ov)
"""


def _metric(spark, sf, metric):
    parts = None
    for system in ("a", "b", "c"):
        pairs = V.scored_pairs(spark, sf, system).select(F.lit(system).alias("system"), "query_id", "prediction", "reference")
        parts = pairs if parts is None else parts.unionByName(pairs)
    return R.with_rouge(parts, [metric], stemmed=False).select(
        "system",
        "query_id",
        *[F.round(f"{metric}.{k}", 6).alias(name) for k, name in zip("prf", ("precision", "recall", "fmeasure"))],
    )


_METRIC_SELECT = """SELECT system, query_id, round(prec, 6) AS precision, round(rec, 6) AS recall,
  round(f, 6) AS fmeasure FROM sc"""


@register("rouge1", O.with_ctes(O.CHAT_QUERIES, LAST, overlap_ctes(1), select=_METRIC_SELECT))
def rouge1(spark, sf):
    return _metric(spark, sf, "rouge1")


@register("rouge2", O.with_ctes(O.CHAT_QUERIES, LAST, overlap_ctes(2), select=_METRIC_SELECT))
def rouge2(spark, sf):
    return _metric(spark, sf, "rouge2")


# The longest common subsequence is the longest rising run through the matching positions: they are
# read by reference token, later positions first, and a list keeps the lowest end of every length.
_TOKS = f"toks AS (SELECT system, query_id, {O.tokens('prediction')} AS p, {O.tokens('reference')} AS r FROM preds),"
_LCS_OF = """
pt AS (SELECT system, query_id, unnest(p) AS t, generate_subscripts(p, 1) AS k FROM toks),
rt AS (SELECT system, query_id, unnest(r) AS t, generate_subscripts(r, 1) AS k FROM toks),
met AS (SELECT system, query_id, list(pt.k ORDER BY rt.k, pt.k DESC) AS ks FROM pt JOIN rt USING (system, query_id, t) GROUP BY ALL),
runs AS (SELECT system, query_id, len(list_reduce(
    list_concat([CAST([] AS BIGINT[])], list_transform(ks, lambda k: [k])),
    lambda ends, x: list_concat(list_append(ends[1:len(list_filter(ends, lambda e: e < x[1]))], x[1]),
                                ends[len(list_filter(ends, lambda e: e < x[1])) + 2:]))) AS h FROM met),
lcs AS (SELECT system, query_id, len(p) AS np, len(r) AS nr, coalesce(h, 0) AS h FROM toks LEFT JOIN runs USING (system, query_id))
"""


@register(
    "rougeL",
    O.with_ctes(
        O.CHAT_QUERIES,
        LAST,
        _TOKS + _LCS_OF,
        select="""SELECT system, query_id, round(h / greatest(np, 1), 6) AS precision,
          round(h / greatest(nr, 1), 6) AS recall,
          CASE WHEN h = 0 THEN 0.0 ELSE round(2.0 * h / (np + nr), 6) END AS fmeasure FROM lcs""",
    ),
)
def rouge_l(spark, sf):
    return _metric(spark, sf, "rougeL")


def _f(hits: str, less: int = 0) -> str:
    """F of hits against both lengths, each less by `less`."""
    n_pred, n_ref = (f"greatest(len({side}) - {less}, 1)" for side in ("p", "r"))
    p, r = f"coalesce({hits}, 0) / {n_pred}", f"coalesce({hits}, 0) / {n_ref}"
    return f"CASE WHEN coalesce({hits}, 0) > 0 THEN round(2 * ({p}) * ({r}) / (({p}) + ({r})), 6) ELSE 0.0 END"


_GRAMS = """
g{n} AS (
  SELECT query_id, side, g, count(*) AS c
  FROM (SELECT query_id, side, unnest(list_transform(range(1, greatest(len(t) - {n} + 2, 1)), lambda i: array_to_string(t[i:i + {n} - 1], ' '))) AS g FROM flat) GROUP BY ALL),
h{n} AS (
  SELECT p.query_id, sum(least(p.c, r.c)) AS h FROM g{n} p JOIN g{n} r ON p.query_id = r.query_id AND p.g = r.g AND p.side = 'p' AND r.side = 'r' GROUP BY 1),
"""


@register(
    "rouge_stemmed",
    O.with_ctes(
        O.CHAT_QUERIES,
        LAST,
        stems_sql.SENTENCES
        + stems_sql.UNION_LCS
        + _GRAMS.format(n=1)
        + _GRAMS.format(n=2)
        + "stemmed AS (SELECT 'b' AS system, q.query_id, coalesce(x.t, []) AS p, coalesce(y.t, []) AS r FROM (SELECT query_id FROM preds WHERE system = 'b') q"
        " LEFT JOIN flat x ON q.query_id = x.query_id AND x.side = 'p' LEFT JOIN flat y ON q.query_id = y.query_id AND y.side = 'r'),"
        + _LCS_OF.replace("FROM toks", "FROM stemmed"),
        select=f"""SELECT stemmed.query_id, {_f('h1.h')} AS rouge1, {_f('h2.h', 1)} AS rouge2, {_f('lcs.h')} AS "rougeL", {_f('lsum.h')} AS "rougeLsum"
          FROM (SELECT query_id, p, r FROM stemmed) stemmed LEFT JOIN h1 USING (query_id) LEFT JOIN h2 USING (query_id) LEFT JOIN (SELECT query_id, h FROM lcs) lcs USING (query_id) LEFT JOIN lsum USING (query_id)""",
    ),
)
def rouge_stemmed(spark, sf):
    pairs = V.scored_pairs(spark, sf, "b").select("query_id", "prediction", "reference")
    scored = R.with_rouge(pairs)
    return scored.select("query_id", *[F.round(f"{m}.f", 6).alias(m) for m in R.METRICS])


@register(
    "token_f1",
    O.with_ctes(
        O.CHAT_QUERIES, LAST, overlap_ctes(1), select="SELECT query_id, round(f, 6) AS token_f1 FROM sc WHERE system = 'b'"
    ),
)
def token_f1(spark, sf):
    p = V.scored_pairs(spark, sf, "b")
    f = R.token_f1(T.alnum_tokens(F.col("prediction")), T.alnum_tokens(F.col("reference")))
    return p.select("query_id", F.round(f, 6).alias("token_f1"))


def _all_systems(spark, sf):
    parts = None
    for system in ("a", "b", "c"):
        rows = V.scored_pairs(spark, sf, system).withColumn("system", F.lit(system))
        parts = rows if parts is None else parts.unionByName(rows)
    return parts


@register(
    "precision_recall",
    O.with_ctes(
        O.CHAT_QUERIES,
        LAST,
        overlap_ctes(1),
        f"""lens AS (SELECT system, list_sort(list({O.n_words('prediction')})) AS ls FROM preds GROUP BY 1),
        ref AS (SELECT list_sort(list({O.n_words('reference')})) AS ls FROM queries)""",
        select="""SELECT system, count(*) AS n, round(avg(prec), 6) AS precision, round(avg(rec), 6) AS recall,
          round(avg(f), 6) AS fmeasure, any_value(lens.ls[len(lens.ls) // 2 + 1]) AS median_words,
          any_value(ref.ls[len(ref.ls) // 2 + 1]) AS reference_median_words,
          round(any_value(lens.ls[len(lens.ls) // 2 + 1] / ref.ls[len(ref.ls) // 2 + 1]), 6) AS length_vs_reference
          FROM sc JOIN lens USING (system) CROSS JOIN ref GROUP BY system""",
    ),
)
def precision_recall(spark, sf):
    rows = _all_systems(spark, sf).select("system", "prediction", "reference")
    out = scoring.precision_recall(
        R.with_rouge(rows, ["rouge1"], stemmed=False), V.chat_queries(spark, sf).select("reference")
    )
    return out.select(
        "system",
        "n",
        *r6("precision", "recall", "fmeasure"),
        "median_words",
        "reference_median_words",
        *r6("length_vs_reference"),
    )


@register(
    "corpus_score",
    O.with_ctes(
        O.CHAT_QUERIES,
        LAST,
        overlap_ctes(1),
        select="SELECT system, count(*) AS n, round(avg(f), 6) AS rouge1 FROM sc GROUP BY 1",
    ),
)
def corpus_score(spark, sf):
    rows = R.with_rouge(_all_systems(spark, sf).select("system", "prediction", "reference"), ["rouge1"], stemmed=False)
    return scoring.quality_means(rows, ["system"], ["rouge1"]).withColumn("rouge1", F.round("rouge1", 6))


@register(
    "self_agreement",
    O.with_ctes(
        O.CHAT_QUERIES,
        LAST.replace("preds AS", "raw_preds AS"),
        """preds AS (SELECT 'x' AS system, a.query_id, a.prediction, c.prediction AS reference
           FROM raw_preds a JOIN raw_preds c USING (query_id) WHERE a.system = 'a' AND c.system = 'b')""",
        overlap_ctes(1),
        select="""SELECT (SELECT round(avg(CASE WHEN prediction = reference THEN 1.0 ELSE 0.0 END), 6) FROM preds) AS exact_match_rate,
          round(avg(f), 6) AS self_rouge1 FROM sc""",
    ),
)
def self_agreement(spark, sf):
    out = scoring.self_agreement(V.predictions(spark, sf, "a"), V.predictions(spark, sf, "b"), ["rouge1"], stemmed=False)
    return out.select(*r6("exact_match_rate", "self_rouge1"))


# --- runs from events -------------------------------------------------------------------------

_MODEL_CASE = "CASE event_type " + " ".join(f"WHEN '{e}' THEN '{m}'" for e, m in V.MODELS.items()) + " END"
_PRICES = "prices(model, ri, ro, bi, bo) AS (VALUES " + ", ".join(
    f"('{m}', {a}, {b}, {c}, {d})" for m, a, b, c, d in [
        (m, *[f"CAST({x} AS DOUBLE)" for x in p]) for m, *p in costs.PRICES if p[2] is not None
    ]
) + ")"
RUNS = f"""
{_PRICES},
runs AS (
  SELECT event_id AS query_id, event_type AS system, user_id, {_MODEL_CASE} AS model,
         CAST(props->>'k' AS BIGINT) * 100 AS pt, CAST(props->>'k' AS BIGINT) AS ct,
         CASE WHEN event_id % 5 = 0 THEN CAST(props->>'k' AS BIGINT) % 7 ELSE 0 END AS tt,
         CASE event_id % 3 WHEN 0 THEN 'batch' WHEN 1 THEN 'sync' END AS mode,
         CASE WHEN event_id % 7 <> 0 THEN value END AS latency_s,
         CASE WHEN event_id % 7 <> 0 THEN value / 8 END AS locate_s,
         CASE WHEN event_id % 11 <> 0 OR event_type <> 'error' THEN value / 4 END AS generate_s,
         event_id < 10 AS warmup,
         CASE WHEN user_id % 2 = 0 THEN 'gpu-a' WHEN event_type <> 'view' THEN 'gpu-b' END AS device,
         CASE WHEN event_id % 4 <> 0 THEN value / 16 END AS peak
  FROM events),
costed AS (SELECT *, pt / 1e6 * (CASE WHEN mode = 'batch' THEN bi ELSE ri END)
                   + (ct + tt) / 1e6 * (CASE WHEN mode = 'batch' THEN bo ELSE ro END) AS cost FROM runs JOIN prices USING (model))
"""


@register("cost", O.with_ctes(RUNS, select="SELECT query_id, mode, round(cost, 9) AS cost_usd FROM costed"))
def cost(spark, sf):
    rows = costs.with_cost(V.event_runs(spark, sf), costs.price_table(spark))
    return rows.select("query_id", "mode", F.round("cost_usd", 9).alias("cost_usd"))


_TIMED = "latency_s IS NOT NULL AND NOT warmup"


def _mean_sql(c: str) -> str:
    v = f"CASE WHEN {_TIMED} THEN {c} END"
    return f"CASE WHEN count({v}) = count_if({_TIMED}) THEN round(avg({v}), 3) END AS {c}_mean"


@register(
    "score_row",
    O.with_ctes(
        RUNS,
        select=f"""SELECT system, count(*) AS n, round(sum(cost), 6) AS cost_usd_total, {_mean_sql('latency_s')},
          {_mean_sql('locate_s')}, {_mean_sql('generate_s')}, CAST(nullif(count_if({_TIMED}), 0) AS BIGINT) AS latency_n_timed,
          nullif(string_agg(DISTINCT device, '+' ORDER BY device), '') AS device,
          nullif(string_agg(DISTINCT mode, '+' ORDER BY mode), '') AS billing_mode FROM costed GROUP BY system""",
    ),
)
def score_row(spark, sf):
    return scoring.run_figures(costs.with_cost(V.event_runs(spark, sf), costs.price_table(spark)), ["system"])


_MEASURED = """
noted AS (
  SELECT *, CASE WHEN k % 7 <> 0 THEN (k % 1000) / 8.0 END AS latency_s, CASE WHEN k % 7 <> 0 THEN (k % 1000) / 32.0 END AS locate_s,
         CASE WHEN k % 11 <> 0 THEN (k % 1000) / 16.0 END AS generate_s, k % 13 = 0 AS warmup,
         CASE WHEN k % 2 = 0 THEN 'gpu-a' ELSE 'gpu-b' END AS device, CASE WHEN k % 3 = 0 THEN 'batch' END AS mode,
         CASE WHEN k % 5 <> 0 THEN (k % 64) / 1024.0 END AS cost, CASE WHEN k % 4 <> 0 THEN (k % 97) / 4.0 END AS peak
  FROM (SELECT query_id, conv_id * 7 + turn AS k FROM preds WHERE system = 'b')),
p AS (SELECT list_sort(list(peak) FILTER (peak IS NOT NULL)) AS v FROM noted)
"""


@register(
    "run_score_row",
    O.with_ctes(
        O.CHAT_QUERIES,
        LAST,
        overlap_ctes(1),
        "f1 AS (SELECT round(avg(f), 6) AS rouge1, count(*) AS n FROM sc WHERE system = 'b')",
        overlap_ctes(2).replace("toks", "toks2").replace("grams", "grams2").replace("pc", "pc2").replace("rc", "rc2")
        .replace("hit", "hit2").replace("ov", "ov2").replace("sc AS", "sc2 AS"),
        "f2 AS (SELECT round(avg(f), 6) AS rouge2 FROM sc2 WHERE system = 'b')",
        _MEASURED,
        f"""fig AS (
          SELECT round(sum(cost), 6) AS cost_usd_total, {_mean_sql('latency_s')}, {_mean_sql('locate_s')}, {_mean_sql('generate_s')},
            CAST(nullif(count_if({_TIMED}), 0) AS BIGINT) AS latency_n_timed, string_agg(DISTINCT device, '+' ORDER BY device) AS device,
            string_agg(DISTINCT mode, '+' ORDER BY mode) AS billing_mode FROM noted)""",
        select="""SELECT 'run-b' AS run_id, 'test' AS split, n, rouge1, rouge2, fig.*, v[-1] AS peak_vram_gb_max,
          CASE WHEN len(v) % 2 = 1 THEN v[len(v) // 2 + 1] ELSE round((v[len(v) // 2] + v[len(v) // 2 + 1]) / 2, 3) END AS peak_vram_gb_median,
          v[CAST(least(len(v) - 1, round_even(CAST(0.95 AS DOUBLE) * (len(v) - 1), 0)) AS BIGINT) + 1] AS peak_vram_gb_p95,
          v[-1] + 0.5 AS peak_vram_reserved_gb_max, 'measured by rule' AS notes FROM f1, f2, fig, p""",
    ),
)
def run_score_row(spark, sf):
    """The whole row of one run: guards, overlap, cost, times and memory peaks; what was measured follows from the ids."""
    at = lambda i: F.regexp_extract("query_id", "^([0-9]+)_.([0-9]+)$", i).cast("bigint")
    k = F.col("k")
    measured = V.predictions(spark, sf, "b").withColumn("k", at(1) * 7 + at(2)).select(
        "query_id",
        "prediction",
        F.when(k % 7 != 0, k % 1000 / 8).alias("latency_s"),
        F.when(k % 7 != 0, k % 1000 / 32).alias("locate_s"),
        F.when(k % 11 != 0, k % 1000 / 16).alias("generate_s"),
        (k % 13 == 0).alias("warmup"),
        F.when(k % 2 == 0, "gpu-a").otherwise("gpu-b").alias("device"),
        F.when(k % 3 == 0, "batch").alias("mode"),
        F.when(k % 5 != 0, k % 64 / 1024).alias("cost_usd"),
        F.when(k % 4 != 0, k % 97 / 4).alias("peak_vram_gb"),
        F.when(k % 4 != 0, k % 97 / 4 + 0.5).alias("peak_vram_reserved_gb"),
    )
    row = scoring.score_row(
        measured, V.chat_queries(spark, sf), "run-b", "test", "measured by rule", ["rouge1", "rouge2"], stemmed=False
    )
    return row.withColumns({m: F.round(m, 6) for m in ("rouge1", "rouge2")})


@register(
    "peak_summary",
    O.with_ctes(
        RUNS,
        "p AS (SELECT system, list_sort(list(peak) FILTER (peak IS NOT NULL)) AS v FROM runs GROUP BY 1)",
        select="""SELECT system, v[-1] AS "max", v[1] AS "min", CAST(len(v) AS BIGINT) AS n,
          CASE WHEN len(v) % 2 = 1 THEN v[len(v) // 2 + 1] ELSE round((v[len(v) // 2] + v[len(v) // 2 + 1]) / 2, 3) END AS median,
          v[CAST(least(len(v) - 1, round_even(CAST(0.95 AS DOUBLE) * (len(v) - 1), 0)) AS BIGINT) + 1] AS p95 FROM p""",
    ),
)
def peak_summary(spark, sf):
    return scoring.peak_summary(V.event_runs(spark, sf), ["system"], "peak_vram_gb")


@register(
    "latency_probe",
    O.with_ctes(
        RUNS,
        select="""SELECT system, round(avg(latency_s), 6) AS mean, round(median(latency_s), 6) AS median,
          min(latency_s) AS "min", max(latency_s) AS "max", round(max(latency_s) / min(latency_s), 6) AS spread_ratio
          FROM runs GROUP BY 1""",
    ),
)
def latency_probe(spark, sf):
    out = scoring.latency_probe(V.event_runs(spark, sf), ["system"])
    return out.select("system", *r6("mean", "median"), "min", "max", *r6("spread_ratio"))


@register(
    "seed_spread",
    O.with_ctes(
        RUNS,
        """seeds AS (SELECT system, user_id AS seed, avg(generate_s) AS score FROM runs GROUP BY ALL),
        known AS (SELECT * FROM seeds WHERE score IS NOT NULL)""",
        select="""SELECT system, count(*) AS n, round(min(score), 6) AS "min", round(max(score), 6) AS "max",
          arg_min(seed, score) AS min_seed, arg_max(seed, score) AS max_seed, round(max(score) - min(score), 6) + 0.0 AS "range",
          round(avg(score), 6) AS mean, round(stddev_samp(score), 6) AS stdev,
          CASE WHEN max(score) - min(score) >= 1.7 THEN 'BRANCH A' WHEN max(score) - min(score) >= 0.9
               THEN 'BRANCH A (weaker form)' ELSE 'BRANCH B' END AS verdict FROM known GROUP BY 1""",
    ),
)
def seed_spread(spark, sf):
    runs = V.event_runs(spark, sf).groupBy("system", F.col("user_id").alias("seed")).agg(F.avg("generate_s").alias("score"))
    out = scoring.seed_spread(runs, ["system"], "score")
    return out.select(
        "system",
        "n",
        "min_seed",
        "max_seed",
        scoring.seed_verdict(F.col("range")).alias("verdict"),
        *r6("min", "max", "range", "mean", "stdev"),
    )


@register(
    "worst_case",
    O.with_ctes(RUNS, select="SELECT system, device, max(peak) AS peak_vram_gb_worst FROM runs GROUP BY ALL"),
)
def worst_case(spark, sf):
    return scoring.worst_case(V.event_runs(spark, sf), ["system", "device"], "peak_vram_gb")


@register("dup_guard", "SELECT user_id, count(*) AS copies FROM events GROUP BY 1 HAVING count(*) > 1")
def dup_guard(spark, sf):
    return scoring.duplicate_ids(V.table(spark, sf, "events"), "user_id")


@register(
    "missing_guard",
    "SELECT d.doc_id FROM documents d ANTI JOIN labels l ON l.doc_id = d.doc_id",
)
def missing_guard(spark, sf):
    return scoring.missing_ids(V.table(spark, sf, "documents"), V.table(spark, sf, "labels"), "doc_id")


@register(
    "batch_prefix",
    """WITH r AS (SELECT doc_id, length(text) / 4.0 + 512 AS est_tokens,
        sum(length(text) / 4.0 + 512) OVER (ORDER BY doc_id) AS run FROM documents)
    SELECT doc_id, est_tokens, run AS enqueued_tokens FROM r WHERE run <= 900000 * 0.85 OR doc_id = (SELECT min(doc_id) FROM documents)""",
)
def batch_prefix(spark, sf):
    rows = V.table(spark, sf, "documents").select("doc_id", T.estimate_tokens(F.col("text")).alias("est_tokens"))
    return costs.batch_prefix(rows, "doc_id")


@register(
    "pending",
    """SELECT d.doc_id AS query_id, d.n_chars FROM documents d ANTI JOIN labels l ON l.doc_id = d.doc_id""",
)
def pending(spark, sf):
    docs = V.table(spark, sf, "documents").select(F.col("doc_id").alias("query_id"), "n_chars")
    return costs.pending(docs, V.table(spark, sf, "labels").select(F.col("doc_id").alias("query_id")))


@register(
    "cache_coverage",
    """SELECT count(l.doc_id) AS written, CAST(count_if(l.doc_id IS NULL) AS BIGINT) AS missing
    FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id""",
)
def cache_coverage(spark, sf):
    docs = V.table(spark, sf, "documents").select(F.col("doc_id").alias("query_id"))
    return costs.cache_coverage(docs, V.table(spark, sf, "labels").select(F.col("doc_id").alias("query_id")))


# --- text shape -------------------------------------------------------------------------------

_PROFILE = f"""
w AS (SELECT source AS system, text, {O.uwords('text')} AS w, len({O.sentences('text', False)}) AS sc FROM documents),
g AS (SELECT *, list_zip(w, w[2:], w[3:], w[4:], true) AS g FROM w),
s AS (SELECT system, len(w) AS wc, sc,
        CASE WHEN len(w) < 4 THEN 0.0 ELSE (len(g) - len(list_distinct(g))) / len(g) END AS rep,
        CASE WHEN len(w) = 0 THEN 0.0 ELSE len(list_distinct(w)) / len(w) END AS ttr FROM g),
prof AS (SELECT system, count(*) AS n, avg(wc) AS words_mean, avg(rep) AS repeat_4gram_mean,
        CAST(count_if(rep > 0.20) AS BIGINT) AS degenerate_rows, avg(ttr) AS type_token_ratio_mean,
        median(wc) AS words_median, median(sc) AS sentences_median FROM s GROUP BY 1)
"""


def _profile(spark, sf):
    rows = V.table(spark, sf, "documents").select(F.col("source").alias("system"), F.col("text").alias("prediction"))
    return scoring.text_profile(rows, ["system"])


@register(
    "text_profile",
    O.with_ctes(
        _PROFILE,
        select="""SELECT system, n, round(words_mean, 6) AS words_mean, round(repeat_4gram_mean, 6) AS repeat_4gram_mean,
          degenerate_rows, round(type_token_ratio_mean, 6) AS type_token_ratio_mean, words_median, sentences_median FROM prof""",
    ),
)
def text_profile(spark, sf):
    return _profile(spark, sf).select(
        "system",
        "n",
        *r6("words_mean", "repeat_4gram_mean", "type_token_ratio_mean"),
        "degenerate_rows",
        "words_median",
        "sentences_median",
    )


@register(
    "screening",
    O.with_ctes(
        _PROFILE,
        """j AS (SELECT p.system, list_filter([
            CASE WHEN p.degenerate_rows > 0.05 * p.n THEN 'degenerate rows' END,
            CASE WHEN p.repeat_4gram_mean > 2 * greatest(b.repeat_4gram_mean, 0.005) THEN 'self-repeat doubled' END,
            CASE WHEN p.words_median <= b.words_median * 1.15 THEN 'length barely moved' END], lambda x: x IS NOT NULL) AS r
          FROM prof p JOIN prof b ON b.system = 'src0' AND p.system <> 'src0')""",
        select="SELECT system, len(r) = 0 AS worth_marking, array_to_string(r, '; ') AS blocked_because FROM j",
    ),
)
def screening(spark, sf):
    out = scoring.screening_verdicts(_profile(spark, sf), "src0")
    return out.withColumn("blocked_because", F.array_join("blocked_because", "; "))


# --- resampling -------------------------------------------------------------------------------

DRAWS = protocol.BOOTSTRAP_DRAWS
LO, HI = resampling.interval_ranks(DRAWS)


def _scores(spark, sf, system):
    pairs = V.scored_pairs(spark, sf, system).select("query_id", "prediction", "reference")
    scored = R.with_rouge(pairs, ["rouge1"], stemmed=False)
    return scored.select("query_id", F.col("rouge1.f").alias("score"))


def _pair(spark, sf):
    return resampling.pair_scores(_scores(spark, sf, "c"), _scores(spark, sf, "b"))


_PAIR = """
pair AS (SELECT x.query_id, x.f AS a, y.f AS b, y.f - x.f AS d
         FROM sc x JOIN sc y ON y.query_id = x.query_id WHERE x.system = 'c' AND y.system = 'b'),
obs AS (SELECT count(*) AS n_shared, avg(a) AS a_mean, avg(b) AS b_mean, avg(b) - avg(a) AS observed_diff,
   CAST(count_if(d > 0) AS BIGINT) AS per_query_b_wins, CAST(count_if(d < 0) AS BIGINT) AS per_query_a_wins,
   CAST(count_if(d = 0) AS BIGINT) AS per_query_ties, median(abs(d)) AS median_abs_per_query_diff FROM pair)
"""
_OBS = """n_shared, round(a_mean, 6) AS a_mean, round(b_mean, 6) AS b_mean, round(observed_diff, 6) + 0.0 AS observed_diff,
  per_query_b_wins, per_query_a_wins, per_query_ties, round(median_abs_per_query_diff, 6) AS median_abs_per_query_diff"""
_CI = f"""round(ds[{LO + 1}], 6) + 0.0 AS ci95_low, round(ds[{HI + 1}], 6) + 0.0 AS ci95_high, p_b_better,
  ds[{LO + 1}] <= 0 AND ds[{HI + 1}] >= 0 AS crosses_zero"""
ROUNDED = (
    "a_mean", "b_mean", "observed_diff", "median_abs_per_query_diff", "ci95_low", "ci95_high",
)


def _rounded(out):
    return out.select(*[F.round(c, 6).alias(c) if c in ROUNDED else F.col(c) for c in out.columns])


_DRAWN = f"""
slots AS (SELECT d.range AS draw, s.range AS slot, (SELECT n FROM size) AS n
          FROM range({DRAWS}) d, range((SELECT n FROM size)) s),
picks AS (SELECT draw, {resampling.hashed_sql('draw', 'slot', protocol.SEED)} % n AS idx FROM slots),
"""


@register(
    "paired_bootstrap",
    O.with_ctes(
        O.CHAT_QUERIES,
        LAST,
        overlap_ctes(1),
        _PAIR,
        f"""size AS (SELECT count(*) AS n FROM pair),
        num AS (SELECT *, row_number() OVER (ORDER BY query_id) - 1 AS idx FROM pair),
        {_DRAWN}
        sums AS (SELECT draw, avg(d) AS m FROM picks JOIN num USING (idx) GROUP BY 1),
        ci AS (SELECT list_sort(list(m)) AS ds, count_if(m > 0) / {DRAWS} AS p_b_better FROM sums)""",
        select=f"SELECT {_OBS}, {_CI} FROM obs CROSS JOIN ci",
    ),
)
def paired_bootstrap(spark, sf):
    return _rounded(resampling.paired_bootstrap(_pair(spark, sf)))


@register(
    "cluster_bootstrap",
    O.with_ctes(
        O.CHAT_QUERIES,
        LAST,
        overlap_ctes(1),
        _PAIR,
        f"""clus AS (SELECT q.meeting_id, sum(d) AS d, count(*) AS m FROM pair JOIN queries q USING (query_id) GROUP BY 1),
        size AS (SELECT count(*) AS n FROM clus),
        num AS (SELECT *, row_number() OVER (ORDER BY meeting_id) - 1 AS idx FROM clus),
        {_DRAWN}
        sums AS (SELECT draw, sum(d) / sum(m) AS m FROM picks JOIN num USING (idx) GROUP BY 1),
        ci AS (SELECT list_sort(list(m)) AS ds, count_if(m > 0) / {DRAWS} AS p_b_better FROM sums)""",
        select=f"SELECT {_OBS}, (SELECT n FROM size) AS n_clusters, {_CI} FROM obs CROSS JOIN ci",
    ),
)
def cluster_bootstrap(spark, sf):
    clusters = V.chat_queries(spark, sf).select("query_id", F.col("meeting_id").alias("cluster_id"))
    return _rounded(resampling.paired_cluster_bootstrap(resampling.with_clusters(_pair(spark, sf), clusters)))


# The same with many blocks: a block's share of a draw comes down the tree of halves.
BLOCK = 16
_Z = " + ".join(f"{resampling.hashed_sql(f'(draw * 16 + {j})', '(lo * 1048576 + hi)', protocol.SEED + 1)} / {resampling.PRIME}" for j in range(12))
_FIRST = f"""CAST(least(greatest(floor(cnt * share + (({_Z}) - 6.0) * sqrt(cnt * share * (1.0 - share)) + 0.5), 0), cnt) AS BIGINT)"""


@register(
    "tree_bootstrap",
    O.with_ctes(
        O.CHAT_QUERIES,
        LAST,
        overlap_ctes(1),
        _PAIR,
        f"""size AS (SELECT count(*) AS n, CAST(ceil(count(*) / {BLOCK}) AS BIGINT) AS nb FROM pair),
        num AS (SELECT *, row_number() OVER (ORDER BY query_id) - 1 AS idx FROM pair),
        tree AS (
          SELECT d.range AS draw, CAST(0 AS BIGINT) AS lo, nb AS hi, n AS cnt, n FROM range({DRAWS}) d, size
          UNION ALL
          SELECT draw, CASE WHEN side = 0 THEN lo ELSE mid END, CASE WHEN side = 0 THEN mid ELSE hi END,
                 CASE WHEN side = 0 THEN first ELSE cnt - first END, n
          FROM (SELECT *, {_FIRST} AS first FROM (
                  SELECT *, (least(mid * {BLOCK}, n) - lo * {BLOCK}) / (least(hi * {BLOCK}, n) - lo * {BLOCK}) AS share
                  FROM (SELECT *, (lo + hi) // 2 AS mid FROM tree WHERE hi - lo > 1))), (SELECT unnest([0, 1]) AS side)),
        slots AS (SELECT draw, lo AS block, unnest(range(cnt)) AS slot, least({BLOCK}, n - lo * {BLOCK}) AS rows_in FROM tree WHERE hi - lo = 1),
        picks AS (SELECT draw, block * {BLOCK} + {resampling.hashed_sql('draw', f'(slot + block * {4 * BLOCK})', protocol.SEED)} % rows_in AS idx FROM slots),
        sums AS (SELECT draw, avg(d) AS m FROM picks JOIN num USING (idx) GROUP BY 1),
        ci AS (SELECT list_sort(list(m)) AS ds, count_if(m > 0) / {DRAWS} AS p_b_better FROM sums)""",
        select=f"SELECT {_OBS}, {_CI} FROM obs CROSS JOIN ci",
    ),
)
def tree_bootstrap(spark, sf):
    return _rounded(resampling.paired_bootstrap(_pair(spark, sf), block=BLOCK))


K = 10


@register(
    "subsample",
    O.with_ctes(
        O.CHAT_QUERIES,
        LAST,
        overlap_ctes(1),
        f"""one AS (SELECT query_id, f AS score FROM sc WHERE system = 'b'),
        size AS (SELECT count(*) AS n FROM one),
        num AS (SELECT *, row_number() OVER (ORDER BY query_id) - 1 AS idx FROM one),
        places AS (SELECT d.range AS draw, p.range AS pos, n FROM range({DRAWS}) d, range({K}) p, size),
        {resampling.permuted_sql('places', protocol.SEED)},
        means AS (SELECT draw, avg(score) AS m FROM picks JOIN num USING (idx) GROUP BY 1),
        spread AS (SELECT list_sort(list(m)) AS ms, avg(m) AS draw_mean, min(m) AS lo, max(m) AS hi,
            {', '.join(f"avg(CASE WHEN m > {t} THEN 1.0 ELSE 0.0 END) AS above_{f'{t:.3f}'.replace('.', '_')}" for t in protocol.SUBSAMPLE_THRESHOLDS)} FROM means)""",
        select=f"""SELECT n, (SELECT round(avg(score), 6) FROM one) AS full_mean, round(draw_mean, 6) AS draw_mean,
          round(ms[{int(0.025 * DRAWS) + 1}], 6) AS low, round(ms[{int(0.975 * DRAWS) + 1}], 6) AS high,
          round(lo, 6) AS "min", round(hi, 6) AS "max",
          {', '.join('above_' + f'{t:.3f}'.replace('.', '_') for t in protocol.SUBSAMPLE_THRESHOLDS)} FROM spread, size""",
    ),
)
def subsample(spark, sf):
    out = resampling.subsample_distribution(_scores(spark, sf, "b"), K)
    round_these = ("full_mean", "draw_mean", "low", "high", "min", "max")
    return out.select(*[F.round(c, 6).alias(c) if c in round_these else F.col(c) for c in out.columns])


@register(
    "seeded_sample",
    O.with_ctes(
        O.CHAT_QUERIES,
        select=f"""SELECT query_id, CAST(row_number() OVER (ORDER BY query_id) - 1 AS INTEGER) AS place
        FROM (SELECT query_id FROM queries ORDER BY md5('{protocol.SEED}:' || query_id), query_id LIMIT {protocol.JUDGE_SAMPLE})""",
    ),
)
def seeded_sample(spark, sf):
    ids = V.chat_queries(spark, sf).select("query_id")
    return resampling.seeded_sample(ids, protocol.JUDGE_SAMPLE)
