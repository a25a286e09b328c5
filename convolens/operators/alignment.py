"""Map predictions without ids to references: both keep their order, only references may be skipped.

Prediction i of a file lands on reference i + o, where the offset o never falls and never exceeds
the file's slack (references minus predictions). So only a band of slack + 1 similarities per
prediction matters. Long files are cut into blocks; a block is a (max, +) matrix over offsets, the
matrices of a file are chained, and every block is then resolved on its own. Blocks grow with the
square root of the longest file, so neither a block nor the chain holds more than that.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from convolens import protocol
from convolens.functions.rouge import ngram_overlap, tokenize, with_rouge
from convolens.session import keep

MIN_BLOCK = 2048
PRED_BLOCK = 2_000
REF_BLOCK = 20_000
#: Files of one block go to Python together, about this many rows at a time, over this many groups at least.
GROUP_ROWS = 4_096
GROUPS = 64


class AlignmentRefused(ValueError):
    """An alignment whose controls failed."""


@F.pandas_udf(DoubleType())
def overlap_f1(a: pd.Series, b: pd.Series) -> pd.Series:
    """Multiset F of unstemmed tokens."""
    return pd.Series([ngram_overlap(tokenize(y or "", False), tokenize(x or "", False), 1)[2] for x, y in zip(a, b)])


def group_count(rows: DataFrame) -> int:
    """Groups of files of about GROUP_ROWS rows; a Python call for each file would cost more than its work."""
    return max(GROUPS, -(-rows.count() // GROUP_ROWS))


def group_of(file_id: str, groups: int) -> Column:
    return F.pmod(F.xxhash64(file_id), F.lit(groups))


def _dealt(rows: DataFrame, groups: int, *keys: str) -> DataFrame:
    """By key over all shuffle partitions: the optimizer goes by bytes, which are few here."""
    most = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(max(1, min(groups, most)), *keys)


def file_sizes(predictions: DataFrame, references: DataFrame) -> DataFrame:
    """`file_id, n_pred, n_ref, slack`; more predictions than references fail the query."""
    p = predictions.groupBy("file_id").agg(F.count(F.lit(1)).alias("n_pred"))
    r = references.groupBy("file_id").agg(F.count(F.lit(1)).alias("n_ref"))
    slack = F.col("n_ref") - F.col("n_pred")
    fail = F.raise_error(F.concat(F.lit("more predictions than references in "), F.col("file_id"))).cast("bigint")
    return p.join(r, "file_id").withColumn("slack", F.when(slack < 0, fail).otherwise(slack))


def band(predictions: DataFrame, references: DataFrame) -> DataFrame:
    """Similarities `file_id, i, o, sim` of every prediction with the references it may land on."""
    sizes = file_sizes(predictions, references)
    may = predictions.join(sizes, "file_id").select(
        "file_id", "i", F.col("text").alias("pt"), "slack", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("slack"))).alias("o")
    )
    refs = references.select("file_id", F.col("j").alias("j"), F.col("text").alias("rt"))
    return (
        may.withColumn("j", F.col("i") + F.col("o"))
        .join(refs, ["file_id", "j"])
        .select("file_id", "i", F.col("o").cast("int").alias("o"), F.col("slack").cast("int").alias("slack"), overlap_f1("pt", "rt").alias("sim"))
    )


def rigid_offset(band_rows: DataFrame) -> DataFrame:
    """The best mean similarity of a fixed shift, never below 0: what the alignment has to beat."""
    by_shift = band_rows.groupBy("file_id", "o").agg(F.avg("sim").alias("m"))
    return by_shift.groupBy("file_id").agg(F.greatest(F.max("m"), F.lit(0.0)).alias("rigid"))


# --- the offsets ------------------------------------------------------------------------------


def _square(rows: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Sorted prediction numbers and their similarity by offset."""
    rows = rows.sort_values(["i", "o"])
    width = int(rows["slack"].iloc[0]) + 1
    return rows["i"].to_numpy()[::width], rows["sim"].to_numpy().reshape(-1, width)


def _forward(sims: np.ndarray, reach: np.ndarray) -> np.ndarray:
    """Best total with the last prediction at exactly each offset, for every prediction.

    `reach[o]` is the best total before the block with an offset of at most o.
    """
    out = np.empty_like(sims)
    for k, row in enumerate(sims):
        out[k] = reach + row
        reach = np.maximum.accumulate(out[k])
    return out


def _backward(exact: np.ndarray, bound: int) -> tuple[np.ndarray, int]:
    """Offsets from the end: of equally good ones the largest, then that bounds the one before."""
    out = np.empty(len(exact), dtype=np.int64)
    for k in range(len(exact) - 1, -1, -1):
        row = exact[k, : bound + 1]
        bound = bound - int(np.argmax(row[::-1]))
        out[k] = bound
    return out, bound


def align(band_rows: DataFrame, longest: int | None = None, min_block: int = MIN_BLOCK) -> DataFrame:
    """`file_id, i, j`: the order-preserving mapping of the highest total similarity."""
    band_rows = keep(band_rows)
    if longest is None:
        longest = (band_rows.agg(F.max("i")).first()[0] or 0) + 1
    block = max(min_block, math.isqrt(longest))
    result = "file_id string, i bigint, j bigint"

    def solve(rows: pd.DataFrame) -> pd.DataFrame:
        out = []
        for file_id, file in rows.groupby("file_id", dropna=False, sort=False):
            i, sims = _square(file)
            exact = _forward(sims, np.zeros(sims.shape[1]))
            offsets, _ = _backward(exact, sims.shape[1] - 1)
            out.append((file_id, i, i + offsets))
        return pd.DataFrame({"file_id": np.repeat(np.array([x[0] for x in out], object), [len(x[1]) for x in out]),
                             "i": np.concatenate([x[1] for x in out]), "j": np.concatenate([x[2] for x in out])})

    if longest <= block:
        groups = group_count(band_rows)
        return _dealt(band_rows.withColumn("g", group_of("file_id", groups)), groups, "g").groupBy("g").applyInPandas(solve, result)

    rows = band_rows.withColumn("blk", F.floor(F.col("i") / block))

    def matrix(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        _, sims = _square(part)
        n = sims.shape[1]
        cells = []
        for start in range(n):
            reach = np.where(np.arange(n) >= start, 0.0, -np.inf)
            cells.append(np.maximum.accumulate(_forward(sims, reach)[-1]))
        return pd.DataFrame({"file_id": [key[0]], "blk": [key[1]], "m": [np.concatenate(cells).tolist()]})

    matrices = rows.groupBy("file_id", "blk").applyInPandas(matrix, "file_id string, blk bigint, m array<double>")

    def chain(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("blk")
        n = math.isqrt(len(part["m"].iloc[0]))
        reach, seen = np.zeros(n), []
        for m in part["m"]:
            seen.append(reach.tolist())
            m = np.asarray(m).reshape(n, n)
            # Entering at offset a costs nothing more than having reached a at most.
            reach = np.max(reach[:, None] + m, axis=0)
        return pd.DataFrame({"file_id": part["file_id"], "blk": part["blk"], "reach": seen})

    reached = matrices.groupBy("file_id").applyInPandas(chain, "file_id string, blk bigint, reach array<double>")
    ready = rows.join(reached, ["file_id", "blk"])

    def bounds(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        _, sims = _square(part)
        exact = _forward(sims, np.asarray(part["reach"].iloc[0]))
        to = [int(_backward(exact, b)[1]) for b in range(sims.shape[1])]
        return pd.DataFrame({"file_id": [key[0]], "blk": [key[1]], "left": [to]})

    maps = ready.groupBy("file_id", "blk").applyInPandas(bounds, "file_id string, blk bigint, left array<int>")

    def back(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("blk", ascending=False)
        bound, seen = len(part["left"].iloc[0]) - 1, []
        for left in part["left"]:
            seen.append(bound)
            bound = int(left[bound])
        return pd.DataFrame({"file_id": part["file_id"], "blk": part["blk"], "bound": seen})

    entry = maps.groupBy("file_id").applyInPandas(back, "file_id string, blk bigint, bound int")

    def resolve(part: pd.DataFrame) -> pd.DataFrame:
        i, sims = _square(part)
        exact = _forward(sims, np.asarray(part["reach"].iloc[0]))
        offsets, _ = _backward(exact, int(part["bound"].iloc[0]))
        return pd.DataFrame({"file_id": part["file_id"].iloc[0], "i": i, "j": i + offsets})

    return ready.join(entry, ["file_id", "blk"]).groupBy("file_id", "blk").applyInPandas(resolve, result)


# --- controls ---------------------------------------------------------------------------------


_STATS = ["file_id", "i", "beaten", "ahead", "total", "others"]


def _group_stats(preds: pd.DataFrame, refs: pd.DataFrame) -> pd.DataFrame:
    """`_block_stats` of each file of a group."""
    if preds.empty or refs.empty:
        return pd.DataFrame({c: [] for c in _STATS})
    places = refs.groupby("r_file", sort=False).indices
    out = []
    for file_id, own in preds.groupby("file_id", sort=False):
        if file_id in places:
            out += _block_stats(own, refs.iloc[places[file_id]])
    return pd.DataFrame(out, columns=_STATS)


def _block_stats(preds: pd.DataFrame, refs: pd.DataFrame) -> list[tuple]:
    """For every prediction of a block, what one block of references adds to its figures."""
    js = refs["r_j"].to_numpy()
    sizes = np.zeros(len(js))
    postings: dict[str, tuple[list, list]] = {}
    for k, text in enumerate(refs["r_text"]):
        counts = Counter(tokenize(text or "", False))
        sizes[k] = sum(counts.values())
        for t, c in counts.items():
            at, n = postings.setdefault(t, ([], []))
            at.append(k)
            n.append(c)
    index = {t: (np.array(at), np.array(n)) for t, (at, n) in postings.items()}
    out = []
    for file_id, i, j, text, target in preds[["file_id", "i", "j", "text", "sim"]].itertuples(index=False):
        mine = Counter(tokenize(text or "", False))
        size = sum(mine.values())
        shared = np.zeros(len(js))
        for t, c in mine.items():
            if t in index:
                at, n = index[t]
                shared[at] += np.minimum(n, c)
        with np.errstate(divide="ignore", invalid="ignore"):
            p, r = shared / size if size else shared, shared / sizes
            sim = np.where(shared > 0, 2 * p * r / (p + r), 0.0)
        other = js != j
        before = other & ((sim > target) | ((sim == target) & (js < j)))
        out.append((file_id, i, int((other & (sim < target)).sum()), int(before.sum()), float(sim[other].sum()), int(other.sum())))
    return out


def rank_statistics(predictions: DataFrame, references: DataFrame, mapping: DataFrame, band_rows: DataFrame) -> DataFrame:
    """Per prediction: how many other references it beats, how many come before it, and their mean.

    Blocks of predictions meet blocks of references and send on four numbers per prediction, never
    a pair. A file of ordinary length is one such meeting, and many of them go to Python together.
    """
    # Files of one block are in groups, numbered from 0; each longer one is on its own, below 0.
    groups = group_count(references)
    small = (F.col("n_ref") <= min(GROUP_ROWS, REF_BLOCK)) & (F.col("n_pred") <= PRED_BLOCK)
    group = lambda c: F.when(small, group_of(c, groups)).otherwise(F.lit(-1)).alias
    alone = lambda c: F.when(small, "").otherwise(F.col(c)).alias
    sims = band_rows.select("file_id", "i", (F.col("i") + F.col("o")).alias("j"), "sim")
    sizes = file_sizes(predictions, references)
    left = (
        predictions.join(mapping.join(sims, ["file_id", "i", "j"]), ["file_id", "i"])
        .join(sizes, "file_id")
        .select(
            "file_id",
            "i",
            "j",
            "text",
            "sim",
            group("file_id")("g"),
            alone("file_id")("long_file"),
            F.floor(F.col("i") / PRED_BLOCK).alias("pb"),
            F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("n_ref") - 1) / REF_BLOCK))).alias("rb"),
        )
    )
    # New names keep the two sides of the cogroup apart where both stem from one table.
    right = references.join(sizes, "file_id").select(
        F.col("file_id").alias("r_file"),
        group("file_id")("r_g"),
        alone("file_id")("r_long"),
        F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("n_pred") - 1) / PRED_BLOCK))).alias("r_pb"),
        F.floor(F.col("j") / REF_BLOCK).alias("r_rb"),
        F.col("j").alias("r_j"),
        F.col("text").alias("r_text"),
    )
    parts = (
        _dealt(left, groups, "g", "long_file", "pb", "rb")
        .groupBy("g", "long_file", "pb", "rb")
        .cogroup(_dealt(right, groups, "r_g", "r_long", "r_pb", "r_rb").groupBy("r_g", "r_long", "r_pb", "r_rb"))
        .applyInPandas(_group_stats, "file_id string, i bigint, beaten bigint, ahead bigint, total double, others bigint")
    )
    return parts.groupBy("file_id", "i").agg(*[F.sum(c).alias(c) for c in ("beaten", "ahead", "total", "others")])


def verify(predictions: DataFrame, references: DataFrame, mapping: DataFrame, band_rows: DataFrame) -> DataFrame:
    """Every control of an alignment, reported pass or fail; one row per file."""
    # The mapping is read three times, and making it goes through Python.
    mapping = keep(mapping)
    sims = band_rows.select("file_id", "i", (F.col("i") + F.col("o")).alias("j"), "sim")
    matched = mapping.join(sims, ["file_id", "i", "j"])
    ranks = rank_statistics(predictions, references, mapping, band_rows)
    # The neighbour is looked up by number: a window over a whole file would sort it in one task.
    after = mapping.select("file_id", (F.col("i") - 1).alias("i"), F.col("j").alias("nj"))
    falls = mapping.join(after, ["file_id", "i"]).groupBy("file_id").agg(
        F.count_if(F.col("nj") <= F.col("j")).alias("falls")
    )
    per_file = (
        matched.groupBy("file_id")
        .agg(F.avg("sim").alias("mean_matched_similarity"))
        .join(
            ranks.groupBy("file_id").agg(
                F.avg(F.when(F.col("others") > 0, F.col("beaten") / F.col("others")).otherwise(1.0)).alias(
                    "mean_matched_percentile"
                ),
                (F.sum("total") / F.sum("others")).alias("mean_unmatched_similarity"),
                F.avg((F.col("ahead") == 0).cast("double")).alias("top1_recovery"),
            ),
            "file_id",
        )
        .join(rigid_offset(band_rows), "file_id")
        .join(file_sizes(predictions, references), "file_id")
        .join(falls, "file_id", "left")
    )
    r4 = lambda c: F.round(c, 4)
    margin = F.when((F.col("slack") > 0) & (F.col("rigid") > 0), r4(F.col("mean_matched_similarity") / F.col("rigid")))
    out = per_file.select(
        "file_id",
        F.col("n_pred").alias("n_predictions"),
        F.col("n_ref").alias("n_references"),
        "slack",
        r4(F.col("mean_matched_similarity")).alias("mean_matched_similarity"),
        r4(F.col("mean_matched_percentile")).alias("mean_matched_percentile"),
        r4(F.coalesce("mean_unmatched_similarity", F.lit(0.0))).alias("mean_unmatched_similarity"),
        r4(F.col("top1_recovery")).alias("top1_recovery"),
        F.round(F.col("top1_recovery") * F.col("n_ref"), 2).alias("top1_lift_over_chance"),
        r4(F.col("rigid")).alias("best_rigid_offset_similarity"),
        margin.alias("margin_over_rigid"),
        (F.coalesce("falls", F.lit(0)) == 0).alias("monotone"),
    )
    passed = (
        (F.col("mean_matched_similarity") >= protocol.MIN_MEAN_SIM)
        & (F.col("mean_matched_percentile") >= protocol.MIN_MEAN_PERCENTILE)
        & (F.col("top1_lift_over_chance") >= protocol.MIN_TOP1_LIFT)
        & F.col("monotone")
        & ((F.col("slack") == 0) | (F.coalesce("margin_over_rigid", F.lit(0.0)) >= protocol.MIN_MARGIN))
    )
    return out.withColumn("passed", passed)


def reproduction_check(aligned: DataFrame, expected_rouge1: float, stemmed: bool = True) -> DataFrame:
    """Our ROUGE-1 of the aligned pairs (`prediction, reference`) against the authors' own figure."""
    ours = with_rouge(aligned, ["rouge1"], stemmed).agg((F.avg("rouge1.f") * 100).alias("our_rouge1"))
    delta = F.col("our_rouge1") - F.lit(float(expected_rouge1))
    return ours.select(
        F.lit(float(expected_rouge1)).alias("author_rouge1"),
        "our_rouge1",
        delta.alias("delta"),
        (F.abs(delta) <= protocol.ROUGE1_TOLERANCE).alias("passed"),
    )


def build_alignment(
    predictions: DataFrame,
    references: DataFrame,
    expected_rouge1: float | None = None,
    force: bool = False,
    stemmed: bool = True,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Aligned rows, skipped reference ids and the report of one file.

    `references` also carries `query_id`. A published score decides when there is one, the
    similarity controls otherwise; a file that fails is withheld unless forced.
    """
    rows = keep(band(predictions, references))
    mapping = keep(align(rows))
    aligned = (
        mapping.join(predictions.select("file_id", "i", F.col("text").alias("prediction")), ["file_id", "i"])
        .join(references.select("file_id", "j", "query_id", F.col("text").alias("reference")), ["file_id", "j"])
    )
    skipped = references.join(mapping.select("file_id", "j"), ["file_id", "j"], "left_anti").select("file_id", "query_id")
    controls = verify(predictions, references, mapping, rows)
    if expected_rouge1 is not None:
        check = reproduction_check(aligned.select("prediction", "reference"), expected_rouge1, stemmed)
        report = controls.drop("passed").crossJoin(check).withColumn("gate", F.lit("author_score_reproduction"))
    else:
        report = controls.withColumn("gate", F.lit("similarity_heuristics"))
    if not force and not report.first()["passed"]:
        raise AlignmentRefused("the alignment's controls failed; nothing is returned unless forced")
    return aligned.select("query_id", "prediction"), skipped, report
