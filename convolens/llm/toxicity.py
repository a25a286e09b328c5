"""Toxicity by a classifier chain: one linear model per category, each fed the probabilities of those before it.

Features are hashed words and word beginnings, present or not. In training, the earlier categories' probabilities
come from models that did not see the row (out of fold), as those of new documents will. The models are fitted on
a bounded sample of labelled rows; everything is then applied to all documents, a map over them.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from convolens.llm import common as C

DIM_BITS = 18
#: Bytes of the word beginnings that are features beside whole words.
BEGINNINGS = (4, 5, 6)
FOLDS = 5

_LETTER = np.zeros(256, bool)
_LETTER[128:] = True
_LETTER[[*range(ord("0"), ord("9") + 1), *range(ord("A"), ord("Z") + 1), *range(ord("a"), ord("z") + 1)]] = True


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text, feature) of all words of all texts, with repetitions. Letters are digits, A-Z and all beyond ASCII."""
    inside = _LETTER[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1] | edge[1 : len(data)]
    last[:-1] &= ~inside[1:] | edge[1 : len(data)]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    text = np.searchsorted(offsets, starts, side="right") - 1
    shift = np.uint64(64 - DIM_BITS)
    owners, found = [text], [C.word_hashes(data, starts, ends, lower=True) >> shift]
    for size in BEGINNINGS:
        long = ends - starts >= size
        owners.append(text[long])
        found.append(C.mix(C.word_hashes(data, starts[long], starts[long] + size, lower=True) + np.uint64(size)) >> shift)
    return np.concatenate(owners), np.concatenate(found).astype(np.int64)


@dataclass
class Linear:
    """Weights of chosen features, of the earlier categories' probabilities, and a constant."""

    weights: np.ndarray
    chain: np.ndarray
    bias: float

    def logit(self, rows: np.ndarray, found: np.ndarray, n: int, earlier: np.ndarray) -> np.ndarray:
        """Rows and features without repetitions; earlier: (n, categories before)."""
        return np.bincount(rows, self.weights[found], n) + earlier @ self.chain + self.bias


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def fit(rows: np.ndarray, found: np.ndarray, n: int, earlier: np.ndarray, label: np.ndarray, ridge: float = 0.02, steps: int = 100) -> Linear:
    """Ridge logistic regression by accelerated gradient steps, on features that tell the classes apart.

    A feature counts by one over the root of its number of rows, so rare telling words are learnt as fast as common
    ones. Without both classes, or without rows, the model is the constant that the labels are.
    """
    dim = 1 << DIM_BITS
    hits = float(label.sum())
    if not 0 < hits < n:
        return Linear(np.zeros(dim), np.zeros(earlier.shape[1]), 20.0 if n and hits else -20.0)
    with_it = np.bincount(found, label[rows], dim)
    all_ = np.bincount(found, minlength=dim).astype(float)
    rate = hits / n
    spread = np.sqrt(all_ * rate * (1 - rate) + 1e-9)
    chosen = (np.abs(with_it - all_ * rate) / spread > 4) & (all_ >= 3)
    index = np.cumsum(chosen) - 1
    use = chosen[found]
    r, f = rows[use], index[found[use]]
    k, m = int(chosen.sum()), earlier.shape[1]
    value = (1 / np.sqrt(all_[chosen]))[f]
    scale = np.concatenate([1 / np.sqrt(all_[chosen]), np.full(m + 1, 1 / np.sqrt(n))])
    w = np.zeros(k + m + 1)
    w[-1] = np.log(rate / (1 - rate)) / scale[-1]

    def losses(u: np.ndarray) -> tuple[float, np.ndarray]:
        z = np.bincount(r, u[f] * value, n) + (earlier @ u[k : k + m] + u[-1]) * scale[-1]
        p = sigmoid(z)
        error = p - label
        grad = np.concatenate([np.bincount(f, error[r] * value, k) if k else np.zeros(0), earlier.T @ error * scale[-1], [error.sum() * scale[-1]]])
        grad[:-1] += ridge * u[:-1]
        return -float(np.log(np.where(label > 0, p, 1 - p) + 1e-12).sum()) + ridge / 2 * float((u[:-1] ** 2).sum()), grad

    pace, momentum, look, before = 1.0, 1.0, w, w
    loss, grad = losses(w)
    for _ in range(steps):
        after = look - pace * grad
        following = (1 + np.sqrt(1 + 4 * momentum**2)) / 2
        ahead = after + (momentum - 1) / following * (after - before)
        loss_ahead, grad_ahead = losses(ahead)
        if loss_ahead > loss:
            if momentum == 1.0:
                pace /= 2
            momentum, before = 1.0, look
            continue
        look, before, momentum, loss, grad = ahead, after, following, loss_ahead, grad_ahead
        pace *= 1.05
    weights = np.zeros(dim)
    weights[chosen] = look[:k] * scale[:k]
    return Linear(weights, look[k : k + m] * scale[-1], float(look[-1] * scale[-1]))


def best_threshold(p: np.ndarray, label: np.ndarray) -> float:
    """The probability that parts the classes with the best F1, half-way to the next; one half without both classes."""
    order = np.argsort(-p, kind="stable")
    p, label = p[order], label[order]
    hits = np.cumsum(label)
    if not len(p) or not 0 < hits[-1] < len(p):
        return 0.5
    f1 = 2 * hits / (np.arange(1, len(p) + 1) + hits[-1])
    f1[:-1][p[:-1] == p[1:]] = 0
    k = int(np.argmax(f1))
    return float((p[k] + p[k + 1]) / 2) if k + 1 < len(p) else float(p[k])


def fit_chain(rows: np.ndarray, found: np.ndarray, folds: np.ndarray, labels: np.ndarray) -> tuple[list[Linear], np.ndarray]:
    """One model per column of `labels` (n, categories), and the rows' out-of-fold probabilities."""
    n, m = labels.shape
    outside = np.zeros((n, m))
    models = []
    for c in range(m):
        earlier = outside[:, :c]
        models.append(fit(rows, found, n, earlier, labels[:, c]))
        for fold in np.unique(folds):
            held = folds == fold
            seen = np.flatnonzero(~held)
            place = np.cumsum(~held) - 1
            use = ~held[rows]
            model = fit(place[rows[use]], found[use], len(seen), earlier[seen], labels[seen, c])
            outside[held, c] = sigmoid(model.logit(rows, found, n, earlier))[held]
    return models, outside


def per_text(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Pieces of a column: first text, texts, and (text, feature) without repetitions."""
    data, offsets = C.text_bytes(column)
    for a, b in C.pieces(offsets, 2 * C.PIECE):
        rows, found = features(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
        yield a, b - a, rows, found


def distinct(rows: np.ndarray, found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    both = np.unique(rows << DIM_BITS | found)
    return both >> DIM_BITS, both & ((1 << DIM_BITS) - 1)


def train(docs: DataFrame, labels: DataFrame, categories: Sequence[tuple[str, Column]], at_most: int = 6_000, id_col: str = "doc_id", text_col: str = "text") -> tuple[list[Linear], list[float]]:
    """Models of the categories, in order, and their thresholds, chosen out of fold. Each is a name and a 0/1 column over `labels`.

    Fitted on at most `at_most` labelled documents, chosen by a hash of their ids. Labels that are null, of an id
    that is null or has no document, count for nothing; of several labels for an id the largest counts.
    """
    C.small_batches(docs)
    picked = labels.select(F.col(id_col).cast("long").alias("doc"), *[c.cast("double").alias(f"c{i}") for i, (_, c) in enumerate(categories)]).dropna()
    picked = picked.groupBy("doc").agg(*[F.max(f"c{i}").alias(f"c{i}") for i in range(len(categories))])
    picked = picked.orderBy(F.xxhash64("doc"), "doc").limit(at_most)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, n, rows, found in per_text(batch.column(1)):
                rows, found = distinct(rows, found)
                ends = np.searchsorted(rows, np.arange(n + 1)).astype(np.int32)
                part = batch.slice(a, n)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(found.astype(np.int32))), *part.columns[2:]],
                    names=["doc", "found", *part.schema.names[2:]],
                )

    names = [f"c{i}" for i in range(len(categories))]
    chosen = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).cast("string").alias("text")).join(F.broadcast(picked), "doc").select("doc", "text", *names)
    table = chosen.mapInArrow(run, "doc long, found array<int>, " + ", ".join(f"{c} double" for c in names)).toArrow()
    lists = table.column("found").combine_chunks()
    lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
    sizes = np.diff(lists.offsets.to_numpy()) if len(table) else np.zeros(0, np.int64)
    found = lists.flatten().to_numpy().astype(np.int64) if len(table) else np.zeros(0, np.int64)
    rows = np.repeat(np.arange(len(table)), sizes)
    # A feature of fewer than three rows is never chosen.
    common = np.bincount(found, minlength=1 << DIM_BITS)[found] >= 3
    rows, found = rows[common], found[common]
    doc = table.column("doc").to_numpy().astype(np.int64)
    folds = C.mix(doc.astype(np.uint64)) % np.uint64(FOLDS)
    target = np.array([table.column(c).to_numpy() for c in names]).T.reshape(len(table), len(names))
    models, outside = fit_chain(rows, found, folds, target)
    return models, [best_threshold(outside[:, c], target[:, c]) for c in range(len(names))]


def probabilities(texts: pa.Array, chain: Sequence[Linear], used: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Pieces of a column: first text, and (texts, categories). `used`: features with a weight in any model."""
    for a, n, rows, found in per_text(texts):
        known = used[found]
        rows, found = distinct(rows[known], found[known])
        out = np.zeros((n, 0))
        for m in chain:
            out = np.column_stack([out, sigmoid(m.logit(rows, found, n, out))])
        yield a, out


def score(docs: DataFrame, models: Sequence[Linear], names: Sequence[str], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col and p_<name> for each category, for every row; a null text has no features."""
    spark = docs.sparkSession
    C.small_batches(docs)
    shared = spark.sparkContext.broadcast(list(models))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        C.forget()
        chain = shared.value
        used = np.any([m.weights != 0 for m in chain], axis=0)
        for batch in batches:
            for a, out in probabilities(batch.column(1), chain, used):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, len(out)), *[pa.array(x) for x in out.T]], names=["doc", *columns])

    columns = [f"p_{x}" for x in names]
    texts = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).cast("string").alias("text"))
    return texts.mapInArrow(run, "doc long, " + ", ".join(f"`{c}` double" for c in columns)).withColumnRenamed("doc", id_col)


def categories() -> list[tuple[str, Column]]:
    """The chain over the table of labels: low quality, then toxicity."""
    return [("low_quality", 1 - F.col("quality")), ("toxic", F.col("toxic"))]


def accepted(docs: DataFrame, labels: DataFrame, threshold: float | None = None, at_most: int = 6_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of `docs` that `judged` does not call toxic, with all columns."""
    models, thresholds = train(docs, labels, categories(), at_most, id_col, text_col)
    limit = thresholds[-1] if threshold is None else threshold
    shared = docs.sparkSession.sparkContext.broadcast(models)

    def start():
        chain = shared.value
        used = np.any([m.weights != 0 for m in chain], axis=0)
        return lambda texts: np.concatenate([np.zeros(0), *[p[:, -1] for _, p in probabilities(texts, chain, used)]]) < limit

    return C.kept_rows(docs, text_col, start)


def judged(docs: DataFrame, labels: DataFrame, threshold: float | None = None, at_most: int = 6_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, p_low_quality, p_toxic, toxic (p_toxic >= threshold), for every row of `docs`.

    The threshold is the one that tells held-out labelled rows apart best, unless given.
    An empty or null text is as toxic as the labels' rate alone says. Without labels nothing is toxic. Equal rows get
    equal results; rows may lack an id. An empty table gives none.
    """
    chain = categories()
    models, thresholds = train(docs, labels, chain, at_most, id_col, text_col)
    scores = score(docs, models, [n for n, _ in chain], id_col, text_col)
    return scores.withColumn("toxic", F.col("p_toxic") >= F.lit(thresholds[-1] if threshold is None else threshold))
