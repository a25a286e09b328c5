"""Benchmark decontamination: windows of documents that are near copies of benchmark items.

A window has as many words as the item it is compared with; a document of fewer words is one window. An item of fewer words
than a shingle is one shingle, and so are the windows that it is compared with. A window's SimHash adds up the signs of its shingles'
hashes. Items are indexed by BLOCKS parts of their fingerprints: a fingerprint within RADIUS bits of an item's agrees
with it up to RADIUS // BLOCKS bits in one part, and each part's table lists the items within that many bits of
every value, so no fingerprint in the radius is missed. What is found is verified by the exact similarity of the
two multisets of shingles, sum of minima over sum of maxima.

A window that shares no shingle with an item has similarity 0, so fingerprints are made only of windows with a
benchmark shingle in them: all of those.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from convolens.llm import common as C

BITS, BLOCKS = 64, 8
#: Shingles that agree in eight of nine differ in 10 bits on average, with a deviation of 3.
RADIUS = 23
#: Letters of benchmark text that a task indexes at a time; more items are taken in several passes.
AT_ONCE = 16 << 20


def whole(prefix: C.Prefix, start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The one shingle of n words from each start; the length keeps it apart from others."""
    return C.mix(prefix.of(start, start + n) + n.astype(np.uint64))


def text_shingles(data: np.ndarray, offsets: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, C.Prefix]:
    """Hash of the shingle at each word, each text's first word, number of shingles, and hashes of all runs of words; a short
    text is one shingle."""
    starts, ends, first = C.word_spans(data, offsets)
    hashes = C.word_hashes(data, starts, ends, lower=True)
    prefix = C.Prefix(hashes, 31)
    n = np.diff(first)
    at = np.arange(len(hashes))
    out = prefix.of(at, np.minimum(at + words, len(hashes)))
    short = np.flatnonzero((n > 0) & (n < words))
    out[first[short]] = whole(prefix, first[short], n[short])
    return out, first, np.where(n >= words, n - words + 1, np.minimum(n, 1)), prefix


def signs(shingles: np.ndarray) -> np.ndarray:
    """+1 or -1 for each bit of each hash."""
    bits = np.unpackbits(shingles.view(np.uint8).reshape(-1, 8), axis=1)
    return bits.astype(np.int32) * 2 - 1


def packed(sums: np.ndarray) -> np.ndarray:
    return np.packbits(sums > 0, axis=-1)


def among(x: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which of x stand in `known`, which is in order and not empty."""
    return known[np.minimum(np.searchsorted(known, x), len(known) - 1)] == x


class Index:
    """Items by number of words; per number the fingerprints and, per part of them, the items near each value."""

    def __init__(self, ids: list[int], texts: list[str], words: int):
        self.words = words
        data, offsets = C.text_bytes(pa.array(texts, pa.string()))
        grams, first, n, _ = text_shingles(data, offsets, words)
        self.shingles = [np.sort(grams[f : f + k]) for f, k in zip(first, n)]
        self.ids = ids
        keep = [i for i in range(len(ids)) if n[i]]
        known = np.unique(np.concatenate([self.shingles[i] for i in keep])) if keep else np.zeros(0, np.uint64)
        self.known = known
        #: Most shingles of documents are none of these; their leading bits say so.
        self.maybe = np.zeros(1 << 20, bool)
        self.maybe[known >> np.uint64(44)] = True
        self.sizes: dict[int, list[int]] = defaultdict(list)
        #: Items of one shingle by number of words, each shingle's items.
        self.short: dict[int, dict[int, list[int]]] = defaultdict(lambda: defaultdict(list))
        for i in keep:
            size = int(first[i + 1] - first[i])
            if size < words:
                self.short[size][int(self.shingles[i][0])].append(i)
            else:
                self.sizes[size].append(i)
        bits = np.array([bin(x).count("1") for x in range(256)], np.uint8)
        near = bits[np.arange(256)[:, None] ^ np.arange(256)[None, :]] <= RADIUS // BLOCKS
        self.prints, self.tables, self.having = {}, {}, {}
        for size, items in self.sizes.items():
            own = np.array([packed(signs(self.shingles[i]).sum(axis=0)) for i in items])
            self.prints[size] = own
            # near[v][own part]: items whose part lies within the block's radius of v.
            self.tables[size] = [[np.flatnonzero(near[v][own[:, b]]) for v in range(256)] for b in range(BLOCKS)]
            self.having[size] = np.unique(np.concatenate([self.shingles[i] for i in items]))
        self.bits = bits

    def found(self, grams: np.ndarray, n_words: int, percent: int, prefix: C.Prefix, at: int) -> Iterator[tuple[int, int, int, float]]:
        """(item, first word, words, similarity) of the best window of one text for each item that it holds; the text
        begins at word `at` of `prefix`."""
        for size, items in self.short.items():
            if size <= n_words:
                own = whole(prefix, np.arange(at, at + n_words - size + 1), np.full(n_words - size + 1, size))
                wanted = np.sort(np.fromiter(items, np.uint64, len(items)))
                hits = np.flatnonzero(among(own, wanted))
                for gram, first in dict(zip(own[hits][::-1].tolist(), hits[::-1].tolist())).items():
                    for i in items[gram]:
                        yield self.ids[i], first, size, 1.0
        # A text of fewer words than a shingle shares none with a longer item.
        if n_words < self.words or not len(self.known):
            return
        hits = np.flatnonzero(self.maybe[grams >> np.uint64(44)])
        hits = hits[among(grams[hits], self.known)]
        if not len(hits):
            return
        sums = np.concatenate([np.zeros((1, BITS), np.int32), np.cumsum(signs(grams), axis=0)])
        for size, items in self.sizes.items():
            own = hits[among(grams[hits], self.having[size])]
            if not len(own):
                continue
            # All windows of this size with one of these shingles in them; a shorter text is one window.
            width = min(size, n_words) - self.words + 1
            theirs = size - self.words + 1
            last = len(grams) - width
            flags = np.zeros(len(grams) + 1, np.int32)
            np.add.at(flags, np.minimum(np.maximum(own - width + 1, 0), last), 1)
            np.add.at(flags, np.minimum(own, last) + 1, -1)
            starts = np.flatnonzero(np.cumsum(flags[: last + 1]) > 0)
            if 100 * width < percent * theirs or not len(starts):
                continue
            prints = packed(sums[starts + width] - sums[starts])
            best: dict[int, tuple[float, int]] = {}
            for first, fingerprint in zip(starts.tolist(), prints):
                near = np.unique(np.concatenate([self.tables[size][b][fingerprint[b]] for b in range(BLOCKS)]))
                near = near[self.bits[self.prints[size][near] ^ fingerprint].sum(axis=1) <= RADIUS]
                for k in near.tolist():
                    both = _shared(np.sort(grams[first : first + width]), self.shingles[items[k]])
                    if 100 * both >= percent * (width + theirs - both):
                        score = both / (width + theirs - both)
                        if score > best.get(k, (0.0, 0))[0]:
                            best[k] = (score, first)
            for k, (score, first) in sorted(best.items()):
                yield self.ids[items[k]], first, min(size, n_words), score


def _shared(a: np.ndarray, b: np.ndarray) -> int:
    """Sum of the minima of two multisets, both in order."""
    values, counts = np.unique(a, return_counts=True)
    other, their = np.unique(b, return_counts=True)
    at = np.searchsorted(other, values)
    at[at == len(other)] = 0
    same = other[at] == values
    return int(np.minimum(counts[same], their[at[same]]).sum())


def leaks(docs: DataFrame, benchmark: DataFrame, words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """id_col, item_col, first_word, n_words, similarity: documents with a window near an item, the best window of each.

    Words are lower-cased; similarity is at least percent / 100. A document or an item without words, or null, is
    near nothing; an item of fewer than `words` words is one shingle and stands in every document with the same run of
    words, a document of fewer words than an item is one window. Items that are equal are found alike. Equal
    rows get equal results; rows without an id are searched too. No documents or no items give no rows.

    The items go to the tasks in blocks of AT_ONCE letters, one pass over the documents for each: what a task
    holds does not grow with the benchmark.
    """
    spark = docs.sparkSession
    C.small_batches(docs)
    texts = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).cast("string").alias("text"))
    items = benchmark.select(F.col(item_col).cast("long").alias("item"), F.col(item_text).cast("string").alias("text")).filter("text IS NOT NULL")
    blocks = _blocks(items)
    schema = "doc long, item long, first_word long, n_words long, similarity double"
    out = spark.createDataFrame([], schema)
    for ids, parts in blocks:
        shared = spark.sparkContext.broadcast((ids, parts))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            index = None
            for batch in batches:
                index = index or Index(*shared.value, words)
                data, offsets = C.text_bytes(batch.column(1))
                doc = batch.column(0).to_pylist()
                rows = []
                for a, b in C.pieces(offsets, 4 * C.PIECE):
                    grams, first, n, prefix = text_shingles(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], words)
                    for i in range(b - a):
                        f, count = int(first[i]), int(n[i])
                        rows += [(doc[a + i], *row) for row in index.found(grams[f : f + count], int(first[i + 1]) - f, percent, prefix, f)]
                if rows:
                    columns = list(zip(*rows))
                    yield pa.RecordBatch.from_arrays([*[pa.array(c, pa.int64()) for c in columns[:4]], pa.array(columns[4], pa.float64())], names=["doc", "item", "first_word", "n_words", "similarity"])

        out = out.unionByName(texts.mapInArrow(run, schema))
    return out.withColumnsRenamed({"doc": id_col, "item": item_col})


def _blocks(items: DataFrame) -> Iterator[tuple[list[int], list[str]]]:
    ids, texts, size = [], [], 0
    for row in items.orderBy("item", "text").toLocalIterator():
        ids.append(row.item)
        texts.append(row.text)
        size += len(row.text)
        if size >= AT_ONCE:
            yield ids, texts
            ids, texts, size = [], [], 0
    if ids:
        yield ids, texts


def clean(docs: DataFrame, benchmark: DataFrame, words: int = 5, percent: int = 80, text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """The rows of `docs` that `leaks` does not find, with all columns."""
    items = benchmark.select(F.col(item_col).cast("long").alias("item"), F.col(item_text).cast("string").alias("text")).filter("text IS NOT NULL")
    for block in _blocks(items):
        shared = docs.sparkSession.sparkContext.broadcast(block)

        def start(shared=shared):
            index = Index(*shared.value, words)

            def flags(texts: pa.Array) -> np.ndarray:
                free = np.ones(len(texts), bool)
                data, offsets = C.text_bytes(texts)
                for a, b in C.pieces(offsets, 4 * C.PIECE):
                    grams, first, n, prefix = text_shingles(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], words)
                    for i in range(b - a):
                        f = int(first[i])
                        free[a + i] = next(index.found(grams[f : f + int(n[i])], int(first[i + 1]) - f, percent, prefix, f), None) is None
                return free

            return flags

        docs = C.kept_rows(docs, text_col, start)
    return docs
