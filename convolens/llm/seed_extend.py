"""Substring dedup by seed and extend, over words.

Seeds are winnowed word grams; documents meet where they share one. Of an anchor's contexts the one in the
smallest document leads, and every other is extended against it word by word, to the left and to the right. A
match that leaves room for a whole window is a maximal repeat over the threshold. Windows that the leader does
not explain meet those of the other contexts directly, so a repeat between two later documents is found too.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from convolens.llm import common as C
from convolens.llm import repeats as R


def extend(s: R.Strings, kind: R.Kind) -> np.ndarray:
    """Flags of the windows that also stand in a smaller document, for whole anchors sorted by document."""
    n = len(s.anchor)
    new = np.concatenate([[True], s.anchor[1:] != s.anchor[:-1]])
    leader = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    seed, lead_seed = s.offsets[:-1] + s.lead, (s.offsets[:-1] + s.lead)[leader]
    # Words that agree to the left of the anchor, and from the anchor on to the right.
    left = np.zeros(n, np.int64)
    room = np.minimum(s.lead, s.lead[leader])
    alive = np.arange(n)
    for step in range(1, int(room.max(initial=0)) + 1):
        alive = alive[room[alive] >= step]
        alive = alive[s.symbols[seed[alive] - step] == s.symbols[lead_seed[alive] - step]]
        left[alive] = step
    right = np.zeros(n, np.int64)
    room = np.minimum(s.offsets[1:] - seed, s.offsets[1:][leader] - lead_seed)
    alive = np.arange(n)
    for step in range(int(room.max(initial=0))):
        alive = alive[room[alive] > step]
        alive = alive[s.symbols[seed[alive] + step] == s.symbols[lead_seed[alive] + step]]
        right[alive] = step + 1
    owner = np.repeat(np.arange(n), s.windows)
    start = np.arange(len(owner)) - np.repeat(np.cumsum(s.windows) - s.windows, s.windows)
    ahead = s.lead[owner] - start
    with_leader = (ahead <= left[owner]) & (kind.length - ahead <= right[owner])
    flags = with_leader & (s.doc[owner] > s.doc[leader][owner])
    # The rest: windows of neither the leader nor its matches, where an anchor has at least two more contexts.
    size = np.bincount(np.cumsum(new) - 1)[np.cumsum(new) - 1]
    rest = np.flatnonzero(~with_leader & (size > 2)[owner])
    if len(rest):
        h1, h2 = R.window_hashes(s.symbols, s.offsets[:-1], s.windows, kind)
        order = rest[np.lexsort((s.doc[owner[rest]], h2[rest], h1[rest]))]
        fresh = np.concatenate([[True], (h1[order][1:] != h1[order][:-1]) | (h2[order][1:] != h2[order][:-1])])
        first = np.maximum.accumulate(np.where(fresh, np.arange(len(order)), 0))
        docs = s.doc[owner[order]]
        flags[order] = docs > docs[first]
    return flags


def dedup(docs: DataFrame, length: int = 50, gram: int = 10, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Take out each word covered by a window of `length` words that also starts in a document with a smaller id.

    Returns per row of `docs`: id_col, n_words, n_removed, kept (the other words, joined by one space) and spans
    (removed ranges of words, in order). A null text has no words. A document without an id comes after all
    others, and documents without one do not thin each other. Rows that share an id are one document, which does
    not thin itself; equal rows get equal results. An empty table gives an empty result.
    """
    out = _cut(_repeats(R.keyed(docs, id_col, text_col), length, gram))
    return out.select(R.own_id(id_col), *[c for c in out.columns if c != "doc"])


def thinned(docs: DataFrame, length: int = 50, gram: int = 10, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`docs` with the words of `dedup` taken out of the texts; a text that loses none, or is null, stays as it is."""
    joined = _repeats(R.keyed(docs, id_col, text_col, carry=True), length, gram)
    schema = joined.schema["row"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, lists = batch.column(0), batch.column(1)
            out = [None if words is None else b" ".join(words).decode() for _, _, words in _kept(texts, lists)]
            new = [texts[i].as_py() if x is None else x for i, x in enumerate(out)]
            yield pa.RecordBatch.from_arrays([pa.array(new, pa.string()), batch.column(2)], names=["text", "row"])

    done = joined.select("text", "cuts", "row").mapInArrow(run, StructType([StructField("text", StringType()), StructField("row", schema)]))
    return done.select(*[(F.col("text") if c == text_col else F.col("row")[c]).alias(c) for c in docs.columns])


def _repeats(texts: DataFrame, length: int, gram: int) -> DataFrame:
    """The texts with the ranges of words to take out, as `cuts`."""
    kind = R.Kind(True, C.positive("length", length), min(gram, length))
    found = C.staged(R.seeds(texts, kind), "seeds")
    occ = C.staged(R.occurrences(found, F.col("first_doc") < F.col("last_doc")), "repeats")
    C.discard(found)
    ctx = C.staged(R.contexts(occ), "contexts")
    crowded = F.col("crowd") > kind.crowd
    few = R.by_anchor(R.contents(texts, ctx.filter(~crowded), kind), kind, lambda s: extend(s, kind))
    many = R.by_window(R.contents(texts, ctx.filter(crowded), kind), kind, F.col("first_doc") < F.col("doc"))
    cuts = R.marks(occ, ctx, few.unionByName(many), F.col("doc") > F.col("first_doc"), True, kind)
    return texts.join(cuts, ["doc", "twin"], "left")


def _kept(texts: pa.Array, lists: pa.ListArray) -> Iterator[tuple[list[bytes], tuple[np.ndarray, np.ndarray], list[bytes] | None]]:
    """Each text's words, the ranges to take out, and the other words; None where there are no ranges."""
    for i in range(len(texts)):
        words = (texts[i].as_py() or "").encode().split()
        start, end = R.merged(lists, i)
        left, at = [], 0
        for a, b in zip(start.tolist(), end.tolist()):
            left += words[at:a]
            at = b
        yield words, (start, end), left + words[at:] if len(start) else None


def _cut(joined: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts, lists = batch.column(0), batch.column(1), batch.column(2)
            n_words, n_removed, kept, spans = [], [], [], []
            size = 0
            first = 0
            for i, (words, (start, end), left) in enumerate(_kept(texts, lists)):
                left = words if left is None else left
                n_words.append(len(words))
                n_removed.append(len(words) - len(left))
                kept.append(b" ".join(left))
                spans.append([{"start": int(a), "end": int(b)} for a, b in zip(start, end)])
                size += len(kept[-1])
                if size > 16 * C.PIECE or i == len(batch) - 1:
                    yield pa.RecordBatch.from_arrays(
                        [
                            ids.slice(first, i + 1 - first), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string()),
                            pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
                        ],
                        names=["doc", "n_words", "n_removed", "kept", "spans"],
                    )
                    n_words, n_removed, kept, spans, size, first = [], [], [], [], 0, i + 1

    return joined.select("doc", "text", "cuts").mapInArrow(
        run, "doc long, n_words long, n_removed long, kept string, spans array<struct<start: bigint, end: bigint>>"
    )
