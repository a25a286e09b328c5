"""Repeated windows of a collection, without pairs: the steps that both substring operators share.

1. Each text becomes runs of windows around winnowed anchors (`anchors.py`), a few dozen symbols each.
2. Anchors that occur once are dropped: their windows occur once.
3. Runs of one anchor with the same symbols are one context. Where an anchor has one context, all of its
   runs are repeats of each other and nothing is left to compare.
4. For the other anchors one run of each context fetches its symbols from its text, and a resolver says which
   of its windows repeat. Anchors with more contexts than a task should hold are resolved window by window.
5. The decisions go back to all runs, and their ranges to the texts.

Nothing is gathered by anchor before equal runs are one row, so a passage that stands in every third document
costs no more than any other. Step 1's rows are written to the shared folder once; the texts are shuffled
once, for steps 4 and 5 together.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from convolens.llm import anchors as A
from convolens.llm import common as C

#: A document without an id comes after all others.
LAST = (1 << 63) - 1


@dataclass(frozen=True)
class Kind:
    """What a window is made of."""

    words: bool
    length: int
    gram: int
    #: Anchors with more contexts than this are resolved window by window.
    crowd: int = 4096

    def symbols(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not self.words:
            return data, offsets
        starts, ends, first = C.word_spans(data, offsets)
        return C.word_hashes(data, starts, ends), first

    def hashed(self, symbols: np.ndarray) -> np.ndarray:
        return symbols if self.words else C.BYTE[symbols]

    @property
    def dtype(self):
        return np.uint64 if self.words else np.uint8


def keyed(docs: DataFrame, id_col: str, text_col: str, carry: bool = False) -> DataFrame:
    """doc, twin, text: rows of one id with different texts have different twins; equal rows share both.

    With `carry` there is also row, a structure of all columns but the text.

    `doc` is LAST where there is no id; `own_id` undoes that.
    """
    C.small_batches(docs)
    return docs.select(
        F.coalesce(F.col(id_col).cast("long"), F.lit(LAST)).alias("doc"),
        F.hash(F.col(text_col)).alias("twin"),
        F.col(text_col).cast("string").alias("text"),
        *[F.struct(*[F.col(c) for c in docs.columns if c != text_col]).alias("row")] * carry,
    )


def own_id(name: str) -> Column:
    return F.when(F.col("doc") != LAST, F.col("doc")).alias(name)


def seeds(texts: DataFrame, kind: Kind) -> DataFrame:
    """One row per run: doc, twin, pos, windows, lead, anchor, context."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        C.forget()
        for batch in batches:
            data, offsets = C.text_bytes(batch.column(2))
            doc, twin = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for a, b in C.pieces(offsets, 4 * C.PIECE):
                symbols, bounds = kind.symbols(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                for lo, hi, at, first, before in A.chunked(bounds, kind.length, C.PIECE):
                    r = A.runs(kind.hashed(symbols[lo:hi]), at, kind.length, kind.gram)
                    if len(r.pos):
                        owner = a + first + r.text
                        yield pa.RecordBatch.from_arrays(
                            [
                                pa.array(doc[owner]), pa.array(twin[owner]), pa.array((r.pos + before).astype(np.int64)),
                                pa.array(r.windows.astype(np.int32)), pa.array(r.lead.astype(np.int32)),
                                pa.array(C.signed(r.anchor)), pa.array(C.signed(r.context)),
                            ],
                            names=["doc", "twin", "pos", "windows", "lead", "anchor", "context"],
                        )

    return texts.select("doc", "twin", "text").mapInArrow(
        run, "doc long, twin int, pos long, windows int, lead int, anchor long, context long"
    )


def occurrences(found: DataFrame, repeated: Column) -> DataFrame:
    """Runs whose anchor repeats. `repeated` is over runs, first_doc, last_doc of an anchor."""
    groups = (
        found.groupBy("anchor")
        .agg(
            F.count("*").alias("runs"), F.min("doc").alias("first_doc"), F.max("doc").alias("last_doc"),
            F.min("context").alias("least"), F.max("context").alias("most"),
        )
        .filter(repeated)
        .select("anchor", "first_doc", (F.col("least") == F.col("most")).alias("single"))
    )
    # Written first, so that the join deals out both sides anew and a hot anchor's runs can be split.
    return found.join(C.staged(groups, "anchors"), "anchor")


def contexts(occ: DataFrame) -> DataFrame:
    """One row per context of an anchor with several: the first run of it, how many there are, how crowded the anchor is."""
    each = (
        occ.filter(~F.col("single"))
        .groupBy("anchor", "context", "windows", "lead")
        .agg(F.min(F.struct("doc", "pos", "twin")).alias("at"), F.count("*").alias("runs"))
    )
    crowd = each.groupBy("anchor").agg(F.count("*").alias("crowd"))
    return each.join(crowd, "anchor").select("anchor", "context", "windows", "lead", "runs", "crowd", "at.doc", "at.pos", "at.twin")


def contents(texts: DataFrame, ctx: DataFrame, kind: Kind) -> DataFrame:
    """Contexts with their symbols."""
    wanted = ctx.groupBy("doc", "twin").agg(
        F.collect_list(F.struct("anchor", "context", "windows", "lead", "runs", "crowd", "pos")).alias("wanted")
    )
    joined = texts.select("doc", "twin", "text").join(wanted, ["doc", "twin"]).select("doc", "text", "wanted")
    names = ["anchor", "context", "windows", "lead", "runs", "crowd"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        C.forget()
        for batch in batches:
            data, offsets = C.text_bytes(batch.column(1))
            lists = batch.column(2)
            doc = batch.column(0).to_numpy()
            bounds = lists.offsets.to_numpy()
            for a, b in C.pieces(offsets, 4 * C.PIECE):
                symbols, first = kind.symbols(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                rows = lists.values.slice(int(bounds[a]), int(bounds[b] - bounds[a]))
                owner = np.repeat(np.arange(a, b), np.diff(bounds[a : b + 1]))
                begin = first[owner - a] + rows.field("pos").to_numpy()
                size = rows.field("windows").to_numpy().astype(np.int64) + kind.length - 1
                ends = np.cumsum(size)
                cut = symbols[np.repeat(begin - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)]
                width = np.dtype(kind.dtype).itemsize
                where = np.concatenate([[0], ends * width]).astype(np.int32)
                content = pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(where), pa.py_buffer(np.ascontiguousarray(cut))])
                yield pa.RecordBatch.from_arrays([*[rows.field(n) for n in names], pa.array(doc[owner]), content], names=[*names, "doc", "content"])

    return joined.mapInArrow(
        run, "anchor long, context long, windows int, lead int, runs long, crowd long, doc long, content binary"
    )


@dataclass
class Strings:
    """Contexts of whole anchors, one behind another."""

    anchor: np.ndarray
    context: np.ndarray
    windows: np.ndarray
    lead: np.ndarray
    runs: np.ndarray
    doc: np.ndarray
    symbols: np.ndarray
    offsets: np.ndarray

    @classmethod
    def of(cls, table: pa.Table, dtype) -> Strings:
        content = table.column("content").combine_chunks()
        content = content.chunk(0) if isinstance(content, pa.ChunkedArray) else content
        bounds = np.frombuffer(content.buffers()[1], np.int32, len(content) + 1, content.offset * 4).astype(np.int64)
        symbols = np.frombuffer(content.buffers()[2], np.uint8)[bounds[0] : bounds[-1]].view(dtype)
        col = lambda n: table.column(n).to_numpy()
        return cls(*[col(n) for n in ("anchor", "context", "windows", "lead", "runs", "doc")], symbols, (bounds - bounds[0]) // np.dtype(dtype).itemsize)


def ranges_batch(s: Strings, repeated: np.ndarray) -> pa.RecordBatch:
    """Decisions from a flag per window (all strings' windows behind one another): one row for each string with any, its flags as ranges."""
    owner = np.repeat(np.arange(len(s.windows)), s.windows)
    at = np.flatnonzero(repeated)
    owner = owner[at]
    return folded(s.anchor, s.context, owner, at - (np.cumsum(s.windows) - s.windows)[owner])


def folded(anchor: np.ndarray, context: np.ndarray, owner: np.ndarray, window: np.ndarray) -> pa.RecordBatch:
    """One row per owner of windows (both ascending), neighbouring windows as one range."""
    new = np.ones(len(owner), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (window[1:] != window[:-1] + 1)
    start = np.flatnonzero(new)
    last = window[np.concatenate([start[1:], [len(owner)]]) - 1] + 1 if len(start) else window
    which, counts = np.unique(owner[start], return_counts=True)
    ranges = pa.StructArray.from_arrays([pa.array(window[start].astype(np.int32)), pa.array(last.astype(np.int32))], names=["first", "last"])
    lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), ranges)
    return pa.RecordBatch.from_arrays([pa.array(anchor[which]), pa.array(context[which]), lists], names=["anchor", "context", "ranges"])


#: At most one row per context of an anchor, so a run meets at most one.
RANGES = "anchor long, context long, ranges array<struct<first: int, last: int>>"


def by_anchor(strings: DataFrame, kind: Kind, resolve: Callable[[Strings], np.ndarray], batch: int = 4096) -> DataFrame:
    """Ranges of repeated windows, from a resolver that sees whole anchors, about `batch` strings at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        C.forget()
        held: list[pa.RecordBatch] = []
        n = 0

        def done(table: pa.Table) -> Iterator[pa.RecordBatch]:
            if len(table):
                s = Strings.of(table, kind.dtype)
                yield ranges_batch(s, resolve(s))

        for b in batches:
            held.append(b)
            n += len(b)
            while n >= 2 * batch:
                table = pa.Table.from_batches(held).combine_chunks()
                ids = table.column("anchor").to_numpy()
                cut = np.flatnonzero(ids[1:] != ids[:-1]) + 1
                cut = cut[cut >= batch]
                if not len(cut):
                    break
                yield from done(table.slice(0, int(cut[0])).combine_chunks())
                held = table.slice(int(cut[0])).to_batches()
                n -= int(cut[0])
        if held:
            table = pa.Table.from_batches(held).combine_chunks()
            ids = table.column("anchor").to_numpy()
            cut = np.flatnonzero(ids[1:] != ids[:-1]) + 1
            at = 0
            while at < len(table):
                later = cut[cut >= at + batch]
                end = int(later[0]) if len(later) else len(table)
                yield from done(table.slice(at, end - at).combine_chunks())
                at = end

    return strings.repartition("anchor").sortWithinPartitions("anchor", "doc").mapInArrow(run, RANGES)


def by_window(strings: DataFrame, kind: Kind, repeated: Column) -> DataFrame:
    """The same for crowded anchors: each window by a 128-bit hash. `repeated` is over doc, first_doc and total of equal windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = Strings.of(pa.Table.from_batches([batch]), kind.dtype)
            for a, b in C.pieces(s.offsets, C.PIECE):
                first, last = window_hashes(s.symbols[s.offsets[a] : s.offsets[b]], s.offsets[a:b] - s.offsets[a], s.windows[a:b], kind)
                owner = a + np.repeat(np.arange(b - a), s.windows[a:b])
                start = np.arange(len(owner)) - np.repeat(np.cumsum(s.windows[a:b]) - s.windows[a:b], s.windows[a:b])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(C.signed(first)), pa.array(C.signed(last)), *[pa.array(x[owner]) for x in (s.anchor, s.context, s.doc, s.runs)], pa.array(start.astype(np.int32))],
                    names=["h1", "h2", "anchor", "context", "doc", "runs", "first"],
                )

    windows = strings.mapInArrow(run, "h1 long, h2 long, anchor long, context long, doc long, runs long, first int")
    equal = windows.groupBy("h1", "h2").agg(F.min("doc").alias("first_doc"), F.max("doc").alias("last_doc"), F.sum("runs").alias("total"))
    equal = equal.filter((F.col("total") > 1) | (F.col("first_doc") < F.col("last_doc"))).drop("last_doc")
    # A context has no more windows than fit around its anchor.
    each = windows.join(equal, ["h1", "h2"]).filter(repeated).groupBy("anchor", "context").agg(F.sort_array(F.collect_set("first")).alias("windows"))

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(2)
            owner = np.repeat(np.arange(len(batch)), lists.value_lengths().to_numpy())
            yield folded(batch.column(0).to_numpy(), batch.column(1).to_numpy(), owner, lists.flatten().to_numpy().astype(np.int64))

    return each.mapInArrow(fold, RANGES)


def window_hashes(symbols: np.ndarray, offsets: np.ndarray, windows: np.ndarray, kind: Kind) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of every window of strings that lie behind one another."""
    x = kind.hashed(symbols)
    start = np.repeat(offsets - (np.cumsum(windows) - windows), windows) + np.arange(int(windows.sum()))
    return C.Prefix(x, 21).of(start, start + kind.length), C.Prefix(x, 22).of(start, start + kind.length)


#: Contexts with more runs than one in this many of all: there are fewer of them than this, so they can be broadcast.
HOT = 1000


def marks(occ: DataFrame, ctx: DataFrame, ranges: DataFrame, whole: Column, first_only: bool, kind: Kind) -> DataFrame:
    """Per document the ranges of symbols to take out, as `cuts`.

    `whole`: of an anchor with one context, which runs repeat entirely. `first_only`: ranges hold for a context's
    first document; its runs in later documents repeat entirely. Contexts with very many runs go to the runs, the others
    meet theirs by key.
    """
    key = ["anchor", "context"]
    decided = ctx.select(*key, F.col("runs").alias("of"), F.col("doc").alias("context_doc")).join(ranges, key, "left" if first_only else "inner")
    decided = C.staged(decided, "decided")
    total = ctx.agg(F.sum("runs")).first()[0] or 0
    hot = F.broadcast(decided.filter(F.col("of") * HOT > total))
    several = occ.filter(~F.col("single")).select("doc", "twin", "pos", "windows", *key)
    joined = several.join(hot, key).unionByName(several.join(hot.select(*key), key, "left_anti").join(decided.filter(F.col("of") * HOT <= total), key))
    all_of_it = lambda last: F.array(F.struct(F.lit(0).alias("first"), F.col(last).alias("last")))
    if first_only:
        own = F.when(F.col("doc") > F.col("context_doc"), all_of_it("windows")).otherwise(F.col("ranges"))
        joined = joined.withColumn("ranges", own).filter("ranges IS NOT NULL")
    single = occ.filter(F.col("single") & whole).select("doc", "twin", "pos", all_of_it("windows").alias("ranges"))
    cut = lambda r: F.struct((F.col("pos") + r["first"]).alias("start"), (F.col("pos") + r["last"] + kind.length - 1).alias("end"))
    return (
        single.unionByName(joined.select("doc", "twin", "pos", "ranges"))
        .select("doc", "twin", F.transform("ranges", cut).alias("cuts"))
        .groupBy("doc", "twin")
        .agg(F.flatten(F.collect_list("cuts")).alias("cuts"))
    )


def merged(lists: pa.ListArray, i: int) -> tuple[np.ndarray, np.ndarray]:
    """The i-th list of ranges as disjoint ranges in order."""
    if not lists.is_valid()[i].as_py():
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    bounds = lists.offsets
    rows = lists.values.slice(bounds[i].as_py(), bounds[i + 1].as_py() - bounds[i].as_py())
    start, end = rows.field("start").to_numpy(), rows.field("end").to_numpy()
    order = np.argsort(start, kind="stable")
    start, end = start[order], np.maximum.accumulate(end[order])
    if not len(start):
        return start, end
    new = np.concatenate([[True], start[1:] > end[:-1]])
    return start[new], end[np.concatenate([np.flatnonzero(new)[1:] - 1, [len(end) - 1]])]
