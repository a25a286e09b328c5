"""Suffix-array dedup: a collection's Burrows-Wheeler transform, built column by column, over UTF-8 bytes.

Each round takes one more symbol of every string, from the right: it fills the strings' open places in the
transform, and its rank there is where the longer suffix goes in. Common prefixes are kept alongside: a suffix
that goes in shares one symbol more with its neighbour than the least common prefix between the rows they come
from. Transform and common prefixes lie in two files that each round reads from front to back and writes anew.
When all symbols are in, two neighbours with a common prefix of `length` bytes are one repeated string.

A symbol is `wide` bytes, and there is a collection for each distance to the anchor modulo `wide`: equal strings
of `length` bytes have their anchor at the same distance, so they begin in the same collection. Rounds and rows
get fewer by that factor each.

The collection is what `repeats.py` leaves over: bytes around winnowed anchors that stand in more than one
context. Equal strings of `length` bytes have the same anchor, so collections of whole anchors miss nothing.
"""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from convolens.llm import common as C
from convolens.llm import repeats as R

class Files:
    """Transform and common prefixes on disk, read and written from front to back once per round."""

    def __init__(self, dtype):
        self.dtype = dtype
        self.now, self.next = tempfile.TemporaryFile(), tempfile.TemporaryFile()

    def read(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        self.now.seek(0)
        return np.fromfile(self.now, self.dtype, n), np.fromfile(self.now, np.uint8, n)

    def write(self, bwt: np.ndarray, lcp: np.ndarray) -> None:
        self.next.seek(0)
        bwt.tofile(self.next)
        lcp.tofile(self.next)
        self.now, self.next = self.next, self.now


def least(x: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """min(x[lo .. hi]) for each pair, both ends included, from minima over powers of two."""
    out = np.empty(len(lo), x.dtype)
    level = np.frexp((hi - lo + 1).astype(np.float64))[1] - 1
    width = 1
    for k in range(int(level.max(initial=-1)) + 1):
        at = np.flatnonzero(level == k)
        if len(at):
            out[at] = np.minimum(x[lo[at]], x[hi[at] - width + 1])
        if len(x) > width:
            x = np.minimum(x[:-width], x[width:])
        width *= 2
    return out


def insert(x: np.ndarray, at: np.ndarray, values: np.ndarray, old: np.ndarray) -> np.ndarray:
    """`values` at the places `at` of the result, and x in order at those marked `old`."""
    out = np.empty(len(x) + len(at), x.dtype)
    out[old] = x
    out[at] = values
    return out


def collection(symbols: np.ndarray, offsets: np.ndarray, cap: int) -> tuple[np.ndarray, np.ndarray]:
    """Transform and common prefixes (at most `cap`, which is at most 254) of all strings.

    Row i < m is the empty suffix of string i; row m + k is the suffix that begins with the k-th smallest symbol of
    the transform and goes on with the row that symbol stands in. Suffixes that end alike stand in the order of
    the strings and share no more than their symbols. The place of a string whose next symbol is not known holds
    the largest number of the symbols' type, which is no symbol.
    """
    open_ = np.iinfo(symbols.dtype).max
    m = len(offsets) - 1
    length = np.diff(offsets)
    files = Files(symbols.dtype)
    files.write(np.full(m, open_, symbols.dtype), np.zeros(m, np.uint8))
    place = np.arange(m)
    active = np.flatnonzero(length > 0)
    n, taken = m, 0
    while len(active):
        taken += 1
        bwt, lcp = files.read(n)
        active = active[np.argsort(place[active])]
        row = place[active]
        bwt[row] = symbols[offsets[active + 1] - taken]
        # Rows by their symbol: where the suffix that begins with it goes. Those of this round are not in yet.
        rows = by_symbol(bwt)
        fresh = np.zeros(n, bool)
        fresh[row] = True
        slot = np.flatnonzero(fresh[rows])
        to = m + slot
        key = bwt[rows]
        above = np.flatnonzero((slot > 0) & (key[slot - 1] == key[slot]))
        low = np.zeros(len(slot), np.uint8)
        at = slot[above]
        low[above] = np.minimum(least(lcp, rows[at - 1] + 1, rows[at]), cap - 1) + 1
        after = np.minimum(slot + 1, len(rows) - 1)
        below = np.flatnonzero((after > slot) & (key[after] == key[slot]) & ~fresh[rows[after]])
        at = slot[below]
        next_low = np.minimum(least(lcp, rows[at] + 1, rows[at + 1]), cap - 1) + 1
        old = np.ones(n + len(slot), bool)
        old[to] = False
        place[active[np.searchsorted(row, rows[slot])]] = to
        lcp = insert(lcp, to, low, old)
        lcp[to[below] + 1] = next_low
        files.write(insert(bwt, to, np.full(len(to), open_, symbols.dtype), old), lcp)
        n += len(to)
        active = active[length[active] > taken]
    return files.read(n)


def by_symbol(bwt: np.ndarray) -> np.ndarray:
    """Rows in the order of their symbols, those without one left out."""
    return np.argsort(bwt, kind="stable")[: len(bwt) - int(np.count_nonzero(bwt == np.iinfo(bwt.dtype).max))]


def twice(symbols: np.ndarray, offsets: np.ndarray, starts: np.ndarray, length: int) -> np.ndarray:
    """Flags of each string's first `starts` suffixes, strings behind one another: whether their first `length` symbols recur."""
    bwt, lcp = collection(symbols, offsets, length)
    m = len(starts)
    like = lcp >= length
    like[:-1] |= like[1:]
    longer = np.empty(len(bwt), np.int64)
    rows = by_symbol(bwt)
    longer[rows] = m + np.arange(len(rows))
    flags = np.zeros(int(starts.sum()), bool)
    edge = np.cumsum(starts) - starts
    # From each string's end to its start, a symbol at a time.
    size = np.diff(offsets)
    at, active = np.arange(m), np.arange(m)
    for taken in range(1, int(size.max(initial=0)) + 1):
        active = active[size[active] >= taken]
        at[active] = longer[at[active]]
        start = size[active] - taken
        hit = (start < starts[active]) & like[at[active]]
        flags[edge[active[hit]] + start[hit]] = True
    return flags


def repeated_windows(s: R.Strings, kind: R.Kind, wide: int) -> np.ndarray:
    """Flags of the windows that occur twice among whole anchors' strings."""
    flags = np.repeat(s.runs > 1, s.windows)
    edge = np.cumsum(s.windows, dtype=np.int64) - s.windows
    for distance in range(wide):
        first = (s.lead - distance) % wide
        starts = np.maximum(0, (s.windows - first + wide - 1) // wide).astype(np.int64)
        size = np.where(starts > 0, (starts - 1) * wide + kind.length, 0)
        ends = np.cumsum(size)
        if not len(ends) or not ends[-1]:
            continue
        own = s.symbols[np.repeat(s.offsets[:-1] + first - (ends - size), size) + np.arange(ends[-1])]
        names, symbols = np.unique(own.view(f">u{wide}"), return_inverse=True)
        symbols = symbols.astype(np.uint16 if len(names) < 1 << 16 else np.uint32)
        found = twice(symbols, np.concatenate([[0], ends]) // wide, starts, kind.length // wide)
        owner = np.repeat(np.arange(len(starts)), starts)
        at = np.arange(len(owner)) - np.repeat(np.cumsum(starts) - starts, starts)
        flags[(edge[owner] + first[owner] + at * wide)[found]] = True
    return flags


def dedup(docs: DataFrame, length: int = 200, gram: int = 40, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Take out each byte covered by a string of `length` bytes that starts anywhere else too, in the same text or another.

    Returns per row of `docs`: id_col, n_bytes, n_removed, n_spans (removed runs, as long as they go), kept (the
    other bytes, which need not be whole characters) and spans (the removed ranges). A null text is empty. Equal
    rows are each other's repeats. An empty table gives an empty result.
    """
    wide = next(w for w in (8, 4, 2, 1) if length % w == 0)
    if not 0 < length // wide <= 254:
        raise ValueError(f"length must be from 1 to {254 * wide}")
    kind = R.Kind(False, length, min(gram, length))
    texts = R.keyed(docs, id_col, text_col)
    found = C.staged(R.seeds(texts, kind), "seeds")
    occ = C.staged(R.occurrences(found, F.col("runs") > 1), "repeats")
    C.discard(found)
    ctx = C.staged(R.contexts(occ), "contexts")
    crowded = F.col("crowd") > kind.crowd
    few = R.by_anchor(R.contents(texts, ctx.filter(~crowded), kind), kind, lambda s: repeated_windows(s, kind, wide), 2048)
    many = R.by_window(R.contents(texts, ctx.filter(crowded), kind), kind, F.col("total") > 1)
    cuts = R.marks(occ, ctx, few.unionByName(many), F.lit(True), False, kind)
    return _cut(texts.join(cuts, ["doc", "twin"], "left"), id_col)


def _cut(joined: DataFrame, id_col: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, lists = batch.column(0), batch.column(2)
            data, offsets = C.text_bytes(batch.column(1))
            for a, b in C.pieces(offsets, 16 * C.PIECE):
                n_bytes, n_removed, n_spans, kept, spans = [], [], [], [], []
                for i in range(a, b):
                    text = data[offsets[i] : offsets[i + 1]].tobytes()
                    start, end = R.merged(lists, i)
                    left, at = [], 0
                    for x, y in zip(start.tolist(), end.tolist()):
                        left.append(text[at:x])
                        at = y
                    left.append(text[at:])
                    kept.append(b"".join(left))
                    n_bytes.append(len(text))
                    n_removed.append(len(text) - len(kept[-1]))
                    n_spans.append(len(start))
                    spans.append([{"start": int(x), "end": int(y)} for x, y in zip(start, end)])
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.slice(a, b - a), pa.array(n_bytes, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(n_spans, pa.int64()), pa.array(kept, pa.binary()),
                        pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
                    ],
                    names=["doc", "n_bytes", "n_removed", "n_spans", "kept", "spans"],
                )

    out = joined.select("doc", "text", "cuts").mapInArrow(
        run, "doc long, n_bytes long, n_removed long, n_spans long, kept binary, spans array<struct<start: bigint, end: bigint>>"
    )
    return out.select(R.own_id(id_col), *out.columns[1:])
