"""Greedy word-budgeted windows over transcripts of any length.

A window is closed when the next line would take it past the budget, so where a window starts
depends on every line before it. Transcripts are cut into blocks of lines; each block also gets
the lines just behind it, so every window is complete in the block it starts in. All that a block
must know from the past is the line at which its first window starts. A block therefore is a
function from that line to the first start in the next block. These functions compose, so they
are folded up and down a tree of blocks: no task ever holds more than one block, or one small
stack of functions, however long a transcript is. Transcripts of a single block skip all that.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from convolens import protocol
from convolens.functions.text import let, speaker_line, word_count

BLOCK_LINES = 4096
FAN_IN = 64


def explode_meetings(meetings: DataFrame) -> DataFrame:
    """Array form of transcripts to long form."""
    return meetings.select("meeting_id", F.posexplode("utterances").alias("utt_idx", "u")).select(
        "meeting_id", "utt_idx", F.col("u.speaker").alias("speaker"), F.col("u.text").alias("text")
    )


def _block_size(budget: int, block_lines: int) -> int:
    return max(block_lines, budget)


def in_rows(transcripts: DataFrame) -> bool:
    """Whether transcripts come as one array per row instead of one row per utterance."""
    return "utterances" in transcripts.columns


def is_multi_block(utterances: DataFrame, budget: int, block_lines: int = BLOCK_LINES) -> bool:
    """Whether any transcript is longer than one block. One that fits a row needs no blocks."""
    if in_rows(utterances):
        return False
    top = utterances.agg(F.max("utt_idx")).first()[0]
    return top is not None and top >= _block_size(budget, block_lines)


def _lines(utterances: DataFrame) -> DataFrame:
    line = speaker_line(F.col("speaker"), F.col("text"))
    return utterances.select("meeting_id", "utt_idx", line.alias("line")).withColumn("n", word_count(F.col("line")))


def _greedy_starts(lines: Column, budget: int) -> Column:
    """Line numbers at which windows start when one starts at the first line given."""
    empty = F.struct(F.array().cast("array<int>").alias("starts"), F.lit(0).alias("used"))

    def step(acc: Column, x: Column) -> Column:
        opens = (acc["used"] == 0) | (acc["used"] + x["n"] > budget)
        return F.struct(
            F.when(opens, F.concat(acc["starts"], F.array(x["utt_idx"]))).otherwise(acc["starts"]).alias("starts"),
            F.when(opens, x["n"]).otherwise(acc["used"] + x["n"]).alias("used"),
        )

    return F.aggregate(lines, empty, step, lambda acc: acc["starts"])


def _cut(lines: Column, starts: Column) -> Column:
    """Windows between consecutive starts; the last one ends with the lines."""
    first = lines[0]["utt_idx"]
    last = F.element_at(lines, -1)["utt_idx"]

    def window(s: Column, k: Column) -> Column:
        end = F.coalesce(F.get(starts, k + 1) - 1, last)
        return let(
            F.slice(lines, s - first + 1, end - s + 1),
            lambda part: F.struct(
                s.alias("start"),
                end.alias("end"),
                F.aggregate(part, F.lit(0), lambda a, x: a + x["n"]).alias("n_words"),
                F.array_join(F.transform(part, lambda x: x["line"]), "\n").alias("text"),
            ),
        )

    return F.transform(starts, window)


def _windows_of(lines: Column, budget: int) -> Column:
    return let(lines, lambda ls: let(_greedy_starts(ls, budget), lambda st: _cut(ls, st)))


def _opened(whole: DataFrame, budget: int) -> DataFrame:
    cut = whole.select("meeting_id", F.posexplode(_windows_of(F.col("ls"), budget)).alias("win_idx", "w"))
    return cut.select("meeting_id", "win_idx", "w.start", "w.end", "w.n_words", "w.text")


def build_windows(
    utterances: DataFrame, budget: int | None = None, block_lines: int = BLOCK_LINES, multi: bool | None = None
) -> DataFrame:
    """`meeting_id, win_idx, start, end, n_words, text`; no budget means the protocol's.

    Long form is one row per utterance, with `utt_idx` counting 0..n-1 within a transcript. Array
    form is cut row by row, without any shuffle.
    """
    budget = budget or protocol.CHUNK_WORDS
    if in_rows(utterances):
        line = lambda u, i: F.struct(i.alias("utt_idx"), speaker_line(u["speaker"], u["text"]).alias("line"))
        counted = lambda x: F.struct(x["utt_idx"], word_count(x["line"]).alias("n"), x["line"])
        return _opened(utterances.select("meeting_id", F.transform(F.transform("utterances", line), counted).alias("ls")), budget)
    if multi is None:
        multi = is_multi_block(utterances, budget, block_lines)
    lines = _lines(utterances)
    if not multi:
        whole = lines.groupBy("meeting_id").agg(
            F.sort_array(F.collect_list(F.struct("utt_idx", "n", "line"))).alias("ls")
        )
        return _opened(whole, budget)

    size = _block_size(budget, block_lines)
    blk = F.floor(F.col("utt_idx") / size).cast("int")
    ahead = (F.col("blk") > 0) & (F.col("utt_idx") % size < budget)
    blocks = (
        lines.withColumn("blk", blk)
        .withColumn("blk", F.explode(F.when(ahead, F.array(F.col("blk") - 1, F.col("blk"))).otherwise(F.array("blk"))))
        .groupBy("meeting_id", "blk")
        .agg(F.sort_array(F.collect_list(F.struct("utt_idx", "n", "line"))).alias("ls"))
    )
    n_blocks = utterances.agg(F.max("utt_idx")).first()[0] // size + 1
    entries = _block_entries(blocks, budget, size, n_blocks)
    ready = (
        blocks.join(entries, ["meeting_id", "blk"], "left")
        .withColumn("entry", F.coalesce("entry", F.lit(0)))
        .withColumn("win0", F.coalesce("win0", F.lit(0).cast("bigint")))
        .where(F.col("entry") < F.size("ls"))
    )
    tail = F.slice(F.col("ls"), F.col("entry") + 1, F.size("ls"))
    cut = ready.select("meeting_id", "blk", "win0", F.posexplode(_windows_of(tail, budget)).alias("k", "w"))
    return cut.where(F.col("w.start") < (F.col("blk") + 1) * size).select(
        "meeting_id", (F.col("win0") + F.col("k")).cast("int").alias("win_idx"), "w.start", "w.end", "w.n_words", "w.text"
    )


def _block_function(ns: np.ndarray, budget: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """For every possible first start of a block: the next block's first start, windows started here."""
    total = np.concatenate(([0], np.cumsum(ns, dtype=np.int64)))
    here = np.arange(len(ns))
    nxt = np.maximum(here + 1, np.searchsorted(total, total[:-1] + budget, side="right") - 1)
    out = np.zeros(size, dtype=np.int64)
    cnt = np.zeros(size, dtype=np.int64)
    for i in range(size - 1, -1, -1):
        j = nxt[i]
        if j >= size:
            out[i], cnt[i] = j - size, 1
        else:
            out[i], cnt[i] = out[j], cnt[j] + 1
    return out[:budget], cnt[:budget]


def _block_entries(blocks: DataFrame, budget: int, size: int, n_blocks: int) -> DataFrame:
    """First start and first window number of every block of a transcript with several blocks."""

    @F.pandas_udf("struct<exit: array<int>, cnt: array<bigint>>")
    def block_function(ns: pd.Series) -> pd.DataFrame:
        pairs = [_block_function(np.asarray(n, dtype=np.int64), budget, size) for n in ns]
        return pd.DataFrame({"exit": [p[0] for p in pairs], "cnt": [p[1] for p in pairs]})

    @F.pandas_udf("struct<exit: array<int>, cnt: array<bigint>>")
    def compose(exits: pd.Series, cnts: pd.Series) -> pd.DataFrame:
        out_e, out_c = [], []
        for es, cs in zip(exits, cnts):
            at = np.arange(budget)
            seen = np.zeros(budget, dtype=np.int64)
            for e, c in zip(es, cs):
                seen = seen + np.asarray(c)[at]
                at = np.asarray(e)[at]
            out_e.append(at)
            out_c.append(seen)
        return pd.DataFrame({"exit": out_e, "cnt": out_c})

    @F.pandas_udf("array<struct<k: int, entry: int, win0: bigint>>")
    def walk(entry: pd.Series, win0: pd.Series, exits: pd.Series, cnts: pd.Series) -> pd.Series:
        rows = []
        for e0, w0, es, cs in zip(entry, win0, exits, cnts):
            at, seen, out = int(e0), int(w0), []
            for k, (e, c) in enumerate(zip(es, cs)):
                out.append({"k": k, "entry": at, "win0": seen})
                at, seen = int(e[at]), seen + int(c[at])
            # The node behind the last function has none itself: it only needs its entry.
            out.append({"k": len(es), "entry": at, "win0": seen})
            rows.append(out)
        return pd.Series(rows)

    # Only blocks with a successor have a function; it is defined by the successor's lines too.
    has_next = F.element_at("ls", -1)["utt_idx"] >= (F.col("blk") + 1) * size
    level = (
        blocks.where(has_next)
        .select("meeting_id", "blk", F.transform("ls", lambda x: x["n"]).alias("ns"))
        .select("meeting_id", "blk", block_function("ns").alias("f"))
        .select("meeting_id", F.col("blk").alias("node"), "f.exit", "f.cnt")
    )
    stacks = []
    width = n_blocks
    while True:
        stacked = (
            level.groupBy("meeting_id", F.floor(F.col("node") / FAN_IN).cast("int").alias("group"))
            .agg(F.sort_array(F.collect_list(F.struct("node", "exit", "cnt"))).alias("fs"))
            .select(
                "meeting_id",
                "group",
                F.transform("fs", lambda f: f["exit"]).alias("exits"),
                F.transform("fs", lambda f: f["cnt"]).alias("cnts"),
            )
        )
        stacks.append(stacked)
        width = -(-width // FAN_IN)
        if width <= 1:
            break
        level = stacked.select("meeting_id", F.col("group").alias("node"), compose("exits", "cnts").alias("f")).select(
            "meeting_id", "node", "f.exit", "f.cnt"
        )
    # The root of every transcript starts at line 0 with window 0; walk back down to the blocks.
    entries = stacks[-1].select(
        "meeting_id", F.col("group"), F.lit(0).alias("entry"), F.lit(0).cast("bigint").alias("win0")
    )
    for stacked in reversed(stacks):
        entries = (
            entries.join(stacked, ["meeting_id", "group"])
            .select("meeting_id", "group", F.explode(walk("entry", "win0", "exits", "cnts")).alias("x"))
            .select(
                "meeting_id",
                (F.col("group") * FAN_IN + F.col("x.k")).alias("group"),
                F.col("x.entry").alias("entry"),
                F.col("x.win0").alias("win0"),
            )
            # A full group's walk ends at the next group's first node, which that group may report too.
            .dropDuplicates(["meeting_id", "group"])
        )
    return entries.withColumnRenamed("group", "blk")
