"""Token ids as range asymmetric numeral system (rANS) files.

A file is a folder with two tables. `table` holds the shared frequencies, one row per id that occurs, scaled to
2^SCALE in all. `blocks` holds independent blocks of up to BLOCK ids: the words of LANES interleaved coders (id t
goes to lane t % lanes), checkpoints with all lanes' states and their place among the words, a checksum, the
documents that the block holds and the place of its first id among all ids. Documents lie in ascending order of id.

A block decodes without any other, and from each checkpoint of it without what stands before: the decoder takes
all checkpoints of a block at once. Counting and coding are maps over the blocks; only the frequencies, whose
number the vocabulary bounds, and one total per partition meet in one place.
"""

from __future__ import annotations

import json
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from convolens.llm import bpe
from convolens.llm import common as C

SCALE = 18
BLOCK = 1 << 18
LANES = 512
#: Steps of all lanes between two checkpoints.
STEPS = 128
#: Bytes of texts that are cut together.
GROUP = 16 * C.PIECE
_LOW = np.uint64(1 << 31)
_WORD = np.uint64(32)

_DOCS = "docs array<struct<id: bigint, offset: bigint, n: bigint, whole: boolean>>"
_DOCS_TYPE = pa.list_(pa.struct([("id", pa.int64()), ("offset", pa.int64()), ("n", pa.int64()), ("whole", pa.bool_())]))


class Table:
    """Scaled frequencies: at least 1 for every id that occurs, 2^SCALE in all."""

    def __init__(self, ids: np.ndarray, freqs: np.ndarray):
        size = int(ids.max()) + 1 if len(ids) else 1
        self.freq = np.zeros(size, np.uint64)
        self.freq[ids] = freqs
        self.below = np.concatenate([[0], np.cumsum(self.freq)[:-1]]).astype(np.uint64)
        self.id_at = np.repeat(np.arange(size, dtype=np.uint32), self.freq.astype(np.int64))

    @staticmethod
    def scaled(ids: np.ndarray, counts: np.ndarray, scale: int = SCALE) -> np.ndarray:
        """Frequencies near counts in proportion. The largest take what rounding leaves over or short."""
        total, room = int(counts.sum()), 1 << scale
        if len(ids) > room:
            raise ValueError("more ids than the scale has places")
        freqs = np.maximum(1, (counts.astype(object) * room // max(total, 1)).astype(np.int64))
        order = np.lexsort((ids, -counts))
        short = room - int(freqs.sum())
        if len(ids) and short > 0:
            freqs[order[0]] += short
        while short < 0:
            for k in order:
                take = min(-short, int(freqs[k]) // 2)
                freqs[k] -= take
                short += take
                if short == 0:
                    break
        return freqs


def encode_block(ids: np.ndarray, table: Table, lanes: int = LANES, steps: int = STEPS) -> tuple[int, np.ndarray, np.ndarray]:
    """(lanes, checkpoints, words); a checkpoint is its place among the words and then all lanes' states."""
    n = len(ids)
    lanes = max(1, min(lanes, n // 64))
    total = -(-n // lanes)
    state = np.full(lanes, _LOW, np.uint64)
    out: list[np.ndarray] = []
    marks: list[np.ndarray] = []
    written = 0
    shift, up = np.uint64(SCALE), np.uint64(63 - SCALE)
    for step in range(total - 1, -1, -1):
        at = ids[step * lanes : (step + 1) * lanes]
        x = state[: len(at)]
        f = table.freq[at]
        full = x >= f << up
        words = x[full]
        if len(words):
            out.append((words & np.uint64(0xFFFFFFFF)).astype(np.uint32))
            written += len(words)
            x = np.where(full, x >> _WORD, x)
        high = x // f
        state[: len(at)] = (high << shift) + (x - high * f) + table.below[at]
        if step % steps == 0:
            marks.append(np.concatenate([[np.uint64(written)], state]))
    words = np.concatenate(out[::-1]) if out else np.zeros(0, np.uint32)
    marks = np.array(marks[::-1], np.uint64).reshape(-1, lanes + 1)
    marks[:, 0] = np.uint64(written) - marks[:, 0]
    return lanes, marks, words


def decode_block(n: int, lanes: int, marks: np.ndarray, words: np.ndarray, table: Table, steps: int = STEPS) -> np.ndarray:
    """The ids, from all checkpoints side by side."""
    total = -(-n // lanes)
    out = np.zeros((len(marks), steps, lanes), np.uint32)
    place, state = marks[:, 0].astype(np.int64), marks[:, 1:].copy()
    words = np.concatenate([words.astype(np.uint64), [np.uint64(0)]])
    shift, mask = np.uint64(SCALE), np.uint64((1 << SCALE) - 1)
    for k in range(min(steps, total)):
        # Only the last checkpoint may have fewer steps, and only its last step fewer lanes.
        live = len(marks) if (len(marks) - 1) * steps + k < total else len(marks) - 1
        x = state[:live]
        slot = x & mask
        ids = table.id_at[slot]
        out[:live, k] = ids
        x = table.freq[ids] * (x >> shift) + slot - table.below[ids]
        short = x < _LOW
        if live == len(marks) and (live - 1) * steps + k == total - 1:
            extra = n - (total - 1) * lanes
            short[-1, extra:] = False
            x[-1, extra:] = state[live - 1, extra:]
        count = np.cumsum(short, axis=1)
        at = np.minimum(place[:live, None] + count - 1, len(words) - 1)
        state[:live] = np.where(short, (x << _WORD) | words[at], x)
        place[:live] += count[:, -1]
    if not (state[-1] == _LOW).all():
        raise ValueError("a block does not decode to its end")
    return out.reshape(-1)[:n]


class Ids:
    """Ids as the tokenizers library gives them for the file at `path`.

    Plain texts are cut together, and tiktoken merges each distinct piece of them once, with the merges of that file,
    which gives the same ids many times as fast. Texts that hold added tokens, zero characters or characters on which
    Unicode versions differ, and all texts under a file whose ids are not in the order of its merges, go through the
    library itself.
    """

    #: Letters of remembered pieces, beyond which they are forgotten.
    LETTERS = 1 << 24

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import tiktoken
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        cutter = bpe.Cutter(spec, path)
        self.added = list(cutter.added)
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        byte = {x: b for b, x in enumerate(bpe.byte_letters())}
        merged = [vocab["".join(m.split(" ") if isinstance(m, str) else m)] for m in merges]
        self.zero = vocab[bpe.byte_letters()[0]]
        self.forget()
        self.fast = None
        if merged == sorted(set(merged)) and (not merged or max(vocab[x] for x in byte) < merged[0]):
            ranks = {bytes(byte[x] for x in token): i for token, i in vocab.items()}
            # Takes pieces with a zero character between them, so that one call merges many.
            self.fast = tiktoken.Encoding("file", pat_str="[^\\x00]+|\\x00", mergeable_ranks=ranks, special_tokens={})

    def whole(self, text: str) -> np.ndarray:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, np.uint32)

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.letters = 0
        self.lists = pa.array([], pa.large_list(pa.uint32()))

    def merged(self, pieces: str) -> pa.Array:
        """The ids of each piece, as a list; pieces have a zero character between them."""
        ids = self.fast.encode_to_numpy(pieces)
        zeros = np.flatnonzero(ids == self.zero)
        ends = np.concatenate([[0], zeros - np.arange(len(zeros)), [len(ids) - len(zeros)]])
        return pa.LargeListArray.from_arrays(pa.array(ends), pa.array(np.delete(ids, zeros)))

    def looked_up(self, pieces: pa.Array) -> pa.Array:
        """The ids of each piece, as a list. Distinct pieces are merged, but for those that are remembered."""
        if len(self.known) > bpe.REMEMBERED or self.letters > self.LETTERS:
            self.forget()
        found = pieces.dictionary_encode()
        distinct = pc.binary_join(pa.ListArray.from_arrays([0, len(found.dictionary)], found.dictionary), pa.scalar("\0", pa.large_string()))[0].as_py().split("\0")
        new = [x for x in distinct if x not in self.known]
        if new:
            joined = "\0".join(new)
            self.lists = pa.concat_arrays([self.lists, self.merged(joined)])
            self.known.update(zip(new, range(len(self.known), len(self.lists))))
            self.letters += len(joined)
        at = np.fromiter(map(self.known.__getitem__, distinct), np.int64, len(distinct))
        return self.lists.take(pa.array(at[found.indices.to_numpy()]))

    def encode(self, texts: pa.Array) -> list[np.ndarray]:
        """The ids of each text; null is empty."""
        data, offsets = C.text_bytes(texts)
        if self.fast is None:
            return [self.whole(t or "") for t in texts.to_pylist()]
        if not len(data):
            return [np.zeros(0, np.uint32)] * len(texts)
        starts, odd = bpe.cuts(data, offsets)
        raw = data.tobytes().replace(b"\0", b" ")
        if any(t.encode() in raw for t in self.added):
            odd = np.union1d(odd, [i for i, t in enumerate(texts.to_pylist()) if t and any(x in t for x in self.added)])
        lists = self.looked_up(pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(np.append(starts, len(data))), pa.py_buffer(raw)))
        first = lists.offsets.to_numpy()[np.searchsorted(starts, offsets)]
        ids = lists.values.to_numpy()
        out = [ids[a:b] for a, b in zip(first[:-1].tolist(), first[1:].tolist())]
        for i in odd.tolist():
            out[i] = self.whole(texts[i].as_py())
        return out


_IDS: dict[str, Ids] = {}
C.held(lambda: [own.forget() for own in _IDS.values()])


def blocks_of_ids(docs: DataFrame, path: str, end_id: int, id_col: str, text_col: str, block: int) -> DataFrame:
    """Ids in blocks, in order of document within each partition: part, seq, first (of the partition's ids), n, ids, docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in _IDS:
            _IDS[path] = Ids(path)
        part = TaskContext.get().partitionId()
        held: list[np.ndarray] = []
        inside: list[dict] = []
        seq = first = size = 0

        def close() -> pa.RecordBatch:
            nonlocal seq, first, size
            ids = np.concatenate(held)
            ids = ids.astype("<u2" if ids.max() < 1 << 16 else "<u4")
            batch = pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([seq], pa.int64()), pa.array([first], pa.int64()), pa.array([size], pa.int64()), pa.array([ids.tobytes()], pa.binary()), pa.array([inside], _DOCS_TYPE)],
                names=["part", "seq", "first", "n", "ids", "docs"],
            )
            seq, first, size = seq + 1, first + size, 0
            held.clear()
            inside.clear()
            return batch

        for batch in batches:
            sizes = C.text_bytes(batch.column(1))[1]
            keys = batch.column(0).to_pylist()
            for a, b in C.pieces(sizes, GROUP):
                for key, ids in zip(keys[a:b], _IDS[path].encode(batch.column(1).slice(a, b - a))):
                    ids = np.append(ids, np.uint32(end_id))
                    if size and size + len(ids) > block:
                        yield close()
                    for at in range(0, len(ids), block):
                        cut = ids[at : at + block]
                        held.append(cut)
                        inside.append({"id": key, "offset": at, "n": len(cut), "whole": len(ids) <= block})
                        size += len(cut)
                        if size >= block:
                            yield close()
        if size:
            yield close()

    C.small_batches(docs)
    ordered = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    ordered = ordered.repartitionByRange("id").sortWithinPartitions("id", "text")
    return ordered.mapInArrow(run, f"part int, seq bigint, first bigint, n bigint, ids binary, {_DOCS}")


def plain_ids(data: bytes, n: int) -> np.ndarray:
    """A block's ids, of two or of four bytes each."""
    return np.frombuffer(data, "<u2" if len(data) == 2 * n else "<u4")


def counts(blocks: DataFrame) -> DataFrame:
    """How often each id occurs, over all blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for batch in batches:
            for ids, n in zip(batch.column(0), batch.column(1).to_pylist()):
                own = np.bincount(plain_ids(ids.as_py(), n))
                if len(own) > len(total):
                    own, total = total, own
                total[: len(own)] += own
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["id", "n"])

    return blocks.select("ids", "n").mapInArrow(run, "id bigint, n bigint").groupBy("id").agg(F.sum("n").alias("n"))


def write(docs: DataFrame, path: str, tokenizer: str, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK) -> None:
    """Encode each text, append `end_id`, and write all ids in ascending order of document to the folder `path`.

    A null text is empty and has the end id alone. Documents without an id come first; those that share one lie in
    order of text. An empty table gives a file without blocks.
    """
    spark = docs.sparkSession
    plain = C.staged(blocks_of_ids(docs, tokenizer, end_id, id_col, text_col, block), "ids")
    known = counts(plain).toPandas().sort_values("id")  # no more rows than the vocabulary has
    ids = known["id"].to_numpy(np.int64)
    freqs = Table.scaled(ids, known["n"].to_numpy(np.int64))
    spark.createDataFrame(list(zip(ids.tolist(), freqs.tolist())), "id bigint, freq bigint").coalesce(1).write.parquet(f"{path}/table")
    shared = spark.sparkContext.broadcast((ids, freqs))
    # One row per partition, which the number of partitions bounds.
    parts = plain.groupBy("part").agg(F.sum("n").alias("n"))
    before = parts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    placed = plain.join(F.broadcast(before), "part").select("part", "seq", (F.col("before") + F.col("first")).alias("start"), "n", "ids", "docs")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = Table(*shared.value)
        for batch in batches:
            for i in range(len(batch)):
                lanes, marks, words = encode_block(plain_ids(batch.column(4)[i].as_py(), batch.column(3)[i].as_py()), table)
                marks, words = marks.astype("<u8").tobytes(), words.astype("<u4").tobytes()
                yield pa.RecordBatch.from_arrays(
                    [*[batch.column(k).slice(i, 1) for k in range(4)], pa.array([lanes], pa.int32()), pa.array([marks], pa.binary()), pa.array([words], pa.binary()), pa.array([zlib.crc32(words, zlib.crc32(marks))], pa.int64()), batch.column(5).slice(i, 1)],
                    names=["part", "seq", "start", "n", "lanes", "checkpoints", "words", "checksum", "docs"],
                )

    schema = f"part int, seq bigint, start bigint, n bigint, lanes int, checkpoints binary, words binary, checksum bigint, {_DOCS}"
    placed.mapInArrow(run, schema).write.parquet(f"{path}/blocks", compression="none")


def read(spark: SparkSession, path: str, id_col: str = "doc_id") -> DataFrame:
    """The documents of a file: id_col, start (of all ids), n, and ids as little-endian 32-bit numbers."""
    table = spark.read.parquet(f"{path}/table").toPandas()
    shared = spark.sparkContext.broadcast((table["id"].to_numpy(np.int64), table["freq"].to_numpy(np.int64)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Table(*shared.value)
        for batch in batches:
            for row in batch.to_pylist():
                if zlib.crc32(row["words"], zlib.crc32(row["checkpoints"])) != row["checksum"]:
                    raise ValueError(f"block {row['part']}/{row['seq']} is damaged")
                marks = np.frombuffer(row["checkpoints"], "<u8").reshape(-1, row["lanes"] + 1)
                ids = decode_block(row["n"], row["lanes"], marks, np.frombuffer(row["words"], "<u4"), own).astype("<u4")
                n = np.array([d["n"] for d in row["docs"]], np.int64)
                at = np.concatenate([[0], np.cumsum(n)])
                col = lambda k, kind: pa.array([d[k] for d in row["docs"]], kind)
                offset = np.array([d["offset"] for d in row["docs"]], np.int64)
                yield pa.RecordBatch.from_arrays(
                    [
                        col("id", pa.int64()), pa.array(row["start"] + at[:-1] - offset), pa.array(offset), pa.array(n), col("whole", pa.bool_()),
                        pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer((4 * at).astype(np.int32)), pa.py_buffer(ids)]),
                    ],
                    names=["id", "start", "offset", "n", "whole", "ids"],
                )

    blocks = spark.read.parquet(f"{path}/blocks")
    schema = "id bigint, start bigint, offset bigint, n bigint, whole boolean, ids binary"
    whole = blocks.mapInArrow(run, schema).filter("whole").select("id", "start", "n", "ids")
    # Documents longer than a block: their pieces, in order.
    cut = blocks.filter("exists(docs, d -> NOT d.whole)").mapInArrow(run, schema).filter("NOT whole").groupBy("start").agg(F.max("id").alias("id"), F.sum("n").alias("n"), F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("p"))
    joined = F.aggregate("p.ids", F.lit("").cast("binary"), lambda a, b: F.concat(a, b))
    return whole.unionByName(cut.select("id", "start", "n", joined.alias("ids"))).withColumnRenamed("id", id_col)
