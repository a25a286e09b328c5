"""Helpers of the operators: the shared folder, staged tables, and batches of texts as arrays."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Texts are taken through numpy in pieces of about this many symbols.
PIECE = 1 << 18


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as spark.checkpoint.dir names it.

    A local master shares its own temporary folder; any other needs the setting.
    """
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or _LOCAL.get(sc.applicationId)
    if not named:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        named = _LOCAL[sc.applicationId] = "file://" + tempfile.mkdtemp(prefix="convolens-shared-")
    return named.rstrip("/")


#: Temporary folders of local sessions, by application.
_LOCAL: dict[str, str] = {}


#: Lists that get the paths made while they are watched.
_WATCHED: list[list[str]] = []


@contextmanager
def watched(paths: list[str]) -> Iterator[None]:
    """Paths made inside are added to the list."""
    _WATCHED.append(paths)
    try:
        yield
    finally:
        _WATCHED.remove(paths)


def delete(spark: SparkSession, paths: list[str], but_for: DataFrame) -> None:
    """Delete these folders, but for those that a table reads, and empty the list."""
    read = {f.rsplit("/", 1)[0].rsplit("/", 1)[-1] for f in but_for.inputFiles()}
    for path in paths:
        if path.rsplit("/", 1)[-1] not in read:
            hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)
    paths.clear()


def new_path(spark: SparkSession, name: str) -> str:
    """A path of its own in the shared folder; it goes when the application ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    for paths in _WATCHED:
        paths.append(path)
    jvm = spark.sparkContext._jvm
    hadoop = jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    return path


def _collect(spark: SparkSession) -> None:
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def staged(df: DataFrame, name: str) -> DataFrame:
    """The table, written to the shared folder and read from there: lost executors cost no step twice.

    Shuffle files of earlier steps go when the driver drops their plans, which a collection there hastens.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    _collect(spark)
    df.write.parquet(path, compression="zstd")
    return spark.read.schema(df.schema).parquet(path)


def small_batches(df: DataFrame) -> None:
    """Whole texts go to Python a thousand at a time, so that a worker holds a few megabytes of them."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")


def discard(*tables: DataFrame) -> None:
    """Delete staged tables that no frame reads any more."""
    for df in tables:
        spark = df.sparkSession
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


#: Bits for the keys of `hits`: a table of at most a 64th as many rows, so it can be broadcast.
SLOTS = 1 << 24


def hits(df: DataFrame, key: str, keys: DataFrame) -> DataFrame:
    """`df` with a column `hit`, false only where `key` is none of those in `keys`, a table with that column too.

    Each key sets one bit by its hash. So rows that a join by key would not meet are told before they are shuffled, nearly
    all of them while there are fewer keys than bits, and fewer after that; a row with a hit still has to be joined.
    """
    bit = F.xxhash64(key).bitwiseAND(SLOTS - 1)
    place = [F.shiftright(bit, 6).alias("_word"), F.call_function("shiftleft", F.lit(1).cast("long"), bit.bitwiseAND(63).cast("int")).alias("_bit")]
    table = keys.select(*place).groupBy("_word").agg(F.bit_or("_bit").alias("_bits"))
    hit = F.coalesce(F.col("_bit").bitwiseAND(F.col("_bits")) != 0, F.lit(False))
    return df.select("*", *place).join(F.broadcast(table), "_word", "left").select(*df.columns, hit.alias("hit"))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def mix(x: np.ndarray) -> np.ndarray:
    """Every bit of each 64-bit number depends on all of its bits (splitmix64's finalizer)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def numbers(seed: int, n: int) -> np.ndarray:
    return mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed))


BYTE = numbers(11, 256)
_BASE = int(numbers(5, 1)[0]) | 1
_POWERS: dict[tuple[int, int], np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1), modulo 2 ** 64."""
    have = _POWERS.get((base, 0))
    if have is None or len(have) < n:
        size = 1 << max(10, (n - 1).bit_length())
        have = np.empty(size, np.uint64)
        have[0] = 1
        done = 1
        while done < size:
            have[done : 2 * done] = have[:done] * np.uint64(pow(base, done, 1 << 64))
            done *= 2
        _POWERS[base, 0] = have
    return have[:n]


_HELD: list[Callable[[], None]] = [_POWERS.clear]


def held(clear: Callable[[], None]) -> None:
    """Register what a worker remembers between tasks, so that `forget` can drop it."""
    _HELD.append(clear)


def forget() -> None:
    """Drop what tasks of other operators left in this worker."""
    for clear in _HELD:
        clear()


class Prefix:
    """Polynomial hashes of all substrings of an array of 64-bit symbols, after one pass."""

    def __init__(self, symbols: np.ndarray, seed: int):
        base = int(numbers(seed, 1)[0]) | 1
        n = len(symbols)
        self.back = powers(pow(base, -1, 1 << 64), n + 1)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(symbols * powers(base, n), out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.back[start])


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts behind one another, and where each begins (one more at the end); null is empty."""
    column = column.cast(pa.large_string()).fill_null("") if column.type != pa.large_string() else column.fill_null("")
    offsets = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8)
    if column.buffers()[2] is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    data = np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of each run of other than ASCII white space, and each text's first word (one more at the end)."""
    inside = ~_SPACE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    first = inside.copy()
    first[1:] &= ~inside[:-1] | edge[1 : len(data)]
    last = inside.copy()
    last[:-1] &= ~inside[1:] | edge[1 : len(data)]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = False) -> np.ndarray:
    """A 64-bit hash of each word."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    lengths = ends - starts
    total = int(lengths.sum())
    begin = np.cumsum(lengths) - lengths
    at = np.arange(total) - np.repeat(begin, lengths)
    letters = data[np.repeat(starts, lengths) + at]
    values = BYTE[_LOWER[letters]] if lower else BYTE[letters]
    return mix(np.add.reduceat(values * powers(_BASE, int(lengths.max()))[at], begin) + lengths.astype(np.uint64))


def pieces(offsets: np.ndarray, size: int = PIECE) -> Iterator[tuple[int, int]]:
    """Ranges of texts with about `size` symbols in each."""
    first, n = 0, len(offsets) - 1
    while first < n:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + size, side="right")) - 1)
        yield first, last
        first = last


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def positive(name: str, value: int) -> int:
    if value < 1:
        raise ValueError(f"{name} must be at least 1")
    return value


def kept_rows(docs: DataFrame, text_col: str, start: Callable[[], Callable[[pa.Array], np.ndarray]]) -> DataFrame:
    """Rows whose text the flags of `start()` keep, with all their columns, in one pass; it is called once per task."""
    at = docs.columns.index(text_col)
    small_batches(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        flags = start()
        for batch in batches:
            yield batch.filter(pa.array(flags(batch.column(at)), pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
