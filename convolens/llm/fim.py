"""Fill-in-middle by rotation in place: a text's middle goes to its end, and back.

Two seeded cuts make a text prefix, middle and suffix. Sentinels are put in front of the parts in one bytearray, which
then reads P prefix M middle S suffix, and neighbouring segments change places by three reversals, without a second
copy of the text. For psm the last two segments are exchanged, for spm the first two with the last. `restore` finds
the sentinels, exchanges the same segments back and takes the sentinels out.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from convolens.llm import common as C

#: In front of prefix, suffix and middle.
SENTINELS = ("<P>", "<S>", "<M>")
_BLOCK = 1 << 16


def reverse(data: np.ndarray, a: int, b: int) -> None:
    """Reverse data[a:b] where it lies, a block from either end at a time."""
    while b - a > 1:
        k = min(_BLOCK, (b - a) // 2)
        head = data[a : a + k][::-1].copy()
        data[a : a + k] = data[b - k : b][::-1]
        data[b - k : b] = head
        a, b = a + k, b - k


def exchange(data: np.ndarray, a: int, m: int, b: int) -> None:
    """data[a:m] and data[m:b] change places."""
    reverse(data, a, m)
    reverse(data, m, b)
    reverse(data, a, b)


def byte_of(data: np.ndarray, k: int) -> int:
    """Where code point k of UTF-8 begins, or where the text ends if it has k of them."""
    seen = 0
    for at in range(0, len(data), _BLOCK):
        starts = (data[at : at + _BLOCK] & 0xC0) != 0x80
        n = int(np.count_nonzero(starts))
        if seen + n > k:
            return at + int(np.flatnonzero(starts)[k - seen])
        seen += n
    return len(data)


def rotated(text: bytes, form: str, first: int, last: int, marks: Sequence[bytes]) -> bytes:
    """The text with its middle, code points first to last, moved behind prefix and suffix; `plain` as it is."""
    if form == "plain":
        return text
    pre, suf, mid = marks
    data = np.frombuffer(text, np.uint8)
    a, b = byte_of(data, first), byte_of(data, last)
    buf = bytearray(text)
    buf[b:b] = suf
    buf[a:a] = mid
    buf[0:0] = pre
    a, b = a + len(pre), b + len(pre) + len(mid)
    data = np.frombuffer(buf, np.uint8)
    exchange(data, a if form == "psm" else 0, b, len(buf))
    return bytes(buf)


def restored(out: bytes, form: str, marks: Sequence[bytes]) -> bytes:
    """The text that `rotated` gave `out` for, from it and its form alone."""
    if form == "plain":
        return out
    pre, suf, mid = marks
    buf = bytearray(out)
    if form == "psm":
        a = buf.index(suf, len(pre))
        moved = buf.index(mid, a + len(suf))
    else:
        a, moved = 0, buf.index(pre, len(suf))
    exchange(np.frombuffer(buf, np.uint8), a, moved, len(buf))
    # P prefix M middle S suffix again; S begins where as much as lay in front of the moved part is left.
    b = len(buf) - (moved - a)
    del buf[b : b + len(suf)]
    m = buf.index(mid, len(pre)) if form == "spm" else a
    del buf[m : m + len(mid)]
    del buf[: len(pre)]
    return bytes(buf)


def _marks(sentinels: Sequence[str]) -> list[bytes]:
    marks = [s.encode() for s in sentinels]
    heads = {m[:1] for m in marks}
    if len(marks) != 3 or len(set(marks)) != 3 or not all(marks) or any(h in m[1:] for m in marks for h in heads):
        raise ValueError("three different sentinels are needed, and none may hold the first byte of one further in")
    return marks


def _mapped(df: DataFrame, inputs: Sequence[str], name: str, fn) -> DataFrame:
    """df with the string `name` from fn(first input as bytes, the others), the first input left out."""
    C.small_batches(df)
    kept = [c for c in df.columns if c != inputs[0]]
    at = [df.columns.index(c) for c in inputs]
    where = [df.columns.index(c) for c in kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        C.forget()
        for batch in batches:
            data, offsets = C.text_bytes(batch.column(at[0]))
            others = [batch.column(k).to_pylist() for k in at[1:]]
            for a, b in C.pieces(offsets, 16 * C.PIECE):
                out = [fn(data[offsets[i] : offsets[i + 1]].tobytes(), *[o[i] for o in others]) for i in range(a, b)]
                yield pa.RecordBatch.from_arrays(
                    [*[batch.column(k).slice(a, b - a) for k in where], pa.array(out, pa.binary()).cast(pa.string())], names=[*kept, name]
                )

    return df.mapInArrow(run, df.select(*kept, F.lit("").alias(name)).schema)


def draws(seed: int, id_col: str) -> list[Column]:
    """Four numbers below 2^32 for each id: the first 32 hexadecimal digits of a hash of seed and id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 1 + 8 * k, 8), 16, 10).cast("long") for k in range(4)]


def transform(
    docs: DataFrame, seed: int = 1, plain_percent: int = 10, spm_percent: int = 20, sentinels: Sequence[str] = SENTINELS,
    id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """One row per row of `docs`: id_col, n, form, prefix_chars, middle_chars, output.

    n counts code points; both cuts lie anywhere from 0 to n, so parts may be empty. `plain_percent` of the ids stay
    plain, as do empty texts, nulls (taken as empty) and texts with a sentinel in them; `spm_percent` of the others
    are spm, the rest psm. Plain rows have null counts. A null id draws like an empty one, rows of one id draw
    alike, and an empty table gives none. Other columns are not looked at.
    """
    _marks(sentinels)
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), F.array(*draws(seed, id_col)).alias("h"))
    n = F.length("text").cast("long")
    cut = lambda k: F.col("h")[k] % (n + 1)
    plain = (F.col("text") == "") | (F.col("h")[2] % 100 >= 100 - plain_percent)
    for s in sentinels:
        plain = plain | F.contains("text", F.lit(s))
    form = F.when(plain, "plain").when(F.col("h")[3] % 100 < spm_percent, "spm").otherwise("psm")
    rows = rows.select("id", "text", n.alias("n"), form.alias("form"), F.least(cut(0), cut(1)).alias("first"), F.greatest(cut(0), cut(1)).alias("last"))
    marks = _marks(sentinels)
    out = _mapped(rows, ["text", "form", "first", "last"], "output", lambda text, form, first, last: rotated(text, form, first, last, marks))
    cuts = F.col("form") != "plain"
    return out.select(
        F.col("id").alias(id_col), "n", "form", F.when(cuts, F.col("first")).alias("prefix_chars"),
        F.when(cuts, F.col("last") - F.col("first")).alias("middle_chars"), "output",
    )


def restore(rows: DataFrame, sentinels: Sequence[str] = SENTINELS, output_col: str = "output", form_col: str = "form") -> DataFrame:
    """`rows` with the column `restored` in place of the output: the exact text, from output and form alone. A null output is empty."""
    marks = _marks(sentinels)
    return _mapped(rows, [output_col, form_col], "restored", lambda out, form: restored(out, form, marks))
