"""Fixed-size token chunks and label masks, on arrays of token ids."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from convolens.functions.text import let

CHUNK_TOKENS = 512
MAX_CHUNKS = 32
IGNORED = -100


def _pass(prefix: Column, tokens: Column, width: Column, n_chunks: int, pad: bool, pad_id: int) -> Column:
    """One pass over the tokens: chunks of prefix plus `width` tokens, as `{ids, mask}`."""
    have = F.size(tokens)
    # Chunks with tokens; behind them come chunks of padding alone, which are all one.
    used = F.ceil(have / width).cast("int")
    blank = F.lit(n_chunks) - used if pad else F.lit(0)

    def chunk(part: Column) -> Column:
        fill = width - F.size(part)
        return F.struct(
            F.concat(prefix, part, F.array_repeat(F.lit(pad_id), fill)).alias("ids"),
            F.concat(F.array_repeat(F.lit(1), F.size(prefix) + F.size(part)), F.array_repeat(F.lit(0), fill)).alias("mask"),
        )

    none = F.array().cast("array<struct<ids: array<int>, mask: array<int>>>")
    cut = F.transform(F.sequence(F.lit(0), used - 1), lambda k: let(F.slice(tokens, k * width + 1, width), chunk))
    full = F.when(used == 0, none).otherwise(cut)
    return F.concat(full, F.array_repeat(chunk(F.array().cast("array<int>")), blank))


def chunk_tokens(
    prefix: Column,
    tokens: Column,
    chunk: int = CHUNK_TOKENS,
    max_chunks: int = MAX_CHUNKS,
    stride: bool = True,
    pad: bool = True,
    pad_id: int = 1,
) -> Column:
    """The prefix in front of every chunk; with `stride` a second pass starts half a chunk later.

    Tokens behind the last chunk are cut off. Without padding to the full number of chunks only
    the last chunk of a pass is filled up.
    """

    def both(p: Column) -> Column:
        width = F.lit(chunk) - F.size(p)

        def passes(t: Column) -> Column:
            first = _pass(p, t, width, max_chunks, pad, pad_id)
            if not (stride and max_chunks > 1):
                return first
            half = F.floor(width / 2).cast("int")
            later = F.slice(t, half + 1, F.lit(max_chunks - 1) * width)
            return F.concat(first, let(later, lambda x: _pass(p, x, width, max_chunks - 1, pad, pad_id)))

        return let(F.slice(tokens, F.lit(1), F.lit(max_chunks) * width), passes)

    return let(F.slice(prefix, F.lit(1), F.lit(chunk)), both)


def masked_example(prompt: Column, response: Column, max_len: int) -> Column:
    """Token ids of prompt and response with labels on the response only, cut to a length."""
    ids = F.slice(F.concat(prompt, response), F.lit(1), F.lit(max_len))
    labels = F.slice(F.concat(F.array_repeat(F.lit(IGNORED), F.size(prompt)), response), F.lit(1), F.lit(max_len))
    return F.struct(ids.alias("input_ids"), labels.alias("labels"))


def padded_batches(examples: DataFrame, batch: Sequence[str], pad_id: int) -> DataFrame:
    """Pad `input_ids, labels` to the longest example of each batch, with an attention mask."""
    longest = examples.groupBy(*batch).agg(F.max(F.size("input_ids")).alias("__n"))
    fill = F.col("__n") - F.size("input_ids")
    return (
        examples.join(longest, list(batch))
        .withColumn("attention_mask", F.concat(F.array_repeat(F.lit(1), F.size("input_ids")), F.array_repeat(F.lit(0), fill)))
        .withColumn("labels", F.concat("labels", F.array_repeat(F.lit(IGNORED), fill)))
        .withColumn("input_ids", F.concat("input_ids", F.array_repeat(F.lit(pad_id), fill)))
        .drop("__n")
    )
