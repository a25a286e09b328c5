"""Text expressions. Everything here stays inside the JVM: no Python worker is started."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from convolens import protocol

# The white space that separates words: the full Unicode set plus the four ASCII separators.
WS_CLASS = r"[\s\x1c-\x1f\x85\p{Z}]"
WS = WS_CLASS + "+"
_EDGE_WS = rf"\A{WS}|{WS}\z"
_SENTENCE_GAP = rf"(?<=[.!?]){WS}"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate `value` once per row and use it several times, also inside lambdas."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words(text: Column) -> Column:
    """White-space separated words, never an empty one."""
    return F.filter(F.split(text, WS), lambda w: w != "")


def word_count(text: Column) -> Column:
    return F.size(words(text))


def strip(text: Column) -> Column:
    return F.regexp_replace(text, _EDGE_WS, "")


def flatten_ws(text: Column) -> Column:
    return F.array_join(words(text), " ")


def truncate_words(text: Column, budget: Column | int) -> Column:
    """The text itself within the budget, else its first words joined by single spaces."""
    limit = budget if isinstance(budget, Column) else F.lit(budget)
    return let(
        words(text),
        lambda w: F.when(F.size(w) <= limit, text).otherwise(F.array_join(F.slice(w, F.lit(1), limit), " ")),
    )


def alnum_tokens(text: Column) -> Column:
    """Lower-case ASCII letter and digit runs; NULL gives no tokens."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0))


def unicode_words(text: Column) -> Column:
    """Lower-case runs of letters, numbers, underscores and apostrophes in any script."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}_']+"), F.lit(0))


def scoring_lines(text: Column) -> Column:
    """One sentence per line; existing line breaks are flattened first."""
    return F.regexp_replace(flatten_ws(F.coalesce(text, F.lit(""))), "([.!?]) ", "$1\n")


def sentences(text: Column, trim_parts: bool = True) -> Column:
    """Sentences of the text as it is laid out, without flattening."""
    parts = F.split(strip(text), _SENTENCE_GAP)
    if trim_parts:
        parts = F.transform(parts, strip)
    return F.filter(parts, lambda s: s != "")


def ngrams(tokens: Column, n: int) -> Column:
    return let(
        tokens,
        lambda t: F.when(F.size(t) < n, F.array().cast("array<string>")).otherwise(
            F.transform(
                F.sequence(F.lit(1), F.greatest(F.size(t) - (n - 1), F.lit(1))),
                lambda i: F.array_join(F.slice(t, i, F.lit(n)), " "),
            )
        ),
    )


def self_repeat(text: Column, n: int = 4) -> Column:
    """Share of n-grams that occurred earlier in the same text; 0 when there is none."""
    return let(
        ngrams(unicode_words(text), n),
        lambda g: F.when(F.size(g) == 0, F.lit(0.0)).otherwise(
            (F.size(g) - F.size(F.array_distinct(g))) / F.size(g)
        ),
    )


def type_token_ratio(text: Column) -> Column:
    return let(
        unicode_words(text),
        lambda w: F.when(F.size(w) == 0, F.lit(0.0)).otherwise(F.size(F.array_distinct(w)) / F.size(w)),
    )


def speaker_line(speaker: Column, text: Column) -> Column:
    return F.concat(speaker, F.lit(": "), text)


def format_transcript(utterances: Column) -> Column:
    """Render an utterance array that is already one value of a row."""
    return F.array_join(F.transform(utterances, lambda u: speaker_line(u["speaker"], u["text"])), "\n")


def summary_prompt(query: Column, transcript: Column) -> Column:
    return F.concat(
        F.lit(protocol.PROMPT_HEAD), query, F.lit(protocol.PROMPT_MIDDLE), transcript, F.lit(protocol.PROMPT_TAIL)
    )


def seq2seq_input(query: Column, transcript: Column) -> Column:
    return F.concat(query, F.lit(" </s> "), transcript)


def estimate_tokens(prompt: Column) -> Column:
    return F.length(prompt) / F.lit(protocol.CHARS_PER_TOKEN) + F.lit(float(protocol.MAX_NEW_TOKENS))


def has_leaked_tag(text: Column) -> Column:
    """Reasoning or system tags that should never reach an answer."""
    # Fixed tag names.
    return F.coalesce(text, F.lit("")).rlike(r"(?i)</?(thinking|antml|internal|scratchpad)\b")


def clock(seconds: Column) -> Column:
    """Seconds as `01h 02m 03s`; whole days are dropped, as on a clock."""
    s = F.floor(seconds).cast("bigint")
    return F.format_string("%02dh %02dm %02ds", F.floor(s / 3600) % 24, F.floor(s % 3600 / 60), s % 60)
