"""Read judge replies: verdict lines, JSON blocks, fact markings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from convolens import schemas
from convolens.functions.text import let, strip

_LINE_END = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"


def parse_verdict(text: Column) -> Column:
    """What the last `VERDICT:` line says, in upper case; UNPARSED without one."""
    lines = F.transform(F.split(strip(F.coalesce(text, F.lit(""))), _LINE_END), strip)
    found = F.filter(lines, lambda s: s.startswith("VERDICT:"))
    return let(
        found,
        lambda v: F.when(F.size(v) == 0, F.lit("UNPARSED")).otherwise(
            F.upper(strip(F.substring(F.get(v, F.size(v) - 1), 9, 2**31 - 1)))
        ),
    )


def winner(verdict: Column, swap: Column, strict: bool = False) -> Column:
    """Who a verdict names once the swap is undone.

    As the protocol has it, any text that is not A, TIE or UNPARSED counts like B.
    With `strict` such a text names nobody.
    """
    out = F.when(verdict == "UNPARSED", F.lit(None).cast("string"))
    if strict:
        out = out.when(~verdict.isin("A", "B", "TIE"), F.lit(None).cast("string"))
    return out.when(verdict == "TIE", "tie").when((verdict == "A") != swap, "a").otherwise("b")


def json_block(text: Column) -> Column:
    """From the first brace to the last, when that is a JSON object; else NULL."""
    block = F.nullif(F.regexp_extract(F.coalesce(text, F.lit("")), r"(?s)\{.*\}", 0), F.lit(""))
    return F.when(F.try_parse_json(block).isNotNull(), block)


def marking(text: Column) -> Column:
    """The three lists of a marking reply as a struct; NULL when the reply does not parse."""
    return let(
        json_block(text),
        lambda b: F.when(b.isNotNull(), F.from_json(b, schemas.MARKING)),
    )


def fact_list(text: Column) -> Column:
    """The facts of an extraction reply; NULL when there are none."""
    facts = F.from_json(json_block(text), "facts array<string>")["facts"]
    return F.when(F.size(facts) > 0, facts)


def numbers_in_range(items: Column, top: Column) -> Column:
    """Distinct whole numbers of 1..top; digit strings count, anything else does not."""
    clean = F.transform(F.coalesce(items, F.array().cast("array<string>")), lambda x: strip(x))
    digits = F.filter(clean, lambda x: x.rlike(r"\A-*[0-9]+\z"))
    as_int = F.transform(digits, lambda x: x.try_cast("int"))
    return F.array_distinct(F.filter(as_int, lambda x: x.between(F.lit(1), top)))


def score_marking(mark: Column, n_facts: Column) -> Column:
    """Counts, recall and precision of one marking.

    Without claims the precision is NULL: nothing was verified. A marking is incoherent when it
    credits facts yet supports none of the claims.
    """
    claims = F.coalesce(F.size(mark["summary_claims"]), F.lit(0))
    counts = F.struct(
        n_facts.cast("int").alias("n_facts"),
        F.size(numbers_in_range(mark["covered_fact_numbers"], n_facts)).alias("n_covered"),
        claims.alias("n_claims"),
        F.size(numbers_in_range(mark["unsupported_claim_numbers"], claims)).alias("n_unsupported"),
    )
    return let(
        counts,
        lambda c: F.struct(
            c["n_facts"].alias("n_facts"),
            c["n_covered"].alias("n_covered"),
            c["n_claims"].alias("n_claims"),
            c["n_unsupported"].alias("n_unsupported"),
            ((c["n_covered"] > 0) & (c["n_claims"] > 0) & (c["n_claims"] == c["n_unsupported"])).alias("incoherent"),
            F.when(c["n_facts"] > 0, c["n_covered"] / c["n_facts"]).alias("recall"),
            F.when(c["n_claims"] > 0, (c["n_claims"] - c["n_unsupported"]) / c["n_claims"]).alias("precision"),
        ),
    )


def f1_of_means(precision: Column, recall: Column) -> Column:
    """F of two aggregates; NULL where it cannot be computed."""
    return F.when(precision + recall != 0, 2 * precision * recall / (precision + recall))


def per_query_f1(precision: Column, recall: Column) -> Column:
    """F of one query: a failure is 0, and only an unmeasured recall is NULL."""
    return F.when(recall.isNull(), F.lit(None).cast("double")).otherwise(
        F.coalesce(f1_of_means(precision, recall), F.lit(0.0))
    )


def claims_at(claims: Column, positions: Column) -> Column:
    """Claims by 1-based position, positions out of range left out."""
    return F.transform(
        F.filter(positions, lambda i: i.between(F.lit(1), F.size(claims))), lambda i: F.get(claims, i - 1)
    )
