"""Stems through a vocabulary: distinct words once, their stems once, and back into the texts' arrays.

The steps of the stemmer run once per distinct word, in Arrow batches, whatever the number of rows. Texts are named by a hash and tokenised once however many rows have them. Most words are their own stem and are in no
join; of the others the most common go out as a broadcast of bounded size.
"""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from convolens.functions.rouge import token_sentences
from convolens.functions.stemmer import stem
from convolens.operators.joins import join_by_weight
from convolens.session import keep


def vocabulary(words: DataFrame) -> DataFrame:
    """word, stem, n for each distinct `word`: n counts its rows."""

    @F.pandas_udf("string")
    def stems(word: pd.Series) -> pd.Series:
        return word.map(stem)

    return keep(words.groupBy("word").agg(F.count("*").alias("n")).withColumn("stem", stems("word")))


def _name(text: Column) -> Column:
    return F.md5(F.coalesce(text, F.lit("")).cast("binary"))


def stemmed_sentences(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """`rows` with each text of `columns` turned into its sentences, as arrays of stems; null texts have none."""
    texts = rows.select(F.explode(F.array(*columns)).alias("text")).where("text IS NOT NULL")
    texts = texts.groupBy(_name(F.col("text")).alias("k")).agg(F.first("text").alias("text"))
    places = texts.select("k", F.posexplode(token_sentences(F.col("text"))).alias("s", "tokens"))
    places = keep(places.select("k", "s", F.posexplode("tokens").alias("i", "word")))
    found = vocabulary(places.where(F.length("word") > 3).select("word")).where("stem <> word")
    joined = join_by_weight(places, found, ["word"], "n", places.count())
    token = F.struct("i", F.coalesce("stem", "word").alias("t"))
    # Rows of a text are together after one shuffle, which both groupings use.
    sents = joined.repartition("k").groupBy("k", "s").agg(F.sort_array(F.collect_list(token))["t"].alias("t"))
    whole = sents.groupBy("k").agg(F.sort_array(F.collect_list(F.struct("s", "t")))["t"].alias("sents"))
    out = rows.withColumns({f"__{c}": _name(F.col(c)) for c in columns})
    for c in columns:
        out = out.join(whole.select(F.col("k").alias(f"__{c}"), F.col("sents").alias(f"__{c}_sents")), f"__{c}", "left")
    empty = F.array().cast("array<array<string>>")
    return out.select(*[F.coalesce(f"__{c}_sents", empty).alias(c) if c in columns else F.col(c) for c in rows.columns])
