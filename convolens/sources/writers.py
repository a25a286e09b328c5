"""Write tables, and render the small reports that people read."""

from __future__ import annotations

import html
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

def write_jsonl(df: DataFrame, path: str, mode: str = "error") -> None:
    """JSON lines, UTF-8, one file per task."""
    df.write.mode(mode).json(path)


def write_row(row: DataFrame, path: str, mode: str = "overwrite") -> None:
    """A one-row table as one JSON file, null fields kept."""
    row.coalesce(1).write.mode(mode).option("ignoreNullFields", "false").json(path)


def number_text(value: Column, places: int, scale: float = 1.0, signed: bool = False) -> Column:
    """A number at fixed places, blank where it was not measured.

    Printed by Python, which rounds the stored binary value; the JVM would round its decimal form.
    """
    sign = "+" if signed else ""

    @F.pandas_udf("string")
    def shown(values: pd.Series) -> pd.Series:
        return values.map(lambda v: "" if pd.isna(v) else format(v * scale, f"{sign}.{places}f"))

    return shown(value.cast("double"))


def chart_rows(rows: DataFrame) -> DataFrame:
    """Score rows as display strings, by split and then the best ROUGE-1 first."""
    return rows.orderBy("split", F.desc("rouge1")).select(
        "run_id",
        "split",
        F.col("n").cast("string").alias("n"),
        *[number_text(F.col(c), 3).alias(c) for c in ("rouge1", "rouge2", "rougeLsum", "bertscore_f1")],
        number_text(F.col("cost_usd_total"), 2).alias("cost_usd"),
        number_text(F.col("latency_s_mean"), 1).alias("s_per_query"),
        number_text(F.col("peak_vram_gb_max"), 2).alias("peak_gb"),
    )


def index_rows(records: DataFrame) -> DataFrame:
    """Interval records as display strings; ROUGE is shown in points."""
    points = F.col("metric").startswith("rouge")

    def shown(c: str) -> Column:
        return F.when(points, number_text(F.col(c), 2, 100.0, True)).otherwise(number_text(F.col(c), 4, 1.0, True))

    return records.orderBy("metric", F.desc("observed_diff")).select(
        "metric",
        F.coalesce("resampling_unit", F.lit("query")).alias("resampling"),
        F.col("a.run_id").alias("a"),
        F.col("b.run_id").alias("b"),
        shown("observed_diff").alias("diff"),
        F.concat(F.lit("["), shown("ci95_low"), F.lit(", "), shown("ci95_high"), F.lit("]")).alias("interval"),
        F.when(F.col("crosses_zero"), "crosses zero").otherwise("excludes zero").alias("verdict"),
    )


def markdown_lines(df: DataFrame) -> DataFrame:
    """Each row as a line of a Markdown table, in the order of `df`; NULL shows as a blank."""
    cell = lambda c: F.regexp_replace(F.replace(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")), F.lit("|"), F.lit("\\|")), "\n", " ")
    return df.select(F.concat(F.lit("| "), F.concat_ws(" | ", *[cell(c) for c in df.columns]), F.lit(" |")).alias("value"))


def _frame(df: DataFrame, title: str | None, notes: Sequence[str]) -> tuple[list[str], list[str]]:
    head = [f"# {title}", ""] if title else []
    head += ["| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns)]
    return head, ["", *[f"- {n}" for n in notes]] if notes else []


def markdown(df: DataFrame, title: str | None = None, notes: Sequence[str] = ()) -> str:
    """A report for reading as one text. `write_markdown` writes tables of any length."""
    head, tail = _frame(df, title, notes)
    return "\n".join([*head, *[r.value for r in markdown_lines(df).collect()], *tail]) + "\n"


def write_markdown(df: DataFrame, path: str, title: str | None = None, notes: Sequence[str] = (), mode: str = "overwrite") -> None:
    """The same as text files, whose parts in order are the report; only its frame is the driver's."""
    head, tail = _frame(df, title, notes)
    text = lambda lines: df.sparkSession.createDataFrame([("\n".join(lines),)], "value string").coalesce(1)
    parts = text(head).unionByName(markdown_lines(df))
    (parts.unionByName(text(tail)) if tail else parts).write.mode(mode).text(path)


def bar_chart(df: DataFrame, label: str, value: str, title: str) -> str:
    """Horizontal bars as SVG, the longest first; the same rows always give the same text."""
    rows = [(r[0], r[1]) for r in df.where(F.col(value).isNotNull()).select(label, value).collect()]
    rows.sort(key=lambda r: (-r[1], r[0]))
    top = max((v for _, v in rows), default=1.0) or 1.0
    height = 40 + 24 * len(rows)
    out = [
        f'<svg xmlns="http://www.w3.org/2000/svg" width="760" height="{height}" font-family="sans-serif" font-size="12">',
        f'<text x="8" y="20" font-size="14">{html.escape(title)}</text>',
    ]
    for k, (name, v) in enumerate(rows):
        y = 36 + 24 * k
        out.append(f'<text x="8" y="{y + 12}">{html.escape(str(name))}</text>')
        out.append(f'<rect x="300" y="{y}" width="{380 * v / top:.1f}" height="16" fill="#4477aa"/>')
        out.append(f'<text x="{304 + 380 * v / top:.1f}" y="{y + 12}">{v:.4f}</text>')
    return "\n".join([*out, "</svg>"]) + "\n"


def merge_reports(old: Column, new: Column) -> Column:
    """Two maps in one: the new entry wins, entries of others stay."""
    kept = F.map_filter(old, lambda k, v: ~F.array_contains(F.map_keys(new), k))
    return F.map_concat(kept, new)
