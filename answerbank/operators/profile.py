"""Table profile (A1-A4): counts, missing cells, duplicates, word-length stats, value counts.

One aggregate per split; nothing is collected. Duplicate rows count every
repeat of a full row (nulls compare equal), as the pandas profile does.
Percentiles are exact and interpolated (``percentile``), which keeps a count
per distinct word length, not the values themselves.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from answerbank.functions.text import word_count


def profile(df: DataFrame, question: str, answer: str | None = None, split_col: str | None = None) -> DataFrame:
    """A1/A2/A4: one row per split (or one row) with rows, columns, missing cells, duplicates, word stats."""
    keys = [split_col] if split_col else []
    cols = df.columns
    missing = sum((F.col(c).isNull().cast("long") for c in cols), F.lit(0).cast("long"))
    rows = df.select(
        *[F.col(c) for c in cols if c not in keys],
        *keys,
        missing.alias("__missing"),
        word_count(question).alias("__qw"),
        *([word_count(answer).alias("__aw")] if answer else []),
    )
    aggs = [
        F.count("*").alias("rows"),
        F.lit(len(cols)).alias("columns"),
        F.sum("__missing").alias("missing_cells"),
        F.round(F.coalesce(F.avg("__qw"), F.lit(0.0)), 6).alias("question_words_mean"),
        F.round(F.coalesce(F.percentile("__qw", 0.95), F.lit(0.0)), 6).alias("question_words_p95"),
    ]
    if answer:
        aggs += [
            F.round(F.coalesce(F.avg("__aw"), F.lit(0.0)), 6).alias("answer_words_mean"),
            F.round(F.coalesce(F.percentile("__aw", 0.95), F.lit(0.0)), 6).alias("answer_words_p95"),
        ]
    # duplicates = rows - distinct full rows (a struct of all columns; nulls compare equal)
    rows = rows.withColumn("__row", F.struct(*[F.col(f"`{c}`") for c in cols]))
    aggs.append((F.count("*") - F.countDistinct("__row")).alias("duplicate_rows"))
    return rows.groupBy(*keys).agg(*aggs)


def value_counts(df: DataFrame, col: str, name: str = "value") -> DataFrame:
    """A3: counts per value, null as ``UNKNOWN``."""
    return df.groupBy(F.coalesce(F.col(col).cast("string"), F.lit("UNKNOWN")).alias(name)).agg(
        F.count("*").alias("count")
    )
