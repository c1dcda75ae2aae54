"""Deterministic row selection.

Random sampling is replaced by an order on ``md5(seed:id)``: the same seed
gives the same rows on any cluster and in the SQL oracle. Per-group limits use
``row_number() <= n`` with a literal ``n`` so Spark plans a partial
``WindowGroupLimit`` before the shuffle (a hot group sends at most ``n`` rows
per input partition).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def hash_key(id_col: str, seed: int) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(id_col).cast("string")))


def first_n_per_group(df: DataFrame, group_col: str, n: int, order_col: str = "pos") -> DataFrame:
    """The first ``n`` rows of each group in source order."""
    w = Window.partitionBy(group_col).orderBy(order_col)
    return df.withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= n).drop("__r")


def seeded_sample(df: DataFrame, n: int, seed: int, id_col: str = "id") -> DataFrame:
    """``n`` rows chosen by the seeded hash order (all rows when ``n`` >= rows)."""
    return df.withColumn("__h", hash_key(id_col, seed)).orderBy("__h").limit(n).drop("__h")


def stratified_cap(df: DataFrame, group_col: str | None, max_rows: int, seed: int, id_col: str = "id") -> DataFrame:
    """``ceil(max_rows / groups)`` rows per group (at least 1), then at most ``max_rows`` overall."""
    if group_col is None or group_col not in df.columns:
        return seeded_sample(df, max_rows, seed, id_col)
    if df.limit(max_rows + 1).count() <= max_rows:
        return df
    groups = df.select(group_col).distinct().count()
    per_group = max(1, -(-max_rows // max(groups, 1)))
    h = df.withColumn("__h", hash_key(id_col, seed))
    w = Window.partitionBy(group_col).orderBy("__h")
    picked = h.withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= per_group).drop("__r")
    return picked.orderBy("__h").limit(max_rows).drop("__h")


def first_rows(df: DataFrame, n: int, order_col: str = "pos") -> DataFrame:
    """The first ``n`` rows in source order (never a bare ``limit``)."""
    return df.orderBy(order_col).limit(n)
