"""Resumable per-ID processing.

The reference has no stream operators; its only incremental behaviour is a
results cache that is appended row by row and skipped on restart. Here the
cache is a folder of batches with a commit manifest:

* ``<path>/batches/commit=<n>``: the rows of batch ``n`` (Parquet);
* ``<path>/commits``: one row ``(commit, rows)`` per finished batch, written after the batch.

Readers see committed batches only, so a batch that broke off half-way counts
for nothing: its IDs stay pending, and the next batch takes the same number and
replaces what was left there. One job writes a cache at a time. An ID that was
done twice is read through ``latest_per_id``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

COMMITS = "commit int, rows long"


def _read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The table at ``path`` (empty when it does not exist yet)."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as exc:
        if exc.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def read_commits(spark: SparkSession, path: str) -> DataFrame:
    """``commit, rows`` of every committed batch."""
    return _read(spark, f"{path}/commits", COMMITS)


def read_done(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The rows of all committed batches with the number of their ``commit`` (``schema``: the columns of a batch)."""
    return _read(spark, f"{path}/batches", f"{schema}, commit int").join(read_commits(spark, path), "commit", "left_semi")


def pending(requests: DataFrame, done: DataFrame, id_col: str = "ID") -> DataFrame:
    """Rows still to process: requests without a committed result."""
    return requests.join(done.select(id_col).distinct(), id_col, "left_anti")


def write_batch(results: DataFrame, path: str, batch: int) -> int:
    """Write the rows of one batch, replacing what an earlier attempt left; they count only once committed."""
    seen = Observation()
    results.observe(seen, F.count(F.lit(1)).alias("rows")).write.mode("overwrite").parquet(f"{path}/batches/commit={batch}")
    return seen.get["rows"]


def append_done(results: DataFrame, path: str) -> int:
    """Write and commit one batch; returns its number. The commit is one file, so it is there whole or not at all."""
    spark = results.sparkSession
    last = read_commits(spark, path).agg(F.max("commit")).first()[0]
    batch = 0 if last is None else last + 1
    rows = write_batch(results, path, batch)
    spark.createDataFrame([(batch, rows)], COMMITS).coalesce(1).write.mode("append").parquet(f"{path}/commits")
    return batch


def latest_per_id(done: DataFrame, id_col: str = "ID", order_col: str = "commit") -> DataFrame:
    """When an ID was committed twice (a retried batch), keep the latest batch's row."""
    w = Window.partitionBy(id_col).orderBy(F.col(order_col).desc())
    return done.withColumn("__r", F.row_number().over(w)).where(F.col("__r") == 1).drop("__r")
