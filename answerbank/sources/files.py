"""File scans and sinks.

CSV inputs carry quoted multi-line text, so every reader uses
``multiLine`` with ``"`` as quote and escape, a declared schema, and an
explicit list of null tokens applied to text columns (Spark only knows one
``nullValue``). Runs live in folders; the folder name is the run name, read
from ``_metadata.file_path`` so one scan covers every run.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from answerbank.plans.ranking import global_rank

# Text tokens read as missing (the pandas CSV defaults that occur in text data).
NULL_TOKENS = ["", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
               "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null"]

# Ordered column-name aliases per role (first present wins).
ID_NAMES = ("ID", "Id", "id")
QUESTION_NAMES = ("Question", "question", "Input", "input", "Source", "source")
ANSWER_NAMES = ("Answer", "answer", "Target", "target", "Response", "response", "Output", "output")
LANGUAGE_NAMES = ("Language", "language", "lang", "Lang")
PREDICTION_NAMES = ("prediction", "TargetRLF1")
#: What an empty text is written as: quoted, so that it is told from a null (nothing between the commas).
EMPTY_TEXT = '""'
#: Stands for a null while a file is read (Spark's own choice, '', would turn quoted empty text into nulls).
NO_TEXT = "\x00"


def _reader(spark: SparkSession):
    return (
        spark.read.option("header", True)
        .option("multiLine", True)
        .option("quote", '"')
        .option("escape", '"')
        .option("mode", "PERMISSIVE")
    )


def null_tokens_to_null(c: Column) -> Column:
    return F.when(c.isin(NULL_TOKENS), F.lit(None).cast("string")).otherwise(c)


def load_csv(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """CSV scan (all columns string unless a schema is given); null tokens become null."""
    r = _reader(spark)
    df = r.schema(schema).csv(path) if schema else r.option("inferSchema", False).csv(path)
    return df.select(*[null_tokens_to_null(F.col(c)).alias(c) if t == "string" else F.col(c) for c, t in df.dtypes])


def infer_roles(columns: list[str], require_answer: bool) -> dict[str, str | None]:
    """First present name per role; ID and question required, answer on demand."""
    aliases = {"id": ID_NAMES, "question": QUESTION_NAMES, "answer": ANSWER_NAMES, "language": LANGUAGE_NAMES}
    roles = {role: next((n for n in names if n in columns), None) for role, names in aliases.items()}
    needed = ["id", "question"] + ["answer"] * require_answer
    absent = [role for role in needed if roles[role] is None]
    if absent:
        raise ValueError(f"no column serves as {', '.join(absent)} among {columns}")
    return roles


def bind_roles(df: DataFrame, require_answer: bool = False) -> DataFrame:
    """Canonical ``ID, question, answer?, language?`` columns (other columns kept)."""
    roles = infer_roles(df.columns, require_answer)
    renamed = {roles["id"]: "ID", roles["question"]: "question"}
    if roles["answer"]:
        renamed[roles["answer"]] = "answer"
    if roles["language"]:
        renamed[roles["language"]] = "language"
    taken = set(renamed.values())
    cols = [F.col(c).alias(renamed[c]) for c in renamed]
    cols += [F.col(c) for c in df.columns if c not in renamed and c not in taken]
    return df.select(*cols)


def prediction_layout(df: DataFrame) -> DataFrame:
    """S3: ``(ID, prediction)`` from either layout (``prediction`` or the submission's ``TargetRLF1``)."""
    col = next((c for c in PREDICTION_NAMES if c in df.columns), None)
    if col is None or "ID" not in df.columns:
        raise ValueError(f"no ID and prediction among the columns {df.columns}")
    return df.select(F.col("ID").cast("string").alias("ID"), F.col(col).alias("prediction"))


def _files_under(spark: SparkSession, pattern: str) -> list[str]:
    """Non-empty data files that ``pattern`` names, directly or as parts of a folder (a listing; no data is read)."""
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path  # noqa: SLF001
    path = jvm_path(pattern)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())  # noqa: SLF001
    found = []
    for status in fs.globStatus(path) or []:
        for entry in fs.listStatus(status.getPath()) if status.isDirectory() else [status]:
            hidden = entry.getPath().getName().startswith(("_", "."))
            if entry.isFile() and entry.getLen() and not hidden:
                found.append(entry.getPath().toString())
    return sorted(found)


def scan_predictions(spark: SparkSession, patterns: list[str]) -> DataFrame:
    """``(__path, ID, prediction)`` of prediction files that may differ in their columns.

    A CSV scan binds columns by place, so files are grouped by their header (that of the first part, for the parts of one
    folder) and every layout is one scan. Files without an ID and a known prediction column are left out.
    """
    folders: dict[str, list[str]] = {}
    for pattern in patterns:
        for path in _files_under(spark, pattern):
            folder, name = path.rsplit("/", 1)
            folders.setdefault(folder if name.startswith("part-") else path, []).append(path)
    layouts: dict[tuple[str, ...], list[str]] = {}
    for paths in folders.values():
        layouts.setdefault(tuple(_reader(spark).csv(paths[0]).columns), []).extend(paths)
    out = spark.createDataFrame([], "__path string, ID string, prediction string")
    for columns, paths in layouts.items():
        text = next((c for c in PREDICTION_NAMES if c in columns), None)
        if text is None or "ID" not in columns:
            continue
        schema = StructType([StructField(c, StringType()) for c in columns])
        rows = _reader(spark).schema(schema).option("nullValue", NO_TEXT).csv(paths)
        out = out.unionByName(rows.select(F.col("_metadata.file_path").alias("__path"), "ID", F.col(text).alias("prediction")))
    return out


def scan_runs(spark: SparkSession, pattern: str) -> DataFrame:
    """Every run file matching ``pattern``: ``(run, ID, prediction)``; run = parent folder."""
    run = F.element_at(F.split(F.col("__path"), "/"), -2)
    return scan_predictions(spark, [pattern]).select(run.alias("run"), "ID", "prediction")


def read_experiment_log(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Permissive scan keeping malformed lines in ``_corrupt_record`` (count them, do not fail); no file: no rows."""
    if not _files_under(spark, path):
        return spark.createDataFrame([], schema + ", _corrupt_record string")
    return (
        _reader(spark)
        .schema(schema + ", _corrupt_record string")
        .option("columnNameOfCorruptRecord", "_corrupt_record")
        .csv(path)
    )


def write_table(
    df: DataFrame,
    path: str,
    fmt: str = "parquet",
    partition_by: list[str] | None = None,
    order: list[Column] | None = None,
    rows_per_file: int = 0,
) -> str:
    """Prediction / metrics sinks (Parquet by default, CSV with quoted multi-line text).

    With ``order`` (G1, G2) the rows are range-partitioned and sorted, and the files are numbered in that order;
    ``read_ordered`` gives it back. ``rows_per_file`` cuts larger files (0: one file a task).
    """
    if order and partition_by:
        raise ValueError("an ordered table has no partition folders")
    w = (df.orderBy(*order) if order else df).write.mode("overwrite").option("maxRecordsPerFile", rows_per_file)
    if partition_by:
        w = w.partitionBy(*partition_by)
    if fmt == "csv":
        w = w.option("header", True).option("quote", '"').option("escape", '"').option("emptyValue", EMPTY_TEXT)
        w.option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)
    else:
        w.parquet(path)
    return path


def read_ordered(spark: SparkSession, path: str, fmt: str = "parquet", schema: str | None = None) -> DataFrame:
    """The rows of an ordered table with ``position`` (from 1): by the numbers of the files, then by the place in the file.

    A scan deals files to tasks by size, so the order of the rows it returns is not that of the files. The position is a
    rank over all tasks; sort by it where the rows leave Spark. CSV columns are strings unless ``schema`` is given.
    """
    name = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1)
    number = lambda pattern: F.regexp_extract(name, pattern, 1).try_cast("long")
    if fmt == "csv":
        reader = _reader(spark).option("nullValue", NO_TEXT)
        df = reader.schema(schema).csv(path) if schema else reader.option("inferSchema", False).csv(path)
        # a task reads a block of a file from its start to its end
        place = F.struct(F.col("_metadata.file_block_start"), F.monotonically_increasing_id())
    else:
        df = spark.read.schema(schema).parquet(path) if schema else spark.read.parquet(path)
        place = F.struct("_metadata.row_index")
    # Spark names files part-<task>-<job>-c<file of the task>
    placed = df.select("*", number(r"^part-(\d+)").alias("__task"), number(r"-c(\d+)\.").alias("__file"), place.alias("__place"))
    order = [F.col(c).asc() for c in ("__task", "__file", "__place")]
    return global_rank(placed, [], order, "position").drop("__task", "__file", "__place")


def vectors_to_encode(texts: DataFrame, cache: DataFrame | None, text_col: str = "text") -> DataFrame:
    """Content-keyed vector cache: rows whose ``(id, sha256(text))`` has no cached vector."""
    keyed = texts.select("id", F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256).alias("text_hash"), text_col)
    if cache is None:
        return keyed
    return keyed.join(cache.select("id", "text_hash"), ["id", "text_hash"], "left_anti")


def load_run_list(
    spark: SparkSession, root: str, names: list[str], source: DataFrame, files: tuple[str, ...] = ("validation", "test")
) -> DataFrame:
    """``(candidate, ID, prediction)`` for every listed run whose files all exist under ``root/<name>/``.

    A run missing any of its files is skipped; no run loading is an error. Every file of a run is read (the files
    hold different IDs; of an ID in several, the first listed file counts). Each run is left-joined from the source IDs, a missing prediction becomes ''.
    The existence check lists paths (metadata only).
    """
    root = root.rstrip("/")
    present = [n for n in names if all(_files_under(spark, f"{root}/{n}/{f}") for f in files)]
    if not present:
        raise ValueError(f"none of the runs {names} under {root} has all of {list(files)}")
    found = scan_predictions(spark, [f"{root}/{n}/{f}" for n in present for f in files])
    # a file is <root>/<run>/<file> or, written by Spark, a part below that
    part = lambda k: F.regexp_extract("__path", f"/([^/]+)/({'|'.join(map(re.escape, files))})(?:/[^/]+)?$", k)
    run, place = part(1), F.array_position(F.array(*map(F.lit, files)), part(2))
    first = F.min(F.struct(place.alias("place"), "prediction"))["prediction"].alias("prediction")
    runs = found.groupBy(run.alias("candidate"), "ID").agg(first)
    # every source ID meets every loaded run: the run names are a literal array expanded per ID
    grid = source.select(F.col("ID").cast("string").alias("ID")).distinct().select(
        "ID", F.explode(F.array(*[F.lit(n) for n in present])).alias("candidate")
    )
    return grid.join(runs, ["candidate", "ID"], "left").select(
        "candidate", "ID", F.coalesce(F.col("prediction"), F.lit("")).alias("prediction")
    )
