import os
import tempfile

from pyspark.sql import functions as F

from answerbank.streaming import resume

SCHEMA = "ID long, result string"


def _rows(spark, ids, result):
    return spark.createDataFrame([(i, result) for i in ids], SCHEMA)


def _state(spark, path):
    return {r["ID"]: (r["result"], r["commit"]) for r in resume.latest_per_id(resume.read_done(spark, path, SCHEMA)).collect()}


def test_a_batch_broken_off_counts_for_nothing_and_is_replaced(spark):
    path = os.path.join(tempfile.mkdtemp(), "cache")
    requests = spark.createDataFrame([(i,) for i in range(10)], "ID long")
    assert resume.read_done(spark, path, SCHEMA).count() == 0
    assert resume.append_done(_rows(spark, range(3), "a"), path) == 0
    resume.write_batch(_rows(spark, range(3, 9), "broken off"), path, 1)  # its commit was never written
    assert set(_state(spark, path)) == {0, 1, 2}
    todo = resume.pending(requests, resume.read_done(spark, path, SCHEMA))
    assert sorted(r["ID"] for r in todo.collect()) == list(range(3, 10))
    assert resume.append_done(_rows(spark, [9], "b"), path) == 1  # the number that broke off: its rows are gone
    assert _state(spark, path) == {0: ("a", 0), 1: ("a", 0), 2: ("a", 0), 9: ("b", 1)}


def test_files_of_half_a_batch_are_not_seen(spark):
    path = os.path.join(tempfile.mkdtemp(), "cache")
    resume.append_done(_rows(spark, range(4), "a"), path)
    half = os.path.join(path, "batches", "commit=1")
    _rows(spark, range(4, 8), "half").repartition(2).write.parquet(half)
    os.remove(os.path.join(half, "_SUCCESS"))
    assert resume.read_done(spark, path, SCHEMA).agg(F.max("ID")).first()[0] == 3


def test_the_latest_of_an_id_done_twice_and_empty_batches(spark):
    path = os.path.join(tempfile.mkdtemp(), "cache")
    resume.append_done(_rows(spark, [1, 2], "old"), path)
    assert resume.append_done(_rows(spark, [], "none"), path) == 1
    resume.append_done(_rows(spark, [2], "new"), path)
    assert _state(spark, path) == {1: ("old", 0), 2: ("new", 2)}
    assert sorted(r["rows"] for r in resume.read_commits(spark, path).collect()) == [0, 1, 2]
