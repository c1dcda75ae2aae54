import glob
import os
import tempfile

import pytest
from pyspark.sql import functions as F

from answerbank.operators import blend
from answerbank.sources import files


def _positions(df, column):
    return [r[column] for r in sorted(df.collect(), key=lambda r: r["position"])]


@pytest.mark.parametrize("fmt", ["parquet", "csv"])
def test_order_holds_over_a_reread_of_many_files(spark, fmt):
    path = os.path.join(tempfile.mkdtemp(), "t")
    df = spark.range(500).repartition(7).select((F.col("id") % 5).alias("k"), "id", F.lit("two\nlines").alias("text"))
    files.write_table(df, path, fmt, order=[F.col("k").desc(), F.col("id").asc()], rows_per_file=30)
    assert len(glob.glob(f"{path}/part-*")) >= 15
    read = files.read_ordered(spark, path, fmt, "k long, id long, text string")
    want = sorted(range(500), key=lambda i: (-(i % 5), i))
    assert _positions(read, "id") == want
    assert sorted(r["position"] for r in read.collect()) == list(range(1, 501))


def test_files_go_by_number_not_by_name(spark):
    path = tempfile.mkdtemp()
    for number in (100000, 99999, 7):
        part = os.path.join(tempfile.mkdtemp(), "p")
        spark.createDataFrame([(number, 1), (number, 2)], "n long, k long").coalesce(1).write.parquet(part)
        os.link(glob.glob(f"{part}/part-*")[0], f"{path}/part-{number:05d}-x-c000.parquet")
    read = files.read_ordered(spark, path)
    assert _positions(read, "n") == [7, 7, 99999, 99999, 100000, 100000]
    assert _positions(read, "k") == [1, 2] * 3


def test_a_submission_in_source_order(spark):
    source = spark.createDataFrame([("c", 0), ("a", 1), ("b", 2)], "ID string, pos long")
    predictions = spark.createDataFrame([("a", "x"), ("b", 'q"1'), ("c", "")], "ID string, prediction string")
    out = blend.build_submission(source, predictions)
    path = os.path.join(tempfile.mkdtemp(), "s")
    blend.save_submission(out, path, source=source, rows_per_file=1)
    read = files.read_ordered(spark, path, "csv")
    assert _positions(read, "ID") == ["c", "a", "b"] and _positions(read, "TargetLLM") == ["", "x", 'q"1']
    with pytest.raises(Exception, match="no source row for c"):
        blend.save_submission(out, path + "2", source=source.where("ID <> 'c'"))


def test_no_rows_and_partition_folders(spark):
    path = os.path.join(tempfile.mkdtemp(), "t")
    empty = spark.createDataFrame([], "k long")
    files.write_table(empty, path, order=[F.col("k").asc()])
    assert files.read_ordered(spark, path).count() == 0
    with pytest.raises(ValueError):
        files.write_table(empty, path, partition_by=["k"], order=[F.col("k").asc()])
