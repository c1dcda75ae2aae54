import os
import tempfile

from pyspark.sql import functions as F

from answerbank.sources import files as FS
from answerbank.streaming import resume


def _tmp():
    return tempfile.mkdtemp(prefix="answerbank-test-")


def test_experiment_log_keeps_malformed_rows(spark):
    d = _tmp()
    p = os.path.join(d, "log.csv")
    with open(p, "w") as f:
        f.write("experiment_id,local_score,insight\n")
        f.write('e1,0.42,"fine, quoted"\n')
        f.write("e2,0.5,unquoted, comma\n")
        f.write('e3,,"multi\nline"\n')
    df = FS.read_experiment_log(spark, p, "experiment_id string, local_score double, insight string").cache()
    rows = {r["experiment_id"]: r for r in df.collect()}
    assert rows["e1"]["insight"] == "fine, quoted" and rows["e1"]["_corrupt_record"] is None
    assert rows["e2"]["_corrupt_record"] is not None          # 4 fields against 3: kept, flagged
    assert rows["e3"]["insight"] == "multi\nline" and rows["e3"]["local_score"] is None


def test_roles_and_layouts(spark):
    df = spark.createDataFrame([("1", "q", "a", "en")], "ID string, Question string, Answer string, Language string")
    assert FS.bind_roles(df, require_answer=True).columns == ["ID", "question", "answer", "language"]
    sub = spark.createDataFrame([("1", "x", "x", "x")], "ID string, TargetRLF1 string, TargetR1F1 string, TargetLLM string")
    assert FS.prediction_layout(sub).collect()[0]["prediction"] == "x"
    import pytest

    with pytest.raises(ValueError):
        FS.infer_roles(["ID", "text"], require_answer=False)


def test_resume_processes_only_pending(spark):
    path = os.path.join(_tmp(), "done")
    schema = "ID string, result string, batch int"
    req = spark.createDataFrame([(str(i),) for i in range(6)], "ID string")
    done = resume.read_done(spark, path, schema)
    first = resume.pending(req, done).where(F.col("ID") < "3").select("ID", F.lit("r").alias("result"), F.lit(1).alias("batch"))
    resume.append_done(first, path)
    todo = resume.pending(req, resume.read_done(spark, path, schema))
    assert sorted(r["ID"] for r in todo.collect()) == ["3", "4", "5"]


def test_run_list_skips_incomplete_runs(spark):
    root = _tmp()
    for name, files in (("r1", ("validation", "test")), ("r2", ("validation",))):
        for f in files:
            spark.createDataFrame([("1", "p-" + name)], "ID string, prediction string").coalesce(1).write.option(
                "header", True).csv(os.path.join(root, name, f))
    src = spark.createDataFrame([("1",), ("2",)], "ID string")
    out = sorted(tuple(r) for r in FS.load_run_list(spark, root, ["r1", "r2", "r3"], src).collect())
    assert out == [("r1", "1", "p-r1"), ("r1", "2", "")]


def test_csv_keeps_blanks_empty_text_and_nulls(spark):
    rows = [("1", "  lead and trail  "), ("2", ""), ("3", None), ("4", 'two\nlines, "quoted"'), ("5", " ")]
    path = os.path.join(_tmp(), "run")
    FS.write_table(spark.createDataFrame(rows, "ID string, prediction string"), path, fmt="csv")
    assert sorted(tuple(r) for r in FS.scan_predictions(spark, [path]).select("ID", "prediction").collect()) == rows


def test_runs_of_three_layouts(spark):
    root = _tmp()
    layouts = {
        "a": ("ID,prediction", "x,one"),
        "b": ("ID,matched_id,similarity,prediction,reference", "x,m1,0.5,two,ref"),
        "c": ("ID,TargetRLF1,TargetR1F1,TargetLLM", "x,three,three,three"),
        "d": ("ID,score", "x,0.1"),
    }
    for name, lines in layouts.items():
        os.makedirs(os.path.join(root, name))
        for file, row_id in (("validation.csv", "v"), ("test.csv", "t")):
            with open(os.path.join(root, name, file), "w") as f:
                f.write(f"{lines[0]}\n{row_id}{lines[1][1:]}\n")
    found = sorted(tuple(r) for r in FS.scan_runs(spark, f"{root}/*/test.csv").collect())
    assert found == [("a", "t", "one"), ("b", "t", "two"), ("c", "t", "three")]
    source = spark.createDataFrame([("v",), ("t",)], "ID string")
    listed = FS.load_run_list(spark, root, ["b", "c", "gone"], source, ("validation.csv", "test.csv"))
    assert sorted(tuple(r) for r in listed.collect()) == [("b", "t", "two"), ("b", "v", "two"), ("c", "t", "three"), ("c", "v", "three")]


def test_missing_log_is_empty(spark):
    assert FS.read_experiment_log(spark, os.path.join(_tmp(), "none.csv"), "experiment_id string").count() == 0
