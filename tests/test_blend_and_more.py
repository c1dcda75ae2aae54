import pytest
from pyspark.sql import functions as F

from answerbank.operators import blend as B
from answerbank.operators import compare as CMP
from answerbank.operators import profile as P
from answerbank.operators import sample as SM
from answerbank.operators import sweep as SW


def test_judge_gate_cases(spark):
    src = spark.createDataFrame(
        [("1", "A", 1), ("2", "A", 2), ("3", "A", 3), ("4", "A", 4), ("5", "A", 5), ("6", "B", 6), ("7", "A", 7)],
        "ID string, subset string, pos int")
    base = spark.createDataFrame([(str(i), "base") for i in range(1, 8)], "ID string, prediction string")
    cand = spark.createDataFrame(
        [("1", "base"), ("2", " "), ("3", "cand"), ("4", "cand"), ("5", "cand"), ("6", "cand"), ("7", "cand")],
        "ID string, prediction string")
    dec = spark.createDataFrame([("3", "B", 0.68, "ok"), ("4", "A", 0.9, "keep"), ("6", "B", 1.0, "x")],
                                "ID string, choice string, confidence double, reason string")
    out = {r["ID"]: r for r in B.judge_gate(src, base, cand, dec, ["A"], limit_per_subset=3).collect()}
    assert out["1"]["decision_reason"] == "not_target_subset"   # identical candidate
    assert out["2"]["decision_reason"] == "not_target_subset"   # empty candidate
    assert out["3"]["used_candidate"] and out["3"]["prediction"] == "cand"  # confidence exactly at the threshold
    assert not out["4"]["used_candidate"] and out["4"]["decision_reason"] == "keep"
    assert out["5"]["decision_reason"] == "pending"            # judged, no decision yet
    assert out["6"]["decision_reason"] == "not_target_subset"
    assert out["7"]["decision_reason"] == "limit_reached"


def test_rules_and_coverage(spark):
    src = spark.createDataFrame([("1", "q one two three", "s"), ("2", "short", "t")], "ID string, question string, subset string")
    pred = spark.createDataFrame([("1", " p1  p2 p3 "), ("2", "keep me ")], "ID string, prediction string")
    rules = spark.createDataFrame([("s", "input_pred", None, 2, 1, None, None, None),
                                   ("t", "input_only", None, None, None, "pred_words", ">", 5.0)], SW_RULES)
    out = {r["ID"]: r["prediction"] for r in B.apply_rules(src, pred, rules).collect()}
    assert out == {"1": "q one p1", "2": "keep me"}
    with pytest.raises(B.CoverageError):
        B.apply_rules(src, pred.where(F.col("ID") == "1"), rules)


SW_RULES = ("subset string, mode string, cap int, input_cap int, prediction_cap int, "
            "feature string, op string, threshold double")


def test_submission_contract(spark):
    ids = spark.createDataFrame([("a",), ("b",)], "ID string")
    sub = B.build_submission(ids, spark.createDataFrame([("a", "x")], "ID string, prediction string"))
    B.validate_submission(sub)
    assert {r["ID"]: r["TargetLLM"] for r in sub.collect()} == {"a": "x", "b": ""}
    bad = sub.withColumn("TargetLLM", F.lit("other"))
    with pytest.raises(ValueError):
        B.validate_submission(bad)


def test_stratified_cap_keeps_groups(spark):
    df = spark.createDataFrame([(i, s) for i, s in enumerate(["a"] * 5 + ["b"] * 5 + ["c"] * 5)], "id int, subset string")
    out = SM.stratified_cap(df, "subset", 6, 42).collect()
    assert len(out) == 6 and {r["subset"] for r in out} == {"a", "b", "c"}


def test_history_branches(spark):
    h = spark.createDataFrame([(1, 1, 0.501, 1), (1, 2, 0.503, 2), (1, 3, 0.504, 3), (2, 9, 0.42, 1)],
                              "series int, id int, score double, seq int")
    out = {r["series"]: r["branch"] for r in CMP.next_step_signal(h).collect()}
    assert out == {1: "plateau", 2: "more_epochs"}


def test_profile_counts(spark):
    df = spark.createDataFrame([("1", "what is it", "ans"), ("1", "what is it", "ans"), ("2", None, "x")],
                               "ID string, Question string, Answer string")
    r = P.profile(df, "Question", "Answer").collect()[0]
    assert (r["rows"], r["missing_cells"], r["duplicate_rows"]) == (3, 1, 1)


def test_rule_grid_size():
    assert len(SW.rule_specs()) == 142
    assert len(SW.retrieval_grid_settings()) == 288


def test_repeated_ids_are_errors(spark):
    src = spark.createDataFrame([("1", "s", 1), ("2", "s", 2)], "ID string, subset string, pos int")
    runs = spark.createDataFrame([("1", "a"), ("2", "b")], "ID string, prediction string")
    twice = runs.unionByName(spark.createDataFrame([("1", "c")], runs.schema))
    dec = spark.createDataFrame([("1", "B", 0.9, "x"), ("1", "A", 0.9, "y")], "ID string, choice string, confidence double, reason string")
    caps = spark.createDataFrame([("s", 1), ("s", 2)], "subset string, max_words int")
    for build in (
        lambda: B.override_by_id(src, runs, twice),
        lambda: B.override_by_subset(src, twice, runs, ["s"]),
        lambda: B.judge_gate(src, runs, runs.withColumn("prediction", F.lit("z")), dec, ["s"]),
        lambda: B.generation_override(src, runs, twice, ["s"]),
        lambda: B.cap_by_subset(src, runs, caps),
        lambda: B.build_submission(src, twice),
    ):
        with pytest.raises(Exception, match="more than one row for"):
            build().collect()
    once = B.build_submission(src, runs)
    B.validate_submission(once)
    with pytest.raises(ValueError):
        B.validate_submission(once.unionByName(once))


def test_missing_vector_or_prediction_is_an_error(spark):
    from answerbank import catalog
    from answerbank.operators import fusion

    cands = spark.createDataFrame([(1, 1, 0.5), (2, 1, 0.5)], "qid long, pos long, score double")
    vectors = spark.createDataFrame([(1, [1.0, 0.0])], "id long, vec array<double>")
    assert fusion.with_dense(cands.where("qid = 1"), vectors, vectors).first()["dense_score"] == 1.0
    with pytest.raises(Exception, match="no vector for query 2"):
        fusion.with_dense(cands, vectors, vectors).collect()
    refs = spark.createDataFrame([(1, "a"), (2, "b")], "qid long, answer string")
    with pytest.raises(Exception, match="no prediction for 2"):
        catalog.score_corpus(spark.createDataFrame([(1, "a")], "qid long, prediction string"), refs).collect()
