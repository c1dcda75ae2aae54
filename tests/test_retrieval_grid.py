"""The settings grid against one retrieval per setting, and the vocabulary cut against a sort."""

import random

import pytest
from pyspark.sql import functions as F

from answerbank.functions import rouge as R
from answerbank.operators import similarity as sim
from answerbank.operators import sweep as SW
from answerbank.operators.tfidf import TfidfSettings, _limit_features


def test_grid_equals_single_retrievals(spark):
    rng = random.Random(8)
    text = lambda n: " ".join(rng.choice(["aa", "Ab", "ba", "cab", "d"]) for _ in range(rng.randint(0, n)))
    bank = spark.createDataFrame([(k, f"b{k}", text(8), text(6)) for k in range(3, 30)], "pos long, id string, question string, answer string")
    queries = spark.createDataFrame([(k, text(6), text(6)) for k in range(8)] + [(8, "zzz", "aa"), (9, None, None)], "qid long, question string, answer string")
    base = TfidfSettings(analyzer="char", ngram_min=1, ngram_max=2, lowercase=True)
    settings = [base.with_(max_features=m, min_df=d, sublinear_tf=s, binary=b, use_idf=i)
                for m, d, s, b, i in ((7, 1, False, False, True), (7, 2, True, False, True), (9, 1, False, True, True), (1000, 3, False, False, False), (5, 1, False, True, False))]
    settings.append(base.with_(analyzer="char_wb", ngram_min=2, ngram_max=3, max_features=None))
    got = SW.retrieval_grid(spark, bank, queries, settings).collect()
    assert [r["weighted_without_llm"] for r in got] == sorted((r["weighted_without_llm"] for r in got), reverse=True)
    for row in got:
        pred = sim.top1_predict(bank, queries, settings[row["setting"]]).select("qid", "prediction")
        scored = queries.join(pred, "qid").select(R.rouge("answer", "prediction").alias("r")).agg(F.avg("r.rouge1"), F.avg("r.rouge_l")).first()
        assert (row["rouge1_f1"], row["rouge_l_f1"]) == pytest.approx(tuple(scored), abs=1e-9), settings[row["setting"]]


def test_cut_by_counting_equals_a_sort(spark):
    rng = random.Random(9)
    rows = [(g, f"{rng.choice(['same', 'sama', 'b'])}{k}", rng.choice([1, 1, 1, 2, 5])) for g in ("x", "y") for k in range(120)]
    stats = spark.createDataFrame(rows, "g string, term string, ctf long")
    for limit in (1, 7, 60, 119, 120, 500):
        want = {(g, t) for g in "xy" for _, t, _ in sorted((r for r in rows if r[0] == g), key=lambda r: (-r[2], r[1]))[:limit]}
        assert {(r.g, r.term) for r in _limit_features(stats, limit, ["g"]).collect()} == want
        want = {t for _, t, _ in sorted((r for r in rows if r[0] == "x"), key=lambda r: (-r[2], r[1]))[:limit]}
        assert {r.term for r in _limit_features(stats.where("g = 'x'").drop("g"), limit, []).collect()} == want
