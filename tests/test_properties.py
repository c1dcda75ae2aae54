"""Properties from the design's test plan."""

from pyspark.sql import functions as F

from answerbank.operators import blend as B
from answerbank.operators import fusion as FU
from answerbank.operators import similarity as sim
from answerbank.operators.tfidf import TfidfSettings
from answerbank.sources import tables as T

from conftest import SF001

S = TfidfSettings(analyzer="char", ngram_min=2, ngram_max=4, sublinear_tf=True, max_features=100000)


def test_topk_prefix_property(spark):
    bank, q = T.bank_and_queries(T.conv_qa(spark, SF001))
    k5 = {(r["qid"], r["rank"]): r["pos"] for r in sim.topk_scores(bank, q, S, 5).collect()}
    k3 = {(r["qid"], r["rank"]): r["pos"] for r in sim.topk_scores(bank, q, S, 3).collect()}
    assert all(k5[key] == pos for key, pos in k3.items())


def test_single_member_ensemble_is_that_member(spark):
    bank, q = T.bank_and_queries(T.conv_qa(spark, SF001))
    member = sim.top1_predict(bank, q, S).select("qid", "matched_id", "similarity", "prediction")
    voted = FU.ensemble_vote([(member, 1.0)])
    a = sorted((r["qid"], r["matched_id"], round(r["similarity"], 9)) for r in member.collect())
    b = sorted((r["qid"], r["matched_id"], round(r["similarity"], 9)) for r in voted.collect())
    assert a == b


def test_override_with_empty_subset_set_is_base(spark):
    bank, q = T.bank_and_queries(T.conv_qa(spark, SF001))
    src = q.select(F.col("qid").alias("ID"), "subset")
    base = sim.top1_predict(bank, q, S).select(F.col("qid").alias("ID"), "prediction")
    other = base.withColumn("prediction", F.lit("other"))
    out = B.override_by_subset(src, base, other, [])
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, base.collect()))
