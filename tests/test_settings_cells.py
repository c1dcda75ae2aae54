"""The cells that score every setting of a family against plain loops; the grid writes no pair of rows."""

import math
import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from answerbank.operators import sweep as SW
from answerbank.operators.tfidf import TfidfSettings
from answerbank.plans import blocks, settings_cells


def test_cells_keep_the_best_row_of_every_setting(monkeypatch):
    rng = random.Random(4)
    member = {t: rng.choice([1, 3, 7, 7]) for t in range(40)}
    idf = {t: 1 + rng.random() for t in member}
    rows = lambda n: [{t: rng.randint(1, 3) for t in rng.sample(range(45), rng.randint(1, 9))} for _ in range(n)]
    asked, held = rows(30), rows(50)
    held[31] = held[7]  # equal scores: the lower position
    settings = [(i, bit, mode) for i, (bit, mode) in enumerate((b, m) for b in (1, 2, 4) for m in range(6))]

    def weight(tf, t, mode):
        kind = settings_cells.MODES[mode]
        w = {"raw": tf, "sub": 1 + math.log(tf), "one": 1}[kind[:3]]
        return w * idf[t] if kind.endswith("_idf") else w

    def vector(row, bit, mode):
        w = {t: weight(tf, t, mode) for t, tf in row.items() if member.get(t, 0) & bit}
        norm = math.sqrt(sum(x * x for x in w.values()))
        return {t: x / norm for t, x in w.items()}, (1 / norm if norm else 0.0)

    def batch(found):
        of = lambda name, kind: pa.array([name(row) for row in found], pa.list_(kind))
        return pa.RecordBatch.from_arrays(
            [pa.array(range(len(found)), pa.int64()), of(lambda r: [t for t in r if t in member], pa.int64()),
             of(lambda r: [r[t] for t in r if t in member], pa.int32()), of(lambda r: [member[t] for t in r if t in member], pa.int64()),
             of(lambda r: [idf[t] for t in r if t in member], pa.float64()),
             of(lambda r: [vector(r, bit, mode)[1] for _, bit, mode in settings], pa.float64())],
            ["rid", "tids", "ws", "members", "idfs", "factors"])

    want = {}
    for i, bit, mode in settings:
        bank = [vector(row, bit, mode)[0] for row in held]
        for q, row in enumerate(asked):
            mine = vector(row, bit, mode)[0]
            score = [round(sum(x * b.get(t, 0.0) for t, x in mine.items()), 9) for b in bank]
            if max(score) > 0:
                want[q, i] = score.index(max(score))
    for queries, bank, ratio, pairs in ((256, 256, 128, 10**6), (7, 9, 10**9, 10), (30, 4, 1, 5), (11, 50, 20, 40)):
        for module, name, value in ((settings_cells, "PART_QUERIES", queries), (settings_cells, "PART_BANK", bank),
                                    (settings_cells, "DENSE_RATIO", ratio), (blocks, "PAIR_CHUNK", pairs)):
            monkeypatch.setattr(module, name, value)
        block = settings_cells.SettingsBlock(settings, [batch(asked)])
        bests = block.bests(1)
        for low in (25, 0):  # in any order
            block.meet(bests, batch(held).slice(low, 25))
        (found,) = block.found(bests)
        assert {(q, i): p for q, i, _, p in zip(*(x.to_pylist() for x in found))} == want
        assert np.all(bests[0] <= 1 + 1e-9)


def test_no_pair_of_rows_leaves_a_cell(spark):
    """Products of every (query, bank row, class) were rows of a shuffle."""
    bank = spark.createDataFrame([(i, f"w{i % 7} w{i % 5} all", "a") for i in range(60)], "pos long, question string, answer string")
    queries = bank.select((F.col("pos") % 50).alias("qid"), "question", "answer").limit(40)
    base = TfidfSettings(analyzer="word", ngram_min=1, ngram_max=1, lowercase=True)
    settings = [base, base.with_(min_df=2), base.with_(binary=True), base.with_(analyzer="char", ngram_max=2)]
    best = SW._best_per_setting(bank, queries, settings, 60)
    plan = best._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "Aggregate" not in plan  # a row a query and setting, nothing before it is planned again
    assert best.count() == 40 * len(settings)
