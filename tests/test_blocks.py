"""The streaming cell scorer against plain loops."""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from answerbank.operators import similarity as sim
from answerbank.operators.tfidf import TfidfSettings
from answerbank.plans import blocks


def _posts(rng, n, terms):
    rows = []
    for i in range(n):
        held = rng.choice(terms, size=int(rng.integers(1, 9)), replace=False)
        rows += [(i, int(t) * 7919 - 50, float(rng.integers(1, 4))) for t in held]
    return rows


def _best(q_rows, b_rows, k):
    scores = {}
    for q, t, w in q_rows:
        for b, u, x in b_rows:
            if t == u:
                scores[q, b] = scores.get((q, b), 0.0) + w * x
    out = {}
    for (q, b), s in scores.items():
        out.setdefault(q, []).append((-round(s, 9), b))
    return {q: [(b, -s) for s, b in sorted(found)[:k]] for q, found in out.items()}


def test_blocks_of_any_size_give_the_same_rows(spark):
    rng = np.random.default_rng(3)
    q_rows, b_rows = _posts(rng, 70, 40), _posts(rng, 150, 40)
    schema = "id long, tid long, w double"
    q, b = spark.createDataFrame(q_rows, schema), spark.createDataFrame(b_rows, schema)
    want = _best(q_rows, b_rows, 4)
    for sizes in ({}, {"max_query_rows": 9, "max_bank_rows": 31}):
        got = {}
        for r in blocks.blocked_topk(q, b, 4, [], **sizes).collect():
            got.setdefault(r["qid"], []).append((r["pos"], r["score"]))
        assert {key: sorted(v, key=lambda x: (-x[1], x[0])) for key, v in got.items()} == want


def test_tiles_and_chunks_do_not_change_a_cell(monkeypatch):
    rng = np.random.default_rng(5)
    q_rows, b_rows = _posts(rng, 50, 30), _posts(rng, 90, 30)

    def batch(rows, side):
        ids = sorted({r[0] for r in rows})
        lists = [[r[c] for r in rows if r[0] == i] for c in (1, 2) for i in ids]
        n = len(ids)
        return pa.RecordBatch.from_arrays(
            [pa.array([side] * n), pa.array([0] * n), pa.array([0] * n), pa.array(ids, pa.int64()),
             pa.array(lists[:n], pa.list_(pa.int64())), pa.array(lists[n:], pa.list_(pa.float64())), pa.array([0.5] * n)],
            ["side", "qblock", "bblock", "rid", "tids", "ws", "scale"])

    want = _best(q_rows, [(b, t, w / 2) for b, t, w in b_rows], 3)
    for tile, bank, ratio, pairs in ((2048, 1024, 384, 10**6), (7, 5, 1, 10), (16, 90, 10**9, 3), (50, 4, 20, 50)):
        for name, value in (("TILE_QUERIES", tile), ("TILE_BANK", bank), ("DENSE_RATIO", ratio), ("PAIR_CHUNK", pairs), ("CHUNK_BYTES", 4096)):
            monkeypatch.setattr(blocks, name, value)
        run = blocks._cell_runner(blocks._Sparse, 3, [], ["qid", "pos", "score"])
        got = {}
        for out in run(iter([batch(q_rows, 0), batch(b_rows, 1)])):
            for r in out.to_pylist():
                got.setdefault(r["qid"], []).append((r["pos"], r["score"]))
        assert got == want


def test_rows_sent_per_row_do_not_grow_with_small_blocks(spark):
    """A bank row is sent once per query block of thousands of rows; it was sent once per 512 queries."""
    texts = [f"w{i % 13} w{i % 17} w{i % 29}" for i in range(3000)]
    schema = "pos long, question string, answer string"
    bank = spark.createDataFrame([(i, t, t) for i, t in enumerate(texts)], schema)
    queries = bank.select(F.col("pos").alias("qid"), "question")
    s = TfidfSettings(analyzer="word", ngram_min=1, ngram_max=1)
    counted = spark.sparkContext.accumulator(0)

    def runner(*args, real=blocks._cell_runner):
        inner = real(*args)

        def run(batches):
            def seen():
                for batch in batches:
                    counted.add(batch.num_rows)
                    yield batch

            return inner(seen())

        return run

    kept, blocks._cell_runner = blocks._cell_runner, runner
    try:
        top = sim.topk_scores(bank, queries, s, 1, strategy="blocked").collect()
    finally:
        blocks._cell_runner = kept
    assert len(top) == 3000
    assert counted.value <= 5 * 2 * 3000


def test_dense_cells_match_a_plain_product(spark):
    rng = np.random.default_rng(7)
    q, b = rng.normal(size=(40, 5)), rng.normal(size=(90, 5))
    b[10] = b[60]
    q_df = spark.createDataFrame([(i, [float(x) for x in v], i % 3) for i, v in enumerate(q)], "qid long, vec array<double>, label int")
    b_df = spark.createDataFrame([(i, [float(x) for x in v], i % 3) for i, v in enumerate(b)], "pos long, vec array<double>, label int")
    for keys in ([], ["label"]):
        got = blocks.dense_topk(q_df, b_df, 3, keys, max_query_rows=7, max_bank_rows=11).collect()
        for i in range(40):
            allowed = [j for j in range(90) if not keys or i % 3 == j % 3]
            want = sorted(allowed, key=lambda j: (-round(float(q[i] @ b[j]), 9), j))[:3]
            assert [r["pos"] for r in sorted((r for r in got if r["qid"] == i), key=lambda r: r["rank"])] == want


def test_a_capped_vocabulary_is_one_leaf_of_later_plans(spark):
    """The plan of the cut by frequency was copied into every plan that read the vocabulary."""
    bank = spark.createDataFrame([(i, f"w{i % 7} w{i % 5}", "a", f"s{i % 2}") for i in range(60)], "pos long, question string, answer string, subset string")
    queries = bank.select(F.col("pos").alias("qid"), "question", "subset")
    s = TfidfSettings(analyzer="word", ngram_min=1, ngram_max=1, max_features=8)
    for strategy in ("term_join", "blocked"):
        top = sim.topk_scores(bank, queries, s, 1, keys=["subset"], strategy=strategy)
        plan = top._jdf.queryExecution().analyzed().toString()
        assert "__room" not in plan and "__left" not in plan
        assert top.count() == 60


def test_groups_that_all_have_bank_rows_fit_one_vocabulary(spark, monkeypatch):
    """The whole bank was fitted too, for no query."""
    bank = spark.createDataFrame([(i, i, f"w{i % 7} w{i % 5}", "a", f"s{i % 2}") for i in range(30)],
                                 "pos long, id long, question string, answer string, subset string")
    queries = bank.select(F.col("pos").alias("qid"), "question", "subset")
    fits, real = [], sim.topk_scores
    monkeypatch.setattr(sim, "topk_scores", lambda *a, **kw: fits.append(1) or real(*a, **kw))
    s = TfidfSettings(analyzer="word", ngram_min=1, ngram_max=1)
    assert sim.grouped_top1(bank, queries, s).count() == 30 and len(fits) == 1
    odd = queries.withColumn("subset", F.when(F.col("qid") == 3, "none").otherwise(F.col("subset")))
    assert sim.grouped_top1(bank, odd, s).count() == 30 and len(fits) == 3


def test_a_dense_cell_never_holds_more_than_a_tile_of_scores(monkeypatch):
    """A cell's whole score matrix was made and sorted at once."""
    rng = np.random.default_rng(9)
    q, b = rng.normal(size=(2500, 4)), rng.normal(size=(1300, 4))

    def batch(vectors, side):
        n = len(vectors)
        return pa.RecordBatch.from_arrays(
            [pa.array([side] * n), pa.array([0] * n), pa.array([0] * n), pa.array(np.arange(n)), pa.array(list(vectors), pa.list_(pa.float64()))],
            ["side", "qblock", "bblock", "rid", "vec"])

    sizes, real = [], blocks._Dense.scores

    def scores(self, *args):
        made = real(self, *args)
        sizes.append(made.shape)
        return made

    monkeypatch.setattr(blocks._Dense, "scores", scores)
    run = blocks._cell_runner(blocks._Dense, 1, [], ["qid", "pos", "score"])
    got = {r["qid"]: r["pos"] for out in run(iter([batch(q, 0), batch(b, 1)])) for r in out.to_pylist()}
    assert got == dict(enumerate(np.argmax(q @ b.T, axis=1).tolist()))
    assert max(x for x, _ in sizes) <= blocks.TILE_BANK and max(y for _, y in sizes) <= blocks.TILE_QUERIES


def test_no_row_is_copied_for_the_blocks_of_the_other_side(spark):
    """Each bank row went through the shuffle once per query block, each query row once per bank block."""
    rng = np.random.default_rng(11)
    q_rows, b_rows = _posts(rng, 60, 30), _posts(rng, 80, 30)
    schema = "id long, tid long, w double"
    q, b = spark.createDataFrame(q_rows, schema), spark.createDataFrame(b_rows, schema)
    got = blocks.blocked_topk(q, b, 1, [], max_query_rows=5, max_bank_rows=9)
    assert "Generate" not in got._jdf.queryExecution().optimizedPlan().toString()
    assert {r["qid"]: [(r["pos"], r["score"])] for r in got.collect()} == _best(q_rows, b_rows, 1)


def test_rows_returned_a_query_do_not_grow_with_bank_blocks(spark, monkeypatch):
    """Each query block returned its best k once per bank block, so these rows grew with queries x bank rows."""
    rng = np.random.default_rng(13)
    q, b = rng.normal(size=(300, 4)), rng.normal(size=(400, 4))
    q_df = spark.createDataFrame([(i, [float(x) for x in v], i % 3) for i, v in enumerate(q)], "qid long, vec array<double>, label int")
    b_df = spark.createDataFrame([(i, [float(x) for x in v], i % 3) for i, v in enumerate(b)], "pos long, vec array<double>, label int")
    for keys in ([], ["label"]):
        counted = spark.sparkContext.accumulator(0)

        def runner(*args, real=blocks._cell_runner, counted=counted):
            inner = real(*args)

            def run(batches):
                for out in inner(batches):
                    counted.add(out.num_rows)
                    yield out

            return run

        with monkeypatch.context() as patched:
            patched.setattr(blocks, "_cell_runner", runner)
            got = blocks.dense_topk(q_df, b_df, 2, keys, max_query_rows=10, max_bank_rows=10).collect()
        assert counted.value <= 2 * 2 * 300  # 40 bank blocks
        for i in range(300):
            allowed = [j for j in range(400) if not keys or i % 3 == j % 3]
            want = sorted(allowed, key=lambda j: (-round(float(q[i] @ b[j]), 9), j))[:2]
            assert [r["pos"] for r in sorted((r for r in got if r["qid"] == i), key=lambda r: r["rank"])] == want


def test_cells_that_take_turns_give_each_its_own_best():
    """Pairs come bank block by bank block, each with several query blocks in turn."""
    rng = np.random.default_rng(15)
    vectors = {side: rng.normal(size=(6, 3)) for side in (0, 1)}

    def packed(side, low):
        lists = pa.array([v.tolist() for v in vectors[side][low : low + 3]], pa.list_(pa.float64()))
        table = pa.table({"rid": pa.array(range(low, low + 3), pa.int64()), "vec": lists})
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, table.schema) as writer:
            writer.write_table(table)
        return sink.getvalue().to_pybytes()

    pairs = [{"held_no": b, "held": packed(1, b), "no": q, "asked": packed(0, q)} for b in (0, 3) for q in (0, 3)]
    run = blocks._cells_of_pairs(blocks._cell_runner(blocks._Dense, 1, [], ["qid", "pos", "score"]), [])
    got = [(r["qid"], r["pos"]) for out in run(iter([pa.RecordBatch.from_pylist(pairs)])) for r in out.to_pylist()]
    assert sorted(got) == list(enumerate(np.argmax(vectors[0] @ vectors[1].T, axis=1).tolist()))


def test_packed_blocks_hold_every_row_once(spark, monkeypatch):
    monkeypatch.setattr(blocks, "PACKED_VALUES", 6)
    rows = [(i % 3, i % 2, i, list(range(i % 9)), [1.0] * (i % 9), 1.0) for i in range(50)]
    df = spark.createDataFrame(rows, "key long, block int, rid long, tids array<long>, ws array<double>, scale double")
    df = df.repartition(2, "key").sortWithinPartitions("key", "block", "rid")
    found = []
    for r in blocks._packed_blocks(df, ["key"], 4).collect():
        held = pa.ipc.open_stream(r["data"]).read_all()
        assert held.num_rows <= 4 and (held.num_rows == 1 or sum(map(len, held["tids"].to_pylist())) <= 6)
        found += [(r["key"], r["block"], *row.values()) for row in held.to_pylist()]
    assert sorted(found) == sorted(rows)


def test_equal_scores_keep_the_lowest_positions_in_any_order():
    best = blocks._Best(1, 2, 0.0)
    for pos in ([40, 30], [7, 50], [20, 3]):
        best.add(np.full((2, 1), 0.5), np.array(pos))
    assert best.pos.tolist() == [3, 7]


def _odd_tables(spark):
    words = ["common", "rare", "fever", "cough", "rash", "pain"]
    texts = [" ".join(words[(i * 7 + j * j) % len(words)] for j in range(i % 6)) + f" common u{i % 9}" for i in range(40)]
    bank = [(i, t, f"s{i % 2}" if i % 13 else None) for i, t in enumerate(texts)]
    bank += [(3, "fever again", "s1"), (None, "rash pain", "s0"), (None, "rash twice", "s0"), (50, None, "s0"), (51, "", "s1")]
    queries = [(100 + i, t, f"s{i % 2}") for i, t in enumerate(texts[::3])]
    queries += [(None, "rash pain u1", "s0"), (200, None, "s1"), (201, "nothing shared here", "s0"), (100, "twice fever", "s0")]
    return (spark.createDataFrame(bank, "pos long, question string, subset string"),
            spark.createDataFrame(queries, "qid long, question string, subset string"))


def test_uncapped_vocabulary_by_hash_equals_the_terms_themselves(spark):
    bank, queries = _odd_tables(spark)
    order = lambda r: tuple((x is None, x) for x in r)
    placed = bank.where("pos is not null")  # without keys, padding needs positions
    cases = (({"sublinear_tf": True}, ["subset"], bank), ({"binary": True, "min_df": 2, "max_df": 0.5, "smooth_idf": False}, [], placed))
    for more, keys, rows in cases:
        found = []
        for limit, strategy in ((10**6, "term_join"), (None, "term_join"), (None, "blocked")):
            s = TfidfSettings(analyzer="word", ngram_min=1, ngram_max=2, max_features=limit, **more)
            top = sim.topk_scores(rows, queries, s, 3, keys=keys, strategy=strategy)
            got = top.select(*keys, "qid", "pos", F.round("score", 6), "rank").collect()
            found.append(sorted(map(tuple, got), key=order))
        assert found[0] == found[1] == found[2], (more, keys)
    spark.catalog.clearCache()


def test_hashed_counts_are_the_counts_of_the_terms(spark):
    from answerbank.operators.tfidf import hashed_counts, term_counts

    bank, _ = _odd_tables(spark)
    for analyzer, low, high in (("word", 1, 2), ("char_wb", 2, 3)):
        s = TfidfSettings(analyzer=analyzer, ngram_min=low, ngram_max=high, max_features=None)
        packed = hashed_counts(bank, "pos", "question", s, ["subset"])
        got = packed.select("subset", "id", F.inline(F.arrays_zip("tids", "tfs")))
        want = term_counts(bank, "pos", "question", s, ["subset"]).select("subset", "id", F.xxhash64("term"), F.col("tf").cast("int"))
        assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()


def test_only_the_blocks_and_the_best_stay_kept(spark):
    """Counts, vocabularies, postings and packed rows are dropped once both sides lie in blocks."""
    bank, queries = _odd_tables(spark)
    bank = bank.where("pos is not null")
    kept = spark.sparkContext._jsc.getPersistentRDDs
    for limit in (None, 1000):
        spark.catalog.clearCache()
        before = len(kept())
        s = TfidfSettings(analyzer="word", ngram_min=1, ngram_max=1, max_features=limit)
        top = sim.topk_scores(bank, queries, s, 2, strategy="blocked")
        assert len(kept()) - before <= (2 if limit is None else 3)  # a capped cut keeps its statistics
        assert top.count() and len(kept()) - before <= (3 if limit is None else 4)
    spark.catalog.clearCache()


def test_low_precision_decides_nothing(monkeypatch):
    """Tiles are scored in float32; scores that differ by less than its error still come in order, and exactly."""
    rng = np.random.default_rng(17)
    terms = rng.choice(10**6, 60, replace=False)
    ask = [np.sort(rng.choice(60, 40, replace=False)) for _ in range(9)]
    near = rng.random(60)
    rows = [near * (1 + 3e-8 * rng.permutation(60)) for _ in range(120)]

    def batch(tids, ws, scale):
        n = len(tids)
        return pa.RecordBatch.from_arrays(
            [pa.array(range(n), pa.int64()), pa.array([list(x) for x in tids], pa.list_(pa.int64())),
             pa.array([list(x) for x in ws], pa.list_(pa.float64())), pa.array(scale)], ["rid", "tids", "ws", "scale"])

    asked = batch([terms[x] for x in ask], [near[x] for x in ask], [1.0] * 9)
    held = batch([terms] * 120, rows, [0.1] * 120)
    want = []
    for x in ask:
        score = [float((near[x] * w[x]).sum() * 0.1) for w in rows]
        want.append(sorted(range(120), key=lambda j: (-round(score[j], 9), j))[:4])
    for ratio in (1, 10**9):
        monkeypatch.setattr(blocks, "DENSE_RATIO", ratio)
        monkeypatch.setattr(blocks, "SCRATCH_VALUES", 130)
        kinds, real = set(), blocks._Sparse.scores
        with monkeypatch.context() as patched:
            patched.setattr(blocks._Sparse, "scores", lambda *a: kinds.add(a[-1]) or real(*a))
            block = blocks._Sparse([asked])
            bests = block.bests(4)
            for low in (64, 0):
                block.meet(bests, held.slice(low, 64))
        assert kinds == {np.float32}
        ((query, pos, _),) = [[x.to_pylist() for x in found] for found in block.found(bests)]
        assert [[p for q, p in zip(query, pos) if q == i] for i in range(9)] == want


def test_a_vocabulary_cut_reads_its_statistics_as_one_leaf(spark, monkeypatch):
    """Every reading of the statistics held the plan of the texts; the driver kept and logged them all."""
    from answerbank.operators import tfidf

    plans, real = [], tfidf._limit_features
    monkeypatch.setattr(tfidf, "_limit_features", lambda stats, *a: plans.append(stats._jdf.queryExecution().optimizedPlan().toString()) or real(stats, *a))
    bank, _ = _odd_tables(spark)
    s = TfidfSettings(analyzer="word", ngram_min=1, ngram_max=1, max_features=5)
    counts = tfidf.term_counts(bank, "pos", "question", s, ["subset"])
    vocab = tfidf.fit_vocabulary(counts, bank.groupBy("subset").agg(F.count("*").alias("n")), s, ["subset"])
    assert vocab.groupBy("subset").count().agg(F.max("count")).first()[0] == 5
    assert len(plans) == 1 and len(plans[0].strip().splitlines()) == 1
