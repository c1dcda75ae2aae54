import random

from answerbank.functions import rouge as R


def _lcs_dp(a, b):
    t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            t[i][j] = t[i - 1][j - 1] + 1 if a[i - 1] == b[j - 1] else max(t[i - 1][j], t[i][j - 1])
    return t[-1][-1]


def test_bit_parallel_lcs_equals_dp():
    rng = random.Random(3)
    for _ in range(300):
        a = [rng.choice("abcde") for _ in range(rng.randint(0, 40))]
        b = [rng.choice("abcde") for _ in range(rng.randint(0, 40))]
        assert R.lcs_length(a, b) == _lcs_dp(a, b)


def test_rouge_properties():
    assert R.pair_scores("the cat sat", "the cat sat") == (1.0, 1.0)
    assert R.pair_scores("a b", "c d") == (0.0, 0.0)
    assert R.pair_scores("", "a") == (0.0, 0.0)
    assert R.pair_scores("ሰላም ነው", "ሰላም ነው") == (0.0, 0.0)  # non-ASCII script has no tokens
    r1, rl = R.pair_scores("a b c", "c b a")
    assert r1 == 1.0 and rl < 1.0
    # clipping: repeated prediction tokens count at most as often as in the reference
    r1, _ = R.pair_scores("a b", "a a a a")
    assert abs(r1 - 2 * (1 / 4) * (1 / 2) / (1 / 4 + 1 / 2)) < 1e-12
    assert R.pair_scores("x y", "y x")[0] == R.pair_scores("y x", "x y")[0]


def test_rouge_udf_matches_python(spark):
    rows = [("The cat, sat!", "the cat sat"), ("", "x"), ("é a", "a é"), (None, None)]
    df = spark.createDataFrame(rows, "r string, p string")
    got = [tuple(x) for x in df.select(R.rouge("r", "p").alias("s")).select("s.*").collect()]
    assert got == [R.pair_scores(r or "", p or "") for r, p in rows]


def test_walk_scores_every_prefix():
    import random

    rng = random.Random(5)
    for _ in range(200):
        ref, pred = (" ".join(rng.choice("abcd") for _ in range(rng.randint(0, 12))) for _ in range(2))
        walk, words = R.Walk(ref), pred.split()
        assert walk.scores() == (0.0, 0.0)
        for k, word in enumerate(words, start=1):
            walk.extend(R.tokens(word))
            assert walk.scores() == R.pair_scores(ref, " ".join(words[:k]))
            fork = walk.fork()
            fork.extend(["a", "zz"])
            assert fork.scores() == R.pair_scores(ref, " ".join(words[:k]) + " a zz")
