"""Runs of words against brute force."""

import hashlib
import random
import zlib

import numpy as np

from answerbank.llm import periodic_runs as P

SF = "/root/testdata/sf0.001"


def smallest_period(w):
    return next(q for q in range(1, len(w) + 1) if all(w[k] == w[k + q] for k in range(len(w) - q)))


def brute_runs(w, exponent=4, length=6):
    out, n = [], len(w)
    for q in range(1, n // exponent + 1):
        i = 0
        while i + q < n:
            if w[i] != w[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            if j + q - i >= max(length, exponent * q) and smallest_period(w[i : j + q]) == q:
                out.append((i, j + q - i, q))
            i = j
    return sorted(out, key=lambda r: (r[0], r[2]))


def brute_lyndon(w):
    def lyndon(x):
        return all(x < x[k:] for k in range(1, len(x)))

    return [max(m for m in range(1, len(w) - i + 1) if lyndon(w[i : i + m])) for i in range(len(w))]


def sequences(seed, count, longest):
    rng = random.Random(seed)
    for _ in range(count):
        w = []
        while len(w) < rng.randint(0, longest):
            unit = [rng.randint(0, rng.choice((1, 2, 5))) for _ in range(rng.randint(1, 7))]
            w += unit * rng.randint(1, 6) + unit[: rng.randint(0, len(unit))]
        yield w


def test_groups_give_the_lyndon_array_under_both_orders():
    for w in sequences(1, 150, 30):
        assert P.lyndon_lengths(w) == brute_lyndon(w)
        assert P.lyndon_lengths([-x for x in w]) == brute_lyndon([-x for x in w])


def test_runs_equal_brute_force():
    for w in sequences(2, 400, 90):
        for exponent, length in ((2, 2), (3, 5), (4, 6)):
            assert P.runs_of(np.array(w, dtype=np.int64), exponent, length) == brute_runs(w, exponent, length)


def test_cut_stretches_keep_every_run():
    texts = list(sequences(3, 200, 120))
    flat = np.array([x for w in texts for x in w], dtype=np.int64)
    rows = np.repeat(np.arange(len(texts)), [len(w) for w in texts])
    for exponent, length in ((2, 2), (2, 4), (4, 6)):
        found = [[] for _ in texts]
        for a, b in zip(*P.stretches(flat, rows, exponent, length)):
            assert rows[a] == rows[b - 1]
            base = int(np.searchsorted(rows, rows[a]))
            found[rows[a]] += [(s + a - base, n, q) for s, n, q in P.runs_of(flat[a:b], exponent, length)]
        assert [[tuple(map(int, r)) for r in x] for x in found] == [brute_runs(w, exponent, length) for w in texts]


def expected(doc_id, text):
    words = (text or "").encode().split()
    if doc_id is not None:
        h, n = zlib.crc32(str(doc_id).encode()), len(words)
        g = h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = brute_runs(words)
    best = min(runs, key=lambda r: (-r[1] / r[2], r[0], r[2]), default=None)
    gone = {k for s, n, q in runs for k in range(s + q, s + n)}
    kept = b" ".join(w for k, w in enumerate(words) if k not in gone)
    listed = "".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()
    digest = lambda x: hashlib.sha256(x).hexdigest()
    facts = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return (doc_id, len(runs), *facts, digest(listed), digest(kept))


def test_query_and_odd_rows(spark, tmp_path):
    rng = random.Random(4)
    rows = [(None, "a b " * 9), (1, None), (1, ""), (2, " \t\n "), (3, "x " * 40), (3, "x " * 40), (4, "é é é é " * 5 + " "), (5, "<|x|> \x1c " * 8)]
    rows += [(k, " ".join(rng.choice("abc") for _ in range(rng.randint(1, 90)))) for k in range(10, 260)]
    schema = "doc_id long, text string, runs string, best int, n_words string"
    docs = spark.createDataFrame([(*r, "z", 1, None) for r in rows], schema)
    docs.repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = P.documents_runs(spark, str(tmp_path)).collect()
    key = lambda r: tuple((x is not None, x) for x in r)
    assert sorted(map(tuple, got), key=key) == sorted((expected(*r) for r in rows), key=key)
    assert any(zlib.crc32(str(k).encode()) % 10 == 0 for k in range(10, 260))
    assert P.periodic_runs(docs.limit(0)).count() == 0


def test_query_on_the_small_table(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    rows = [r for r in rows if len((r["text"] or "").split()) < 400]
    got = {r["doc_id"]: tuple(r) for r in P.documents_runs(spark, SF).collect()}
    for r in rows:
        assert got[r["doc_id"]] == expected(r["doc_id"], r["text"])


def test_long_periodic_text(spark):
    text = " ".join(str(k % 977) for k in range(40000)) + " " + "a b " * 30000
    row = P.periodic_runs(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert [tuple(r) for r in row["runs"]] == [(0, 40000, 977), (40000, 60000, 2)]
