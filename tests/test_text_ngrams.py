"""N-gram generators against a brute-force implementation of the published analyzers."""

import random
import re

from pyspark.sql import functions as F

from answerbank.functions import text as X
from answerbank.functions.ngrams import ngrams_from_units, units


def _norm(t):
    return re.sub(r"\s+", " ", t).strip()


def ref_char(t, a, b):
    t = _norm(t)
    return sorted(t[i:i + n] for n in range(a, b + 1) for i in range(len(t) - n + 1))


def ref_char_wb(t, a, b):
    out = []
    for w in _norm(t).split():
        w = f" {w} "
        for n in range(a, b + 1):
            offset = 0
            out.append(w[offset:offset + n])
            while offset + n < len(w):
                offset += 1
                out.append(w[offset:offset + n])
            if offset == 0:
                break
    return sorted(out)


def ref_word(t, a, b):
    toks = re.findall(r"(?u)\b\w\w+\b", _norm(t))
    return sorted(" ".join(toks[i:i + n]) for n in range(a, b + 1) for i in range(len(toks) - n + 1))


def _texts():
    rng = random.Random(7)
    alphabet = "abcé ü  \t\nxyz,.Ωa"
    texts = ["", " ", "a", "ab", "a b c", "I x", "héllo wörld", "tab\tsep nbsp line", "  lead trail  "]
    for _ in range(60):
        texts.append("".join(rng.choice(alphabet) for _ in range(rng.randint(0, 30))))
    return texts


def test_ngrams_match_reference(spark):
    texts = _texts()
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, t string")
    for analyzer, ref in (("char", ref_char), ("char_wb", ref_char_wb), ("word", ref_word)):
        for a, b in ((1, 1), (1, 3), (2, 4), (3, 5)):
            u = df.select("id", units(X.normalize_ws("t"), analyzer).alias("u"))
            got = {r["id"]: sorted(r["g"]) for r in u.select("id", ngrams_from_units(F.col("u"), analyzer, a, b).alias("g")).collect()}
            for i, t in enumerate(texts):
                assert got[i] == ref(t, a, b), (analyzer, a, b, t)


def test_whitespace_and_trims(spark):
    rows = [("a  b\x1f c d  ", 2), ("one  two", 5), ("", 3)]
    df = spark.createDataFrame(rows, "t string, n int")
    out = df.select(
        X.normalize_ws("t").alias("norm"), X.word_count("t").alias("wc"),
        X.trim_words("t", F.col("n")).alias("tw"), X.trim_words_keep("t", F.col("n")).alias("tk"),
    ).collect()
    assert out[0]["norm"] == "a b c d" and out[0]["wc"] == 4 and out[0]["tw"] == "a b"
    # a text that fits keeps its inner spacing with the keep-variant, not with the re-joining one
    assert out[1]["tk"] == "one  two" and out[1]["tw"] == "one two"
    assert out[2]["wc"] == 0 and out[2]["tw"] == ""


def test_parse_decision(spark):
    cases = {
        '{"choice": "B", "confidence": 0.61, "reason": "covers the dose"}': ("B", 0.61, "covers the dose"),
        '<think>A? B?</think> {"choice": "B", "confidence": 7, "reason": "sure"}': ("B", 1.0, "sure"),
        "Both look alike to me.": ("A", 0.0, "fallback_parse"),
        "take b with score = 0.55": ("B", 0.55, "fallback_parse"),
        '{"choice": " b\\n", "confidence": 0.9}': ("B", 0.9, "json"),
        '{"choice": "B", "confidence": true, "reason": false}': ("B", 1.0, "False"),
        '{"choice": "B", "confidence": null, "reason": "x"}': ("B", 0.0, "fallback_parse"),
        '{"choice": "B", "confidence": " 0.75 ", "reason": null}': ("B", 0.75, "None"),
        '{"choice": "B", "confidence": "high"} score: 0.4': ("B", 0.4, "fallback_parse"),
        "{'choice': 'A', 'confidence': 0.8}": ("A", 0.8, "fallback_parse"),
        '{"choice": "B", "confidence": 0.7': ("B", 0.7, "fallback_parse"),
        '{"choice": null, "reason": 12}': ("A", 0.0, "12"),
        '{"choice": "B", "confidence": "-inf"}': ("B", 0.0, "json"),
        "{}": ("A", 0.0, "json"),
    }
    df = spark.createDataFrame([(r,) for r in cases], "raw string")
    got = {r[0]: tuple(r[1]) for r in df.select("raw", X.parse_decision("raw").alias("d")).collect()}
    assert got == cases
