"""N-gram generators as array-valued Column expressions (V1-V3).

Generation is split in two steps so it stays linear in the text length:

1. ``units(t, analyzer)`` turns the normalised text into an array once:
   code points (``char``), code points of each space-padded word
   (``char_wb``), or word tokens (``word``). UTF-8 ``substring`` is O(position),
   so slicing the text directly would be quadratic on long documents.
2. ``ngrams_from_units(u, …)`` reads that *materialised* column inside the
   lambdas (``slice`` + ``array_join``), never re-evaluating step 1.

The multiset of emitted n-grams equals the published character /
padded-word / word-token analyzers; order inside the array does not matter.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from answerbank.functions.text import WORD_TOKEN


def _empty() -> Column:
    return F.array().cast("array<string>")


def units(t: Column, analyzer: str) -> Column:
    """Step 1: the array an analyzer slices (``t`` is whitespace-normalised text)."""
    if analyzer == "char":
        return F.when(t == "", _empty()).otherwise(F.split(t, ""))
    if analyzer == "char_wb":
        words = F.filter(F.split(t, " "), lambda w: w != "")
        return F.transform(words, lambda w: F.split(F.concat(F.lit(" "), w, F.lit(" ")), ""))
    if analyzer == "word":
        return F.regexp_extract_all(t, F.lit(WORD_TOKEN), 0)
    raise ValueError(f"unknown analyzer {analyzer!r}")


def _windows(u: Column, nmin: int, nmax: int, sep: str) -> Column:
    size = F.size(u)
    return F.flatten(
        F.transform(
            F.sequence(F.lit(nmin), F.lit(nmax)),
            lambda n: F.when(
                size >= n, F.transform(F.sequence(F.lit(1), size - n + 1), lambda i: F.array_join(F.slice(u, i, n), sep))
            ).otherwise(_empty()),
        )
    )


def char_ngrams(chars: Column, nmin: int, nmax: int) -> Column:
    """V1 ``char``: every substring of length n in [nmin, nmax]; none when the text is shorter than n."""
    return _windows(chars, nmin, nmax, "")


def char_wb_ngrams(padded_words: Column, nmin: int, nmax: int) -> Column:
    """V2 ``char_wb``: n-grams inside each space-padded word.

    A padded word of length L gives its L-n+1 windows while L > n; at the
    first n with L <= n it is emitted whole, once, and longer n add nothing.
    """

    def per_word(pc: Column) -> Column:
        length = F.size(pc)
        return F.flatten(
            F.transform(
                F.sequence(F.lit(nmin), F.lit(nmax)),
                lambda n: F.when(
                    length > n,
                    F.transform(F.sequence(F.lit(1), length - n + 1), lambda i: F.array_join(F.slice(pc, i, n), "")),
                )
                .when((length == n) | ((n == nmin) & (length < n)), F.array(F.array_join(pc, "")))
                .otherwise(_empty()),
            )
        )

    return F.flatten(F.transform(padded_words, per_word))


def word_ngrams(tokens: Column, nmin: int, nmax: int) -> Column:
    """V3 ``word``: runs of two or more word characters, joined into n-grams by one space."""
    return _windows(tokens, nmin, nmax, " ")


def ngrams_from_units(u: Column, analyzer: str, nmin: int, nmax: int) -> Column:
    """Step 2: n-grams of a materialised ``units`` column."""
    if nmin < 1 or nmax < nmin:
        raise ValueError(f"bad n-gram range ({nmin}, {nmax})")
    if analyzer == "char":
        return char_ngrams(u, nmin, nmax)
    if analyzer == "char_wb":
        return char_wb_ngrams(u, nmin, nmax)
    if analyzer == "word":
        return word_ngrams(u, nmin, nmax)
    raise ValueError(f"unknown analyzer {analyzer!r}")
