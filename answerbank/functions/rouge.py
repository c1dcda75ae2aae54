"""ROUGE-1 / ROUGE-L F-measures (R1-R4) on whole texts.

Tokens are maximal ``[a-z0-9]+`` runs of the lower-cased text (no stemming),
so non-ASCII letters separate tokens and a text in another script scores 0.
ROUGE-1 is the clipped multiset overlap; ROUGE-L uses the longest common
subsequence. Precision/recall/F follow the published scorer: an empty side
gives 0.

The pair score runs in an Arrow-batched pandas UDF: the LCS has no JVM
builtin, and the bit-parallel form (one big-int update per prediction token)
keeps the per-row helper small and linear in the token count.
"""

from __future__ import annotations

import re
from collections import Counter

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

# Fixed value: the token rule of the published scorer without stemming.
TOKEN = re.compile(r"[a-z0-9]+")
TOKEN_PATTERN = "[a-z0-9]+"


def tokens(text: str | None) -> list[str]:
    return TOKEN.findall((text or "").lower())


def _masks(a: list[str]) -> dict[str, int]:
    masks: dict[str, int] = {}
    for i, tok in enumerate(a):
        masks[tok] = masks.get(tok, 0) | (1 << i)
    return masks


def _lcs_with_masks(n: int, masks: dict[str, int], b: list[str]) -> int:
    """LCS length by the bit-vector recurrence: V' = (V + (V & M[y])) | (V - (V & M[y]))."""
    if not n or not b:
        return 0
    full = (1 << n) - 1
    v = full
    for tok in b:
        m = masks.get(tok)
        if m:
            u = v & m
            v = ((v + u) | (v - u)) & full
    return n - v.bit_count()


def lcs_length(a: list[str], b: list[str]) -> int:
    return _lcs_with_masks(len(a), _masks(a), b)


def _f(overlap: int, n_pred: int, n_ref: int) -> float:
    p = overlap / max(n_pred, 1)
    r = overlap / max(n_ref, 1)
    return 0.0 if p + r == 0 else 2 * p * r / (p + r)


def _reference(text: str | None) -> tuple[int, Counter, dict[str, int]]:
    ref = tokens(text)
    return len(ref), Counter(ref), _masks(ref)


def _scores(ref_info: tuple[int, Counter, dict[str, int]], prediction: str | None) -> tuple[float, float]:
    n_ref, rc, masks = ref_info
    pred = tokens(prediction)
    if not n_ref or not pred:
        return 0.0, 0.0
    pc = Counter(pred)
    overlap = sum(min(c, pc[t]) for t, c in rc.items())
    return _f(overlap, len(pred), n_ref), _f(_lcs_with_masks(n_ref, masks, pred), len(pred), n_ref)


class Walk:
    """A candidate that grows token by token against one reference, readable after every token.

    The bit vector holds the LCS of what was walked so far, and ``left`` how many of each reference token are
    not matched yet, so one walk scores every prefix of a text.
    """

    __slots__ = ("n_ref", "masks", "full", "v", "left", "overlap", "n")

    def __init__(self, reference: str | None):
        self.n_ref, counts, self.masks = _reference(reference)
        self.full = self.v = (1 << self.n_ref) - 1
        self.left, self.overlap, self.n = dict(counts), 0, 0

    def fork(self) -> "Walk":
        """Another walk that goes on from here."""
        other = object.__new__(Walk)
        for name in Walk.__slots__:
            setattr(other, name, getattr(self, name))
        other.left = dict(self.left)
        return other

    def extend(self, toks: list[str]) -> None:
        self.n += len(toks)
        masks, left, v = self.masks, self.left, self.v
        for tok in toks:
            m = masks.get(tok)
            if m is None:
                continue
            u = v & m
            v = ((v + u) | (v - u)) & self.full
            if left[tok]:
                left[tok] -= 1
                self.overlap += 1
        self.v = v

    def scores(self) -> tuple[float, float]:
        """(rouge1 F, rougeL F) of the tokens walked so far."""
        if not self.n_ref or not self.n:
            return 0.0, 0.0
        return _f(self.overlap, self.n, self.n_ref), _f(self.n_ref - self.v.bit_count(), self.n, self.n_ref)


def pair_scores(reference: str | None, prediction: str | None) -> tuple[float, float]:
    """(rouge1 F, rougeL F) of one pair; the row-level reference implementation."""
    return _scores(_reference(reference), prediction)


ROUGE_TYPE = T.StructType([T.StructField("rouge1", T.DoubleType()), T.StructField("rouge_l", T.DoubleType())])


@pandas_udf(ROUGE_TYPE)
def _rouge_udf(reference: pd.Series, prediction: pd.Series) -> pd.DataFrame:
    r1, rl = [], []
    seen: dict[str, tuple] = {}  # one reference is often scored against many candidates in a batch
    for ref, pred in zip(reference.tolist(), prediction.tolist()):
        info = seen.get(ref)
        if info is None:
            info = seen[ref] = _reference(ref)
        a, b = _scores(info, pred)
        r1.append(a)
        rl.append(b)
    return pd.DataFrame({"rouge1": r1, "rouge_l": rl})


def rouge(reference: Column | str, prediction: Column | str) -> Column:
    """R2+R3: struct(rouge1, rouge_l) per row."""
    ref = F.col(reference) if isinstance(reference, str) else reference
    pred = F.col(prediction) if isinstance(prediction, str) else prediction
    return _rouge_udf(F.coalesce(ref, F.lit("")), F.coalesce(pred, F.lit("")))


def weighted(r: Column) -> Column:
    """0.5·ROUGE-1 + 0.5·ROUGE-L."""
    return 0.5 * r["rouge1"] + 0.5 * r["rouge_l"]

