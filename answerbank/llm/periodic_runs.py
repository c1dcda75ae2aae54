"""Periodic runs of words by Baier's grouping and Lyndon roots (operator 11).

A run is a stretch of words with smallest period q, at least ``least_exponent * q`` and ``least_length`` words long, that no neighbour
extends with the same period.  Within each text:

* Grouping: phase one of Baier's suffix sorter keeps suffixes in groups that share a prefix, and refines lower groups by
  higher ones.  When a group's turn comes, its prefix is the longest Lyndon word from each of its places, so the Lyndon array is
  read off directly.  It runs twice, under an order of the words and under the reverse one.
* Roots: the longest Lyndon word from a place, under one of the two orders, is a root of every run (the runs theorem).  A run
  of exponent 3 or more holds two whole roots side by side; only such places are extended, one of each stretch.
* LCE: a root is extended to both sides by the longest common extension of its place and the place one
  period on, by comparing words in growing blocks; the result is exact.

Before that, words that can be in no run leave: each gram of ``g`` words inside a run of period q occurs at least
(max(least_length, least_exponent * q) - g + 1) // q times in it.  Stretches between rarer grams are cut, a few times over.
Grams are counted by a hash with the text's number; equal hashes of different grams only keep words that need not stay.

Words are ``[^\\x20\\x09-\\x0D]+``, numbered from 0.  Defined cases: a null or blank text has no words and no runs; rows with null or
repeated ids are judged each by itself; other columns are not read.  A text is handled whole, whatever its length.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from answerbank.llm.common import mix64, table, text_or_empty, text_slices

LEAST_EXPONENT, LEAST_LENGTH = 4, 6
#: Longest gram and rounds of the cut before the grouping (they affect speed only).
GRAM, CUTS = 3, 3
#: Odd factors that mix the words of a gram (fixed values).
FACTORS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)

Run = tuple[int, int, int]


def lyndon_lengths(symbols: list[int]) -> list[int]:
    """Length of the longest Lyndon word from each place, by the groups of phase one."""
    n = len(symbols)
    order = sorted(range(n), key=symbols.__getitem__)  # suffixes by group, the groups in ascending order
    place, group = [0] * n, [0] * n  # of a suffix: where it stands in ``order``, and where its group starts there
    size, prefix = [0] * n, [1] * n  # of a group, by its start
    for k, i in enumerate(order):
        place[i] = k
        group[i] = group[order[k - 1]] if k and symbols[order[k - 1]] == symbols[i] else k
        size[group[i]] += 1
    # A suffix to the left such that all between are in no lower group; it moves left as lower groups come up.
    left = list(range(-1, n - 1))
    lengths, end = [0] * n, n
    while end:
        first = group[order[end - 1]]
        u, hits = prefix[first], {}
        for i in order[first:end]:
            lengths[i] = u
            p = left[i]
            while p >= 0 and group[p] >= first:
                p = left[p]
            q = i
            while q != p:
                left[q], q = p, left[q]
            if p >= 0:
                hits[p] = hits.get(p, 0) + 1
        # A lower suffix with c members of this group behind it has its prefix grow by c times theirs and moves up in its group.
        moves: dict[tuple[int, int], list[int]] = {}
        for p, c in hits.items():
            moves.setdefault((-c, group[p]), []).append(p)
        for (c, old), moved in sorted(moves.items()):
            last, grown = old + size[old], prefix[old] - c * u
            if len(moved) < size[old]:
                size[old] -= len(moved)
                for p in moved:
                    last -= 1
                    other, k = order[last], place[p]
                    order[k], place[other] = other, k
                    order[last], place[p] = p, last
                for p in moved:
                    group[p] = last
                size[last] = len(moved)
                old = last
            prefix[old] = grown
        end = first
    return lengths


def common_extension(words: np.ndarray, i: int, j: int) -> int:
    """How many words from i on equal those from j on (i < j)."""
    done, step, most = 0, 16, len(words) - j
    while done < most:
        block = min(step, most - done)
        differ = words[i + done : i + done + block] != words[j + done : j + done + block]
        k = int(differ.argmax())
        if differ[k]:
            return done + k
        done, step = done + block, 2 * step
    return done


def runs_of(words: np.ndarray, least_exponent: int = LEAST_EXPONENT, least_length: int = LEAST_LENGTH) -> list[Run]:
    """``(start, length, period)`` of every run of a sequence of word numbers, by start and period."""
    n, found = len(words), set()
    back = words[::-1]
    for symbols in (words, -words):
        roots = np.array(lyndon_lengths(symbols.tolist()), dtype=np.int64)
        at = np.arange(n)
        following = at + roots
        usable = following < n
        if least_exponent >= 3:  # two whole roots side by side
            beside = np.minimum(following, n - 1)
            usable &= (roots[beside] == roots) & (words[beside] == words)
        reached: dict[int, int] = {}  # by period, how far the last stretch goes
        for i in at[usable].tolist():
            q = int(roots[i])
            if i + q < reached.get(q, 0):
                continue  # in the stretch found from its first root
            high = i + q + common_extension(words, i, i + q)
            low = i - common_extension(back, n - i - q, n - i)
            reached[q] = high
            if high - low >= max(least_length, least_exponent * q):
                found.add((low, high - low, q))
    return sorted(found, key=lambda run: (run[0], run[2]))


def stretches(words: np.ndarray, texts: np.ndarray, least_exponent: int, least_length: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the stretches of ``words`` (numbers; ``texts`` ascend) that can hold runs; none crosses texts."""

    def least_count(g: int) -> int:  # over all periods; from q = least_length on it cannot fall further
        return min((max(least_length, least_exponent * q) - g + 1) // q for q in range(1, max(least_length, g) + 1))

    gram = next((g for g in range(GRAM, 0, -1) if least_count(g) > 1), 1)
    need = least_count(gram)
    edges = np.flatnonzero(np.concatenate(([True], texts[1:] != texts[:-1]))) if len(texts) else np.zeros(0, np.int64)
    starts, ends = edges, np.append(edges[1:], len(texts))[: len(edges)]
    for _ in range(CUTS):
        long = ends - starts >= max(least_length, gram)
        starts, ends = starts[long], ends[long]
        sizes = ends - starts - gram + 1
        if not len(starts):
            break
        owner = np.repeat(np.arange(len(starts)), sizes)
        at = np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes) + starts[owner]
        key = mix64(owner.astype(np.uint64))
        for g in range(gram):
            key += mix64(words[at + g].astype(np.uint64) * np.uint64(FACTORS[g]) + np.uint64(g))
        _, name, counts = np.unique(key, return_inverse=True, return_counts=True)
        keep = counts[name] >= need
        at, owner = at[keep], owner[keep]
        if not len(at):
            return at, at
        first = np.concatenate(([True], (at[1:] != at[:-1] + 1) | (owner[1:] != owner[:-1])))
        begin = np.flatnonzero(first)
        last = np.append(begin[1:], len(at)) - 1
        starts, ends, before = at[begin], at[last] + gram, len(starts)
        if len(starts) == before and keep.all():
            break
    long = ends - starts >= least_length
    return starts[long], ends[long]


def best_of(runs: list[Run]) -> Run | None:
    """The run with the greatest exact exponent; ties by smallest start, then period."""
    best = None
    for run in runs:  # by start, then period
        if best is None or run[1] * best[2] > best[1] * run[2]:
            best = run
    return best


RUN = "struct<start:long,length:long,period:long>"


def periodic_runs(
    docs: DataFrame,
    least_exponent: int = LEAST_EXPONENT,
    least_length: int = LEAST_LENGTH,
    rewrite: Callable[[object, list[bytes]], list[bytes]] | None = None,
) -> DataFrame:
    """``doc_id, n_words, runs, best, collapsed`` of every row of ``docs`` (doc_id, text); ``rewrite(doc_id, words)`` may change a text's words first.

    ``runs`` are ordered by start and period; ``best`` has the greatest exponent (null without a run); ``collapsed`` is the text's words
    without those that any run holds after its first period, joined by one space.
    """
    if least_exponent < 2 or least_length < 1:
        raise ValueError("a run repeats at least once")
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        struct = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
        for batch in batches:
            for low, high in text_slices(batch, "text"):
                part = batch.slice(low, high - low)
                words = [text.as_py().encode().split() for text in part.column("text")]  # splits at just these six bytes
                if rewrite is not None:
                    words = [rewrite(key.as_py(), row) for key, row in zip(part.column("doc_id"), words)]
                numbers: dict[bytes, int] = {}
                flat = np.array([numbers.setdefault(w, len(numbers)) for row in words for w in row], dtype=np.int64)
                counts = np.array([len(row) for row in words], dtype=np.int64)
                base = np.cumsum(counts) - counts
                texts = np.repeat(np.arange(len(words)), counts)
                found: list[list[Run]] = [[] for _ in words]
                for a, b in zip(*(x.tolist() for x in stretches(flat, texts, least_exponent, least_length))):
                    row = int(texts[a])
                    shift = a - int(base[row])
                    found[row] += [(s + shift, n, q) for s, n, q in runs_of(flat[a:b], least_exponent, least_length)]
                collapsed = []
                for row, runs in zip(words, found):
                    if runs:
                        keep = np.ones(len(row), dtype=bool)
                        for s, n, q in runs:
                            keep[s + q : s + n] = False
                        row = [row[k] for k in np.flatnonzero(keep)]
                    collapsed.append(b" ".join(row).decode())
                as_dict = lambda r: None if r is None else dict(zip(("start", "length", "period"), r))
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id"),
                        pa.array(counts),
                        pa.array([[as_dict(r) for r in runs] for runs in found], pa.list_(struct)),
                        pa.array([as_dict(best_of(runs)) for runs in found], struct),
                        pa.array(collapsed, pa.string()),
                    ],
                    ["doc_id", "n_words", "runs", "best", "collapsed"],
                )

    schema = f"doc_id {kind}, n_words long, runs array<{RUN}>, best {RUN}, collapsed string"
    return docs.select("doc_id", text_or_empty().alias("text")).mapInArrow(run, schema)


def with_periods(doc_id, words: list[bytes]) -> list[bytes]:
    """The words of a tenth of all documents repeat, from a place and with a period that crc32 of the id as text gives."""
    h, n = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1, len(words)
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + k % p] for k in range(n - a)]


def documents_runs(spark, sf_dir: str) -> DataFrame:
    """Query op11: runs of whole texts of documents, of which a tenth repeat words with a period given by their id."""
    docs = table(spark, sf_dir, "documents")
    found = periodic_runs(docs, rewrite=with_periods)
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    listed = F.array_join(F.transform(lines, lambda line: F.concat(line, F.lit("\n"))), "")
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        F.col("best.start").alias("start"),
        F.col("best.length").alias("length"),
        F.col("best.period").alias("period"),
        F.expr("best.length * 1000 div best.period").alias("exponent_milli"),
        F.sha2(listed, 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
