"""Removal of repeated line runs by a suffix array over line ids (operator 9).

Each line is an id (64-bit hash); a document is a sequence of ids.  Prefix doubling ranks the strings of 2^k lines that start at
each position: the rank of 2^(k+1) lines is the place of the pair (rank at i, rank at i + 2^k) among all
sorted pairs.  Only tied positions go on: a string that occurs once is in no repeated run.  Positions with the same rank
form an interval of the suffix array whose longest common prefix is at least 2^k lines; any run of m lines is named by two
ranks that overlap (at its start and 2^k lines before its end, 2^k <= m).

A repeated run counts if it has ``LEAST_CHARS`` characters (with its line ends).  The lines of all maximal repeated runs that
count are the union of the shortest counting runs from each line on and up to each line, so doubling ends at the
longest of these, ``LEAST_CHARS`` lines at most.  Of each such run the first copy, by ascending ``doc_id`` and then place in the
text, stays; lines that lie in a later copy are deleted.

Defined cases: a null text stays null and an empty one empty; rows with null ids come last; rows with equal id and equal
text are one document and change alike; a text that loses no line stays as it is; other columns stay.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from answerbank.llm.common import checkpointed, span_hashes, table, text_bytes, text_slices, widened

LEAST_CHARS = 100
LAST = (1 << 63) - 1


def line_edges(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and rows of the lines of each text (a text of n line feeds has n + 1 lines)."""
    feeds = np.flatnonzero(data == 10)
    starts = np.concatenate((offsets[:-1], feeds + 1))
    ends = np.concatenate((feeds, offsets[1:]))
    rows = np.concatenate((np.arange(len(offsets) - 1), np.searchsorted(offsets, feeds, side="right") - 1))
    order = np.lexsort((starts, rows))
    starts, rows = starts[order], rows[order]
    return starts, np.sort(ends), rows


def line_rows(docs: DataFrame, least_chars: int) -> DataFrame:
    """``d, t, i, h, runs``: key, line number, line hash and the lengths (in lines) of the shortest counting runs that start here."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high in text_slices(batch, "text"):
                part = batch.slice(low, high - low)
                data, offsets = text_bytes(part.column("text"))
                starts, ends, rows = line_edges(data, offsets)
                hashes = span_hashes(data, starts, ends)
                first = np.searchsorted(rows, np.arange(len(offsets)))
                number = np.arange(len(rows)) - first[rows]
                # Characters up to each line's end, over all texts; a run must stay in its text.
                chars = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))
                until = (chars[ends] + np.arange(1, len(ends) + 1)).astype(np.int64)
                before = np.concatenate(([0], until[:-1]))
                stop = np.searchsorted(until, before + least_chars)  # last line of the shortest run from each line on
                begin = np.searchsorted(before, until - least_chars, side="right") - 1  # first line of that up to each line
                lines = np.arange(len(rows))
                ahead = lines[(stop < first[rows + 1])]
                back = lines[begin >= first[rows]]
                at = np.concatenate((ahead, begin[back]))
                length = np.concatenate((stop[ahead] - ahead + 1, back - begin[back] + 1))
                pairs = np.unique(np.stack((at, length)), axis=1) if len(at) else np.zeros((2, 0), np.int64)
                bounds = np.searchsorted(pairs[0], np.arange(len(rows) + 1))
                runs = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(pairs[1], pa.int32()))
                taken = pa.array(rows, pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(taken), part.column(1).take(taken), pa.array(number, pa.int32()), pa.array(hashes.view(np.int64)), runs],
                    ["d", "t", "i", "h", "runs"],
                )

    return docs.select("d", "t", "text").mapInArrow(run, "d long, t long, i int, h long, runs array<int>")


def sorted_places(keys: DataFrame, *columns: str) -> DataFrame:
    """Add ``rank``: ascending with the sort order of ``columns`` (unique, not gapless)."""
    return checkpointed(keys.orderBy(*columns).withColumn("rank", F.monotonically_increasing_id()))


def tied(positions: DataFrame, columns: list[str], rank: str) -> DataFrame:
    """Positions whose ``columns`` occur at least twice, ranked by them in ``rank``."""
    often = positions.groupBy(*columns).agg(F.count("*").alias("n")).filter("n > 1").drop("n")
    ranks = sorted_places(often, *columns).withColumnRenamed("rank", rank)
    return positions.join(ranks, columns, "inner")


def run_keys(ranked: DataFrame, levels: int) -> DataFrame:
    """``d, t, i, m, a, b`` of every counting run of tied lines: two ranks that name its m lines."""
    fields = [F.col("i"), F.col("runs"), *(F.col(f"r{k}") for k in range(levels))]
    docs = ranked.groupBy("d", "t").agg(F.collect_list(F.struct(*fields)).alias("lines"))  # lines of one document

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for d, t, lines in zip(*(batch.column(k).to_pylist() for k in range(3))):
                by_line = {x["i"]: x for x in lines}
                for i, x in by_line.items():
                    for m in x["runs"] or ():
                        k = m.bit_length() - 1
                        if k >= levels:
                            continue
                        other = by_line.get(i + m - (1 << k))
                        a, b = x[f"r{k}"], other and other[f"r{k}"]
                        if a is not None and b is not None:
                            out.append((d, t, i, m, a, b))
            columns = list(zip(*out)) if out else [[]] * 6
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["d", "t", "i", "m", "a", "b"])

    return docs.mapInArrow(run, "d long, t long, i int, m int, a long, b long")


def later_copies(lines: DataFrame) -> DataFrame:
    """``d, t, copies``: line ranges (first line, lines) of each document that are later copies of a run."""
    ranked = checkpointed(tied(lines.dropDuplicates(["d", "t", "i"]), ["h"], "r0").drop("h"))
    longest = ranked.agg(F.max(F.array_max("runs"))).first()[0] or 0
    levels = 1
    while 1 << levels <= longest:
        half, last = 1 << (levels - 1), f"r{levels - 1}"
        ahead = Window.partitionBy("d", "t").orderBy("i").rangeBetween(half, half)
        paired = ranked.withColumn("__next", F.first(last).over(ahead)).select("d", "t", "i", F.col(last).alias("__own"), "__next")
        paired = paired.filter(F.col("__own").isNotNull() & F.col("__next").isNotNull())
        longer = tied(paired, ["__own", "__next"], f"r{levels}").select("d", "t", "i", f"r{levels}")
        ranked = checkpointed(ranked.join(longer, ["d", "t", "i"], "left"))
        levels += 1
    runs = checkpointed(run_keys(ranked, levels))
    place = F.struct("d", "t", "i")
    firsts = runs.groupBy("m", "a", "b").agg(F.min(place).alias("first"), F.count("*").alias("n")).filter("n > 1").drop("n")
    firsts = checkpointed(firsts)  # so that the join shuffles both sides and Spark can split a common run
    copies = runs.join(firsts, ["m", "a", "b"]).filter(place != F.col("first"))
    return copies.groupBy("d", "t").agg(F.collect_list(F.struct("i", "m")).alias("copies"))


def remove_repeats(docs: DataFrame, least_chars: int = LEAST_CHARS) -> DataFrame:
    """``docs`` with the text less its later copies, and ``__lines`` and ``__removed``: its lines and how many went."""
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST))
    keyed = docs.withColumns({"__d": key, "__t": F.xxhash64("text")})
    lines = line_rows(keyed.filter(F.col("text").isNotNull()).select(F.col("__d").alias("d"), F.col("__t").alias("t"), "text"), least_chars)
    copies = later_copies(lines).select(F.col("d").alias("__d"), F.col("t").alias("__t"), F.col("copies").alias("__copies"))
    joined = keyed.join(copies, ["__d", "__t"], "left").select(*docs.columns, "__copies")
    kept = [f.name for f in docs.schema.fields]
    schema = widened(docs.schema, __lines="long", __removed="long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, n_lines, n_removed = [], [], []
            for text, copies in zip(batch.column(kept.index("text")), batch.column("__copies")):
                text, copies = text.as_py(), copies.as_py()
                n_lines.append(text.count("\n") + 1 if text is not None else 0)
                n_removed.append(0)
                if copies:
                    gone = np.zeros(n_lines[-1], dtype=bool)
                    for x in copies:
                        gone[x["i"] : x["i"] + x["m"]] = True
                    text = "\n".join(line for line, out in zip(text.split("\n"), gone.tolist()) if not out)
                    n_removed[-1] = int(gone.sum())
                texts.append(text)
            columns = [pa.array(texts, pa.string()) if c == "text" else batch.column(c) for c in kept]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(n_lines, pa.int64()), pa.array(n_removed, pa.int64())], [*kept, "__lines", "__removed"])

    return joined.mapInArrow(run, schema)


def deduped_lines(spark, sf_dir: str) -> DataFrame:
    """Query op9: documents without later copies of repeated line runs."""
    cleaned = remove_repeats(table(spark, sf_dir, "documents"))
    return cleaned.select("doc_id", "text", F.col("__lines").alias("n_lines"), F.col("__removed").alias("n_removed"))


def without_repeats(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: later copies of line runs go; a document that loses all its lines goes with them."""
    cleaned = remove_repeats(docs)
    cleaned = cleaned.filter((F.col("__removed") == 0) | (F.col("__removed") < F.col("__lines")))
    if "n_chars" in docs.columns:
        cleaned = cleaned.withColumn("n_chars", F.when(F.col("__removed") > 0, F.length("text")).otherwise(F.col("n_chars")))
    return cleaned.select(*docs.columns)
