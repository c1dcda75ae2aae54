"""Removal of byte strings that repeat across documents, by suffix buckets (operator 8).

A byte goes if some ``LENGTH``-byte string that covers it also starts in a document with a smaller id; strings are judged on
the input.  Suffixes are compared only as far as ``LENGTH`` bytes, one bucket at a time:

* Cover sample: of every ``LENGTH`` consecutive bytes the ``KMER``-byte string with the smallest hash is sampled.  Equal
  strings sample the same place, so two equal strings always share an aligned sample.  (A cover by place modulo
  v, as in the classic construction, needs 6 of 31 places; sampling by content needs about 1 of 18.)
* Sample ranks: sampled strings are counted over all documents; those of a single document rank alone and end there.
* Buckets: the other samples, with the bytes round them, are dealt by sampled string.  A bucket holds all suffixes whose
  first ``LENGTH`` bytes sample this string; they are sorted by their first ``LENGTH`` bytes (as 64-bit
  names) and distance to it.  Of equal suffixes those outside the smallest id's document are repeats.

Of documents with equal texts only the one with the smallest id enters the buckets; the others go whole.

Rows are told apart by a hash of id and text, ``r``: what a row loses is found and removed by row, whose it is by id.

Defined cases: a null text reads as empty; texts under ``LENGTH`` bytes lose nothing; rows without an id come after all
others; rows with the same id lose nothing to each other; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from answerbank.llm.common import BASE, checkpointed, mix64, shuffle_partitions, table, text_bytes, text_or_empty, text_slices

LENGTH = 50
KMER = 16
#: Bytes on each side of a sampled string that a string of LENGTH bytes over it can reach.
REACH = LENGTH - KMER
LAST = (1 << 63) - 1
LEAST_PARTS = 48
#: What stands before the bytes round a sampled string: its place in the text, and how many of the bytes come before it.
HEAD = np.dtype([("place", "<u4"), ("ahead", "u1")])


def kmer_hashes(data: np.ndarray) -> np.ndarray:
    """64-bit hash of the KMER bytes from each place on (len - KMER + 1 of them)."""
    n = len(data) - 7
    eight = np.empty(max(n, 0), dtype=np.uint64)
    for shift in range(min(8, max(n, 0))):
        size = (len(data) - shift) // 8
        eight[shift::8] = data[shift : shift + 8 * size].view("<u8")[: len(eight[shift::8])]
    value = eight[: max(0, len(data) - KMER + 1)] * np.uint64(0x9FB21C651E98DF25)
    value ^= value >> np.uint64(29)
    value += eight[8:]
    return mix64(value)


def samples(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The cover sample of all texts: places, their hashes, and the first and last string of LENGTH bytes that each covers."""
    if len(data) < LENGTH:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    hashes = kmer_hashes(data)
    # Smallest hash first, then the leftmost place: 32 bits each.
    least = (hashes & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(hashes), dtype=np.uint64)
    width = 1
    while 2 * width <= REACH + 1:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    rest = REACH + 1 - width
    least = np.minimum(least[: len(least) - rest], least[rest:]) if rest else least
    starts = np.arange(len(least))
    ends = offsets[np.searchsorted(offsets, starts, side="right")] if len(starts) else starts
    starts = starts[starts + LENGTH <= ends]
    chosen = (least[starts] & np.uint64(0xFFFFFFFF)).astype(np.int64)  # never goes back
    first = np.flatnonzero(np.concatenate(([True], chosen[1:] != chosen[:-1]))) if len(chosen) else np.zeros(0, np.int64)
    places = chosen[first]
    return places, hashes[places], starts[first], starts[np.append(first[1:], len(starts))[: len(first)] - 1]


def short(hashes: np.ndarray) -> np.ndarray:
    """The half of a hash that counting goes by; samples that only seem shared cost time, no more."""
    return (hashes >> np.uint64(32)).astype(np.uint32)


def sample_blocks(docs: DataFrame, parts: int) -> DataFrame:
    """``part, keys, rows, hashes``: the samples of a slice of texts by part, packed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high in text_slices(batch, "text"):
                part = batch.slice(low, high - low)
                data, offsets = text_bytes(part.column("text"))
                places, values, _, _ = samples(data, offsets)
                if not len(places):
                    continue
                keys = part.column("r").to_numpy(zero_copy_only=False)
                rows = (np.searchsorted(offsets, places, side="right") - 1).astype(np.uint32)
                to = (values % np.uint64(parts)).astype(np.int32)
                values = short(values)
                order = np.lexsort((rows, values, to))
                to, rows, values = to[order], rows[order], values[order]
                new = np.ones(len(to), dtype=bool)
                new[1:] = (values[1:] != values[:-1]) | (rows[1:] != rows[:-1])
                to, rows, values = to[new], rows[new], values[new]
                first = np.flatnonzero(np.concatenate(([True], to[1:] != to[:-1])))
                ends = np.append(first[1:], len(to))
                out = [(int(to[a]), keys[np.unique(rows[a:b])], np.unique(rows[a:b], return_inverse=True)[1], values[a:b]) for a, b in zip(first, ends)]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([x[0] for x in out], pa.int32()),
                        pa.array([x[1].astype("<i8").tobytes() for x in out], pa.binary()),
                        pa.array([x[2].astype("<u2" if high - low < 1 << 16 else "<u4").tobytes() for x in out], pa.binary()),
                        pa.array([x[3].astype("<u4").tobytes() for x in out], pa.binary()),
                    ],
                    ["part", "keys", "rows", "hashes"],
                )

    return docs.select("r", "text").mapInArrow(run, "part int, keys binary, rows binary, hashes binary")


def shared_samples(blocks: pa.Table) -> pa.Table:
    """``r, hashes``: of each row the samples that some other row has, too."""
    keys, values = [], []
    for blob, rows, hashes in zip(*(blocks[c].to_pylist() for c in ("keys", "rows", "hashes"))):
        hashes = np.frombuffer(hashes, "<u4")
        rows = np.frombuffer(rows, "<u2" if len(rows) == 2 * len(hashes) else "<u4")
        keys.append(np.frombuffer(blob, "<i8")[rows])
        values.append(hashes)
    keys, values = np.concatenate(keys), np.concatenate(values)
    order = np.argsort(values, kind="stable")
    keys, values = keys[order], values[order]
    first = np.flatnonzero(np.concatenate(([True], values[1:] != values[:-1])))
    sizes = np.diff(np.append(first, len(values)))
    several = np.minimum.reduceat(keys, first) != np.maximum.reduceat(keys, first)
    keep = np.repeat(several, sizes)
    keys, values = keys[keep], values[keep]
    order = np.argsort(keys, kind="stable")
    keys, values = keys[order], values[order]
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, np.int64)
    ends = np.append(first[1:], len(keys)) if len(keys) else first
    blobs = [values[a:b].tobytes() for a, b in zip(first, ends)]
    return pa.table({"r": pa.array(keys[first], pa.int64()), "hashes": pa.array(blobs, pa.binary())})


def surroundings(found: DataFrame) -> DataFrame:
    """``sample, d, r, around``: shared samples with the bytes round them, behind a ``HEAD``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high in text_slices(batch, "text"):
                part = batch.slice(low, high - low)
                data, offsets = text_bytes(part.column("text"))
                places, hashes, lowest, highest = samples(data, offsets)
                rows = np.searchsorted(offsets, places, side="right") - 1
                keep = np.zeros(len(places), dtype=bool)
                bounds = np.searchsorted(rows, np.arange(len(offsets)))
                for k, blobs in enumerate(part.column("shared").to_pylist()):
                    a, b = bounds[k], bounds[k + 1]
                    if blobs and b > a:
                        keep[a:b] = np.isin(short(hashes[a:b]), np.frombuffer(b"".join(blobs), "<u4"))
                places, rows, hashes = places[keep], rows[keep], hashes[keep]
                if not len(places):
                    continue
                begin, end = lowest[keep], highest[keep] + LENGTH
                raw = data.tobytes()
                heads = np.empty(len(places), HEAD)
                heads["place"], heads["ahead"] = places - offsets[rows], places - begin
                heads, n = heads.tobytes(), HEAD.itemsize
                around = [heads[n * k : n * k + n] + raw[a:b] for k, (a, b) in enumerate(zip(begin.tolist(), end.tolist()))]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(hashes.view(np.int64), pa.int64()),
                        part.column("d").take(pa.array(rows, pa.int64())),
                        part.column("r").take(pa.array(rows, pa.int64())),
                        pa.array(around, pa.binary()),
                    ],
                    ["sample", "d", "r", "around"],
                )

    return found.select("d", "r", "text", "shared").mapInArrow(run, "sample long, d long, r long, around binary")


def repeats(bucket: pa.Table) -> pa.Table:
    """``r, start, end``: byte ranges of strings that also start in a document with a smaller id."""
    ids, keys = bucket["d"].to_numpy(), bucket["r"].to_numpy()
    around = bucket["around"].combine_chunks().cast(pa.large_binary())
    around = pa.concat_arrays(around.chunks) if isinstance(around, pa.ChunkedArray) else around
    bounds = np.frombuffer(around.buffers()[1], np.int64)[around.offset : around.offset + len(around) + 1]
    data = np.frombuffer(around.buffers()[2], np.uint8)
    heads = data[bounds[:-1, None] + np.arange(HEAD.itemsize)].view(HEAD).reshape(-1)
    place, ahead = heads["place"].astype(np.int64), heads["ahead"].astype(np.int64)
    begins = bounds[:-1] + HEAD.itemsize
    sizes = bounds[1:] - begins
    # Strings are named column by column: column c holds those that start REACH - c bytes before the sample, so a bucket takes a few
    # numbers per row at a time, however many rows one sample has.  The name of a column is rolled on from the one before.
    shift = REACH - ahead
    letter = lambda c: np.where((c >= shift) & (c < shift + sizes), data[np.clip(begins + c - shift, 0, len(data) - 1)], 0).astype(np.uint64)
    base, out_of = np.uint64(BASE), np.uint64(pow(BASE, LENGTH, 1 << 64))
    rolled = np.zeros(len(ids), np.uint64)
    for c in range(LENGTH):
        rolled = rolled * base + letter(c)
    sample = data[(begins + ahead)[:, None] + np.arange(KMER)].view("<u8").reshape(-1, KMER // 8) if len(ids) else np.zeros((0, 2), np.uint64)
    salt = mix64(sample[:, 0] ^ mix64(sample[:, 1]))  # names of different samples meet only by chance
    open_from, place_rows, place_starts, place_ends = np.full(len(ids), -1, np.int16), [], [], []
    for c in range(REACH + 2):
        gone = np.zeros(len(ids), dtype=bool)
        if c <= REACH:
            some = np.flatnonzero((c >= shift) & (c + LENGTH <= shift + sizes))
            names, owner = mix64(rolled[some]) + salt[some], ids[some]
            sort = np.argsort(names, kind="stable")
            first = np.flatnonzero(np.concatenate(([True], names[sort][1:] != names[sort][:-1]))) if len(some) else np.zeros(0, np.int64)
            if len(some):
                least = np.minimum.reduceat(owner[sort], first)
                gone[some[sort]] = np.repeat(least, np.diff(np.append(first, len(some)))) < owner[sort]
            rolled = rolled * base + letter(c + LENGTH) - letter(c) * out_of
        begin, stop = np.flatnonzero(gone & (open_from < 0)), np.flatnonzero(~gone & (open_from >= 0))
        place_rows.append(stop)
        place_starts.append(open_from[stop].astype(np.int64))
        place_ends.append(np.full(len(stop), c - 1 + LENGTH))
        open_from[stop], open_from[begin] = -1, c
    rows = np.concatenate(place_rows)
    base_place = place[rows] - REACH
    return pa.table(
        {
            "r": pa.array(keys[rows], pa.int64()),
            "start": pa.array(base_place + np.concatenate(place_starts), pa.int64()),
            "end": pa.array(base_place + np.concatenate(place_ends), pa.int64()),
        }
    )


def merged(spans: list[dict], n_bytes: int) -> list[tuple[int, int]]:
    """Maximal ranges that the spans cover."""
    out: list[tuple[int, int]] = []
    for low, high in sorted((x["start"], min(x["end"], n_bytes)) for x in spans):
        if out and low <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], high))
        else:
            out.append((low, high))
    return out


def repeated_spans(docs: DataFrame) -> DataFrame:
    """``r, spans, copy`` of the rows (d, r, text) that lose bytes; ``copy``: all of them."""
    parts = max(LEAST_PARTS, shuffle_partitions(docs.sparkSession))
    digests = docs.select("d", "r", F.xxhash64("text").alias("t"), F.hash("text").alias("u"), F.octet_length("text").alias("n")).filter(F.col("n") >= LENGTH)
    same = ["t", "u", "n"]
    firsts = checkpointed(digests.groupBy(*same).agg(F.min("d").alias("first"), F.count("*").alias("rows")).filter("rows > 1"))
    copies = checkpointed(digests.join(firsts, same).filter("first < d").select("r", F.lit(True).alias("copy")).distinct())
    shared = sample_blocks(docs, parts).groupBy("part").applyInArrow(shared_samples, "r long, hashes binary")
    shared = shared.groupBy("r").agg(F.collect_list("hashes").alias("shared"))  # of one row
    shared = shared.join(copies, "r", "left_anti")
    around = surroundings(docs.join(shared, "r"))
    around = around.withColumn("part", F.pmod("sample", F.lit(parts)).cast("int")).drop("sample")
    spans = around.groupBy("part").applyInArrow(lambda x: repeats(x), "r long, start long, end long")
    spans = spans.groupBy("r").agg(F.collect_list(F.struct("start", "end")).alias("spans"))
    return spans.join(copies, "r", "full")


def without_repeats(docs: DataFrame) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept`` (the remaining bytes) of every row of ``docs``."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    # Both joins read the same three columns, so Spark shuffles the texts once for both.
    docs = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("d"), text_or_empty().alias("text"))
    docs = docs.select("d", F.xxhash64("d", "text").alias("r"), "text")
    joined = docs.join(repeated_spans(docs), "r", "left")
    joined = joined.select(F.nullif("d", F.lit(LAST)).cast(kind).alias("doc_id"), "text", "spans", "copy")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            for text, spans, copy in zip(*(batch.column(k) for k in (1, 2, 3))):
                data = text.as_py().encode()
                if copy.as_py():
                    gone = [(0, len(data))]
                else:
                    gone = merged(spans.as_py() or [], len(data))
                edges = [0, *(x for span in gone for x in span), len(data)]
                kept = b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2]))
                for values, x in zip(out, (len(data), len(data) - len(kept), len(gone), hashlib.sha256(kept).hexdigest(), kept)):
                    values.append(x)
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
            names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(v, k) for v, k in zip(out, kinds))], names)

    return joined.mapInArrow(run, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")


def deduped_bytes(spark, sf_dir: str) -> DataFrame:
    """Query op8: documents without 50-byte strings of documents with smaller ids."""
    return without_repeats(table(spark, sf_dir, "documents")).drop("kept")
