"""Best-fit packing with certified bin counts (operator 10).

Documents become token pieces; pieces as long as a sequence are sequences by themselves and
the rest is dealt over many partitions.  Each partition packs its pieces best-fit
decreasing and computes a lower bound of its bin count from dual-feasible functions
(functions f with: sizes that fit one bin have f-values that fit one bin; so the sum of
f over all pieces bounds the bins from below).  A partition that meets its bound is certified: no
packing of its pieces uses fewer bins.  Partitions with a gap give up their emptiest bins;
the released pieces of all partitions are dealt anew and packed again.  A round
that does not lower the number of bins is discarded, and the rounds end.
"""

from __future__ import annotations

import json
import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from answerbank.llm.bpe_tree import MergeTree, load_encoding
from answerbank.llm.common import checkpointed, process_cache, table, text_or_empty, widened

CAPACITY = 1024
END_ID = 2
#: Pieces packed together in one task.
PER_PARTITION = 4096
ROUNDS = 8
#: Emptiest bins that a partition releases in the first round: for each bin of its gap, and at least; k times as many in round k.
RELEASE_PER_GAP, RELEASE_LEAST = 16, 32


class TokenizerIds:
    """Ids as the tokenizer file gives them without special tokens of its own: its added tokens count where they stand in the text."""

    def __init__(self, vocabulary: str):
        def build() -> dict[str, int]:
            import public_tokenizers

            with open(public_tokenizers.path(vocabulary.removesuffix(".tiktoken") + ".json"), "rb") as file:
                found = json.load(file)["added_tokens"]
            if any(x["single_word"] or x["lstrip"] or x["rstrip"] for x in found):
                raise ValueError(f"{vocabulary}: an added token that is more than its literal text")
            return {x["content"]: x["id"] for x in found}

        self.tree, self.added = MergeTree(load_encoding(vocabulary)), process_cache("added_" + vocabulary, build)
        longest_first = sorted(self.added, key=len, reverse=True)
        self.finder = re.compile("(" + "|".join(map(re.escape, longest_first)) + ")") if longest_first else None

    def encode(self, text: str) -> np.ndarray:
        parts = self.finder.split(text) if self.finder else [text]  # every second part is an added token
        return np.concatenate([np.array([self.added[x]], "<u4") if k % 2 else self.tree.encode(x) for k, x in enumerate(parts)])


def token_pieces(
    docs: DataFrame, vocabulary: str = "byte_bpe_50k.tiktoken", capacity: int = CAPACITY, end_id: int | None = END_ID
) -> DataFrame:
    """Pieces of every document: ``doc_id, piece, start, length, ids_crc32``.

    The rank file holds the same vocabulary as ``byte_bpe_50k.json``, hence the same ids; the added tokens come from the latter.  A null
    text reads as empty: its only id is ``end_id`` (without one it has no piece).  A document over
    ``capacity`` is cut so that only its first piece is shorter.  Null and repeated ids are kept:
    each row gives its own pieces.  Other columns are not read.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = TokenizerIds(vocabulary)
        tail = np.array([] if end_id is None else [end_id], dtype="<u4")
        for batch in batches:
            row, piece, start, length, crc = [], [], [], [], []
            for k, text in enumerate(batch.column(1)):
                ids = np.concatenate((tokenizer.encode(text.as_py()), tail))
                first = len(ids) % capacity
                cuts = [0, *range(first or capacity, len(ids), capacity), len(ids)] if len(ids) else [0]
                for j, (low, high) in enumerate(zip(cuts, cuts[1:])):
                    row.append(k)
                    piece.append(j)
                    start.append(low)
                    length.append(high - low)
                    crc.append(zlib.crc32(ids[low:high].tobytes()))
            yield pa.RecordBatch.from_pydict(
                {
                    "doc_id": batch.column(0).take(pa.array(row, pa.int64())),
                    "piece": pa.array(piece, pa.int32()),
                    "start": pa.array(start, pa.int64()),
                    "length": pa.array(length, pa.int64()),
                    "ids_crc32": pa.array(crc, pa.int64()),
                }
            )

    return docs.select("doc_id", text_or_empty().alias("text")).mapInArrow(
        run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long"
    )


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> np.ndarray:
    """Bin of each piece; each goes to the fullest bin that still has room, the longest first."""
    bins = np.zeros(len(lengths), dtype=np.int64)
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    occupied, count = 0, 0  # occupied: bit r is set if some bin has room r
    for k in np.argsort(-lengths, kind="stable").tolist():
        size = int(lengths[k])
        fitting = occupied >> size
        if fitting:
            room = size + (fitting & -fitting).bit_length() - 1
            chosen = by_room[room].pop()
            if not by_room[room]:
                occupied ^= 1 << room
        else:
            room, chosen, count = capacity, count, count + 1
        bins[k] = chosen
        left = room - size
        if left:
            by_room[left].append(chosen)
            occupied |= 1 << left
    return bins


def bin_bound(lengths: np.ndarray, capacity: int) -> int:
    """The best lower bound of the bin count that two families of dual-feasible functions give."""
    if not len(lengths):
        return 0
    counts = np.bincount(lengths, minlength=capacity + 1)[: capacity + 1].astype(np.int64)
    sizes = np.arange(capacity + 1, dtype=np.int64)
    n_upto, sum_upto = np.cumsum(counts), np.cumsum(counts * sizes)
    cut = np.arange(1, capacity // 2 + 1)
    # Pieces over capacity - cut count as a whole bin, pieces under cut as nothing, the rest as they are.
    threshold = (n_upto[-1] - n_upto[capacity - cut]) * capacity + sum_upto[capacity - cut] - sum_upto[cut - 1]
    best = max(int(sum_upto[-1]), int(threshold.max(initial=0)))
    best = -(-best // capacity)
    for k in range(1, 33):  # steps of 1/k; sizes on a step stay as they are
        scaled = (k + 1) * sizes
        value = np.where(scaled % capacity == 0, sizes * k, scaled // capacity * capacity)  # times k
        best = max(best, -(-int((counts * value).sum()) // (capacity * k)))
    return best


def pack(pieces: DataFrame, capacity: int = CAPACITY, per_partition: int = PER_PARTITION, rounds: int = ROUNDS) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to pieces with a ``length`` of 1 to ``capacity``.

    Offsets in a sequence start at 0 without gaps.  All other columns stay; rows may repeat.
    An empty table gives an empty table.
    """
    columns = pieces.columns
    pieces = checkpointed(pieces.withColumn("__row", F.monotonically_increasing_id()))
    schema = widened(pieces.schema, __part="long", sequence_id="long", offset="long", __open="boolean")

    def packer(k: int, last: bool):
        def run(rows: pa.Table) -> pa.Table:
            rows = rows.sort_by("__row")
            lengths = rows["length"].to_numpy()
            bins = best_fit_decreasing(lengths, capacity)
            filled = np.bincount(bins, weights=lengths).astype(np.int64)
            gap = 0 if last else len(filled) - bin_bound(lengths, capacity)
            opened = np.zeros(len(filled), dtype=bool)
            if gap:
                emptiest = np.argsort(filled, kind="stable")[: max(RELEASE_LEAST, RELEASE_PER_GAP * gap) * (k + 1)]
                opened[emptiest[filled[emptiest] < capacity]] = True
            order = np.lexsort((np.arange(len(bins)), bins))
            ends = np.cumsum(lengths[order])
            first = np.concatenate(([0], np.cumsum(filled)[:-1]))
            offset = np.empty(len(bins), dtype=np.int64)
            offset[order] = ends - lengths[order] - first[bins[order]]
            part = rows["__part"][0].as_py()
            sequence = ((((k << 24) | part) << 24) | bins) * 2 + 1
            for name, values in (("sequence_id", sequence), ("offset", offset), ("__open", opened[bins])):
                rows = rows.append_column(name, pa.array(values))
            return rows

        return run

    whole = pieces.filter(F.col("length") == capacity)
    done = [whole.withColumns({"sequence_id": F.col("__row") * 2, "offset": F.lit(0).cast("long")})]
    rest, before = pieces.filter(F.col("length") < capacity), math.inf
    n_rows, kept = rest.count(), None
    for k in range(rounds):
        if not n_rows:
            break
        parts = math.ceil(n_rows / per_partition)
        dealt = rest.withColumn("__part", F.pmod(F.xxhash64("__row", F.lit(k)), F.lit(parts)).cast("long"))
        last = k == rounds - 1
        packed = checkpointed(dealt.groupBy("__part").applyInArrow(packer(k, last), schema))
        starts = F.col("offset") == 0
        tally = packed.agg(
            F.count_if(starts).alias("bins"),
            F.count_if(starts & F.col("__open")).alias("open_bins"),
            F.count_if("__open").alias("open_rows"),
        ).first()
        if tally["bins"] >= before:  # no gain: the packing of the round before stays
            break
        if kept is not None:
            done.append(kept.filter(~F.col("__open")))
        kept, before, n_rows = packed, tally["open_bins"], tally["open_rows"]
        rest = packed.filter("__open").drop("__part", "sequence_id", "offset", "__open")
    if kept is not None:
        done.append(kept)
    out = [part.select(*columns, "sequence_id", "offset") for part in done]
    result = out[0]
    for part in out[1:]:
        result = result.unionByName(part)
    return result


def packed_documents(spark, sf_dir: str) -> DataFrame:
    """Query op10: all documents as sequences of at most 1024 tokens."""
    return pack(token_pieces(table(spark, sf_dir, "documents")))
