"""Alignment of the tokens of two tokenizers, and how often id pairs are linked (operator 13).

Side A is a byte-level BPE on a space and the text, side B a sentencepiece model that adds that space itself.  Both tokenise whole
texts first.  Byte offsets where tokens of both sides end cut them into groups; all A and B tokens of a group are linked.

* Anchors: an offset where a token that starts with a space begins on both sides is a shared end, checked on both token
  sequences.  Anchors (and the texts' starts) split a text into windows of token ids; no group crosses one.
* Memo: a window's groups depend on its ids alone, so they are found once per distinct pair of id tuples and looked up after
  that.  Equal windows of a slice are found by a hash and then compared id by id.
* Counts: a task keeps its documents in blocks.  A block lists its distinct id pairs with the number of its documents that hold each; a
  document keeps its pairs' numbers in that list and how often each is linked.  Pairs are summed over blocks by
  a grouping, and each block joins the counts of its own pairs back: hot pairs cost one row per block, never one per document.

Defined cases: texts that are null, empty, or not given back byte for byte by side B have no tokens (zeros and an empty
digest); each row is a document, also with a null or repeated id; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from answerbank.llm.bpe_tree import MergeTree, load_encoding
from answerbank.llm.common import mix64, process_cache, scratch_table, table, text_or_empty, text_slices

SIDE_A, SIDE_B = "byte_bpe_50k.tiktoken", "piece_bpe_32k.model"
#: A block ends with the slice that brings it to so many pairs, each counted once per document.
BLOCK_PAIRS = 1 << 20
#: Bytes of text aligned at once; longer texts are handled alone.
SLICE = 1 << 20
#: Alignments kept per worker; beyond that the memo starts anew.
MEMO = 250_000
#: Links of a group from which on its distinct pairs are found first.
HUGE = 1 << 12
SPACE = "▁"


class Tokenizers:
    """Both sides' encoders, and for each id its bytes, their number and whether they start with a space."""

    def __init__(self, side_a: str, side_b: str):
        import public_tokenizers
        import sentencepiece

        encoding = load_encoding(side_a)
        self.tree = MergeTree(encoding)
        self.pieces = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(side_b))
        values_a = {k: encoding.decode_single_token_bytes(k) for k in encoding._mergeable_ranks.values()}
        self.bytes_a = [values_a.get(k, b"") for k in range(max(values_a) + 1)]
        self.bytes_b = [self.piece_bytes(k) for k in range(self.pieces.get_piece_size())]
        self.sizes = tuple(np.array([len(x) for x in side], dtype=np.int64) for side in (self.bytes_a, self.bytes_b))
        self.marked = tuple(np.array([x[:1] == b" " for x in side]) for side in (self.bytes_a, self.bytes_b))
        self.width = len(self.bytes_b)
        if not {bytes([x]) for x in range(256)} <= set(self.bytes_a):
            raise ValueError(f"{side_a}: some bytes are no tokens")
        if len(self.bytes_a) * self.width > 1 << 32:
            raise ValueError("id pairs of these vocabularies do not fit 32 bits")
        self.written = [f"{k}{mark}" for k in range(len(self.bytes_a)) for mark in ",|"] + [f"{k}{mark}" for k in range(self.width) for mark in ",;"]

    def piece_bytes(self, k: int) -> bytes:
        piece = self.pieces.id_to_piece(k)
        return bytes([int(piece[3:5], 16)]) if self.pieces.is_byte(k) else piece.replace(SPACE, " ").encode()

    def encode(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray] | None]:
        """Ids of both sides; None for texts that side B does not give back (side A has all bytes as tokens and changes none)."""
        out: list[tuple[np.ndarray, np.ndarray] | None] = [None] * len(texts)
        some = [k for k, text in enumerate(texts) if text]
        for k, b in zip(some, self.pieces.encode([texts[k] for k in some], num_threads=1)):
            raw = (" " + texts[k]).encode()
            if b"".join(map(self.bytes_b.__getitem__, b)) == raw:
                out[k] = self.tree.encode(" " + texts[k]).astype(np.int64), np.array(b, dtype=np.int64)
        return out


def load_tokenizers(side_a: str, side_b: str) -> Tokenizers:
    return process_cache(f"aligned_{side_a}_{side_b}", lambda: Tokenizers(side_a, side_b))


#: Of a window: groups, links, its id pairs (a * ids of B + b), how often each is linked (None: once), the groups as text.
Alignment = tuple[int, int, np.ndarray, np.ndarray | None, str]


def group_product(mine: list[int], theirs: list[int], width: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct id pairs of one group and how often each is linked."""
    x, n = np.unique(mine, return_counts=True)
    y, m = np.unique(theirs, return_counts=True)
    return (x[:, None] * width + y).ravel(), (n[:, None] * m).ravel()


def aligned_windows(a: np.ndarray, b: np.ndarray, count_a: np.ndarray, count_b: np.ndarray, tools: Tokenizers) -> list[Alignment]:
    """Groups and links of windows given one behind the other; both sides of a window span the same bytes."""
    ends_a, ends_b = np.cumsum(tools.sizes[0][a]), np.cumsum(tools.sizes[1][b])
    common = np.intersect1d(ends_a, ends_b, assume_unique=True)
    of_a, of_b = np.searchsorted(common, ends_a), np.searchsorted(common, ends_b)
    n_a, n_b = np.bincount(of_a, minlength=len(common)), np.bincount(of_b, minlength=len(common))
    first_a, first_b = np.cumsum(n_a) - n_a, np.cumsum(n_b) - n_b
    window = np.searchsorted(ends_a[np.cumsum(count_a) - 1], common)  # of each group
    bounds = np.searchsorted(window, np.arange(len(count_a) + 1))
    links = n_a * n_b
    huge = links > HUGE
    # Every A token with each B token of its group.
    times = np.where(huge, 0, n_b)[of_a]
    partner = np.arange(int(times.sum())) - np.repeat(np.cumsum(times) - times, times) + np.repeat(first_b[of_a], times)
    pairs = np.repeat(a, times) * tools.width + b[partner]
    pair_bounds = np.searchsorted(np.repeat(window[of_a], times), np.arange(len(count_a) + 1)).tolist()
    # The groups as text: A tokens end with "," or "|", B tokens with "," or ";".
    written = np.empty(len(a) + len(b), dtype=np.int64)
    last_a, last_b = np.append(of_a[1:] != of_a[:-1], True), np.append(of_b[1:] != of_b[:-1], True)
    written[np.arange(len(a)) + first_b[of_a]] = 2 * a + last_a
    written[np.arange(len(b)) + (first_a + n_a)[of_b]] = 2 * (b + len(tools.bytes_a)) + last_b
    parts = list(map(tools.written.__getitem__, written.tolist()))
    ends = np.cumsum(count_a + count_b).tolist()
    sums = np.concatenate(([0], np.cumsum(links)))
    totals, n_groups = (sums[bounds[1:]] - sums[bounds[:-1]]).tolist(), np.diff(bounds).tolist()
    out: list[Alignment] = []
    low = 0
    for k, high in enumerate(ends):
        x = pairs[pair_bounds[k] : pair_bounds[k + 1]]
        out.append((n_groups[k], totals[k], x, None, "".join(parts[low:high])[:-1]))
        low = high
    for g in np.flatnonzero(huge).tolist():
        more = group_product(a[first_a[g] : first_a[g] + n_a[g]], b[first_b[g] : first_b[g] + n_b[g]], tools.width)
        n, total, x, often, text = out[window[g]]
        often = np.ones(len(x), dtype=np.int64) if often is None else often
        out[window[g]] = n, total, np.concatenate((x, more[0])), np.concatenate((often, more[1])), text
    return out


class Side:
    """All tokens of one side in a slice, by byte offset."""

    def __init__(self, ids: list[np.ndarray], sizes: np.ndarray, marked: np.ndarray):
        self.ids = np.concatenate(ids)
        ends = np.cumsum(sizes[self.ids])
        self.starts = ends - sizes[self.ids]
        self.marked = self.starts[marked[self.ids]]

    def windows(self, anchors: np.ndarray) -> None:
        self.low = np.searchsorted(self.starts, anchors)
        self.count = np.diff(np.append(self.low, len(self.ids)))
        self.within = np.arange(len(self.ids)) - np.repeat(self.low, self.count)

    def hashes(self, factor: int) -> np.ndarray:
        places = mix64(np.arange(int(self.count.max()), dtype=np.uint64) + np.uint64(factor))
        mixed = mix64(self.ids.astype(np.uint64) * np.uint64(factor) + places[self.within])
        return mix64(np.add.reduceat(mixed, self.low) + self.count.astype(np.uint64))

    def differ(self, other: np.ndarray) -> np.ndarray:
        """Whether each window's ids are not those of window ``other``."""
        unequal = self.count != self.count[other]
        there = np.repeat(self.low[other], self.count) + self.within
        tokens = self.ids != self.ids[np.minimum(there, len(self.ids) - 1)]
        return unequal | (np.add.reduceat(tokens.astype(np.int64), self.low) > 0)


def sliced_windows(pair: list[tuple[np.ndarray, np.ndarray]], tools: Tokenizers) -> tuple[Side, Side, np.ndarray, np.ndarray, np.ndarray]:
    """Both sides of a slice's texts, the text of each window, the first of each class of equal windows, and each window's class."""
    sides = [Side([x[k] for x in pair], tools.sizes[k], tools.marked[k]) for k in (0, 1)]
    bytes_of = np.array([int(tools.sizes[0][x].sum()) for x, _ in pair], dtype=np.int64)
    base = np.cumsum(bytes_of) - bytes_of
    anchors = np.union1d(base, np.intersect1d(sides[0].marked, sides[1].marked, assume_unique=True))
    for side in sides:
        side.windows(anchors)
    keys = sides[0].hashes(0x9E3779B97F4A7C15) + sides[1].hashes(0xC2B2AE3D27D4EB4F)
    _, first, kind = np.unique(keys, return_index=True, return_inverse=True)
    wrong = np.flatnonzero(sides[0].differ(first[kind]) | sides[1].differ(first[kind]))
    kind[wrong] = len(first) + np.arange(len(wrong))  # one hash, other ids: a class by itself
    first = np.append(first, wrong)
    return *sides, np.searchsorted(base, anchors, side="right") - 1, first, kind


def varints(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Non-negative numbers as bytes of seven bits, the last without the top bit, and the bytes of each."""
    sizes = np.ones(len(values), dtype=np.int64)
    for k in range(1, 10):
        sizes += values >> np.int64(7 * k) > 0
    starts = np.cumsum(sizes) - sizes
    out = np.empty(int(sizes.sum()), dtype=np.uint8)
    for k in range(int(sizes.max(initial=0))):
        some = sizes > k
        out[starts[some] + k] = (values[some] >> np.int64(7 * k) & 127) | np.where(sizes[some] > k + 1, 128, 0)
    return out, sizes


def from_varints(data: bytes) -> np.ndarray:
    raw = np.frombuffer(data, np.uint8)
    starts = np.concatenate(([0], np.flatnonzero(raw[:-1] < 128) + 1)) if len(raw) else np.zeros(0, np.int64)
    shift = 7 * (np.arange(len(raw)) - np.repeat(starts, np.diff(np.append(starts, len(raw)))))
    return np.add.reduceat((raw & 127).astype(np.int64) << shift, starts) if len(raw) else np.zeros(0, np.int64)


class Block:
    """Documents of a task that look up their counts together."""

    def __init__(self) -> None:
        self.docs: list[dict[str, object]] = []
        self.held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # of each slice: document, pair, times
        self.n_held = 0

    def add(self, keys: pa.Array, texts: list[str], tools: Tokenizers, memo: dict, groups: bool) -> None:
        encoded = tools.encode(texts)
        rows = [k for k, x in enumerate(encoded) if x is not None]
        nothing = {"n_a": 0, "n_b": 0, "n_groups": 0, "n_links": 0, "groups_sha256": "", "groups": ""}
        docs = [nothing | {"doc_id": key} for key in keys.to_pylist()]
        base = len(self.docs)
        self.docs += docs
        if not rows:
            return
        a, b, text_of, first, kind = sliced_windows([encoded[k] for k in rows], tools)
        known = self.looked_up(a, b, first, tools, memo)
        bounds = np.searchsorted(text_of, np.arange(len(rows) + 1))
        n_groups, n_links = (np.add.reduceat(np.array([x[f] for x in known])[kind], bounds[:-1]).tolist() for f in (0, 1))
        fragments = list(map([x[4] for x in known].__getitem__, kind.tolist()))
        for t, k in enumerate(rows):
            written = ";".join(fragments[bounds[t] : bounds[t + 1]])
            docs[k] |= {"n_a": len(encoded[k][0]), "n_b": len(encoded[k][1]), "n_groups": n_groups[t], "n_links": n_links[t]}
            docs[k] |= {"groups_sha256": hashlib.sha256(written.encode()).hexdigest()} | ({"groups": written} if groups else {})
        # All pairs of all windows by document, each once with how often it is linked.
        sizes = np.array([len(x[2]) for x in known], dtype=np.int64)
        starts, n = np.cumsum(sizes) - sizes, sizes[kind]
        at = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + np.repeat(starts[kind], n)
        document = np.repeat(base + np.array(rows, np.int64)[text_of], n)
        every = document << 32 | np.concatenate([x[2] for x in known])[at]
        held, times = np.unique(every, return_counts=True)
        if any(x[3] is not None for x in known):
            often = np.concatenate([np.ones(len(x[2]), dtype=np.int64) if x[3] is None else x[3] for x in known])
            place = np.searchsorted(held, every)
            times = np.zeros(len(held), dtype=np.int64)
            np.add.at(times, place, often[at])
        self.held.append((held >> 32, held & 0xFFFFFFFF, times))
        self.n_held += len(held)

    @staticmethod
    def looked_up(a: Side, b: Side, first: np.ndarray, tools: Tokenizers, memo: dict) -> list[Alignment]:
        """The alignment of each window in ``first``, from the memo where its ids were seen before."""
        raw_a, raw_b, size = a.ids.astype("<u4").tobytes(), b.ids.astype("<u4").tobytes(), 4
        low_a, low_b = (size * a.low[first]).tolist(), (size * b.low[first]).tolist()
        end_a, end_b = (size * (a.low + a.count)[first]).tolist(), (size * (b.low + b.count)[first]).tolist()
        keys = [(raw_a[i:j], raw_b[k:m]) for i, j, k, m in zip(low_a, end_a, low_b, end_b)]
        found = [memo.get(key) for key in keys]
        new = np.array([k for k, x in enumerate(found) if x is None], dtype=np.int64)
        if len(new):
            counts = a.count[first[new]], b.count[first[new]]
            ids = [side.ids[np.repeat(side.low[first[new]] - np.cumsum(n) + n, n) + np.arange(int(n.sum()))] for side, n in zip((a, b), counts)]
            if len(memo) + len(new) > MEMO:
                memo.clear()
            for k, one in zip(new.tolist(), aligned_windows(*ids, *counts, tools)):
                found[k] = memo[keys[k]] = one
        return found

    def full(self) -> bool:
        return self.n_held >= BLOCK_PAIRS

    def rows(self, number: int) -> tuple[list[dict[str, object]], dict[str, object]]:
        """Rows of the documents and of the block."""
        distinct = np.unique(np.concatenate([x[1] for x in self.held])) if self.held else np.zeros(0, np.int64)
        count = np.zeros(len(distinct), dtype=np.int64)
        for doc in self.docs:
            doc |= {"block": number, "held": b"", "times": b""}
        for doc, pair, often in self.held:
            code = np.searchsorted(distinct, pair)
            count += np.bincount(code, minlength=len(distinct))
            new = np.concatenate(([True], doc[1:] != doc[:-1]))
            steps, sizes = varints(np.where(new, code, np.diff(code, prepend=0)))
            times, more = varints(often)
            edges = np.flatnonzero(new)
            cuts = [np.append(np.add.reduceat(x, edges).cumsum() - np.add.reduceat(x, edges), x.sum()).tolist() for x in (sizes, more)]
            for k, d in enumerate(doc[edges].tolist()):
                self.docs[d] |= {"held": steps[cuts[0][k] : cuts[0][k + 1]].tobytes(), "times": times[cuts[1][k] : cuts[1][k + 1]].tobytes()}
        return self.docs, {"block": number, "pairs": distinct, "held_by": count}


def blocks(docs: DataFrame, side_a: str = SIDE_A, side_b: str = SIDE_B, groups: bool = False) -> DataFrame:
    """Rows of documents and of blocks (``pairs`` not null); with ``groups`` the documents' groups as text, too."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = (
        f"block long, doc_id {kind}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, groups string, "
        "held binary, times binary, pairs array<long>, held_by array<long>"
    )
    longs = pa.list_(pa.int64())
    kinds = {"groups_sha256": pa.string(), "groups": pa.string(), "pairs": longs, "held_by": longs}
    kinds |= dict.fromkeys(("block", "n_a", "n_b", "n_groups", "n_links"), pa.int64())
    kinds |= dict.fromkeys(("held", "times"), pa.binary())
    names = [part.strip().split()[0] for part in schema.split(",")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tools, memo = load_tokenizers(side_a, side_b), process_cache("alignments", dict)
        block, number, out = Block(), TaskContext.get().partitionId() << 32, None

        def written() -> Iterator[pa.RecordBatch]:
            rows, own = block.rows(number)
            for row in (rows[k : k + 4096] for k in range(0, len(rows), 4096)):
                yield pa.RecordBatch.from_pylist(row, out)
            yield pa.RecordBatch.from_pylist([own], out)

        for batch in batches:
            out = out or pa.schema([(name, kinds.get(name) or batch.schema.field("doc_id").type) for name in names])
            for low, high in text_slices(batch, "text", SLICE):
                part = batch.slice(low, high - low)
                block.add(part.column("doc_id"), part.column("text").to_pylist(), tools, memo, groups)
                if block.full():
                    yield from written()
                    block, number = Block(), number + 1
        if block.docs:
            yield from written()

    return docs.select("doc_id", text_or_empty().alias("text")).mapInArrow(run, schema)


def alignments(docs: DataFrame, side_a: str = SIDE_A, side_b: str = SIDE_B) -> DataFrame:
    """``doc_id, n_a, n_b, n_groups, n_links, groups``: every document's groups as ``a1,a2|b1;a3|b2``."""
    found = blocks(docs, side_a, side_b, groups=True).filter("pairs is null")
    return found.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "groups")


def pair_counts(found: DataFrame, width: int) -> DataFrame:
    """``pair, a, b, n, best`` over all ``blocks``: documents that hold the pair linked, and whether no pair of its A id has more.

    ``width``: ids of side B.
    """
    rows = found.filter("pairs is not null").select(F.explode(F.arrays_zip("pairs", "held_by")).alias("x"))
    counts = rows.groupBy(F.col("x.pairs").alias("pair")).agg(F.sum("x.held_by").alias("n"))
    counts = counts.select("pair", F.expr(f"pair div {width}").alias("a"), (F.col("pair") % width).alias("b"), "n")
    # One A id has ``width`` pairs at most.
    return counts.withColumn("best", F.col("n") == F.max("n").over(Window.partitionBy("a")))


def linked_counts(docs: DataFrame, side_a: str = SIDE_A, side_b: str = SIDE_B) -> DataFrame:
    """``doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256`` of every row of ``docs``."""
    found = scratch_table(blocks(docs, side_a, side_b).drop("groups"), "aligned-blocks")
    counts = scratch_table(pair_counts(found, load_tokenizers(side_a, side_b).width).select("pair", "n", "best"), "aligned-counts")
    asked = found.filter("pairs is not null").select(F.col("block").alias("asking"), F.posexplode("pairs").alias("at", "pair"))
    asked = asked.join(counts, "pair").select("asking", "at", "n", "best")
    kind = docs.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]

    def summed(docs: pa.Table, counts: pa.Table) -> pa.Table:
        n = np.zeros((2, counts.num_rows), dtype=np.int64)
        n[:, counts["at"].to_numpy()] = counts["n"].to_numpy(), counts["best"].to_numpy().astype(np.int64)
        totals = np.zeros((2, docs.num_rows), dtype=np.int64)
        for k, (steps, often) in enumerate(zip(docs["held"].to_pylist(), docs["times"].to_pylist())):
            if steps:
                totals[:, k] = (n[:, np.cumsum(from_varints(steps))] * from_varints(often)).sum(axis=1)
        out = {name: docs[name] for name in names if name not in ("n_best", "count_sum")}
        out |= {"count_sum": pa.array(totals[0]), "n_best": pa.array(totals[1])}
        return pa.table({name: out[name] for name in names})

    rows = found.filter("pairs is null").drop("pairs", "held_by").groupBy("block")
    schema = f"doc_id {kind}, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
    return rows.cogroup(asked.groupBy("asking")).applyInArrow(summed, schema)


def aligned_documents(spark, sf_dir: str) -> DataFrame:
    """Query op13: both tokenizers' ids of whole texts of documents, aligned and counted."""
    return linked_counts(table(spark, sf_dir, "documents"))
