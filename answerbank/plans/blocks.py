"""Physical strategies for the exact top-k similarity join.

Two interchangeable strategies, same answers (property-tested):

* **term join** (A): postings equi-join on ``(keys…, tid)`` and a partial
  ``sum(wq*wb)`` per (query, bank row). Cheap when terms are rare; frequent
  terms make it quadratic in their document frequency.
* **blocked scorer** (B): queries and bank rows are hash-assigned to blocks
  whose count follows each key's size (a hot group gets more blocks, never a
  bigger one). A block is kept as a few rows of packed bytes, and every query
  block meets every bank block of its key by Spark's cartesian product, whose
  tasks read the kept blocks: no row is written or shuffled once per block of
  the other side. A cell's query block lies in memory (bounded by rows and
  postings) and bank rows stream past, those of several bank blocks in one task.
  They are multiplied
  in numpy (float64) and only the running top-k stays. A task returns k rows a
  query, and there are more tasks a query block only while there are few query
  blocks, so what is returned grows with the queries, not with queries x bank blocks. A global
  ``row_number() <= k`` (planned as a partial ``WindowGroupLimit``) finishes.

The caller estimates the term-join size, ``Σ_t df_q(t)·df_b(t)``, and picks A below a threshold.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import StorageLevel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Ordering rule shared by every ranking in the package: scores are rounded to
# this many digits before comparing, then the lower bank position wins.
SCORE_DIGITS = 9

# Measured on local[8], whole texts, end to end: at ~47M term pairs the term join was ~10% faster,
# at ~240M the blocked scorer was ~35% faster; the switch sits between the two.
TERM_JOIN_MAX_PAIRS = 60_000_000
# A query block lies in a Python task's memory, a bank block in its executor's.
MAX_QUERY_BLOCK_ROWS = 2048
MAX_QUERY_BLOCK_POSTINGS = 1_000_000
MAX_BANK_BLOCK_ROWS = 8192
MAX_BANK_BLOCK_POSTINGS = 3_000_000
# Numbers (postings, components of vectors) in one row of packed bytes, if it has more than one vector.
PACKED_VALUES = 1_000_000
# Rows of a tile: so many queries of the block against so many streamed bank rows.
TILE_QUERIES, TILE_BANK = 2048, 512
CHUNK_BYTES = 16 << 20
# A term goes to the dense product when its pairs exceed 1/DENSE_RATIO of the tile.
DENSE_RATIO = 300
PAIR_CHUNK = 100_000
# Numbers of the scratch space in which pairs are scored exactly.
SCRATCH_VALUES = 2_000_000


def order_key(score_col: str = "score"):
    return [F.round(F.col(score_col), SCORE_DIGITS).desc(), F.col("pos").asc()]


def term_join_scores(q_post: DataFrame, b_post: DataFrame, keys: list[str]) -> DataFrame:
    """``(keys…, qid, pos, score)`` for pairs sharing at least one term (strategy A)."""
    q = q_post.select(*keys, F.col("id").alias("qid"), "tid", F.col("w").alias("wq"))
    b = b_post.select(*keys, F.col("id").alias("pos"), "tid", F.col("w").alias("wb"))
    return (
        q.join(b, [*keys, "tid"])
        .groupBy(*keys, "qid", "pos")
        .agg(F.sum(F.col("wq") * F.col("wb")).alias("score"))
    )


def pack(post: DataFrame, keys: list[str]) -> DataFrame:
    """One row per vector: ``(keys…, rid, tids array<bigint>, ws array<double>, scale double)``.

    Both lists come from the same aggregate, so element i of one matches element i of the other.  ``scale`` (1 if
    ``post`` has none) is a factor of the whole vector: weights that repeat take little room in a shuffle, products do not.
    """
    scale = F.first("scale") if "scale" in post.columns else F.lit(1.0)
    return post.groupBy(*keys, F.col("id").alias("rid")).agg(
        F.collect_list("tid").alias("tids"), F.collect_list("w").alias("ws"), scale.alias("scale")
    )


def pad_rows(bank: DataFrame, queries: DataFrame, k: int, keys: list[str]) -> DataFrame:
    """The ``k`` lowest bank positions per key, offered to every query of that key at score 0."""
    w = Window.partitionBy(*keys).orderBy("pos")
    first = bank.select(*keys, "pos").withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= k).drop("__r")
    q = queries.select(*keys, "qid")
    if keys:  # k rows per key, joined on the key
        joined = q.join(first, keys, "inner")
        return joined.select(*keys, "qid", "pos", F.lit(0.0).alias("score"))
    # without keys the pad is at most k positions: a literal array expanded per query
    positions = [r["pos"] for r in first.orderBy("pos").collect()]
    pad = F.array(*[F.lit(int(p)).cast("long") for p in positions]) if positions else F.array().cast("array<bigint>")
    return q.select("qid", F.explode(pad).alias("pos"), F.lit(0.0).alias("score"))


#: Stands for a null id inside a task; it sorts first, as null does.
NO_ID = np.iinfo(np.int64).min


def _ids(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    return pc.fill_null(column, pa.scalar(NO_ID, pa.int64())).to_numpy()


def _lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Values of a list column one after another, and each row's length."""
    lengths = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    return column.flatten().to_numpy(zero_copy_only=False), lengths


def _terms(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct terms of a list column, the place in them of each value, and each row's length."""
    lengths = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    values = column.flatten()
    if pa.types.is_dictionary(values.type):
        return values.dictionary.to_numpy(zero_copy_only=False), values.indices.to_numpy(zero_copy_only=False), lengths
    return *np.unique(values.to_numpy(zero_copy_only=False), return_inverse=True), lengths


def spread(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The places ``start[i] … start[i] + count[i] - 1``, one after another."""
    total = np.cumsum(count)
    return np.repeat(start - (total - count), count) + np.arange(total[-1] if len(total) else 0)


class _Block:
    """A block of queries, in parts of ``TILE_QUERIES``: what it keeps of the bank rows it meets, and what it returns."""

    def bests(self, k: int) -> list[_Best]:
        sizes = range(0, len(self.ids), TILE_QUERIES)
        return [_Best(min(TILE_QUERIES, len(self.ids) - x), k, self.floor) for x in sizes]

    def found(self, bests: list[_Best]) -> Iterator[list[pa.Array]]:
        """``qid, pos, score`` of each part."""
        for part, best in enumerate(bests):
            ids = self.ids[part * TILE_QUERIES :][best.query] if len(best.pos) else np.empty(0, np.int64)
            yield [*(pa.array(x, mask=x == NO_ID) for x in (ids, best.pos)), pa.array(best.score)]


class _Tile:
    """Postings of some bank rows, row by row, that the block's queries hold too: place in its vocabulary, row, weight."""

    def __init__(self, n: int, at: np.ndarray, row: np.ndarray, weight: np.ndarray, terms: int):
        self.n, self.at, self.row, self.weight = n, at, row, weight
        self.held = np.bincount(at, minlength=terms)
        self.edges = np.searchsorted(row, np.arange(n + 1))


class _Sparse(_Block):
    """A block of query postings.  A tile is scored in float32, whose error is bounded; what can be among the best ``k`` by that is
    scored again in float64, so the rows and scores kept are exact."""

    floor = 0.0  # bank rows that share no term are padded by position, not scored

    def __init__(self, batches: list[pa.RecordBatch]):
        self.ids = np.concatenate([_ids(x.column("rid")) for x in batches])
        found = [_terms(x.column("tids")) for x in batches]
        tids, lengths = np.concatenate([terms[at] for terms, at, _ in found]), np.concatenate([n for _, _, n in found])
        weights = np.concatenate([_lists(x.column("ws"))[0] for x in batches]).astype(np.float64)
        self.vocab, at = np.unique(tids, return_inverse=True)
        # row by row, for the exact score of a pair
        self.edges, self.term, self.weight = np.concatenate(([0], np.cumsum(lengths))), at.astype(np.int32), weights
        row = np.repeat(np.arange(len(self.ids)), lengths)
        part, width = row // TILE_QUERIES, max(1, len(self.vocab))
        key = part * width + at
        order = np.argsort(key, kind="stable")
        # postings of a part, term by term: starts[part, t] is where term t begins
        parts = -(-len(self.ids) // TILE_QUERIES)
        edges = np.searchsorted(key[order], np.arange(parts * width + 1))
        self.starts, self.counts = edges[:-1].reshape(parts, width), np.diff(edges).reshape(parts, width)
        self.row, self.w = (row % TILE_QUERIES)[order].astype(np.int32), weights[order]
        # a float32 sum of n products that are not negative is off by less than this share of it
        self.slack = (int(lengths.max(initial=0)) + 8) * 2.0**-23
        self.positive = not (weights < 0).any()
        self.scratch = None

    def meet(self, bests: list[_Best], batch: pa.RecordBatch) -> None:
        terms, codes, lengths = _terms(batch.column("tids"))
        place = np.minimum(np.searchsorted(self.vocab, terms), max(0, len(self.vocab) - 1))
        place = np.where(self.vocab[place] == terms, place, -1) if len(self.vocab) else np.full(len(terms), -1)
        at, pos = place[codes], _ids(batch.column("rid"))
        weight = _lists(batch.column("ws"))[0] * np.repeat(batch.column("scale").to_numpy(), lengths)
        row, edges = np.repeat(np.arange(batch.num_rows), lengths), np.concatenate(([0], np.cumsum(lengths)))
        low_precision = self.positive and not (weight < 0).any()
        for low in range(0, batch.num_rows, TILE_BANK):
            high = min(low + TILE_BANK, batch.num_rows)
            mine = slice(edges[low], edges[high])
            hit = np.nonzero(at[mine] >= 0)[0]
            tile = _Tile(high - low, at[mine][hit], row[mine][hit] - low, weight[mine][hit], self.counts.shape[1])
            for part, best in enumerate(bests):
                if not low_precision:
                    best.add(self.scores(part, len(best.least), tile, np.float64), pos[low:high])
                    continue
                found, query = best.near(self.scores(part, len(best.least), tile, np.float32), self.slack)
                if len(found):
                    best.keep(query, pos[low:high][found], self.exact(part * TILE_QUERIES + query, found, tile))

    def scores(self, part: int, n_queries: int, tile: _Tile, kind: type) -> np.ndarray:
        """The ``bank rows x queries`` product of a tile.  Terms whose pairs exceed ``1/DENSE_RATIO`` of it go to a dense BLAS
        product; the long tail is expanded into explicit (bank, query) pairs in bounded chunks and summed with ``bincount``."""
        at, row, weight = tile.at, tile.row, tile.weight
        out = np.zeros((tile.n, n_queries), kind)
        starts, counts = self.starts[part], self.counts[part]
        if not len(at):
            return out
        dense = counts * tile.held * DENSE_RATIO > n_queries * tile.n
        terms = np.nonzero(dense)[0]
        if len(terms):
            column = np.full(len(dense), -1, dtype=np.int32)
            column[terms] = np.arange(len(terms), dtype=np.int32)
            of_bank = column[at]
            theirs = np.nonzero(of_bank >= 0)[0]
            of_bank, bank_row, bank_weight = of_bank[theirs], row[theirs], weight[theirs]
            step = max(1, CHUNK_BYTES // (8 * (n_queries + tile.n)))
            for c0 in range(0, len(terms), step):
                some = terms[c0 : c0 + step]
                here = slice(None) if step >= len(terms) else (of_bank >= c0) & (of_bank < c0 + step)
                mine = spread(starts[some], counts[some])
                qm, bm = np.zeros((len(some), n_queries), kind), np.zeros((tile.n, len(some)), kind)
                qm[np.repeat(np.arange(len(some)), counts[some]), self.row[mine]] = self.w[mine]
                bm[bank_row[here], of_bank[here] - c0] = bank_weight[here]
                out += bm @ qm
        rest = np.nonzero(~dense[at] & (counts[at] > 0))[0]
        flat, n, first_of = out.reshape(-1), counts[at[rest]], starts[at[rest]]
        total = np.cumsum(n)
        low = 0
        while low < len(rest):
            done = total[low - 1] if low else 0
            high = max(low + 1, int(np.searchsorted(total, done + PAIR_CHUNK, side="right")))
            some, many = rest[low:high], n[low:high]
            place = spread(first_of[low:high], many)
            # bank rows come in order, so these pairs fall into few rows of the tile
            first, last = int(row[some[0]]), int(row[some[-1]]) + 1
            # all places exist; "clip" only spares the check of each
            cell = np.repeat((row[some] - first) * n_queries, many) + self.row.take(place, mode="clip")
            value = np.repeat(weight[some], many) * self.w.take(place, mode="clip")
            flat[first * n_queries : last * n_queries] += np.bincount(cell, weights=value, minlength=(last - first) * n_queries)
            low = high
        return out

    def exact(self, query: np.ndarray, found: np.ndarray, tile: _Tile) -> np.ndarray:
        """Scores of pairs of a query and a row of the tile."""
        width, out = self.counts.shape[1], np.empty(len(query))
        held = min(max(1, SCRATCH_VALUES // width), TILE_QUERIES)  # vectors that lie spread out at a time
        if self.scratch is None:
            self.scratch = np.zeros(held * width)
        ours, theirs = (query, self.edges, self.term, self.weight), (found, tile.edges, tile.at, tile.weight)

        def reads(laid: tuple, read: tuple) -> int:
            """Postings touched if each vector of one side is laid out once and those of the other are read for every pair."""
            once = np.unique(laid[0])
            return int((laid[1][once + 1] - laid[1][once]).sum() + (read[1][read[0] + 1] - read[1][read[0]]).sum())

        if reads(theirs, ours) < reads(ours, theirs):
            ours, theirs = theirs, ours
        (laid, laid_edges, laid_term, laid_weight), (read, read_edges, read_term, read_weight) = ours, theirs
        order = np.argsort(laid, kind="stable")
        change = np.concatenate(([True], np.diff(laid[order]) > 0))
        once, number = laid[order][change], np.cumsum(change) - 1
        n = (read_edges[read + 1] - read_edges[read])[order]
        total = np.concatenate(([0], np.cumsum(n)))
        for low in range(0, len(once), held):
            some = once[low : low + held]
            size = laid_edges[some + 1] - laid_edges[some]
            mine = spread(laid_edges[some], size)
            cells = np.repeat(np.arange(len(some)) * width, size) + laid_term[mine]
            self.scratch[cells] = laid_weight[mine]
            x, last = np.searchsorted(number, (low, low + len(some)))
            while x < last:  # postings in bounded chunks
                y = min(last, max(x + 1, int(np.searchsorted(total, total[x] + PAIR_CHUNK, side="right")) - 1))
                at = spread(read_edges[read[order[x:y]]], n[x:y])
                cell = np.repeat((number[x:y] - low) * width, n[x:y]) + read_term.take(at, mode="clip")
                value = self.scratch.take(cell, mode="clip") * read_weight.take(at, mode="clip")
                out[order[x:y]] = np.bincount(np.repeat(np.arange(y - x), n[x:y]), value, y - x)
                x = y
            self.scratch[cells] = 0.0
        return out


class _Dense(_Block):
    """A block of query vectors."""

    floor = -np.inf

    def __init__(self, batches: list[pa.RecordBatch]):
        table = pa.Table.from_batches(batches).combine_chunks()
        self.ids = _ids(table.column("rid"))
        self.vectors = _matrix(table.column("vec").combine_chunks())

    def meet(self, bests: list[_Best], batch: pa.RecordBatch) -> None:
        for low in range(0, batch.num_rows, TILE_BANK):
            some = batch.slice(low, TILE_BANK)
            chunk, pos = _matrix(some.column("vec")), _ids(some.column("rid"))
            for part, best in enumerate(bests):
                best.add(self.scores(part, len(best.least), chunk), pos)

    def scores(self, part: int, n_queries: int, chunk: np.ndarray) -> np.ndarray:
        low = part * TILE_QUERIES
        return chunk @ self.vectors[low : low + n_queries].T


def _matrix(column: pa.Array) -> np.ndarray:
    values, lengths = _lists(column)
    if column.null_count or len(np.unique(lengths)) > 1:
        raise ValueError("vectors must be present and of one length")
    return values.astype(np.float64, copy=False).reshape(len(lengths), -1)


class _Best:
    """The running top ``k`` of one part of a query block.  Bank rows come in any order; of equal (rounded) scores the lowest
    positions stay."""

    def __init__(self, n_queries: int, k: int, floor: float):
        self.k, self.floor, self.least = k, floor, np.full(n_queries, floor)
        self.n = np.zeros(n_queries, np.int64)
        self._pos, self._score = np.zeros((n_queries, k), np.int64), np.zeros((n_queries, k))

    @property
    def _held(self) -> np.ndarray:
        return np.arange(self.k) < self.n[:, None]

    query = property(lambda self: np.nonzero(self._held)[0])
    pos = property(lambda self: self._pos[self._held])
    score = property(lambda self: self._score[self._held])

    def add(self, scores: np.ndarray, pos: np.ndarray) -> None:
        at, query = self.near(scores)
        if len(at):
            self.keep(query, pos[at], scores[at, query])

    def near(self, scores: np.ndarray, slack: float = 0.0) -> tuple[np.ndarray, np.ndarray]:
        """Places (bank row, query) of a tile that can be among the best, if no score is off by more than this share of it."""
        if scores.shape[0] <= self.k:  # only the k best of a tile can stay
            return tuple(x.ravel() for x in np.indices(scores.shape))
        least = np.maximum((self.least - 10.0**-SCORE_DIGITS) * (1.0 - slack), self.floor)
        mask = scores > least.astype(scores.dtype) if slack else scores > least
        # skipped where few rows pass anyway; a row that passes costs more if it is scored again
        if np.count_nonzero(mask) > (1.2 if slack else 4) * self.k * scores.shape[1]:
            kth = np.partition(scores, scores.shape[0] - self.k, axis=0)[scores.shape[0] - self.k]
            mask &= scores >= kth * (1.0 - 3 * slack) - 2 * 10.0**-SCORE_DIGITS
        return np.nonzero(mask)

    def keep(self, query: np.ndarray, pos: np.ndarray, found: np.ndarray) -> None:
        rounded = np.round(found, SCORE_DIGITS)
        better = ~(rounded < self.least[query]) & ~(rounded <= self.floor)
        if not better.any():
            return
        # only queries that get a row are ranked again
        asked, number = np.unique(query[better], return_inverse=True)
        held = self._held[asked]
        number = np.concatenate((np.nonzero(held)[0], number))
        score = np.concatenate((self._score[asked][held], found[better]))
        pos = np.concatenate((self._pos[asked][held], pos[better]))
        order = np.lexsort((pos, -np.round(score, SCORE_DIGITS), number))
        number = number[order]
        edges = np.searchsorted(number, np.arange(len(asked) + 1))
        rank = np.arange(len(order)) - edges[number]
        first = rank < self.k
        place = asked[number[first]], rank[first]
        self._score[place], self._pos[place] = score[order[first]], pos[order[first]]
        self.n[asked] = np.minimum(np.diff(edges), self.k)
        full = asked[self.n[asked] == self.k]
        self.least[full] = np.round(self._score[full, self.k - 1], SCORE_DIGITS)


class _Cell:
    """Queries that meet bank rows: their block, made when the first bank row comes, and the best rows so far."""

    def __init__(self, key: list[pa.Array]):
        self.key, self.queries, self.block, self.best = key, [], None, []

    def close(self, block_of: Callable, k: int) -> None:
        self.block, self.queries = block_of(self.queries), []
        self.best = self.block.bests(k)


def _cell_runner(block_of: Callable, k: int, keys: list[str], names: list[str]):
    """Task function: rows of cells, a cell's queries before its bank rows -> the top ``k`` of each cell's queries.

    Cells may take turns; all of a task's stay open to its end.
    """
    cell_columns = [*keys, "qblock", "bblock"]

    def finish(cell: _Cell) -> Iterator[pa.RecordBatch]:
        for columns in cell.block.found(cell.best) if cell.block is not None else ():
            labels = [column.take(pa.array(np.zeros(len(columns[0]), np.int64))) for column in cell.key]
            yield pa.RecordBatch.from_arrays([*labels, *columns], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells: dict[tuple, _Cell] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            changes = np.zeros(batch.num_rows, dtype=bool)
            for name in [*cell_columns, "side"]:
                column = batch.column(name)
                changes[1:] |= pc.not_equal(column.slice(1), column.slice(0, batch.num_rows - 1)).to_numpy(zero_copy_only=False)
            edges = [0, *np.nonzero(changes)[0], batch.num_rows]
            for low, high in zip(edges, edges[1:]):
                rows = batch.slice(low, high - low)
                now = tuple(rows.column(name)[0].as_py() for name in cell_columns)
                if now not in cells:
                    cells[now] = _Cell([rows.column(name).take(pa.array([0])) for name in keys])
                cell = cells[now]
                if rows.column("side")[0].as_py() == 0:
                    cell.queries.append(rows)
                    continue
                if cell.block is None:
                    if not cell.queries:
                        continue
                    cell.close(block_of, k)
                cell.block.meet(cell.best, rows)
        for cell in cells.values():
            yield from finish(cell)

    return run


def _packed_blocks(rows: DataFrame, keys: list[str], most_rows: int) -> DataFrame:
    """``(keys…, block, data binary)`` from rows in order of key and block; a row of bytes holds ``most_rows`` vectors at most."""
    labels = [*keys, "block"]
    values = [c for c in rows.columns if c not in labels]

    def row_of(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(held).select(values).combine_chunks()
        if "tids" in values:  # each distinct term once, in order: a cell looks these up, not every posting
            terms, at, lengths = _terms(table.column("tids").combine_chunks())
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(lengths))).astype(np.int32)), pa.DictionaryArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(terms)))
            table = table.set_column(values.index("tids"), "tids", lists)
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="lz4")) as writer:
            writer.write_table(table)
        data = pa.array([sink.getvalue().to_pybytes()], pa.binary())
        return pa.RecordBatch.from_arrays([*(held[0].column(c).slice(0, 1) for c in labels), data], [*labels, "data"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, now, n, size = [], None, 0, 0
        for batch in batches:
            changes = np.zeros(batch.num_rows, dtype=bool)
            for name in labels:
                column = batch.column(name)
                changes[1:] |= pc.not_equal(column.slice(1), column.slice(0, batch.num_rows - 1)).to_numpy(zero_copy_only=False)
            edges = [0, *np.nonzero(changes)[0], batch.num_rows]
            lengths = pc.fill_null(pc.list_value_length(batch.column("tids" if "tids" in values else "vec")), 0)
            total = np.concatenate(([0], np.cumsum(lengths.to_numpy(zero_copy_only=False).astype(np.int64))))
            for low, end in zip(edges, edges[1:]):
                key = tuple(batch.column(name)[low].as_py() for name in labels) if end > low else now
                if held and key != now:
                    yield row_of(held)
                    held, n, size = [], 0, 0
                now = key
                while low < end:
                    high = int(np.searchsorted(total, total[low] + PACKED_VALUES - size, side="right")) - 1
                    high = min(max(high, low if held else low + 1), low + most_rows - n, end)
                    if high > low:
                        held.append(batch.slice(low, high - low))
                        n, size, low = n + high - low, size + int(total[high] - total[low]), high
                    if low < end:
                        yield row_of(held)
                        held, n, size = [], 0, 0
        if held:
            yield row_of(held)

    schema = T.StructType([*(rows.schema[c] for c in labels), T.StructField("data", T.BinaryType())])
    return rows.select(*labels, *values).mapInArrow(run, schema).withColumn("no", F.monotonically_increasing_id())


def _cells_of_pairs(run: Callable, keys: list[str]) -> Callable:
    """Task function: pairs of packed blocks, each bank block with all its query blocks in turn -> rows for ``run``, a cell a query
    block: its own rows the first time it comes, then the bank rows."""

    def rows(pair: pa.RecordBatch, data: pa.RecordBatch, side: int) -> pa.RecordBatch:
        first = pa.array(np.zeros(data.num_rows, np.int64))
        same = [pair.column(c).take(first) for c in (*keys, "no")]
        numbers = [pa.array(np.full(data.num_rows, x, np.int32)) for x in (0, side)]
        return pa.RecordBatch.from_arrays([*same, *numbers, *data.columns], [*keys, "qblock", "bblock", "side", *data.schema.names])

    def unpacked(pair: pa.RecordBatch, name: str) -> pa.RecordBatch:
        return pa.ipc.open_stream(pair.column(name)[0].as_buffer()).read_all().combine_chunks().to_batches()[0]

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, last, held = set(), None, None
        for batch in batches:
            for at in range(batch.num_rows):
                pair = batch.slice(at, 1)
                number = pair.column("no")[0].as_py()
                if number not in seen:
                    seen.add(number)
                    yield rows(pair, unpacked(pair, "asked"), 0)
                if last != (last := pair.column("held_no")[0].as_py()):
                    held = unpacked(pair, "held")
                yield rows(pair, held, 1)

    return lambda batches: run(cells(batches))


def _best_of_cells(
    queries: DataFrame, bank: DataFrame, k: int, keys: list[str], block_of: Callable, max_query_rows: int, max_bank_rows: int
) -> DataFrame:
    """``(keys…, qid, pos, score, rank)`` from packed rows ``(keys…, rid, …)`` of both sides."""
    names = [T.StructField("qid", T.LongType()), T.StructField("pos", T.LongType()), T.StructField("score", T.DoubleType())]
    found = found_in_cells(queries, bank, k, keys, block_of, names, max_query_rows, max_bank_rows)
    w = Window.partitionBy(*keys, "qid").orderBy(*order_key())
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def found_in_cells(
    queries: DataFrame,
    bank: DataFrame,
    k: int,
    keys: list[str],
    block_of: Callable,
    names: list[T.StructField],
    max_query_rows: int = MAX_QUERY_BLOCK_ROWS,
    max_bank_rows: int = MAX_BANK_BLOCK_ROWS,
    kept: list[DataFrame] | None = None,
) -> DataFrame:
    """``keys…`` and the columns ``names`` that the blocks of ``block_of`` return, from every cell.  ``kept`` gets the kept blocks.

    Each row is sent to its block once and kept there; the cells read the blocks of both sides.  Without a need for more
    (memory), a key gets as many blocks of both sides as make its share of a fixed number of cells.
    """
    spark = queries.sparkSession
    target = 3 * spark.sparkContext.defaultParallelism
    postings = F.sum(F.size("tids")) if "tids" in queries.columns else F.lit(0)
    qn = queries.groupBy(*keys).agg(F.count("*").alias("nq"), postings.alias("qp"))
    bn = bank.groupBy(*keys).agg(F.count("*").alias("nb"), postings.alias("bp"))
    number = F.col("nq").cast("double") * F.col("nb")

    def blocks(work) -> list:
        share = F.lit(float(target)) * number / work
        nqb = F.greatest(
            F.ceil(F.col("nq") / max_query_rows), F.ceil(F.col("qp") / MAX_QUERY_BLOCK_POSTINGS),
            F.least(F.col("nq"), F.ceil(F.sqrt(share))), F.lit(1),
        )
        nbb = F.greatest(
            F.ceil(F.col("nb") / max_bank_rows), F.ceil(F.col("bp") / MAX_BANK_BLOCK_POSTINGS),
            F.least(F.col("nb"), F.ceil(share / nqb)), F.lit(1),
        )
        return [nqb.cast("int").alias("nqb"), nbb.cast("int").alias("nbb")]

    key_fields = [queries.schema[c] for c in keys]
    fields = [T.StructField(f.name, f.dataType, True) for f in key_fields]
    schema = T.StructType(fields + names)
    if keys:
        sizes = qn.join(bn, keys, "inner").persist(StorageLevel.MEMORY_AND_DISK)  # one row a key
        work = sizes.agg(F.sum(number)).first()[0] or 0.0
        if work:
            sizes = sizes.select(*keys, *blocks(F.lit(work)))
            total = sizes.agg(*(F.sum(F.col(n).cast("long")).alias(n) for n in ("nqb", "nbb"))).first()
    else:
        a, b = qn.first(), bn.first()
        work = float(a["nq"]) * b["nb"]
        if work:
            counted = (("nq", a["nq"]), ("qp", a["qp"]), ("nb", b["nb"]), ("bp", b["bp"]))
            one = spark.range(1).select(*[F.lit(int(v or 0)).alias(n) for n, v in counted])
            total = one.select(*blocks(F.lit(work))).first()
    if not work:
        return spark.createDataFrame([], schema)
    # a block a partition, up to so many
    bank_parts, query_parts = (min(total[n], 100 * target) for n in ("nbb", "nqb"))
    # a task returns k rows a query: the bank is read in as few shares as still make enough tasks
    shares = min(bank_parts, -(-2 * target // query_parts))

    def placed(rows: DataFrame, own: str, parts: int, most_rows: int) -> DataFrame:
        values = rows.columns
        rows = rows.join(sizes, keys, "inner") if keys else rows.withColumn(own, F.lit(total[own]))
        rows = rows.select(*values, F.pmod(F.xxhash64("rid"), F.col(own)).cast("int").alias("block"))
        spread = F.pmod(F.xxhash64(*keys), F.lit(parts)) if keys else F.lit(0)
        rows = rows.repartitionById(parts, F.pmod(spread + F.col("block"), F.lit(parts)).cast("int"))
        rows = rows.sortWithinPartitions(*keys, "block", "rid")
        made = _packed_blocks(rows, keys, most_rows).persist(StorageLevel.MEMORY_AND_DISK)
        made.count()  # each block is made once, by one task; after that nothing reads the rows again
        if kept is not None:
            kept.append(made)
        return made

    asked = placed(queries, "nqb", query_parts, min(max_query_rows, TILE_QUERIES)).select(*keys, "no", F.col("data").alias("asked"))
    held = placed(bank, "nbb", bank_parts, min(max_bank_rows, TILE_QUERIES))
    held = held.select(*keys, F.col("no").alias("held_no"), F.col("data").alias("held")).coalesce(shares)
    # Spark's cartesian product also for keys: it reads the kept blocks of both sides and moves none. It holds the right side's
    # partition, a query block, and the bank's blocks of the share stream past
    held = held.hint("shuffle_replicate_nl")
    pairs = held.join(asked, keys) if keys else held.crossJoin(asked)
    return pairs.mapInArrow(_cells_of_pairs(_cell_runner(block_of, k, keys, schema.names), keys), schema)


def blocked_topk(
    q_post: DataFrame,
    b_post: DataFrame,
    k: int,
    keys: list[str],
    *,
    max_query_rows: int = MAX_QUERY_BLOCK_ROWS,
    max_bank_rows: int = MAX_BANK_BLOCK_ROWS,
    bank_rows: DataFrame | None = None,
) -> DataFrame:
    """Strategy B: ``(keys…, qid, pos, score)``, the top ``k`` bank rows of each query with a score above 0.

    ``bank_rows`` (``keys…, pos``) lists every bank row, including rows with no vocabulary term: the lowest positions score 0
    and take part in ties and padding.
    """
    qp = pack(q_post, keys).persist(StorageLevel.MEMORY_AND_DISK)  # read by the counts and by the cells
    bp = pack(b_post, keys).persist(StorageLevel.MEMORY_AND_DISK)
    found = best_of_packed(qp, bp, k, keys, max_query_rows=max_query_rows, max_bank_rows=max_bank_rows)
    bp.unpersist()
    if bank_rows is None:
        qp.unpersist()
        return found
    asked = qp.select(*keys, F.col("rid").alias("qid"))
    found = found.unionByName(pad_rows(bank_rows, asked, k, keys)).groupBy(*keys, "qid", "pos").agg(F.max("score").alias("score"))
    w = Window.partitionBy(*keys, "qid").orderBy(*order_key())
    return found.withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= k).drop("__r")


def best_of_packed(
    qp: DataFrame,
    bp: DataFrame,
    k: int,
    keys: list[str],
    *,
    max_query_rows: int = MAX_QUERY_BLOCK_ROWS,
    max_bank_rows: int = MAX_BANK_BLOCK_ROWS,
) -> DataFrame:
    """``blocked_topk`` of rows that are packed already (``pack``); both sides are read before it returns, and not again."""
    return _best_of_cells(qp, bp, k, keys, _Sparse, max_query_rows, max_bank_rows).drop("rank")


def dense_topk(
    queries: DataFrame,
    bank: DataFrame,
    k: int,
    keys: list[str] | None = None,
    *,
    max_query_rows: int = MAX_QUERY_BLOCK_ROWS,
    max_bank_rows: int = MAX_BANK_BLOCK_ROWS,
) -> DataFrame:
    """Exact dot-product top-k of ``queries (keys…, qid, vec)`` against ``bank (keys…, pos, vec)``.

    Same block layout as the lexical scorer; each tile is one BLAS product.
    """
    keys = keys or []
    q = queries.select(*keys, F.col("qid").alias("rid"), "vec")
    b = bank.select(*keys, F.col("pos").alias("rid"), "vec")
    return _best_of_cells(q, b, k, keys, _Dense, max_query_rows, max_bank_rows)
