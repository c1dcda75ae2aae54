"""Similarity join of documents on word n-gram sets under several token orders (operator 7).

Two documents link if their sets of distinct ``WORDS``-word shingles have a Jaccard similarity of ``LEAST`` (a fraction).  Any order
of all tokens gives a filter: documents that link share a token among the first n - ceil(t n) + 1 tokens of both
(n: set size, t: least similarity).  The first order puts frequent tokens last and finds candidates by an
equi-join on prefix tokens; candidates must also share a prefix token under every other order (``ORDERS``
permutations of the tokens) before the sets are compared exactly.

Equal sets are one class, of which the smallest id takes part.  Groups of near copies are never expanded
into all pairs: of each prefix token, all holders are first compared with the holder with the
smallest id and with a few others drawn by hash; what links forms a component, and only pairs of holders from different components are compared after that.
Pairs left out lie in one component already, so no component changes.

Frequent tokens are those that more than ``n / MOST_FREQUENT`` (``FREQUENT`` at least) documents hold in their prefix by hash,
``n`` being all such holdings: ``MOST_FREQUENT`` tokens at most, which every task knows.  Which tokens are frequent affects speed only.
A pair of holders must also share so many prefix tokens that, with all tokens after the prefixes, it could link, and the parity
words of its sets (bit b: whether an odd number of tokens falls into cell b) must differ in no more bits than linked sets have
tokens of their own: each such token flips one bit, so the filter is exact.

Defined cases: a text without words (or null) has an empty set and links with nothing; with fewer words than ``WORDS`` the
whole sequence is its one shingle; rows without an id link with nothing and have no component; rows with the same id are one node.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from answerbank.llm.common import lower_ascii, mix64, scratch_table, span_hashes, table, text_bytes, text_slices, words

WORDS = 3
LEAST = Fraction(90, 100)
#: Odd factors of the further token orders (fixed values).
ORDERS = (0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)
FREQUENT, MOST_FREQUENT = 2, 1 << 20
#: Tokens with more holders than ``FEW`` get ``CENTRES`` more stars in each of ``ATTEMPTS`` rounds, to join near copies early.
FEW, CENTRES, ATTEMPTS = 8, 4, 2
#: Of so many smallest prefix tokens two documents learn whether they have met already; it bounds a row, not the tokens compared.
SMALLEST = 20
#: Tokens are compared by so many bytes of their hash.
TOKEN_BYTES = 6
#: Columns of 64 parity bits a set has.  Sets of n tokens at a similarity s differ in about 512 (1 - exp(-n (1 - s) / (1 + s) / 256)) of
#: 1024 bits; with 256 bits no pair of sets of more than about 600 tokens could be told apart at a least similarity of 0.8.
PARITY = tuple(f"p{k}" for k in range(16))


def stored(df: DataFrame) -> DataFrame:
    """Cut lineage by a Parquet table in the shared folder.  Unlike a checkpoint it has a known size: Spark deals small tables to
    few tasks and sends them to the large ones instead of shuffling both."""
    return scratch_table(df, "jaccard")


def shingle_hashes(data: np.ndarray, offsets: np.ndarray, n_words: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each shingle (with repeats) of lower-cased texts, and the bounds of each text's shingles."""
    data = lower_ascii(data)
    starts, ends, rows = words(data, offsets)
    hashes = span_hashes(data, starts, ends)
    per_row = np.bincount(rows, minlength=len(offsets) - 1)
    width = np.minimum(per_row[rows], n_words)  # of the shingle that starts here
    last = np.cumsum(per_row)[rows]
    valid = np.arange(len(rows)) + width <= last
    value = mix64(hashes + width.astype(np.uint64))
    for k in range(1, n_words):
        following = np.concatenate((hashes[k:], np.zeros(min(k, len(hashes)), np.uint64)))
        value = np.where(width > k, mix64(value + following), value)
    # Of fewer words than a shingle only the whole sequence counts.
    bounds = np.searchsorted(rows[valid], np.arange(len(offsets)))
    return value[valid], bounds


def token_sets(column: pa.Array, n_words: int) -> list[np.ndarray]:
    """Sorted distinct tokens (``TOKEN_BYTES`` bytes each, as uint64) of every text."""
    data, offsets = text_bytes(column)
    values, bounds = shingle_hashes(data, offsets, n_words)
    values >>= np.uint64(8 * (8 - TOKEN_BYTES))
    return [np.unique(values[low:high]) for low, high in zip(bounds, bounds[1:])]


def packed(tokens: np.ndarray) -> bytes:
    return tokens.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :TOKEN_BYTES].tobytes()


def unpacked(data: bytes) -> np.ndarray:
    wide = np.zeros((len(data) // TOKEN_BYTES, 8), dtype=np.uint8)
    wide[:, :TOKEN_BYTES] = np.frombuffer(data, dtype=np.uint8).reshape(-1, TOKEN_BYTES)
    return wide.reshape(-1).view("<u8")


def prefix_length(n: int, least: Fraction) -> int:
    return n + least.numerator * n // -least.denominator + 1


def first_under(tokens: np.ndarray, factor: int, count: int) -> np.ndarray:
    """The first ``count`` tokens under the order by ``mix(token * factor)``."""
    keys = mix64(tokens * np.uint64(factor))
    return np.partition(keys, count - 1)[:count] if count < len(keys) else keys


def parity_words(digest: np.ndarray) -> list[int]:
    """The parity bits of a set, from mixed hashes of its tokens, as signed 64-bit numbers."""
    cells = np.bincount((digest % np.uint64(64 * len(PARITY))).astype(np.int64), minlength=64 * len(PARITY)) & 1
    return np.packbits(cells.astype(np.uint8), bitorder="little").view("<i8").tolist()


def per_text(docs: DataFrame, n_words: int, schema: str, rows_of: Callable) -> DataFrame:
    """Rows that ``rows_of(id, tokens)`` yields for each text, by columns of ``schema``."""
    names = [part.split()[0] for part in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out_schema = None
        for batch in batches:
            for low, high in text_slices(batch, "text"):
                part = batch.slice(low, high - low)
                out = [row for key, s in zip(part.column(0).to_pylist(), token_sets(part.column(1), n_words)) for row in rows_of(key, s)]
                if out:
                    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64())}
                    out_schema = out_schema or [kinds[part.split()[1]] for part in schema.split(", ")]
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), out_schema)], names)

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def frequent_tokens(docs: DataFrame, n_words: int, least: Fraction) -> tuple[np.ndarray, np.ndarray]:
    """Sorted frequent tokens and their counts."""

    def rows_of(key, tokens):
        if len(tokens):
            yield (tokens[: prefix_length(len(tokens), least)].astype(np.int64),)  # tokens are hashes in ascending order

    held = per_text(docs, n_words, "tokens array<long>", rows_of).select(F.explode("tokens").alias("token"))
    counts = held.groupBy("token").agg(F.count("*").alias("n"))
    counts = stored(counts.filter(F.col("n") >= FREQUENT))
    total = counts.agg(F.sum("n")).first()[0] or 0
    often = counts.filter(F.col("n") > total // MOST_FREQUENT).toArrow()  # MOST_FREQUENT rows at most
    tokens, n = often["token"].to_numpy(), often["n"].to_numpy()
    order = np.argsort(tokens)
    return tokens[order].astype(np.uint64), n[order]


def components(links: DataFrame) -> DataFrame:
    """``node, component`` (its smallest node) of every node of ``links`` (a, b), by alternating stars."""
    edges = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct()
    edges = stored(edges)
    state = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(stored(least), "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = stored(large)  # every node now points to smaller ones
        least = stored(large.groupBy("u").agg(F.min("v").alias("m")))
        small = large.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = stored(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct())
        now = tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())
        if now == state:
            break
        state = now
    stars = edges.groupBy("u").agg(F.min("v").alias("component")).select(F.col("u").alias("node"), "component")
    roots = stars.select(F.col("component").alias("node"), "component").distinct()
    return stored(stars.unionByName(roots).groupBy("node").agg(F.min("component").alias("component")))


def verified(pairs: DataFrame, sets: DataFrame, least: Fraction) -> DataFrame:
    """Pairs (a, b) whose sets pass the filters of all orders and then link."""
    of = lambda side: sets.select(F.col("id").alias(side), F.col("tokens").alias(f"tokens_{side}"))
    joined = pairs.join(of("b"), "b").join(of("a"), "a").select("a", "b", "tokens_a", "tokens_b")
    num, den = least.numerator, least.denominator

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep, known, last = [], [], None
            for row, (a, x, y) in enumerate(zip(*(batch.column(k) for k in (0, 2, 3)))):
                if last != (a := a.as_py()):
                    x, last = unpacked(x.as_py()), a
                    known = [x] + [first_under(x, f, prefix_length(len(x), least)) for f in ORDERS]
                x, y = known[0], unpacked(y.as_py())
                for factor, mine in zip(ORDERS, known[1:]):
                    if not len(np.intersect1d(mine, first_under(y, factor, prefix_length(len(y), least)), assume_unique=True)):
                        break
                else:
                    common = len(np.intersect1d(x, y, assume_unique=True))
                    if den * common >= num * (len(x) + len(y) - common):
                        keep.append(row)
            yield batch.select([0, 1]).take(pa.array(keep, pa.int64()))

    return joined.mapInArrow(run, "a long, b long")


def linked(docs: DataFrame, n_words: int = WORDS, least: Fraction = LEAST) -> DataFrame:
    """``doc_id, n_shingles, class_id, component_id`` of every row of ``docs`` (doc_id, text)."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    spark = docs.sparkSession
    frequent = spark.sparkContext.broadcast(frequent_tokens(docs, n_words, least))  # MOST_FREQUENT pairs of numbers at most
    num, den = least.numerator, least.denominator

    def described(key, tokens):
        n, prefix, last = len(tokens), [], (0, 0)
        if n:
            often, counts = frequent.value
            at = np.searchsorted(often, tokens)
            rank = np.zeros(n, dtype=np.int64)
            if len(often):
                hit = often[np.minimum(at, len(often) - 1)] == tokens
                rank[hit] = counts[at[hit]]
            order = np.lexsort((tokens, rank))
            order = order[: prefix_length(n, least)]
            prefix, last = tokens[order].astype(np.int64), (int(rank[order[-1]]), int(tokens[order[-1]]))
        digest = mix64(tokens)
        sums = [int(digest.sum(dtype=np.uint64)), int(mix64(digest ^ np.uint64(ORDERS[0])).sum(dtype=np.uint64))]
        yield key, n, *(x - (1 << 64) if x >> 63 else x for x in sums), prefix, *last, *parity_words(digest)

    schema = "doc_id long, n int, d1 long, d2 long, prefix array<long>, rank long, last long, " + ", ".join(f"{p} long" for p in PARITY)
    described = per_text(docs, n_words, schema, described)
    described = scratch_table(described, "jaccard-docs")
    same = ["n", "d1", "d2"]
    with_words = described.filter((F.col("n") > 0) & F.col("doc_id").isNotNull())
    classes = stored(with_words.groupBy(*same).agg(F.min("doc_id").alias("class_id")))
    chosen = classes.select(*same, F.col("class_id").alias("doc_id"))
    holdings = with_words.select(*same, "doc_id", "prefix").join(chosen, [*same, "doc_id"], "left_semi")
    holdings = holdings.select(F.explode("prefix").alias("token"), F.col("doc_id").alias("id"), "n")
    # The holder with the smallest id is the centre of its token's star.
    shared = holdings.groupBy("token").agg(F.min(F.struct("id", "n")).alias("x"), F.count("*").alias("holders")).filter("holders > 1")
    shared = stored(shared.select("token", F.col("x.id").alias("centre"), F.col("x.n").alias("n_centre"), "holders"))
    held = scratch_table(holdings.join(shared, "token"), "jaccard-held")
    near = lambda x, y: F.least(x, y) * den >= F.greatest(x, y) * num

    def alike():
        """Whether the parity words of ``a`` and ``b`` leave room for a link."""
        differing = sum(F.bit_count(F.col(f"{p}_a").bitwiseXOR(F.col(f"{p}_b"))) for p in PARITY)
        return differing * (num + den) <= (F.col("n_a") + F.col("n_b")).cast("long") * (den - num)

    stars = held.filter((F.col("id") != F.col("centre")) & near(F.col("n"), F.col("n_centre")))
    stars = stored(stars.select(F.col("centre").alias("a"), F.col("id").alias("b")).distinct())

    # All common tokens of a pair are shared prefix tokens or lie behind the prefix that ends first (as many as n less the
    # prefix); together they must reach t / (1 + t) of both sizes.
    def after_prefix(n):
        return F.floor((n.cast("long") * num + den - 1) / den) - 1

    def could_link(common, n_a, n_b, end_a, end_b):
        behind = after_prefix(F.when(end_a < end_b, n_a).otherwise(n_b))
        return (common + behind) * (num + den) >= (n_a + n_b) * num

    end = F.struct("rank", "last").alias("end")

    def facts(side: str, *columns) -> DataFrame:
        found = with_words.select("doc_id", "n", *columns)
        return found.select(*(F.col(c).alias(side if c == "doc_id" else f"{c}_{side}") for c in found.columns))

    def compared(pairs: DataFrame) -> DataFrame:
        """Pairs that link, from the whole texts of the documents in ``pairs``."""
        pairs = stored(pairs)
        ids = pairs.select(F.col("a").alias("doc_id")).unionByName(pairs.select(F.col("b").alias("doc_id"))).distinct()
        # As a file the ids have a known size, so Spark sends them to the texts if they are few, else the texts to them.
        chosen = docs.join(scratch_table(ids, "jaccard-ids"), "doc_id", "left_semi")
        sets = per_text(chosen, n_words, "id long, tokens binary", lambda key, s: [(key, packed(s))])
        return stored(verified(pairs, stored(sets), least))

    def further_stars(held: DataFrame, attempt: int) -> DataFrame:
        """Pairs of each holder with ``CENTRES`` other centres, drawn by hash, of a token with many holders."""
        many = held.filter(F.col("holders") > FEW)
        drawn = [F.min(F.struct(F.xxhash64("id", "token", F.lit(CENTRES * attempt + k)), "id", "n"))["id"] for k in range(CENTRES)]
        centres = stored(many.groupBy("token").agg(F.array(*drawn).alias("centres")))
        pairs = many.join(centres, "token").select(F.explode("centres").alias("x"), "id").filter("x <> id")
        return pairs.select(F.least("x", "id").alias("a"), F.greatest("x", "id").alias("b")).distinct()

    def near_enough(pairs: DataFrame) -> DataFrame:
        """Pairs that could link by their sizes, parity words and whole prefixes."""
        pairs = pairs.join(facts("b", *PARITY), "b").join(facts("a", *PARITY), "a").filter(near(F.col("n_a"), F.col("n_b")) & alike())
        return by_prefix(pairs.select("a", "b"))

    def by_prefix(pairs: DataFrame) -> DataFrame:
        """Pairs that could link by their whole prefixes."""
        pairs = pairs.join(facts("b", end, "prefix"), "b").join(facts("a", end, "prefix"), "a")
        common = F.size(F.array_intersect("prefix_a", "prefix_b"))
        return pairs.filter(could_link(common, *(F.col(c) for c in ("n_a", "n_b", "end_a", "end_b")))).select("a", "b")

    def across(pairs: DataFrame, grouped: DataFrame) -> DataFrame:
        """Pairs whose ends lie in different components."""
        for side in ("a", "b"):
            own = grouped.select(F.col("node").alias(side), F.col("component").alias(f"c_{side}"))
            pairs = pairs.join(own, side, "left").withColumn(f"c_{side}", F.coalesce(f"c_{side}", side))
        return pairs.filter("c_a <> c_b").select("a", "b")

    links = compared(near_enough(stars.unionByName(further_stars(held, 0)).distinct()))
    grouped = components(links)
    for attempt in range(1, ATTEMPTS):  # groups of near copies grow together before the rest is compared
        found = compared(near_enough(stored(across(further_stars(held, attempt), grouped))))
        if found.isEmpty():
            break
        links = links.unionByName(found)
        grouped = components(links)
    place = held.join(grouped.withColumnRenamed("node", "id"), "id", "left").withColumn("component", F.coalesce("component", "id"))
    place = scratch_table(place.filter(F.col("id") != F.col("centre")).select("token", "id", "n", "component"), "jaccard-place")
    mixed = place.groupBy("token").agg(F.min("component").alias("x"), F.max("component").alias("y")).filter("x <> y").select("token")
    place = place.join(stored(mixed), "token", "left_semi")
    # A pair that shares several prefix tokens is made at the smallest one that both have among their ``SMALLEST`` smallest of the
    # tokens that still have rows here: most tokens of a long prefix have one holder and would fill the places of shared ones.
    lowest = F.slice(F.array_sort(F.collect_set("token")), 1, SMALLEST).alias("lowest")
    lowest = place.groupBy("id", "n").agg(lowest)
    place = place.join(lowest, ["id", "n"]).join(with_words.select(F.col("doc_id").alias("id"), *PARITY), "id")
    place = stored(place.select("token", "id", "n", "component", *PARITY, "lowest"))
    columns = ("id", "n", "component", *PARITY, "lowest")
    of = lambda side: place.select("token", *(F.col(c).alias(f"{c}_{side}") for c in columns))
    apart = (F.col("id_a") < F.col("id_b")) & (F.col("component_a") != F.col("component_b")) & near(F.col("n_a"), F.col("n_b"))
    once = F.coalesce(F.array_min(F.array_intersect("lowest_a", "lowest_b")) >= F.col("token"), F.lit(True))
    met = of("a").join(of("b"), "token").filter(apart & alike() & once)
    met = stored(met.select(F.col("id_a").alias("a"), F.col("id_b").alias("b")).distinct())
    more = compared(by_prefix(met).distinct())
    members = with_words.select("doc_id", *same).join(classes, same).select("doc_id", "n", "class_id")
    twice = members.groupBy("doc_id").agg(F.min("class_id").alias("a"), F.max("class_id").alias("b"), F.collect_set("class_id").alias("all"))
    twice = twice.filter("a <> b").select("a", F.explode("all").alias("b"))  # rows with the same id are one node
    final = components(links.unionByName(more).unionByName(twice)).select(F.col("node").alias("class_id"), F.col("component").alias("component_id"))
    found = members.join(final, "class_id", "left").withColumn("component_id", F.coalesce("component_id", "class_id"))
    alone = described.filter((F.col("n") == 0) | F.col("doc_id").isNull())
    alone = alone.select("doc_id", "n", F.col("doc_id").alias("class_id"), F.col("doc_id").alias("component_id"))
    found = found.select("doc_id", "n", "class_id", "component_id").unionByName(alone)
    return found.select("doc_id", F.col("n").cast("long").alias("n_shingles"), "class_id", "component_id")


def linked_documents(spark, sf_dir: str) -> DataFrame:
    """Query op7: links between whole texts of documents at a similarity of 0.9 on 3-word shingles."""
    return linked(table(spark, sf_dir, "documents"))


def without_near_copies(spark, docs: DataFrame, sf_dir: str, n_words: int = 5, least: Fraction = Fraction(8, 10)) -> DataFrame:
    """Pipeline stage: of each component of near copies the document with the smallest id stays."""
    found = stored(linked(docs, n_words, least).select("doc_id", "component_id"))
    copies = found.filter(F.col("doc_id") != F.col("component_id")).select("doc_id").distinct()
    return docs.join(copies, "doc_id", "left_anti").select(*docs.columns)
