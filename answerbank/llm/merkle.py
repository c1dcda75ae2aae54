"""Document fingerprints as Merkle trees over sections, paragraphs and pieces (operator 5).

Only DataFrame functions.  A paragraph is a line, or each ``LEAF`` characters of a longer line; its hash is the first
half of SHA-256 of its text.  A section is a run of paragraphs up to
one whose hash ends in 0 to 3 (content decides, so an edit moves no other section's ends); its hash is
SHA-256 over its paragraphs' hashes, and the root is SHA-256 over the sections' hashes.  Paragraphs also keep their lengths.
For edits inside paragraphs the fingerprint has pieces: 32-bit hashes of neighbouring token pairs (a token: up to 5
characters other than white space).  A text of many different pairs keeps those whose hash ends in ``level`` zero
bits, so about ``PAIRS`` to twice as many; texts of different levels are compared at the higher one.

Fingerprint: ``root:section(paragraph,paragraph)section(...):lengths:level:pieces``, hashes in hexadecimal, shortened below the root.
Roots are equal if and only if texts are equal (up to a SHA-256 collision).  Where roots differ,
:func:`with_span` descends from sections to the paragraphs between which the edit lies, and :func:`with_likeness` is the larger of
the share of characters in paragraphs before and after the edit, and the share of common pieces.

Defined cases: a null text reads as empty; equal texts have likeness 1, an empty and a non-empty text 0, unequal texts less
than 1.  Null ids sort before all others; rows with the same id are in the order of their roots.  Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from answerbank.llm.common import shuffle_partitions, table, text_or_empty

LEAF = 128
PARAGRAPH = r"[^\n]{1,%d}+\n?|\n" % LEAF
TOKEN = r"\S{1,5}"
PAIRS = 64
#: Ranges of ids that are sorted by themselves; their smallest ids are known to the driver.
MAX_RANGES, PER_LEVEL = 1 << 16, 256
LOWEST = -(1 << 63)


def with_tree(df: DataFrame, text: str, out: str) -> DataFrame:
    """Add the struct ``root, sections, level, lengths, pieces`` of a text column (steps, so that nothing is computed twice)."""
    df = df.withColumn("__paragraphs", F.regexp_extract_all(text, F.lit(PARAGRAPH), F.lit(0)))
    paragraphs = F.transform("__paragraphs", lambda p: F.substring(F.sha2(p, 256), 1, 32))
    marked = F.concat_ws("", F.transform(paragraphs, lambda h: F.concat(h, F.when(F.substring(h, 32, 1) < "4", "|").otherwise(","))))
    df = df.withColumns(
        {
            "__lengths": F.transform("__paragraphs", lambda p: F.length(p)),
            "__sections": F.filter(F.split(marked, r"\|", -1), lambda s: s != ""),
            "__tokens": F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0)),
        }
    )
    # A last empty token gives a text of one token a pair, too.
    pairs = F.zip_with("__tokens", F.slice(F.concat("__tokens", F.array(F.lit(""))), F.lit(2), F.size("__tokens")), lambda x, y: F.hash(x, y))
    df = df.withColumn("__pairs", F.array_distinct(pairs))
    level = F.greatest(F.floor(F.log2(F.greatest(F.size("__pairs"), F.lit(1)) / PAIRS)), F.lit(0)).cast("int")
    df = df.withColumn("__level", level)
    tree = F.struct(
        F.sha2(F.concat_ws("", F.transform("__sections", lambda s: F.sha2(s, 256))), 256).alias("root"),
        F.col("__sections").alias("sections"),
        F.col("__level").alias("level"),
        F.col("__lengths").alias("lengths"),
        at_level(F.col("__pairs"), F.col("__level")).alias("pieces"),
    )
    return df.withColumn(out, tree).drop("__paragraphs", "__sections", "__lengths", "__tokens", "__pairs", "__level")


def at_level(pieces: Column, level: Column) -> Column:
    """The pieces whose hash ends in ``level`` zero bits."""
    return F.filter(pieces, lambda h: F.pmod(h, F.call_function("shiftleft", F.lit(1), level)) == 0)


def fingerprint(of: Column) -> Column:
    """The tree as one string."""
    short = F.transform(
        of["sections"],
        lambda s: F.concat(
            F.substring(F.sha2(s, 256), 1, 8),
            F.lit("("),
            F.regexp_replace(F.rtrim(s, F.lit(",")), "([0-9a-f]{8})[0-9a-f]{24}", "$1"),
            F.lit(")"),
        ),
    )
    pieces = F.transform(of["pieces"], lambda h: F.substring(F.hex(h.cast("long") + F.lit(1 << 32)), -8, 8))
    lengths = F.concat_ws(",", of["lengths"].cast("array<string>"))
    return F.concat_ws(":", of["root"], F.concat_ws("", short), lengths, of["level"].cast("string"), F.concat_ws("", pieces))


def total(lengths: Column) -> Column:
    return F.aggregate(lengths, F.lit(0), lambda x, y: x + y)


def equal_at_start(x: Column, y: Column) -> Column:
    """How many leading elements of two arrays of strings are equal."""
    differs = F.array_position(F.zip_with(x, y, lambda p, q: ~p.eqNullSafe(q)), True).cast("int")
    return F.when(differs > 0, differs - 1).otherwise(F.size(x))


def with_span(df: DataFrame, a: str, b: str, out: str) -> DataFrame:
    """Add struct ``first, last``: paragraphs of tree ``a`` that the edit to ``b`` lies in (null if roots are equal).

    Sections are compared from both ends, and paragraphs only of the sections that differ.  ``last`` is
    ``first - 1`` if ``b`` only has more.
    """
    x, y = F.col(a)["sections"], F.col(b)["sections"]
    least = F.least(F.size(x), F.size(y))
    df = df.withColumn("__head", equal_at_start(x, y))
    df = df.withColumn("__tail", F.least(equal_at_start(F.reverse(x), F.reverse(y)), least - F.col("__head")))

    def lines(sections: Column) -> Column:
        return F.filter(F.split(F.concat_ws("", sections), ",", -1), lambda h: h != "")

    def inner(sections: Column) -> Column:
        return lines(F.slice(sections, F.col("__head") + 1, F.size(sections) - F.col("__head") - F.col("__tail")))

    df = df.withColumns({"__x": inner(x), "__y": inner(y), "__before": F.size(lines(F.slice(x, F.lit(1), F.col("__head"))))})
    df = df.withColumn("__first", equal_at_start(F.col("__x"), F.col("__y")))
    same = equal_at_start(F.reverse("__x"), F.reverse("__y"))
    df = df.withColumn("__last", F.size("__x") - F.least(same, F.least(F.size("__x"), F.size("__y")) - F.col("__first")) - 1)
    span = F.struct((F.col("__before") + F.col("__first")).alias("first"), (F.col("__before") + F.col("__last")).alias("last"))
    df = df.withColumn(out, F.when(F.col(a)["root"] != F.col(b)["root"], span))
    return df.drop("__head", "__tail", "__x", "__y", "__before", "__first", "__last")


def with_likeness(df: DataFrame, a: str, b: str, span: str, out: str) -> DataFrame:
    """Add the likeness of trees ``a`` and ``b``, whose :func:`with_span` is ``span``.

    1 for equal roots, else (under 1) the larger share of unchanged paragraphs' characters and of common pieces.
    """
    level = F.greatest(F.col(a)["level"], F.col(b)["level"])
    length, longest = total(F.col(a)["lengths"]), F.greatest(total(F.col(a)["lengths"]), total(F.col(b)["lengths"]))
    edit = F.slice(F.col(a)["lengths"], F.col(span)["first"] + 1, F.col(span)["last"] - F.col(span)["first"] + 1)
    df = df.withColumns(
        {
            "__x": at_level(F.col(a)["pieces"], level),
            "__y": at_level(F.col(b)["pieces"], level),
            "__longest": longest,
            "__kept": length - total(edit),
        }
    )
    both = F.size("__x") + F.size("__y")
    share = 2 * F.size(F.array_intersect("__x", "__y")) / F.greatest(both, F.lit(1))
    best = F.greatest(share, F.col("__kept") / F.greatest(F.col("__longest"), F.lit(1)))
    value = F.when(F.col(a)["root"] == F.col(b)["root"], F.lit(1.0)).otherwise(F.least(best, 1 - 1 / (F.col("__longest") + 2)))
    return df.withColumn(out, value).drop("__x", "__y", "__longest", "__kept")


def ranged(docs: DataFrame, key: str, ranges: int) -> tuple[DataFrame, list[tuple[int, int]]]:
    """Add ``__range``: ids cut into ranges of about as many rows; and the smallest key of each range that has rows."""
    cuts: list[int] = []
    if ranges > 1:
        at = [k / ranges for k in range(1, ranges)]
        found = docs.agg(F.percentile_approx(key, at, max(10_000, 4 * ranges)).alias("cuts")).first()["cuts"]
        cuts = sorted(set(found or ()))

    def under(values: list[int]) -> Column:
        return F.size(F.filter(F.lit(values), lambda t: t <= F.col(key))) if values else F.lit(0)

    groups = [cuts[k : k + PER_LEVEL] for k in range(0, len(cuts), PER_LEVEL)]
    place = under(cuts)
    if len(groups) > 1:  # two levels: first the group of cuts, then the place in it
        group = under([g[0] for g in groups[1:]])
        inner = F.element_at(F.lit(groups), group + 1)
        place = group * PER_LEVEL + F.size(F.filter(inner, lambda t: t <= F.col(key)))
    docs = docs.withColumn("__range", place.cast("int"))
    heads = docs.groupBy("__range").agg(F.min(key).alias("head")).collect()  # at most ``ranges`` rows
    return docs, sorted((r["__range"], r["head"]) for r in heads)


def with_next(docs: DataFrame, column: str, tie: str) -> DataFrame:
    """Add ``next``: ``column`` of the row that follows by ascending ``doc_id`` and ``tie`` (the first follows the last).

    One shuffle by ranges of ids; the first row of each range also goes to the range before.
    """
    spark = docs.sparkSession
    docs = docs.withColumn("__key", F.coalesce(F.col("doc_id").cast("long"), F.lit(LOWEST)))
    # Only ids are read for the ranges.
    ranges = min(MAX_RANGES, 4 * shuffle_partitions(spark))
    docs, heads = ranged(docs, "__key", ranges)
    if not heads:
        return docs.withColumn("next", F.col(column)).drop("__key", "__range")
    copies = [(head, heads[k - 1][0], k == 0) for k, (_, head) in enumerate(heads)]
    copies = spark.createDataFrame(copies, "__key long, __to int, __late boolean")
    own = F.struct(F.col("__range").alias("at"), F.lit(False).alias("late"), F.lit(False).alias("copy"))
    copy = F.struct(F.col("__to").alias("at"), F.col("__late").alias("late"), F.lit(True).alias("copy"))
    dealt = docs.join(F.broadcast(copies), "__key", "left")  # MAX_RANGES rows of three numbers at most
    dealt = dealt.withColumn("__place", F.explode(F.when(F.col("__to").isNull(), F.array(own)).otherwise(F.array(own, copy))))
    by_range = Window.partitionBy("__place.at").orderBy("__place.late", "__key", tie, "__place.copy")
    # The last range gets the first row of all behind its own rows; in the others a copy has the greatest key.
    return dealt.withColumn("next", F.lead(column).over(by_range)).filter(~F.col("__place.copy"))


def fingerprints(docs: DataFrame) -> DataFrame:
    """Each document, its edited text and its successor: ``doc_id, n_chars, ...`` (query op5)."""
    docs = with_tree(docs.select("doc_id", text_or_empty().alias("text")), "text", "tree")
    docs = docs.select("doc_id", F.col("tree.root").alias("root"), F.struct("text", "tree").alias("own"))
    chained = with_next(docs, "own", "root")
    text = F.col("own.text")
    n = F.length(text)
    quarter = F.floor(n / 4).cast("int")
    edited = F.concat(F.substring(text, F.lit(1), n - quarter), F.substring(F.col("next.text"), F.lit(1), quarter))
    chained = chained.select(
        "doc_id", F.col("own.tree").alias("tree"), F.col("next.tree").alias("next"), n.cast("long").alias("n_chars"), edited.alias("edited")
    )
    chained = with_tree(chained, "edited", "edited_tree")
    chained = with_span(chained, "tree", "edited_tree", "edited_paragraphs")
    chained = with_likeness(chained, "tree", "edited_tree", "edited_paragraphs", "near_edited")
    chained = with_span(chained, "tree", "next", "__to_next")
    chained = with_likeness(chained, "tree", "next", "__to_next", "near_next")
    return chained.select(
        "doc_id",
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        fingerprint(F.col("tree")).alias("fingerprint"),
        fingerprint(F.col("edited_tree")).alias("edited_fingerprint"),
        "near_edited",
        "near_next",
        "edited_paragraphs",
    )


def fingerprinted_documents(spark, sf_dir: str) -> DataFrame:
    """Query op5: fingerprints of every whole text of documents, of its edit, and their likeness."""
    return fingerprints(table(spark, sf_dir, "documents"))
