"""TF-IDF as DataFrames of postings (V4-V9).

A fitted model is a *vocabulary* DataFrame ``(keys…, term, tid, df, idf)``;
vectors are *postings* ``(keys…, id, term, tid, w)`` with ``w`` already
l2-normalised per row, so a cosine similarity is a plain sum of products.
``keys`` lets one call fit one vocabulary per group or per setting (a hot
group is just more rows, never one task).

Semantics follow the published vectorizer with a custom preprocessor: the
text is whitespace-normalised, case and accents are kept (``lowercase`` is
honoured only when set), ``min_df`` is an absolute count, ``max_df`` a
fraction of bank rows, ``max_features`` keeps the highest corpus frequencies
after the df pruning (ties: term ascending), idf is ``ln((1+n)/(1+df))+1``
(smooth) or ``ln(n/df)+1``, tf is raw, binary, or ``1+ln(tf)``.
"""

from __future__ import annotations

from dataclasses import asdict, dataclass, replace
from functools import reduce

from pyspark import StorageLevel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from answerbank.functions.ngrams import ngrams_from_units, units
from answerbank.functions.text import normalize_ws
from answerbank.session import ensure_checkpoint_dir


@dataclass(frozen=True)
class TfidfSettings:
    analyzer: str = "char_wb"
    ngram_min: int = 3
    ngram_max: int = 5
    max_features: int | None = 250_000
    min_df: int = 1
    max_df: float = 1.0
    lowercase: bool = False
    sublinear_tf: bool = False
    binary: bool = False
    use_idf: bool = True
    smooth_idf: bool = True

    def with_(self, **kw) -> "TfidfSettings":
        return replace(self, **kw)

    def as_dict(self) -> dict:
        return asdict(self)


# A vocabulary capped at this many terms (~40 bytes each) is broadcast; larger or
# uncapped vocabularies go through a shuffle join (AQE may still broadcast them
# at run time once their real size is known).
BROADCAST_VOCAB_LIMIT = 1_000_000


def term_counts(df: DataFrame, id_col: str, text_col: str, s: TfidfSettings, keys: list[str] | None = None) -> DataFrame:
    """``(keys…, id, term, tf)`` for every row with at least one n-gram.

    Rows are hash-partitioned by ``(keys…, id)`` *before* the explode, so only
    raw text crosses the network; the count per (row, term) then runs without
    another exchange because the row key already clusters it. The unit array
    (characters / padded words / tokens) is its own projection, so the n-gram
    lambdas read it instead of re-deriving it per element.
    """
    keys = keys or []
    t = normalize_ws(F.col(text_col))
    if s.lowercase:
        t = F.lower(t)
    base = df.select(*[F.col(k) for k in keys], F.col(id_col).alias("id"), t.alias("__t")).repartition(
        *[F.col(k) for k in keys], F.col("id")
    )
    with_units = base.select(*keys, "id", units(F.col("__t"), s.analyzer).alias("__u"))
    grams = ngrams_from_units(F.col("__u"), s.analyzer, s.ngram_min, s.ngram_max)
    exploded = with_units.select(*keys, "id", F.explode(grams).alias("term"))
    return exploded.groupBy(*keys, "id", "term").agg(F.count("*").alias("tf"))


def hashed_counts(df: DataFrame, id_col: str, text_col: str, s: TfidfSettings, keys: list[str] | None = None) -> DataFrame:
    """``(keys…, id, tids array<bigint>, tfs array<int>)``: ``term_counts`` as one row per text, terms by their 64-bit hash.

    ``tids`` ascends; a row without n-grams is left out, and rows of one id count as one text, as in ``term_counts``.  Rows lie by
    ``(keys…, id)`` in a number of partitions that is given, so Spark joins what it groups by the same columns without moving them.
    """
    keys = keys or []
    t = normalize_ws(F.col(text_col))
    if s.lowercase:
        t = F.lower(t)
    base = df.select(*[F.col(k) for k in keys], F.col(id_col).alias("id"), t.alias("__t"))
    base = base.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *[F.col(k) for k in keys], F.col("id"))
    with_units = base.select(*keys, "id", units(F.col("__t"), s.analyzer).alias("__u"))
    grams = ngrams_from_units(F.col("__u"), s.analyzer, s.ngram_min, s.ngram_max)
    hashed = with_units.select(*keys, "id", F.transform(grams, lambda g: F.xxhash64(g)).alias("__h"))
    hashed = hashed.groupBy(*keys, "id").agg(F.sort_array(F.flatten(F.collect_list("__h"))).alias("__h")).where(F.size("__h") > 0)
    h = F.col("__h")
    # places (from 1) at which a run of equal hashes ends
    last = F.filter(F.sequence(F.lit(1), F.size(h)), lambda i: (i == F.size(h)) | (F.get(h, i - 1) != F.get(h, i)))
    ends = hashed.select(*keys, "id", "__h", last.alias("__e"))
    e = F.col("__e")
    return ends.select(
        *keys, "id",
        F.transform(e, lambda x: F.get(h, x - 1)).alias("tids"),
        F.transform(e, lambda x, i: x - F.when(i == 0, F.lit(0)).otherwise(F.get(e, i - 1))).alias("tfs"),
    )


def hashed_vocabulary(counts: DataFrame, n_docs: DataFrame, s: TfidfSettings, keys: list[str] | None = None) -> DataFrame:
    """``(keys…, tid, df, idf)`` from ``hashed_counts`` of the bank: ``fit_vocabulary`` without ``max_features``, terms by their hash."""
    if s.max_features is not None:
        raise ValueError("a cut by max_features needs the terms themselves: use fit_vocabulary")
    keys = keys or []
    stats = counts.select(*keys, F.explode("tids").alias("tid")).groupBy(*keys, "tid").agg(F.count("*").alias("df"))
    stats = _document_frequencies(stats, n_docs, s, keys)
    return stats.select(*keys, "tid", F.col("df").cast("int").alias("df"), _idf(s).alias("idf"))


def hashed_postings(counts: DataFrame, vocab: DataFrame, s: TfidfSettings, keys: list[str] | None = None) -> DataFrame:
    """``(keys…, id, tid, tfw, idf, df)`` of ``hashed_counts`` rows for the terms of a ``hashed_vocabulary``."""
    keys = keys or []
    terms = counts.select(*keys, "id", F.inline(F.arrays_zip("tids", "tfs"))).withColumnsRenamed({"tids": "tid", "tfs": "tf"})
    return terms.join(vocab, [*keys, "tid"]).select(*keys, "id", "tid", _tf_weight(s).alias("tfw"), "idf", "df")


def tf_weights(s: TfidfSettings):
    """The ``tfs`` of ``hashed_counts`` as weights, integers as long as they are."""
    if s.binary:
        return F.transform("tfs", lambda tf: F.lit(1))
    if s.sublinear_tf:
        return F.transform("tfs", lambda tf: F.lit(1.0) + F.log(tf.cast("double")))
    return F.col("tfs")


def _tf_weight(s: TfidfSettings):
    tf = F.col("tf").cast("double")
    if s.binary:
        return F.lit(1.0)
    if s.sublinear_tf:
        return F.lit(1.0) + F.log(tf)
    return tf


def fit_vocabulary(
    counts: DataFrame, n_docs: DataFrame, s: TfidfSettings, keys: list[str] | None = None
) -> DataFrame:
    """``(keys…, term, tid, df, idf)`` from bank term counts.

    ``n_docs`` is ``(keys…, n)``: bank rows per key, including rows whose text
    has no n-gram (they still count in idf and ``max_df``).
    """
    keys = keys or []
    stats = counts.groupBy(*keys, "term").agg(
        F.count("*").alias("df"),
        (F.count("*") if s.binary else F.sum("tf")).alias("ctf"),
    )
    stats = _document_frequencies(stats, n_docs, s, keys)
    if s.max_features is not None:
        # read by the histograms and by the vocabulary itself: cut off, else each reading holds the plan of the texts, and the
        # driver keeps and logs these plans
        ensure_checkpoint_dir(counts.sparkSession)
        stats = _limit_features(stats.checkpoint(), s.max_features, keys)
    return stats.select(*keys, "term", F.xxhash64("term").alias("tid"), "df", "ctf", _idf(s).alias("idf"))


def _document_frequencies(stats: DataFrame, n_docs: DataFrame, s: TfidfSettings, keys: list[str]) -> DataFrame:
    """The terms within ``min_df`` and ``max_df``, with the number ``n`` of bank rows."""
    if keys:
        stats = stats.join(n_docs, keys, "inner")
    else:  # one number: attach it as a literal
        stats = stats.withColumn("n", F.lit(int(n_docs.first()["n"])))
    return stats.where((F.col("df") >= F.lit(s.min_df)) & (F.col("df") <= F.lit(float(s.max_df)) * F.col("n")))


def _idf(s: TfidfSettings):
    n = F.col("n").cast("double")
    dfc = F.col("df").cast("double")
    if not s.use_idf:
        return F.lit(1.0)
    if s.smooth_idf:
        return F.log((n + 1.0) / (dfc + 1.0)) + 1.0
    return F.log(n / dfc) + 1.0


#: Characters of a term by which equal frequencies are told apart before single terms are ranked (affects speed only).
TIE_PREFIX = 4


def _limit_features(stats: DataFrame, limit: int, keys: list[str]) -> DataFrame:
    """Keep the ``limit`` terms with the highest corpus frequency per key (ties: term ascending).

    Selection by counting: a histogram of frequencies and its running sum show which frequencies fit whole and which one
    the cut falls into; that one's terms are divided the same way by their first characters, and the terms of the prefix
    that the cut falls into one by one.  No sort of all terms and no other plan for small vocabularies.
    """
    columns = stats.columns
    undecided, kept = stats.withColumn("__room", F.lit(limit).cast("long")), []
    for value, order in ((F.col("ctf"), F.desc), (F.substring("term", 1, TIE_PREFIX), F.asc), (F.col("term"), F.asc)):
        valued = undecided.withColumn("__v", value)
        hist = valued.groupBy(*keys, "__v").agg(F.count("*").alias("__c"), F.first("__room").alias("__r"))
        above = Window.partitionBy(*keys).orderBy(order("__v")).rowsBetween(Window.unboundedPreceding, -1)
        hist = hist.withColumn("__left", F.col("__r") - F.coalesce(F.sum("__c").over(above), F.lit(0))).where("__left > 0").drop("__r")
        marked = valued.join(hist, [*keys, "__v"])
        kept.append(marked.where("__c <= __left").select(*columns))
        undecided = marked.where("__c > __left").select(*columns, F.col("__left").alias("__room"))
    return reduce(DataFrame.unionByName, kept)  # single terms all fit or do not, so nothing is undecided after the last step


def weigh(counts: DataFrame, vocab: DataFrame, s: TfidfSettings, keys: list[str] | None = None) -> DataFrame:
    """V8/V9: postings ``(keys…, id, term, tid, w)`` of any rows against a fitted vocabulary, with ``w = tfw · idf / norm`` and ``df``.

    Terms outside the vocabulary are dropped before the l2 norm (as the
    vectorizer's ``transform``). The vocabulary side is broadcast only when its
    size is bounded by ``max_features``; otherwise Spark plans a shuffle join.
    """
    keys = keys or []
    v = vocab.select(*keys, "term", "tid", "idf", "df")
    if s.max_features is not None and s.max_features <= BROADCAST_VOCAB_LIMIT and not keys:
        v = F.broadcast(v)
    joined = counts.join(v, [*keys, "term"], "inner")
    raw = joined.select(*keys, "id", "term", "tid", "idf", "df", _tf_weight(s).alias("tfw"))
    raw = raw.withColumn("raw", F.col("tfw") * F.col("idf"))
    # The norm is a window over the row key, so its groups are the terms of one row.
    norm = F.sqrt(F.sum(F.col("raw") * F.col("raw")).over(Window.partitionBy(*keys, "id")))
    weighted = raw.withColumn("norm", norm).withColumn("w", F.col("raw") / F.col("norm"))
    return weighted.select(*keys, "id", "term", "tid", "w", "tfw", "idf", "norm", "df").where(F.col("w").isNotNull())


def fit_transform(
    bank: DataFrame,
    queries: DataFrame,
    s: TfidfSettings,
    *,
    bank_id: str = "pos",
    query_id: str = "qid",
    text_col: str = "question",
    keys: list[str] | None = None,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Fit on ``bank`` and vectorise both sides: ``(vocab, bank_postings, query_postings)``."""
    keys = keys or []
    # read twice (document frequencies, then weights): keep the exploded counts instead of re-deriving them
    bank_counts = term_counts(bank, bank_id, text_col, s, keys).persist(StorageLevel.MEMORY_AND_DISK)
    n_docs = bank.groupBy(*keys).agg(F.count("*").alias("n"))
    # Document frequencies are counted before the shuffle, and the join back on the term is one AQE can split: a term that
    # most rows hold never lands in one task.
    vocab = fit_vocabulary(bank_counts, n_docs, s, keys)
    bank_post = weigh(bank_counts, vocab, s, keys)
    query_post = weigh(term_counts(queries, query_id, text_col, s, keys), vocab, s, keys)
    return vocab, bank_post, query_post
