"""Exact lexical similarity search over TF-IDF postings.

Inputs are plain DataFrames:

* bank: ``(keys…, pos bigint, id, question string, answer string)``; ``pos``
  is the row order (ties go to the lower position, §8.1 of the design);
* queries: ``(keys…, qid bigint, question string)``.

Every query gets exactly ``min(k, bank rows)`` candidates ordered by
``(round(score, 9) desc, pos asc)``; when fewer than ``k`` bank rows share a
term, the lowest positions follow at score 0 (so a query sharing nothing
matches the first bank row with similarity 0, as the argmax of an all-zero row).
"""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from answerbank.operators.tfidf import (
    TfidfSettings,
    fit_vocabulary,
    hashed_counts,
    hashed_postings,
    hashed_vocabulary,
    term_counts,
    tf_weights,
    weigh,
)
from answerbank.plans.blocks import (
    NO_ID,
    TERM_JOIN_MAX_PAIRS,
    best_of_packed,
    blocked_topk,
    pack,
    order_key,
    pad_rows,
    term_join_scores,
)
from answerbank.session import ensure_checkpoint_dir

STRATEGIES = ("auto", "term_join", "blocked")


def topk_scores(
    bank: DataFrame,
    queries: DataFrame,
    settings: TfidfSettings,
    k: int,
    *,
    keys: list[str] | None = None,
    strategy: str = "auto",
    text_col: str = "question",
) -> DataFrame:
    """J1 + J3: ``(keys…, qid, pos, score, rank)``, rank 1..min(k, bank rows) for every query.

    With ``keys`` the vocabulary, idf and candidate set are per key (the bank
    is restricted to the query's key before fitting).  A query whose key is null or
    has no bank rows gets no candidates; ``grouped_top1`` sends such queries to the whole bank.
    """
    if strategy not in STRATEGIES:
        raise ValueError(f"strategy must be one of {STRATEGIES}")
    if k < 1:
        raise ValueError("k must be >= 1")
    keys = keys or []
    find = _capped_scores if settings.max_features is not None else _uncapped_scores
    scores, strategy = find(bank, queries, settings, k, keys, strategy, text_col)
    cand = scores.unionByName(pad_rows(bank, queries, k, keys))
    cand = cand.groupBy(*keys, "qid", "pos").agg(F.max("score").alias("score"))
    w = Window.partitionBy(*keys, "qid").orderBy(*order_key())
    top = cand.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    # k rows a query: kept, so that a plan that reads them twice does not score twice
    return top.persist(StorageLevel.MEMORY_AND_DISK) if strategy == "blocked" else top


def _strategy_for(q_post: DataFrame, strategy: str) -> str:
    if strategy != "auto":
        return strategy
    pairs = q_post.agg(F.sum("df")).first()[0] or 0  # postings that the term join would pair
    return "term_join" if pairs <= TERM_JOIN_MAX_PAIRS else "blocked"


def _capped_scores(
    bank: DataFrame, queries: DataFrame, settings: TfidfSettings, k: int, keys: list[str], strategy: str, text_col: str
) -> tuple[DataFrame, str]:
    """Scores with a bounded vocabulary, which is sent to the postings, and the strategy they were found by."""
    # read twice (document frequencies, then weights): keep the exploded counts instead of re-deriving them
    counts = term_counts(bank, "pos", text_col, settings, keys).persist(StorageLevel.MEMORY_AND_DISK)
    vocab = fit_vocabulary(counts, bank.groupBy(*keys).agg(F.count("*").alias("n")), settings, keys)
    # a bounded table; cutting it off keeps the plan of the cut by frequency from being copied into every later plan
    ensure_checkpoint_dir(bank.sparkSession)
    vocab = vocab.checkpoint()
    b_post = weigh(counts, vocab, settings, keys)
    q_post = weigh(term_counts(queries, "qid", text_col, settings, keys), vocab, settings, keys)
    q_post = q_post.select(*keys, "id", "tid", "w", "idf", "df").persist(StorageLevel.MEMORY_AND_DISK)
    strategy = _strategy_for(q_post, strategy)
    if strategy == "term_join":
        kept = b_post.select(*keys, "id", "tid", "w").persist(StorageLevel.MEMORY_AND_DISK)
        return term_join_scores(q_post, kept, keys), strategy
    # the bank's idf goes to the query's side and its norm to the row: what is left of a bank weight is a tf that repeats
    asked = q_post.select(*keys, "id", "tid", (F.col("w") * F.col("idf")).alias("w"))
    held = b_post.select(*keys, "id", "tid", F.col("tfw").alias("w"), (F.lit(1.0) / F.col("norm")).alias("scale"))
    scores = blocked_topk(asked, held, k, keys)  # keeps its packed blocks: nothing reads the postings again
    for read in (counts, q_post, vocab):
        read.unpersist()
    return scores, strategy


def _uncapped_scores(
    bank: DataFrame, queries: DataFrame, settings: TfidfSettings, k: int, keys: list[str], strategy: str, text_col: str
) -> tuple[DataFrame, str]:
    """As ``_capped_scores`` with a vocabulary of any size, which meets the postings by a shuffle.

    A text is kept as one row of term hashes and counts, and no term's text is moved or kept.  The bank's idf goes to the query's
    side, so a bank posting needs its idf for the row's norm only: postings go to the vocabulary, and what comes back is a sum
    a row.  Terms outside the vocabulary stay in the bank's rows: no query holds them.
    """
    numbered = lambda df, name: df.withColumn(name, F.coalesce(F.col(name), F.lit(NO_ID)))  # noqa: E731  rows are joined by it
    counts = hashed_counts(numbered(bank, "pos"), "pos", text_col, settings, keys).persist(StorageLevel.MEMORY_AND_DISK)
    counts.count()  # now Spark knows how the rows lie
    vocab = hashed_vocabulary(counts, bank.groupBy(*keys).agg(F.count("*").alias("n")), settings, keys)
    vocab = vocab.persist(StorageLevel.MEMORY_AND_DISK)
    raw = F.col("tfw") * F.col("idf")
    norm = F.sqrt(F.sum(raw * raw))
    norms = hashed_postings(counts, vocab, settings, keys).groupBy(*keys, "id").agg((F.lit(1.0) / norm).alias("scale"))
    norms = norms.persist(StorageLevel.MEMORY_AND_DISK)  # one number a row
    held = counts.join(norms, [*keys, "id"]).select(*keys, F.col("id").alias("rid"), "tids", tf_weights(settings).alias("ws"), "scale")
    asked = hashed_postings(hashed_counts(numbered(queries, "qid"), "qid", text_col, settings, keys), vocab, settings, keys)
    norm = F.sqrt(F.sum(raw * raw).over(Window.partitionBy(*keys, "id")))
    asked = asked.select(*keys, "id", "tid", (raw * F.col("idf") / norm).alias("w"), "df").persist(StorageLevel.MEMORY_AND_DISK)
    strategy = _strategy_for(asked, strategy)
    if strategy == "term_join":
        rows = held.select(*keys, F.col("rid").alias("id"), "scale", F.inline(F.arrays_zip("tids", "ws")))
        rows = rows.select(*keys, "id", F.col("tids").alias("tid"), (F.col("ws") * F.col("scale")).alias("w"))
        scores = term_join_scores(asked, rows.persist(StorageLevel.MEMORY_AND_DISK), keys)
        known = lambda name: F.nullif(F.col(name), F.lit(NO_ID)).alias(name)
        return scores.select(*keys, known("qid"), known("pos"), "score"), strategy
    scores = best_of_packed(pack(asked.drop("df"), keys), held, k, keys)
    for read in (counts, vocab, norms, asked):
        read.unpersist()
    return scores, strategy


def attach_answers(top: DataFrame, bank: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Candidate rows -> ``(qid, matched_id, pos, similarity, prediction, rank)`` (null answer -> '')."""
    keys = keys or []
    b = bank.select(*keys, "pos", F.col("id").alias("matched_id"), F.coalesce(F.col("answer"), F.lit("")).alias("prediction"))
    extra = ["rank"] if "rank" in top.columns else []
    return top.join(b, [*keys, "pos"]).select(
        *keys, "qid", "matched_id", "pos", F.col("score").alias("similarity"), "prediction", *extra
    )


def top1_predict(
    bank: DataFrame, queries: DataFrame, settings: TfidfSettings, *, strategy: str = "auto"
) -> DataFrame:
    """Best bank row per query -> ``(qid, matched_id, similarity, prediction)``."""
    top = topk_scores(bank, queries, settings, 1, strategy=strategy)
    return attach_answers(top, bank).select("qid", "matched_id", "pos", "similarity", "prediction")


def grouped_top1(
    bank: DataFrame,
    queries: DataFrame,
    settings: TfidfSettings,
    group_col: str = "subset",
    *,
    strategy: str = "auto",
) -> DataFrame:
    """Match inside the query's group (vocabulary and idf fitted per group).

    Queries whose group has no bank rows (or is null) match against the whole bank.
    """
    b = bank.withColumnRenamed(group_col, "__g")
    q = queries.withColumnRenamed(group_col, "__g")
    present = b.select("__g").where(F.col("__g").isNotNull()).distinct()
    q_in = q.join(present, "__g", "left_semi")
    q_out = q.join(present, "__g", "left_anti")
    inside = attach_answers(topk_scores(b, q_in, settings, 1, keys=["__g"], strategy=strategy), b, ["__g"])
    cols = ["qid", "matched_id", "pos", "similarity", "prediction"]
    if q_out.isEmpty():  # nobody asks the whole bank: no second vocabulary
        return inside.select(*cols)
    outside = attach_answers(topk_scores(b.drop("__g"), q_out.drop("__g"), settings, 1, strategy=strategy), b.drop("__g"))
    return inside.select(*cols).unionByName(outside.select(*cols))


def group_settings_top1(
    bank: DataFrame,
    queries: DataFrame,
    default: TfidfSettings,
    overrides: dict[str, dict],
    group_col: str = "subset",
    *,
    strategy: str = "auto",
) -> DataFrame:
    """Each query group uses its own vectoriser settings over the *whole* bank.

    One branch per distinct setting (a handful, from the caller's config), unioned.
    """
    by_setting: dict[TfidfSettings, list[str]] = {}
    for g, o in overrides.items():
        by_setting.setdefault(default.with_(**o), []).append(g)
    cols = ["qid", "matched_id", "pos", "similarity", "prediction"]
    parts = []
    listed = list(overrides)
    default_q = queries.where(~F.col(group_col).isin(listed) | F.col(group_col).isNull()) if listed else queries
    parts.append(top1_predict(bank, default_q, default, strategy=strategy).select(*cols))
    for s, groups in by_setting.items():
        q = queries.where(F.col(group_col).isin(groups))
        parts.append(top1_predict(bank, q, s, strategy=strategy).select(*cols))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def scoped_topk(
    bank: DataFrame,
    queries: DataFrame,
    settings: TfidfSettings,
    k: int,
    *,
    group_col: str = "subset",
    default_scope: str = "all",
    scopes: dict[str, str] | None = None,
    strategy: str = "auto",
) -> DataFrame:
    """Candidate scope per group: ``all`` (whole bank) or ``same_group`` (bank filtered before fitting).

    A ``same_group`` query whose group has no bank row is an error, as in the reference.
    """
    scopes = scopes or {}
    for v in [default_scope, *scopes.values()]:
        if v not in ("all", "same_group"):
            raise ValueError(f"unknown candidate scope {v!r}")
    same = [g for g, v in scopes.items() if v == "same_group"]
    every = [g for g, v in scopes.items() if v == "all"]
    g = F.col(group_col)
    if default_scope == "same_group":
        q_same = queries.where(~g.isin(every)) if every else queries
    else:
        q_same = queries.where(g.isin(same)) if same else queries.limit(0)
    q_all = queries.join(q_same.select("qid"), "qid", "left_anti")
    b = bank.withColumnRenamed(group_col, "__g")
    missing = q_same.withColumnRenamed(group_col, "__g").join(b.select("__g").distinct(), "__g", "left_anti")
    if missing.limit(1).count():
        raise ValueError("same_group scope: a query group has no bank rows")
    inside = attach_answers(
        topk_scores(b, q_same.withColumnRenamed(group_col, "__g"), settings, k, keys=["__g"], strategy=strategy),
        b,
        ["__g"],
    ).drop("__g")
    outside = attach_answers(topk_scores(bank, q_all, settings, k, strategy=strategy), bank)
    return inside.unionByName(outside.select(*inside.columns))


def test_bank(train: DataFrame, val: DataFrame, include_val: bool = True) -> DataFrame:
    """The bank for unlabelled queries: train rows, then validation rows after them in position order."""
    if not include_val:
        return train
    top = train.agg(F.max("pos").alias("m")).first()["m"]
    offset = 0 if top is None else int(top) + 1
    return train.unionByName(val.withColumn("pos", F.col("pos") + F.lit(offset)), allowMissingColumns=True)
