"""Scans of the driver tables and the views the operators run on.

Every view reads whole rows and whole texts (no prefixes, no row caps); the
``split`` column assigns each row to the answer bank or to the query side, so
every row takes part in the work.
"""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from answerbank.plans.ranking import global_rank

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    if name not in TABLES:
        raise ValueError(f"unknown table {name!r}")
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def conv_qa(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Question/answer pairs: a user turn and the assistant turn that follows it.

    ``(id, question, answer, subset, split, pos)``; subset is ``s<conv_id mod 4>``,
    conversations with ``conv_id mod 5 = 0`` are the query side (the validation split).
    """
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    a = c.where(F.col("role") == "user").alias("a")
    b = c.where(F.col("role") == "assistant").alias("b")
    j = a.join(b, (F.col("a.conv_id") == F.col("b.conv_id")) & (F.col("b.turn") == F.col("a.turn") + 1))
    rid = F.col("a.conv_id") * 1000 + F.col("a.turn")
    return j.select(
        rid.alias("id"),
        F.col("a.text").alias("question"),
        F.col("b.text").alias("answer"),
        F.concat(F.lit("s"), (F.col("a.conv_id") % 4).cast("string")).alias("subset"),
        F.when(F.col("a.conv_id") % 5 == 0, "query").otherwise("bank").alias("split"),
        rid.alias("pos"),
    )


CONV_QA_SQL = """
select a.conv_id*1000+a.turn as id, a.text as question, b.text as answer,
       concat('s', cast(a.conv_id % 4 as varchar)) as subset,
       case when a.conv_id % 5 = 0 then 'query' else 'bank' end as split,
       a.conv_id*1000+a.turn as pos
from conversations a join conversations b on a.conv_id = b.conv_id and b.turn = a.turn + 1
where a.role = 'user' and b.role = 'assistant'
"""


def doc_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole documents as a retrieval corpus: ``(id, question=text, answer=source, subset=lang, split, pos)``."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    return d.select(
        F.col("doc_id").alias("id"),
        F.col("text").alias("question"),
        F.col("source").alias("answer"),
        F.col("lang").alias("subset"),
        F.when(F.col("doc_id") % 5 == 0, "query").otherwise("bank").alias("split"),
        F.col("doc_id").alias("pos"),
    )


DOC_SPLIT_SQL = """
select doc_id as id, text as question, source as answer, lang as subset,
       case when doc_id % 5 = 0 then 'query' else 'bank' end as split, doc_id as pos
from documents
"""


def bank_and_queries(qa: DataFrame, keep: bool = True) -> tuple[DataFrame, DataFrame]:
    """Split a QA view into the bank (labelled) and the query side (``qid``).

    The view (a self-join of turns) is read by many branches of one plan — the
    bank, the queries, padding, answer lookup — so it is materialised once
    (memory, spilling to disk; recomputed from lineage if an executor is lost).
    A view that is a plain scan is not worth its disk: ``keep=False`` reads the table again.
    """
    if keep:
        qa = qa.persist(StorageLevel.MEMORY_AND_DISK)
    bank = qa.where(F.col("split") == "bank")
    queries = qa.where(F.col("split") == "query").withColumnRenamed("id", "qid")
    return bank, queries


#: Replies that look like JSON but need care: padding, null, boolean, quoted and broken values.
ODD_REPLIES = (
    '{"choice": " b\\n", "confidence": 0.9}',
    '{"choice": "B", "confidence": true, "reason": false}',
    '{"choice": "B", "confidence": null, "reason": "x"}',
    '{"choice": "B", "confidence": " 0.75 ", "reason": null}',
    '{"choice": "B", "confidence": "high"} score: 0.4',
    "{'choice': 'B', 'confidence': 0.8}",
    '{"choice": "B", "confidence": 0.7',
    '{"choice": null, "reason": 12}',
    '{"confidence": [0.9], "choice": "B"}',
)


def judge_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Judge replies: JSON after a think block, free text, no decision, other JSON, and every eleventh an odd shape."""
    e = table(spark, sf_dir, "events")
    num = F.lpad(F.regexp_extract("props", r"([0-9]+)", 1), 2, "0")
    odd = F.element_at(F.array(*map(F.lit, ODD_REPLIES)), (F.floor(F.col("event_id") / 11) % len(ODD_REPLIES) + 1).cast("int"))
    raw = (
        F.when(F.col("event_id") % 11 == 0, odd)
        .when(
            F.col("event_id") % 4 == 0,
            F.concat(
                F.lit('<think>n</think>{"choice": "B", "confidence": 0.'),
                num,
                F.lit(', "reason": "'),
                F.col("event_type"),
                F.lit('"}'),
            ),
        )
        .when(F.col("event_id") % 4 == 1, F.concat(F.lit("Choice b, confidence: 0."), num))
        .when(F.col("event_id") % 4 == 2, F.lit("I am not sure."))
        .otherwise(F.col("props"))
    )
    return e.select(F.col("event_id").alias("id"), raw.alias("raw"))


_ODD_SQL = ", ".join("'" + reply.replace("'", "''") + "'" for reply in ODD_REPLIES)
JUDGE_RAW_SQL = f"""
select event_id as id, case when event_id % 11 = 0 then ([{_ODD_SQL}])[(event_id // 11) % {len(ODD_REPLIES)} + 1] else case event_id % 4
  when 0 then concat('<think>n</think>{{"choice": "B", "confidence": 0.',
                     lpad(regexp_extract(props,'([0-9]+)',1),2,'0'), ', "reason": "', event_type, '"}}')
  when 1 then concat('Choice b, confidence: 0.', lpad(regexp_extract(props,'([0-9]+)',1),2,'0'))
  when 2 then 'I am not sure.' else props end end as raw
from events
"""


def history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score histories, one series per user, ``seq`` in time order (ranked over all tasks, so a series may be of any length)."""
    e = table(spark, sf_dir, "events")
    e = e.select(F.col("user_id").alias("series"), F.col("event_id").alias("id"), F.col("value").alias("score"), "ts")
    ranked = global_rank(e, ["series"], [F.col("ts").asc(), F.col("id").asc()], "seq")
    return ranked.select("series", "id", "score", "seq")


HISTORY_SQL = """
select user_id as series, event_id as id, value as score,
       row_number() over (partition by user_id order by ts, event_id) as seq
from events
"""


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dense vectors ``(vid, vec array<double>, label)``."""
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").alias("vid"), F.col("embedding").cast("array<double>").alias("vec"), "label")


def qa_vectors(spark: SparkSession, sf_dir: str, qa: DataFrame) -> DataFrame:
    """Encoder output for QA rows, taken from the ``embeddings`` table: row ``id`` uses vector ``id mod n``."""
    v = vectors(spark, sf_dir)
    n = v.count()
    return (
        qa.select("id")
        .select("id", F.pmod(F.col("id"), F.lit(n)).alias("vid"))
        .join(v.select("vid", "vec"), "vid")
        .select("id", "vec")
    )


QA_VECTORS_SQL = """
select q.id, cast(e.embedding as double[]) as vec from ({qa}) q
join embeddings e on e.vec_id = q.id % (select count(*) from embeddings)
"""
