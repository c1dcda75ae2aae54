"""Training-data pipeline over ``documents``: each stage applies one operator of ``answerbank.llm``.

language ID -> line dedup -> n-gram Jaccard join -> PII pseudonyms -> best-fit packing
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from answerbank.llm import jaccard_join, langid, line_dedup, packing, pii_feistel
from answerbank.llm.common import scratch_table


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Last stage: every document as token pieces in sequences of 1024 tokens."""
    return packing.pack(packing.token_pieces(docs))


#: (name, function); a function takes (spark, docs, sf_dir) and returns the next documents.
STAGES = [
    ("language_id", langid.identified),
    ("line_dedup", line_dedup.without_repeats),
    ("near_copies", jaccard_join.without_near_copies),
    ("pii", pii_feistel.private),
    ("packing", packed),
]

#: SQL cannot express mixture inference or packing; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what each returns is written as Parquet and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = scratch_table(docs, f"pipeline-{k}-{name}")
    return docs
