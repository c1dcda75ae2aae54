"""Registered queries of the training-data operators and their DuckDB SQL, where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from answerbank.llm import ann_collision, bpe_tree, cross_tokenizer, html_template, jaccard_join, langid, line_dedup, merkle, packing, periodic_runs, pii_feistel, suffix_dedup, warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_html_template": html_template.extracted_pages,
    "op2_bpe_tree": bpe_tree.roundtrip,
    "op3_ann_collision": ann_collision.nearest_embeddings,
    "op4_pii_feistel": pii_feistel.pseudonymised_documents,
    "op5_merkle": merkle.fingerprinted_documents,
    "op6_langid": langid.predicted_documents,
    "op7_jaccard_join": jaccard_join.linked_documents,
    "op8_suffix_dedup": suffix_dedup.deduped_bytes,
    "op9_line_dedup": line_dedup.deduped_lines,
    "op10_best_fit_packing": packing.packed_documents,
    "op11_periodic_runs": periodic_runs.documents_runs,
    "op12_warc": warc.archived_pages,
    "op13_cross_tokenizer": cross_tokenizer.aligned_documents,
}

ORACLE: dict[str, str] = {}
