"""Language identification as inference of a language mixture (operator 6).

Training counts byte trigrams (hashed to ``BUCKETS``) per language over a bounded sample of
the labelled rows.  A document is cut into short units of ``UNIT`` trigrams; a unit
comes from one language, and expectation-maximisation estimates the document's proportions of
languages from the units' trigram likelihoods.  The language set is chosen by penalised
likelihood: for each size m the m largest languages of the full mixture are fitted
again, and each further language must raise the log-likelihood by ``PENALTY`` and half the
logarithm of the number of units.

Defined cases: a null text and one without a letter are ``und`` with score 0; so is every
text if there is nothing to learn from.  Ties go to the language that sorts first.
Neither ``lang`` nor ``source`` nor ``doc_id`` is read for a prediction.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from answerbank.llm.common import lower_ascii, table, text_bytes, text_slices

UNKNOWN = "und"
BUCKET_BITS = 16
BUCKETS = 1 << BUCKET_BITS
#: Documented bound: about so many labelled documents of each language are learned from (whole texts).
TRAIN_PER_LANGUAGE = 3000
#: More learned languages than this is an error: the model is held by every task.
MAX_LANGUAGES = 500
#: Trigrams of a unit, and the weight of a trigram (neighbours overlap, so each counts a third).
UNIT, TRIGRAM_WEIGHT = 24, 1 / 3
SMOOTHING = 0.5
ROUNDS = 6
PENALTY = 4.0
LATIN_LETTER = re.compile(rb"[A-Za-z]")


@dataclass(frozen=True)
class Model:
    """Languages in order and the log-likelihood of each trigram bucket (BUCKETS x languages)."""

    languages: tuple[str, ...]
    log_p: np.ndarray


def held_out(doc_id: Column) -> Column:
    """Whether a row is never learned from: crc32 of its id as text leaves 2 modulo 4."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def trigrams(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bucket of each trigram of texts padded by a blank on both sides; starts and counts per row."""
    data, offsets = text_bytes(column)
    n = len(offsets) - 1
    padded = np.full(len(data) + n + 1, 32, dtype=np.uint8)
    sizes = np.diff(offsets)
    place = np.arange(len(data)) + np.repeat(np.arange(1, n + 1), sizes)
    padded[place] = lower_ascii(data)
    if len(padded) < 3:
        return np.zeros(0, np.uint16), np.zeros(n, np.int64), np.zeros(n, np.int64)
    wide = padded.astype(np.uint32)
    code = (wide[:-2] << np.uint32(16)) | (wide[1:-1] << np.uint32(8)) | wide[2:]
    buckets = ((code * np.uint32(2654435761)) >> np.uint32(32 - BUCKET_BITS)).astype(np.uint16)
    return buckets, offsets[:-1] + np.arange(n), sizes


def train(docs: DataFrame, per_language: int = TRAIN_PER_LANGUAGE) -> Model:
    """Learn from the rows with a text and a ``lang`` that are not held out."""
    labelled = docs.filter(F.col("text").isNotNull() & F.col("lang").isNotNull() & ~held_out(F.col("doc_id")))
    sizes = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count("*").alias("n")).limit(MAX_LANGUAGES + 1).collect()}
    if len(sizes) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages to learn")
    languages = tuple(sorted(sizes))
    if not languages:
        return Model((), np.zeros((BUCKETS, 0), np.float32))
    index = {lang: k for k, lang in enumerate(languages)}
    grain = 1 << 20
    share = F.create_map(*[x for lang in languages for x in (F.lit(lang), F.lit(min(grain, -(-per_language * grain // sizes[lang]))))])
    drawn = F.pmod(F.xxhash64(F.col("doc_id"), F.lit("train")), F.lit(grain)) < share[F.col("lang")]
    sample = labelled.filter(drawn).select("lang", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = np.zeros((len(languages), BUCKETS), dtype=np.int64)
        for batch in batches:
            for low, high in text_slices(batch, "text"):
                part = batch.slice(low, high - low)
                buckets, starts, n = trigrams(part.column("text"))
                for lang, first, size in zip(part.column("lang").to_pylist(), starts.tolist(), n.tolist()):
                    np.add.at(totals[index[lang]], buckets[first : first + size], 1)
        lang, bucket = np.nonzero(totals)
        yield pa.RecordBatch.from_pydict(
            {"lang": pa.array(lang, pa.int32()), "bucket": pa.array(bucket, pa.int32()), "n": pa.array(totals[lang, bucket], pa.int64())}
        )

    rows = (
        sample.repartition(6)  # the sample is bounded; few tasks send few partial tables
        .mapInArrow(count, "lang int, bucket int, n long")
        .groupBy("lang", "bucket")
        .agg(F.sum("n").alias("n"))
        .toArrow()
    )
    counts = np.full((BUCKETS, len(languages)), SMOOTHING)
    np.add.at(counts, (rows["bucket"].to_numpy(), rows["lang"].to_numpy()), rows["n"].to_numpy())
    return Model(languages, np.log(counts / counts.sum(axis=0)).astype(np.float32))


def fit(units: np.ndarray, rows: np.ndarray, firsts: np.ndarray, n_units: np.ndarray, start: np.ndarray):
    """EM of every document's proportions from ``start``; a language at 0 stays at 0.

    ``units``: likelihood of each unit under each language, relative to its best one.
    Returns the proportions and the log-likelihood of each document.
    """
    share = start
    for _ in range(ROUNDS):
        joint = units * share[rows]
        joint /= joint.sum(axis=1, keepdims=True)
        share = np.add.reduceat(joint, firsts, axis=0) / n_units[:, None]
    return share, np.add.reduceat(np.log((units * share[rows]).sum(axis=1)), firsts)


def mixtures(model: Model, column: pa.Array) -> np.ndarray:
    """Proportions (rows x languages) of every text; a row without any byte has zeros."""
    out = np.zeros((len(column), len(model.languages)))
    buckets, starts, n = trigrams(column)
    some = np.flatnonzero(n > 0)
    if not len(some) or not model.languages:
        return out
    n_units = -(-n[some] // UNIT)
    firsts = np.concatenate(([0], np.cumsum(n_units)[:-1]))
    rows = np.repeat(np.arange(len(some)), n_units)
    begins = np.repeat(starts[some], n_units) + UNIT * (np.arange(int(n_units.sum())) - firsts[rows])
    values = model.log_p[buckets]
    across = starts + n  # after each row's own trigrams stands one that belongs to no text
    values[across[across < len(values)]] = 0
    scores = np.add.reduceat(values, begins, axis=0).astype(np.float64) * TRIGRAM_WEIGHT
    units = np.exp(scores - scores.max(axis=1, keepdims=True)) + 1e-30
    n_langs = len(model.languages)
    full, _ = fit(units, rows, firsts, n_units, np.full((len(some), n_langs), 1 / n_langs))
    rank = np.argsort(np.argsort(-full, axis=1, kind="stable"), axis=1)
    best, best_value = full, np.full(len(some), -np.inf)
    for m in range(1, n_langs + 1):
        chosen = rank < m
        share, value = fit(units, rows, firsts, n_units, chosen / m)
        value = value - (m - 1) * (PENALTY + 0.5 * np.log(n_units))
        better = value > best_value
        best = np.where(better[:, None], share, best)
        best_value = np.maximum(value, best_value)
    out[some] = best
    return out


def predict(
    docs: DataFrame,
    model: Model,
    keep: tuple[str, ...] = ("doc_id",),
    names: tuple[str, str, str] = ("lang_pred", "score", "shares"),
) -> DataFrame:
    """The columns ``keep``, the language, its proportion (score) and all proportions, named ``names``."""
    fields = [docs.schema[c] for c in keep]
    columns = [f.name for f in fields]
    text_name = "text" if "text" in columns else "__text"
    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in fields)
    schema += "{} string, {} double, {} map<string,double>".format(*names)
    limit = max(1 << 14, (1 << 20) // max(1, len(model.languages)))
    # Plain values, BUCKETS x MAX_LANGUAGES floats at most: a task needs no install of this package to read them.
    sent = docs.sparkSession.sparkContext.broadcast((model.languages, model.log_p))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(*sent.value)
        for batch in batches:
            for low, high in text_slices(batch, text_name, limit):
                part = batch.slice(low, high - low)
                texts = part.column(text_name)
                shares = mixtures(model, texts)
                lang, score, all_shares = [], [], []
                for text, share in zip(texts, shares):
                    text = text.as_py() or ""
                    lettered = LATIN_LETTER.search(text.encode()) or any(map(str.isalpha, text))
                    if not lettered or not len(share):
                        lang.append(UNKNOWN), score.append(0.0), all_shares.append([])
                        continue
                    top = int(share.argmax())
                    lang.append(model.languages[top])
                    score.append(min(1.0, float(share[top])))
                    all_shares.append([(model.languages[k], float(share[k])) for k in np.flatnonzero(share > 0)])
                out = {c: part.column(c) for c in columns}
                out |= {names[0]: pa.array(lang, pa.string()), names[1]: pa.array(score, pa.float64())}
                yield pa.RecordBatch.from_pydict(out | {names[2]: pa.array(all_shares, pa.map_(pa.string(), pa.float64()))})

    return docs.select(*columns, *([] if "text" in columns else [F.col("text").alias(text_name)])).mapInArrow(run, schema)


def predicted_documents(spark, sf_dir: str) -> DataFrame:
    """Query op6: the language of every whole text of documents."""
    docs = table(spark, sf_dir, "documents")
    found = predict(docs, train(docs))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "shares")


def identified(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: rows whose language can be told stay as they are; ``und`` rows go."""
    found = predict(docs, train(docs), keep=tuple(docs.columns), names=("__lang", "__score", "__shares"))
    return found.filter(F.col("__lang") != UNKNOWN).select(*docs.columns)
