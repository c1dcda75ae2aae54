"""Shared helpers of the training-data operators: Arrow text buffers, byte-level words, stable hashes."""

from __future__ import annotations

import sys
import types
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Text handled at once inside a task, in bytes; larger single texts are handled alone.
SLICE_BYTES = 1 << 18


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def process_cache(key: str, build: Callable[[], object]) -> object:
    """Build ``key`` once per Python worker process (tokenizers are slow to load)."""
    module = sys.modules.setdefault("_answerbank_llm_cache", types.ModuleType("_answerbank_llm_cache"))
    if not hasattr(module, key):
        setattr(module, key, build())
    return getattr(module, key)


def shuffle_partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut lineage into the shared folder named by ``spark.checkpoint.dir`` (set only where unset, as in tests)."""
    from answerbank.session import ensure_checkpoint_dir

    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def text_slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of ``batch`` whose texts hold at most ``limit`` bytes together (one row at least)."""
    ends = np.asarray(batch.column(column).cast(pa.large_string()).fill_null("").buffers()[1])
    offsets = np.frombuffer(ends, dtype=np.int64)[: batch.num_rows + 1]
    low = 0
    while low < batch.num_rows:
        high = int(np.searchsorted(offsets, offsets[low] + limit, side="right")) - 1
        high = max(low + 1, min(high, batch.num_rows))
        yield low, high
        low = high


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and row offsets of a string column without copies (null reads as empty)."""
    filled = pa.concat_arrays([column.cast(pa.large_string()).fill_null("")])
    _, offsets, data = filled.buffers()
    offsets = np.frombuffer(offsets, dtype=np.int64)[filled.offset : filled.offset + len(filled) + 1]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix): a bijection, so distinct inputs stay distinct."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def lower_ascii(data: np.ndarray) -> np.ndarray:
    """A-Z to a-z; other bytes stay."""
    return np.where((data >= 65) & (data <= 90), data + np.uint8(32), data)


#: An odd 64-bit number and its inverse modulo 2^64 (fixed values; base of the polynomial hash).
BASE = 0x9E3779B97F4A7C15
BASE_INVERSE = pow(BASE, -1, 1 << 64)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE^k and BASE^-k modulo 2^64 for k < n (kept per process up to 4 MB of text)."""

    def build(size: int) -> tuple[np.ndarray, np.ndarray]:
        factors = np.ones((2, size), dtype=np.uint64)
        factors[0, 1:], factors[1, 1:] = BASE, BASE_INVERSE
        return tuple(np.cumprod(factors, axis=1))

    if n > 1 << 22:
        return build(n)
    size = max(1 << 19, 1 << (n - 1).bit_length()) if n else 1 << 19
    return process_cache(f"powers_{size}", lambda: build(size))


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each byte span ``[starts, ends)``: a polynomial in its bytes, mixed with its length."""
    up, down = powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=sums[1:])
    values = (sums[ends] - sums[starts]) * down[starts]
    return mix64(values + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and rows of the words ``[^\\x20\\x09-\\x0D]+`` of each text."""
    solid = ~((data == 32) | ((data >= 9) & (data <= 13)))
    edge = np.zeros(len(data) + 1, dtype=bool)
    edge[offsets] = True  # a word never crosses texts
    before = np.concatenate(([False], solid[:-1])) if len(data) else solid
    starts = np.flatnonzero(solid & (~before | edge[:-1]))
    after = np.concatenate((solid[1:], [False])) if len(data) else solid
    ends = np.flatnonzero(solid & (~after | edge[1:])) + 1
    rows = np.searchsorted(offsets, starts, side="right") - 1
    return starts, ends, rows


def scratch_table(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared checkpoint folder and read it again."""
    import uuid

    from answerbank.session import ensure_checkpoint_dir

    path = f"{ensure_checkpoint_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def widened(schema: StructType, **more: str) -> StructType:
    """A copy of ``schema`` with more columns (``StructType.add`` would change the DataFrame's own)."""
    return StructType([*schema.fields, *StructType.fromDDL(", ".join(f"`{name}` {kind}" for name, kind in more.items())).fields])
