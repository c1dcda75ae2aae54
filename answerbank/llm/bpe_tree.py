"""Byte-level BPE encoding and decoding by a tree of halves (operator 2).

``encode`` splits a text in two halves, encodes each by itself, and joins the two id
sequences.  Joining is the associative operation of a monoid: only a window round
the seam is encoded again.  The window grows on both sides until it ends at a place
where the token sequence is proved not to depend on what lies beyond:

    a position p with ``text[p]`` a space or line feed and ``text[p-1]`` not white space.

Proof for ``public_tokenizers.PATTERN``: no alternative has white space after a
character that is not white space, so some match ends at p whatever follows; the only
look-ahead, ``\\s+(?!\\S)``, looks one character beyond a run of white space, and no run
reaches p from the left; there is no look-behind, so matching starts afresh at p.
Each match is merged by itself, hence ids(text) = ids(text[:p]) + ids(text[p:]).

Decoding concatenates the bytes of the halves up the same kind of tree.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from answerbank.llm.common import process_cache, text_or_empty

#: Texts (code points) and id sequences up to these lengths are leaves.
LEAF_CHARS = 4096
LEAF_IDS = 8192


#: The Unicode property White_Space, which is ``\\s`` in the pattern (fixed values).
WHITE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
#: Runs of white space for which the pattern's look-ahead is not run: the matcher's stack is bounded.
LONG_WHITE = re.compile(f"[{WHITE}]{{4000,}}")


def load_ranks(path: str) -> dict[bytes, int]:
    """Ranks of a vocabulary file: base64 token and rank on each line."""
    import base64

    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def load_encoding(vocabulary: str):
    """The leaf encoder for a vocabulary file of ``public_tokenizers`` (once per worker)."""

    def build():
        import public_tokenizers
        import tiktoken

        ranks = load_ranks(public_tokenizers.path(vocabulary))
        return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    return process_cache("encoding_" + vocabulary, build)


def settled_before(text: str, low: int, high: int) -> int | None:
    """The last settled position in (low, high), or None."""
    p = high
    while True:
        p = max(text.rfind(" ", low + 1, p), text.rfind("\n", low + 1, p))
        if p < 0:
            return None
        if not text[p - 1].isspace():
            return p


def settled_after(text: str, low: int, high: int) -> int | None:
    """The first settled position in (low, high), or None."""
    p = low
    while True:
        found = [q for q in (text.find(" ", p + 1, high), text.find("\n", p + 1, high)) if q >= 0]
        if not found:
            return None
        p = min(found)
        if not text[p - 1].isspace():
            return p


class MergeTree:
    """Encoder and decoder over ``encoding`` (needs ``encode_ordinary`` and ``decode_bytes``)."""

    def __init__(self, encoding, leaf_chars: int = LEAF_CHARS, leaf_ids: int = LEAF_IDS, window: int = 64):
        self.encoding, self.leaf_chars, self.leaf_ids, self.window = encoding, max(1, leaf_chars), max(1, leaf_ids), window

    def encode(self, text: str) -> np.ndarray:
        return self._encode(text, 0, len(text))

    def _leaf(self, text: str) -> np.ndarray:
        ids, done = [], 0
        for run in LONG_WHITE.finditer(text):
            # One match: the run, less its last character if anything follows.
            end = run.end() if run.end() == len(text) else run.end() - 1
            ids += self.encoding.encode_ordinary(text[done : run.start()])
            ids += self.encoding._encode_single_piece(text[run.start() : end])
            done = end
        ids += self.encoding.encode_ordinary(text[done:] if done else text)
        return np.array(ids, dtype="<u4")

    def _encode(self, text: str, low: int, high: int) -> np.ndarray:
        if high - low <= self.leaf_chars:
            return self._leaf(text[low:high])
        middle = (low + high) // 2
        return self._join(text, low, middle, high, self._encode(text, low, middle), self._encode(text, middle, high))

    def _join(self, text: str, low: int, middle: int, high: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        start, reach = None, self.window
        while start is None:
            edge = max(low, middle - reach)
            start = settled_before(text, edge, middle)
            start = low if start is None and edge == low else start
            reach *= 2
        end, reach = None, self.window
        while end is None:
            edge = min(high, middle + reach)
            end = settled_after(text, middle, edge)
            end = high if end is None and edge == high else end
            reach *= 2
        kept = self._without_tail(left, len(text[start:middle].encode()))
        rest = self._without_head(right, len(text[middle:end].encode()))
        return np.concatenate((kept, self._leaf(text[start:end]), rest))

    def _length(self, token: int) -> int:
        return len(self.encoding.decode_single_token_bytes(int(token)))

    def _without_tail(self, ids: np.ndarray, n_bytes: int) -> np.ndarray:
        k = len(ids)
        while n_bytes > 0:
            k -= 1
            n_bytes -= self._length(ids[k])
        assert n_bytes == 0, "a settled position lies between two tokens"
        return ids[:k]

    def _without_head(self, ids: np.ndarray, n_bytes: int) -> np.ndarray:
        k = 0
        while n_bytes > 0:
            n_bytes -= self._length(ids[k])
            k += 1
        assert n_bytes == 0, "a settled position lies between two tokens"
        return ids[k:]

    def decode(self, ids: np.ndarray) -> bytes:
        if len(ids) <= self.leaf_ids:
            return self.encoding.decode_bytes(ids.tolist())
        middle = len(ids) // 2
        return self.decode(ids[:middle]) + self.decode(ids[middle:])


def encode_column(
    df: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True
) -> DataFrame:
    """Encode and decode every text; one row per input row.

    Returns ``id_col``, ``ids`` (array<int>, only ``with_ids``), ``n_tokens``, ``ids_sha256`` (ids as
    little-endian unsigned 32-bit integers), ``decoded_sha256``.  A null or empty text has no
    ids; repeated rows and null ids are encoded like any other row; other columns of ``df``
    are not read, so their names cannot clash.
    """
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = MergeTree(load_encoding(vocabulary))
        for batch in batches:
            arrays: list[list] = [[], [], [], []]
            for text in batch.column(1):
                ids = tree.encode(text.as_py())
                if with_ids:
                    arrays[0].append(ids.astype(np.int32))
                arrays[1].append(len(ids))
                arrays[2].append(hashlib.sha256(ids.tobytes()).hexdigest())
                arrays[3].append(hashlib.sha256(tree.decode(ids)).hexdigest())
            out = {id_col: batch.column(0)}
            if with_ids:
                out["ids"] = pa.array(arrays[0], pa.list_(pa.int32()))
            out |= {"n_tokens": pa.array(arrays[1], pa.int64()), "ids_sha256": pa.array(arrays[2], pa.string())}
            yield pa.RecordBatch.from_pydict(out | {"decoded_sha256": pa.array(arrays[3], pa.string())})

    schema = f"`{id_col}` {kind}, " + ("ids array<int>, " if with_ids else "")
    return df.select(F.col(id_col), text_or_empty(text_col).alias("text")).mapInArrow(
        run, schema + "n_tokens long, ids_sha256 string, decoded_sha256 string"
    )


def roundtrip(spark, sf_dir: str) -> DataFrame:
    """Query op2: every whole text of documents through the tree and back."""
    from answerbank.llm.common import table

    return encode_column(table(spark, sf_dir, "documents"), "byte_bpe_multi_50k.tiktoken", with_ids=False)
