"""Encoding of whole texts with a public byte-level BPE vocabulary.

A text is split by the vocabulary's pattern; each piece starts as bytes and merges neighbours until none can merge. The ranks of
adjacent pairs are the leaves of a segment tree of minima: its root names the lowest rank, a descent to the left finds the
leftmost pair of that rank, and a merge changes three leaves, each in logarithmic time. Long pieces thus cost n log n.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

TOKENIZERS = os.environ.get("PUBLIC_TOKENIZERS", "/opt/tokenizers")

#: Fixed value: the pattern that splits texts before the merges of the rank files.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

_NEVER = 1 << 60


def load_ranks(data: bytes) -> dict[bytes, int]:
    """Token bytes to rank, from the lines of a rank file."""
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, data.splitlines()) if a}


def merge_piece(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The ids of a piece: merge the leftmost pair of lowest rank until no pair can merge."""
    n = len(piece)
    if n < 2:
        return [ranks[piece]] if n else []
    parts: list[bytes | None] = [piece[i : i + 1] for i in range(n)]
    get = ranks.get
    size = 1 << (n - 1).bit_length()
    tree = [_NEVER] * (2 * size)
    for i in range(n - 1):
        tree[size + i] = get(piece[i : i + 2], _NEVER)
    for k in range(size - 1, 0, -1):
        a, b = tree[2 * k], tree[2 * k + 1]
        tree[k] = a if a <= b else b
    after = list(range(1, n + 1))  # the next part's place, n for none
    before = list(range(-1, n - 1))

    def put(i: int, rank: int) -> None:
        k = size + i
        tree[k] = rank
        k >>= 1
        while k:
            a, b = tree[2 * k], tree[2 * k + 1]
            low = a if a <= b else b
            if tree[k] == low:
                break
            tree[k] = low
            k >>= 1

    while tree[1] < _NEVER:
        low, k = tree[1], 1
        while k < size:
            k = 2 * k if tree[2 * k] == low else 2 * k + 1
        i = k - size
        j = after[i]
        joined = parts[i] + parts[j]
        parts[i], parts[j] = joined, None
        nxt = after[j]
        after[i] = nxt
        put(j, _NEVER)
        if nxt < n:
            before[nxt] = i
            put(i, get(joined + parts[nxt], _NEVER))
        else:
            put(i, _NEVER)
        if before[i] >= 0:
            put(before[i], get(parts[before[i]] + joined, _NEVER))
    return [ranks[p] for p in parts if p is not None]


def make_encoder(data: bytes, kept: int = 100_000) -> Callable[[str | None], list[int]]:
    """A function from text to ids; null and empty texts give the empty list. `kept` short pieces are remembered at most."""
    import regex

    ranks, pieces, known = load_ranks(data), regex.compile(PATTERN), {}

    def encode(text: str | None) -> list[int]:
        out: list[int] = []
        if not text:
            return out
        for piece in pieces.findall(text):
            ids = known.get(piece)
            if ids is None:
                ids = merge_piece(piece.encode("utf-8"), ranks)
                if len(piece) <= 64:
                    if len(known) >= kept:
                        known.clear()
                    known[piece] = ids
            out += ids
        return out

    return encode


@lru_cache(maxsize=4)
def _encoder(data: bytes) -> Callable[[str | None], list[int]]:
    return make_encoder(data)  # one for each Python worker and vocabulary


def _vocabulary(spark: SparkSession, name: str, folder: str):
    """The rank file, about 1 MB, sent once to each executor."""
    with open(os.path.join(folder, f"{name}.tiktoken"), "rb") as f:
        return spark.sparkContext.broadcast(f.read())


def token_ids(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", name: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> DataFrame:
    """(id_col, ids): the token ids of each whole text, without special tokens; the empty list for null and empty texts.

    One row for each row of docs, repeated ids included; other columns are ignored. Special tokens' strings in a text are
    ordinary text.
    """
    shared = _vocabulary(docs.sparkSession, name, folder)
    kind = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[dict(docs.dtypes)[id_col]]
    schema = pa.schema([(id_col, kind), ("ids", pa.list_(pa.int32()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoder(shared.value)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([encode(t) for t in b.column(1).to_pylist()], pa.list_(pa.int32()))], schema=schema)

    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {dict(docs.dtypes)[id_col]}, ids array<int>")


def token_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", name: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> DataFrame:
    """(id_col, n_tokens): the number of ids of each text; the ids don't leave the worker."""
    shared = _vocabulary(docs.sparkSession, name, folder)
    kind = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[dict(docs.dtypes)[id_col]]
    schema = pa.schema([(id_col, kind), ("n_tokens", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoder(shared.value)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(encode(t)) for t in b.column(1).to_pylist()], pa.int32())], schema=schema)

    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {dict(docs.dtypes)[id_col]}, n_tokens int")
