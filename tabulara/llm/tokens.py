"""Token ids of a public byte-level BPE vocabulary for a whole corpus.

A text is cut into pieces by the vocabulary's pattern; a piece is merged by a segment tree over the ranks of its adjacent pairs: the root holds the lowest rank and, among equals, the leftmost place;
a merge changes three leaves, each in logarithmic time, until no pair of the piece is in the vocabulary. Pieces repeat, so every Python worker keeps the ids of the pieces it has seen.

The vocabulary is a rank file (base64 token, rank) read once by the driver and broadcast: its size is that of the public file, whatever the corpus.

Nulls and edge cases: null and empty texts have an empty list; white space is text; names of special tokens are ordinary text; texts of any length are encoded whole (a piece of n bytes costs n log n);
repeated rows and repeated doc_ids give a row each; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
from array import array
from collections.abc import Callable, Iterator
from itertools import chain

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from tabulara.session import ship_code

TOKENIZER_DIR = "/opt/tokenizers"
VOCABULARY = "byte_bpe_50k.tiktoken"
#: How the vocabulary cuts a text into pieces; White_Space as Unicode has it (Python's \s holds four control characters more).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
#: A worker forgets its pieces when it has seen so many; no result depends on it.
CACHE_PIECES = 1 << 19
_NONE = 1 << 62


def read_ranks(data: bytes) -> dict[bytes, int]:
    return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, data.splitlines()) if token}


def encode_piece(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one piece. Leaf i of the tree stands for the pair that begins at byte i: its rank and i in one number, so the minimum is the leftmost lowest."""
    n = len(piece)
    if n == 1:
        return [ranks[piece]]
    size = 1 << (n - 2).bit_length() if n > 2 else 1
    tree = [_NONE] * (2 * size)
    get = ranks.get
    for i in range(n - 1):
        rank = get(piece[i : i + 2])
        if rank is not None:
            tree[size + i] = rank << 32 | i
    for p in range(size - 1, 0, -1):
        a, b = tree[2 * p], tree[2 * p + 1]
        tree[p] = a if a < b else b
    end = list(range(1, n + 1))  # of the part that begins at i
    before = list(range(-1, n - 1))  # where the part before it begins

    def put(leaf: int, value: int) -> None:
        p = size + leaf
        tree[p] = value
        while p > 1:
            a, b = tree[p], tree[p ^ 1]
            p >>= 1
            value = a if a < b else b
            if tree[p] == value:
                return
            tree[p] = value

    def pair(i: int) -> int:
        j = end[i]
        rank = get(piece[i : end[j]]) if j < n else None
        return _NONE if rank is None else rank << 32 | i

    while tree[1] != _NONE:
        i = tree[1] & 0xFFFFFFFF
        j = end[i]
        end[i] = end[j]
        if end[i] < n:
            before[end[i]] = i
        put(i, pair(i))
        if j < n - 1:
            put(j, _NONE)
        if before[i] >= 0:
            put(before[i], pair(before[i]))
    ids, i = [], 0
    while i < n:
        ids.append(ranks[piece[i : end[i]]])
        i = end[i]
    return ids


class Pieces(dict):
    """Ids of the pieces seen, made when first asked for."""

    def __init__(self, ranks: dict[bytes, int]):
        super().__init__()
        self.ranks = ranks

    def __missing__(self, piece: str) -> list[int]:
        if len(self) >= CACHE_PIECES:
            self.clear()
        ids = self[piece] = encode_piece(piece.encode("utf-8", "replace"), self.ranks)
        return ids


class PieceCounts(Pieces):
    """Numbers of ids of the pieces seen."""

    def __missing__(self, piece: str) -> int:
        if len(self) >= CACHE_PIECES:
            self.clear()
        n = self[piece] = len(encode_piece(piece.encode("utf-8", "replace"), self.ranks))
        return n


_kept: dict[tuple, Pieces] = {}
_find = regex.compile(PATTERN).findall


def _pieces(kind: type[Pieces], data: bytes) -> Pieces:
    """Those this worker has for the vocabulary, or new ones."""
    key = hash(data)
    if (kind, key) not in _kept:
        _kept[kind, key] = kind(read_ranks(data))
    return _kept[kind, key]


def encode_text(text: str | None, pieces: Pieces) -> list[int]:
    return list(chain.from_iterable(map(pieces.__getitem__, _find(text or ""))))


def _over_texts(documents: DataFrame, vocabulary: str, schema: str, kind: type[Pieces], column: Callable) -> DataFrame:
    ship_code(documents.sparkSession)
    with open(vocabulary, "rb") as f:
        shared = documents.sparkSession.sparkContext.broadcast(f.read())

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = _pieces(kind, shared.value)
        for batch in batches:
            texts = batch.column(1)
            yield pa.RecordBatch.from_arrays([batch.column(0), column((t.as_py() for t in texts), len(texts), pieces)], names=["doc_id", "x"])

    return documents.select("doc_id", "text").mapInArrow(rows, f"doc_id bigint, x {schema}")


def _id_lists(texts: Iterator[str | None], n: int, pieces: Pieces) -> pa.Array:
    flat, offsets, get = array("i"), array("i", [0]), pieces.__getitem__
    for text in texts:
        if text:
            flat.extend(chain.from_iterable(map(get, _find(text))))
        offsets.append(len(flat))
    return pa.ListArray.from_arrays(pa.Array.from_buffers(pa.int32(), n + 1, [None, pa.py_buffer(offsets)]), pa.Array.from_buffers(pa.int32(), len(flat), [None, pa.py_buffer(flat)]))


def _id_counts(texts: Iterator[str | None], n: int, pieces: Pieces) -> pa.Array:
    get = pieces.__getitem__
    return pa.array([sum(map(get, _find(text))) if text else 0 for text in texts], pa.int64())


def token_ids(documents: DataFrame, vocabulary: str = f"{TOKENIZER_DIR}/{VOCABULARY}") -> DataFrame:
    """(doc_id, ids array<int>) of every row."""
    return _over_texts(documents, vocabulary, "array<int>", Pieces, _id_lists).withColumnRenamed("x", "ids")


def token_counts(documents: DataFrame, vocabulary: str = f"{TOKENIZER_DIR}/{VOCABULARY}") -> DataFrame:
    """(doc_id, n_tokens bigint) of every row; null and empty texts have 0."""
    return _over_texts(documents, vocabulary, "bigint", PieceCounts, _id_counts).withColumnRenamed("x", "n_tokens")


def decoded_hashes(encoded: DataFrame, vocabulary: str = f"{TOKENIZER_DIR}/{VOCABULARY}") -> DataFrame:
    """(doc_id, n_ids, sha256 of the bytes that the ids stand for) of rows (doc_id, ids): the way back, to prove an encoding."""
    ship_code(encoded.sparkSession)
    with open(vocabulary, "rb") as f:
        shared = encoded.sparkSession.sparkContext.broadcast(f.read())

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = {i: token for token, i in read_ranks(shared.value).items()}
        for batch in batches:
            ids = [x.as_py() for x in batch.column(1)]
            sha = [hashlib.sha256(b"".join(map(parts.__getitem__, x))).hexdigest() for x in ids]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(map(len, ids), pa.int64()), pa.array(sha, pa.string())], names=["doc_id", "n_ids", "sha256"])

    return encoded.select("doc_id", "ids").mapInArrow(rows, "doc_id bigint, n_ids bigint, sha256 string")
