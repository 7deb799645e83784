"""Encoding of text by a public byte-level BPE vocabulary.

Pre-tokens are merged with a rank queue: a bucket per merge rank holds the places of the pairs with that rank, a
hierarchical bitmap of the non-empty buckets gives the lowest rank by finding the first set bit of three words, tokens
are a linked list over the bytes, and an entry whose pair has changed since is skipped when it comes up. A pre-token
of n bytes takes O(n log n) steps at most, so a pre-token of a whole document is no special case. Pre-tokens that a
worker has met before come from its memory.
"""

from __future__ import annotations

import base64
import hashlib
from array import array
from collections.abc import Iterator
from functools import partial
from itertools import repeat
from pathlib import Path

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from quernel.functions.arrow import text_parts
from quernel.plans.shape import spread

#: Fixed value: the published pattern by which the rank files' tokenizers split text before merging.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: Pre-tokens that a worker remembers, and the characters of the longest: for speed only.
REMEMBERED, REMEMBERED_CHARS = 250_000, 48

#: Length from which a pre-token's lists are packed: an object for each number would take several times the room.
PACKED_BYTES = 4096

#: Text of the rows that are encoded before their ids are handed on.
PART_BYTES = 8 << 20

_WORD = 64


class RankQueue:
    """Places by rank, lowest rank first. Ranks are below 64**3."""

    def __init__(self) -> None:
        self.low: dict[int, int] = {}
        self.mid: dict[int, int] = {}
        self.top = 0
        self.buckets: dict[int, list[int]] = {}

    def push(self, rank: int, place: int) -> None:
        bucket = self.buckets.get(rank)
        if bucket is not None:
            bucket.append(place)
            return
        self.buckets[rank] = [place]
        a, b = rank >> 6, rank >> 12
        self.low[a] = self.low.get(a, 0) | 1 << (rank & 63)
        self.mid[b] = self.mid.get(b, 0) | 1 << (a & 63)
        self.top |= 1 << b

    def pop(self) -> tuple[int, list[int]]:
        """The lowest rank and the places in its bucket, which is emptied."""
        b = (self.top & -self.top).bit_length() - 1
        w = self.mid[b]
        a = b << 6 | (w & -w).bit_length() - 1
        v = self.low[a]
        bit = v & -v
        rank = a << 6 | bit.bit_length() - 1
        self.low[a] = v ^ bit
        if v == bit:
            self.mid[b] = w = w ^ 1 << (a & 63)
            if not w:
                self.top ^= 1 << b
        return rank, self.buckets.pop(rank)


class _Memory(dict):
    def __init__(self, encode) -> None:
        super().__init__()
        self.encode = encode

    def __missing__(self, piece: str) -> bytes:
        ids = self.encode(piece.encode("utf-8", "surrogatepass"))
        if len(piece) <= REMEMBERED_CHARS:
            if len(self) >= REMEMBERED:
                self.clear()
            self[piece] = ids
        return ids


class Encoder:
    """Encodes text by a rank file: lines of a base64 token and its rank, which is its id."""

    def __init__(self, rank_file: bytes, pattern: str = PATTERN):
        self.ranks = {base64.b64decode(t): int(r) for t, r in (line.split() for line in rank_file.splitlines() if line)}
        if max(self.ranks.values()) >= _WORD**3:
            raise ValueError("ranks must be below 262,144")
        self.find = regex.compile(pattern).findall
        self.pieces = _Memory(self.merge)

    def merge(self, piece: bytes) -> bytes:
        """The ids of one pre-token as 32-bit integers."""
        ranks = self.ranks
        whole = ranks.get(piece)
        if whole is not None:
            return whole.to_bytes(4, "little")
        n = len(piece)
        tokens: list[bytes | None] = [piece[i : i + 1] for i in range(n)]
        ints = list if n < PACKED_BYTES else partial(array, "i")
        after, before, rank_at = ints(range(1, n + 1)), ints(range(-1, n - 1)), ints(repeat(-1, n))
        queue = RankQueue()
        for i in range(n - 1):
            r = ranks.get(piece[i : i + 2])
            if r is not None:
                rank_at[i] = r
                queue.push(r, i)
        while queue.top:
            rank, places = queue.pop()
            places.sort()
            for done, i in enumerate(places):
                if rank_at[i] != rank:
                    continue  # stale: one of the pair is merged already
                j = after[i]
                k = after[j]
                token = tokens[i] = tokens[i] + tokens[j]
                tokens[j] = None
                rank_at[j] = rank_at[i] = -1
                after[i] = k
                lower = False
                if k < n:
                    before[k] = i
                    r = ranks.get(token + tokens[k])
                    if r is not None:
                        rank_at[i] = r
                        queue.push(r, i)
                        lower = r < rank
                h = before[i]
                if h >= 0:
                    r = ranks.get(tokens[h] + token)
                    rank_at[h] = -1 if r is None else r
                    if r is not None:
                        queue.push(r, h)
                        lower = lower or r < rank
                if lower:  # its turn comes before the rest of this bucket
                    for place in places[done + 1 :]:
                        queue.push(rank, place)
                    break
        return b"".join([ranks[t].to_bytes(4, "little") for t in tokens if t is not None])

    def encode(self, text: str) -> bytes:
        """The ids of ``text`` as 32-bit integers; text that looks like a special token is ordinary text."""
        return b"".join(map(self.pieces.__getitem__, self.find(text)))


_encoders: dict[str, Encoder] = {}


def _encoder(rank_file: bytes, digest: str) -> Encoder:
    """One encoder per vocabulary in each worker, which lives on between tasks."""
    if digest not in _encoders:
        _encoders[digest] = Encoder(rank_file)
    return _encoders[digest]


def _mapped(df: DataFrame, id_columns: list[str], text: str, rank_path: str, out: T.StructField, values) -> DataFrame:
    rank_file = Path(rank_path).read_bytes()  # of fixed size: the vocabulary
    digest = hashlib.sha256(rank_file).hexdigest()
    shared = df.sparkSession.sparkContext.broadcast(rank_file)
    schema = T.StructType([*(df.schema[c] for c in id_columns), out])
    arrow_schema = to_arrow_schema(schema)

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoder(shared.value, digest).encode
        for batch in batches:
            # Rows of any length: what is held at once is the text of some rows, never cut.
            for part in text_parts(batch, len(id_columns), PART_BYTES):
                ids = [b"" if t is None else encode(t) for t in part.column(len(id_columns)).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns[: len(id_columns)], values(ids)], schema=arrow_schema)

    return spread(df.select(*id_columns, F.col(text).alias("_text"))).mapInArrow(encoded, schema)


def _ids(encoded: list[bytes]) -> pa.ListArray:
    offsets = np.zeros(len(encoded) + 1, np.int32)
    np.cumsum([len(x) // 4 for x in encoded], out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(encoded), "<i4")))


def encode_column(df: DataFrame, id_columns: list[str], text: str, rank_path: str) -> DataFrame:
    """``id_columns`` and ids (array of int) of each row; the list is empty for empty and NULL text.

    One pass without a shuffle. ``rank_path`` is read on the driver and sent to the workers. Other columns of ``df``
    are not read. Rows come out as often as they go in.
    """
    return _mapped(df, id_columns, text, rank_path, T.StructField("ids", T.ArrayType(T.IntegerType(), False)), _ids)


def count_tokens(df: DataFrame, id_columns: list[str], text: str, rank_path: str) -> DataFrame:
    """``id_columns`` and n_tokens (0 for empty and NULL text)."""
    return _mapped(df, id_columns, text, rank_path, T.StructField("n_tokens", T.LongType(), False), lambda ids: pa.array([len(x) // 4 for x in ids], pa.int64()))
