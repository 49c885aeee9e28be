"""Byte-level BPE encoding and decoding with a hierarchical-bitmap rank queue.

A pre-token's bytes form a linked list.  The positions whose pair of tokens has
merge rank r lie in bucket r, smallest position first.  A bitmap of two levels,
256 bits a word, says which buckets hold anything; finding the first set bit,
level by level, gives the lowest rank.  A merge changes its neighbours' pairs;
their former entries stay behind and are skipped when popped.  n bytes take
O(n log n), so a pre-token of a million letters is no special case.

Null texts count as empty: no tokens, the hash of no bytes.  Rows are handled one
by one; repeated rows and ids are all kept, other columns are not carried.  Of equal
ranks the leftmost pair is merged first.  An empty table gives an empty one; an id
column named like a new column gets a longer name.
"""

from __future__ import annotations

import base64
import functools
import hashlib
from heapq import heappop, heappush

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import free_name, parts_of
from .pieces import Remembered, split_at_spaces


_BIT = [1 << i for i in range(256)]


class ByteBpe:
    """A vocabulary of ranks; ``pattern`` cuts a text into pre-tokens."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.bytes_of = {rank: token for token, rank in self.ranks.items()}
        self.pattern = regex.compile(pattern)
        #: Bit r & 255 of word r >> 8: bucket r holds a position.  Empty between calls.
        self.low = [0] * ((max(self.ranks.values()) >> 8) + 1)
        self.pre_token = Remembered(self._digest_parts, 400_000)
        self.part = Remembered(self._digest_part, 300_000)

    def merge(self, piece: bytes) -> list[int]:
        """The ids of one pre-token."""
        ranks = self.ranks
        whole = ranks.get(piece)
        if whole is not None:
            return [whole]
        n, get, low, top = len(piece), ranks.get, self.low, 0
        buckets: dict[int, list[int]] = {}
        token = [piece[i : i + 1] for i in range(n)]
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        pair = [-1] * n
        for i in range(n - 1):
            pair[i] = rank = get(piece[i : i + 2], -1)
            if rank in buckets:
                buckets[rank].append(i)
            elif rank >= 0:
                buckets[rank] = [i]
                low[rank >> 8] |= _BIT[rank & 255]
                top |= _BIT[rank >> 8]
        while top:
            w = (top & -top).bit_length() - 1  # the first set bit, level by level
            word = low[w]
            rank = (w << 8) + (word & -word).bit_length() - 1
            bucket = buckets[rank]
            i = heappop(bucket)
            if not bucket:
                del buckets[rank]
                low[w] = word = word & (word - 1)
                if not word:
                    top &= top - 1
            if pair[i] != rank:
                continue  # stale
            j = after[i]
            token[i] = joined = token[i] + token[j]
            token[j], pair[j], pair[i] = b"", -1, -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                pair[i] = rank = get(joined + token[k], -1)
                if rank in buckets:
                    heappush(buckets[rank], i)
                elif rank >= 0:
                    buckets[rank] = [i]
                    low[rank >> 8] |= _BIT[rank & 255]
                    top |= _BIT[rank >> 8]
            h = before[i]
            if h >= 0:
                pair[h] = rank = get(token[h] + joined, -1)
                if rank in buckets:
                    heappush(buckets[rank], h)
                elif rank >= 0:
                    buckets[rank] = [h]
                    low[rank >> 8] |= _BIT[rank & 255]
                    top |= _BIT[rank >> 8]
        return [ranks[t] for t in token if t]

    def encode(self, text: str) -> list[int]:
        ids: list[int] = []
        for piece in self.pattern.findall(text):
            ids += self.merge(piece.encode())
        return ids

    def decode(self, ids) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))

    def _digest_parts(self, piece: str) -> tuple[str, bytes]:
        ids = self.merge(piece.encode())
        return " ".join(map(str, ids)), self.decode(ids)

    def _digest_part(self, part: str) -> tuple[str, bytes]:
        """Decimal ids and decoded bytes of a part that has lost its leading space."""
        found = [self.pre_token(p) for p in self.pattern.findall(" " + part)]
        return " ".join([f[0] for f in found]), b"".join([f[1] for f in found])

    def round_trip(self, text: str) -> tuple[str, bytes]:
        """All ids in decimal, joined by a space, and the bytes they decode to."""
        first, *rest = split_at_spaces(text)
        found = [self.pre_token(p) for p in self.pattern.findall(first)]
        found += self.part.all(rest)
        return " ".join([f[0] for f in found]), b"".join([f[1] for f in found])


@functools.cache
def _bpe(path: str, pattern: str) -> ByteBpe:
    return ByteBpe(path, pattern)


def encode_documents(df: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids array<int>) of each text."""
    kind = dict(df.dtypes)[id_col]

    def run(batches):
        bpe = _bpe(path, pattern)
        for batch in parts_of(batches, 1):
            ids = [bpe.encode(t or "") for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], ["id", "ids"])

    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, f"id {kind}, ids array<int>").withColumnRenamed("id", free_name(["ids"], id_col))


def decode_documents(df: DataFrame, path: str, pattern: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id, bytes binary) of each row's ids."""
    kind = dict(df.dtypes)[id_col]

    def run(batches):
        bpe = _bpe(path, pattern)
        for batch in batches:
            found = [bpe.decode(ids or ()) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.binary())], ["id", "bytes"])

    rows = df.select(F.col(id_col).alias("id"), F.col(ids_col).alias("ids"))
    return rows.mapInArrow(run, f"id {kind}, bytes binary").withColumnRenamed("id", free_name(["bytes"], id_col))


def round_trip_digests(df: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256): the ids of each text, and the bytes decoded from them."""
    kind = dict(df.dtypes)[id_col]

    def run(batches):
        bpe = _bpe(path, pattern)
        for batch in parts_of(batches, 1):
            counts, ids, decoded = [], [], []
            for text in batch.column(1).to_pylist():
                decimal, back = bpe.round_trip(text or "")
                counts.append(decimal.count(" ") + 1 if decimal else 0)
                ids.append(hashlib.sha256(decimal.encode()).hexdigest())
                decoded.append(hashlib.sha256(back).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(ids), pa.array(decoded)], ["id", "n_tokens", "ids_sha256", "decoded_sha256"])

    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, f"id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string").withColumnRenamed("id", free_name(["n_tokens", "ids_sha256", "decoded_sha256"], id_col))
