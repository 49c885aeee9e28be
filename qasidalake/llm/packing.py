"""Packing token sequences into windows by Karmarkar-Karp multiway differencing.

Each document's ids, closed by an end id, are cut into full windows and a tail.
Full windows stand alone.  Tails gather, whole, in groups for ``WINDOWS`` windows
less ``SPARE`` ids each.  In a group every tail starts as a partial
partition of its own (one part holding it, the others empty); the two partial
partitions of the largest spread are merged, the fullest part of one with the
emptiest of the other, until one partition remains: windows of nearly equal fill.
If its fullest exceeds the capacity, the group is dealt again into more windows.
What then is missing in a window is cut off the tails that follow, so about one
piece a window is not a whole tail; less than ``LEAST`` ids are left as padding
rather than filled with a fragment.  What remains at the end of a task fills
sequences whose lengths are powers of two, which need no padding.

Grouping is within a task's rows, as they stream by, so nothing is shuffled, a
group's size is fixed, and a lost task repeats the same sequences.  Null and empty
texts give the end id alone; very long texts are mostly full windows; repeated rows and
ids are packed like any others; of equal tails the earlier row's is merged first.  An
empty table gives no pieces.  An id column named like a new column gets a longer name,
other columns are not kept.
"""

from __future__ import annotations

import base64
import functools
import heapq
import json
import re
import zlib
from collections import deque
from pathlib import Path

import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import free_name, parts_of
from .pieces import Remembered, split_at_spaces

CAPACITY, END_ID = 1024, 0
#: Windows of a group, ids left free in each of them at first, gaps that are not filled.
WINDOWS, SPARE, LEAST = 32, 32, 8


def largest_differencing(sizes: list[int], parts: int) -> list[list[int]]:
    """The items' positions in ``parts`` sets of nearly equal sums."""
    heap = []
    for i, size in enumerate(sizes):
        # parts in descending order of their sums
        sums, sets = [size] + [0] * (parts - 1), [(i,)] + [()] * (parts - 1)
        heap.append((-size, i, sums, sets))
    if not heap:
        return [[] for _ in range(parts)]
    heapq.heapify(heap)
    serial = len(sizes)
    while len(heap) > 1:
        _, _, a_sums, a_sets = heapq.heappop(heap)
        _, _, b_sums, b_sets = heapq.heappop(heap)
        merged = [(x + y, (s, t)) for x, y, s, t in zip(a_sums, reversed(b_sums), a_sets, reversed(b_sets))]
        merged.sort(key=lambda m: -m[0])
        sums, sets = [m[0] for m in merged], [s if not t else t if not s else (s, t) for _, (s, t) in merged]
        heapq.heappush(heap, (sums[-1] - sums[0], serial, sums, sets))
        serial += 1
    return [list(_leaves(s)) for s in heap[0][3]]


def _leaves(tree):
    """The item positions in nested tuples, without recursion."""
    stack = [tree]
    while stack:
        x = stack.pop()
        if isinstance(x, tuple):
            stack.extend(x)
        else:
            yield x


def windows_of(sizes: list[int], capacity: int = CAPACITY) -> list[list[int]]:
    """Windows of at most ``capacity``; their number rises whenever one exceeds it, by what the excess would fill."""
    parts = max(1, -(-sum(sizes) // capacity))
    while True:
        found = largest_differencing(sizes, parts)
        excess = sum(max(0, sum(sizes[i] for i in w) - capacity) for w in found)
        if not excess:
            return [w for w in found if w]
        parts += -(-excess // capacity)


class Packer:
    """Takes (doc_id, ids as little-endian uint32 bytes) and gives finished pieces.

    A piece: (doc_id, start, length, crc32, doc_tokens, sequence, offset).
    """

    def __init__(self, first_sequence: int, capacity: int = CAPACITY):
        self.sequence, self.capacity = first_sequence, capacity
        self.tails: deque[tuple] = deque()  # (doc_id, start, bytes, doc_tokens)
        self.held = 0

    def add(self, doc_id, data: bytes):
        total, full = len(data) // 4, len(data) // 4 // self.capacity * self.capacity
        for start in range(0, full, self.capacity):
            yield from self._emit([(doc_id, start, data[4 * start : 4 * (start + self.capacity)], total)])
        if full < total:
            self.tails.append((doc_id, full, data[4 * full :], total))
            self.held += total - full
        # half as many again wait behind a group, to fill its gaps
        while self.held >= WINDOWS * self.capacity * 3 // 2:
            pieces, windows = self._dealt(WINDOWS)
            yield from self._filled(pieces, windows)

    def finish(self):
        parts = self.held // self.capacity
        while parts > 1:
            pieces, windows = self._dealt(min(parts, WINDOWS))
            if sum(len(p[2]) // 4 for p in pieces) + self.held >= len(windows) * self.capacity:
                yield from self._filled(pieces, windows)
                parts = self.held // self.capacity
            else:  # too little is left to fill so many windows
                self.tails.extendleft(reversed(pieces))
                self.held += sum(len(p[2]) // 4 for p in pieces)
                parts = min(parts, WINDOWS) * 3 // 4
        while self.held:
            size = 1 << (self.held.bit_length() - 1)
            yield from self._emit(self._take(min(size, self.capacity)))

    def _take(self, size: int) -> list[tuple]:
        """Tails of exactly ``size`` ids, or all that are left; the last of them is cut where it exceeds that."""
        taken, left = [], min(size, self.held)
        self.held -= left
        while left:
            doc_id, start, data, total = self.tails.popleft()
            n = len(data) // 4
            if n > left:
                self.tails.appendleft((doc_id, start + left, data[4 * left :], total))
                data, n = data[: 4 * left], left
            taken.append((doc_id, start, data, total))
            left -= n
        return taken

    def _dealt(self, parts: int) -> tuple[list[tuple], list[list[int]]]:
        pieces = self._take(parts * (self.capacity - SPARE))
        return pieces, windows_of([len(p[2]) // 4 for p in pieces], self.capacity)

    def _filled(self, pieces: list[tuple], windows: list[list[int]]):
        for window in windows:
            own = [pieces[i] for i in sorted(window)]
            gap = self.capacity - sum(len(p[2]) // 4 for p in own)
            yield from self._emit(own + self._take(gap if gap >= LEAST else 0))

    def _emit(self, pieces: list[tuple]):
        offset = 0
        for doc_id, start, data, total in pieces:
            yield doc_id, start, len(data) // 4, zlib.crc32(data), total, self.sequence, offset
            offset += len(data) // 4
        self.sequence += 1


def added_tokens(path: str) -> tuple[tuple[str, int], ...]:
    """(token, id) of the tokens added in the tokenizer file beside a rank file; none without such a file."""
    file = Path(path).with_suffix(".json")
    if not file.exists():
        return ()
    found = json.loads(file.read_text(encoding="utf-8")).get("added_tokens") or []
    if any(t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"] for t in found):
        raise ValueError(f"{file}: added tokens that are not matched as they stand")
    return tuple((t["content"], t["id"]) for t in found)


class Ids:
    """The ids of texts as little-endian uint32 bytes.

    ``path`` is a rank file; the tokenizer file of the same vocabulary gives the
    same ids (a test compares them).  Texts are cut at its ``added`` tokens, the
    longest first, which give their own ids.
    """

    def __init__(self, path: str, pattern: str, added: tuple[tuple[str, int], ...] = ()):
        self.added = {token: i.to_bytes(4, "little") for token, i in added}
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")") if added else None
        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.encoding = tiktoken.Encoding("public", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.part = Remembered(lambda part: self._encode(" " + part))

    def _encode(self, text: str) -> bytes:
        ids = self.encoding.encode_ordinary(text)
        return b"".join([i.to_bytes(4, "little") for i in ids])

    def __call__(self, text: str) -> bytes:
        if not any(token in text for token in self.added):
            return self._between(text)
        parts = self.cut.split(text)  # texts and, at odd places, added tokens
        return b"".join([self.added[x] if k % 2 else self._between(x) for k, x in enumerate(parts)])

    def _between(self, text: str) -> bytes:
        first, *rest = split_at_spaces(text)
        return self._encode(first) + b"".join(self.part.all(rest))


@functools.cache
def _ids(path: str, pattern: str, added: tuple[tuple[str, int], ...]) -> Ids:
    return Ids(path, pattern, added)


_RESULT = [("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())]


def pack_documents(df: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    kind, added = dict(df.dtypes)[id_col], added_tokens(path)

    def run(batches):
        ids, packer, id_type = _ids(path, pattern, added), Packer(TaskContext.get().partitionId() << 40), None
        end = END_ID.to_bytes(4, "little")

        def rows_of(found):
            columns = [pa.array([r[0] for r in found], id_type), *(pa.array([r[i + 1] for r in found], t) for i, (_, t) in enumerate(_RESULT))]
            return pa.RecordBatch.from_arrays(columns, ["id", *(n for n, _ in _RESULT)])

        for batch in parts_of(batches, 1):
            id_type, found = batch.schema.field(0).type, []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found.extend(packer.add(doc_id, ids(text or "") + end))
                if len(found) >= 20_000:
                    yield rows_of(found)
                    found = []
            yield rows_of(found)
        if id_type is not None:
            yield rows_of(list(packer.finish()))

    result = "start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, f"id {kind}, {result}").withColumnRenamed("id", free_name([n for n, _ in _RESULT], id_col))
