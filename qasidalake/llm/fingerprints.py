"""Document fingerprints: a quartile bucket digest.

Byte triplets drawn from a sliding window of five bytes are hashed into 256
buckets and counted.  The digest holds the text's length on a log scale, the
ratios of the bucket quartiles, and for each bucket the quartile (0 to 3) its
count falls in.  Two digests are compared by a bounded difference score, which
``likeness`` maps to 1 (equal) down to 0.

Nulls count as empty texts; the empty text has a digest of its own, and texts
under five bytes are padded with zero bytes.  Equal texts have equal digests.
Rows with equal or null ids are all kept, texts of any length are read whole.  An
empty table gives an empty one; a lone row is its own next.  An id column named like a
new column gets a longer name, other columns are not kept.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import free_name, parts_of, shuffle_partitions, written

BUCKETS = 256
#: Offsets in the window, a triplet each.
TRIPLETS = ((0, 1, 2), (0, 1, 3), (0, 1, 4), (0, 2, 3), (0, 2, 4), (0, 3, 4))
#: A step of the length code, of a ratio code, and the most that either adds.
LENGTH_WEIGHT, RATIO_WEIGHT, HEADER_MOST = 6, 2, 60
#: A difference of this much, or more, has likeness 0.
BOUND = 400


def _tables() -> np.ndarray:
    rng = np.random.RandomState(20240607)
    return np.array([[rng.permutation(256) for _ in range(3)] for _ in TRIPLETS], dtype=np.uint8)


_T = _tables()
#: Distance of two quartile codes: one step 1, two steps 2, opposite ends 6.
_STEP = np.array([0, 1, 2, 6], dtype=np.int64)


def bucket_counts(data: bytes, block: int = 1 << 20) -> np.ndarray:
    """Counts of the hashed triplets of every window of five bytes, in blocks of bounded memory."""
    if len(data) < 5:
        data = data + b"\0" * (5 - len(data))
    raw, counts = np.frombuffer(data, dtype=np.uint8), np.zeros(BUCKETS, dtype=np.int64)
    for lo in range(0, len(raw) - 4, block):
        part = raw[lo : lo + block + 4]
        n = len(part) - 4
        for tables, (a, b, c) in zip(_T, TRIPLETS):
            h = tables[0][part[a : a + n]]
            h ^= tables[1][part[b : b + n]]
            h += tables[2][part[c : c + n]]
            counts += np.bincount(h, minlength=BUCKETS)
    return counts


def digest(data: bytes) -> str:
    """The fingerprint of a text's bytes: two hex digits of length, two of ratios, 128 of quartile codes."""
    if not data:
        return "0000" + "0" * (BUCKETS // 2)
    counts = bucket_counts(data)
    q1, q2, q3 = np.partition(counts, (63, 127, 191))[[63, 127, 191]]
    codes = (counts > q1).astype(np.uint8) + (counts > q2) + (counts > q3)
    packed = (codes[0::4] << 6) | (codes[1::4] << 4) | (codes[2::4] << 2) | codes[3::4]
    length = min(255, 1 + int(math.log(len(data)) / math.log(1.2)))
    ratios = (int(q1 * 15 // q3) << 4 | int(q2 * 15 // q3)) if q3 else 0
    return f"{length:02x}{ratios:02x}" + packed.astype(np.uint8).tobytes().hex()


def _codes(fingerprint: str) -> np.ndarray:
    packed = np.frombuffer(bytes.fromhex(fingerprint[4:]), dtype=np.uint8)
    return ((packed[:, None] >> np.array([6, 4, 2, 0], dtype=np.uint8)) & 3).reshape(-1).astype(np.int64)


def difference(a: str, b: str) -> int:
    """0 for equal digests, at most ``BOUND``."""
    if a == b:
        return 0
    body = int(_STEP[np.abs(_codes(a) - _codes(b))].sum())
    length = abs(int(a[:2], 16) - int(b[:2], 16)) * LENGTH_WEIGHT
    ratios = sum(abs(int(x, 16) - int(y, 16)) for x, y in zip(a[2:4], b[2:4])) * RATIO_WEIGHT
    return min(BOUND, body + min(HEADER_MOST, length) + min(HEADER_MOST, ratios))


def likeness(a: str, b: str) -> float:
    return 1.0 - difference(a, b) / BOUND


def document_fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fingerprint) of each row; other columns are not carried."""
    kind = dict(df.dtypes)[id_col]

    def run(batches):
        for batch in parts_of(batches, 1):
            prints = [digest((t or "").encode()) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints, pa.string())], ["id", "fingerprint"])

    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, f"id {kind}, fingerprint string").withColumnRenamed("id", free_name(["fingerprint"], id_col))


_RESULT = [("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())]


def _compared(text: str, own: str, after: str, after_print: str) -> tuple:
    k = len(text) // 2
    edited = (text[: len(text) - k] + after[:k]).encode()
    changed = digest(edited)
    return len(text), hashlib.sha256(edited).hexdigest(), own, changed, likeness(own, changed), likeness(own, after_print)


def neighbour_fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each row's fingerprint beside that of its edited text and of the next row by ascending id.

    The edited text is the text whose last floor(n/2) code points are replaced
    by the first as many of the next text; after the last row comes the first.
    Rows of one id follow each other by their text's hash, a null id comes first.

    The rows are dealt out once by ranges of the id and sorted there, so the next
    row is the next in the same task.  A task hands on the first and last text of
    its range; those pairs, one a range, are compared in a second, short job.
    """
    kind, part, head, tail = dict(df.dtypes)[id_col], "part", "head", "tail"
    names = ["id", *(n for n, _ in _RESULT), part, head, tail]

    def run(batches):
        first = last = None  # (id, text, fingerprint)
        for batch in parts_of(batches, 1):
            found, ids = [], []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                row = (key, text, digest(text.encode()))
                if last is None:
                    first = row
                else:
                    ids.append(last[0])
                    found.append(_compared(last[1], last[2], text, row[2]))
                last = row
            yield rows_of(batch.schema.field(0).type, ids, found, None)
        if last is not None:
            yield rows_of(batch.schema.field(0).type, [last[0]], [(None,) * len(_RESULT)], (TaskContext.get().partitionId(), first[1], last[1]))

    def rows_of(id_type, ids, found, edge):
        columns = [pa.array(ids, id_type), *(pa.array([r[i] for r in found], t) for i, (_, t) in enumerate(_RESULT))]
        columns += [pa.array([edge and edge[i]] * len(ids), t) for i, t in enumerate((pa.int64(), pa.string(), pa.string()))]
        return pa.RecordBatch.from_arrays(columns, names)

    def run_edges(batches):
        for batch in batches:
            rows = zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())
            found = [_compared(text, digest(text.encode()), after, digest(after.encode())) for text, after in rows]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([r[i] for r in found], t) for i, (_, t) in enumerate(_RESULT))], names[:-3])

    result = "n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    rows = df.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    keys = [F.col("id"), F.xxhash64("text")]
    dealt = rows.repartitionByRange(shuffle_partitions(df.sparkSession), *keys).sortWithinPartitions(*keys)
    table = written(dealt.mapInArrow(run, f"id {kind}, {result}, part long, head string, tail string"), "fingerprints")
    # one row a range: only the ranges' numbers meet in one task, their texts are joined to them
    edges = table.where(F.col(part).isNotNull())
    in_order = Window.orderBy(part)
    whole_circle = in_order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    following = edges.select(part).select(part, F.coalesce(F.lead(part).over(in_order), F.first(part).over(whole_circle)).alias("next"))
    heads = edges.select(F.col(part).alias("next"), F.col(head).alias("after"))
    pairs = edges.select("id", part, F.col(tail).alias("text")).join(following, part).join(heads, "next").select("id", "text", "after")
    closed = pairs.mapInArrow(run_edges, f"id {kind}, {result}")
    out = table.where(F.col(part).isNull()).drop(part, head, tail).unionByName(closed)
    return out.withColumnRenamed("id", free_name([n for n, _ in _RESULT], id_col))
