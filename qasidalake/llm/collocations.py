"""Phrase collocations by suffix sorting.

Texts are cut into pieces and words, language by language.  Every place of a word gives
the suffix of its piece that starts there, cut to ``MAX_N`` words.  Suffixes are dealt out by
language and first word, sorted in reverse lexicographic order, and one stack of words counts
all their prefixes in one pass: a prefix is done when the next suffix does not start with it.
The stack is worked off a batch at a time: what begins and ends within a batch is summed
between its bounds, what is still open at its end stays on the stack.  The empty prefix counts a
language's words.

Tasks combine equal suffixes of a part of their texts before they send them.  A first word
is dealt into ``PARTS`` parts by a hash of its next one, so a frequent word does not meet in one task.
Phrases of two words or more are whole in a part and go on only with ``min_count`` occurrences; the
counts of single words and of languages are joined afterwards.

Scores are floor(1000 * a * n / (l * r)) in 38-digit decimals.  The first ``top`` phrases of a language are
first picked in ``TOP_PARTS`` parts each, then among those.

A null text counts as empty, a null language as ``und``.  Texts of any length are read
whole; pieces join no two texts.  Repeated rows count each time.  Ties in rank go by
a, then by the phrase's bytes, and no two phrases are equal.  Empty tables give no rows, and
other columns are not looked at.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, slices, written

MAX_N, MIN_COUNT, TOP, INSIDE_PERCENT = 5, 100, 2000, 100
PARTS, TOP_PARTS = 16, 64
PART_BYTES = 4 << 20
# What ends a piece, and what stands between words.
ENDS, BLANKS = b".,;:!?\n\x0b\x0c\r", b" \t"
# A tab, which no word holds, stands for 0x00 in words, and 0x00 stands between them: so a phrase comes next to what starts with it.
_TABLE = bytes.maketrans(bytes(range(65, 91)) + ENDS + BLANKS + b"\0", bytes(range(97, 123)) + b"\n" * len(ENDS) + b" " * len(BLANKS) + b"\t")
_BACK = bytes.maketrans(b"\0\t", b" \0")


def language_key(lang: str) -> bytes:
    """A language as the first word of a key, without 0x00."""
    return lang.encode().replace(b"\1", b"\1\1").replace(b"\0", b"\1\2")


def language_of(key: bytes) -> str:
    return re.sub(b"\1([\1\2])", lambda m: m[1].replace(b"\2", b"\0"), key).decode()


def words_of(texts: list[bytes]) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """Of texts in order: the place of each word in a list of distinct words, that list, and whether a word and its next one share a piece."""
    raw = np.frombuffer(b"\n".join(texts).translate(_TABLE), np.uint8)
    end = raw == 10
    inside = ~(end | (raw == 32))
    edge = np.diff(inside.astype(np.int8), prepend=0, append=0)
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if not len(starts):
        return np.zeros(0, np.int64), pa.array([], pa.large_binary()), np.zeros(0, bool)
    offsets = np.concatenate([[0], np.cumsum(ends - starts)]).astype(np.int64)
    words = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(raw[inside])]).dictionary_encode()
    piece = np.cumsum(end)[starts]
    return words.indices.to_numpy().astype(np.int64), words.dictionary, np.append(piece[1:] == piece[:-1], False)


def by_language(batches):
    """(language, texts) of parts of batches (lang, text)."""
    for batch in batches:
        for part in slices(batch, batch.schema.names[1], PART_BYTES):
            texts = {}
            for lang, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                texts.setdefault(lang, []).append(text or b"")
            yield from texts.items()


def distinct_rows(columns: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The first place of each distinct row of whole numbers from -1 up, in their order, and how often it occurs."""
    code = np.unique(columns[0], return_inverse=True)[1]
    for column in columns[1:]:
        code = np.unique(code * (int(column.max()) + 2) + column + 1, return_inverse=True)[1]
    _, first, count = np.unique(code, return_index=True, return_counts=True)
    return first, count


def suffixes(df: DataFrame, max_n: int) -> DataFrame:
    """(key, n): the language and a suffix, joined by 0x00, and its places.

    Those of a part of the texts come in reverse order, which sorts and packs well.
    """

    def run(batches):
        for lang, texts in by_language(batches):
            ids, words, together = words_of(texts)
            if not len(ids):
                continue
            order = pc.sort_indices(words).to_numpy().astype(np.int64)
            rank = np.empty_like(order)
            rank[order] = np.arange(len(order))
            words, ids = words.take(pa.array(order)), rank[ids]
            at, inside, columns = np.arange(len(ids)), np.ones(len(ids), bool), [ids]
            for k in range(1, max_n):
                inside = inside & together[np.minimum(at + k - 1, len(ids) - 1)]
                columns.append(np.where(inside, ids[np.minimum(at + k, len(ids) - 1)], -1))
            first, n = (x[::-1] for x in distinct_rows(columns))
            columns = [c[first] for c in columns]
            rest = [words.take(pa.array(np.maximum(c, 0), mask=c < 0)) for c in columns]
            keys = pc.binary_join_element_wise(pa.scalar(language_key(lang), pa.large_binary()), *rest, pa.scalar(b"\0", pa.large_binary()), null_handling="skip")
            for at in range(0, len(n), 10_000):
                yield pa.RecordBatch.from_arrays([keys[at : at + 10_000].cast(pa.binary()), pa.array(n[at : at + 10_000])], ["key", "n"])

    return df.mapInArrow(run, "key binary, n long")


def places_of_words(keys: list[bytes], depth: int) -> np.ndarray:
    """The words of keys as places in a list of distinct words, -1 beyond a key's last one."""
    data = np.frombuffer(b"\0".join(keys) + b"\0", np.uint8)
    ends = np.flatnonzero(data == 0)
    starts = np.concatenate([[0], ends[:-1] + 1])
    offsets = np.concatenate([[0], np.cumsum(ends - starts)])
    words = pa.Array.from_buffers(pa.large_binary(), len(ends), [None, pa.py_buffer(offsets), pa.py_buffer(data[data != 0])]).dictionary_encode()
    upto = np.searchsorted(ends, np.cumsum([len(k) + 1 for k in keys]) - 1) + 1  # words up to each key's end
    before = np.concatenate([[0], upto[:-1]])
    row = np.repeat(np.arange(len(keys)), upto - before)
    places = np.full((len(keys), depth), -1)
    places[row, np.arange(len(ends)) - before[row]] = words.indices.to_numpy()
    return places


def prefix_counts(depth: int, whole_from: int, min_count: int):
    """For ``mapInArrow``: (lang, phrase, n) of the prefixes of keys (key, n) in reverse lexicographic order, by one stack.

    Keys have ``depth`` words at most, the language first.  Prefixes of ``whole_from`` words and
    more do not occur elsewhere and are left out below ``min_count``.
    """

    def told(keys: list[bytes], depths: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
        parts = [k.split(b"\0", 1 + d)[: 1 + d] for k, d in zip(keys, depths.tolist())]
        columns = [[language_of(p[0]) for p in parts], [b"\0".join(p[1:]).translate(_BACK) for p in parts], counts]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.binary(), pa.int64()))], ["lang", "phrase", "n"])

    def run(batches):
        last, stack = None, np.zeros(depth, np.int64)  # the last key, and what its prefixes have counted so far
        for batch in batches:
            if not batch.num_rows:
                continue
            keys, n = batch.column(0).to_pylist(), batch.column(1).to_numpy()
            if last is not None:
                keys, n = [last, *keys], np.concatenate([[0], n])
            places = places_of_words(keys, depth)
            same = np.zeros(places.shape, bool)
            same[1:] = np.logical_and.accumulate((places[1:] == places[:-1]) & (places[1:] >= 0), axis=1)
            sums, total = np.concatenate([[0], np.cumsum(n)]), stack
            stack, rows, depths, counts = np.zeros(depth, np.int64), [], [], []
            for d in range(depth):
                begin = np.flatnonzero(~same[:, d])
                end = np.append(begin[1:], len(n))
                held = places[begin, d] >= 0
                count = sums[end] - sums[begin]
                count[0] += total[d]  # goes on from the batch before
                if held[-1]:
                    stack[d], held[-1] = count[-1], False
                good = held & ((count >= min_count) | (d < whole_from))
                rows.append(begin[good])
                depths.append(np.full(good.sum(), d))
                counts.append(count[good])
            at = np.concatenate(rows)
            yield told([keys[i] for i in at.tolist()], np.concatenate(depths), np.concatenate(counts))
            last = keys[-1]
        if last is not None:
            open_ = np.flatnonzero(stack)
            yield told([last] * len(open_), open_, stack[open_])

    return run


def phrase_counts(df: DataFrame, text_col: str, lang_col: str, max_n: int, min_count: int) -> DataFrame:
    """(lang, phrase, n) of all phrases of up to ``max_n`` words with ``min_count`` occurrences or more, and of the empty phrase: the words of a language."""
    rows = df.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.col(text_col).cast("string").cast("binary").alias("text"))
    each = suffixes(rows, max_n)
    words = lambda k: F.substring_index(F.col("key").cast("string"), "\0", k)  # noqa: E731  the first of a key, its language among them
    dealt = each.repartition(words(2), F.pmod(F.xxhash64(words(3)), F.lit(PARTS))).sortWithinPartitions(F.desc("key"))
    parts = dealt.mapInArrow(prefix_counts(1 + max_n, 2, min_count), "lang string, phrase binary, n long")
    sums = parts.groupBy("lang", "phrase").agg(F.sum("n").alias("n"))
    return sums.where((F.col("n") >= min_count) | (F.length("phrase") == 0)).select("lang", F.col("phrase").cast("string").alias("phrase"), "n")


def collocations(df: DataFrame, text_col: str = "text", lang_col: str = "lang", max_n: int = MAX_N, min_count: int = MIN_COUNT, top: int = TOP, inside_percent: int = INSIDE_PERCENT) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): of each language its first ``top`` phrases."""
    work = Scratch(df.sparkSession, "collocations")
    try:
        counts = work.written(phrase_counts(df, text_col, lang_col, max_n, min_count), "counts")
        return written(_ranked(counts, top, inside_percent), "collocations")
    finally:
        work.clear()


def _ranked(counts: DataFrame, top: int, inside_percent: int) -> DataFrame:
    phrases = counts.where("phrase <> ''")
    totals = counts.where("phrase = ''").select("lang", F.col("n").alias("n"))
    rows = phrases.where("contains(phrase, ' ')").select("lang", "phrase", F.col("n").alias("a"), F.size(F.split("phrase", " ")).alias("words"))

    cut = rows.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("words") - 1))).withColumn("head", F.expr("substring_index(phrase, ' ', k)"))
    cut = cut.withColumn("tail", F.expr("substring(phrase, length(head) + 2)"))
    cut = cut.join(phrases.select("lang", F.col("phrase").alias("head"), F.col("n").alias("l")), ["lang", "head"])
    cut = cut.join(phrases.select("lang", F.col("phrase").alias("tail"), F.col("n").alias("r")), ["lang", "tail"])
    cut = cut.join(totals, "lang")
    wide = lambda c: f"cast({c} AS decimal(19, 0))"
    score = F.expr(f"cast(1000 AS decimal(4, 0)) * ({wide('a')} * {wide('n')}) div ({wide('l')} * {wide('r')})")
    lowest = F.min(F.struct(score.alias("score"), "k", "l", "r", "n", "a")).alias("cut")
    scored = cut.groupBy("lang", "phrase").agg(lowest).select("lang", "phrase", "cut.*")

    # what lies in a longer phrase as frequent lies in one of a word more that is as frequent
    longer = rows.where("words > 2").withColumn("sides", F.array(F.expr("substring_index(phrase, ' ', words - 1)"), F.expr("substring(phrase, instr(phrase, ' ') + 1)")))
    longer = longer.select("lang", F.explode("sides").alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("around"))
    kept = scored.join(longer, ["lang", "phrase"], "left").where(f"around IS NULL OR 100 * around < {int(inside_percent)} * a")

    order = [F.desc("score"), F.desc("a"), F.col("phrase")]
    part = F.pmod(F.xxhash64("phrase"), F.lit(TOP_PARTS))
    some = kept.withColumn("part", part).withColumn("nth", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).where(F.col("nth") <= top)
    ranked = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
