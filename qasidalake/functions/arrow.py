"""The functions of ``text`` for whole tables of lines and documents: the same results from Arrow batches.

A batch's texts become one array of code points, which numpy works through in slices of ``CHARS``; a table lookup
and a few sums take the place of a hash lookup for each character.  Not for use inside lambdas of array functions,
where ``text`` has the same functions as plain columns.
"""

from __future__ import annotations

from functools import lru_cache
from hashlib import blake2b
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from . import text as T

#: Characters that are worked on at a time; a longer text is a slice of its own.
CHARS = 1 << 18
_WIDE, _DROP, _SPACE = 0x10000, 0xFFFFFFFF, 0x20


def _points(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The code points of all texts, and where each text begins among them; null counts as empty."""
    texts = texts.fill_null("")
    starts = np.zeros(len(texts) + 1, np.int64)
    np.cumsum(pc.utf8_length(texts).to_numpy(), out=starts[1:])
    at = np.frombuffer(texts.buffers()[1], np.int32, len(texts) + 1, texts.offset * 4)
    data = b"" if texts.buffers()[2] is None else texts.buffers()[2][int(at[0]) : int(at[-1])].to_pybytes()
    return np.frombuffer(data.decode().encode("utf-32-le"), np.uint32), starts


def _texts(points: np.ndarray, starts: np.ndarray, null: np.ndarray) -> pa.Array:
    top, at = points.max(initial=0), starts
    for most in (0x7F, 0x7FF, 0xFFFF):
        if top > most:  # a byte more for each of them
            more = np.zeros(len(points) + 1, np.int32)
            np.cumsum(points > most, out=more[1:])
            at = at + more[starts]
    width, code = ("<u2", "utf-16-le") if top < _WIDE else ("<u4", "utf-32-le")
    data = pa.py_buffer(points.astype(width).tobytes().decode(code).encode())
    valid = pa.py_buffer(np.packbits(~null, bitorder="little").tobytes())
    return pa.Array.from_buffers(pa.string(), len(starts) - 1, [valid, pa.py_buffer(at.astype(np.int32).tobytes()), data])


def _kept(points: np.ndarray, starts: np.ndarray, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return points[keep], starts - np.searchsorted(np.flatnonzero(~keep), starts)


def _sliced(texts: pa.Array, others: tuple, kind: pa.DataType, work) -> pa.Array:
    """``work(texts, *others)`` over slices of the batch, put together."""
    texts = texts.cast(pa.string())
    ends, low, found = np.cumsum(pc.utf8_length(texts).fill_null(0).to_numpy(zero_copy_only=False)), 0, []
    while low < len(texts):
        high = max(low + 1, int(np.searchsorted(ends, (ends[low - 1] if low else 0) + CHARS, "right")))
        found.append(work(texts.slice(low, high - low), *(x.slice(low, high - low) for x in others)))
        low = high
    return pa.concat_arrays(found) if found else pa.array([], kind)


def _null(texts: pa.Array) -> np.ndarray:
    return texts.is_null().to_numpy(zero_copy_only=False)


@lru_cache(8)
def _table(chars: str, to: str) -> np.ndarray:
    table, told = np.arange(_WIDE, dtype=np.uint32), set()
    for i, c in enumerate(chars):
        if c not in told:  # as in Spark's translate, the first counts
            table[ord(c)] = ord(to[i]) if i < len(to) else _DROP
            told.add(c)
    return table


def _looked_up(points: np.ndarray, table: np.ndarray) -> np.ndarray:
    if not len(points) or points.max() < _WIDE:
        return table[points]
    return np.where(points < _WIDE, table[np.minimum(points, _WIDE - 1)], points)


def _translate(texts: pa.Array, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    points, starts = _points(texts)
    points = _looked_up(points, table)
    keep = points != _DROP
    return (points, starts) if keep.all() else _kept(points, starts, keep)


def translated(text: Column, chars: str, to: str) -> Column:
    """As Spark's translate, for characters of the basic plane."""

    @F.arrow_udf("string")
    def run(texts: pa.Array) -> pa.Array:
        table = _table(chars, to)
        return _sliced(texts, (), pa.string(), lambda own: _texts(*_translate(own, table), _null(own)))

    return run(text)


def translated_digest(text: Column, chars: str, to: str) -> Column:
    """A digest of 16 bytes of each text as ``translated`` gives it, which itself stays in the task."""

    @F.arrow_udf("binary")
    def run(texts: pa.Array) -> pa.Array:
        table = _table(chars, to)

        def work(own):
            points, starts = _translate(own, table)
            data, at = memoryview(points.view(np.uint8)), (starts * 4).tolist()
            return pa.array([blake2b(data[low:high], digest_size=16).digest() for low, high in pairwise(at)], pa.binary())

        return _sliced(texts, (), pa.binary(), work)

    return run(text)


def _one_space(points: np.ndarray, starts: np.ndarray, trim: bool) -> tuple[np.ndarray, np.ndarray]:
    """Runs of spaces as one; ``trim`` leaves none at the ends of a text."""
    space = points == _SPACE
    drop = space.copy()
    drop[1:] &= space[:-1]
    filled = starts[:-1] < starts[1:]
    first, last = starts[:-1][filled], starts[1:][filled] - 1
    drop[first] = space[first] & trim
    if trim:  # what is left of a run at the end of a text: the last space kept, if it is that text's
        left = np.flatnonzero(space & ~drop)
        first, last = first[space[last]], last[space[last]]
        nth = np.searchsorted(left, last, "right") - 1
        own = left[nth[nth >= 0]]
        drop[own[own >= first[nth >= 0]]] = True
    return _kept(points, starts, ~drop) if drop.any() else (points, starts)


def _spaced(text: Column, blanks: str, dropped: str, folded: tuple[str, str] = ("", ""), trim: bool = True) -> Column:
    """Blanks as spaces, runs of spaces as one, without ``dropped``."""

    @F.arrow_udf("string")
    def run(texts: pa.Array) -> pa.Array:
        table = _table(folded[0] + blanks + dropped, folded[1] + " " * len(blanks))
        return _sliced(texts, (), pa.string(), lambda own: _texts(*_one_space(*_translate(own, table), trim), _null(own)))

    return run(text)


def strip_punct(text: Column) -> Column:
    return _spaced(text, T.BLANKS, T.TATWEEL)


def strip_all(text: Column) -> Column:
    return _spaced(text, T.BLANKS, T.TATWEEL + T.MARKS_LISTED, (T.FOLD_FROM, T.FOLD_TO))


def search_columns(text: Column) -> Column:
    """struct<plain, stripped>: ``strip_all`` and ``strip_punct`` in one pass, the former out of the latter."""

    @F.arrow_udf("struct<plain string, stripped string>")
    def run(texts: pa.Array) -> pa.Array:
        silent = _table(T.BLANKS + T.TATWEEL, " " * len(T.BLANKS))
        bare = _table(T.FOLD_FROM + T.MARKS_LISTED, T.FOLD_TO)

        def work(own):
            null = _null(own)
            points, starts = _one_space(*_translate(own, silent), True)
            folded = _looked_up(points, bare)
            plain = _one_space(*_kept(folded, starts, folded != _DROP), True)
            return pa.StructArray.from_arrays([_texts(*plain, null), _texts(points, starts, null)], ["plain", "stripped"])

        return _sliced(texts, (), pa.struct([("plain", pa.string()), ("stripped", pa.string())]), work)

    return run(text)


def translated_and_plain(text: Column, chars: str, to: str) -> Column:
    """struct<text, plain>: ``translated`` and ``strip_all`` of that, in one pass."""

    @F.arrow_udf("struct<text string, plain string>")
    def run(texts: pa.Array) -> pa.Array:
        table, bare = _table(chars, to), _table(T.FOLD_FROM + T.BLANKS + T.TATWEEL + T.MARKS_LISTED, T.FOLD_TO + " " * len(T.BLANKS))

        def work(own):
            null = _null(own)
            points, starts = _translate(own, table)
            folded = _looked_up(points, bare)
            plain = _one_space(*_kept(folded, starts, folded != _DROP), True)
            return pa.StructArray.from_arrays([_texts(points, starts, null), _texts(*plain, null)], ["text", "plain"])

        return _sliced(texts, (), pa.struct([("text", pa.string()), ("plain", pa.string())]), work)

    return run(text)


def clean_line(text: Column) -> Column:
    return _spaced(text, "\t\n\r", T.TATWEEL)


def without_marks(clean: Column) -> Column:
    return translated(clean, T.MARKS_LISTED, "")


def verses(text: Column) -> Column:
    """All verses of a text that are not empty, as ``text.verse`` gives them; line feeds are what parts them."""
    marked = _spaced(F.replace(text, F.lit("..."), F.lit("=")), T.SPACES_LISTED.replace("\n", ""), "", ("_", "="), trim=False)
    return F.filter(F.transform(F.split(marked, "\n"), lambda v: F.trim(v)), lambda v: v != "")


def span(text: Column, at: Column, size: Column) -> Column:
    """struct<start, end> in ``text`` of the ``size`` characters from place ``at`` (from 1, as ``regexp_instr`` counts) of ``strip_punct(text)``.

    A run of white space and punctuation counts as its first character.  Nothing, or no match, has the span (-1, -1).
    """

    @F.arrow_udf("struct<start int, end int>")
    def run(texts: pa.Array, ats: pa.Array, sizes: pa.Array) -> pa.Array:
        table = _table(T.BLANKS + T.TATWEEL, " " * len(T.BLANKS))

        def work(own, ats, sizes):
            points, starts = _points(own)
            points = _looked_up(points, table)
            spoken = np.flatnonzero(points != _DROP)
            points, first = _kept(points, starts, points != _DROP)
            space = points == _SPACE
            after = np.zeros(len(points), bool)
            after[1:] = space[:-1]
            after[first[:-1][first[:-1] < first[1:]]] = True
            keep = ~(space & after)
            points, first = _kept(points, first, keep)
            place = spoken[keep]
            at, size = (x.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64) for x in (ats, sizes))
            hit = (size > 0) & (at > 0)
            start, end = np.full(len(own), -1, np.int32), np.full(len(own), -1, np.int32)
            units = np.zeros(len(points) + 1, np.int64)  # of UTF-16, which places of a regex count
            np.cumsum(1 + (points >= _WIDE), out=units[1:])
            begin = np.searchsorted(units, units[first[:-1][hit]] + at[hit] - 1)
            start[hit] = place[begin] - starts[:-1][hit]
            end[hit] = place[begin + size[hit] - 1] + 1 - starts[:-1][hit]
            return pa.StructArray.from_arrays([pa.array(start), pa.array(end)], ["start", "end"])

        return _sliced(texts, (ats, sizes), pa.struct([("start", pa.int32()), ("end", pa.int32())]), work)

    return run(text, at, size)


def span_in(text: Column, stripped: Column, pattern: str, sure: bool = False) -> Column:
    """struct<start, end> in ``text`` of the pattern's first match in ``stripped``; null without one.

    ``stripped`` is ``strip_punct(text)``.  An empty match has the span (-1, -1).
    ``sure`` says that there is a match, which then is not asked again.
    """
    at, size = F.regexp_instr(stripped, F.lit(pattern)), F.length(F.regexp_substr(stripped, F.lit(pattern)))
    # as many characters as are dropped in all may stand before the match's end
    reach = at + size + F.length(text) - F.length(stripped)
    hit = span(F.substr(text, F.lit(1), reach), at, size)
    return hit if sure else F.when(stripped.rlike(pattern), hit)


@lru_cache(1)
def _kinds() -> np.ndarray:
    """Bits of each character: 1 a mark, 2 a letter that joins the next one, 4 lam, 8 a letter that may stand behind, 16 an alef."""
    kinds = np.zeros(_WIDE, np.uint8)
    letters = set(T.LETTERS_LISTED)
    for bit, chars in ((1, T.MARKS_LISTED), (2, letters - set(T.NO_JOIN_AFTER)), (4, T.LAM), (8, letters - {T.HAMZA}), (16, T.ALEFS)):
        for c in chars:
            kinds[ord(c)] |= bit
    return kinds


def _stretch(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points, starts of texts, and the places before which a tatweel may be put, all texts in a row."""
    points, starts = _points(texts)
    kind = _kinds()[np.minimum(points, _WIDE - 1)]
    spoken = np.flatnonzero((kind & 1) == 0)
    own, behind = kind[spoken[:-1]], kind[spoken[1:]]
    joins = ((own & 2) > 0) & ((behind & 8) > 0) & ~(((own & 4) > 0) & ((behind & 16) > 0))
    letter, place = spoken[:-1][joins], spoken[1:][joins]
    same = np.searchsorted(starts, letter, "right") == np.searchsorted(starts, place, "right")
    return points, starts, place[same]


def stretch_points(text: Column) -> Column:
    """Places before which a tatweel may be put, ascending."""

    @F.arrow_udf("array<int>")
    def run(texts: pa.Array) -> pa.Array:
        def work(own):
            _, starts, place = _stretch(own)
            row = np.searchsorted(starts, place, "right") - 1
            bounds = np.searchsorted(place, starts).astype(np.int32)
            found = pa.ListArray.from_arrays(pa.array(bounds), pa.array((place - starts[row]).astype(np.int32)))
            return found if not own.null_count else pc.if_else(own.is_null(), pa.scalar(None, found.type), found)

        return _sliced(texts, (), pa.list_(pa.int32()), work)

    return run(text)


def stretched(text: Column, count: Column) -> Column:
    """The text with ``count`` tatweels spread evenly over its points."""

    @F.arrow_udf("string")
    def run(texts: pa.Array, counts: pa.Array) -> pa.Array:
        def work(own, counts):
            points, starts, place = _stretch(own)
            bounds = np.searchsorted(place, starts)
            n, total = np.diff(bounds), counts.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            row = np.repeat(np.arange(len(own)), n)
            nth, n, total = np.arange(len(place)) - bounds[row], n[row], np.maximum(total, 0)[row]
            left = total % n
            k = -(-nth * left // n)  # the k-th one more goes to point k * n // left
            more = total // n + ((k < left) & (k * n < (nth + 1) * left))
            before = np.zeros(len(place) + 1, np.int64)
            np.cumsum(more, out=before[1:])
            return _texts(np.insert(points, np.repeat(place, more), ord(T.TATWEEL)), starts + before[bounds], _null(own))

        return _sliced(texts, (counts,), pa.string(), work)

    return run(text, count)


def mark_sets(text: Column) -> Column:
    """struct<tokens, sketch>: the marks of a text whose lines are parted by U+0001, and 256 bits that a set's supersets have too.

    A token is the place of a letter among all characters but marks, times 64, and its mark, once each; marks before
    the first letter of a line are left out.
    """

    @F.arrow_udf("struct<tokens array<long>, sketch array<long>>")
    def run(texts: pa.Array) -> pa.Array:
        longs = pa.list_(pa.int64())

        def work(own):
            points, starts = _points(own)
            mark = (_kinds()[np.minimum(points, _WIDE - 1)] & 1) > 0
            letters = np.zeros(len(points) + 1, np.int64)
            np.cumsum(~mark, out=letters[1:])
            at = np.flatnonzero(mark)
            row = np.searchsorted(starts, at, "right") - 1
            place = letters[at] - letters[starts[row]] - 1
            spoken = points[~mark]
            held = place >= 0
            held[held] = spoken[letters[at[held]] - 1] != 1
            at, row, place = at[held], row[held], place[held]
            code = points[at].astype(np.int64)
            token = place * 64 + np.where(code < 0x660, code - 0x64B, 21)  # U+0670 behind U+065F
            order = np.lexsort((token, row))
            row, token = row[order], token[order]
            new = np.ones(len(token), bool)
            new[1:] = (row[1:] != row[:-1]) | (token[1:] != token[:-1])
            row, token = row[new], token[new]
            bounds = np.searchsorted(row, np.arange(len(own) + 1))
            mixed = token.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
            bit = np.uint64(1) << ((mixed >> np.uint64(56)) & np.uint64(63))
            sketch, some = np.zeros((len(own), 4), np.uint64), np.flatnonzero(np.diff(bounds))
            for k in range(4 if len(some) else 0):
                sketch[some, k] = np.bitwise_or.reduceat(np.where(mixed >> np.uint64(62) == k, bit, np.uint64(0)), bounds[:-1][some])
            tokens = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(token))
            words = pa.ListArray.from_arrays(pa.array(np.arange(len(own) + 1, dtype=np.int32) * 4), pa.array(sketch.view(np.int64).ravel()))
            return pa.StructArray.from_arrays([tokens, words], ["tokens", "sketch"])

        return _sliced(texts, (), pa.struct([("tokens", longs), ("sketch", longs)]), work)

    return run(text)
