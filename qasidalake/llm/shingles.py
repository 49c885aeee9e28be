"""Hashes of words and of runs of five words, computed for many texts at once in numpy.

Words are runs of ASCII letters and digits and of bytes from 0x80 up; A-Z count
as a-z.  A text of one to four words has one shingle, all its words.
"""

from __future__ import annotations

import numpy as np

SIZE = 5
_RNG = np.random.RandomState(1234577)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_PLACE = np.array([0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], dtype=np.uint64)


def _byte_tables():
    value = _RNG.randint(1, 1 << 62, size=256, dtype=np.int64).astype(np.uint64)
    in_word = np.zeros(256, dtype=bool)
    in_word[0x30:0x3A] = in_word[0x41:0x5B] = in_word[0x61:0x7B] = in_word[0x80:] = True
    value[0x41:0x5B] = value[0x61:0x7B]
    return value, in_word


_VALUE, _IN_WORD = _byte_tables()
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power_tables(n: int):
    """Powers of the base and of its inverse, 0 to n - 1 at least."""
    if len(_powers[0]) < n:
        for k, base in enumerate((_BASE, _INVERSE)):
            _powers[k] = np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(n - 1, base))])
    return _powers


def word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The hash and the start of each word of ``data``."""
    raw = np.frombuffer(data, dtype=np.uint8)
    inside = np.zeros(len(raw) + 2, dtype=np.int8)
    inside[1:-1] = _IN_WORD[raw]
    edge = np.diff(inside)
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    power, inverse = _power_tables(len(raw) + 1)
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(_VALUE[raw] * power[: len(raw)], out=sums[1:])
    h = (sums[ends] - sums[starts]) * inverse[starts]
    return mixed(h + (ends - starts).astype(np.uint64)), starts


def _long_words(data: bytes, block: int):
    """``word_hashes`` of a long text, a block at a time, cut between words."""
    hashes, at = [], 0
    while at < len(data):
        end = min(len(data), at + block)
        while end < len(data) and _IN_WORD[data[end]]:
            end += 1
        hashes.append(word_hashes(data[at:end])[0])
        at = end
    return np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)


def words_by_text(texts: list[bytes], block: int = 1 << 20) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all texts' words in order, and each text's first place in them (and their number, last)."""
    if any(len(t) > block for t in texts):
        each = [_long_words(t, block) for t in texts]
        bounds = np.concatenate([[0], np.cumsum([len(e) for e in each])])
        return (np.concatenate(each) if each else np.zeros(0, np.uint64)), bounds
    hashes, starts = word_hashes(b" ".join(texts))
    offsets = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])])
    return hashes, np.searchsorted(starts, offsets)


def shingle_hashes(words: np.ndarray) -> np.ndarray:
    """The hashes of one text's shingles, in order."""
    n = len(words)
    if n == 0:
        return words
    if n < SIZE:
        return mixed((words * _PLACE[:n]).sum(keepdims=True) + np.uint64(n))
    h = words[: n - SIZE + 1] * _PLACE[0]
    for k in range(1, SIZE):
        h = h + words[k : n - SIZE + 1 + k] * _PLACE[k]
    return mixed(h)
