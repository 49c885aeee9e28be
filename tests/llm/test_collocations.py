"""Collocations against plain counting."""

import random
import re
from collections import Counter

import pytest

from qasidalake.llm import collocations as C


def plain(rows, max_n, least, top):
    """(lang, rank, phrase, a, l, r, n, score) by counters of all phrases."""
    f, n = Counter(), Counter()
    lower = {i: i + 32 for i in range(65, 91)}
    for text, lang in rows:
        own = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\n-\r]", (text or "").translate(lower)):
            words = re.findall("[^ \t]+", piece)
            n[own] += len(words)
            for i in range(len(words)):
                for m in range(1, min(max_n, len(words) - i) + 1):
                    f[own, tuple(words[i : i + m])] += 1
    able = {k: a for k, a in f.items() if len(k[1]) > 1 and a >= least}
    rows = []
    for (lang, words), a in able.items():
        score, k = min((1000 * a * n[lang] // (f[lang, words[:k]] * f[lang, words[k:]]), k) for k in range(1, len(words)))
        inside = any(longer[0] == lang and len(longer[1]) > len(words) and b >= a and any(longer[1][o : o + len(words)] == words for o in range(len(longer[1]))) for longer, b in able.items())
        if not inside:
            rows.append((lang, -score, -a, " ".join(words).encode("utf-8", "surrogatepass"), f[lang, words[:k]], f[lang, words[k:]]))
    out, rank = [], Counter()
    for lang, score, a, phrase, left, right in sorted(rows):
        rank[lang] += 1
        if rank[lang] <= top:
            out.append((lang, rank[lang], phrase.decode(), -a, left, right, n[lang], -score))
    return out


def made(seed, n=160):
    pick = random.Random(seed)
    words = ["the", "Of", "ÉTÉ", "a\x01b", "a", "x\x00", "naïve", "q　r", "the\x1f", "\x00", "a\x00\x00b", "und", "zz"] + [f"w{i}" for i in range(30)]
    rows = []
    for i in range(n):
        text = ""
        for _ in range(pick.choice([0, 3, 40, 200])):
            text += pick.choice(["of the naïve", "a a a a a a", "the long fixed passage of words", *words]) + pick.choice([" ", " ", " ", "  ", "\t", ". ", ",", "\r\n", "\x0b", "!"])
        rows.append((text, pick.choice(["en", "en", "en", "fr", None, "und", ""])))
    return rows + [(None, "en"), ("", "de"), (" \t.,", "xx"), *[("all of the same passage stands here", "en")] * 50]


@pytest.mark.parametrize("max_n, least, top", [(5, 12, 2000), (3, 5, 7), (5, 1000, 5), (2, 30, 10)])
def test_by_counting(spark, max_n, least, top):
    rows = made(max_n + least)
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "text string, lang string, phrase string, rank int").repartition(5)
    found = C.collocations(df, max_n=max_n, min_count=least, top=top)
    assert found.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"] and all(k == "bigint" for c, k in found.dtypes if c not in ("lang", "phrase"))
    assert sorted(map(tuple, found.collect())) == sorted(plain(rows, max_n, least, top))


def test_prefixes_over_batches():
    keys = sorted({("en", *random.Random(i).choices("abc", k=1 + i % 3)) for i in range(60)} | {("fr", "a"), ("fr", "a", "b")}, reverse=True)
    rows = [("\0".join(k).encode(), i + 1) for i, k in enumerate(keys)]
    wanted = Counter()
    for k, (_, n) in zip(keys, rows):
        for d in range(len(k)):
            wanted[k[0], " ".join(k[1 : d + 1]).encode()] += n
    wanted = {k: n for k, n in wanted.items() if n >= 40 or len(k[1].split()) < 2}
    for size in (1, 2, 7, 100):
        parts = [C.pa.RecordBatch.from_arrays(list(map(C.pa.array, zip(*rows[i : i + size]))), ["key", "n"]) for i in range(0, len(rows), size)]
        found = [r for b in C.prefix_counts(4, 2, 40)(iter(parts)) for r in zip(*(c.to_pylist() for c in b.columns))]
        got = {(lang, p): n for lang, p, n in found}
        assert len(got) == len(found) and {k: n for k, n in got.items() if n >= 40 or len(k[1].split()) < 2} == wanted
    assert all(C.language_of(C.language_key(x)) == x for x in ("", "en", "a\0b", "\1\2", "\0\1\1\2é"))


def test_long_text_and_empty_table(spark):
    text = "one two three four five six " * 60_000
    df = spark.createDataFrame([(text, "en")], "text string, lang string")
    assert sorted(map(tuple, C.collocations(df).collect())) == sorted(plain([(text, "en")], 5, 100, 2000))
    assert C.collocations(df.limit(0)).collect() == []


def test_exact_scores_beyond_64_bits(spark):
    n = 3 * 10**9
    counts = spark.createDataFrame([("en", "", n), ("en", "a", n // 3), ("en", "b", n // 3 + 1), ("en", "a b", n // 7)], "lang string, phrase string, n long")
    row = C._ranked(counts, 10, 100).collect()[0]
    assert row["score"] == 1000 * (n // 7) * n // ((n // 3) * (n // 3 + 1))
