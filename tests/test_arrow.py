"""Text functions over Arrow batches against those that are plain columns, on odd texts and in small slices."""

import random

import pytest
from pyspark.sql import functions as F

from qasidalake.functions import arrow as A
from qasidalake.functions import text as T
from qasidalake.sources import corpus as C

ODD = "ابلدرءىأ" + "َُّ" + T.TATWEEL + " \t\n\r =.,-" + "_eé|#" + "​😀"


@pytest.fixture(scope="module")
def texts(spark):
    pick = random.Random(11)
    rows = [None, "", " ", " \n ", "لا", "ل" + "َ" * 3 + "ا", "قلب", "😀ـ. ب"] + ["".join(pick.choices(ODD, k=pick.randint(0, 60))) for _ in range(3000)]
    return spark.createDataFrame(list(enumerate(rows)), "id long, t string").repartition(3).cache()


@pytest.fixture(autouse=True)
def small_slices(monkeypatch):
    monkeypatch.setattr(A, "CHARS", 500)


def test_same_as_columns(texts):
    t = F.col("t")
    pairs = {f.__name__: (getattr(A, f.__name__)(t), f(t)) for f in (T.strip_punct, T.strip_all, T.clean_line, T.without_marks, T.verses, T.stretch_points)}
    pairs["translated"] = A.translated(t, C.LATIN, C.ARABIC), C.arabic(t)
    for n in (0, 1, 7, 100):
        pairs[f"stretched_{n}"] = A.stretched(t, F.lit(n)), T.stretched(t, F.lit(n))
    for name, (got, wanted) in pairs.items():
        assert texts.select("t", got.alias("got"), wanted.alias("wanted")).where("NOT got <=> wanted").take(3) == [], name


def test_spans(texts):
    """A span holds what it was found by, and begins and ends with it."""
    stripped = T.strip_punct(F.col("t"))
    found = texts.select("t", stripped.alias("s"), A.span_in(F.col("t"), stripped, "ب[^ ]* ?[^ ]").alias("at"), F.regexp_substr(stripped, F.lit("ب[^ ]* ?[^ ]")).alias("hit")).collect()
    assert sum(r["at"] is not None for r in found) > 500
    for r in found:
        assert (r["at"] is None) == (r["hit"] is None)
        if r["at"]:
            own = r["t"][r["at"]["start"] : r["at"]["end"]]
            blank = set(T.BLANKS)
            assert "".join(c for c in own if c not in blank and c != T.TATWEEL) == r["hit"].replace(" ", "") and own[0] == "ب"


def test_control_characters_are_no_cuts(spark):
    """Points were the places of a control character, which a text may hold itself."""
    df = spark.createDataFrame([("قل\u0001ب",)], "t string").select(A.stretch_points(F.col("t")).alias("p"), A.stretched(F.col("t"), F.lit(2)).alias("s")).head()
    assert df["p"] == [1] and df["s"] == "قـ" + "ـل\u0001ب"


def test_mark_sets(texts):
    """Against a loop over the characters; a text without U+0001 has one line, and sketches of equal sets are equal."""
    cut = F.translate("t", " ", "\u0001")
    for r in texts.select(cut.alias("t"), A.mark_sets(cut).alias("m")).collect():
        wanted, place, before = set(), -1, None
        for c in r["t"] or "":
            if c not in T.MARKS_LISTED:
                place, before = place + 1, c
            elif before not in (None, "\u0001"):
                wanted.add((place, c))
        got = [(x >> 6, T.MARKS_LISTED[x & 63]) for x in r["m"]["tokens"]]
        assert sorted(got) == sorted(wanted) and len(r["m"]["sketch"]) == 4 and any(r["m"]["sketch"]) == bool(wanted)


def test_search_columns(texts):
    """Both columns of one pass, among them marks that stand alone between spaces and at the ends."""
    more = texts.sparkSession.createDataFrame([(-1, " َ ا َ َ  ب َ"), (-2, "َ"), (-3, "ا . ـ ."), (-4, ". . ا")], "id long, t string")
    own = texts.unionByName(more).withColumn("got", A.search_columns(F.col("t")))
    lost = own.where("t IS NOT NULL").select("t", "got", T.strip_all(F.col("t")).alias("plain"), T.strip_punct(F.col("t")).alias("stripped"))
    assert lost.where("NOT (got.plain <=> plain AND got.stripped <=> stripped)").take(3) == []
