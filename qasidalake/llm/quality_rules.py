"""Quality rules: a threshold table compiled into one projection of Spark's own functions.

``THRESHOLDS`` names a measure and the least and the most it may be; ``kept`` is
true where a text passes the base rules and every line of the table.  All
measures of a text are computed inside one expression, so nothing is exploded,
shuffled or sent to Python.  Repeated three-word windows are found by sorting the
windows' 64-bit hashes with their places.

Null and empty texts have no words and fail.  Rows are judged one by one;
repeated rows and ids are all kept, texts of any length are read whole.  A measure at
its least or most passes.  An empty table gives an empty one; ``keep_good`` keeps all
columns, else an id column named like a new column gets a longer name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .columns import ascii_words, let
from .common import free_name

# Frequent function words of English, German, French and Spanish.
STOP_WORDS = (
    "a an and are as at be by for from have in is it not of on or that the this to was were with "
    "das dem den der die ein eine für im ist mit nicht sich sie sind und von zu "
    "au aux avec ce dans de des du en est et il la le les ne par pas pour que qui sur un une "
    "con del el es las los no para por se su una y"
).split()

#: (measure, least, most); None is no bound.
THRESHOLDS = (
    ("n_words", 50, None),
    ("chars_per_word", 1.5, 25.0),
    ("symbols_per_word", None, 0.5),
    ("stop_word_share", 0.02, None),
    ("repeated_line_share", None, 0.6),
    ("longest_word", None, 20_000),
)


def repeated_window_words(words: Column) -> Column:
    """Words in three-word windows that are found twice or more, the first included."""

    def covered(found: Column) -> Column:
        h = lambda i: F.get(found, i)["h"]
        twice = F.filter(found, lambda x, i: F.coalesce(x["h"] == h(i - 1), F.lit(False)) | F.coalesce(x["h"] == h(i + 1), F.lit(False)))
        places = F.sort_array(F.transform(twice, lambda x: x["p"]))
        start = F.struct(F.lit(0).alias("n"), F.lit(-3).alias("last"))
        return F.aggregate(places, start, lambda a, p: F.struct((a["n"] + F.least(F.lit(3), p - a["last"])).alias("n"), p.alias("last")), lambda a: a["n"])

    windows = F.transform(F.sequence(F.lit(0), F.size(words) - 3), lambda i: F.struct(F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)).alias("h"), i.alias("p")))
    return F.when(F.size(words) < 3, F.lit(0)).otherwise(let(F.sort_array(windows), covered))


def measures(text: Column) -> Column:
    """One struct with all measures of a text."""
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike("[^ \\t-\\r]"))
    by_line = let(lines, lambda x: F.struct(F.size(x).alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).alias("n_dup_lines")))
    by_word = let(
        ascii_words(text),
        lambda w: F.struct(
            F.size(w).alias("n_words"),
            F.length(F.array_join(w, "")).alias("word_chars"),
            F.size(F.filter(w, lambda x: F.lower(x).isin(STOP_WORDS))).alias("n_stop_words"),
            F.coalesce(F.array_max(F.transform(w, lambda x: F.length(x))), F.lit(0)).alias("longest_word"),
            repeated_window_words(w).alias("n_repeat_words"),
        ),
    )
    symbols = F.length(text) - F.length(F.regexp_replace(text, "[#*$%&|<>]+", ""))
    return F.struct(by_line.alias("lines"), by_word.alias("words"), symbols.alias("n_symbols"))


def _named(m: Column) -> dict[str, Column]:
    """The table's measures; those over no words or lines are 0."""
    words, lines = F.greatest(m["words"]["n_words"], F.lit(1)), F.greatest(m["lines"]["n_lines"], F.lit(1))
    return {
        "n_words": m["words"]["n_words"],
        "chars_per_word": m["words"]["word_chars"] / words,
        "symbols_per_word": m["n_symbols"] / words,
        "stop_word_share": m["words"]["n_stop_words"] / words,
        "repeated_line_share": m["lines"]["n_dup_lines"] / lines,
        "longest_word": m["words"]["longest_word"],
    }


def base_failed(m: Column) -> Column:
    w = m["words"]
    return (w["n_words"] < 50) | (w["n_repeat_words"].cast("long") * 100 > w["n_words"].cast("long") * 50)


def verdict(m: Column, thresholds=THRESHOLDS) -> Column:
    """The table compiled into one condition; false where the base rules fail."""
    named, passed = _named(m), ~base_failed(m)
    for name, least, most in thresholds:
        if least is not None:
            passed = passed & (named[name] >= least)
        if most is not None:
            passed = passed & (named[name] <= most)
    return passed


def quality_measures(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", thresholds=THRESHOLDS) -> DataFrame:
    """(id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept) of each text."""
    rows = df.select(F.col(id_col).alias("id"), measures(F.coalesce(F.col(text_col).cast("string"), F.lit(""))).alias("m"))
    m = F.col("m")
    found = [m["words"]["n_words"], m["words"]["word_chars"], m["n_symbols"], m["lines"]["n_dup_lines"], m["words"]["n_repeat_words"]]
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    return rows.select(
        F.col("id").alias(free_name([*names, "base_failed", "kept"], id_col)),
        *(c.cast("long").alias(n) for c, n in zip(found, names)),
        base_failed(m).alias("base_failed"),
        verdict(m, thresholds).alias("kept"),
    )


def keep_good(df: DataFrame, text_col: str = "text", thresholds=THRESHOLDS) -> DataFrame:
    """The rows of ``df`` that are kept, with its columns."""
    name = free_name(df.columns, "quality_measures")
    judged = df.withColumn(name, measures(F.coalesce(F.col(text_col).cast("string"), F.lit(""))))
    return judged.where(verdict(F.col(name), thresholds)).drop(name)
