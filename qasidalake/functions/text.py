"""Normalization of Arabic verse as Spark columns, with plain-string twins for query text."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Character classes, as the inside of a regex class.
MARKS = "\u064b-\u065f\u0670"  # vowel signs and other marks above or below a letter
LETTERS = "\u0621-\u063a\u0641-\u064a"
TATWEEL = "\u0640"
SPACES = "\t\n\x0b\f\r \u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"
PUNCTUATION = '=.,;:!?\\-()\\[\\]"\u060c\u061b\u061f\u00ab\u00bb'
# Letters that searches take for one another, each group under its first form here.
YA_GROUP = "يى"
ALEF_GROUP = "اأإآؤئء"
FOLD_FROM = YA_GROUP[1:] + ALEF_GROUP[1:]
FOLD_TO = YA_GROUP[0] * (len(YA_GROUP) - 1) + ALEF_GROUP[0] * (len(ALEF_GROUP) - 1)

_FOLD = str.maketrans(FOLD_FROM, FOLD_TO)
_SILENT = re.compile(f"[{TATWEEL}{MARKS}]")
_BETWEEN = re.compile(f"[{PUNCTUATION}{SPACES}]+")


def _listed(inside: str) -> str:
    """The characters of a regex class, without its ranges and escapes."""
    ranges = re.sub(r"([^\\])-(.)", lambda m: "".join(map(chr, range(ord(m[1]), ord(m[2]) + 1))), inside)
    return re.sub(r"\\(.)", r"\1", ranges)


SPACES_LISTED, MARKS_LISTED, LETTERS_LISTED = map(_listed, (SPACES, MARKS, LETTERS))
BLANKS = _listed(PUNCTUATION) + SPACES_LISTED


def trimmed(text: Column) -> Column:
    """Without white space of any kind at the ends."""
    return F.btrim(text, F.lit(SPACES_LISTED))


def _spaced(text: Column, blanks: str, dropped: str, folded: tuple[str, str] = ("", "")) -> Column:
    """Runs of ``blanks`` and spaces as one space, none at the ends, without ``dropped``; one pass over the characters, no regex class."""
    return F.trim(F.regexp_replace(F.translate(text, folded[0] + blanks + dropped, folded[1] + " " * len(blanks)), " {2,}", " "))


def strip_punct(text: Column) -> Column:
    """No tatweel; punctuation and white space become single spaces, none at the ends; marks stay."""
    return _spaced(text, BLANKS, TATWEEL)


def strip_all(text: Column) -> Column:
    """``strip_punct`` without marks and with letter variants folded: the coarse search key."""
    return _spaced(text, BLANKS, TATWEEL + MARKS_LISTED, (FOLD_FROM, FOLD_TO))


def strip_all_text(text: str) -> str:
    return _BETWEEN.sub(" ", _SILENT.sub("", text)).strip(" ").translate(_FOLD)


def clean_line(text: Column) -> Column:
    """No tatweel, runs of ASCII white space as one space, trimmed; the rest as written."""
    return _spaced(text, "\t\n\r", TATWEEL)


def without_marks(clean: Column) -> Column:
    return F.translate(clean, MARKS_LISTED, "")


def mark_count(clean: Column) -> Column:
    return F.length(clean) - F.length(without_marks(clean))


def is_mark(char: Column) -> Column:
    return char.rlike(f"^[{MARKS}]$")


def is_mark_or_tatweel(char: Column) -> Column:
    return char.rlike(f"^[{MARKS}{TATWEEL}]$")


def first_half(line: Column) -> Column:
    """What stands before the first ``=``, or the whole line."""
    return trimmed(F.substring_index(line, "=", 1))


def second_half(line: Column) -> Column:
    """What stands after the first ``=``, or nothing."""
    at = F.instr(line, "=")
    return F.when(at > 0, trimmed(F.substr(line, at + 1))).otherwise("")


def has_two_halves(line: Column) -> Column:
    return line.contains("=")


def verse(raw: Column) -> Column:
    """An imported verse with ``=`` between its halves, white space collapsed."""
    marked = F.replace(F.replace(raw, F.lit("..."), F.lit("=")), F.lit("_"), F.lit("="))
    return F.trim(F.regexp_replace(marked, f"[{SPACES}]+", " "))


def verses(text: Column) -> Column:
    """All verses of a text that are not empty."""
    return F.filter(F.transform(F.split(text, "\n"), verse), lambda v: v != "")


def title_of(verse_list: Column) -> Column:
    return F.substring_index(F.get(verse_list, F.lit(0)), " = ", 1)


def tightness(start: Column, end: Column, text: Column) -> Column:
    """The share of the text that a span covers; 0 for an empty text."""
    n = F.length(text)
    return F.when(n > 0, (end - start) / n).otherwise(F.lit(0.0)).cast("double")


def odd_spaces(stripped: Column, odd: str) -> Column:
    """``stripped`` with another space before words that begin with a mark; no place changes."""
    return F.regexp_replace(stripped, f" (?=[{MARKS}])", odd)


def merged_spans(spans: Column, length: Column) -> Column:
    """Spans inside the text, clamped, in order, joined where they touch or overlap."""
    inside = F.filter(spans, lambda s: (s["start"] >= 0) & (s["end"] > s["start"]) & (s["start"] < length))
    clamped = F.array_sort(F.transform(inside, lambda s: F.struct(s["start"].alias("start"), F.least(s["end"], length).alias("end"))))
    none = F.slice(clamped, 1, 0)

    def step(done: Column, s: Column) -> Column:
        last = F.element_at(done, -1)
        grown = F.struct(last["start"].alias("start"), F.greatest(last["end"], s["end"]).alias("end"))
        joins = (F.size(done) > 0) & (s["start"] <= F.try_element_at(done, F.lit(-1))["end"])
        return F.when(joins, F.concat(F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0))), F.array(grown))).otherwise(F.concat(done, F.array(s)))

    def safe_step(done: Column, s: Column) -> Column:
        return F.when(F.size(done) == 0, F.array(s)).otherwise(step(done, s))

    return F.aggregate(clamped, none, safe_step)


# Letters after which, and before which, no tatweel may stand.
NO_JOIN_AFTER = "ءآأؤإاةدذرزوى"
HAMZA, LAM, ALEFS = "ء", "ل", "اأإآ"

_JOIN = (
    f"(?:[{LETTERS}&&[^{NO_JOIN_AFTER}{LAM}]][{MARKS}]*(?=[{LETTERS}&&[^{HAMZA}]])"
    f"|{LAM}[{MARKS}]*(?=[{LETTERS}&&[^{HAMZA}{ALEFS}]]))"
)


def _stretchable(text: Column) -> Column:
    """The text cut at each place that can take a tatweel."""
    return F.split(F.regexp_replace(text, f"({_JOIN})", "$1\u0001"), "\u0001")


def stretch_points(text: Column) -> Column:
    """Places before which a tatweel may be put, ascending."""
    parts = _stretchable(text)
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("all"))
    grown = F.aggregate(F.slice(parts, F.lit(1), F.size(parts) - 1), start, lambda a, p: F.struct((a["at"] + F.length(p)).alias("at"), F.concat(a["all"], F.array(a["at"] + F.length(p))).alias("all")))
    return grown["all"]


def stretched(text: Column, count: Column) -> Column:
    """The text with ``count`` tatweels spread evenly over its points."""

    def fill(parts: Column) -> Column:
        n = F.size(parts) - 1
        left = count % n
        extra = F.when(left > 0, F.transform(F.sequence(F.lit(0), left - 1), lambda k: F.floor(k * n / left).cast("int"))).otherwise(F.array().cast("array<int>"))
        share = F.floor(count / n).cast("int")
        whole = F.transform(parts, lambda p, i: F.when(i < n, F.concat(p, F.repeat(F.lit(TATWEEL), share + F.array_contains(extra, i).cast("int")))).otherwise(p))
        return F.when((count > 0) & (n > 0), F.array_join(whole, "")).otherwise(text)

    return F.transform(F.array(_stretchable(text)), fill).getItem(0)
