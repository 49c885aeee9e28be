"""Poets that appear under several spellings: which belong together, and the name to keep."""

from __future__ import annotations

import re
from dataclasses import replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import LETTERS, SPACES, clean_line, mark_count, strip_all, strip_all_text, trimmed
from ..sources.corpus import Corpus
from .poem_dedup import NO_SOURCE

# The name of an unknown poet, and notes after a name that are no part of it (era, metre).
UNKNOWN = "مجهول"
NOTES = (
    "الجاهلية", "شاعر مجهول", "الاموي", "المخضرمون", "صدر الاسلام", "العباسي", "مخضرمو الدولتين",
    "من الطويل", "من البسيط", "من الكامل", "من الوافر", "من الخفيف", "من المتقارب", "من السريع", "من الرجز",
    "من المنسرح", "من الرمل", "من الهزج", "من المديد", "من مجزوء الكامل", "من الكامل الاحذ",
    "طويل", "كامل", "بسيط", "الطويل", "البسيط",
)
JUNK = ".,;:\\-،؛"

_KNOWN = frozenset(map(strip_all_text, NOTES))
_YEAR = re.compile(r"\d{2,4}\s*م")
_LETTER = re.compile(f"[A-Za-z{LETTERS}]")
_LEAD = re.compile(f"^[{JUNK}\\s']+")
_TRAIL = re.compile(f"[{JUNK}\\s]+$")
_NOTE = (re.compile(r'(.*)\(([^()]*)\)\s*', re.S), re.compile(r'(.+)"([^"]*)"\s*', re.S))


def _unpaired(name: str, edge: str) -> str:
    """Without a quote mark at the edge, if the name has an odd number of them."""
    return re.sub(edge, "", name, count=1) if name.count('"') % 2 else name


def _in_one_pair(name: str) -> bool:
    """Whether the first bracket is closed by the last character and not before."""
    depth = 0
    for place, char in enumerate(name):
        depth += {"(": 1, ")": -1}.get(char, 0)
        if place and depth == 0 and char == ")":
            return place == len(name) - 1
    return False


def _without_note(name: str, note: re.Pattern) -> str:
    found = note.fullmatch(name)
    if found and (strip_all_text(found[2].strip()) in _KNOWN or _YEAR.fullmatch(found[2].strip())):
        return _TRAIL.sub("", found[1])
    return name


def _tidied(name: str) -> str:
    name = _unpaired(_LEAD.sub("", name), r'^"\s*')
    name = _unpaired(_TRAIL.sub("", name), r'"\s*$')
    if name[:1] == "(" and _in_one_pair(name):
        name = name[1:-1].strip()
    if len(name) > 1 and name[0] == name[-1] == '"' and name.count('"') == 2:
        name = name[1:-1].strip()
    for note in _NOTE:
        name = _without_note(name, note)
    return name.strip()


def poet_name(raw: str) -> str:
    """The name in a stored name: tidied until nothing changes; a name without letters is unknown.

    For single strings; tables take ``name_in``, which tests hold against it.
    """
    if not _LETTER.search(raw):
        return UNKNOWN
    name, before = raw, None
    while name != before:
        name, before = _tidied(name), name
    return name if len(name) > 1 else raw


#: A name and the note after it, in brackets or quotes.
NOTED = (rf"(?s)^(.*)\(([^()]*)\)[{SPACES}]*\z", rf'(?s)^(.+)"([^"]*)"[{SPACES}]*\z')
YEAR = rf"^[0-9]{{2,4}}[{SPACES}]*م\z"
LEAD, TRAIL = f"^[{JUNK}{SPACES}']+", rf"[{JUNK}{SPACES}]+\z"
FIRST_QUOTE, LAST_QUOTE = f'^"[{SPACES}]*', rf'"[{SPACES}]*\z'
KNOWN_NOTES = tuple(sorted(_KNOWN))


def _quotes(name: Column) -> Column:
    return F.length(name) - F.length(F.replace(name, F.lit('"'), F.lit("")))


def _without_odd(edge: str):
    return lambda name: F.when(_quotes(name) % 2 == 1, F.regexp_replace(name, edge, "")).otherwise(name)


def _inside(name: Column) -> Column:
    return trimmed(F.substr(name, F.lit(2), F.length(name) - 2))


def _bracketed(name: Column) -> Column:
    """Whether one pair of brackets holds the whole name: nothing before its last character brings the depth to 0."""
    start = F.struct(F.lit(0).alias("depth"), F.lit(1).alias("least"))

    def step(at: Column, char: Column) -> Column:
        depth = at["depth"] + F.when(char == "(", 1).when(char == ")", -1).otherwise(0)
        return F.struct(depth.alias("depth"), F.least(at["least"], depth).alias("least"))

    depths = F.aggregate(F.split(F.substr(name, F.lit(1), F.length(name) - 1), ""), start, step)
    return name.startswith("(") & name.endswith(")") & (depths == F.struct(F.lit(1).alias("depth"), F.lit(1).alias("least")))


def _quoted(name: Column) -> Column:
    return (F.length(name) > 1) & name.startswith('"') & name.endswith('"') & (_quotes(name) == 2)


def _before_note(noted: str):
    def rule(name: Column) -> Column:
        tag = trimmed(F.regexp_extract(name, noted, 2))
        is_note = name.rlike(noted) & (strip_all(tag).isin(*KNOWN_NOTES) | tag.rlike(YEAR))
        return F.when(is_note, F.regexp_replace(F.regexp_extract(name, noted, 1), TRAIL, "")).otherwise(name)

    return rule


#: What is tried on a name in turn; a round tries all, and rounds go on until one changes nothing.
RULES = (
    lambda name: F.regexp_replace(name, LEAD, ""),
    _without_odd(FIRST_QUOTE),
    lambda name: F.regexp_replace(name, TRAIL, ""),
    _without_odd(LAST_QUOTE),
    lambda name: F.when(_bracketed(name), _inside(name)).otherwise(name),
    lambda name: F.when(_quoted(name), _inside(name)).otherwise(name),
    *map(_before_note, NOTED),
    trimmed,
)


def name_in(raw: Column) -> Column:
    """``poet_name`` as a column, null for null.

    A rule only ever shortens a name, so there are at most as many rounds as characters; those after the last change
    pass the name on untouched.
    """

    def tried(name: Column, rule: Column) -> Column:
        cases = F.when(rule == 0, RULES[0](name))
        for i, own in enumerate(RULES[1:], 1):
            cases = cases.when(rule == i, own(name))
        return cases

    def round_of(at: Column, _: Column) -> Column:
        after = F.aggregate(F.array(*map(F.lit, range(len(RULES)))), at["name"], tried)
        ended = F.transform(F.array(after), lambda name: F.struct(name.alias("name"), (name == at["name"]).alias("done")))
        return F.when(at["done"], at).otherwise(F.get(ended, F.lit(0)))

    start = F.struct(raw.alias("name"), F.lit(False).alias("done"))
    name = F.aggregate(F.sequence(F.lit(0), F.length(raw)), start, round_of)["name"]
    long_enough = F.transform(F.array(name), lambda n: F.when(F.length(n) > 1, n).otherwise(raw))
    return F.when(~raw.rlike(_LETTER.pattern), UNKNOWN).when(raw.isNotNull(), F.get(long_enough, F.lit(0)))


def variants(corpus: Corpus) -> DataFrame:
    """(poet_id, name, priority, count): spellings with poems, by source."""
    poem = corpus.poem.select("poet_id", F.coalesce("source_id", F.lit(NO_SOURCE)).alias("priority"))
    return corpus.poet.join(poem, F.col("id") == F.col("poet_id")).groupBy("poet_id", "name", "priority").agg(F.count(F.lit(1)).alias("count"))


def _best(found: DataFrame, key: str, best: str) -> DataFrame:
    """(group, best): of each group's keys, by priority, marks, count and name."""
    merged = found.groupBy("group", key).agg(F.min("priority").alias("priority"), F.sum("count").alias("count"))
    order = F.struct("priority", (-mark_count(clean_line(F.col(key)))).alias("m"), (-F.col("count")).alias("c"), F.col(key).alias(best))
    return merged.groupBy("group").agg(F.min(order).alias("first")).select("group", F.col(f"first.{best}").alias(best))


def grouped_variants(corpus: Corpus) -> DataFrame:
    """The variants with ``clean`` (the name in the stored name) and ``group`` (its coarse key)."""
    names = corpus.poet.select("name").distinct().withColumn("clean", name_in(F.col("name"))).withColumn("group", strip_all(F.col("clean")))
    return variants(corpus).join(names, "name")


def merge_plan(corpus: Corpus) -> DataFrame:
    """(poet_id, name, target_id, canonical) of each poet that is merged or renamed."""
    found = grouped_variants(corpus)
    names = _best(found, "clean", "canonical").join(_best(found, "name", "stored"), "group")
    poets = found.select("group", "poet_id", "name").distinct().join(names, "group")
    same = Window.partitionBy("group")
    target = F.min(F.when(F.col("name") == F.col("stored"), F.col("poet_id"))).over(same)
    poets = poets.withColumns({"target_id": target, "spellings": F.count(F.lit(1)).over(same)})
    return poets.where((F.col("spellings") > 1) | (F.col("name") != F.col("canonical"))).select("poet_id", "name", "target_id", "canonical")


def merged(corpus: Corpus) -> Corpus:
    """The corpus with the plan carried out: poems repointed, merged poets gone, targets renamed."""
    plan = merge_plan(corpus)
    to = plan.select("poet_id", "target_id")
    poem = corpus.poem.join(to, "poet_id", "left").withColumn("poet_id", F.coalesce("target_id", "poet_id")).select(corpus.poem.columns)
    gone = plan.where("poet_id <> target_id").select(F.col("poet_id").alias("id"))
    named = plan.select(F.col("target_id").alias("id"), "canonical").distinct()
    poet = corpus.poet.join(gone, "id", "left_anti").join(named, "id", "left").select("id", F.coalesce("canonical", "name").alias("name"))
    return replace(corpus, poem=poem, poet=poet)
