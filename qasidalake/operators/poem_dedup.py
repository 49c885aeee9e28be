"""Poems that are copies of one another but for their vocalization, and what is kept of them.

Two poems belong together if their lines are equal without marks.  In such a group
the order is: most marks, then the source of highest priority, then the least id.
A poem goes if one before it in that order has all its marks, letter by letter; it
becomes an alias of the first survivor that has.  As having all marks is transitive,
that is the first poem that has them, and no loop is needed.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.arrow import clean_line, mark_sets, without_marks
from ..sources.corpus import Corpus
from ..sources.snapshots import written

NO_SOURCE = 99


def poem_texts(corpus: Corpus) -> DataFrame:
    """(id, signature, own, marks, priority) of each poem that has lines."""
    poems = cleaned_lines(corpus.lines).withColumn("text", F.array_join("clean", "\u0001")).drop("clean").withColumn("bare", without_marks(F.col("text")))
    digest = lambda text: F.struct(F.md5(text).alias("m"), F.xxhash64(text).alias("h"))
    poems = poems.select("id", digest("bare").alias("signature"), digest("text").alias("own"), (F.length("text") - F.length("bare")).alias("marks"))
    priority = corpus.poem.select("id", F.coalesce("source_id", F.lit(NO_SOURCE)).alias("priority"))
    return poems.join(priority, "id")


def cleaned_lines(lines: DataFrame) -> DataFrame:
    """(id, clean): each poem's cleaned lines, in order."""
    lines = lines.select("poem_id", F.struct("line_number", F.col("id").alias("line_id"), clean_line(F.coalesce("line", F.lit(""))).alias("clean")).alias("line"))
    return lines.groupBy(F.col("poem_id").alias("id")).agg(F.sort_array(F.collect_list("line")).alias("all")).select("id", F.transform("all", lambda x: x["clean"]).alias("clean"))


#: Holders of one token that a task compares with a reading at a time.
BLOCK = 1024


def readings_of(lines: DataFrame, firsts: DataFrame) -> DataFrame:
    """(signature, own, turn, tokens, size, sketch) of each vocalization in a group of several; a token stands for the place of a letter and a mark."""
    several = firsts.groupBy("signature").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("signature")
    mixed = firsts.join(several, "signature", "left_semi").select("signature", "own", "turn", F.col("turn.i").alias("id"))
    # only the lines of poems in such groups are read into texts again
    poems = cleaned_lines(lines.join(mixed.select(F.col("id").alias("poem_id")), "poem_id", "left_semi"))
    poems = poems.select("id", mark_sets(F.array_join("clean", "\u0001")).alias("marks"))
    return mixed.join(poems, "id").select("signature", "own", "turn", "marks.tokens", F.size("marks.tokens").alias("size"), "marks.sketch")


def supersets(readings: DataFrame) -> DataFrame:
    """(signature, own, to): the first turn before a reading's own whose reading has all its tokens, where there is one.

    A set-containment join.  Whatever has all tokens of a reading has its rarest one in the group, so a reading
    is compared with that token's holders only.  If the first holder has all tokens it is the answer, so a chain
    of ever fuller readings costs a comparison each.  The rest meet the other holders in blocks, by turn, size and
    a sketch of 256 bits before the tokens themselves.  A reading without tokens goes to the first of its group.
    """
    plain = readings.groupBy("signature").agg(F.min("turn").alias("to")).join(readings.where("size = 0").select("signature", "own", "turn"), "signature")
    plain = plain.where("to < turn").select("signature", "own", "to")
    held = readings.select("signature", "own", "turn", "size", "sketch", F.explode("tokens").alias("token"))
    counts = held.groupBy("signature", "token").agg(F.count(F.lit(1)).alias("n"), F.min_by("own", "turn").alias("a_own"), F.min("turn").alias("a_turn"))
    rarest = held.select("signature", "own", "token").join(counts, ["signature", "token"])
    rarest = rarest.groupBy("signature", "own").agg(F.min(F.struct("n", "token", "a_own", "a_turn")).alias("r")).select("signature", "own", "r.*")
    sets = readings.select("signature", "own", "turn", "size", "sketch", "tokens")
    others = readings.select("signature", F.col("own").alias("a_own"), F.col("tokens").alias("a_tokens"))
    whole = F.size(F.array_except("tokens", "a_tokens")) == 0
    # a reading that is the first holder itself has none before it
    tried = written(sets.join(rarest, ["signature", "own"]).where("a_turn < turn").join(others, ["signature", "a_own"]).withColumn("whole", whole).drop("a_tokens"), "readings-tried")
    found = tried.where("whole").select("signature", "own", F.col("a_turn").alias("to"))

    rest = tried.where("NOT whole").drop("a_own", "a_turn", "whole").withColumn("blocks", F.ceil(F.col("n") / BLOCK).cast("int"))
    wanted = rest.select("signature", "token", "blocks").distinct()
    holders = held.join(wanted, ["signature", "token"]).withColumn("block", F.pmod(F.xxhash64("own"), F.col("blocks")).cast("int"))
    holders = holders.select("signature", "token", "block", F.col("own").alias("a_own"), F.col("turn").alias("a_turn"), F.col("size").alias("a_size"), F.col("sketch").alias("a_sketch"))
    covers = F.col("a_size") >= F.col("size")
    for k in range(4):
        covers = covers & (F.get("sketch", F.lit(k)).bitwiseAND(F.bitwise_not(F.get("a_sketch", F.lit(k)))) == 0)
    rest = rest.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    pairs = rest.select("signature", "own", "turn", "size", "sketch", "token", "block").join(holders, ["signature", "token", "block"]).where((F.col("a_turn") < F.col("turn")) & covers)
    pairs = pairs.select("signature", "own", "a_own", "a_turn").join(sets.select("signature", "own", "tokens"), ["signature", "own"]).join(others, ["signature", "a_own"]).where(whole)
    later = pairs.groupBy("signature", "own").agg(F.min("a_turn").alias("to"))
    return plain.unionByName(found).unionByName(later)


def duplicates(corpus: Corpus) -> DataFrame:
    """(id, survivor) of each poem that goes.

    Keys are digests: of the lines without marks, and of the lines.  Only groups of several vocalizations
    shuffle more than keys: one set of marks a vocalization, stored once in the shared folder.
    """
    poems = poem_texts(corpus)
    turn = F.struct((-F.col("marks")).alias("m"), F.col("priority").alias("p"), F.col("id").alias("i"))
    keys = written(poems.select("id", "signature", "own", turn.alias("turn")), "poem-keys")  # read by several joins
    # poems of equal lines differ in nothing: each of them has the first one as its survivor
    firsts = keys.groupBy("signature", "own").agg(F.min("turn").alias("turn"), F.count(F.lit(1)).alias("copies"))
    # the first in turn of all that hold a poem's marks is never one that goes: what held its marks would come before it
    targets = supersets(written(readings_of(corpus.lines, firsts), "readings"))
    targets = firsts.join(targets, ["signature", "own"], "left").where("copies > 1 OR to IS NOT NULL")
    targets = targets.select("signature", "own", F.coalesce("to.i", "turn.i").alias("survivor"))
    return keys.join(targets, ["signature", "own"]).where(F.col("id") != F.col("survivor")).select("id", "survivor")


def deduplicated(corpus: Corpus) -> Corpus:
    """The corpus without the poems that go, which become aliases of their survivors."""
    if not corpus.poem_alias.isEmpty():
        raise ValueError("the corpus has aliases already: it has been deduplicated")
    gone = duplicates(corpus)
    none = [F.lit(None).cast("string").alias(c) for c in ("poet", "book", "page", "type")]
    alias = corpus.poem.join(gone, "id").select("id", F.col("survivor").alias("poem_id"), "source_url", "source_id", *none)
    poem = corpus.poem.join(gone, "id", "left_anti")
    lines = corpus.lines.join(gone.select(F.col("id").alias("poem_id")), "poem_id", "left_anti")
    return replace(corpus, poem=poem, lines=lines.select(corpus.lines.columns), poem_alias=alias)
