"""Browsing a corpus: poets, poems, their sources and lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.search import search_entries
from ..sources.corpus import Corpus


def poets_by_count(corpus: Corpus) -> DataFrame:
    """(id, name, poems), most poems first, then by name; poets without poems count 0."""
    poem = corpus.poem.select("poet_id", F.col("id").alias("poem_id"))
    counted = corpus.poet.join(poem, F.col("id") == F.col("poet_id"), "left").groupBy("id", "name").agg(F.count("poem_id").alias("poems"))
    return counted.orderBy(F.col("poems").desc(), "name")


def poem_count_for(corpus: Corpus, name: str) -> DataFrame:
    """(poems): how many poems one poet has, in one row; 0 where no poet is named so."""
    own = corpus.poet.where(F.col("name") == name).select(F.col("id").alias("poet_id"))
    return corpus.poem.join(own, "poet_id", "left_semi").agg(F.count(F.lit(1)).alias("poems"))


def search_poets(corpus: Corpus, query: str) -> DataFrame:
    return search_entries(corpus.poet.withColumnRenamed("name", "original"), query) if query else corpus.poet.withColumnRenamed("name", "original")


def full_url(prefix: Column, suffix: Column) -> Column:
    return F.when(prefix.isNotNull() & suffix.isNotNull(), F.concat(prefix, suffix)).otherwise(suffix)


def poems(corpus: Corpus) -> DataFrame:
    """Poems with the names of their poet, book, type and source, and whole URLs."""
    out = corpus.poem.select("id", "title", "page", "line_count", "source_url", "source_id", "poet_id", "book_id", "type_id")
    for name in ("poet", "book", "type"):
        table = getattr(corpus, name).select(F.col("id").alias(f"{name}_id"), F.col("name").alias(name))
        out = out.join(table, f"{name}_id", "left")
    source = corpus.source.select(F.col("id").alias("source_id"), F.col("name").alias("source"), "url_prefix")
    out = out.join(F.broadcast(source), "source_id", "left")  # a row for each source
    texts = [F.coalesce(c, F.lit("")).alias(c) for c in ("title", "poet")]
    return out.select("id", *texts, "book", "type", "page", F.coalesce("line_count", F.lit(0)).alias("line_count"), "source", full_url(F.col("url_prefix"), F.col("source_url")).alias("url"))


def poem_by_id(corpus: Corpus, poem_id: int) -> DataFrame:
    return poems(corpus).where(F.col("id") == poem_id)


def poems_by_poet(corpus: Corpus, name: str) -> DataFrame:
    return poems(corpus).where(F.col("poet") == name).orderBy("id")


def lines_of_poem(corpus: Corpus, poem_id: int) -> DataFrame:
    return corpus.lines.where(F.col("poem_id") == poem_id).orderBy("line_number", "id")


def sources_of_poems(corpus: Corpus) -> DataFrame:
    """(poem_id, place, source, url): every source of each poem once, its own first, with the first URL known."""
    own = corpus.poem.select(F.col("id").alias("poem_id"), "source_id", "source_url", F.lit(-1).cast("long").alias("turn"))
    rows = own.unionByName(corpus.poem_alias.select("poem_id", "source_id", "source_url", F.col("id").alias("turn")))
    source = corpus.source.select(F.col("id").alias("source_id"), F.col("name").alias("source"), "url_prefix")
    rows = rows.join(F.broadcast(source), "source_id")  # a row for each source
    url = F.when(F.col("source_url") != "", F.concat(F.coalesce("url_prefix", F.lit("")), "source_url"))
    rows = rows.withColumn("url", url).groupBy("poem_id", "source").agg(F.min("turn").alias("turn"), F.min_by("url", F.when(F.col("url").isNotNull(), F.col("turn"))).alias("url"))
    return rows.withColumn("place", F.row_number().over(Window.partitionBy("poem_id").orderBy("turn", "source"))).select("poem_id", "place", "source", "url")


def line_groups(lines: DataFrame) -> DataFrame:
    """With ``group`` and ``variant``: runs of one line number in a poem are readings of one line, the first is 0."""
    in_order = Window.partitionBy("poem_id").orderBy("line_number", "id")
    new = (~F.col("line_number").eqNullSafe(F.lag("line_number").over(in_order))) | (F.row_number().over(in_order) == 1)
    rows = lines.withColumn("group", F.sum(new.cast("int")).over(in_order) - 1)
    return rows.withColumn("variant", F.row_number().over(Window.partitionBy("poem_id", "group").orderBy("line_number", "id")) - 1)


def copy_text(lines: DataFrame) -> DataFrame:
    """(poem_id, text): the first readings of a poem's lines, one below the other."""
    first = line_groups(lines).where("variant = 0").groupBy("poem_id").agg(F.sort_array(F.collect_list(F.struct("group", "line"))).alias("all"))
    return first.select("poem_id", F.array_join(F.transform("all", lambda x: x["line"]), "\n").alias("text"))
