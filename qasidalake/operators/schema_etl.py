"""From flat poem rows to the corpus tables: lookup tables, ids, URL suffixes, imports, and their checks."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.arrow import verses
from ..functions.text import title_of
from ..sources.batches import BATCH, batches_written, in_batches
from ..sources.corpus import SOURCES, Corpus, line_id
from ..sources.snapshots import written


def names_of(rows: DataFrame, column: str) -> DataFrame:
    """(id, name): the distinct values that are neither null nor empty, numbered by name.

    Ids follow the order of the names.  Names are numbered among those of the same
    first characters, of which only the counts meet in one task.
    """
    names = rows.select(F.col(column).alias("name")).where((F.col("name") != "")).distinct().withColumn("lead", F.substring("name", 1, 3))
    before = Window.orderBy("lead").rowsBetween(Window.unboundedPreceding, -1)
    counts = names.groupBy("lead").agg(F.count(F.lit(1)).alias("n")).select("lead", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    nth = F.row_number().over(Window.partitionBy("lead").orderBy("name"))
    return names.withColumn("nth", nth).join(counts, "lead").select((F.col("before") + F.col("nth")).cast("long").alias("id"), "name")


def with_ids(rows: DataFrame, column: str, names: DataFrame) -> DataFrame:
    """``column`` replaced by ``<column>_id``, null where it has no name."""
    return rows.join(names.select(F.col("name").alias(column), F.col("id").alias(f"{column}_id")), column, "left").drop(column)


def source_of_url(url: Column) -> Column:
    """The first source whose prefix the URL has."""
    return F.coalesce(*(F.when(url.startswith(prefix), F.lit(i)) for i, _, prefix in SOURCES if prefix))


def source_of_name(name: Column) -> Column:
    return F.coalesce(*(F.when(name == shown, F.lit(i)) for i, shown, _ in SOURCES))


def url_suffix(source_id: Column, url: Column) -> Column:
    """The URL without its source's prefix, by length alone."""
    cut = url
    for i, _, prefix in SOURCES:
        if prefix:
            cut = F.when(source_id == i, F.substring(url, len(prefix) + 1, 1 << 30)).otherwise(cut)
    return cut


def suffix_collisions(poem: DataFrame) -> DataFrame:
    """(source_id, suffix, count, ids) of URLs that would be one after cutting."""
    known = [i for i, _, prefix in SOURCES if prefix]
    rows = poem.where(F.col("source_url").isNotNull() & F.col("source_id").isin(known))
    rows = rows.groupBy("source_id", url_suffix(F.col("source_id"), F.col("source_url")).alias("suffix"))
    rows = rows.agg(F.count(F.lit(1)).alias("count"), F.sort_array(F.collect_list("id")).alias("ids"))
    return rows.where("count > 1")


def colliding_poems(poem: DataFrame) -> DataFrame:
    """(id, source_id, suffix, count) of each poem whose URL would be another's after cutting: groups of any size."""
    known = [i for i, _, prefix in SOURCES if prefix]
    rows = poem.where(F.col("source_url").isNotNull() & F.col("source_id").isin(known))
    rows = rows.select("id", "source_id", url_suffix(F.col("source_id"), F.col("source_url")).alias("suffix"))
    counts = rows.groupBy("source_id", "suffix").agg(F.count(F.lit(1)).alias("count")).where("count > 1")
    return rows.join(counts, ["source_id", "suffix"]).select("id", "source_id", "suffix", "count")


class BackfillError(ValueError):
    """Rows could not be given the ids of their names."""


def normalized_metadata(poem: DataFrame, alias: DataFrame) -> dict[str, DataFrame]:
    """Tables poem, poem_alias, book and type out of rows that carry names and whole URLs.

    ``poem`` has book, type, source_name and source_url as text.  Raises
    ``BackfillError`` if a source is not known or if cut URLs would collide.
    """
    book, kind = names_of(poem, "book"), names_of(poem, "type")
    poem = with_ids(with_ids(poem, "book", book), "type", kind)
    poem, alias = (df.withColumn("source_id", source_of_name(F.col("source_name"))).drop("source_name") for df in (poem, alias))
    for name, df in (("poem", poem), ("poem_alias", alias)):
        missing = df.where(F.col("source_id").isNull()).count()
        if missing:
            raise BackfillError(f"{name}.source_id: {missing} rows without a source")
    if not (same := suffix_collisions(poem)).isEmpty():
        raise BackfillError(f"source_url: {same.count()} suffixes stand for several poems")
    cut = lambda df: df.withColumn("source_url", url_suffix(F.col("source_id"), F.col("source_url")))
    return {"poem": cut(poem), "poem_alias": cut(alias), "book": book, "type": kind}


def normalized_poets(poem: DataFrame) -> dict[str, DataFrame]:
    """Tables poem and poet out of rows that carry the poet's name."""
    poet = names_of(poem, "poet")
    return {"poem": with_ids(poem, "poet", poet), "poet": poet}


def without_alias_title(alias: DataFrame) -> tuple[DataFrame, int]:
    """The aliases without their title, and the characters that saves."""
    saved = alias.agg(F.sum(F.length("title"))).first()[0] or 0
    return alias.drop("title"), saved


def column_drift(df: DataFrame, expected) -> tuple[set[str], set[str]]:
    """Columns that are missing, and columns that are not expected."""
    own, wanted = set(df.columns), set(expected)
    return wanted - own, own - wanted


def broken_references(corpus: Corpus) -> DataFrame:
    """(reference, rows): how many rows point to nothing, for each reference between the tables."""
    checks = [("lines.poem_id", corpus.lines, "poem_id", corpus.poem), ("poem_alias.poem_id", corpus.poem_alias, "poem_id", corpus.poem)]
    checks += [(f"poem.{n}_id", corpus.poem, f"{n}_id", getattr(corpus, n)) for n in ("poet", "book", "type", "source")]
    out = None
    for name, rows, column, to in checks:
        lost = rows.where(F.col(column).isNotNull()).join(to.select(F.col("id").alias(column)), column, "left_anti")
        count = lost.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("reference"), "rows")
        out = count if out is None else out.unionByName(count)
    return out


def imported(raw: DataFrame) -> dict[str, DataFrame]:
    """Tables poem (with the poet's name) and lines out of raw poems (id, poet_name, text).

    Texts without a verse are left out; ids are the raw ones, a line's id is its
    poem's times 100000 plus its place.
    """
    rows = raw.where(F.col("text") != "").withColumn("verses", verses(F.col("text"))).where(F.size("verses") > 0)
    poem = rows.select(
        "id",
        F.when(F.col("poet_name") != "", F.col("poet_name")).alias("poet"),
        F.lit(None).cast("string").alias("source_url"),
        title_of(F.col("verses")).alias("title"),
        F.lit(None).cast("string").alias("page"),
        F.size("verses").alias("line_count"),
        F.lit(None).cast("long").alias("book_id"),
        F.lit(None).cast("long").alias("type_id"),
        F.lit(len(SOURCES) - 1).alias("source_id"),
    )
    lines = rows.select("id", F.posexplode("verses").alias("at", "line")).select(
        line_id(F.col("id"), F.col("at")).alias("id"), F.col("id").alias("poem_id"), "line", (F.col("at") + 1).alias("line_number"), F.lit("").alias("line_type")
    )
    return {"poem": poem, "lines": lines}


def with_imported(corpus: Corpus, raw: DataFrame) -> Corpus:
    """The corpus with the raw poems; poets not known yet follow the highest id, by name."""
    return with_tables(corpus, imported(raw))


def imported_in_batches(raw: DataFrame, folder: str, batch: int = BATCH, progress=None) -> dict[str, DataFrame]:
    """The tables of ``imported``, written in ranges of ids; after a failure the next call goes on after the last range."""
    in_batches(raw, folder, imported, batch=batch, progress=progress)
    found = {name: batches_written(raw.sparkSession, folder, name) for name in ("poem", "lines")}
    return imported(raw.limit(0)) if None in found.values() else found


def with_tables(corpus: Corpus, new: dict[str, DataFrame]) -> Corpus:
    """The corpus with tables that ``imported`` made."""
    known = corpus.poet.select(F.col("name").alias("poet"))
    unknown = new["poem"].select("poet").where("poet IS NOT NULL").distinct().join(known, "poet", "left_anti")
    unknown = written(unknown, "poets-unknown")  # numbered by two jobs, which else both read the texts
    highest = corpus.poet.agg(F.coalesce(F.max("id"), F.lit(0)).alias("highest"))
    added = names_of(unknown, "poet").crossJoin(F.broadcast(highest))  # one row
    poet = corpus.poet.unionByName(added.select((F.col("highest") + F.col("id")).alias("id"), "name"))
    poem = with_ids(new["poem"], "poet", poet).select("id", "poet_id", "source_url", "title", "page", "line_count", "book_id", "type_id", "source_id")
    return replace(corpus, poet=poet, poem=corpus.poem.unionByName(poem, allowMissingColumns=True), lines=corpus.lines.unionByName(new["lines"], allowMissingColumns=True))
