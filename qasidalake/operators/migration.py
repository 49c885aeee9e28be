"""Flat poems, which carry names and whole URLs, migrated to the normalized tables as one checked step.

The tables are written as a snapshot.  Each rule counts the rows that break it while its table is written; where
one has more than it may have, or a table lost or gained rows, the snapshot never counts.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..sources.corpus import SCHEMAS, SOURCES, Corpus
from ..sources.curation import Refused, store_corpus
from .schema_etl import names_of, url_suffix, with_ids

NAMES = ("poet", "book", "type")


@dataclass(frozen=True)
class Rule:
    """Rows of a poem table where ``broken`` is true break the rule; more than ``most`` of them stop the migration."""

    name: str
    broken: Column
    most: int = 0


def rules() -> list[Rule]:
    """Each poem has a source, and an id for each of its names; columns of names are still there when these are judged."""
    named = [Rule(f"poem.{n}_id", (F.col(n) != "") & F.col(f"{n}_id").isNull()) for n in NAMES]
    return [Rule("poem.id", F.col("id").isNull()), Rule("poem.source_id", F.col("source_id").isNull()), *named]


def source_like(url: Column) -> Column:
    """The source whose prefix the URL has, in either case of its letters."""
    return F.coalesce(*(F.when(F.lower(url).startswith(prefix.lower()), F.lit(i)) for i, _, prefix in SOURCES if prefix))


def source_urls(source: DataFrame) -> DataFrame:
    """The source table with the URL prefix of each source that is known; refused where it has prefixes already."""
    if "url_prefix" in source.columns:
        raise Refused("source.url_prefix is there already")
    known = source.sparkSession.createDataFrame([(i, prefix) for i, _, prefix in SOURCES], "id int, url_prefix string")
    return source.join(F.broadcast(known), "id", "left")  # a row for each source


def migrated(poem: DataFrame, lines: DataFrame, folder: str, checks: list[Rule] | None = None) -> None:
    """Stores the normalized corpus of flat poems (id, poet, book, type, title, page, line_count, source_url) and their lines.

    Sources come from the URLs, which keep only what follows the prefix.  Raises ``Refused`` with the
    broken rules and their numbers of rows (``broken``), and then stores nothing; so it does where poems have ids of poets
    already.  Empty and null names have no id; names are numbered in their order.
    """
    if "poet_id" in poem.columns:
        raise Refused("poem.poet_id is there already")
    spark, before = poem.sparkSession, {"poem": poem.count(), "lines": lines.count()}
    tables = {n: names_of(poem, n) for n in NAMES}
    rows = poem.withColumn("source_id", source_like(F.col("source_url")))
    for n in NAMES:
        rows = with_ids(rows.withColumn(f"{n}_name", F.col(n)), n, tables[n]).withColumnRenamed(f"{n}_name", n)
    metrics, checks = Observation("rules"), rules() if checks is None else checks
    rows = rows.observe(metrics, *(F.count_if(rule.broken).alias(rule.name) for rule in checks)) if checks else rows
    rows = rows.withColumn("source_url", url_suffix(F.col("source_id"), F.col("source_url")))

    def check(after: dict[str, int], stored: Corpus) -> dict[str, int]:
        found = metrics.get if checks else {}
        broken = {rule.name: found[rule.name] for rule in checks if found[rule.name] > rule.most}
        broken |= {f"{name} rows": after[name] - n for name, n in before.items() if after[name] != n}
        same = stored.poem.where("source_url IS NOT NULL").groupBy("source_id", "source_url").count().where("count > 1")
        if not broken and (suffixes := same.count()):  # reads two columns of what is written
            broken["source_url"] = suffixes
        return broken

    columns = [F.col(f.split()[0]).cast(f.split()[1]) for f in SCHEMAS["poem"].split(", ")]
    source = source_urls(spark.createDataFrame([(i, name) for i, name, _ in SOURCES], "id int, name string")).select("id", "name", "url_prefix")
    alias = spark.createDataFrame([], SCHEMAS["poem_alias"])
    store_corpus(Corpus(rows.select(*columns), lines, tables["poet"], tables["book"], tables["type"], source, alias), folder, check)
