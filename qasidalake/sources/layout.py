"""A physical layout for searches that go source by source: wide rows, partitioned by source, each file sorted by id.

Each title and each line stands once for every source that holds its poem, together with what a search shows
of the poem and its poet.  So a search of one source reads one partition and joins nothing, and the cap
on candidates, which goes by id, meets sorted files.  The poem's columns repeat from line to line, which
Parquet's dictionaries and runs make cheap; lines of poems that several sources hold are stored several times.
Of the columns that searches read, ``plain`` is stored, which the scan filters by; ``stripped`` is made of the candidates' originals.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.arrow import strip_all
from .snapshots import Snapshots

#: Of the columns; a layout of another version is written anew.
LAYOUT_VERSION = "2"
TABLES = ("lines", "titles")
#: Bytes of a row group, small enough that the rows of a poem are a small part of a file.
ROW_GROUP = 8 << 20


@dataclass(frozen=True)
class BySource:
    """``lines`` and ``titles`` with their source_id, where they are stored, and the ids of all sources that have rows."""

    lines: DataFrame | None
    titles: DataFrame | None
    sources: tuple[int, ...]


def with_plain(rows: DataFrame) -> DataFrame:
    return rows if "plain" in rows.columns else rows.withColumn("plain", strip_all(F.col("original")))


def write_by_source(rows: DataFrame, path: str) -> list[int]:
    """Writes rows (source_id, row_id, original ...), which come dealt out and in order, with ``plain``; the sources found."""
    wide = with_plain(rows)
    wide.write.partitionBy("source_id").option("parquet.block.size", ROW_GROUP).option("compression", "zstd").parquet(path)
    stored = rows.sparkSession.read.schema(wide.schema).parquet(path)
    return sorted(r["source_id"] for r in stored.select("source_id").distinct().collect())  # a row for each source


def open_by_source(spark: SparkSession, folder: str, build, input: str | None = None, names: tuple[str, ...] = TABLES) -> BySource:
    """The stored layout of this version and input; where there is none, that of the rows of ``build()``, a DataFrame for each of ``names``.

    ``input`` names the state of what ``build`` reads; None takes any.  A run that fails leaves the snapshot before as it is.
    """
    store = Snapshots(spark, folder)
    number, found = store.latest()
    if found is None or found["version"] != LAYOUT_VERSION or input is not None and found["input"] != input or not {*names} <= {*found["schemas"]}:
        rows = build()

        def write(data: str) -> dict:
            known = {s for name in names for s in write_by_source(rows[name], f"{data}/{name}.parquet")}
            schemas = {name: with_plain(rows[name]).schema.json() for name in names}
            return {"version": LAYOUT_VERSION, "input": input, "sources": sorted(known), "schemas": schemas}

        found = store.commit(number, write)
    tables = {n: spark.read.schema(StructType.fromJson(json.loads(found["schemas"][n]))).parquet(f"{folder}/{found['data']}/{n}.parquet") for n in names}
    return BySource(**dict.fromkeys(TABLES) | tables, sources=tuple(found["sources"]))
