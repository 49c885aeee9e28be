"""Curation of a stored corpus: each step writes the tables that it changes anew beside the old ones and counts as one change.

A step has a name and is carried out once; asked for again it changes nothing.  Its tables are checked
by metrics that Spark gathers while it writes them.  A step whose checks fail, that breaks off, or that another run has
overtaken leaves the corpus as it was.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Observation, SparkSession
from pyspark.sql import functions as F

from .corpus import SCHEMAS, Corpus
from .snapshots import Snapshots

#: By table, columns that may not be null.
NEEDED = {"poem": ("id",), "lines": ("id", "poem_id"), "poet": ("id", "name"), "poem_alias": ("id", "poem_id")}


class Refused(RuntimeError):
    """A step whose result breaks a rule; ``broken`` has the rows by rule, where they were counted."""

    def __init__(self, says: str, broken: dict[str, int] | None = None):
        super().__init__(says)
        self.broken = broken or {}


def _write(corpus: Corpus, folder: str, but: tuple[str, ...] = ()) -> dict[str, int]:
    """Writes all tables ``but`` some; the rows of each.  Raises ``Refused`` where a needed column is null."""
    rows = {}
    for name, table in corpus.tables().items():
        if name in but:
            continue
        metrics = Observation(name)
        gaps = [F.count_if(F.col(c).isNull()).alias(c) for c in NEEDED.get(name, ())]
        table.observe(metrics, F.count(F.lit(1)).alias("all_rows"), *gaps).write.parquet(f"{folder}/{name}.parquet")
        found = metrics.get
        rows[name] = found.pop("all_rows")
        if empty := {c: n for c, n in found.items() if n}:
            raise Refused(f"{name}: {empty} rows without a value")
    return rows


def carry_out(spark: SparkSession, folder: str, step: str, change: Callable[[Corpus], Corpus], check: Callable[[dict, dict], str | None] | None = None) -> bool:
    """Carries out a step on the stored corpus; False if it has been before.

    ``check`` gets the numbers of rows by table before and after, and says what is wrong with them, if anything.
    """
    store = Snapshots(spark, folder)
    number, before = store.latest()
    if before is not None and step in before["steps"]:
        return False

    def write(data: str) -> dict:
        old = read_stored(spark, folder)
        new = change(old)
        same = tuple(name for name in SCHEMAS if getattr(new, name) is getattr(old, name))
        rows = {name: before["rows"][name] for name in same} | _write(new, data, but=same)
        if wrong := check and check(before["rows"], rows):
            raise Refused(f"{step}: {wrong}")
        return {"rows": rows, "steps": [*before["steps"], step], "input": before.get("input"), "at": {name: _at(before, name) for name in same}}

    if before is None:
        raise ValueError(f"no corpus is stored in {folder}")
    store.commit(number, write)
    return True


def store_corpus(corpus: Corpus, folder: str, check: Callable[[dict, Corpus], dict[str, int]] | None = None, input: str | None = None) -> None:
    """The first snapshot of a folder, or one that replaces all before; ``input`` names the state of what it was made of.

    ``check`` gets the numbers of rows by table and the tables as written; the rules that it names with their rows stop the step.
    """
    spark = corpus.lines.sparkSession
    store = Snapshots(spark, folder)

    def write(data: str) -> dict:
        rows = _write(corpus, data)
        if broken := check and check(rows, _read(spark, data)):
            raise Refused(f"rules broken, with their rows: {broken}", broken)
        return {"rows": rows, "steps": [], "input": input}

    store.commit(store.latest()[0], write)


def _at(found: dict, table: str) -> str:
    """The folder that holds a table of a snapshot: that of the last step which changed it."""
    return found.get("at", {}).get(table, found["data"])


def _read(spark: SparkSession, folder: str) -> Corpus:
    return Corpus(**{name: spark.read.parquet(f"{folder}/{name}.parquet") for name in SCHEMAS})


def read_stored(spark: SparkSession, folder: str) -> Corpus:
    _, found = Snapshots(spark, folder).latest()
    return Corpus(**{name: spark.read.parquet(f"{folder}/{_at(found, name)}/{name}.parquet") for name in SCHEMAS})


def is_stored(spark: SparkSession, folder: str, input: str) -> bool:
    _, found = Snapshots(spark, folder).latest()
    return found is not None and found.get("input") == input


def open_stored(spark: SparkSession, folder: str, build: Callable[[], Corpus], input: str) -> Corpus:
    """The stored corpus, if it was made of this input; otherwise that of ``build()``, stored first."""
    if not is_stored(spark, folder, input):
        store_corpus(build(), folder, input=input)
    return read_stored(spark, folder)
