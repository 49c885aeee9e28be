"""Work over a table in ranges of ids, each written once; a run that broke off goes on after the last range.

The state is a row of snapshots: the ranges that are planned, those that are done, and the folder of each.  Bounds are
planned for the ids that lie after the last range, so rows with higher ids that arrive later make further ranges.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .snapshots import Snapshots

#: Rows of a range, about.
BATCH = 1_000_000
#: Below every id.
LEAST = -(1 << 62)


def planned(rows: DataFrame, id_col: str, batch: int) -> tuple[list[int], int]:
    """Upper bounds of ranges of about ``batch`` rows, the last one being the highest id, and the number of rows."""
    n, top = rows.agg(F.count(F.lit(1)), F.max(id_col)).head()
    if not n:
        return [], 0
    if top is None:  # no row has an id
        return [LEAST], n
    parts = math.ceil(n / batch)
    shares = [k / parts for k in range(1, parts)]
    inner = rows.agg(F.percentile_approx(id_col, shares, 10 * parts).alias("bounds")).head()["bounds"] if shares else []
    return sorted({*inner, top}), n


def _within(column: str, low: int | None, high: int) -> Column:
    """Ids after ``low`` up to ``high``; the first range takes rows without an id too."""
    held = F.col(column) <= high
    return held | F.col(column).isNull() if low is None else held & (F.col(column) > low)


def in_batches(rows: DataFrame, folder: str, work: Callable[[DataFrame], dict[str, DataFrame]], id_col: str = "id", batch: int = BATCH, progress: Callable[[int, int], None] | None = None) -> int:
    """Writes the tables that ``work`` makes of each range of rows; returns how many ranges this run has written.

    ``work`` must treat a row alike whatever the others of its range are.  Ids are whole numbers; rows of one id are in one range.
    Rows that are added under ids that a finished range covers are not seen.  ``progress`` gets the ranges done and planned.
    """
    spark, ran = rows.sparkSession, 0
    store = Snapshots(spark, folder)
    while True:
        number, found = store.latest()
        found = found or {"bounds": [], "done": []}
        done, bounds = found["done"], found["bounds"]
        low = bounds[len(done) - 1] if done else None
        if len(done) == len(bounds):
            later = rows if low is None else rows.where(F.col(id_col) > low)
            more, _ = planned(later, id_col, batch)
            if not more:
                return ran
            bounds = bounds + more
        part = rows.where(_within(id_col, low, bounds[len(done)]))

        def write(data: str) -> dict:
            for name, table in work(part).items():
                table.write.parquet(f"{data}/{name}.parquet")
            return {"bounds": bounds, "done": [*done, data.rsplit("/", 1)[-1]]}

        store.commit(number, write)
        ran += 1
        if progress:
            progress(len(done) + 1, len(bounds))


def batches_written(spark: SparkSession, folder: str, name: str) -> DataFrame | None:
    """A table out of all ranges that are done; None where there is none."""
    _, found = Snapshots(spark, folder).latest()
    if not found or not found["done"]:
        return None
    return spark.read.parquet(*(f"{folder}/{data}/{name}.parquet" for data in found["done"]))
