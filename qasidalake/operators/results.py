"""What happens to found rows: order, groups of equal text, pages.

Results with a cap are ordered by short windows.  For results without one there are ``ranked_all``,
``sorted_all`` and ``grouped_all``: places come out of a sort by ranges and the sizes of its partitions.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import arrow as A
from ..functions.text import clean_line, without_marks
from ..sources.snapshots import written

LINE_COUNT, RELEVANCE = "line_count_desc", "relevance"


def sort_mode(name: str | None) -> str:
    return RELEVANCE if name == RELEVANCE else LINE_COUNT


def order_of(mode: str | None) -> list[Column]:
    """The order of found rows (as ``search`` returns them) under a sort mode."""
    if sort_mode(mode) == RELEVANCE:
        return [F.col("rank")]
    return [F.col("source_rank"), F.col("line_count").desc(), F.col("tightness").desc(), F.col("rank")]


def sorted_results(found: DataFrame, mode: str | None = None) -> DataFrame:
    """With ``position``, from 0; found rows are capped, so their order is one short window."""
    if "rank" not in found.columns:
        raise ValueError("rows without a rank have no cap: use sorted_all")
    return found.withColumn("position", F.row_number().over(Window.orderBy(*order_of(mode))) - 1)


def positions(rows: DataFrame, order: list[Column], name: str) -> DataFrame:
    """With ``name``, the place of each row in ``order``, from 0; ``order`` should tell all rows apart.

    Rows are dealt out by ranges and sorted there, written once with their places in their partitions, and read
    again; a partition's first place is the sum of the sizes of those before it.
    """
    within, part = f"{name}_within", f"{name}_part"
    rows = written(rows, f"{name}-found")  # a deal by ranges reads its input twice
    numbered = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(within, F.monotonically_increasing_id())
    stored = written(numbered.withColumns({part: F.shiftright(within, 33), within: F.col(within).bitwiseAND(F.lit((1 << 33) - 1))}), name)
    sizes = stored.groupBy(part).agg(F.count(F.lit(1)).alias("size"))  # a row for each partition
    before = F.sum("size").over(Window.orderBy(part)) - F.col("size")
    return stored.join(F.broadcast(sizes.select(part, before.alias("before"))), part).withColumn(name, F.col(within) + F.col("before")).select(*rows.columns, name)


def _own_id(found: DataFrame) -> str:
    return "line_id" if "line_id" in found.columns else "poem_id"


def ranked_all(found: DataFrame) -> DataFrame:
    """Results without a cap, with the rank that a search gives: by source, tightness and id, from 1."""
    order = [F.col("source_rank"), F.desc("tightness"), F.col(_own_id(found))]
    return positions(found.drop("rank"), order, "rank").withColumn("rank", F.col("rank") + 1)


def sorted_all(found: DataFrame, mode: str | None = None) -> DataFrame:
    """Results without a cap, with ``position``, from 0."""
    by_lines = [] if sort_mode(mode) == RELEVANCE else [F.desc("line_count")]
    return positions(found.drop("rank"), [F.col("source_rank"), *by_lines, F.desc("tightness"), F.col(_own_id(found))], "position")


def with_group_key(found: DataFrame, text_col: str) -> DataFrame:
    """With ``group_key``, a digest of what texts of one group share, so that rows can be placed without their texts."""
    return found.withColumn("group_key", F.md5(A.without_marks(A.clean_line(F.col(text_col))).cast("binary")))


def grouped_all(ordered: DataFrame, text_col: str | None = None) -> DataFrame:
    """As ``grouped``, for any number of rows; ``duplicates`` counts the rest of a group, which may be large.

    Without ``text_col`` rows have their ``group_key``.
    """
    keyed = ordered if text_col is None else with_group_key(ordered, text_col)
    shown = [c for c in keyed.columns if c not in ("position", "group_key")]
    groups = keyed.groupBy("group_key").agg(F.min(F.struct("position", *shown)).alias("shown"), (F.count(F.lit(1)) - 1).alias("duplicates"))
    return positions(groups.select("shown.*", "duplicates"), [F.col("position")], "group")


def grouped(ordered: DataFrame, text_col: str) -> DataFrame:
    """Rows of equal text (but for marks and tatweel) as one: the first is shown, the rest are counted and listed.

    Groups are numbered from 0 in the order of their first rows.
    """
    key = without_marks(clean_line(F.col(text_col)))
    first = F.min_by(F.struct(*ordered.columns), "position").alias("shown")
    groups = ordered.groupBy(key.alias("key")).agg(first, F.sort_array(F.collect_list("position")).alias("positions"))
    groups = groups.withColumn("group", F.row_number().over(Window.orderBy("shown.position")) - 1)
    return groups.select("group", "shown.*", F.slice("positions", F.lit(2), F.greatest(F.size("positions") - 1, F.lit(0))).alias("duplicates"))


@dataclass(frozen=True)
class Page:
    """Which titles and lines a page shows; titles come first."""

    page: int
    pages: int
    titles: tuple[int, int]
    lines: tuple[int, int]

    @classmethod
    def of(cls, titles: int, lines: int, page: int, size: int = 100) -> Page:
        pages = max(1, -(-(titles + lines) // size))
        page = min(max(page, 0), pages - 1)
        lo, hi = page * size, min((page + 1) * size, titles + lines)
        inside = lambda x, most: min(max(x, 0), most)
        return cls(page, pages, (inside(lo, titles), inside(hi, titles)), (inside(lo - titles, lines), inside(hi - titles, lines)))


def page_rows(title_groups: DataFrame, line_groups: DataFrame, page: int, size: int = 100) -> DataFrame:
    """The rows that a page shows, with their section and group."""
    counts = [df.count() for df in (title_groups, line_groups)]
    shown = Page.of(*counts, page, size)
    parts = []
    for section, df, (lo, hi) in (("title", title_groups, shown.titles), ("line", line_groups, shown.lines)):
        parts.append(df.where((F.col("group") >= lo) & (F.col("group") < hi)).withColumn("section", F.lit(section)))
    return parts[0].unionByName(parts[1], allowMissingColumns=True)
