"""Raw poems that arrive as files, as a stream of indexed lines.

The derived columns are functions of one line, so the stream keeps no state: a
restart goes on from the checkpoint, and each file is read once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import strip_all, strip_punct
from ..operators.schema_etl import imported

RAW_SCHEMA = "id long, poet_name string, text string"


def indexed_lines(raw: DataFrame) -> DataFrame:
    """The lines of raw poems with their derived columns; for batches and streams."""
    return imported(raw)["lines"].withColumns({"plain": strip_all(F.col("line")), "stripped": strip_punct(F.col("line"))})


def start(spark: SparkSession, incoming: str, out: str, checkpoint: str, at_once: bool = False):
    """The running query; ``at_once`` takes what is there and ends."""
    lines = indexed_lines(spark.readStream.schema(RAW_SCHEMA).parquet(incoming))
    writer = lines.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if at_once else writer).start()
