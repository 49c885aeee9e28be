"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import re
import tempfile
import uuid

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def free_name(columns, base: str) -> str:
    """``base``, lengthened until no column has it in any letter case."""
    taken = {c.lower() for c in columns}
    while base.lower() in taken:
        base += "_"
    return base


def shared_folder(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; only a local session (as in tests) may do without and takes a temporary one."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        folder = spark.sparkContext.getCheckpointDir()
    if not folder:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="qasidalake-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def written(df: DataFrame, tag: str, tasks: int | None = None) -> DataFrame:
    """``df`` written as Parquet in the shared folder and read again, which cuts its lineage.

    ``tasks``: of the last shuffle, and so files, at most.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{tag}-{uuid.uuid4().hex}"
    (df if tasks is None else df.coalesce(max(1, tasks))).write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


class Scratch:
    """A place in the shared folder for tables that are needed for a while."""

    def __init__(self, spark: SparkSession, tag: str):
        self.spark, self.tag = spark, f"{tag}-{uuid.uuid4().hex}"

    def written(self, df: DataFrame, tag: str, tasks: int | None = None) -> DataFrame:
        return written(df, f"{self.tag}/{tag}", tasks)

    def clear(self) -> None:
        """Removes all its tables."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{shared_folder(self.spark)}/{self.tag}")
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def parts_of(batches, column: int, max_bytes: int = 4 << 20):
    """The batches in parts whose ``column`` (its place) holds about ``max_bytes`` at most, so that no task holds more as objects."""
    for batch in batches:
        yield from slices(batch, batch.schema.names[column], max_bytes)


def slices(batch: pa.RecordBatch, column: str, max_bytes: int = 4 << 20, max_rows: int = 2000):
    """Parts of a batch whose ``column`` holds about ``max_bytes`` at most (one row at least)."""
    values, start, held = batch.column(column), 0, 0
    sizes = [0 if n is None else n for n in pc.binary_length(values).to_pylist()]
    for i, n in enumerate(sizes):
        if i > start and (held + n > max_bytes or i - start >= max_rows):
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += n
    if start < len(sizes):
        yield batch.slice(start)
