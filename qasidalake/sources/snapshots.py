"""Tables under snapshot numbers: written beside the old ones, taken over by one small file that is created last.

A folder holds ``data-*`` folders and a file for each snapshot, named by its number, with
the snapshot's description as JSON.  The highest number counts.  A run that fails, or that is overtaken by
another one, leaves the old snapshot as it is.
"""

from __future__ import annotations

import json
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Overtaken(RuntimeError):
    """Another run has made the snapshot that was to be made."""


def shared_folder(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; only a local session (as in tests) may do without and takes a temporary one."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="qasidalake-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def written(df: DataFrame, tag: str) -> DataFrame:
    """``df`` written as Parquet in the shared folder and read again, which cuts its lineage."""
    path = f"{shared_folder(df.sparkSession)}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fingerprint(table: DataFrame) -> str:
    """Of the files that a table is read from: how many, and a digest of their paths, sizes and times, in any order."""
    files = table.select("_metadata.file_path", "_metadata.file_size", "_metadata.file_modification_time").distinct()
    each = F.xxhash64("file_path", "file_size", "file_modification_time")
    found = files.agg(F.count(F.lit(1)).alias("n"), F.sum(each.cast("decimal(20,0)")).alias("total"), F.bit_xor(each).alias("mixed")).head()
    return f"{found['n']}:{found['total']}:{found['mixed']}"


class Snapshots:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self._fs = self._path("").getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}" if name else self.folder)

    def _described(self, number: int) -> dict | None:
        stream = self._fs.open(self._path(str(number)))
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        except ValueError:  # begun and not ended
            return None
        finally:
            stream.close()

    def latest(self) -> tuple[int, dict | None]:
        """The number and the description of the snapshot that counts; 0 and None before the first."""
        if not self._fs.exists(self._path("")):
            return 0, None
        names = [s.getPath().getName() for s in self._fs.listStatus(self._path(""))]
        for number in sorted((int(n) for n in names if n.isdigit()), reverse=True):
            if found := self._described(number):
                return number, found
        return 0, None

    def commit(self, after: int, write) -> dict:
        """A new snapshot to follow number ``after``: ``write(folder)`` writes its tables and returns its description."""
        data = f"data-{uuid.uuid4().hex}"
        try:
            found = {**write(f"{self.folder}/{data}"), "data": data}
            try:
                stream = self._fs.create(self._path(str(after + 1)), False)
            except Exception as e:
                if "AlreadyExists" not in str(e):
                    raise
                raise Overtaken(f"snapshot {after + 1} of {self.folder} is there already") from None
            stream.write(bytearray(json.dumps(found).encode()))
            stream.close()
        except BaseException:
            self._fs.delete(self._path(data), True)
            raise
        return found
