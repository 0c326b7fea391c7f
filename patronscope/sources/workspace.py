"""Intermediate tables on storage that every executor can reach."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from itertools import count

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; a temporary one only in local mode."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    folder = tempfile.mkdtemp(prefix="patronscope-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    return folder


class Workspace:
    """Writes frames that are read more than once as Parquet and returns them re-read.

    A written table cuts the lineage, outlives lost executors and, unlike a cached or checkpointed
    frame, keeps column pruning and size statistics for later reads.
    """

    def __init__(self, spark: SparkSession, root: str | None = None) -> None:
        self.spark = spark
        self.path = f"{(root or shared_folder(spark)).rstrip('/')}/run-{uuid.uuid4().hex}"
        self._numbers = count(1)

    def save(self, df: DataFrame, name: str) -> DataFrame:
        target = f"{self.path}/{next(self._numbers):02d}-{name}"
        df.write.parquet(target)
        return self.spark.read.schema(df.schema).parquet(target)

    def clear(self) -> None:
        """Remove this run's tables. Frames returned by :meth:`save` are unusable afterwards."""
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        folder.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(folder, True)
