"""Tables between steps, kept where the driver and all executors can read them."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Most rows of one or two numbers that are ever sent to every executor (some 32 MB).
SENDABLE_ROWS = 1_000_000


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``, or the context's checkpoint folder.

    With neither set, a local session (one machine by definition) gets a folder of its own; on a
    cluster that is an error, as no machine-local folder would do.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    named = named or spark.sparkContext.getCheckpointDir()
    if not named:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="patronscope-")
        spark.sparkContext.setCheckpointDir(named)
    return named


class Store:
    """Parquet tables under one new folder of the shared one; what is read twice goes here."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.path = f"{shared_folder(spark).rstrip('/')}/llm-{uuid.uuid4().hex}"

    def save(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.path}/{name}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)


def rows_with_keys(df: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    """Rows of ``df`` whose key is among the distinct ``keys``.

    Few keys are sent to the executors, so that ``df`` need not move; beyond ``SENDABLE_ROWS`` both
    sides are shuffled. The rows are the same either way.
    """
    few = keys.count() <= SENDABLE_ROWS
    return df.join(F.broadcast(keys) if few else keys, on, "left_semi")


def parts_for(rows: int, each: int) -> int:
    """Number of parts of about ``each`` rows."""
    return max(1, -(-rows // each))
