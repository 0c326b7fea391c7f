"""Small frames made of driver-side values."""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema


def small_table(spark: SparkSession, rows: Sequence[tuple], schema: str) -> DataFrame:
    """A local relation of ``rows``, for parameter tables whose size does not grow with the data."""
    columns = T.StructType.fromDDL(schema)
    arrow = to_arrow_schema(columns)
    values = list(zip(*rows)) if rows else [()] * len(columns)
    arrays = [pa.array(list(column), type=kind.type) for column, kind in zip(values, arrow)]
    return spark.createDataFrame(pa.Table.from_arrays(arrays, schema=arrow), schema=columns)


def pin(df: DataFrame) -> DataFrame:
    """Evaluate a frame of a few rows now, so that later uses do not recompute it."""
    return small_table(
        df.sparkSession,
        [tuple(row) for row in df.collect()],
        ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema),
    )
