"""Readers for raw transaction lines."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

TRANSACTIONS = T.StructType(
    [
        T.StructField("invoice_no", T.StringType()),
        T.StructField("invoice_ts", T.TimestampNTZType()),
        T.StructField("customer_id", T.LongType()),
        T.StructField("quantity", T.IntegerType()),
        T.StructField("unit_price", T.DecimalType(18, 4)),
    ]
)

# Folder column of transactions stored by month.
MONTH = "invoice_month"

# Column names of the published retail file.
PUBLISHED_NAMES = {
    "invoice_no": "InvoiceNo",
    "invoice_ts": "InvoiceDate",
    "customer_id": "CustomerID",
    "quantity": "Quantity",
    "unit_price": "UnitPrice",
}


# The columns read from the order and event tables, declared so that no job infers them.
ORDER_TABLES = {
    "lineitem": (
        "l_orderkey bigint, l_partkey bigint, l_linenumber int, l_quantity double, "
        "l_returnflag string"
    ),
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderdate timestamp_ntz",
    "part": "p_partkey bigint, p_brand string, p_retailprice double",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double",
}


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.schema(ORDER_TABLES[name]).parquet(f"{folder}/{name}.parquet")


def canonical(tx: DataFrame, *labels: str) -> DataFrame:
    """Select the five transaction columns, under their own or their published names, and labels."""
    present = set(tx.columns)
    picked, missing = [], []
    for name, published in PUBLISHED_NAMES.items():
        if name in present:
            picked.append(F.col(name))
        elif published in present:
            picked.append(F.col(published).alias(name))
        else:
            missing.append(published)
    if missing:
        raise ValueError(f"transaction columns missing: {', '.join(missing)}")
    return tx.select(*picked, *labels)


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    """Transactions from Parquet; other columns in the files are never read."""
    return canonical(spark.read.parquet(path))


def write_by_month(tx: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Write transactions as Parquet in one folder per month of sale, ``invoice_month=yyyy-MM``.

    Columns take the types of ``TRANSACTIONS``. Rows are ranged by month and time, so a month is written by few tasks, a large one by several,
    and files within it cover short spans of time. Lines without a time go to a folder of their own.
    """
    declared = [F.col(f.name).cast(f.dataType).alias(f.name) for f in TRANSACTIONS]
    dated = canonical(tx).select(*declared).withColumn(
        MONTH, F.expr("date_format(invoice_ts, 'yyyy-MM')")
    )
    ranged = dated.repartitionByRange(MONTH, "invoice_ts", "invoice_no")
    ranged.write.mode(mode).partitionBy(MONTH).parquet(path)


def read_between(
    spark: SparkSession, path: str, since: dt.datetime, until: dt.datetime
) -> DataFrame:
    """Transactions of ``write_by_month`` at or after ``since`` and before ``until``.

    Folders of other months aren't listed for reading, and files and row groups outside the span are
    skipped by their statistics.
    """
    schema = T.StructType([*TRANSACTIONS.fields, T.StructField(MONTH, T.StringType())])
    tx = spark.read.schema(schema).parquet(path)
    return tx.where(
        f"{MONTH} between '{since:%Y-%m}' and '{until:%Y-%m}'"
        f" and invoice_ts >= timestamp_ntz'{since}' and invoice_ts < timestamp_ntz'{until}'"
    ).drop(MONTH)


def read_csv(spark: SparkSession, path: str, timestamp_format: str | None = None) -> DataFrame:
    """Transactions from CSV with a header line.

    Columns are found by header name, so files may hold others. Values are cast, not inferred.
    Customer ids written as floating numbers (``17850.0``) are accepted.
    """
    raw = canonical(spark.read.option("header", True).csv(path))
    when = F.trim("invoice_ts")
    stamp = (
        F.to_timestamp_ntz(when, F.lit(timestamp_format))
        if timestamp_format
        else when.cast(T.TimestampNTZType())
    )
    return raw.select(
        "invoice_no",
        stamp.alias("invoice_ts"),
        F.trim("customer_id").cast(T.DecimalType(24, 4)).cast(T.LongType()).alias("customer_id"),
        F.trim("quantity").cast(T.IntegerType()).alias("quantity"),
        F.trim("unit_price").cast(T.DecimalType(18, 4)).alias("unit_price"),
    )


def from_order_tables(spark: SparkSession, folder: str) -> DataFrame:
    """Transactions derived from the tables ``lineitem``, ``orders`` and ``part`` under ``folder``.

    Some lines are turned into cancellations, anonymous sales, returns and free items, so that every
    cleaning rule has rows to act on. The joins carry no hints: Spark broadcasts ``part`` or
    ``orders`` when their measured size allows it and sorts and merges otherwise.
    """
    lines = _table(spark, folder, "lineitem")
    orders = _table(spark, folder, "orders")
    parts = _table(spark, folder, "part")
    joined = lines.join(orders, lines.l_orderkey == orders.o_orderkey).join(
        parts, lines.l_partkey == parts.p_partkey
    )
    return joined.selectExpr(
        "if(l_returnflag = 'R', 'C', '') || cast(o_orderkey as string) as invoice_no",
        "o_orderdate as invoice_ts",
        "if(o_custkey % 97 <> 0, o_custkey, null) as customer_id",
        "cast(if(l_linenumber = 7 and l_quantity < 5, -l_quantity, l_quantity) as int) as quantity",
        "if(l_linenumber = 6 and l_quantity < 5, 0, cast(p_retailprice as decimal(18, 2))) "
        "as unit_price",
        "p_brand as brand",
    )


def from_events(spark: SparkSession, folder: str) -> DataFrame:
    """Purchases in the table ``events`` as transactions with a time of day."""
    events = _table(spark, folder, "events")
    return events.where("event_type = 'purchase'").selectExpr(
        "cast(event_id as string) as invoice_no",
        "ts as invoice_ts",
        "user_id as customer_id",
        "1 as quantity",
        "cast(value as decimal(18, 2)) as unit_price",
    )
