"""Readers and writers for the result tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

SCORED_SCHEMA = (
    "customer_id bigint, recency bigint, frequency bigint, monetary double, r_score int, "
    "f_score int, m_score int, rfm_score int, cluster int, segment string"
)
SUMMARY_SCHEMA = (
    "segment string, customers bigint, avg_recency double, avg_frequency double, "
    "avg_monetary double, total_revenue double, revenue_pct double"
)

# CSV headers of the published result files.
CSV_HEADERS = {
    "customer_id": "CustomerID",
    "recency": "Recency",
    "frequency": "Frequency",
    "monetary": "Monetary",
    "r_score": "R_Score",
    "f_score": "F_Score",
    "m_score": "M_Score",
    "rfm_score": "RFM_Score",
    "cluster": "Cluster",
    "segment": "Segment",
    "customers": "Customers",
    "avg_recency": "Avg_Recency",
    "avg_frequency": "Avg_Frequency",
    "avg_monetary": "Avg_Monetary",
    "total_revenue": "Total_Revenue",
    "revenue_pct": "Revenue_Pct",
}


def column_names(schema: str) -> list[str]:
    return [part.split()[0] for part in schema.split(",")]


def write_table(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite") -> None:
    """Write as Parquet, or as CSV under the published headers."""
    if fmt == "csv":
        df = df.withColumnsRenamed({c: CSV_HEADERS[c] for c in df.columns if c in CSV_HEADERS})
        df.write.mode(mode).option("header", True).csv(path)
    elif fmt == "parquet":
        df.write.mode(mode).parquet(path)
    else:
        raise ValueError(f"unknown table format {fmt!r}")


def read_table(spark: SparkSession, path: str, schema: str, fmt: str = "parquet") -> DataFrame:
    """Read a result table with a declared schema.

    CSV columns are matched by header name, so a missing or misplaced column is an error instead of
    a silent shift.
    """
    if fmt == "parquet":
        return spark.read.schema(schema).parquet(path)
    if fmt != "csv":
        raise ValueError(f"unknown table format {fmt!r}")
    headers = ", ".join(
        f"{CSV_HEADERS[name]} {kind}" for name, kind in (p.split() for p in schema.split(","))
    )
    reader = spark.read.schema(headers).option("header", True).option("enforceSchema", False)
    return reader.csv(path).toDF(*column_names(schema))


def write_scored(labelled: DataFrame, path: str, fmt: str = "parquet") -> None:
    write_table(labelled.select(*column_names(SCORED_SCHEMA)), path, fmt)


def read_scored(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    return read_table(spark, path, SCORED_SCHEMA, fmt)


def write_summary(summary: DataFrame, path: str, fmt: str = "parquet") -> None:
    write_table(summary.select(*column_names(SUMMARY_SCHEMA)), path, fmt)


def read_summary(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """The summary in display order, unknown segments last."""
    from patronscope.operators.segments import in_display_order

    return in_display_order(read_table(spark, path, SUMMARY_SCHEMA, fmt))
