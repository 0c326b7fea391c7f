import datetime as dt
from decimal import Decimal

import pytest
from conftest import day, rows
from pyspark.errors import AnalysisException

from patronscope.catalog import SEGMENTS
from patronscope.operators.clean import clean_transactions
from patronscope.sources.small import pin, small_table
from patronscope.sources.tables import (
    SCORED_SCHEMA,
    SUMMARY_SCHEMA,
    read_scored,
    read_summary,
    write_scored,
    write_summary,
    write_table,
)
from patronscope.sources.transactions import TRANSACTIONS, read_csv, read_parquet
from patronscope.sources.workspace import Workspace, shared_folder


def test_csv_by_header_name(spark, tmp_path):
    (tmp_path / "tx.csv").write_text(
        "InvoiceNo,StockCode,Description,Quantity,InvoiceDate,UnitPrice,CustomerID,Country\n"
        '536365,85123A,"HOLDER, WHITE",6,12/1/2010 8:26,2.55,17850.0,United Kingdom\n'
        "C536366,71053,LANTERN,-6,12/1/2010 8:28,3.39,17850,United Kingdom\n"
        "536367,71053,LANTERN,6,12/1/2010 18:28,3.3949,,United Kingdom\n"
    )
    tx = read_csv(spark, str(tmp_path / "tx.csv"), "M/d/yyyy H:mm")
    assert [f.dataType for f in tx.schema] == [f.dataType for f in TRANSACTIONS]
    first, second, third = tx.collect()
    assert tuple(first) == ("536365", dt.datetime(2010, 12, 1, 8, 26), 17850, 6, Decimal("2.5500"))
    assert (second.invoice_no, second.quantity) == ("C536366", -6)
    assert (third.customer_id, third.unit_price) == (None, Decimal("3.3949"))
    assert rows(clean_transactions(tx).select("invoice_no", "revenue")) == [
        ("536365", Decimal("15.3000"))
    ]


def test_csv_with_iso_dates(spark, tmp_path):
    (tmp_path / "tx.csv").write_text(
        "CustomerID,UnitPrice,Quantity,InvoiceDate,InvoiceNo\n1,2.5,2,2024-01-02 03:04:05,9\n"
    )
    assert rows(read_csv(spark, str(tmp_path / "tx.csv")))[0][1] == day("2024-01-02 03:04:05")


def test_missing_input(spark, tmp_path):
    for reader in (read_csv, read_parquet):
        with pytest.raises(AnalysisException, match="PATH_NOT_FOUND"):
            reader(spark, str(tmp_path / "nothing"))


@pytest.fixture()
def lab(spark):
    values = [
        (i, 10 * i, i, i + 0.07, 1, 2, 3, 6, i % 5, SEGMENTS[i % 5]) for i in range(1, 12)
    ]
    return spark.createDataFrame(values, SCORED_SCHEMA)


@pytest.mark.parametrize("fmt", ["parquet", "csv"])
def test_scored_roundtrip(spark, tmp_path, lab, fmt):
    path = str(tmp_path / "scored")
    write_scored(lab.withColumn("z_recency", lab.monetary), path, fmt)
    back = read_scored(spark, path, fmt)
    assert back.dtypes == lab.dtypes
    assert sorted(rows(back)) == sorted(rows(lab))
    if fmt == "csv":
        header = spark.read.option("header", True).csv(path).columns
        assert header[:2] == ["CustomerID", "Recency"] and header[-1] == "Segment"


def test_csv_columns_must_match(spark, tmp_path, lab):
    path = str(tmp_path / "scored")
    write_table(lab.drop("cluster"), path, "csv")
    with pytest.raises(Exception, match="CSV header|does not conform"):
        read_scored(spark, path, "csv").collect()
    with pytest.raises(ValueError):
        write_table(lab, path, "xlsx")


@pytest.mark.parametrize("fmt", ["parquet", "csv"])
def test_summary_is_read_in_order(spark, tmp_path, fmt):
    values = [(s, 1, 1.0, 1.0, 1.0, 1.0, 20.0) for s in ("Zebra", *reversed(SEGMENTS))]
    path = str(tmp_path / "summary")
    write_summary(spark.createDataFrame(values, SUMMARY_SCHEMA).repartition(3), path, fmt)
    assert [r.segment for r in read_summary(spark, path, fmt).collect()] == [*SEGMENTS, "Zebra"]


def test_workspace_uses_the_named_folder(spark, lab):
    own = Workspace(spark)
    assert own.path.startswith(spark.conf.get("spark.checkpoint.dir"))
    assert shared_folder(spark) == spark.conf.get("spark.checkpoint.dir")
    saved = own.save(lab, "lab")
    assert saved.count() == 11
    own.clear()
    with pytest.raises(Exception):
        spark.read.schema(SCORED_SCHEMA).parquet(f"{own.path}/01-lab").count()


def test_small_tables(spark):
    schema = "a int, b string, c array<string>, d double"
    values = [(1, "x", ["p", "q"], 0.5), (2, None, [], None)]
    df = small_table(spark, values, schema)
    assert df.collect() == spark.createDataFrame(values, schema).collect()
    assert pin(df).collect() == df.collect()
    assert small_table(spark, [], schema).count() == 0
    assert "LocalTableScan" in df._jdf.queryExecution().executedPlan().toString()
