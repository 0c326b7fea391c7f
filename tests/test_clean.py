import datetime as dt
from decimal import Decimal

import pytest
from conftest import SHOPPERS, TX, day, plan_text, rows
from pyspark.sql import functions as F

from patronscope.operators.clean import clean_transactions, load_stats

NAN = float("nan")


def frame(spark, values, schema=TX):
    return spark.createDataFrame(values, schema)


def test_rules(spark):
    t = day("2024-01-01")
    tx = frame(
        spark,
        [
            ("1", t, 1, 2, 1.5),
            ("C2", t, 1, 2, 1.5),
            ("D2", t, 1, 2, 1.5),
            ("M2", t, 1, 2, 1.5),
            ("S2", t, 1, 2, 1.5),
            ("c3", t, 1, 2, 1.5),
            ("A4", t, 1, 2, 1.5),
            (None, t, 1, 2, 1.5),
            ("", t, 1, 2, 1.5),
            ("5", t, None, 2, 1.5),
            ("6", t, 1, 0, 1.5),
            ("7", t, 1, -1, 1.5),
            ("8", t, 1, None, 1.5),
            ("9", t, 1, 2, 0.0),
            ("10", t, 1, 2, NAN),
            ("11", t, 1, 2, None),
        ],
    )
    kept = clean_transactions(tx)
    assert {r.invoice_no for r in kept.collect()} == {"1", "c3", "A4", None, ""}
    assert {r.revenue for r in kept.collect()} == {Decimal("3.00000000")}


def test_published_names_and_floating_ids(spark):
    tx = frame(
        spark,
        [(536365, day("2024-01-01 08:26:00"), 17850.0, NAN, "x", 2.55),
         (536366, day("2024-01-01 08:26:00"), NAN, 6.0, "x", 2.55),
         (536367, day("2024-01-01 08:26:00"), 17850.0, 6.0, "x", 2.55)],
        "InvoiceNo bigint, InvoiceDate timestamp_ntz, CustomerID double, Quantity double, "
        "Country string, UnitPrice double",
    )
    (row,) = clean_transactions(tx).collect()
    assert (row.invoice_no, row.customer_id) == ("536367", 17850)
    assert row.invoice_ts == dt.datetime(2024, 1, 1, 8, 26)
    assert float(row.revenue) == pytest.approx(15.3)


def test_decimal_prices_stay_exact(spark):
    tx = frame(
        spark,
        [("1", day("2024-01-01"), 1, 3, Decimal("0.1001"))],
        TX.replace("unit_price double", "unit_price decimal(18,4)"),
    )
    assert clean_transactions(tx).first().revenue == Decimal("0.3003")


def test_missing_column(spark):
    with pytest.raises(ValueError, match="UnitPrice"):
        clean_transactions(spark.range(1).select(
            F.lit("1").alias("InvoiceNo"), F.current_date().alias("InvoiceDate"),
            F.col("id").alias("CustomerID"), F.lit(1).alias("Quantity")))


def test_load_stats(spark, sales_df, kept_sales):
    assert rows(load_stats(clean_transactions(sales_df))) == [(len(kept_sales), SHOPPERS)]
    assert rows(load_stats(clean_transactions(sales_df).where("false"))) == [(0, 0)]


def test_filters_reach_the_scan(spark, tmp_path):
    path = str(tmp_path / "tx")
    frame(spark, [("1", day("2024-01-01"), 1, 2, 1.5)]).withColumn("note", F.lit("x")).write.parquet(path)
    plan = plan_text(clean_transactions(spark.read.parquet(path)))
    for pushed in ("IsNotNull(customer_id)", "GreaterThan(quantity,0)", "GreaterThan(unit_price,0.0)"):
        assert pushed in plan
    assert "note" not in plan


@pytest.mark.parametrize(
    "kind", ["decimal(38,18)", "decimal(20,10)", "decimal(10,2)", "int", "bigint", "double"]
)
def test_revenue_of_any_price_type(spark, kind):
    lines = [(2**31 - 1, "7"), (3, "2"), (1, "20000000")]
    df = spark.createDataFrame(lines, "quantity int, price string").selectExpr(
        "'1' as invoice_no", "timestamp_ntz'2024-05-01' as invoice_ts", "1L as customer_id",
        "quantity", f"cast(price as {kind}) as unit_price",
    )
    total = clean_transactions(df.where("unit_price is not null")).selectExpr("sum(revenue)").first()
    whole = sum(q * int(p) for q, p in lines)
    assert int(total[0]) == whole


def test_revenue_keeps_digits(spark):
    df = spark.sql(
        "select '1' as invoice_no, timestamp_ntz'2024-05-01' as invoice_ts, 1L as customer_id,"
        " 10 as quantity, cast('2500000000.5000000001' as decimal(20,10)) as unit_price"
    )
    assert str(clean_transactions(df).first().revenue).rstrip("0") == "25000000005.000000001"
