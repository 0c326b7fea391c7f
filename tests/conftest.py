from __future__ import annotations

import datetime as dt
import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from patronscope.sources.workspace import Workspace  # noqa: E402

TX = "invoice_no string, invoice_ts timestamp_ntz, customer_id bigint, quantity int, unit_price double"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture()
def workspace(spark):
    own = Workspace(spark)
    yield own
    own.clear()


SHOPPERS = 64


def _sales_lines() -> list[tuple]:
    """Invoices of shoppers 1 to ``SHOPPERS``, worked out by rule, with lines that are no sales.

    Shopper s buys every s-th day, so few buy often and many rarely; two neighbours share habits,
    which makes ties. Purchases fall at odd hours, invoices have one to four lines of which one may
    be repeated, and every third shopper also cancels, returns or takes a free item.
    """
    opening = dt.datetime(2021, 3, 1, 6, 30)
    lines = []
    for shopper in range(1, SHOPPERS + 1):
        habit = (shopper + 1) // 2
        for day_no in range(habit % 5, 240 - 2 * habit, habit + 2):
            when = opening + dt.timedelta(days=day_no, minutes=(shopper * 97 + day_no * 53) % 1300)
            invoice = f"{shopper:03}-{day_no:03}"
            items = [
                (invoice, when, shopper, 1 + (day_no + i) % 7, round(0.35 * habit + 1.15 * i, 2))
                for i in range(1 + (shopper + day_no) % 4)
            ]
            lines += items + items[:1] * (day_no % 3 == 0)
        if shopper % 3 == 0:
            last = opening + dt.timedelta(days=300, hours=shopper % 20)
            lines += [
                (f"C{shopper:03}", last, shopper, 4, 2.5),
                (f"{shopper:03}-r", last, shopper, -2, 2.5),
                (f"{shopper:03}-f", last, shopper, 1, 0.0),
                (f"{shopper:03}-x", last, None, 3, 9.99),
            ]
    return lines


@pytest.fixture(scope="session")
def sales() -> list[tuple]:
    """All lines, among them cancellations, returns, free items and anonymous sales."""
    return _sales_lines()


@pytest.fixture(scope="session")
def kept_sales(sales) -> list[tuple]:
    """The lines that count as sales."""
    return [
        line for line in sales if line[2] is not None and line[3] > 0 and line[4] > 0 and line[0][0] != "C"
    ]


@pytest.fixture(scope="session")
def sales_df(spark, sales):
    return spark.createDataFrame(sales, TX).repartition(3).cache()


def day(text: str) -> dt.datetime:
    return dt.datetime.fromisoformat(text)


def rows(df) -> list[tuple]:
    return [tuple(r) for r in df.collect()]


def plan_text(df) -> str:
    utils = df.sparkSession._jvm.org.apache.spark.sql.api.python.PythonSQLUtils
    return utils.explainString(df._jdf.queryExecution(), "formatted")
