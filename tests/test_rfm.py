import datetime as dt

import pytest
from conftest import SHOPPERS, TX, day
from pyspark.sql import functions as F

from patronscope.functions import selection
from patronscope.operators.clean import clean_transactions
from patronscope.operators.rfm import (
    landmarks,
    metric_order,
    rfm_base,
    rfm_ranks,
    rfm_scores,
    score_range,
)

RFM = "customer_id bigint, recency bigint, frequency bigint, monetary double"


def by_hand(table: list[tuple]) -> dict[int, tuple]:
    """Ranks and scores of (customer, recency, frequency, monetary) rows with plain dicts.

    The quintile of 0-based rank i of n is the least q with 5 i <= q (n - 1), at least 1.
    """
    ranks: dict[int, list[int]] = {row[0]: [] for row in table}
    for at in (1, 2, 3):
        for rank, row in enumerate(sorted(table, key=lambda r: (r[at], r[0]))):
            ranks[row[0]].append(rank)
    n = len(table)
    found = {}
    for customer, places in ranks.items():
        r, f, m = (next(q for q in range(1, 6) if 5 * i <= q * (n - 1)) for i in places)
        found[customer] = (*(i + 1 for i in places), 6 - r, f, m, 6 - r + f + m)
    return found


def scored_and_ranked(rfm, workspace) -> dict[int, tuple]:
    ranks = {r.customer_id: tuple(r)[1:] for r in rfm_ranks(metric_order(rfm, workspace)).collect()}
    scored = rfm_scores(rfm, landmarks(rfm)).collect()
    return {
        r.customer_id: (*ranks[r.customer_id], r.r_score, r.f_score, r.m_score, r.rfm_score)
        for r in scored
    }


def test_base_matches_plain_sums(sales_df, kept_sales, workspace):
    invoices, spent, latest = {}, {}, {}
    for invoice, when, customer, quantity, price in kept_sales:
        invoices.setdefault(customer, set()).add(invoice)
        spent[customer] = spent.get(customer, 0) + quantity * round(price * 100)
        latest[customer] = max(latest.get(customer, when), when)
    end = max(latest.values()) + dt.timedelta(days=1)
    got = {r.customer_id: r for r in rfm_base(clean_transactions(sales_df), workspace).collect()}
    assert set(got) == set(latest) and len(got) == SHOPPERS
    for customer, row in got.items():
        assert row.recency == (end - latest[customer]) // dt.timedelta(days=1)
        assert row.frequency == len(invoices[customer])
        assert row.monetary == spent[customer] / 100


def test_scores_match_plain_ranks(sales_df, workspace):
    rfm = rfm_base(clean_transactions(sales_df), workspace)
    want = by_hand([tuple(r) for r in rfm.collect()])
    assert scored_and_ranked(rfm, workspace) == want
    assert {w[-1] for w in want.values()} >= {4, 8, 12}


@pytest.mark.parametrize("n", [2, 3, 4, 5, 6, 7, 11, 12, 26, 41, 3000])
def test_quintile_edges_and_ties(spark, workspace, monkeypatch, n):
    """Every customer has the same frequency, few differ in recency; few values are fetched."""
    monkeypatch.setattr(selection, "KEPT", 5)
    table = [(7 * i % (n * 7 + 1) - n, 1 + i * i % 3, 1, i * 37 % 101 / 4) for i in range(1, n + 1)]
    got = scored_and_ranked(spark.createDataFrame(table, RFM), workspace)
    assert got == by_hand(table)


@pytest.mark.parametrize("n", [0, 1])
def test_too_few_customers(spark, n):
    rfm = spark.createDataFrame([(1, 1, 1, 1.0)] * n, RFM)
    with pytest.raises(ValueError, match="at least two customers"):
        rfm_scores(rfm, landmarks(rfm))


def test_score_types_and_range(spark, workspace, sales_df):
    rfm = rfm_base(clean_transactions(sales_df), workspace)
    scored = rfm_scores(rfm, landmarks(rfm))
    kinds = dict(scored.dtypes)
    assert [kinds[c] for c in ("r_score", "f_score", "m_score", "rfm_score")] == ["int"] * 4
    assert kinds["recency"] == kinds["frequency"] == kinds["customer_id"] == "bigint"
    low, high = score_range(scored).first()
    assert 3 <= low <= high <= 15


@pytest.mark.parametrize("zone", ["UTC", "America/New_York"])
def test_recency_counts_elapsed_days(spark, workspace, zone):
    """A sale late in the evening and one early the next morning are not a day apart."""
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        tx = spark.createDataFrame(
            [
                ("1", day("2024-03-11 08:00:00"), 1, 1, 1.0),
                ("2", day("2024-03-10 07:59:59"), 2, 1, 1.0),
                ("3", day("2024-03-10 08:00:00"), 3, 1, 1.0),
                ("4", day("2024-03-10 23:00:00"), 4, 1, 1.0),
                ("5", day("2024-03-10 02:30:00.000001"), 5, 1, 1.0),
            ],
            TX,
        )
        got = rfm_base(clean_transactions(tx), workspace)
        assert {r.customer_id: r.recency for r in got.collect()} == {1: 1, 2: 2, 3: 2, 4: 1, 5: 2}
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


def test_invoices_count_once(spark, workspace):
    """Lines and repeated lines of an invoice count once; so does one shared by two customers."""
    monday, sunday = day("2019-11-04 09:15:00"), day("2019-11-03 17:40:00")
    lines = [("A7", monday, 31, 2, 4.25)] * 3 + [("A7", monday, 31, 1, 0.335)]
    lines += [("B1", sunday, 31, 5, 0.2), ("A7", sunday, 32, 1, 6.5)]
    lines += [(None, monday, 33, 1, 2.75), (None, sunday, 33, 2, 1.0)]
    got = rfm_base(clean_transactions(spark.createDataFrame(lines, TX)), workspace)
    found = {r.customer_id: (r.frequency, r.monetary) for r in got.collect()}
    # 3 x 8.50 + 0.335 + 1.00 = 26.835, of which the cent rounds to the even neighbour.
    assert found == {31: (2, 26.84), 32: (1, 6.5), 33: (0, 4.75)}


def test_hot_customer(spark, workspace):
    """A third of all lines on one customer, and a third on one invoice of another."""
    lines = spark.range(30_000).select(
        F.when(F.col("id") % 3 == 1, "hot").otherwise(F.col("id").cast("string")).alias("invoice_no"),
        F.lit(day("2024-01-01")).cast("timestamp_ntz").alias("invoice_ts"),
        F.when(F.col("id") % 3 == 0, 1)
        .when(F.col("id") % 3 == 1, 2)
        .otherwise(F.col("id") % 50 + 3)
        .cast("bigint")
        .alias("customer_id"),
        F.lit(1).alias("quantity"),
        F.lit(0.1).cast("decimal(18,2)").alias("unit_price"),
    )
    cleaned = clean_transactions(lines)
    found = {r.customer_id: r for r in rfm_base(cleaned, workspace).collect()}
    assert (found[1].frequency, found[1].monetary) == (10_000, 1000.0)
    assert (found[2].frequency, found[2].monetary) == (1, 1000.0)
    assert sum(r.frequency for r in found.values()) == 20_001
