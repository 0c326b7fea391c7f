"""Recency, frequency and monetary value per customer, their ranks and quintile scores."""

from __future__ import annotations

import math
from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from patronscope.catalog import METRICS
from patronscope.functions.numeric import double
from patronscope.functions.order_stats import GlobalOrder, global_order
from patronscope.functions.selection import select_ranks
from patronscope.sources.workspace import Workspace

QUINTILES = 5


def rfm_base(clean_tx: DataFrame, workspace: Workspace) -> DataFrame:
    """One row per customer: days since the last invoice, invoices, and spend to the cent.

    Transactions are read once. They are first reduced per (customer, invoice), which spreads even
    a customer holding a large share of all lines over the cluster, then per customer. The customer
    table is stored, since the snapshot date (the day after the latest sale) and all later steps
    read it again.
    """
    invoices = clean_tx.groupBy("customer_id", "invoice_no").agg(
        F.expr("max(invoice_ts) as last_ts"), F.expr("sum(revenue) as revenue")
    )
    return rfm_of_customers(workspace.save(customers_of_invoices(invoices), "customers"))


def customers_of_invoices(invoices: DataFrame) -> DataFrame:
    """Latest sale, invoices and spend per customer, from one row per (customer, invoice)."""
    return invoices.groupBy("customer_id").agg(
        F.expr("max(last_ts) as last_ts"),
        F.expr("count(invoice_no) as frequency"),
        F.expr("cast(bround(sum(revenue), 2) as double) as monetary"),
    )


def rfm_of_customers(customers: DataFrame) -> DataFrame:
    """Replace the latest sale of a stored customer table by days before the snapshot date."""
    latest = customers.selectExpr("cast(max(last_ts) as string)").first()[0]
    return customers.selectExpr(
        "customer_id", f"{elapsed_days(latest)} as recency", "frequency", "monetary"
    )


def elapsed_days(latest: str | None) -> str:
    """SQL for whole days from ``last_ts`` to a day after ``latest``; null without any sale.

    Elapsed time is cut to whole days. An interval of zone-free timestamps does not depend on the
    session time zone, unlike timestampdiff.
    """
    if latest is None:
        return "cast(null as bigint)"
    elapsed = f"timestamp_ntz '{latest}' + interval 1 day - last_ts"
    return f"cast(extract(day from {elapsed}) as bigint)"


def metric_order(rfm: DataFrame, workspace: Workspace) -> GlobalOrder:
    """All (metric, value, customer) rows in one sorted table, metrics in catalogue order.

    Ties go by customer id, which also makes every row's key unique.
    """
    values = ", ".join(
        f"struct({i} as metric_no, cast({m} as double) as value)" for i, m in enumerate(METRICS)
    )
    long = rfm.selectExpr(f"inline(array({values}))", "customer_id")
    return global_order(long, ["metric_no", "value", "customer_id"], workspace, "metric-order")


def customer_count(order: GlobalOrder) -> int:
    return order.total // len(METRICS)


def rfm_ranks(order: GlobalOrder) -> DataFrame:
    """1-based rank of each customer in each metric, smallest value first."""
    customers = customer_count(order)
    return (
        order.with_position()
        .groupBy("customer_id")
        .agg(
            *[
                F.expr(
                    f"max(if(metric_no = {i}, position - {i * customers} + 1, null)) "
                    f"as {metric}_rank"
                )
                for i, metric in enumerate(METRICS)
            ]
        )
    )


@dataclass(frozen=True)
class Landmarks:
    """The customers at a few ranks of each metric, ties by customer id.

    ``rows[metric][rank]`` is the (value, customer id) at that 0-based rank.
    """

    customers: int
    rows: dict[str, dict[int, tuple[float, int]]]

    def quantile(self, metric: str, fraction: float) -> float:
        """Linear-interpolated quantile; its ranks must be among the landmarks."""
        place = fraction * (self.customers - 1)
        low, high = (self.rows[metric][step(place)][0] for step in (math.floor, math.ceil))
        return low + (high - low) * (place - math.floor(place))


def quintile_ends(customers: int) -> list[int]:
    """Rank of the last customer of each of the first four quintiles."""
    return [(b * (customers - 1)) // QUINTILES for b in range(1, QUINTILES)]


def landmarks(rfm: DataFrame, quantiles: Mapping[str, float] | None = None) -> Landmarks:
    """Find the quintile ends of each metric, and the ranks around its entry in ``quantiles``.

    Customers are neither sorted nor moved: the values at these ranks are selected in a few passes,
    then, among the customers who share such a value, the ids.
    """
    wanted = quantiles or {}

    def ranks(i: int, n: int) -> list[int]:
        place = wanted.get(METRICS[i], 0.0) * (n - 1)
        return [*quintile_ends(n), math.floor(place), math.ceil(place)]

    # No metric is null, so each has as many ranks as there are customers.
    values = rfm.selectExpr("customer_id", *[f"cast({m} as double) as {m}" for m in METRICS])
    selection = select_ranks(values, METRICS, ranks)
    customers = selection.counts.get(0, [0])[0]
    by_value = selection.found.get(0, [{} for _ in METRICS])
    # One column of ids for each value that was met, with the ranks wanted among them.
    tied: dict[tuple[str, float], list[tuple[int, int]]] = {}
    for metric, found in zip(METRICS, by_value, strict=True):
        for rank, hit in found.items():
            tied.setdefault((metric, hit.value), []).append((rank, rank - hit.below))
    rows: dict[str, dict[int, tuple[float, int]]] = {m: {} for m in METRICS}
    if tied:
        columns = [
            f"if({metric} = {double(value)}, customer_id, null) as id_{i}"
            for i, (metric, value) in enumerate(tied)
        ]
        places = list(tied.values())
        ids = select_ranks(
            values.selectExpr(*columns),
            [f"id_{i}" for i in range(len(tied))],
            lambda i, _: [place for _, place in places[i]],
        ).found[0]
        for (metric, value), pairs, found_ids in zip(tied, places, ids, strict=True):
            for rank, place in pairs:
                rows[metric][rank] = (value, found_ids[place].value)
    return Landmarks(customers, rows)


def rfm_scores(rfm: DataFrame, marks: Landmarks) -> DataFrame:
    """Add quintile scores 1 to 5 per metric and their sum.

    A customer's quintile follows from comparing its (value, id) with the last customer of each of
    the first four quintiles, so scoring is a projection and shuffles nothing.
    """
    if marks.customers < 2:
        raise ValueError(f"quintiles need at least two customers, found {marks.customers}")

    def quintile(metric: str) -> str:
        beyond = []
        for end in quintile_ends(marks.customers):
            last, customer_id = marks.rows[metric][end]
            value = double(last)
            beyond.append(
                f"int({metric} > {value} or ({metric} = {value} and customer_id > {customer_id}L))"
            )
        return "1 + " + " + ".join(beyond)

    recency, frequency, monetary = (quintile(m) for m in METRICS)
    return rfm.selectExpr(
        "*",
        f"{QUINTILES + 1} - ({recency}) as r_score",
        f"{frequency} as f_score",
        f"{monetary} as m_score",
    ).selectExpr("*", "r_score + f_score + m_score as rfm_score")


def score_range(scored: DataFrame) -> DataFrame:
    return scored.selectExpr("min(rfm_score) as min_score", "max(rfm_score) as max_score")
