"""Cleaning of transaction lines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from patronscope.functions.numeric import is_floating, positive, present, quoted
from patronscope.sources.transactions import canonical

# First letters of invoices that are not sales.
EXCLUDED_PREFIXES = ("C", "D", "M", "S")

# Digits of a quantity (an int), and digits before the point that a price may have.
QUANTITY_DIGITS, WHOLE_DIGITS = 10, 15


def clean_transactions(tx: DataFrame, *labels: str) -> DataFrame:
    """Keep sales to known customers and add ``revenue``; ``labels`` are further columns to keep.

    Dropped are lines without customer, lines of invoices starting with an excluded letter, and
    lines whose quantity or price is not above zero. A line without invoice number stays. The filters
    are plain predicates on source columns, so the scan itself skips what statistics rule out.
    """
    tx = canonical(tx, *labels)
    prefixes = ", ".join(quoted(p) for p in EXCLUDED_PREFIXES)
    kept = tx.where(
        f"{present(tx, 'customer_id')} and {positive(tx, 'quantity')} "
        f"and {positive(tx, 'unit_price')} "
        f"and coalesce(substring(cast(invoice_no as string), 1, 1), '') not in ({prefixes})"
    )
    return kept.selectExpr(
        "cast(invoice_no as string) as invoice_no",
        "cast(invoice_ts as timestamp_ntz) as invoice_ts",
        "cast(customer_id as bigint) as customer_id",
        "quantity",
        "unit_price",
        f"{_revenue(tx)} as revenue",
        *labels,
    )


def _revenue(tx: DataFrame) -> str:
    """Quantity times price as a decimal, so that sums do not depend on the order of rows."""
    if is_floating(tx, "quantity") or is_floating(tx, "unit_price"):
        return "cast(quantity * unit_price as decimal(28, 8))"
    price = tx.schema["unit_price"].dataType
    if not isinstance(price, T.DecimalType):
        return "cast(quantity as decimal(19, 0)) * cast(unit_price as decimal(19, 0))"
    # The product of narrowed factors keeps every digit: Spark adds up their precisions, plus one.
    whole = min(price.precision - price.scale, WHOLE_DIGITS)
    scale = min(price.scale, 38 - 1 - QUANTITY_DIGITS - whole)
    return (
        f"cast(quantity as decimal({QUANTITY_DIGITS}, 0))"
        f" * cast(unit_price as decimal({whole + scale}, {scale}))"
    )


def load_stats(clean_tx: DataFrame) -> DataFrame:
    """Number of lines and of customers, from one pass that pre-aggregates per customer."""
    per_customer = clean_tx.groupBy("customer_id").agg(F.expr("count(*) as lines"))
    return per_customer.selectExpr(
        "coalesce(sum(lines), 0) as n_records", "count(customer_id) as n_customers"
    )
