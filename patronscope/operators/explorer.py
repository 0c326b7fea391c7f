"""Single-customer lookup and the sortable customer table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from patronscope.config import CustomerFilter
from patronscope.functions.numeric import half_even
from patronscope.operators.reports import filtered_customers

# Columns of the customer table and the headings they are shown under.
HEADINGS = {
    "customer_id": "Customer ID",
    "segment": "Segment",
    "recency": "Recency",
    "frequency": "Frequency",
    "monetary": "Monetary",
    "r_score": "R",
    "f_score": "F",
    "m_score": "M",
    "rfm_score": "RFM Score",
}
SORTABLE = ("rfm_score", "monetary", "recency", "frequency", "customer_id")


def customer_profile(labelled: DataFrame, text: str) -> DataFrame:
    """The customer whose id is typed in ``text``: one row, or none if there is no such customer."""
    try:
        number = int(text.strip())
    except ValueError:
        raise ValueError(f"not a numeric customer id: {text!r}") from None
    known = -(2**63) <= number < 2**63
    wanted = F.col("customer_id") == F.lit(number) if known else F.lit(False)
    return (
        labelled.where(wanted)
        .limit(1)
        .selectExpr(
            "customer_id",
            "segment",
            "recency",
            "frequency",
            "monetary",
            "rfm_score",
            "format_string('R%d F%d M%d', r_score, f_score, m_score) as profile",
        )
    )


def explorer_table(
    labelled: DataFrame,
    chosen: CustomerFilter,
    sort: str = "rfm_score",
    ascending: bool = False,
) -> DataFrame:
    """Customers in view, sorted by one column and under display headings.

    Equal values are ordered by customer id, which also keeps the range partitions of the sort even
    when one value is very frequent.
    """
    if sort not in SORTABLE:
        raise ValueError(f"cannot sort by {sort!r}; choose one of {', '.join(SORTABLE)}")
    key = F.col(sort).asc() if ascending else F.col(sort).desc()
    rows = filtered_customers(labelled, chosen).orderBy(key, "customer_id")
    shown = {**{c: c for c in HEADINGS}, "monetary": half_even("monetary", 2)}
    return rows.selectExpr(*[f"{shown[c]} as `{heading}`" for c, heading in HEADINGS.items()])


def export_view(view: DataFrame, path: str) -> None:
    """Write a table as CSV with headings, each task writing its own part in sorted order."""
    view.write.mode("overwrite").option("header", True).csv(path)
