"""Comparison of two snapshots of labelled customers: migration and drift of segments."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from patronscope.catalog import SEGMENTS
from patronscope.functions.numeric import double, half_even, quoted
from patronscope.sources.small import small_table

# Names of the states before a customer's first and after its last snapshot.
ENTERED, LEFT = "entered", "left"
# Customers that an empty cell counts as when shares are compared on a log scale.
FLOOR = 0.5
# Stability index from which a population counts as shifted.
ALERT = 0.2


def customer_moves(before: DataFrame, after: DataFrame) -> DataFrame:
    """(customer_id, from_segment, to_segment) of every customer of either snapshot.

    A customer who is only in the later one comes from ``entered``, one only in the earlier goes to
    ``left``; a null segment stays null. Ids are unique within a snapshot. Both sides are read for
    two columns and meet in one join on the id.
    """
    old = before.selectExpr("customer_id", "struct(segment) as old")
    new = after.selectExpr("customer_id", "struct(segment) as new")
    return old.join(new, "customer_id", "full_outer").selectExpr(
        "customer_id",
        f"if(old is null, {quoted(ENTERED)}, old.segment) as from_segment",
        f"if(new is null, {quoted(LEFT)}, new.segment) as to_segment",
    )


def segment_migration(before: DataFrame, after: DataFrame) -> DataFrame:
    """Customers per pair of segments, and their share of those they started with, in percent.

    Only pairs that occur have a row. Rows of one ``from_segment`` add up to its customers before,
    those of one ``to_segment`` to its customers after.
    """
    pairs = (
        customer_moves(before, after)
        .groupBy("from_segment", "to_segment")
        .agg(F.count("*").alias("customers"))
    )
    share = half_even("customers * 100D / sum(customers) over (partition by from_segment)", 1)
    return pairs.selectExpr("*", f"{share} as pct_of_from")


def migration_matrix(migration: DataFrame, names: Sequence[str] = SEGMENTS) -> DataFrame:
    """One row per ``from_segment`` and a column for each segment and ``left``, zero where empty."""
    columns = [*names, LEFT]
    wide = migration.groupBy("from_segment").pivot("to_segment", columns).agg(F.sum("customers"))
    return wide.fillna(0, columns)


def segment_drift(
    before: DataFrame, after: DataFrame, names: Sequence[str] = SEGMENTS, alert: float = ALERT
) -> DataFrame:
    """Shares of each segment in two snapshots, their difference and the stability index.

    Every name of ``names`` has a row, in order, whether or not it occurs; customers without one of
    these names aren't counted. A segment's ``psi`` is (q - p) ln(q / p) of its shares before (p)
    and after (q), an empty cell counting as ``FLOOR`` customers; ``psi_total`` is their sum and
    ``shifted`` whether it reaches ``alert``. An empty snapshot has null shares and indexes and no
    alert.
    """
    spark = before.sparkSession
    grid = small_table(spark, list(enumerate(names)), "place int, segment string")
    counted = [
        df.groupBy("segment").agg(F.count("*").alias(name))
        for name, df in (("n_before", before), ("n_after", after))
    ]
    # Each side has one row per segment.
    cells = grid
    for side in counted:
        cells = cells.join(F.broadcast(side), "segment", "left")
    cells = cells.selectExpr(
        "place", "segment", "coalesce(n_before, 0L) as n_before", "coalesce(n_after, 0L) as n_after"
    )

    def share(n: str) -> str:
        return f"{n} / nullif(sum({n}) over (), 0)"

    def floored(n: str) -> str:
        return f"greatest({n}, {double(FLOOR)}) / nullif(sum({n}) over (), 0)"

    found = cells.selectExpr(
        "*",
        f"{share('n_before')} as share_before", f"{share('n_after')} as share_after",
        f"{floored('n_before')} as p", f"{floored('n_after')} as q",
    ).selectExpr("*", "(q - p) * ln(q / p) as psi")
    return found.selectExpr(
        "place", "segment", "n_before", "n_after", "share_before", "share_after",
        "share_after - share_before as change", "psi", "sum(psi) over () as psi_total",
    ).selectExpr(
        "segment", "n_before", "n_after", "share_before", "share_after", "change", "psi",
        "psi_total", f"coalesce(psi_total >= {double(alert)}, false) as shifted", "place",
    ).orderBy("place").drop("place")
