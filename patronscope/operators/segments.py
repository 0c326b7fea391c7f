"""Naming of clusters as ranked segments."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from patronscope.catalog import SEGMENTS
from patronscope.functions.numeric import half_even, quoted_array
from patronscope.functions.selection import exact_quantiles
from patronscope.sources.small import small_table

PLAYBOOK_SCHEMA = "segment string, priority string, actions array<string>, target string"


def in_display_order(df: DataFrame, names: Sequence[str] = SEGMENTS) -> DataFrame:
    """Sort by the place of ``segment`` in the catalogue, unknown names last."""
    place = F.expr(f"nullif(array_position({quoted_array(names)}, segment), 0)")
    return df.orderBy(place.asc_nulls_last(), "segment")


def cluster_ranking(assigned: DataFrame) -> DataFrame:
    """Clusters from best to worst: by median score, then median spend, then number.

    ``assigned`` holds ``rfm_score``, ``monetary`` and ``cluster``. The window runs over one row per
    cluster.
    """
    medians = exact_quantiles(assigned, ["rfm_score", "monetary"], [0.5], "cluster")
    return medians.selectExpr(
        "cluster", "rfm_score[0] as med_rfm", "monetary[0] as med_monetary"
    ).selectExpr(
        "*",
        "row_number() over (order by med_rfm desc, med_monetary desc, cluster) as rank",
    )


def segment_labels(
    assigned: DataFrame, ranking: DataFrame, names: Sequence[str] = SEGMENTS
) -> DataFrame:
    """Add ``segment``; it is null for a cluster ranked below the last name."""
    lookup = ranking.selectExpr("cluster", f"get({quoted_array(names)}, rank - 1) as segment")
    # One row per cluster.
    return assigned.join(F.broadcast(lookup), "cluster", "left").select(
        *assigned.columns, "segment"
    )


def require_labelled(labelled: DataFrame) -> None:
    """Raise if any customer has no segment."""
    missing = labelled.where(F.col("segment").isNull()).count()
    if missing:
        raise ValueError(f"{missing} customers have no segment: more clusters than segment names?")


def empty_segments(labelled: DataFrame, names: Sequence[str] = SEGMENTS) -> DataFrame:
    """Catalogue segments that hold no customer."""
    catalogue = small_table(labelled.sparkSession, [(n,) for n in names], "segment string")
    used = labelled.groupBy("segment").agg(F.count("*").alias("customers"))
    # Grouped first, so the right side has one row per segment.
    return catalogue.join(F.broadcast(used), "segment", "left_anti")


def cluster_segment_mean(labelled: DataFrame) -> DataFrame:
    mean = half_even("avg(rfm_score)", 1)
    return labelled.groupBy("cluster", "segment").agg(F.expr(f"{mean} as avg_rfm_score"))


def segment_counts(labelled: DataFrame) -> DataFrame:
    return (
        labelled.groupBy("segment")
        .agg(F.count("*").alias("customers"))
        .orderBy(F.desc("customers"), "segment")
    )


def segment_playbook(labelled: DataFrame, playbook: DataFrame) -> DataFrame:
    """One row per recommended action of each segment present, numbered from 1.

    ``playbook`` is the user's own table of ``PLAYBOOK_SCHEMA``, one row per segment. A segment
    without a row, or whose row has no actions, has no rows in the result.
    """
    sizes = labelled.groupBy("segment").agg(F.count("*").alias("customers"))
    return sizes.join(playbook, "segment").selectExpr(
        "segment", "customers", "priority", "posexplode(actions) as (at, action)", "target"
    ).selectExpr("segment", "customers", "priority", "at + 1 as action_no", "action", "target")
