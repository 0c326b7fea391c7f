"""The three dashboard tabs as named frames over stored result tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from patronscope.catalog import SEGMENTS
from patronscope.config import CustomerFilter, HeatmapBands
from patronscope.operators.explorer import explorer_table
from patronscope.operators.reports import (
    filtered_customers,
    portfolio_kpis,
    rfm_heatmap,
    score_histogram,
    segment_kpis,
    segment_share,
    segment_vs_portfolio,
)
from patronscope.operators.segments import segment_playbook


def has_customers(scored: DataFrame, chosen: CustomerFilter) -> bool:
    """Whether a filter leaves anything to show."""
    if chosen.segments is not None and not chosen.segments:
        return False
    return not filtered_customers(scored, chosen).isEmpty()


def overview(
    scored: DataFrame,
    summary: DataFrame,
    chosen: CustomerFilter = CustomerFilter(),
    bands: HeatmapBands = HeatmapBands(),
) -> dict[str, DataFrame]:
    """Headline figures, shares and heatmap. Shares follow the segment choice only."""
    segments = SEGMENTS if chosen.segments is None else chosen.segments
    return {
        "kpis": portfolio_kpis(scored, chosen),
        "shares": segment_share(summary, segments),
        "heatmap": rfm_heatmap(scored, chosen, bands),
    }


def segment_detail(
    scored: DataFrame,
    summary: DataFrame,
    segment: str,
    playbook: DataFrame,
    chosen: CustomerFilter = CustomerFilter(),
) -> dict[str, DataFrame]:
    """One segment: its summary row, its spread next to everyone's, and its part of the playbook."""
    return {
        "kpis": segment_kpis(summary, segment),
        "boxes": segment_vs_portfolio(scored, segment, chosen),
        "playbook": segment_playbook(scored.where(F.col("segment") == segment), playbook),
    }


def explorer(
    scored: DataFrame,
    chosen: CustomerFilter = CustomerFilter(),
    sort: str = "rfm_score",
    ascending: bool = False,
) -> dict[str, DataFrame]:
    """The customer table and the score histogram of the customers in view."""
    return {
        "table": explorer_table(scored, chosen, sort, ascending),
        "histogram": score_histogram(scored, chosen),
    }
