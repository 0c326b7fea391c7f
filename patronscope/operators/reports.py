"""Report tables on labelled customers. A labelled table holds one row per customer."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import product

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from patronscope.catalog import ALL_CUSTOMERS, METRICS
from patronscope.config import CustomerFilter, HeatmapBands
from patronscope.functions.numeric import band, exact_total, half_even, quoted, quoted_array
from patronscope.functions.selection import clean_values, exact_quantiles
from patronscope.operators.segments import in_display_order
from patronscope.sources.small import small_table

QUARTILES = (0.25, 0.5, 0.75)


def filtered_customers(labelled: DataFrame, chosen: CustomerFilter) -> DataFrame:
    """Customers matching all given conditions; each reaches the Parquet scan."""
    kept = labelled
    for condition in conditions(chosen):
        kept = kept.where(condition)
    return kept


def conditions(chosen: CustomerFilter) -> list[str]:
    """The given conditions as SQL; a choice of no segment matches nobody."""
    found = []
    if chosen.segments is not None:
        names = ", ".join(quoted(name) for name in chosen.segments)
        found.append(f"segment in ({names})" if names else "false")
    bounds = (
        ("rfm_score", chosen.score_lo, chosen.score_hi),
        ("monetary", chosen.monetary_lo, chosen.monetary_hi),
    )
    for name, low, high in bounds:
        found += [f"{name} >= {low!r}"] * (low is not None) + [f"{name} <= {high!r}"] * (high is not None)
    return found


def filter_bounds(labelled: DataFrame) -> DataFrame:
    """Range of scores, and the largest spend without its fraction."""
    return labelled.selectExpr(
        "min(rfm_score) as score_min",
        "max(rfm_score) as score_max",
        "cast(max(monetary) as bigint) as monetary_max_int",
    )


def segment_summary(labelled: DataFrame) -> DataFrame:
    """Size, averages and revenue per segment, in display order.

    The revenue share divides the rounded totals. Its window covers one row per segment.
    """
    total = exact_total("monetary")
    figures = {
        "avg_recency": "avg(recency)",
        "avg_frequency": "avg(frequency)",
        "avg_monetary": f"{total} / count(monetary)",
        "total_revenue": total,
    }
    sums = labelled.groupBy("segment").agg(
        F.expr("count(customer_id) as customers"),
        *[F.expr(f"{half_even(text, 1)} as {name}") for name, text in figures.items()],
    )
    share = half_even(_share("cast(total_revenue as decimal(20, 1))"), 1)
    return in_display_order(sums.selectExpr("*", f"{share} as revenue_pct"))


def _share(part: str) -> str:
    """Percentage of the sum over all rows of a small table."""
    return f"try_divide(cast({part} as double), cast(sum({part}) over () as double)) * 100"


def segment_share(summary: DataFrame, segments: Sequence[str]) -> DataFrame:
    """Shares of customers and revenue among the selected segments only."""
    revenue = _share("cast(total_revenue as decimal(20, 1))")
    return summary.where(F.col("segment").isin(list(segments))).selectExpr(
        "segment",
        "customers",
        f"{half_even(_share('customers'), 1)} as customer_pct",
        "total_revenue",
        f"{half_even(revenue, 1)} as revenue_pct_selected",
    )


def segment_kpis(summary: DataFrame, segment: str) -> DataFrame:
    return summary.where(F.col("segment") == segment)


def portfolio_kpis(labelled: DataFrame, chosen: CustomerFilter) -> DataFrame:
    """Headline figures of the customers in view, in one row."""
    total = exact_total("monetary")
    return filtered_customers(labelled, chosen).selectExpr(
        "count(*) as n_rows",
        "count(distinct customer_id) as customers",
        f"coalesce({total}, 0D) as total_revenue",
        f"try_divide({total}, count(monetary)) as avg_monetary",
        "avg(recency) as avg_recency",
        "avg(frequency) as avg_frequency",
    )


def rfm_heatmap(labelled: DataFrame, chosen: CustomerFilter, bands: HeatmapBands) -> DataFrame:
    """Customers per spend band and recency band, with a row for every pair of bands."""
    counted = (
        filtered_customers(labelled, chosen)
        .selectExpr(
            f"{band('monetary', bands.monetary_edges, bands.monetary_labels)} as monetary_band",
            f"{band('recency', bands.recency_edges, bands.recency_labels)} as recency_band",
        )
        .where("monetary_band is not null and recency_band is not null")
        .groupBy("monetary_band", "recency_band")
        .agg(F.expr("count(*) as customers"))
    )
    cells = [
        (m, r, i * len(bands.recency_labels) + j)
        for (i, m), (j, r) in product(
            enumerate(bands.monetary_labels), enumerate(bands.recency_labels)
        )
    ]
    grid = small_table(
        labelled.sparkSession, cells, "monetary_band string, recency_band string, cell int"
    )
    # Both sides have at most one row per cell of the grid.
    return (
        grid.join(F.broadcast(counted), ["monetary_band", "recency_band"], "left")
        .orderBy("cell")
        .selectExpr("monetary_band", "recency_band", "coalesce(customers, 0) as customers")
    )


def heatmap_matrix(cells: DataFrame, bands: HeatmapBands) -> DataFrame:
    """The heatmap with one row per spend band and one column per recency band."""
    order = F.expr(f"array_position({quoted_array(bands.monetary_labels)}, monetary_band)")
    return (
        cells.groupBy("monetary_band")
        .pivot("recency_band", list(bands.recency_labels))
        .agg(F.sum("customers"))
        .orderBy(order)
    )


def score_histogram(labelled: DataFrame, chosen: CustomerFilter) -> DataFrame:
    return (
        filtered_customers(labelled, chosen)
        .groupBy("segment", "rfm_score")
        .agg(F.count("*").alias("customers"))
    )


def box_stats(df: DataFrame, by: str) -> DataFrame:
    """Quartiles, whiskers, outliers and mean of each metric per group.

    Quartiles are linear-interpolated. A whisker ends at the last value within 1.5 interquartile
    ranges of its quartile, or at the quartile if there is none.
    """
    quartiles = exact_quantiles(df, METRICS, QUARTILES, by)
    found = quartiles.withColumnsRenamed({m: f"{m}_q" for m in METRICS})

    def box(m: str) -> str:
        low = f"{m} >= {m}_q[0] - 1.5D * ({m}_q[2] - {m}_q[0])"
        high = f"{m} <= {m}_q[2] + 1.5D * ({m}_q[2] - {m}_q[0])"
        q1, median, q3 = (f"first({m}_q[{i}])" for i in range(3))
        return (
            f"struct('{m}' as metric, {q1} as q1, {median} as median, {q3} as q3, "
            f"least(min(if({low}, {m}, null)), {q1}) as whisker_lo, "
            f"greatest(max(if({high}, {m}, null)), {q3}) as whisker_hi, "
            f"count_if(not ({low} and {high})) as n_outliers, "
            f"try_divide({exact_total(m)}, count({m})) as mean)"
        )

    return (
        clean_values(df, METRICS, by)
        # One row per group.
        .join(F.broadcast(found), by)
        .groupBy(by)
        .agg(F.expr(f"array({', '.join(box(m) for m in METRICS)}) as boxes"))
        .selectExpr(by, "inline(boxes)")
    )


def segment_box_stats(labelled: DataFrame) -> DataFrame:
    return box_stats(labelled, "segment").drop("mean")


def segment_vs_portfolio(
    labelled: DataFrame, segment: str, chosen: CustomerFilter
) -> DataFrame:
    """Box statistics of all customers, unfiltered, next to those of one filtered segment."""
    wanted = F.expr(" and ".join([f"segment = {quoted(segment)}", *conditions(chosen)]))
    # A customer counts once or twice, from one scan.
    groups = F.array_compact(F.array(F.lit(ALL_CUSTOMERS), F.when(wanted, F.lit(segment))))
    return box_stats(labelled.select(F.explode(groups).alias("grp"), *METRICS), "grp")


def segment_radar(labelled: DataFrame) -> DataFrame:
    """Mean of each metric per segment on the 0 to 1 scale of all customers, recency inverted.

    Scaling is linear, so the mean of scaled values is the scaled mean: one pass yields means and
    extremes per segment, and the overall extremes follow from those few rows.
    """
    per_segment = labelled.groupBy("segment").agg(
        *[
            F.expr(f"{name}({m}) as {m}_{name}")
            for m in METRICS
            for name in ("avg", "min", "max")
        ]
    )

    def scaled(m: str) -> str:
        low, high = f"min({m}_min) over ()", f"max({m}_max) over ()"
        return f"({m}_avg - {low}) / nullif({high} - {low}, 0)"

    return per_segment.selectExpr(
        "segment",
        f"1 - {scaled('recency')} as recency_inv",
        f"{scaled('frequency')} as frequency",
        f"{scaled('monetary')} as monetary",
    )


def scatter_points(labelled: DataFrame) -> DataFrame:
    return labelled.select("customer_id", "segment", "recency", "monetary")
