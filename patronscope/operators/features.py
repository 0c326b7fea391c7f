"""Capping and standardising of the three metrics for clustering."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, Row

from patronscope.catalog import METRICS
from patronscope.functions.numeric import double
from patronscope.operators.rfm import Landmarks
from patronscope.sources.small import small_table

FEATURES = tuple(f"z_{metric}" for metric in METRICS)


def outlier_caps(rfm: DataFrame, marks: Landmarks, quantiles: Mapping[str, float]) -> DataFrame:
    """One row with the exact, linear-interpolated upper quantile of each metric.

    The two neighbouring values of each quantile are among the landmarks found for ``quantiles``.
    """
    caps = [marks.quantile(m, quantiles[m]) if marks.customers else None for m in METRICS]
    return small_table(
        rfm.sparkSession, [tuple(caps)], ", ".join(f"{m}_cap double" for m in METRICS)
    )


def capped_features(rfm: DataFrame, caps: DataFrame) -> DataFrame:
    """Add ``*_capped`` columns; the metrics themselves keep their raw values."""
    limits = caps.first()
    return rfm.selectExpr(
        "*",
        *[
            f"least(cast({m} as double), {_number(limits[f'{m}_cap'])}) as {m}_capped"
            for m in METRICS
        ],
    )


def feature_stats(capped: DataFrame) -> DataFrame:
    """One row with mean and population standard deviation of each capped metric."""
    return capped.selectExpr(
        *[f"avg({m}_capped) as {m}_mean" for m in METRICS],
        *[f"stddev_pop({m}_capped) as {m}_std" for m in METRICS],
    )


def scaled_features(capped: DataFrame) -> DataFrame:
    """Replace the capped columns by standardised ``z_*`` columns; a constant metric becomes 0."""
    stats = feature_stats(capped).first()
    kept = [c for c in capped.columns if not c.endswith("_capped")]
    return capped.selectExpr(*kept, *[f"{_standardised(m, stats)} as z_{m}" for m in METRICS])


def _standardised(metric: str, stats: Row) -> str:
    mean, spread = stats[f"{metric}_mean"], stats[f"{metric}_std"]
    return f"({metric}_capped - {double(mean)}) / {double(spread)}" if spread else "0D"


def _number(value: float | None) -> str:
    return "cast(null as double)" if value is None else double(value)
