"""The batch run: transactions to scored customers, segments and chart tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame

from patronscope.catalog import SEGMENTS
from patronscope.config import SegmentationConfig
from patronscope.operators.clean import clean_transactions
from patronscope.operators.clustering import assign_centroid, fit_kmeans, k_sweep
from patronscope.operators.features import (
    capped_features,
    outlier_caps,
    scaled_features,
)
from patronscope.operators.reports import (
    scatter_points,
    segment_box_stats,
    segment_radar,
    segment_summary,
)
from patronscope.operators.rfm import Landmarks, landmarks, rfm_base, rfm_scores
from patronscope.operators.segments import (
    cluster_ranking,
    require_labelled,
    segment_labels,
)
from patronscope.sources.small import pin
from patronscope.sources.tables import (
    SCORED_SCHEMA,
    column_names,
    read_scored,
    read_summary,
    write_scored,
    write_summary,
    write_table,
)
from patronscope.sources.workspace import Workspace


def score_customers(
    tx: DataFrame, workspace: Workspace, quantiles: Mapping[str, float] | None = None
) -> tuple[DataFrame, Landmarks]:
    """Transactions to customers with RFM values and scores, and the landmarks the scores rest on."""
    rfm = rfm_base(clean_transactions(tx), workspace)
    marks = landmarks(rfm, quantiles)
    return rfm_scores(rfm, marks), marks


def prepare_features(
    tx: DataFrame, config: SegmentationConfig, workspace: Workspace
) -> DataFrame:
    """Scored customers with standardised features, stored for the passes of clustering."""
    scored, marks = score_customers(tx, workspace, config.cap_quantiles)
    capped = capped_features(scored, outlier_caps(scored, marks, config.cap_quantiles))
    return workspace.save(scaled_features(capped), "features")


def label_customers(
    features: DataFrame, centers: Sequence[Sequence[float]], names: Sequence[str] = SEGMENTS
) -> DataFrame:
    """Assign each customer to a centre and name the clusters.

    Scores and features travel in one row, so neither step joins customers with customers.
    """
    assigned = assign_centroid(features, centers)
    labelled = segment_labels(assigned, pin(cluster_ranking(assigned)), names)
    return labelled.select(*column_names(SCORED_SCHEMA))


@dataclass(frozen=True)
class Segmentation:
    """Results of a batch run, read back from where they were written."""

    scored: DataFrame
    summary: DataFrame
    sweep: DataFrame


def run(
    tx: DataFrame,
    output: str,
    config: SegmentationConfig | None = None,
    workspace: Workspace | None = None,
    fmt: str = "parquet",
) -> Segmentation:
    """Segment all customers of ``tx`` and write the result tables under ``output``.

    Written are ``rfm_scored``, ``segment_summary`` and the data of each chart: ``k_sweep``,
    ``box_stats``, ``scatter`` and ``radar``.
    """
    config = config or SegmentationConfig()
    own = workspace is None
    workspace = workspace or Workspace(tx.sparkSession)
    spark = tx.sparkSession
    try:
        features = prepare_features(tx, config, workspace)
        sweep = k_sweep(features, config.sweep_ks, config.sweep_n_init, config.random_state)
        final = fit_kmeans(features, config.k_final, config.n_init, config.random_state)
        labelled = workspace.save(label_customers(features, final.centers), "labelled")
        require_labelled(labelled)
        write_scored(labelled, f"{output}/rfm_scored", fmt)
        write_summary(segment_summary(labelled), f"{output}/segment_summary", fmt)
        for name, table in (
            ("k_sweep", sweep),
            ("box_stats", segment_box_stats(labelled)),
            ("scatter", scatter_points(labelled)),
            ("radar", segment_radar(labelled)),
        ):
            write_table(table, f"{output}/{name}", fmt)
    finally:
        if own:
            workspace.clear()
    return Segmentation(
        read_scored(spark, f"{output}/rfm_scored", fmt),
        read_summary(spark, f"{output}/segment_summary", fmt),
        sweep,
    )
