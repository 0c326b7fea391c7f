"""

``entry(spark)`` runs the flagship query, ``queries()`` names every operator as a callable over a
folder of Parquet tables, and ``oracle_sql()`` gives the SQL each of them is compared with.
"""

from __future__ import annotations

import datetime as dt
import sys
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parent))

import duckdb_checks  # noqa: E402
from patronscope.config import CustomerFilter, HeatmapBands, SegmentationConfig  # noqa: E402
from patronscope.functions.numeric import half_even  # noqa: E402
from patronscope.operators import brands, explorer, reports, rfm, segments, snapshots  # noqa: E402
from patronscope.operators import clustering as cl  # noqa: E402
from patronscope.operators import features as ft  # noqa: E402
from patronscope.operators.clean import clean_transactions, load_stats  # noqa: E402
from patronscope.plans import pipeline  # noqa: E402
from patronscope.sources import tables, transactions  # noqa: E402
from patronscope.sources.small import small_table  # noqa: E402
from patronscope.sources.workspace import Workspace  # noqa: E402
from patronscope.streaming import incremental  # noqa: E402

try:
    import corpus_pipeline
    from patronscope.llm import queries as llm_queries
except ModuleNotFoundError as missing:  # the subpackage and its pipeline are optional, no more
    if not (missing.name or "").startswith(("corpus_pipeline", "patronscope.llm")):
        raise
    llm_queries = None

CONFIG = SegmentationConfig()
# Centres in feature space that make the clustering, and so all reports, reproducible in SQL.
CENTERS = (
    (-0.6, 1.5, 1.5),
    (-0.4, 0.5, 0.5),
    (0.0, -0.1, -0.1),
    (0.3, -0.9, -0.9),
    (2.4, -1.2, -1.2),
)
STARTS = duckdb_checks.SWEEP_STARTS
# End of the earlier snapshot, and the span of stored transactions that is read back.
CUT = "2000-01-01 00:00:00"
SPAN = (dt.datetime(1997, 3, 9), dt.datetime(1998, 2, 17))
# Batches in which stored lines arrive.
BATCHES = 5
SELECTED = ("Champions", "Loyal Customers", "At Risk")
CHOSEN = CustomerFilter(SELECTED, 6, 12, 100_000, 900_000)
BANDS = HeatmapBands(
    monetary_edges=(0, 200_000, 400_000, 600_000, 1_000_000),
    monetary_labels=("0-200k", "200k-400k", "400k-600k", "600k-1M", "1M+"),
)

Query = Callable[[SparkSession, str], DataFrame]


def _clean(spark: SparkSession, folder: str) -> DataFrame:
    return clean_transactions(transactions.from_order_tables(spark, folder))


def _rfm(spark: SparkSession, folder: str, workspace: Workspace | None = None) -> DataFrame:
    return rfm.rfm_base(_clean(spark, folder), workspace or Workspace(spark))


def _scored(spark: SparkSession, folder: str) -> DataFrame:
    lines = transactions.from_order_tables(spark, folder)
    return pipeline.score_customers(lines, Workspace(spark))[0]


def _features(spark: SparkSession, folder: str) -> DataFrame:
    lines = transactions.from_order_tables(spark, folder)
    return pipeline.prepare_features(lines, CONFIG, Workspace(spark))


def _assigned(spark: SparkSession, folder: str) -> DataFrame:
    return cl.assign_centroid(_features(spark, folder), CENTERS)


def _labelled(spark: SparkSession, folder: str) -> DataFrame:
    """Labelled customers as the reports read them: from a stored table."""
    labelled = pipeline.label_customers(_features(spark, folder), CENTERS)
    return Workspace(spark).save(labelled, "labelled")


def _summary(spark: SparkSession, folder: str) -> DataFrame:
    return reports.segment_summary(_labelled(spark, folder))


def _six(df: DataFrame, *names: str) -> DataFrame:
    """Round to six digits, past which two engines' sums of doubles may differ."""
    return df.withColumns({n: F.expr(half_even(n, 6)) for n in names})


def _clean_transactions(spark: SparkSession, folder: str) -> DataFrame:
    # Two engines hold decimals and timestamps in different units; doubles and text compare as is.
    kinds = {"unit_price": "double", "revenue": "double", "invoice_ts": "string"}
    return _clean(spark, folder).withColumns({n: F.col(n).cast(k) for n, k in kinds.items()})


def _rfm_base_events(spark: SparkSession, folder: str) -> DataFrame:
    sales = clean_transactions(transactions.from_events(spark, folder))
    return rfm.rfm_base(sales, Workspace(spark))


def _rfm_ranks(spark: SparkSession, folder: str) -> DataFrame:
    workspace = Workspace(spark)
    return rfm.rfm_ranks(rfm.metric_order(_rfm(spark, folder, workspace), workspace))


def _caps(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    base = _rfm(spark, folder)
    marks = rfm.landmarks(base, CONFIG.cap_quantiles)
    return base, ft.outlier_caps(base, marks, CONFIG.cap_quantiles)


def _outlier_caps(spark: SparkSession, folder: str) -> DataFrame:
    return _six(_caps(spark, folder)[1], "recency_cap", "frequency_cap", "monetary_cap")


def _capped(spark: SparkSession, folder: str) -> DataFrame:
    return ft.capped_features(*_caps(spark, folder))


def _capped_features(spark: SparkSession, folder: str) -> DataFrame:
    names = ["recency_capped", "frequency_capped", "monetary_capped"]
    return _six(_capped(spark, folder).select("customer_id", *names), *names)


def _scaled_features(spark: SparkSession, folder: str) -> DataFrame:
    scaled = ft.scaled_features(_capped(spark, folder))
    return _six(scaled.select("customer_id", *ft.FEATURES), *ft.FEATURES)


def _k_sweep(spark: SparkSession, folder: str) -> DataFrame:
    """Training from constant centres for a few passes, which SQL can follow step by step."""
    init = {k: [STARTS[:k]] for k in CONFIG.sweep_ks}
    sweep = cl.k_sweep(
        _features(spark, folder), CONFIG.sweep_ks, 1, 0, duckdb_checks.PASSES, 0.0, init=init
    )
    return _six(sweep, "inertia", "silhouette")


def _kmeans_segments(spark: SparkSession, folder: str) -> DataFrame:
    features, k = _features(spark, folder), CONFIG.k_final
    found = cl.fit_kmeans(features, k, 1, 0, duckdb_checks.PASSES, 0.0, init=[STARTS[:k]])
    return cl.assign_centroid(features, found.centers).select("customer_id", "cluster")


def _assign_centroid(spark: SparkSession, folder: str) -> DataFrame:
    return _six(_assigned(spark, folder).select("customer_id", "cluster", "dist2"), "dist2")


def _segment_box_stats(spark: SparkSession, folder: str) -> DataFrame:
    boxes = reports.segment_box_stats(_labelled(spark, folder))
    return _six(boxes, "q1", "median", "q3", "whisker_lo", "whisker_hi")


def _segment_vs_portfolio(spark: SparkSession, folder: str) -> DataFrame:
    boxes = reports.segment_vs_portfolio(_labelled(spark, folder), "At Risk", CHOSEN)
    return _six(boxes, "q1", "median", "q3", "whisker_lo", "whisker_hi", "mean")


def _scored_roundtrip(spark: SparkSession, folder: str) -> DataFrame:
    path = f"{Workspace(spark).path}/rfm_scored_csv"
    tables.write_scored(_labelled(spark, folder), path, "csv")
    return tables.read_scored(spark, path, "csv")


def _seeded_sweep(spark: SparkSession, folder: str) -> DataFrame:
    """Training to convergence from drawn starts, as the batch run does it."""
    return cl.k_sweep(
        _features(spark, folder), CONFIG.sweep_ks, CONFIG.sweep_n_init, CONFIG.random_state
    )


def _seeded_segments(spark: SparkSession, folder: str) -> DataFrame:
    features = _features(spark, folder)
    found = cl.fit_kmeans(features, CONFIG.k_final, CONFIG.n_init, CONFIG.random_state)
    return cl.assign_centroid(features, found.centers).select("customer_id", "cluster")


def _checked_labels(spark: SparkSession, folder: str) -> DataFrame:
    labelled = _labelled(spark, folder)
    segments.require_labelled(labelled)
    return labelled


def _empty_segments(spark: SparkSession, folder: str) -> DataFrame:
    """Three clusters for five names, so two segments are empty."""
    labelled = pipeline.label_customers(_features(spark, folder), CENTERS[:3])
    return segments.empty_segments(Workspace(spark).save(labelled, "labelled"))


def _summary_roundtrip(spark: SparkSession, folder: str) -> DataFrame:
    path = f"{Workspace(spark).path}/segment_summary_csv"
    tables.write_summary(_summary(spark, folder), path, "csv")
    return tables.read_summary(spark, path, "csv")


def _explorer_export(spark: SparkSession, folder: str) -> DataFrame:
    """The exported view, read back with the types of the table."""
    path = f"{Workspace(spark).path}/explorer_csv"
    view = explorer.explorer_table(_labelled(spark, folder), CHOSEN, "recency", True)
    explorer.export_view(view, path)
    return spark.read.schema(view.schema).option("header", True).csv(path)


def _brand_scores(spark: SparkSession, folder: str) -> DataFrame:
    workspace = Workspace(spark)
    lines = transactions.from_order_tables(spark, folder)
    return brands.scores_by(brands.rfm_by(lines, "brand", workspace), "brand", workspace)


def _staged(lines: DataFrame, path: str) -> DataFrame:
    """A stream of ``lines``, dealt at random into ``BATCHES`` batches that are stored under ``path``.

    Spark cuts a large batch into tasks, and so files, of its advised size. As many files as make a
    batch arrive together, so neither a task nor the number of batches grows with the lines.
    """
    spark = lines.sparkSession
    dealt = lines.withColumn("batch", F.expr(f"pmod(xxhash64(*), {BATCHES})"))
    dealt.hint("rebalance", "batch").write.partitionBy("batch").parquet(path)
    stored = f"{path}/batch=*"
    files = len(spark.read.schema(lines.schema).parquet(stored).inputFiles())
    return (
        spark.readStream.schema(lines.schema)
        .option("maxFilesPerTrigger", max(1, -(-files // BATCHES)))
        .parquet(stored)
    )


def _incremental(spark: SparkSession, folder: str) -> DataFrame:
    """All lines dealt into batches at random, so that invoices are split, and streamed in."""
    workspace = Workspace(spark)
    lines = transactions.canonical(transactions.from_order_tables(spark, folder))
    stream = _staged(lines, f"{workspace.path}/staged")
    state = incremental.InvoiceState(spark, f"{workspace.path}/state")
    incremental.ingest(stream, state, f"{workspace.path}/progress", fold_every=3)
    return state.rfm_base(workspace)


def _snapshots(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Labelled customers as of ``CUT`` and as of the last sale."""
    lines = transactions.canonical(transactions.from_order_tables(spark, folder))
    found = []
    for tx in (lines.where(f"invoice_ts < timestamp_ntz'{CUT}'"), lines):
        workspace = Workspace(spark)
        features = pipeline.prepare_features(tx, CONFIG, workspace)
        found.append(workspace.save(pipeline.label_customers(features, CENTERS), "labelled"))
    return found[0], found[1]


def _segment_drift(spark: SparkSession, folder: str) -> DataFrame:
    drift = snapshots.segment_drift(*_snapshots(spark, folder))
    return _six(drift, "share_before", "share_after", "change", "psi", "psi_total")


def _transactions_between(spark: SparkSession, folder: str) -> DataFrame:
    path = f"{Workspace(spark).path}/by-month"
    transactions.write_by_month(transactions.from_order_tables(spark, folder), path)
    found = transactions.read_between(spark, path, *SPAN)
    return found.withColumns({"invoice_ts": F.col("invoice_ts").cast("string"),
                              "unit_price": F.col("unit_price").cast("double")})


def _playbook(spark: SparkSession) -> DataFrame:
    return small_table(spark, duckdb_checks.TEST_PLAYBOOK, segments.PLAYBOOK_SCHEMA)


def _on_labelled(report: Callable[..., DataFrame], *arguments) -> Query:
    return lambda spark, folder: report(_labelled(spark, folder), *arguments)


def _on_summary(report: Callable[..., DataFrame], *arguments) -> Query:
    return lambda spark, folder: report(_summary(spark, folder), *arguments)


def entry(spark: SparkSession) -> DataFrame:
    """Flagship query: transactions to scored, clustered and named customers."""
    return queries()["segment_labels"](spark, "/root/testdata/sf0.001")


def queries() -> dict[str, Query]:
    """One entry per operator; each callable takes (spark, folder of Parquet tables)."""
    found: dict[str, Query] = {
        "clean_transactions": _clean_transactions,
        "load_stats": lambda s, d: load_stats(_clean(s, d)),
        "rfm_base": _rfm,
        "rfm_base_events": _rfm_base_events,
        "rfm_ranks": _rfm_ranks,
        "rfm_scores": _scored,
        "score_range": lambda s, d: rfm.score_range(_scored(s, d)),
        "outlier_caps": _outlier_caps,
        "capped_features": _capped_features,
        "scaled_features": _scaled_features,
        "k_sweep": _k_sweep,
        "kmeans_segments": _kmeans_segments,
        "assign_centroid": _assign_centroid,
        "inertia_fixed": lambda s, d: _six(cl.inertia(_assigned(s, d)), "inertia"),
        "silhouette_exact": lambda s, d: _six(
            cl.silhouette(_assigned(s, d), cl.EUCLIDEAN), "silhouette"
        ),
        "silhouette_squared": lambda s, d: _six(
            cl.silhouette(_assigned(s, d), cl.SQUARED), "silhouette"
        ),
        "cluster_ranking": lambda s, d: segments.cluster_ranking(_assigned(s, d)),
        "silhouette_sampled": lambda s, d: _six(
            cl.sampled_silhouette(_assigned(s, d), 10), "silhouette", "std_error"
        ),
        "segment_labels": _checked_labels,
        "empty_segments": _empty_segments,
        "cluster_segment_mean": _on_labelled(segments.cluster_segment_mean),
        "segment_counts": _on_labelled(segments.segment_counts),
        "segment_summary": _summary,
        "segment_share": _on_summary(reports.segment_share, SELECTED),
        "segment_kpis": _on_summary(reports.segment_kpis, "At Risk"),
        "filter_bounds": _on_labelled(reports.filter_bounds),
        "filtered_customers": _on_labelled(reports.filtered_customers, CHOSEN),
        "portfolio_kpis": lambda s, d: _six(
            reports.portfolio_kpis(_labelled(s, d), CHOSEN),
            "avg_monetary",
            "avg_recency",
            "avg_frequency",
        ),
        "rfm_heatmap": _on_labelled(reports.rfm_heatmap, CHOSEN, BANDS),
        "score_histogram": _on_labelled(reports.score_histogram, CHOSEN),
        "segment_box_stats": _segment_box_stats,
        "segment_vs_portfolio": _segment_vs_portfolio,
        "segment_radar": lambda s, d: _six(
            reports.segment_radar(_labelled(s, d)), "recency_inv", "frequency", "monetary"
        ),
        "scatter_points": _on_labelled(reports.scatter_points),
        "customer_profile": _on_labelled(explorer.customer_profile, " 101 "),
        "explorer_table": _on_labelled(explorer.explorer_table, CHOSEN, "monetary", False),
        "segment_playbook": lambda s, d: segments.segment_playbook(_labelled(s, d), _playbook(s)),
        "scored_roundtrip": _scored_roundtrip,
        "summary_roundtrip": _summary_roundtrip,
        "explorer_export": _explorer_export,
        "rfm_incremental": _incremental,
        "brand_scores": _brand_scores,
        "segment_migration": lambda s, d: snapshots.segment_migration(*_snapshots(s, d)),
        "segment_drift": _segment_drift,
        "transactions_between": _transactions_between,
        "k_sweep_seeded": _seeded_sweep,
        "kmeans_segments_seeded": _seeded_segments,
    }
    if llm_queries:
        found |= llm_queries.queries() | {"pipeline": corpus_pipeline.run}
    return found


def oracle_sql() -> dict[str, str]:
    """SQL for every query that SQL can express."""
    found = duckdb_checks.all_checks()
    if llm_queries:
        found |= llm_queries.oracle_sql()
    return found
