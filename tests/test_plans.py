import csv

import pytest
from conftest import SHOPPERS, rows

from patronscope.__main__ import main
from patronscope.catalog import SEGMENTS
from patronscope.config import CustomerFilter, SegmentationConfig
from patronscope.operators.segments import PLAYBOOK_SCHEMA
from patronscope.plans import dashboard
from patronscope.plans.pipeline import run
from patronscope.sources.transactions import PUBLISHED_NAMES

FAST = SegmentationConfig(n_init=4, sweep_n_init=2, k_range_end=6)


@pytest.fixture(scope="module")
def result(sales_df, tmp_path_factory):
    output = str(tmp_path_factory.mktemp("out"))
    return output, run(sales_df, output, FAST)


def test_every_customer_is_labelled(result):
    scored = result[1].scored.toPandas()
    assert len(scored) == SHOPPERS == scored["customer_id"].nunique()
    assert scored["segment"].notna().all()
    assert set(scored["segment"]) == set(SEGMENTS)
    assert scored["cluster"].nunique() == 5
    assert scored["rfm_score"].between(3, 15).all() and (scored["monetary"] > 0).all()


def test_best_segment_has_the_best_scores(result):
    medians = result[1].scored.toPandas().groupby("segment")["rfm_score"].median()
    assert medians[list(SEGMENTS)].is_monotonic_decreasing


def test_sweep_and_summary(result):
    sweep = result[1].sweep.toPandas()
    assert sweep["k"].tolist() == [2, 3, 4, 5, 6]
    assert sweep["silhouette"].between(-1, 1).all()
    summary = result[1].summary.toPandas()
    assert summary["segment"].tolist() == list(SEGMENTS)
    assert abs(summary["revenue_pct"].sum() - 100) < 0.5
    assert summary["customers"].sum() == SHOPPERS


def test_chart_tables_are_written(spark, result):
    sizes = {n: spark.read.parquet(f"{result[0]}/{n}").count() for n in
             ("rfm_scored", "segment_summary", "k_sweep", "box_stats", "scatter", "radar")}
    assert sizes["rfm_scored"] == sizes["scatter"]
    assert (sizes["segment_summary"], sizes["box_stats"], sizes["radar"]) == (5, 15, 5)


def test_dashboard_tabs(result):
    scored, summary = result[1].scored, result[1].summary
    chosen = CustomerFilter(segments=SEGMENTS[:3])
    plays = scored.sparkSession.createDataFrame(
        [(SEGMENTS[0], "p", ["a", "b"], "t")], PLAYBOOK_SCHEMA
    )
    assert dashboard.has_customers(scored, chosen)
    assert not dashboard.has_customers(scored, CustomerFilter(segments=[]))
    assert not dashboard.has_customers(scored, CustomerFilter(score_lo=16))
    frames = {
        **dashboard.overview(scored, summary, chosen),
        **{f"detail_{k}": v for k, v in
           dashboard.segment_detail(scored, summary, SEGMENTS[0], plays, chosen).items()},
        **dashboard.explorer(scored, chosen, "monetary", True),
    }
    counts = {name: len(rows(df)) for name, df in frames.items()}
    in_view = scored.where(scored.segment.isin(*SEGMENTS[:3])).count()
    assert counts["kpis"] == 1 and counts["shares"] == 3 and counts["heatmap"] == 30
    assert counts["detail_kpis"] == 1 and counts["detail_boxes"] == 6
    assert counts["detail_playbook"] == 2 and counts["table"] == in_view


def test_too_few_customers(sales_df, tmp_path):
    with pytest.raises(ValueError):
        run(sales_df.where("customer_id = 11"), str(tmp_path), FAST)


def test_command_line(spark, sales, tmp_path, capsys):
    with open(tmp_path / "tx.csv", "w", newline="") as file:
        out = csv.writer(file)
        out.writerow(PUBLISHED_NAMES.values())
        out.writerows(sales)
    (tmp_path / "c.yaml").write_text(
        "clustering: {k_final: 5, n_init: 3, sweep_n_init: 1, k_range_start: 2, k_range_end: 4}\n"
    )
    main(["--input", str(tmp_path / "tx.csv"), "--input-format", "csv", "--output",
          str(tmp_path / "out"), "--output-format", "csv", "--config", str(tmp_path / "c.yaml")])
    assert "Champions" in capsys.readouterr().out
    back = spark.read.option("header", True).csv(str(tmp_path / "out" / "rfm_scored"))
    assert back.count() == SHOPPERS and "RFM_Score" in back.columns
