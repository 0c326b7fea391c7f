import pytest
from conftest import rows

from patronscope.catalog import SEGMENTS
from patronscope.operators.segments import (
    cluster_ranking,
    cluster_segment_mean,
    empty_segments,
    in_display_order,
    require_labelled,
    segment_counts,
    segment_labels,
    PLAYBOOK_SCHEMA,
    segment_playbook,
)

ASSIGNED = "customer_id int, cluster int, rfm_score int, monetary double"


@pytest.fixture()
def assigned(spark):
    """Cluster 0 beats 2 on spend at equal score; 7 is worst; 4 and 5 tie in full."""
    values = [
        (1, 2, 12, 50.0), (2, 2, 12, 70.0), (3, 0, 11, 90.0), (4, 0, 13, 110.0),
        (5, 7, 3, 1.0), (6, 5, 8, 10.0), (7, 4, 8, 10.0),
    ]
    return spark.createDataFrame(values, ASSIGNED)


def test_ranking(assigned):
    assert rows(cluster_ranking(assigned)) == [
        (0, 12.0, 100.0, 1), (2, 12.0, 60.0, 2), (4, 8.0, 10.0, 3), (5, 8.0, 10.0, 4), (7, 3.0, 1.0, 5)
    ]


def test_labels(assigned):
    labelled = segment_labels(assigned, cluster_ranking(assigned))
    require_labelled(labelled)
    found = {r.cluster: r.segment for r in labelled.collect()}
    assert [found[c] for c in (0, 2, 4, 5, 7)] == list(SEGMENTS)
    assert labelled.columns == [*assigned.columns, "segment"]
    assert empty_segments(labelled).count() == 0


def test_more_clusters_than_names(assigned):
    labelled = segment_labels(assigned, cluster_ranking(assigned), SEGMENTS[:4])
    with pytest.raises(ValueError, match="1 customers have no segment"):
        require_labelled(labelled)


def test_fewer_clusters_than_names(assigned):
    few = assigned.where("cluster in (0, 2)")
    labelled = segment_labels(few, cluster_ranking(few))
    require_labelled(labelled)
    assert {r[0] for r in rows(empty_segments(labelled))} == set(SEGMENTS[2:])


def test_means_and_counts(assigned):
    labelled = segment_labels(assigned.union(assigned.where("customer_id = 3")), cluster_ranking(assigned))
    means = {r.cluster: r.avg_rfm_score for r in cluster_segment_mean(labelled).collect()}
    assert means[0] == 11.7 and means[2] == 12.0
    assert rows(segment_counts(labelled))[:2] == [("Champions", 3), ("Loyal Customers", 2)]


def test_unknown_segments_come_last(spark):
    df = spark.createDataFrame([("Zebra",), ("At Risk",), ("Champions",), (None,)], "segment string")
    assert [r[0] for r in rows(in_display_order(df))][:2] == ["Champions", "At Risk"]


def test_playbook(assigned):
    few = assigned.where("cluster in (0, 2)")
    own = [("Champions", "p", ["x", "y", "z"], "t"), ("Nobody", "q", ["u"], "v")]
    table = few.sparkSession.createDataFrame(own, PLAYBOOK_SCHEMA)
    plays = rows(segment_playbook(segment_labels(few, cluster_ranking(few)), table))
    assert sorted(tuple(p) for p in plays) == [
        ("Champions", 2, "p", n, a, "t") for n, a in enumerate("xyz", 1)
    ]


def test_naming_joins_no_customers(assigned):
    plan = segment_labels(assigned, cluster_ranking(assigned))
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in text and "NestedLoop" not in text and "Cartesian" not in text
