import datetime as dt
import math

import pytest
from conftest import TX, day, plan_text, rows

from patronscope.catalog import SEGMENTS
from patronscope.operators.brands import rfm_by, scores_by
from patronscope.operators.clustering import EUCLIDEAN, sampled_silhouette, silhouette
from patronscope.operators.snapshots import (
    customer_moves,
    migration_matrix,
    segment_drift,
    segment_migration,
)
from patronscope.sources.transactions import read_between, write_by_month

BEST, LOYAL = SEGMENTS[:2]
LAB = "customer_id bigint, segment string"


@pytest.fixture()
def pair(spark):
    before = [(1, BEST), (2, BEST), (3, LOYAL), (4, LOYAL), (5, None)]
    after = [(2, BEST), (3, BEST), (4, None), (5, LOYAL), (6, LOYAL), (7, LOYAL)]
    return spark.createDataFrame(before, LAB), spark.createDataFrame(after, LAB)


def test_moves(pair):
    assert {tuple(r) for r in customer_moves(*pair).collect()} == {
        (1, BEST, "left"), (2, BEST, BEST), (3, LOYAL, BEST), (4, LOYAL, None), (5, None, LOYAL),
        (6, "entered", LOYAL), (7, "entered", LOYAL),
    }


def test_migration_adds_up_to_both_snapshots(pair):
    found = rows(segment_migration(*pair))
    assert (BEST, "left", 1, 50.0) in found and ("entered", LOYAL, 2, 100.0) in found
    for at, side in ((0, pair[0]), (1, pair[1])):
        sums = {}
        for row in found:
            sums[row[at]] = sums.get(row[at], 0) + row[2]
        counts = {r.segment: r["count"] for r in side.groupBy("segment").count().collect()}
        assert {k: v for k, v in sums.items() if k not in ("entered", "left")} == counts
    matrix = {r.from_segment: r for r in migration_matrix(segment_migration(*pair)).collect()}
    assert matrix[BEST][BEST] == matrix[BEST]["left"] == 1 and matrix[BEST][LOYAL] == 0


def test_empty_snapshots(pair):
    none = pair[0].limit(0)
    assert segment_migration(none, none).count() == 0
    assert {r.from_segment for r in segment_migration(none, pair[1]).collect()} == {"entered"}
    drift = segment_drift(none, pair[1]).collect()
    assert [r.segment for r in drift] == list(SEGMENTS)
    assert all(r.share_before is None and r.psi_total is None and not r.shifted for r in drift)


def test_drift(pair):
    """Shares 2/4 and 2/4 become 2/5 and 3/5; the other names are empty on both sides."""
    found = {r.segment: r for r in segment_drift(*pair).collect()}
    assert [found[s].n_before for s in SEGMENTS] == [2, 2, 0, 0, 0]
    assert found[BEST].change == pytest.approx(-0.1)
    empty = (0.5 / 5 - 0.5 / 4) * math.log(4 / 5)
    parts = [-0.1 * math.log(0.8), 0.1 * math.log(1.2), *[empty] * 3]
    assert [found[s].psi for s in SEGMENTS] == pytest.approx(parts)
    assert found[BEST].psi_total == pytest.approx(sum(parts))
    assert not found[BEST].shifted
    assert segment_drift(*pair, alert=0.05).first().shifted
    same = segment_drift(pair[0], pair[0]).first()
    assert same.psi_total == 0 and same.change == 0


def test_scores_within_a_brand(spark, workspace):
    """A brand with most customers, one with two, one with a single one and lines without brand."""
    lines, at = [], dt.datetime(2022, 5, 1, 9)
    for c in range(1, 201):
        for i in range(1 + c % 3):
            lines.append((f"{c}-{i}", at + dt.timedelta(days=c % 17, hours=i), c, 1 + i, c % 23 + 0.5, "big"))
    lines += [("s1", at, 1, 1, 9.0, "small"), ("s2", at, 2, 1, 9.0, "small"), ("o", at, 3, 1, 1.0, "one")]
    lines += [("n1", at, 8, 1, 2.0, None), ("n2", at, 9, 1, 3.0, None), ("Cx", at, 9, 1, 3.0, "one")]
    tx = spark.createDataFrame(lines, TX + ", brand string").repartition(5)
    got = {(r.brand, r.customer_id): r for r in scores_by(rfm_by(tx, "brand", workspace), "brand", workspace).collect()}
    assert len(got) == 205
    end = max(line[1] for line in lines)
    for brand in ("big", "small", None):
        own = [r for (b, _), r in got.items() if b == brand]
        for metric, score in (("recency", "r_score"), ("frequency", "f_score"), ("monetary", "m_score")):
            ordered = sorted(own, key=lambda r: (r[metric], r.customer_id))
            for i, row in enumerate(ordered):
                bucket = next(q for q in range(1, 6) if 5 * i <= q * (len(own) - 1))
                assert row[score] == (6 - bucket if metric == "recency" else bucket)
    assert got["big", 5].recency == (end - (at + dt.timedelta(days=5, hours=2))).days + 1
    assert got["big", 5].monetary == 5.5 * 6
    alone = got["one", 3]
    assert (alone.frequency, alone.r_score, alone.rfm_score) == (1, None, None)


def test_months_are_pruned(spark, tmp_path):
    lines = [(str(i), day("2020-01-10 08:00:00") + dt.timedelta(days=20 * i), i, 1, 2.5) for i in range(20)]
    lines.append(("none", None, 1, 1, 1.0))
    path = str(tmp_path / "tx")
    write_by_month(spark.createDataFrame(lines, TX), path)
    since, until = dt.datetime(2020, 3, 10, 8), dt.datetime(2020, 6, 1)
    got = read_between(spark, path, since, until)
    assert sorted(r.invoice_no for r in got.collect()) == sorted(
        x[0] for x in lines if x[1] and since <= x[1] < until
    )
    plan = plan_text(got)
    assert "PartitionFilters: [isnotnull(invoice_month" in plan
    assert "2020-03" in plan and "PushedFilters: [IsNotNull(invoice_ts), GreaterThanOrEqual(invoice_ts" in plan


def test_sampled_silhouette_is_near_the_exact_one(spark):
    points = spark.sql(
        "select id as customer_id, cast(id % 3 as int) as cluster,"
        " id % 3 * 4 + rand(1) as z_recency, rand(2) * 3 as z_frequency, rand(3) as z_monetary"
        " from range(900)"
    ).cache()
    exact = silhouette(points, EUCLIDEAN).first().silhouette
    whole = sampled_silhouette(points, 1).first()
    assert whole.silhouette == pytest.approx(exact, rel=1e-12) and whole.sampled == 900
    some = sampled_silhouette(points, 7).first()
    assert abs(some.silhouette - exact) < 4 * some.std_error and some.sampled == 129
    with pytest.raises(ValueError, match="sample_mod"):
        sampled_silhouette(points, 5000)
