import numpy as np
import pandas as pd
import pytest
from pyspark.ml.clustering import KMeans
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.feature import VectorAssembler
from brute_force import silhouette_by_hand

from patronscope.operators import clustering, kmeans
from patronscope.operators.clustering import (
    EUCLIDEAN,
    SQUARED,
    assign_centroid,
    fit_kmeans,
    inertia,
    k_sweep,
    sampled_silhouette,
    silhouette,
)
from patronscope.operators.features import FEATURES


@pytest.fixture(scope="module")
def blobs(spark):
    rng = np.random.default_rng(11)
    means = rng.normal(size=(5, 3)) * 4
    points = np.vstack([rng.normal(m, 0.6, (60, 3)) for m in means])
    table = pd.DataFrame(points, columns=list(FEATURES))
    table.insert(0, "customer_id", np.arange(len(table)))
    return spark.createDataFrame(table).cache()


def test_assignment_and_ties(spark):
    df = spark.createDataFrame(
        [(1, 0.0, 0.0, 0.0), (2, 0.9, 0.0, 0.0), (3, 0.5, 0.0, 0.0)],
        "customer_id int, z_recency double, z_frequency double, z_monetary double",
    )
    assigned = assign_centroid(df, [(0, 0, 0), (1, 0, 0)])
    got = {r.customer_id: (r.cluster, r.dist2) for r in assigned.collect()}
    assert got[1] == (0, 0.0) and got[3] == (0, 0.25)
    assert got[2][0] == 1 and got[2][1] == pytest.approx(0.01)
    assert inertia(assigned).first()[0] == pytest.approx(0.26)


def test_finds_the_blobs(blobs):
    found = fit_kmeans(blobs, 5, starts=5, seed=42)
    assert sorted(found.sizes) == [60] * 5
    assigned = assign_centroid(blobs, found.centers)
    assert inertia(assigned).first()[0] == pytest.approx(found.inertia)
    assert assigned.select("cluster").distinct().count() == 5
    again = fit_kmeans(blobs, 5, starts=5, seed=42)
    assert np.allclose(again.centers, found.centers)


def test_not_worse_than_mllib(blobs):
    vectors = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(blobs)
    theirs = min(
        KMeans(k=4, seed=s, maxIter=300).fit(vectors).summary.trainingCost for s in range(3)
    )
    assert fit_kmeans(blobs, 4, starts=8, seed=0).inertia <= theirs * 1.001


def test_given_starts_train_by_plain_steps(blobs):
    starts = [(-2.0, 0.0, 1.0), (0.5, 0.5, 0.5), (3.0, -1.0, 0.0)]
    points = [tuple(r) for r in blobs.select(*FEATURES).collect()]
    centers = list(starts)
    for _ in range(3):
        members = [[] for _ in centers]
        for p in points:
            gaps = [sum((a - b) ** 2 for a, b in zip(p, c)) for c in centers]
            members[gaps.index(min(gaps))].append(p)
        centers = [tuple(sum(axis) / len(own) for axis in zip(*own)) for own in members]
    found = fit_kmeans(blobs, 3, starts=1, seed=0, max_iter=3, tol=0.0, init=[starts])
    assert np.allclose(found.centers, centers)


def test_lost_centres_come_back(blobs):
    starts = [(0, 0, 0), (50, 50, 50), (60, 60, 60), (1, 1, 1), (-70, 0, 0)]
    found = fit_kmeans(blobs, 5, starts=1, seed=0, init=[starts])
    assert min(found.sizes) > 0 and sum(found.sizes) == blobs.count()
    assert assign_centroid(blobs, found.centers).select("cluster").distinct().count() == 5


def test_starts_come_from_all_rows_and_follow_the_seed(blobs):
    with kmeans._cached_points(blobs) as points:
        first = kmeans._drawn_starts(points, [(4, 1), (4, 2)])
        again = kmeans._drawn_starts(points.repartition(9, "z_monetary"), [(4, 1), (4, 2)])
    rows = {tuple(r) for r in blobs.select(*FEATURES).collect()}
    assert all(len({tuple(c) for c in start} & rows) == 4 for start in first)
    assert np.array_equal(first, again)
    assert not np.array_equal(first[0], first[1])


def test_sweep(blobs):
    got = k_sweep(blobs, range(2, 7), starts=4, seed=42).toPandas()
    assert got["k"].tolist() == [2, 3, 4, 5, 6]
    assert got["inertia"].is_monotonic_decreasing
    assert got["silhouette"].between(-1, 1).all()
    assert set(got["measure"]) == {SQUARED}
    assert got.set_index("k")["silhouette"].idxmax() == 5


def test_silhouettes(blobs):
    centers = [(0, 0, 0), (2, 2, 2), (-3, 0, 1)]
    assigned = assign_centroid(blobs, centers)
    table = assigned.toPandas()
    points, labels = table[list(FEATURES)].to_numpy(), table["cluster"].to_numpy()
    exact = silhouette(assigned, EUCLIDEAN).first()
    assert exact.measure == EUCLIDEAN
    assert exact.silhouette == pytest.approx(silhouette_by_hand(points, labels))
    squared = silhouette(assigned).first()
    assert squared.measure == SQUARED
    assert squared.silhouette == pytest.approx(silhouette_by_hand(points, labels, squared=True))
    vectors = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(assigned)
    theirs = ClusteringEvaluator(predictionCol="cluster").evaluate(
        vectors.withColumn("cluster", vectors.cluster.cast("double"))
    )
    assert squared.silhouette == pytest.approx(theirs)


def test_sweep_keeps_the_measure_asked_for(blobs):
    got = k_sweep(blobs, [3, 5], starts=4, seed=42, measure=EUCLIDEAN).toPandas()
    assert set(got["measure"]) == {EUCLIDEAN}
    assert got["silhouette"].is_monotonic_increasing


@pytest.mark.parametrize("tile", [7, 64])
def test_tiles_do_not_change_a_silhouette(blobs, monkeypatch, tile):
    assigned = assign_centroid(blobs, [(0, 0, 0), (2, 2, 2), (-3, 0, 1)])
    whole = silhouette(assigned, EUCLIDEAN).first().silhouette
    monkeypatch.setattr(clustering, "TILE", tile)
    assert silhouette(assigned, EUCLIDEAN).first().silhouette == pytest.approx(whole)


def test_order_of_rows_does_not_matter(blobs):
    first = fit_kmeans(blobs.repartition(7), 4, starts=2, seed=3)
    second = fit_kmeans(blobs.repartition(2, "z_recency"), 4, starts=2, seed=3)
    assert np.allclose(first.centers, second.centers)


def test_lone_points_and_twins(spark):
    df = spark.createDataFrame(
        [(0.0, 0.0, 0.0, 3), (0.0, 0.0, 0.0, 3), (1.0, 0.0, 0.0, 7), (5.0, 0.0, 0.0, 9), (5.0, 1.0, 0.0, 9)],
        "z_recency double, z_frequency double, z_monetary double, cluster int",
    )
    table = df.toPandas()
    want = silhouette_by_hand(table[list(FEATURES)].to_numpy(), table["cluster"].to_numpy())
    assert silhouette(df, EUCLIDEAN).first().silhouette == pytest.approx(want)


def test_too_few_customers(spark, blobs):
    few = blobs.limit(4)
    with pytest.raises(ValueError, match="at least as many customers"):
        fit_kmeans(few, 5, starts=1, seed=0)
    with pytest.raises(ValueError, match="silhouette"):
        k_sweep(few, [2, 3, 4], starts=1, seed=0)
    with pytest.raises(ValueError, match="silhouette"):
        silhouette(assign_centroid(few, [(0, 0, 0)]))


def test_fewer_distinct_points_than_centres(spark):
    schema = "customer_id int, " + ", ".join(f"{f} double" for f in FEATURES)
    same = spark.createDataFrame([(i, 1.0, 1.0, 1.0) for i in range(6)], schema)
    found = fit_kmeans(same, 3, starts=1, seed=0)
    assert sum(found.sizes) == 6 and found.inertia == 0


def test_repeated_customers_are_measured_once(blobs, monkeypatch):
    """Equal points are one that counts as often, so copies add nothing to the quadratic work."""
    assigned = assign_centroid(blobs, [(0, 0, 0), (2, 2, 2), (-3, 0, 1)])
    often = assigned.selectExpr("*", "explode(sequence(0, customer_id % 5)) as copy")
    points = often.select(*FEATURES, "cluster")
    totals = clustering._cluster_totals(points, ["cluster"])
    with clustering._pairwise_sums(points, ["cluster"], totals) as summed:
        assert summed.count() == assigned.count() < points.count()
    table = points.toPandas()
    want = silhouette_by_hand(table[list(FEATURES)].to_numpy(), table["cluster"].to_numpy())
    monkeypatch.setattr(clustering, "TILE", 50)
    assert silhouette(points, EUCLIDEAN).first().silhouette == pytest.approx(want)


def test_samples_of_any_size(blobs, monkeypatch):
    """Samples beyond the former bound of 20,000, whole and in part, in several tiles."""
    monkeypatch.setattr(clustering, "TILE", 50)
    assigned = assign_centroid(blobs, [(0, 0, 0), (2, 2, 2), (-3, 0, 1)])
    often = assigned.selectExpr("*", "explode(sequence(0, 139)) as copy")
    many = often.withColumn("customer_id", often.customer_id + often.copy * 300)
    table = assigned.toPandas()
    points, labels = table[list(FEATURES)].to_numpy(), table["cluster"].to_numpy()
    n = len(points) * 140
    whole = sampled_silhouette(many, 1).first()
    exact = silhouette(many, EUCLIDEAN).first().silhouette
    assert whole.sampled == n and whole.silhouette == pytest.approx(exact)
    some = sampled_silhouette(many, 2).first()
    assert some.sampled == n // 2
    gaps = np.sqrt(((points[:, None] - points[None]) ** 2).sum(axis=2))
    sizes = np.bincount(labels) * 140
    sums = np.stack([gaps[:, labels == c].sum(axis=1) * 140 for c in range(3)], axis=1)
    gains = np.repeat(clustering._gains(sums, sizes.astype(float), labels)[::2], 140)
    assert some.silhouette == pytest.approx(gains.mean())
    assert some.std_error == pytest.approx(gains.std(ddof=1) / np.sqrt(n // 2))
