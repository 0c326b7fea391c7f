"""Clusters of customers in feature space: assignment, choice of model, and quality."""

from __future__ import annotations

import sys
from collections.abc import Iterable, Iterator, Mapping, Sequence
from contextlib import contextmanager
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel, cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from patronscope.functions.numeric import double
from patronscope.operators.features import FEATURES
from patronscope.operators.kmeans import Clustering, fit_models, train
from patronscope.sources.small import small_table

# Functions of this module travel to tasks by value: workers need not have the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Points per tile of a pairwise silhouette: a task measures two tiles against each other.
TILE = 16_384
# Distances that a task holds at a time, 2 MB.
HELD = 1 << 18

EUCLIDEAN = "euclidean"
SQUARED = "squared_euclidean"


def nearest_center(centers: Sequence[Sequence[float]]) -> str:
    """SQL struct of the squared distance to the nearest centre and that centre's number.

    The centres are literals, so assignment is one projection without join or Python worker. Ties go
    to the lower number.
    """

    def candidate(number: int, center: Sequence[float]) -> str:
        gaps = [f"({f} - {double(c)})" for f, c in zip(FEATURES, center)]
        return f"struct({' + '.join(f'{g} * {g}' for g in gaps)} as dist2, {number} as cluster)"

    return f"array_min(array({', '.join(candidate(i, c) for i, c in enumerate(centers))}))"


def assign_centroid(features: DataFrame, centers: Sequence[Sequence[float]]) -> DataFrame:
    """Add the nearest centre's number as ``cluster`` and its squared distance as ``dist2``."""
    return features.selectExpr("*", f"{nearest_center(centers)} as nearest").selectExpr(
        *features.columns, "nearest.cluster", "nearest.dist2"
    )


def inertia(assigned: DataFrame) -> DataFrame:
    return assigned.selectExpr("sum(dist2) as inertia")


Centers = Sequence[Sequence[float]]


def fit_kmeans(
    features: DataFrame,
    k: int,
    starts: int,
    seed: int,
    max_iter: int = 300,
    tol: float = 1e-4,
    init: Sequence[Centers] | None = None,
) -> Clustering:
    """The best by inertia of ``starts`` seeded models, or of those that start from ``init``."""
    given = None if init is None else {k: init}
    return _best_of_starts(features, [k], starts, seed, max_iter, tol, given)[k]


def _best_of_starts(
    features: DataFrame,
    ks: Sequence[int],
    starts: int,
    seed: int,
    max_iter: int,
    tol: float,
    init: Mapping[int, Sequence[Centers]] | None,
) -> dict[int, Clustering]:
    if init is None:
        jobs = [(k, seed + i) for k in ks for i in range(starts)]
        models = fit_models(features, jobs, max_iter, tol)
    else:
        models = train(features, [start for k in ks for start in init[k]], max_iter, tol)
    best: dict[int, Clustering] = {}
    for model in models:
        k = len(model.centers)
        if k not in best or model.inertia < best[k].inertia:
            best[k] = model
    return best


def k_sweep(
    features: DataFrame,
    ks: Iterable[int],
    starts: int,
    seed: int,
    max_iter: int = 300,
    tol: float = 1e-4,
    measure: str = SQUARED,
    init: Mapping[int, Sequence[Centers]] | None = None,
) -> DataFrame:
    """Inertia and silhouette per number of clusters.

    ``measure`` holds at any size. The squared Euclidean silhouette takes two linear passes; the
    Euclidean one takes all distances, so its work is quadratic. With ``init``, starting centres per
    number of clusters, ``starts`` and ``seed`` have no effect.
    """
    ks = sorted(set(ks))
    best = _best_of_starts(features, ks, starts, seed, max_iter, tol, init)
    labels = [f"cluster_{k}" for k in ks]
    points = features.selectExpr(
        *FEATURES, *[f"{nearest_center(best[k].centers)}.cluster as cluster_{k}" for k in ks]
    )
    scores = _silhouettes(points, labels, measure)
    return small_table(
        features.sparkSession,
        [(k, best[k].inertia, score, measure) for k, score in zip(ks, scores)],
        "k int, inertia double, silhouette double, measure string",
    )


def silhouette(assigned: DataFrame, measure: str = SQUARED) -> DataFrame:
    """Mean silhouette of a clustering in one row; see :func:`k_sweep` for the measure."""
    points = assigned.select(*FEATURES, "cluster")
    (score,) = _silhouettes(points, ["cluster"], measure)
    return small_table(
        assigned.sparkSession, [(score, measure)], "silhouette double, measure string"
    )


def sampled_silhouette(assigned: DataFrame, sample_mod: int) -> DataFrame:
    """Estimate of the Euclidean silhouette from the customers whose id ``sample_mod`` divides.

    Each of them is measured against all customers, so only the mean over customers is estimated;
    ``std_error`` is its standard error. The sample may have any size: like all customers it is cut
    into tiles, and tasks measure pairs of tiles.
    """
    drawn = f"customer_id % {int(sample_mod)} = 0"
    points = assigned.selectExpr(*FEATURES, "cluster", f"coalesce({drawn}, false) as drawn")
    size = points.where("drawn").count()
    if size < 2:
        raise ValueError(f"sample_mod {sample_mod} picks {size} customers; it should be 2 or more")
    totals = _cluster_totals(points, ["cluster"])
    names = totals[0].names
    if not 2 <= len(names) < totals[0].sizes.sum():
        raise ValueError(f"a silhouette needs 2 clusters or more, found {len(names)}")
    with _pairwise_sums(points, ["cluster"], totals, "drawn") as summed:
        total, squares = _total_gains(summed, ["cluster"], totals)[0]
    mean = total / size
    error = float(np.sqrt(max(squares - size * mean**2, 0.0) / (size - 1) / size))
    return small_table(
        assigned.sparkSession,
        [(mean, error, size)],
        "silhouette double, std_error double, sampled bigint",
    )


def _silhouettes(
    points: DataFrame, labels: Sequence[str], measure: str
) -> list[float]:
    """Mean silhouette of each label column of ``points``, from passes shared by all of them."""
    if measure not in (EUCLIDEAN, SQUARED):
        raise ValueError(f"measure is {EUCLIDEAN!r} or {SQUARED!r}, not {measure!r}")
    totals = _cluster_totals(points, labels)
    n = int(totals[0].sizes.sum())
    for found in totals:
        if not 2 <= len(found.names) < n:
            raise ValueError(
                f"a silhouette of {n} customers needs 2 to {n - 1} clusters, "
                f"found {len(found.names)}"
            )
    sums = _pairwise_sums if measure == EUCLIDEAN else _squared_sums
    with sums(points, labels, totals) as summed:
        return [total / n for total, _ in _total_gains(summed, labels, totals)]


def _total_gains(
    summed: DataFrame, labels: Sequence[str], totals: Sequence[_Totals]
) -> list[tuple[float, float]]:
    """Per label column the sum of all customers' silhouettes, and that of their squares."""
    names = [f"{kind}_{label}" for label in labels for kind in ("sum", "squares")]

    def gains(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gained = np.zeros(len(names))
        for batch in batches:
            columns = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            numbers, alike, at = columns[: len(labels)], columns[len(labels)], len(labels) + 1
            for place, found in enumerate(totals):
                to_clusters = np.column_stack(columns[at : at + len(found.names)])
                at += len(found.names)
                home = np.searchsorted(found.names, numbers[place])
                gain = _gains(to_clusters, found.sizes, home)
                gained[2 * place] += (alike * gain).sum()
                gained[2 * place + 1] += (alike * gain**2).sum()
        yield pa.RecordBatch.from_arrays([pa.array([x]) for x in gained], names=names)

    gained = (
        summed.mapInArrow(gains, ", ".join(f"{name} double" for name in names))
        .agg(*[F.sum(name) for name in names])
        .first()
    )
    return list(zip(gained[::2], gained[1::2]))


@dataclass(frozen=True)
class _Totals:
    """Per cluster of one label column: number, size, coordinate sums, sum of squared norms."""

    names: np.ndarray
    sizes: np.ndarray
    sums: np.ndarray
    norms: np.ndarray


def _cluster_totals(points: DataFrame, labels: Sequence[str]) -> list[_Totals]:
    norm = " + ".join(f"{f} * {f}" for f in FEATURES)
    rows = (
        points.unpivot(list(FEATURES), list(labels), "label", "cluster")
        .groupBy("label", "cluster")
        .agg(
            F.expr("cast(count(*) as double) as n"),
            *[F.expr(f"sum({f}) as {f}") for f in FEATURES],
            F.expr(f"sum({norm}) as norm"),
        )
        # As many rows as there are clusters.
        .toPandas()
        .sort_values("cluster")
    )
    parts = [rows[rows["label"] == label] for label in labels]
    return [
        _Totals(*(p[c].to_numpy() for c in ("cluster", "n", list(FEATURES), "norm")))
        for p in parts
    ]


def _sum_columns(totals: Sequence[_Totals]) -> list[str]:
    return [f"to_{i}_{j}" for i, found in enumerate(totals) for j in range(len(found.names))]


@contextmanager
def _squared_sums(
    points: DataFrame, labels: Sequence[str], totals: Sequence[_Totals]
) -> Iterator[DataFrame]:
    """Per point its labels, how many it stands for, and its summed squared distances to each
    cluster of each label.

    They follow from a cluster's size, coordinate sums and squared norms.
    """
    names = _sum_columns(totals)

    def distances(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            axes = np.array([c.to_numpy(zero_copy_only=False) for c in batch.columns[:len(FEATURES)]])
            norms = (axes**2).sum(axis=0)
            summed = [
                np.outer(norms, t.sizes) - 2 * (axes.T @ t.sums.T) + t.norms for t in totals
            ]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[len(FEATURES) :], pa.array(np.ones(batch.num_rows))]
                + [pa.array(c) for c in np.hstack(summed).T],
                names=[*labels, "alike", *names],
            )

    yield points.select(*FEATURES, *labels).mapInArrow(distances, _sums_schema(labels, names))


def _sums_schema(labels: Sequence[str], names: Sequence[str]) -> str:
    return ", ".join([f"{c} int" for c in labels] + [f"{c} double" for c in ("alike", *names)])


@contextmanager
def _pairwise_sums(
    points: DataFrame, labels: Sequence[str], totals: Sequence[_Totals], drawn: str = "true"
) -> Iterator[DataFrame]:
    """As :func:`_squared_sums`, of plain distances, for the points where ``drawn`` holds.

    Equal points with equal labels have equal sums, so they are one point that counts as often as it
    occurs. A tile packs up to ``TILE`` of these into one row. Every tile meets every tile, which is
    the measure's definition: one task for each pair, which gives the sums of either tile's points
    to the other's, so no pair is measured twice; these are added up per point.
    """
    names, columns = _sum_columns(totals), [*FEATURES, *labels, "times", "alike"]
    distinct = (
        points.groupBy(*FEATURES, *labels)
        .agg(
            F.expr("cast(count(*) as double) as times"),
            F.expr(f"cast(count_if({drawn}) as double) as alike"),
        )
        .persist(StorageLevel.MEMORY_AND_DISK)
    )
    tiles = None
    try:
        parts = -(-distinct.count() // TILE)
        # Tiles have drawn points or others, so that two tiles of others needn't meet.
        tiles = (
            distinct.repartition(max(1, parts))
            .sortWithinPartitions(F.expr("alike = 0"))
            .mapInArrow(_packed(columns, TILE), _packed_schema(labels))
            .withColumn("tile", F.monotonically_increasing_id())
            .persist(StorageLevel.MEMORY_AND_DISK)
        )
        # Two numbers per tile.
        rows = tiles.selectExpr("tile", "exists(alike, x -> x > 0) as asked").collect()
        asking = F.array(*[F.lit(r.tile) for r in rows if r.asked])
        first = tiles.withColumn("asks", F.array_contains(asking, F.col("tile"))).withColumn(
            "other", F.explode(F.array(*[F.lit(r.tile) for r in rows]))
        )
        # A pair of which both ask is measured once, any other by the one that asks.
        first = first.where(
            F.col("asks") & (~F.array_contains(asking, F.col("other")) | F.expr("tile <= other"))
        ).drop("asks")
        second = tiles.select(
            F.col("tile").alias("other"), *[F.col(c).alias(f"other_{c}") for c in columns]
        )
        cores = points.sparkSession.sparkContext.defaultParallelism
        asked = sum(r.asked for r in rows)
        pairs = asked * (asked + 1) // 2 + asked * (len(rows) - asked)
        yield (
            first.join(second, "other")
            .select("tile", *columns, "other", *[f"other_{c}" for c in columns])
            .repartition(max(cores, pairs))
            .mapInArrow(
                _measured(labels, totals, HELD),
                f"tile bigint, at int, {_sums_schema(labels, names)}",
            )
            .groupBy("tile", "at")
            .agg(
                *[F.max(c).alias(c) for c in (*labels, "alike")],
                *[F.sum(c).alias(c) for c in names],
            )
            .drop("tile", "at")
        )
    finally:
        distinct.unpersist()
        if tiles is not None:
            tiles.unpersist()


def _packed_schema(labels: Sequence[str]) -> str:
    return ", ".join(
        [f"{f} array<double>" for f in FEATURES]
        + [f"{c} array<int>" for c in labels]
        + [f"{c} array<double>" for c in ("times", "alike")]
    )


def _packed(columns: Sequence[str], size: int):
    """Pack the rows of a partition, up to ``size`` together, into one row of arrays.

    A row holds points that are asked for (``alike`` > 0), which come first, or others.
    """

    def row(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        whole = pa.Table.from_batches(parts).combine_chunks()
        cells = [c.combine_chunks() for c in whole.columns]
        ends = pa.array([0, whole.num_rows], pa.int32())
        return pa.RecordBatch.from_arrays(
            [pa.ListArray.from_arrays(ends, c) for c in cells], names=list(columns)
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, kind = [], True
        for batch in batches:
            asked = int((batch.column(len(columns) - 1).to_numpy() > 0).sum())
            for part, asks in ((batch.slice(0, asked), True), (batch.slice(asked), False)):
                while part.num_rows:
                    have = sum(p.num_rows for p in held)
                    if held and (kind != asks or have == size):
                        yield row(held)
                        held, have = [], 0
                    held.append(part.slice(0, size - have))
                    part, kind = part.slice(size - have), asks
        if held:
            yield row(held)

    return run


def _measured(labels: Sequence[str], totals: Sequence[_Totals], most: int):
    """Sums of distances of a tile's points to the other's, by clusters, and the other way round.

    At most about ``most`` distances are held at a time.
    """
    axes, names = len(FEATURES), _sum_columns(totals)
    width = axes + len(labels) + 2

    def own(tile: list[np.ndarray]) -> np.ndarray:
        """How much each point of a tile counts in each cluster of each label."""
        inside = [n[:, None] == t.names for n, t in zip(tile[axes:], totals)]
        return np.hstack(inside) * tile[-2][:, None]

    def rows(number: int, tile: list[np.ndarray], sums: np.ndarray) -> pa.RecordBatch:
        at = np.flatnonzero(tile[-1] > 0)
        return pa.RecordBatch.from_arrays(
            [pa.array(np.full(len(at), number), pa.int64()), pa.array(at, pa.int32())]
            + [pa.array(c[at], pa.int32()) for c in tile[axes:-2]]
            + [pa.array(tile[-1][at])]
            + [pa.array(c) for c in sums[at].T],
            names=["tile", "at", *labels, "alike", *names],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                cells = [batch.column(j)[i] for j in range(batch.num_columns)]
                number, other = cells[0].as_py(), cells[width + 1].as_py()
                mine = [np.array(c.values) for c in cells[1 : width + 1]]
                theirs = [np.array(c.values) for c in cells[width + 2 :]]
                of_mine, of_theirs = own(mine), own(theirs)
                to_mine, to_theirs = np.zeros(of_theirs.shape), np.zeros(of_mine.shape)
                mutual = number != other and (theirs[-1] > 0).any()
                step = max(1, most // len(theirs[0]))
                for at in range(0, len(mine[0]), step):
                    here = slice(at, at + step)
                    gaps = np.subtract.outer(mine[0][here], theirs[0])
                    gaps *= gaps
                    for a, b in zip(mine[1:axes], theirs[1:axes]):
                        gap = np.subtract.outer(a[here], b)
                        gap *= gap
                        gaps += gap
                    np.sqrt(gaps, out=gaps)
                    to_theirs[here] = gaps @ of_theirs
                    if mutual:
                        to_mine += gaps.T @ of_mine[here]
                yield rows(number, mine, to_theirs)
                if mutual:
                    yield rows(other, theirs, to_mine)

    return run


def _gains(sums: np.ndarray, sizes: np.ndarray, home: np.ndarray) -> np.ndarray:
    """Silhouette per point from its summed distances to each cluster; 0 for a lone point."""
    rows = np.arange(len(sums))
    others = sizes[home] - 1
    inner = sums[rows, home] / np.maximum(others, 1)
    outer = sums / sizes
    outer[rows, home] = np.inf
    nearest = outer.min(axis=1)
    widest = np.maximum(inner, nearest)
    return np.divide(
        nearest - inner, widest, out=np.zeros(len(sums)), where=(others > 0) & (widest > 0)
    )
