"""Training of many K-Means models at once.

A sweep over cluster counts with several starts each needs dozens of models, each dozens of passes.
Fitted one by one that is thousands of Spark jobs over the same table. Here all models are started
and trained together on the whole table: every pass reads it once, tasks add up the points nearest
to each centre, Spark sums these few rows over the tasks, and the driver moves the centres.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator, Sequence
from contextlib import contextmanager
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel, cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from patronscope.operators.features import FEATURES

# Functions of this module travel to tasks by value: workers need not have the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Rounds that draw candidates for a start, and candidates a round draws for each centre.
START_ROUNDS = 2
DRAWS_PER_CENTER = 2


@dataclass(frozen=True)
class Clustering:
    """Centres in feature space, customers per centre and the sum of squared distances."""

    centers: tuple[tuple[float, ...], ...]
    sizes: tuple[int, ...]
    inertia: float


def fit_models(
    features: DataFrame, jobs: Sequence[tuple[int, int]], max_iter: int, tol: float
) -> list[Clustering]:
    """One model per (k, seed) in ``jobs``, from starts drawn among all customers.

    ``features`` holds ``customer_id`` and the feature columns; for the rest see :func:`train`.
    """
    with _cached_points(features) as points:
        n, needed = points.count(), max(k for k, _ in jobs)
        if n < needed:
            raise ValueError(f"{needed} clusters need at least as many customers, found {n}")
        return _trained(points.select(*FEATURES), _drawn_starts(points, jobs), max_iter, tol)


def train(
    features: DataFrame, starts: Sequence[Sequence[Sequence[float]]], max_iter: int, tol: float
) -> list[Clustering]:
    """One model per start, each a list of centres.

    A model rests once its centres move by at most ``tol`` in one pass, in summed squares. A centre
    that lost all its points moves to the point farthest from its own centre.
    """
    with _cached_points(features) as points:
        centers = [np.array(start, dtype=float) for start in starts]
        return _trained(points.select(*FEATURES), centers, max_iter, tol)


def _trained(
    points: DataFrame, starts: Sequence[np.ndarray], max_iter: int, tol: float
) -> list[Clustering]:
    centers = list(starts)
    moving = list(range(len(centers)))
    for _ in range(max_iter):
        still = []
        for model, totals in zip(moving, _one_pass(points, [centers[m] for m in moving])):
            centers[model], shift = _moved(centers[model], totals)
            if shift > tol:
                still.append(model)
        moving = still
        if not moving:
            break
    return [
        Clustering(
            tuple(tuple(float(x) for x in row) for row in found),
            tuple(int(x) for x in totals.sums[:, 0]),
            float(totals.sums[:, 1].sum()),
        )
        for found, totals in zip(centers, _one_pass(points, centers))
    ]


@contextmanager
def _cached_points(features: DataFrame) -> Iterator[DataFrame]:
    """A hash of the customer and the features, cached and spread over at least all cores."""
    points = features.selectExpr("xxhash64(customer_id) as customer", *FEATURES)
    cores = features.sparkSession.sparkContext.defaultParallelism
    if points.rdd.getNumPartitions() < cores:
        points = points.repartition(cores)
    points.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        yield points
    finally:
        points.unpersist()


def _drawn_starts(points: DataFrame, jobs: Sequence[tuple[int, int]]) -> list[np.ndarray]:
    """k-means||: a start for each job from candidates drawn among all points.

    Each round draws a few points per model, with a chance that grows with the squared distance to
    the candidates so far. One pass then counts the points nearest to each candidate, and
    k-means++ on these few weighted candidates gives the start. The number of candidates depends on
    k alone.
    """
    candidates = [np.empty((0, len(FEATURES)))] * len(jobs)
    for turn in range(1 + START_ROUNDS):
        wanted = [DRAWS_PER_CENTER * k if turn else 1 for k, _ in jobs]
        drawn = _draw(points, candidates, wanted, [(seed, turn) for _, seed in jobs])
        candidates = [np.vstack(pair) for pair in zip(candidates, drawn)]
    weights = _one_pass(points.select(*FEATURES), candidates)
    return [
        _spread_start(found, totals.sums[:, 0], k, np.random.default_rng(seed))
        for (k, seed), found, totals in zip(jobs, candidates, weights)
    ]


def _draw(
    points: DataFrame,
    candidates: Sequence[np.ndarray],
    wanted: Sequence[int],
    salts: Sequence[tuple[int, int]],
) -> list[np.ndarray]:
    """``wanted`` points per model, weighted by squared distance, without replacement.

    A point's place in the draw is an exponential variate of a hash of customer and salt, divided
    by its weight; the lowest places win. So neither partitions nor repeated tasks matter.
    """
    # numpy spreads a salt over 64 bits, so salts that differ by one give unrelated hashes.
    mixed = [np.random.SeedSequence(list(salt)).generate_state(1, np.uint64)[0] for salt in salts]

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [np.empty((0, 1 + len(FEATURES)))] * len(candidates)
        for batch in batches:
            columns = [column.to_numpy(zero_copy_only=False) for column in batch.columns]
            keys, axes = columns[0].view(np.uint64), columns[1:]
            for model, (found, count, salt) in enumerate(zip(candidates, wanted, mixed)):
                weight = _squares(axes, found).min(axis=1) if len(found) else np.ones(len(keys))
                chosen = np.flatnonzero(weight > 0)
                place = -np.log(_uniform(keys[chosen] ^ salt)) / weight[chosen]
                rows = np.column_stack([place, *(axis[chosen] for axis in axes)])
                rows = np.vstack([best[model], rows])
                best[model] = rows[np.argsort(rows[:, 0], kind="stable")[:count]]
        everyone = np.vstack(best)
        models = np.repeat(np.arange(len(best), dtype=np.int32), [len(rows) for rows in best])
        limits = np.repeat(np.array(wanted, dtype=np.int32), [len(rows) for rows in best])
        yield pa.RecordBatch.from_arrays(
            [pa.array(models), pa.array(limits)] + [pa.array(column) for column in everyone.T],
            names=["model", "wanted", "place", *FEATURES],
        )

    axes = ", ".join(f"{f} double" for f in FEATURES)
    order = ", ".join(("place", *FEATURES))
    rows = (
        points.mapInArrow(places, f"model int, wanted int, place double, {axes}")
        # At most ``wanted`` rows of each task and model meet here.
        .withColumn("rank", F.expr(f"row_number() over (partition by model order by {order})"))
        .where("rank <= wanted")
        .toPandas()
        .sort_values(["model", "rank"])
    )
    return [rows.loc[rows["model"] == m, list(FEATURES)].to_numpy() for m in range(len(wanted))]


def _uniform(keys: np.ndarray) -> np.ndarray:
    """Numbers in (0, 1) from 64-bit keys: the finishing steps of the SplitMix64 generator."""
    keys = (keys ^ (keys >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    keys = (keys ^ (keys >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    keys ^= keys >> np.uint64(31)
    return ((keys >> np.uint64(11)).astype(float) + 0.5) / 2.0**53


def _spread_start(
    found: np.ndarray, weights: np.ndarray, k: int, rng: np.random.Generator
) -> np.ndarray:
    """k-means++ on weighted candidates: draw the next by weight times squared distance."""
    chosen = [found[rng.choice(len(found), p=weights / weights.sum())]]
    nearest = ((found - chosen[0]) ** 2).sum(axis=1)
    while len(chosen) < k:
        chance = nearest * weights
        # With fewer distinct points than centres the remaining ones coincide.
        chance = chance / chance.sum() if chance.sum() > 0 else None
        chosen.append(found[rng.choice(len(found), p=chance)])
        nearest = np.minimum(nearest, ((found - chosen[-1]) ** 2).sum(axis=1))
    return np.array(chosen)


@dataclass(frozen=True)
class _Totals:
    """Of one model: per centre the number of its points, their summed squared distance and summed
    coordinates; and the farthest point from its centre with that squared distance in front."""

    sums: np.ndarray
    farthest: np.ndarray


def _squares(axes: Sequence[np.ndarray], centers: np.ndarray) -> np.ndarray:
    return sum((axis[:, None] - centers[:, i]) ** 2 for i, axis in enumerate(axes))


def _nearest_sums(axes: Sequence[np.ndarray], centers: np.ndarray) -> _Totals:
    dist2 = _squares(axes, centers)
    near = dist2.argmin(axis=1)
    cost = dist2[np.arange(len(near)), near]
    sums = np.column_stack([np.bincount(near, w, len(centers)) for w in (None, cost, *axes)])
    # Of equally far points the one with the greatest coordinates, whatever the order of rows.
    last = np.flatnonzero(cost == cost.max())
    return _Totals(sums, np.array(max((cost[i], *(axis[i] for axis in axes)) for i in last)))


def _moved(centers: np.ndarray, totals: _Totals) -> tuple[np.ndarray, float]:
    """Centres moved to the mean of their points, and the sum of squared shifts.

    Of the centres without points one a pass moves, to the farthest point; where no point is off
    its centre, they stay.
    """
    n = totals.sums[:, :1]
    moved = np.where(n > 0, totals.sums[:, 2:] / np.maximum(n, 1), centers)
    lost = np.flatnonzero(n[:, 0] == 0)
    if len(lost) and totals.farthest[0] > 0:
        moved[lost[0]] = totals.farthest[1:]
    return moved, float(((moved - centers) ** 2).sum())


def _one_pass(points: DataFrame, models: Sequence[np.ndarray]) -> list[_Totals]:
    """The totals of :func:`_nearest_sums` over all points for every model, from one scan."""
    ends = np.cumsum([len(m) for m in models])
    sums = ("n", "cost", *FEATURES)
    far = ("far", *(f"far_{f}" for f in FEATURES))

    def partial_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = np.zeros((ends[-1], len(sums)))
        farthest = [(-1.0,) + (0.0,) * len(FEATURES)] * len(models)
        for batch in batches:
            if not batch.num_rows:
                continue
            axes = [column.to_numpy(zero_copy_only=False) for column in batch.columns]
            found = [_nearest_sums(axes, m) for m in models]
            totals += np.vstack([one.sums for one in found])
            farthest = [max(old, tuple(one.farthest)) for old, one in zip(farthest, found)]
        # A model's farthest point rides on each of its centres.
        riding = np.repeat(np.array(farthest), [len(m) for m in models], axis=0)
        yield pa.RecordBatch.from_arrays(
            [pa.array(range(len(totals)), pa.int32())]
            + [pa.array(column) for column in (*totals.T, *riding.T)],
            names=["center", *sums, *far],
        )

    schema = "center int, " + ", ".join(f"{c} double" for c in (*sums, *far))
    summed = (
        points.mapInArrow(partial_sums, schema)
        .groupBy("center")
        .agg(
            *[F.expr(f"sum({c}) as {c}") for c in sums],
            F.expr(f"max(struct({', '.join(far)})) as farthest"),
        )
        .select("center", *sums, "farthest.*")
        # As many rows as there are centres.
        .toPandas()
        .sort_values("center")
    )
    per_model = np.split(summed[[*sums, *far]].to_numpy(), ends[:-1])
    return [_Totals(rows[:, : len(sums)], rows[0, len(sums) :]) for rows in per_model]
