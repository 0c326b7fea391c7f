import random

import pytest

from patronscope.functions import selection
from patronscope.functions.selection import exact_quantiles, select_ranks

LEVELS = [0.0, 0.25, 0.5, 0.75, 0.99, 1.0]


def quantile_by_hand(values: list[float], fraction: float) -> float:
    ordered = sorted(values)
    place = fraction * (len(ordered) - 1)
    low = ordered[int(place)]
    high = ordered[min(int(place) + 1, len(ordered) - 1)]
    return low + (high - low) * (place - int(place))


@pytest.fixture(params=[(256, 10_000, 1024), (8, 10_000, 3), (16, 20, 50)], ids=["as-is", "fine", "bad-sketch"])
def steps(request, monkeypatch):
    """Grids and sketches so coarse that many passes are needed, and that are far off."""
    for name, value in zip(("GRID", "ACCURACY", "KEPT"), request.param, strict=True):
        monkeypatch.setattr(selection, name, value)


def test_group_quantiles(spark, steps):
    rng = random.Random(3)
    rows = [
        (rng.choice("aaaaaaaaab"), rng.gauss(0, 1000), rng.choice([1, 1, 1, rng.randrange(50)]))
        for _ in range(3000)
    ]
    rows += [("c", 1.5, 3), ("d", 1.0, 4), ("d", 2.0, 5), (None, 7.0, 7)]
    df = spark.createDataFrame(rows, "grp string, smooth double, tied int").repartition(5)
    got = {r.grp: r for r in exact_quantiles(df, ["smooth", "tied"], LEVELS, "grp").collect()}
    assert set(got) == {"a", "b", "c", "d"}
    for grp, row in got.items():
        for at, metric in ((1, "smooth"), (2, "tied")):
            values = [r[at] for r in rows if r[0] == grp]
            want = [quantile_by_hand(values, f) for f in LEVELS]
            assert row[metric] == pytest.approx(want, rel=1e-12)


def test_ranks_between_two_frequent_values(spark, steps):
    """The wanted ranks are the last of one value and the first of the next."""
    df = spark.sql("select if(id < 2000, 3, 4) as v from range(4000)")
    selected = select_ranks(df, ["v"], lambda _, n: [0, 1999, 2000, n - 1])
    found = {r: (s.value, s.below, s.upto) for r, s in selected.found[0][0].items()}
    low, high = (3, 0, 2000), (4, 2000, 4000)
    assert found == {0: low, 1999: low, 2000: high, 3999: high}
    assert selected.counts == {0: [4000]}


def test_large_ids_stay_exact(spark, steps):
    """Whole numbers past 2^53 differ by one."""
    df = spark.sql("select 9007199254740993 + id * 7 % 1500 as v from range(1500)")
    found = select_ranks(df, ["v"], lambda _, n: range(0, n, 123)).found[0][0]
    assert {r: s.value for r, s in found.items()} == {
        r: 9007199254740993 + r for r in range(0, 1500, 123)
    }


def test_missing_values(spark):
    df = spark.createDataFrame(
        [("a", 1.0), ("a", None), ("a", float("nan")), ("a", 3.0), ("b", None)], "g string, v double"
    )
    got = {r.g: r.v for r in exact_quantiles(df, ["v"], [0.5], "g").collect()}
    assert got == {"a": [2.0], "b": [None]}
    assert exact_quantiles(df.limit(0), ["v"], [0.5], "g").count() == 0
    assert select_ranks(df.where("v < 0").select("v"), ["v"], lambda _, n: [0]).found == {}


def test_no_rows_are_moved(spark, monkeypatch):
    """Ranks of many rows are found with exchanges of a few rows per task."""
    monkeypatch.setattr(selection, "KEPT", 10)
    rows = spark.range(20_000).selectExpr("0 as grp", "0 as no", "cast(id as double) as v")
    marked = selection._counts(rows, {(0, 0): [5.0, 9.0]}, "int", "double")
    assert marked == {(0, 0): [(5, 6), (9, 10)]}
