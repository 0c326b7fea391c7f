"""Exact order statistics by selection: brackets narrowed in passes that move no rows.

A pass sketches the values inside each open bracket, picks candidates around the wanted rank and
counts how many values lie below and up to each. The counts are exact, so a sketch that is far off
costs a pass but no correctness: a candidate either is the wanted value or leaves the bracket. Both
steps combine per task. A bracket ends when a candidate is met or when it holds at most ``KEPT``
values, which are then fetched; so the driver sees a bounded number of rows per group and rank.
"""

from __future__ import annotations

import math
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Hashable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from patronscope.functions.numeric import double
from patronscope.sources.small import small_table

# Steps of the grid of ranks a sketch is asked for, and the sketch's accuracy.
GRID = 256
ACCURACY = 10_000
# Most values of a bracket that are fetched.
KEPT = 1024

LEAST, MOST = -(1 << 63), (1 << 63) - 1


@dataclass(frozen=True)
class Selected:
    """A value with the number of values below it and up to it."""

    value: float | int
    below: int
    upto: int


@dataclass
class _Bracket:
    """Where a rank's value must lie: ``below`` values are smaller, ``inside`` are within."""

    low: float | int
    high: float | int
    below: int
    inside: int


Ranks = Callable[[int, int], Sequence[int]]


@dataclass(frozen=True)
class Selection:
    """For each group and value column, the number of values and what is at the wanted ranks."""

    counts: dict[Hashable, list[int]]
    found: dict[Hashable, list[dict[int, Selected]]]


def select_ranks(
    df: DataFrame, values: Sequence[str], ranks: Ranks, by: str | None = None
) -> Selection:
    """The values at given 0-based ranks of each value column, per group of ``by``.

    ``values`` are columns of whole numbers or doubles (all of one kind, no NaN); nulls have no
    rank. ``ranks(i, n)`` names the ranks wanted of column i in a group where n rows have a value.
    ``by`` must have few distinct values; without it all rows are the group 0, and rows whose group
    is null are left out. ``df`` is read twice per pass.
    """
    whole = all(df.schema[v].dataType.simpleString() in ("int", "bigint") for v in values)
    kind = "bigint" if whole else "double"
    parts = ", ".join(
        f"struct({i} as no, cast({v} as {kind}) as v)" for i, v in enumerate(values)
    )
    group = by or "cast(0 as int)"
    rows = df.selectExpr(f"{group} as grp", f"inline(array({parts}))").where("grp is not null")
    grp = rows.schema["grp"].dataType.simpleString()
    sizes = rows.groupBy("grp", "no").agg(F.count("v").alias("n")).collect()
    rows = rows.where("v is not null")
    ends = (LEAST, MOST) if whole else (-math.inf, math.inf)
    counts: dict[Hashable, list[int]] = {}
    found: dict[Hashable, list[dict[int, Selected]]] = {}
    open_: dict[tuple, dict[int, _Bracket]] = {}
    for row in sizes:
        counts.setdefault(row["grp"], [0] * len(values))[row["no"]] = row["n"]
        found.setdefault(row["grp"], [{} for _ in values])
        wanted = {r for r in ranks(row["no"], row["n"]) if 0 <= r < row["n"]}
        if wanted:
            open_[row["grp"], row["no"]] = {r: _Bracket(*ends, 0, row["n"]) for r in wanted}
    while open_:
        small = _part(open_, lambda b: b.inside <= KEPT)
        open_ = _part(open_, lambda b: b.inside > KEPT)
        for (key, no), hits in _fetched(rows, small, grp, kind).items():
            found[key][no] |= hits
        if not open_:
            break
        candidates = _candidates(rows, open_, grp, kind)
        marked = _counts(rows, candidates, grp, kind)
        for (key, no), brackets in open_.items():
            for rank, bracket in list(brackets.items()):
                hit = _narrow(bracket, rank, candidates[key, no], marked[key, no], whole)
                if hit:
                    found[key][no][rank] = hit
                    del brackets[rank]
        open_ = _part(open_, lambda _: True)
    return Selection(counts, found)


def _part(open_: dict, chosen: Callable[[_Bracket], bool]) -> dict:
    """The keys that have such brackets, with these."""
    kept = {key: {r: b for r, b in own.items() if chosen(b)} for key, own in open_.items()}
    return {key: own for key, own in kept.items() if own}


def _with_parameters(rows: DataFrame, table: list[tuple], schema: str) -> DataFrame:
    parameters = small_table(rows.sparkSession, table, schema)
    # One row per group and value column.
    return rows.join(F.broadcast(parameters), ["grp", "no"])


def _slots(open_: dict) -> dict[tuple, list[tuple]]:
    """The distinct brackets of each key, ascending.

    Those of one column are equal or apart: they end next to the same counted candidates.
    """
    return {key: sorted({(b.low, b.high) for b in own.values()}) for key, own in open_.items()}


def _inside(rows: DataFrame, slots: dict, grp: str, kind: str) -> DataFrame:
    """Values within a bracket, with its number as ``slot``."""
    table = [(g, no, [b[0] for b in s], [b[1] for b in s]) for (g, no), s in slots.items()]
    return (
        _with_parameters(rows, table, f"grp {grp}, no int, low array<{kind}>, high array<{kind}>")
        .withColumn("slot", F.expr("size(filter(low, x -> x <= v)) - 1"))
        .where("slot >= 0 and v <= get(high, slot)")
        .select("grp", "no", "slot", "v")
    )


def _fetched(rows: DataFrame, small: dict, grp: str, kind: str) -> dict[tuple, dict]:
    """What is at the ranks of brackets that hold few values."""
    if not small:
        return {}
    slots = _slots(small)
    held: dict[tuple, list] = {}
    for row in _inside(rows, slots, grp, kind).collect():
        held.setdefault((row["grp"], row["no"], row["slot"]), []).append(row["v"])
    for own in held.values():
        own.sort()
    found: dict[tuple, dict] = {}
    for key, brackets in small.items():
        for rank, b in brackets.items():
            own = held[(*key, slots[key].index((b.low, b.high)))]
            value = own[rank - b.below]
            ends = (b.below + cut(own, value) for cut in (bisect_left, bisect_right))
            found.setdefault(key, {})[rank] = Selected(value, *ends)
    return found


def _candidates(rows: DataFrame, open_: dict, grp: str, kind: str) -> dict[tuple, list]:
    """Ascending values near each open rank, from one sketch per bracket."""
    slots = _slots(open_)
    inside = _inside(rows, slots, grp, kind)
    grid = ", ".join(double(i / GRID) for i in range(GRID + 1))
    sketches = (
        inside.groupBy("grp", "no", "slot")
        .agg(F.expr(f"percentile_approx(v, array({grid}), {ACCURACY}) as marks"))
        .collect()
    )
    marks = {(r["grp"], r["no"], r["slot"]): r["marks"] for r in sketches}
    picked = {}
    for key, brackets in open_.items():
        chosen = set()
        for rank, b in brackets.items():
            known = marks[(*key, slots[key].index((b.low, b.high)))]
            at = (rank - b.below) * GRID // max(1, b.inside - 1)
            chosen |= {known[min(GRID, max(0, at + step))] for step in (-1, 0, 1, 2)}
        picked[key] = sorted(chosen)
    return picked


def _counts(rows: DataFrame, candidates: dict, grp: str, kind: str) -> dict[tuple, list]:
    """For each candidate of a key, how many values are below it and up to it."""
    table = [(g, no, values) for (g, no), values in candidates.items()]
    # Twice the candidates below a value, plus one if it equals the next.
    cells = (
        _with_parameters(rows, table, f"grp {grp}, no int, marks array<{kind}>")
        .selectExpr(
            "grp", "no",
            "size(filter(marks, x -> x < v)) + size(filter(marks, x -> x <= v)) as cell",
        )
        .groupBy("grp", "no", "cell")
        .agg(F.count("*").alias("n"))
        .collect()
    )
    counted = {}
    for row in cells:
        counted.setdefault((row["grp"], row["no"]), {})[row["cell"]] = row["n"]
    found = {}
    for key, values in candidates.items():
        n, so_far, pairs = counted.get(key, {}), 0, []
        for i in range(len(values)):
            below = so_far + n.get(2 * i, 0)
            so_far = below + n.get(2 * i + 1, 0)
            pairs.append((below, so_far))
        found[key] = pairs
    return found


def _narrow(
    b: _Bracket, rank: int, candidates: list, counts: list[tuple[int, int]], whole: bool
) -> Selected | None:
    """The value at ``rank`` if it is a candidate; else the bracket loses all candidates."""
    at = bisect_left([upto for _, upto in counts], rank + 1)
    if at < len(candidates) and counts[at][0] <= rank:
        return Selected(candidates[at], *counts[at])
    above = b.below + b.inside
    if at < len(candidates):
        high = candidates[at] - 1 if whole else math.nextafter(candidates[at], -math.inf)
        if high <= b.high:
            b.high, above = high, counts[at][0]
    if at:
        low = candidates[at - 1] + 1 if whole else math.nextafter(candidates[at - 1], math.inf)
        if low >= b.low:
            b.low, b.below = low, counts[at - 1][1]
    b.inside = above - b.below
    return None


def interpolated(ranked: dict[int, Selected], place: float) -> float:
    """Value at a place between two ranks, both among ``ranked``."""
    low, high = (ranked[step(place)].value for step in (math.floor, math.ceil))
    return low + (high - low) * (place - math.floor(place))


def exact_quantiles(
    df: DataFrame, values: Sequence[str], fractions: Sequence[float], by: str
) -> DataFrame:
    """Exact linear-interpolated quantiles per group, as one array column per value column.

    ``by`` must have few distinct values, such as segments; null groups have no row. Nulls and NaN
    have no rank; a column without values in a group is null there.
    """
    rows = clean_values(df, values, by)

    def ranks(_: int, n: int) -> list[int]:
        return [step(f * (n - 1)) for f in fractions for step in (math.floor, math.ceil)]

    selection = select_ranks(rows, values, ranks, by)
    table = []
    for key, counts in selection.counts.items():
        arrays = [
            [interpolated(found, f * (n - 1)) if n else None for f in fractions]
            for n, found in zip(counts, selection.found[key], strict=True)
        ]
        table.append((key, *arrays))
    kind = rows.schema[by].dataType.simpleString()
    columns = ", ".join(f"`{v}` array<double>" for v in values)
    return small_table(df.sparkSession, table, f"`{by}` {kind}, {columns}")


def clean_values(df: DataFrame, values: Sequence[str], by: str) -> DataFrame:
    """The ``by`` column and the values as doubles, with null in place of NaN."""
    return df.selectExpr(by, *[f"nullif(cast({v} as double), double('NaN')) as {v}" for v in values])
