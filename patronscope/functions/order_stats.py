"""Exact positions in a whole order without gathering rows in one task."""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterable, Sequence
from dataclasses import dataclass
from itertools import batched

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from patronscope.sources.small import small_table
from patronscope.sources.workspace import Workspace

# monotonically_increasing_id() keeps the task number above bit 33 and the row number below it.
TASK_SHIFT = 33
# Spark's default for spark.sql.parquet.pushdown.inFilterThreshold.
PUSHED_LIST = 10


@dataclass(frozen=True)
class GlobalOrder:
    """A stored table in range-sorted order with the first position of each writing task."""

    rows: DataFrame
    tasks: list[int]
    starts: list[int]
    total: int

    def with_position(self, name: str = "position") -> DataFrame:
        """Add each row's 0-based place in the whole order."""
        offsets = small_table(
            self.rows.sparkSession, list(zip(self.tasks, self.starts)), "task bigint, start bigint"
        )
        return (
            # One row per task that wrote the order: a few thousand at most.
            self.rows.withColumn("task", F.expr(f"shiftright(slot, {TASK_SHIFT})"))
            .join(F.broadcast(offsets), "task")
            .withColumn(name, F.expr(f"start + slot - shiftleft(task, {TASK_SHIFT})"))
            .drop("task", "start", "slot")
        )

    def rows_at(self, positions: Iterable[int]) -> dict[int, Row]:
        """Fetch the rows at a few positions, reading only the Parquet row groups that hold them."""
        slots = {}
        for position in positions:
            if not 0 <= position < self.total:
                raise IndexError(f"position {position} outside 0..{self.total - 1}")
            at = bisect_right(self.starts, position) - 1
            slots[(self.tasks[at] << TASK_SHIFT) + position - self.starts[at]] = position
        if not slots:
            return {}
        # Longer lists would be pushed down as one range from the lowest to the highest slot.
        lists = [", ".join(f"{s}L" for s in part) for part in batched(slots, PUSHED_LIST)]
        found = self.rows.where(" or ".join(f"slot in ({part})" for part in lists)).collect()
        return {slots[row["slot"]]: row for row in found}


def global_order(
    df: DataFrame, keys: Sequence[str], workspace: Workspace, name: str
) -> GlobalOrder:
    """Sort ``df`` by ``keys``, which must identify a row, and store the result.

    Because the keys are unique, range partitions stay even however often one leading value
    repeats. The result is written before positions are derived, so that range bounds, which Spark
    samples, cannot differ between the count and the use.
    """
    ordered = (
        df.repartitionByRange(*keys)
        .sortWithinPartitions(*keys)
        .withColumn("slot", F.monotonically_increasing_id())
    )
    rows = workspace.save(ordered, name)
    sizes = (
        rows.groupBy(F.expr(f"shiftright(slot, {TASK_SHIFT}) as task"))
        .agg(F.expr("count(*) as n"))
        .orderBy("task")
        .collect()
    )
    tasks, starts, total = [], [], 0
    for size in sizes:
        tasks.append(size["task"])
        starts.append(total)
        total += size["n"]
    return GlobalOrder(rows, tasks, starts, total)
