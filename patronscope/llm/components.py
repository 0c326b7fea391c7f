"""Connected components by alternating large-star and small-star steps.

Each step joins and aggregates edges in Spark and writes the new edges as a table, so nothing
reaches the driver and a lost executor costs at most one step.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from patronscope.llm.shared import Store


def connected_components(edges: DataFrame, store: Store, name: str) -> DataFrame:
    """(node, component) for every node of ``edges`` (a, b); component is its smallest node.

    Nulls and loops are left out; repeated edges count once. No edges give no rows.
    """
    found = larger_nodes(edges, store, name)
    low = found.selectExpr("component AS node", "component").distinct()
    return found.unionByName(low)


def larger_nodes(edges: DataFrame, store: Store, name: str) -> DataFrame:
    """``connected_components`` without the rows of the smallest nodes; one row for each other node.

    A left join that falls back on the node itself needs no more.
    """
    now = store.save(
        edges.filter("a <> b")
        .selectExpr("greatest(a, b) AS hi", "least(a, b) AS lo")
        .distinct(),
        f"{name}-0",
    )
    step = 0
    while not _settled(now):
        step += 1
        now = store.save(_small_star(_large_star(now)), f"{name}-{step}")
    return now.selectExpr("hi AS node", "lo AS component")


def _settled(edges: DataFrame) -> bool:
    """Whether every node is either the centre of a star or a point of one single star."""
    ends = edges.selectExpr("inline(array(struct(hi AS node, 1 AS up), struct(lo AS node, 0 AS up)))")
    stars = ends.groupBy("node").agg(F.sum("up").alias("ups"), F.min("up").alias("least"))
    # A point has one edge up and none down.
    loose = stars.filter("ups > 1 OR ups = 1 AND least = 0")
    return loose.agg(F.count("*")).first()[0] == 0


def _large_star(edges: DataFrame) -> DataFrame:
    """Link every larger neighbour of a node to the smallest of its neighbourhood."""
    both = edges.selectExpr("inline(array(struct(hi AS u, lo AS v), struct(lo AS u, hi AS v)))")
    least = both.groupBy("u").agg(F.min("v").alias("m")).selectExpr("u", "least(u, m) AS m")
    return both.filter("v > u").join(least, "u").selectExpr("v AS hi", "m AS lo").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Link a node and its smaller neighbours to the smallest of them."""
    least = edges.groupBy("hi").agg(F.min("lo").alias("m"))
    moved = edges.join(least, "hi").selectExpr(
        "inline(array(struct(hi AS hi, m AS lo), struct(lo AS hi, m AS lo)))"
    )
    return moved.filter("hi <> lo").distinct()
