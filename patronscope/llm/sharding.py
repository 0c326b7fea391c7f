"""Sharding by weighted rendezvous hashing.

A record's key meets every shard in a hash, which gives a draw u in (0, 1); the shard with the
least -ln(u) / weight takes the record. A shard so gets records in proportion to its weight, and
one more shard takes records only into itself.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from patronscope.llm.shared import Store

SEED = 17


def rendezvous(key: str, weights: Sequence[float], seed: int = SEED) -> str:
    """SQL for the shard (int) of the record whose key is the SQL expression ``key``.

    A null key is a key like any other.
    """
    if not weights or any(w <= 0 for w in weights):
        raise ValueError("every shard needs a weight above 0")
    draws = []
    for shard, weight in enumerate(weights):
        # 53 bits of the hash, centred, so that u is never 0 or 1.
        u = f"(shiftrightunsigned(xxhash64({key}, {shard}, {seed}), 11) + 0.5D) / 9007199254740992D"
        draws.append(f"struct(-ln({u}) / {float(weight)}D AS cost, {shard} AS shard)")
    return f"array_min(array({', '.join(draws)})).shard"


def assign_shards(
    docs: DataFrame,
    weights: Sequence[float],
    key: str = "doc_id",
    grown_weight: float | None = None,
    seed: int = SEED,
) -> DataFrame:
    """All rows and columns of ``docs`` with ``shard`` and ``grown_shard``.

    ``grown_shard`` is the shard with one more shard of ``grown_weight`` (the mean, if not given).
    Columns of ``docs`` with these names are replaced. Nothing is shuffled.
    """
    more = sum(weights) / len(weights) if grown_weight is None else grown_weight
    return docs.withColumns(
        {
            "shard": F.expr(rendezvous(key, weights, seed)),
            "grown_shard": F.expr(rendezvous(key, [*weights, more], seed)),
        }
    )


def number_slots(rows: DataFrame, store: Store) -> DataFrame:
    """``rows`` with ``slot``: 0, 1, 2, ... within each ``shard``, without gaps.

    Rows are stored with the task that wrote them and their place in it, which fixes both. Counts
    per task and shard then give each its first slot, so no shard is ever gathered in one task, and
    equal or repeated keys need no care. Meant for narrow rows.
    """
    # The high bits of the id are the writing task's number.
    placed = store.save(
        rows.withColumn("_place", F.monotonically_increasing_id()), "placed"
    ).withColumn("_task", F.expr("shiftright(_place, 33)"))
    counts = store.save(placed.groupBy("_task", "shard").agg(F.count("*").alias("_n")), "counts")
    first = counts.selectExpr(
        "_task",
        "shard",
        "coalesce(sum(_n) OVER (PARTITION BY shard ORDER BY _task"
        " ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS _first",
    )
    within = placed.withColumn(
        "_row", F.expr("row_number() OVER (PARTITION BY _task, shard ORDER BY _place) - 1")
    )
    joined = within.join(first, ["_task", "shard"])
    return joined.withColumn("slot", F.expr("CAST(_first + _row AS BIGINT)")).drop(
        "_task", "_place", "_row", "_first"
    )


def op1_sharding(spark, folder: str) -> DataFrame:
    """Every document's place in eight shards of equal weight, under the ``key`` law."""
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    small = docs.selectExpr(
        "doc_id",
        "CAST(coalesce(octet_length(text), 0) + 1 AS BIGINT) AS size",
        "crc32(CAST(coalesce(text, '') AS BINARY)) AS text_crc32",
        "'key' AS law",
    )
    placed = assign_shards(small, [1.0] * 8)
    return number_slots(placed, Store(spark)).select(
        "doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"
    )
