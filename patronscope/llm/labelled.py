"""Labelled documents, on which classifiers are trained: all of them, or bounded samples."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from patronscope.llm.shared import SENDABLE_ROWS


def _known(labels: DataFrame, label: str, usable: str) -> DataFrame:
    """(doc_id, y, draw) of usable labels, one for each id; ``draw`` is a hash of the id."""
    return (
        labels.filter(f"doc_id IS NOT NULL AND {label} IN (0, 1) AND ({usable})")
        .selectExpr("doc_id", f"CAST({label} AS INT) AS y")
        .dropDuplicates(["doc_id"])
        .withColumn("draw", F.xxhash64("doc_id"))
    )


def _counts(known: DataFrame) -> dict[int, int]:
    return {row["y"]: row["n"] for row in known.groupBy("y").agg(F.count("*").alias("n")).collect()}


_CHOSEN = ("doc_id", "y", "CAST(pmod(draw, 10) AS INT) AS part")


def labelled_rows(
    docs: DataFrame, labels: DataFrame, label: str, usable: str
) -> tuple[DataFrame, dict[int, int]]:
    """(doc_id, text, lang, y, part) of every labelled document; see :func:`labelled_sample`.

    Few labels are sent to the executors, so that documents don't move; beyond ``SENDABLE_ROWS``
    both sides are shuffled. The rows are the same either way.
    """
    known = _known(labels, label, usable)
    counts = _counts(known)
    chosen = known.selectExpr(*_CHOSEN)
    chosen = F.broadcast(chosen) if sum(counts.values()) <= SENDABLE_ROWS else chosen
    return docs.select("doc_id", "text", "lang").join(chosen, "doc_id"), counts


def labelled_sample(
    docs: DataFrame, labels: DataFrame, label: str, usable: str, per_class: int
) -> tuple[DataFrame, dict[int, int]]:
    """(doc_id, text, lang, y, part) of at most ``per_class`` documents of either class.

    Chosen by the least hashes of their ids among labelled rows for which the SQL condition
    ``usable`` holds, so the choice doesn't depend on partitioning; ``part`` (0 to 9) is further
    bits of the hash. Also returns how many such labels each class has in all. Rows whose label or
    id is null aren't used. The bound keeps the sample's ids small enough to send to every
    executor, so documents don't move.
    """
    known = _known(labels, label, usable)
    counts = _counts(known)
    chosen = known.filter("y = 0").orderBy("draw", "doc_id").limit(per_class)
    chosen = chosen.unionByName(known.filter("y = 1").orderBy("draw", "doc_id").limit(per_class))
    chosen = chosen.selectExpr(*_CHOSEN)
    return docs.select("doc_id", "text", "lang").join(F.broadcast(chosen), "doc_id"), counts
