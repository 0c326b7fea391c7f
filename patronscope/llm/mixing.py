"""Mixing sources to target weights by subset-sum budget fitting.

Documents are counted by (source, exact length). Each source then fits its budget on these counts
alone: whole passes over all documents, an even share of every length, and a bounded-knapsack
program over the lengths left for the words still missing. Which documents of a length are taken
follows from a seeded hash of their ids.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from patronscope.llm.shared import SENDABLE_ROWS, Store

# Weights of the sources in order of their names, repeating.
WEIGHTS = (5, 2, 1)
# No document is taken more often than this.
MOST_COPIES = 3
# Words that the knapsack program fits; what exceeds them is taken by even shares and long documents.
KNAPSACK_WORDS = 1 << 16
# Documents of one source and length that are ranked together.
RANKED_TOGETHER = 8192
SEED = 29
WORD_COUNT = r"CAST(coalesce(regexp_count(text, '[^\\x20\\x09-\\x0D]+'), 0) AS BIGINT)"


def fit_counts(lengths: np.ndarray, counts: np.ndarray, budget: int) -> np.ndarray:
    """How many documents of each length to take so that their words come nearest below ``budget``.

    At most ``counts`` of each; lengths are positive. The sum never exceeds the budget. It meets it
    exactly if the last ``KNAPSACK_WORDS`` words are a sum of lengths still free.
    """
    lengths, counts = lengths.astype(object), counts.astype(object)
    total = int((lengths * counts).sum()) if len(lengths) else 0
    budget = max(0, min(budget, total))
    if not budget:
        return np.zeros(len(lengths), dtype=np.int64)
    taken = counts * budget // total
    left = budget - int((lengths * taken).sum())
    for i in np.argsort(-lengths.astype(np.int64), kind="stable"):
        if left <= KNAPSACK_WORDS:
            break
        more = min(counts[i] - taken[i], (left - KNAPSACK_WORDS) // lengths[i])
        taken[i] += more
        left -= int(more * lengths[i])
    taken = taken.astype(np.int64)
    for i, more in _knapsack(lengths, counts - taken, left):
        taken[i] += more
    return taken


def _knapsack(lengths, free, budget: int) -> list[tuple[int, int]]:
    """(place, documents) whose lengths sum to the largest reachable sum up to ``budget``.

    Bit s of ``reached`` tells whether s is a sum of the pieces so far. A length with n documents
    is split into pieces of 1, 2, 4, ... documents, the last one smaller, which reach all of 0..n.
    """
    mask = (1 << (budget + 1)) - 1
    reached, steps = 1, []
    for i in range(len(lengths)):
        usable = min(int(free[i]), budget // int(lengths[i]))
        size = 1
        while usable > 0:
            piece = min(size, usable)
            grown = (reached | reached << piece * int(lengths[i])) & mask
            if grown != reached:
                steps.append((i, piece, reached))
                reached = grown
            usable -= piece
            size *= 2
        if reached >> budget & 1:
            break
    best, chosen = reached.bit_length() - 1, []
    for i, piece, before in reversed(steps):
        if not before >> best & 1:
            chosen.append((i, piece))
            best -= piece * int(lengths[i])
    return chosen


def _fit_source(rows: pd.DataFrame) -> pd.DataFrame:
    """Whole passes and extra documents for each length of one source."""
    rows = rows.sort_values("size", ignore_index=True)
    size, n = rows["size"].to_numpy(np.int64), rows["n"].to_numpy(np.int64)
    whole = int(sum(int(a) * int(b) for a, b in zip(size, n, strict=True)))
    target = float(rows["target"].iloc[0])
    passes = min(MOST_COPIES, int(target // whole)) if whole else 0
    extra = np.zeros(len(rows), dtype=np.int64)
    if passes < MOST_COPIES and whole:
        words = size > 0
        extra[words] = fit_counts(size[words], n[words], round(target - passes * whole))
    return pd.DataFrame(
        {"source_no": rows["source_no"], "size": size, "passes": passes, "extra": extra}
    )


def source_targets(lengths: DataFrame, weights=WEIGHTS) -> DataFrame:
    """(source, source_no, source_size, target) from (source, size, n).

    The words of all sources are shared by weight. A source never gets more than ``MOST_COPIES``
    times its words; what it can't take goes to the others by weight until none is above. With
    sources ordered by limit / weight, those before a certain one are at their limit and the rest
    share one rate, so one ordered pass finds the rate. One row per source takes part.
    """
    weigh = f"element_at(array({', '.join(map(str, weights))}), 1 + (source_no % {len(weights)}))"
    sources = lengths.groupBy("source").agg(F.expr("sum(size * n)").alias("source_size"))
    return lengths.sparkSession.sql(f"""
        WITH numbered AS (
            SELECT source, source_size,
                   row_number() OVER (ORDER BY source NULLS LAST) - 1 AS source_no FROM {{s}}),
        weighed AS (
            SELECT *, CAST({weigh} AS DOUBLE) AS w,
                   CAST({MOST_COPIES} * source_size AS DOUBLE) AS most FROM numbered),
        ordered AS (
            SELECT *, most / w AS full_rate,
                   (sum(source_size) OVER () - coalesce(sum(most) OVER before, 0))
                   / (sum(w) OVER () - coalesce(sum(w) OVER before, 0)) AS rate FROM weighed
            WINDOW before AS (ORDER BY most / w, source_no
                              ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
        found AS (
            SELECT coalesce(min_by(rate, struct(full_rate, source_no))
                            FILTER (WHERE rate <= full_rate), 0) AS rate FROM ordered)
        SELECT source, CAST(source_no AS INT) AS source_no,
               CAST(source_size AS BIGINT) AS source_size, least(most, w * found.rate) AS target
        FROM ordered JOIN found ON true""", s=sources)


def mix(docs: DataFrame, store: Store, size: str = WORD_COUNT, seed: int = SEED) -> DataFrame:
    """Rows of ``docs`` with ``size``, ``source_size``, ``target`` and ``copies`` (0 to 3).

    ``docs`` needs doc_id, source and what the SQL expression ``size`` reads; it is read three
    times. Columns of the four names are replaced. A null source is a source of its own, an empty
    text has size 0 and no copies beyond its source's whole passes. Equal documents of one id may
    get different copies; which row gets which then makes no difference.
    """
    sized = docs.withColumn("size", F.expr(size))
    lengths = store.save(sized.groupBy("source", "size").agg(F.count("*").alias("n")), "lengths")
    targets = store.save(source_targets(lengths), "targets")
    known = targets.withColumnRenamed("source", "_source")
    by_no = lengths.join(known, F.expr("source <=> _source"))
    fitted = by_no.groupBy("source_no").applyInPandas(
        _fit_source, "source_no int, size long, passes int, extra long"
    )
    plan = store.save(
        by_no.join(fitted, ["source_no", "size"]).selectExpr(
            "source AS _source", "source_no AS _no", "size AS _size", "source_size", "target",
            "passes AS _passes", "extra AS _extra", "n AS _n",
        ),
        "plan",
    )
    few = plan.count() <= SENDABLE_ROWS
    placed = (
        sized.drop("source_size", "target", "copies")
        .join(F.broadcast(plan) if few else plan, F.expr("size = _size AND source <=> _source"))
        .withColumn("_draw", F.xxhash64("doc_id", F.lit(seed)))
        .withColumn(
            "_part",
            F.expr(
                "CAST(floor(shiftrightunsigned(_draw, 11) / 9007199254740992D"
                f" * ceil(_n / {RANKED_TOGETHER}D)) AS BIGINT)"
            ),
        )
    )
    part = ["_no", "_size", "_part"]
    counts = store.save(placed.groupBy(*part).agg(F.count("*").alias("_rows")), "parts")
    first = counts.selectExpr(
        *part,
        "coalesce(sum(_rows) OVER (PARTITION BY _no, _size ORDER BY _part"
        " ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS _first",
    )
    ranked = placed.repartition(*part).withColumn(
        "_rank",
        F.expr("row_number() OVER (PARTITION BY _no, _size, _part ORDER BY _draw, doc_id)"),
    )
    return (
        ranked.join(first, part)
        .withColumn("copies", F.expr("_passes + IF(_first + _rank <= _extra, 1, 0)"))
        .drop(*part, "_source", "_draw", "_rank", "_first", "_passes", "_extra", "_n")
    )


def op9_mixing(spark, folder: str) -> DataFrame:
    """All documents with their source's target and the words that the mix takes of them."""
    store = Store(spark)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    sizes = store.save(docs.selectExpr("doc_id", "source", f"{WORD_COUNT} AS size"), "sizes")
    return mix(sizes, store, "size").selectExpr(
        "doc_id", "size", "source_size", "target", "CAST(size * copies AS BIGINT) AS taken"
    )
