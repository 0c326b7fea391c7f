"""A training corpus from raw documents: stages that each call one operator of ``llm``.

Each stage reads what its predecessor wrote and decides on all of it. All but the last return the
columns of their input, also under names that an operator uses itself; the mixing stage repeats a row
as often as its source's budget asks for, the last one replaces columns named like those it adds.
Null texts, ids, languages and sources, empty and very long texts, ties and repeated rows are treated
as the operators say: such rows stay unless they are toxic, repeat another text, hold a benchmark item
or have no copy in the mix. An empty table stays empty.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from patronscope.llm.decontamination import drop_contaminated
from patronscope.llm.mixing import WORD_COUNT, mix
from patronscope.llm.near_duplicates import keep_one_of_each
from patronscope.llm.sharding import assign_shards
from patronscope.llm.shared import Store
from patronscope.llm.toxicity import drop_toxic

SHARDS = 8

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def toxicity(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Drop documents that the toxicity classifier rejects."""
    return drop_toxic(docs, spark.read.parquet(f"{folder}/labels.parquet"))


def near_duplicates(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Keep one document of each group of near duplicates."""
    return keep_one_of_each(docs, Store(spark))


def decontamination(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Drop documents that contain benchmark items."""
    benchmark = spark.read.parquet(f"{folder}/benchmark.parquet")
    return drop_contaminated(docs, benchmark, Store(spark))


def mixing(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Repeat or leave out documents so that sources meet their target weights.

    A row travels as one column beside what the mix reads, so its names can't clash.
    """
    rows = docs.select(
        "doc_id", "source", F.expr(WORD_COUNT).alias("words"), F.struct(*docs.columns).alias("row")
    )
    mixed = mix(rows, Store(spark), "words")
    return mixed.select("row", F.explode(F.expr("array_repeat(0, copies)"))).select("row.*")


def sharding(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Place every document in a shard by its id."""
    return assign_shards(docs, [1.0] * SHARDS)


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", toxicity),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("mixing", mixing),
    ("sharding", sharding),
]

# Training a classifier and fitting subset sums have no SQL form; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, folder: str) -> DataFrame:
    """All stages over the documents of ``folder``, each written and read again by the next."""
    store = Store(spark)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for number, (name, stage) in enumerate(STAGES, 1):
        docs = store.save(stage(spark, docs, folder), f"{number}-{name}")
    return docs
