"""Customers kept up to date from batches of transaction lines.

State is one partial row per (customer, invoice) and batch: the latest time and the revenue. Both
merge by max and sum, so lines of one invoice may arrive in any number of batches and in any order.
A batch only writes its own partial rows, under its id; replaying it replaces them. Folding merges
what many batches wrote into one base table, whose name tells the batches it holds.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from patronscope.operators.clean import clean_transactions
from patronscope.operators.rfm import customers_of_invoices, rfm_of_customers
from patronscope.sources.workspace import Workspace

PARTIAL = "customer_id bigint, invoice_no string, last_ts timestamp_ntz, revenue decimal(38, 8)"
MERGED = ("max(last_ts) as last_ts", "cast(sum(revenue) as decimal(38, 8)) as revenue")


class InvoiceState:
    """Partial invoices under ``path``, which driver and executors must share.

    ``delta/<batch id>`` holds the rows of one batch, ``base/<batch id>`` those of all batches up to
    that one. A table counts once Spark has marked it as complete.
    """

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark = spark
        self.path = path.rstrip("/")

    def _complete(self, kind: str) -> list[int]:
        """Batch ids of the complete tables of a kind, ascending."""
        jvm = self.spark._jvm
        pattern = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{kind}/*/_SUCCESS")
        files = pattern.getFileSystem(self.spark._jsc.hadoopConfiguration())
        marks = files.globStatus(pattern) or []
        return sorted(int(re.search(r"/(\d+)/_SUCCESS$", str(m.getPath())).group(1)) for m in marks)

    def _read(self, names: list[str]) -> DataFrame:
        if not names:
            return self.spark.createDataFrame([], PARTIAL)
        return self.spark.read.schema(PARTIAL).parquet(*[f"{self.path}/{n}" for n in names])

    def _tables(self) -> tuple[list[str], list[int]]:
        """Names of the tables that together hold every batch once, and the deltas among them."""
        bases = self._complete("base")
        newest = bases[-1] if bases else -1
        deltas = [b for b in self._complete("delta") if b > newest]
        return [f"base/{newest}"] * bool(bases) + [f"delta/{b}" for b in deltas], deltas

    def merge(self, tx: DataFrame, batch_id: int) -> None:
        """Take in one batch of lines; a batch that the base already holds is left alone.

        Batch ids grow. A replayed batch must hold the lines it held before.
        """
        bases = self._complete("base")
        if bases and batch_id <= bases[-1]:
            return
        partial = clean_transactions(tx).groupBy("customer_id", "invoice_no").agg(
            F.expr("max(invoice_ts) as last_ts"),
            F.expr("cast(sum(revenue) as decimal(38, 8)) as revenue"),
        )
        partial.write.mode("overwrite").parquet(f"{self.path}/delta/{batch_id}")

    def invoices(self) -> DataFrame:
        """One row per (customer, invoice) over all batches."""
        return (
            self._read(self._tables()[0])
            .groupBy("customer_id", "invoice_no")
            .agg(*[F.expr(text) for text in MERGED])
        )

    def fold(self) -> None:
        """Merge base and deltas into a new base; nothing is removed, so readers go on."""
        deltas = self._tables()[1]
        if deltas:
            self.invoices().write.mode("overwrite").parquet(f"{self.path}/base/{deltas[-1]}")

    def rfm_base(self, workspace: Workspace) -> DataFrame:
        """Recency, frequency and monetary value of every customer, over all batches so far."""
        customers = workspace.save(customers_of_invoices(self.invoices()), "customers")
        return rfm_of_customers(customers)


def ingest(stream: DataFrame, state: InvoiceState, checkpoint: str, fold_every: int = 16) -> None:
    """Take in all lines that a stream of transactions has now, then stop.

    A restart goes on after the last complete batch; one that was cut short is replayed under its
    id. Every ``fold_every`` batches the state is folded, so a read opens few tables.
    """

    def take(batch: DataFrame, batch_id: int) -> None:
        state.merge(batch, batch_id)
        if batch_id % fold_every == fold_every - 1:
            state.fold()

    query = (
        stream.writeStream.foreachBatch(take)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
