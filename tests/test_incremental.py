import random

import pytest
from __spark_entry__ import BATCHES, _staged
from conftest import SHOPPERS, TX

from patronscope.operators.clean import clean_transactions
from patronscope.operators.rfm import rfm_base
from patronscope.streaming.incremental import InvoiceState, ingest


@pytest.fixture()
def whole(sales_df, workspace):
    """The customer table from one pass over all lines."""
    return sorted(tuple(r) for r in rfm_base(clean_transactions(sales_df), workspace).collect())


def found(state, workspace) -> list[tuple]:
    return sorted(tuple(r) for r in state.rfm_base(workspace).collect())


@pytest.mark.parametrize("seed", [1, 2])
def test_any_split_equals_one_pass(spark, sales, whole, workspace, tmp_path, seed):
    """Lines are dealt at random, so invoices are split; batches come twice, before and after folds."""
    rng = random.Random(seed)
    batches = [[] for _ in range(5)]
    for line in sales:
        rng.choice(batches).append(line)
    state = InvoiceState(spark, str(tmp_path / "state"))
    assert found(state, workspace) == []
    for number, batch in enumerate(batches):
        lines = spark.createDataFrame(batch, TX)
        state.merge(lines, number)
        if number == 1:
            state.merge(lines, number)  # replayed while it is a delta
            state.fold()
            state.merge(lines, number)  # replayed when the base holds it
        if number == 3:
            state.fold()
            state.fold()
    assert found(state, workspace) == whole
    assert len(whole) == SHOPPERS
    state.fold()
    assert found(state, workspace) == whole


def test_unfinished_tables_do_not_count(spark, sales_df, whole, workspace, tmp_path):
    state = InvoiceState(spark, str(tmp_path / "state"))
    state.merge(sales_df, 0)
    for kind in ("delta/1", "base/7"):
        clean_transactions(sales_df).groupBy("customer_id", "invoice_no").agg(
            {"invoice_ts": "max"}
        ).write.parquet(str(tmp_path / "state" / kind))
        (tmp_path / "state" / kind / "_SUCCESS").unlink()
    assert found(state, workspace) == whole


def test_stream_goes_on_after_a_restart(spark, sales, whole, workspace, tmp_path):
    """Files that arrive later are taken in by the next run; the first ones aren't read again."""
    folder, half = str(tmp_path / "in"), len(sales) // 2
    state = InvoiceState(spark, str(tmp_path / "state"))
    for part in (sales[:half], sales[half:], []):
        if part:
            spark.createDataFrame(part, TX).repartition(3).write.mode("append").parquet(folder)
        stream = spark.readStream.schema(TX).option("maxFilesPerTrigger", 2).parquet(folder)
        ingest(stream, state, str(tmp_path / "progress"), fold_every=2)
    assert found(state, workspace) == whole
    assert state._complete("base") and len(state._complete("delta")) >= 3


def test_large_batches_are_cut_into_tasks(spark, sales, whole, workspace):
    """No task gets a whole batch; files that arrive together still make no more batches."""
    size = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    spark.conf.set(size, "2k")
    try:
        stream = _staged(spark.createDataFrame(sales, TX).repartition(8), f"{workspace.path}/staged")
    finally:
        spark.conf.unset(size)
    files = spark.read.parquet(f"{workspace.path}/staged").inputFiles()
    assert len(files) > 2 * BATCHES
    state = InvoiceState(spark, f"{workspace.path}/state")
    ingest(stream, state, f"{workspace.path}/progress", fold_every=3)
    assert found(state, workspace) == whole
    assert len(state._complete("delta")) <= BATCHES and state._complete("base")
