import numpy as np
import pandas as pd
import pytest

from patronscope.functions.order_stats import global_order


@pytest.fixture()
def many_partitions(spark):
    """Keep AQE from merging the small range partitions of a test."""
    name = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(name, "false")
    yield
    spark.conf.unset(name)


def test_positions_over_many_tasks(spark, workspace, many_partitions):
    rng = np.random.default_rng(1)
    # Two thirds of the rows share one value.
    value = np.where(rng.random(3000) < 0.67, 5.0, rng.integers(0, 10, 3000))
    table = pd.DataFrame({"value": value, "id": rng.permutation(3000)})
    order = global_order(spark.createDataFrame(table), ["value", "id"], workspace, "t")
    assert order.total == 3000 and len(order.tasks) == 4
    sizes = np.diff([*order.starts, order.total])
    assert sizes.max() < 2 * sizes.min(), "the frequent value must not fill one partition"
    want = table.sort_values(["value", "id"]).reset_index(drop=True)
    got = order.with_position().toPandas().sort_values("position").reset_index(drop=True)
    assert got["position"].tolist() == list(range(3000))
    assert (got[["value", "id"]] == want).all().all()
    picked = order.rows_at([0, 749, 1500, 2999])
    assert {p: r["id"] for p, r in picked.items()} == want["id"][[0, 749, 1500, 2999]].to_dict()
    many = order.rows_at(range(0, 3000, 120))
    assert {p: r["id"] for p, r in many.items()} == want["id"][::120].to_dict()
    assert order.rows_at([]) == {}
    with pytest.raises(IndexError):
        order.rows_at([3000])


def test_no_rows(spark, workspace):
    order = global_order(spark.createDataFrame([], "v double, id bigint"), ["v", "id"], workspace, "t")
    assert order.total == 0
    assert order.with_position().count() == 0
