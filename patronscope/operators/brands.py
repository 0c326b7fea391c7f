"""RFM per brand, store or any other label of a transaction line."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from patronscope.catalog import METRICS
from patronscope.functions.order_stats import global_order
from patronscope.operators.clean import clean_transactions
from patronscope.operators.rfm import QUINTILES, elapsed_days
from patronscope.sources.workspace import Workspace


def rfm_by(tx: DataFrame, label: str, workspace: Workspace) -> DataFrame:
    """One row per label (null is one as well) and customer: recency, frequency, monetary value.

    Recency counts from the day after the latest sale of all labels, so labels are comparable. Lines
    are first reduced per (label, customer, invoice): a label or customer with a third of all lines
    is spread by invoice.
    """
    invoices = (
        clean_transactions(tx, label)
        .groupBy(label, "customer_id", "invoice_no")
        .agg(F.expr("max(invoice_ts) as last_ts"), F.expr("sum(revenue) as revenue"))
    )
    customers = workspace.save(
        invoices.groupBy(label, "customer_id").agg(
            F.expr("max(last_ts) as last_ts"),
            F.expr("count(invoice_no) as frequency"),
            F.expr("cast(bround(sum(revenue), 2) as double) as monetary"),
        ),
        "label-customers",
    )
    latest = customers.selectExpr("cast(max(last_ts) as string)").first()[0]
    return customers.selectExpr(
        label, "customer_id", f"{elapsed_days(latest)} as recency", "frequency", "monetary"
    )


def scores_by(rfm: DataFrame, label: str, workspace: Workspace) -> DataFrame:
    """Add quintile scores within each label, ties by customer id, and their sum.

    All (label, metric, value, customer) rows are sorted once, by ranges of that whole key: a large
    label spans many tasks. A rank within a label is the position in the whole order less that of
    the label's first row. Edges are the linear ones of the whole-portfolio scores; a label with a
    single customer has no quintiles, its scores are null.
    """
    values = ", ".join(
        f"struct({i} as metric_no, cast({m} as double) as value)" for i, m in enumerate(METRICS)
    )
    long = rfm.selectExpr(label, f"inline(array({values}))", "customer_id")
    order = global_order(
        long, [label, "metric_no", "value", "customer_id"], workspace, "label-order"
    )
    positions = order.with_position()
    firsts = positions.groupBy(label, "metric_no").agg(
        F.min("position").alias("first"), F.count("*").alias("n")
    )
    # As many rows as labels times metrics; Spark broadcasts them if their size allows.
    ranked = positions.withColumnRenamed(label, "_label").join(
        firsts.withColumnsRenamed({label: "_of", "metric_no": "_metric"}),
        F.expr("_label <=> _of AND metric_no = _metric"),
    )
    rank = "position - first"
    bucket = f"greatest(1, cast(ceil({QUINTILES} * ({rank}) / nullif(n - 1, 0)) as int))"
    scored = ranked.selectExpr(
        "_label", "customer_id", "metric_no",
        f"if(n < 2, null, if(metric_no = 0, {QUINTILES + 1} - {bucket}, {bucket})) as score",
        "value",
    )
    kinds = dict(rfm.dtypes)
    wide = scored.groupBy("_label", "customer_id").agg(
        *[
            F.expr(f"cast(max(if(metric_no = {i}, value, null)) as {kinds[m]}) as {m}")
            for i, m in enumerate(METRICS)
        ],
        *[
            F.expr(f"max(if(metric_no = {i}, score, null)) as {m[0]}_score")
            for i, m in enumerate(METRICS)
        ],
    )
    return wide.withColumnRenamed("_label", label).withColumn(
        "rfm_score", F.expr("r_score + f_score + m_score")
    )
