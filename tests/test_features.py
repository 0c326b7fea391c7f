import numpy as np
import pandas as pd
import pytest

from patronscope.catalog import METRICS
from patronscope.operators.features import capped_features, outlier_caps, scaled_features
from patronscope.operators.rfm import landmarks

RFM = "customer_id bigint, recency bigint, frequency bigint, monetary double"


@pytest.fixture()
def table():
    rng = np.random.default_rng(5)
    return pd.DataFrame(
        {
            "customer_id": np.arange(101),
            "recency": rng.integers(1, 300, 101),
            "frequency": rng.integers(1, 20, 101),
            "monetary": rng.lognormal(5, 2, 101).round(2),
        }
    )


def caps_at(rfm, fraction):
    quantiles = {m: fraction for m in METRICS}
    return outlier_caps(rfm, landmarks(rfm, quantiles), quantiles)


def test_caps_are_interpolated_quantiles(spark, table):
    quantiles = {"recency": 0.5, "frequency": 0.9, "monetary": 0.993}
    rfm = spark.createDataFrame(table, RFM)
    caps = outlier_caps(rfm, landmarks(rfm, quantiles), quantiles).first()
    for m in METRICS:
        assert caps[f"{m}_cap"] == pytest.approx(table[m].quantile(quantiles[m]), rel=1e-12)


def test_capping_and_scaling(spark, table):
    rfm = spark.createDataFrame(table, RFM)
    caps = caps_at(rfm, 0.9)
    capped = capped_features(rfm, caps)
    got = scaled_features(capped).toPandas().sort_values("customer_id")
    for m in METRICS:
        want = table[m].clip(upper=table[m].quantile(0.9))
        z = (want - want.mean()) / want.std(ddof=0)
        assert np.allclose(got[f"z_{m}"], z)
        assert got[m].tolist() == table[m].tolist(), "metrics keep their raw values"
    assert not [c for c in got if c.endswith("_capped")]


def test_constant_metric_scales_to_zero(spark, table):
    rfm = spark.createDataFrame(table.assign(frequency=7), RFM)
    caps = caps_at(rfm, 0.99)
    got = scaled_features(capped_features(rfm, caps)).toPandas()
    assert (got["z_frequency"] == 0).all()
    assert got["z_recency"].std(ddof=0) == pytest.approx(1)


def test_no_customers(spark):
    rfm = spark.createDataFrame([], RFM)
    caps = caps_at(rfm, 0.99)
    assert caps.first().monetary_cap is None
    assert scaled_features(capped_features(rfm, caps)).count() == 0
