import pytest

from patronscope.catalog import METRICS, SEGMENTS
from patronscope.config import HeatmapBands, SegmentationConfig


def test_defaults_are_valid():
    config = SegmentationConfig()
    assert list(config.sweep_ks) == [2, 3, 4, 5, 6, 7, 8]
    assert set(config.cap_quantiles) == set(METRICS)
    assert all(0 < q < 1 for q in config.cap_quantiles.values())


def test_from_mapping_and_yaml(tmp_path):
    text = """
clustering: {k_final: 4, random_state: 1, n_init: 3, k_range_start: 2, k_range_end: 6}
caps: {monetary_quantile: 0.95, frequency_quantile: 0.9, recency_quantile: 0.8}
heatmap:
  recency_bins: [0, 10]
  recency_labels: [new, old]
  monetary_bins: [0]
  monetary_labels: [any]
"""
    path = tmp_path / "settings.yaml"
    path.write_text(text)
    config = SegmentationConfig.from_yaml(str(path))
    assert (config.k_final, config.n_init, config.sweep_ks[-1]) == (4, 3, 6)
    assert config.cap_quantiles == {"recency": 0.8, "frequency": 0.9, "monetary": 0.95}
    assert config.heatmap.recency_labels == ("new", "old")


@pytest.mark.parametrize(
    "bad",
    [
        {"monetary_quantile": 1.0},
        {"k_range_start": 8},
        {"k_final": 1},
        {"n_init": 0},
    ],
)
def test_bad_settings(bad):
    with pytest.raises(ValueError):
        SegmentationConfig(**bad)


def test_bad_bands():
    with pytest.raises(ValueError):
        HeatmapBands(recency_edges=(0, 1), recency_labels=("a",))
    with pytest.raises(ValueError):
        HeatmapBands(recency_edges=(1, 0), recency_labels=("a", "b"))


def test_five_segments():
    assert len(set(SEGMENTS)) == 5
