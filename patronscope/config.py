"""Tunable parameters and customer filters."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from typing import Any


@dataclass(frozen=True)
class HeatmapBands:
    """Left-open, right-closed bands; the last band of each axis has no upper edge.

    ``edges[i]`` is the lower edge of the band named ``labels[i]``.
    """

    # Default edges and labels of the recency and spend bands.
    recency_edges: tuple[float, ...] = (0, 30, 90, 150, 210, 270)
    recency_labels: tuple[str, ...] = ("0-30", "31-90", "91-150", "151-210", "211-270", "271+")
    monetary_edges: tuple[float, ...] = (0, 500, 2000, 5000, 20000)
    monetary_labels: tuple[str, ...] = ("£0-500", "£501-2k", "£2k-5k", "£5k-20k", "£20k+")

    def __post_init__(self) -> None:
        for axis in ("recency", "monetary"):
            edges = getattr(self, f"{axis}_edges")
            labels = getattr(self, f"{axis}_labels")
            if len(edges) != len(labels):
                raise ValueError(f"{axis}: {len(edges)} edges but {len(labels)} labels")
            if any(low >= high for low, high in zip(edges, edges[1:])):
                raise ValueError(f"{axis}: edges must rise strictly, got {edges}")
            if len(set(labels)) != len(labels):
                raise ValueError(f"{axis}: labels repeat, got {labels}")


@dataclass(frozen=True)
class SegmentationConfig:
    """Parameters of one segmentation run."""

    k_final: int = 5
    random_state: int = 42
    n_init: int = 20
    sweep_n_init: int = 10
    k_range_start: int = 2
    k_range_end: int = 8
    recency_quantile: float = 0.99
    frequency_quantile: float = 0.99
    monetary_quantile: float = 0.99
    heatmap: HeatmapBands = field(default_factory=HeatmapBands)

    def __post_init__(self) -> None:
        for name in ("recency_quantile", "frequency_quantile", "monetary_quantile"):
            value = getattr(self, name)
            if not 0.0 < value < 1.0:
                raise ValueError(f"{name}={value} is not between 0 and 1")
        for name in ("k_final", "k_range_start"):
            if getattr(self, name) < 2:
                raise ValueError(f"{name} must be at least 2")
        if self.k_range_start >= self.k_range_end:
            raise ValueError("k_range_start must be below k_range_end")
        if self.n_init < 1 or self.sweep_n_init < 1:
            raise ValueError("n_init and sweep_n_init must be at least 1")

    @property
    def sweep_ks(self) -> range:
        return range(self.k_range_start, self.k_range_end + 1)

    @property
    def cap_quantiles(self) -> dict[str, float]:
        return {
            "recency": self.recency_quantile,
            "frequency": self.frequency_quantile,
            "monetary": self.monetary_quantile,
        }

    @classmethod
    def from_mapping(cls, settings: Mapping[str, Any]) -> SegmentationConfig:
        """Build from nested settings with sections ``clustering``, ``caps`` and ``heatmap``."""
        values: dict[str, Any] = {**settings.get("clustering", {}), **settings.get("caps", {})}
        bands = settings.get("heatmap")
        if bands:
            values["heatmap"] = HeatmapBands(
                recency_edges=tuple(bands["recency_bins"]),
                recency_labels=tuple(bands["recency_labels"]),
                monetary_edges=tuple(bands["monetary_bins"]),
                monetary_labels=tuple(bands["monetary_labels"]),
            )
        return cls(**values)

    @classmethod
    def from_yaml(cls, path: str) -> SegmentationConfig:
        try:
            import yaml
        except ImportError as missing:
            raise RuntimeError("reading YAML settings needs the yaml module") from missing
        with open(path, encoding="utf-8") as handle:
            return cls.from_mapping(yaml.safe_load(handle) or {})


@dataclass(frozen=True)
class CustomerFilter:
    """Which customers a report covers; a bound of ``None`` is open, both ends inclusive."""

    segments: Sequence[str] | None = None
    score_lo: int | None = None
    score_hi: int | None = None
    monetary_lo: float | None = None
    monetary_hi: float | None = None
