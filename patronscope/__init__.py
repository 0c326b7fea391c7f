"""Customer value analysis on Spark: RFM scoring, segmentation and segment reporting."""

from patronscope.config import CustomerFilter, HeatmapBands, SegmentationConfig

__all__ = ["CustomerFilter", "HeatmapBands", "SegmentationConfig"]
