"""Metrics of streams."""

from .incremental import StateTable, stream_metrics, windowed_metrics

__all__ = ["StateTable", "stream_metrics", "windowed_metrics"]
