"""Where rows come from and where metrics go."""

from .cache import CachedStore, CacheStats
from .frame import FrameSource
from .store import MemoryStore, MetricStore, ParquetStore, StoredMetric

__all__ = ["CacheStats", "CachedStore", "FrameSource", "MemoryStore", "MetricStore", "ParquetStore", "StoredMetric"]
