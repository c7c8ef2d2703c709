"""A store that keeps what is read and holds back what is written."""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterable
from dataclasses import dataclass
from typing import Any

from .store import MemoryStore, MetricStore, StoredMetric, StoreStats

_ABSENT = object()


@dataclass
class CacheStats:
    """Reads answered without the store, reads that went to it, and rows that wait to be written."""

    hits: int = 0
    misses: int = 0
    dirty: int = 0

    @property
    def hit_ratio(self) -> float:
        return self.hits / (self.hits + self.misses) if self.hits + self.misses else 0.0


class CachedStore:
    """A write-back cache before another store.

    Rows persisted wait here until ``flush``, or until ``most_dirty`` of them do, and then go to
    the store in one write, which for a store of files means one file instead of many.  Reads
    see them as if they were written.  An answer of the store is kept until the next write or
    deletion that may change it.
    """

    def __init__(self, store: MetricStore, most_dirty: int = 10_000):
        self.store, self.most_dirty, self.counts = store, most_dirty, CacheStats()
        self._dirty = MemoryStore()
        self._kept: dict[tuple, Any] = {}

    def __enter__(self) -> CachedStore:
        return self

    def __exit__(self, *_: Any) -> None:
        self.flush()

    def _read(self, key: tuple, ask: Any) -> Any:
        if (kept := self._kept.get(key, _ABSENT)) is not _ABSENT:
            self.counts.hits += 1
            return kept
        self.counts.misses += 1
        self._kept[key] = ask()
        return self._kept[key]

    def persist(self, rows: Iterable[StoredMetric]) -> None:
        self._dirty.persist(rows)
        self.counts.dirty = self._dirty.stats().total
        if self.counts.dirty >= self.most_dirty:
            self.flush()

    def flush(self) -> int:
        """Write what waits; how many rows that were."""
        rows = self._dirty.all()
        if rows:
            self.store.persist(rows)
            self._dirty, self._kept = MemoryStore(), {}
        self.counts.dirty = 0
        return len(rows)

    def is_dirty(self, metric_id: str) -> bool:
        return self._dirty.exists(metric_id)

    def clear(self) -> None:
        """Forget what was read; what waits to be written stays."""
        self._kept.clear()

    def get_metric_window(self, name: str, dataset: str, first: dt.date, last: dt.date, parameters: str = "{}", tags: dict[str, str] | None = None, execution_id: str | None = None) -> dict[dt.date, StoredMetric]:
        key = (name, dataset, first, last, parameters, None if tags is None else tuple(sorted(tags.items())), execution_id)
        found = dict(self._read(key, lambda: self.store.get_metric_window(name, dataset, first, last, parameters, tags, execution_id)))
        for day, row in self._dirty.get_metric_window(name, dataset, first, last, parameters, tags, execution_id).items():
            if day not in found or found[day].created <= row.created:
                found[day] = row
        return found

    def get_metric(self, name: str, dataset: str, day: dt.date, parameters: str = "{}", tags: dict[str, str] | None = None, execution_id: str | None = None) -> StoredMetric | None:
        return self.get_metric_window(name, dataset, day, day, parameters, tags, execution_id).get(day)

    def get_by_execution_id(self, execution_id: str) -> list[StoredMetric]:
        return [*self._read((execution_id,), lambda: self.store.get_by_execution_id(execution_id)), *self._dirty.get_by_execution_id(execution_id)]

    def exists(self, metric_id: str) -> bool:
        return self._dirty.exists(metric_id) or self.store.exists(metric_id)

    def delete(self, metric_id: str) -> None:
        self._dirty.delete(metric_id)
        self.counts.dirty = self._dirty.stats().total
        self.store.delete(metric_id)
        self._kept.clear()

    def stats(self, now: dt.datetime | None = None) -> StoreStats:
        own, below = self._dirty.stats(now), self.store.stats(now)
        return StoreStats(own.total + below.total, own.expired + below.expired)

    def delete_expired(self, now: dt.datetime | None = None) -> int:
        gone = self._dirty.delete_expired(now) + self.store.delete_expired(now)
        self.counts.dirty = self._dirty.stats().total
        self._kept.clear()
        return gone
