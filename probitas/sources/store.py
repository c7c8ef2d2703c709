"""The metric store: one row for each metric, day, dataset and run."""

from __future__ import annotations

import datetime as dt
import itertools
import json
import uuid
from collections.abc import Callable, Iterable
from dataclasses import asdict, dataclass, field, replace
from typing import Any, Protocol

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

TTL_HOURS = 168
SCHEMA = (
    "metric_id string, metric_type string, name string, parameters string, dataset string, state string, value double, "
    "yyyy_mm_dd date, tags map<string,string>, execution_id string, ttl_hours int, created timestamp"
)
_ticks = itertools.count()


def _now() -> dt.datetime:
    # distinct within a process, so that the latest of two rows is defined
    return dt.datetime.now(dt.UTC).replace(tzinfo=None) + dt.timedelta(microseconds=next(_ticks) % 1000)


@dataclass(frozen=True)
class StoredMetric:
    metric_type: str
    name: str
    dataset: str
    value: float
    yyyy_mm_dd: dt.date
    parameters: str = "{}"
    tags: dict[str, str] = field(default_factory=dict)
    state: str = "{}"
    execution_id: str = ""
    ttl_hours: int = TTL_HOURS
    metric_id: str = field(default_factory=lambda: str(uuid.uuid4()))
    created: dt.datetime = field(default_factory=_now)


@dataclass(frozen=True)
class StoreStats:
    total: int
    expired: int


def parameters_text(parameters: Any) -> str:
    return json.dumps(parameters if isinstance(parameters, dict) else dict(parameters), sort_keys=True, default=str)


class MetricStore(Protocol):
    def persist(self, rows: Iterable[StoredMetric]) -> None: ...
    def get_metric(self, name: str, dataset: str, day: dt.date, parameters: str = "{}", tags: dict[str, str] | None = None, execution_id: str | None = None) -> StoredMetric | None: ...
    def get_metric_window(self, name: str, dataset: str, first: dt.date, last: dt.date, parameters: str = "{}", tags: dict[str, str] | None = None, execution_id: str | None = None) -> dict[dt.date, StoredMetric]: ...
    def get_by_execution_id(self, execution_id: str) -> list[StoredMetric]: ...
    def exists(self, metric_id: str) -> bool: ...
    def delete(self, metric_id: str) -> None: ...
    def stats(self, now: dt.datetime | None = None) -> StoreStats: ...
    def delete_expired(self, now: dt.datetime | None = None) -> int: ...


def _expired(row: StoredMetric, now: dt.datetime) -> bool:
    return (row.created + dt.timedelta(hours=row.ttl_hours)).replace(microsecond=0) < now.replace(microsecond=0)


class MemoryStore:
    """Metrics in the driver's memory."""

    def __init__(self) -> None:
        self._rows: dict[str, StoredMetric] = {}

    def persist(self, rows: Iterable[StoredMetric]) -> None:
        self._rows |= {r.metric_id: r for r in rows}

    def _where(self, test: Callable[[StoredMetric], bool]) -> list[StoredMetric]:
        return [r for r in self._rows.values() if test(r)]

    def get_metric_window(self, name, dataset, first, last, parameters="{}", tags=None, execution_id=None):
        found: dict[dt.date, StoredMetric] = {}
        for r in self._where(
            lambda r: r.name == name and r.dataset == dataset and first <= r.yyyy_mm_dd <= last and r.parameters == parameters and (tags is None or r.tags == tags) and execution_id in (None, r.execution_id)
        ):
            if r.yyyy_mm_dd not in found or found[r.yyyy_mm_dd].created < r.created:
                found[r.yyyy_mm_dd] = r
        return found

    def get_metric(self, name, dataset, day, parameters="{}", tags=None, execution_id=None):
        return self.get_metric_window(name, dataset, day, day, parameters, tags, execution_id).get(day)

    def get_by_execution_id(self, execution_id: str) -> list[StoredMetric]:
        return self._where(lambda r: r.execution_id == execution_id)

    def all(self) -> list[StoredMetric]:
        return list(self._rows.values())

    def exists(self, metric_id: str) -> bool:
        return metric_id in self._rows

    def delete(self, metric_id: str) -> None:
        self._rows.pop(metric_id, None)

    def stats(self, now: dt.datetime | None = None) -> StoreStats:
        now = now or _now()
        return StoreStats(len(self._rows), len(self._where(lambda r: _expired(r, now))))

    def delete_expired(self, now: dt.datetime | None = None) -> int:
        now = now or _now()
        gone = self._where(lambda r: _expired(r, now))
        for r in gone:
            del self._rows[r.metric_id]
        return len(gone)

    def frame(self, spark: SparkSession) -> DataFrame:
        return frame_of(spark, self._rows.values())


def frame_of(spark: SparkSession, rows: Iterable[StoredMetric]) -> DataFrame:
    names = [f.split()[0] for f in SCHEMA.split(", ")]
    return spark.createDataFrame([tuple(asdict(r)[n] for n in names) for r in rows], SCHEMA)


def latest(rows: DataFrame, *keys: str) -> DataFrame:
    """The newest row for each value of the keys."""
    newest = Window.partitionBy(*keys).orderBy(F.col("created").desc(), F.col("metric_id").desc())
    return rows.withColumn("__rank", F.row_number().over(newest)).where("__rank = 1").drop("__rank")


class ParquetStore:
    """Metrics in a folder of Parquet files, partitioned by day.

    Rows are only appended; deletions are appended too, as rows of a second folder, and taken
    out by ``compact``.  So no reader sees a half-written table.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _read(self, part: str, schema: str) -> DataFrame:
        try:
            return self.spark.read.schema(schema).parquet(f"{self.path}/{part}")
        except Exception as error:  # a store that was never written
            if "PATH_NOT_FOUND" in str(error):
                return self.spark.createDataFrame([], schema)
            raise

    def frame(self) -> DataFrame:
        deleted = self._read("deleted", "metric_id string")
        return self._read("metrics", SCHEMA).join(deleted, "metric_id", "left_anti")

    def persist(self, rows: Iterable[StoredMetric]) -> None:
        rows = list(rows)
        if rows:
            frame_of(self.spark, rows).coalesce(1).write.mode("append").partitionBy("yyyy_mm_dd").parquet(f"{self.path}/metrics")

    def _rows(self, frame: DataFrame) -> list[StoredMetric]:
        return [StoredMetric(**(r.asDict() | {"tags": dict(r["tags"] or {})})) for r in frame.select(*(f.split()[0] for f in SCHEMA.split(", "))).collect()]

    def get_metric_window(self, name, dataset, first, last, parameters="{}", tags=None, execution_id=None):
        frame = self.frame().where(F.col("yyyy_mm_dd").between(F.lit(first), F.lit(last)) & (F.col("name") == name) & (F.col("dataset") == dataset) & (F.col("parameters") == parameters))
        if execution_id is not None:
            frame = frame.where(F.col("execution_id") == execution_id)
        if tags is not None:
            frame = frame.where(F.to_json(F.array_sort(F.map_entries("tags"))) == F.lit(json.dumps([{"key": k, "value": v} for k, v in sorted(tags.items())], separators=(",", ":"))))
        return {r.yyyy_mm_dd: r for r in self._rows(latest(frame, "yyyy_mm_dd"))}

    def get_metric(self, name, dataset, day, parameters="{}", tags=None, execution_id=None):
        return self.get_metric_window(name, dataset, day, day, parameters, tags, execution_id).get(day)

    def get_by_execution_id(self, execution_id: str) -> list[StoredMetric]:
        return self._rows(self.frame().where(F.col("execution_id") == execution_id))

    def exists(self, metric_id: str) -> bool:
        return not self.frame().where(F.col("metric_id") == metric_id).isEmpty()

    def delete(self, metric_id: str) -> None:
        self._delete(self.spark.createDataFrame([(metric_id,)], "metric_id string"))

    def _delete(self, ids: DataFrame) -> None:
        ids.coalesce(1).write.mode("append").parquet(f"{self.path}/deleted")

    def _gone(self, now: dt.datetime | None) -> DataFrame:
        expiry = F.date_trunc("second", F.expr("created + make_dt_interval(0, ttl_hours)"))
        return self.frame().where(expiry < F.date_trunc("second", F.lit(now or _now()).cast("timestamp")))

    def stats(self, now: dt.datetime | None = None) -> StoreStats:
        return StoreStats(self.frame().count(), self._gone(now).count())

    def delete_expired(self, now: dt.datetime | None = None) -> int:
        ids = [r[0] for r in self._gone(now).select("metric_id").collect()]
        if ids:
            self._delete(self.spark.createDataFrame([(i,) for i in ids], "metric_id string"))
        return len(ids)

    def compact(self, target: str) -> ParquetStore:
        """Write what isn't deleted to another folder, and return the store there."""
        self.frame().repartition("yyyy_mm_dd").write.partitionBy("yyyy_mm_dd").parquet(f"{target.rstrip('/')}/metrics")
        return ParquetStore(self.spark, target)


def with_created(row: StoredMetric, created: dt.datetime) -> StoredMetric:
    return replace(row, created=created)
