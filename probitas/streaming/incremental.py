"""Metrics that grow with a stream.

Two ways: states of micro-batches, kept in a table and merged when they are read, which takes
late rows of any age; and windowed aggregation with a watermark, for metrics of event time.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from probitas.operators.metrics import Metric
from probitas.operators.states import combined, state_columns, state_of


class StateTable:
    """States by key and metric in a folder of Parquet files, one folder for each micro-batch.

    A micro-batch that is run again after a failure overwrites its own folder, so its rows
    count once.
    """

    def __init__(self, spark: SparkSession, path: str, metrics: list[Metric], keys: list[str]):
        for m in metrics:
            state_of(m)  # refuses what can't be merged
        self.spark, self.path, self.keys = spark, path.rstrip("/"), keys
        self.metrics = {f"m{k}": m for k, m in enumerate(metrics)}

    def add(self, batch: DataFrame, batch_id: int) -> None:
        """Write the states of a micro-batch; for ``foreachBatch``."""
        states = batch.groupBy(*self.keys).agg(*state_columns(self.metrics))
        states.write.mode("overwrite").parquet(f"{self.path}/batch={batch_id}")

    def frame(self) -> DataFrame:
        """(keys, a column for each metric, by its name) over all micro-batches; a null key is a key like others."""
        out = combined(self.spark.read.parquet(self.path), self.keys, self.metrics)
        return out.select(*self.keys, *(F.col(k).alias(m.name) for k, m in self.metrics.items()))


def stream_metrics(stream: DataFrame, table: StateTable, checkpoint: str) -> DataStreamWriter:
    """A writer that adds each micro-batch of ``stream`` to the table."""
    return stream.writeStream.foreachBatch(table.add).option("checkpointLocation", checkpoint)


def windowed_metrics(stream: DataFrame, time: str, window: str, metrics: list[Metric], late: str, slide: str | None = None) -> DataFrame:
    """(start, end, a column for each metric) by windows of event time; rows later than ``late`` are dropped."""
    w = F.window(time, window, slide) if slide else F.window(time, window)
    out = stream.withWatermark(time, late).groupBy(w.alias("w")).agg(*(m.column().alias(m.name) for m in metrics))
    return out.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *(F.col(f"`{m.name}`") for m in metrics))
