"""How a metric's value went from the store through the analysis to the assertions."""

from __future__ import annotations

import datetime as dt
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from probitas.operators.metrics import Metric
from probitas.sources.store import StoredMetric

METRICS = "date date, metric string, type string, dataset string, value double, tags string"
ANALYSIS = "date date, metric string, symbol string, type string, dataset string, value double, tags string"
SYMBOLS = "date date, symbol string, metric string, dataset string, value double, error string, tags string, data_av_ratio double"


def tags_text(tags: dict[str, str] | None) -> str:
    return ", ".join(map("=".join, sorted((tags or {}).items()))) or "-"


def metrics_frame(spark: SparkSession, rows: list[StoredMetric]) -> DataFrame:
    return spark.createDataFrame([(r.yyyy_mm_dd, r.name, r.metric_type, r.dataset, r.value, tags_text(r.tags)) for r in rows], METRICS).orderBy(F.desc("date"), "metric")


def trace_join(metrics: DataFrame, analysis: DataFrame, symbols: DataFrame) -> DataFrame:
    """The three tables as one.

    Stored metrics and the analysis are joined in full on (date, metric, dataset); symbols are
    added where (date, symbol, metric, dataset) agree.
    """
    a = analysis.select("date", "metric", "dataset", "symbol", F.col("type").alias("a_type"), F.col("value").alias("value_analysis"), F.col("tags").alias("a_tags"))
    m = metrics.select("date", "metric", "dataset", F.col("type").alias("m_type"), F.col("value").alias("value_db"), F.col("tags").alias("m_tags"))
    both = m.join(a, ["date", "metric", "dataset"], "full_outer")
    s = symbols.select("date", "metric", "dataset", "symbol", F.col("value").alias("value_final"), "error", F.col("tags").alias("s_tags"), "data_av_ratio")
    kind = F.coalesce("m_type", "a_type")
    return both.join(s, ["date", "symbol", "metric", "dataset"], "left").select(
        "date",
        "metric",
        "symbol",
        kind.alias("type"),
        "dataset",
        "value_db",
        "value_analysis",
        "value_final",
        "error",
        F.coalesce("m_tags", "a_tags", "s_tags").alias("tags"),
        F.coalesce(kind.isin("day_over_day", "week_over_week", "stddev"), F.lit(False)).alias("is_extended"),
        "data_av_ratio",
    )


METRICS_ARROW = pa.schema([("date", pa.date32()), ("metric", pa.string()), ("type", pa.string()), ("dataset", pa.string()), ("value", pa.float64()), ("tags", pa.string())])
ANALYSIS_ARROW = METRICS_ARROW.insert(2, pa.field("symbol", pa.string()))


def metrics_table(rows: list[StoredMetric]) -> pa.Table:
    """Stored metrics as an Arrow table, the newest day first."""
    ordered = sorted(rows, key=lambda r: (-r.yyyy_mm_dd.toordinal(), r.name))
    return pa.table(list(zip(*((r.yyyy_mm_dd, r.name, r.metric_type, r.dataset, r.value, tags_text(r.tags)) for r in ordered), strict=True)) or [[]] * len(METRICS_ARROW), schema=METRICS_ARROW)


def analysis_table(suite: Any) -> pa.Table:
    """What the analysis of a run computed, as an Arrow table, the newest day first."""
    rows = sorted(_analysis_rows(suite, _named(suite)), key=lambda r: (-r[0].toordinal(), r[1], r[4]))
    return pa.table(list(zip(*rows, strict=True)) or [[]] * len(ANALYSIS_ARROW), schema=ANALYSIS_ARROW)


def _named(suite: Any) -> dict[tuple, str]:
    """(dataset, day, spec) to the first symbol for it."""
    names: dict[tuple, str] = {}
    for name, s in suite.provider.symbols.items():
        names.setdefault((s.dataset, suite.key.yyyy_mm_dd - dt.timedelta(days=s.lag), s.spec), name)
    return names


def _analysis_rows(suite: Any, names: dict[tuple, str]) -> list[tuple]:
    tags = tags_text(suite.key.tags)
    return [
        (day, spec.name, names.get((dataset, day, spec)), spec.kind, dataset, v.value if v.ok else None, tags)
        for (dataset, day, spec), v in suite._analysis.items()
        if isinstance(spec, Metric)
    ]


def metric_trace(suite: Any, spark: SparkSession) -> DataFrame:
    stored = metrics_frame(spark, suite.db.get_by_execution_id(suite.execution_id))
    tags = tags_text(suite.key.tags)
    by_spec = _named(suite)
    symbols = []
    for name, s in suite.provider.symbols.items():
        day = suite.key.yyyy_mm_dd - dt.timedelta(days=s.lag)
        v = suite._values.get(name)
        ok = v is not None and v.ok
        symbols.append((day, name, s.spec.name, s.dataset, v.value if ok else None, None if ok or v is None else str(v), tags, suite._ratios.get(name)))
    analysis = _analysis_rows(suite, by_spec)
    # trends aren't analysed; they go from the store to their symbol
    analysis += [(day, spec.name, name, spec.kind, dataset, None, tags) for (dataset, day, spec), name in by_spec.items() if not isinstance(spec, Metric)]
    return trace_join(stored, spark.createDataFrame(analysis, ANALYSIS), spark.createDataFrame(symbols, SYMBOLS))


def differs(a: str, b: str):
    x, y = F.col(a), F.col(b)
    return F.coalesce(F.abs(x - y) > 1e-9 * F.greatest(F.abs(x), F.abs(y)), F.lit(False))


def discrepancies(trace: DataFrame) -> DataFrame:
    """The rows of metrics that aren't extended whose values differ between two steps."""
    return trace.where(~F.col("is_extended")).where(differs("value_db", "value_analysis") | differs("value_analysis", "value_final") | differs("value_db", "value_final"))


def discrepancy_details(trace: DataFrame) -> DataFrame:
    """A row for each two steps whose values differ: date, metric, symbol, dataset, steps, before, after, difference."""
    steps = [("value_db", "value_analysis"), ("value_analysis", "value_final"), ("value_db", "value_final")]
    pairs = [F.when(differs(a, b), F.struct(F.lit(f"{a} to {b}").alias("steps"), F.col(a).alias("before"), F.col(b).alias("after"), (F.col(b) - F.col(a)).alias("difference"))) for a, b in steps]
    return trace.where(~F.col("is_extended")).select("date", "metric", "symbol", "dataset", F.inline(F.array_compact(F.array(*pairs))))


def trace_stats(trace: DataFrame) -> dict[str, int]:
    row = trace.agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(F.col("value_db").isNull()).alias("missing_db"),
        F.count_if(F.col("value_analysis").isNull() & ~F.col("is_extended")).alias("missing_analysis"),
        F.count_if(F.col("symbol").isNull()).alias("without_symbol"),
        F.count_if(F.col("error").isNotNull()).alias("errors"),
    ).first()
    return row.asDict() | {"discrepancies": discrepancies(trace).count()}
