"""The registered queries of the metrics engine, each with the SQL it must agree with.

Every query goes through the public API: sources, planner, trends, suites, contracts.
"""

from __future__ import annotations

import datetime as dt
import math
from collections.abc import Callable
from dataclasses import replace
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from probitas.contracts import Contract, OdcsContract
from probitas.functions import PREDICATES, coalesce, function, pct, sqrt
from probitas.functions.expr import Expr, Ref
from probitas.keys import ResultKey
from probitas.operators import metrics as M
from probitas.operators import trends
from probitas.operators.states import combined, state_columns
from probitas.plans import profiles as P
from probitas.plans.config import parse
from probitas.plans.planner import Planner
from probitas.plans.suite import VerificationSuite, check
from probitas.plans.tunables import TunableChoice, TunableFloat, TunableInt
from probitas.reports.trace import discrepancy_details, trace_join
from probitas.sources import CachedStore, FrameSource, MemoryStore, ParquetStore, StoredMetric
from probitas.sources.scratch import scratch_folder
from probitas.sources.store import latest
from probitas.streaming import StateTable

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}
_day = dt.date.fromisoformat
DAY = _day("2024-01-20")


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def _register(sql: str | None = None):
    def decorate(function: Query) -> Query:
        QUERIES[function.__name__] = function
        if sql:
            ORACLE_SQL[function.__name__] = sql
        return function

    return decorate


def _rounded(frame: DataFrame, digits: int = 4) -> DataFrame:
    """Doubles to some digits, and days as text, so that two engines' results can be compared as they print."""
    return frame.select(*(F.round(c, digits).alias(c) if t == "double" else F.col(c).cast("string").alias(c) if t == "date" else F.col(c) for c, t in frame.dtypes))


def _over_all(source: FrameSource, metrics: dict[str, M.Metric]) -> DataFrame:
    """One row with the metrics over all rows of a source without days."""
    return _rounded(Planner(source).table([DAY], metrics).drop("date"))


def _metric_query(name: str, table: str, metrics: dict[str, M.Metric], sql: str, prepare: Callable[[DataFrame], DataFrame] = lambda df: df) -> None:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _over_all(FrameSource(prepare(_read(spark, sf_dir, table)), table), metrics)

    query.__name__ = name
    columns = ", ".join(f"round(cast({x} as double), 4) as {n}" for n, x in zip(metrics, sql.split(";"), strict=True)) if ";" in sql or not sql.startswith("select") else None
    source = {"duplicate_with_nulls": "(select nullif(o_orderpriority, '5-LOW') as p, nullif(o_orderstatus, 'F') as s from orders)", "null_count": "(select nullif(o_orderpriority, '5-LOW') as p from orders)"}.get(name, table)
    _register(f"select {columns} from {source}" if columns else sql)(query)


_nulled = lambda df: df.select(F.nullif("o_orderpriority", F.lit("5-LOW")).alias("p"), F.nullif("o_orderstatus", F.lit("F")).alias("s"))

_metric_query("num_rows", "lineitem", {"n": M.num_rows()}, "count(*)")
_metric_query("average", "lineitem", {"avg_quantity": M.average("l_quantity"), "avg_revenue": M.average("l_extendedprice * (1 - l_discount)")}, "avg(l_quantity);avg(l_extendedprice * (1 - l_discount))")
_metric_query("minimum", "lineitem", {"min_price": M.minimum("l_extendedprice")}, "min(l_extendedprice)")
_metric_query("maximum", "lineitem", {"max_price": M.maximum("l_extendedprice")}, "max(l_extendedprice)")
_metric_query("sum", "lineitem", {"sum_quantity": M.total("l_quantity"), "sum_keys": M.total("l_orderkey")}, "sum(l_quantity);sum(l_orderkey)")
_metric_query("variance", "lineitem", {"var_quantity": M.variance("l_quantity")}, "var_samp(l_quantity)")
_metric_query("first_ordered", "events", {"first_value": M.first("value", "struct(ts, event_id)")}, "select round(cast(arg_min(value, {'a': ts, 'b': event_id}) as double), 4) as first_value from events")
_metric_query("null_count", "orders", {"nulls": M.null_count("p")}, "count(*) filter (where p is null)", _nulled)
_metric_query("negative_count", "customer", {"negatives": M.negative_count("c_acctbal")}, "count(*) filter (where c_acctbal < 0)")
_metric_query("unique_count", "lineitem", {"parts": M.unique_count("l_partkey"), "flags": M.unique_count("l_returnflag")}, "count(distinct l_partkey);count(distinct l_returnflag)")
_metric_query("duplicate_single", "lineitem", {"duplicates": M.duplicate_count(["l_orderkey"])}, "count(*) - count(distinct l_orderkey)")
_metric_query("duplicate_composite", "lineitem", {"duplicates": M.duplicate_count(["l_orderkey", "l_linenumber"])}, "count(*) - count(distinct (l_linenumber, l_orderkey))")
_metric_query("duplicate_with_nulls", "orders", {"one": M.duplicate_count(["p"]), "both": M.duplicate_count(["p", "s"])}, "count(*) - count(distinct p);count(*) - count(distinct (p, s))", _nulled)
_metric_query("count_values_str", "orders", {"urgent": M.count_values("o_orderpriority", "1-URGENT")}, "count(*) filter (where o_orderpriority = '1-URGENT')")
_metric_query("count_values_list", "orders", {"high": M.count_values("o_orderpriority", ["1-URGENT", "2-HIGH"])}, "count(*) filter (where o_orderpriority in ('1-URGENT', '2-HIGH'))")
_metric_query("count_values_int", "part", {"sizes": M.count_values("p_size", [1, 7, 20])}, "count(*) filter (where p_size in (1, 7, 20))")
_metric_query("count_values_bool", "labels", {"good": M.count_values("quality = 1", True)}, "count(*) filter (where quality = 1)")
_metric_query("length_string", "documents", {"shortest": M.min_length("text"), "longest": M.max_length("text"), "mean": M.average_length("text")}, "min(length(text));max(length(text));avg(length(text))")
_metric_query(
    "length_list",
    "embeddings",
    {"shortest": M.min_length("slice(embedding, 1, 1 + label)", "list"), "longest": M.max_length("slice(embedding, 1, 1 + label)", "list")},
    "min(len(embedding[1:1 + label]));max(len(embedding[1:1 + label]))",
)
_metric_query(
    "length_map",
    "events",
    {"shortest": M.min_length("from_json(props, 'map<string,int>')", "map"), "longest": M.max_length("from_json(props, 'map<string,int>')", "map")},
    "min(len(json_keys(props)));max(len(json_keys(props)))",
)
_metric_query("max_length_empty", "documents", {"longest": M.max_length("text")}, "select '-inf'::double as longest", lambda df: df.where("n_chars < 0"))
_metric_query("custom_sql_ratio", "lineitem", {"share": M.custom_sql("sum(l_extendedprice * (1 - l_discount)) / sum(l_extendedprice)")}, "sum(l_extendedprice * (1 - l_discount)) / sum(l_extendedprice)")
_metric_query("percentile", "lineitem", {"p50": M.percentile("l_extendedprice", 0.5), "p95": M.percentile("l_extendedprice", 0.95)}, "quantile_cont(l_extendedprice, 0.5);quantile_cont(l_extendedprice, 0.95)")
_metric_query("pattern", "pages", {"pages": M.matching_count("url", "^https://[^/]+/en/[0-9]+$")}, "count(*) filter (where regexp_matches(url, '^https://[^/]+/en/[0-9]+$'))")


@_register(
    """select round(cast(count(*) filter (where o_orderpriority = '1-URGENT') as double), 4) as urgent_rows,
       round(sum(o_totalprice) filter (where o_orderpriority = '1-URGENT'), 4) as urgent_price,
       round(cast(count(distinct o_custkey) filter (where o_totalprice >= 100000) as double), 4) as big_customers,
       round(sum(o_totalprice) / count(*), 4) as mean_price,
       round(sum(o_totalprice) filter (where o_totalprice >= 100000) / count(*) filter (where o_totalprice >= 100000), 4) as big_mean from orders"""
)
def parameter_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics with different parameters: all but the opaque expression share the scan."""
    filters = {"priority": lambda v: F.col("o_orderpriority") == v, "least": lambda v: F.col("o_totalprice") >= v}
    source = FrameSource(_read(spark, sf_dir, "orders"), "orders", parameter_filters=filters)
    return _over_all(
        source,
        {
            "urgent_rows": M.num_rows().with_parameters({"priority": "1-URGENT"}),
            "urgent_price": M.total("o_totalprice").with_parameters({"priority": "1-URGENT"}),
            "big_customers": M.unique_count("o_custkey").with_parameters({"least": 100000}),
            "mean_price": M.custom_sql("sum(o_totalprice) / count(*)"),
            "big_mean": M.custom_sql("sum(o_totalprice) / count(*)").with_parameters({"least": 100000}),
        },
    )


def _events(spark: SparkSession, sf_dir: str, **kw) -> FrameSource:
    return FrameSource(_read(spark, sf_dir, "events"), "events", date_col="ts", **kw)


def _days(first: dt.date, last: dt.date) -> list[dt.date]:
    return [first + dt.timedelta(days=k) for k in range((last - first).days + 1)]


JANUARY = _days(_day("2024-01-01"), _day("2024-01-30"))
_DAILY = "select cast(ts as date) as date, sum(value) as v from events group by 1"


@_register(
    """select cast(cast(ts as date) as varchar) as date, round(cast(count(*) as double), 6) as n, round(sum(value), 6) as total, round(avg(value), 11) as mean,
       round(cast(count(distinct user_id) as double), 6) as users, round(var_samp(value), 6) as spread from events group by cast(ts as date)"""
)
def daily_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five metrics for thirty days in one aggregation."""
    metrics = {"n": M.num_rows(), "total": M.total("value"), "mean": M.average("value"), "users": M.unique_count("user_id"), "spread": M.variance("value")}
    daily = Planner(_events(spark, sf_dir)).table(JANUARY, metrics)
    # means of few values with two digits are often half-way between two shorter numbers
    return daily.select(F.col("date").cast("string").alias("date"), *(F.round(n, 11 if n == "mean" else 6).alias(n) for n in metrics))


@_register(
    """select cast(cast(d.day as date) as varchar) as date, cast(count(e.event_id) as double) as n, round(sum(e.value), 4) as total,
       cast(coalesce(max(length(e.event_type)), '-inf'::double) as double) as longest
       from range(date '2024-01-27', date '2024-02-03', interval 1 day) d(day) left join events e on cast(e.ts as date) = d.day group by 1"""
)
def daily_with_missing_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days without rows have a row: counts are 0, the longest length -inf, the rest null."""
    metrics = {"n": M.num_rows(), "total": M.total("value"), "longest": M.max_length("event_type")}
    return _rounded(Planner(_events(spark, sf_dir)).table(_days(_day("2024-01-27"), _day("2024-02-02")), metrics))


def _daily_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Planner(_events(spark, sf_dir)).table(JANUARY, {"v": M.total("value")})


@_register(f"with d as ({_DAILY}) select cast(a.date as varchar) as date, round(abs((a.v - b.v) / nullif(b.v, 0)), 4) as day_over_day from d a left join d b on b.date = a.date - 1")
def day_over_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(trends.with_day_over_day(_daily_sum(spark, sf_dir), "v").drop("v"))


@_register(f"with d as ({_DAILY}) select cast(a.date as varchar) as date, round(abs((a.v - b.v) / nullif(b.v, 0)), 4) as week_over_week from d a left join d b on b.date = a.date - 7")
def week_over_week(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(trends.with_week_over_week(_daily_sum(spark, sf_dir), "v").drop("v"))


@_register(
    f"""with d as ({_DAILY}) select cast(a.date as varchar) as date, round(case when count(b.v) = 1 then 0.0 else stddev_samp(b.v) end, 3) as stddev
        from d a left join d b on b.date between a.date - 7 and a.date - 1 group by a.date"""
)
def stddev_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(trends.with_stddev(_daily_sum(spark, sf_dir), "v", offset=1, n=7).drop("v"), 3)


@_register(
    f"""with d as ({_DAILY}), c as (select a.date, abs((a.v - b.v) / nullif(b.v, 0)) as c from d a left join d b on b.date = a.date - 1)
        select cast(a.date as varchar) as date, round(case when count(b.c) = 1 then 0.0 else stddev_samp(b.c) end, 4) as stddev
        from c a left join c b on b.date between a.date - 4 and a.date group by a.date"""
)
def stddev_of_day_over_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    change = trends.with_day_over_day(_daily_sum(spark, sf_dir), "v")
    return _rounded(trends.with_stddev(change, "day_over_day", offset=0, n=5).select("date", "stddev"))


def _algebra(columns: dict[str, Expr]) -> Callable[[DataFrame], DataFrame]:
    return lambda frame: _rounded(frame.select(*(e.column({c: F.col(c) for c in frame.columns}).alias(n) for n, e in columns.items())))


@_register(
    """select round(abs(sum(l_tax) / sum(l_discount) - 1), 4) as distance, round(sqrt(var_samp(l_quantity)), 4) as deviation,
       round(-((max(l_quantity) - min(l_quantity)) ** 2) / 2, 4) as spread, round(least(avg(l_tax), avg(l_discount)), 4) as smaller,
       round(ln(count(*)) + exp(avg(l_tax)), 4) as logs, 0.0::double as nothing from lineitem"""
)
def expression_algebra(spark: SparkSession, sf_dir: str) -> DataFrame:
    source = FrameSource(_read(spark, sf_dir, "lineitem"), "lineitem")
    from probitas.functions import exp, log, minimum_of

    frame = Planner(source).table(
        [DAY],
        {
            "tax": M.total("l_tax"), "discount": M.total("l_discount"), "var": M.variance("l_quantity"), "high": M.maximum("l_quantity"), "low": M.minimum("l_quantity"),
            "mean_tax": M.average("l_tax"), "mean_discount": M.average("l_discount"), "n": M.num_rows(), "none": M.count_values("l_returnflag", "?"),
        },
    )
    r = Ref
    return _algebra(
        {
            "distance": abs(r("tax") / r("discount") - 1),
            "deviation": sqrt(r("var")),
            "spread": -((r("high") - r("low")) ** 2) / 2,
            "smaller": minimum_of(r("mean_tax"), r("mean_discount")),
            "logs": log(r("n")) + exp(r("mean_tax")),
            "nothing": r("none") / r("none"),
        }
    )(frame)


@_register(
    """select cast(cast(d.day as date) as varchar) as date, round(coalesce(sum(e.value), -1.0), 4) as total
       from range(date '2024-01-28', date '2024-02-02', interval 1 day) d(day) left join events e on cast(e.ts as date) = d.day group by 1"""
)
def coalesce_expression(spark: SparkSession, sf_dir: str) -> DataFrame:
    frame = Planner(_events(spark, sf_dir)).table(_days(_day("2024-01-28"), _day("2024-02-01")), {"v": M.total("value")})
    return _rounded(frame.select("date", coalesce(Ref("v"), -1.0).column({"v": F.col("v")}).alias("total")))


_PREDICATE_SQL = {
    "is_geq": "v > 25 - 1e-9", "is_gt": "v > 25 + 1e-9", "is_leq": "v < 25 + 1e-9", "is_lt": "v < 25 - 1e-9", "is_eq": "abs(v - 25) < 1e-9", "is_neq": "abs(v - 25) >= 1e-9",
    "is_between": "v > 10 - 1e-9 and v < 20 + 1e-9", "is_not_between": "v < 10 - 1e-9 or v > 20 + 1e-9", "is_zero": "abs(v) < 1e-9", "is_positive": "v > 1e-9", "is_negative": "v < -1e-9",
}


@_register("select " + ", ".join(f"count(*) filter (where {c}) as {n}" for n, c in _PREDICATE_SQL.items()) + " from (select l_quantity as v from lineitem)")
def predicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All eleven comparisons as columns."""
    bounds = {"is_between": (10, 20), "is_not_between": (10, 20), "is_zero": (), "is_positive": (), "is_negative": ()}
    v = F.col("l_quantity")
    return _read(spark, sf_dir, "lineitem").agg(*(F.count_if(f(v, *bounds.get(n, (25,)))).alias(n) for n, f in PREDICATES.items()))


def _results(suite: VerificationSuite, spark: SparkSession) -> DataFrame:
    return _rounded(suite.results_frame(spark).select("check", "assertion", "severity", "status", "value"))


def _row(check_: str, assertion: str, severity: str, status: str, value: str, source: str) -> str:
    return f"select '{check_}' as \"check\", '{assertion}' as assertion, '{severity}' as severity, {status} as status, round(cast({value} as double), 4) as value from {source}"


@_register(
    " union all ".join(
        [
            _row("Prices", "positive", "P0", "case when sum(l_extendedprice) > 0 then 'PASSED' else 'FAILED' end", "sum(l_extendedprice)", "lineitem"),
            _row("Prices", "discount", "P1", "case when avg(l_discount) between 0.04 and 0.06 then 'PASSED' else 'FAILED' end", "avg(l_discount)", "lineitem"),
            _row("Prices", "too few", "P2", "case when count(*) < 10 then 'PASSED' else 'FAILED' end", "count(*)", "lineitem"),
            _row("Orders", "lines per order", "P1", "case when 4.0 - 1.0 < (select count(*) from lineitem) / count(*) then 'PASSED' else 'FAILED' end", "(select count(*) from lineitem) / count(*)", "orders"),
            _row("Orders", "null rate", "P1", "'PASSED'", "count(*) filter (where o_orderstatus is null) / count(*)", "orders"),
            _row("Orders", "recorded", "P3", "'PASSED'", "max(o_totalprice)", "orders"),
        ]
    )
)
def assertion_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A suite over two datasets, with a tunable bound and a cross-dataset expression."""
    least = TunableFloat("LINES", 4.0, bounds=(1.0, 8.0))

    @check(name="Prices", datasets=["lineitem"])
    def prices(mp, ctx):
        ctx.assert_that(mp.sum("l_extendedprice")).config(name="positive", severity="P0").is_positive()
        ctx.assert_that(mp.average("l_discount")).config(name="discount").is_between(0.04, 0.06)
        ctx.assert_that(mp.num_rows()).config(name="too few", severity="P2").is_lt(10)

    @check(name="Orders", datasets=["lineitem", "orders"])
    def orders(mp, ctx):
        ratio = mp.num_rows(dataset="lineitem") / mp.num_rows(dataset="orders")
        ctx.assert_that(ratio).config(name="lines per order").is_gt(least - 1.0)
        ctx.assert_that(mp.null_rate("o_orderstatus", dataset="orders")).config(name="null rate").is_leq(0.05)
        ctx.assert_that(mp.maximum("o_totalprice", dataset="orders")).config(name="recorded", severity="P3").noop()

    suite = VerificationSuite([prices, orders], MemoryStore(), "Assertion results")
    suite.run([FrameSource(_read(spark, sf_dir, t), t) for t in ("lineitem", "orders")], ResultKey(DAY))
    return _results(suite, spark)


_DAILY_AT = lambda f, back: f"(select {f} from events where cast(ts as date) = date '{DAY}' - {back})"


@_register(
    " union all ".join(
        [
            _row("Trends", "ratio to yesterday", "P1", "'PASSED'", f"{_DAILY_AT('sum(value)', 0)} / {_DAILY_AT('sum(value)', 1)}", "(select 1)"),
            _row("Trends", "excluded", "P1", "'SKIPPED'", "null", "(select 1)"),
            _row("Trends", "week", "P0", "'PASSED'", f"abs(({_DAILY_AT('avg(value)', 0)} - {_DAILY_AT('avg(value)', 7)}) / {_DAILY_AT('avg(value)', 7)})", "(select 1)"),
        ]
    )
)
def date_exclusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lags and trends; an assertion over a day that isn't available is skipped."""

    @check(name="Trends")
    def of(mp, ctx):
        ctx.assert_that(mp.sum("value") / mp.sum("value", lag=1)).config(name="ratio to yesterday").is_gt(0)
        ctx.assert_that(mp.ext.day_over_day(mp.sum("value", lag=2))).config(name="excluded").is_leq(10)
        ctx.assert_that(mp.ext.week_over_week(mp.average("value"))).config(name="week", severity="P0").is_leq(100)

    suite = VerificationSuite([of], MemoryStore(), "Exclusion", data_av_threshold=0.8)
    suite.run([_events(spark, sf_dir, skip_dates={DAY - dt.timedelta(days=3)})], ResultKey(DAY))
    return _results(suite, spark)


@_register(
    " union all ".join(
        [
            _row("Volume", "doubled", "P3", f"case when 2 * {_DAILY_AT('count(*)', 0)} > 1.5 * {_DAILY_AT('count(*)', 1)} then 'PASSED' else 'FAILED' end", f"{_DAILY_AT('count(*)', 0)}", "(select 1)"),
            _row("Off", "any", "P1", "'SKIPPED'", "null", "(select 1)"),
        ]
    )
)
def profile_scaled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A profile doubles a metric before its test, lowers its severity, and disables a check; the reported value stays."""

    @check(name="Volume")
    def volume(mp, ctx):
        ctx.assert_that(mp.num_rows()).config(name="doubled", tags={"volume"}).is_gt(1.5 * before)

    @check(name="Off")
    def off(mp, ctx):
        ctx.assert_that(mp.num_rows()).config(name="any").is_positive()

    source = _events(spark, sf_dir)
    yesterday = DAY - dt.timedelta(days=1)
    before = Planner(source).run([(yesterday, M.num_rows())])[yesterday, M.num_rows()].value
    rules = [P.tag("volume").set(metric_multiplier=2.0, severity="P3"), P.check("Off").disable()]
    suite = VerificationSuite([volume, off], MemoryStore(), "Profiles", profiles=[P.SeasonalProfile("January", _day("2024-01-01"), _day("2024-01-31"), rules)])
    suite.run([source], ResultKey(DAY))
    return _results(suite, spark)


_CONTRACT = """
name: events
version: "1"
description: all check types
owner: data
dataset: events
metadata: {partitioned_by: [ts]}
sla: {schedule: "0 6 * * *", lag_hours: 2}
checks:
  - {type: num_rows, name: rows, min: 1}
  - {type: duplicates, name: keys, columns: [event_id, user_id], max: 0}
  - {type: freshness, name: fresh, timestamp_column: ts, max_age_hours: 48}
  - {type: completeness, name: complete, partition_column: ts, granularity: daily, lookback_days: 35, allow_future_gaps: false, max_gap_count: 5}
columns:
  - {name: event_id, type: int, checks: [{type: duplicates, name: id_twice, max: 0}, {type: count, name: id_count, min: 1}]}
  - name: user_id
    type: int
    checks: [{type: cardinality, name: users, between: [1, 1000000]}, {type: whitelist, name: some_users, values: [1, 2, 3, 4, 5]}]
  - name: event_type
    type: string
    checks:
      - {type: missing, name: type_missing, return: pct, equals: 0}
      - {type: whitelist, name: type_known, values: [CLICK, view], case_sensitive: false}
      - {type: blacklist, name: type_banned, values: [click], return: pct, min: 0.5}
      - {type: pattern, name: type_shape, pattern: "^[A-Z]+$", flags: [IGNORECASE]}
      - {type: min_length, name: type_short, min: 1}
      - {type: max_length, name: type_long, max: 50}
      - {type: avg_length, name: type_mean, between: [1, 50]}
  - name: value
    type: float
    checks:
      - {type: min, name: value_min}
      - {type: max, name: value_max}
      - {type: mean, name: value_mean}
      - {type: sum, name: value_sum}
      - {type: variance, name: value_variance}
      - {type: stddev, name: value_stddev}
      - {type: percentile, name: value_p90, percentile: 0.9}
  - {name: ts, type: timestamp}
"""
_E = "events"
_AGE = "(epoch(timestamp '2024-01-31 12:00:00') - epoch(max(ts))) / 3600"
_CONTRACT_ROWS = [
    ("rows [min >= 1.0]", "'PASSED'", "count(*)"),
    ("keys [max <= 0.0]", "'PASSED'", "count(*) - count(distinct (event_id, user_id))"),
    ("fresh [max <= 48.0]", f"case when {_AGE} <= 48 then 'PASSED' else 'FAILED' end", _AGE),
    ("complete [max <= 5.0]", "'PASSED'", "35 - count(distinct cast(ts as date)) filter (where cast(ts as date) between date '2023-12-28' and date '2024-01-31')"),
    ("id_twice [max <= 0.0]", "'PASSED'", "count(*) - count(distinct event_id)"),
    ("id_count [min >= 1.0]", "'PASSED'", "count(event_id)"),
    ("users [between [1.0, 1000000.0]]", "'PASSED'", "count(distinct user_id)"),
    ("some_users", "'PASSED'", "count(*) filter (where user_id in (1, 2, 3, 4, 5))"),
    ("type_missing [equals = 0.0]", "'PASSED'", "count(*) filter (where event_type is null) / count(*)"),
    ("type_known", "'PASSED'", "count(*) filter (where lower(event_type) in ('click', 'view'))"),
    ("type_banned [min >= 0.5]", "case when count(*) filter (where event_type <> 'click') / count(*) >= 0.5 then 'PASSED' else 'FAILED' end", "count(*) filter (where event_type <> 'click') / count(*)"),
    ("type_shape", "'PASSED'", "count(*) filter (where regexp_matches(event_type, '^[A-Za-z]+$'))"),
    ("type_short [min >= 1.0]", "'PASSED'", "min(length(event_type))"),
    ("type_long [max <= 50.0]", "'PASSED'", "max(length(event_type))"),
    ("type_mean [between [1.0, 50.0]]", "'PASSED'", "avg(length(event_type))"),
    ("value_min", "'PASSED'", "min(value)"),
    ("value_max", "'PASSED'", "max(value)"),
    ("value_mean", "'PASSED'", "avg(value)"),
    ("value_sum", "'PASSED'", "sum(value)"),
    ("value_variance", "'PASSED'", "var_samp(value)"),
    ("value_stddev", "'PASSED'", "stddev_samp(value)"),
    ("value_p90", "'PASSED'", "quantile_cont(value, 0.9)"),
    ("SLA: Freshness check [max <= 27.0]", f"case when {_AGE} <= 27 then 'PASSED' else 'FAILED' end", _AGE),
]


@_register(" union all ".join(_row("events", n, "P0" if n.startswith("SLA") else "P1", s, v, _E) for n, s, v in _CONTRACT_ROWS))
def contract_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All 21 check types of a YAML contract, its schema and its service level, in one suite."""
    source = FrameSource(_read(spark, sf_dir, "events"), "events")
    now = dt.datetime(2024, 1, 31, 12, tzinfo=dt.UTC)
    checks = Contract.parse(_CONTRACT).to_checks(source, now=now, day=now.date())
    suite = VerificationSuite(checks, MemoryStore(), "Contract")
    suite.run([source], ResultKey(DAY))
    return _results(suite, spark)


@_register(
    """with gaps as (select cast(d as timestamp) as p from range(timestamp '2024-01-10', timestamp '2024-01-13', interval 1 hour) r(d))
       select cast(count(*) as double) as gaps from gaps where p not in (select date_trunc('hour', ts) from events where hour(ts) <> 7)"""
)
def completeness_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hours without rows, on data that lacks an hour of each day."""
    source = FrameSource(_read(spark, sf_dir, "events").where(F.hour("ts") != 7), "events")
    return _over_all(source, {"gaps": M.gap_count("ts", "hour", dt.datetime(2024, 1, 10), dt.datetime(2024, 1, 12, 23))})


_ODCS = """
version: 1.0.0
apiVersion: v3.1.0
kind: DataContract
id: orders-contract
status: active
schema:
  - name: orders
    properties:
      - {name: o_orderkey, logicalType: integer, required: true, quality: [{name: unique, metric: duplicateValues, mustBe: 0, severity: error}]}
      - name: o_orderstatus
        logicalType: string
        quality:
          - {name: nulls, metric: nullValues, unit: percent, mustBeLessThan: 0.1}
          - {name: invalid, metric: invalidValues, validValues: [O, F], mustBe: 0}
          - {name: sentinel, metric: missingValues, arguments: {missingValues: [P]}, mustBeGreaterThan: 0}
          - {name: described, type: text, description: the state of the order}
      - name: o_orderpriority
        logicalType: string
        quality:
          - {name: outside, type: custom, engine: probitas, mustBeGreaterOrEqualTo: 1, implementation: {check: whitelist, column: o_orderpriority, values: [1-URGENT]}}
          - {name: inside, type: custom, engine: probitas, mustBeBetween: [0, 1], implementation: {check: blacklist, column: o_orderpriority, values: [1-URGENT], return: pct}}
    quality:
      - {name: volume, metric: rowCount, mustBeGreaterOrEqualTo: 100}
      - {name: composite, metric: duplicateValues, arguments: {properties: [o_orderkey, o_custkey]}, mustBe: 0}
"""
_O = "orders"


@_register(
    " union all ".join(
        _row(_O, n, sev, s, v, _O)
        for n, sev, s, v in [
            ("unique", "P0", "'PASSED'", "count(*) - count(distinct o_orderkey)"),
            ("nulls", "P1", "'PASSED'", "count(*) filter (where o_orderstatus is null) / count(*)"),
            ("invalid", "P1", "case when count(*) filter (where o_orderstatus in ('O', 'F')) = count(*) then 'PASSED' else 'FAILED' end", "count(*) - count(*) filter (where o_orderstatus in ('O', 'F'))"),
            ("sentinel", "P1", "case when count(*) filter (where o_orderstatus = 'P') > 0 then 'PASSED' else 'FAILED' end", "count(*) filter (where o_orderstatus = 'P')"),
            ("outside", "P1", "'PASSED'", "count(*) filter (where o_orderpriority <> '1-URGENT')"),
            ("inside", "P1", "'PASSED'", "count(*) filter (where o_orderpriority = '1-URGENT') / count(*)"),
            ("volume", "P1", "'PASSED'", "count(*)"),
            ("composite", "P1", "'PASSED'", "count(*) - count(distinct (o_custkey, o_orderkey))"),
            ("o_orderkey is required", "P0", "'PASSED'", "count(*) filter (where o_orderkey is null)"),
        ]
    )
)
def odcs_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Library and custom rules, operators and severities of an ODCS document."""
    source = FrameSource(_read(spark, sf_dir, "orders"), "orders")
    [contract] = OdcsContract.parse(_ODCS)
    suite = VerificationSuite(contract.to_checks(source), MemoryStore(), "ODCS")
    suite.run([source], ResultKey(DAY))
    return _results(suite, spark)


@_register(
    """with stored as (select date '2024-01-20' as date, 'm' || n_nationkey as metric, 'a' as dataset, cast(n_regionkey as double) as v from nation where n_regionkey <> 1),
       analysed as (select date '2024-01-20' as date, 'm' || n_nationkey as metric, 'a' as dataset, 'x_' || n_nationkey as symbol, cast(n_regionkey as double) as v from nation where n_regionkey <> 2),
       symbols as (select date '2024-01-20' as date, 'm' || n_nationkey as metric, 'a' as dataset, 'x_' || n_nationkey as symbol, cast(n_regionkey as double) as v from nation where n_regionkey <> 3)
       select cast(coalesce(m.date, a.date) as varchar) as date, coalesce(m.metric, a.metric) as metric, a.symbol, 'sum' as type, 'a' as dataset, m.v as value_db, a.v as value_analysis, s.v as value_final
       from stored m full join analysed a on m.metric = a.metric left join symbols s on s.symbol = a.symbol and s.metric = coalesce(m.metric, a.metric)"""
)
def metric_trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Store, analysis and symbols as one table."""
    nation = _read(spark, sf_dir, "nation").select(
        F.lit(DAY).alias("date"), F.concat(F.lit("m"), "n_nationkey").alias("metric"), F.concat(F.lit("x_"), "n_nationkey").alias("symbol"), F.lit("sum").alias("type"),
        F.lit("a").alias("dataset"), F.col("n_regionkey").cast("double").alias("value"), F.lit(None).cast("string").alias("error"), F.lit("-").alias("tags"), F.lit(1.0).alias("data_av_ratio"), "n_regionkey",
    )
    parts = [nation.where(F.col("n_regionkey") != k) for k in (1, 2, 3)]  # each lacks a region
    return _rounded(trace_join(*parts)).select("date", "metric", "symbol", "type", "dataset", "value_db", "value_analysis", "value_final")


@_register("select o_custkey as dataset, max_by(o_totalprice, {'a': o_orderdate, 'b': cast(o_orderkey as varchar)}) as value from orders group by 1")
def latest_metric(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest of several stored values for each key."""
    rows = _read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("dataset"), F.col("o_totalprice").alias("value"), F.col("o_orderdate").alias("created"), F.col("o_orderkey").cast("string").alias("metric_id"))
    return latest(rows, "dataset").select("dataset", "value")


@_register(
    """select nullif(l_returnflag, 'R') as flag, round(cast(count(*) as double), 4) as n, round(avg(l_quantity), 4) as mean, round(var_samp(l_quantity), 4) as var,
       round(var_samp(l_quantity + 1e9), 4) as var_far, round(max(l_tax), 4) as high, round(min_by(l_extendedprice, {'a': l_shipdate, 'b': l_orderkey, 'c': l_linenumber}), 4) as opening
       from lineitem group by 1"""
)
def merged_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics from states of disjoint parts, here one for each ship month, merged as tables; with a null key and values far from zero."""
    metrics = {
        "n": M.num_rows(),
        "mean": M.average("l_quantity"),
        "var": M.variance("l_quantity"),
        "var_far": M.variance("l_quantity + 1e9D"),
        "high": M.maximum("l_tax"),
        "opening": M.first("l_extendedprice", "struct(l_shipdate, l_orderkey, l_linenumber)"),
    }
    rows = _read(spark, sf_dir, "lineitem").withColumn("flag", F.nullif("l_returnflag", F.lit("R")))
    parts = rows.groupBy("flag", F.date_trunc("month", "l_shipdate").alias("month")).agg(*state_columns(metrics))
    return _rounded(combined(parts, ["flag"], metrics))


@_register("select nullif(l_returnflag, 'R') as flag, cast(count(*) as double) as n, round(avg(l_quantity), 4) as mean, round(var_samp(l_quantity), 4) as spread, round(min(l_tax), 4) as low from lineitem group by 1")
def state_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Micro-batches, here of one year each, added to a table of states; the second is added twice, as after a failure."""
    rows = _read(spark, sf_dir, "lineitem").withColumn("flag", F.nullif("l_returnflag", F.lit("R")))
    table = StateTable(spark, scratch_folder(spark), [M.num_rows(), M.average("l_quantity"), M.variance("l_quantity"), M.minimum("l_tax")], ["flag"])
    years = sorted(r[0] for r in rows.select(F.year("l_shipdate")).distinct().collect())
    for k, year in [*enumerate(years), (1, years[1])]:
        table.add(rows.where(F.year("l_shipdate") == year), k)
    return _rounded(table.frame().toDF("flag", "n", "mean", "spread", "low"))


@_register("select cast(cast(ts as date) as varchar) as date, 'sum(value)' as name, round(sum(value), 4) as value from events where cast(ts as date) between date '2024-01-11' and date '2024-01-18' group by 1 union all select cast(cast(ts as date) as varchar), 'num_rows()', count(*) from events where cast(ts as date) between date '2024-01-17' and date '2024-01-20' group by 1")
def store_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics of ten days written to a store of files, some deleted again, and read as a window of days."""
    store = ParquetStore(spark, scratch_folder(spark))
    source, days = _events(spark, sf_dir), _days(DAY - dt.timedelta(days=9), DAY)
    values = Planner(source).run([(d, m) for d in days for m in (M.total("value"), M.num_rows())])
    rows = [StoredMetric(m.kind, m.name, "events", v.value, d, tags={"env": "test"}) for (d, m), v in values.items()]
    store.persist([replace(r, metric_id=f"old {r.metric_id}", value=-1.0, created=r.created - dt.timedelta(days=1)) for r in rows])
    store.persist(rows)
    for r in rows:
        if r.metric_type == "num_rows" and r.yyyy_mm_dd == days[0]:
            store.delete(r.metric_id)
    window = store.get_metric_window("sum(value)", "events", days[0], days[7], tags={"env": "test"})
    counts = store.get_metric_window("num_rows()", "events", days[6], DAY, tags={"env": "test"})
    found = spark.createDataFrame([(d, r.name, r.value) for own in (window, counts) for d, r in own.items()], "date date, name string, value double")
    return _rounded(found)


@_register("select cast(count(*) as double) as total, cast(count(*) filter (where o_orderdate + interval 7 day < timestamp '1996-01-01') as double) as expired from orders")
def store_expiry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What of a store is older than its time to live."""
    orders = _read(spark, sf_dir, "orders")
    written = orders.select(
        F.col("o_orderkey").cast("string").alias("metric_id"), F.lit("sum").alias("metric_type"), F.lit("sum(x)").alias("name"), F.lit("{}").alias("parameters"), F.lit("orders").alias("dataset"),
        F.lit("{}").alias("state"), F.col("o_totalprice").cast("double").alias("value"), F.lit(DAY).alias("yyyy_mm_dd"), F.expr("map('env', 'test')").alias("tags"), F.lit("run").alias("execution_id"),
        F.lit(168).alias("ttl_hours"), F.col("o_orderdate").cast("timestamp").alias("created"),
    )
    folder = scratch_folder(spark)
    written.write.partitionBy("yyyy_mm_dd").parquet(f"{folder}/metrics")
    stats = ParquetStore(spark, folder).stats(dt.datetime(1996, 1, 1))
    return spark.createDataFrame([(float(stats.total), float(stats.expired))], "total double, expired double")


@_register(
    " union all ".join(
        _row("History", name, "P1", "'PASSED'", value, "(select 1)")
        for name, value in (("today", _DAILY_AT("sum(value)", 0)), ("yesterday", "1.0"), ("change", f"abs(({_DAILY_AT('sum(value)', 0)} - 1.0) / 1.0)"))
    )
)
def stored_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A suite that takes earlier days from the store, behind a write-back cache; the stored value is another than that of the rows."""

    @check(name="History")
    def of(mp, ctx):
        ctx.assert_that(mp.sum("value")).config(name="today").noop()
        ctx.assert_that(mp.sum("value", lag=1)).config(name="yesterday").noop()
        ctx.assert_that(mp.ext.day_over_day(mp.sum("value"))).config(name="change").noop()

    store = MemoryStore()
    store.persist([StoredMetric("sum", "sum(value)", "events", 1.0, DAY - dt.timedelta(days=1))])
    with CachedStore(store) as cache:
        suite = VerificationSuite([of], cache, "History", reuse_history=True)
        suite.run([_events(spark, sf_dir)], ResultKey(DAY))
    return _results(suite, spark)


@_register(
    " union all ".join(
        [
            _row("Tuned", "share", "P1", "case when count(*) filter (where o_orderstatus = 'F') / count(*) > 0.3 then 'PASSED' else 'FAILED' end", "count(*) filter (where o_orderstatus = 'F') / count(*)", "orders"),
            _row("Tuned", "priority", "P1", "'PASSED'", "count(*) filter (where o_orderpriority = '2-HIGH')", "orders"),
            _row("Tuned", "limit", "P1", "'FAILED'", "count(*)", "orders"),
        ]
    )
)
def tunables_in_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tunables of three types, set from YAML and by hand between two runs of a suite."""
    share, priority, most = TunableFloat("SHARE", 0.9, bounds=(0.0, 1.0)), TunableChoice("PRIORITY", "1-URGENT", choices=("1-URGENT", "2-HIGH")), TunableInt("MOST", 10**9, bounds=(1, 10**12))

    @check(name="Tuned")
    def of(mp, ctx):
        ctx.assert_that(mp.count_values("o_orderstatus", "F") / mp.num_rows()).config(name="share").is_gt(share)
        ctx.assert_that(mp.count_values("o_orderpriority", priority.value)).config(name="priority").is_geq(0)
        ctx.assert_that(mp.num_rows()).config(name="limit").is_leq(most)

    suite = VerificationSuite([of], MemoryStore(), "Tuned", config=parse("tunables: {SHARE: 0.5, MOST: 10}"))
    source = FrameSource(_read(spark, sf_dir, "orders"), "orders")
    suite.run([source], ResultKey(DAY))
    suite.set_param("SHARE", 0.3, agent="query", reason="second run")
    priority.set("2-HIGH")
    suite.reset()
    suite.run([source], ResultKey(DAY))
    return _results(suite, spark)


@_register(
    " union all ".join(
        [
            _row("One", "own dataset", "P1", "'PASSED'", "count(*)", "nation"),
            _row("Two", "named", "P1", "'PASSED'", "(select count(*) from nation) - count(*)", "region"),
            _row("Two", "critical", "P0", "'FAILED'", "count(*)", "region"),
            _row("Two", "missing", "P1", "'FAILED'", "null", "(select 1)"),
        ]
    )
)
def imputed_datasets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics get the dataset of their check where they name none; a metric without a value fails only its own assertion."""

    @check(name="One", datasets=["nation"])
    def one(mp, ctx):
        ctx.assert_that(mp.num_rows()).config(name="own dataset").is_positive()

    @check(name="Two", datasets=["nation", "region"])
    def two(mp, ctx):
        ctx.assert_that(mp.num_rows(dataset="nation") - mp.num_rows(dataset="region")).config(name="named").is_gt(0)
        ctx.assert_that(mp.num_rows(dataset="region")).config(name="critical", severity="P0").is_zero()
        ctx.assert_that(mp.average("nullif(r_regionkey, r_regionkey)", dataset="region")).config(name="missing").is_zero()

    suite = VerificationSuite([one, two], MemoryStore(), "Imputed")
    suite.run([FrameSource(_read(spark, sf_dir, t), t) for t in ("nation", "region")], ResultKey(DAY))
    return _results(suite, spark) if suite.is_critical() else _results(suite, spark).limit(0)


@_register(
    " union all ".join(
        f"select '{kind}' as connector, cast(count(*) as double) as n, round(cast(sum(n_nationkey) as double), 4) as keys, cast(max(length(n_name)) as double) as longest from nation{where}"
        for kind, where in (("arrow", ""), ("csv", ""), ("json", ""), ("orc", ""), ("parquet", ""), ("function", " where n_regionkey <> 2"), ("union", ", range(2)"))
    )
)
def connectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same metrics of a table from memory, from files of four formats, from a function of the day, and from a union."""
    nation = _read(spark, sf_dir, "nation")
    sources = {"arrow": FrameSource.from_arrow(spark, nation.toArrow(), "nation"), "union": FrameSource(nation.unionByName(nation), "nation")}
    for kind in ("csv", "json", "orc", "parquet"):
        folder, options = scratch_folder(spark), {"header": "true"} if kind == "csv" else {}
        nation.write.format(kind).options(**options).save(folder)
        sources[kind] = FrameSource.from_path(spark, folder, "nation", kind, options)
    sources["function"] = FrameSource(lambda day, parameters: nation.where(F.col("n_regionkey") != parameters["but"]), "nation")
    tables = []
    for kind, source in sources.items():
        with_ = {"but": 2} if kind == "function" else {}
        metrics = {"n": M.num_rows(), "keys": M.total("n_nationkey"), "longest": M.max_length("n_name")}
        tables.append(Planner(source).table([DAY], {n: m.with_parameters(with_) for n, m in metrics.items()}).select(F.lit(kind).alias("connector"), "n", "keys", "longest"))
    return _rounded(reduce(DataFrame.unionByName, tables))


@_register("select round(avg(l_tax) * 0.05, 6) as five_percent, round(tanh(avg(l_discount)), 6) as bent, 1.0::double as yes, avg(l_tax) between 0 and 1 as near, round(count(*) / count(distinct l_orderkey), 6) as lines from lineitem")
def scalar_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Percentages, a function of the user's own, booleans as numbers, and a tolerant comparison."""
    frame = Planner(FrameSource(_read(spark, sf_dir, "lineitem"), "lineitem")).table([DAY], {"tax": M.average("l_tax"), "discount": M.average("l_discount"), "n": M.num_rows(), "orders": M.unique_count("l_orderkey")})
    columns = {c: F.col(c) for c in frame.columns}
    expressions = {"five_percent": Ref("tax") * pct(5), "bent": function("tanh", math.tanh, F.tanh)(Ref("discount")), "yes": Ref("n") * 0 + True, "lines": Ref("n") / Ref("orders")}
    near = F.abs(F.col("tax") - 0.5) < 0.5 + 1e-9
    return frame.select(*(F.round(e.column(columns), 6).alias(n) for n, e in expressions.items()), near.alias("near"))


@_register(
    """with steps as (select n_nationkey as k, cast(n_regionkey as double) as a, n_regionkey + (n_nationkey % 3) as b, n_regionkey + (n_nationkey % 2) as c from nation),
       pairs as (select k, 'value_db to value_analysis' as steps, a as before, b as after from steps union all select k, 'value_analysis to value_final', b, c from steps union all select k, 'value_db to value_final', a, c from steps)
       select 'm' || k as metric, steps, cast(before as double) as before, cast(after as double) as after, cast(after - before as double) as difference from pairs where before <> after"""
)
def trace_discrepancies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each two steps of the trace between which a value changed."""
    key, value = F.col("n_nationkey"), F.col("n_regionkey").cast("double")
    trace = _read(spark, sf_dir, "nation").select(
        F.lit(DAY).alias("date"), F.concat(F.lit("m"), key).alias("metric"), F.concat(F.lit("x_"), key).alias("symbol"), F.lit("nation").alias("dataset"), F.lit(False).alias("is_extended"),
        value.alias("value_db"), (value + key % 3).alias("value_analysis"), (value + key % 2).alias("value_final"),
    )
    return discrepancy_details(trace).select("metric", "steps", "before", "after", "difference")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assertion_results(spark, sf_dir)
