import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from probitas.keys import ProbitasError, ResultKey, valid_tags
from probitas.operators import metrics as M
from probitas.operators import states
from probitas.operators.selection import exact_percentiles
from probitas.plans.planner import Planner
from probitas.sources import FrameSource

D = dt.date(2024, 1, 10)


@pytest.fixture(scope="module")
def rows(spark):
    data = [(1, 10.0, "a", [1], {"k": 1}, True), (2, None, "bb", [], {}, False), (2, -5.0, None, None, None, None), (None, 0.0, "a\\b", [1, 2], {"x": 1, "y": 2}, True)]
    return FrameSource(spark.createDataFrame(data, "i int, x double, s string, l array<int>, m map<string,int>, b boolean"), "rows")


def value(source, metric, day=D):
    return Planner(source).run([(day, metric)])[day, metric]


CASES = [
    (M.num_rows(), 4.0), (M.average("x"), 5 / 3), (M.minimum("x"), -5.0), (M.maximum("x"), 10.0), (M.total("x"), 5.0), (M.variance("x"), 175 / 3), (M.total("b"), 2.0),
    (M.null_count("x"), 1.0), (M.negative_count("x"), 1.0), (M.unique_count("i"), 2.0), (M.duplicate_count(["i"]), 2.0), (M.count_values("s", "a\\b"), 1.0),
    (M.count_values("i", [2, 3]), 2.0), (M.count_values("b", True), 2.0), (M.min_length("s"), 1.0), (M.max_length("s"), 3.0), (M.min_length("l", "list"), 0.0), (M.max_length("m", "map"), 2.0),
    (M.custom_sql("sum(x) / count(*)"), 1.25), (M.first("x", "coalesce(i, 9)"), 10.0), (M.average("x * 2"), 10 / 3), (M.average_length("s"), 2.0), (M.percentile("x", 0.5), 0.0),
    (M.matching_count("s", "^A", ("IGNORECASE",)), 2.0),
]


@pytest.mark.parametrize("metric, expected", CASES, ids=lambda x: getattr(x, "name", x))
def test_values(rows, metric, expected):
    assert value(rows, metric).value == pytest.approx(expected)


def test_all_kinds_share_one_aggregation(rows):
    groups = Planner(rows).groups([m for m, _ in CASES])
    assert len(groups) == 1
    assert [len(m) for _, m in Planner(rows, max_distinct_per_job=1).groups([M.num_rows(), M.unique_count("i"), M.unique_count("s")])] == [1, 1, 1]


def test_empty_rows(spark, rows):
    none = FrameSource(rows.frame.where("false"), "none")
    assert value(none, M.num_rows()).value == 0 and value(none, M.unique_count("i")).value == 0
    assert value(none, M.max_length("s")).value == float("-inf")
    for m in (M.total("x"), M.average("x"), M.minimum("x"), M.min_length("s")):
        assert "Null value encountered" in str(value(none, m))


def test_special_values(spark):
    nan = FrameSource(spark.createDataFrame([(float("nan"),), (0.0,), (-0.0,)], "x double"), "nan")
    assert "NaN value encountered" in str(value(nan, M.average("x"))) and value(nan, M.unique_count("x")).value == 2
    big = FrameSource(spark.createDataFrame([(2**62,), (2**62,), (2**62,)], "x bigint"), "big")
    assert value(big, M.total("x")).value == float(3 * 2**62)
    pairs = FrameSource(spark.createDataFrame([(1, "a")] * 2 + [(1, None)] * 2 + [(None, None)] * 2, "a int, b string"), "pairs")
    assert value(pairs, M.duplicate_count(["a", "b"])).value == 3


def test_temporal_input_is_refused(spark):
    days = FrameSource(spark.createDataFrame([(D,)], "d date"), "days")
    for m in (M.minimum("d"), M.maximum("d"), M.first("d")):
        with pytest.raises(ProbitasError, match="date"):
            value(days, m)


def test_arguments_are_checked():
    for bad in ([], [1, "a"], [True], None, 1.5):
        with pytest.raises(ValueError):
            M.count_values("x", bad)
    with pytest.raises(ValueError):
        M.duplicate_count([])
    with pytest.raises(ValueError):
        M.min_length("x", "set")
    with pytest.raises(ProbitasError):
        M.register(M.Kind("sum", lambda m, w: F.lit(0)))
    assert M.duplicate_count(["b", "a"]) == M.duplicate_count(["a", "b"])
    assert M.total("x").with_parameters({"a": [1, 2]}) == M.total("x").with_parameters({"a": (1, 2)}) != M.total("x")
    with pytest.raises(ValueError):
        valid_tags(["a b"])
    assert len({ResultKey(D, {"a": "1"}), ResultKey(D, {"a": "2"})}) == 2


def test_days_and_parameters(spark):
    data = [(D - dt.timedelta(days=k % 3), k, "ab"[k % 2]) for k in range(12)]
    source = FrameSource(spark.createDataFrame(data, "d date, x int, c string"), "days", date_col="d", parameter_filters={"c": lambda v: F.col("c") == v})
    wanted = [(D - dt.timedelta(days=k), m.with_parameters(p)) for k in (0, 1, 5) for m in (M.num_rows(), M.total("x"), M.first("x", "x"), M.custom_sql("max(x) - min(x)")) for p in ({}, {"c": "a"})]
    got = Planner(source).run(wanted)
    for day, m in wanted:
        xs = [x for d, x, c in data if d == day and (not m.parameters or c == "a")]
        expected = {"num_rows": len(xs), "sum": sum(xs), "first": min(xs, default=None), "custom_sql": max(xs, default=0) - min(xs, default=0)}[m.kind]
        assert got[day, m].ok == bool(xs or m.kind == "num_rows") and (not got[day, m].ok or got[day, m].value == expected)
    with pytest.raises(ProbitasError, match="filter"):
        Planner(source).run([(D, M.num_rows().with_parameters({"z": 1}))])
    with pytest.raises(ProbitasError, match="date column"):
        Planner(FrameSource(source.frame, "static")).run([(D, M.num_rows()), (D - dt.timedelta(days=1), M.num_rows())])
    by_call = FrameSource(lambda day, p: source.frame.where(F.col("d") == F.lit(day)).where(F.col("c") == p.get("c", F.col("c"))), "call")
    assert {k: v for k, v in Planner(by_call).run(wanted).items() if v.ok} == {k: v for k, v in got.items() if v.ok}


def test_date_filter_reaches_the_scan(spark, tmp_path):
    spark.range(10).selectExpr("id", "timestamp_ntz'2024-01-01' + make_dt_interval(id) as ts", "id as other").write.parquet(f"{tmp_path}/t")
    source = FrameSource.from_path(spark, f"{tmp_path}/t", "t", date_col="ts")
    plan = Planner(source).frames([dt.date(2024, 1, 3)], [M.total("id")])[0][1]._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(ts,2024-01-03" in plan and "other" not in plan


def test_states_merge_to_the_whole(spark):
    xs = [float(x) for x in (3, 1, 4, 1, 5, 9, 2, 6, 5, 3, 5)]
    df = spark.createDataFrame([(k % 4, x if k != 6 else None) for k, x in enumerate(xs)], "p int, x double")
    whole = FrameSource(df, "whole")
    for m in (M.num_rows(), M.average("x"), M.variance("x"), M.minimum("x"), M.maximum("x"), M.total("x"), M.null_count("x"), M.first("x", "x * 7 % 11")):
        state = states.state_of(m)
        parts = [{k: r[k] for k in state.identity} for r in df.groupBy("p").agg(*(c.alias(n) for n, c in state.columns(m).items())).collect()]
        merged = states.merged(m, parts)
        assert state.value(merged) == pytest.approx(value(whole, m).value)
        assert state.merge(dict(state.identity), merged) == merged
    for m in (M.unique_count("x"), M.duplicate_count(["x"]), M.percentile("x", 0.5)):
        with pytest.raises(ProbitasError, match="Cannot merge"):
            states.state_of(m)


def test_variances_far_from_zero_and_null_keys(spark):
    for offset in (1e9, 1e12):
        df = spark.createDataFrame([(k % 3, [None, "a"][k // 7], offset + k % 7) for k in range(14)], "part int, g string, x double")
        metrics = {"v": M.variance("x"), "m": M.average("x"), "n": M.num_rows()}
        parts = df.groupBy("part", "g").agg(*states.state_columns(metrics))
        assert {r.g: (r.v, r.m, r.n) for r in states.combined(parts, ["g"], metrics).collect()} == {None: (pytest.approx(14 / 3, rel=1e-3), offset + 3, 7.0), "a": (pytest.approx(14 / 3, rel=1e-3), offset + 3, 7.0)}
        [row] = states.combined(parts, [], metrics).collect()
        assert row.n == 14 and row.v == pytest.approx(4.0 * 14 / 13, rel=1e-3)


def test_first_of_parts(spark):
    a, b, none = {"value": 1.0, "order": None}, {"value": 2.0, "order": None}, {"value": None, "order": None}
    assert states.merged(M.first("x"), [none, a, b]) == a
    early, late = {"value": 5.0, "order": 1}, {"value": 6.0, "order": 2}
    assert states.merged(M.first("x", "t"), [none, late, early]) == early
    df = spark.createDataFrame([(0, 3, 1.0), (1, 1, None), (1, 2, 4.0)], "p int, t int, x double")
    metrics = {"by_t": M.first("x", "t"), "any": M.first("x")}
    [row] = states.combined(df.groupBy("p").agg(*states.state_columns(metrics)), [], metrics).collect()
    assert row.by_t is None and row["any"] in (1.0, 4.0)


def test_states_beside_values():
    values = {M.variance("x"): 4.0, M.average("x"): 3.0, M.num_rows(): 10.0, M.null_count("x"): 3.0}
    assert states.stored(M.variance("x"), values.get) == {"n": 7.0, "mean": 3.0, "m2": 24.0}
    assert states.stored(M.average("x"), values.get) == {"n": 7.0, "mean": 3.0}
    assert states.stored(M.num_rows(), values.get) == {"value": 10.0} and states.stored(M.percentile("x", 0.1), {M.percentile("x", 0.1): 1.0}.get) is None


@pytest.mark.parametrize("unit, start, end, periods", [("week", dt.datetime(2024, 1, 10), dt.datetime(2024, 1, 16), 2), ("hour", dt.datetime(2024, 1, 1, 0, 30), dt.datetime(2024, 1, 1, 3, 10), 4), ("day", dt.datetime(2024, 1, 1, 12), dt.datetime(2024, 1, 3, 1), 3), ("month", dt.datetime(2024, 1, 31), dt.datetime(2024, 3, 1), 3)])
def test_gaps_over_no_rows_are_those_of_a_scan(spark, unit, start, end, periods):
    m = M.gap_count("t", unit, start, end)
    assert M.empty_value(m) == periods
    df = spark.createDataFrame([(D, dt.datetime(1999, 1, 1))], "d date, t timestamp_ntz")
    got = Planner(FrameSource(df, "s", date_col="d")).run([(D, m), (D - dt.timedelta(days=1), m)])
    assert {v.value for v in got.values()} == {float(periods)}


def test_percentiles_by_selection(spark):
    rnd = random.Random(9)
    shapes = {"wide": [rnd.gauss(0, 1e6) for _ in range(40_000)], "ties": [float(rnd.randrange(3)) for _ in range(30_000)], "one": [7.0], "two": [1.0, 2.0], "mostly": [0.0] * 20_000 + [rnd.random() for _ in range(5)], "none": [None] * 3, "odd": [float("inf"), 1.0, None, -0.0, 2.0]}
    rows = spark.createDataFrame([(g, x) for g, xs in shapes.items() for x in xs], "g string, x double").repartition(5)
    ps = (0.0, 0.01, 0.25, 0.5, 0.77, 0.9999, 1.0)
    wanted = {f"p{k}": (F.col("x"), p) for k, p in enumerate(ps)}
    got = {r.g: r[1:] for r in exact_percentiles(rows, "g", wanted).collect()}
    expected = {r.g: r[1:] for r in rows.groupBy("g").agg(*(F.percentile("x", F.lit(p)).alias(n) for n, (_, p) in wanted.items())).collect()}
    for g in shapes:
        assert g == "none" and g not in got or got[g] == pytest.approx(expected[g], rel=1e-12), g
    assert exact_percentiles(rows.where("g = 'wide'"), None, wanted).first()[:] == pytest.approx(expected["wide"], rel=1e-12)
    assert exact_percentiles(rows.limit(0), None, wanted).collect() == [(None,) * len(ps)]
    source = FrameSource(rows.where("g = 'ties'"), "s", parameter_filters={"least": lambda v: F.col("x") >= v})
    found = Planner(source).run([(D, M.percentile("x", 0.5).with_parameters({"least": 2})), (D, M.percentile("x", 0.5)), (D, M.num_rows())])
    assert [v.value for v in found.values()] == [2.0, 1.0, 30_000.0]


def test_distinct_counts_are_split_by_default(spark):
    df = spark.range(100).selectExpr("id % 2 as a", "id % 3 as b", "id % 5 as c", "id % 7 as e")
    groups = Planner(FrameSource(df, "s")).groups([M.unique_count(c) for c in "abce"])
    assert [len(m) for _, m in groups] == [2, 2]
