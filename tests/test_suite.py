import datetime as dt
import json
import math
import time

import pytest
from pyspark.sql import functions as F

from probitas.functions import PREDICATES, coalesce, exp, function, log, maximum_of, pct, sqrt, within_tol
from probitas.functions.expr import Ref
from probitas.keys import Err, Ok, ProbitasError, ResultKey, fail
from probitas.operators import trends
from probitas.plans import config, profiles
from probitas.plans.suite import VerificationSuite, check
from probitas.plans.tunables import TunableChoice, TunableFloat, TunableInt
from probitas.reports import plugins, tables, trace
from probitas.sources import FrameSource, MemoryStore

D = dt.date(2025, 1, 15)
KEY = ResultKey(D, {"env": "prod"})
day = lambda k: D - dt.timedelta(days=k)


@pytest.fixture(scope="module")
def sales(spark):
    """Thirty days with 10 rows each; the tax of a day is 10 + its number of days back."""
    rows = [(day(k), k * 10 + j, 10.0 + k, j % 3, "ab"[j % 2]) for k in range(30) for j in range(10)]
    df = spark.createDataFrame(rows, "d date, id int, tax double, n int, c string")
    return lambda **kw: FrameSource(df, kw.pop("name", "ds1"), date_col="d", parameter_filters={"c": lambda v: F.col("c") == v}, **kw)


def run(sources, *bodies, **kw):
    checks = [check(name=f"c{k}", datasets=None)(b) for k, b in enumerate(bodies)]
    suite = VerificationSuite(checks, kw.pop("db", MemoryStore()), "suite", **kw)
    suite.run(sources, KEY)
    return suite


def statuses(suite):
    return {r.assertion: r.status for r in suite.collect_results()}


@pytest.mark.parametrize(
    "name, args, passing, failing",
    [
        ("is_geq", (5,), 5, 4.9), ("is_gt", (5,), 5.1, 5), ("is_leq", (5,), 5, 5.1), ("is_lt", (5,), 4.9, 5), ("is_eq", (5,), 5, 5.1), ("is_neq", (5,), 5.1, 5),
        ("is_between", (1, 3), 3, 3.1), ("is_not_between", (1, 3), 0.9, 1), ("is_zero", (), 0, 0.1), ("is_positive", (), 1, 0), ("is_negative", (), -1, 0),
    ],
)
def test_predicates(spark, name, args, passing, failing):
    f = PREDICATES[name]
    assert f(passing, *args) and not f(failing, *args)
    row = spark.range(1).select(f(F.lit(float(passing)), *args).alias("p"), f(F.lit(float(failing)), *args).alias("f")).first()
    assert row.p and not row.f


def test_tolerance_is_strict():
    assert not PREDICATES["is_eq"](5, 5, tol=0) and not PREDICATES["is_geq"](5, 5, tol=0)
    assert within_tol(10, 10.5, abs_tol=1) and not within_tol(10, 12, rel_tol=0.1) and pct(5) == 0.05
    with pytest.raises(ValueError):
        within_tol(1, 1)


def test_expressions_agree_on_driver_and_columns(spark):
    a, b, c = Ref("a"), Ref("b"), Ref("c")
    cases = [a + b * 2, 1 - a / b, -(a**2) / 4, abs(b - a), sqrt(a), log(b) + exp(a / 10), maximum_of(a, b, 3), coalesce(c, a), 2 ** (a - b), (a - a) / (b - b)]
    for x, y in ((3.0, 7.5), (2.0, 2.0), (9.0, 0.25)):
        values = {"a": Ok(x), "b": Ok(y), "c": fail("none")}
        row = spark.createDataFrame([(x, y, None)], "a double, b double, c double").select(*(e.column({n: F.col(n) for n in "abc"}).alias(str(k)) for k, e in enumerate(cases))).first()
        for k, e in enumerate(cases):
            got = e.evaluate(values)
            assert got.ok == (row[k] is not None) and (not got.ok or math.isclose(got.value, row[k], rel_tol=1e-12)), str(e)


def test_expression_failures():
    a, b = Ref("a"), Ref("b")
    v = {"a": Ok(-4.0), "b": fail("broken")}
    text = lambda e: str(e.evaluate(v))
    assert "infinity" in text(a / 0) and "complex: 0 + 2.0i" in text(sqrt(a)).replace("0.0", "0") and "complex" in text(a**0.5)
    assert text(a + b).startswith("Failed to evaluate symbol(s): b") and "broken" in text(a + b)
    assert "Error evaluating" in text(exp(a * -1000)) and coalesce(b, 7).evaluate(v) == Ok(7.0)
    assert (a * 0 / (a - a)).evaluate(v) == Ok(0.0)
    for bad in (lambda: bool(a), lambda: a < 1, lambda: a + "x"):
        with pytest.raises(TypeError):
            bad()


def test_trends_on_gaps(spark):
    series = {day(0): 12.0, day(1): 10.0, day(7): 6.0, day(9): 0.0, day(8): 3.0}
    assert trends.change(series, day(0), 1).value == pytest.approx(0.2) and trends.change(series, day(0), 7).value == 1
    assert "is zero" in str(trends.change(series, day(8), 1)) and "There are 1 dates" in str(trends.change(series, day(7), 7))
    assert trends.deviation(series, day(0), 0, 1) == Ok(0.0) and not trends.deviation(series, day(0), 3, 2).ok
    df = spark.createDataFrame(list(series.items()), "date date, v double")
    rows = {r.date: r for r in trends.with_stddev(trends.with_week_over_week(trends.with_day_over_day(df, "v"), "v"), "v", 1, 8).collect()}
    for d in series:
        for name, got in (("day_over_day", trends.change(series, d, 1)), ("week_over_week", trends.change(series, d, 7)), ("stddev", trends.deviation(series, d, 1, 8))):
            assert (rows[d][name] is None) == (not got.ok) and (not got.ok or rows[d][name] == pytest.approx(got.value))


def test_lags_trends_and_nesting(sales):
    def body(mp, ctx):
        tax = mp.average("tax")
        ctx.assert_that(tax / mp.average("tax", lag=1)).config(name="ratio").is_eq(10 / 11)
        ctx.assert_that(mp.ext.day_over_day(tax)).config(name="dod").is_eq(1 / 11)
        ctx.assert_that(mp.ext.week_over_week(tax, lag=1)).config(name="wow").is_eq(7 / 18)
        ctx.assert_that(mp.ext.stddev(tax, offset=1, n=3)).config(name="sd").is_eq(1.0)
        ctx.assert_that(mp.ext.stddev(mp.ext.day_over_day(tax), offset=0, n=2)).config(name="nested").is_eq(abs(1 / 11 - 1 / 12) / math.sqrt(2))
        ctx.assert_that(mp.sum("tax", lag=40)).config(name="nothing").noop()

    suite = run([sales()], body)
    assert statuses(suite) == dict.fromkeys(("ratio", "dod", "wow", "sd", "nested"), "PASSED") | {"nothing": "FAILED"}
    assert "Null value" in suite.collect_results()[-1].reason
    with pytest.raises(ProbitasError, match="has run"):
        suite.run([sales()], KEY)
    first = suite.execution_id
    suite.reset()
    suite.run([sales()], KEY)
    assert suite.execution_id != first and statuses(suite)["dod"] == "PASSED"


def test_parameters_are_part_of_a_metric(sales):
    def body(mp, ctx):
        ctx.assert_that(mp.num_rows() - mp.num_rows(parameters={"c": "a"})).config(name="half").is_eq(5)

    assert statuses(run([sales()], body)) == {"half": "PASSED"}


def test_exclusion(sales):
    def body(mp, ctx):
        ctx.assert_that(mp.num_rows(lag=2)).config(name="out").is_eq(10)
        ctx.assert_that(mp.ext.day_over_day(mp.num_rows(lag=1))).config(name="half out").is_eq(0)
        ctx.assert_that(mp.ext.stddev(mp.average("tax"), offset=0, n=10)).config(name="mostly there").is_gt(0)
        ctx.assert_that(coalesce(mp.num_rows(lag=5), -1)).config(name="in").is_eq(10)

    got = statuses(run([sales(skip_dates={day(2)})], body))
    assert got == {"out": "SKIPPED", "half out": "SKIPPED", "mostly there": "PASSED", "in": "PASSED"}


def test_two_datasets(sales):
    def body(mp, ctx):
        a, b = mp.average("tax", dataset="ds1"), mp.average("tax", dataset="ds2")
        ctx.assert_that(abs(a / b - 1)).config(name="near", severity="P0").is_lt(0.2, tol=0.01)
        ctx.assert_that(a).config(name="between").is_between(b - 1, b + 1)

    suite = run([sales(), sales(name="ds2")], body)
    assert statuses(suite) == {"near": "PASSED", "between [lower]": "PASSED", "between [upper]": "PASSED"} and not suite.is_critical()
    with pytest.raises(ProbitasError, match="must name one"):
        run([sales(), sales(name="ds2")], lambda mp, ctx: ctx.assert_that(mp.num_rows()).config(name="x").noop())
    with pytest.raises(ProbitasError, match="weren't given"):
        suite = VerificationSuite([check(name="x", datasets=["other"])(lambda mp, ctx: ctx.assert_that(mp.num_rows()).config(name="x").noop())], MemoryStore(), "s")
        suite.run([sales()], KEY)


def test_validation():
    ok = lambda mp, ctx: ctx.assert_that(mp.num_rows()).config(name="a").noop()

    def twice(mp, ctx):
        ok(mp, ctx)
        ok(mp, ctx)

    make = lambda *checks: VerificationSuite(list(checks), MemoryStore(), "s")
    with pytest.raises(ProbitasError, match="Duplicate check"):
        make(check(name="x")(ok), check(name="x")(ok))
    with pytest.raises(ProbitasError, match="more than one assertion"):
        make(check(name="x")(twice))
    with pytest.raises(ProbitasError, match="not one of"):
        make(check(name="x", datasets=["a"])(lambda mp, ctx: ctx.assert_that(mp.num_rows(dataset="b")).config(name="a").noop()))
    suite = make(check(name="x")(lambda mp, ctx: mp.num_rows() and None if False else mp.sum("z")))
    assert len(suite.validation.warnings) == 2 and not suite.provider.symbols
    for bad in (dict(name=""), dict(name="x" * 256), dict(name="x", severity="P9"), dict(name="x", tags={"a b"}), dict(name="x", cost={"fp": 1}), dict(name="x", cost={"fp": -1, "fn": 0})):
        with pytest.raises(ValueError):
            make(check(name="x")(lambda mp, ctx: ctx.assert_that(mp.num_rows()).config(**bad)))  # noqa: B023
    with pytest.raises(ValueError, match="above"):
        make(check(name="x")(lambda mp, ctx: ctx.assert_that(mp.num_rows()).config(name="x").is_between(2, 1)))
    for bad in (lambda: make(), lambda: make(ok), lambda: VerificationSuite([check(name="x")(ok)], MemoryStore(), " ")):
        with pytest.raises(ProbitasError):
            bad()
    with pytest.raises(ProbitasError, match="hasn't run"):
        make(check(name="x")(ok)).collect_results()


def test_failure_of_one_metric_leaves_the_rest(sales):
    def body(mp, ctx):
        ctx.assert_that(mp.sum("tax", lag=50)).config(name="gone", severity="P0").is_positive()
        ctx.assert_that(mp.num_rows()).config(name="there").is_eq(10)

    suite = run([sales()], body)
    assert statuses(suite) == {"gone": "FAILED", "there": "PASSED"} and suite.is_critical()
    with pytest.raises(ProbitasError, match="Null value"):
        run([sales()], body, strict=True)


def test_tunables(sales):
    low, n = TunableFloat("LOW", 20.0, bounds=(0.0, 50.0)), TunableInt("N", 2, bounds=(1, 9))

    def body(mp, ctx):
        ctx.assert_that(mp.num_rows() * n).config(name="a").is_leq(low)
        ctx.assert_that(mp.num_rows()).config(name="b").is_between(low - 15, 12)

    suite = run([sales()], body)
    assert statuses(suite) == {"a": "PASSED", "b": "PASSED"} and {p["name"] for p in suite.get_tunable_params()} == {"LOW", "N"}
    suite.set_param("LOW", 30.0, agent="rl", reason="test")
    assert suite.get_param("LOW") == 30.0 and [c.agent for c in suite.get_param_history("LOW")] == ["system", "rl"]
    suite.reset()
    suite.run([sales()], KEY)
    assert statuses(suite) == {"a": "PASSED", "b": "ERROR"} and "above the upper" in suite.collect_results()[1].reason
    for bad in (lambda: low.set(51.0), lambda: n.set(2.5), lambda: n.set(True), lambda: TunableFloat("X", 1, bounds=(3, 2)), lambda: TunableChoice("C", "z", ["a"])):
        with pytest.raises(ValueError):
            bad()
    with pytest.raises(KeyError):
        suite.get_param("?")
    other = TunableFloat("LOW", 1.0, bounds=(0.0, 2.0))
    with pytest.raises(ProbitasError, match="Two tunables"):
        run([sales()], lambda mp, ctx: ctx.assert_that(mp.num_rows() * low).config(name="x").is_leq(other))


def test_profiles_and_config(sales, tmp_path):
    mult = TunableFloat("M", 1.0, bounds=(0.0, 9.0))

    def body(mp, ctx):
        ctx.assert_that(mp.num_rows() * mult).config(name="volume", tags={"xmas"}).is_geq(35)
        ctx.assert_that(mp.num_rows()).config(name="other").is_eq(10)

    text = """
tunables: {M: 2.0}
profiles:
  - {name: season, start_date: 2025-01-10, end_date: 2025-01-15, rules: [{tag: xmas, metric_multiplier: 2.0, severity: P3}, {check: c1, disable: true}]}
  - {name: always, type: permanent, rules: [{assertion: volume, severity: P2}]}
"""
    path = tmp_path / "c.yaml"
    path.write_text(text)
    suite = run([sales()], body, lambda mp, ctx: ctx.assert_that(mp.num_rows()).config(name="off").is_eq(0), config=str(path))
    results = {r.assertion: r for r in suite.collect_results()}
    assert (results["volume"].status, results["volume"].severity, results["volume"].metric) == ("PASSED", "P2", 20.0)
    assert results["off"].status == "SKIPPED" and results["off"].reason == "Disabled by profile" and results["other"].severity == "P1"
    late = profiles.SeasonalProfile("x", day(5), day(1), [profiles.check("c0").disable()])
    assert statuses(run([sales()], body, profiles=[late]))["other"] == "PASSED"
    bad = ["profiles: []", "tunables: {}\nmore: 1", "- a", "tunables: {}\nprofiles: [{name: a, start_date: 2025-01-02, end_date: 2025-01-01}]", "tunables: {}\nprofiles: [{name: a, type: x}]",
           "tunables: {}\nprofiles: [{name: a, type: permanent, rules: [{severity: P1}]}]", "tunables: {}\nprofiles: [{name: a, type: permanent}, {name: a, type: permanent}]", "a: [", "tunables: {}\nprofiles: [{name: a, start_date: no, end_date: 2025-01-01}]"]
    for text in bad:
        with pytest.raises(ProbitasError):
            config.parse(text)
    with pytest.raises(ProbitasError, match="unknown tunables"):
        run([sales()], body, config=config.parse("tunables: {Z: 1}"))
    with pytest.raises(ProbitasError, match="given twice"):
        run([sales()], body, config=config.parse("tunables: {}\nprofiles: [{name: p, type: permanent}]"), profiles=[profiles.PermanentProfile("p")])


def test_history_trace_and_tables(spark, sales):
    db = MemoryStore()

    def body(mp, ctx):
        ctx.assert_that(mp.sum("tax") + mp.sum("tax", lag=1)).config(name="a").is_positive()
        ctx.assert_that(mp.ext.day_over_day(mp.sum("tax"))).config(name="b").is_positive()

    suite = run([sales()], body, db=db)
    frame = suite.metric_trace(spark)
    rows = {(r.metric, r.date): r for r in frame.collect()}
    row = rows["sum(tax)", day(1)]
    assert row.value_db == row.value_analysis == row.value_final == 110.0 and row.tags == "env=prod" and row.symbol
    assert rows["day_over_day(sum(tax))", D].is_extended and rows["day_over_day(sum(tax))", D].value_final == pytest.approx(1 / 11)
    assert trace.trace_stats(frame)["discrepancies"] == 0
    wrong = frame.withColumn("value_db", F.col("value_db") + 1)
    assert trace.discrepancies(wrong).count() == 2
    assert "PASSED" in tables.assertion_table(suite.collect_results()) and "x_1" in tables.symbol_table(suite.collect_symbols()) and "sum(tax)" in tables.trace_table(frame, 0.9)
    assert suite.results_frame(spark).count() == 2
    again = run([sales()], body, db=db, reuse_history=True)
    assert statuses(again) == statuses(suite) and len(db.get_by_execution_id(again.execution_id)) < len(db.get_by_execution_id(suite.execution_id))


class Slow:
    @staticmethod
    def metadata():
        return plugins.PluginMetadata("slow")

    def process(self, context):
        time.sleep(5)


class Broken(Slow):
    @staticmethod
    def metadata():
        return plugins.PluginMetadata("broken")

    def process(self, context):
        raise RuntimeError("no")


def test_plugins(sales):
    suite = run([sales()], lambda mp, ctx: ctx.assert_that(mp.num_rows()).config(name="a", severity="P0").is_eq(9), plugins=[plugins.AuditPlugin])
    manager = suite.plugin_manager
    manager.time_limit = 0.2
    manager.register(Slow())
    manager.register("probitas.reports.plugins.AuditPlugin")
    manager.register(Broken)
    assert manager.process_all(suite, [sales()]) == {"audit": "ok", "slow": "time limit", "broken": "RuntimeError: no"}
    seen = []
    catcher = type("Catcher", (Slow,), {"metadata": staticmethod(lambda: plugins.PluginMetadata("c")), "process": lambda self, c: seen.append(c)})
    manager.clear()
    manager.register(catcher())
    manager.process_all(suite, [sales()])
    assert seen[0].failures_by_severity() == {"P0": 1} and seen[0].pass_rate() == 0 and "1 failed" in plugins.AuditPlugin().report(seen[0])
    for bad in ("nothing", object()):
        with pytest.raises(ValueError):
            manager.register(bad)


def test_err_text():
    assert isinstance(fail("x"), Err) and str(fail("x")) == "x" and not fail("x").ok


def test_a_plugin_beyond_its_time_is_interrupted(sales):
    ended = []

    class Endless:
        @staticmethod
        def metadata():
            return plugins.PluginMetadata("endless")

        def process(self, context):
            try:
                while True:
                    time.sleep(0.01)
            finally:
                ended.append(True)

    suite = run([sales()], lambda mp, ctx: ctx.assert_that(mp.num_rows()).config(name="a").noop())
    manager = plugins.PluginManager([Endless], time_limit=0.2)
    assert manager.process_all(suite, [sales()]) == {"endless": "time limit"} and ended == [True]
    manager.unregister("endless")
    manager.register(plugins.AuditPlugin)
    assert manager.process_all(suite, [sales()]) == {"audit": "ok"}


def test_reports_of_a_run(sales, capsys):
    def body(mp, ctx):
        ctx.assert_that(mp.sum("tax") / mp.num_rows(lag=1)).config(name="ratio").is_gt(0)
        ctx.assert_that(mp.ext.day_over_day(mp.average("n"))).config(name="change", severity="P0").noop()

    suite = run([sales()], body)
    analysed = trace.analysis_table(suite)
    assert analysed.schema == trace.ANALYSIS_ARROW
    assert [(r["date"], r["metric"], r["value"]) for r in analysed.to_pylist()] == [(day(0), "average(n)", 0.9), (day(0), "sum(tax)", 100.0), (day(1), "average(n)", 0.9), (day(1), "num_rows()", 10.0)]
    stored = suite.db.get_by_execution_id(suite.execution_id)
    metrics = trace.metrics_table(stored)
    assert metrics.schema == trace.METRICS_ARROW and metrics.num_rows == 5 and metrics["tags"].to_pylist() == ["env=prod"] * 5
    assert trace.metrics_table([]).num_rows == 0 and trace.metrics_table([]).schema == trace.METRICS_ARROW
    tables.print_analysis_report(suite)
    tables.print_metrics_by_execution_id(stored, suite.execution_id)
    tables.print_graph(suite)
    shown = capsys.readouterr().out
    assert "Analysis report" in shown and f"Metrics for execution: {suite.execution_id}" in shown
    assert "Suite suite\n  Check c0\n    ratio [P1]" in shown and "num_rows(), 1 days before of ds1" in shown


def test_states_are_stored(sales):
    suite = run([sales()], lambda mp, ctx: ctx.assert_that(mp.variance("n") + mp.average("n") + mp.num_rows()).config(name="a").noop())
    found = {r.name: json.loads(r.state) for r in suite.db.get_by_execution_id(suite.execution_id)}
    assert found == {"variance(n)": {"n": 10.0, "mean": 0.9, "m2": pytest.approx(6.9)}, "average(n)": {"n": 10.0, "mean": 0.9}, "num_rows()": {"value": 10.0}}


def test_history_is_read_once_for_each_metric(sales):
    class Counting(MemoryStore):
        reads = 0

        def get_metric_window(self, *args, **kw):
            self.reads += 1
            return super().get_metric_window(*args, **kw)

    body = lambda mp, ctx: ctx.assert_that(mp.ext.stddev(mp.sum("tax"), offset=1, n=7) + mp.sum("tax")).config(name="a").noop()
    db = Counting()
    first = run([sales()], body, db=db)
    again = run([sales()], body, db=db, reuse_history=True)
    assert db.reads == 1 and first.collect_results()[0].metric == again.collect_results()[0].metric


def test_other_functions(sales):
    tanh = function("tanh", math.tanh, F.tanh)
    inverse = function("inverse", lambda x: 1 / x, lambda c: 1 / c)

    def body(mp, ctx):
        ctx.assert_that(tanh(mp.average("n"))).config(name="bent").is_eq(math.tanh(0.9))
        ctx.assert_that(inverse(mp.negative_count("n"))).config(name="fails").noop()

    assert statuses(run([sales()], body)) == {"bent": "PASSED", "fails": "FAILED"}
    with pytest.raises(ValueError, match="exists"):
        function("tanh", math.tan, F.tan)
