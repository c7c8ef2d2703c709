"""Checks, suites and their evaluation.

A check is a function that asks a provider for metrics and asserts conditions on expressions
over them.  A suite collects the metrics of all its checks, has the planner compute them with
one aggregation for each dataset where possible, and evaluates the assertions on the driver.
"""

from __future__ import annotations

import datetime as dt
import functools
import json
import logging
import math
import time
import uuid
from collections.abc import Callable, Iterable, Sequence
from dataclasses import dataclass, field
from typing import Any, TypedDict, Unpack

from pyspark.sql import DataFrame, SparkSession

from probitas.functions import compare
from probitas.functions.expr import Expr, Ref, lift
from probitas.keys import SEVERITIES, Err, EvaluationFailure, Ok, ProbitasError, ResultKey, SymbolInfo, fail, valid_tags
from probitas.operators import metrics as M
from probitas.operators import states, trends
from probitas.sources.frame import FrameSource
from probitas.sources.store import MetricStore, StoredMetric, StoreStats, parameters_text

from . import profiles as P
from .config import Config, load
from .planner import MAX_DISTINCT, Planner
from .tunables import Tunable, TunableChange, by_name

log = logging.getLogger("probitas")

PASSED, FAILED, SKIPPED, ERROR = "PASSED", "FAILED", "SKIPPED", "ERROR"
DISABLED = "Disabled by profile"
UNAVAILABLE = "Insufficient data availability"


@dataclass(frozen=True)
class Trend:
    """A metric derived from the daily values of another."""

    kind: str
    base: Any  # Metric or Trend
    offset: int = 0
    n: int = 0

    @property
    def name(self) -> str:
        more = f", offset={self.offset}, n={self.n}" if self.kind == "stddev" else ""
        return f"{self.kind}({self.base.name}{more})"

    @property
    def parameters(self) -> tuple:
        return self.base.parameters

    def days(self, day: dt.date) -> list[dt.date]:
        """The days of the base that the value of a day depends on."""
        back = {"day_over_day": [0, trends.DAY], "week_over_week": [0, trends.WEEK]}.get(self.kind) or [self.offset + k for k in range(self.n)]
        return [day - dt.timedelta(days=b) for b in back]

    def compute(self, series: trends.Series, day: dt.date) -> Ok | Err:
        if self.kind == "stddev":
            return trends.deviation(series, day, self.offset, self.n)
        return trends.change(series, day, trends.DAY if self.kind == "day_over_day" else trends.WEEK)


@dataclass
class Symbol:
    """A metric that a check asked for."""

    name: str
    spec: Any
    lag: int
    dataset: str | None
    check: str | None = None


class Scope(TypedDict, total=False):
    """Of which day, dataset and rows a metric is: days back, the dataset's name, and row filters."""

    lag: int
    dataset: str | None
    parameters: dict[str, Any] | None


class MetricProvider:
    """Hands out symbols for metrics; equal metrics of one dataset and lag share a symbol."""

    def __init__(self) -> None:
        self.symbols: dict[str, Symbol] = {}
        self.ext = Extended(self)
        self.current: str | None = None

    def metric(self, spec: Any, lag=0, dataset=None) -> Ref:
        if lag < 0:
            raise ValueError("A lag can't be negative")
        for s in self.symbols.values():
            if (s.spec, s.lag, s.dataset, s.check) == (spec, lag, dataset, self.current):
                return Ref(s.name)
        name = f"x_{len(self.symbols) + 1}"
        self.symbols[name] = Symbol(name, spec, lag, dataset, self.current)
        return Ref(name)

    def _simple(self, spec: M.Metric, lag=0, dataset=None, parameters=None) -> Ref:
        return self.metric(spec.with_parameters(parameters), lag, dataset)

    def num_rows(self, **scope: Unpack[Scope]) -> Ref:
        return self._simple(M.num_rows(), **scope)

    def first(self, column: str, order_by: str | None = None, **scope: Unpack[Scope]) -> Ref:
        return self._simple(M.first(column, order_by), **scope)

    def duplicate_count(self, columns: list[str], **scope: Unpack[Scope]) -> Ref:
        return self._simple(M.duplicate_count(columns), **scope)

    def count_values(self, column: str, values: Any, **scope: Unpack[Scope]) -> Ref:
        return self._simple(M.count_values(column, values), **scope)

    def min_length(self, column: str, type: str = "string", **scope: Unpack[Scope]) -> Ref:
        return self._simple(M.min_length(column, type), **scope)

    def max_length(self, column: str, type: str = "string", **scope: Unpack[Scope]) -> Ref:
        return self._simple(M.max_length(column, type), **scope)

    def null_rate(self, column: str, **scope: Unpack[Scope]) -> Expr:
        return self.null_count(column, **scope) / self.num_rows(**scope)

    def get(self, ref: Ref) -> Symbol:
        return self.symbols[ref.name]


def _column_metric(make: Callable[[str], M.Metric]):
    def method(self: MetricProvider, column: str, **scope: Unpack[Scope]) -> Ref:
        return self._simple(make(column), **scope)

    return method


for _name, _make in {
    "average": M.average,
    "minimum": M.minimum,
    "maximum": M.maximum,
    "sum": M.total,
    "variance": M.variance,
    "null_count": M.null_count,
    "negative_count": M.negative_count,
    "unique_count": M.unique_count,
    "custom_sql": M.custom_sql,
}.items():
    setattr(MetricProvider, _name, _column_metric(_make))


class Extended:
    """Trends over metrics, and over other trends."""

    def __init__(self, provider: MetricProvider):
        self.provider = provider

    def _trend(self, of: Ref, kind: str, lag=0, dataset=None, offset=0, n=0) -> Ref:
        base = self.provider.get(of)
        if dataset is not None and base.dataset not in (None, dataset):
            raise ProbitasError(f"{kind} of dataset {dataset!r} over a metric of {base.dataset!r}")
        return self.provider.metric(Trend(kind, base.spec, offset, n), lag + base.lag, dataset or base.dataset)

    def day_over_day(self, metric: Ref, lag=0, dataset=None) -> Ref:
        return self._trend(metric, "day_over_day", lag, dataset)

    def week_over_week(self, metric: Ref, lag=0, dataset=None) -> Ref:
        return self._trend(metric, "week_over_week", lag, dataset)

    def stddev(self, metric: Ref, offset: int, n: int, dataset=None) -> Ref:
        if n < 1 or offset < 0:
            raise ValueError("stddev needs n of at least 1 and an offset of at least 0")
        return self._trend(metric, "stddev", 0, dataset, offset, n)


@dataclass
class Assertion:
    check: str
    name: str
    expr: Expr
    test: Callable[[float], bool]
    shown: Callable[[], str]
    severity: str = "P1"
    tags: frozenset[str] = frozenset()
    experimental: bool = False
    required: bool = False
    cost: dict[str, float] | None = None
    predicate: str = "noop"
    tunables: tuple[Tunable, ...] = ()


@dataclass(frozen=True)
class AssertionResult:
    yyyy_mm_dd: dt.date
    suite: str
    check: str
    assertion: str
    severity: str
    status: str
    value: Ok | Err
    expression: str
    tags: dict[str, str]
    assertion_tags: frozenset[str] = frozenset()
    experimental: bool = False
    required: bool = False
    cost: dict[str, float] | None = None
    reason: str | None = None

    @property
    def metric(self) -> float | None:
        return self.value.value if self.value.ok else None


class AssertionDraft:
    """An expression about which nothing is asserted yet."""

    def __init__(self, context: Context, actual: Any):
        self._context, self._actual = context, lift(actual)

    def config(
        self,
        name: str,
        severity: str = "P1",
        tags: Iterable[str] = (),
        experimental: bool = False,
        required: bool = False,
        cost: dict[str, float] | None = None,
    ) -> AssertionReady:
        name = (name or "").strip()
        if not name:
            raise ValueError("An assertion needs a name")
        if len(name) > 255:
            raise ValueError("The name of an assertion has at most 255 characters")
        if severity not in SEVERITIES:
            raise ValueError(f"{severity!r} is no severity")
        if cost is not None and (set(cost) != {"fp", "fn"} or not all(isinstance(v, int | float) and not isinstance(v, bool) and v >= 0 for v in cost.values())):
            raise ValueError("cost has exactly fp and fn, numbers of at least 0")
        return AssertionReady(self._context, self._actual, dict(name=name, severity=severity, tags=valid_tags(tags), experimental=experimental, required=required, cost=cost))


class AssertionReady:
    """An expression with a name, to which a condition is added."""

    def __init__(self, context: Context, actual: Expr, config: dict[str, Any]):
        self._context, self._actual, self._config = context, actual, config

    def _add(self, predicate: str, sign: str, bounds: tuple[Any, ...], tol: float) -> None:
        # bounds that are expressions over metrics move to the left side
        lifted = tuple(lift(b) for b in bounds)
        actual = self._actual
        tunables = tuple(t.tunable for e in (actual, *lifted) for t in e.tunables())
        function = compare.PREDICATES.get(predicate)
        moved = any(b.refs() for b in lifted)
        if moved and len(lifted) == 1:
            actual, lifted = actual - lifted[0], (lift(0.0),)
            shown_bounds = lifted
        elif moved:
            lower, upper = lifted
            inside = predicate == "is_between"
            ready = AssertionReady(self._context, actual, self._config | {"name": f"{self._config['name']} [lower]"})
            if not inside:
                raise ValueError("is_not_between takes no bounds that are expressions over metrics")
            ready._add("is_geq", ">=", (lower,), tol)
            AssertionReady(self._context, actual, self._config | {"name": f"{self._config['name']} [upper]"})._add("is_leq", "<=", (upper,), tol)
            return
        else:
            shown_bounds = lifted

        def values() -> list[float]:
            out = [b.compute({}) for b in lifted]
            if len(out) == 2 and out[0] > out[1]:
                raise ValueError(f"The lower bound {out[0]} is above the upper bound {out[1]}")
            return out

        if len(lifted) == 2 and not any(b.tunables() for b in lifted):
            values()
        text = actual
        self._context._assertion(
            Assertion(
                check=self._context.check,
                expr=text,
                test=(lambda x: True) if function is None else (lambda x: bool(function(x, *values(), tol=tol))),
                shown=lambda: f"{text} {sign} {', '.join(map(str, shown_bounds))}".strip(),
                predicate=predicate,
                tunables=tuple(dict.fromkeys(tunables)),
                **self._config,
            )
        )

    def is_geq(self, other: Any, tol: float = compare.EPSILON) -> None:
        self._add("is_geq", ">=", (other,), tol)

    def is_gt(self, other: Any, tol: float = compare.EPSILON) -> None:
        self._add("is_gt", ">", (other,), tol)

    def is_leq(self, other: Any, tol: float = compare.EPSILON) -> None:
        self._add("is_leq", "<=", (other,), tol)

    def is_lt(self, other: Any, tol: float = compare.EPSILON) -> None:
        self._add("is_lt", "<", (other,), tol)

    def is_eq(self, other: Any, tol: float = compare.EPSILON) -> None:
        self._add("is_eq", "=", (other,), tol)

    def is_neq(self, other: Any, tol: float = compare.EPSILON) -> None:
        self._add("is_neq", "!=", (other,), tol)

    def is_between(self, lower: Any, upper: Any, tol: float = compare.EPSILON) -> None:
        self._add("is_between", "in", (lower, upper), tol)

    def is_not_between(self, lower: float, upper: float, tol: float = compare.EPSILON) -> None:
        self._add("is_not_between", "not in", (lower, upper), tol)

    def is_zero(self, tol: float = compare.EPSILON) -> None:
        self._add("is_zero", "= 0", (), tol)

    def is_positive(self, tol: float = compare.EPSILON) -> None:
        self._add("is_positive", "> 0", (), tol)

    def is_negative(self, tol: float = compare.EPSILON) -> None:
        self._add("is_negative", "< 0", (), tol)

    def noop(self) -> None:
        """Collect the value; it always passes."""
        self._add("noop", "", (), 0.0)


class Context:
    """What a check function asserts on."""

    def __init__(self, suite: str, provider: MetricProvider, key: ResultKey | None = None):
        self.suite, self.provider, self.key = suite, provider, key
        self.check: str = ""
        self.assertions: list[Assertion] = []

    def assert_that(self, expr: Any) -> AssertionDraft:
        return AssertionDraft(self, expr)

    def _assertion(self, a: Assertion) -> None:
        self.assertions.append(a)


CheckFunction = Callable[[MetricProvider, Context], None]


def check(name: str, datasets: Sequence[str] | None = None) -> Callable[[CheckFunction], CheckFunction]:
    """Make a check of a function."""
    if not name or not name.strip():
        raise ValueError("A check needs a name")

    def decorate(function: CheckFunction) -> CheckFunction:
        @functools.wraps(function)
        def run(mp: MetricProvider, ctx: Context) -> None:
            function(mp, ctx)

        run.check_name, run.check_datasets = name, tuple(datasets or ())  # type: ignore[attr-defined]
        return run

    return decorate


@dataclass
class _Check:
    name: str
    datasets: tuple[str, ...]
    assertions: list[Assertion] = field(default_factory=list)


@dataclass(frozen=True)
class Validation:
    errors: tuple[str, ...]
    warnings: tuple[str, ...]


class VerificationSuite:
    """Checks that run together.

    Metrics are declared in the constructor, so mistakes in checks show before any data is read.
    A suite runs once; ``reset`` makes it ready for another run, with another execution id.
    strict: a metric without a value stops the run, instead of failing the assertions that
    need it.  reuse_history: values of earlier days that the store has from earlier runs, with
    the same tags, are taken from it.
    """

    def __init__(
        self,
        checks: Sequence[CheckFunction],
        db: MetricStore,
        name: str,
        data_av_threshold: float = 0.9,
        profiles: Sequence[P.Profile] = (),
        config: Config | str | None = None,
        plugins: Sequence[Any] = (),
        strict: bool = False,
        reuse_history: bool = False,
        max_distinct_per_job: int | None = MAX_DISTINCT,
        log_level: str | None = None,
    ):
        if not checks:
            raise ProbitasError("A suite needs a check")
        if not name or not name.strip():
            raise ProbitasError("A suite needs a name")
        if not 0 <= data_av_threshold <= 1:
            raise ProbitasError("data_av_threshold lies between 0 and 1")
        if log_level:
            log.setLevel(log_level)
        self.checks, self.db, self.name, self.data_av_threshold = list(checks), db, name, data_av_threshold
        self.strict, self.reuse_history, self.max_distinct = strict, reuse_history, max_distinct_per_job
        config = load(config) if isinstance(config, str) else config
        self.profiles = list(profiles)
        if config:
            if clash := {p.name for p in self.profiles} & {p.name for p in config.profiles}:
                raise ProbitasError(f"Profiles given twice: {', '.join(sorted(clash))}")
            self.profiles += config.profiles
        from probitas.reports.plugins import PluginManager

        self.plugin_manager = PluginManager(plugins)
        self.analysis_ms: float | None = None
        self.metrics_stats = StoreStats(0, 0)
        self._build()
        self._tunables = by_name(t for a in self.assertions for t in a.tunables)
        if config:
            config.apply(self._tunables)

    def _build(self) -> None:
        self.execution_id = str(uuid.uuid4())
        self.provider = MetricProvider()
        self.context = Context(self.name, self.provider)
        self._checks: list[_Check] = []
        self.key: ResultKey | None = None
        self._results: list[AssertionResult] | None = None
        self._values: dict[str, Ok | Err] = {}
        self._ratios: dict[str, float] = {}
        self._analysis: dict[tuple, Ok | Err] = {}
        self._errors: list[str] = []
        for function in self.checks:
            if not hasattr(function, "check_name"):
                raise ProbitasError(f"{getattr(function, '__name__', function)!r} isn't decorated with @check")
            made = _Check(function.check_name, function.check_datasets)
            self._checks.append(made)
            before = len(self.context.assertions)
            self.context.check = self.provider.current = made.name
            function(self.provider, self.context)
            made.assertions = self.context.assertions[before:]
        self.context.check, self.provider.current = "", None
        self.validation = self._validate()
        for warning in self.validation.warnings:
            log.warning(warning)
        if self.validation.errors:
            raise ProbitasError("Suite validation failed: " + "; ".join(self.validation.errors))

    @property
    def assertions(self) -> list[Assertion]:
        return self.context.assertions

    def _validate(self) -> Validation:
        errors, warnings = [], []
        names = [c.name for c in self._checks]
        errors += [f"Duplicate check name: {n!r}" for n in dict.fromkeys(names) if names.count(n) > 1]
        used = {r.name for a in self.assertions for r in a.expr.refs()}
        for c in self._checks:
            own = [a.name for a in c.assertions]
            errors += [f"Check {c.name!r} has more than one assertion named {n!r}" for n in dict.fromkeys(own) if own.count(n) > 1]
            if not own:
                warnings.append(f"Check {c.name!r} has no assertions")
        for s in self.provider.symbols.values():
            datasets = next((c.datasets for c in self._checks if c.name == s.check), ())
            if datasets and s.dataset is not None and s.dataset not in datasets:
                errors.append(f"{s.spec.name} of check {s.check!r} is of dataset {s.dataset!r}, not one of {', '.join(datasets)}")
        unused = [s for s in self.provider.symbols if s not in used]
        # a base that only a trend needs isn't unused: the trend holds its spec
        trends_of = {(t.spec.base, t.dataset) for t in self.provider.symbols.values() if isinstance(t.spec, Trend)}
        warnings += [f"Metric {self.provider.symbols[s].spec.name} isn't used" for s in unused if (self.provider.symbols[s].spec, self.provider.symbols[s].dataset) not in trends_of]
        for s in unused:
            del self.provider.symbols[s]
        return Validation(tuple(errors), tuple(warnings))

    def _impute(self, sources: dict[str, FrameSource]) -> None:
        """Give each symbol its dataset: its own, or the only one of its check, or of the suite."""
        for c in self._checks:
            if unknown := [d for d in c.datasets if d not in sources]:
                raise ProbitasError(f"Check {c.name!r} needs dataset(s) that weren't given: {', '.join(unknown)}")
        for s in self.provider.symbols.values():
            datasets = next((c.datasets for c in self._checks if c.name == s.check), ()) or tuple(sources)
            if s.dataset is None:
                if len(datasets) != 1:
                    raise ProbitasError(f"{s.spec.name} of check {s.check!r} must name one of the datasets {', '.join(datasets)}")
                s.dataset = datasets[0]
            elif s.dataset not in sources:
                raise ProbitasError(f"{s.spec.name} is of dataset {s.dataset!r}, which wasn't given")

    def _base_requests(self, spec: Any, day: dt.date) -> list[tuple[dt.date, M.Metric]]:
        if isinstance(spec, M.Metric):
            return [(day, spec)]
        return [r for d in spec.days(day) for r in self._base_requests(spec.base, d)]

    def _ratio(self, spec: Any, day: dt.date, skipped: frozenset[dt.date]) -> float:
        if isinstance(spec, M.Metric):
            return 0.0 if day in skipped else 1.0
        children = [self._ratio(spec.base, d, skipped) for d in spec.days(day)]
        return sum(children) / len(children)

    def run(self, datasources: Sequence[FrameSource], key: ResultKey, *, enable_plugins: bool = True) -> None:
        if self.is_evaluated:
            raise ProbitasError("The suite has run; reset() it before another run")
        sources = {s.name: s for s in datasources}
        if not sources:
            raise ProbitasError("A run needs a datasource")
        if len(sources) < len(datasources):
            raise ProbitasError("Two datasources have one name")
        self._impute(sources)
        self.key, self.context.key = key, key
        self.metrics_stats = self.db.stats()
        self.db.delete_expired()
        began = time.perf_counter()
        for name, source in sources.items():
            self._analyze(source, [s for s in self.provider.symbols.values() if s.dataset == name], key)
        self.analysis_ms = (time.perf_counter() - began) * 1000
        self._results = [self._evaluate(a, key) for a in self.assertions]
        if enable_plugins:
            self.plugin_manager.process_all(self, datasources)

    def _analyze(self, source: FrameSource, symbols: list[Symbol], key: ResultKey) -> None:
        requests: list[tuple[dt.date, M.Metric]] = []
        live = []
        for s in symbols:
            day = key.yyyy_mm_dd - dt.timedelta(days=s.lag)
            self._ratios[s.name] = ratio = self._ratio(s.spec, day, source.skip_dates)
            if ratio < self.data_av_threshold:
                self._values[s.name] = fail(f"{UNAVAILABLE}: {ratio:.2f}")
                continue
            live.append((s, day))
            requests += [r for r in self._base_requests(s.spec, day) if r[0] not in source.skip_dates]
        requests = list(dict.fromkeys(requests))
        known = self._known(source.name, requests, key) if self.reuse_history else {}
        missing = [r for r in requests if r not in known]
        # what the states of some metrics hold beside their value, from the same scan
        computed = Planner(source, self.max_distinct).run([*missing, *((d, extra) for d, m in missing for extra in states.beside(m))])
        found = known | {r: computed[r] for r in missing}
        if self.strict and (bad := next((v for v in found.values() if not v.ok), None)):
            raise ProbitasError(str(bad))
        self._analysis |= {(source.name, *r): v for r, v in found.items()}
        self._persist([(m, d, v) for (d, m), v in found.items() if (d, m) not in known], source.name, key, computed)
        derived: dict[tuple[Any, dt.date], Ok | Err] = {(m, d): v for (d, m), v in found.items()}

        def value(spec: Any, day: dt.date) -> Ok | Err:
            if (spec, day) not in derived:
                if isinstance(spec, M.Metric):
                    derived[spec, day] = fail(f"Metric {spec.name} for {day.isoformat()} on dataset '{source.name}' not found!")
                else:
                    parts = {d: value(spec.base, d) for d in spec.days(day)}
                    derived[spec, day] = spec.compute({d: v.value for d, v in parts.items() if v.ok}, day)
            return derived[spec, day]

        for s, day in live:
            self._values[s.name] = value(s.spec, day)
        self._persist([(spec, d, v) for (spec, d), v in derived.items() if isinstance(spec, Trend)], source.name, key)

    def _known(self, dataset: str, requests: list, key: ResultKey) -> dict:
        """Stored values of earlier days, read once for each metric."""
        earlier: dict[M.Metric, list[dt.date]] = {}
        for day, metric in requests:
            if day < key.yyyy_mm_dd:
                earlier.setdefault(metric, []).append(day)
        known = {}
        for metric, days in earlier.items():
            rows = self.db.get_metric_window(metric.name, dataset, min(days), max(days), parameters_text(metric.parameters), key.tags)
            known |= {(d, metric): Ok(rows[d].value) for d in days if d in rows}
        return known

    def _persist(self, values: list[tuple[Any, dt.date, Ok | Err]], dataset: str, key: ResultKey, computed: dict | None = None) -> None:
        known = {r: v.value for r, v in (computed or {}).items() if v.ok}
        self.db.persist(
            StoredMetric(
                metric_type=spec.kind,
                name=spec.name,
                dataset=dataset,
                value=v.value,
                yyyy_mm_dd=day,
                parameters=parameters_text(spec.parameters),
                tags=key.tags,
                state=json.dumps(states.stored(spec, lambda m: known.get((day, m))) or {}) if isinstance(spec, M.Metric) else "{}",
                execution_id=self.execution_id,
            )
            for spec, day, v in values
            if v.ok
        )

    def _evaluate(self, a: Assertion, key: ResultKey) -> AssertionResult:
        override = P.overrides(self.profiles, key.yyyy_mm_dd, a.check, a.name, a.tags)
        base = dict(
            yyyy_mm_dd=key.yyyy_mm_dd,
            suite=self.name,
            check=a.check,
            assertion=a.name,
            severity=override.severity or a.severity,
            expression=a.shown(),
            tags=key.tags,
            assertion_tags=a.tags,
            experimental=a.experimental,
            required=a.required,
            cost=a.cost,
        )
        refs = a.expr.refs()
        if override.disabled:
            return AssertionResult(status=SKIPPED, value=fail(DISABLED, str(a.expr)), reason=DISABLED, **base)
        needed = a.expr.needed() or refs
        if any(self._ratios[r.name] < self.data_av_threshold for r in needed):
            return AssertionResult(status=SKIPPED, value=fail(UNAVAILABLE, str(a.expr)), reason=UNAVAILABLE, **base)
        outcome = a.expr.evaluate(self._values)
        if not outcome.ok:
            about = tuple(self.symbol(r.name) for r in refs)
            outcome = Err(tuple(EvaluationFailure(f.error, f.expression, about) for f in outcome.failures))
            return AssertionResult(status=FAILED, value=outcome, reason=str(outcome), **base)
        try:
            passed = a.test(outcome.value * override.metric_multiplier)
        except (ValueError, ArithmeticError) as error:
            return AssertionResult(status=ERROR, value=outcome, reason=str(error), **base)
        return AssertionResult(status=PASSED if passed else FAILED, value=outcome, **base)

    def symbol(self, name: str) -> SymbolInfo:
        s = self.provider.symbols[name]
        day = self.key.yyyy_mm_dd - dt.timedelta(days=s.lag) if self.key else None
        return SymbolInfo(name, s.spec.name, s.dataset, self._values.get(name, fail("Not evaluated")), day, self.key.tags if self.key else {})

    @property
    def is_evaluated(self) -> bool:
        return self._results is not None

    def _evaluated(self) -> list[AssertionResult]:
        if self._results is None:
            raise ProbitasError("The suite hasn't run")
        return self._results

    def collect_results(self) -> list[AssertionResult]:
        return list(self._evaluated())

    def collect_symbols(self) -> list[SymbolInfo]:
        self._evaluated()
        return [self.symbol(n) for n in sorted(self.provider.symbols, key=lambda n: int(n[2:]))]

    def results_frame(self, spark: SparkSession) -> DataFrame:
        rows = [
            (r.yyyy_mm_dd, r.suite, r.check, r.assertion, r.severity, r.status, r.metric, r.expression, r.tags, sorted(r.assertion_tags), r.experimental, r.required, r.reason)
            for r in self._evaluated()
        ]
        return spark.createDataFrame(
            rows,
            "yyyy_mm_dd date, suite string, check string, assertion string, severity string, status string, value double, expression string, "
            "tags map<string,string>, assertion_tags array<string>, experimental boolean, required boolean, reason string",
        )

    def is_critical(self) -> bool:
        """Whether an assertion of severity P0 failed."""
        return any(r.severity == "P0" and r.status in (FAILED, ERROR) for r in self._evaluated())

    def metric_trace(self, spark: SparkSession) -> DataFrame:
        from probitas.reports.trace import metric_trace

        self._evaluated()
        return metric_trace(self, spark)

    def reset(self) -> None:
        """Make the suite ready for another run; tunables keep their values."""
        self._build()

    def cleanup_expired_metrics(self) -> int:
        return self.db.delete_expired()

    def get_tunable_params(self) -> list[dict[str, Any]]:
        return [t.describe() for t in self._tunables.values()]

    def _tunable(self, name: str) -> Tunable:
        if name not in self._tunables:
            raise KeyError(f"No tunable named {name!r}")
        return self._tunables[name]

    def get_param(self, name: str) -> Any:
        return self._tunable(name).value

    def set_param(self, name: str, value: Any, **note: Any) -> None:
        """note: agent and reason, for the history."""
        self._tunable(name).set(value, **note)

    def get_param_history(self, name: str) -> list[TunableChange]:
        return list(self._tunable(name).history)


def is_number(x: Any) -> bool:
    return isinstance(x, int | float) and not isinstance(x, bool) and math.isfinite(x)
