"""Contracts in the Open Data Contract Standard, version 3.1.0."""

from __future__ import annotations

import datetime as dt
import warnings
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from pathlib import Path
from typing import Any

import yaml
from pyspark.sql import types as T

from probitas.functions.expr import Expr
from probitas.operators import metrics as M
from probitas.plans.suite import check
from probitas.sources.frame import FrameSource

from .checks import COLUMN_TYPES, ContractCheck, parse_check
from .types import ContractValidationError, ContractWarning, Field, ListOf, Simple, StructOf, Timestamp, check_schema

LOGICAL = ("string", "integer", "number", "boolean", "date", "timestamp", "time", "array", "object")
STATUS = ("proposed", "draft", "active", "deprecated", "retired")
OPERATORS = {
    "mustBe": "is_eq",
    "mustNotBe": "is_neq",
    "mustBeGreaterThan": "is_gt",
    "mustBeGreaterOrEqualTo": "is_geq",
    "mustBeLessThan": "is_lt",
    "mustBeLessOrEqualTo": "is_leq",
    "mustBeBetween": "is_between",
    "mustNotBeBetween": "is_not_between",
}
SEVERITY = {"error": "P0", "warning": "P1"}
HOURS = {"h": 1, "hr": 1, "hour": 1, "hours": 1, "d": 24, "day": 24, "days": 24, "y": 8760, "yr": 8760, "year": 8760, "years": 8760}
ENGINE = "probitas"


@dataclass(frozen=True)
class Rule:
    """A rule that can be evaluated: what to measure, the condition, and how much it matters."""

    name: str
    measure: Callable[[Any], Expr]
    method: str
    bounds: tuple[float, ...]
    severity: str

    def add_to(self, mp: Any, ctx: Any) -> None:
        ready = ctx.assert_that(self.measure(mp)).config(name=self.name, severity=self.severity)
        getattr(ready, self.method)(*self.bounds)


@dataclass(frozen=True)
class Latency:
    hours: float
    column: str


@dataclass(frozen=True)
class Property:
    name: str
    type: Any
    required: bool = False
    partition_position: int | None = None


@dataclass(frozen=True)
class OdcsContract:
    """One schema object of a contract document."""

    name: str
    dataset: str
    version: str
    id: str
    status: str
    properties: tuple[Property, ...]
    rules: tuple[Rule, ...] = ()
    text_rules: tuple[dict[str, Any], ...] = field(default=(), hash=False)
    latency: Latency | None = None
    sla_metadata: dict[str, Any] = field(default_factory=dict, hash=False)

    @classmethod
    def from_odcs(cls, path: str | Path, engines: Sequence[str] = (ENGINE,)) -> list[OdcsContract]:
        """A contract for each schema object. engines: names under which custom rules are meant for this library."""
        path = Path(path)
        if not path.exists():
            raise ContractValidationError(f"No contract at {path}")
        return cls.parse(path.read_text(), engines)

    @classmethod
    def parse(cls, text: str, engines: Sequence[str] = (ENGINE,)) -> list[OdcsContract]:
        try:
            data = yaml.safe_load(text)
        except yaml.YAMLError as error:
            raise ContractValidationError(f"No valid YAML: {error}") from None
        _validate_document(data)
        return [_object(o, data, engines) for o in data.get("schema") or []]

    def check_schema(self, schema: T.StructType) -> None:
        check_schema(schema, {p.name: (p.type, not p.required) for p in self.properties if p.type is not None})

    def to_checks(self, source: FrameSource | None = None, now: dt.datetime | None = None) -> list[Callable]:
        """One check with the rules, a null count for each required property, and the freshness that a latency asks for."""
        moment = now or dt.datetime.now(dt.UTC)

        @check(name=self.name, datasets=[self.dataset])
        def contract(mp: Any, ctx: Any) -> None:
            if source is not None:
                self.check_schema(source.schema)
            for rule in self.rules:
                rule.add_to(mp, ctx)
            for p in self.properties:
                if p.required:
                    ctx.assert_that(mp.null_count(p.name)).config(name=f"{p.name} is required", severity="P0").is_eq(0)
            # a document may have several tables; the latency is that of those with the column
            if self.latency and self.latency.column in {p.name for p in self.properties}:
                age = mp.metric(M.age_hours(self.latency.column, moment))
                ctx.assert_that(age).config(name="SLA: Freshness check", severity="P0").is_leq(self.latency.hours)

        return [contract]


def _validate_document(data: Any) -> None:
    if not isinstance(data, dict):
        raise ContractValidationError("A contract is a mapping")
    for key in ("version", "apiVersion", "kind", "id", "status"):
        if not data.get(key):
            raise ContractValidationError(f"'{key}' is a required property")
    if data["kind"] != "DataContract":
        raise ContractValidationError(f"kind must be DataContract, not {data['kind']!r}")
    if data["apiVersion"] != "v3.1.0":
        raise ContractValidationError(f"apiVersion must be v3.1.0, not {data['apiVersion']!r}")
    if not isinstance(data["status"], str):
        raise ContractValidationError("status must be a string")
    for part in ("schema", "slaProperties"):
        if data.get(part) is not None and not isinstance(data[part], list):
            raise ContractValidationError(f"{part} must be a list")


def _warn(text: str) -> None:
    warnings.warn(text, ContractWarning, stacklevel=4)


def logical_type(data: dict[str, Any], where: str) -> Any:
    """The declared type; None where none is declared."""
    logical = data.get("logicalType")
    if logical is None:
        return None
    if logical not in LOGICAL:
        raise ContractValidationError(f"{where}: unknown logicalType {logical!r}")
    options = data.get("logicalTypeOptions") or {}
    if logical == "timestamp" and "timezone" in options:
        return Timestamp(options.get("defaultTimezone", "UTC") if options["timezone"] else None)
    if logical == "array":
        item = logical_type(data.get("items") or {}, f"{where}[]")
        return ListOf(item or _Any())
    if logical == "object":
        fields = [Field(_physical(p, where), logical_type(p, f"{where}.{p.get('name')}") or _Any()) for p in data.get("properties") or []]
        return StructOf(tuple(fields))
    return Simple({"integer": "int", "boolean": "bool"}.get(logical, logical))


@dataclass(frozen=True)
class _Any:
    def mismatch(self, actual: T.DataType, path: str):
        return iter(())


def _physical(data: dict[str, Any], where: str) -> str:
    if not isinstance(data, dict) or not data.get("name"):
        raise ContractValidationError(f"{where}: a property has a name")
    return data.get("physicalName") or data["name"]


def _object(data: dict[str, Any], document: dict[str, Any], engines: Sequence[str]) -> OdcsContract:
    if not isinstance(data, dict) or not data.get("name"):
        raise ContractValidationError("A schema object has a name")
    name = data["name"]
    properties, rules, texts = [], [], []
    for p in data.get("properties") or []:
        physical = _physical(p, f"Schema {name!r}")
        position = p.get("partitionKeyPosition") if p.get("partitioned") else None
        properties.append(Property(physical, logical_type(p, f"Property {p['name']!r}"), bool(p.get("required")), position))
        for q in p.get("quality") or []:
            _rule(q, physical, engines, rules, texts)
    for q in data.get("quality") or []:
        _rule(q, None, engines, rules, texts)
    names: dict[str, int] = {}
    unique = []
    for r in rules:
        names[r.name] = names.get(r.name, 0) + 1
        unique.append(r if names[r.name] == 1 else Rule(f"{r.name} ({names[r.name]})", r.measure, r.method, r.bounds, r.severity))
    aliases = {p.get("name"): _physical(p, name) for p in data.get("properties") or []}
    other = {e["property"]: {k: v for k, v in e.items() if k != "property"} for e in document.get("slaProperties") or [] if isinstance(e, dict) and e.get("property") not in (None, "latency", "ly")}
    return OdcsContract(
        name, data.get("physicalName") or name, str(document["version"]), str(document["id"]), document["status"], tuple(properties), tuple(unique), tuple(texts), _latency(document, properties, aliases), other
    )


def _latency(document: dict[str, Any], properties: list[Property], aliases: dict[str, str]) -> Latency | None:
    """The last latency entry; its column is the element's last part, or the first partition column."""
    found = None
    for entry in document.get("slaProperties") or []:
        if not isinstance(entry, dict) or entry.get("property") not in ("latency", "ly"):
            continue
        value = entry.get("value")
        if value is None:
            _warn("SLA latency: it has no value, so freshness isn't checked")
            continue
        if isinstance(value, bool) or not isinstance(value, int | float) or value < 0:
            raise ContractValidationError(f"A latency is a number of at least 0, not {value!r}")
        unit = str(entry["unit"]).lower() if "unit" in entry else "h"
        if unit not in HOURS:
            raise ContractValidationError(f"Unknown unit of latency {entry.get('unit')!r}")
        column = str(entry["element"]).rsplit(".", 1)[-1].strip() if entry.get("element") else None
        column = aliases.get(column, column) or next((p.name for p in properties if p.partition_position == 1), None)
        if column is None:
            _warn("SLA latency: no timestamp column is named, so freshness isn't checked")
        else:
            found = Latency(value * HOURS[unit], column)
    return found


def _condition(q: dict[str, Any], name: str) -> tuple[str, tuple[float, ...]]:
    given = [o for o in OPERATORS if o in q]
    if len(given) > 1:
        raise ContractValidationError(f"Quality rule {name!r} has more than one operator: {', '.join(given)}")
    if not given:
        return "noop", ()
    operator, value = given[0], q[given[0]]
    number = lambda x: isinstance(x, int | float) and not isinstance(x, bool)
    if operator.endswith("Between"):
        if not isinstance(value, list) or len(value) != 2 or not all(map(number, value)):
            raise ContractValidationError(f"Quality rule {name!r}: {operator} must be a list of [lower, upper], got: {value}")
        if value[0] > value[1]:
            raise ContractValidationError(f"Quality rule {name!r}: {operator} has its lower bound above the upper")
        return OPERATORS[operator], tuple(value)
    if not number(value):
        raise ContractValidationError(f"Quality rule {name!r}: {operator} must be a number, got: {value}")
    return OPERATORS[operator], (value,)


def _rule(q: Any, column: str | None, engines: Sequence[str], rules: list[Rule], texts: list[dict[str, Any]]) -> None:
    if not isinstance(q, dict):
        raise ContractValidationError("A quality rule is a mapping")
    kind = q.get("type") or ("library" if "metric" in q or "rule" in q else "text")
    metric = q.get("metric") or q.get("rule")
    name = q.get("name") or " ".join(str(x) for x in (column, metric or q.get("id") or kind) if x)
    if kind == "text":
        texts.append(q)
        return
    if kind == "sql":
        return _warn(f"Quality rule '{name}': SQL rules aren't executed; skipping")
    if kind == "custom" and q.get("engine") not in engines:
        return _warn(f"Quality rule '{name}': engine '{q.get('engine')}' isn't this one; skipping")
    method, bounds = _condition(q, name)
    severity = SEVERITY.get(q.get("severity", "warning"), "P1")
    measure = _custom(q, name) if kind == "custom" else _library(q, metric, column, name)
    if measure is not None:
        rules.append(Rule(name, measure, method, bounds, severity))


def _library(q: dict[str, Any], metric: str | None, column: str | None, name: str) -> Callable[[Any], Expr] | None:
    arguments = q.get("arguments") or {}
    valid = arguments.get("validValues") or q.get("validValues")
    if metric == "rowCount":
        return lambda mp: mp.num_rows()
    if metric == "duplicateValues" and (arguments.get("properties") or column):
        columns = list(arguments.get("properties") or [column])
        measure = lambda mp: mp.duplicate_count(columns)
    elif column is None:
        return _warn(f"Quality rule '{name}': metric '{metric}' needs a property; skipping")
    elif metric == "nullValues":
        measure = lambda mp: mp.null_count(column)
    elif metric == "missingValues":
        sentinels = [v for v in arguments.get("missingValues") or () if v is not None]
        if sentinels and len({type(v) for v in sentinels}) == 1 and isinstance(sentinels[0], str | int):
            measure = lambda mp: mp.null_count(column) + mp.count_values(column, sentinels)
        elif sentinels:
            return _warn(f"Quality rule '{name}': missingValues of mixed types; skipping")
        else:
            measure = lambda mp: mp.null_count(column)
    elif metric == "invalidValues" and arguments.get("pattern"):
        pattern = arguments["pattern"]
        measure = lambda mp: mp.num_rows() - mp.metric(M.matching_count(column, pattern))
    elif metric == "invalidValues" and valid:
        measure = lambda mp: mp.num_rows() - mp.count_values(column, list(valid))
    else:
        return _warn(f"Quality rule '{name}': metric '{metric}' can't be evaluated; skipping")
    return (lambda mp: measure(mp) / mp.num_rows()) if q.get("unit") == "percent" else measure


def _custom(q: dict[str, Any], name: str) -> Callable[[Any], Expr]:
    """A rule in this library's own vocabulary; white lists count what isn't in them, black lists what is."""
    body = q.get("implementation")
    data = yaml.safe_load(body) if isinstance(body, str) else body
    if not isinstance(data, dict) or "check" not in data:
        raise ContractValidationError(f"Quality rule {name!r}: implementation is a mapping with a check")
    options = {k: v for k, v in data.items() if k not in ("check", "column", "column_type")}
    column = data.get("column")
    if column is None and data["check"] in COLUMN_TYPES and data["check"] != "duplicates":
        raise ContractValidationError(f"Quality rule {name!r}: {data['check']} needs a column")
    made: ContractCheck = parse_check({"type": data["check"], "name": name, **options}, column, f"Quality rule {name!r}", data.get("column_type", "string"))
    now = dt.datetime.now(dt.UTC)
    if made.type not in ("whitelist", "blacklist"):
        return lambda mp: made.expression(mp, now, now.date())

    def outside(mp: Any) -> Expr:
        inside = mp.count_values(column, list(made.option("values")))
        count = mp.num_rows() - inside if made.type == "whitelist" else inside
        return count / mp.num_rows() if made.option("return", "count") == "pct" else count

    return outside
