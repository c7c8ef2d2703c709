import datetime as dt
import warnings

import pytest

from probitas.contracts import Contract, ContractValidationError, ContractWarning, OdcsContract, SchemaValidationError
from probitas.contracts.checks import FORMATS
from probitas.contracts.legacy import period_hours, valid_cron
from probitas.keys import ResultKey
from probitas.operators import metrics as M
from probitas.plans.planner import Planner
from probitas.plans.suite import VerificationSuite
from probitas.sources import FrameSource, MemoryStore

D = dt.date(2024, 1, 1)
NOW = dt.datetime(2024, 1, 3, tzinfo=dt.UTC)
HEAD = 'name: c\nversion: "1"\ndescription: d\nowner: o\ndataset: t\n'


def contract(columns, rest=""):
    return Contract.parse(HEAD + rest + "columns:\n" + columns)


def outcome(spark, rows, schema, text, rest=""):
    source = FrameSource(spark.createDataFrame(rows, schema), "t")
    suite = VerificationSuite(contract(text, rest).to_checks(source, now=NOW, day=NOW.date()), MemoryStore(), "s")
    suite.run([source], ResultKey(D))
    return {r.assertion: (r.status, r.metric) for r in suite.collect_results()}


def test_counts_and_shares(spark):
    text = """
  - name: id
    type: int
    checks:
      - {type: duplicates, name: d, max: 0}
      - {type: duplicates, name: dp, return: pct, between: [0.1, 0.3]}
      - {type: whitelist, name: w, values: [1, 2], equals: 3}
      - {type: blacklist, name: b, values: [1], not_between: [4, 5]}
      - {type: cardinality, name: k}
"""
    got = outcome(spark, [(1,), (1,), (2,), (3,), (4,)], "id int", text)
    assert got == {
        "d [max <= 0.0]": ("FAILED", 1.0), "dp [between [0.1, 0.3]]": ("PASSED", 0.2), "w [equals = 3.0]": ("PASSED", 3.0), "b [not_between [4.0, 5.0]]": ("PASSED", 3.0), "k": ("PASSED", 4.0),
    }


def test_nulls_and_empty_tables(spark):
    text = "  - {name: s, type: string, checks: [{type: missing, name: m, return: pct, max: 0.5}, {type: blacklist, name: b, values: [x]}, {type: count, name: c}, {type: duplicates, name: d, return: pct, max: 0}]}\n"
    assert outcome(spark, [("x",), (None,), ("y",)], "s string", text) == {
        "m [max <= 0.5]": ("PASSED", pytest.approx(1 / 3)), "b": ("PASSED", 2.0), "c": ("PASSED", 2.0), "d [max <= 0.0]": ("FAILED", pytest.approx(1 / 3)),
    }
    assert outcome(spark, [], "s string", text)["d [max <= 0.0]"] == ("PASSED", 0.0)


def test_freshness_and_completeness(spark):
    rest = """checks:
  - {type: freshness, name: new, timestamp_column: ts, max_age_hours: 24}
  - {type: freshness, name: old, timestamp_column: ts, aggregation: min, max_age_hours: 72}
  - {type: completeness, name: days, partition_column: ts, lookback_days: 4, max_gap_count: 1}
"""
    rows = [(dt.datetime(2023, 12, 31, 12),), (dt.datetime(2024, 1, 1, 12),), (dt.datetime(2024, 1, 3),)]
    got = outcome(spark, rows, "ts timestamp", "  - {name: ts, type: timestamp}\n", rest)
    assert got == {"new [max <= 24.0]": ("PASSED", 0.0), "old [max <= 72.0]": ("PASSED", 60.0), "days [max <= 1.0]": ("PASSED", 1.0)}


@pytest.mark.parametrize(
    "name, good, bad",
    [("email", "a.b@c.org", "a@b"), ("phone", "+4912345", "0x1"), ("uuid", "550e8400-e29b-41d4-a716-446655440000", "550e8400"), ("url", "https://a.b/c", "ftp://a"), ("ipv4", "1.2.3.4", "1.2.3"), ("ipv6", "1:2:3:4:5:6:7:8", "1::2"), ("date", "2024-01-01", "1.1.2024"), ("datetime", "2024-01-01T00:00:00Z", "2024-01-01 00:00")],
)
def test_formats(spark, name, good, bad):
    source = FrameSource(spark.createDataFrame([(good,), (bad,), (None,)], "s string"), "t")
    m = M.matching_count("s", FORMATS[name])
    assert Planner(source).run([(D, m)])[D, m].value == 1.0


def test_types(spark):
    text = """
  - {name: a, type: int}
  - {name: b, type: {kind: list, value_type: {kind: struct, fields: [{name: x, type: float}, {name: y, type: string}]}}}
  - {name: c, type: {kind: map, key_type: string, value_type: date}}
  - {name: d, type: {kind: timestamp, tz: UTC}}
  - {name: e, type: {kind: timestamp, tz: null}}
  - {name: f, type: timestamp}
"""
    c = contract(text)
    good = "a bigint, b array<struct<x: double, y: string>>, c map<string, date>, d timestamp, e timestamp_ntz, f timestamp_ntz, more int"
    c.check_schema(spark.createDataFrame([], good).schema)
    with pytest.raises(SchemaValidationError) as error:
        c.check_schema(spark.createDataFrame([], "a string, b array<struct<x: int>>, c map<int, date>, d timestamp_ntz, e timestamp").schema)
    for part in ("a: declared int", "b[].x: declared float", "b[].y: missing", "c.key", "d: declared timestamp in UTC", "e: declared timestamp without", "f: missing"):
        assert part in str(error.value)


@pytest.mark.parametrize(
    "text",
    [
        "  - {name: a, type: integer}\n",
        "  - {name: a, type: int}\n  - {name: a, type: int}\n",
        "  - {name: a}\n",
        "  - {name: a, type: {kind: list}}\n",
        "  - {name: a, type: {kind: struct, fields: []}}\n",
        "  - {name: a, type: int, checks: [{type: nothing, name: x}]}\n",
        "  - {name: a, type: int, checks: [{type: min}]}\n",
        "  - {name: a, type: int, checks: [{type: min, name: x, min: 3, max: 1}]}\n",
        "  - {name: a, type: int, checks: [{type: min, name: x, between: [1]}]}\n",
        "  - {name: a, type: int, checks: [{type: min, name: x, between: [3, 1]}]}\n",
        "  - {name: a, type: int, checks: [{type: min, name: x, odd: 1}]}\n",
        "  - {name: a, type: int, checks: [{type: min, name: x, severity: P7}]}\n",
        "  - {name: a, type: int, checks: [{type: whitelist, name: x, values: []}]}\n",
        "  - {name: a, type: int, checks: [{type: whitelist, name: x, values: [1, b]}]}\n",
        "  - {name: a, type: int, checks: [{type: pattern, name: x}]}\n",
        "  - {name: a, type: int, checks: [{type: pattern, name: x, format: zip}]}\n",
        "  - {name: a, type: int, checks: [{type: percentile, name: x, percentile: 95}]}\n",
    ],
)
def test_wrong_columns(text):
    with pytest.raises(ContractValidationError):
        contract(text)


def test_wrong_documents():
    good = "  - {name: a, type: int}\n"
    for rest in ("checks: [{type: duplicates, name: x}]\n", "checks: [{type: duplicates, name: x, columns: [z]}]\n", "sla: {schedule: '0 6 * * *'}\n", "sla: {schedule: '0 6 * * *', lag_hours: 1}\n", "odd: 1\n", "checks: [{type: completeness, name: x, partition_column: a, lookback_days: 0}]\n"):
        with pytest.raises(ContractValidationError):
            contract(good, rest)
    for text in ("[]", "name: x", "a: [", HEAD):
        with pytest.raises(ContractValidationError):
            Contract.parse(text)
    with pytest.raises(ContractValidationError, match="No contract"):
        Contract.from_yaml("/nowhere.yaml")


def test_schedules():
    assert [period_hours(s) for s in ("0 * * * *", "0 6 * * *", "0 */4 * * *", "30 2 * * 1-5", "0 0 * * 3", "0 0 1 * *")] == [1, 24, 4, 24, 168, 720]
    for bad in ("* * * *", "60 * * * *", "0 24 * * *", "0 0 * * 1,3,5 *", "0 0 0 * *", "a * * * *", "*/0 * * * *", "5-1 * * * *"):
        with pytest.raises(ContractValidationError):
            valid_cron(bad)
    with pytest.raises(ContractValidationError, match="period"):
        period_hours("0 0 * * 1,3,5")
    partitioned = contract("  - {name: d, type: date}\n", "metadata: {partitioned_by: [d]}\nsla: {schedule: '0 0 * * *', lag_hours: 24}\n")
    assert dict(partitioned.all_checks()[0].options)["max_age_hours"] == 49
    with pytest.warns(ContractWarning):
        contract("  - {name: d, type: date}\n", "metadata: {timestamp_column: d}\nsla: {schedule: '0 0 * * *', lag_hours: 200}\n")


ODCS = "version: 1.0.0\napiVersion: v3.1.0\nkind: DataContract\nid: x\nstatus: active\n"


def odcs(properties="", rest=""):
    [c] = OdcsContract.parse(ODCS + rest + "schema:\n  - name: t\n    properties:\n" + properties)
    return c


def test_odcs_rules_are_skipped_with_warnings():
    text = """
      - name: a
        logicalType: string
        quality:
          - {name: q, type: sql, query: select 1, mustBe: 0}
          - {name: s, type: custom, engine: soda, implementation: x}
          - {name: u, metric: unheardOf, mustBe: 0}
          - {name: t, type: text, description: words}
"""
    with pytest.warns(ContractWarning) as seen:
        c = odcs(text)
    assert len(seen) == 3 and c.rules == () and [r["name"] for r in c.text_rules] == ["t"]


def test_odcs_latency_and_types(spark):
    c = odcs("      - {name: ts, physicalName: t_s, logicalType: timestamp, partitioned: true, partitionKeyPosition: 1, required: true}\n", "slaProperties: [{property: latency, value: 2, unit: d}, {property: retention, value: 3}]\n")
    assert (c.latency.hours, c.latency.column, c.sla_metadata) == (48, "t_s", {"retention": {"value": 3}})
    source = FrameSource(spark.createDataFrame([(dt.datetime(2024, 1, 1),), (None,)], "t_s timestamp"), "t")
    suite = VerificationSuite(c.to_checks(source, now=NOW), MemoryStore(), "s")
    suite.run([source], ResultKey(D))
    assert {r.assertion: (r.status, r.severity) for r in suite.collect_results()} == {"t_s is required": ("FAILED", "P0"), "SLA: Freshness check": ("PASSED", "P0")}
    with pytest.raises(SchemaValidationError):
        c.check_schema(spark.createDataFrame([], "t_s string").schema)
    with pytest.warns(ContractWarning, match="no timestamp column"):
        assert odcs("      - {name: a}\n", "slaProperties: [{property: ly, value: 2, unit: y}]\n").latency is None
    nested = odcs("      - {name: a, logicalType: array, items: {logicalType: object, properties: [{name: x, logicalType: integer}]}}\n")
    nested.check_schema(spark.createDataFrame([], "a array<struct<x: int>>").schema)


def test_wrong_odcs():
    for key in ("version", "apiVersion", "kind", "id", "status"):
        with pytest.raises(ContractValidationError, match=f"'{key}' is a required property"):
            OdcsContract.parse("\n".join(line for line in ODCS.splitlines() if not line.startswith(f"{key}:")))
    for text in ("      - {name: a, logicalType: uuid}\n", "      - {name: a, quality: [{name: q, metric: nullValues, mustBeBetween: 100}]}\n", "      - {name: a, quality: [{name: q, metric: nullValues, mustBe: x}]}\n", "      - {name: a, quality: [{name: q, metric: nullValues, mustBe: 1, mustNotBe: 2}]}\n", "      - {logicalType: string}\n"):
        with pytest.raises(ContractValidationError):
            odcs(text)
    with warnings.catch_warnings():
        warnings.simplefilter("error")
        assert odcs("      - {name: a}\n").rules == ()


def test_approximate_metrics(spark):
    text = """
  - name: id
    type: int
    checks:
      - {type: cardinality, name: k, approximate: true, between: [90, 110]}
      - {type: percentile, name: p, percentile: 0.5, approximate: true, between: [45, 55]}
      - {type: percentile, name: q, percentile: 0.5, equals: 49.5}
"""
    got = outcome(spark, [(k,) for k in range(100)], "id int", text)
    assert {s for s, _ in got.values()} == {"PASSED"} and len(got) == 3
    with pytest.raises(ContractValidationError, match="approximate"):
        contract(text.replace("approximate: true", "approximate: 1"))
