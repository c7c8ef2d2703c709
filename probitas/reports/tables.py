"""Tables of text for consoles and logs."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from typing import Any

from .trace import analysis_table, metrics_table


def render(header: Sequence[str], rows: Iterable[Sequence[Any]], title: str = "") -> str:
    """A table with a column as wide as its longest cell."""
    cells = [[_text(c) for c in row] for row in rows]
    widths = [max([len(h), *(len(r[k]) for r in cells)]) for k, h in enumerate(header)]
    line = lambda row: " | ".join(c.ljust(w) for c, w in zip(row, widths, strict=True)).rstrip()
    out = [title] if title else []
    return "\n".join([*out, line(header), "-+-".join("-" * w for w in widths), *map(line, cells)])


def _text(x: Any) -> str:
    if x is None:
        return "-"
    if isinstance(x, float):
        return f"{x:.6g}"
    return str(x)


def assertion_table(results: Iterable[Any]) -> str:
    return render(
        ("Date", "Check", "Assertion", "Expression", "Severity", "Status", "Value", "Reason"),
        [(r.yyyy_mm_dd, r.check, r.assertion, r.expression, r.severity, r.status, r.metric, r.reason) for r in results],
        "Assertion results",
    )


def symbol_table(symbols: Iterable[Any]) -> str:
    return render(
        ("Symbol", "Metric", "Dataset", "Date", "Value", "Error"),
        [(s.name, s.metric, s.dataset, s.yyyy_mm_dd, s.value.value if s.value.ok else None, None if s.value.ok else str(s.value)) for s in symbols],
        "Symbols",
    )


def _of_arrow(table: Any, title: str) -> str:
    return render([n.capitalize() for n in table.column_names], zip(*(c.to_pylist() for c in table.columns), strict=True), title)


def analysis_report(suite: Any) -> str:
    """What the analysis of a run computed."""
    return _of_arrow(analysis_table(suite), "Analysis report")


def metrics_report(rows: list[Any], execution_id: str) -> str:
    """The stored metrics of one execution."""
    return _of_arrow(metrics_table([r for r in rows if r.execution_id == execution_id]), f"Metrics for execution: {execution_id}")


def graph(suite: Any) -> str:
    """The suite as a tree of checks, their assertions and the symbols these need."""
    lines = [f"Suite {suite.name}"]
    for check in suite._checks:
        lines.append(f"  Check {check.name}" + (f" ({', '.join(check.datasets)})" if check.datasets else ""))
        for a in check.assertions:
            lines.append(f"    {a.name} [{a.severity}]: {a.shown()}")
            for r in a.expr.refs():
                s = suite.provider.symbols[r.name]
                lines.append(f"      {r.name} = {s.spec.name}" + (f", {s.lag} days before" if s.lag else "") + (f" of {s.dataset}" if s.dataset else ""))
    return "\n".join(lines)


def print_analysis_report(suite: Any) -> None:
    print(analysis_report(suite))


def print_metrics_by_execution_id(rows: list[Any], execution_id: str) -> None:
    print(metrics_report(rows, execution_id))


def print_graph(suite: Any) -> None:
    print(graph(suite))


def trace_table(trace: Any, threshold: float | None = None) -> str:
    columns = "date metric symbol type dataset value_db value_analysis value_final error tags data_av_ratio".split()
    rows = trace.orderBy("date", "metric", "symbol").collect()
    marked = [[f"{r[c]:.2f} low" if c == "data_av_ratio" and r[c] is not None and threshold is not None and r[c] < threshold else r[c] for c in columns] for r in rows]
    return render(columns, marked, "Metric trace")


def print_assertion_results(results: Iterable[Any]) -> None:
    print(assertion_table(results))


def print_symbols(symbols: Iterable[Any]) -> None:
    print(symbol_table(symbols))


def print_metric_trace(trace: Any, threshold: float | None = None) -> None:
    print(trace_table(trace, threshold))
