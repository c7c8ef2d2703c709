"""Expressions over metrics: arithmetic that is written once and evaluated per run.

Expressions evaluate on the driver, to a value or the reason why there is none, and convert to
a Spark column over columns of metric values.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from probitas.keys import Err, Ok, fail


class Expr:
    """A node of an expression; combine nodes with + - * / ** abs and the functions of this module."""

    op: str = ""
    parts: tuple[Expr, ...] = ()

    def __add__(self, other: Any) -> Expr:
        return Apply("+", self, other)

    def __radd__(self, other: Any) -> Expr:
        return Apply("+", other, self)

    def __sub__(self, other: Any) -> Expr:
        return Apply("-", self, other)

    def __rsub__(self, other: Any) -> Expr:
        return Apply("-", other, self)

    def __mul__(self, other: Any) -> Expr:
        return Apply("*", self, other)

    def __rmul__(self, other: Any) -> Expr:
        return Apply("*", other, self)

    def __truediv__(self, other: Any) -> Expr:
        return Apply("/", self, other)

    def __rtruediv__(self, other: Any) -> Expr:
        return Apply("/", other, self)

    def __pow__(self, other: Any) -> Expr:
        return Apply("**", self, other)

    def __rpow__(self, other: Any) -> Expr:
        return Apply("**", other, self)

    def __neg__(self) -> Expr:
        return Apply("neg", self)

    def __pos__(self) -> Expr:
        return self

    def __abs__(self) -> Expr:
        return Apply("abs", self)

    def __bool__(self) -> bool:
        raise TypeError("An expression has no truth value before it is evaluated; use assert_that(...)")

    def _unordered(self, other: Any) -> bool:
        raise TypeError("Expressions can't be compared before they are evaluated; use assert_that(...)")

    __lt__ = __le__ = __gt__ = __ge__ = _unordered

    def refs(self) -> tuple[Ref, ...]:
        """The metric symbols in it, in order, once each."""
        return tuple(dict.fromkeys(r for p in self.parts for r in p.refs()))

    def tunables(self) -> tuple[TunableRef, ...]:
        return tuple(dict.fromkeys(t for p in self.parts for t in p.tunables()))

    def substitute(self, mapping: dict[Expr, Expr]) -> Expr:
        if self in mapping:
            return mapping[self]
        return Apply(self.op, *(p.substitute(mapping) for p in self.parts)) if self.parts else self

    def evaluate(self, values: dict[str, Ok | Err]) -> Ok | Err:
        """The value, given the outcomes of the symbols by name.

        0 / 0 is 0.  Any other division by zero, infinity, NaN and results that aren't real are
        failures, as are failed symbols, except inside coalesce.
        """
        failed = [r for r in self.needed() if not values[r.name].ok]
        if failed:
            causes = tuple(f for r in failed for f in values[r.name].failures)
            return Err((*fail(f"Failed to evaluate symbol(s): {', '.join(r.name for r in failed)}", str(self)).failures, *causes))
        try:
            result = self.compute({k: v.value if v.ok else None for k, v in values.items()})
        except (ArithmeticError, ValueError, TypeError) as error:
            return fail(f"Error evaluating expression: {error}", str(self))
        if result is None:
            return fail("No argument has a value", str(self))
        if isinstance(result, complex):
            return fail(f"Validating value is complex: {result.real} + {result.imag}i", str(self))
        result = float(result)
        if math.isinf(result):
            return fail("Validating value is infinity", str(self))
        if math.isnan(result):
            return fail("Validating value is NaN", str(self))
        return Ok(result)

    def needed(self) -> tuple[Ref, ...]:
        """The symbols without which there is no value."""
        if self.op == "coalesce":
            return ()
        return tuple(dict.fromkeys(r for p in self.parts for r in p.needed()))

    def compute(self, values: dict[str, float | None]) -> float | complex | None:
        raise NotImplementedError

    def column(self, columns: dict[str, Column]) -> Column:
        """The same as a Spark column, with a column for each symbol; failures are null."""
        raise NotImplementedError


def lift(x: Any) -> Expr:
    if isinstance(x, Expr):
        return x
    if hasattr(x, "as_expr"):
        return x.as_expr()
    if isinstance(x, bool | int | float):
        return Const(x)
    raise TypeError(f"{x!r} can't be part of an expression")


class Const(Expr):
    def __init__(self, value: float):
        self.value = value

    def refs(self) -> tuple[Ref, ...]:
        return ()

    needed = tunables = refs

    def compute(self, values):
        return self.value

    def column(self, columns):
        return F.lit(float(self.value))

    def __str__(self) -> str:
        return str(self.value)


class Ref(Expr):
    """A symbol that stands for a metric of a run."""

    def __init__(self, name: str):
        self.name = name

    def __eq__(self, other: Any) -> bool:
        return isinstance(other, Ref) and other.name == self.name

    def __hash__(self) -> int:
        return hash(self.name)

    def refs(self) -> tuple[Ref, ...]:
        return (self,)

    needed = refs

    def tunables(self) -> tuple[TunableRef, ...]:
        return ()

    def compute(self, values):
        return values[self.name]

    def column(self, columns):
        return columns[self.name]

    def __str__(self) -> str:
        return self.name


class TunableRef(Expr):
    """The value that a tunable has when the expression is evaluated."""

    def __init__(self, tunable: Any):
        self.tunable = tunable

    def refs(self) -> tuple[Ref, ...]:
        return ()

    needed = refs

    def tunables(self) -> tuple[TunableRef, ...]:
        return (self,)

    def compute(self, values):
        return self.tunable.value

    def column(self, columns):
        return F.lit(float(self.tunable.value))

    def __str__(self) -> str:
        return str(self.tunable.value)


def _divide(a, b):
    if b == 0:
        return 0.0 if a == 0 else math.copysign(math.inf, a if not isinstance(a, complex) else 1.0)
    return a / b


def _sqrt(x):
    return complex(0, math.sqrt(-x)) if x < 0 else math.sqrt(x)


_OPERATIONS: dict[str, Callable[..., Any]] = {
    "+": lambda a, b: a + b,
    "-": lambda a, b: a - b,
    "*": lambda a, b: a * b,
    "/": _divide,
    "**": lambda a, b: math.inf if a == 0 and b < 0 else a**b,
    "neg": lambda a: -a,
    "abs": abs,
    "sqrt": _sqrt,
    "exp": math.exp,
    "log": lambda a: complex(math.log(-a), math.pi) if a < 0 else -math.inf if a == 0 else math.log(a),
    "min": min,
    "max": max,
}
_COLUMNS: dict[str, Callable[..., Column]] = {
    "+": lambda a, b: a + b,
    "-": lambda a, b: a - b,
    "*": lambda a, b: a * b,
    "/": lambda a, b: F.when((a == 0) & (b == 0), F.lit(0.0)).otherwise(a / F.nullif(b, F.lit(0.0))),
    "**": F.pow,
    "neg": lambda a: -a,
    "abs": F.abs,
    "sqrt": lambda a: F.when(a >= 0, F.sqrt(a)),
    "exp": F.exp,
    "log": lambda a: F.when(a > 0, F.log(a)),
    "min": F.least,
    "max": F.greatest,
    "coalesce": lambda *a: F.coalesce(*(F.nullif(x, F.lit(float("nan"))) for x in a)),
}


class Apply(Expr):
    def __init__(self, op: str, *parts: Any):
        self.op, self.parts = op, tuple(lift(p) for p in parts)

    def compute(self, values):
        parts = [p.compute(values) for p in self.parts]
        if self.op == "coalesce":
            return next((x for x in parts if x is not None and not (isinstance(x, float) and math.isnan(x))), None)
        if any(x is None for x in parts):
            return None
        return _OPERATIONS[self.op](*parts)

    def column(self, columns):
        return _COLUMNS[self.op](*(p.column(columns) for p in self.parts))

    def __str__(self) -> str:
        if self.op in ("+", "-", "*", "/", "**"):
            return f"({self.parts[0]} {self.op} {self.parts[1]})"
        if self.op == "neg":
            return f"-{self.parts[0]}"
        return f"{self.op}({', '.join(map(str, self.parts))})"


def const(value: float) -> Expr:
    return Const(value)


def sqrt(x: Any) -> Expr:
    return Apply("sqrt", x)


def exp(x: Any) -> Expr:
    return Apply("exp", x)


def log(x: Any) -> Expr:
    return Apply("log", x)


def minimum_of(*xs: Any) -> Expr:
    return Apply("min", *xs)


def maximum_of(*xs: Any) -> Expr:
    return Apply("max", *xs)


def coalesce(*xs: Any) -> Expr:
    """The first argument that has a value; a metric that failed has none."""
    if not xs:
        raise ValueError("coalesce needs an argument")
    return Apply("coalesce", *xs)


def function(name: str, on_numbers: Callable[..., float], on_columns: Callable[..., Column]) -> Callable[..., Expr]:
    """Any other function of expressions: what it does to numbers, and the same as columns.

    ``tanh = function("tanh", math.tanh, F.tanh)`` makes ``tanh(mp.average("x"))``.  An error of
    the function, such as a ValueError, fails the assertion like a division of infinities.
    """
    if name in _OPERATIONS and _OPERATIONS[name] is not on_numbers:
        raise ValueError(f"A function named {name} exists")
    _OPERATIONS[name], _COLUMNS[name] = on_numbers, on_columns
    return lambda *xs: Apply(name, *xs)


def pct(x: float) -> float:
    """x percent as a number: pct(5) is 0.05."""
    return x / 100
