"""Thresholds with a name, bounds and a history, that can be changed between runs."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass, field
from typing import Any

from probitas.functions.expr import Apply, Expr, TunableRef
from probitas.keys import ProbitasError


@dataclass(frozen=True)
class TunableChange:
    old_value: Any
    new_value: Any
    agent: str
    reason: str | None
    timestamp: dt.datetime = field(default_factory=lambda: dt.datetime.now(dt.UTC))


class Tunable:
    """A named value; every change is checked and kept."""

    def __init__(self, name: str, value: Any):
        if not name or not name.strip():
            raise ValueError("A tunable needs a name")
        self.name = name
        self.validate(value)
        self._value = value
        self.history: list[TunableChange] = [TunableChange(None, value, "system", "initial value")]

    @property
    def value(self) -> Any:
        return self._value

    def validate(self, value: Any) -> None:
        raise NotImplementedError

    def set(self, value: Any, agent="human", reason=None) -> None:
        self.validate(value)
        self.history.append(TunableChange(self._value, value, agent, reason))
        self._value = value

    def describe(self) -> dict[str, Any]:
        return {"name": self.name, "type": type(self).__name__, "value": self._value}


class _Numeric(Tunable):
    def __init__(self, name: str, value: float, bounds: tuple[float, float]):
        low, high = bounds
        if low > high:
            raise ValueError(f"{name}: the lower bound {low} is above the upper bound {high}")
        self.bounds = (low, high)
        super().__init__(name, value)

    def validate(self, value: Any) -> None:
        low, high = self.bounds
        if isinstance(value, bool) or not isinstance(value, int | float):
            raise ValueError(f"{self.name}: {value!r} isn't a number")
        if not low <= value <= high:
            raise ValueError(f"{self.name}: {value} lies outside of [{low}, {high}]")

    def describe(self) -> dict[str, Any]:
        return super().describe() | {"bounds": self.bounds}

    def as_expr(self) -> Expr:
        return TunableRef(self)

    def __add__(self, x): return self.as_expr() + x  # noqa: E704
    def __radd__(self, x): return x + self.as_expr()  # noqa: E704
    def __sub__(self, x): return self.as_expr() - x  # noqa: E704
    def __rsub__(self, x): return Apply("-", x, self)  # noqa: E704
    def __mul__(self, x): return self.as_expr() * x  # noqa: E704
    def __rmul__(self, x): return Apply("*", x, self)  # noqa: E704
    def __truediv__(self, x): return self.as_expr() / x  # noqa: E704
    def __rtruediv__(self, x): return Apply("/", x, self)  # noqa: E704
    def __neg__(self): return -self.as_expr()  # noqa: E704


class TunableFloat(_Numeric):
    pass


class TunableInt(_Numeric):
    def validate(self, value: Any) -> None:
        if isinstance(value, bool) or not isinstance(value, int):
            raise ValueError(f"{self.name}: {value!r} isn't an integer")
        super().validate(value)


class TunableChoice(Tunable):
    def __init__(self, name: str, value: str, choices: tuple[str, ...] | list[str]):
        self.choices = tuple(choices)
        if not self.choices:
            raise ValueError(f"{name}: no choices")
        super().__init__(name, value)

    def validate(self, value: Any) -> None:
        if value not in self.choices:
            raise ValueError(f"{self.name}: {value!r} isn't one of {', '.join(map(str, self.choices))}")

    def describe(self) -> dict[str, Any]:
        return super().describe() | {"choices": self.choices}


def by_name(tunables) -> dict[str, Tunable]:
    """The tunables by name; different ones of one name are refused."""
    out: dict[str, Tunable] = {}
    for t in tunables:
        if out.setdefault(t.name, t) is not t:
            raise ProbitasError(f"Two tunables are named {t.name!r}")
    return out
