"""Keys, errors and outcomes that all parts share."""

from __future__ import annotations

import datetime as dt
import re
from dataclasses import dataclass, field
from typing import Generic, TypeVar

T = TypeVar("T")

_TAG = re.compile(r"[A-Za-z0-9_-]+\Z")
SEVERITIES = tuple(f"P{level}" for level in range(4))
Days = tuple[dt.date, dt.date]


class ProbitasError(Exception):
    """Anything this library refuses."""


@dataclass(frozen=True)
class ResultKey:
    """The day and the tags that results are filed under."""

    yyyy_mm_dd: dt.date = field(default_factory=dt.date.today)
    tags: dict[str, str] = field(default_factory=dict)

    def lag(self, days: int) -> ResultKey:
        return ResultKey(self.yyyy_mm_dd - dt.timedelta(days=days), self.tags)

    def range(self, lag: int, window: int) -> Days:
        """First and last day of the ``window`` days that end ``lag`` days before."""
        last = self.yyyy_mm_dd - dt.timedelta(days=lag)
        return last - dt.timedelta(days=window - 1), last

    def __hash__(self) -> int:
        return hash((self.yyyy_mm_dd, tuple(sorted(self.tags.items()))))


@dataclass(frozen=True)
class Ok(Generic[T]):
    value: T

    @property
    def ok(self) -> bool:
        return True


@dataclass(frozen=True)
class Err:
    failures: tuple[EvaluationFailure, ...]

    @property
    def ok(self) -> bool:
        return False

    def __str__(self) -> str:
        return "; ".join(f.error for f in self.failures)


@dataclass(frozen=True)
class SymbolInfo:
    """What a symbol of an expression stands for and what became of it."""

    name: str
    metric: str
    dataset: str | None
    value: Ok | Err
    yyyy_mm_dd: dt.date | None = None
    tags: dict[str, str] = field(default_factory=dict)


@dataclass(frozen=True)
class EvaluationFailure:
    error: str
    expression: str = ""
    symbols: tuple[SymbolInfo, ...] = ()


def fail(error: str, expression: str = "", symbols: tuple[SymbolInfo, ...] = ()) -> Err:
    return Err((EvaluationFailure(error, expression, symbols),))


def valid_tags(tags) -> frozenset[str]:
    """The tags as a set; each must be letters, digits, _ and - only."""
    tags = frozenset(tags or ())
    for tag in tags:
        if not isinstance(tag, str) or not _TAG.match(tag):
            raise ValueError(f"Invalid tag {tag!r}: only letters, digits, '_' and '-' are allowed")
    return tags


def freeze(value):
    """A hashable value that equals for equal input, also for nested lists and dicts."""
    if isinstance(value, dict):
        return tuple(sorted((k, freeze(v)) for k, v in value.items()))
    if isinstance(value, list | tuple):
        return tuple(freeze(v) for v in value)
    if isinstance(value, set | frozenset):
        return tuple(sorted(freeze(v) for v in value))
    return value
