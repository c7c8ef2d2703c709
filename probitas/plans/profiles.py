"""Profiles: rules that change assertions on certain days."""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterable, Sequence
from dataclasses import dataclass, field, replace
from typing import Protocol

from probitas.keys import SEVERITIES


@dataclass(frozen=True)
class Selector:
    """What a rule applies to: a check, an assertion (of a check, if one is given) or a tag."""

    kind: str
    name: str
    within: str | None = None

    def matches(self, check: str, assertion: str, tags: frozenset[str]) -> bool:
        if self.kind == "tag":
            return self.name in tags
        if self.kind == "check":
            return self.name == check
        return self.name == assertion and self.within in (None, check)


@dataclass(frozen=True)
class Rule:
    selector: Selector
    severity: str | None = None
    metric_multiplier: float = 1.0
    disabled: bool = False


@dataclass(frozen=True)
class RuleBuilder:
    selector: Selector

    def disable(self) -> Rule:
        return Rule(self.selector, disabled=True)

    def set(self, *, severity: str | None = None, metric_multiplier: float = 1.0) -> Rule:
        if severity is not None and severity not in SEVERITIES:
            raise ValueError(f"{severity!r} is no severity")
        return Rule(self.selector, metric_multiplier=metric_multiplier, severity=severity)


def check(name: str) -> RuleBuilder:
    return RuleBuilder(Selector("check", name))


def assertion(name: str, within: str | None = None) -> RuleBuilder:
    return RuleBuilder(Selector("assertion", name, within))


def tag(name: str) -> RuleBuilder:
    return RuleBuilder(Selector("tag", name))


class Profile(Protocol):
    name: str
    rules: Sequence[Rule]

    def is_active(self, day: dt.date) -> bool: ...


@dataclass(frozen=True)
class SeasonalProfile:
    """Active from start_date to end_date, both included."""

    name: str
    start_date: dt.date
    end_date: dt.date
    rules: Sequence[Rule] = field(default_factory=tuple)

    def __post_init__(self) -> None:
        if self.start_date > self.end_date:
            raise ValueError(f"Profile {self.name!r} ends before it starts")

    def is_active(self, day: dt.date) -> bool:
        return self.start_date <= day <= self.end_date


@dataclass(frozen=True)
class PermanentProfile:
    """Always active."""

    name: str
    rules: Sequence[Rule] = field(default_factory=tuple)

    def is_active(self, day: dt.date) -> bool:
        return True


@dataclass(frozen=True)
class Overrides:
    disabled: bool = False
    metric_multiplier: float = 1.0
    severity: str | None = None
    profiles: tuple[str, ...] = ()


def overrides(profiles: Iterable[Profile], day: dt.date, check: str, assertion: str, tags: frozenset[str]) -> Overrides:
    """What the active profiles do to an assertion: multipliers compound, the last severity wins."""
    out = Overrides()
    for profile in profiles:
        if not profile.is_active(day):
            continue
        for rule in profile.rules:
            if rule.selector.matches(check, assertion, tags):
                out = replace(
                    out,
                    disabled=out.disabled or rule.disabled,
                    metric_multiplier=out.metric_multiplier * rule.metric_multiplier,
                    severity=rule.severity or out.severity,
                    profiles=tuple(dict.fromkeys((*out.profiles, profile.name))),
                )
    return out
