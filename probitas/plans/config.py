"""Tunables and profiles from a YAML file."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass
from pathlib import Path
from typing import Any

import yaml

from probitas.keys import ProbitasError

from . import profiles as P
from .tunables import Tunable


@dataclass(frozen=True)
class Config:
    tunables: dict[str, Any]
    profiles: tuple[P.Profile, ...]

    def apply(self, tunables: dict[str, Tunable]) -> None:
        """Set the tunables; a name that no check uses is an error."""
        unknown = sorted(set(self.tunables) - set(tunables))
        if unknown:
            raise ProbitasError(f"Configuration of unknown tunables: {', '.join(unknown)}")
        for name, value in self.tunables.items():
            tunables[name].set(value, agent="config")


def _only(data: dict, allowed: set[str], where: str) -> None:
    if not isinstance(data, dict):
        raise ProbitasError(f"{where} must be a mapping")
    if unknown := sorted(set(data) - allowed):
        raise ProbitasError(f"{where}: unknown field(s) {', '.join(map(str, unknown))}")


def _day(value: Any, where: str) -> dt.date:
    if isinstance(value, dt.datetime):
        return value.date()
    if isinstance(value, dt.date):
        return value
    try:
        return dt.date.fromisoformat(str(value))
    except ValueError:
        raise ProbitasError(f"{where}: {value!r} is no date") from None


def _rule(data: dict, where: str) -> P.Rule:
    """action: disable, or set with metric_multiplier and severity; target: one of check, assertion, tag."""
    _only(data, {"check", "assertion", "tag", "within", "disable", "action", "metric_multiplier", "severity"}, where)
    targets = [k for k in ("check", "assertion", "tag") if k in data]
    if len(targets) != 1 and not (set(targets) == {"check", "assertion"}):
        raise ProbitasError(f"{where}: a rule has one of check, assertion and tag")
    if "assertion" in data:
        builder = P.assertion(data["assertion"], data.get("within") or data.get("check"))
    else:
        builder = {"check": P.check, "tag": P.tag}[targets[0]](data[targets[0]])
    if data.get("disable") or data.get("action") == "disable":
        return builder.disable()
    multiplier = data.get("metric_multiplier", 1.0)
    if isinstance(multiplier, bool) or not isinstance(multiplier, int | float):
        raise ProbitasError(f"{where}: metric_multiplier must be a number")
    try:
        return builder.set(metric_multiplier=float(multiplier), severity=data.get("severity"))
    except ValueError as error:
        raise ProbitasError(f"{where}: {error}") from None


def _profile(data: dict, k: int) -> P.Profile:
    where = f"Profile {data.get('name', k + 1)}" if isinstance(data, dict) else f"Profile {k + 1}"
    _only(data, set("name type rules start_date end_date".split()), where)
    if not data.get("name"):
        raise ProbitasError(f"{where} has no name")
    rules = tuple(_rule(r, f"{where}, rule {i + 1}") for i, r in enumerate(data.get("rules") or ()))
    kind = data.get("type", "seasonal")
    if kind == "permanent":
        return P.PermanentProfile(data["name"], rules)
    if kind != "seasonal":
        raise ProbitasError(f"{where}: unknown type {kind!r}")
    if "start_date" not in data or "end_date" not in data:
        raise ProbitasError(f"{where} needs start_date and end_date")
    try:
        return P.SeasonalProfile(data["name"], _day(data["start_date"], where), _day(data["end_date"], where), rules)
    except ValueError as error:
        raise ProbitasError(str(error)) from None


def parse(text: str) -> Config:
    try:
        data = yaml.safe_load(text)
    except yaml.YAMLError as error:
        raise ProbitasError(f"No valid YAML: {error}") from None
    _only(data, {"tunables", "profiles"}, "Configuration")
    if "tunables" not in data:
        raise ProbitasError("Configuration has no tunables")
    tunables = data["tunables"] or {}
    if not isinstance(tunables, dict):
        raise ProbitasError("tunables must be a mapping")
    found = tuple(_profile(p, k) for k, p in enumerate(data.get("profiles") or ()))
    if len({p.name for p in found}) < len(found):
        raise ProbitasError("Two profiles have one name")
    return Config(tunables, found)


def load(path: str | Path) -> Config:
    path = Path(path)
    if not path.exists():
        raise ProbitasError(f"No configuration at {path}")
    return parse(path.read_text())
