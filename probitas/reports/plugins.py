"""Plugins that run after a suite.

A plugin has ``metadata()`` and ``process(context)``.  Each has a time limit, at which it is
interrupted by a signal; where signals can't be had, outside the main thread, it runs in a
thread that is left behind.  What goes wrong in one is logged and touches neither the suite nor
other plugins.
"""

from __future__ import annotations

import importlib
import logging
import operator
import signal
import threading
import time
from collections import Counter
from collections.abc import Callable, Iterable
from dataclasses import dataclass
from typing import Any, Protocol

log = logging.getLogger("probitas")
TIME_LIMIT = 60.0


@dataclass(frozen=True)
class PluginMetadata:
    name: str
    version: str = "0"
    author: str = ""
    description: str = ""


@dataclass(frozen=True)
class PluginContext:
    """What a plugin sees of a run."""

    suite_name: str
    datasources: tuple[str, ...]
    key: Any
    timestamp: float
    duration_ms: float
    results: tuple[Any, ...]
    symbols: tuple[Any, ...]

    def by_status(self) -> dict[str, int]:
        return dict(Counter(map(operator.attrgetter("status"), self.results)))

    def failures_by_severity(self) -> dict[str, int]:
        failed = [r for r in self.results if r.status == "FAILED"]
        return dict(Counter(map(operator.attrgetter("severity"), failed)))

    def pass_rate(self) -> float:
        """Passed among those that were evaluated; 1 if none was."""
        done = [r for r in self.results if r.status != "SKIPPED"]
        return sum(r.status == "PASSED" for r in done) / len(done) if done else 1.0


class Plugin(Protocol):
    @staticmethod
    def metadata() -> PluginMetadata: ...

    def process(self, context: PluginContext) -> None: ...


class AuditPlugin:
    """Logs a summary of the run."""

    @staticmethod
    def metadata() -> PluginMetadata:
        return PluginMetadata("audit", "1", description="Summary of a run")

    def report(self, context: PluginContext) -> str:
        counts = context.by_status()
        parts = [f"{counts.get(s, 0)} {s.lower()}" for s in ("PASSED", "FAILED", "SKIPPED", "ERROR")]
        failed = ", ".join(f"{k}: {n}" for k, n in sorted(context.failures_by_severity().items()))
        lines = [f"Suite {context.suite_name} on {context.key.yyyy_mm_dd} over {', '.join(context.datasources)}", f"{len(context.results)} assertions: {', '.join(parts)}"]
        if failed:
            lines.append(f"Failures by severity: {failed}")
        lines.append(f"Pass rate {context.pass_rate():.1%}, {len(context.symbols)} symbols, {context.duration_ms:.0f} ms")
        return "\n".join(lines)

    def process(self, context: PluginContext) -> None:
        log.info(self.report(context))


class _TimeIsUp(BaseException):
    """Not an Exception, so that a plugin's own handlers don't take it."""


def _interrupted(work: Callable[[], None], seconds: float) -> None:
    """Run ``work`` in the main thread, and interrupt it after so many seconds."""

    def ring(signum: int, frame: Any) -> None:
        raise _TimeIsUp

    before = signal.signal(signal.SIGALRM, ring)
    try:
        signal.setitimer(signal.ITIMER_REAL, seconds)
        work()
        signal.setitimer(signal.ITIMER_REAL, 0)
    except _TimeIsUp:  # it rang just after the end
        pass
    finally:
        signal.setitimer(signal.ITIMER_REAL, 0)
        signal.signal(signal.SIGALRM, before)


class PluginManager:
    def __init__(self, plugins: Iterable[Any] = (), time_limit: float = TIME_LIMIT):
        self.time_limit = time_limit
        self.plugins: dict[str, Any] = {}
        for p in plugins:
            self.register(p)

    def register(self, plugin: Any) -> None:
        """Add a plugin: an instance, a class, or the path of a class, module.Class."""
        if isinstance(plugin, str):
            module, _, name = plugin.rpartition(".")
            if not module:
                raise ValueError(f"{plugin!r} is no path of a class")
            plugin = getattr(importlib.import_module(module), name)
        if isinstance(plugin, type):
            plugin = plugin()
        if not callable(getattr(plugin, "process", None)) or not callable(getattr(plugin, "metadata", None)):
            raise ValueError(f"{plugin!r} is no plugin: it needs metadata() and process(context)")
        self.plugins[plugin.metadata().name] = plugin

    def unregister(self, name: str) -> None:
        self.plugins.pop(name, None)

    def clear(self) -> None:
        self.plugins.clear()

    def process_all(self, suite: Any, datasources: Iterable[Any]) -> dict[str, str]:
        """Run the plugins; the result has what became of each: ok, time limit, or the error."""
        if not self.plugins:
            return {}
        context = PluginContext(
            suite.name, tuple(s.name for s in datasources), suite.key, time.time(), suite.analysis_ms or 0.0, tuple(suite.collect_results()), tuple(suite.collect_symbols())
        )
        return {name: self._run(name, plugin, context) for name, plugin in self.plugins.items()}

    def _run(self, name: str, plugin: Any, context: PluginContext) -> str:
        outcome = ["time limit"]

        def work() -> None:
            try:
                plugin.process(context)
                outcome[0] = "ok"
            except _TimeIsUp:
                pass
            except Exception as error:  # a plugin must not stop the suite
                outcome[0] = f"{type(error).__name__}: {error}"

        if threading.current_thread() is threading.main_thread() and hasattr(signal, "setitimer"):
            _interrupted(work, self.time_limit)
        else:
            thread = threading.Thread(target=work, daemon=True, name=f"plugin-{name}")
            thread.start()
            thread.join(self.time_limit)
        if outcome[0] != "ok":
            log.error("Plugin %s: %s", name, outcome[0])
        return outcome[0]
