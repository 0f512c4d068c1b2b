"""Counters, gauges and histograms of a driver, with hooks that export them.

Values of data belong in aggregates (``operators.aggregate``); these are for the engine's own events.
"""

from __future__ import annotations

import math
import threading
from collections.abc import Callable


class Counter:
    def __init__(self) -> None:
        self._lock, self.value = threading.Lock(), 0

    def add(self, n: int = 1) -> None:
        with self._lock:
            self.value += n


class Gauge:
    """The last value that was set."""

    def __init__(self) -> None:
        self.value = 0.0

    def set(self, value: float) -> None:
        self.value = float(value)


class Histogram:
    """The last ``keep`` values, with their statistics; a percentile is the value at place floor(p * (n - 1))."""

    def __init__(self, keep: int = 10_000) -> None:
        self._lock, self._keep, self._values, self._at = threading.Lock(), keep, [], 0
        self.count, self.total = 0, 0.0

    def observe(self, value: float) -> None:
        with self._lock:
            self.count += 1
            self.total += value
            if len(self._values) < self._keep:
                self._values.append(value)
            else:
                self._values[self._at] = value
                self._at = (self._at + 1) % self._keep

    def summary(self) -> dict[str, float]:
        with self._lock:
            held = sorted(self._values)
            if not held:
                return {"count": 0}
            place = lambda p: held[math.floor(p * (len(held) - 1))]
            return {"count": self.count, "sum": self.total, "mean": self.total / self.count, "min": held[0], "max": held[-1], "p50": place(0.5), "p95": place(0.95), "p99": place(0.99)}


class Metrics:
    """Named instruments, each made on first use."""

    def __init__(self) -> None:
        self._lock, self._found, self._hooks = threading.Lock(), {}, []

    def _of(self, kind: type, name: str):
        with self._lock:
            found = self._found.setdefault(name, kind())
        if not isinstance(found, kind):
            raise ValueError(f"{name} is a {type(found).__name__}")
        return found

    def counter(self, name: str) -> Counter:
        return self._of(Counter, name)

    def gauge(self, name: str) -> Gauge:
        return self._of(Gauge, name)

    def histogram(self, name: str) -> Histogram:
        return self._of(Histogram, name)

    def values(self) -> dict[str, object]:
        return {n: m.summary() if isinstance(m, Histogram) else m.value for n, m in sorted(self._found.items())}

    def on_export(self, hook: Callable[[dict[str, object]], None]) -> None:
        self._hooks.append(hook)

    def export(self) -> dict[str, object]:
        """Hands all values to the hooks."""
        values = self.values()
        for hook in self._hooks:
            hook(values)
        return values


metrics = Metrics()
