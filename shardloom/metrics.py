"""Counters, gauges and histograms, and the engine's own set of them, in the text exposition format."""

from __future__ import annotations

import contextlib
import threading
import time
from collections.abc import Iterator

# Upper bounds of duration histograms of queries and of transactions, in seconds.
BOUNDS = (0.001, 0.005, 0.01, 0.05, 0.1, 0.5, 1.0, 5.0)
TRANSACTION_BOUNDS = (0.01, 0.05, 0.1, 0.5, 1.0, 5.0, 10.0)


class Metric:
    kind = "untyped"

    def __init__(self, name: str, labels: dict[str, str] | None = None):
        self.name, self.labels, self._lock = name, dict(sorted((labels or {}).items())), threading.Lock()

    def label_text(self, **more: str) -> str:
        both = {**self.labels, **more}
        return "{" + ",".join(f'{k}="{v}"' for k, v in both.items()) + "}" if both else ""


class Counter(Metric):
    kind = "counter"

    def __init__(self, name, labels=None):
        super().__init__(name, labels)
        self.value = 0.0

    def add(self, n: float = 1.0) -> None:
        with self._lock:
            self.value += n

    def lines(self) -> list[str]:
        return [f"{self.name}{self.label_text()} {self.value:g}"]


class Gauge(Counter):
    kind = "gauge"

    def set(self, value: float) -> None:
        with self._lock:
            self.value = value


class Histogram(Metric):
    """counts hold each bucket by itself (value <= bound), the last what is above all bounds."""

    kind = "histogram"

    def __init__(self, name, labels=None, bounds: tuple[float, ...] = BOUNDS):
        super().__init__(name, labels)
        self.bounds, self.counts, self.sum = bounds, [0] * (len(bounds) + 1), 0.0

    @property
    def count(self) -> int:
        return sum(self.counts)

    def observe(self, value: float) -> None:
        at = next((i for i, b in enumerate(self.bounds) if value <= b), len(self.bounds))
        with self._lock:
            self.counts[at] += 1
            self.sum += value

    def lines(self) -> list[str]:
        out, total = [], 0
        for bound, n in zip((*self.bounds, float("inf")), self.counts):
            total += n
            out.append(f"{self.name}_bucket{self.label_text(le='+Inf' if bound == float('inf') else f'{bound:g}')} {total}")
        return [*out, f"{self.name}_sum{self.label_text()} {self.sum:g}", f"{self.name}_count{self.label_text()} {total}"]


class Collector:
    """Metrics by name and labels; label order doesn't matter."""

    def __init__(self):
        self._found: dict[tuple, Metric] = {}

    def add(self, metric):
        return self._found.setdefault((metric.name, *metric.labels.items()), metric)

    def get(self, name: str, labels: dict[str, str] | None = None) -> Metric | None:
        return self._found.get((name, *sorted((labels or {}).items())))

    def all(self) -> list[Metric]:
        return list(self._found.values())

    def text(self) -> str:
        out: list[str] = []
        for m in self.all():
            out += [f"# TYPE {m.name} {m.kind}", *m.lines()]
        return "\n".join(out) + "\n"


class ShardingMetrics:
    def __init__(self):
        c = self.collector = Collector()
        self.query_total = c.add(Counter("sharding_query_total", {"type": "all"}))
        self.query_duration = c.add(Histogram("sharding_query_duration_seconds"))
        self.query_errors = c.add(Counter("sharding_query_errors_total"))
        self.connections_active = c.add(Gauge("sharding_connections_active"))
        self.connections_total = c.add(Counter("sharding_connections_total"))
        self.routes = c.add(Counter("sharding_routes_total"))
        self.cross_shard = c.add(Counter("sharding_cross_shard_queries_total"))
        self.transaction_total = c.add(Counter("sharding_transaction_total"))
        self.transaction_duration = c.add(Histogram("sharding_transaction_duration_seconds", bounds=TRANSACTION_BOUNDS))
        self.transaction_errors = c.add(Counter("sharding_transaction_errors_total"))

    def route(self, table: str, nodes: int) -> None:
        self.routes.add()
        if nodes > 1:
            self.cross_shard.add()

    @contextlib.contextmanager
    def _timed(self, total: Counter, duration: Histogram, errors: Counter) -> Iterator[None]:
        began = time.perf_counter()
        total.add()
        try:
            yield
        except BaseException:
            errors.add()
            raise
        finally:
            duration.observe(time.perf_counter() - began)

    def query(self):
        return self._timed(self.query_total, self.query_duration, self.query_errors)

    def transaction(self):
        return self._timed(self.transaction_total, self.transaction_duration, self.transaction_errors)

    @contextlib.contextmanager
    def connection(self) -> Iterator[None]:
        self.connections_total.add()
        self.connections_active.add()
        try:
            yield
        finally:
            self.connections_active.add(-1)
