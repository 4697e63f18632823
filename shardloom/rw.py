"""Read/write splitting: writes go to the primary, reads to a replica."""

from __future__ import annotations

import contextlib
import contextvars
import random
import threading
from collections.abc import Iterator

from shardloom.config import ReadWriteSplit
from shardloom.functions.algorithms import hints

# Leading words of statements that write.
WRITE_WORDS = ("INSERT", "UPDATE", "DELETE", "CREATE", "DROP", "ALTER", "TRUNCATE", "REPLACE", "MERGE", "CALL", "EXEC")
_PRIMARY: contextvars.ContextVar[bool] = contextvars.ContextVar("primary", default=False)


def is_write(sql: str) -> bool:
    return sql.strip().upper().startswith(WRITE_WORDS)


@contextlib.contextmanager
def on_primary() -> Iterator[None]:
    """Within the block (a transaction, or a forced read) everything goes to the primary."""
    token = _PRIMARY.set(True)
    try:
        yield
    finally:
        _PRIMARY.reset(token)


class Splitter:
    def __init__(self, config: ReadWriteSplit, seed: int | None = None):
        if not config.master_data_source:
            raise ValueError("a read/write split needs a primary")
        self.config, self._lock, self._next, self._random = config, threading.Lock(), 0, random.Random(seed)
        weights = config.weights or [1] * len(config.slave_data_sources)
        if len(weights) != len(config.slave_data_sources) or any(w < 0 for w in weights):
            raise ValueError("one weight of 0 or more for each replica")
        self._current = [0] * len(weights)
        self._weights = weights

    def route(self, sql: str) -> str:
        if is_write(sql) or _PRIMARY.get() or hints().master_only or not self.config.slave_data_sources:
            return self.config.master_data_source
        return self.replica()

    def replica(self) -> str:
        replicas = self.config.slave_data_sources
        if len(replicas) == 1:
            return replicas[0]
        kind = self.config.load_balance_algorithm
        if kind == "random":
            return self._random.choice(replicas)
        with self._lock:
            if kind == "weight" and sum(self._weights):  # smooth: each gains its weight, the largest pays the sum
                self._current = [c + w for c, w in zip(self._current, self._weights)]
                at = max(range(len(replicas)), key=lambda i: (self._current[i], -i))
                self._current[at] -= sum(self._weights)
                return replicas[at]
            found = replicas[self._next]
            self._next = (self._next + 1) % len(replicas)
            return found
