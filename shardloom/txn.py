"""Transactions over stores: local, two-phase over several stores, and sagas with compensations."""

from __future__ import annotations

import enum
import time
from collections.abc import Callable
from typing import TYPE_CHECKING, Any

from shardloom.rw import on_primary
from shardloom.sources.catalog import Change, Conflict, Store, pending

if TYPE_CHECKING:
    from pyspark.sql import DataFrame

    from shardloom.engine import Engine, Result


class State(enum.IntEnum):
    ACTIVE = 0
    PREPARED = 1
    COMMITTED = 2
    ROLLED_BACK = 3
    FAILED = 4


class TransactionError(RuntimeError):
    pass


def new_id() -> str:
    return f"tx_{time.time_ns()}"


class Transaction:
    """Statements write their files at once and are committed together, or discarded. Each sees what those before it did."""

    def __init__(self, engine: Engine):
        self.engine, self.id, self.state = engine, new_id(), State.ACTIVE
        self._changes: list[tuple[Store, Change]] = []

    def _need(self, *states: State) -> None:
        if self.state not in states:
            raise TransactionError(f"{self.id} is {self.state.name.lower()}")

    def execute(self, text: str, *args: Any) -> Result:
        from shardloom.operators import dml

        self._need(State.ACTIVE)
        found: list[tuple[Store, Change]] = []
        with on_primary(), pending(self._changes):
            result = dml.execute(self.engine, text, args, found)
        for store, change in found:
            at = next((i for i, (s, _) in enumerate(self._changes) if s is store), None)
            if at is None:
                self._changes.append((store, change))
            else:
                self._changes[at] = (store, self._changes[at][1].then(change))
        return result

    def sql(self, text: str, *args: Any) -> DataFrame:
        """A query that sees the transaction's own changes."""
        self._need(State.ACTIVE)
        with on_primary(), pending(self._changes):
            return self.engine.sql(text, *args)

    def prepare(self) -> None:
        """Checks that every store is still at the version its change began with."""
        self._need(State.ACTIVE)
        for store, change in self._changes:
            if store.version() != change.base:
                self.rollback()
                self.state = State.FAILED
                raise Conflict(f"{store.table.name} changed during {self.id}")
        self.state = State.PREPARED

    def commit(self) -> None:
        self._need(State.ACTIVE, State.PREPARED)
        with self.engine.metrics.transaction():
            if self.state is State.ACTIVE:
                self.prepare()
            for k, (store, change) in enumerate(self._changes):
                try:
                    store.commit(change)
                except Conflict:
                    # Stores that were committed before it get their old leaves back, so that none keeps half a transaction.
                    for s, c in self._changes[:k]:
                        s.commit(Change(c.base + 1, add=c.drop, drop=c.add))
                    for s, c in self._changes[k:]:
                        s.discard(c)
                    self.state = State.FAILED
                    raise
            self.state = State.COMMITTED

    def rollback(self) -> None:
        self._need(State.ACTIVE, State.PREPARED)
        for store, change in self._changes:
            store.discard(change)
        self.state = State.ROLLED_BACK

    def __enter__(self) -> Transaction:
        return self

    def __exit__(self, kind, value, trace) -> None:
        if self.state in (State.ACTIVE, State.PREPARED):
            self.rollback() if kind else self.commit()


class Saga:
    """Steps with compensations. A step that keeps failing has the steps before it undone, last first."""

    def __init__(self, retries: int = 3, wait: Callable[[int], None] = time.sleep):
        self.id, self.state, self.retries, self._wait = new_id(), State.ACTIVE, retries, wait
        self.steps: list[tuple[Callable[[], Any], Callable[[], Any] | None]] = []

    def add(self, step: Callable[[], Any], undo: Callable[[], Any] | None = None) -> Saga:
        self.steps.append((step, undo))
        return self

    def run(self) -> State:
        if self.state is not State.ACTIVE:
            raise TransactionError(f"{self.id} is {self.state.name.lower()}")
        done: list[Callable[[], Any]] = []
        for step, undo in self.steps:
            for attempt in range(1, self.retries + 1):
                try:
                    step()
                    break
                except Exception:
                    if attempt == self.retries:
                        for back in reversed(done):
                            back()
                        self.state = State.ROLLED_BACK
                        return self.state
                    self._wait(attempt)
            if undo:
                done.append(undo)
        self.state = State.COMMITTED
        return self.state


class Manager:
    """Open transactions by id."""

    def __init__(self, engine: Engine):
        self.engine, self.open = engine, {}

    def begin(self) -> Transaction:
        tx = Transaction(self.engine)
        self.open[tx.id] = tx
        return tx

    def get(self, id: str) -> Transaction:
        return self.open[id]

    def end(self, id: str, commit: bool = True) -> None:
        tx = self.open.pop(id)
        tx.commit() if commit else tx.rollback()
