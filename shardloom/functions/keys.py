"""Key generation, one at a time on the driver and as Columns over a DataFrame."""

from __future__ import annotations

import threading
import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Layout of a snowflake id. 2020-01-01 00:00:00 UTC in milliseconds; bits of worker, data centre and sequence.
EPOCH_MS = 1_577_836_800_000
WORKER_BITS, CENTRE_BITS, SEQUENCE_BITS = 5, 5, 12
_TIME_SHIFT, _CENTRE_SHIFT, _WORKER_SHIFT = WORKER_BITS + CENTRE_BITS + SEQUENCE_BITS, WORKER_BITS + SEQUENCE_BITS, SEQUENCE_BITS


class ClockMovedBack(RuntimeError):
    pass


class Generator:
    def next(self) -> int:
        raise NotImplementedError


class Snowflake(Generator):
    def __init__(self, worker: int = 0, centre: int = 0, clock: Callable[[], int] | None = None):
        if not 0 <= worker < 1 << WORKER_BITS:
            raise ValueError("worker must be between 0 and 31")
        if not 0 <= centre < 1 << CENTRE_BITS:
            raise ValueError("data centre must be between 0 and 31")
        self.worker, self.centre, self._clock = worker, centre, clock or (lambda: time.time_ns() // 1_000_000)
        self._lock, self._last, self._sequence = threading.Lock(), -1, 0

    def next(self) -> int:
        with self._lock:
            now = self._clock()
            if now < self._last:
                raise ClockMovedBack(f"clock moved back by {self._last - now} ms")
            self._sequence = (self._sequence + 1) % (1 << SEQUENCE_BITS) if now == self._last else 0
            if now == self._last and not self._sequence:
                while now <= self._last:
                    now = self._clock()
            self._last = now
            return compose(now, self.centre, self.worker, self._sequence)


def compose(ms: int, centre: int, worker: int, sequence: int) -> int:
    return (ms - EPOCH_MS) << _TIME_SHIFT | centre << _CENTRE_SHIFT | worker << _WORKER_SHIFT | sequence


def fields(key: int) -> dict[str, int]:
    return {
        "ms": (key >> _TIME_SHIFT) + EPOCH_MS,
        "centre": key >> _CENTRE_SHIFT & 31,
        "worker": key >> _WORKER_SHIFT & 31,
        "sequence": key & 4095,
    }


class Uuid(Generator):
    """The first eight characters of a random UUID, as bytes of a 64-bit integer."""

    def next(self) -> int:
        return int.from_bytes(str(uuid.uuid4())[:8].encode(), "big")


class Increment(Generator):
    """The first key is start + step."""

    def __init__(self, start: int = 0, step: int = 1):
        self._value, self.step, self._lock = start, step, threading.Lock()

    def next(self) -> int:
        with self._lock:
            self._value += self.step
            return self._value


_MAKERS: dict[str, Callable[..., Generator]] = {"snowflake": Snowflake, "uuid": Uuid, "increment": Increment}
_NAMED: dict[str, Generator] = {}


def generator(kind: str, **options: int) -> Generator:
    """A new generator; other spellings of the options are accepted."""
    names = {"workerId": "worker", "workerID": "worker", "node_id": "worker", "datacenterId": "centre", "datacenterID": "centre"}
    try:
        make = _MAKERS[kind.lower()]
    except KeyError:
        raise ValueError(f"unsupported key generator: {kind}") from None
    return make(**{names.get(k, k): v for k, v in options.items()})


def register(name: str, made: Generator) -> None:
    _NAMED[name] = made


def named(name: str = "default") -> Generator:
    if name == "default":
        _NAMED.setdefault(name, Snowflake(1, 1))
    return _NAMED[name]


def with_snowflake(df: DataFrame, column: str, now_ms: int | None = None, worker: int | None = None, centre: int = 0) -> DataFrame:
    """df with distinct snowflake ids, without a shuffle. Time runs ahead by one millisecond for every 4,096 rows.

    Without a worker, partition and place in it make worker, centre and sequence, and time also runs ahead by a lane for
    every 1,024 partitions. With one, rows are numbered over all partitions (with_increment) and all have that worker.
    Ids depend on the partitioning: write the rows before the ids are used twice.
    """
    ms = now_ms if now_ms is not None else time.time_ns() // 1_000_000
    if worker is not None:
        number = F.col(column) - 1
        at = F.lit(ms - EPOCH_MS) + F.shiftright(number, SEQUENCE_BITS)
        key = F.shiftleft(at, _TIME_SHIFT) + F.lit(centre << _CENTRE_SHIFT | worker << _WORKER_SHIFT) + number % (1 << SEQUENCE_BITS)
        return with_increment(df, column).withColumn(column, key.cast("bigint"))
    row = F.monotonically_increasing_id()
    part, place = F.shiftright(row, 33), row.bitwiseAND(F.lit((1 << 33) - 1))
    lane = part % 1024
    # Partitions that share a lane take turns of 2^20 ms, enough for 2^32 rows each.
    at = F.lit(ms - EPOCH_MS) + F.shiftright(place, SEQUENCE_BITS) + F.shiftleft(F.call_function("div", part, F.lit(1024)), 20)
    key = F.shiftleft(at, _TIME_SHIFT) + F.shiftleft(lane, _WORKER_SHIFT) + place % (1 << SEQUENCE_BITS)
    return df.withColumn(column, key.cast("bigint"))


def with_uuid(df: DataFrame, column: str) -> DataFrame:
    """df with keys as Uuid makes them. They have 32 random bits, so in large tables some repeat, by their definition."""
    return df.withColumn(column, F.conv(F.hex(F.substring(F.expr("uuid()"), 1, 8)), 16, 10).cast("bigint"))


class TableKeys:
    """Keys of one table's rule that never repeat: each statement starts above the table's highest key so far."""

    def __init__(self, kind: str, options: dict[str, int], high: int | None):
        self.kind, self.high = kind.lower(), high
        made = generator(kind, **options)  # checks the options
        if isinstance(made, Snowflake):
            self._worker, self._centre = made.worker, made.centre
            self._own = any(k.lower().startswith(("worker", "node", "datacenter", "centre")) for k in options)
            self._start = max(time.time_ns() // 1_000_000, -1 if high is None else high + 1)
        elif isinstance(made, Increment):
            self._start, self._step = made._value if high is None else high, made.step
        self._made = made

    def some(self, n: int) -> list[int]:
        if isinstance(self._made, Snowflake):
            return [compose(self._start + (i >> SEQUENCE_BITS), self._centre, self._worker, i & (1 << SEQUENCE_BITS) - 1) for i in range(n)]
        if isinstance(self._made, Increment):
            return [self._start + self._step * (i + 1) for i in range(n)]
        return [self._made.next() for _ in range(n)]

    def column(self, df: DataFrame, name: str) -> DataFrame:
        if isinstance(self._made, Snowflake):
            return with_snowflake(df, name, self._start, self._worker if self._own else None, self._centre)
        if isinstance(self._made, Increment):
            return with_increment(df, name, self._start, self._step)
        return with_uuid(df, name)

    def highest(self, keys: DataFrame, name: str) -> int | None:
        """What the next statement must start above, from the rows that this one wrote."""
        if isinstance(self._made, Uuid):
            return self.high
        top = keys.agg((F.max if not isinstance(self._made, Increment) or self._step > 0 else F.min)(name)).first()[0]
        if top is None:
            return self.high
        return fields(top)["ms"] if isinstance(self._made, Snowflake) else top


def with_increment(df: DataFrame, column: str, start: int = 0, step: int = 1) -> DataFrame:
    """df with start + step, start + 2 * step, ...: partition sizes are counted first, so rows stay where they are."""
    numbered = df.withColumn("__row", F.monotonically_increasing_id())
    sizes = dict(numbered.groupBy(F.shiftright("__row", 33).alias("p")).count().collect())
    begin, total = {}, 0
    for p in sorted(sizes):
        begin[p], total = total, total + sizes[p]
    offset = F.create_map(*[x for p, b in begin.items() for x in (F.lit(p), F.lit(b).cast("bigint"))]) if begin else F.lit(None)
    place = F.col("__row").bitwiseAND(F.lit((1 << 33) - 1)) + (F.element_at(offset, F.shiftright("__row", 33)) if begin else F.lit(0))
    return numbered.withColumn(column, (place + 1) * step + start).drop("__row")
