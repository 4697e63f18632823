"""Sharding algorithms. Each has a scalar form (routing) and a Column form (writing), which agree on every key."""

from __future__ import annotations

import ast
import contextlib
import contextvars
import re
import zlib
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F


class RouteError(ValueError):
    """A key or a rule that leads nowhere."""


@dataclass(frozen=True)
class Eq:
    value: Any


@dataclass(frozen=True)
class In:
    values: tuple


@dataclass(frozen=True)
class Between:
    """Inclusive; None is open."""

    low: Any
    high: Any


Condition = Eq | In | Between


def to_int(value: Any) -> int:
    """Integers and strings of digits; floats, signed or empty strings and None are refused."""
    if isinstance(value, bool) or not isinstance(value, int):
        if isinstance(value, str) and re.fullmatch(r"[0-9]+", value):
            return int(value)
        raise RouteError(f"cannot convert {value!r} to an integer")
    return value


def to_text(value: Any) -> str:
    return "<nil>" if value is None else str(value).lower() if isinstance(value, bool) else str(value)


def go_mod(a: int, b: int) -> int:
    """Remainder with the sign of a, as in SQL."""
    r = abs(a) % abs(b)
    return -r if a < 0 else r


def go_div(a: int, b: int) -> int:
    q = abs(a) // abs(b)
    return q if (a < 0) == (b < 0) else -q


# -- expressions ---------------------------------------------------------------------------------------------------

_OPS: dict[type, tuple[Callable[[int, int], int], Callable[[Column, Column], Column]]] = {
    ast.Add: (lambda a, b: a + b, lambda a, b: a + b),
    ast.Sub: (lambda a, b: a - b, lambda a, b: a - b),
    ast.Mult: (lambda a, b: a * b, lambda a, b: a * b),
    ast.Mod: (go_mod, lambda a, b: a % b),
    ast.Div: (go_div, lambda a, b: F.call_function("div", a, b)),
    ast.FloorDiv: (go_div, lambda a, b: F.call_function("div", a, b)),
}


def _crc(value: Any) -> int:
    return zlib.crc32(to_text(value).encode())


def column_crc(col: Column) -> Column:
    return F.crc32(col.cast("string").cast("binary"))


class Expression:
    """`prefix_${arithmetic}_suffix` over columns (or `value`), with + - * / %, parentheses, hash(x) and abs(x)."""

    def __init__(self, text: str):
        self.text, self.parts = text, []
        at = 0
        for m in re.finditer(r"\$\{([^}]*)\}", text):
            self.parts += [text[at : m.start()], ast.parse(m[1].strip(), mode="eval").body]
            at = m.end()
        self.parts.append(text[at:])

    @property
    def columns(self) -> list[str]:
        found = [n.id for p in self.parts if isinstance(p, ast.AST) for n in ast.walk(p) if isinstance(n, ast.Name) and n.id not in ("hash", "abs")]
        return list(dict.fromkeys(found))

    def scalar(self, values: dict[str, Any]) -> str:
        return "".join(p if isinstance(p, str) else to_text(self._value(p, values)) for p in self.parts)

    def column(self, columns: dict[str, Column]) -> Column:
        parts = [F.lit(p) if isinstance(p, str) else self._column(p, columns).cast("string") for p in self.parts if p != ""]
        return F.concat(*parts) if parts else F.lit("")

    def _value(self, node: ast.AST, values: dict[str, Any]) -> Any:
        match node:
            case ast.Name(id=name):
                if name not in values:
                    raise RouteError(f"sharding value not found for column: {name}")
                return values[name]
            case ast.Constant(value=int() as n):
                return n
            case ast.UnaryOp(op=ast.USub(), operand=x):
                return -self._number(x, values)
            case ast.BinOp(left=a, op=op, right=b) if type(op) in _OPS:
                return _OPS[type(op)][0](self._number(a, values), self._number(b, values))
            case ast.Call(func=ast.Name(id="hash"), args=[x]):
                return _crc(self._value(x, values))
            case ast.Call(func=ast.Name(id="abs"), args=[x]):
                return abs(self._number(x, values))
        raise RouteError(f"unsupported expression: {self.text}")

    def _number(self, node: ast.AST, values: dict[str, Any]) -> int:
        value = self._value(node, values)
        if isinstance(value, float):
            return int(value)
        if isinstance(value, str) and re.fullmatch(r"[+-]?[0-9]+", value):
            return int(value)
        return to_int(value)

    def _column(self, node: ast.AST, columns: dict[str, Column]) -> Column:
        match node:
            case ast.Name(id=name):
                if name not in columns:
                    raise RouteError(f"no column {name} for {self.text}")
                return columns[name]
            case ast.Constant(value=int() as n):
                return F.lit(n).cast("bigint")
            case ast.UnaryOp(op=ast.USub(), operand=x):
                return -self._long(x, columns)
            case ast.BinOp(left=a, op=op, right=b) if type(op) in _OPS:
                return _OPS[type(op)][1](self._long(a, columns), self._long(b, columns))
            case ast.Call(func=ast.Name(id="hash"), args=[x]):
                return column_crc(self._column(x, columns))
            case ast.Call(func=ast.Name(id="abs"), args=[x]):
                return F.abs(self._long(x, columns))
        raise RouteError(f"unsupported expression: {self.text}")

    def _long(self, node: ast.AST, columns: dict[str, Column]) -> Column:
        return self._column(node, columns).cast("bigint")


# -- algorithms ----------------------------------------------------------------------------------------------------


class Algorithm:
    """columns: what it routes by. scalar: values to one target; column: the same as a Column; targets: by conditions."""

    columns: list[str]

    def scalar(self, values: dict[str, Any], targets: list[str]) -> str:
        raise NotImplementedError

    def column(self, columns: dict[str, Column], targets: list[str]) -> Column:
        raise NotImplementedError

    def route(self, conditions: dict[str, Condition], targets: list[str]) -> list[str]:
        """Targets that may hold matching rows, in their order. Conditions it can't use prune nothing."""
        points = self._points(conditions)
        if points is None:
            return list(targets)
        hit = {self.scalar(p, targets) for p in points}
        return [t for t in targets if t in hit]

    #: A range of integers up to this size is routed key by key.
    MOST_POINTS = 1_000

    def _points(self, conditions: dict[str, Condition]) -> list[dict[str, Any]] | None:
        points: list[dict[str, Any]] = [{}]
        for c in self.columns:
            match conditions.get(c):
                case Eq(value):
                    values: Iterable[Any] = [value]
                case In(values_):
                    values = values_
                case Between(int() as low, int() as high) if high - low < self.MOST_POINTS:
                    values = range(low, high + 1)
                case _:
                    return None
            points = [p | {c: v} for p in points for v in values]
            if len(points) > 10_000:
                return None
        return points


class Inline(Algorithm):
    """An expression over one column or several. A key whose target isn't a node leads nowhere."""

    def __init__(self, expression: str, columns: list[str]):
        self.expression = Expression(expression)
        used = self.expression.columns
        self.columns = [c for c in used if c != "value"] + [c for c in columns if "value" in used and c not in used]
        self.alias = columns[0] if columns and "value" in used else None

    def scalar(self, values, targets):
        return self.expression.scalar(values | ({"value": values[self.alias]} if self.alias in values else {}))

    def column(self, columns, targets):
        return self.expression.column(columns | ({"value": columns[self.alias]} if self.alias else {}))


class Mod(Algorithm):
    """|key mod count|, as a place in the list of targets."""

    def __init__(self, column: str, count: Any):
        self.columns = [column]
        if count is None:
            raise RouteError("sharding-count is required")
        self.count = to_int(count.strip() if isinstance(count, str) else count)
        if self.count <= 0:
            raise RouteError("sharding-count must be positive")

    def place(self, value: Any) -> int:
        return abs(go_mod(to_int(value), self.count))

    def place_column(self, col: Column) -> Column:
        return F.abs(col.cast("bigint") % self.count)

    def scalar(self, values, targets):
        return targets[self.place(values[self.columns[0]]) % len(targets)]

    def column(self, columns, targets):
        place = self.place_column(columns[self.columns[0]]) % len(targets)
        return F.element_at(F.array(*map(F.lit, targets)), place.cast("int") + 1)


class HashMod(Mod):
    """CRC32 of the key's text, mod count."""

    def place(self, value):
        return _crc(value) % self.count

    def place_column(self, col):
        return column_crc(col) % self.count


class Range(Algorithm):
    """`0-100:ds_0,101-200:ds_1`, inclusive; the first that fits wins."""

    def __init__(self, column: str, ranges: str):
        self.columns, self.ranges = [column], []
        for part in filter(None, map(str.strip, ranges.split(","))):
            m = re.fullmatch(r"(\d+)\s*-\s*(\d+)\s*:\s*(\S+)", part)
            if m is None or int(m[1]) > int(m[2]):
                raise RouteError(f"invalid range: {part}")
            self.ranges.append((int(m[1]), int(m[2]), m[3]))

    def scalar(self, values, targets):
        key = to_int(values[self.columns[0]])
        for low, high, target in self.ranges:
            if low <= key <= high:
                return target
        raise RouteError(f"no range holds {key}")

    def column(self, columns, targets):
        col = columns[self.columns[0]].cast("bigint")
        choices = [F.when(col.between(low, high), F.lit(target)) for low, high, target in self.ranges]
        return F.coalesce(*choices, F.lit(None).cast("string"))

    def route(self, conditions, targets):
        match conditions.get(self.columns[0]):
            case Eq(value):
                spans = [(value, value)]
            case In(values):
                spans = [(v, v) for v in values]
            case Between(low, high):
                spans = [(low, high)]
            case _:
                return list(targets)
        hit = set()
        for low, high in spans:
            if not all(x is None or isinstance(x, int) for x in (low, high)):
                return list(targets)
            hit |= {t for a, b, t in self.ranges if (high is None or a <= high) and (low is None or b >= low)}
        return [t for t in targets if t in hit]


class HintInline(Algorithm):
    """The target comes from a hint, not from rows: a plain string is the target; otherwise `value` is replaced in the expression."""

    def __init__(self, expression: str = "${value}"):
        self.columns, self.expression = [], expression

    def target(self, hint: Any) -> str:
        if "${" not in self.expression:
            return self.expression
        return Expression(self.expression).scalar({"value": hint})

    def route(self, conditions, targets):
        hint = hints().database
        if hint is None:
            return list(targets)
        target = self.target(hint)
        return [t for t in targets if t == target]


class Custom(Algorithm):
    """A user's function of one key and the targets; writing uses an Arrow-batched form of the same function."""

    def __init__(self, column: str, choose: Callable[[Any, list[str]], str]):
        self.columns, self.choose = [column], choose

    def scalar(self, values, targets):
        return self.choose(values[self.columns[0]], targets)

    def column(self, columns, targets):
        choose = self.choose
        return F.udf(lambda key: choose(key, targets), "string", useArrow=True)(columns[self.columns[0]])


Maker = Callable[[str, list[str], dict[str, str]], Algorithm]
_REGISTRY: dict[str, Maker] = {
    "inline": lambda text, cols, p: Inline(text, cols),
    "complex_inline": lambda text, cols, p: Inline(text, cols),
    "mod": lambda text, cols, p: Mod(cols[0], p.get("sharding-count", text or None)),
    "hash_mod": lambda text, cols, p: HashMod(cols[0], p.get("sharding-count", text or None)),
    "range": lambda text, cols, p: Range(cols[0], p.get("sharding-ranges", text)),
    "hint_inline": lambda text, cols, p: HintInline(text or "${value}"),
}


def register(kind: str, make: Maker) -> None:
    """Adds an algorithm of the user's."""
    _REGISTRY[kind.lower()] = make


def create(kind: str, text: str, columns: list[str], properties: dict[str, str] | None = None) -> Algorithm:
    try:
        make = _REGISTRY[(kind or "inline").lower()]
    except KeyError:
        raise RouteError(f"unsupported sharding algorithm: {kind}") from None
    return make(text, columns, properties or {})


# -- hints ---------------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Hints:
    database: Any = None
    table: Any = None
    master_only: bool = False


_HINTS: contextvars.ContextVar[Hints] = contextvars.ContextVar("hints", default=Hints())


def hints() -> Hints:
    return _HINTS.get()


@contextlib.contextmanager
def hinted(database: Any = None, table: Any = None, master_only: bool = False) -> Iterator[Hints]:
    """Within the block, statements go to the hinted target; the state before comes back after it."""
    token = _HINTS.set(Hints(database, table, master_only))
    try:
        yield hints()
    finally:
        _HINTS.reset(token)
