"""Data nodes: the physical tables behind a logical one, written as an expression with ranges."""

from __future__ import annotations

import re
from typing import NamedTuple


class Node(NamedTuple):
    source: str
    table: str

    def __str__(self) -> str:
        return f"{self.source}.{self.table}"


_RANGE = re.compile(r"\$\{([^}]*)\}")


def expand_side(pattern: str) -> list[str]:
    """`p_${0..2}_s` or `p_${[a, b]}_s`: only the first range counts; one that can't be read stays as it is."""
    m = _RANGE.search(pattern)
    if m is None:
        return [pattern]
    head, tail, inside = pattern[: m.start()], pattern[m.end() :], m[1].strip()
    if inside.startswith("[") and inside.endswith("]"):
        return [f"{head}{x.strip()}{tail}" for x in inside[1:-1].split(",")]
    low, dots, high = inside.partition("..")
    if not dots or not re.fullmatch(r"-?\d+", low.strip()) or not re.fullmatch(r"-?\d+", high.strip()):
        return [pattern]
    return [f"{head}{i}{tail}" for i in range(int(low), int(high) + 1)]


def expand(expression: str) -> list[Node]:
    """`sources.tables`, crossed; several expressions may be joined by commas outside braces."""
    out: list[Node] = []
    for part in re.split(r",(?![^${]*\})(?![^\[]*\])", expression):
        bare = _RANGE.sub(lambda m: "#" * len(m[0]), part)
        if bare.count(".") != 1:
            raise ValueError(f"invalid actual data nodes format: {expression}")
        dot = bare.index(".")
        out += [Node(s.strip(), t.strip()) for s in expand_side(part[:dot]) for t in expand_side(part[dot + 1 :])]
    return list(dict.fromkeys(out))
