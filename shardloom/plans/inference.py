"""Shard inference: which nodes each occurrence of a logical table in a statement needs.

The statement is analysed with one view for each occurrence. Catalyst's optimizer pushes predicates, also those it
infers across equi-joins, down to the relations; a filter that stands right on an occurrence's relation (with only
projections and filters between) holds for every row that can matter, whatever joins and subqueries are above.
Conjuncts narrow, disjuncts join, anything else (NOT, functions, casts of the key) narrows nothing.
"""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame

from shardloom.functions.algorithms import Between, Condition, Eq, In, RouteError
from shardloom.plans.router import Table
from shardloom.sources.nodes import Node

_PASS = ("Project", "Filter", "SubqueryAlias", "View")


def _kids(node) -> list:
    kids = node.children()
    return [kids.apply(i) for i in range(kids.size())]


def _kind(node) -> str:
    return node.getClass().getSimpleName().rstrip("$")


def _inner_plans(node) -> list:
    """Plans inside a node's subquery expressions, and of its CTE definitions."""
    plans = node.subqueries()
    return [plans.apply(i) for i in range(plans.size())]


def _attributes(plan, names: dict[str, int]) -> dict[int, tuple[int, str]]:
    """Expression id of every output column of an occurrence's view: (occurrence, column)."""
    out: dict[int, tuple[int, str]] = {}

    def walk(node):
        if _kind(node) == "SubqueryAlias" and node.alias() in names:
            cols = node.output()
            for i in range(cols.size()):
                a = cols.apply(i)
                out[a.exprId().id()] = (names[node.alias()], a.name())
        for x in _kids(node) + _inner_plans(node):
            walk(x)

    walk(plan)
    return out


def _value(literal) -> Any:
    v = literal.value()
    kind = literal.dataType().simpleString()
    if v is None:
        return None
    if kind in ("tinyint", "smallint", "int", "bigint"):
        return int(v)
    if kind == "string":
        return v if isinstance(v, str) else v.toString()
    raise RouteError(f"literals of type {kind} don't route")


def _between(a: Condition | None, b: Condition) -> Condition:
    """Both conditions at once, or the sharper of the two."""
    if a is None:
        return b
    if isinstance(b, Eq) or isinstance(a, Between) and isinstance(b, In):
        return b
    if isinstance(a, Between) and isinstance(b, Between):
        pick = lambda f, x, y: x if y is None else y if x is None else f(x, y)
        return Between(pick(max, a.low, b.low), pick(min, a.high, b.high))
    return a


def _conjuncts(e) -> list:
    return _conjuncts(e.left()) + _conjuncts(e.right()) if _kind(e) == "And" else [e]


def _nodes(e, ids: dict[int, tuple[int, str]], occurrence: int, table: Table) -> list[Node]:
    conditions: dict[str, Condition] = {}
    found: set[Node] | None = None

    def column(x) -> str | None:
        if _kind(x) == "AttributeReference":
            k, name = ids.get(x.exprId().id(), (-1, ""))
            if k == occurrence:
                return name
        return None

    for c in _conjuncts(e):
        kind = _kind(c)
        try:
            if kind == "Or":
                either = set(_nodes(c.left(), ids, occurrence, table)) | set(_nodes(c.right(), ids, occurrence, table))
                found = either if found is None else found & either
            elif kind in ("EqualTo", "GreaterThan", "GreaterThanOrEqual", "LessThan", "LessThanOrEqual"):
                left, right = c.left(), c.right()
                flip = _kind(left) == "Literal"
                name, literal = (column(right), left) if flip else (column(left), right)
                if name is None or _kind(literal) != "Literal":
                    continue
                value = _value(literal)
                if kind == "EqualTo":
                    new: Condition = Eq(value)
                elif not isinstance(value, int):
                    continue
                else:
                    below = kind.startswith("Less") != flip
                    edge = value if kind.endswith("Equal") else value - 1 if below else value + 1
                    new = Between(None, edge) if below else Between(edge, None)
                conditions[name] = _between(conditions.get(name), new)
            elif kind == "In" and (name := column(c.value())):
                values = [c.list().apply(i) for i in range(c.list().size())]
                if all(_kind(v) == "Literal" for v in values):
                    conditions[name] = _between(conditions.get(name), In(tuple(x for x in map(_value, values) if x is not None)))
            elif kind == "InSet" and (name := column(c.child())):
                items, values = c.set().iterator(), []
                text = c.child().dataType().simpleString() == "string"
                while items.hasNext():
                    v = items.next()
                    if v is not None:
                        values.append((v if isinstance(v, str) else v.toString()) if text else int(v))
                conditions[name] = _between(conditions.get(name), In(tuple(values)))
        except RouteError:
            continue
    try:
        routed = table.route({k: v for k, v in conditions.items() if k in table.columns})
    except RouteError:
        # A key no algorithm takes: it can't be pruned by.
        routed = table.nodes
    return [n for n in routed if found is None or n in found]


def infer(df: DataFrame, names: dict[str, int], tables: list[Table]) -> dict[int, list[Node]]:
    """Nodes by occurrence. names: view names; an occurrence that the optimizer removed needs no node."""
    execution = df._jdf.queryExecution()
    ids = _attributes(execution.analyzed(), names)
    out: dict[int, set[Node]] = {}

    def walk(node, filters):
        kids = _kids(node)
        for x in _inner_plans(node):
            walk(x, [])
        if not kids:
            cols = node.output()
            mine = {ids[i][0] for i in (cols.apply(j).exprId().id() for j in range(cols.size())) if i in ids}
            for k in mine:
                need = set(tables[k].nodes)
                for f in filters:
                    need &= set(_nodes(f, ids, k, tables[k]))
                out[k] = out.get(k, set()) | need
            return
        kind = _kind(node)
        passed = (filters + [node.condition()] if kind == "Filter" else filters) if kind in _PASS else []
        for x in kids:
            walk(x, passed)

    walk(execution.optimizedPlan(), [])
    hinted = {k: [n for n in t.route({}) if k not in out or n in out[k]] for k, t in enumerate(tables)}
    return {k: v if k in out else [n for n in v if n in tables[k].route({})] for k, v in hinted.items()}
