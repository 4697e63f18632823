"""Routing: which nodes of a logical table may hold rows that match a statement's conditions."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shardloom.config import Strategy, TableRule
from shardloom.functions import algorithms as A
from shardloom.sources.nodes import Node, expand

DS, TBL = "__ds", "__tbl"


def _algorithm(s: Strategy | None) -> A.Algorithm | None:
    return A.create(s.type, s.algorithm, s.columns, s.properties) if s else None


class Table:
    """A logical table: its nodes, and the algorithms that deal rows to sources and to tables within them."""

    def __init__(self, rule: TableRule):
        self.rule, self.name = rule, rule.logic_table
        self.nodes = expand(rule.actual_data_nodes)
        self.sources = list(dict.fromkeys(n.source for n in self.nodes))
        self.tables = list(dict.fromkeys(n.table for n in self.nodes))
        self.by_source, self.by_table = _algorithm(rule.database_strategy), _algorithm(rule.table_strategy)

    @property
    def columns(self) -> list[str]:
        return list(dict.fromkeys(c for a in (self.by_source, self.by_table) if a for c in a.columns))

    def route(self, conditions: dict[str, A.Condition], strict: bool = False) -> list[Node]:
        """strict: a strategy whose column isn't among given conditions, and a route to no node, are errors."""
        if strict and conditions:
            for a in (self.by_source, self.by_table):
                for c in a.columns if a else ():
                    if c not in conditions:
                        raise A.RouteError(f"sharding value not found for column: {c}")
        sources = self.by_source.route(conditions, self.sources) if self.by_source else self.sources
        tables = self.by_table.route(conditions, self.tables) if self.by_table else self.tables
        hint = A.hints()
        if hint.table is not None:
            tables = [t for t in tables if t == hint.table]
        if hint.database is not None and not isinstance(self.by_source, A.HintInline):
            sources = [s for s in sources if s == hint.database]
        found = [n for n in self.nodes if n.source in sources and n.table in tables]
        if strict and not found:
            raise A.RouteError(f"no valid route found for table {self.name}")
        return found

    def node_of(self, values: dict[str, Any]) -> Node:
        """The node of a row with these keys."""
        source = self.by_source.scalar(values, self.sources) if self.by_source and self.by_source.columns else self.sources[0]
        tables = [n.table for n in self.nodes if n.source == source]
        if not tables:
            raise A.RouteError(f"no valid route found for table {self.name}: {source}")
        node = Node(source, self.by_table.scalar(values, self.tables) if self.by_table else tables[0])
        if node not in self.nodes:
            raise A.RouteError(f"no valid route found for table {self.name}: {node}")
        return node

    def node_columns(self, columns: dict[str, Column]) -> tuple[Column, Column]:
        """The same as two Columns. Rows with a null key are kept at the first source or table."""

        def axis(algorithm: A.Algorithm | None, targets: list[str]) -> Column:
            if algorithm is None or not algorithm.columns:
                return F.lit(targets[0])
            null = columns[algorithm.columns[0]].isNull()
            for c in algorithm.columns[1:]:
                null = null | columns[c].isNull()
            return F.when(null, F.lit(targets[0])).otherwise(algorithm.column(columns, targets))

        return axis(self.by_source, self.sources), axis(self.by_table, self.tables)

    def dealt(self, df: DataFrame) -> DataFrame:
        """df with the node columns."""
        ds, tbl = self.node_columns({c: df[c] for c in self.columns})
        return df.withColumns({DS: ds, TBL: tbl})


class Router:
    """All logical tables, by name."""

    def __init__(self, tables: dict[str, TableRule]):
        self.tables: dict[str, Table] = {}
        for name, rule in tables.items():
            rule.logic_table = rule.logic_table or name
            self.tables[name] = Table(rule)

    def __getitem__(self, name: str) -> Table:
        try:
            return self.tables[name]
        except KeyError:
            raise A.RouteError(f"table rule not found: {name}") from None

    def __contains__(self, name: str) -> bool:
        return name in self.tables

    def route(self, name: str, conditions: dict[str, A.Condition] | None = None, strict: bool = False) -> list[Node]:
        return self[name].route(conditions or {}, strict)
