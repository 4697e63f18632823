"""The engine: SQL over logical tables."""

from __future__ import annotations

import itertools
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from shardloom.config import Config, ShardingRule, TableRule
from shardloom.functions import keys
from shardloom.metrics import ShardingMetrics
from shardloom.plans import dialect as D
from shardloom.plans.inference import infer
from shardloom.plans.router import Router
from shardloom.rw import Splitter, is_write
from shardloom.sources.catalog import Derived, Logical, Store, Union
from shardloom.sources.nodes import Node

_NUMBERS = itertools.count()
_FROM = {"FROM", "JOIN", ","}
#: What may follow a table without being its alias.
_AFTER = frozenset("WHERE JOIN LEFT RIGHT FULL INNER CROSS ON USING GROUP ORDER LIMIT UNION HAVING OFFSET EXCEPT INTERSECT WINDOW LATERAL NATURAL SEMI ANTI TABLESAMPLE PIVOT SET OUTER MINUS".split())


@dataclass
class Result:
    """Of a statement that writes."""

    affected: int
    last_insert_id: int | None = None
    returning: DataFrame | None = None


class Engine:
    """Logical tables by name, under one dialect. Tables without a rule are ordinary tables or views of the session."""

    def __init__(self, spark: SparkSession, config: Config | dict[str, TableRule], dialect: str = "mysql"):
        if isinstance(config, Config):
            config.validate()
            rules = (config.sharding_rule or ShardingRule()).tables
            self.splitters = {n: Splitter(s) for n, s in config.read_write_splits.items()}
        else:
            rules, self.splitters = config, {}
        self.spark, self.dialect, self.config = spark, dialect, config
        self.router, self.metrics = Router(rules), ShardingMetrics()
        self.logical: dict[str, Logical] = {}
        self.views: set[str] = set()
        self.routines: dict[str, str] = {}

    # -- tables --

    def attach(self, name: str, df: DataFrame) -> None:
        """df as a logical table, its nodes worked out row by row."""
        self.logical[name] = Derived(self.router[name], df)

    def attach_nodes(self, name: str, frames: dict[Node, DataFrame]) -> None:
        self.logical[name] = Union(self.router[name], frames)

    def attach_store(self, name: str, path: str, df: DataFrame | None = None, schema=None) -> Store:
        """A store at path; rows of df, if given, become its first version."""
        store = Store(self.spark, self.router[name], path, schema or df.schema)
        if df is not None:
            store.commit(store.append(df))
        self.logical[name] = store
        return store

    def register(self, name: str, df: DataFrame) -> None:
        """A table without shards."""
        df.createOrReplaceTempView(name)
        self.views.add(name)

    def store(self, name: str) -> Store:
        found = self.logical.get(name)
        if not isinstance(found, Store):
            raise D.DialectError(f"{name} isn't a table that can be written")
        return found

    # -- queries --

    def sql(self, text: str, *args: Any) -> DataFrame:
        """The rows that the statement would give on the unsharded tables."""
        statement = D.translate(text, self.dialect)
        return self.spark_sql(statement.sql, statement.args(args))

    def spark_sql(self, sql: str, args: dict[str, Any] | None = None) -> DataFrame:
        with self.metrics.query():
            return self._run(sql, args or {})[0]

    def nodes_for(self, text: str, *args: Any) -> list[tuple[str, list[Node]]]:
        """(logical table, nodes) of each of its occurrences, in order of the text."""
        statement = D.translate(text, self.dialect)
        return self._run(statement.sql, statement.args(args))[1]

    def _run(self, sql: str, args: dict[str, Any]) -> tuple[DataFrame, list[tuple[str, list[Node]]]]:
        toks = D.tokenize(sql)
        found = self._occurrences(toks)
        views = {f"__shard_{next(_NUMBERS)}": i for i in range(len(found))}
        for view, (at, name) in zip(views, found):
            code = [t for t in toks[at + 1 :] if t.kind != "space"]
            own_alias = bool(code) and (code[0].kind == "quoted" or (code[0].kind == "name" and code[0].word() not in _AFTER))
            toks[at].text = view if own_alias else f"{view} AS {name}"
        text = D.text_of(toks)
        tables = [self.logical[name].table for _, name in found]
        try:
            for view, (_, name) in zip(views, found):
                self.logical[name].view().createOrReplaceTempView(view)
            df = self.spark.sql(text, args=args or None)
            if not found:
                return df, []
            nodes = infer(df, views, tables)
            routed = [(name, nodes[i]) for i, (_, name) in enumerate(found)]
            for name, need in routed:
                self.metrics.route(name, len(need))
            less = [i for i, t in enumerate(tables) if len(nodes[i]) < len(t.nodes)]
            for i, (view, (_, name)) in enumerate(zip(views, found)):
                if i in less:
                    self.logical[name].view(nodes[i]).createOrReplaceTempView(view)
            return (self.spark.sql(text, args=args or None) if less else df), routed
        finally:
            for view in views:
                self.spark.catalog.dropTempView(view)

    def _occurrences(self, toks: list[D.Token]) -> list[tuple[int, str]]:
        """(place, name) of logical tables in FROM clauses; a CTE of the same name hides the table."""
        code = [(i, t) for i, t in enumerate(toks) if t.kind != "space"]
        hidden = {b.text for (_, a), (_, b), (_, c) in zip(code, code[1:], code[2:]) if a.word() in ("WITH", "RECURSIVE", ",") and b.kind == "name" and c.word() == "AS"}
        hidden &= {t.text for (_, p), (_, t), (_, a), (_, o) in zip(code, code[1:], code[2:], code[3:]) if a.word() == "AS" and o.text == "("}
        out = []
        for k, (i, t) in enumerate(code):
            name = t.text.strip("`") if t.kind == "quoted" else t.text
            if t.kind not in ("name", "quoted") or name not in self.logical or name in hidden or not k:
                continue
            after = code[k + 1][1].text if k + 1 < len(code) else ""
            if code[k - 1][1].word() in _FROM and after not in (".", "("):
                out.append((i, name))
        return out

    # -- writes --

    def execute(self, text: str, *args: Any) -> Result:
        """INSERT, UPDATE, DELETE, REPLACE, TRUNCATE and DDL."""
        from shardloom.operators import dml

        with self.metrics.query():
            return dml.execute(self, text, args)

    def define(self, name: str, body: str) -> None:
        """A table function or procedure: one statement with placeholders."""
        self.routines[name.lower()] = body

    def call(self, name: str, *args: Any) -> DataFrame | Result:
        """Rows of a query, or the result of a statement that writes."""
        try:
            body = self.routines[name.lower()]
        except KeyError:
            raise D.DialectError(f"no routine {name}") from None
        return self.execute(body, *args) if is_write(body) else self.sql(body, *args)

    def transaction(self):
        from shardloom.txn import Transaction

        return Transaction(self)

    # -- the rest --

    def data_source(self, name: str, sql: str) -> str:
        """The physical source for a statement: a splitter of that name chooses, otherwise the name itself."""
        return self.splitters[name].route(sql) if name in self.splitters else name

    def health(self) -> dict[str, bool]:
        """Whether each logical table can be read."""
        out = {}
        for name, table in self.logical.items():
            try:
                out[name] = table.healthy() if isinstance(table, Store) else table.frame().limit(1).count() >= 0
            except Exception:
                out[name] = False
        return out

    def table_keys(self, name: str, version: int) -> keys.TableKeys:
        """The keys that a statement on a version of a store may give out."""
        rule = self.router[name].rule.key_generator
        return keys.TableKeys(rule.type if rule else "snowflake", rule.properties if rule else {}, self.store(name).high(version))

    def close(self) -> None:
        for view in self.views:
            self.spark.catalog.dropTempView(view)
        self.views.clear()
        self.logical.clear()
