"""Statements that write stores: copy on write by node, RETURNING, upserts, generated keys.

A change rewrites only the nodes that its condition can reach. New files are written first and a new version is
committed at the end, so the rows read are those of the version the statement began with; no checkpoint is needed.
"""

from __future__ import annotations

import itertools
import re
from dataclasses import dataclass, field
from typing import TYPE_CHECKING, Any

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shardloom.plans import dialect as D
from shardloom.plans.router import DS, TBL
from shardloom.sources.catalog import TX, Change, Store, node_filter
from shardloom.sources.nodes import Node

if TYPE_CHECKING:
    from shardloom.engine import Engine, Result

_VIEWS = itertools.count()


@dataclass
class Write:
    kind: str  # INSERT, REPLACE, UPDATE or DELETE
    table: str
    columns: list[str] = field(default_factory=list)
    source: str = ""  # VALUES ... or a query
    sets: list[tuple[str, str]] = field(default_factory=list)
    where: str = ""
    alias: str = ""
    returning: str = ""
    conflict: list[str] | None = None  # key columns; [] is the first column
    do_update: list[tuple[str, str]] | None = None  # None with conflict set: do nothing


class _Reader:
    def __init__(self, toks: list[D.Token]):
        self.toks, self.at = toks, 0

    def peek(self, k: int = 0) -> str:
        return self.toks[self.at + k].word() if self.at + k < len(self.toks) else ""

    def take(self, *words: str) -> bool:
        if all(self.peek(i) == w for i, w in enumerate(words)):
            self.at += len(words)
            return True
        return False

    def name(self) -> str:
        t = self.toks[self.at].text
        self.at += 1
        return t.strip("`")

    def until(self, *stops: str) -> list[D.Token]:
        """Tokens before any of the words, outside brackets."""
        begin, depth = self.at, 0
        while self.at < len(self.toks):
            t = self.toks[self.at]
            if depth == 0 and t.word() in stops:
                break
            depth += t.text == "("
            depth -= t.text == ")"
            self.at += 1
        return self.toks[begin : self.at]

    def names(self) -> list[str]:
        """(a, b, ...)"""
        self.at += 1
        out = []
        while self.peek() != ")":
            if not self.take(","):
                out.append(self.name())
        self.at += 1
        return out


def _sets(toks: list[D.Token]) -> list[tuple[str, str]]:
    out, depth, part = [], 0, []
    for t in [*toks, D.Token("op", ",")]:
        depth += t.text == "("
        depth -= t.text == ")"
        if t.text == "," and depth == 0:
            at = next(i for i, x in enumerate(part) if x.text == "=")
            out.append((part[at - 1].text.strip("`"), D._spaced(part[at + 1 :])))
            part = []
        else:
            part.append(t)
    return out


def parse(sql: str) -> Write:
    """sql: Spark SQL as the dialect layer gives it, with the statement's own clauses still there."""
    r = _Reader(D.code(sql))
    kind = r.peek()
    r.at += 1
    if kind in ("INSERT", "REPLACE"):
        ignore = r.take("IGNORE")
        r.take("INTO")
        w = Write(kind, r.name(), conflict=[] if ignore else None)
        if r.peek() == "(" and r.peek(1) not in ("SELECT", "WITH"):
            w.columns = r.names()
        w.source = D._spaced(r.until("ON", "RETURNING") if r.peek() in ("VALUES", "VALUE") else _query(r))
        if r.take("ON", "CONFLICT"):
            w.conflict = r.names() if r.peek() == "(" else []
            r.take("DO")
            if r.take("UPDATE"):
                r.take("SET")
                w.do_update = _sets(r.until("RETURNING"))
            else:
                r.take("NOTHING")
        elif r.take("ON", "DUPLICATE", "KEY", "UPDATE"):
            w.conflict, w.do_update = [], _sets(r.until("RETURNING"))
    elif kind == "UPDATE":
        w = Write(kind, r.name())
        r.take("AS")
        w.alias = "" if r.peek() == "SET" else r.name()
        r.take("SET")
        w.sets = _sets(r.until("WHERE", "RETURNING"))
    elif kind == "DELETE":
        r.take("FROM")
        w = Write(kind, r.name())
        r.take("AS")
        w.alias = "" if r.peek() in ("WHERE", "RETURNING", "") else r.name()
    else:
        raise D.DialectError(f"not a statement that writes: {kind}")
    if kind in ("UPDATE", "DELETE") and r.take("WHERE"):
        w.where = D._spaced(r.until("RETURNING"))
    if r.take("RETURNING"):
        w.returning = D._spaced(r.toks[r.at :])
    return w


def _query(r: _Reader) -> list[D.Token]:
    """A query up to RETURNING or an ON CONFLICT / ON DUPLICATE clause."""
    begin, depth = r.at, 0
    while r.at < len(r.toks):
        t = r.toks[r.at]
        depth += t.text == "("
        depth -= t.text == ")"
        if depth == 0 and (t.word() == "RETURNING" or (t.word() == "ON" and r.peek(1) in ("CONFLICT", "DUPLICATE"))):
            break
        r.at += 1
    return r.toks[begin : r.at]


def execute(engine: Engine, text: str, args: tuple, into: list | None = None) -> Result:
    """Runs a statement; with `into`, changes are put there uncommitted, as (store, Change)."""
    from shardloom.engine import Result

    head = next((t.word() for t in D.code(text)), "")
    statement = D.translate(text, engine.dialect)
    if head == "TRUNCATE":
        name = D.code(statement.sql)[-1].text.strip("`")
        store = engine.store(name)
        version = store.version()
        n = store.frame(version).count()
        _finish(store, Change(version, drop=store.leaves(version)), into)
        return Result(n)
    if head == "MERGE":
        return _merge(engine, statement.sql, statement.args(args), into)
    if m := re.fullmatch(r"\s*CREATE\s+(?:OR\s+REPLACE\s+)?(?:TEMPORARY\s+)?VIEW\s+`?(\w+)`?\s+AS\s+(.*)", statement.sql, re.I | re.S):
        engine.register(m[1], _select(engine, m[2], statement.args(args)))
        return Result(0)
    if head not in ("INSERT", "REPLACE", "UPDATE", "DELETE"):
        if (rows := _logical_ddl(engine, statement.sql)) is not None:
            return Result(0, None, rows)
        shown = engine.spark.sql(_ddl(statement.sql), args=statement.args(args) or None)
        return Result(0, None, shown if head in ("SHOW", "DESCRIBE", "DESC") else None)
    w = parse(statement.sql)
    given = {k: v for k, v in statement.args(args).items()}
    if w.table not in engine.logical:
        if w.kind != "INSERT" or w.conflict is not None or w.returning:
            raise D.DialectError(f"no logical table {w.table}")
        engine.spark_sql(statement.sql, given).collect()
        return Result(0)
    store = engine.store(w.table)
    return (_insert if w.kind in ("INSERT", "REPLACE") else _change)(engine, store, w, given, into)


def _ddl(sql: str) -> str:
    """What other dialects say about columns and Spark doesn't."""
    sql = re.sub(r"\b(AUTO_INCREMENT|PRIMARY KEY|UNIQUE)\b(?!\s*\()", "", sql, flags=re.I)
    if re.match(r"\s*CREATE\s+(OR\s+REPLACE\s+)?(CONSTRAINT\s+)?TRIGGER\b", sql, re.I):
        raise D.DialectError("triggers aren't run; give the column's value in the statement that writes")
    if re.match(r"\s*(CREATE\s+(UNIQUE\s+)?|DROP\s+)INDEX\b", sql, re.I):
        return "SELECT 1"  # Parquet has statistics instead of indexes
    return sql


def _logical_ddl(engine: Engine, sql: str) -> DataFrame | None:
    """ALTER, DROP, SHOW and DESCRIBE of logical tables: rows to show, or None if the statement is about something else."""
    done = engine.spark.createDataFrame([], "done string")
    table = r"(?:TABLE\s+)?`?(\w+)`?"
    if re.fullmatch(r"\s*SHOW\s+TABLES\s*", sql, re.I):
        plain = engine.spark.sql("SHOW TABLES").select(F.col("tableName").alias("table"))
        logical = engine.spark.createDataFrame([(n,) for n in sorted(engine.logical)], "table string")
        return logical.unionByName(plain.where(~F.col("table").startswith("__"))).distinct()
    if m := re.fullmatch(rf"\s*(?:DESCRIBE|DESC|SHOW\s+(?:FULL\s+)?COLUMNS\s+(?:FROM|IN))\s+{table}\s*", sql, re.I):
        if m[1] in engine.logical:
            fields = engine.logical[m[1]].view().schema.fields
            return engine.spark.createDataFrame([(f.name, f.dataType.simpleString()) for f in fields], "col_name string, data_type string")
        return None
    if m := re.fullmatch(r"\s*DROP\s+TABLE\s+(?:IF\s+EXISTS\s+)?`?(\w+)`?(?:\s+(?:CASCADE|RESTRICT))?\s*", sql, re.I):
        if m[1] in engine.logical:
            del engine.logical[m[1]]  # its files stay: other readers may be at a version of them
            return done
        return None
    if m := re.fullmatch(r"\s*ALTER\s+TABLE\s+`?(\w+)`?\s+(.*?)\s*", sql, re.I | re.S):
        if m[1] not in engine.logical:
            return None
        store = engine.store(m[1])
        if n := re.fullmatch(r"ADD\s+(?:COLUMN\s+)?`?(\w+)`?\s+(\w+(?:\s*\([\d\s,]*\))?)(?:\s+NULL)?", m[2], re.I):
            store.add_column(T.StructField(n[1], T._parse_datatype_string(D.TYPES.get(n[2].upper(), n[2]))))
        elif n := re.fullmatch(r"DROP\s+(?:COLUMN\s+)?`?(\w+)`?", m[2], re.I):
            store.drop_column(n[1])
        else:
            raise D.DialectError(f"can't do this to a logical table: {m[2]}")
        return done
    return None


def _finish(store: Store, change: Change, into: list | None) -> None:
    if into is None:
        store.commit(change)
    else:
        into.append((store, change))


def _used(sql: str, given: dict[str, Any]) -> dict[str, Any]:
    return {k: v for k, v in given.items() if re.search(rf":{k}\b", sql)}


def _select(engine: Engine, sql: str, given: dict[str, Any]) -> DataFrame:
    return engine._run(sql, _used(sql, given))[0]


def _returned(engine: Engine, w: Write, rows: DataFrame) -> DataFrame | None:
    if not w.returning:
        return None
    name = f"__returning_{next(_VIEWS)}"
    rows.createOrReplaceTempView(name)
    try:
        return engine.spark.sql(f"SELECT {w.returning} FROM {name} AS {w.alias or w.table}")
    finally:
        engine.spark.catalog.dropTempView(name)


def _insert(engine: Engine, store: Store, w: Write, given: dict[str, Any], into: list | None) -> Result:
    from shardloom.engine import Result

    schema = store.schema
    source = w.source if not w.source.upper().startswith("VALUE") else f"SELECT * FROM {re.sub('^VALUE ', 'VALUES ', w.source)}"
    rows = _select(engine, source, given)
    columns = w.columns or schema.names[: len(rows.columns)]
    if len(columns) != len(rows.columns):
        raise D.DialectError(f"{len(columns)} columns, {len(rows.columns)} values")
    rows = rows.toDF(*columns)
    version = store.version()
    rule, made, last = store.table.rule.key_generator, None, None
    if rule and rule.column and rule.column not in columns:
        made = engine.table_keys(w.table, version)
        if w.source.upper().startswith("VALUE"):
            given_out = made.some(rows.count())  # a row each that the statement's text spells out
            last = given_out[-1] if given_out else None
            at = F.row_number().over(Window.orderBy(F.monotonically_increasing_id()))
            rows = rows.withColumn(rule.column, F.element_at(F.array(*map(F.lit, given_out)), at))
        else:
            rows = made.column(rows, rule.column)
    rows = rows.select([(F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema.fields])

    def high(leaves: list[str]) -> int | None:
        return made.highest(_read(store, leaves), rule.column) if made else None

    if w.conflict is None and w.kind == "INSERT":
        leaves = store.written(rows)
        done = _read(store, leaves)
        _finish(store, Change(version, add=leaves, high=high(leaves)), into)
        return Result(done.count(), last, _returned(engine, w, done))
    # Keys decide; of new rows with equal keys one stays.
    on = w.conflict or [rule.column if rule and rule.column else schema.names[0]]
    leaves = store.written(rows.dropDuplicates(on))
    top = high(leaves)
    new, old = _read(store, leaves), store.frame(version)
    if set(store.table.columns) <= set(on):  # a key's old row can only be where the new one goes
        old = old.where(node_filter(list({store.node_of(x) for x in leaves})))
    if w.do_update is None and w.kind == "INSERT":
        fresh = store.written(new.join(old.select(*on), on, "left_anti").select(*schema.names))
        store.discard(Change(version, add=leaves))
        done = _read(store, fresh)
        _finish(store, Change(version, add=fresh, high=top), into)
        return Result(done.count(), last, _returned(engine, w, done))
    # Only nodes that hold a row with one of the keys are written again; their number is that of the nodes at most.
    met = old.join(new.select(*on), on, "left_semi").select(DS, TBL).distinct().collect()
    nodes = [Node(r[DS], r[TBL]) for r in met]
    old = old.where(node_filter(nodes)).select(*schema.names) if nodes else engine.spark.createDataFrame([], schema)
    if w.kind == "REPLACE":
        change = store.replace(nodes, old.join(new.select(*on), on, "left_anti").select(*schema.names), version)
        affected = new.count() + old.join(new.select(*on), on, "left_semi").count()
        added = leaves
    else:
        renamed = new.select(*[F.col(c).alias(f"__new_{c}") for c in schema.names])
        same = [F.col(f"{w.table}.{c}") == F.col(f"__new_{c}") for c in on]
        pairs = old.alias(w.table).join(renamed, same, "left")
        sets = {c: F.expr(_of_new(e)) for c, e in w.do_update}
        matched = F.col(f"__new_{on[0]}").isNotNull()
        out = [(F.when(matched, sets[c]).otherwise(F.col(f"{w.table}.{c}")) if c in sets else F.col(f"{w.table}.{c}")).alias(c) for c in schema.names]
        change = store.replace(nodes, pairs.select(*out), version)
        added = store.written(new.join(old.select(*on), on, "left_anti").select(*schema.names))
        affected = new.count()
    change.add, change.high = change.add + added, top
    _finish(store, change, into)
    done = _read(store, change.add).join(new.select(*on), on, "left_semi").select(*schema.names)
    return Result(affected, last, _returned(engine, w, done))


def _of_new(sql: str) -> str:
    """EXCLUDED.c and VALUES(c) as the joined new row's column; strings stay as they are."""
    toks, out, i = D.code(sql), [], 0
    while i < len(toks):
        words = [t.word() for t in toks[i : i + 4]]
        if words[:2] == ["EXCLUDED", "."] and len(words) > 2:
            out.append(D.Token("name", f"`__new_{toks[i + 2].text.strip('`')}`"))
            i += 3
        elif words[:2] == ["VALUES", "("] and words[3:] == [")"]:
            out.append(D.Token("name", f"`__new_{toks[i + 2].text.strip('`')}`"))
            i += 4
        else:
            out.append(toks[i])
            i += 1
    return D._spaced(out)


def _read(store: Store, leaves: list[str]) -> DataFrame:
    """Rows of leaf folders, of a version or not."""
    if not leaves:
        return store.spark.createDataFrame([], store.schema)
    return store.spark.read.schema(store.schema).parquet(*(f"{store.path}/{x}" for x in leaves))


def _merge(engine: Engine, sql: str, given: dict[str, Any], into: list | None) -> Result:
    """MERGE INTO t USING source ON condition WHEN [NOT] MATCHED [AND c] THEN ...; of WHEN MATCHED clauses the first that fits counts.
    A target row that several source rows match is an error."""
    from shardloom.engine import Result

    r = _Reader(D.code(sql))
    r.take("MERGE", "INTO")
    table = r.name()
    r.take("AS")
    name = table if r.peek() == "USING" else r.name()
    r.take("USING")
    source = D._spaced(r.until("ON"))
    r.take("ON")
    on = D._spaced(r.until("WHEN"))
    store = engine.store(table)
    fields, version, view = store.schema.fields, store.version(), f"__target_{next(_VIEWS)}"
    every = store.frame(version).drop(TX)
    every.createOrReplaceTempView(view)
    try:
        # Only nodes that hold a matched row are written again.
        met = _select(engine, f"SELECT DISTINCT {name}.{DS} AS ds, {name}.{TBL} AS tbl FROM {view} AS {name} JOIN {source} ON {on}", given).collect()
        nodes = [Node(r["ds"], r["tbl"]) for r in met]
        base = every.where(node_filter(nodes)) if nodes else every.limit(0)
        base.drop(DS, TBL).withColumn("__row", F.monotonically_increasing_id()).createOrReplaceTempView(view)
        twice = _select(engine, f"SELECT {name}.__row FROM {view} AS {name} JOIN {source} ON {on} GROUP BY {name}.__row HAVING count(*) > 1", given)
        if not twice.isEmpty():
            raise D.DialectError(f"several source rows match one row of {table}")
        same = ", ".join(f"{name}.`{f.name}`" for f in fields)
        joined, alone = f"{view} AS {name} JOIN {source} ON {on}", f"{view} AS {name} LEFT ANTI JOIN {source} ON {on}"
        kept, written, affected, earlier, fresh = [f"SELECT {same} FROM {alone}"], [], 0, "false", "false"
        while r.take("WHEN"):
            no = r.take("NOT")
            r.take("MATCHED")
            extra = D._spaced(r.until("THEN")) if r.take("AND") else "true"
            r.take("THEN")
            if no:
                r.take("INSERT")
                columns = r.names() if r.peek() == "(" else [f.name for f in fields]
                r.take("VALUES")
                values = dict(zip(columns, _listed(r.until("WHEN")[1:-1])))
                what = ", ".join(f"CAST(({values.get(f.name, 'NULL')}) AS {f.dataType.simpleString()}) AS `{f.name}`" for f in fields)
                written.append(f"SELECT {what} FROM {source} LEFT ANTI JOIN {view} AS {name} ON {on} WHERE coalesce(({extra}), false) AND NOT ({fresh})")
                fresh = f"({fresh}) OR coalesce(({extra}), false)"
                continue
            chosen = f"coalesce(({extra}), false) AND NOT ({earlier})"
            if r.take("DELETE"):
                affected += _select(engine, f"SELECT 1 FROM {joined} WHERE {chosen}", given).count()
            else:
                r.take("UPDATE")
                r.take("SET")
                sets = dict(_sets(r.until("WHEN")))
                what = ", ".join(f"CAST(({sets[f.name]}) AS {f.dataType.simpleString()}) AS `{f.name}`" if f.name in sets else f"{name}.`{f.name}`" for f in fields)
                written.append(f"SELECT {what} FROM {joined} WHERE {chosen}")
            earlier = f"({earlier}) OR coalesce(({extra}), false)"
        kept.append(f"SELECT {same} FROM {joined} WHERE NOT ({earlier})")
        leaves = [x for q in written for x in store.written(_select(engine, q, given))]
        affected += _read(store, leaves).count()
        change = store.replace(nodes, _select(engine, " UNION ALL ".join(kept), given), version) if nodes else Change(version)
        change.add += leaves
    finally:
        engine.spark.catalog.dropTempView(view)
    _finish(store, change, into)
    return Result(affected)


def _listed(toks: list[D.Token]) -> list[str]:
    """Expressions between commas outside brackets."""
    out, depth, part = [], 0, []
    for t in [*toks, D.Token("op", ",")]:
        depth += t.text == "("
        depth -= t.text == ")"
        if t.text == "," and depth == 0:
            out.append(D._spaced(part))
            part = []
        else:
            part.append(t)
    return out


def _change(engine: Engine, store: Store, w: Write, given: dict[str, Any], into: list | None) -> Result:
    from shardloom.engine import Result

    name = w.alias or w.table
    where = w.where or "true"
    version = store.version()
    probe = f"SELECT * FROM {w.table} AS {name} WHERE {where}"
    nodes = engine._run(probe, _used(probe, given))[1][0][1]
    # The nodes' rows in two halves, so that a condition may hold subqueries.
    view = f"__target_{next(_VIEWS)}"
    base = store.frame(version).where(node_filter(nodes)).drop(DS, TBL, TX)
    base.createOrReplaceTempView(view)
    try:
        select = lambda what, cond: _select(engine, f"SELECT {what} FROM {view} AS {name} WHERE {cond}", given)
        rest = select("*", f"NOT coalesce(({where}), false)")
        if w.kind == "DELETE":
            gone = select("*", where)
            affected = gone.count()
            change = store.replace(nodes, rest, version)
            returned = _returned(engine, w, gone)
        else:
            sets = dict(w.sets)
            unknown = set(sets) - set(store.schema.names)
            if unknown:
                raise D.DialectError(f"no column {', '.join(sorted(unknown))} in {w.table}")
            what = ", ".join(f"CAST(({sets[f.name]}) AS {f.dataType.simpleString()}) AS `{f.name}`" if f.name in sets else f"{name}.`{f.name}`" for f in store.schema.fields)
            added = store.written(select(what, where))
            done = _read(store, added)
            affected = done.count()
            change = store.replace(nodes, rest, version)
            change.add += added
            returned = _returned(engine, w, done)
    finally:
        engine.spark.catalog.dropTempView(view)
    if not affected:
        store.discard(change)
        change = Change(version)
    if change.add or change.drop:
        _finish(store, change, into)
    return Result(affected, None, returned)
