"""Stores of sharded tables and the logical tables that read them.

A Store keeps a table as Parquet under  <path>/__tx=<n>/__ds=<source>/__tbl=<table>/.  A manifest,
<path>/_manifests/<version>, lists the leaf folders that make up a version. Writers only add folders and then add
the next manifest, which fails if another writer was first; so a version is never seen half written, lost executors
only repeat tasks, and a reader keeps the version it began with.
"""

from __future__ import annotations

import contextlib
import json
import uuid
from collections.abc import Iterator
from contextvars import ContextVar
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shardloom.plans.router import DS, TBL, Table
from shardloom.sources.nodes import Node

TX = "__tx"


class Conflict(RuntimeError):
    """Another writer has committed since the version that a change was based on."""


def node_filter(nodes: list[Node]) -> Column:
    """Rows of these nodes; a cross product of sources and tables becomes two IN lists, which partition pruning uses."""
    if not nodes:
        return F.lit(False)
    sources, tables = list(dict.fromkeys(n.source for n in nodes)), list(dict.fromkeys(n.table for n in nodes))
    if len(nodes) == len(sources) * len(tables):
        return F.col(DS).isin(sources) & F.col(TBL).isin(tables)
    out = F.lit(False)
    for s in sources:
        out = out | ((F.col(DS) == s) & F.col(TBL).isin([n.table for n in nodes if n.source == s]))
    return out


class Logical:
    """A logical table as a DataFrame with the node columns DS and TBL."""

    def __init__(self, table: Table):
        self.table = table

    def frame(self) -> DataFrame:
        raise NotImplementedError

    def view(self, nodes: list[Node] | None = None) -> DataFrame:
        """What queries see: rows of the nodes (all by default), without the node columns."""
        df = self.frame()
        if nodes is not None:
            df = df.where(node_filter(nodes))
        return df.drop(DS, TBL, TX)


class Derived(Logical):
    """Any DataFrame as a logical table; the node of a row is worked out on the fly."""

    def __init__(self, table: Table, df: DataFrame):
        super().__init__(table)
        self.df = df

    def frame(self) -> DataFrame:
        return self.table.dealt(self.df)


class Union(Logical):
    """Physical tables, one DataFrame a node (Parquet, JDBC, anything Spark reads), by column name."""

    def __init__(self, table: Table, frames: dict[Node, DataFrame]):
        super().__init__(table)
        missing = [str(n) for n in table.nodes if n not in frames]
        if missing:
            raise ValueError(f"no data for nodes {', '.join(missing)}")
        self.frames = frames

    def frame(self) -> DataFrame:
        tagged = [self.frames[n].withColumns({DS: F.lit(n.source), TBL: F.lit(n.table)}) for n in self.table.nodes]
        out = tagged[0]
        for df in tagged[1:]:
            out = out.unionByName(df)
        return out


def jdbc_frames(spark: SparkSession, table: Table, sources: dict, **options: str) -> dict[Node, DataFrame]:
    """A JDBC scan for each node; filters and columns are pushed to the databases by Spark."""
    out = {}
    for n in table.nodes:
        s = sources[n.source]
        reader = spark.read.format("jdbc").option("url", s.url).option("dbtable", n.table)
        for k, v in {"user": s.username, "password": s.password, **options}.items():
            reader = reader.option(k, v) if v else reader
        out[n] = reader.load()
    return out


@dataclass
class Change:
    """Leaf folders to add to a store and to leave out, on top of a version; and the highest generated key so far, if keys were generated."""

    base: int
    add: list[str] = field(default_factory=list)
    drop: list[str] = field(default_factory=list)
    high: int | None = None

    def then(self, later: Change) -> Change:
        """Both, one after the other."""
        gone = set(later.drop)
        return Change(self.base, [x for x in self.add if x not in gone] + later.add, self.drop + [x for x in later.drop if x not in self.add], self.high if later.high is None else later.high)


#: Changes of an open transaction, by store: what its own statements see.
_PENDING: ContextVar[dict[int, Change]] = ContextVar("pending", default={})


@contextlib.contextmanager
def pending(changes: list[tuple[Store, Change]]) -> Iterator[None]:
    token = _PENDING.set({id(store): change for store, change in changes})
    try:
        yield
    finally:
        _PENDING.reset(token)


class Store(Logical):
    def __init__(self, spark: SparkSession, table: Table, path: str, schema: T.StructType):
        super().__init__(table)
        self.spark, self.path, self.schema = spark, path.rstrip("/"), schema

    # -- files --

    def _fs(self, path: str):
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()), at

    def _list(self, path: str) -> list[str]:
        fs, at = self._fs(path)
        return sorted(x.getPath().getName() for x in fs.listStatus(at)) if fs.exists(at) else []

    def version(self) -> int:
        return max((int(x) for x in self._list(f"{self.path}/_manifests") if x.isdigit()), default=0)

    def _manifest(self, version: int) -> dict:
        if not version:
            return {"leaves": [], "high": None}
        fs, at = self._fs(f"{self.path}/_manifests/{version}")
        stream = fs.open(at)
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def leaves(self, version: int | None = None) -> list[str]:
        """Leaf folders of a version, relative to the store, as an open transaction's statements see them."""
        mine = _PENDING.get().get(id(self))
        version = (mine.base if mine else self.version()) if version is None else version
        found = self._manifest(version)["leaves"]
        if mine and mine.base == version:
            return [x for x in found if x not in set(mine.drop)] + mine.add
        return found

    def high(self, version: int) -> int | None:
        """The highest generated key of a version: milliseconds of snowflake ids, values of increments."""
        mine = _PENDING.get().get(id(self))
        return mine.high if mine and mine.high is not None else self._manifest(version)["high"]

    @staticmethod
    def node_of(leaf: str) -> Node:
        parts = dict(p.split("=", 1) for p in leaf.split("/"))
        return Node(parts[DS], parts[TBL])

    # -- reading --

    def frame(self, version: int | None = None) -> DataFrame:
        schema = T.StructType([*self.schema.fields, T.StructField(TX, T.StringType()), T.StructField(DS, T.StringType()), T.StructField(TBL, T.StringType())])
        leaves = self.leaves(version)
        if not leaves:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).option("basePath", self.path).parquet(*(f"{self.path}/{x}" for x in leaves))

    # -- writing --

    def written(self, df: DataFrame) -> list[str]:
        """Writes rows to their nodes; their leaf folders aren't part of any version yet."""
        tx = uuid.uuid4().hex
        rows = self.table.dealt(df.select([F.col(f.name).cast(f.dataType).alias(f.name) for f in self.schema.fields]))
        known = F.concat_ws(".", DS, TBL).isin([str(n) for n in self.table.nodes])
        rows = rows.withColumn(TBL, F.when(known, F.col(TBL)).otherwise(F.raise_error(F.concat(F.lit(f"no valid route found for table {self.table.name}: "), F.concat_ws(".", DS, TBL)))))
        # Rows of a node go together, but a node with many rows is split over tasks.
        rows.hint("rebalance", DS, TBL).write.partitionBy(DS, TBL).parquet(f"{self.path}/{TX}={tx}")
        base = f"{TX}={tx}"
        return [f"{base}/{d}/{t}" for d in self._list(f"{self.path}/{base}") if d.startswith(DS) for t in self._list(f"{self.path}/{base}/{d}") if t.startswith(TBL)]

    def append(self, df: DataFrame) -> Change:
        return Change(self.version(), add=self.written(df))

    def replace(self, nodes: list[Node], df: DataFrame, version: int) -> Change:
        """df instead of all rows of nodes."""
        gone = [x for x in self.leaves(version) if self.node_of(x) in nodes]
        return Change(version, add=self.written(df), drop=gone)

    def commit(self, change: Change) -> int:
        if self.version() != change.base:
            raise Conflict(f"{self.table.name} is at version {self.version()}, the change began at {change.base}")
        old, gone = self._manifest(change.base), set(change.drop)
        high = old["high"] if change.high is None else change.high
        new = {"leaves": [x for x in old["leaves"] if x not in gone] + change.add, "high": high}
        # Written aside and renamed without overwriting: a version is whole as soon as it can be seen, and only one writer makes it.
        jvm = self.spark._jvm
        fs, aside = self._fs(f"{self.path}/_manifests/.{uuid.uuid4().hex}")
        stream = fs.create(aside, False)
        stream.write(bytearray(json.dumps(new).encode()))
        stream.close()
        rename = jvm.org.apache.hadoop.fs.Options.Rename
        how = self.spark.sparkContext._gateway.new_array(rename, 0)
        place = fs.makeQualified(jvm.org.apache.hadoop.fs.Path(f"{self.path}/_manifests/{change.base + 1}"))
        try:
            jvm.org.apache.hadoop.fs.FileContext.getFileContext(place.toUri(), self.spark._jsc.hadoopConfiguration()).rename(fs.makeQualified(aside), place, how)
        except Exception as e:
            fs.delete(aside, False)
            raise Conflict(f"{self.table.name}: version {change.base + 1} exists") from e
        return change.base + 1

    def add_column(self, column: T.StructField) -> None:
        """A column that older rows have as null; files stay as they are."""
        if column.name in self.schema.names:
            raise ValueError(f"{self.table.name} has a column {column.name}")
        self.schema = T.StructType([*self.schema.fields, column])

    def drop_column(self, name: str) -> None:
        if name not in self.schema.names or name in self.table.columns:
            raise ValueError(f"{self.table.name} has no column {name} that can go")
        self.schema = T.StructType([f for f in self.schema.fields if f.name != name])

    def discard(self, change: Change) -> None:
        for tx in {x.split("/", 1)[0] for x in change.add}:
            fs, at = self._fs(f"{self.path}/{tx}")
            fs.delete(at, True)

    def truncate(self) -> int:
        version = self.version()
        return self.commit(Change(version, drop=self.leaves(version)))

    def healthy(self) -> bool:
        """Every leaf folder of the current version is there."""
        return all(fs.exists(at) for fs, at in (self._fs(f"{self.path}/{x}") for x in self.leaves()))
