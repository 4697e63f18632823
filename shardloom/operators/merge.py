"""Merging of shard results that are already there as DataFrames (the engine itself never needs it).

The default merges as if the query had run on all rows: partial counts are summed, averages are weighted, groups
come before order and limit. compat="reference" keeps three known oddities for callers that rely on them: counts
are the number of partial rows, averages are unweighted, a sum of nothing is 0.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass
class Order:
    column: str
    descending: bool = False


@dataclass
class Aggregate:
    """kind: count, sum, avg, min or max. column: of the partial values. weight: for avg, the column of partial counts."""

    kind: str
    column: str
    weight: str | None = None


@dataclass
class Context:
    group_by: list[str] = field(default_factory=list)
    aggregates: list[Aggregate] = field(default_factory=list)
    order_by: list[Order] = field(default_factory=list)
    limit: int = 0  # 0 is no limit, and then the offset doesn't count
    offset: int = 0


def _merged(a: Aggregate, compat: str):
    value = F.col(a.column)
    number = value.try_cast("double")
    match a.kind:
        case "count":
            return F.count(F.lit(1)) if compat == "reference" else F.sum(value)
        case "sum":
            return F.coalesce(F.sum(number), F.lit(0.0)) if compat == "reference" else F.sum(value)
        case "avg":
            if compat == "reference" or a.weight is None:
                return F.avg(number)
            return F.sum(number * F.col(a.weight)) / F.sum(F.when(number.isNotNull(), F.col(a.weight)))
        case "min":
            return F.min(value)
        case "max":
            return F.max(value)
    raise ValueError(f"unknown aggregate: {a.kind}")


def merge(shards: list[DataFrame], context: Context | None = None, compat: str | None = None) -> DataFrame:
    """One DataFrame of all shards' rows, grouped, ordered and cut. Columns match by name; NULL sorts lowest."""
    context, compat = context or Context(), compat or "sql"
    df = reduce(DataFrame.unionByName, shards)
    if context.group_by or context.aggregates:
        named = {a.column for a in context.aggregates} | {a.weight for a in context.aggregates}
        rest = [c for c in df.columns if c not in named and c not in context.group_by]
        found = [_merged(a, compat).alias(a.column) for a in context.aggregates] + [F.first(c).alias(c) for c in rest]
        df = df.groupBy(*context.group_by).agg(*found or [F.count(F.lit(1)).alias("__n")]).drop("__n")
    order = [F.col(o.column).desc_nulls_last() if o.descending else F.col(o.column).asc_nulls_first() for o in context.order_by if o.column in df.columns]
    if order:
        df = df.orderBy(*order)
    if context.limit > 0:
        df = (df.offset(context.offset) if context.offset else df).limit(context.limit)
    return df
