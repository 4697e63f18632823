"""Registered queries whose feature isn't a filter run over the whole tables."""

import os

import pytest

from shardloom import queries
from shardloom.plans import dialect

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")


def test_no_row_is_cut(spark):
    orders, users, events = (queries.read(spark, SF, t) for t in ("orders", "customer", "events"))
    n, customers = orders.count(), orders.select("o_custkey").distinct()
    expected = {
        "merge_sort_desc_nulls": n,
        "array_agg_sorted": customers.count(),
        "join_using": orders.join(orders.select("o_orderkey"), "o_orderkey").count(),
        "set_union_distinct": customers.union(users.select("c_custkey")).distinct().count(),
        "set_union_all": n + users.count(),
        "fn_json_key_exists": events.where("get_json_object(props, '$.k') IS NOT NULL").count(),
    }
    assert {name: queries.queries()[name](spark, SF).count() for name in expected} == expected


def test_json_key_test_needs_no_parameter():
    s = dialect.translate("SELECT a FROM t WHERE props ? 'k' AND b = ?", "postgresql")
    assert s.params == ["p1"] and "json_object_keys(props)" in s.sql and s.sql.endswith("b = :p1")
    assert dialect.translate("SELECT a FROM t WHERE props ? 'k'", "postgresql").params == []
