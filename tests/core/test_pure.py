"""Parts that need no session: nodes, algorithms, routing, dialects, analysis, plans, keys, splitting, metrics, configuration."""

import threading

import pytest
from hypothesis import given
from hypothesis import strategies as st

from shardloom import config as C
from shardloom.functions import keys
from shardloom.functions.algorithms import Between, Eq, HashMod, In, Mod, Range, RouteError, create, hinted, hints, register, to_int, to_text
from shardloom.metrics import Collector, Counter, Histogram, ShardingMetrics
from shardloom.plans import analysis, dialect, planning
from shardloom.plans.router import Router
from shardloom.rw import Splitter, is_write, on_primary
from shardloom.sources.nodes import Node, expand, expand_side
from shardloom.txn import Saga, State


@pytest.mark.parametrize("text, n", [("ds_${0..1}.t_order_${0..1}", 4), ("ds_${[0, 1]}.t_order_${[0, 1]}", 4), ("ds_0.t_order_0", 1), ("ds_${0..}.t_order_${0..1}", 2)])
def test_expand(text, n):
    assert len(expand(text)) == n


@pytest.mark.parametrize("text", ["nodot", "a.b.c"])
def test_expand_refuses(text):
    with pytest.raises(ValueError):
        expand(text)


@pytest.mark.parametrize("text, out", [("ds_${0..2}", ["ds_0", "ds_1", "ds_2"]), ("ds_${[0, 2, 4]}", ["ds_0", "ds_2", "ds_4"]), ("ds_${a..1}", ["ds_${a..1}"]), ("ds_${[0, a]}", ["ds_0", "ds_a"])])
def test_ranges(text, out):
    assert expand_side(text) == out


@pytest.fixture
def router():
    return Router({"t_order": C.TableRule("t_order", "ds_${0..1}.t_order_${0..1}", C.Strategy("user_id", "ds_${user_id % 2}"), C.Strategy("order_id", "t_order_${order_id % 2}"))})


@pytest.mark.parametrize("given_, nodes", [({}, 4), ({"user_id": Eq(1)}, 2), ({"order_id": Eq(2)}, 2), ({"user_id": Eq(1), "order_id": Eq(2)}, 1), ({"user_id": In((1, 2))}, 4), ({"user_id": In((1, 3))}, 2), ({"user_id": Between(3, 3)}, 2), ({"user_id": Between(3, None)}, 4)])
def test_route(router, given_, nodes):
    assert len(router.route("t_order", given_)) == nodes


def test_route_exact(router):
    assert router.route("t_order", {"user_id": Eq(123), "order_id": Eq(456)}) == [Node("ds_1", "t_order_0")]
    with pytest.raises(RouteError):
        router.route("nothing")
    with pytest.raises(RouteError, match="sharding value not found"):
        router.route("t_order", {"user_id": Eq(1)}, strict=True)
    with pytest.raises(RouteError, match="no valid route"):
        router.route("t_order", {"user_id": Eq(-1), "order_id": Eq(1)}, strict=True)
    with hinted("ds_0", "t_order_1"):
        assert router.route("t_order") == [Node("ds_0", "t_order_1")]
    assert hints().database is None


DS4 = [f"ds{i}" for i in range(4)]


@pytest.mark.parametrize("key, out", [(123, "ds3"), (-123, "ds3"), (4, "ds0"), ("7", "ds3")])
def test_mod(key, out):
    assert Mod("k", "4").scalar({"k": key}, DS4) == out


def test_mod_lists_and_errors():
    assert Mod("k", 4).route({"k": In((0, 1, 2, 3))}, DS4) == DS4
    for count in (0, None, "invalid", -1):
        with pytest.raises(RouteError):
            Mod("k", count)
    assert HashMod("k", 4).scalar({"k": "john_doe"}, DS4) == "ds2"


def test_range():
    r = Range("k", "0-100:ds_0,101-200:ds_1")
    targets = ["ds_0", "ds_1"]
    assert r.scalar({"k": 100}, targets) == "ds_0"
    assert r.route({"k": Between(90, 110)}, targets) == targets
    assert r.route({"k": In((150,))}, targets) == ["ds_1"]
    assert r.route({"k": Between(None, 50)}, targets) == ["ds_0"]
    with pytest.raises(RouteError):
        r.scalar({"k": 500}, targets)
    with pytest.raises(RouteError):
        Range("k", "9-1:x")


def test_inline_expressions():
    assert create("inline", "t_2023-01_${k % 2}", ["k"]).scalar({"k": 5}, []) == "t_2023-01_1"
    assert create("inline", "ds_${k / 1000}", ["k"]).scalar({"k": 2500}, []) == "ds_2"
    assert create("inline", "ds_${hash(k) % 4}", ["k"]).scalar({"k": "john_doe"}, []) == "ds_2"
    assert create("complex_inline", "x_${(a % 2) + (b % 4)}", ["a", "b"]).scalar({"a": 3, "b": 6}, []) == "x_3"
    assert create("inline", "ds_${value % 2}", ["k"]).scalar({"k": -5}, []) == "ds_-1"
    with pytest.raises(RouteError):
        create("nothing", "", ["k"])
    with pytest.raises(RouteError):
        create("inline", "ds_${__import__('os')}", ["k"]).scalar({"k": 1}, [])
    h = create("hint_inline", "index_${value % 2}", [])
    assert h.target(5) == "index_1"
    assert create("hint_inline", "ds_9", []).target(5) == "ds_9"
    register("first", lambda text, cols, p: Mod(cols[0], 1))
    assert create("first", "", ["k"]).scalar({"k": 9}, DS4) == "ds0"


@pytest.mark.parametrize("x, out", [(1, 1), ("12", 12)])
def test_to_int(x, out):
    assert to_int(x) == out


@pytest.mark.parametrize("x", [1.5, None, "", "-3", "a", True])
def test_to_int_refuses(x):
    with pytest.raises(RouteError):
        to_int(x)


def test_to_text():
    assert [to_text(x) for x in (None, 5, "a", True)] == ["<nil>", "5", "a", "true"]


@pytest.mark.parametrize(
    "kind, sql, out",
    [
        ("mysql", "SELECT `a` FROM t LIMIT 5, 10", "SELECT `a` FROM t LIMIT 10 OFFSET 5"),
        ("mysql", "SELECT DATE_SUB(NOW(), INTERVAL 30 DAY)", "SELECT (NOW() - INTERVAL 30 DAY)"),
        ("postgresql", "SELECT a->>'k' FROM t", "SELECT get_json_object(a, concat('$.', 'k')) FROM t"),
        ("postgresql", "SELECT x FROM t WHERE tags && ARRAY['a']", "SELECT x FROM t WHERE arrays_overlap(tags, array('a'))"),
        ("postgresql", "SELECT x FROM t WHERE n ~* 'a' -- c", "SELECT x FROM t WHERE (n RLIKE concat('(?i)', 'a'))"),
        ("postgresql", "SELECT '5'::numeric, x::jsonb", "SELECT '5'::decimal(38,18), x::string"),
        ("postgresql", "SELECT 1 WHERE $2 = ANY(a) AND b = $1", "SELECT 1 WHERE array_contains(a, :p2) AND b = :p1"),
        ("postgresql", "SELECT unnest(ARRAY[1,2]), generate_series(1, 3)", "SELECT explode(array(1, 2)), explode(sequence(1, 3))"),
    ],
)
def test_translate(kind, sql, out):
    assert dialect.translate(sql, kind).sql == out


def test_placeholders():
    assert dialect.to_dollar("SELECT ?, 'test?', ?") == "SELECT $1, 'test?', $2"
    assert dialect.to_dollar("SELECT $1, x ? 'k'") == "SELECT $1, x ? 'k'"
    assert dialect.to_postgresql("SELECT `a` FROM t WHERE b = ?") == 'SELECT "a" FROM t WHERE b = $1'
    s = dialect.translate("SELECT ? + ?", "mysql")
    assert s.args((1, 2)) == {"p1": 1, "p2": 2}
    with pytest.raises(dialect.DialectError):
        s.args((1,))


@pytest.mark.parametrize("sql", ["SELECT * FROM t LIMIT 1, 2", "SELECT `a`", "CREATE TABLE t (a INT AUTO_INCREMENT)"])
def test_postgresql_guard(sql):
    with pytest.raises(dialect.DialectError):
        dialect.check_postgresql(sql)


def test_rename_tables():
    sql = "SELECT t_order.a FROM t_order JOIN t_order_item -- t_order\nWHERE x = 't_order'"
    assert dialect.rename_tables(sql, {"t_order": "t_order_0"}) == "SELECT t_order_0.a FROM t_order_0 JOIN t_order_item -- t_order\nWHERE x = 't_order'"


def test_analysis():
    a = analysis.analyze("WITH user_stats AS (SELECT user_id, COUNT(*) c FROM posts GROUP BY user_id) SELECT * FROM users u LEFT JOIN user_stats s ON u.id = s.user_id ORDER BY u.id LIMIT 5")
    assert (a.kind, a.dependencies, list(a.ctes), a.limit) == ("SELECT", {"users": ["user_stats"]}, ["user_stats"], "5")
    assert analysis.analyze("SELECT * FROM users JOIN posts ON users.id = posts.user_id").dependencies == {"users": ["posts"]}
    assert analysis.analyze("INSERT INTO users VALUES (1)").score == 27
    assert analysis.analyze("SELECT RANK() OVER (ORDER BY a) FROM t WHERE a IN (SELECT b FROM s)").complexity == {"tables": 2, "joins": 0, "subqueries": 1, "ctes": 0, "windows": 1, "nesting": 1}
    assert ("performance", "warning") == analysis.suggestions("SELECT * FROM t WHERE a = 1")[0][:2]
    assert analysis.validate("SELECT a FROM t LIMIT 1, 2")[0][0] == "syntax"
    f = analysis.features("SELECT COALESCE(a, 1), b || c FROM t WHERE d @> '{}' RETURNING id")
    assert (f["functions"], f["operators"], f["returning"]) == (["COALESCE"], ["@>", "||"], ["id"])
    many = "SELECT 1 FROM a0 " + " ".join(f"JOIN a{i} ON a{i}.x = a0.x" for i in range(1, 100))
    assert analysis.analyze(many).complexity["joins"] == 99


@pytest.mark.parametrize("sql, kind", [("select 1", "SELECT"), (" INSERT x", "INSERT"), ("TRUNCATE t", "OTHER"), ("SHOW TABLES", "SHOW"), ("DROP TABLE t", "DROP"), ("WITH a AS (SELECT 1) SELECT 1", "OTHER")])
def test_statement_kind(sql, kind):
    assert analysis.statement_kind(sql) == kind


def test_planning():
    assert planning.plan("INSERT INTO t VALUES (1)").cost == 4.0
    assert planning.plan("SELECT a FROM t JOIN s ON t.x = s.x WHERE a = 1 GROUP BY a ORDER BY a LIMIT 1").cost == 25.5
    assert [s.operation for s in planning.plan("DELETE FROM t WHERE a = 1").steps] == ["ROUTE_DELETE", "APPLY_WHERE", "DELETE_ROWS"]
    with pytest.raises(planning.Unsupported):
        planning.plan("CREATE TABLE t (a INT)")
    assert planning.estimate("SELECT * FROM users WHERE a = 1", {"users": 1000}) == 0.5
    assert planning.estimate("SELECT * FROM users u JOIN orders o ON u.id = o.user_id WHERE x = 1", {"users": 1000, "orders": 5000}) == 8.0
    assert planning.estimate("SELECT * FROM nothing", {}) == 0
    r = planning.Rules()
    r.add("up", str.upper)
    assert r.apply("select 1") == ("SELECT 1", None)
    r.add("bad", lambda s: 1 / 0)
    assert r.apply("select 1") == ("select 1", "bad")


def test_snowflake():
    g = keys.Snowflake(5, 3)
    made = [g.next() for _ in range(5000)]
    assert len(set(made)) == 5000 and made == sorted(made)
    assert {k: v for k, v in keys.fields(made[0]).items() if k in ("worker", "centre")} == {"worker": 5, "centre": 3}
    now = iter([1_700_000_000_000, 1_600_000_000_000])
    with pytest.raises(keys.ClockMovedBack):
        g = keys.Snowflake(clock=lambda: next(now))
        g.next(), g.next()
    for worker in (-1, 32):
        with pytest.raises(ValueError):
            keys.Snowflake(worker)


def test_other_keys():
    assert [keys.Increment(10, 5).next(), keys.generator("increment").next()] == [15, 1]
    assert 0 < keys.generator("uuid").next() < 1 << 63
    assert keys.generator("snowflake", workerId=7).worker == 7
    with pytest.raises(ValueError):
        keys.generator("nothing")
    assert keys.named() is keys.named()
    g, seen = keys.Snowflake(), set()
    threads = [threading.Thread(target=lambda: seen.update([g.next() for _ in range(500)])) for _ in range(8)]
    [t.start() for t in threads], [t.join() for t in threads]
    assert len(seen) == 4000


WRITES = ["INSERT INTO u VALUES (1)", "UPDATE u SET a = 1", "DELETE FROM u", "CREATE TABLE t (a INT)", "DROP TABLE t", "ALTER TABLE u ADD b INT", "TRUNCATE TABLE u", "REPLACE INTO u VALUES (1)", "insert into u values (1)", "MERGE INTO a", "CALL p()"]
READS = ["SELECT * FROM u", "SHOW TABLES", "DESCRIBE u", "EXPLAIN SELECT 1", "  SELECT 1  ", "Select 1"]


@pytest.mark.parametrize("sql, out", [(s, True) for s in WRITES] + [(s, False) for s in READS])
def test_is_write(sql, out):
    assert is_write(sql) is out


def test_splitter():
    s = Splitter(C.ReadWriteSplit("x", "w", ["a", "b"]))
    assert [s.route("SELECT 1") for _ in range(3)] == ["a", "b", "a"]
    with on_primary():
        assert s.route("SELECT 1") == "w"
    with hinted(master_only=True):
        assert s.route("SELECT 1") == "w"
    w = Splitter(C.ReadWriteSplit("x", "w", ["a", "b"], "weight", [3, 1]))
    assert sorted(w.replica() for _ in range(8)) == ["a"] * 6 + ["b"] * 2
    assert Splitter(C.ReadWriteSplit("x", "w", ["a"], "random")).replica() == "a"
    assert Splitter(C.ReadWriteSplit("x", "w")).route("SELECT 1") == "w"


def test_metrics():
    h = Histogram("h", bounds=(1.0, 2.0))
    for x in (0.5, 1.0, 1.5, 9.0):
        h.observe(x)
    assert (h.counts, h.count, h.sum) == ([2, 1, 1], 4, 12.0)
    c = Collector()
    assert c.add(Counter("n", {"b": "1", "a": "2"})) is c.add(Counter("n", {"a": "2", "b": "1"}))
    m = ShardingMetrics()
    m.route("t", 2), m.route("t", 1)
    assert (m.routes.value, m.cross_shard.value) == (2, 1)
    with pytest.raises(ZeroDivisionError), m.query():
        1 / 0
    with m.connection():
        assert m.connections_active.value == 1
    assert m.query_errors.value == 1 and 'sharding_query_total{type="all"} 1' in m.collector.text() and len(m.collector.all()) == 10


def test_saga():
    seen, waits = [], []
    assert Saga(wait=waits.append).add(lambda: seen.append(1), lambda: seen.append(-1)).add(lambda: 1 / 0).run() is State.ROLLED_BACK
    assert (seen, waits) == ([1, -1], [1, 2])
    assert Saga().add(lambda: None).run() is State.COMMITTED


def test_config(tmp_path):
    data = {
        "dataSources": {"ds_0": {"driverName": "mysql", "url": "x", "maxOpenConns": 5}},
        "shardingRule": {"tables": {"t": {"actualDataNodes": "ds_0.t_${0..1}", "databaseShardingStrategy": {"shardingColumn": "a", "algorithmExpression": "ds_0"}}}, "defaultTableStrategy": {"shardingColumn": "b", "algorithm": "t_${b % 2}"}},
        "readWriteSplitting": {"rw": {"masterDataSource": "ds_0", "slaveDataSources": ["r"]}},
    }
    c = C.from_dict(data).validate()
    assert (c.sharding_rule.tables["t"].logic_table, c.sharding_rule.tables["t"].table_strategy.algorithm, c.data_sources["ds_0"].max_open) == ("t", "t_${b % 2}", 5)
    for name in ("c.yaml", "c.json"):
        C.save(c, tmp_path / name)
        assert C.load(tmp_path / name) == c
    for bad, message in [({}, "at least one"), ({"dataSources": {"a": {"url": "x"}}}, "driver name"), ({"dataSources": {"a": {"driverName": "mysql"}}}, "URL"), ({"dataSources": {"a": {"driverName": "mysql", "url": "x"}}, "shardingRule": {"tables": {"t": {}}}}, "actual data nodes")]:
        with pytest.raises(C.ConfigError, match=message):
            C.from_dict(bad).validate()
    assert C.database_type("MSSQL") == "sqlserver" and C.DIALECTS["mysql"].limit(5, 2) == "LIMIT 2, 5" and C.DIALECTS["postgresql"].quoted("a") == '"a"'
    with pytest.raises(C.ConfigError):
        C.database_type("nothing")


@given(st.integers(-(10**12), 10**12), st.integers(1, 50))
def test_mod_targets(key, n):
    assert Mod("k", n).scalar({"k": key}, [str(i) for i in range(n)]) == str(abs(key) % n)
