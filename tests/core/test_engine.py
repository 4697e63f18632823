"""The engine on small tables: sharded answers equal unsharded ones, pruning is sound, writes keep what they should."""

import random

import pytest
from pyspark.sql import functions as F

from shardloom.config import KeyGenerator, Strategy, TableRule
from shardloom.engine import Engine
from shardloom.functions.algorithms import create
from shardloom.operators.merge import Aggregate, Context, Order, merge
from shardloom.plans.dialect import DialectError
from shardloom.plans.router import DS, TBL
from shardloom.sources.catalog import Conflict
from shardloom.txn import State, TransactionError


def rules(key=""):
    return {
        "t_order": TableRule("t_order", "ds_${0..1}.t_order_${0..1}", Strategy("user_id", "ds_${user_id % 2}"), Strategy("order_id", "t_order_${order_id % 2}"), KeyGenerator(key) if key else None),
        "t_user": TableRule("t_user", "ds_${0..1}.t_user", Strategy("user_id", "ds_${user_id % 2}")),
    }


ORDERS = [(1000, 2, "PENDING", 299.99), (1002, 4, "COMPLETED", 199.5), (1004, 6, "PENDING", 399.0), (1001, 2, "COMPLETED", 150.75), (1003, 4, "PENDING", 89.99), (1005, 8, "COMPLETED", 599.0), (2000, 1, "PENDING", 199.99), (2002, 3, "COMPLETED", 299.5), (2004, 5, "PENDING", 149.0), (2001, 1, "COMPLETED", 89.75), (2003, 3, "PENDING", 199.99), (2005, 7, "COMPLETED", 399.0)]
SCHEMA = "order_id bigint, user_id bigint, status string, amount double"


@pytest.fixture
def orders(spark):
    return spark.createDataFrame(ORDERS, SCHEMA)


@pytest.fixture
def users(spark):
    return spark.createDataFrame([(i, f"u{i}") for i in range(1, 9)], "user_id bigint, name string")


@pytest.fixture
def engine(spark, orders, users, tmp_path):
    e = Engine(spark, rules(), "postgresql")
    e.attach_store("t_order", f"{tmp_path}/o", orders)
    e.attach_store("t_user", f"{tmp_path}/u", users)
    return e


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_layout(engine):
    found = {(r[0], r[1]): r[2] for r in engine.logical["t_order"].frame().groupBy(DS, TBL).count().collect()}
    assert found == {(f"ds_{d}", f"t_order_{t}"): 3 for d in (0, 1) for t in (0, 1)}


CASES = [
    ("SELECT order_id FROM t_order WHERE user_id = $1", (2,), [2]),
    ("SELECT order_id FROM t_order WHERE user_id = 2 AND order_id = 1001", (), [1]),
    ("SELECT order_id FROM t_order WHERE user_id IN (1, 3) AND order_id > 0", (), [2]),
    ("SELECT order_id FROM t_order WHERE user_id = 1 OR order_id = 1000", (), [3]),
    ("SELECT order_id FROM t_order WHERE NOT (user_id = 1)", (), [4]),
    ("SELECT order_id FROM t_order WHERE user_id * 2 = 2", (), [4]),
    ("SELECT order_id FROM t_order WHERE user_id = 1 AND user_id = 2", (), None),
    ("SELECT o.order_id, u.name FROM t_user u JOIN t_order o ON u.user_id = o.user_id WHERE u.user_id = 3", (), [1, 2]),
    ("SELECT u.user_id, o.order_id FROM t_user u LEFT JOIN t_order o ON u.user_id = o.user_id AND o.order_id = 1000", (), [2, 2]),
    ("SELECT u.user_id, o.order_id FROM t_user u LEFT JOIN t_order o ON u.user_id = o.user_id WHERE o.order_id IS NULL OR o.user_id = 1", (), [2, 4]),
    ("SELECT a.order_id, b.order_id FROM t_order a JOIN t_order b ON a.status = b.status WHERE a.user_id = 2 AND b.user_id = 3", (), [2, 2]),
    ("WITH x AS (SELECT * FROM t_order WHERE user_id = 8) SELECT count(*) FROM x", (), [2]),
    ("SELECT user_id FROM t_user WHERE user_id IN (SELECT user_id FROM t_order WHERE order_id = 2005 AND user_id = 7)", (), None),
    ("SELECT count(*), sum(amount) FROM t_order", (), [4]),
]


@pytest.mark.parametrize("sql, args, sizes", CASES)
def test_sharded_equals_unsharded(engine, spark, orders, users, sql, args, sizes):
    routed = engine.nodes_for(sql, *args)
    if sizes:
        assert [len(n) for _, n in routed] == sizes
    orders.createOrReplaceTempView("p_order")
    users.createOrReplaceTempView("p_user")
    plain = sql.replace("t_order", "p_order").replace("t_user", "p_user")
    for i, a in enumerate(args):
        plain = plain.replace(f"${i + 1}", str(a))
    assert rows(engine.sql(sql, *args)) == rows(spark.sql(plain))


def test_random_predicates_never_lose_rows(engine, spark, orders):
    orders.createOrReplaceTempView("p_order")
    rng = random.Random(3)

    def predicate(depth=0):
        if depth < 2 and rng.random() < 0.5:
            return f"({predicate(depth + 1)} {rng.choice(['AND', 'OR'])} {predicate(depth + 1)})"
        col, v = rng.choice([("user_id", rng.randint(-2, 9)), ("order_id", rng.choice([1000, 1001, 2003, 5]))])
        return rng.choice([f"{col} = {v}", f"{v} = {col}", f"{col} IN ({v}, {v + 1})", f"{col} BETWEEN {v} AND {v + 1}", f"{col} < {v}", f"{v} <= {col}", f"NOT {col} = {v}", f"{col} <> {v}"])

    for _ in range(25):
        p = predicate()
        assert rows(engine.sql(f"SELECT order_id FROM t_order WHERE {p}")) == rows(spark.sql(f"SELECT order_id FROM p_order WHERE {p}")), p


def test_partition_filters(engine):
    plan = engine.sql("SELECT order_id FROM t_order WHERE user_id = 2")._jdf.queryExecution().toString()
    assert "PartitionFilters: [" in plan and "ds_0" in plan.split("PartitionFilters: [")[-1][:200]
    assert "__ds" not in engine.sql("SELECT * FROM t_order").columns


def test_scalar_and_column_agree(spark):
    targets = [f"d{i}" for i in range(4)]
    values = [0, 1, -1, 7, -123, 10**12, 250, 333]
    df = spark.createDataFrame([(v,) for v in values], "k bigint")
    for a in (create("mod", "4", ["k"]), create("hash_mod", "4", ["k"]), create("inline", "d${k % 4}", ["k"]), create("inline", "d${hash(k) % 4}", ["k"]), create("inline", "d_${k / 100}", ["k"]), create("range", "0-300:d0,301-9999999999999:d1", ["k"])):
        got = [r[0] for r in df.select(a.column({"k": df["k"]}, targets)).collect()]
        for v, g in zip(values, got):
            if g is not None:
                assert a.scalar({"k": v}, targets) == g


def test_dml(engine):
    count = lambda: engine.sql("SELECT count(*) FROM t_order").first()[0]
    assert engine.execute("INSERT INTO t_order (order_id, user_id, status, amount) VALUES ($1, 9, 'NEW', 1.0)", 3000).affected == 1
    r = engine.execute("UPDATE t_order SET amount = amount + 1, status = 'X' WHERE user_id = $1 RETURNING order_id, amount", 9)
    assert r.affected == 1 and rows(r.returning) == [(3000, 2.0)]
    assert engine.execute("UPDATE t_order SET user_id = 10 WHERE user_id = 9").affected == 1
    assert [len(n) for _, n in engine.nodes_for("SELECT * FROM t_order WHERE user_id = 10")] == [2] and engine.sql("SELECT order_id FROM t_order WHERE user_id = 10").count() == 1
    assert engine.execute("UPDATE t_order SET status = 'Y' WHERE user_id = 99").affected == 0
    assert engine.execute("INSERT INTO t_order VALUES (3000, 1, 'Z', 5.0), (3001, 1, 'Z', 5.0) ON CONFLICT (order_id) DO NOTHING").affected == 1
    assert engine.execute("INSERT INTO t_order VALUES (3000, 10, 'W', 7.0) ON CONFLICT (order_id) DO UPDATE SET amount = EXCLUDED.amount").affected == 1
    assert engine.sql("SELECT amount, status FROM t_order WHERE order_id = 3000").collect()[0] == (7.0, "X")
    assert engine.execute("DELETE FROM t_order WHERE user_id IN (SELECT user_id FROM t_user WHERE name = 'u2') RETURNING order_id").affected == 2
    assert count() == 12
    with pytest.raises(DialectError):
        engine.execute("UPDATE t_order SET nothing = 1")
    assert engine.execute("TRUNCATE TABLE t_order").affected == 12 and count() == 0
    assert engine.execute("INSERT INTO t_order SELECT user_id + 1, user_id, name, 0 FROM t_user").affected == 8
    assert engine.health() == {"t_order": True, "t_user": True}


def test_generated_keys(spark, orders, tmp_path):
    e = Engine(spark, rules("order_id"), "mysql")
    e.attach_store("t_order", f"{tmp_path}/o", orders)
    r = e.execute("INSERT INTO t_order (user_id, status) VALUES (?, 'N'), (?, 'M')", 1, 2)
    assert r.affected == 2 and r.last_insert_id > 0
    assert e.sql("SELECT count(DISTINCT order_id) FROM t_order").first()[0] == 14
    assert e.execute("REPLACE INTO t_order (order_id, user_id, status, amount) VALUES (1000, 2, 'R', 0.0)").affected == 2
    assert e.sql("SELECT status FROM t_order WHERE order_id = 1000").first()[0] == "R"


def test_transactions(engine):
    with engine.transaction() as tx:
        tx.execute("DELETE FROM t_order WHERE user_id = 2")
        tx.execute("DELETE FROM t_user WHERE user_id = 2")
        assert engine.sql("SELECT * FROM t_order").count() == 12
    assert (tx.state, engine.sql("SELECT * FROM t_order").count(), engine.sql("SELECT * FROM t_user").count()) == (State.COMMITTED, 10, 7)
    with pytest.raises(RuntimeError), engine.transaction() as tx:
        tx.execute("DELETE FROM t_order")
        raise RuntimeError
    assert tx.state is State.ROLLED_BACK and engine.sql("SELECT * FROM t_order").count() == 10
    with pytest.raises(TransactionError):
        tx.commit()
    tx = engine.transaction()
    tx.execute("DELETE FROM t_order WHERE user_id = 4")
    engine.execute("DELETE FROM t_order WHERE user_id = 1")
    with pytest.raises(Conflict):
        tx.commit()
    assert engine.sql("SELECT * FROM t_order").count() == 8


def test_merge(spark):
    a = spark.createDataFrame([("x", 2, 10.0), ("y", 1, None)], "g string, n bigint, m double")
    b = spark.createDataFrame([("x", 4, 40.0)], "g string, n bigint, m double")
    c = Context(["g"], [Aggregate("count", "n"), Aggregate("avg", "m")], [Order("g", True)])
    assert [tuple(r) for r in merge([a, b], c).collect()] == [("y", 1, None), ("x", 6, 25.0)]
    assert [tuple(r) for r in merge([a, b], c, "reference").collect()] == [("y", 1, None), ("x", 2, 25.0)]
    w = merge([a, b], Context(["g"], [Aggregate("avg", "m", "n")], [Order("g")]))
    assert w.first()["m"] == 30.0
    assert merge([a, b], Context(order_by=[Order("n")], limit=2, offset=1)).count() == 2
    assert merge([a, b], Context(limit=0, offset=2)).count() == 3
    assert merge([a, b], Context(limit=5, offset=9)).count() == 0
    assert [r[0] for r in merge([a, b], Context(order_by=[Order("m"), Order("nothing")])).select("m").collect()] == [None, 10.0, 40.0]


def test_union_nodes(engine, spark):
    table = engine.router["t_order"]
    all_rows = engine.logical["t_order"].frame()
    e = Engine(spark, rules(), "postgresql")
    e.attach_nodes("t_order", {n: all_rows.where((F.col(DS) == n.source) & (F.col(TBL) == n.table)).select("order_id", "user_id", "status", "amount") for n in table.nodes})
    assert e.sql("SELECT count(*) FROM t_order WHERE user_id = 2").first()[0] == 2
    with pytest.raises(ValueError):
        e.attach_nodes("t_order", {})


def test_null_keys_are_kept(spark, tmp_path):
    e = Engine(spark, rules(), "postgresql")
    e.attach_store("t_order", f"{tmp_path}/o", spark.createDataFrame([(None, None, "a", 1.0), (1, 1, "b", 2.0)], SCHEMA))
    assert e.sql("SELECT * FROM t_order").count() == 2
    assert e.sql("SELECT * FROM t_order WHERE user_id IS NULL").count() == 1


def test_merge_into(engine):
    sql = "MERGE INTO t_order AS t USING (SELECT 1000 AS k, 5.0 AS v UNION ALL SELECT 7777, 6.0) s ON t.order_id = s.k WHEN MATCHED THEN UPDATE SET amount = s.v WHEN NOT MATCHED THEN INSERT (order_id, user_id, amount) VALUES (s.k, 3, s.v)"
    assert engine.execute(sql).affected == 2
    assert rows(engine.sql("SELECT order_id, amount FROM t_order WHERE order_id IN (1000, 7777)")) == [(1000, 5.0), (7777, 6.0)]
    assert engine.sql("SELECT * FROM t_order").count() == 13
    with pytest.raises(DialectError):
        engine.execute("MERGE INTO t_order t USING (SELECT 1000 AS k UNION ALL SELECT 1000) s ON t.order_id = s.k WHEN MATCHED THEN DELETE")


def test_jdbc_nodes(spark, tmp_path):
    """Each node a table of a Derby database, read through JDBC with the filter pushed down."""
    from shardloom.config import DataSource
    from shardloom.sources.catalog import jdbc_frames

    e = Engine(spark, rules(), "postgresql")
    table = e.router["t_order"]
    url = {s: f"jdbc:derby:{tmp_path}/{s};create=true" for s in table.sources}
    dealt = table.dealt(spark.createDataFrame(ORDERS, SCHEMA))
    for n in table.nodes:
        part = dealt.where((F.col(DS) == n.source) & (F.col(TBL) == n.table)).drop(DS, TBL)
        part.write.jdbc(url[n.source], n.table, properties={"driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"})
    sources = {s: DataSource("derby", u) for s, u in url.items()}
    e.attach_nodes("t_order", jdbc_frames(spark, table, sources, driver="org.apache.derby.iapi.jdbc.AutoloadedDriver"))
    df = e.sql("SELECT order_id FROM t_order WHERE user_id = 2")
    assert rows(df) == [(1000,), (1001,)]
    plan = df._jdf.queryExecution().toString()
    assert "PushedFilters" in plan and plan.split("== Physical Plan ==")[-1].count("JDBC") == 2


@pytest.mark.parametrize(
    "statement, nodes",
    [
        ("INSERT INTO t_order (order_id, user_id, status) VALUES (1000, 2, 'X') ON CONFLICT (order_id) DO UPDATE SET status = EXCLUDED.status", 1),
        ("INSERT INTO t_order (order_id, user_id, status) VALUES (1000, 2, 'X') ON CONFLICT (order_id, user_id) DO UPDATE SET status = EXCLUDED.status", 1),
        ("REPLACE INTO t_order (order_id, user_id, status) VALUES (1000, 2, 'X')", 1),
        ("MERGE INTO t_order t USING (SELECT 1000 AS k) s ON t.order_id = s.k WHEN MATCHED THEN UPDATE SET status = 'X'", 1),
        ("INSERT INTO t_order (order_id, user_id, status) VALUES (9000, 2, 'X') ON CONFLICT (order_id) DO UPDATE SET status = EXCLUDED.status", 0),
    ],
)
def test_one_row_rewrites_one_node(engine, statement, nodes):
    store = engine.store("t_order")
    before = set(store.leaves())
    engine.dialect = "mysql" if statement.startswith("REPLACE") else "postgresql"
    engine.execute(statement)
    assert len(before - set(store.leaves())) == nodes
    assert engine.sql("SELECT count(*) FROM t_order WHERE status = 'X'").first()[0] == 1
    assert engine.sql("SELECT count(*) FROM t_order").first()[0] == len(ORDERS) + (nodes == 0)


def test_a_version_has_one_writer_and_is_whole(engine):
    store = engine.store("t_order")
    first, second = store.append(store.frame()), store.append(store.frame())
    store.commit(first)
    with pytest.raises(Conflict):
        store.commit(second)
    second.base = store.version() - 1
    store.version = lambda: second.base  # a writer that hasn't seen the newer version yet
    with pytest.raises(Conflict):
        store.commit(second)
    del store.version
    assert store.version() == 2 and store.frame().count() == 2 * len(ORDERS)


def test_no_store_keeps_half_a_transaction(engine):
    tx = engine.transaction()
    tx.execute("DELETE FROM t_order WHERE user_id = 2")
    tx.execute("DELETE FROM t_user WHERE user_id = 2")
    tx.prepare()
    engine.execute("DELETE FROM t_user WHERE user_id = 3")
    with pytest.raises(Conflict):
        tx.commit()
    assert tx.state is State.FAILED
    assert engine.sql("SELECT count(*) FROM t_order").first()[0] == len(ORDERS) and engine.sql("SELECT count(*) FROM t_user").first()[0] == 7


def test_statements_of_threads_do_not_meet(engine):
    from concurrent.futures import ThreadPoolExecutor

    def run(k):
        return engine.execute(f"UPDATE {['t_order', 't_user'][k]} SET {['status', 'name'][k]} = 'T' WHERE user_id = {2 + k} RETURNING user_id").returning.collect()

    with ThreadPoolExecutor(2) as pool:
        found = list(pool.map(run, (0, 1)))
    assert {r[0] for r in found[0]} == {2} and {r[0] for r in found[1]} == {3}


def test_triggers_are_refused(engine):
    with pytest.raises(DialectError):
        engine.execute("CREATE TRIGGER t BEFORE UPDATE ON t_order FOR EACH ROW EXECUTE FUNCTION f()")


def test_json_concatenation(spark):
    e = Engine(spark, {}, "postgresql")
    got = e.sql("""SELECT '{"a": 1, "b": {"x": [1]}}'::jsonb || '{"a": "q"}' AS o, '[1]'::jsonb || '[2, "z"]'::jsonb AS l, 'a' || 'b' AS s""").first()
    assert (got["o"], got["l"], got["s"]) == ('{"b":{"x":[1]},"a":"q"}', '[1,2,"z"]', "ab")
