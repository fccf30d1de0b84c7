"""What is sent to databases, and changes that must not lose rows."""

import sqlite3
import subprocess
import sys
from pathlib import Path

import pytest

from fedframe import Engine
from fedframe.errors import ConfigError, FedError
from fedframe.functions import column_type
from fedframe.lang import parse
from fedframe.operators import ai, statements
from fedframe.plans.lower import NativeLower
from fedframe.service import Service
from fedframe.shared import shared_dir
from fedframe.sources import JdbcConnection, MemoryConnection, ParquetConnection, SqliteConnection, open_all
from fedframe.sources.base import Column
from fedframe.sources.jdbc import jdbc_url, maintenance_url
from fedframe.sources.sqlite import MAX_TASKS, SqliteSource

KINDS = ("postgres", "mysql", "mssql", "derby")


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.fixture
def engine(spark, sf, tmp_path):
    return Engine(spark, [ParquetConnection(spark, "pq", sf), SqliteConnection(spark, "lite", f"{tmp_path}/l.db"), JdbcConnection(spark, "dby", "derby", f"jdbc:derby:{tmp_path}/db;create=true")])


def replace(engine, c):
    engine.sql(f'create table T@{c} (K int primary key, V string); create T@{c} [{{K: 1, V: "a"}}, {{K: 9, V: "z"}}]')
    done = engine.execute(f'find [r_regionkey as K, "new" as V] from region@pq where r_regionkey < 2 >> T@{c} insert if exists on conflict replace')
    assert done.rows_affected == 2
    assert rows(engine.sql(f"find [K, V] from T@{c}")) == [(0, "new"), (1, "new"), (9, "z")]
    engine.sql(f'find [K, "self" as V] from T@{c} where K > 0 >> T@{c} insert if exists on conflict replace')  # reads what it changes
    assert rows(engine.sql(f"find [K, V] from T@{c}")) == [(0, "new"), (1, "self"), (9, "self")]
    assert [r[0] for r in engine.sql(f"show tables @{c}").collect()] == ["T"]  # nothing is left beside


@pytest.mark.parametrize("c", ["lite", "dby"])
def test_conflict_replace_loses_nothing(engine, c):
    replace(engine, c)


def test_without_a_shared_folder(sf, tmp_path):
    """The same, and staged rows, in a session of its own that sets no spark.checkpoint.dir."""
    code = f"""
import sys; sys.path[:0] = [{str(Path(__file__).parent.parent)!r}, {str(Path(__file__).parent)!r}]
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
from fedframe import Engine
from fedframe.shared import shared_dir
from fedframe.sources import JdbcConnection, ParquetConnection, SqliteConnection
import test_databases
engine = Engine(spark, [ParquetConnection(spark, "pq", {sf!r}), SqliteConnection(spark, "lite", {f"{tmp_path}/l.db"!r}), JdbcConnection(spark, "dby", "derby", "jdbc:derby:memory:x;create=true")])
for c in ("lite", "dby"):
    test_databases.replace(engine, c)
assert engine.stage(spark.range(3)).count() == 3 and shared_dir(spark) == shared_dir(spark)
"""
    subprocess.run([sys.executable, "-c", code], check=True, timeout=300, cwd=tmp_path)


@pytest.mark.parametrize("c", ["lite", "dby"])
def test_a_failing_row_takes_all_back(engine, c):
    engine.sql(f"create table T@{c} (K int primary key, V string not null)")
    with pytest.raises(FedError):
        engine.sql(f'create T@{c} [{{K: 1, V: "a"}}, {{K: 2, V: "b"}}, {{K: 1, V: "c"}}]')
    assert rows(engine.sql(f"find T@{c}")) == []
    many = ", ".join(f'{{K: {i}, V: "v" || {i}}}' for i in range(450))
    assert engine.execute(f"create T@{c} [{many}]").rows_affected == 450
    assert engine.sql(f'find T@{c} where V = "v449"').count() == 1


def test_stage_needs_a_shared_folder_on_a_cluster(spark, monkeypatch):
    class Context:
        master = "spark://host:7077"
        getConf = spark.sparkContext.getConf

    class Session:
        sparkContext = Context()

        class conf:  # noqa: N801
            get = staticmethod(lambda key, default=None: default)

    monkeypatch.setattr(Context, "getConf", lambda self: type("C", (), {"get": staticmethod(lambda key: None)})())
    with pytest.raises(ConfigError):
        shared_dir(Session())


def test_addresses():
    assert jdbc_url("postgres", "postgres://u:p%40w@h:5433/db?sslmode=require") == "jdbc:postgresql://h:5433/db?user=u&password=p%40w&sslmode=require"
    assert jdbc_url("postgres", "postgresql://h/db") == "jdbc:postgresql://h/db"
    assert jdbc_url("mysql", "mysql://root@h/shop") == "jdbc:mysql://h/shop?user=root"
    assert jdbc_url("mssql", "mssql://sa:x@h:1433/db") == "jdbc:sqlserver://h:1433;databaseName=db;user=sa;password=x"
    assert jdbc_url("mssql", "Server=tcp:h,1433;Database=db;User Id=sa;Password=x;TrustServerCertificate=true") == "jdbc:sqlserver://h:1433;databaseName=db;user=sa;password=x;trustServerCertificate=true"
    assert jdbc_url("derby", "derby:memory:x") == "jdbc:derby:memory:x" and jdbc_url("mysql", "jdbc:mysql://h/x") == "jdbc:mysql://h/x"
    with pytest.raises(ConfigError):
        jdbc_url("postgres", "nothing")
    assert maintenance_url("postgres", "jdbc:postgresql://h:1/db?user=u") == "jdbc:postgresql://h:1/postgres?user=u"
    assert maintenance_url("mysql", "jdbc:mysql://h/db?user=u") == "jdbc:mysql://h/?user=u"
    assert maintenance_url("mssql", "jdbc:sqlserver://h:1;databaseName=db;user=u") == "jdbc:sqlserver://h:1;user=u;databaseName=master"


def test_one_bad_entry_leaves_the_others(spark, sf, tmp_path):
    entries = [{"name": "m", "kind": "mongodb", "uri": "mongodb://h/db"}, {"name": "x", "kind": "parquet", "uri": "nosuchscheme://x"}, {"name": "a", "kind": "parquet", "uri": sf}, {"name": "l", "kind": "sqlite", "uri": f"sqlite://{tmp_path}/l.db?mode=rwc"}]
    opened, _, errors = open_all(spark, entries)
    assert [c.name for c in opened] == ["a", "l"] and sorted(errors) == ["m", "x"] and opened[1].path == f"{tmp_path}/l.db"


def made(spark, kind):
    conn = JdbcConnection.__new__(JdbcConnection)
    conn.kind, conn.name, conn.schema = kind, kind, None
    return conn


#: Kind to the definition of each column below.
DEFINED = {
    "postgres": ['"k" TEXT NOT NULL PRIMARY KEY', '"s" TEXT', '"f" DOUBLE PRECISION', '"b" BOOLEAN', '"t" TIMESTAMP', '"j" JSONB', '"i" BIGINT'],
    "mysql": ["`k` VARCHAR(255) NOT NULL PRIMARY KEY", "`s` LONGTEXT", "`f` DOUBLE", "`b` BOOLEAN", "`t` DATETIME(6)", "`j` JSON", "`i` BIGINT"],
    "mssql": ["[k] NVARCHAR(450) NOT NULL PRIMARY KEY", "[s] NVARCHAR(MAX)", "[f] FLOAT", "[b] BIT", "[t] DATETIME2", "[j] NVARCHAR(MAX)", "[i] BIGINT"],
    "derby": ['"k" VARCHAR(32000) NOT NULL PRIMARY KEY', '"s" VARCHAR(32000)', '"f" DOUBLE', '"b" BOOLEAN', '"t" TIMESTAMP', '"j" VARCHAR(32000)', '"i" BIGINT'],
}


@pytest.mark.parametrize("kind", KINDS)
def test_column_types(spark, kind):
    columns = [Column("k", "string", False, True), *(Column(n, t) for n, t in (("s", "string"), ("f", "float"), ("b", "bool"), ("t", "datetime"), ("j", "json"), ("i", "int")))]
    assert [made(spark, kind).column_sql(c) for c in columns] == DEFINED[kind]
    assert column_type("sqlite", "float") == "REAL"


#: Kind to a condition's text.
CONDITIONS = {
    "postgres": """(((("a" || 'x\\y') ILIKE 'q%') AND ("t" > (CURRENT_TIMESTAMP - INTERVAL '3' DAY))) AND (extract(year FROM "t") = CAST("s" AS BIGINT))) AND ("b" = TRUE)""",
    "mysql": """(((LOWER(CONCAT(`a`, 'x\\\\y')) LIKE LOWER('q%')) AND (`t` > (CURRENT_TIMESTAMP - INTERVAL 3 DAY))) AND (extract(year FROM `t`) = CAST(`s` AS SIGNED))) AND (`b` = TRUE)""",
    "mssql": """(((LOWER(([a] + 'x\\y')) LIKE LOWER('q%')) AND ([t] > DATEADD(DAY, -3, CURRENT_TIMESTAMP))) AND (DATEPART(year, [t]) = CAST([s] AS BIGINT))) AND ([b] = 1)""",
    "derby": """(((LOWER(("a" || 'x\\y')) LIKE LOWER('q%')) AND ("t" > {fn TIMESTAMPADD(SQL_TSI_DAY, -3, CURRENT_TIMESTAMP)})) AND (YEAR("t") = CAST("s" AS BIGINT))) AND ("b" = TRUE)""",
}


@pytest.mark.parametrize("kind", KINDS)
def test_conditions(spark, kind):
    (s,) = parse('remove x where a || "x\\\\y" ilike "q%" and t > now() - 3d and extract(year from t) = s::int and b = true')
    conn = made(spark, kind)
    assert NativeLower(kind, lambda t: t.name, conn.identifier, conn.literal, {}).expr(s.where) == f"({CONDITIONS[kind]})"


def test_derby_and_sqlite_run_their_forms(engine):
    for c in ("dby", "lite"):
        engine.sql(f'create table T@{c} (K int, T datetime, V string); create T@{c} [{{K: 1, T: "2020-01-31 00:00:00"::datetime, V: "Abc"}}, {{K: 12, T: "2021-01-31 00:00:00"::datetime, V: null}}]')
        assert engine.execute(f'update T@{c} set V = V || "d" where V ilike "ab%" and extract(year from T) = 2020 and K % 5 = 1').rows_affected == 1
        assert engine.execute(f"remove T@{c} where T < now() - 2d and K > 5").rows_affected == 1
        assert [r.V for r in engine.sql(f"find T@{c}").collect()] == ["Abcd"]


def test_sparse_row_ids_make_few_ranges(tmp_path):
    path = f"{tmp_path}/s.db"
    with sqlite3.connect(path) as db:
        db.execute("create table t (k integer primary key, v text collate nocase)")
        db.executemany("insert into t values (?, ?)", [(1, "a"), (2**62, "A")])
    source = SqliteSource({"path": path, "table": "t"})
    reader = source.reader(source.schema())
    assert len(reader.partitions()) <= MAX_TASKS + 1 and reader.partitions()[-1].high == 2**62


def test_text_is_compared_as_spark_does(spark, tmp_path):
    with sqlite3.connect(f"{tmp_path}/s.db") as db:
        db.execute("create table t (v text collate nocase)")
        db.executemany("insert into t values (?)", [("a",), ("A",)])
    engine = Engine(spark, [SqliteConnection(spark, "s", f"{tmp_path}/s.db")])
    assert rows(engine.sql('find t where v = "a"')) == [("a",)]


def test_keys_are_checked_against_old_and_new(spark, sf, tmp_path):
    engine = Engine(spark, [ParquetConnection(spark, "w", f"{tmp_path}/w"), MemoryConnection(spark, "mem")])
    engine.sql("create table t@w (a int primary key, b int); create t@w [{a: 1, b: 1}, {a: 2, b: 2}]")
    for bad in ("create t@w [{a: 3}, {a: 3}]", "create t@w {a: 2}"):
        with pytest.raises(FedError):
            engine.sql(bad)
    assert engine.execute("create t@w {a: 3}").rows_affected == 1


def test_unknown_escapes_keep_their_backslash(spark, sf):
    engine = Engine(spark, [ParquetConnection(spark, "pq", sf)])
    got = engine.sql(r'find [regexp_replace("a12b3", "\d+", "#") as x, "q\"\\n\n" as y]').first()
    assert (got.x, got.y) == ("a#b#", 'q"\\n\n')


def test_the_answer_tells_all_rows(spark, sf):
    s = Service(Engine(spark, [ParquetConnection(spark, "pq", sf)]))
    got = s.call("query", {"query": "find lineitem"})
    assert got["total_rows"] == 6000 and len(got["rows"]) == 1000 and got["truncated"] and got["elapsed_ms"] > 0
    listed, read = s.answers(['{"id": 1, "method": "resources/list"}', '{"id": 2, "method": "resources/read", "params": {"uri": "fedframe://docs/quickref"}}'])
    assert "fedframe://docs" in listed and "find [distinct]" in read


def test_calls_share_the_concurrency(spark):
    """Tasks that run at once have together no more calls than the endpoint allows."""
    df = spark.range(64).repartition(16).selectExpr("cast(id as string) as p")
    out = ai.apply(df, [("p", ai.AiConfig("m", "openai", "http://x", concurrency=3), "m")], lambda *a: {"choices": [{"message": {"content": "ok"}}]})
    assert out.rdd.getNumPartitions() == 3 and out.where("p = 'ok'").count() == 64
    assert statements.VALUES_AT_ONCE >= 1


def test_keys_go_to_the_database(spark, engine):
    engine.sql("find [o_orderkey as O_ORDERKEY, o_orderpriority as P] from orders@pq >> ORDERS@dby")
    text = "find [l.l_orderkey, o.P] from lineitem@pq l {} join ORDERS@dby o on l.l_orderkey = o.O_ORDERKEY where {}"
    plan = lambda df: df._jdf.queryExecution().toString()
    few = engine.sql(text.format("", "l.l_orderkey in (3, 5)"))
    assert "O_ORDERKEY IN (3" in plan(few).replace("in (", "IN (")
    many = engine.sql(text.format("left", "l.l_orderkey < 1500"))  # more than a list holds
    assert plan(many).count("O_ORDERKEY IN (") >= 2 and " OR " in plan(many)
    plain = Engine(spark, engine.connections.values(), key_joins=False)
    for join, where in (("", "l.l_orderkey in (3, 5)"), ("left", "l.l_orderkey < 1500"), ("left", "l.l_quantity > 1000"), ("right", "l.l_quantity > 49"), ("full", "1 = 1")):
        assert rows(engine.sql(text.format(join, where))) == rows(plain.sql(text.format(join, where)))
    none = engine.sql(text.format("", "l.l_quantity > 1000"))
    assert none.count() == 0
    cte = "with ORDERS as (find [r_regionkey as O_ORDERKEY, r_name as P] from region@pq) find [l.l_orderkey, o.P] from lineitem@pq l join ORDERS o on l.l_orderkey = o.O_ORDERKEY"
    assert rows(engine.sql(cte)) == rows(plain.sql(cte))


def test_filtered_branches_are_joined_first(spark, sf):
    engine = Engine(spark, [ParquetConnection(spark, "pq", sf)])
    from fedframe.plans.lower import filtered_branches
    from fedframe.queries import TEXTS

    five = TEXTS["join_multi5"][0]
    assert filtered_branches(parse(five)[0]) == {4: 3, 3: 2}
    for text in (five.replace('r.r_name = "ASIA" and', ""), five.replace("join region", "left join region"), five.replace("[n.n_name, round", "[*, round")):
        assert filtered_branches(parse(text)[0]) == {}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = engine.sql(five)._jdf.queryExecution().optimizedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    depth = {t: len(line) - len(line.lstrip(" :+-|")) for line in plan.splitlines() for t in ("c_custkey", "r_regionkey") if "Relation" in line and t in line}
    assert depth["r_regionkey"] > 0


def test_filtered_joins_of_the_first_table_lead(spark, sf):
    from duck import assert_same

    from fedframe.plans.lower import Lower, leading_joins
    from fedframe.queries import FEDERATED, TEXTS

    triple = parse(FEDERATED["fed_triple"][0])[0]
    assert leading_joins(triple) == [2]
    text = Lower(lambda t: t.name).query(triple)
    assert text.index("JOIN part") < text.index("JOIN supplier") < text.index("JOIN NATION")
    assert leading_joins(parse(TEXTS["join_multi5"][0])[0]) == [0]
    ends = " join c on a.k = c.k where c.f = 1"
    assert leading_joins(parse(f"find [a.x] from a join b on a.k = b.k{ends}")[0]) == [1]
    for other in ("a join b on k = b.k", "a left join b on a.k = b.k", "a, d join b on a.k = b.k", "a join b on a.k = b.k and a.k in (find [k] from d)"):
        assert leading_joins(parse(f"find [a.x] from {other}{ends}")[0]) == []
    engine = Engine(spark, [ParquetConnection(spark, "pq", sf)])
    asked = "find [l.l_orderkey, l.l_linenumber, s.s_name, p.p_name] from lineitem l join supplier s on l.l_suppkey = s.s_suppkey join part p on p.p_partkey = l.l_partkey where p.p_size < 10"
    assert_same(engine.sql(asked), asked.replace("find [", "SELECT ").replace("] from", " FROM"), sf)
