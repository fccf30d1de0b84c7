"""Statements, connections and errors."""

import sqlite3

import pytest

from fedframe import Engine
from fedframe.errors import ConfigError, ConnectionNotFound, ConstraintError, FedError, GuardError, Unsupported
from fedframe.operators.ai import AiConfig, ask
from fedframe.operators.key_join import key_join
from fedframe.sources import CsvConnection, DocumentConnection, JdbcConnection, MemoryConnection, OrcConnection, ParquetConnection, SqliteConnection, load_config


@pytest.fixture
def engine(spark, sf, tmp_path):
    return Engine(spark, [ParquetConnection(spark, "pq", sf), ParquetConnection(spark, "w", f"{tmp_path}/w"), MemoryConnection(spark, "mem"), DocumentConnection(spark, "doc", f"{tmp_path}/doc"), OrcConnection(spark, "orc", f"{tmp_path}/orc"), SqliteConnection(spark, "lite", f"{tmp_path}/l.db")])


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


KINDS = ["w", "mem", "doc", "orc", "lite"]


@pytest.mark.parametrize("c", KINDS)
def test_rows_come_and_go(engine, c):
    engine.sql(f'create table t@{c} (id int primary key, v string default "d", x float)')
    assert engine.execute(f'create t@{c} [{{id: 1, x: 0.5}}, {{id: 2, v: "it\'s", x: 1.5}}]').rows_affected == 2
    assert engine.execute(f"update t@{c} set x = x * 2, v = null where id = 2").rows_affected == 1
    assert engine.execute(f"update t@{c} set x = 0 where v = \"none\"").rows_affected == 0
    assert rows(engine.sql(f"find [id, v, x] from t@{c}")) == [(1, "d", 0.5), (2, None, 3.0)]
    assert engine.execute(f"remove t@{c} where x > 1").rows_affected == 1
    assert engine.execute(f"find [3 as id, \"n\" as v, 0.0 as x] from region@pq where r_regionkey = 0 >> t@{c}").rows_affected == 1
    assert rows(engine.sql(f"find [id, v, x] from t@{c}")) == [(1, "d", 0.5), (3, "n", 0.0)]
    assert [r[0] for r in engine.sql(f"show tables @{c}").collect()] == ["t"]
    assert [(r[0], r[2], r[3]) for r in engine.sql(f"describe t@{c}").collect()][0] == ("id", "NO", "PK")
    engine.sql(f"drop table t@{c}")
    assert engine.sql(f"show tables @{c}").count() == 0
    with pytest.raises(FedError):
        engine.sql(f"drop table t@{c}")
    engine.sql(f"drop table if exists t@{c}")


@pytest.mark.parametrize("c", KINDS)
def test_conflicts(engine, c):
    engine.sql(f'create table t@{c} (k int primary key, v string); create t@{c} [{{k: 1, v: "a"}}, {{k: 9, v: "z"}}]')
    engine.sql(f'find [r_regionkey as k, "new" as v] from region@pq where r_regionkey < 3 >> t@{c} insert if exists on conflict ignore')
    assert rows(engine.sql(f"find [k, v] from t@{c}")) == [(0, "new"), (1, "a"), (2, "new"), (9, "z")]
    engine.sql(f'find [r_regionkey as k, "newer" as v] from region@pq where r_regionkey < 2 >> t@{c} insert if exists on conflict replace')
    assert rows(engine.sql(f"find [k, v] from t@{c}")) == [(0, "newer"), (1, "newer"), (2, "new"), (9, "z")]


@pytest.mark.parametrize("c", KINDS)
def test_constraints(engine, c):
    engine.sql(f'create table t@{c} (id int primary key, v string not null); create t@{c} {{id: 1, v: "a"}}')
    for bad in (f'create t@{c} {{id: 1, v: "b"}}', f"create t@{c} {{id: 2}}", f'create t@{c} {{id: 2, v: "x", nosuch: 1}}', f"update t@{c} set v = null"):
        with pytest.raises((ConstraintError, FedError)):
            engine.sql(bad)
    assert rows(engine.sql(f"find t@{c}")) == [(1, "a")]
    with pytest.raises(FedError):
        engine.sql(f"create table t@{c} (a int)")
    engine.sql(f"create table if not exists t@{c} (a int)")


def test_nothing_persisted_makes_no_table(engine):
    assert engine.execute("find region where r_regionkey < 0 >> none@w").rows_affected == 0
    assert engine.sql("show tables @w").count() == 0
    assert engine.sql("find region where r_regionkey < 0").columns == ["r_regionkey", "r_name"]


@pytest.mark.parametrize("c", ["w", "mem"])
def test_alter(engine, c):
    engine.sql(f'create table t@{c} (a int, b string); create t@{c} [{{a: 1, b: "2"}}, {{a: null, b: "x"}}]')
    engine.sql(f"alter table t@{c} alter column b type int; alter table t@{c} add c string not null default \"c\"; alter table t@{c} rename a to z")
    assert rows(engine.sql(f"find [z, b, c] from t@{c}")) == [(1, 2, "c"), (None, None, "c")]
    with pytest.raises(ConstraintError):
        engine.sql(f"alter table t@{c} alter column z not null")
    for bad in ("add c int", "drop nosuch", "rename nosuch to a"):
        with pytest.raises(FedError):
            engine.sql(f"alter table t@{c} {bad}")
    engine.sql(f"alter table t@{c} drop column z; alter table t@{c} alter column c drop default; create t@{c} {{b: 5, c: \"y\"}}; alter table t@{c} rename to u")
    assert rows(engine.sql(f"find u@{c}")) == [(2, "c"), (5, "y"), (None, "c")]


def test_csv_is_read_only(spark, tmp_path):
    (tmp_path / "t.csv").write_text('a,b\n1,"x, ""y"""\n,""\n3,\n')
    engine = Engine(spark, [CsvConnection(spark, "csv", str(tmp_path))])
    assert rows(engine.sql("find [a::int as a, b] from t")) == sorted([(1, 'x, "y"'), (None, None), (3, None)], key=repr)
    assert [r[0] for r in engine.sql("show tables").collect()] == ["t"]
    for bad in ("create t {a: 1}", "update t set a = 1", "remove t", "drop table t", "alter table t add column c int", "create table u (a int)", "find t >> u"):
        with pytest.raises(Unsupported):
            engine.sql(bad)
    assert rows(engine.sql("find [count(*) as n] from t")) == [(3,)]


def test_documents_cannot_be_altered(engine):
    engine.sql("create table t@doc (a int)")
    with pytest.raises(Unsupported):
        engine.sql("alter table t@doc add b int")


def test_databases(engine):
    engine.sql("create database d@w; create table d.t@w (a int); create d.t@w {a: 4}")
    assert rows(engine.sql("find d.t@w")) == [(4,)]
    with pytest.raises(FedError):
        engine.sql("create database d@w")
    engine.sql("drop database d@w; drop database if exists d@w")
    with pytest.raises(Unsupported):
        engine.sql("create database d@lite")


def test_jdbc(spark, engine, tmp_path):
    db = engine.add(JdbcConnection(spark, "dbt", "derby", f"jdbc:derby:{tmp_path}/db;create=true"))
    engine.sql('create table T@dbt (ID int primary key, V string default "d"); create T@dbt [{ID: 1}, {ID: 2, V: "it\'s"}]; alter table T@dbt add W float default 1.5')
    assert engine.execute("update T@dbt set V = \"x\" where ID = 2").rows_affected == 1
    assert rows(engine.sql("find T@dbt")) == [(1, "d", 1.5), (2, "x", 1.5)]
    engine.sql("find [r_regionkey + 10 as ID, r_name as V, 0.0 as W] from region@pq >> T@dbt; alter table T@dbt rename V to X; alter table T@dbt rename to U")
    assert engine.sql("find [count(*)] from U@dbt").first()[0] == 7
    plan = engine.sql("find [X] from U@dbt where ID = 2")._jdf.queryExecution().toString()
    assert "ID" in plan and "PushedFilters: [ID IS NOT NULL, ID = 2]" in plan
    counted = engine.sql("find [X, count(*) as n] from U@dbt group by X")._jdf.queryExecution().toString()
    assert "PushedAggregates: [COUNT(*)]" in counted
    joined = key_join(engine.sql("find [r_regionkey + 10 as k] from region@pq where r_regionkey < 2"), engine.table("U@dbt"), "k", "ID")
    assert joined.count() == 2 and "IN (10" in joined._jdf.queryExecution().toString().replace("ID IN", "IN")
    with pytest.raises(Unsupported):
        engine.sql("remove U@dbt where ID in (find [r_regionkey] from region@pq)")
    assert db.columns("nosuch") == [] and engine.sql("describe nosuch@dbt").count() == 0


def test_sqlite_takes_filters(spark, engine, tmp_path):
    with sqlite3.connect(f"{tmp_path}/l.db") as db:
        db.execute("create table n (a integer, b text, t timestamp, f boolean)")
        db.executemany("insert into n values (?, ?, ?, ?)", [(i, f"b{i}", "2001-02-03 04:05:06", i % 2) for i in range(100)])
    df = engine.sql('find [a, b] from n@lite where a >= 10 and a < 13 and b != "b11"')
    assert rows(df) == [(10, "b10"), (12, "b12")]
    assert engine.sql("find [max(t)] from n@lite where f").first()[0].year == 2001


def test_guards_and_names(spark, sf, engine):
    engine.sql("create table t@mem (a int); create t@mem {a: 1}")
    with pytest.raises(GuardError):
        engine.sql("find [a, r_name] from t@mem cross join region@pq")
    with pytest.raises(GuardError):
        engine.sql("find [a, r_name] from t@mem, region@pq")
    assert engine.sql("find [a, r_name] from t@mem cross join region@pq limit 3").count() == 3
    assert engine.sql("find [r_name, n_name] from region cross join nation").count() == 125
    capped = Engine(spark, [ParquetConnection(spark, "pq", sf)], cross_join_limit=10)
    assert capped.sql("find region cross join nation").count() == 10
    with pytest.raises(ConnectionNotFound):
        engine.sql("find t@nosuch")
    with pytest.raises(Exception, match="nosuch"):
        engine.sql("find nosuch@pq")


def test_lenient_and_strict(spark, sf):
    strict = Engine(spark, [ParquetConnection(spark, "pq", sf)], lenient=False)
    with pytest.raises(Exception, match="DIVIDE_BY_ZERO"):
        strict.sql("find [1 / 0 as x]").collect()
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        strict.sql('find ["x"::int as x]').collect()


def test_parameters_are_bound(engine):
    assert engine.sql("find [r_regionkey] from region where r_name = :name", name="ASIA").count() == 1
    assert engine.sql("find region where r_name = :name", name="x' or '1' = '1").count() == 0
    engine.sql(":k = 1 + 1")
    assert engine.sql("find [:k * 2 as x]").first()[0] == 4
    assert engine.sql("find [:k as x]", k=7).first()[0] == 7


def test_explain_runs_nothing(engine):
    lines = [r["plan"] for r in engine.sql("explain find [r_name] from region where r_regionkey = 1 >> t@w").orderBy("line").collect()]
    assert lines[0] == "-- statement" and "-- connections: pq, w" in lines
    assert any("PushedFilters" in x and "EqualTo(r_regionkey,1)" in x for x in lines)
    assert engine.sql("show tables @w").count() == 0


def test_plans_push_and_prune(engine):
    plan = engine.sql("find [l_returnflag, sum(l_quantity) as q] from lineitem where l_shipdate > \"2000-01-01\"::timestamp group by l_returnflag")._jdf.queryExecution().toString()
    assert "ReadSchema: struct<l_quantity:double,l_returnflag:string,l_shipdate:timestamp" in plan and "GreaterThan(l_shipdate" in plan
    joined = engine.sql("find [c.c_name] from orders o join customer c on o.o_custkey = c.c_custkey where c.c_acctbal > 9000")._jdf.queryExecution().toString()
    assert "GreaterThan(c_acctbal,9000.0)" in joined and "BroadcastHashJoin" in joined
    top = engine.sql("find [x.k] from (find [o_orderkey as k, row_number() over (partition by o_custkey order by o_orderkey) as rn] from orders) as x where x.rn <= 2")._jdf.queryExecution().toString()
    assert "WindowGroupLimit" in top


def test_config(spark, sf, tmp_path):
    path = tmp_path / "c.yaml"
    path.write_text("- {name: a, kind: parquet, uri: '${ROOT}'}\n- {name: b, kind: nosuch, uri: x}\n- {name: m, kind: ai, provider: openai, uri: http://x, concurrency: 3}\n")
    entries = load_config(str(path), {"ROOT": sf})
    assert entries[0]["uri"] == sf and load_config(str(tmp_path / "none")) == []
    with pytest.raises(ConfigError):
        load_config(str(path), {})
    path.write_text(path.read_text().replace("${ROOT}", sf))
    engine = Engine.from_config(spark, str(path))
    assert engine.sql("find region").count() == 5 and engine.models["m"].concurrency == 3 and "unknown kind" in engine.errors["b"]
    with pytest.raises(ConnectionNotFound, match="unknown kind"):
        engine.sql("find t@b")


def test_ai(engine):
    sent = []

    def transport(url, headers, body, timeout):
        sent.append((url, headers, body))
        return {"choices": [{"message": {"content": "o"}}], "content": [{"type": "text", "text": "a"}], "candidates": [{"content": {"parts": [{"text": "g"}]}}]}

    for provider, answer, end in (("openai", "o", "/chat/completions"), ("anthropic", "a", "/v1/messages"), ("gemini", "g", "/models/m:generateContent")):
        assert ask(AiConfig("x", provider, "http://h/", key="k", model="m"), "m", "p", transport) == answer
        assert sent[-1][0] == f"http://h{end}"
    engine.models["x"] = AiConfig("x", "openai", "http://127.0.0.1:9", timeout=0.2)
    for bad in ("find [ai_query(\"nosuch\", r_name)] from region", "find [upper(ai_query(\"x\", r_name))] from region", "find region where ai_query(\"x\", r_name) = \"a\""):
        with pytest.raises(FedError):
            engine.sql(bad)
    cells = [r[0] for r in engine.sql('find [ai_query("x", r_name)] from region limit 2').collect()]
    assert all(c.startswith("[AI Error: ") for c in cells)
