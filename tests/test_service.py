"""The tools and the chained query."""

import json

import pytest

from fedframe import Engine
from fedframe.operators.find import find
from fedframe.service import Service
from fedframe.sources import MemoryConnection, ParquetConnection


@pytest.fixture
def engine(spark, sf):
    return Engine(spark, [ParquetConnection(spark, "pq", sf), MemoryConnection(spark, "mem")])


def test_tools(engine):
    s = Service(engine)
    got = s.call("query", {"query": "find [r_name] from region where r_regionkey = :k", "params": {"k": 2}})
    assert got["columns"] == ["r_name"] and got["rows"] == [["ASIA"]] and got["total_rows"] == 1 and "truncated" not in got
    assert s.call("query", {"query": "find lineitem"})["truncated"] and len(s.call("query", {"query": "find lineitem"})["rows"]) == 1000
    assert s.call("query", {"query": "create table t (a int); create t {a: 1}", "connection": "mem"})["rows_affected"] == 1
    assert s.call("list_tables", {"connection": "mem"}) == {"tables": ["t"]} and engine.default == "pq"
    assert s.call("describe", {"table": "region"})["columns"][0]["column_name"] == "r_regionkey"
    assert "PushedFilters" in s.call("explain", {"query": "find region where r_regionkey = 1"})["plan"]
    assert s.call("list_connections")["connections"] == [{"name": "pq", "kind": "parquet"}, {"name": "mem", "kind": "memory"}]
    assert "find" in s.call("help")["help"]
    assert "error" in s.call("nosuch") and "error" in s.call("query", {"query": "find ("}) and "error" in s.call("query", {"nosuch": 1})


def test_lines(engine):
    asked = ['{"id": 1, "method": "tools/list"}', "", "not json", '{"id": 2, "method": "tools/call", "params": {"name": "query", "arguments": {"query": "find [o_orderdate] from orders limit 1"}}}']
    got = [json.loads(x) for x in Service(engine).answers(asked)]
    assert len(got[0]["result"]["tools"]) == 6 and "error" in got[1] and isinstance(got[2]["result"]["rows"][0][0], str)


def test_chained_query(engine):
    q = find(engine, "orders as o").join("customer as c", "o.o_custkey = c.c_custkey").where("o.o_totalprice > :low").where("c.c_acctbal > 0 or c.c_nationkey = 1")
    q = q.select("c.c_mktsegment as s", "count(*) as n").group_by("c.c_mktsegment").having("n > 1").order_by("n desc", "s").limit(3, 1)
    text = "find [c.c_mktsegment as s, count(*) as n] from orders as o join customer as c on o.o_custkey = c.c_custkey where o.o_totalprice > :low and (c.c_acctbal > 0 or c.c_nationkey = 1) group by c.c_mktsegment having n > 1 order by n desc, s limit 3 offset 1"
    assert q.frame(low=1000).collect() == engine.sql(text, low=1000).collect()
    assert find(engine, "region").distinct().select("r_name").persist("names@mem").rows_affected == 5
    assert find(engine, "nation").select("n_name", "cast(rank() over w as int) as r").window("w", "order by n_nationkey").frame().count() == 25
