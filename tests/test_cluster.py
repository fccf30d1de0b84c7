"""Queries whose tasks run in other processes than the driver, which only share a folder with it."""

import importlib.util
import json
import os
import subprocess
import sys
from pathlib import Path

import pytest
from duck import counted, oracle

from fedframe import queries as registered
from fedframe.sources.jdbc import in_driver

ROOT = Path(__file__).resolve().parent.parent
QUERIES = [
    "fed_aggregate_pushed",
    "fed_documents",
    "fed_key_batches",
    "fed_orc",
    "refused_statements",
    "fed_cross_with_limit",
    "fed_full_join",
    "fed_key_join",
    "fed_persist_to_jdbc",
    "fed_cte",
    "fed_join_parquet_jdbc",
    "fed_left_join",
    "fed_triple",
]

CODE = """
import json, sys
sys.path[:0] = [{root!r}, {root!r} + "/tests"]
from pyspark.sql import SparkSession
settings = {{"spark.master": "local-cluster[2,2,1024]", "spark.executor.memory": "700m", "spark.driver.host": "127.0.0.1", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false",
    "spark.sql.shuffle.partitions": "4", "spark.sql.session.timeZone": "UTC", "spark.checkpoint.dir": "file://{tmp}/shared", "spark.sql.warehouse.dir": "{tmp}/warehouse"}}
spark = SparkSession.builder.config(map=settings).getOrCreate()
import test_databases
from fedframe import Engine
from fedframe import queries as registered
from fedframe.sources import JdbcConnection, ParquetConnection
told, made = {{}}, registered.queries()
def held(name, run):
    try:
        told[name] = run()
    except Exception as e:
        told[name] = "".join(str(e).splitlines()[:2])
def result(name):
    df = made[name](spark, {sf!r})
    return [df.columns, [list(r) for r in df.collect()]]
for name in {queries!r}:
    held(name, lambda: result(name))
def changes():
    engine = Engine(spark, [ParquetConnection(spark, "pq", {sf!r}), JdbcConnection(spark, "dby", "derby", "jdbc:derby:{tmp}/db;create=true")])
    test_databases.replace(engine, "dby")
    before = engine.sql("find T@dby")
    done = engine.execute('find [K + 100 as K, V] from T@dby >> T@dby').rows_affected  # reads what it changes
    engine.sql('update T@dby set V = "y" where K = 100')
    try:
        engine.sql("find [n_nationkey + 1000 * (n_nationkey % 24) as K, n_name as V] from nation@pq where n_nationkey > 0 union all find [100 as K, \\"twice\\" as V] >> T@dby")
        failed = False
    except Exception:
        failed = True
    return [done, before.count(), failed, sorted(map(list, engine.sql("find [K, V] from T@dby").collect())), engine.sql("find [V] from T@dby where K in (1, 101)").count()]
held("changes", changes)
json.dump(told, open("{tmp}/told", "w"), default=str)
spark.stop()
"""


@pytest.fixture(scope="module")
def told(tmp_path_factory, sf):
    tmp = tmp_path_factory.mktemp("cluster")
    (tmp / "home" / "work").mkdir(parents=True)  # executors' folders are made in Spark's home
    for p in Path(importlib.util.find_spec("pyspark").origin).parent.iterdir():
        if p.name != "work":
            (tmp / "home" / p.name).symlink_to(p)
    env = os.environ | {"SPARK_HOME": str(tmp / "home"), "SPARK_SCALA_VERSION": "2.13", "SPARK_LOCAL_IP": "127.0.0.1", "SPARK_LOCAL_DIRS": str(tmp / "local"), "PYSPARK_PYTHON": sys.executable, "PYSPARK_SUBMIT_ARGS": "pyspark-shell"}
    subprocess.run([sys.executable, "-c", CODE.format(root=str(ROOT), tmp=tmp, sf=sf, queries=QUERIES)], check=True, timeout=600, cwd=tmp, env=env)
    return json.loads((tmp / "told").read_text())


@pytest.mark.parametrize("name", QUERIES)
def test_query(name, told, sf):
    assert not isinstance(told[name], str), told[name]
    columns, rows = told[name]
    names, wanted = oracle(registered.oracle_sql()[name], sf)
    assert counted([x.lower() for x in columns], rows) == counted(names, wanted)


def test_changes(told):
    """Each read has the changes before it, a frame those before it was made; rows that can't all be added leave none."""
    old = [[0, "new"], [1, "self"], [9, "self"]]
    assert told["changes"] == [3, 3, True, [*old, [100, "y"], [101, "self"], [109, "self"]], 2]


def test_addresses_of_the_drivers_databases():
    assert all(map(in_driver, ("jdbc:derby:memory:x;create=true", "jdbc:derby:/tmp/db", "jdbc:derby:directory:db")))
    assert not any(map(in_driver, ("jdbc:derby://host:1527/db", "jdbc:derby:jar:(/x.jar)db", "jdbc:derby:classpath:db", "jdbc:postgresql://h/db")))
