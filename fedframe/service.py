"""The engine as tools: JSON in, JSON out, one request a line on standard input.

Requests are {"id", "method", "params"}; methods are tools/list and tools/call
(params: name, arguments), the tools' names themselves, and resources/list and
resources/read (params: uri), which hold documentation.
"""

from __future__ import annotations

import datetime as dt
import decimal
import json
import sys
import time
from collections.abc import Iterable, Iterator

from .engine import Engine
from .errors import FedError
from .functions import SPARK_TYPES
from .lang.parser import AGGREGATES, CLAUSES

#: Rows of an answer; the rest is told by `truncated`.
MOST_ROWS = 1000
TOOLS = {
    "query": {"description": "Run statements of the find dialect; the last one's rows.", "arguments": {"query": "text", "connection": "optional: the default connection", "params": "optional: values of :names"}},
    "describe": {"description": "Columns of a table.", "arguments": {"table": "[schema.]table", "connection": "optional"}},
    "list_tables": {"description": "Tables of a connection.", "arguments": {"connection": "optional"}},
    "explain": {"description": "The tree and Spark's plan of a statement, which is not run.", "arguments": {"query": "text"}},
    "list_connections": {"description": "Connections, their kinds, and entries that failed.", "arguments": {}},
    "help": {"description": "The dialect in short.", "arguments": {}},
}
HELP = """find [distinct] [[expr [as name], ...] from] source [join source on expr] [where expr] [group by ...] [having expr]
     [window w as (...)] [order by ...] [limit n] [offset n] [union|intersect|except [all] find ...] [>> table]
source: [schema.]table[@connection] [as name] | (find ...) as name
with [recursive] name[(columns)] as (find ...) find ...
create table t (...) | create t {column: value} | create t [{...}, ...] | create t (find ...)
update t set column = expr [where expr] | remove t [where expr] | alter table ... | drop table ...
create|drop database d | show tables | describe t | explain ... | :name = expr"""


KEYWORDS = {*CLAUSES, *AGGREGATES, *"find distinct case cast exists any all some true false null with recursive create table database update remove alter add drop rename column default primary key if show tables describe explain ai_query".split()}
#: What can be read: address to its name and text.
RESOURCES = {
    "fedframe://docs": ("The dialect", lambda: f"{HELP}\n\n{_functions()}\n\nTypes: {', '.join(SPARK_TYPES)}."),
    "fedframe://docs/quickref": ("The dialect in short", lambda: HELP),
    "fedframe://docs/keywords": ("Reserved words", lambda: "\n".join(sorted(KEYWORDS))),
}


def _functions() -> str:
    return "Functions: those of Spark SQL; now() and current_timestamp are its current time, concat skips nulls, count() is count(*)."


def _cell(value: object) -> object:
    if isinstance(value, dt.date | dt.datetime | dt.timedelta | decimal.Decimal):
        return str(value)
    if isinstance(value, tuple) and hasattr(value, "asDict"):
        return {k: _cell(v) for k, v in value.asDict().items()}
    if isinstance(value, dict):
        return {str(k): _cell(v) for k, v in value.items()}
    return [_cell(v) for v in value] if isinstance(value, list | tuple) else value


class Service:
    def __init__(self, engine: Engine):
        self.engine = engine

    def call(self, name: str, arguments: dict | None = None) -> dict:
        """A tool's answer; what goes wrong is {"error": ...}."""
        given = arguments or {}
        try:
            if name not in TOOLS:
                raise FedError(f"there is no tool {name}")
            return getattr(self, f"_{name}")(**given)
        except TypeError as e:
            return {"error": f"bad arguments: {e}"}
        except Exception as e:  # noqa: BLE001  an answer must follow
            return {"error": str(e).split("\n\nJVM stacktrace")[0]}

    def _query(self, query: str, connection: str | None = None, params: dict | None = None) -> dict:
        engine, began = self.engine, time.perf_counter()
        if connection:
            chosen = engine.connection(connection)
            first = {chosen.name: chosen}
            engine.connections, kept = first | engine.connections, engine.connections
            try:
                result = engine.execute(query, **(params or {}))
            finally:
                engine.connections = kept
        else:
            result = engine.execute(query, **(params or {}))
        rows = result.frame.limit(MOST_ROWS + 1).collect()
        cut = len(rows) > MOST_ROWS
        total = result.frame.count() if cut else len(rows)
        out = {"columns": result.frame.columns, "rows": [[_cell(v) for v in r] for r in rows[:MOST_ROWS]], "elapsed_ms": round((time.perf_counter() - began) * 1000), "rows_affected": result.rows_affected, "total_rows": total}
        return out | ({"truncated": True} if cut else {})

    def _describe(self, table: str, connection: str | None = None) -> dict:
        schema, _, name = table.rpartition(".")
        found = self.engine.connection(connection).columns(name, schema or None)
        return {"columns": [{"column_name": c.name, "data_type": c.type, "nullable": c.nullable and not c.primary_key, "is_pk": c.primary_key} for c in found]}

    def _list_tables(self, connection: str | None = None) -> dict:
        return {"tables": self.engine.connection(connection).tables()}

    def _explain(self, query: str) -> dict:
        return {"plan": self.engine.describe_plan(query)}

    def _list_connections(self) -> dict:
        return {"connections": [{"name": k, "kind": c.kind} for k, c in self.engine.connections.items()], "models": sorted(self.engine.models), "errors": self.engine.errors}

    def _help(self) -> dict:
        return {"help": HELP}

    def answers(self, lines: Iterable[str]) -> Iterator[str]:
        for line in lines:
            if not line.strip():
                continue
            try:
                asked = json.loads(line)
                method, params = asked.get("method"), asked.get("params") or {}
                if method == "tools/list":
                    result = {"tools": [{"name": k, **v} for k, v in TOOLS.items()]}
                elif method == "resources/list":
                    result = {"resources": [{"uri": k, "name": name, "mimeType": "text/markdown"} for k, (name, _) in RESOURCES.items()]}
                elif method == "resources/read":
                    uri = params.get("uri")
                    result = {"contents": [{"uri": uri, "mimeType": "text/markdown", "text": RESOURCES[uri][1]()}] if uri in RESOURCES else []}
                elif method == "tools/call":
                    result = self.call(params.get("name"), params.get("arguments"))
                else:
                    result = self.call(method, params)
                yield json.dumps({"id": asked.get("id"), "result": result})
            except (ValueError, AttributeError) as e:
                yield json.dumps({"id": None, "error": f"bad request: {e}"})


def main(argv: list[str] | None = None) -> None:
    """python -m fedframe.service CONFIG [--repl]: tools on standard input, or statements to type."""
    from pyspark.sql import SparkSession

    args = sys.argv[1:] if argv is None else argv
    if not args:
        sys.exit(main.__doc__)
    engine = Engine.from_config(SparkSession.builder.appName("fedframe").getOrCreate(), args[0])
    if "--repl" not in args:
        for line in Service(engine).answers(sys.stdin):
            print(line, flush=True)
        return
    while True:
        try:
            text = input("find> ")
        except EOFError:
            return
        try:
            began = time.perf_counter()
            result = engine.execute(text)
            result.frame.show(50, truncate=False)
            print(f"{time.perf_counter() - began:.2f} s, connections: {', '.join(result.connections) or 'none'}")
        except Exception as e:  # noqa: BLE001  the next statement may be right
            print(str(e).split("\n\nJVM stacktrace")[0])


__all__ = ["Service", "main"]

if __name__ == "__main__":
    main()
