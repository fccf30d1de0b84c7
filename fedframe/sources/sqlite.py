"""SQLite files, through a Python data source.

The source hands comparisons with constants to SQLite, and reads ranges of rowids
in parallel tasks. The file must be at a path that every executor can open.
"""

from __future__ import annotations

import sqlite3
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, IsNotNull, IsNull, LessThan, LessThanOrEqual

from ..errors import ConnectionFailed, FedError
from ..functions import column_type
from ..plans.lower import quote
from ..shipping import ship
from .base import Column, Connection

#: Row ids in a task's range, unless that would make more than MAX_TASKS ranges: ids may be sparse.
ROWS_PER_TASK, MAX_TASKS = 500_000, 1_000
ROWS_PER_BATCH = 10_000
_COMPARE = {EqualTo: "=", GreaterThan: ">", GreaterThanOrEqual: ">=", LessThan: "<", LessThanOrEqual: "<="}


def _ident(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def _spark_type(declared: str) -> T.DataType:
    """By SQLite's affinity rules, and booleans and times by name."""
    d = declared.upper()
    if "BOOL" in d:
        return T.BooleanType()
    if "TIME" in d or "DATE" in d:
        return T.TimestampType()
    if "INT" in d:
        return T.LongType()
    return T.StringType() if any(x in d for x in ("CHAR", "CLOB", "TEXT")) else T.DoubleType() if any(x in d for x in ("REAL", "FLOA", "DOUB", "NUM", "DEC")) else T.StringType()


class _Range(InputPartition):
    def __init__(self, low: int | None, high: int | None):
        self.low, self.high = low, high


class _Reader(DataSourceReader):
    def __init__(self, path: str, table: str, schema: T.StructType):
        self.path, self.table, self.schema = path, table, schema
        self.tests: list[tuple[str, object]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            name = _ident(f.attribute[0]) if hasattr(f, "attribute") and len(f.attribute) == 1 else None
            op = _COMPARE.get(type(f))
            if name and op and isinstance(f.value, int | float | str) and not isinstance(f.value, bool):
                self.tests.append((f"{name} {op} ?" + " COLLATE BINARY" * isinstance(f.value, str), f.value))  # as Spark compares
            elif name and isinstance(f, IsNull | IsNotNull):
                self.tests.append((f"{name} IS {'' if isinstance(f, IsNull) else 'NOT '}NULL", None))
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        with sqlite3.connect(self.path) as db:
            try:
                low, high = db.execute(f"SELECT min(rowid), max(rowid) FROM {_ident(self.table)}").fetchone()
            except sqlite3.OperationalError:  # views and tables without rowids
                return [_Range(None, None)]
        if low is None:
            return [_Range(None, None)]
        step = max(ROWS_PER_TASK, -(-(high - low + 1) // MAX_TASKS))
        return [_Range(x, min(high, x + step - 1)) for x in range(low, high + 1, step)]

    def read(self, part: _Range) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(self.schema)
        tests, values = [t for t, _ in self.tests], [v for t, v in self.tests if " ?" in t]
        if part.low is not None:
            tests, values = [*tests, "rowid BETWEEN ? AND ?"], [*values, part.low, part.high]
        text = f"SELECT {', '.join(map(_ident, self.schema.names))} FROM {_ident(self.table)}" + (f" WHERE {' AND '.join(tests)}" if tests else "")
        db = sqlite3.connect(f"file:{self.path}?mode=ro", uri=True)
        try:
            found = db.execute(text, values)
            while rows := found.fetchmany(ROWS_PER_BATCH):
                columns = [self._column([r[i] for r in rows], f) for i, f in enumerate(arrow)]
                yield pa.RecordBatch.from_arrays(columns, schema=arrow)
        finally:
            db.close()

    @staticmethod
    def _column(values: list, f: pa.Field) -> pa.Array:
        if pa.types.is_timestamp(f.type):
            import datetime as dt

            values = [v if v is None else dt.datetime.fromtimestamp(v, dt.UTC) if isinstance(v, int | float) else dt.datetime.fromisoformat(v) for v in values]
            values = [v if v is None or v.tzinfo else v.replace(tzinfo=dt.UTC) for v in values]
        elif pa.types.is_boolean(f.type):
            values = [None if v is None else bool(v) for v in values]
        elif pa.types.is_string(f.type):
            values = [v if v is None or isinstance(v, str) else str(v) for v in values]
        elif pa.types.is_floating(f.type):
            values = [None if v is None else float(v) for v in values]
        return pa.array(values, f.type)


class SqliteSource(DataSource):
    """spark.read.format("fedframe_sqlite").option("path", ...).option("table", ...)"""

    @classmethod
    def name(cls) -> str:
        return "fedframe_sqlite"

    def schema(self) -> T.StructType:
        with sqlite3.connect(self.options["path"]) as db:
            rows = db.execute(f"PRAGMA table_info({_ident(self.options['table'])})").fetchall()
        if not rows:
            raise FedError(f"there is no table {self.options['table']}")
        return T.StructType([T.StructField(r[1], _spark_type(r[2])) for r in rows])

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return _Reader(self.options["path"], self.options["table"], schema)


class SqliteConnection(Connection):
    kind, native = "sqlite", True

    def __init__(self, spark: SparkSession, name: str, path: str):
        super().__init__(spark, name)
        ship(spark)
        self.path = path
        spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
        spark.dataSource.register(SqliteSource)
        try:
            sqlite3.connect(path).close()
        except sqlite3.Error as e:
            raise ConnectionFailed(f"{name}: {e}") from e

    def _query(self, sql: str) -> list[tuple]:
        db = sqlite3.connect(self.path)
        try:
            return db.execute(sql).fetchall()
        finally:
            db.close()

    def execute(self, sql: str) -> int:
        return self.transaction([sql])

    def transaction(self, texts: list[str]) -> int:
        db = sqlite3.connect(self.path)
        try:
            with db:
                return sum(max(0, db.execute(sql).rowcount) for sql in texts)
        except sqlite3.Error as e:
            raise FedError(f"{self.name}: {e}") from e
        finally:
            db.close()

    def qualified(self, table: str, schema: str | None) -> str:
        return self.identifier(table)

    def relation(self, table: str, schema: str | None = None) -> str:
        view = f"__{self.name}____{table}"
        self.spark.read.format("fedframe_sqlite").options(path=self.path, table=table).load().createOrReplaceTempView(quote(view))
        return quote(view)

    def tables(self, schema: str | None = None) -> list[str]:
        return [r[0] for r in self._query("SELECT name FROM sqlite_master WHERE type IN ('table', 'view') AND name NOT LIKE 'sqlite_%' ORDER BY name")]

    def columns(self, table: str, schema: str | None = None) -> list[Column]:
        return [Column(r[1], r[2].lower(), not r[3] and not r[5], bool(r[5]), r[4]) for r in self._query(f"PRAGMA table_info({_ident(table)})")]

    def column_sql(self, c: Column) -> str:
        made = f"{self.identifier(c.name)} {column_type("sqlite", c.type)}"
        made += f" DEFAULT {c.default}" if c.default is not None else ""
        return made + (" NOT NULL" if not c.nullable or c.primary_key else "") + (" PRIMARY KEY" if c.primary_key else "")

    def create(self, table: str, columns: list[Column], schema: str | None = None) -> None:
        self.execute(f"CREATE TABLE {self.identifier(table)} ({', '.join(map(self.column_sql, columns))})")

    def drop(self, table: str, schema: str | None = None) -> None:
        self.execute(f"DROP TABLE {self.identifier(table)}")

    def append(self, table: str, df: DataFrame, schema: str | None = None) -> None:
        """Rows arrive at the driver a partition at a time: SQLite has one writer."""
        names = df.columns
        text = f"INSERT INTO {self.identifier(table)} ({', '.join(map(self.identifier, names))}) VALUES ({', '.join('?' * len(names))})"
        db = sqlite3.connect(self.path)
        try:
            with db:
                db.executemany(text, (tuple(str(v) if hasattr(v, "isoformat") else v for v in row) for row in df.toLocalIterator()))
        except sqlite3.Error as e:
            raise FedError(f"{self.name}: {e}") from e
        finally:
            db.close()

    def rename(self, table: str, new: str, schema: str | None = None) -> None:
        self.execute(f"ALTER TABLE {self.identifier(table)} RENAME TO {self.identifier(new)}")

    def rename_column_sql(self, table: str, schema: str | None, name: str, new: str) -> str:
        return f"ALTER TABLE {self.identifier(table)} RENAME COLUMN {self.identifier(name)} TO {self.identifier(new)}"
