"""Folders of files: Parquet and ORC tables, CSV files to read, and JSON document collections.

A table is <root>[/<schema>]/<table>.<suffix>, one file or a folder of files.
Statements that change rows write the whole new table beside the old one and then
swap the two by renames; there is one writer at a time. What Parquet doesn't
know about columns (keys, defaults, not null) is kept in a file beside the table.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import asdict

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from ..errors import FedError, Unsupported
from ..plans.lower import quote
from .base import Column, Connection


class _FileConnection(Connection):
    suffix = ""

    def __init__(self, spark: SparkSession, name: str, root: str, schema: str | None = None):
        super().__init__(spark, name, schema)
        self.root = root.rstrip("/")
        self._jvm = spark.sparkContext._jvm
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _path(self, text: str):
        return self._jvm.org.apache.hadoop.fs.Path(text)

    def folder(self, schema: str | None) -> str:
        schema = schema or self.schema
        return f"{self.root}/{schema}" if schema else self.root

    def where(self, table: str, schema: str | None = None) -> str:
        return f"{self.folder(schema)}/{table}{self.suffix}"

    def _meta(self, table: str, schema: str | None) -> str:
        return f"{self.folder(schema)}/_{table}.columns"

    def exists(self, table: str, schema: str | None = None) -> bool:
        return bool(self._fs.exists(self._path(self.where(table, schema))))

    def tables(self, schema: str | None = None) -> list[str]:
        folder = self._path(self.folder(schema))
        if not self._fs.exists(folder):
            return []
        names = [x.getPath().getName() for x in self._fs.listStatus(folder)]
        return sorted(n[: -len(self.suffix)] for n in names if n.endswith(self.suffix) and not n.startswith(("_", ".")))

    def _read(self, path: str) -> DataFrame:
        raise NotImplementedError

    def _write(self, df: DataFrame, path: str, mode: str) -> None:
        raise NotImplementedError

    def relation(self, table: str, schema: str | None = None) -> str:
        view = f"__{self.name}__{schema or self.schema or ''}__{table}"
        self.frame(table, schema).createOrReplaceTempView(quote(view))
        return quote(view)

    def frame(self, table: str, schema: str | None = None) -> DataFrame:
        return self._read(self.where(table, schema))

    def _stored(self, table: str, schema: str | None) -> dict[str, Column]:
        path = self._path(self._meta(table, schema))
        if not self._fs.exists(path):
            return {}
        stream = self._fs.open(path)
        try:
            return {x["name"]: Column(**x) for x in json.loads(self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))}
        finally:
            stream.close()

    def _store(self, table: str, schema: str | None, columns: list[Column] | None) -> None:
        path = self._path(self._meta(table, schema))
        if columns is None:
            self._fs.delete(path, False)
            return
        stream = self._fs.create(path, True)
        try:
            self._jvm.org.apache.commons.io.IOUtils.write(json.dumps([asdict(c) for c in columns]), stream, "UTF-8")
        finally:
            stream.close()

    def columns(self, table: str, schema: str | None = None) -> list[Column]:
        if not self.exists(table, schema):
            return []
        known = self._stored(table, schema)
        fields = self.frame(table, schema).schema.fields
        return [known.get(f.name) or Column(f.name, f.dataType.simpleString(), f.nullable) for f in fields]

    def create(self, table: str, columns: list[Column], schema: str | None = None) -> None:
        fields = T.StructType([T.StructField(c.name, T._parse_datatype_string(c.type)) for c in columns])
        self._write(self.spark.createDataFrame([], fields), self.where(table, schema), "errorifexists")
        self._store(table, schema, columns)

    def drop(self, table: str, schema: str | None = None) -> None:
        self._fs.delete(self._path(self.where(table, schema)), True)
        self._store(table, schema, None)

    def append(self, table: str, df: DataFrame, schema: str | None = None) -> None:
        self._write(df, self.where(table, schema), "append")

    def overwrite(self, table: str, df: DataFrame, schema: str | None = None, columns: list[Column] | None = None) -> None:
        new, now = f"{self.folder(schema)}/_new-{uuid.uuid4().hex}", self.where(table, schema)
        old = f"{self.folder(schema)}/_old-{uuid.uuid4().hex}"
        self._write(df, new, "errorifexists")
        if not self._fs.rename(self._path(now), self._path(old)) or not self._fs.rename(self._path(new), self._path(now)):
            raise FedError(f"{now} can't be replaced")
        if columns is not None:
            self._store(table, schema, columns)
        self._fs.delete(self._path(old), True)
        self.spark.catalog.refreshByPath(now)

    def rename(self, table: str, new: str, schema: str | None = None) -> None:
        columns = self._stored(table, schema)
        if not self._fs.rename(self._path(self.where(table, schema)), self._path(self.where(new, schema))):
            raise FedError(f"{table} can't be renamed")
        self._store(table, schema, None)
        if columns:
            self._store(new, schema, list(columns.values()))

    def create_database(self, name: str, if_not_exists: bool) -> None:
        path = self._path(f"{self.root}/{name}")
        if self._fs.exists(path):
            if if_not_exists:
                return
            raise FedError(f"database {name} exists")
        self._fs.mkdirs(path)

    def drop_database(self, name: str, if_exists: bool) -> None:
        path = self._path(f"{self.root}/{name}")
        if not self._fs.exists(path):
            if if_exists:
                return
            raise FedError(f"there is no database {name}")
        self._fs.delete(path, True)


class ParquetConnection(_FileConnection):
    """A folder of Parquet tables."""

    kind, suffix = "parquet", ".parquet"

    def _read(self, path: str) -> DataFrame:
        return self.spark.read.parquet(path)

    def _write(self, df: DataFrame, path: str, mode: str) -> None:
        df.write.mode(mode).parquet(path)


class OrcConnection(_FileConnection):
    """A folder of ORC tables."""

    kind, suffix = "orc", ".orc"

    def _read(self, path: str) -> DataFrame:
        return self.spark.read.orc(path)

    def _write(self, df: DataFrame, path: str, mode: str) -> None:
        df.write.mode(mode).orc(path)


class CsvConnection(_FileConnection):
    """A folder of CSV files with header lines, to read only.

    Columns are strings, so that no pass over the data guesses types; options are
    those of Spark's reader (as sep or multiLine). A quote in a quoted field is written
    twice. An empty field is null, quoted or not.
    """

    kind, suffix, alterable = "csv", ".csv", False

    def __init__(self, spark: SparkSession, name: str, root: str, schema: str | None = None, options: dict[str, str] | None = None):
        super().__init__(spark, name, root, schema)
        self.options = {"header": "true", "escape": '"', **(options or {})}

    def _read(self, path: str) -> DataFrame:
        return self.spark.read.options(**self.options).csv(path)

    def _write(self, df: DataFrame, path: str, mode: str) -> None:
        raise Unsupported("csv tables are only read")

    def drop(self, table: str, schema: str | None = None) -> None:
        raise Unsupported("csv tables are only read")

    def rename(self, table: str, new: str, schema: str | None = None) -> None:
        raise Unsupported("csv tables are only read")


class DocumentConnection(_FileConnection):
    """A folder of collections of JSON documents, one document a line."""

    kind, suffix, alterable = "document", ".json", False

    def _read(self, path: str) -> DataFrame:
        name = path.rsplit("/", 1)[-1].removesuffix(self.suffix)
        folder = path.rsplit("/", 1)[0]
        schema = None if folder == self.root else folder[len(self.root) + 1 :]
        known = self._stored(name, schema if schema != self.schema else None)
        reader = self.spark.read
        if known:
            reader = reader.schema(T.StructType([T.StructField(c.name, T._parse_datatype_string(c.type)) for c in known.values()]))
        return reader.json(path)

    def _write(self, df: DataFrame, path: str, mode: str) -> None:
        df.write.mode(mode).json(path, ignoreNullFields=False)

    def rename(self, table: str, new: str, schema: str | None = None) -> None:
        raise Unsupported("document collections can't be renamed")
