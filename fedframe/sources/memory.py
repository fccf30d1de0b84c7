"""Tables that live in the session."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from ..plans.lower import quote
from .base import Column, Connection


class MemoryConnection(Connection):
    """DataFrames by name; a changed table is the plan of the change over the old one."""

    kind = "memory"

    def __init__(self, spark: SparkSession, name: str, tables: dict[str, DataFrame] | None = None):
        super().__init__(spark, name)
        self._frames = dict(tables or {})
        self._columns: dict[str, list[Column]] = {}

    def _key(self, table: str) -> str:
        return next((k for k in self._frames if k.lower() == table.lower()), table)

    def relation(self, table: str, schema: str | None = None) -> str:
        view = f"__{self.name}____{table}"
        self.frame(table).createOrReplaceTempView(quote(view))
        return quote(view)

    def frame(self, table: str, schema: str | None = None) -> DataFrame:
        if not self.exists(table):
            return self.spark.table(quote(f"{self.name}.{table}"))  # Spark's own error
        return self._frames[self._key(table)]

    def tables(self, schema: str | None = None) -> list[str]:
        return sorted(self._frames)

    def columns(self, table: str, schema: str | None = None) -> list[Column]:
        if not self.exists(table):
            return []
        known = {c.name: c for c in self._columns.get(self._key(table), [])}
        return [known.get(f.name) or Column(f.name, f.dataType.simpleString(), f.nullable) for f in self.frame(table).schema.fields]

    def create(self, table: str, columns: list[Column], schema: str | None = None) -> None:
        self._frames[table] = self.spark.createDataFrame([], T.StructType([T.StructField(c.name, T._parse_datatype_string(c.type)) for c in columns]))
        self._columns[table] = columns

    def drop(self, table: str, schema: str | None = None) -> None:
        self._columns.pop(self._key(table), None)
        self._frames.pop(self._key(table))

    def append(self, table: str, df: DataFrame, schema: str | None = None) -> None:
        self._frames[self._key(table)] = self.frame(table).unionByName(df)

    def overwrite(self, table: str, df: DataFrame, schema: str | None = None, columns: list[Column] | None = None) -> None:
        key = self._key(table)
        self._frames[key] = df
        if columns is not None:
            self._columns[key] = [replace(c) for c in columns]

    def rename(self, table: str, new: str, schema: str | None = None) -> None:
        key = self._key(table)
        self._frames[new] = self._frames.pop(key)
        if key in self._columns:
            self._columns[new] = self._columns.pop(key)
