"""What every connection can be asked."""

from __future__ import annotations

from abc import ABC, abstractmethod
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from ..errors import Unsupported


@dataclass(frozen=True)
class Column:
    """A column as a table's owner describes it; default is Spark SQL or null."""

    name: str
    type: str
    nullable: bool = True
    primary_key: bool = False
    default: str | None = None


class Connection(ABC):
    """A named place of tables. Reads are lazy; statements take effect at once.

    Kinds that run their own SQL text set `native` and answer execute(); for the
    others changed tables are computed by Spark and handed to overwrite().
    """

    kind = ""
    native = False
    #: Joins may hand it the keys of small tables.
    takes_keys = False
    alterable = True

    def __init__(self, spark: SparkSession, name: str, schema: str | None = None):
        self.spark, self.name, self.schema = spark, name, schema

    @abstractmethod
    def relation(self, table: str, schema: str | None = None) -> str:
        """Spark SQL that names the table in a FROM clause."""

    @abstractmethod
    def tables(self, schema: str | None = None) -> list[str]: ...

    @abstractmethod
    def columns(self, table: str, schema: str | None = None) -> list[Column]:
        """The table's columns, none if there is no such table."""

    @abstractmethod
    def create(self, table: str, columns: list[Column], schema: str | None = None) -> None: ...

    @abstractmethod
    def drop(self, table: str, schema: str | None = None) -> None: ...

    @abstractmethod
    def append(self, table: str, df: DataFrame, schema: str | None = None) -> int | None:
        """Add rows; returns their number where the connection writes and counts them itself."""

    def frame(self, table: str, schema: str | None = None) -> DataFrame:
        return self.spark.sql(f"SELECT * FROM {self.relation(table, schema)}")

    def fields(self, table: str, schema: str | None = None) -> T.StructType:
        """The table's columns as Spark reads them."""
        return self.frame(table, schema).schema

    def exists(self, table: str, schema: str | None = None) -> bool:
        return table.lower() in {x.lower() for x in self.tables(schema)}

    def overwrite(self, table: str, df: DataFrame, schema: str | None = None, columns: list[Column] | None = None) -> None:
        raise Unsupported(f"{self.kind} tables can't be replaced")

    def rename(self, table: str, new: str, schema: str | None = None) -> None:
        raise Unsupported(f"{self.kind} tables can't be renamed")

    def create_database(self, name: str, if_not_exists: bool) -> None:
        raise Unsupported(f"{self.kind} connections have no databases to create")

    def drop_database(self, name: str, if_exists: bool) -> None:
        raise Unsupported(f"{self.kind} connections have no databases to drop")

    def execute(self, sql: str) -> int:
        """Run the connection's own SQL; returns how many rows it changed."""
        raise Unsupported(f"{self.kind} connections have no SQL of their own")

    def transaction(self, texts: list[str]) -> int:
        """Run statements of the connection's own SQL, all or none; returns how many rows they changed."""
        raise Unsupported(f"{self.kind} connections have no SQL of their own")

    def identifier(self, name: str) -> str:
        """A name in the connection's own SQL."""
        return '"' + name.replace('"', '""') + '"'

    def literal(self, value: object) -> str:
        """A value in the connection's own SQL."""
        if value is None:
            return "NULL"
        if isinstance(value, bool):
            return "TRUE" if value else "FALSE"
        return "'" + value.replace("'", "''") + "'" if isinstance(value, str) else repr(value)
