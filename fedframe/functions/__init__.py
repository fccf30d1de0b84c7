"""How the dialect's functions and types read in Spark SQL; other names pass through."""

from __future__ import annotations

import re

from ..errors import FedError

#: Type of the dialect to Spark SQL type (fixed values).
SPARK_TYPES = {"string": "STRING", "int": "BIGINT", "float": "DOUBLE", "bool": "BOOLEAN", "datetime": "TIMESTAMP", "json": "VARIANT"}
#: The same for tables in databases, by kind (fixed values).
DATABASE_TYPES = {
    "postgres": {"string": "TEXT", "int": "BIGINT", "float": "DOUBLE PRECISION", "bool": "BOOLEAN", "datetime": "TIMESTAMP", "json": "JSONB"},
    "mysql": {"string": "LONGTEXT", "int": "BIGINT", "float": "DOUBLE", "bool": "BOOLEAN", "datetime": "DATETIME(6)", "json": "JSON"},
    "mssql": {"string": "NVARCHAR(MAX)", "int": "BIGINT", "float": "FLOAT", "bool": "BIT", "datetime": "DATETIME2", "json": "NVARCHAR(MAX)"},
    "derby": {"string": "VARCHAR(32000)", "int": "BIGINT", "float": "DOUBLE", "bool": "BOOLEAN", "datetime": "TIMESTAMP", "json": "VARCHAR(32000)"},
    "sqlite": {"string": "TEXT", "int": "INTEGER", "float": "REAL", "bool": "BOOLEAN", "datetime": "TIMESTAMP", "json": "TEXT"},
}
#: Strings that are keys or have a default, where the type above can't be (fixed values).
SHORT_STRINGS = {"mysql": "VARCHAR(255)", "mssql": "NVARCHAR(450)"}
#: What a cast names, where it is not the column's type (fixed values).
CAST_TYPES = {"mysql": {"string": "CHAR", "int": "SIGNED", "bool": "UNSIGNED"}}
_IDENTIFIER = re.compile(r"[A-Za-z_]\w*(\.[A-Za-z_]\w*)*\Z")


def column_type(kind: str, name: str, short: bool = False) -> str:
    """A database's type for a type of the dialect; short: for a key or a column with a default."""
    return SHORT_STRINGS[kind] if short and name == "string" and kind in SHORT_STRINGS else DATABASE_TYPES[kind][name]


def cast_type(kind: str, name: str) -> str:
    return CAST_TYPES.get(kind, {}).get(name) or DATABASE_TYPES[kind][name]


def call(name: str, args: list[str], distinct: bool = False) -> str:
    """Spark SQL of a call; args are SQL already."""
    if not _IDENTIFIER.match(name):
        raise FedError(f"{name!r} is no function name")
    if name == "concat":  # skips nulls, as `||` doesn't
        return f"concat_ws('', {', '.join(f'CAST({a} AS STRING)' for a in args)})"
    if name in ("now", "current_timestamp") and not args:
        return "current_timestamp()"
    if name == "count" and not args:
        args = ["*"]
    return f"{name}({'DISTINCT ' if distinct else ''}{', '.join(args)})"
