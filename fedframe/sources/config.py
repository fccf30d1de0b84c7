"""Connections from a configuration file.

A YAML (or JSON) list of entries with name, kind and uri (or path), and for some
kinds schema and options. ${NAME} is replaced from the environment. Entries of
kind `ai` name model endpoints.
"""

from __future__ import annotations

import os
import re
from collections.abc import Mapping
from pathlib import Path

from pyspark.sql import SparkSession

from ..errors import ConfigError
from ..operators.ai import AiConfig
from .base import Connection
from .files import CsvConnection, DocumentConnection, OrcConnection, ParquetConnection
from .jdbc import DRIVERS, JdbcConnection, jdbc_url
from .memory import MemoryConnection
from .sqlite import SqliteConnection


def _filled(value: object, env: Mapping[str, str]) -> object:
    if isinstance(value, str):

        def put(m: re.Match) -> str:
            if m[1] not in env:
                raise ConfigError(f"the environment has no {m[1]}")
            return env[m[1]]

        return re.sub(r"\$\{(\w+)\}", put, value)
    if isinstance(value, dict):
        return {k: _filled(v, env) for k, v in value.items()}
    return [_filled(v, env) for v in value] if isinstance(value, list) else value


def load_config(path: str, env: Mapping[str, str] | None = None) -> list[dict]:
    """The entries of a file; a missing file has none."""
    import yaml

    where = Path(path)
    if not where.exists():
        return []
    held = yaml.safe_load(where.read_text()) or []
    if isinstance(held, dict):
        held = held.get("connections", [])
    if not isinstance(held, list) or not all(isinstance(x, dict) and "name" in x and "kind" in x for x in held):
        raise ConfigError(f"{path}: expected a list of entries with name and kind")
    return _filled(held, os.environ if env is None else env)  # type: ignore[return-value]


def connect(spark: SparkSession, entry: dict) -> Connection:
    """Open the connection of one entry."""
    name, kind, schema = entry["name"], entry["kind"].lower(), entry.get("schema")
    kind = {"postgresql": "postgres", "mariadb": "mysql", "sqlserver": "mssql", "mongodb": "document", "json": "document"}.get(kind, kind)
    where = entry.get("path") or entry.get("uri") or ""
    if kind == "memory":
        return MemoryConnection(spark, name)
    if not where:
        raise ConfigError(f"{name}: uri or path is missing")
    if kind == "parquet":
        return ParquetConnection(spark, name, where, schema)
    if kind == "orc":
        return OrcConnection(spark, name, where, schema)
    if kind == "csv":
        return CsvConnection(spark, name, where, schema, entry.get("options"))
    if kind == "document":
        if where.startswith("mongodb"):
            raise ConfigError(f"{name}: document collections are read from a folder of JSON files, not from a server")
        return DocumentConnection(spark, name, where, schema)
    if kind == "sqlite":
        return SqliteConnection(spark, name, where.removeprefix("sqlite:").removeprefix("//").partition("?")[0])
    if kind in DRIVERS:
        return JdbcConnection(spark, name, kind, jdbc_url(kind, where), schema, entry.get("options"))
    raise ConfigError(f"{name}: unknown kind {kind!r}")


def open_all(spark: SparkSession, entries: list[dict]) -> tuple[list[Connection], dict[str, AiConfig], dict[str, str]]:
    """Connections, model endpoints, and the errors of entries that can't be opened, by name."""
    opened, models, errors = [], {}, {}
    for entry in entries:
        try:
            if entry["kind"].lower() == "ai":
                models[entry["name"]] = AiConfig.from_entry(entry)
            else:
                opened.append(connect(spark, entry))
        except Exception as e:  # noqa: BLE001  the other entries must open
            errors[entry["name"]] = str(e).splitlines()[0] if str(e) else type(e).__name__
    return opened, models, errors
