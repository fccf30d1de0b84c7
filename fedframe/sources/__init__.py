"""Connections: where tables live, by kind."""

from .base import Column, Connection
from .config import connect, load_config, open_all
from .files import CsvConnection, DocumentConnection, OrcConnection, ParquetConnection
from .jdbc import JdbcConnection
from .memory import MemoryConnection
from .sqlite import SqliteConnection

__all__ = ["Column", "Connection", "CsvConnection", "DocumentConnection", "JdbcConnection", "MemoryConnection", "OrcConnection", "ParquetConnection", "SqliteConnection", "connect", "load_config", "open_all"]
