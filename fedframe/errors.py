"""What can go wrong, by kind."""

from __future__ import annotations


class FedError(Exception):
    """Base of all errors of this package."""


class ParseError(FedError):
    """The text is not in the language; says where."""

    def __init__(self, message: str, line: int, column: int, text: str = ""):
        self.line, self.column, self.reason = line, column, message
        lines = text.splitlines()
        shown = f"\n  {lines[line - 1]}\n  {' ' * (column - 1)}^" if 0 < line <= len(lines) else ""
        super().__init__(f"line {line}, column {column}: {message}{shown}")


class ConnectionNotFound(FedError):
    """A statement names a connection that is not registered."""


class ConnectionFailed(FedError):
    """A connection can't be opened."""


class ConfigError(FedError):
    """A configuration entry is wrong."""


class Unsupported(FedError):
    """The connection's kind can't do this."""


class GuardError(FedError):
    """A statement was refused before it ran."""


class ConstraintError(FedError):
    """Rows break NOT NULL or PRIMARY KEY."""
