"""fedframe: a federated analytics engine on Spark."""

from .engine import Engine, Result

__all__ = ["Engine", "Result"]
