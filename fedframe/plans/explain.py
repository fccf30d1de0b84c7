"""What a statement will do: its tree and Spark's plan."""

from __future__ import annotations

from dataclasses import fields, is_dataclass

from ..lang import nodes as n
from .lower import walk


def tree(node: object, depth: int = 0, label: str = "") -> list[str]:
    """The statement's tree, one line a node; empty parts are left out."""
    pad = "  " * depth + (f"{label}: " if label else "")
    if is_dataclass(node):
        simple = {f.name: getattr(node, f.name) for f in fields(node) if not is_dataclass(getattr(node, f.name)) and not isinstance(getattr(node, f.name), tuple)}
        told = " ".join(f"{k}={v!r}" for k, v in simple.items() if v not in (None, False, {}))
        lines = [f"{pad}{type(node).__name__}{' ' + told if told else ''}"]
        for f in fields(node):
            value = getattr(node, f.name)
            if is_dataclass(value):
                lines += tree(value, depth + 1, f.name)
            elif isinstance(value, tuple) and value:
                lines += [f"{'  ' * (depth + 1)}{f.name}:"] + [x for v in value for x in tree(v, depth + 2)]
        return lines
    if isinstance(node, tuple):
        return [x for v in node for x in tree(v, depth)]
    return [f"{pad}{node!r}"]


def connections(node: object, default: str | None) -> list[str]:
    """The connections a statement uses, sorted; names of its CTEs are none."""
    ctes = {x.name.lower() for x in walk(node) if isinstance(x, n.Cte)}
    used = {x.connection or default for x in walk(node) if isinstance(x, n.Table) and not (x.connection is None and x.schema is None and x.name.lower() in ctes)}
    return sorted(x for x in used if x)
