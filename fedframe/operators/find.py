"""The dialect's query as a chain of calls.

    find(engine, "orders@pg as o").join("customer as c", "o.o_custkey = c.c_custkey")
        .where("o.o_totalprice > :low").select("c.c_name", "count(*) as n").group_by("c.c_name").frame(low=10)

Each part is text of the dialect; the whole is parsed and lowered like any query,
so Catalyst sees one statement.
"""

from __future__ import annotations

from dataclasses import dataclass, replace
from typing import TYPE_CHECKING

from pyspark.sql import DataFrame

if TYPE_CHECKING:
    from ..engine import Engine, Result


@dataclass(frozen=True)
class Find:
    """An unfinished query; every method returns a new one."""

    engine: Engine
    source: str
    items: tuple[str, ...] = ("*",)
    unique: bool = False
    joins: tuple[str, ...] = ()
    tests: tuple[str, ...] = ()
    groups: tuple[str, ...] = ()
    having_tests: tuple[str, ...] = ()
    windows: tuple[str, ...] = ()
    order: tuple[str, ...] = ()
    tail: tuple[str, ...] = ()

    def select(self, *items: str) -> Find:
        return replace(self, items=items)

    def distinct(self) -> Find:
        return replace(self, unique=True)

    def join(self, source: str, on: str | None = None, how: str = "inner") -> Find:
        return replace(self, joins=(*self.joins, f"{how} join {source}" + (f" on {on}" if on else "")))

    def where(self, test: str) -> Find:
        return replace(self, tests=(*self.tests, test))

    def group_by(self, *exprs: str) -> Find:
        return replace(self, groups=(*self.groups, *exprs))

    def having(self, test: str) -> Find:
        return replace(self, having_tests=(*self.having_tests, test))

    def window(self, name: str, spec: str) -> Find:
        return replace(self, windows=(*self.windows, f"{name} as ({spec})"))

    def order_by(self, *keys: str) -> Find:
        return replace(self, order=(*self.order, *keys))

    def limit(self, n: int, offset: int = 0) -> Find:
        return replace(self, tail=(f"limit {int(n)}", f"offset {int(offset)}"))

    def text(self) -> str:
        """The query in the dialect."""
        parts = [f"find {'distinct ' if self.unique else ''}[{', '.join(self.items)}] from {self.source}", *self.joins]
        for word, texts, between in (("where", self.tests, " and "), ("group by", self.groups, ", "), ("having", self.having_tests, " and "), ("window", self.windows, ", "), ("order by", self.order, ", ")):
            if texts:
                parts.append(f"{word} " + between.join(f"({t})" if between == " and " else t for t in texts))
        return " ".join([*parts, *self.tail])

    def frame(self, **params) -> DataFrame:
        return self.engine.sql(self.text(), **params)

    def persist(self, target: str, conflict: str | None = None, **params) -> Result:
        return self.engine.execute(f"{self.text()} >> {target}" + (f" insert if exists on conflict {conflict}" if conflict else ""), **params)


def find(engine: Engine, source: str) -> Find:
    """Begin a query over a source, as `orders@pg as o`."""
    return Find(engine, source)
