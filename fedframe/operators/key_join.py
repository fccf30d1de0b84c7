"""Joins that hand the small side's keys to the large side's scan.

For a database table joined to a small table, reading the matching rows beats
reading all. Catalyst does this for Parquet (runtime filters) but not for JDBC.
"""

from __future__ import annotations

from dataclasses import replace
from functools import reduce
from typing import TYPE_CHECKING

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..lang import nodes as n
from ..plans.lower import alias, conjuncts, sides

if TYPE_CHECKING:
    from ..engine import Engine

#: Up to so many distinct keys are written into the scan's filter, in lists of BATCH; with more, the join is a plain one.
MAX_KEYS, BATCH = 10_000, 1000
#: Keys are looked for on sides that Spark estimates to be of at most so many bytes.
MAX_SIDE_BYTES = 64 << 20


def _among(key: Column, keys: list) -> Column:
    """key in keys, in lists that databases take."""
    lists = [key.isin(keys[i : i + BATCH]) for i in range(0, len(keys), BATCH)]
    return reduce(Column.__or__, lists) if lists else F.lit(False)


def key_join(build: DataFrame, probe: DataFrame, build_key: str, probe_key: str, how: str = "inner", max_keys: int = MAX_KEYS) -> DataFrame:
    """build join probe on build_key = probe_key, how inner, left or left_semi.

    The distinct keys of build, if there are at most max_keys, become a filter on
    probe, which the source can push down. Null keys match nothing. Right and full
    joins keep all rows of probe and so don't take this way.
    """
    condition = build[build_key] == probe[probe_key]
    if how not in ("inner", "left", "left_semi"):
        return build.join(probe, condition, how)
    keys = [r[0] for r in build.select(build_key).where(F.col(build_key).isNotNull()).distinct().limit(max_keys + 1).collect()]
    if len(keys) <= max_keys:
        probe = probe.where(_among(F.col(probe_key), sorted(keys)))
        condition = build[build_key] == probe[probe_key]
    return build.join(probe, condition, how)


def with_keys(engine: Engine, q: n.Select, params: dict[str, object], known: frozenset[str] = frozenset()) -> n.Select:
    """The query with the keys of small tables as filters on the database tables that they are joined to.

    An inner or left join of a database's table takes part if its condition equates
    one of its columns with one of an earlier table elsewhere, which is small or
    filtered by the query to be so. known: names of common table expressions.
    """
    tables: list[n.Table | n.Derived] = [*q.sources]
    names, joins = {alias(s) for s in (*q.sources, *(j.source for j in q.joins))}, []
    for j in q.joins:
        if j.kind in ("inner", "left") and _in_database(engine, j.source, known):
            for c in conjuncts(j.on):
                made = _filtered(engine, q, tables, j.source, c, params, names, known)
                if made is not None:
                    j = replace(j, source=made)
                    break
        joins.append(j)
        tables.append(j.source)
        if j.kind not in ("inner", "left"):
            break
    return replace(q, joins=(*joins, *q.joins[len(joins) :]))


def _in_database(engine: Engine, s: n.Table | n.Derived, known: frozenset[str]) -> bool:
    return isinstance(s, n.Table) and s.name.lower() not in known and engine.connection(s.connection).takes_keys


def _filtered(engine: Engine, q: n.Select, tables: list, target: n.Table, c: n.Expr, params: dict[str, object], names: set[str], known: frozenset[str]) -> n.Derived | None:
    if not (isinstance(c, n.Binary) and c.op == "=" and isinstance(c.left, n.Name) and isinstance(c.right, n.Name) and len(sides(c, names) or ()) == 2):
        return None
    mine, other = (c.left, c.right) if c.left.parts[0].lower() == alias(target) else (c.right, c.left)
    found = [t for t in tables if isinstance(t, n.Table) and alias(t) == other.parts[0].lower() and t.name.lower() not in known]
    if mine.parts[0].lower() != alias(target) or not found or engine.connection(found[0].connection) is engine.connection(target.connection):
        return None
    tests = [x for x in conjuncts(q.where) if sides(x, names) == {alias(found[0])}]
    where: n.Expr = n.IsNull(other, True)
    for x in tests:
        where = n.Binary("and", where, x)
    keys = engine.run_sql(engine.lower().query(n.Select((n.Item(other, "k"),), (found[0],), where=where, distinct=True)), params)
    if keys.schema["k"].dataType.typeName() not in ("byte", "short", "integer", "long", "string") or int(str(keys._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) > MAX_SIDE_BYTES:
        return None
    values = [r[0] for r in keys.limit(MAX_KEYS + 1).collect()]
    if len(values) > MAX_KEYS:
        return None
    lists = [n.InList(n.Name((mine.parts[1],)), tuple(map(n.Literal, sorted(values)[i : i + BATCH])), False) for i in range(0, len(values), BATCH)]
    test = reduce(lambda a, b: n.Binary("or", a, b), lists) if lists else n.Literal(False)
    return n.Derived(n.Select((n.Item(n.Star(), None),), (replace(target, alias=None),), where=test), target.alias or target.name)
