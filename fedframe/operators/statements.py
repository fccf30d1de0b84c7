"""Statements that change tables.

Kinds with SQL of their own (databases) run changes there. For the others Spark
computes the changed table from the old one and the connection swaps it in, which
rewrites the table once, in parallel; keys and not-null are checked before.
"""

from __future__ import annotations

import uuid
from dataclasses import replace
from typing import TYPE_CHECKING

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ..errors import ConstraintError, FedError, Unsupported
from ..functions import SPARK_TYPES, column_type
from ..lang import nodes as n
from ..plans.lower import NativeLower, quote
from ..sources.base import Column, Connection

if TYPE_CHECKING:
    from ..engine import Engine

Params = dict[str, object]


def _native(engine: Engine, conn: Connection, params: Params) -> NativeLower:
    def relation(t: n.Table) -> str:
        if engine.connection(t.connection) is not conn:
            raise Unsupported(f"a change in {conn.name} can read only tables of {conn.name}")
        return conn.qualified(t.name, t.schema)  # type: ignore[attr-defined]

    return NativeLower(conn.kind, relation, conn.identifier, conn.literal, params)


def _known(conn: Connection, t: n.Table) -> list[Column]:
    columns = conn.columns(t.name, t.schema)
    if not columns:
        raise FedError(f"there is no table {t.name} in {conn.name}")
    return columns


def _observed(df: DataFrame) -> tuple[DataFrame, Observation]:
    """df that counts its rows while it is written."""
    seen = Observation()
    return df.observe(seen, F.count(F.lit(1)).alias("rows")), seen


def _check(conn: Connection, t: n.Table, columns: list[Column], new: DataFrame, old: DataFrame | None) -> None:
    """Not null and primary keys of rows to be added to old."""
    needed = [c for c in columns if c.primary_key or not c.nullable]
    if needed:
        counts = new.agg(*[F.count(F.when(F.col(quote(c.name)).isNull(), 1)).alias(f"c{i}") for i, c in enumerate(needed)]).first()
        for c, found in zip(needed, counts, strict=True):
            if found:
                raise ConstraintError(f"{t.name}.{c.name} can't be null")
    keys = [quote(c.name) for c in columns if c.primary_key]
    if keys:
        added = new.select(*keys)
        twice = not added.groupBy(*keys).count().where("count > 1").isEmpty()
        if twice or (old is not None and not old.select(*keys).join(added, [c.name for c in columns if c.primary_key], "left_semi").isEmpty()):
            raise ConstraintError(f"{t.name} has the key {', '.join(keys)} already")


def _aligned(engine: Engine, conn: Connection, t: n.Table, columns: list[Column], df: DataFrame) -> DataFrame:
    """df with the table's columns in order: defaults where it has none, cast to their types."""
    given = {c.lower(): c for c in df.columns}
    if extra := set(given) - {c.name.lower() for c in columns}:
        raise FedError(f"{t.name} has no column {', '.join(sorted(extra))}")
    types = {f.name.lower(): f.dataType for f in conn.fields(t.name, t.schema).fields}
    out = []
    for c in columns:
        value = F.col(quote(given[c.name.lower()])) if c.name.lower() in given else F.expr(c.default) if c.default is not None else F.lit(None)
        out.append(value.cast(types[c.name.lower()]).alias(c.name))
    return df.select(*out)


def _rows(engine: Engine, rows: tuple[n.Object, ...], params: Params) -> DataFrame:
    """The rows of an insert; keys are the union of all rows', absent ones are null."""
    names = list(dict.fromkeys(k for r in rows for k, _ in r.items))
    lower = engine.lower()
    selects = []
    for r in rows:
        values = dict(r.items)
        selects.append("SELECT " + ", ".join(f"{lower.expr(values.get(k, n.Literal(None)))} AS {quote(k)}" for k in names))
    return engine.run_sql(" UNION ALL ".join(selects), params)


def insert(engine: Engine, s: n.Insert, params: Params, ctes: n.With | None = None) -> int:
    t, conn = s.target, engine.connection(s.target.connection)
    columns = _known(conn, t)
    if conn.native and s.rows:
        native, texts = _native(engine, conn, params), []
        for r, values in zip(s.rows, _values(engine, s.rows, params), strict=True):
            names, held = ", ".join(native.quote(k) for k, _ in r.items), ", ".join(map(conn.literal, values))
            texts.append(f"INSERT INTO {conn.qualified(t.name, t.schema)} ({names}) VALUES ({held})")  # type: ignore[attr-defined]
        return conn.transaction(texts)
    df = engine.query_frame(replace(ctes, body=s.query) if ctes and s.query else s.query, params) if s.query is not None else _by_row_defaults(engine, s.rows, columns, params)
    if s.query is not None and len(df.columns) == len(columns) and not set(map(str.lower, df.columns)) <= {c.name.lower() for c in columns}:
        df = df.toDF(*[c.name for c in columns])  # by position, as in SQL
    df = _aligned(engine, conn, t, columns, df)
    if not conn.native:
        _check(conn, t, columns, df, conn.frame(t.name, t.schema))
    return _append(engine, conn, t, df)


#: Values of an insert that are computed together.
VALUES_AT_ONCE = 400


def _values(engine: Engine, rows: tuple[n.Object, ...], params: Params) -> list[list]:
    """The values of each row, by a few queries of one row each."""
    flat, found = [v for r in rows for _, v in r.items], []
    for i in range(0, len(flat), VALUES_AT_ONCE):
        part = flat[i : i + VALUES_AT_ONCE]
        found += engine.run_sql("SELECT " + ", ".join(f"{engine.lower().expr(v)} AS `v{k}`" for k, v in enumerate(part)), params).first()
    plain = iter([v if v is None or isinstance(v, bool | int | float | str) else str(v) for v in found])
    return [[next(plain) for _ in r.items] for r in rows]


def _by_row_defaults(engine: Engine, rows: tuple[n.Object, ...], columns: list[Column], params: Params) -> DataFrame:
    """Rows where a key that one row lacks takes the column's default, not null."""
    names = {k for r in rows for k, _ in r.items}
    defaults = {c.name: c.default for c in columns if c.name in names and c.default is not None}
    if all(len(r.items) == len(names) for r in rows) or not defaults:
        return _rows(engine, rows, params)
    parts = [_rows(engine, (r,), params) for r in rows]
    parts = [p.withColumns({k: F.expr(v) for k, v in defaults.items() if k not in p.columns}) for p in parts]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def _append(engine: Engine, conn: Connection, t: n.Table, df: DataFrame) -> int:
    if conn.kind in ("memory", "sqlite"):  # Spark doesn't write these, so nothing is observed
        df = engine.stage(df)
        conn.append(t.name, df, t.schema)
        return df.count()
    counted, seen = _observed(df)
    written = conn.append(t.name, counted, t.schema)
    return int(seen.get["rows"]) if written is None else written


def update(engine: Engine, s: n.Update, params: Params) -> int:
    t, conn = s.target, engine.connection(s.target.connection)
    columns = _known(conn, t)
    if conn.native:
        low = _native(engine, conn, params)
        sets = ", ".join(f"{low.quote(c)} = {low.expr(e)}" for c, e in s.sets)
        return conn.execute(f"UPDATE {low.relation(t)} SET {sets}" + (f" WHERE {low.expr(s.where)}" if s.where is not None else ""))
    low, old = engine.lower(), conn.frame(t.name, t.schema)
    names = {c.lower(): c for c in old.columns}
    if unknown := [c for c, _ in s.sets if c.lower() not in names]:
        raise FedError(f"{t.name} has no column {', '.join(unknown)}")
    test = f"coalesce({low.expr(s.where)}, false)" if s.where is not None else "true"
    sets, kinds = {c.lower(): low.expr(e) for c, e in s.sets}, {f.name.lower(): f.dataType.simpleString() for f in old.schema.fields}
    base = f"FROM (SELECT *, {test} AS `__hit` FROM {engine.relation(t)} AS {quote(t.name)}) AS {quote(t.name)}"
    columns_sql = [f"CASE WHEN `__hit` THEN CAST({sets[k]} AS {kinds[k]}) ELSE {quote(c)} END AS {quote(c)}" if k in sets else quote(c) for k, c in names.items()]
    hits = engine.run_sql(f"SELECT count_if(`__hit`) {base}", params).first()[0]
    new = engine.run_sql(f"SELECT {', '.join(columns_sql)} {base}", params)
    changed = [c for c in columns if c.name.lower() in sets]
    if any(c.primary_key or not c.nullable for c in changed):
        _check(conn, t, columns, new, None)
    conn.overwrite(t.name, new, t.schema)
    return int(hits)


def delete(engine: Engine, s: n.Delete, params: Params) -> int:
    t, conn = s.target, engine.connection(s.target.connection)
    _known(conn, t)
    if conn.native:
        low = _native(engine, conn, params)
        return conn.execute(f"DELETE FROM {low.relation(t)}" + (f" WHERE {low.expr(s.where)}" if s.where is not None else ""))
    test = f"coalesce({engine.lower().expr(s.where)}, false)" if s.where is not None else "true"
    base = f"FROM {engine.relation(t)} AS {quote(t.name)}"
    hits = engine.run_sql(f"SELECT count_if({test}) {base}", params).first()[0]
    conn.overwrite(t.name, engine.run_sql(f"SELECT * {base} WHERE NOT {test}", params), t.schema)
    return int(hits)


def _column(engine: Engine, conn: Connection, c: n.ColumnDef) -> Column:
    kind = c.type if conn.native else SPARK_TYPES[c.type]
    low = _native(engine, conn, {}) if conn.native else engine.lower()
    default = low.expr(c.default) if c.default is not None else None
    return Column(c.name, kind, not (c.not_null or c.primary_key), c.primary_key, default)


def create_table(engine: Engine, s: n.CreateTable, params: Params) -> int:
    t, conn = s.target, engine.connection(s.target.connection)
    if conn.exists(t.name, t.schema):
        if s.if_not_exists:
            return 0
        raise FedError(f"table {t.name} exists")
    names = [c.name.lower() for c in s.columns]
    if len(set(names)) < len(names):
        raise FedError("a column is named twice")
    conn.create(t.name, [_column(engine, conn, c) for c in s.columns], t.schema)
    return 0


def drop_table(engine: Engine, s: n.DropTable, params: Params) -> int:
    t, conn = s.target, engine.connection(s.target.connection)
    if not conn.exists(t.name, t.schema):
        if s.if_exists:
            return 0
        raise FedError(f"there is no table {t.name} in {conn.name}")
    conn.drop(t.name, t.schema)
    return 0


def alter_table(engine: Engine, s: n.AlterTable, params: Params) -> int:
    t, conn = s.target, engine.connection(s.target.connection)
    if not conn.alterable:
        raise Unsupported(f"{conn.kind} tables can't be altered")
    columns = _known(conn, t)
    if s.action == "rename_table":
        conn.rename(t.name, str(s.new_name), t.schema)
        return 0
    if conn.native:
        for text in _alter_sql(engine, conn, s):
            conn.execute(text)
        return 0
    by_name = {c.name.lower(): i for i, c in enumerate(columns)}
    df = conn.frame(t.name, t.schema)
    named = str(s.column.name if s.column else s.name).lower()
    if (s.action == "add") == (named in by_name):
        raise FedError(f"{t.name} has {'a' if s.action == 'add' else 'no'} column {named}")
    if s.action == "add":
        assert s.column
        made = _column(engine, conn, s.column)
        df = df.withColumn(made.name, (F.expr(made.default) if made.default is not None else F.lit(None)).cast(made.type))
        columns = [*columns, made]
        _check(conn, t, [made], df, None)
    elif s.action == "drop":
        df = df.drop(columns[by_name[named]].name)
        columns = [c for c in columns if c.name.lower() != named]
    elif s.action == "rename":
        i = by_name[named]
        df = df.withColumnRenamed(columns[i].name, str(s.new_name))
        columns = [*columns[:i], replace(columns[i], name=str(s.new_name)), *columns[i + 1 :]]
    else:
        i, changes = by_name[named], s.changes
        c = columns[i]
        if "type" in changes:
            c = replace(c, type=SPARK_TYPES[changes["type"]])
            df = df.withColumn(c.name, F.expr(f"{'try_cast' if engine.lenient else 'cast'}({quote(c.name)} AS {c.type})"))
        if "not_null" in changes:
            c = replace(c, nullable=not changes["not_null"])
        if "default" in changes:
            c = replace(c, default=None if changes["default"] is None else engine.lower().expr(changes["default"]))
        columns = [*columns[:i], c, *columns[i + 1 :]]
        _check(conn, t, [replace(c, primary_key=False)], df, None)
    conn.overwrite(t.name, df, t.schema, columns)
    return 0


def _alter_sql(engine: Engine, conn: Connection, s: n.AlterTable) -> list[str]:
    """The statements by which a database of the connection's kind alters a column."""
    table = conn.qualified(s.target.name, s.target.schema)  # type: ignore[attr-defined]
    if s.action == "add":
        assert s.column
        word = "ADD" if conn.kind == "mssql" else "ADD COLUMN"
        return [f"ALTER TABLE {table} {word} {conn.column_sql(_column(engine, conn, s.column))}"]  # type: ignore[attr-defined]
    name = conn.identifier(str(s.name))
    if s.action == "drop":
        return [f"ALTER TABLE {table} DROP COLUMN {name}"]
    if s.action == "rename":
        return [conn.rename_column_sql(s.target.name, s.target.schema, str(s.name), str(s.new_name))]  # type: ignore[attr-defined]
    if conn.kind == "sqlite":
        raise Unsupported("sqlite columns can't be altered")
    kind = column_type(conn.kind, s.changes["type"]) if "type" in s.changes else ""
    default = s.changes.get("default")
    value = _native(engine, conn, {}).expr(default) if default is not None else ""
    column = f"ALTER TABLE {table} ALTER COLUMN {name}"
    out = []
    if conn.kind in ("mysql", "mssql"):
        if "type" in s.changes or "not_null" in s.changes:
            if not kind:
                raise Unsupported(f"{conn.kind} needs the type beside not null")
            verb = "MODIFY COLUMN" if conn.kind == "mysql" else "ALTER COLUMN"
            out.append(f"ALTER TABLE {table} {verb} {name} {kind}" + (" NOT NULL" if s.changes.get("not_null") else ""))
        if "default" in s.changes:
            out.append(f"{column} {'SET DEFAULT ' + value if value else 'DROP DEFAULT'}" if conn.kind == "mysql" else f"ALTER TABLE {table} ADD DEFAULT {value} FOR {name}")
        return out
    if kind:
        out.append(f"{column} {'SET DATA TYPE' if conn.kind == 'derby' else 'TYPE'} {kind}")
    if "not_null" in s.changes:
        out.append(f"{column} {'SET' if s.changes['not_null'] else 'DROP'} NOT NULL")
    if "default" in s.changes:
        out.append(f"{column} {'SET DEFAULT ' + value if value else 'DROP DEFAULT'}")
    return out


def create_database(engine: Engine, s: n.CreateDatabase, params: Params) -> int:
    engine.connection(s.connection).create_database(s.name, s.if_not_exists)
    return 0


def drop_database(engine: Engine, s: n.DropDatabase, params: Params) -> int:
    engine.connection(s.connection).drop_database(s.name, s.if_exists)
    return 0


def persist(engine: Engine, s: n.Persist, params: Params, ctes: n.With | None = None) -> int:
    """Write a query's rows to a table, made if it is missing; no rows change nothing.

    On conflict, rows whose key (all columns, where there is none) is in the table
    are left out (ignore) or take the old ones' place (replace). Of rows that share
    a key among themselves one is written.
    """
    t, conn = s.target, engine.connection(s.target.connection)
    df = engine.query_frame(replace(ctes, body=s.query) if ctes else s.query, params)
    if df.isEmpty():
        return 0
    if not conn.exists(t.name, t.schema):
        conn.create(t.name, [Column(f.name, _dialect_type(f.dataType.typeName()) if conn.native else f.dataType.simpleString()) for f in df.schema.fields], t.schema)
    columns = _known(conn, t)
    df = _aligned(engine, conn, t, columns, df)
    if s.conflict is None:
        if not conn.native:
            _check(conn, t, columns, df, conn.frame(t.name, t.schema))
        return _append(engine, conn, t, df)
    keys = [c.name for c in columns if c.primary_key] or [c.name for c in columns]
    df = df.dropDuplicates(keys)
    old = conn.frame(t.name, t.schema)

    def same(a: DataFrame, b: DataFrame):
        test = F.lit(True)
        for k in keys:
            test = test & a[quote(k)].eqNullSafe(b[quote(k)])
        return test

    if s.conflict == "ignore":
        fresh = engine.stage(df.join(old, same(df, old), "left_anti"))
        return 0 if fresh.isEmpty() else _append(engine, conn, t, fresh)
    if conn.native:
        return _replace_in_database(engine, conn, t, df, keys)
    found = df.count()
    conn.overwrite(t.name, old.join(df, same(old, df), "left_anti").unionByName(df), t.schema)
    return found


def _replace_in_database(engine: Engine, conn: Connection, t: n.Table, df: DataFrame, keys: list[str]) -> int:
    """Write the rows beside the table, then in one transaction delete those of their keys and insert them."""
    beside = f"new_{uuid.uuid4().hex[:12]}"
    conn.create(beside, [Column(f.name, _dialect_type(f.dataType.typeName())) for f in df.schema.fields], t.schema)
    try:
        conn.append(beside, df, t.schema)
        table, new = conn.qualified(t.name, t.schema), conn.qualified(beside, t.schema)  # type: ignore[attr-defined]
        sides = [(f"{table}.{conn.identifier(k)}", f"n.{conn.identifier(k)}") for k in keys]
        same = " AND ".join(f"({a} = {b} OR ({a} IS NULL AND {b} IS NULL))" for a, b in sides)
        names = ", ".join(map(conn.identifier, df.columns))
        gone = f"DELETE FROM {table} WHERE EXISTS (SELECT 1 FROM {new} n WHERE {same})"
        conn.transaction([gone, f"INSERT INTO {table} ({names}) SELECT {names} FROM {new}"])
        return conn.frame(beside, t.schema).count()
    finally:
        conn.drop(beside, t.schema)


def _dialect_type(name: str) -> str:
    """The dialect's type for a Spark type's name."""
    if name in ("byte", "short", "integer", "long"):
        return "int"
    if name in ("float", "double", "decimal") or name.startswith("decimal"):
        return "float"
    return {"boolean": "bool", "timestamp": "datetime", "timestamp_ntz": "datetime", "date": "datetime"}.get(name, "string")
