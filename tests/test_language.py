"""Lexer and parser."""

import pytest

from fedframe.errors import ParseError
from fedframe.lang import nodes as n
from fedframe.lang import parse, parse_one
from fedframe.lang.lexer import tokens


def kinds(text):
    return [(t.kind, t.value) for t in tokens(text)[:-1]]


def test_strings_and_escapes():
    assert kinds(r'"a\"b\n\\" ' + "'x'") == [("string", 'a"b\n\\'), ("string", "x")]


def test_numbers_and_intervals():
    assert kinds("1_000 2.5 1e3 30d 2mon 1w 5y 10h 3m 4s") == [("int", 1000), ("float", 2.5), ("float", 1000.0), ("interval", (30, "DAY")), ("interval", (2, "MONTH")), ("interval", (1, "WEEK")), ("interval", (5, "YEAR")), ("interval", (10, "HOUR")), ("interval", (3, "MINUTE")), ("interval", (4, "SECOND"))]


@pytest.mark.parametrize("text", ["12abc", "1.5d", '"open', "/* open", "`open", "99999999999999999999", "find #"])
def test_bad_tokens(text):
    with pytest.raises(ParseError):
        tokens(text)


def test_comments_nest_and_positions():
    assert kinds("a -- b\n /* c /* d */ e */ f") == [("word", "a"), ("word", "f")]
    with pytest.raises(ParseError) as e:
        parse("find t\nwhere (a = 1")
    assert (e.value.line, e.value.column) == (2, 13)


def where(text):
    return parse_one(f"find t where {text}").where


def test_precedence():
    assert where("not a = 1 and b = 2 or c = 3").op == "or"
    assert where("not a = 1") == n.Unary("not", n.Binary("=", n.Name(("a",)), n.Literal(1)))
    assert where("a + b * 2 > 3 - -1").op == ">"
    assert where("a = b is null") == n.IsNull(n.Binary("=", n.Name(("a",)), n.Name(("b",))), False)
    assert where("a || b like \"x%\"").op == "like"
    assert isinstance(where("a::int + 1 between 2 and 3"), n.Between)
    assert where("a not in (1, 2,)") == n.InList(n.Name(("a",)), (n.Literal(1), n.Literal(2)), True)


def test_keywords_as_names():
    q = parse_one("find [t.key, replace(t.type, \"a\", \"b\") as value] from t")
    assert q.items[0].expr == n.Name(("t", "key")) and q.items[1].expr.name == "replace"


def test_shorthands():
    assert parse_one("find users@pg") == parse_one("find * from users@pg")
    assert parse_one("find [1]").sources == ()
    assert parse_one("find s.t@c as x").sources == (n.Table("t", "s", "c", "x"),)
    assert parse_one("find t x").sources == (n.Table("t", None, None, "x"),)


def test_set_operations_bind():
    q = parse_one("find a union find b intersect find c except all find d limit 3")
    assert (q.op, q.all, q.limit) == ("except", True, 3)
    assert q.left.op == "union" and q.left.right.op == "intersect"


def test_statements():
    got = [type(x).__name__ for x in parse("""create table t (a int primary key); create t {a: 1}; create t [{a: 1}, {a: :p}]; create t (find x); update t set a = 1;
        remove t where a = 1; drop table if exists t cascade; alter table t add column b string not null default "x"; create database d@c; drop database if exists d;
        show tables @c; describe s.t@c; explain find t; :p = 3; find t >> u insert if exists on conflict replace; with x as (find t) find x""")]
    assert got == ["CreateTable", "Insert", "Insert", "Insert", "Update", "Delete", "DropTable", "AlterTable", "CreateDatabase", "DropDatabase", "ShowTables", "Describe", "Explain", "Assign", "Persist", "With"]


def test_insert_into_a_table_named_table():
    assert parse_one("create table {a: 1}") == n.Insert(n.Table("table"), (n.Object((("a", n.Literal(1)),)),))


@pytest.mark.parametrize("text", ["find", "find [a", "find t where", "find t limit x", "find t order a", "find t join u", "create table t (a nosuch)", "update t a = 1", "find t extra words", "drop t", "find [case end]", "find (find t)"])
def test_refused(text):
    with pytest.raises(ParseError):
        parse(text)
