"""Random conditions against DuckDB: three-valued logic, precedence, arithmetic, grouping."""

import random

import duckdb
import pandas as pd
import pytest

from tamarack.engine import Engine

ROWS = [(k, None if k % 5 == 0 else k % 7 - 3, None if k % 6 == 0 else (k % 9) / 2 - 1, None if k % 4 == 0 else "abc AbC xyz q1".split()[k % 4]) for k in range(40)]


def number(r, depth=0):
    if depth > 2 or r.random() < 0.4:
        return r.choice([("a", "a"), ("b", "b"), ("id", "id"), ("2", "2"), ("-1", "-1"), ("0.5", "0.5::DOUBLE")])
    op = r.choice("+-*")
    (x, dx), (y, dy) = number(r, depth + 1), number(r, depth + 1)
    return f"({x} {op} {y})", f"({dx} {op} {dy})"


def condition(r, depth=0):
    kind = r.choice(["cmp", "text", "null", "between", "in", "like"] + ["and", "or", "not"] * (2 if depth < 3 else 0))
    if kind in ("and", "or"):
        (x, dx), (y, dy) = condition(r, depth + 1), condition(r, depth + 1)
        return f"({x} {kind} {y})", f"({dx} {kind} {dy})"
    if kind == "not":
        x, dx = condition(r, depth + 1)
        return f"NOT {x}", f"(NOT {dx})"
    no, dno = r.choice([("", ""), ("NOT ", "NOT ")])
    if kind == "cmp":
        op = r.choice(["=", "<>", "<", ">", "<=", ">="])
        (x, dx), (y, dy) = number(r), number(r)
        return f"{x} {op} {y}", f"({dx} {op} {dy})"
    if kind == "text":
        op, t = r.choice(["=", "<>", "<", ">="]), r.choice(["ABC", "xyz", "m"])
        return f"s {op} '{t}'", f"(lower(s) {op} '{t.lower()}')"
    if kind == "null":
        c = r.choice("abs")
        return f"{c} IS {no}NULL", f"({c} IS {no}NULL)"
    if kind == "between":
        (x, dx), (y, dy), (z, dz) = number(r), number(r), number(r)
        # a null bound makes the whole unknown here
        return f"{x} {no}BETWEEN {y} AND {z}", f"(CASE WHEN {dx} IS NULL OR {dy} IS NULL OR {dz} IS NULL THEN NULL ELSE {dx} {dno}BETWEEN {dy} AND {dz} END)"
    if kind == "in":
        x, dx = number(r)
        items = r.choice(["1, 2, 3", "-1, NULL", "0"])
        return f"{x} {no}IN ({items})", f"({dx} {dno}IN ({items}))"
    p = r.choice([("a*", "a%"), ("*C", "%c"), ("?b?", "_b_")])
    return f"s {no}LIKE '{p[0]}'", f"(lower(s) {dno}LIKE '{p[1]}')"


@pytest.mark.parametrize("seed", range(6))
def test_conditions(spark, seed):
    r = random.Random(seed)
    frame = pd.DataFrame(ROWS, columns=["id", "a", "b", "s"])
    frame["a"] = frame["a"].astype("Int64")
    e = Engine(spark, tables={"t": spark.createDataFrame(ROWS, "id int, a int, b double, s string")})
    con = duckdb.connect()
    con.register("t", frame)
    pairs = [condition(r) for _ in range(12)]
    for access, duck in pairs:
        got = sorted(x["id"] for x in e.query(f"SELECT id FROM t WHERE {access}").collect())
        assert got == sorted(x[0] for x in con.sql(f"SELECT id FROM t WHERE {duck}").fetchall()), access


def test_metamorphic(spark):
    e = Engine(spark, tables={"t": spark.createDataFrame(ROWS, "id int, a int, b double, s string")}, views={"v": "SELECT id, a FROM t WHERE a > 0"})
    same = lambda x, y: [tuple(r) for r in e.query(x).collect()] == [tuple(r) for r in e.query(y).collect()]
    assert same("SELECT TOP 7 id FROM t ORDER BY id DESC", "SELECT id FROM t ORDER BY id DESC LIMIT 7")
    assert same("SELECT id FROM v ORDER BY id", "SELECT id FROM t WHERE a > 0 ORDER BY id")
    assert same("SELECT a FROM t UNION SELECT a FROM t ORDER BY a", "SELECT DISTINCT a FROM t ORDER BY a")
    assert same("SELECT a, Count(*) AS n FROM t GROUP BY a ORDER BY a", "SELECT a, Sum(1) AS n FROM t GROUP BY a ORDER BY a")
    assert same("SELECT id FROM t WHERE a IN (SELECT a FROM v) ORDER BY id", "SELECT id FROM t WHERE EXISTS (SELECT * FROM v WHERE v.a = t.a) ORDER BY id")
    assert same("SELECT id FROM t WHERE NOT (a > 1 OR b > 1) ORDER BY id", "SELECT id FROM t WHERE a <= 1 AND b <= 1 ORDER BY id")
