"""Saved queries: the rows that describe one, and the SQL they stand for."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from tamarack.sources.jet.pages import JetError
from tamarack.sources.jet.tables import QUERY_OBJECT, JetFile

#: Row kinds of MSysQueries.
PARAMETER, OPTIONS, EXTERNAL, SOURCE, COLUMN, JOIN, WHERE, GROUP, HAVING, ORDER = 2, 3, 4, 5, 6, 7, 8, 9, 10, 11
#: Option bits.
ALL_COLUMNS, DISTINCT, OWNER_ACCESS, DISTINCT_ROW, TOP, PERCENT = 1, 2, 4, 8, 16, 32
JOINS = {1: "INNER JOIN", 2: "LEFT JOIN", 3: "RIGHT JOIN"}
PARAMETER_TYPES = {0: "Value", 1: "Bit", 2: "Byte", 3: "Short", 4: "Long", 5: "Currency", 6: "IEEESingle", 7: "IEEEDouble", 8: "DateTime", 9: "Binary", 10: "Text", 11: "LongBinary", 15: "Guid"}


@dataclass(frozen=True)
class QueryRow:
    attribute: int
    flag: int = 0
    name1: str | None = None
    name2: str | None = None
    expression: str | None = None


def bracket(name: str) -> str:
    return "[" + name.replace("]", "]]") + "]"


def _from(rows: list[QueryRow]) -> str:
    """Sources joined pairwise in the order of the join rows; what no join touches follows after commas."""
    groups: list[tuple[set[str], str]] = []
    for r in rows:
        if r.attribute == SOURCE and (r.name1 or r.expression):
            text = (bracket(r.expression) + "." if r.expression and r.name1 else "") + bracket(r.name1 or r.expression)
            if r.name2:
                text += " AS " + bracket(r.name2)
            groups.append(({(r.name2 or r.name1 or r.expression).lower()}, text))
    joins: dict[tuple, list[str]] = {}
    for r in rows:
        if r.attribute == JOIN:
            if not (r.name1 and r.name2 and r.expression):
                raise JetError("a join of the saved query is incomplete")
            if r.flag not in JOINS:
                raise JetError(f"unknown join type {r.flag}")
            joins.setdefault((r.name1.lower(), r.name2.lower(), r.flag), []).append(f"({r.expression})")
    for (left, right, flag), conditions in joins.items():
        a = next((g for g in groups if left in g[0]), None)
        b = next((g for g in groups if right in g[0]), None)
        if a is None or b is None:
            raise JetError(f"a join names an unknown table: {left} or {right}")
        if a is b:
            raise JetError(f"the joins of the saved query run in a circle at {left} and {right}")
        merged = (a[0] | b[0], f"({a[1]} {JOINS[flag]} {b[1]} ON {' AND '.join(conditions)})")
        groups = [merged if g is a else g for g in groups if g is not b]
    return ", ".join(text for _, text in groups)


def query_sql(rows: Iterable[QueryRow], object_flags: int = 0) -> str:
    """SELECT text of a saved query from its rows.

    Queries that aren't SELECTs are refused by their object flags.  Without
    columns the option for all columns must be set.  DISTINCT rules out TOP,
    as in the original.
    """
    if object_flags & 0xF0:
        raise JetError(f"unsupported query type {object_flags:#x}: only SELECT queries can be read")
    rows = list(rows)
    of = lambda kind: [r for r in rows if r.attribute == kind]
    parts = []
    params = []
    for r in of(PARAMETER):
        if r.name1:
            if r.flag not in PARAMETER_TYPES:
                raise JetError(f"unknown parameter type {r.flag}")
            params.append(f"{bracket(r.name1)} {PARAMETER_TYPES[r.flag]}")
    options = next(iter(of(OPTIONS)), QueryRow(OPTIONS))
    bits = options.flag
    word = "DISTINCT " if bits & DISTINCT else "DISTINCTROW " if bits & DISTINCT_ROW else f"TOP {options.name1 or '0'}{' PERCENT' if bits & PERCENT else ''} " if bits & TOP else ""
    columns = [r.expression + (f" AS {bracket(r.name1)}" if r.name1 else "") for r in of(COLUMN) if r.expression]
    if not columns and bits & ALL_COLUMNS:
        columns = ["*"]
    if not columns:
        raise JetError("the saved query has no columns")
    source = _from(rows)
    if source and any(r.name1 or r.expression for r in of(EXTERNAL)):
        remote = of(EXTERNAL)[0]
        source += f" IN '{remote.name1 or ''}'" + (f" [{remote.expression}]" if remote.expression else "")
    parts.append(f"SELECT {word}{', '.join(columns)}")
    if source:
        parts.append(f"FROM {source}")
    for kind, lead in ((WHERE, "WHERE"), (GROUP, "GROUP BY"), (HAVING, "HAVING"), (ORDER, "ORDER BY")):
        texts = [r.expression + (" DESC" if kind == ORDER and (r.name1 or "").upper() == "D" else "") for r in of(kind) if r.expression]
        if texts:
            parts.append(f"{lead} {', '.join(texts) if kind in (GROUP, ORDER) else texts[0]}")
    if bits & OWNER_ACCESS:
        parts.append("WITH OWNERACCESS OPTION")
    return (f"PARAMETERS {', '.join(params)};\n" if params else "") + "\n".join(parts) + ";"


def saved_queries(file: JetFile) -> dict[str, str | JetError]:
    """SQL of every saved query of a file, or the reason it can't be read."""
    objects = {o.id: o for o in file.objects() if o.type == QUERY_OBJECT}
    rows: dict[int, list[QueryRow]] = {i: [] for i in objects}
    if objects:
        table = file.table("MSysQueries")
        for attribute, expression, flag, name1, name2, owner in file.rows(table, columns=table.pick(["Attribute", "Expression", "Flag", "Name1", "Name2", "ObjectId"])):
            if owner in rows:
                rows[owner].append(QueryRow(attribute or 0, flag or 0, name1 or None, name2 or None, expression or None))
    out: dict[str, str | JetError] = {}
    for i, o in objects.items():
        try:
            out[o.name] = query_sql(rows[i], o.flags)
        except JetError as error:
            out[o.name] = error
    return out
