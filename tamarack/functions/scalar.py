"""The scalar functions of the dialect as Spark SQL."""

from __future__ import annotations

import re
from collections.abc import Callable

from tamarack.functions.values import Typed, as_double, as_number, as_text, as_truth, common_kind, quote, to_kind
from tamarack.plans.lexer import AccessSqlError

SPACE = r"' \t\r\n'"
#: Tokens of a date format and their Spark form; mm is always the month.
DATE_TOKENS = {"yyyy": "yyyy", "yy": "yy", "mmmm": "MMMM", "mmm": "MMM", "mm": "MM", "dd": "dd", "hh": "HH", "nn": "mm", "ss": "ss"}
#: Intervals of DatePart.
DATE_PARTS = {"yyyy": "YEAR", "q": "QUARTER", "m": "MONTH", "y": "DAYOFYEAR", "d": "DAY", "w": "DAYOFWEEK", "ww": "WEEKOFYEAR", "h": "HOUR", "n": "MINUTE", "s": "SECOND"}


def _count(name: str, args: list[Typed], low: int, high: int) -> None:
    if not low <= len(args) <= high:
        raise AccessSqlError(f"{name} takes {low}{'' if low == high else f' to {high}'} arguments, got {len(args)}")


def _whole(v: Typed) -> str:
    """A count or position argument."""
    return str(v.literal) if isinstance(v.literal, int) and not isinstance(v.literal, bool) else f"CAST({as_number(v)} AS INT)"


def date_value(v: Typed) -> str:
    """A moment from a date or a text in one of the literal layouts."""
    if v.kind == "date":
        return v.sql
    if v.kind == "null":
        return "CAST(NULL AS TIMESTAMP_NTZ)"
    if v.kind != "text":
        raise AccessSqlError(f"a {v.kind} value is no date")
    layouts = ("M/d/yyyy h:mm:ss a", "M/d/yyyy h:mm a", "M/d/yyyy H:mm:ss", "M/d/yyyy H:mm", "M/d/yyyy", "yyyy-M-d H:mm:ss", "yyyy-M-d H:mm", "yyyy-M-d")
    return "COALESCE(" + ", ".join(f"CAST(TRY_TO_TIMESTAMP({v.sql}, '{x}') AS TIMESTAMP_NTZ)" for x in layouts) + ")"


def _iif(args: list[Typed]) -> Typed:
    _count("IIf", args, 3, 3)
    kind = common_kind([args[1].kind, args[2].kind])
    return Typed(f"(CASE WHEN {as_truth(args[0])} THEN {to_kind(args[1], kind)} ELSE {to_kind(args[2], kind)} END)", kind)


def _nz(args: list[Typed]) -> Typed:
    _count("Nz", args, 1, 2)
    if len(args) == 1:
        return Typed(f"COALESCE({as_text(args[0])}, '')", "text")
    kind = common_kind([args[0].kind, args[1].kind])
    return Typed(f"COALESCE({to_kind(args[0], kind)}, {to_kind(args[1], kind)})", kind)


def _text1(form: str) -> Callable[[list[Typed]], Typed]:
    def make(args: list[Typed]) -> Typed:
        _count("function", args, 1, 1)
        return Typed(form.format(as_text(args[0])), "text")

    return make


def _len(args: list[Typed]) -> Typed:
    _count("Len", args, 1, 1)
    return Typed(f"CHAR_LENGTH({as_text(args[0])})", "int")


def _side(which: str) -> Callable[[list[Typed]], Typed]:
    def make(args: list[Typed]) -> Typed:
        _count(which.title(), args, 2, 2)
        if isinstance(args[1].literal, int) and args[1].literal < 0:
            raise AccessSqlError(f"{which.title()} needs a length of 0 or more")
        return Typed(f"COALESCE({which}({as_text(args[0])}, {_whole(args[1])}), '')", "text")

    return make


def _mid(args: list[Typed]) -> Typed:
    _count("Mid", args, 2, 3)
    if isinstance(args[1].literal, int) and args[1].literal < 1:
        raise AccessSqlError("Mid needs a start of 1 or more")
    if len(args) == 3 and isinstance(args[2].literal, int) and args[2].literal < 0:
        raise AccessSqlError("Mid needs a length of 0 or more")
    rest = f", {_whole(args[2])}" if len(args) == 3 else ""
    return Typed(f"COALESCE(SUBSTRING({as_text(args[0])}, {_whole(args[1])}{rest}), '')", "text")


def _cstr(args: list[Typed]) -> Typed:
    _count("CStr", args, 1, 1)
    return Typed(as_text(args[0]), "text")


def _clng(args: list[Typed]) -> Typed:
    _count("CLng", args, 1, 1)
    if args[0].kind == "int":
        return Typed(f"CAST({args[0].sql} AS BIGINT)", "int")
    return Typed(f"CAST(ROUND({as_number(args[0])}) AS BIGINT)", "int")


def _cdbl(args: list[Typed]) -> Typed:
    _count("CDbl", args, 1, 1)
    return Typed(as_double(args[0]), "double")


def _date(args: list[Typed]) -> Typed:
    _count("Date", args, 0, 0)
    return Typed("CAST(CURRENT_DATE() AS TIMESTAMP_NTZ)", "date")


def _now(args: list[Typed]) -> Typed:
    _count("Now", args, 0, 0)
    return Typed("LOCALTIMESTAMP()", "date")


def _datevalue(args: list[Typed]) -> Typed:
    _count("DateValue", args, 1, 1)
    return Typed(f"CAST(CAST({date_value(args[0])} AS DATE) AS TIMESTAMP_NTZ)", "date")


def _datepart(args: list[Typed]) -> Typed:
    _count("DatePart", args, 2, 4)
    part = args[0].literal
    if not isinstance(part, str) or part.lower() not in DATE_PARTS:
        raise AccessSqlError(f"unsupported DatePart interval {part!r}")
    return Typed(f"CAST({DATE_PARTS[part.lower()]}({date_value(args[1])}) AS BIGINT)", "int")


def _format(args: list[Typed]) -> Typed:
    _count("Format", args, 2, 4)
    layout = args[1].literal
    if not isinstance(layout, str):
        raise AccessSqlError("Format needs a constant format")
    v = args[0]
    if v.kind == "date":
        out = []
        for m in re.finditer(r"yyyy|yy|mmmm|mmm|mm|dd|hh|nn|ss|'|.", layout.lower(), re.DOTALL):
            t = m.group()
            out.append(DATE_TOKENS[t] if t in DATE_TOKENS else "''" if t == "'" else f"'{t}'" if t.isalpha() or t in "[]{}#" else t)
        pattern = re.sub(r"(?<=[a-z])''(?=[a-z])", "", "".join(out)) if "'" not in layout else "".join(out)
        return Typed(f"DATE_FORMAT({v.sql}, {quote(pattern)})", "text")
    if layout.lower() == "fixed":
        return Typed(f"FORMAT_STRING('%.2f', {as_double(v)})" if v.literal is not None else f"(CASE WHEN {v.sql} IS NOT NULL THEN FORMAT_STRING('%.2f', {as_double(v)}) END)", "text")
    return Typed(as_text(v), "text")


def _abs(args: list[Typed]) -> Typed:
    _count("Abs", args, 1, 1)
    kind = args[0].kind if args[0].kind in ("int", "money") else "double"
    inner = f"CAST({args[0].sql} AS BIGINT)" if kind == "int" else args[0].sql if kind == "money" else as_double(args[0])
    return Typed(f"ABS({inner})", kind)


def _round(args: list[Typed]) -> Typed:
    _count("Round", args, 1, 2)
    x = as_double(args[0])
    places = args[1].literal if len(args) == 2 and isinstance(args[1].literal, int) else None
    if len(args) == 1 or places == 0:
        return Typed(f"RINT({x})", "double")
    scale = f"{float(10**places)!r}D" if places is not None else f"POWER(10D, {_whole(args[1])})"
    return Typed(f"(RINT({x} * {scale}) / {scale})", "double")


FUNCTIONS: dict[str, Callable[[list[Typed]], Typed]] = {
    "iif": _iif,
    "nz": _nz,
    "len": _len,
    "lcase": _text1("LOWER({})"),
    "ucase": _text1("UPPER({})"),
    "trim": _text1(r"REGEXP_REPLACE({}, '(?U)^\\s+|\\s+$', '')"),
    "ltrim": _text1("LTRIM(" + SPACE + ", {})"),
    "rtrim": _text1("RTRIM(" + SPACE + ", {})"),
    "left": _side("LEFT"),
    "right": _side("RIGHT"),
    "mid": _mid,
    "cstr": _cstr,
    "clng": _clng,
    "cint": _clng,
    "cdbl": _cdbl,
    "csng": _cdbl,
    "date": _date,
    "now": _now,
    "datevalue": _datevalue,
    "datepart": _datepart,
    "format": _format,
    "abs": _abs,
    "round": _round,
}
AGGREGATES = ("count", "sum", "avg", "min", "max")
