"""Kinds of values and the SQL that turns one into another.

Kinds: null, bool, int, money (decimal with four places), double, text, date,
bytes; anything else (arrays, structs) is 'other' and can only be selected.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

from tamarack.plans.lexer import AccessSqlError

NUMBERS = ("bool", "int", "money", "double")
SQL_TYPE = {"bool": "BOOLEAN", "int": "BIGINT", "money": "DECIMAL(19,4)", "double": "DOUBLE", "text": "STRING", "date": "TIMESTAMP_NTZ", "bytes": "BINARY", "null": "STRING"}


@dataclass(frozen=True)
class Typed:
    """SQL text with its kind; ``literal`` holds the value of a constant."""

    sql: str
    kind: str
    literal: object = None
    aggregate: bool = False


def kind_of(data_type: T.DataType) -> str:
    if isinstance(data_type, T.BooleanType):
        return "bool"
    if isinstance(data_type, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return "int"
    if isinstance(data_type, T.DecimalType):
        return "money" if data_type.scale == 4 else "double"
    if isinstance(data_type, (T.FloatType, T.DoubleType)):
        return "double"
    if isinstance(data_type, (T.StringType, T.CharType, T.VarcharType)):
        return "text"
    if isinstance(data_type, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return "date"
    if isinstance(data_type, T.BinaryType):
        return "bytes"
    return "null" if isinstance(data_type, T.NullType) else "other"


def quote(text: str) -> str:
    """A Spark string literal."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'").replace("\n", "\\n").replace("\r", "\\r").replace("\t", "\\t").replace("\0", "\\0") + "'"


def quote_name(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def _float_text(x: str) -> str:
    """Shortest decimal form; with an exponent below 1e-4 and from 1e21 digits on as 1e+06 style from one million."""
    s = f"CAST(ABS({x}) AS STRING)"
    sign = f"CASE WHEN {x} < 0 THEN '-' ELSE '' END"
    trim = lambda m: f"REGEXP_REPLACE({m}, '\\\\.?0*$', '')"
    plain = trim(s)
    mantissa = f"REGEXP_EXTRACT({s}, '^([0-9.]+)E', 1)"
    power = f"CAST(REGEXP_EXTRACT({s}, 'E(-?[0-9]+)$', 1) AS INT)"
    digits = f"REGEXP_REPLACE({mantissa}, '[.]0$|[.]', '')"
    exponent = lambda p: f"CONCAT(CASE WHEN {p} < 0 THEN 'e-' ELSE 'e+' END, LPAD(CAST(ABS({p}) AS STRING), GREATEST(2, LENGTH(CAST(ABS({p}) AS STRING))), '0'))"
    million = f"CONCAT(REGEXP_REPLACE(CONCAT(SUBSTRING({s}, 1, 1), '.', REPLACE(SUBSTRING({s}, 2), '.', '')), '\\\\.?0*$', ''), 'e+06')"
    body = f"CASE WHEN {s} LIKE '%E-4' THEN CONCAT('0.000', {digits}) WHEN {s} LIKE '%E%' THEN CONCAT({trim(mantissa)}, {exponent(power)}) WHEN ABS({x}) >= 1000000 THEN {million} WHEN {s} LIKE '%.%' THEN {plain} ELSE {s} END"
    return f"CASE WHEN {x} IS NULL THEN NULL WHEN ISNAN({x}) THEN 'NaN' WHEN ABS({x}) = DOUBLE('Infinity') THEN CASE WHEN {x} > 0 THEN '+Inf' ELSE '-Inf' END ELSE CONCAT({sign}, {body}) END"


def as_text(v: Typed) -> str:
    """Text form; null stays null."""
    if v.kind in ("text", "null"):
        return v.sql if v.kind == "text" else "CAST(NULL AS STRING)"
    if v.kind == "bool":
        return f"CASE {v.sql} WHEN TRUE THEN '1' WHEN FALSE THEN '0' END"
    if v.kind == "int":
        return f"CAST({v.sql} AS STRING)"
    if v.kind == "money":
        return f"CAST(CAST({v.sql} AS DECIMAL(19,4)) AS STRING)"
    if v.kind == "double":
        return _float_text(f"CAST({v.sql} AS DOUBLE)")
    if v.kind == "date":
        return f"DATE_FORMAT({v.sql}, 'yyyy-MM-dd HH:mm:ss')"
    if v.kind == "bytes":
        return f"LOWER(HEX({v.sql}))"
    raise AccessSqlError("a column of a nested type can only be selected")


def as_number(v: Typed) -> str:
    """Numeric form: true is -1, text must read as a number."""
    if v.kind == "bool":
        return f"CASE {v.sql} WHEN TRUE THEN -1 WHEN FALSE THEN 0 END"
    if v.kind in ("int", "money", "double"):
        return v.sql
    if v.kind == "text":
        return f"CAST({v.sql} AS DOUBLE)"
    if v.kind == "null":
        return "CAST(NULL AS DOUBLE)"
    raise AccessSqlError(f"a {v.kind} value can't be used as a number")


def as_double(v: Typed) -> str:
    return v.sql if v.kind == "double" and isinstance(v.literal, float) else f"CAST({as_number(v)} AS DOUBLE)"


def as_truth(v: Typed) -> str:
    """A condition: numbers are true unless 0, texts unless '', '0' or 'false'; null is unknown."""
    if v.kind == "bool":
        return v.sql
    if v.kind in ("int", "money", "double"):
        return f"({v.sql} <> 0)"
    if v.kind == "text":
        return f"(NOT LOWER({v.sql}) IN ('', '0', 'false'))"
    if v.kind == "null":
        return "CAST(NULL AS BOOLEAN)"
    return f"({v.sql} IS NOT NULL)"


def common_kind(kinds: list[str]) -> str:
    """The kind that holds values of all kinds: null < bool < int < money < double; any mix with text, date or bytes is text."""
    real = [k for k in dict.fromkeys(kinds) if k != "null"]
    if not real:
        return "null"
    if len(real) == 1:
        return real[0]
    if "other" in real:
        raise AccessSqlError("a column of a nested type can't be mixed with other values")
    if all(k in NUMBERS for k in real):
        return max(real, key=NUMBERS.index)
    return "text"


def to_kind(v: Typed, kind: str) -> str:
    """``v`` as a value of ``kind``, which common_kind gave."""
    if v.kind == "null":
        return f"CAST(NULL AS {SQL_TYPE[kind]})"
    if v.kind == kind:
        return f"CAST({v.sql} AS BIGINT)" if kind == "int" else v.sql
    if kind == "text":
        return as_text(v)
    return f"CAST({as_number(v)} AS {SQL_TYPE[kind]})"
