"""Column expressions for names that are spelled freely."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: the characters that count as outer blanks of a name.
BLANKS = " \t\r\n\u00a0\u3000"


def strip(c: Column) -> Column:
    """``c`` without outer blanks."""
    return F.btrim(c, F.lit(BLANKS))


def name_key(c: Column) -> Column:
    """Comparison form of an object name: no case, outer blanks, or one pair of square brackets.

    Null stays null; a name of blanks only becomes ''.
    """
    bare = strip(c)
    inner = F.when(bare.startswith("[") & bare.endswith("]") & (F.length(bare) >= 2), strip(bare.substr(F.lit(2), F.length(bare) - 2))).otherwise(bare)
    return F.lower(inner)


def object_ref(c: Column) -> tuple[Column, Column]:
    """Kind (form, table, query, report) and name key of a source object text.

    A text without a kind before the dot names a form.
    """
    bare = strip(c)
    kind = F.lower(F.regexp_extract(bare, r"(?i)^(form|table|query|report)\s*\.", 1))
    rest = F.regexp_replace(bare, r"(?i)^(?:form|table|query|report)\s*\.", "")
    return F.when(kind == "", "form").otherwise(kind), name_key(rest)
