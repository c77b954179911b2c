"""Several values packed in one field, split by a quote-aware finite-state tokenizer."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tamarack.functions.names import strip

#: Characters that separate values, and blanks around them.
SEPARATORS = ";,|\t\r\n；，"
BLANK = " \u00a0\u3000"
CLOSER = {'"': '"', "'": "'", "[": "]"}


def _closed(text: str, k: int, escape: str | None) -> tuple[str, int] | None:
    """The value within the quote or brackets that open at k, and the place after them; None where they are never closed."""
    mark, close, n = text[k], CLOSER[text[k]], len(text)
    bracket, depth, parts = mark == "[", 1, []
    j = k + 1
    while j < n:
        c = text[j]
        if c == escape and j + 1 < n:
            parts.append(text[j + 1])
            j += 2
            continue
        if c == close:
            if not bracket and text.startswith(close, j + 1):
                parts.append(close)
                j += 2
                continue
            depth -= 1
            if not depth:
                return "".join(parts), j + 1
        elif bracket and c == mark:
            depth += 1
        parts.append(c)
        j += 1
    if bracket and (j := text.find(close, k)) > 0:
        # what is opened more often than closed runs to the first closing mark
        return text[k + 1 : j], j + 1
    return None


def tokenize(text: str | None, decimal_comma: bool = False, escape: str | None = None) -> list[str]:
    """Values of a packed text, in order.

    States: before a value, in a bare value, in a quoted value, in a bracketed
    one with its depth, after an escape, after the closing mark.  Separators
    inside quotes or brackets belong to the value; a doubled quote stands for
    one; brackets within brackets are kept and must be closed first, but where
    too few are closed the first closing one ends the value; CR LF is one
    separator; a separator at the very end opens no value.  With ``escape``
    (a backslash, say) the character after it is taken as it is, inside quotes
    and brackets; fields of form designs have none.  With ``decimal_comma`` a
    comma directly between two digits belongs to the value.  A quote or bracket
    that is never closed is an ordinary character, and text between a closing
    mark and the next separator stays with the value.  Null, empty and blank
    texts hold no value.
    """
    if text is None:
        return []
    text = text.strip(BLANK)
    n, k = len(text), 0
    out: list[str] = []
    while k < n:
        while k < n and text[k] in BLANK:
            k += 1
        value, quoted = "", False
        if k < n and text[k] in CLOSER and (found := _closed(text, k, escape)):
            (value, k), quoted = found, True
        start = k
        while k < n and (text[k] not in SEPARATORS or (decimal_comma and text[k] == "," and 0 < k < n - 1 and text[k - 1].isdigit() and text[k + 1].isdigit())):
            k += 1
        tail = text[start:k].strip(BLANK)
        out.append(value + tail if quoted else tail)
        if k < n:
            k += 2 if text.startswith("\r\n", k) else 1
    return out


def split_packed(df: DataFrame, text_col: str, decimal_comma_col: str | None = None, escape: str | None = None) -> DataFrame:
    """All columns of ``df`` plus item_no (from 1) and item_text, one row per value.

    Columns of ``df`` that have these names already are replaced.
    Rows whose text is null or blank give none.  Tokenizing runs in Arrow
    batches; rows never move between partitions.
    """

    def values(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for texts, commas in batches:
            yield pd.Series([tokenize(t, bool(c), escape) for t, c in zip(texts, commas)], dtype=object)

    values.__annotations__ = {"batches": Iterator[tuple[pd.Series, pd.Series]], "return": Iterator[pd.Series]}
    udf = F.pandas_udf(values, "array<string>")
    commas = F.col(decimal_comma_col) if decimal_comma_col else F.lit(False)
    kept = [F.col(f"`{c}`") for c in df.columns if c.lower() not in ("item_no", "item_text")]
    rows = df.filter(strip(F.col(text_col)) != "").select(F.struct(*kept).alias("__row"), udf(F.col(text_col), commas).alias("__values"))
    return rows.select("__row", F.posexplode("__values").alias("__pos", "item_text")).select("__row.*", "item_text", (F.col("__pos") + 1).cast("int").alias("item_no"))


def packed_fields(controls: DataFrame) -> DataFrame:
    """control_id, field_name, item_no, item_text of every packed field of form controls.

    row_source counts only for value lists.  Repeated rows count once.
    """
    fields = ["link_child_fields", "link_master_fields", "column_widths", "row_source"]
    is_list = F.regexp_replace(F.lower("row_source_type"), r"\s", "") == "valuelist"
    packed = F.array(*[F.struct(F.lit(f).alias("field_name"), (F.when(is_list, F.col(f)) if f == "row_source" else F.col(f)).alias("text")) for f in fields])
    long = controls.filter("control_id is not null").select("control_id", F.explode(packed).alias("p")).select("control_id", "p.field_name", "p.text").filter(strip(F.col("text")) != "")
    once = long.groupBy("control_id", "field_name").agg(F.max("text").alias("text"))
    rows = once.withColumn("comma", F.col("field_name") == "column_widths")
    return split_packed(rows, "text", "comma").select("control_id", "field_name", "item_no", "item_text")
