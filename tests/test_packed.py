import re

from hypothesis import given
from hypothesis import strategies as st

from tamarack.operators import packed


def test_tokenizer_cases():
    t = packed.tokenize
    assert t(None) == [] and t("") == [] and t("  ") == []
    assert t(";") == [""] and t("a;") == ["a"] and t(";a") == ["", "a"] and t("a;;b") == ["a", "", "b"]
    assert t('"a;b";\'c,d\';[e|f]') == ["a;b", "c,d", "e|f"]
    assert t('"say ""hi""";\'Driver\'\'s copy\'') == ['say "hi"', "Driver's copy"]
    assert t("Driver's copy;N/A") == ["Driver's copy", "N/A"]
    assert t("a\r\nb\n\nc\td") == ["a", "b", "", "c", "d"]
    assert t("a；b，c") == ["a", "b", "c"]
    assert t("2,41 cm;;7,42 cm;0", True) == ["2,41 cm", "", "7,42 cm", "0"]
    assert t("1,2,3", True) == ["1,2,3"] and t("0, 0, 2", True) == ["0", "0", "2"]
    assert t('"never closed;x') == ['"never closed', "x"]
    assert t('"a" b;c') == ["ab", "c"]
    assert t("[a]b; [c") == ["ab", "[c"]


def test_depth_and_escapes():
    t = packed.tokenize
    assert t("[a[b]c];d") == ["a[b]c", "d"] and t("[[x;y],[z]];w") == ["[x;y],[z]", "w"]
    assert t("[a[b];c") == ["a[b", "c"] and t("[];x") == ["", "x"]
    assert t(r'"a\";b";c', escape="\\") == ['a";b', "c"] and t(r"[a\];b];c", escape="\\") == ["a];b", "c"]
    # without an escape character a backslash is one of a path
    assert t(r'"C:\dir\";x') == ["C:\\dir\\", "x"]
    assert t("[" * 50_000) == ["[" * 50_000] or len(t("[" * 50_000)) == 1


@given(st.lists(st.text(alphabet="ab ,;|'\"[]\t", max_size=6), min_size=1, max_size=6))
def test_round_trip_of_quoted_values(values):
    text = ";".join('"' + v.replace('"', '""') + '"' for v in values)
    assert packed.tokenize(text) == values


@given(st.text(alphabet="ab12 ,;\n", max_size=30))
def test_unquoted_like_split(text):
    bare = text.strip(" ")
    parts = re.split(r"[;,\n]", bare)
    if parts[-1].strip(" ") == "":
        parts = parts[:-1]
    assert packed.tokenize(text) == [p.strip(" ") for p in parts]


def test_split_keeps_columns_and_long_texts(spark):
    df = spark.createDataFrame([(1, "x", ";".join(map(str, range(20000)))), (2, "y", None), (3, "z", "")], "id long, item_kind string, t string")
    rows = packed.split_packed(df, "t")
    assert rows.columns == ["id", "item_kind", "t", "item_text", "item_no"]
    assert rows.count() == 20000 and rows.agg({"item_no": "max"}).first()[0] == 20000


def test_packed_fields(spark):
    schema = "control_id long, link_child_fields string, link_master_fields string, column_widths string, row_source_type string, row_source string"
    rows = [(1, "[a];b", None, "1,5cm;2", " VALUE list ", "x"), (1, "[a];b", None, "1,5cm;2", " VALUE list ", "x"), (2, None, "", None, "Table/Query", "SELECT 1"), (None, "a", None, None, None, None)]
    got = {tuple(r) for r in packed.packed_fields(spark.createDataFrame(rows, schema)).collect()}
    assert got == {(1, "link_child_fields", 1, "a"), (1, "link_child_fields", 2, "b"), (1, "column_widths", 1, "1,5cm"), (1, "column_widths", 2, "2"), (1, "row_source", 1, "x")}
    assert packed.packed_fields(spark.createDataFrame([], schema)).count() == 0


def test_clashing_columns_are_replaced(spark):
    df = spark.createDataFrame([(9, "old", "a;b", 1)], "item_no int, item_text string, t string, __pos int")
    rows = packed.split_packed(df, "t").orderBy("item_no").collect()
    assert [(r["item_no"], r["item_text"], r["__pos"]) for r in rows] == [(1, "a", 1), (2, "b", 1)]
