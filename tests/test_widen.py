import datetime as dt
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tamarack.operators import widen

SCHEMA = "prop_row_id long, owner_kind string, owner_id long, prop_name string, prop_value string, recorded_at timestamp_ntz"
D = lambda d: dt.datetime(2024, 1, d)


@pytest.mark.parametrize(
    ("kind", "value", "want"),
    [
        ("integer", " 1,840 ", "1840"), ("integer", "5137.0", "5137"), ("integer", "&H7AB", "1963"), ("integer", "&h10&", "16"), ("integer", "1,84", None), ("integer", "12.5", None), ("integer", "n/a", None), ("integer", "-3", "-3"), ("integer", "", None), ("integer", "007", "7"),
        ("boolean", "-1", "true"), ("boolean", " ON", "true"), ("boolean", "No", "false"), ("boolean", "2", None),
        ("colour", "#3F163F ", "#3f163f"), ("colour", "255", "#ff0000"), ("colour", "&H45AA8E&", "#8eaa45"), ("colour", "16777216", None), ("colour", "#12345", None), ("colour", "-1", None),
        ("number", "7,55", "7.55"), ("number", "9.410", "9.41"), ("number", ".66", "0.66"), ("number", "1.005", "1.01"), ("number", "1,2,3", None),
        ("date", "2015/07/30 08:15:00", "2015-07-30"), ("date", "20221207", "2022-12-07"), ("date", "24.04.2020", "2020-04-24"), ("date", "2021-02-30", None), ("date", "unknown", None), ("date", "1.2.2020", "2020-02-01"),
        ("text", "  a b ", "a b"), ("text", "   ", None), ("text", None, None),
    ],
)
def test_readable(spark, kind, value, want):
    df = spark.createDataFrame([(kind, value)], "k string, v string")
    assert df.select(widen.readable(F.col("k"), F.col("v")).alias("r")).first()["r"] == want


def test_last_readable_value_wins(spark):
    rows = [
        (1, "form", 5, "Width", "10", D(1)), (2, "form", 5, " WI_DTH", "20", D(2)), (3, "form", 5, "width", "#Error", D(3)),
        (4, "form", 5, "Caption", "a", D(1)), (5, "form", 5, "Caption", "b", D(1)), (6, "control", 5, "Visible", "yes", None),
        (7, "form", 6, "Width", "n/a", D(1)), (8, None, 5, "Width", "1", D(1)), (9, "form", 5, "No Such", "1", D(1)), (10, "form", 7, "nosuch", "2.5", D(1)), (11, "form", 7, "Odd", "x", D(1)), (12, "form", 7, "odd", "1", D(0 + 2)), (13, "form", 7, " ", "1", D(1)), (2, "form", 5, " WI_DTH", "20", D(2)),
    ]
    wide = widen.form_attributes(spark.createDataFrame(rows, SCHEMA))
    got = {(r["owner_kind"], r["owner_id"]): r for r in wide.collect()}
    assert set(got) == {("form", 5), ("control", 5), ("form", 7)}
    # attributes of no fixed type are found, with the narrowest type of their values
    assert str(got["form", 5]["nosuch"]) == "1.00" and str(got["form", 7]["nosuch"]) == "2.50" and got["form", 7]["odd"] == "1"
    assert wide.columns[-2:] == ["nosuch", "odd"]
    assert got["form", 5]["width"] == 20 and got["form", 5]["caption"] == "b" and got["control", 5]["visible"] is True
    cells = {tuple(r) for r in widen.cells_of(wide, ["owner_kind", "owner_id"]).collect()}
    assert cells == {("form", 5, "nosuch", "1.00"), ("form", 7, "nosuch", "2.50"), ("form", 7, "odd", "1"), ("form", 5, "width", "20"), ("form", 5, "caption", "b"), ("control", 5, "visible", "true")}


def test_blocks_and_types(spark, monkeypatch):
    monkeypatch.setattr(widen, "BLOCK", 7)
    cells = [(k, a, str(k + n)) for k in range(100) for n, a in enumerate(("x", "y")) if (k + n) % 3]
    df = spark.createDataFrame(cells, "id long, attr_name string, cell_value string")
    rows = {r["id"]: (r["x"], r["y"]) for r in widen.stitch(df, ["id"], {"x": "bigint", "y": "decimal(10,2)"}).collect()}
    want = {}
    for k, a, v in cells:
        want.setdefault(k, [None, None])[a == "y"] = int(v) if a == "x" else Decimal(v)
    assert rows == {k: tuple(v) for k, v in want.items()}


def test_ordinals_are_dense_and_in_order(spark, monkeypatch):
    monkeypatch.setattr(widen, "BLOCK", 5)
    df = spark.createDataFrame([(k % 37, a, "1") for k in range(37) for a in ("x", "other")] + [(99, "other", "1")], "id long, attr_name string, cell_value string")
    rows = widen.stitch(df.repartition(7), ["id"], {"x": "int", "y z": "string"}).collect()
    assert sorted((r["id"], r["ordinal"]) for r in rows) == [(k, k) for k in range(37)] and all(r["x"] == 1 and r["y z"] is None for r in rows)


def test_too_many_attributes_are_refused(spark, monkeypatch):
    monkeypatch.setattr(widen, "MOST_COLUMNS", 26)
    rows = [(k, "form", k, f"new{k}", "1", D(1)) for k in range(3)]
    with pytest.raises(ValueError):
        widen.form_attributes(spark.createDataFrame(rows, SCHEMA))


def test_empty(spark):
    assert widen.form_attributes(spark.createDataFrame([], SCHEMA)).count() == 0


def test_extra_columns(spark):
    df = spark.createDataFrame([(1, "form", 5, "Width", "10", D(1), "x", 3, 4)], SCHEMA + ", attr_name string, ordinal int, cell_value int")
    assert widen.form_attributes(df).first()["width"] == 10
