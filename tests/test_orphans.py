import datetime as dt

from tamarack.operators import orphans

D = lambda m: dt.datetime(2024, m, 1)
CONTROL = "control_id long, form_id long, db_file string, source_object string, control_source string, exported_at timestamp_ntz, loaded_at timestamp_ntz"
FORM = "form_id long, db_file string, form_name string, record_source string, created_at timestamp_ntz, deleted_at timestamp_ntz, exported_at timestamp_ntz, loaded_at timestamp_ntz"
OBJECT = "db_file string, obj_name string, obj_type int, created_at timestamp_ntz, deleted_at timestamp_ntz"
FIELD = "db_file string, obj_name string, field_name string, created_at timestamp_ntz, deleted_at timestamp_ntz"


def test_sources_of_record_source():
    f = orphans.sql_sources
    assert f(None) == [] and f("  ; ") == []
    assert f(" [My Table] ;") == ["my table"] and f("Selection") == ["selection"]
    assert f("SELECT a.*, 'from t_none' FROM [A B] AS a left join c ON a.x = c.x, d e WHERE x IN (SELECT y FROM (z INNER JOIN w ON z.i = w.i))") == ["a b", "c", "d", "z", "w"]
    assert f('select * from t where m = "join x"') == ["t"]
    assert f("select 'unclosed") == []


def test_field_ref():
    f = orphans.field_ref
    assert f(None) == [] and f(" ") == [] and f("=Sum([x])") == []
    assert f("[Rate]") == ["", "rate"] and f("t.[A.b]") == ["t", "a.b"] and f("[x.y].z") == ["x.y", "z"]


def run(spark, controls=(), forms=(), objects=(), fields=()):
    frames = [spark.createDataFrame(list(rows), schema) for rows, schema in ((controls, CONTROL), (forms, FORM), (objects, OBJECT), (fields, FIELD))]
    return {tuple(r) for r in orphans.form_orphans(*frames).collect()}


def test_reasons(spark):
    objects = [("a", "T1", 1, D(1), None), ("a", "gone", 1, D(1), D(3)), ("a", "soon", 5, D(8), None), ("a", "again", 5, D(1), D(2)), ("a", "AGAIN", 5, D(4), None), ("b", "other", 1, D(1), None), ("a", "rpt", -32764, D(1), None)]
    forms = [(1, "a", "F", "t1", D(1), None, D(5), None), (2, "a", "G", "select * from gone, soon", D(1), None, D(5), None), (3, "a", "H", "[other]", D(1), D(4), D(5), None), (4, "a", "I", "again", D(1), None, D(5), None), (5, "a", "J", None, D(1), None, D(5), None), (5, "a", "J", None, D(1), None, D(5), None)]
    fields = [("a", "t1", "x", D(1), None), ("a", "t1", "y", D(1), D(2)), ("a", "again", "z", D(9), None)]
    controls = [
        (10, 1, "a", "form.f", "X", D(5), None), (11, 1, "a", "h", "[y]", D(5), None), (12, 1, "a", "nothing", "w", D(5), None),
        (13, 1, "a", "Table.T1", "t1.x", D(5), None), (14, 1, "a", "Query.T1", "=x", D(5), None), (15, 2, "a", "report.RPT", "x", D(5), None),
        (16, 4, "a", None, "z", D(5), None), (17, 5, "a", "", "x", D(5), None), (12, 1, "a", "nothing", "w", D(5), None),
    ]
    assert run(spark, controls, forms, objects, fields) == {
        ("source_object", 11, "deleted", "2024-05"),
        ("source_object", 12, "missing", "2024-05"),
        ("source_object", 14, "missing", "2024-05"),
        ("record_source", 2, "deleted", "2024-05"),
        ("record_source", 3, "missing", "2024-05"),
        ("control_source", 11, "deleted", "2024-05"),
        ("control_source", 12, "missing", "2024-05"),
        ("control_source", 16, "late", "2024-05"),
    }


def test_empty(spark):
    assert run(spark) == set()


def test_extra_columns_and_null_rows(spark):
    frames = [spark.createDataFrame([], CONTROL + ", kind string, name string, reason string"), spark.createDataFrame([(1, "a", None, "lost", None, None, D(5), None, "k"), (None,) * 9], FORM + ", kind string"), spark.createDataFrame([(None,) * 6], OBJECT + ", kind string"), spark.createDataFrame([(None,) * 6], FIELD + ", known boolean")]
    assert {tuple(r) for r in orphans.form_orphans(*frames).collect()} == {("record_source", 1, "missing", "2024-05")}
