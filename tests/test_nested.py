import json

from tamarack.operators import nested

SCHEMA = "export_id long, loaded_at timestamp_ntz, content_json string, components array<struct<comp_name string, properties array<struct<prop_key string, prop_value string>>>>"


def found(spark, rows):
    return {(r["export_id"], r["kind"], r["path"], r["parent_path"]) for r in nested.form_nodes(spark.createDataFrame(rows, SCHEMA)).collect()}


def test_shapes(spark):
    doc = {"PROPERTIES": {"ID": 1}, "sections": json.dumps([{"Name": "Detail", "controls": [{"Controls": [{"Properties": [None, {"ID": 2}]}]}]}])}
    rows = [(1, None, json.dumps(doc), None), (1, None, json.dumps(doc), None), (2, None, "{broken", [("a", [("k", "v"), ("k", None)]), ("b", [])]), (3, None, None, []), (4, None, '{"a": NaN}', None), (5, None, "[1]", None)]
    assert found(spark, rows) == {
        (1, "property", "0", None),
        (1, "section", "0", None),
        (1, "control", "0.0", "sections:0"),
        (1, "control", "0.0.0", "sections.controls:0.0"),
        (1, "property", "0.0.0.1", "sections.controls.controls:0.0.0"),
        (2, "component", "0", None),
        (2, "component", "1", None),
        (2, "item", "0.0", "components:0"),
        (2, "item", "0.1", "components:0"),
    }
    assert found(spark, []) == set()


def test_deep_and_long(spark):
    inner = {"Controls": []}
    for _ in range(150):
        inner = {"Controls": [inner]}
    rows = [(1, None, json.dumps({"Sections": [inner]}), None), (2, None, "[" * 200000, None), (3, None, json.dumps({"Properties": [{"Value": "x" * 10**6}]}), None)]
    got = found(spark, rows)
    assert sum(k == "control" for _, k, _, _ in got) == 150 and (3, "property", "0", None) in got


def test_every_row_has_its_parent_and_values_survive(spark, small):
    nodes = nested.form_nodes(spark.read.parquet(f"{small}/form_export.parquet"))
    rows = nodes.collect()
    keys = {r["node_key"] for r in rows}
    assert len(keys) == len(rows)
    assert all(r["parent_key"] is None or r["parent_key"] in keys for r in rows)


def test_schema_and_flat_table(spark):
    doc = {"Properties": [{"ID": 1, "Value": "2"}, {"ID": 7, "Value": "x", "path": True}]}
    nodes = nested.form_nodes(spark.createDataFrame([(1, None, json.dumps(doc), None)], SCHEMA))
    kinds = {r["attribute"]: r["type"] for r in nested.merged_schema(nodes).collect()}
    assert kinds == {"id": "bigint", "value": "string", "path": "boolean"}
    flat = nested.flat_table(nodes, "property")
    assert {(r["id"], r["value"], r["path_value"]) for r in flat.collect()} == {(1, "2", None), (7, "x", True)}


def test_every_kind_has_a_whole_flat_table(spark, small):
    from tamarack.queries import pipeline
    from tamarack.sources.tables import table

    nodes = nested.form_nodes(table(spark, small, "form_export")).cache()
    for kind in ("section", "control", "property", "component", "item"):
        flat, own = pipeline.QUERIES[f"p2_flat_{kind}"](spark, small), nodes.filter(nodes.kind == kind)
        names = {r["attribute"] for r in nested.merged_schema(own).collect()}
        assert {n if n not in ("path", "ordinal") else f"{n}_value" for n in names} | {"attributes", "node_key", "parent_key"} <= set(flat.columns)
        assert flat.count() == own.count() > 0


def test_merged_schema_tells_the_lists(spark):
    # tags is a list in the second document, so it is one in the first; size never is
    docs = [{"Sections": {"Name": "a", "Tags": {"T": 1}, "Size": {"W": 1}}, "Parts": '[{"P": [{"Q": 2}]}]'}, {"sections": [{"tags": [{"T": 2}, 3, {"T": 3}]}], "parts": [{"p": {"q": 1}}]}]
    df = spark.createDataFrame([(k, None, json.dumps(d), None) for k, d in enumerate(docs)], SCHEMA)
    nodes = nested.form_nodes(df)
    got = {(r["export_id"], r["kind"], r["path"], r["parent_key"]) for r in nodes.collect()}
    assert got == {
        (0, "section", "0", None), (0, "tags", "0.0", "0:sections:0"), (0, "parts", "0", None), (0, "p", "0.0", "0:parts:0"),
        (1, "section", "0", None), (1, "tags", "0.0", "1:sections:0"), (1, "tags", "0.2", "1:sections:0"), (1, "parts", "0", None), (1, "p", "0.0", "1:parts:0"),
    }
    assert {r["kind"] for r in nested.form_nodes(df, only_known=True).collect()} == {"section"}
    values = {r["export_id"]: r["attributes"] for r in nodes.filter("kind = 'section'").collect()}
    assert values[0] == {"name": "a", "size": '{"W": 1}'} and values[1] == {}


def test_odd_keys(spark):
    doc = {"a.b": [{"x>y": [{"z": 1}]}], "": [{"q": 1}], " A.B ": None}
    rows = nested.form_nodes(spark.createDataFrame([(1, None, json.dumps(doc), None)], SCHEMA)).collect()
    assert {(r["kind"], r["path"]) for r in rows} == {("a%2eb", "0"), ("x%3ey", "0.0"), ("", "0")}
