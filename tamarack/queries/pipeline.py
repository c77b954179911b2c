"""Queries of the data-preparation operators; pN_found gives the columns its problem states."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tamarack.operators import drift, forms_tree, hierarchy, nested, orphans, packed, widen
from tamarack.queries.oracles import ORACLES
from tamarack.sources.tables import table
from tamarack.workspace import settle


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    tree = forms_tree.control_tree(table(spark, d, "form_control"), paths=False)
    return tree.select(F.col("id").alias("control_id"), "root_id", F.col("depth").alias("node_depth"))


def p1_paths(spark: SparkSession, d: str) -> DataFrame:
    controls = table(spark, d, "form_control")
    return forms_tree.control_paths(controls, forms_tree.control_tree(controls))


def p1_descendants(spark: SparkSession, d: str) -> DataFrame:
    # its SQL leaves out what hangs from loops; p1_below has all
    return hierarchy.descendants(forms_tree.control_tree(table(spark, d, "form_control")).filter("depth >= 0"))


def p1_below(spark: SparkSession, d: str) -> DataFrame:
    return hierarchy.descendants(forms_tree.control_tree(table(spark, d, "form_control")))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    # the problem's kinds; other lists that the merged schema finds are in p2_flat_nodes
    return nested.form_nodes(table(spark, d, "form_export"), attributes=False).filter(F.col("route").rlike(nested.FORM_ROUTES)).select("export_id", F.col("kind").alias("node_kind"), F.col("path").alias("node_path"))


def p2_schema(spark: SparkSession, d: str) -> DataFrame:
    return nested.merged_schema(nested.form_nodes(table(spark, d, "form_export")))


def p2_controls(spark: SparkSession, d: str) -> DataFrame:
    flat = nested.flat_table(nested.form_nodes(table(spark, d, "form_export")), "control", [("name", "string"), ("type", "string"), ("typecode", "bigint"), ("left", "bigint"), ("top", "bigint"), ("caption", "string")])
    return flat.drop("attributes")


def p2_flat_nodes(spark: SparkSession, d: str) -> DataFrame:
    return nested.form_nodes(table(spark, d, "form_export"))


def _flat(spark: SparkSession, d: str, kind: str) -> DataFrame:
    """All attributes of one kind, by the merged schema, and the map of them."""
    return nested.flat_table(settle(nested.form_nodes(table(spark, d, "form_export")).filter(F.col("kind") == kind)), kind)


def p2_flat_section(spark: SparkSession, d: str) -> DataFrame:
    return _flat(spark, d, "section")


def p2_flat_control(spark: SparkSession, d: str) -> DataFrame:
    return _flat(spark, d, "control")


def p2_flat_property(spark: SparkSession, d: str) -> DataFrame:
    return _flat(spark, d, "property")


def p2_flat_component(spark: SparkSession, d: str) -> DataFrame:
    return _flat(spark, d, "component")


def p2_flat_item(spark: SparkSession, d: str) -> DataFrame:
    return _flat(spark, d, "item")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return packed.packed_fields(table(spark, d, "form_control"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return drift.schema_changes(table(spark, d, "schema_column")).select("file_name", "table_name", "col_name", "change_kind")


def p4_layout(spark: SparkSession, d: str) -> DataFrame:
    return drift.consistent_layout(table(spark, d, "schema_column"))


def p4_columns(spark: SparkSession, d: str) -> DataFrame:
    return drift.consistent_columns(table(spark, d, "schema_column")).drop("root_id")


def p4_objects(spark: SparkSession, d: str) -> DataFrame:
    # forms are kept apart from other objects and name their name otherwise
    layout = [("db_file", "string"), ("obj_name", "string"), ("obj_type", "int"), ("created_at", "timestamp_ntz"), ("deleted_at", "timestamp_ntz")]
    return drift.unite([table(spark, d, "catalog_object"), table(spark, d, "form_content")], layout, {"form_name": "obj_name"})


def _orphans(spark: SparkSession, d: str) -> DataFrame:
    return orphans.form_orphans(*(table(spark, d, t) for t in ("form_control", "form_content", "catalog_object", "catalog_field")))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return _orphans(spark, d)


def p6_counts(spark: SparkSession, d: str) -> DataFrame:
    return orphans.orphan_counts(_orphans(spark, d))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return widen.cells_of(widen.form_attributes(table(spark, d, "form_property")), ["owner_kind", "owner_id"])


def p7_wide(spark: SparkSession, d: str) -> DataFrame:
    return widen.form_attributes(table(spark, d, "form_property"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (p1_found, p1_paths, p1_descendants, p1_below, p2_found, p2_schema, p2_controls, p2_flat_nodes, p2_flat_section, p2_flat_control, p2_flat_property, p2_flat_component, p2_flat_item, p3_found, p4_found, p4_layout, p4_columns, p4_objects, p6_found, p6_counts, p7_found, p7_wide)}

__all__ = ["ORACLES", "QUERIES"]
