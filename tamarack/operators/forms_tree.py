"""The tree of form controls: sections, controls in them, and forms hosted by SubForm controls."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tamarack.functions.names import name_key, object_ref, strip
from tamarack.operators.hierarchy import hierarchy
from tamarack.operators.rows import one_per_key


def control_links(controls: DataFrame) -> DataFrame:
    """control_id, parent_id and ctl_name of every control.

    A control hangs from the control of its form that section_name names, a
    section from the SubForm control of its database that hosts its form.  Of
    several parents of one name the smallest control_id counts.  Names that
    are null match nothing; an unmatched row has a null parent.
    """
    cols = ["form_id", "db_file", "form_name", "ctl_name", "section_name", "is_section", "source_object", "ctl_type"]
    rows = one_per_key(controls.select("control_id", "loaded_at", *cols).filter("control_id is not null"), ["control_id"], ["loaded_at", *cols], "loaded_at")
    kind, target = object_ref(F.col("source_object"))
    section = F.coalesce("is_section", F.lit(False))
    host = (F.lower(strip(F.col("ctl_type"))) == "subform") & (strip(F.col("source_object")) != "") & (kind == "form")
    rows = rows.select(
        "control_id",
        "ctl_name",
        F.when(section, F.struct(F.lit("host").alias("by"), F.col("db_file").alias("scope"), name_key(F.col("form_name")).alias("name"))).otherwise(F.struct(F.lit("name").alias("by"), F.col("form_id").cast("string").alias("scope"), name_key(F.col("section_name")).alias("name"))).alias("seeks"),
        F.array_compact(
            F.array(
                F.struct(F.lit("name").alias("by"), F.col("form_id").cast("string").alias("scope"), name_key(F.col("ctl_name")).alias("name")),
                F.when(host, F.struct(F.lit("host").alias("by"), F.col("db_file").alias("scope"), target.alias("name"))),
            )
        ).alias("offers"),
    )
    offers = rows.select(F.col("control_id").alias("parent_id"), F.explode("offers").alias("o")).select("parent_id", "o.by", "o.scope", "o.name").filter("scope is not null and name is not null").groupBy("by", "scope", "name").agg(F.min("parent_id").alias("parent_id"))
    return rows.select("control_id", "ctl_name", "seeks.by", "seeks.scope", "seeks.name").join(offers, ["by", "scope", "name"], "left").select("control_id", "parent_id", "ctl_name")


def control_tree(controls: DataFrame, paths: bool = True) -> DataFrame:
    """``hierarchy`` over ``control_links``."""
    return hierarchy(control_links(controls), "control_id", "parent_id", paths)


def control_paths(controls: DataFrame, tree: DataFrame) -> DataFrame:
    """Full path of every control as names joined by '/', from the root down; null on or below a loop.

    Ancestors are exploded, named and put together again per control, so no
    name table is broadcast.
    """
    names = one_per_key(controls.select("control_id", "loaded_at", "ctl_name").filter("control_id is not null"), ["control_id"], ["loaded_at", "ctl_name"], "loaded_at").select(F.col("control_id").alias("step"), F.coalesce(strip(F.col("ctl_name")), F.lit("")).alias("step_name"))
    steps = tree.filter("depth >= 0").select("id", F.posexplode(F.array_append("ancestors", F.col("id"))).alias("pos", "step"))
    paths = steps.join(names, "step").groupBy("id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "step_name"))), lambda s: s["step_name"]), "/").alias("path"))
    return tree.join(paths, "id", "left").select("id", "parent_id", "root_id", "depth", "path", "subtree_size", "on_loop")
