"""Deeply nested records to related flat tables.

Each document is read once into its nested records, whatever their depth and
whatever keys they hang from.  The merged schema of the nesting, over all
documents, then tells which keys are lists: those that any record delivers as
an array of objects, and those known beforehand.  Under these every object is a
row with a key of its own, the key of its parent and its ordinal, also where
the list is a single object or JSON text; elsewhere an object stays a value of
its owner.  Typed nested columns are exploded natively.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tamarack.functions.names import strip
from tamarack.operators.rows import one_per_key
from tamarack.workspace import settle

#: Lists of a form document, as owner's list and own (the document's own list is ''), and the kinds of their objects.
FORM_LISTS = (("", "properties"), ("", "sections"), ("sections", "properties"), ("sections", "controls"), ("controls", "properties"), ("controls", "controls"))
FORM_ROUTES = r"^(properties|sections(\.controls)*(\.properties)?|components(\.properties)?)$"
KINDS = {"properties": "property", "sections": "section", "controls": "control"}
NODES = "array<struct<route string, shape string, path string, attributes map<string,string>>>"
#: The most lists of a nesting, and attributes of a flat table, that are told apart; more are refused.
MOST_LISTS, MOST_COLUMNS = 10_000, 5_000


def _refuse(name: str):
    raise ValueError(name)


def parse_json(text: str | None):
    """The value of a JSON text, or None where it is null, not valid or nested beyond the parser's stack."""
    if text is None:
        return None
    try:
        return json.loads(text, parse_constant=_refuse)
    except (ValueError, RecursionError):
        return None


def _records(value) -> tuple[list, str]:
    """What a value holds as a list, and its shape: an array, a single object or the text of either."""
    shape = "array"
    if isinstance(value, str):
        if not value.lstrip()[:1] in ("[", "{"):
            return [], ""
        value, shape = parse_json(value), "text"
    if isinstance(value, dict):
        return [value], "text" if shape == "text" else "object"
    if isinstance(value, list) and any(isinstance(x, dict) for x in value):
        return value, shape
    return [], ""


def _text(value) -> str | None:
    if value is None or isinstance(value, str):
        return value
    return json.dumps(value, ensure_ascii=False)


def walk(document, attributes: bool = True) -> list[dict]:
    """All nested records of a document, parents first, with paths of 0-based positions.

    Keys compare without case and outer blanks; of several the first that is
    not null counts.  route holds the lists' keys from the top down.  Without
    ``attributes`` the records' values aren't copied.
    """
    out: list[dict] = []
    stack = [(document, "", "")] if isinstance(document, dict) else []
    while stack:
        owner, route, path = stack.pop()
        by_key: dict = {}
        for k, v in owner.items():
            if by_key.get(low := k.strip().lower()) is None:
                by_key[low] = v
        for name, value in by_key.items():
            if not isinstance(value, (list, dict, str)):
                continue
            records, shape = _records(value)
            if not records:
                continue
            # dots and arrows stand between the keys of a route
            name = name.replace(".", "%2e").replace(">", "%3e")
            inner = f"{route}.{name}" if route else name
            for n, item in enumerate(records):
                if isinstance(item, dict):
                    own = f"{path}.{n}" if path else str(n)
                    out.append({"route": inner, "shape": shape, "path": own, "attributes": {k.strip().lower(): _text(v) for k, v in item.items()} if attributes else None})
                    stack.append((item, inner, own))
    return out


def nesting(nodes: DataFrame, known: tuple[tuple[str, str], ...] = ()) -> list[tuple[str, str]]:
    """The merged schema of the nesting: (owner's list, list) of every list that some record delivers as an array, and the known ones."""
    steps = nodes.filter("shape = 'array'").select(F.when(F.size(F.split("route", r"\.")) > 1, F.element_at(F.split("route", r"\."), -2)).otherwise("").alias("owner"), F.substring_index("route", ".", -1).alias("list")).distinct()
    found = sorted((r["owner"], r["list"]) for r in steps.limit(MOST_LISTS + 1).collect())
    if len(found) > MOST_LISTS:
        raise ValueError(f"more than {MOST_LISTS} lists")
    return [*known, *(x for x in found if x not in known)]


def json_nodes(df: DataFrame, key: str, json_col: str, known: tuple[tuple[str, str], ...] = (), only_known: bool = False, attributes: bool = True) -> DataFrame:
    """One row per nested record of the documents in ``json_col``, under the lists of their merged schema.

    ``df`` must have one row per ``key``.  Result: key, kind (of a list without
    a kind its key), route, path (unique within a record and route),
    parent_path (route:path of the parent, null at the top), ordinal,
    attributes (without the lists; null where they aren't asked for).  With
    ``only_known`` lists not known beforehand stay values.  A null, empty or invalid text gives none.
    """

    def nodes(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            yield pd.Series([walk(parse_json(t), attributes) for t in batch], dtype=object)

    nodes.__annotations__ = {"texts": Iterator[pd.Series], "return": Iterator[pd.Series]}
    udf = F.pandas_udf(nodes, NODES)
    spread = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # reading costs by the record, not by the byte that partitions are merged by
    every = settle(df.select(key, json_col).filter(F.col(json_col).isNotNull()).repartition(spread).select(key, F.explode(udf(F.col(json_col))).alias("n")).select(key, "n.*"))
    lists = list(known) if only_known else nesting(every, known)
    steps = F.array(*[F.lit(f"{a}>{b}") for a, b in lists]) if lists else F.array().cast("array<string>")
    parts = F.split("route", r"\.")
    own = F.transform(parts, lambda x, i: F.concat(F.when(i > 0, F.element_at(parts, i)).otherwise(F.lit("")), F.lit(">"), x))
    taken = every.filter(F.size(F.array_except(own, steps)) == 0)
    last = F.substring_index("route", ".", -1)
    within = F.transform(F.filter(steps, lambda s: F.substring_index(s, ">", 1) == last), lambda s: F.substring_index(s, ">", -1))
    kinds = F.create_map(*[F.lit(x) for pair in KINDS.items() for x in pair])
    above = lambda c: F.array_join(F.slice(F.split(c, r"\."), 1, F.size(F.split(c, r"\.")) - 1), ".")
    up = F.when(F.instr("path", ".") > 0, F.concat_ws(":", above("route"), above("path")))
    return taken.select(key, F.coalesce(F.element_at(kinds, last), last).alias("kind"), "route", "path", up.alias("parent_path"), F.substring_index("path", ".", -1).cast("int").alias("ordinal"), F.map_filter("attributes", lambda k, _: ~F.array_contains(within, k)).alias("attributes"))


def component_nodes(df: DataFrame, key: str, list_col: str) -> DataFrame:
    """Rows of the typed components column and of the items nested in each, as ``json_nodes`` gives them."""
    level = df.select(key, F.posexplode(list_col).alias("ordinal", "c")).filter("c is not null")
    parts = level.select(key, F.lit("component").alias("kind"), F.lit("components").alias("route"), F.col("ordinal").cast("string").alias("path"), F.lit(None).cast("string").alias("parent_path"), "ordinal", F.create_map(F.lit("comp_name"), F.col("c.comp_name")).alias("attributes"))
    inner = level.select(key, F.col("ordinal").alias("outer"), F.posexplode("c.properties").alias("ordinal", "i")).filter("i is not null")
    items = inner.select(key, F.lit("item").alias("kind"), F.lit("components.properties").alias("route"), F.concat_ws(".", "outer", "ordinal").alias("path"), F.concat(F.lit("components:"), F.col("outer").cast("string")).alias("parent_path"), "ordinal", F.create_map(F.lit("prop_key"), F.col("i.prop_key"), F.lit("prop_value"), F.col("i.prop_value")).alias("attributes"))
    return parts.unionByName(items)


def form_nodes(exports: DataFrame, only_known: bool = False, attributes: bool = True) -> DataFrame:
    """Every nested object of the form exports, repeated deliveries of an export counted once.

    Result: export_id, kind (section, control, property, component, item and,
    but with ``only_known``, any other list of the merged schema), route, path,
    parent_path, ordinal, attributes, node_key and parent_key (surrogate
    keys over all tables).  Without ``attributes`` those of the JSON part are
    null and not copied.
    """
    once = one_per_key(exports.select("export_id", "loaded_at", "content_json", "components").filter("export_id is not null"), ["export_id"], ["loaded_at", "content_json", "components"], "loaded_at")
    nodes = json_nodes(once, "export_id", "content_json", FORM_LISTS, only_known, attributes).unionByName(component_nodes(once, "export_id", "components"))
    key = F.concat_ws(":", F.col("export_id").cast("string"), "route", "path")
    up = F.when(F.col("parent_path").isNotNull(), F.concat_ws(":", F.col("export_id").cast("string"), "parent_path"))
    return nodes.withColumn("node_key", key).withColumn("parent_key", up)


def merged_schema(nodes: DataFrame) -> DataFrame:
    """kind, attribute, n_rows and the narrowest type that holds every value (bigint, double, boolean, string)."""
    pairs = nodes.select("kind", F.explode("attributes").alias("attribute", "value"))
    v = strip(F.col("value"))
    shape = F.when(v.isNull(), 0).when(v.rlike(r"^-?\d{1,18}$"), 1).when(v.rlike(r"^-?\d+(\.\d+)?([eE][-+]?\d+)?$"), 2).when(F.lower(v).isin("true", "false"), 8).otherwise(4)
    seen = pairs.groupBy("kind", "attribute").agg(F.count("*").alias("n_rows"), F.bit_or(shape).alias("shapes"))
    kind = F.when(F.col("shapes") == 0, "string").when(F.col("shapes") == 1, "bigint").when(F.col("shapes") < 4, "double").when(F.col("shapes") == 8, "boolean").otherwise("string")
    return seen.select("kind", "attribute", "n_rows", kind.alias("type"))


def flat_table(nodes: DataFrame, kind: str, columns: list[tuple[str, str]] | None = None) -> DataFrame:
    """The typed flat table of one kind: export_id, node_key, parent_key, path, ordinal and the merged columns.

    ``columns`` are (attribute, type) pairs; by default they are those of the
    merged schema, all of them; more than MOST_COLUMNS are refused.  All
    attributes also stay in the map ``attributes``.
    """
    own = nodes.filter(F.col("kind") == kind)
    if columns is None:
        columns = [(r["attribute"], r["type"]) for r in merged_schema(own).orderBy("attribute").limit(MOST_COLUMNS + 1).collect()]
        if len(columns) > MOST_COLUMNS:
            raise ValueError(f"more than {MOST_COLUMNS} attributes of kind {kind}")
    fixed = ["export_id", "node_key", "parent_key", "path", "ordinal", "attributes"]
    cells = [F.element_at("attributes", F.lit(a)).try_cast(t).alias(a if a not in fixed else f"{a}_value") for a, t in columns]
    return own.select(*fixed, *cells)
