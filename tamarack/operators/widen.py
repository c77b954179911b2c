"""Attribute-value rows into wide tables by positional stitching.

Cells are range partitioned by entity once.  Each task meets its entities in
order, numbers them, and writes every value into its attribute's typed column
at the entity's place; a block of consecutive places is assembled from its
columns by position, without a join per attribute.  Global ordinals are the
places plus the numbers of entities in the ranges before.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator
from decimal import Decimal

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from tamarack.functions.names import strip
from tamarack.workspace import settle

#: Attributes of forms and controls by the type of their values.
ATTRIBUTES = {
    "integer": ("width", "height", "left", "top", "tabindex", "fontsize", "columncount", "listrows", "borderwidth"),
    "boolean": ("visible", "locked", "canshrink", "underline"),
    "colour": ("backcolor", "forecolor", "bordercolor"),
    "number": ("linespacing", "scalefactor"),
    "date": ("datecreated", "lastupdated"),
    "text": ("caption", "fontname", "tag", "statusbartext"),
}
SPARK_TYPES = {"integer": "bigint", "boolean": "boolean", "colour": "string", "number": "decimal(18,2)", "date": "date", "text": "string"}
KNOWN = {n: kind for kind, names in ATTRIBUTES.items() for n in names}
#: Entities to a block, and the most columns of a wide table.
BLOCK = 8192
MOST_COLUMNS = 2000


def attribute_key(c: Column) -> Column:
    """Attribute name in lower case without blanks and underscores."""
    return F.regexp_replace(F.lower(c), r"[\s_ \u3000]+", "")


def _hex(v: Column) -> Column:
    digits = F.regexp_extract(v, r"^&[hH]([0-9a-fA-F]{1,15})&?$", 1)
    return F.when(digits != "", F.conv(digits, 16, 10).cast("bigint"))


def readable(kind: Column, value: Column) -> Column:
    """Written form of a value of the given kind; null where it doesn't read as one."""
    v = strip(value)
    plain = F.when(v.rlike(r"^[-+]?(\d{1,18}|\d{1,3}(,\d{3}){1,5})(\.0*)?$"), F.regexp_replace(F.regexp_replace(v, r"\.0*$", ""), r"[,+]", "").cast("bigint"))
    integer = F.coalesce(plain, _hex(v)).cast("string")
    low = F.lower(v)
    boolean = F.when(low.isin("-1", "1", "true", "yes", "on"), "true").when(low.isin("0", "false", "no", "off"), "false")
    number = F.coalesce(F.when(v.rlike(r"^\d{1,18}(\.0*)?$"), F.regexp_replace(v, r"\.0*$", "").cast("bigint")), _hex(v))
    bgr = F.format_string("#%02x%02x%02x", number.bitwiseAND(255), F.shiftright(number, 8).bitwiseAND(255), F.shiftright(number, 16).bitwiseAND(255))
    colour = F.when(v.rlike(r"^#[0-9a-fA-F]{6}$"), low).when(number.between(0, 0xFFFFFF), bgr)
    decimal = F.when(v.rlike(r"^[-+]?(\d{1,15}([.,]\d*)?|[.,]\d+)$"), F.regexp_replace(v, ",", ".").try_cast("decimal(38,18)").cast("decimal(18,2)").cast("string"))
    shaped = F.when(v.rlike(r"^\d{8}$"), F.concat_ws("-", v.substr(1, 4), v.substr(5, 2), v.substr(7, 2)))
    shaped = F.coalesce(shaped, F.when(v.rlike(r"^\d{4}[-/]\d{1,2}[-/]\d{1,2}([ T].*)?$"), F.regexp_replace(F.regexp_extract(v, r"^(\d{4}[-/]\d{1,2}[-/]\d{1,2})", 1), "/", "-")))
    shaped = F.coalesce(shaped, F.when(v.rlike(r"^\d{1,2}\.\d{1,2}\.\d{4}([ T].*)?$"), F.regexp_replace(v, r"^(\d{1,2})\.(\d{1,2})\.(\d{4}).*$", "$3-$2-$1")))
    date = F.date_format(shaped.try_cast("date"), "yyyy-MM-dd")
    text = F.when(v != "", v)
    return F.when(kind == "integer", integer).when(kind == "boolean", boolean).when(kind == "colour", colour).when(kind == "number", decimal).when(kind == "date", date).when(kind == "text", text)


def attribute_kinds(rows: DataFrame, name: str, value: str, known: dict[str, str] | None = None) -> dict[str, str]:
    """attribute -> kind of every attribute there is: ``known`` ones as given, others the narrowest kind that reads all their values.

    More attributes than a table may have columns (MOST_COLUMNS) are refused.
    """
    known = KNOWN if known is None else known
    attr = attribute_key(F.col(name))
    v = F.when(strip(F.col(value)) != "", F.col(value))
    tried = ("integer", "number", "boolean", "date")
    other = rows.select(attr.alias("attr_name"), v.alias("v")).filter("attr_name <> ''").filter(~F.col("attr_name").isin(*known))
    fits = other.groupBy("attr_name").agg(F.count("v").alias("n"), *[F.count(readable(F.lit(k), F.col("v"))).alias(k) for k in tried]).limit(MOST_COLUMNS + 1).collect()
    if len(known) + len(fits) > MOST_COLUMNS:
        raise ValueError(f"more than {MOST_COLUMNS} attributes")
    return {**known, **{r["attr_name"]: next((k for k in tried if 0 < r["n"] == r[k]), "text") for r in sorted(fits, key=lambda r: r["attr_name"])}}


def winners(rows: DataFrame, entity: list[str], name: str, value: str, order: list[str], kinds: dict[str, str] | None = None) -> DataFrame:
    """entity, attr_name, cell_value: the readable value recorded last for each entity and attribute.

    Ties on the order columns go to the larger value text.  Values are
    combined before the shuffle, so an entity with a third of all rows costs
    one row per task.
    """
    table = F.create_map(*[F.lit(x) for pair in (KNOWN if kinds is None else kinds).items() for x in pair])
    attr = attribute_key(F.col(name))
    read = rows.dropna(subset=entity).select(*entity, attr.alias("attr_name"), *order, readable(F.element_at(table, attr), F.col(value)).alias("cell_value"))
    # unreadable values are left to the aggregate, which skips nulls: as a filter they would be read twice
    best = read.groupBy(*entity, "attr_name").agg(F.max(F.when(F.col("cell_value").isNotNull(), F.struct(*order, "cell_value"))).alias("best"))
    return best.filter("best is not null").select(*entity, "attr_name", F.col("best.cell_value").alias("cell_value"))


#: How a written value becomes one of a column's type.
_TYPED = {"bigint": int, "int": int, "double": float, "boolean": "true".__eq__, "date": dt.date.fromisoformat, "string": str}


def stitch(cells: DataFrame, entity: list[str], columns: dict[str, str]) -> DataFrame:
    """One row per entity with its ordinal and a typed column per attribute.

    ``cells`` holds entity, attr_name and cell_value (in written form), one row
    per entity and attribute; ``columns`` maps attributes to Spark types
    (bigint, int, double, boolean, date, string or decimal).  Cells of other
    attributes are left out, entities without any cell don't appear.  Ordinals
    are dense, from 0 in key order.  A block has at most BLOCK entities,
    whatever the skew.
    """
    spark = cells.sparkSession
    names = list(columns)
    typed = [_TYPED.get(t, Decimal) for t in columns.values()]
    cells = settle(cells.filter(F.col("attr_name").isin(names)).select(*entity, "attr_name", "cell_value"))
    keys = [(f.name, to_arrow_type(f.dataType)) for f in (cells.schema[e] for e in entity)]
    out = f"{', '.join(f'`{e}` {cells.schema[e].dataType.simpleString()}' for e in entity)}, __part int, __place long, {', '.join(f'`{n}` {t}' for n, t in columns.items())}"
    arrow = [to_arrow_type(f.dataType) for f in spark.createDataFrame([], ", ".join(f"`{n}` {t}" for n, t in columns.items())).schema.fields] if columns else []
    size = BLOCK

    def assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = {n: k for k, n in enumerate(names)}
        part = TaskContext.get().partitionId()
        owners: list[tuple] = []
        grid: list[list] = [[None] * size for _ in names]
        base, last = 0, None

        def block() -> pa.RecordBatch:
            n = len(owners)
            arrays = [pa.array([o[k] for o in owners], t) for k, (_, t) in enumerate(keys)]
            arrays += [pa.array([part] * n, pa.int32()), pa.array(range(base, base + n), pa.int64())]
            arrays += [pa.array(col[:n], t) for col, t in zip(grid, arrow)]
            return pa.RecordBatch.from_arrays(arrays, names=[*entity, "__part", "__place", *names])

        for batch in batches:
            columns_of = [c.to_pylist() for c in batch.columns]
            for *owner, name, value in zip(*columns_of):
                owner = tuple(owner)
                if owner != last:
                    if len(owners) == size:
                        yield block()
                        base, owners = base + size, []
                        grid = [[None] * size for _ in names]
                    owners.append(owner)
                    last = owner
                k = at[name]
                grid[k][len(owners) - 1] = typed[k](value)
        if owners:
            yield block()

    assemble.__annotations__ = {"batches": Iterator[pa.RecordBatch], "return": Iterator[pa.RecordBatch]}
    blocks = settle(cells.repartitionByRange(*entity).sortWithinPartitions(*entity).mapInArrow(assemble, out))
    # one number per part
    sizes = {r["__part"]: r["n"] for r in blocks.groupBy("__part").agg(F.count("*").alias("n")).collect()}
    offsets, total = [], 0
    for p in sorted(sizes):
        offsets.append((p, total))
        total += sizes[p]
    before = F.broadcast(spark.createDataFrame(offsets, "__part int, __offset long"))
    return blocks.join(before, "__part").select(*entity, (F.col("__offset") + F.col("__place")).alias("ordinal"), *[F.col(f"`{n}`") for n in names])


def form_attributes(rows: DataFrame) -> DataFrame:
    """One row per form or control with typed columns of its properties and items.

    Attributes whose type is fixed come first; others there are follow by name,
    with the narrowest type that reads all their values.
    """
    kinds = attribute_kinds(rows, "prop_name", "prop_value")
    cells = winners(rows, ["owner_kind", "owner_id"], "prop_name", "prop_value", ["recorded_at", "prop_row_id"], kinds)
    return stitch(cells, ["owner_kind", "owner_id"], {n: SPARK_TYPES[k] for n, k in kinds.items()}).drop("ordinal")


def cells_of(wide: DataFrame, entity: list[str]) -> DataFrame:
    """The non-null cells of a wide table in written form: entity, attr_name, cell_value."""
    values = [c for c in wide.columns if c not in entity]
    cells = F.array(*[F.struct(F.lit(c).alias("attr_name"), F.col(c).cast("string").alias("cell_value")) for c in values])
    return wide.select(*entity, F.explode(cells).alias("c")).select(*entity, "c.attr_name", "c.cell_value").filter("cell_value is not null")
