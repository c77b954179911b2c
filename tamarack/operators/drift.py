"""Schemas that drift between files, matched by similarity flooding.

Two consecutive files form two graphs: tables with a name, columns with a name
and a type, nested in their table and tied to their left and right neighbours.
Pairs of tables and pairs of columns carry a match score that starts from name
and type likeness and flows between the pairs of neighbours and between a pair
of tables and the pairs of their columns until it has converged; the best
consistent pairs are the correspondences.  A table that lost and got columns
is flooded as a whole in one place: Access allows 255 columns.  Unchanged
tables are never collected.
"""

from __future__ import annotations

import heapq
from bisect import bisect_left
from collections.abc import Callable, Iterator
from functools import lru_cache, reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tamarack.functions.names import name_key, strip
from tamarack.workspace import settle

#: Access column type codes and the spellings of their names.
TYPE_CODES = {
    1: ("bool", "yes/no", "boolean", "bit"),
    2: ("byte",),
    3: ("int", "integer", "short"),
    4: ("longint", "long integer", "long"),
    5: ("money", "currency"),
    6: ("float", "single"),
    7: ("double",),
    8: ("datetime", "date/time", "date"),
    9: ("binary",),
    10: ("text", "short text"),
    11: ("ole", "ole object"),
    12: ("memo", "long text"),
    15: ("repid", "guid", "replication id"),
    16: ("numeric", "decimal"),
    18: ("complex",),
}
#: The widest of several types of one column: each type's place in the order, and its Spark type.
LATTICE = {1: "boolean", 2: "smallint", 3: "smallint", 4: "int", 5: "decimal(19,4)", 16: "decimal(28,6)", 6: "double", 7: "double", 8: "timestamp_ntz", 10: "string", 12: "string", 15: "string", 9: "binary", 11: "binary", 18: "int"}

#: Share of a pair's score that flows in from its neighbours and its table, the rest stays its own.
FLOW = 0.6
#: Share of the name in a pair's own score, the rest is its type.
NAME = 0.6
#: Scores are carried on until no pair moves by more than this.
EPSILON = 1e-4
#: Pairs that a step of the flooding takes at once; their number doesn't change the scores.
BLOCK = 1 << 20


def type_code(code: Column, name: Column) -> Column:
    """The Access type code: ``code`` where present, else by the spelling of the name, else null."""
    table = F.create_map(*[F.lit(x) for c, names in TYPE_CODES.items() for n in names for x in (n, c)])
    return F.coalesce(code.cast("int"), F.element_at(table, F.regexp_replace(F.lower(strip(name)), r"\s+", " ")))


def _text_key(c: Column) -> Column:
    return F.lower(strip(c))


def _columns(schemas: DataFrame) -> DataFrame:
    """One row per file, table and column, with the file before it in the series, and the neighbours' names."""
    files = schemas.filter("db_name is not null and file_no is not null").groupBy("db_name", "file_no").agg(F.min(_text_key(F.col("file_name"))).alias("file_name"))
    series = files.select("*", F.lead("file_no").over(Window.partitionBy("db_name").orderBy("file_no")).alias("next_no"), F.lag("file_no").over(Window.partitionBy("db_name").orderBy("file_no")).alias("prev_no"))
    cols = schemas.select("db_name", "file_no", name_key(F.col("table_name")).alias("table_name"), name_key(F.col("col_name")).alias("col_name"), type_code(F.col("col_type"), F.col("type_name")).alias("code"), F.col("col_type").isNotNull().alias("sure"), _text_key(F.col("type_name")).alias("spelling"), "col_pos", "loaded_at").filter("table_name is not null and col_name is not null")
    once = cols.groupBy("db_name", "file_no", "table_name", "col_name").agg(F.max(F.struct("loaded_at", "sure", "code", "spelling", (-F.col("col_pos")).alias("back"))).alias("r"))
    typed = once.select("db_name", "file_no", "table_name", "col_name", F.coalesce(F.col("r.code").cast("string"), F.col("r.spelling"), F.lit("")).alias("kind"), (-F.col("r.back")).alias("col_pos"))
    line = Window.partitionBy("db_name", "file_no", "table_name").orderBy("col_pos", "col_name")
    return typed.select("*", F.coalesce(F.lag("col_name").over(line), F.lit("^")).alias("left_name"), F.coalesce(F.lead("col_name").over(line), F.lit("$")).alias("right_name"), F.row_number().over(line).alias("rank")).join(series, ["db_name", "file_no"])


@lru_cache(1 << 16)
def _grams(name: str) -> frozenset[str]:
    padded = f"^{name}$"
    return frozenset(padded[k : k + 2] for k in range(len(padded) - 1))


def likeness(a: str, b: str) -> float:
    """Likeness of two names, 0 to 1: the pairs of letters they share."""
    if a == b:
        return 1.0
    x, y = _grams(a), _grams(b)
    return 2 * len(x & y) / (len(x) + len(y))


class Names:
    """Names by the pairs of letters they hold, for the likeness of another name to all of them at once."""

    def __init__(self, names: list[str]):
        self.names = names
        places: dict[str, list[int]] = {}
        for j, name in enumerate(names):
            for gram in _grams(name):
                places.setdefault(gram, []).append(j)
        self.common = frozenset(g for g, js in places.items() if len(js) == len(names))
        self.places = {g: np.array(js, dtype=np.intp) for g, js in places.items() if g not in self.common}
        sizes, self.size = np.unique([len(_grams(n)) for n in names], return_inverse=True)
        self.n_sizes = len(sizes)

    def likeness(self, name: str) -> np.ndarray:
        grams = _grams(name)
        shared = np.full(len(self.names), len(grams & self.common), dtype=np.intp)
        for gram in grams - self.common:
            if gram in self.places:
                shared[self.places[gram]] += 1
        # names with as many pairs, of which as many are shared, are equally like: one of each kind is compared
        kind = shared * self.n_sizes + self.size
        one = np.full((len(grams) + 1) * self.n_sizes, -1, dtype=np.intp)
        one[kind] = np.arange(len(self.names))
        like = np.zeros(len(one))
        for k in np.flatnonzero(one >= 0):
            like[k] = likeness(name, self.names[one[k]])
        return like[kind]


def consistent(n_old: int, n_new: int, scores: Callable[[int], np.ndarray]) -> list[tuple[float, int, int]]:
    """The best (score, old place, new place) of all pairs, each place once; ties to the first by place.

    ``scores`` gives an old place's scores with every new one.  An old place
    waits under its best score with the new places that were free when it was
    last looked at; where the first in line still has that score, no pair of
    free places is better.  So no list of all pairs is kept or sorted.
    """
    free, out = np.ones(n_new, dtype=bool), []
    waiting = [(-np.inf, i) for i in range(n_old)]
    while waiting and len(out) < n_new:
        bound, i = waiting[0]
        left = np.where(free, scores(i), -np.inf)
        j = int(left.argmax())
        score = float(left[j])
        if -score == bound:
            heapq.heappop(waiting)
            free[j] = False
            out.append((score, i, j))
        else:
            heapq.heapreplace(waiting, (-score, i))
    return out


def flood_tables(gone: list[str], came: list[str]) -> list[tuple[str, str, float]]:
    """Pairs of a gone and a come table of one layout, with their score; as many as the fewer of them.

    All their columns match, so what flows in from them is whole and the
    name decides, however many they are.
    """
    gone, came = sorted(gone), sorted(came)
    names = Names(came)
    return [(gone[i], came[j], score) for score, i, j in consistent(len(gone), len(came), lambda i: (1 - FLOW) * names.likeness(gone[i]) + FLOW)]


def flood_columns(columns: list[dict]) -> list[dict]:
    """Correspondences of a table's columns in two files: old_col_name, new_col_name, score.

    ``columns`` are the names of both files with what is known of each (kind,
    left_name, right_name, rank) in the older and the newer one, or None.  A
    kept name corresponds to itself; of the other pairs, each of a gone and a
    come name, the best are taken.  Pairs flow to the pairs of the columns
    left and right of them, and to the pair of their tables and back.
    """
    old = sorted((c for c in columns if c["old"]), key=lambda c: c["old"]["rank"])
    new = sorted((c for c in columns if c["new"]), key=lambda c: c["new"]["rank"])
    at_new = {c["col_name"]: j for j, c in enumerate(new)}
    gone = [i for i, c in enumerate(old) if not c["new"]]
    came = [j for j, c in enumerate(new) if not c["old"]]
    kept = [(i, at_new[c["col_name"]]) for i, c in enumerate(old) if c["new"]]
    as_kept, as_gone, as_came = {p: k for k, p in enumerate(kept)}, {i: g for g, i in enumerate(gone)}, {j: c for c, j in enumerate(came)}

    # scores in one line: two fixed ones, of what is no pair and of two tables' edges, which meet as a pair of like
    # neighbours does; the kept pairs; a row for each gone column with a place for each come one
    apart, edge, first = 0, 1, 2 + len(kept)
    rows = np.arange(first, first + len(gone) * len(came), dtype=np.int32).reshape(len(gone), len(came))
    score = np.ones(first + rows.size)
    score[apart] = 0.0
    score[2:first] = [NAME * likeness(old[i]["col_name"], new[j]["col_name"]) + (1 - NAME) * (old[i]["old"]["kind"] == new[j]["new"]["kind"]) for i, j in kept]
    names, kinds = Names([new[j]["col_name"] for j in came]), np.array([new[j]["new"]["kind"] for j in came], dtype=object)
    pairs = score[first:].reshape(rows.shape)
    for g, i in enumerate(gone):
        pairs[g] = NAME * names.likeness(old[i]["col_name"]) + (1 - NAME) * (kinds == old[i]["old"]["kind"])
    own = (1 - FLOW) * score[2:]

    def place(i: int, j: int) -> int:
        if i < 0 or i >= len(old) or j < 0 or j >= len(new):
            return edge if (i < 0 and j < 0) or (i >= len(old) and j >= len(new)) else apart
        if i in as_gone and j in as_came:
            return int(rows[as_gone[i], as_came[j]])
        return 2 + as_kept[i, j] if (i, j) in as_kept else apart

    def beside(step: int) -> np.ndarray:
        """Where the score of the pair before or behind each pair stands."""
        grid = np.full(rows.shape, apart, dtype=np.int32)
        run = (np.diff(gone) == 1)[:, None] & (np.diff(came) == 1)
        if step < 0:
            grid[1:, 1:] = np.where(run, rows[:-1, :-1], apart)
        else:
            grid[:-1, :-1] = np.where(run, rows[1:, 1:], apart)
        for i, j in [*kept, (-1, -1), (len(old), len(new))]:
            if i - step in as_gone and j - step in as_came:
                grid[as_gone[i - step], as_came[j - step]] = place(i, j)
        return np.concatenate([np.array([place(i + step, j + step) for i, j in kept], dtype=np.int32), grid.ravel()])

    left, right, table, moved = beside(-1), beside(1), 1.0, 1.0
    now, after = score[2:], np.empty(len(own))
    blocks = [tuple(x[start : start + BLOCK] for x in (own, left, right, now, after)) for start in range(0, len(own), BLOCK)]
    while moved > EPSILON:
        moved = 0.0
        for own_part, before, behind, was, becomes in blocks:
            np.add(own_part, FLOW * (2 * score[before] + 2 * score[behind] + table) / 5, out=becomes)
            moved = max(moved, np.abs(becomes - was).max())
        now[:] = after
        best = score[2:first].tolist() + (pairs.max(axis=1).tolist() if came else [])
        table = (1 - FLOW) + FLOW * sum(best) / max(len(old), len(new), 1)
    chosen = [(v, gone[g], came[c]) for v, g, c in consistent(len(gone), len(came), lambda g: pairs[g])]
    return [{"old_col_name": old[i]["col_name"], "new_col_name": new[j]["col_name"], "score": float(v)} for v, i, j in [*((score[2 + k], *p) for k, p in enumerate(kept)), *chosen]]


def _tables_udf():
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for gone, came in batches:
            yield pd.Series([[{"old_table": a, "table_name": b, "score": s} for a, b, s in flood_tables(list(x), list(y))] for x, y in zip(gone, came)], dtype=object)

    run.__annotations__ = {"batches": Iterator[tuple[pd.Series, pd.Series]], "return": Iterator[pd.Series]}
    return F.pandas_udf(run, "array<struct<old_table string, table_name string, score double>>")


def _columns_udf():
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for tables in batches:
            yield pd.Series([flood_columns(list(t)) for t in tables], dtype=object)

    run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return F.pandas_udf(run, "array<struct<old_col_name string, new_col_name string, score double>>")


def _table_changes(columns: DataFrame) -> DataFrame:
    """db_name, file_no (the later), table_name, change_kind, old_table and score of tables; null change for a table in both files."""
    tables = columns.groupBy("db_name", "file_no", "next_no", "prev_no", "table_name").agg(F.sha2(F.to_json(F.sort_array(F.collect_list(F.struct("rank", "col_name", "kind")))), 256).alias("layout"))
    old = tables.filter("next_no is not null").select("db_name", F.col("next_no").alias("file_no"), "table_name", F.col("layout").alias("old_layout"), F.lit(None).cast("string").alias("new_layout"))
    new = tables.filter("prev_no is not null").select("db_name", "file_no", "table_name", F.lit(None).cast("string").alias("old_layout"), F.col("layout").alias("new_layout"))
    both = settle(old.unionByName(new).groupBy(*KEY).agg(F.max("old_layout").alias("old_layout"), F.max("new_layout").alias("new_layout")))
    single = both.filter("old_layout is null or new_layout is null")
    groups = single.groupBy("db_name", "file_no", F.coalesce("old_layout", "new_layout").alias("layout")).agg(F.collect_list(F.when(F.col("new_layout").isNull(), F.col("table_name"))).alias("gone"), F.collect_list(F.when(F.col("old_layout").isNull(), F.col("table_name"))).alias("came"))
    paired = groups.withColumn("pairs", F.when((F.size("gone") > 0) & (F.size("came") > 0), _tables_udf()(F.col("gone"), F.col("came"))).otherwise(F.array()))
    none = F.lit(None).cast("string")
    rows = F.concat(
        F.transform("pairs", lambda p: F.struct(p["table_name"].alias("table_name"), F.lit("table_renamed").alias("change_kind"), p["old_table"].alias("old_table"), p["score"].alias("score"))),
        F.transform(F.array_except("gone", F.col("pairs.old_table")), lambda t: F.struct(t.alias("table_name"), F.lit("table_removed").alias("change_kind"), none.alias("old_table"), F.lit(None).cast("double").alias("score"))),
        F.transform(F.array_except("came", F.col("pairs.table_name")), lambda t: F.struct(t.alias("table_name"), F.lit("table_added").alias("change_kind"), none.alias("old_table"), F.lit(None).cast("double").alias("score"))),
    )
    changed = paired.select("db_name", "file_no", F.explode(rows).alias("r")).select("db_name", "file_no", "r.*")
    kept = both.filter("old_layout is not null and new_layout is not null").select(*KEY, none.alias("change_kind"), F.col("table_name").alias("old_table"), F.lit(None).cast("double").alias("score"))
    return changed.unionByName(kept)


KEY = ["db_name", "file_no", "table_name"]
SIDE = ["kind", "left_name", "right_name", "rank"]


def aligned(columns: DataFrame, kept: DataFrame) -> DataFrame:
    """One row per column name of the tables in both files, with what is known of it in the older and the newer file."""
    tables = kept.select(*KEY)
    side = F.struct(*SIDE)
    old = columns.filter("next_no is not null").select("db_name", F.col("next_no").alias("file_no"), "table_name", "col_name", side.alias("old"), F.lit(None).cast(side_type(columns)).alias("new"))
    new = columns.filter("prev_no is not null").select(*KEY, "col_name", F.lit(None).cast(side_type(columns)).alias("old"), side.alias("new"))
    return settle(old.unionByName(new).join(tables, KEY).groupBy(*KEY, "col_name").agg(F.max("old").alias("old"), F.max("new").alias("new")))


def side_type(columns: DataFrame) -> str:
    return columns.select(F.struct(*SIDE).alias("s")).schema["s"].dataType.simpleString()


def column_matches(names: DataFrame) -> DataFrame:
    """Correspondences of gone and come names, from ``aligned`` names: KEY, old_col_name, new_col_name, the sides' kinds and neighbours, score.

    Only tables that both lost and got names are collected, one row each.
    """
    touched = names.groupBy(*KEY).agg(F.max(F.col("new").isNull()).alias("lost"), F.max(F.col("old").isNull()).alias("got")).filter("lost and got").select(*KEY)
    whole = names.join(touched, KEY, "left_semi").groupBy(*KEY).agg(F.collect_list(F.struct("col_name", "old", "new")).alias("cols"))
    flooded = whole.withColumn("m", F.explode(F.filter(_columns_udf()(F.col("cols")), lambda m: m["old_col_name"] != m["new_col_name"])))
    side = lambda name, which: F.filter("cols", lambda c: c["col_name"] == F.col(f"m.{name}"))[0][which]
    matched = flooded.select(*KEY, "m.*", side("old_col_name", "old").alias("old"), side("new_col_name", "new").alias("new"))
    return matched.select(*KEY, "old_col_name", "new_col_name", "score", *[F.col(f"{w}.{c}").alias(f"{w}_{c}") for w in ("old", "new") for c in SIDE])


#: The rule a match of different names must meet to be a rename.
RENAME = "old_kind = new_kind and old_left_name = new_left_name and old_right_name = new_right_name"


def schema_changes(schemas: DataFrame) -> DataFrame:
    """Every change of each file over the one before it in its database.

    Result: file_name, table_name, col_name ('' for tables), change_kind
    (added, removed, renamed, type_changed, table_added, table_removed,
    table_renamed), old_name, old_type, new_type, score.  A rename needs a
    match of the flooding whose columns have one type and the same neighbours;
    matches short of that stay removed and added.  Which of several gone tables
    of one layout was renamed to a come one, the flooding tells.  Rows without database,
    file number, table or column name are ignored; repeated rows count once.
    """
    columns = settle(_columns(schemas))
    changes = settle(_table_changes(columns))
    names = aligned(columns, changes.filter("change_kind is null"))
    types = names.filter("old.kind <> new.kind").select(*KEY, "col_name", F.lit("type_changed").alias("change_kind"), F.col("col_name").alias("old_name"), F.col("old.kind").alias("old_type"), F.col("new.kind").alias("new_type"), F.lit(NAME).alias("score"))
    renames = settle(column_matches(names).filter(RENAME))
    renamed = renames.select(*KEY, F.col("new_col_name").alias("col_name"), F.lit("renamed").alias("change_kind"), F.col("old_col_name").alias("old_name"), F.col("old_kind").alias("old_type"), F.col("new_kind").alias("new_type"), "score")
    moved = renames.select(*KEY, F.col("old_col_name").alias("col_name")).union(renames.select(*KEY, "new_col_name"))
    single = names.filter("old is null or new is null").join(moved, [*KEY, "col_name"], "left_anti").select(*KEY, "col_name", F.when(F.col("old").isNull(), "added").otherwise("removed").alias("change_kind"), F.lit(None).cast("string").alias("old_name"), F.col("old.kind").alias("old_type"), F.col("new.kind").alias("new_type"), F.lit(None).cast("double").alias("score"))
    tables = changes.filter("change_kind is not null").select(*KEY, F.lit("").alias("col_name"), "change_kind", F.col("old_table").alias("old_name"), F.lit(None).cast("string").alias("old_type"), F.lit(None).cast("string").alias("new_type"), "score")
    files = columns.select("db_name", "file_no", "file_name").distinct()
    return reduce(DataFrame.unionByName, [types, renamed, single, tables]).join(files, ["db_name", "file_no"]).select("db_name", "file_no", "file_name", "table_name", "col_name", "change_kind", "old_name", "old_type", "new_type", "score")


#: Score from which ``consistent_layout`` follows a match that is no rename by the rule.
FOLLOW = 0.75


def consistent_columns(schemas: DataFrame, follow: float = FOLLOW) -> DataFrame:
    """Every delivered column with its place in the consistent layout: db_name, file_no, file_name, old_table, old_column, kind, table_name, col_name.

    Renames, and matches of one type that score at least ``follow``, are
    followed through the series with the hierarchy operator: a column of one
    file hangs from its successor in the next, so the root is the last.
    """
    from tamarack.operators.hierarchy import hierarchy

    columns = settle(_columns(schemas))
    changes = settle(_table_changes(columns))
    key = KEY
    names = aligned(columns, changes.filter("change_kind is null"))
    kept = names.filter("old is not null and new is not null").select(*key, F.col("col_name").alias("old_col_name"), F.col("col_name").alias("new_col_name"))
    matches = kept.unionByName(column_matches(names).filter(f"({RENAME}) or (old_kind = new_kind and score >= {float(follow)!r})").select(*key, "old_col_name", "new_col_name"))
    ident = lambda no, table, col: F.xxhash64("db_name", no, table, col)
    through = matches.select("db_name", "file_no", F.col("table_name").alias("old_table"), "table_name", "old_col_name", "new_col_name")
    carried = changes.filter("change_kind = 'table_renamed'").select(*key, "old_table")
    whole = columns.select(*key, F.col("col_name").alias("old_col_name"), F.col("col_name").alias("new_col_name")).join(carried, key).select("db_name", "file_no", "old_table", "table_name", "old_col_name", "new_col_name")
    steps = through.unionByName(whole).join(columns.select("db_name", F.col("file_no").alias("prev_file"), F.col("next_no").alias("file_no")).distinct(), ["db_name", "file_no"])
    up = steps.select(ident("prev_file", "old_table", "old_col_name").alias("id"), ident("file_no", "table_name", "new_col_name").alias("parent_id"))
    mine = settle(columns.select(*key, "col_name", "kind", "file_name", ident("file_no", "table_name", "col_name").alias("id")))
    tree = hierarchy(mine.select("id").join(up, "id", "left"), "id", "parent_id").select("id", "root_id")
    last = mine.select(F.col("id").alias("root_id"), F.col("table_name").alias("last_table"), F.col("col_name").alias("last_col"))
    return mine.join(tree, "id").join(last, "root_id").select("db_name", "file_no", "file_name", F.col("table_name").alias("old_table"), F.col("col_name").alias("old_column"), "kind", F.col("last_table").alias("table_name"), F.col("last_col").alias("col_name"), "root_id")


def consistent_layout(schemas: DataFrame, follow: float = FOLLOW) -> DataFrame:
    """One layout per database: every table and column under the name it has last, with a type that holds all its types.

    Columns are those of ``consistent_columns``.  Result: db_name, table_name,
    col_name, spark_type, access_types, first_file, last_file, n_files.
    """
    order = list(LATTICE)
    place = F.create_map(*[F.lit(x) for n, c in enumerate(order) for x in (str(c), n)])
    spark_type = F.create_map(*[F.lit(x) for n, c in enumerate(order) for x in (n, LATTICE[c])])
    rows = consistent_columns(schemas, follow).groupBy("db_name", "root_id", "table_name", "col_name").agg(F.max(F.coalesce(F.element_at(place, F.col("kind")), F.lit(order.index(10)))).alias("widest"), F.max(F.col("kind").isin("8", "9", "11")).alias("odd"), F.count_distinct("kind").alias("n_types"), F.array_sort(F.collect_set("kind")).alias("access_types"), F.min_by("file_name", "file_no").alias("first_file"), F.max_by("file_name", "file_no").alias("last_file"), F.count_distinct("file_no").alias("n_files"))
    chosen = F.when((F.col("n_types") > 1) & F.col("odd"), "string").otherwise(F.element_at(spark_type, F.col("widest")))
    return rows.select("db_name", "table_name", "col_name", chosen.alias("spark_type"), F.array_join("access_types", ",").alias("access_types"), "first_file", "last_file", "n_files")


def unite(tables: list[DataFrame], layout: list[tuple[str, str]], renames: dict[str, str] | None = None) -> DataFrame:
    """Cast and union the deliveries of one table: layout columns in order, missing ones null, values that don't cast null.

    ``renames`` maps old column names (lower case) to layout names.  Without
    tables the result can't be built and a ValueError is raised.
    """
    if not tables:
        raise ValueError("unite needs at least one table")
    renames = renames or {}
    shaped = []
    for df in tables:
        have = {}
        for c in df.columns:
            have.setdefault(renames.get(c.strip().lower(), c.strip().lower()), c)
        shaped.append(df.select(*[(F.col(f"`{have[n.lower()]}`").try_cast(t) if n.lower() in have else F.lit(None).cast(t)).alias(n) for n, t in layout]))
    return reduce(DataFrame.unionByName, shaped)
