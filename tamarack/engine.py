"""The query engine: tables, saved queries and Access SQL over a Spark session."""

from __future__ import annotations

import hashlib
import itertools
import threading
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field, fields, is_dataclass

from pyspark.sql import DataFrame, SparkSession

from tamarack.functions.values import Typed, as_text, kind_of, quote_name
from tamarack.plans.ast import Call, Name, Select, Star, Table
from tamarack.plans.compiler import Column, Compiler, normal, unique
from tamarack.plans.lexer import AccessSqlError
from tamarack.plans.parser import parse
from tamarack.sources.tables import listing
from tamarack.sources.tables import table as read_table

_serial = itertools.count(1)

#: Access type names by code.
TYPE_NAMES = {1: "BOOL", 2: "BYTE", 3: "INT", 4: "LONGINT", 5: "MONEY", 6: "FLOAT", 7: "DOUBLE", 8: "DATETIME", 9: "BINARY", 10: "TEXT", 11: "OLE", 12: "MEMO", 15: "REPID", 16: "NUMERIC", 18: "COMPLEX"}
#: Access type code of a Spark type.
TYPE_OF = {"boolean": 1, "tinyint": 2, "smallint": 3, "int": 4, "bigint": 4, "float": 6, "double": 7, "timestamp": 8, "timestamp_ntz": 8, "date": 8, "binary": 9, "string": 12}


@dataclass(frozen=True)
class ColumnSchema:
    name: str
    col_type: int
    type_name: str
    size: int = 0
    prec: int = 0
    scale: int = 0
    is_fixed: bool = True


@dataclass(frozen=True)
class TableSchema:
    table_name: str
    columns: tuple[ColumnSchema, ...]
    row_count: int | None = None


class Source:
    """A table that is read column by column: a statement reads those it names."""

    def columns(self) -> list[str]:
        raise NotImplementedError

    def read(self, columns: list[str] | None = None) -> DataFrame:
        """The table with these columns, or all."""
        raise NotImplementedError

    def count(self) -> int | None:
        """Its rows where it knows them without reading them."""
        return None


def names_of(node, views: Callable[[str], object] | None = None, seen: set[str] | None = None) -> set[str] | None:
    """The column names that a statement, and the saved queries in it, may read; None for all of them."""
    out: set[str] = set()
    seen = set() if seen is None else seen
    stack = [node]
    while stack:
        x = stack.pop()
        if isinstance(x, Star):
            return None
        if isinstance(x, Name):
            out.add(normal(x.parts[-1]))
        elif isinstance(x, Table):
            inner = views(x.name) if views and normal(x.name) not in seen else None
            if inner is not None:
                seen.add(normal(x.name))
                stack.append(inner)
        elif isinstance(x, Call):
            stack += [a for a in x.args if not isinstance(a, Star)]
        elif isinstance(x, (tuple, list)):
            stack += x
        elif is_dataclass(x):
            stack += [getattr(x, f.name) for f in fields(x)]
    return out


@dataclass
class TableData:
    columns: list[str]
    rows: list[list[str]]
    nulls: list[list[bool]] = field(default_factory=list)


class Engine:
    """Access SQL over named DataFrames and saved queries.

    ``tables`` maps names to DataFrames, Parquet paths, sources that read
    single columns (``Source``) or None; a name given None, or found nowhere, is looked for as ``<folder>/<name>.parquet``.
    Names don't depend on case.  With ``case_sensitive_text`` texts compare
    exactly, which lets Parquet filters see them.
    """

    def __init__(self, spark: SparkSession, folder: str | None = None, tables: dict[str, object] | None = None, views: dict[str, str] | None = None, case_sensitive_text: bool = False, max_concurrent: int = 8):
        self.spark = spark
        self.folder = folder.rstrip("/") if folder else None
        self.exact = case_sensitive_text
        self._sources: dict[str, tuple[str, object]] = {normal(n): (n, t) for n, t in (tables or {}).items()}
        self._frames: dict[str, DataFrame] = {}
        self._temp: dict[str, tuple[str, list[Column]]] = {}
        self._views: dict[str, tuple[str, str]] = {normal(n): (n, sql) for n, sql in (views or {}).items()}
        self._lock = threading.RLock()
        self.slots = threading.BoundedSemaphore(min(64, max(1, max_concurrent)))
        self._id = next(_serial)

    # ---- catalog

    def add_table(self, name: str, df: DataFrame) -> None:
        with self._lock:
            self._sources[normal(name)] = (name, df)
            self._frames.pop(normal(name), None)
            self._temp.pop(normal(name), None)

    def add_view(self, name: str, sql: str) -> None:
        """Register a saved query; its text is read when it is used."""
        self._views[normal(name)] = (name, sql)

    def tables(self) -> list[str]:
        names = {k: n for k, (n, _) in self._sources.items()}
        if self.folder:
            for name, *_ in listing(self.spark, self.folder):
                names.setdefault(name.lower(), name)
        return [names[k] for k in sorted(names)]

    def views(self) -> list[str]:
        return [self._views[k][0] for k in sorted(self._views)]

    def view_sql(self, name: str) -> str:
        if normal(name) not in self._views:
            raise AccessSqlError(f"{name} is not a saved query")
        return self._views[normal(name)][1]

    def frame(self, name: str) -> DataFrame | None:
        """The DataFrame of a table, or None."""
        key = normal(name)
        with self._lock:
            if key not in self._frames:
                source = self._sources.get(key, (name, None))[1]
                if isinstance(source, DataFrame):
                    self._frames[key] = source
                elif isinstance(source, Source):
                    self._frames[key] = source.read()
                elif isinstance(source, str):
                    self._frames[key] = self.spark.read.parquet(source)
                elif self.folder and (known := next((n for n in self.tables() if n.lower() == key), None)):
                    self._frames[key] = read_table(self.spark, self.folder, known)
                else:
                    return None
            return self._frames[key]

    def compiler(self, stmt: Select, params: dict[str, object] | None) -> Compiler:
        """A compiler of one statement, for which tables are read as far as it names their columns."""
        wanted = names_of(stmt, lambda n: parse(self._views[normal(n)][1]) if normal(n) in self._views and normal(n) not in self._sources else None)
        return Compiler(lambda name: self._resolve(name, wanted), params or {}, self.exact, lambda text, args: self.spark.sql(text, args=dict(args)).first()["n"])

    def _part(self, name: str, source: Source, wanted: set[str]):
        """A view of a source's columns that a statement names."""
        columns = [c for c in source.columns() if normal(c) in wanted] or source.columns()[:1]
        with self._lock:
            key = "\0".join([normal(name), *columns])
            if key not in self._temp:
                df = source.read(columns)
                known = unique([Column(f.name, kind_of(f.dataType), f.name) for f in df.schema.fields])
                view = f"tamarack_{self._id}_{len(self._temp)}_{hashlib.sha256(key.encode()).hexdigest()[:12]}"
                df.toDF(*[c.name for c in known]).createOrReplaceTempView(view)
                self._temp[key] = (quote_name(view), known)
            return self._temp[key]

    def _resolve(self, name: str, wanted: set[str] | None = None):
        key = normal(name)
        source = self._sources.get(key, (name, None))[1]
        if isinstance(source, Source) and wanted is not None and len({c.lower() for c in source.columns()}) == len(source.columns()):
            return self._part(name, source, wanted)
        df = self.frame(name)
        if df is not None:
            with self._lock:
                if key not in self._temp:
                    columns = unique([Column(f.name, kind_of(f.dataType), f.name) for f in df.schema.fields])
                    view = f"tamarack_{self._id}_{len(self._temp)}_{hashlib.sha256(key.encode()).hexdigest()[:12]}"
                    (df if [c.name for c in columns] == df.columns else df.toDF(*[c.name for c in columns])).createOrReplaceTempView(view)
                    self._temp[key] = (quote_name(view), columns)
                return self._temp[key]
        if key in self._views:
            return parse(self._views[key][1])
        return None

    def schema(self, name: str) -> TableSchema:
        df = self.frame(name)
        if df is None:
            raise AccessSqlError(f"{name} is not a table")
        out = []
        for f in df.schema.fields:
            meta = f.metadata or {}
            kind = f.dataType.simpleString()
            code = meta.get("access_type") or (5 if kind.startswith("decimal") and kind.endswith(",4)") else 16 if kind.startswith("decimal") else TYPE_OF.get(kind, 11))
            out.append(ColumnSchema(f.name, code, TYPE_NAMES.get(code, "UNKNOWN"), meta.get("size", 0), meta.get("prec", 0), meta.get("scale", 0), meta.get("is_fixed", code not in (9, 10, 11, 12))))
        return TableSchema(name, tuple(out), self._known_count(name))

    def _known_count(self, name: str) -> int | None:
        source = self._sources.get(normal(name), (name, None))[1]
        return source.count() if isinstance(source, Source) else None

    def schemas(self) -> dict[str, TableSchema]:
        return {n: self.schema(n) for n in self.tables()}

    def row_count(self, name: str) -> int:
        """Rows of a table; database files answer from the table's header, Parquet files from their footers."""
        if (known := self._known_count(name)) is not None:
            return known
        df = self.frame(name)
        if df is None:
            raise AccessSqlError(f"{name} is not a table")
        return df.count()

    def read_table(self, name: str) -> DataFrame:
        """All columns of a table in text form."""
        df = self.frame(name)
        if df is None:
            raise AccessSqlError(f"{name} is not a table")
        cells = []
        for f in df.schema.fields:
            kind = kind_of(f.dataType)
            cells.append(f"{as_text(Typed(quote_name(f.name), kind)) if kind != 'other' else f'TO_JSON({quote_name(f.name)})'} AS {quote_name(f.name)}")
        return df.selectExpr(*cells)

    def table_data(self, name: str) -> TableData:
        """A whole table as texts with a null map; for small tables, it is brought to the driver."""
        df = self.read_table(name)
        rows = df.collect()
        return TableData(df.columns, [[v if v is not None else "" for v in r] for r in rows], [[v is None for v in r] for r in rows])

    # ---- queries

    def compile(self, sql: str | Select, params: dict[str, object] | None = None) -> tuple[str, dict[str, object], list[Column]]:
        """Spark SQL text, its arguments and the result columns."""
        stmt = parse(sql) if isinstance(sql, str) else sql
        compiler = self.compiler(stmt, params)
        out = compiler.select(stmt, None)
        return out.sql, compiler.args, out.columns

    def query(self, sql: str | Select, params: dict[str, object] | None = None) -> DataFrame:
        """The lazy result of a SELECT statement."""
        text, args, _ = self.compile(sql, params)
        return self.spark.sql(text, args=args) if args else self.spark.sql(text)

    def query_view(self, name: str, params: dict[str, object] | None = None) -> DataFrame:
        """The result of a saved query."""
        key = normal(name)
        compiler_sql = self.view_sql(name)
        stmt = parse(compiler_sql)
        compiler = self.compiler(stmt, params)
        compiler.open_views.append(key)
        out = compiler.select(stmt, None)
        return self.spark.sql(out.sql, args=compiler.args) if compiler.args else self.spark.sql(out.sql)

    @contextmanager
    def running(self, tag: str | None = None):
        """A slot of the engine's bounded concurrency; jobs started within carry ``tag``, by which ``interrupt`` stops them."""
        with self.slots:
            if tag:
                self.spark.addTag(tag)
            try:
                yield self
            finally:
                if tag:
                    self.spark.removeTag(tag)

    def interrupt(self, tag: str) -> None:
        """Stop the running jobs of a tag."""
        self.spark.interruptTag(tag)

    def rows(self, sql: str, params: dict[str, object] | None = None, tag: str | None = None) -> Iterator[tuple]:
        """Rows one by one, a partition at a time."""
        with self.running(tag):
            for row in self.query(sql, params).toLocalIterator():
                yield tuple(row)

    def collect(self, sql: str, params: dict[str, object] | None = None, tag: str | None = None) -> list[tuple]:
        """All rows at once, within a slot; for small results."""
        with self.running(tag):
            return [tuple(r) for r in self.query(sql, params).collect()]

    def describe(self, command: str) -> DataFrame:
        """LIST TABLES and DESCRIBE TABLE name."""
        words = command.strip().rstrip(";").split(None, 2)
        low = [w.lower() for w in words]
        if low[:2] == ["list", "tables"]:
            return self.spark.createDataFrame([(n,) for n in self.tables()], "table_name string")
        if low[:1] == ["describe"] and len(words) >= 2:
            name = words[-1]
            return self.spark.createDataFrame([(c.name, c.type_name, c.size) for c in self.schema(normal(name)).columns], "column_name string, type_name string, size int")
        raise AccessSqlError(f"unknown command {command!r}")
