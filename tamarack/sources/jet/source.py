"""Spark data source over database files, and an engine over one file."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from tamarack.engine import Engine, Source
from tamarack.sources.jet.pages import JetError
from tamarack.sources.jet.saved import saved_queries
from tamarack.sources.jet.tables import JetFile

#: Rows to an Arrow batch.
BATCH = 8192


class PageRange(InputPartition):
    def __init__(self, pages: list[int]):
        self.pages = pages


class JetReader(DataSourceReader):
    """Reads a table by ranges of its data pages."""

    def __init__(self, path: str, table: str, pages_per_partition: int, schema):
        self.path, self.table, self.per, self.schema = path, table, pages_per_partition, schema

    def partitions(self) -> list[PageRange]:
        with JetFile(self.path) as f:
            pages = f.data_pages(f.table(self.table))
        return [PageRange(pages[k : k + self.per]) for k in range(0, len(pages), self.per)] or [PageRange([])]

    def read(self, partition: PageRange) -> Iterator[pa.RecordBatch]:
        target = to_arrow_schema(self.schema)
        with JetFile(self.path) as f:
            table = f.table(self.table)
            columns = table.pick([c.name for c in self.schema.fields])
            batch: list[tuple] = []

            def flush() -> pa.RecordBatch:
                return pa.RecordBatch.from_arrays([pa.array([r[k] for r in batch], type=target.field(k).type) for k in range(len(columns))], schema=target)

            for row in f.rows(table, partition.pages, columns):
                batch.append(row)
                if len(batch) == BATCH:
                    yield flush()
                    batch.clear()
            if batch:
                yield flush()


class JetDataSource(DataSource):
    """``spark.read.format("jet").option("table", name).load(path)``; option pages_per_partition (256)."""

    @classmethod
    def name(cls) -> str:
        return "jet"

    def _option(self, name: str) -> str:
        if not self.options.get(name):
            raise JetError(f"option {name} is missing")
        return self.options[name]

    def schema(self):
        with JetFile(self._option("path")) as f:
            return f.table(self._option("table")).schema()

    def reader(self, schema) -> JetReader:
        return JetReader(self._option("path"), self._option("table"), max(1, int(self.options.get("pages_per_partition", "256"))), schema)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(JetDataSource)


class JetSource(Source):
    """A table of a database file; only the columns asked for are decoded, and the header knows its rows."""

    def __init__(self, spark: SparkSession, path: str, name: str):
        self.spark, self.path, self.name = spark, path, name
        with JetFile(path) as f:
            table = f.table(name)
            self.schema, self.rows = table.schema(), table.row_count

    def columns(self) -> list[str]:
        return self.schema.names

    def read(self, columns: list[str] | None = None) -> DataFrame:
        chosen = StructType([f for f in self.schema.fields if columns is None or f.name in columns])
        return self.spark.read.format("jet").schema(chosen).option("table", self.name).load(self.path)

    def count(self) -> int:
        return self.rows


def open_database(spark: SparkSession, path: str, **options) -> Engine:
    """An engine over the user tables and saved queries of one file, which every executor must be able to read."""
    register(spark)
    with JetFile(path) as f:
        names = f.tables()
        queries = saved_queries(f)
    engine = Engine(spark, **options)
    for name in names:
        engine.add_table(name, JetSource(spark, path, name))
    for name, sql in queries.items():
        if isinstance(sql, str):
            engine.add_view(name, sql)
    return engine
