"""Queries over a database file generated from the fixed tables nation and region."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from datetime import datetime, timedelta
from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession

from tamarack.engine import Engine
from tamarack.sources.jet.source import open_database
from tamarack.sources.jet.tables import JetFile
from tamarack.sources.jet.writer import JetWriter
from tamarack.sources.tables import table
from tamarack.workspace import root

#: Key of the encrypted file.
KEY = 0x2468ACE0


def database(spark: SparkSession, d: str, key: int = 0) -> str:
    """The address of a new file in the shared folder with both tables, long texts, typed values and a saved query."""
    nations = sorted((r["n_nationkey"], r["n_name"], r["n_regionkey"]) for r in table(spark, d, "nation").collect())
    regions = sorted((r["r_regionkey"], r["r_name"]) for r in table(spark, d, "region").collect())
    w = JetWriter(key)
    w.table("nation", [("n_nationkey", 4), ("n_name", 10), ("n_regionkey", 4)], nations, per_page=7)
    w.table("region", [("r_regionkey", 4), ("r_name", 10)], regions)
    w.table("notes", [("n_nationkey", 4), ("note", 12)], [(k, w.long((f"{name} " * 300).encode("utf-16-le"), 1500)) for k, name, _ in nations])
    w.table("typed", [("flag", 1), ("small", 2), ("money", 5), ("moment", 8), ("half", 7)], [(r > 2, k, Decimal(k) * Decimal("1.25"), datetime(1998, 1, 1) + timedelta(days=k), k / 2) for k, _, r in nations])
    text = lambda v: w.long(v.encode("utf-16-le"))
    columns = [("Attribute", 2), ("Expression", 12), ("Flag", 3), ("Name1", 10), ("Name2", 10), ("ObjectId", 4)]
    w.table("MSysQueries", columns, [(3, None, 0, None, None, 900), (5, None, 0, "nation", "n", 900), (6, text("n.n_name"), 0, None, None, 900), (8, text("n.n_regionkey = 1"), 0, None, None, 900)], flags=0x80000000)
    w.object(900, "first_region", 5)
    path = f"{root(spark)}/{uuid.uuid4().hex}.mdb"
    if "://" in path and not path.startswith("file://"):
        from pyarrow import fs

        system, inner = fs.FileSystem.from_uri(path)
        with system.open_output_stream(inner) as out:
            out.write(w.content())
    else:
        w.save(path.removeprefix("file://"))
    return path


def _query(sql: str, key: int = 0) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, d: _engine(spark, d, key).query(sql)


def _engine(spark: SparkSession, d: str, key: int = 0) -> Engine:
    return open_database(spark, database(spark, d, key))


def jet_counts(spark: SparkSession, d: str) -> DataFrame:
    e = _engine(spark, d)
    return spark.createDataFrame([(n, e.row_count(n)) for n in e.tables()], "table_name string, n long")


def jet_file(spark: SparkSession, d: str) -> DataFrame:
    with JetFile(database(spark, d, KEY)) as f:
        return spark.createDataFrame([(f.format_name(), f.code_page, len(f.tables()), len(f.queries()))], "format string, code_page int, n_tables int, n_queries int")


#: name -> (query, SQL for DuckDB)
ALL: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str]] = {
    "jet_scan": (_query("SELECT * FROM [nation]"), "SELECT * FROM nation"),
    "jet_columns": (_query('SELECT n_name FROM [nation] WHERE n_regionkey = 2 AND n_name LIKE "*A*"'), "SELECT n_name FROM nation WHERE n_regionkey = 2 AND lower(n_name) LIKE '%a%'"),
    "jet_encrypted": (_query("SELECT n_nationkey, n_name FROM [nation] WHERE n_nationkey >= 10", KEY), "SELECT n_nationkey, n_name FROM nation WHERE n_nationkey >= 10"),
    "jet_join": (_query("SELECT r.r_name, Count(*) AS n FROM [nation] AS n INNER JOIN [region] AS r ON n.n_regionkey = r.r_regionkey GROUP BY r.r_name"), "SELECT r_name, count(*) AS n FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY 1"),
    "jet_long": (_query("SELECT n_nationkey, Len(note) AS size, Right(note, 20) AS tail FROM [notes]"), "SELECT n_nationkey, length(repeat(n_name || ' ', 300)) AS size, right(repeat(n_name || ' ', 300), 20) AS tail FROM nation"),
    "jet_typed": (_query("SELECT flag, small, money, moment, half FROM [typed]"), "SELECT n_regionkey > 2 AS flag, CAST(n_nationkey AS SMALLINT) AS small, CAST(n_nationkey * 1.25 AS DECIMAL(19,4)) AS money, TIMESTAMP '1998-01-01' + to_days(n_nationkey) AS moment, n_nationkey / 2 AS half FROM nation"),
    "jet_view": (_query("SELECT n_name FROM [first_region]"), "SELECT n_name FROM nation WHERE n_regionkey = 1"),
    "jet_counts": (jet_counts, "SELECT 'nation' AS table_name, count(*) AS n FROM nation UNION ALL SELECT 'notes', count(*) FROM nation UNION ALL SELECT 'typed', count(*) FROM nation UNION ALL SELECT 'region', count(*) FROM region"),
    "jet_file": (jet_file, "SELECT 'Access 2000' AS format, 1252 AS code_page, 4 AS n_tables, 1 AS n_queries"),
}
QUERIES = {n: f for n, (f, _) in ALL.items()}
ORACLES = {n: o for n, (_, o) in ALL.items()}
