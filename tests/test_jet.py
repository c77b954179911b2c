"""The database file reader over synthetic files; no real file was at hand."""

import struct
import uuid
from datetime import datetime
from decimal import Decimal

import pytest

from tamarack.sources.jet.pages import JetError, rc4
from tamarack.sources.jet.saved import QueryRow, query_sql
from tamarack.sources.jet.source import open_database
from tamarack.sources.jet.tables import JetFile
from tamarack.sources.jet.writer import JetWriter

GUID = uuid.UUID("12345678-1234-5678-1234-567812345678")
COLUMNS = [("b", 1), ("by", 2), ("i", 3), ("l", 4), ("m", 5), ("f", 6), ("d", 7), ("t", 8), ("bin", 9), ("s", 10), ("ole", 11), ("memo", 12), ("g", 15), ("n", 16, 3)]


def build(path, key=0):
    w = JetWriter(key)
    long_text = "long text é " * 900
    rows = [
        (True, 200, -5, 70000, Decimal("-12.3456"), 1.5, 2.25, datetime(1998, 9, 2, 13, 30), b"\x00\x01", "Größe", w.long(b"blob"), w.long("memo".encode("utf-16-le")), GUID.bytes_le, Decimal("-1234.567")),
        (False, 0, 0, 0, Decimal("0"), 0.0, 0.0, datetime(1899, 12, 31), b"", b"\xff\xfeabc", w.long(b"x" * 3000, 1), w.long(long_text.encode("utf-16-le"), 2000), GUID.bytes_le, Decimal("0")),
        (False,) + (None,) * 13,
    ]
    w.table("typed", COLUMNS, rows)
    w.table("many", [("id", 4), ("name", 10)], [(k, f"row {k}") for k in range(200)], per_page=30, deleted=(5, 31), long_map=True)
    w.table("wide", [(f"column_with_a_long_name_{k}", 4) for k in range(90)], [tuple(range(90))])
    w.table("MSysQueries", [("Attribute", 2), ("Expression", 12), ("Flag", 3), ("Name1", 10), ("Name2", 10), ("ObjectId", 4)], [
        (3, None, 0, None, None, 900), (5, None, 0, "many", "a", 900), (6, w.long("a.id".encode("utf-16-le")), 0, None, None, 900), (8, w.long("a.id < 3".encode("utf-16-le")), 0, None, None, 900),
    ], flags=0x80000000)
    w.object(900, "first_rows", 5)
    w.object(901, "action_query", 5, 0x40)
    return w.save(path), long_text


@pytest.mark.parametrize("key", [0, 0x12345678])
def test_values(tmp_path, key):
    path, long_text = build(tmp_path / "a.mdb", key)
    with JetFile(path) as f:
        assert f.format_name() == "Access 2000" and f.code_page == 1252
        assert f.tables() == ["typed", "many", "wide"]
        t = f.table("TYPED")
        assert t.row_count == 3
        one, two, three = f.rows(t)
        assert one == (True, 200, -5, 70000, Decimal("-12.3456"), 1.5, 2.25, datetime(1998, 9, 2, 13, 30), b"\x00\x01", "Größe", b"blob", "memo", "{" + str(GUID).upper() + "}", Decimal("-1234.567"))
        assert two[9] == "abc" and two[10] == b"x" * 3000 and two[11] == long_text
        assert three == (False,) + (None,) * 13
        assert [r[0] for r in f.rows(f.table("many"))] == [k for k in range(200) if k not in (5, 31)]
        assert [c.name for c in f.table("wide").columns][-1] == "column_with_a_long_name_89"
        with pytest.raises(JetError):
            f.table("nothing")


def test_spark_source_and_engine(spark, tmp_path):
    path, long_text = build(tmp_path / "b.mdb")
    e = open_database(spark, path)
    assert e.tables() == ["many", "typed", "wide"] and e.views() == ["first_rows"]
    assert e.query("SELECT Count(*) AS n, Max(id) AS hi FROM [many]").first() == (198, 199)
    assert [r["id"] for r in e.query("SELECT id FROM first_rows ORDER BY id").collect()] == [0, 1, 2]
    row = e.query("SELECT s, m, t, n, memo FROM typed WHERE b = TRUE").first()
    assert tuple(row) == ("Größe", Decimal("-12.3456"), datetime(1998, 9, 2, 13, 30), Decimal("-1234.567"), "memo")
    assert e.schema("typed").columns[4].type_name == "MONEY"
    df = spark.read.format("jet").option("table", "many").option("pages_per_partition", 2).load(path)
    assert df.rdd.getNumPartitions() == 4 and df.count() == 198


def test_only_named_columns_are_decoded_and_the_header_counts(spark, tmp_path):
    path, _ = build(tmp_path / "p.mdb")
    e = open_database(spark, path)
    plan = lambda sql: e.query(sql)._jdf.queryExecution().analyzed().toString()
    assert "memo#" not in plan("SELECT l, m FROM typed WHERE b = TRUE") and "memo#" in plan("SELECT * FROM typed")
    assert "name#" not in plan("SELECT Count(*) AS n FROM many") and "name#" not in plan("SELECT id FROM first_rows") and "name#" in plan("SELECT m.* FROM many AS m")
    assert [tuple(r) for r in e.query("SELECT l FROM typed WHERE b = TRUE AND s = 'größe'").collect()] == [(70000,)]
    # the header's number, which deleted rows leave as it was written
    assert e.row_count("typed") == 3 and e.schema("typed").row_count == 3 and e.collect("SELECT Count(*) FROM many") == [(198,)]


def test_overflow_rows_and_damage(tmp_path):
    w = JetWriter()
    columns = [("id", 4), ("s", 10)]
    other = w.rows_page([w.row(columns, (7, "moved"))], 999)
    page = w.table("t", columns, [(1, "here"), struct.pack("<I", other << 8), b"\xff\xff\x01", (2, "last")])
    data = next(n for n, p in enumerate(w.pages) if p[0] == 1 and struct.unpack_from("<I", p, 4)[0] == page)
    word = struct.unpack_from("<H", w.pages[data], 14 + 2)[0]
    struct.pack_into("<H", w.pages[data], 14 + 2, word | 0x4000)
    with JetFile(w.save(tmp_path / "c.mdb")) as f:
        assert list(f.rows(f.table("t"))) == [(1, "here"), (7, "moved"), (2, "last")]


def test_not_a_database(tmp_path):
    (tmp_path / "x.mdb").write_bytes(b"no database" * 1000)
    with pytest.raises(JetError):
        JetFile(str(tmp_path / "x.mdb"))
    with pytest.raises(FileNotFoundError):
        JetFile(str(tmp_path / "none.mdb"))


def test_search_path(tmp_path, monkeypatch):
    build(tmp_path / "here.mdb")
    monkeypatch.setenv("MDBPATH", f"/nowhere:{tmp_path}")
    with JetFile("here.mdb") as f:
        assert "many" in f.tables()


def test_files_of_other_systems(tmp_path, monkeypatch):
    from pyarrow import fs

    path, _ = build(tmp_path / "far.mdb")
    asked = []

    class Far:
        @staticmethod
        def from_uri(uri):
            asked.append(uri)
            return fs.LocalFileSystem(), path if uri.endswith("far.mdb") else "/none"

    monkeypatch.setattr(fs, "FileSystem", Far)
    with JetFile("hdfs://host/far.mdb") as f:
        assert f.tables() == ["typed", "many", "wide"] and len(list(f.rows(f.table("many")))) == 198
    with pytest.raises(FileNotFoundError):
        JetFile("hdfs://host/none.mdb")
    with JetFile(f"file://{path}") as f:
        assert f.path == path
    assert asked == ["hdfs://host/far.mdb", "hdfs://host/none.mdb"]


def test_rc4_vector():
    assert rc4(b"Key", b"Plaintext").hex() == "bbf316e8d940af0ad3"


def test_query_text():
    rows = [
        QueryRow(2, 4, "my id"), QueryRow(2, 10, "nm"), QueryRow(3, 0x10 | 0x20 | 0x04, "5"), QueryRow(5, 0, "orders", "o"), QueryRow(5, 0, "customer"), QueryRow(5, 0, "loose"), QueryRow(5, 0, "lines", None, "other db"),
        QueryRow(6, 0, "total", None, "Sum(o.x)"), QueryRow(6, 0, None, None, "customer.name"), QueryRow(7, 2, "o", "customer", "o.c = customer.id"), QueryRow(7, 2, "o", "customer", "o.d = customer.d"), QueryRow(7, 1, "customer", "lines", "customer.id = lines.c"),
        QueryRow(8, 0, None, None, "o.x > [my id]"), QueryRow(9, 0, None, None, "customer.name"), QueryRow(10, 0, None, None, "Sum(o.x) > 3"), QueryRow(11, 0, "D", None, "customer.name"), QueryRow(11, 0, None, None, "2"),
    ]
    assert query_sql(rows) == (
        "PARAMETERS [my id] Long, [nm] Text;\nSELECT TOP 5 PERCENT Sum(o.x) AS [total], customer.name\n"
        "FROM (([orders] AS [o] LEFT JOIN [customer] ON (o.c = customer.id) AND (o.d = customer.d)) INNER JOIN [other db].[lines] ON (customer.id = lines.c)), [loose]\n"
        "WHERE o.x > [my id]\nGROUP BY customer.name\nHAVING Sum(o.x) > 3\nORDER BY customer.name DESC, 2\nWITH OWNERACCESS OPTION;"
    )
    assert query_sql([QueryRow(3, 1 | 2 | 16, "3"), QueryRow(5, 0, "t")]) == "SELECT DISTINCT *\nFROM [t];"
    assert query_sql([QueryRow(3, 9), QueryRow(5, 0, "t")]).startswith("SELECT DISTINCTROW *")
    assert " IN 'x.mdb' [opt]" in query_sql([QueryRow(3, 1), QueryRow(5, 0, "t"), QueryRow(4, 0, "x.mdb", None, "opt")])
    for bad, flags in (([QueryRow(5, 0, "t")], 0), ([QueryRow(3, 1), QueryRow(5, 0, "t")], 0x20), ([QueryRow(3, 1), QueryRow(5, 0, "t"), QueryRow(7, 1, "t", "u", "x")], 0), ([QueryRow(3, 1), QueryRow(5, 0, "t"), QueryRow(7, 1, "t", "t", "x")], 0), ([QueryRow(2, 77, "p"), QueryRow(3, 1)], 0), ([QueryRow(3, 1), QueryRow(5, 0, "t"), QueryRow(5, 0, "u"), QueryRow(7, 9, "t", "u", "x")], 0)):
        with pytest.raises(JetError):
            query_sql(bad, flags)


def jet3_row(columns, values):
    """A Jet 3 row: one-byte counts and offsets, and a byte for each 256 that the offsets pass."""
    fixed, variable, mask = bytearray(), [], bytearray((len(columns) + 7) // 8)
    for k, (c, v) in enumerate(zip(columns, values)):
        if v is not None:
            mask[k // 8] |= 1 << k % 8
        if c.fixed:
            fixed += struct.pack("<i", v or 0)
        else:
            variable.append((v or "").encode("cp1252"))
    out = bytearray([len(columns)]) + fixed
    offsets = []
    for v in variable:
        offsets.append(len(out))
        out += v
    offsets.append(len(out))
    jumps = bytearray(next(k for k, o in enumerate(offsets) if o >= 256 * n) for n in range(1, offsets[-1] // 256 + 1))
    tail = bytes(o & 255 for o in reversed(offsets))
    return bytes(out + tail + bytes(reversed(jumps)) + bytes([len(variable)]) + mask)


@pytest.mark.parametrize("sizes", [(3, 5), (0, 0), (200, 300), (10, 600), (255, 255), (300, 1)])
def test_jet3_rows(sizes):
    from tamarack.sources.jet.pages import JET3
    from tamarack.sources.jet.tables import JetColumn, JetTable

    f = JetFile.__new__(JetFile)
    f.layout, f.code_page = JET3, 1252
    columns = (JetColumn("a", 4, 0, 0, 0, 4, True), JetColumn("s", 10, 1, 0, 0, 255, False), JetColumn("t", 10, 2, 1, 0, 255, False))
    table = JetTable("x", 1, 1, 2, 0, columns)
    values = (7, "é" * sizes[0], "b" * sizes[1])
    assert f.crack(table, jet3_row(columns, values), columns) == values
    assert f.crack(table, jet3_row(columns, (None, None, "z")), columns) == (None, None, "z")
