"""Table definitions, rows and the catalog of a database file."""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import datetime, timedelta
from decimal import Decimal

from pyspark.sql import types as T

from tamarack.sources.jet.pages import DELETED, FORMATS, JET3, OVERFLOW, JetError, PageFile, u16, u32

EPOCH = datetime(1899, 12, 30)
CATALOG_PAGE = 2
#: Object types and system flags of the catalog.
TABLE_OBJECT, QUERY_OBJECT, FORM_OBJECT = 1, 5, -32768
SYSTEM_FLAGS = 0x80000002


@dataclass(frozen=True)
class JetColumn:
    name: str
    code: int
    number: int
    variable: int
    offset: int
    size: int
    fixed: bool
    precision: int = 0
    scale: int = 0

    @property
    def spark_type(self) -> T.DataType:
        if self.code == 16:
            return T.DecimalType(min(38, self.precision or 28), min(self.scale, self.precision or 28))
        return {1: T.BooleanType(), 2: T.ShortType(), 3: T.ShortType(), 4: T.IntegerType(), 5: T.DecimalType(19, 4), 6: T.FloatType(), 7: T.DoubleType(), 8: T.TimestampNTZType(), 9: T.BinaryType(), 11: T.BinaryType(), 18: T.IntegerType()}.get(self.code, T.StringType())


@dataclass(frozen=True)
class JetTable:
    name: str
    page: int
    row_count: int
    variable_columns: int
    usage_map: int
    columns: tuple[JetColumn, ...]

    def schema(self, columns: list[str] | None = None) -> T.StructType:
        chosen = self.columns if columns is None else self.pick(columns)
        return T.StructType([T.StructField(c.name, c.spark_type, c.code != 1, {"access_type": c.code, "size": c.size, "prec": c.precision, "scale": c.scale, "is_fixed": c.fixed}) for c in chosen])

    def pick(self, names: list[str]) -> tuple[JetColumn, ...]:
        by_name = {c.name.lower(): c for c in self.columns}
        missing = [n for n in names if n.lower() not in by_name]
        if missing:
            raise JetError(f"table {self.name} has no column {missing[0]}")
        return tuple(by_name[n.lower()] for n in names)


@dataclass(frozen=True)
class JetObject:
    id: int
    name: str
    type: int
    flags: int
    properties: bytes | None = None


class JetFile(PageFile):
    """Catalog, definitions and rows over the page layer."""

    def text(self, raw: bytes) -> str:
        """Text of a column or name: the code page in Jet 3; UTF-16, perhaps compressed, later."""
        if self.layout is JET3:
            for name in (f"cp{self.code_page}", "cp1252"):
                try:
                    return raw.decode(name)
                except (LookupError, UnicodeDecodeError):
                    continue
            return raw.decode("latin_1")
        if raw[:2] == b"\xff\xfe":
            out, k, squeezed = bytearray(), 2, True
            while k < len(raw):
                if raw[k] == 0:
                    squeezed = not squeezed
                    k += 1
                elif squeezed:
                    out += bytes((raw[k], 0))
                    k += 1
                else:
                    out += raw[k : k + 2]
                    k += 2
            raw = bytes(out)
        return raw[: len(raw) // 2 * 2].decode("utf-16-le", "replace")

    def definition(self, page: int, name: str = "") -> JetTable:
        """The table whose definition starts on ``page``; its parts on further pages are joined."""
        f = self.layout
        data = bytearray(self.page(page))
        if data[0] != 2:
            raise JetError(f"page {page} holds no table definition")
        following, seen = u32(data, 4), {page}
        while following:
            if following in seen:
                raise JetError("a table definition's pages run in a circle")
            seen.add(following)
            part = self.page(following)
            data += part[8:]
            following = u32(part, 4)
        at = f.column_start + u32(data, f.real_indexes) * f.index_entry
        count = u16(data, f.columns)
        entries = [bytes(data[at + k * f.column_entry : at + (k + 1) * f.column_entry]) for k in range(count)]
        at += count * f.column_entry
        columns = []
        for e in entries:
            if len(e) < f.column_entry:
                raise JetError("a table definition is cut short")
            length = data[at] if f is JET3 else u16(data, at)
            at += 1 if f is JET3 else 2
            label = self.text(bytes(data[at : at + length]))
            at += length
            code = e[0]
            measured = code in (5, 6, 7, 16)
            columns.append(JetColumn(label, code, e[f.column_number], u16(e, f.column_variable), u16(e, f.column_fixed), 0 if code == 1 else u16(e, f.column_size), bool(e[f.column_flags] & 1), e[f.column_precision] if measured else 0, e[f.column_scale] if measured else 0))
        return JetTable(name, page, u32(data, f.rows), u16(data, f.columns - 2), u32(data, f.usage_map), tuple(sorted(columns, key=lambda c: c.number)))

    def data_pages(self, table: JetTable) -> list[int]:
        """Data pages of a table by its usage map; every page is looked at where the map can't be read."""
        try:
            return self.usage(table.usage_map)
        except JetError:
            return [n for n in range(1, self.page_count) if (p := self.page(n))[0] == 1 and u32(p, 4) == table.page]

    def rows(self, table: JetTable, pages: list[int] | None = None, columns: tuple[JetColumn, ...] | None = None) -> Iterator[tuple]:
        """Values of the live rows on ``pages`` (all by default), in page order."""
        chosen = columns if columns is not None else table.columns
        for number in pages if pages is not None else self.data_pages(table):
            page = self.page(number)
            if page[0] != 1 or u32(page, 4) != table.page:
                continue
            for k in range(u16(page, self.layout.row_count)):
                try:
                    start, end, flags = self.row_bounds(page, k)
                    if flags & DELETED or start == end:
                        continue
                    raw = page[start:end]
                    if flags & OVERFLOW:
                        raw = self.row_at(u32(raw, 0))
                    yield self.crack(table, raw, chosen)
                except (JetError, struct.error, IndexError):
                    continue  # a damaged row is passed over

    def crack(self, table: JetTable, raw: bytes, columns: tuple[JetColumn, ...]) -> tuple:
        """Values of one row: fixed columns in front, variable ones by the offsets behind them, the null bits last."""
        jet3 = self.layout is JET3
        width = raw[0] if jet3 else u16(raw, 0)
        head = 1 if jet3 else 2
        mask_at = len(raw) - (width + 7) // 8
        if mask_at < head:
            raise JetError("a row is too short for its null bits")
        mask = raw[mask_at:]
        offsets: list[int] = []
        if table.variable_columns:
            if jet3:
                count = raw[mask_at - 1]
                jumps = (len(raw) - 1) // 256
                at = mask_at - 2 - jumps
                if (at - count) // 256 < jumps:
                    jumps -= 1
                used = 0
                for k in range(count + 1):
                    while used < jumps and raw[mask_at - 2 - used] == k:
                        used += 1
                    offsets.append(raw[at - k] + 256 * used)
            else:
                count = u16(raw, mask_at - 2)
                offsets = [u16(raw, mask_at - 4 - 2 * k) for k in range(count + 1)]
        out = []
        for c in columns:
            present = c.number // 8 < len(mask) and mask[c.number // 8] >> (c.number % 8) & 1
            if c.code == 1:
                out.append(bool(present))
            elif not present or c.number >= width:
                out.append(None)
            elif c.fixed:
                out.append(self.value(c, raw[head + c.offset : head + c.offset + c.size]))
            elif c.variable + 1 < len(offsets):
                start, end = offsets[c.variable], offsets[c.variable + 1]
                if start > end or end > mask_at:
                    raise JetError("a value lies outside its row")
                out.append(self.value(c, raw[start:end]))
            else:
                out.append(None)
        return tuple(out)

    def value(self, c: JetColumn, raw: bytes):
        code = c.code
        if code == 2:
            return raw[0]
        if code == 3:
            return struct.unpack("<h", raw[:2])[0]
        if code in (4, 18):
            return struct.unpack("<i", raw[:4])[0]
        if code == 5:
            return Decimal(struct.unpack("<q", raw[:8])[0]).scaleb(-4)
        if code == 6:
            return struct.unpack("<f", raw[:4])[0]
        if code == 7:
            return struct.unpack("<d", raw[:8])[0]
        if code == 8:
            days = struct.unpack("<d", raw[:8])[0]
            whole = int(days)
            # the part of the day counts forward, before 1899 too
            return EPOCH + timedelta(days=whole, microseconds=round(abs(days - whole) * 86_400) * 1_000_000)
        if code == 9:
            return raw
        if code == 11:
            return self.long_value(raw)
        if code == 12:
            return self.text(self.long_value(raw))
        if code == 15:
            return "{" + str(uuid.UUID(bytes_le=raw[:16])).upper() + "}"
        if code == 16:
            number = int.from_bytes(b"".join(raw[1 + k : 5 + k][::-1] for k in range(0, 16, 4)), "big")
            return Decimal(-number if raw[0] & 0x80 else number).scaleb(-c.scale)
        return self.text(raw)

    # ---- catalog

    def objects(self) -> list[JetObject]:
        table = self.definition(CATALOG_PAGE, "MSysObjects")
        names = ["Id", "Name", "Type", "Flags"] + (["LvProp"] if any(c.name == "LvProp" for c in table.columns) else [])
        out = []
        for row in self.rows(table, columns=table.pick(names)):
            kind = row[2]
            out.append(JetObject(row[0], row[1] or "", kind if kind is not None else 0, (row[3] or 0) & 0xFFFFFFFF, row[4] if len(row) > 4 else None))
        return out

    def find(self, name: str, kind: int = TABLE_OBJECT) -> JetObject:
        for o in self.objects():
            if o.type == kind and o.name.lower() == name.lower():
                return o
        raise JetError(f"{name} is not in the catalog")

    def tables(self) -> list[str]:
        """User tables."""
        return [o.name for o in self.objects() if o.type == TABLE_OBJECT and not o.flags & SYSTEM_FLAGS and not o.name.startswith("MSys")]

    def queries(self) -> list[str]:
        return [o.name for o in self.objects() if o.type == QUERY_OBJECT]

    def table(self, name: str) -> JetTable:
        o = self.find(name)
        return self.definition(o.id & 0x00FFFFFF, o.name)

    def format_name(self) -> str:
        """Access version; 2000 and 2003 differ by the table that keeps forms."""
        if self.version != 1:
            return FORMATS[self.version]
        names = {o.name.lower() for o in self.objects()}
        return "Access 2003" if "msysaccessstorage" in names else "Access 2000"
