"""Writes small Jet 4 files, for tests and for the queries over generated files; no sink."""

from __future__ import annotations

import struct
from datetime import datetime

from tamarack.sources.jet.pages import HEADER_KEY, rc4

PAGE = 4096
SIZES = {1: 0, 2: 1, 3: 2, 4: 4, 5: 8, 6: 4, 7: 8, 8: 8, 15: 16, 16: 17}


def encode(code, value, scale=0):
    if code == 2:
        return bytes([value])
    if code in (3, 4):
        return struct.pack("<h" if code == 3 else "<i", value)
    if code == 5:
        return struct.pack("<q", int(value * 10000))
    if code == 6:
        return struct.pack("<f", value)
    if code == 7:
        return struct.pack("<d", value)
    if code == 8:
        return struct.pack("<d", (value - datetime(1899, 12, 30)).total_seconds() / 86400)
    if code == 15:
        return value
    if code == 16:
        n = int(abs(value) * 10**scale).to_bytes(16, "big")
        return bytes([0x80 if value < 0 else 0]) + b"".join(n[k : k + 4][::-1] for k in range(0, 16, 4))
    if code in (9, 11):
        return value
    return value if isinstance(value, bytes) else value.encode("utf-16-le")


class JetWriter:
    def __init__(self, key=0):
        self.key = key
        self.pages = [bytearray(PAGE), bytearray(PAGE), bytearray(PAGE)]
        self.catalog = []
        head = self.pages[0]
        head[:4] = b"\x00\x01\x00\x00"
        head[4:19] = b"Standard Jet DB"
        head[0x14] = 1
        plain = bytearray(128)
        struct.pack_into("<H", plain, 0x3C - 0x18, 1252)
        struct.pack_into("<I", plain, 0x3E - 0x18, key)
        head[0x18 : 0x18 + 128] = rc4(HEADER_KEY, bytes(plain))

    def new_page(self):
        self.pages.append(bytearray(PAGE))
        return len(self.pages) - 1

    def rows_page(self, rows, owner, flags=None):
        """A data page with rows from its end backwards."""
        n = self.new_page()
        page = self.pages[n]
        page[0:2] = b"\x01\x01"
        struct.pack_into("<I", page, 4, owner)
        struct.pack_into("<H", page, 12, len(rows))
        at = PAGE
        for k, row in enumerate(rows):
            at -= len(row)
            page[at : at + len(row)] = row
            struct.pack_into("<H", page, 14 + 2 * k, at | (flags or {}).get(k, 0))
        return n

    def long(self, data, chain=0):
        """A long value: inline, in one row (chain 1) or in a chain of rows of ``chain`` bytes."""
        if not chain:
            return struct.pack("<III", len(data) | 0x80000000, 0, 0) + data
        if chain == 1:
            n = self.rows_page([data], 0)
            return struct.pack("<III", len(data) | 0x40000000, n << 8, 0)
        pointer = 0
        for k in reversed(range(0, len(data), chain)):
            n = self.rows_page([struct.pack("<I", pointer) + data[k : k + chain]], 0)
            pointer = n << 8
        return struct.pack("<III", len(data), pointer, 0)

    def row(self, columns, values):
        fixed, variable, mask = bytearray(), [], bytearray((len(columns) + 7) // 8)
        for k, ((_, code, *rest), v) in enumerate(zip(columns, values)):
            if code == 1:
                if v:
                    mask[k // 8] |= 1 << k % 8
                continue
            if v is not None:
                mask[k // 8] |= 1 << k % 8
            if code in SIZES:
                fixed += encode(code, v, rest[0] if rest else 0) if v is not None else bytes(SIZES[code])
            else:
                variable.append(encode(code, v) if v is not None else b"")
        out = bytearray(struct.pack("<H", len(columns))) + fixed
        ends = []
        for v in variable:
            ends.append(len(out))
            out += v
        if variable:
            end = len(out)
            out += struct.pack("<H", end)
            for e in reversed(ends):
                out += struct.pack("<H", e)
            out += struct.pack("<H", len(variable))
        return bytes(out + mask)

    def define(self, page, columns, data_pages, row_count, long_map=False):
        body = bytearray(63)
        body[0:2] = b"\x02\x01"
        variable = [c for c in columns if c[1] not in SIZES]
        struct.pack_into("<I", body, 16, row_count)
        body[40] = 0x4E
        struct.pack_into("<HHH", body, 41, len(columns), len(variable), len(columns))
        if long_map:
            bitmap = self.new_page()
            for d in data_pages:
                self.pages[bitmap][4 + d // 8] |= 1 << d % 8
            usage = b"\x01" + struct.pack("<I", bitmap)
        else:
            bits = bytearray(64)
            low = min(data_pages, default=0)
            for d in data_pages:
                bits[(d - low) // 8] |= 1 << (d - low) % 8
            usage = b"\x00" + struct.pack("<I", low) + bits
        holder = self.rows_page([usage], 0)
        struct.pack_into("<I", body, 55, holder << 8)
        struct.pack_into("<I", body, 59, holder << 8)
        offset = var = 0
        for k, (_, code, *rest) in enumerate(columns):
            e = bytearray(25)
            e[0] = code
            struct.pack_into("<HHH", e, 5, k, var if code not in SIZES else 0, k)
            if code == 16:
                e[11], e[12] = 18, rest[0]
            e[15] = 3 if code in SIZES else 2
            if code in SIZES:
                struct.pack_into("<H", e, 21, offset)
                offset += SIZES[code]
            else:
                var += 1
            struct.pack_into("<H", e, 23, SIZES.get(code, 255))
            body += e
        for name, *_ in columns:
            raw = name.encode("utf-16-le")
            body += struct.pack("<H", len(raw)) + raw
        first, rest = body[:PAGE], bytes(body[PAGE:])
        self.pages[page][: len(first)] = first
        last = page
        while rest:
            n = self.new_page()
            struct.pack_into("<I", self.pages[last], 4, n)
            self.pages[n][0:2] = b"\x02\x01"
            self.pages[n][8 : 8 + len(rest[: PAGE - 8])] = rest[: PAGE - 8]
            rest, last = rest[PAGE - 8 :], n

    def table(self, name, columns, rows, per_page=20, deleted=(), long_map=False, flags=0):
        page = self.new_page()
        raw = [r if isinstance(r, bytes) else self.row(columns, r) for r in rows]
        data = []
        for k in range(0, len(raw), per_page):
            part = raw[k : k + per_page]
            data.append(self.rows_page(part, page, {n - k: 0x8000 for n in deleted if k <= n < k + per_page}))
        self.define(page, columns, data, len(rows) - len(deleted), long_map)
        self.catalog.append((page, name, 1, flags, None))
        return page

    def object(self, ident, name, kind, flags=0, properties=None):
        self.catalog.append((ident, name, kind, flags, properties))

    def content(self):
        """The whole file; nothing may be added afterwards."""
        columns = [("Id", 4), ("Name", 10), ("Type", 3), ("Flags", 4), ("LvProp", 11)]
        rows = [self.row(columns, (i, n, k, f if f < 2**31 else f - 2**32, self.long(p) if p is not None else None)) for i, n, k, f, p in [(2, "MSysObjects", 1, 0x80000000, None), *self.catalog]]
        data = [self.rows_page(rows[k : k + 8], 2) for k in range(0, len(rows), 8)]
        self.define(2, columns, data, len(rows))
        return b"".join(rc4(struct.pack("<I", self.key ^ n), bytes(p)) if self.key and n else bytes(p) for n, p in enumerate(self.pages))

    def save(self, path):
        with open(path, "wb") as f:
            f.write(self.content())
        return str(path)
