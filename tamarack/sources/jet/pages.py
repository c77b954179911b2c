"""The page layer: format detection, decryption, rows of a page, usage maps, long values."""

from __future__ import annotations

import os
import struct
from collections import OrderedDict
from dataclasses import dataclass


class JetError(ValueError):
    """A file or page that can't be read as a Jet or ACE database."""


@dataclass(frozen=True)
class Layout:
    """Where a format keeps things."""

    page_size: int
    row_count: int  # number of rows on a data page
    rows: int  # rows of a table, in its definition
    columns: int
    real_indexes: int
    usage_map: int
    column_start: int
    index_entry: int
    column_entry: int
    column_number: int
    column_variable: int
    column_flags: int
    column_fixed: int
    column_size: int
    column_precision: int
    column_scale: int


JET4 = Layout(4096, 12, 16, 45, 51, 55, 63, 12, 25, 5, 7, 15, 21, 23, 11, 12)
JET3 = Layout(2048, 8, 12, 25, 31, 35, 43, 8, 18, 1, 3, 13, 14, 16, 9, 10)
#: Version byte of the header -> format name; system tables tell 2000 from 2003.
FORMATS = {0: "Access 97", 1: "Access 2000/2003", 2: "Access 2007", 3: "Access 2010", 4: "Access 2013", 5: "Access 2016", 6: "Access 2019"}
HEADER_KEY = bytes.fromhex("c7da396b")
OFFSET_MASK, DELETED, OVERFLOW = 0x1FFF, 0x8000, 0x4000


def rc4(key: bytes, data: bytes) -> bytes:
    """The RC4 stream cipher; deciphering is enciphering again."""
    box = list(range(256))
    j = 0
    for i in range(256):
        j = (j + box[i] + key[i % len(key)]) & 255
        box[i], box[j] = box[j], box[i]
    out = bytearray(len(data))
    i = j = 0
    for n, byte in enumerate(data):
        i = (i + 1) & 255
        j = (j + box[i]) & 255
        box[i], box[j] = box[j], box[i]
        out[n] = byte ^ box[(box[i] + box[j]) & 255]
    return bytes(out)


def u16(data: bytes, at: int) -> int:
    return struct.unpack_from("<H", data, at)[0]


def u32(data: bytes, at: int) -> int:
    return struct.unpack_from("<I", data, at)[0]


def find_file(path: str) -> str:
    """The path itself, or the first place of that name in the folders of MDBPATH."""
    if os.path.exists(path):
        return path
    for folder in os.environ.get("MDBPATH", "").split(os.pathsep):
        if folder and os.path.exists(place := os.path.join(folder, path)):
            return place
    raise FileNotFoundError(path)


def opened(path: str) -> tuple[object, int, str]:
    """A file to read from any place, its size and its path: a local path, or an address such as hdfs://host/file that Arrow knows to open."""
    if "://" not in path or path.startswith("file://"):
        found = find_file(path.removeprefix("file://"))
        return open(found, "rb"), os.path.getsize(found), found  # noqa: SIM115
    from pyarrow import fs

    system, inner = fs.FileSystem.from_uri(path)
    info = system.get_file_info(inner)
    if info.type != fs.FileType.File:
        raise FileNotFoundError(path)
    return system.open_input_file(inner), info.size, path


class PageFile:
    """Pages of one database file, decrypted; the last ones read are kept."""

    def __init__(self, path: str, keep: int = 256):
        self._file, self.size, self.path = opened(path)
        head = self._file.read(4096)
        if len(head) < 0x98 or head[:4] != b"\x00\x01\x00\x00":
            self._file.close()
            raise JetError(f"{path} is no Jet or ACE database")
        self.version = head[0x14]
        if self.version not in FORMATS:
            self._file.close()
            raise JetError(f"unknown Jet version {self.version}")
        self.layout = JET3 if self.version == 0 else JET4
        plain = rc4(HEADER_KEY, head[0x18 : 0x18 + (126 if self.version == 0 else 128)])
        self.code_page = u16(plain, 0x3C - 0x18)
        self.key = u32(plain, 0x3E - 0x18)
        self.page_count = self.size // self.layout.page_size
        self._kept: OrderedDict[int, bytes] = OrderedDict()
        self._keep = keep

    def close(self) -> None:
        self._file.close()

    def __enter__(self):
        return self

    def __exit__(self, *_):
        self.close()

    def page(self, number: int) -> bytes:
        if number in self._kept:
            self._kept.move_to_end(number)
            return self._kept[number]
        size = self.layout.page_size
        if number < 0 or number * size >= self.size:
            raise JetError(f"page {number} lies beyond the end of the file")
        self._file.seek(number * size)
        data = self._file.read(size).ljust(size, b"\0")
        if number and self.key:
            data = rc4(struct.pack("<I", self.key ^ number), data)
        self._kept[number] = data
        if len(self._kept) > self._keep:
            self._kept.popitem(last=False)
        return data

    def row_bounds(self, page: bytes, row: int) -> tuple[int, int, int]:
        """Start, end and flags of a row on a page."""
        at = self.layout.row_count
        if row >= u16(page, at):
            raise JetError(f"a page has no row {row}")
        word = u16(page, at + 2 + 2 * row)
        end = self.layout.page_size if row == 0 else u16(page, at + 2 * row) & OFFSET_MASK
        start = word & OFFSET_MASK
        if start > end or end > self.layout.page_size:
            raise JetError("a row lies outside its page")
        return start, end, word & ~OFFSET_MASK

    def row_at(self, pointer: int) -> bytes:
        """The bytes that a page and row pointer names."""
        page = self.page(pointer >> 8)
        start, end, _ = self.row_bounds(page, pointer & 0xFF)
        return page[start:end]

    def usage(self, pointer: int) -> list[int]:
        """Page numbers of a usage map: an inline bitmap, or a list of bitmap pages."""
        raw = self.row_at(pointer)
        if not raw:
            raise JetError("an empty usage map")
        out: list[int] = []
        if raw[0] == 0:
            first = u32(raw, 1)
            bits, spans = raw[5:], [(first, 0, len(raw) - 5)]
        elif raw[0] == 1:
            bits, spans = b"", []
            per_page = (self.layout.page_size - 4) * 8
            for n in range((len(raw) - 1) // 4):
                at = u32(raw, 1 + 4 * n)
                if at:
                    body = self.page(at)[4:]
                    spans.append((n * per_page, len(bits), len(body)))
                    bits += body
        else:
            raise JetError(f"unknown usage map type {raw[0]}")
        for first, start, length in spans:
            for k in range(length):
                byte = bits[start + k]
                if byte:
                    out += [first + 8 * k + b for b in range(8) if byte >> b & 1]
        return out

    def long_value(self, head: bytes) -> bytes:
        """The bytes behind a MEMO or OLE field: inline, in one row, or in a chain of rows."""
        if len(head) < 12:
            return b""
        word, pointer = u32(head, 0), u32(head, 4)
        length = word & 0x3FFFFFFF
        if word & 0x80000000:
            return head[12 : 12 + length]
        if word & 0x40000000:
            return self.row_at(pointer)[:length]
        out, seen = bytearray(), set()
        while pointer and len(out) < length:
            if pointer in seen:
                raise JetError("a long value's chain runs in a circle")
            seen.add(pointer)
            part = self.row_at(pointer)
            if len(part) < 4:
                break
            out += part[4:]
            pointer = u32(part, 0)
        return bytes(out[:length])
