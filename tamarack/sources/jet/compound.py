"""OLE compound files (version 3 and 4): the directory tree and its streams."""

from __future__ import annotations

from dataclasses import dataclass

from tamarack.sources.jet.pages import JetError, u16, u32

MAGIC = bytes.fromhex("d0cf11e0a1b11ae1")
END, FREE = 0xFFFFFFFE, 0xFFFFFFFF


@dataclass(frozen=True)
class Entry:
    """A folder or stream of an object store; ``path`` has '/' between names."""

    path: str
    name: str
    is_dir: bool
    size: int
    data: bytes = b""


class Compound:
    def __init__(self, data: bytes):
        if data[:8] != MAGIC or len(data) < 512:
            raise JetError("no OLE compound file")
        self.data = data
        self.sector = 1 << u16(data, 30)
        self.mini_sector = 1 << u16(data, 32)
        self.cutoff = u32(data, 56)
        if self.sector not in (512, 4096) or self.mini_sector != 64:
            raise JetError("a compound file of an unknown sector size")
        heads = [x for k in range(109) if (x := u32(data, 76 + 4 * k)) < END]
        at, left = u32(data, 68), u32(data, 72)
        while at < END and left:
            part = self._sector(at)
            heads += [x for k in range(self.sector // 4 - 1) if (x := u32(part, 4 * k)) < END]
            at, left = u32(part, self.sector - 4), left - 1
        self.fat = [u32(s, 4 * k) for h in heads for s in (self._sector(h),) for k in range(self.sector // 4)]
        self.directory = self._chain(u32(data, 48), self.fat, self._sector)
        mini = self._chain(u32(data, 60), self.fat, self._sector) if u32(data, 60) < END else b""
        self.mini_fat = [u32(mini, 4 * k) for k in range(len(mini) // 4)]
        self.mini_stream = self._stream(0, small=False)

    def _sector(self, n: int) -> bytes:
        start = (n + 1) * self.sector
        if start >= len(self.data):
            raise JetError("a compound sector lies beyond the end")
        return self.data[start : start + self.sector].ljust(self.sector, b"\0")

    def _mini(self, n: int) -> bytes:
        return self.mini_stream[n * self.mini_sector : (n + 1) * self.mini_sector]

    def _chain(self, first: int, table: list[int], read) -> bytes:
        out, seen, at = bytearray(), set(), first
        while at < END:
            if at in seen or at >= len(table):
                raise JetError("a compound chain is broken")
            seen.add(at)
            out += read(at)
            at = table[at]
        return bytes(out)

    def _record(self, n: int) -> bytes:
        if (n + 1) * 128 > len(self.directory):
            raise JetError("a directory entry lies beyond the end")
        return self.directory[n * 128 : n * 128 + 128]

    def _stream(self, n: int, small: bool = True) -> bytes:
        r = self._record(n)
        size, first = u32(r, 120), u32(r, 116)
        if not size or first >= END:
            return b""
        if small and size < self.cutoff:
            return self._chain(first, self.mini_fat, self._mini)[:size]
        return self._chain(first, self.fat, self._sector)[:size]

    def entries(self) -> list[Entry]:
        """Everything below the root, in name order of each folder."""
        out: list[Entry] = []
        seen: set[int] = set()
        # siblings form a tree by left (68) and right (72); 76 leads to the children
        stack = [(u32(self._record(0), 76), "", False)]
        while stack:
            n, parent, expanded = stack.pop()
            if n >= END:
                continue
            r = self._record(n)
            if not expanded:
                if n in seen:
                    raise JetError("a compound directory runs in a circle")
                seen.add(n)
                stack += [(u32(r, 72), parent, False), (n, parent, True), (u32(r, 68), parent, False)]
                continue
            name = r[: max(0, u16(r, 64) - 2)].decode("utf-16-le", "replace")
            path = f"{parent}/{name}" if parent else name
            folder = r[66] == 1
            out.append(Entry(path, name, folder, 0 if folder else u32(r, 120), b"" if folder else self._stream(n)))
            if folder:
                stack.append((u32(r, 76), path, False))
        return out
