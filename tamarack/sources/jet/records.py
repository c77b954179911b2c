"""The packed design records of Jet 4 controls.

A record is FD or FE, the low byte of the control's type, 0, and items up to
the next record: a flag alone (below 0x30), or a tag with one byte (to 0x5F),
two (to 0x9B), four (to 0xBB), or a length and as many bytes (from 0xC0).
Tag 0xDC holds the control's name.  Records without one before the first
control are templates of their control type: sizes that a control's record
leaves out are the template's, else the designer's own.  Other values that a
record leaves out are not filled in.

Access 2003 frames the same items wider: the marker and each tag take four
bytes, and a tag is followed by the property's number, its kind, the size of
its elements and the bytes of its value.  Such a stream starts with 0x0014.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

from tamarack.sources.jet.pages import u16, u32

NAME = 0xDC
GEOMETRY = {0x60: "Left", 0x61: "Top", 0x62: "Width", 0x63: "Height"}
FRAME = {0x31: "SpecialEffect", 0x32: "BackStyle", 0x33: "BorderStyle", 0x34: "BorderWidth"}
# What the items of each control type mean, by the low byte of the type.
ITEMS: dict[int, dict[int, str]] = {
    0x6D: {0x02: "Locked", 0x0A: "FontUnderline", 0x32: "ScrollBars", 0x3B: "TextAlign", 0x43: "BackStyle", **GEOMETRY, 0x6B: "TabIndex", 0x9C: "BackColor", 0x9F: "ForeColor", 0xDD: "ControlSource", 0xDE: "Format", 0xDF: "StatusBarText", 0xE8: "FontName", 0xF4: "Tag"},
    0x64: {0x32: "BackStyle", 0x43: "BackStyle", 0x37: "TextAlign", 0x3B: "TextAlign", **GEOMETRY, 0x64: "FontSize", 0x9C: "BackColor", 0x9E: "ForeColor", 0xDD: "Caption", 0xDE: "FontName", 0xE4: "Tag"},
    0x6F: {0x04: "Locked", 0x39: "TextAlign", 0x60: "ColumnCount", 0x61: "ListRows", 0x62: "ListWidth", 0x63: "Left", 0x64: "Top", 0x65: "Width", 0x66: "Height", 0x6E: "TabIndex", 0x9C: "BoundColumn", 0xDD: "ControlSource", 0xDE: "RowSourceType", 0xDF: "RowSource", 0xE0: "ColumnWidths", 0xEA: "FontName", 0xF5: "Tag"},
    0x68: {**GEOMETRY, 0x69: "TabIndex", 0xDD: "Caption", 0xDF: "OnClick", 0xE4: "FontName", 0xEE: "Tag", 0xF1: "ControlTipText"},
    0x6A: {0x02: "Locked", **GEOMETRY, 0x69: "TabIndex", 0xDD: "ControlSource", 0xF0: "Tag"},
    0x65: {**FRAME, **GEOMETRY, 0x9C: "BackColor", 0x9D: "BorderColor"},
    0x6B: {**FRAME, **GEOMETRY, 0x69: "TabIndex", 0x9C: "BackColor", 0x9D: "BorderColor", 0xDD: "ControlSource"},
    0x69: {0x31: "SpecialEffect", 0x33: "BorderStyle", 0x34: "BorderWidth", **GEOMETRY, 0x69: "TabIndex", 0x9C: "OptionValue", 0x9D: "BorderColor", 0xDD: "ControlSource", 0xDE: "StatusBarText", 0xF0: "Tag"},
    0x70: {0x04: "CanShrink", **GEOMETRY, 0x64: "TabIndex", 0xDD: "SourceObject", 0xDE: "LinkChildFields", 0xDF: "LinkMasterFields", 0xE0: "StatusBarText", 0xE3: "EventProcPrefix"},
    0x7B: {**GEOMETRY, 0x64: "FontSize", 0x65: "FontWeight", 0xDF: "FontName", 0xE8: "EventProcPrefix"},
    0x7C: {**GEOMETRY, 0xE3: "EventProcPrefix", 0xE8: "Caption"},
    **{code: {0x33: "SpecialEffect", 0x60: "Height", 0x9C: "BackColor", 0xDF: "EventProcPrefix"} for code in (0x98, 0x99, 0x9A)},
}
COLOURS = frozenset(("BackColor", "ForeColor", "BorderColor"))
#: First word of a widely framed stream, the frame before a value, and the kinds of values there are.
WIDE, FRAME_BYTES = 0x0014, 18
VALUE_KINDS = frozenset((1, 2, 3, 4, 6, 8, 9, 10, 11, 12))
BINARY, LONGEST = 11, 255
# Sizes in twips that the designer gives a new control of a type.
SIZES = {0x6F: {"Width": "1440"}, 0x68: {"Height": "360"}, 0x69: {"Height": "240"}, 0x65: {"Height": "720"}}
SIGNED = frozenset(("Left", "Top", "OptionValue"))


@dataclass
class Record:
    code: int
    start: int
    end: int
    name: str = ""
    values: dict[str, str] = field(default_factory=dict)


def colour(value: int) -> str:
    """Red, green and blue of a colour number, or the number of a system colour."""
    if value & 0x80000000:
        return f"#{value:08X}"
    return f"#{value & 0xFF:02X}{value >> 8 & 0xFF:02X}{value >> 16 & 0xFF:02X}"


def _text(raw: bytes) -> str | None:
    """Printable UTF-16 text, or None."""
    if not raw or len(raw) % 2:
        return None
    text = raw.decode("utf-16-le", "replace")
    return text if all(c.isprintable() or c in "\t\r\n" for c in text) and "\ufffd" not in text else None


def _width(tag: int) -> int:
    """Bytes of a tag's number; -1 where a length stands before its bytes."""
    return 0 if tag < 0x30 else 1 if tag < 0x60 else 2 if tag < 0x9C else 4 if tag < 0xC0 else -1


def _packed_items(data: bytes, at: int) -> Iterator[tuple[int, bytes, int]]:
    """Tag, value and end of each item from ``at`` on, up to the next marker or what is cut off."""
    while at < len(data) and data[at] < 0xFD:
        tag = data[at]
        start, width = at + 1, _width(tag)
        if width < 0:
            if start >= len(data):
                return
            start, width = at + 2, data[at + 1]
        if start + width > len(data):
            return
        at = start + width
        yield tag, data[start:at], at


def _wide_items(data: bytes, at: int) -> Iterator[tuple[int, bytes, int]]:
    """The same in the wide framing; an item without a property's number or of an unknown kind ends them.

    A long binary value may hold the records of inner controls, so the item
    ends before its bytes.
    """
    while at + FRAME_BYTES <= len(data):
        tag, number, kind, size = u32(data, at), u16(data, at + 4), u32(data, at + 6), u32(data, at + 14)
        start = at + FRAME_BYTES
        if tag > 0xFF or not number or kind not in VALUE_KINDS or size > len(data) - start:
            return
        inner = kind == BINARY and size > LONGEST
        yield tag, b"" if inner else data[start : start + size], start if inner else start + size
        at = start + size


def _filled(out: Record, items: Iterator[tuple[int, bytes, int]]) -> Record:
    """``out`` with the values of its items, of several with one meaning the first."""
    meaning = ITEMS[out.code]
    for tag, raw, end in items:
        label, width = meaning.get(tag), _width(tag)
        out.end = max(out.end, end)
        if width < 0:
            text = _text(raw)
            if tag == NAME and text and not out.name:
                out.name = text
            elif label and text:
                out.values.setdefault(label, text[5:] if label == "SourceObject" and text.lower().startswith("form.") else text)
        elif label and not width:
            out.values.setdefault(label, "false" if raw and not any(raw) else "true")
        elif label and raw:
            number = int.from_bytes(raw, "little")
            if label in COLOURS:
                value = colour(number & 0xFFFFFFFF)
            else:
                if label in SIGNED and number >> (8 * len(raw) - 1):
                    number -= 1 << 8 * len(raw)
                value = str(number + 1 if label == "BoundColumn" else number)
            out.values.setdefault(label, value)
    return out


def record_at(data: bytes, start: int) -> Record | None:
    """The packed record whose marker stands at ``start``, or None."""
    if start + 3 > len(data) or data[start] not in (0xFD, 0xFE) or data[start + 2] or data[start + 1] not in ITEMS:
        return None
    return _filled(Record(data[start + 1], start, start + 3), _packed_items(data, start + 3))


def wide_record_at(data: bytes, start: int) -> Record | None:
    """The widely framed record whose marker stands at ``start``, or None; a second type may stand before its items."""
    if start + 6 > len(data) or data[start] not in (0xFD, 0xFE) or any(data[start + 1 : start + 4]) or data[start + 5] or data[start + 4] not in ITEMS:
        return None
    for first in (start + 6, start + 8):
        out = _filled(Record(data[start + 4], start, first), _wide_items(data, first))
        if out.end > first:
            return out
    return None


def _records(data: bytes, at_marker: Callable[[bytes, int], Record | None]) -> list[Record]:
    out, at = [], 0
    templates: dict[int, dict[str, str]] = {}
    while at < len(data):
        found = at_marker(data, at) if data[at] in (0xFD, 0xFE) else None
        if found is not None and found.name:
            out.append(found)
            at = found.end
        else:
            if found is not None and not out:
                templates.setdefault(found.code, found.values)
            at += 1
    for r in out:
        for label in ("Width", "Height"):
            size = templates.get(r.code, {}).get(label) or SIZES.get(r.code, {}).get(label)
            if size is not None:
                r.values.setdefault(label, size)
    return out


def packed_records(data: bytes) -> list[Record]:
    """All named records of a packed design stream, in order; bytes that belong to no record are passed over."""
    return _records(data, record_at)


def design_records(data: bytes) -> list[Record]:
    """All named records of a design stream of either framing."""
    if len(data) > 1 and u16(data, 0) == WIDE and (wide := _records(data, wide_record_at)):
        return wide
    return packed_records(data)
