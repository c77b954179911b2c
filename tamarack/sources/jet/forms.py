"""Form designs of a database file: property blocks, design streams, controls.

Read here: the property blocks of the catalog (LvProp), the object store in
both its forms, the directory of forms, the list of controls, the property
arrays of the design stream, and the packed records of Jet 4 controls.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from tamarack.sources.jet.compound import MAGIC, Compound, Entry
from tamarack.sources.jet.pages import JetError, u16, u32
from tamarack.sources.jet.records import COLOURS, design_records
from tamarack.sources.jet.tables import FORM_OBJECT, JetColumn, JetFile

# Control type codes of the list of controls.
CONTROL_TYPES = {
    0x066A: "CheckBox", 0x0769: "OptionButton", 0x0A7A: "ToggleButton", 0x0B68: "Button", 0x0C64: "Label", 0x0D64: "Label", 0x1B64: "Label", 0x0E65: "Rectangle", 0x1B65: "Rectangle",
    0x0F67: "Image", 0x1B67: "Image", 0x116B: "OptionGroup", 0x126D: "TextBox", 0x1B6D: "TextBox", 0x136F: "ComboBox", 0x1B6F: "ComboBox", 0x1470: "SubForm", 0x1B70: "SubReport", 0x1666: "Line", 0x1B66: "Line",
    0x1898: "Detail", 0x1998: "Detail", 0x1899: "FormHeader", 0x189A: "FormFooter", 0x1999: "ReportHeader", 0x199A: "ReportFooter", 0x199D: "GroupHeader", 0x199E: "GroupFooter", 0x1F9B: "PageHeader", 0x1F9C: "PageFooter",
    0x207B: "TabControl", 0x217C: "TabPage", 0x247F: "EmptyCell",
}
SECTIONS = frozenset(("Detail", "FormHeader", "FormFooter", "ReportHeader", "ReportFooter", "GroupHeader", "GroupFooter", "PageHeader", "PageFooter"))
INTERNAL_TYPE = 0x1EFF
CONTROLS_MAGIC = 0xACCDEAF7
# Names of the design properties by number.
PROPERTY_NAMES = {
    0x0004: "SpecialEffect", 0x0007: "Picture", 0x0008: "BorderColor", 0x0009: "BorderStyle", 0x000A: "BorderWidth", 0x000B: "BorderLineStyle", 0x000D: "BoundColumn", 0x000E: "CanGrow", 0x0010: "CanShrink", 0x0011: "Caption", 0x0012: "ColumnWidths", 0x0014: "Name", 0x0015: "ControlType", 0x0016: "EventProcPrefix", 0x0017: "DefaultValue", 0x0019: "Enabled",
    0x001B: "ControlSource", 0x001C: "BackColor", 0x001D: "BackStyle", 0x0020: "FontBold", 0x0021: "FontItalic", 0x0022: "FontName", 0x0023: "FontSize", 0x0024: "FontUnderline", 0x0025: "FontWeight", 0x0026: "Format", 0x002C: "Height", 0x0031: "LinkChildFields", 0x0032: "LinkMasterFields", 0x0036: "Left", 0x0038: "Locked", 0x003A: "OptionValue",
    0x0045: "HideDuplicates", 0x0046: "ColumnCount", 0x0047: "DecimalPlaces", 0x0048: "InputMask", 0x005B: "RowSource", 0x005D: "RowSourceType", 0x0068: "OnKeyDown", 0x0069: "OnKeyUp", 0x006A: "OnKeyPress", 0x006B: "OnMouseDown", 0x006C: "OnMouseUp", 0x006D: "OnMouseMove", 0x0073: "OnGotFocus", 0x0074: "OnLostFocus", 0x007E: "OnClick",
    0x0082: "RunningSum", 0x0084: "SourceObject", 0x0087: "StatusBarText", 0x0088: "TextAlign", 0x008D: "Top", 0x0093: "DefaultView", 0x0094: "Visible", 0x0096: "Width", 0x0098: "ScrollBars", 0x0099: "ListRows", 0x009A: "ListWidth", 0x009C: "RecordSource", 0x00A0: "FontName", 0x00CC: "ForeColor", 0x00DE: "OnEnter", 0x00DF: "OnExit", 0x00E0: "OnDblClick",
    0x00ED: "Section", 0x00F5: "Filter", 0x0105: "TabIndex", 0x0106: "TabStop", 0x010A: "Tag", 0x013D: "ControlTipText", 0x0160: "PageIndex", 0x01DC: "TextFormat",
}
#: Property value types -> name and the bytes after the 14-byte head of a value without a length.
VALUE_TYPES = {1: ("Bool", 4), 2: ("Short", 5), 3: ("Long", 6), 6: ("Long", 6), 4: ("Color", 8), 8: ("Double", 12), 9: ("Guid", 20)}
GROUP_START = b"\x14\x00\x0a\x00\x00\x00"


@dataclass(frozen=True)
class Property:
    id: int
    name: str
    value_type: str
    value: str
    raw: bytes = b""


@dataclass(frozen=True)
class Control:
    name: str
    type: str
    type_code: int
    index: int
    section: str = ""
    properties: tuple[Property, ...] = ()


@dataclass(frozen=True)
class FormDesign:
    form_name: str
    storage_id: int
    properties: tuple[Property, ...] = ()
    controls: tuple[Control, ...] = field(default=())


def property_blocks(file: JetFile, data: bytes) -> dict[str, dict[str, str]]:
    """Blocks of a catalog property value (LvProp): block name ('' for the object) -> property -> text.

    Booleans read yes or no, binary values by their length; parts that are
    cut short end the block.
    """
    if data[:4] not in (b"KKD\0", b"MR2\0"):
        raise JetError("an unknown property format")
    names: list[str] = []
    out: dict[str, dict[str, str]] = {}
    at = 4
    while at + 6 <= len(data):
        length, kind = u32(data, at), u16(data, at + 4)
        if length < 6:
            break
        body = data[at + 6 : at + length]
        if kind == 0x80:
            names, k = [], 0
            while k + 2 <= len(body):
                n = u16(body, k)
                names.append(file.text(body[k + 2 : k + 2 + n]))
                k += 2 + n
        elif kind in (0, 1, 2) and len(body) >= 6:
            n = u16(body, 4)
            block = out.setdefault(file.text(body[6 : 6 + n]) if n else "", {})
            k = 6 + n
            while k + 8 <= len(body):
                size, code, which, width = u16(body, k), body[k + 3], u16(body, k + 4), u16(body, k + 6)
                if which >= len(names) or k + 8 + width > len(body) or size < 8:
                    break
                raw = body[k + 8 : k + 8 + width]
                name = names[which]
                if code == 9 and width == 16 and name == "GUID":
                    code = 15
                if code == 1:
                    text = "yes" if raw[:1] not in (b"", b"\0") else "no"
                elif code in (9, 11):
                    text = f"(binary data of length {width})"
                else:
                    value = file.value(JetColumn(name, 10 if code == 12 else code, 0, 0, 0, width, True), raw) if width else ""
                    text = str(value)
                block[name] = text
                k += size
        at += length
    return out


def object_entries(file: JetFile) -> list[Entry]:
    """Folders and streams of the object store: a compound file cut over rows in ID order, or rows that form a tree."""
    names = {o.name.lower(): o.name for o in file.objects() if o.type == 1}
    if "msysaccessstorage" in names:
        table = file.table(names["msysaccessstorage"])
        rows = list(file.rows(table, columns=table.pick(["Id", "ParentId", "Name", "Type", "Lv"])))
        return tree_entries(rows)
    if "msysaccessobjects" not in names:
        raise JetError("the file has no store of Access objects")
    table = file.table(names["msysaccessobjects"])
    whole = bytearray()
    for _, data in sorted((r for r in file.rows(table, columns=table.pick(["ID", "Data"])) if r[0] is not None), key=lambda r: r[0]):
        data = data or b""
        if not whole:
            start = data.find(MAGIC)
            data = data[start:] if start >= 0 else b""
        whole += data
    return Compound(bytes(whole)).entries()


def tree_entries(rows: list[tuple]) -> list[Entry]:
    """Entries of (id, parent id, name, type, data) rows; a row that is its own parent is the root."""
    by_id: dict[int, tuple] = {}
    for r in rows:
        if r[0] in by_id:
            raise JetError(f"the object store has two rows {r[0]}")
        by_id[r[0]] = r
    clean = lambda name: (name or "").lstrip("".join(map(chr, range(32))))
    out = []
    for ident, parent, name, kind, data in rows:
        if ident == parent:
            continue
        if kind not in (1, 2):
            raise JetError(f"object store row {ident} has the unknown type {kind}")
        parts, at, seen = [], ident, set()
        while by_id.get(at, (None,))[0] is not None and by_id[at][1] != at:
            if at in seen:
                raise JetError(f"the object store's parents run in a circle at {at}")
            seen.add(at)
            if not clean(by_id[at][2]):
                raise JetError(f"object store row {at} has no name")
            parts.append(clean(by_id[at][2]))
            at = by_id[at][1]
        if at not in by_id:
            raise JetError(f"object store row {at} is missing")
        out.append(Entry("/".join(reversed(parts)), clean(name), kind == 1, len(data or b""), data or b""))
    return out


def form_directory(data: bytes) -> dict[str, int]:
    """Names of the forms and the numbers of their folders.

    An entry is 4, a length, the UTF-16 name, the number and 0; a long name's
    entry runs on to the next 0.
    """
    out: dict[str, int] = {}
    at = 4
    while at + 2 <= len(data) and data[at] == 4:
        end = at + 2 + data[at + 1]
        if data[at + 1] < 4 or end > len(data):
            raise JetError(f"a form directory entry is broken at {at}")
        if u16(data, end - 2):
            while end + 2 <= len(data) and u16(data, end):
                end += 2
            if end + 2 > len(data):
                raise JetError(f"a form directory entry doesn't end at {at}")
            end += 2
        name = data[at + 2 : end - 4].decode("utf-16-le", "replace").strip()
        if name:
            out[name] = u16(data, end - 4)
        at = end
    return out


def control_list(data: bytes, internal: bool = False) -> list[Control]:
    """Controls of a form: head of 32 bytes, then code, index and two names each, of which the second counts if given."""
    if len(data) < 32 or u32(data, 0) != CONTROLS_MAGIC:
        raise JetError("no list of controls")
    count = u32(data, 12)
    if count > (len(data) - 32) // 8:
        raise JetError(f"a list of {count} controls is too long")
    out, at = [], 32
    for _ in range(count):
        if at + 8 > len(data):
            raise JetError("a list of controls is cut short")
        code, index = u16(data, at), u32(data, at + 4)
        at += 8
        names = []
        for _ in range(2):
            end = data.find(b"\0", at)
            if end < 0:
                raise JetError("a control's name is cut short")
            names.append(data[at:end])
            at = end + 1
        if code == INTERNAL_TYPE and not internal:
            continue
        raw = names[1] or names[0]
        try:
            name = raw.decode("cp932")
        except UnicodeDecodeError:
            name = raw.decode("utf-8", "replace")
        out.append(Control(name, CONTROL_TYPES.get(code, f"Unknown_0x{code:04X}"), code, index))
    return out


def property_at(data: bytes, at: int, end: int) -> tuple[Property, int] | None:
    """The property at an offset of the design stream, and where the next starts."""
    if at < 0 or at + 14 > end or end > len(data):
        return None
    ident, kind, length, start = u16(data, at), u32(data, at + 2), u32(data, at + 10), at + 14
    name = PROPERTY_NAMES.get(ident, f"0x{ident:04X}")
    if kind in VALUE_TYPES:
        label, width = VALUE_TYPES[kind]
        if start + width > end:
            return None
        raw = data[start : start + width]
        if kind == 1:
            value = "true" if u32(raw, 0) else "false"
        elif kind == 2:
            value = str(struct.unpack_from("<h", raw)[0])
        elif kind in (3, 6):
            value = str(struct.unpack_from("<i", raw)[0])
        elif kind == 4:
            value = f"#{u32(raw, 0) & 0xFFFFFF:06X}"
        elif kind == 8:
            number = struct.unpack_from("<d", raw)[0]
            value = str(int(number)) if number == int(number) and abs(number) < 1e6 else repr(number)
        else:
            value = "{" + str(uuid.UUID(bytes_le=raw[:16])).upper() + "}"
        return Property(ident, name, label, value), start + width
    if kind in (10, 11, 12):
        if start + length + 4 > end:
            return None
        raw = data[start : start + length]
        if kind == 11:
            return Property(ident, name, "Binary", f"({length} bytes)", raw), start + length + 4
        return Property(ident, name, "Text", raw.decode("utf-16-le", "replace").rstrip("\0")), start + length + 4
    return None


def property_arrays(data: bytes) -> tuple[list[Property], list[list[Property]]]:
    """The form's own properties, and the group of each control; a group starts with a name."""

    def run(at: int, end: int) -> tuple[list[Property], int]:
        out = []
        while (found := property_at(data, at, end)) is not None:
            out.append(found[0])
            at = found[1]
        return out, at

    if len(data) < 14:
        return [], []
    own, at = run(14, len(data))
    starts = []
    while (at := data.find(GROUP_START, at)) >= 0:
        starts.append(at)
        at += len(GROUP_START)
    groups = [run(s, e)[0] for s, e in zip(starts, [*starts[1:], len(data)])]
    return own, [g for g in groups if g]


_IDS = {name: ident for ident, name in reversed(PROPERTY_NAMES.items())}


def _packed(name: str, value: str) -> Property:
    """A packed record's value as a property."""
    number = value.lstrip("-").isdigit()
    kind = "Color" if name in COLOURS else "Bool" if value == "true" else "Long" if number and not name.endswith(("Text", "Caption", "Tag", "Format")) else "Text"
    return Property(_IDS.get(name, 0), name, kind, value)


def form_design(name: str, storage_id: int, controls: bytes, design: bytes) -> FormDesign:
    """A form of its streams.

    A control takes the property group of its name, else the one of its place,
    what its packed record adds, and the section before it.
    """
    listed = control_list(controls)
    own, groups = property_arrays(design)
    by_name: dict[str, list[Property]] = {}
    for g in groups:
        label = next((p.value for p in g if p.id == 0x14), "")
        by_name.setdefault(label.lower(), g)
    packed: dict[tuple[str, int], dict[str, str]] = {}
    for r in design_records(design):
        packed.setdefault((r.name.lower(), r.code), r.values)
    out, section = [], ""
    for k, c in enumerate(listed):
        if c.type in SECTIONS:
            section = c.name
        props = by_name.get(c.name.lower()) or (groups[k] if k < len(groups) and not any(p.id == 0x14 for p in groups[k]) else [])
        known = {p.name for p in props}
        props = [*props, *(_packed(n, v) for n, v in packed.get((c.name.lower(), c.type_code & 0xFF), {}).items() if n not in known)]
        out.append(Control(c.name, c.type, c.type_code, c.index, section, tuple(props)))
    return FormDesign(name, storage_id, tuple(own), tuple(out))


def read_forms(file: JetFile, names: list[str] | None = None) -> list[FormDesign]:
    """Designs of the forms of a file, all by default."""
    entries = {e.path: e for e in object_entries(file) if not e.is_dir}
    listing = next((e for p, e in entries.items() if p == "Forms/DirData" or p.endswith("/Forms/DirData")), None)
    if listing is None:
        raise JetError("the file has no directory of forms")
    root = listing.path[: -len("DirData")]
    out = []
    wanted = None if names is None else {n.lower() for n in names}
    for name, ident in form_directory(listing.data).items():
        if wanted is not None and name.lower() not in wanted:
            continue
        part = lambda leaf: entries[p].data if (p := f"{root}{ident}/{leaf}") in entries else b""  # noqa: B023, E731
        if part("TypeInfo"):
            out.append(form_design(name, ident, part("TypeInfo"), part("Blob")))
    return out


def form_properties(file: JetFile) -> list[tuple]:
    """(form, object type, flags, table page, block, property, value) of every form's catalog properties."""
    out = []
    for o in file.objects():
        if o.type == FORM_OBJECT and o.properties:
            for block, values in property_blocks(file, o.properties).items():
                out += [(o.name, o.type, o.flags, o.id & 0x00FFFFFF, block, k, v) for k, v in values.items()]
    return out


FORMS = "path string, form_name string, storage_id int, properties array<struct<id int, name string, value_type string, value string>>, controls array<struct<name string, type string, type_code int, ctl_index long, section string, properties array<struct<id int, name string, value_type string, value string>>>>, error string"


def form_table(spark: SparkSession, paths: list[str]) -> DataFrame:
    """One row per form of many database files, a file to a task; a file that can't be read gives a row with its error."""

    def shown(props) -> list[dict]:
        return [{"id": p.id, "name": p.name, "value_type": p.value_type, "value": p.value} for p in props]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for path in frame["path"]:
                try:
                    with JetFile(path) as f:
                        for d in read_forms(f):
                            rows.append((path, d.form_name, d.storage_id, shown(d.properties), [{"name": c.name, "type": c.type, "type_code": c.type_code, "ctl_index": c.index, "section": c.section, "properties": shown(c.properties)} for c in d.controls], None))
                except (JetError, OSError) as error:
                    rows.append((path, None, None, None, None, str(error)))
            yield pd.DataFrame(rows, columns=["path", "form_name", "storage_id", "properties", "controls", "error"]).astype({"storage_id": "Int32"})

    df = spark.createDataFrame([(p,) for p in paths], "path string")
    return df.repartition(max(1, len(paths))).mapInPandas(run, FORMS)
