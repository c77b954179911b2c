"""Form designs over synthetic streams."""

import struct
import uuid

import pytest

from tamarack.sources.jet import forms
from tamarack.sources.jet.compound import Compound
from tamarack.sources.jet.pages import JetError
from tamarack.sources.jet.tables import JetFile
from tamarack.sources.jet.writer import JetWriter


def text_property(ident, text):
    raw = text.encode("utf-16-le")
    return struct.pack("<HIII", ident, 10, 0, len(raw)) + raw + bytes(4)


def number_property(ident, kind, raw):
    return struct.pack("<HIII", ident, kind, 0, 0) + raw + bytes(forms.VALUE_TYPES[kind][1] - len(raw))


BLOB = bytes(14) + text_property(0x11, "My form") + number_property(0x96, 3, struct.pack("<i", 5040)) + b"\xee" * 20 + (
    text_property(0x14, "txtOne") + number_property(0x1C, 4, struct.pack("<I", 0xFF123456)) + number_property(0x94, 1, struct.pack("<I", 1)) + number_property(0x08, 8, struct.pack("<d", 2.5)) + number_property(0x77, 9, uuid.UUID(int=5).bytes_le) + number_property(0x25, 2, struct.pack("<h", -4))
) + (text_property(0x14, "Detail") + struct.pack("<HIII", 7, 11, 0, 3) + b"abc" + bytes(4))


def listing(*controls):
    out = struct.pack("<IIII", forms.CONTROLS_MAGIC, 0, 0, len(controls)) + bytes(16)
    for code, index, a, b in controls:
        out += struct.pack("<HHI", code, 0, index) + a.encode("cp932") + b"\0" + b.encode("cp932") + b"\0"
    return out


TYPES = listing((0x1898, 0, "Detail", ""), (0x126D, 1, "ev", "txtOne"), (forms.INTERNAL_TYPE, 2, "x", ""), (0x0C64, 3, "ラベル", ""), (0xABCD, 4, "odd", ""))
DIRECTORY = b"\0\0\0\0" + b"".join(b"\x04" + bytes([len(n) * 2 + 4]) + n.encode("utf-16-le") + struct.pack("<HH", i, 0) for n, i in (("Main", 7), ("Other", 8)))


def test_control_list_and_directory():
    got = [(c.name, c.type, c.index) for c in forms.control_list(TYPES)]
    assert got == [("Detail", "Detail", 0), ("txtOne", "TextBox", 1), ("ラベル", "Label", 3), ("odd", "Unknown_0xABCD", 4)]
    assert len(forms.control_list(TYPES, True)) == 5
    assert forms.form_directory(DIRECTORY) == {"Main": 7, "Other": 8}
    for bad in (b"", TYPES[:40], struct.pack("<IIII", forms.CONTROLS_MAGIC, 0, 0, 99) + bytes(16)):
        with pytest.raises(JetError):
            forms.control_list(bad)
    with pytest.raises(JetError):
        forms.form_directory(b"\0\0\0\0\x04\x01")


def test_property_arrays():
    own, groups = forms.property_arrays(BLOB)
    assert [(p.name, p.value) for p in own] == [("Caption", "My form"), ("Width", "5040")]
    assert [(p.name, p.value_type, p.value) for p in groups[0]] == [("Name", "Text", "txtOne"), ("BackColor", "Color", "#123456"), ("Visible", "Bool", "true"), ("BorderColor", "Double", "2.5"), ("0x0077", "Guid", "{00000000-0000-0000-0000-000000000005}"), ("FontWeight", "Short", "-4")]
    assert groups[1][1].raw == b"abc" and groups[1][1].value == "(3 bytes)"
    assert forms.property_arrays(b"") == ([], [])
    design = forms.form_design("Main", 7, TYPES, BLOB)
    assert design.controls[1].section == "Detail" and design.controls[1].properties[1].value == "#123456"


def compound(streams):
    """A compound file with one level of folders, all streams in sectors of their own."""
    folders = sorted({p.rsplit("/", 1)[0] for p in streams})
    nodes = [("Root Entry", 5, b"", [])]
    index = {"": 0}
    for path in sorted({"/".join(f.split("/")[: k + 1]) for f in folders for k in range(len(f.split("/")))}):
        index[path] = len(nodes)
        nodes.append((path.rsplit("/", 1)[-1], 1, b"", []))
        nodes[index[path.rsplit("/", 1)[0] if "/" in path else ""]][3].append(index[path])
    for path, data in streams.items():
        nodes[index[path.rsplit("/", 1)[0]]][3].append(len(nodes))
        nodes.append((path.rsplit("/", 1)[-1], 2, data.ljust(5000, b"\0"), []))
    sectors, fat, first = [], [], {}
    for k, (_, kind, data, _) in enumerate(nodes):
        if kind == 2:
            first[k] = len(sectors)
            parts = [data[i : i + 512].ljust(512, b"\0") for i in range(0, len(data), 512)]
            fat += [len(sectors) + i + 1 for i in range(len(parts) - 1)] + [0xFFFFFFFE]
            sectors += parts
    directory = b""
    siblings = {}
    for _, _, _, children in nodes:
        for a, b in zip(children, children[1:]):
            siblings[a] = b
    for k, (name, kind, data, children) in enumerate(nodes):
        raw = (name + "\0").encode("utf-16-le")
        e = bytearray(raw.ljust(128, b"\0"))
        struct.pack_into("<HB", e, 64, len(raw), kind)
        struct.pack_into("<III", e, 68, 0xFFFFFFFF, siblings.get(k, 0xFFFFFFFF), children[0] if children else 0xFFFFFFFF)
        struct.pack_into("<II", e, 116, first.get(k, 0xFFFFFFFE), len(data))
        directory += bytes(e)
    at = len(sectors)
    parts = [directory[i : i + 512].ljust(512, b"\0") for i in range(0, len(directory), 512)]
    fat += [at + i + 1 for i in range(len(parts) - 1)] + [0xFFFFFFFE]
    sectors += parts
    fat_at = len(sectors)
    count = -(-(len(fat) + 4) // 128)
    fat += [0xFFFFFFFD] * count
    table = b"".join(struct.pack("<I", x) for x in fat).ljust(512 * count, b"\xff")
    sectors += [table[i : i + 512] for i in range(0, len(table), 512)]
    head = bytearray(512)
    head[:8] = bytes.fromhex("d0cf11e0a1b11ae1")
    struct.pack_into("<HHHHH", head, 24, 0x3E, 3, 0xFFFE, 9, 6)
    struct.pack_into("<IIIIIIII", head, 44, count, at, 0, 4096, 0xFFFFFFFE, 0, 0xFFFFFFFE, 0)
    for k in range(109):
        struct.pack_into("<I", head, 76 + 4 * k, fat_at + k if k < count else 0xFFFFFFFF)
    return bytes(head) + b"".join(sectors)


STREAMS = {"Forms/DirData": DIRECTORY, "Forms/7/TypeInfo": TYPES, "Forms/7/Blob": BLOB, "Forms/8/TypeInfo": TYPES}


def test_compound():
    entries = {e.path: e for e in Compound(compound(STREAMS)).entries()}
    assert set(entries) == {"Forms", "Forms/7", "Forms/8", *STREAMS}
    assert entries["Forms/7/Blob"].data.startswith(BLOB) and entries["Forms"].is_dir
    with pytest.raises(JetError):
        Compound(b"nothing" * 100)


def object_store(path):
    w = JetWriter()
    data = b"junk" + compound(STREAMS)
    parts = [data[k : k + 3000] for k in range(0, len(data), 3000)]
    rows = [(k, w.long(p, 1)) for k, p in enumerate(parts)]
    w.table("MSysAccessObjects", [("ID", 4), ("Data", 11)], list(reversed(rows)), flags=0x80000000)
    names = ["Description", "GUID", "Hidden"]
    body = b"".join(struct.pack("<H", len(n.encode("utf-16-le"))) + n.encode("utf-16-le") for n in names)
    kkd = b"KKD\0" + struct.pack("<IH", len(body) + 6, 0x80) + body
    value = lambda n, code, raw: struct.pack("<HBBHH", 8 + len(raw), 0, code, n, len(raw)) + raw
    block = struct.pack("<IH", 6, 0) + value(0, 12, "héllo".encode("utf-16-le")) + value(1, 9, uuid.UUID(int=9).bytes_le) + value(2, 1, b"\1")
    kkd += struct.pack("<IH", len(block) + 6, 0) + block
    w.object(55, "Main", -32768, 0, kkd)
    return w.save(path)


def test_forms_of_a_file(spark, tmp_path):
    path = object_store(tmp_path / "f.mdb")
    with JetFile(path) as f:
        designs = {d.form_name: d for d in forms.read_forms(f)}
        assert set(designs) == {"Main", "Other"} and designs["Main"].properties[0].value == "My form"
        assert [d.form_name for d in forms.read_forms(f, ["MAIN"])] == ["Main"]
        assert [r[5:] for r in forms.form_properties(f)] == [("Description", "héllo"), ("GUID", "{00000000-0000-0000-0000-000000000009}"), ("Hidden", "yes")]
    (tmp_path / "bad.mdb").write_bytes(b"x")
    rows = {r["form_name"]: r for r in forms.form_table(spark, [path, str(tmp_path / "bad.mdb")]).collect()}
    assert rows["Main"]["controls"][1]["properties"][0]["value"] == "txtOne" and rows[None]["error"]


def test_tree_store(tmp_path):
    w = JetWriter()
    rows = [(1, 1, "root", 1, None), (2, 1, "\x03Forms", 1, None), (3, 2, "DirData", 2, w.long(DIRECTORY)), (4, 2, "7", 1, None), (5, 4, "TypeInfo", 2, w.long(TYPES)), (6, 4, "Blob", 2, w.long(BLOB, 1))]
    w.table("MSysAccessStorage", [("Id", 4), ("ParentId", 4), ("Name", 10), ("Type", 4), ("Lv", 11)], rows, flags=0x80000000)
    with JetFile(w.save(tmp_path / "t.mdb")) as f:
        assert f.format_name() == "Access 2003"
        assert [d.form_name for d in forms.read_forms(f)] == ["Main"]
    for bad in ([(1, 2, "a", 1, None), (2, 1, "b", 1, None)], [(1, 9, "a", 1, None)], [(1, 1, "a", 1, None), (1, 1, "a", 1, None)], [(1, 1, "r", 1, None), (2, 1, "", 2, None)], [(1, 1, "r", 1, None), (2, 1, "x", 7, None)]):
        with pytest.raises(JetError):
            forms.tree_entries(bad)


def test_no_store(tmp_path):
    w = JetWriter()
    with JetFile(w.save(tmp_path / "n.mdb")) as f, pytest.raises(JetError):
        forms.read_forms(f)
    with JetFile(str(tmp_path / "n.mdb")) as f, pytest.raises(JetError):
        forms.property_blocks(f, b"????")
