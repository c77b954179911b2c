import struct

from tamarack.sources.jet import forms
from tamarack.sources.jet.records import colour, design_records, packed_records
from tests.test_jet_forms import listing


def text(tag, value):
    raw = value.encode("utf-16-le")
    return bytes([tag, len(raw)]) + raw


def word(tag, value):
    return bytes([tag]) + struct.pack("<H", value & 0xFFFF)


def dword(tag, value):
    return bytes([tag]) + struct.pack("<I", value)


BOX = b"\xfd\x6d\x00\x02\x32\x02\x37\xd7\x3b\x01\x43\x00" + word(0x60, -15) + word(0x61, 2340) + word(0x62, 2820) + word(0x63, 660) + word(0x6B, 3) + dword(0x9C, 0x00FFCC88) + dword(0x9F, 0x80000008) + text(0xDC, "txtOne") + text(0xDD, "house_no") + text(0xE8, "Tahoma") + bytes([0xE7, 16]) + bytes(range(16))
COMBO = b"\xfe\x6f\x00\x04" + word(0x60, 2) + word(0x61, 8) + word(0x63, 100) + word(0x64, 200) + word(0x65, 300) + word(0x66, 255) + dword(0x9C, 0) + text(0xDC, "cbo") + text(0xDF, "SELECT 1") + text(0xE0, "1;2")
SECTION = b"\xfd\x98\x00\x33\x01" + word(0x60, 5000) + dword(0x9C, 0x0000FF) + text(0xDC, "Detail")


def test_records():
    data = b"\x14\x00noise\xfd\x01" + BOX + b"\xff\x00junk" + COMBO + SECTION + b"\xfd\x6d\x00"
    box, combo, section = packed_records(data)
    assert box.name == "txtOne" and box.values == {"Locked": "true", "ScrollBars": "2", "TextAlign": "1", "BackStyle": "0", "Left": "-15", "Top": "2340", "Width": "2820", "Height": "660", "TabIndex": "3", "BackColor": "#88CCFF", "ForeColor": "#80000008", "ControlSource": "house_no", "FontName": "Tahoma"}
    assert combo.values == {"Locked": "true", "ColumnCount": "2", "ListRows": "8", "Left": "100", "Top": "200", "Width": "300", "Height": "255", "BoundColumn": "1", "RowSource": "SELECT 1", "ColumnWidths": "1;2"}
    assert section.values == {"SpecialEffect": "1", "Height": "5000", "BackColor": "#FF0000"}


def test_cut_and_nameless_records():
    assert packed_records(b"") == [] and packed_records(BOX[:20]) == []
    for cut in range(len(BOX)):
        packed_records(BOX[:cut])
    assert colour(0x123456) == "#563412"


def test_subform_source_without_start():
    data = b"\xfd\x70\x00\x04" + word(0x62, 9) + text(0xDC, "sub") + text(0xDD, "Form.inner") + text(0xDE, "a;b")
    assert packed_records(data)[0].values == {"CanShrink": "true", "Width": "9", "SourceObject": "inner", "LinkChildFields": "a;b"}


def test_design_takes_packed_values():
    types = listing((0x1898, 0, "Detail", ""), (0x126D, 1, "TXTONE", ""), (0x136F, 2, "cbo", ""))
    design = forms.form_design("F", 1, types, b"\x0b\x00" + bytes(12) + BOX + COMBO + SECTION)
    by_name = {c.name: {p.name: p for p in c.properties} for c in design.controls}
    assert by_name["TXTONE"]["Left"].value == "-15" and by_name["TXTONE"]["Left"].id == 0x36 and by_name["TXTONE"]["BackColor"].value_type == "Color"
    assert by_name["cbo"]["ColumnWidths"].value_type == "Text" and by_name["Detail"]["Height"].value == "5000"


def widened(record, inner=b""):
    """A packed record in the wide framing, with other kinds for numbers, texts and bytes."""
    out = bytearray(struct.pack("<IH", record[0], record[1]))
    at = 3
    while at < len(record):
        tag = record[at]
        if tag >= 0xC0:
            raw = record[at + 2 : at + 2 + record[at + 1]]
            at += 2 + len(raw)
            kind = 10 if tag != 0xE7 else 11
        else:
            width = 0 if tag < 0x30 else 1 if tag < 0x60 else 2 if tag < 0x9C else 4
            raw = record[at + 1 : at + 1 + width]
            at += 1 + width
            kind = {0: 1, 1: 2, 2: 3, 4: 4}[width]
        out += struct.pack("<IHIII", tag, 7, kind, 4, len(raw)) + raw
    if inner:
        out += struct.pack("<IHIII", 0xE9, 9, 11, 0, len(inner)) + inner
    return bytes(out)


def test_wide_framing_gives_the_same_records():
    packed = BOX + COMBO + SECTION
    wide = b"\x14\x00" + bytes(8) + widened(BOX) + b"noise\xfd\x00\x00" + widened(COMBO) + widened(SECTION)
    strip = lambda records: [(r.code, r.name, r.values) for r in records]
    assert strip(design_records(wide)) == strip(design_records(packed)) == strip(packed_records(packed))
    # inner controls stand in a long binary value of their tab
    inner = bytes(200) + widened(BOX) + bytes(60)
    assert strip(design_records(b"\x14\x00" + widened(SECTION, inner) + widened(COMBO))) == strip(packed_records(SECTION + BOX + COMBO))
    for cut in range(0, len(wide), 7):
        design_records(wide[:cut])
    # a type of its own may stand before the items, and a packed stream may start with the same word
    twice = widened(COMBO)
    assert strip(design_records(b"\x14\x00" + twice[:6] + b"\x70\x00" + twice[6:])) == strip(packed_records(COMBO))
    assert strip(design_records(b"\x14\x00" + BOX)) == strip(packed_records(BOX))


def test_templates_and_the_designers_sizes():
    button, combo, line = (bytes([0xFD, code, 0]) + text(0xDC, name) for code, name in ((0x68, "go"), (0x6F, "pick"), (0x65, "frame")))
    values = lambda data: {r.name: (r.values.get("Width"), r.values.get("Height")) for r in design_records(data)}
    assert values(button + combo + line) == {"go": (None, "360"), "pick": ("1440", None), "frame": (None, "720")}
    templates = b"\xfd\x68\x00" + word(0x63, 420) + b"\xfd\x6f\x00\x32\x02" + word(0x65, 900) + word(0x66, 270) + b"\xfd\x65\x00\x31\x03\x32\x00"
    assert values(templates + button + combo + line) == {"go": (None, "420"), "pick": ("900", "270"), "frame": (None, "720")}
    # what a record says itself stays, and a nameless record behind the first control is none's template
    assert values(combo[:3] + word(0x65, 77) + combo[3:] + b"\xfd\x6f\x00" + word(0x65, 900) + b"\xfd\x6f\x00" + text(0xDC, "late")) == {"pick": ("77", None), "late": ("1440", None)}
