"""Restoring garbled text: round trips through wrong decodings, and nothing found in right text."""

import pytest

from tamarack.llm import mojibake

CLEAN = ["Größe wählen", "Señal de retención", "Номер накладной", "提单号码", "データ一覧", "Błędny numer przesyłki", "Café – réservé", "Sjøfrakt på vei", "Ação concluída"]
DECOYS = ["SÃO VALENTE", "ÕES", "10 µm ± 2°", "Prix © ®", "№ 14", "Ligação À VISTA", "Was ist das??", "plain text", "“Entwurf” löschen", "Âmbito"]


def garble(text, written, read, errors="replace"):
    raw = text.encode(written)
    if read in ("cp1252", "cp1250"):
        return "".join(bytes([b]).decode(read) if bytes([b]).decode(read, "ignore") else chr(b) for b in raw)
    return raw.decode(read, errors)


CASES = [
    ("Größe wählen", "utf-8", "latin_1"), ("Señal de retención", "utf-8", "cp1252"), ("Номер накладной", "utf-8", "cp1252"), ("提单号码", "utf-8", "cp437"), ("データ一覧", "utf-8", "mac_roman"),
    ("Café – réservé", "utf-8", "cp1251"), ("Größe wählen", "cp1252", "cp1251"), ("Номер накладной", "cp1251", "latin_1"), ("提单号码", "gbk", "latin_1"), ("Błędny numer przesyłki", "cp1250", "cp1252"), ("Sjøfrakt på vei", "utf-8", "gbk"), ("データ一覧", "cp932", "latin_1"),
]


@pytest.fixture(scope="module")
def restored(spark):
    texts = [t for t in CLEAN + DECOYS for _ in range(60)] + [garble(*c) for c in CASES] + [garble("Sjøfrakt på vei", "latin_1", "utf-8"), garble(garble("Señal de retención", "utf-8", "cp1252"), "utf-8", "cp1252"), None, "", "lost � here"]
    df = spark.createDataFrame([(t, 1) for t in texts], "text string, restored int")
    return {r["text"]: r for r in mojibake.restore_texts(df).collect()}


def test_every_channel_round_trips(restored):
    for case in CASES:
        assert restored[garble(*case)]["restored"] == case[0], case
        assert restored[garble(*case)]["complete"]


def test_lost_bytes_and_double(restored):
    assert restored["Sj�frakt p� vei"]["restored"] == "Sjøfrakt på vei"
    assert restored[garble(garble("Señal de retención", "utf-8", "cp1252"), "utf-8", "cp1252")]["restored"] == "Señal de retención"
    assert not restored["lost � here"]["complete"]


def test_right_text_is_no_case(restored):
    assert not set(CLEAN + DECOYS) & set(restored)


def test_viterbi_keeps_one_channel():
    lattice = [{"a": (3.0, "x"), "b": (2.9, "y")}, {"b": (2.0, "z")}, {}]
    assert mojibake.viterbi(["é", "è", "plain"], lattice)[:2] == ["b", "b"]
    assert mojibake.viterbi(["ok"], [{}]) == [""]


def test_utf8_lattice_holds_wildcards():
    assert mojibake._utf8_lattice("né".encode()) == ("né", 1, 0)
    assert mojibake._utf8_lattice(b"\xc5adunek") == (mojibake.WILD + "adunek", 0, 1)
    assert mojibake._utf8_lattice(b"\xff") is None


def test_fields(spark):
    controls = spark.createDataFrame([(1, "GrÃ¶ÃŸe", None, ""), (1, "GrÃ¶ÃŸe", None, ""), (2, "Größe", "x", None), (None, "GrÃ¶ÃŸe", None, None)], "control_id long, caption string, control_tip_text string, status_bar_text string")
    forms = spark.createDataFrame([(1, "x" * 100_000), (3, "MenÃ¼")], "form_id long, caption string")
    got = {(r["record_kind"], r["record_id"], r["field_name"], r["restored"]) for r in mojibake.damaged_fields(mojibake.form_texts(controls, forms)).collect()}
    assert got == {("control", 1, "caption", "Größe"), ("form", 3, "caption", "Menü")}
    assert mojibake.damaged_fields(mojibake.form_texts(controls.limit(0), forms.limit(0))).count() == 0


def test_repetition_does_not_hide_damage(spark):
    counts = {"MenÃ¼": 1, "MÃ¼ller": 3, "KÃ¶ln": 10_000, "GrÃ¶n": 600, "Grön": 2}
    right = {"São": 10_000, "Âmbito": 3, "Ligação": 500, "№": 40, "тип": 50, "сад": 2000, "通": 30, "PÓŁ": 20, "накладной": 900}
    df = spark.createDataFrame([(t,) for w in (counts, right) for t, n in w.items() for _ in range(n)], "text string")
    got = {r["text"]: r["restored"] for r in mojibake.restore_texts(df).collect()}
    assert got == {"MenÃ¼": "Menü", "MÃ¼ller": "Müller", "KÃ¶ln": "Köln", "GrÃ¶n": "Grön"}


def test_corpus_words_fill_wildcards(spark):
    rows = [("貨物番号",)] * 3 + [("è²¨ç‰©ç•ªå·",), ("100%_貨物番号",), ("100%_è²¨ç‰©ç•ªå·",)]
    got = {r["text"]: (r["restored"], r["complete"]) for r in mojibake.restore_texts(spark.createDataFrame(rows, "text string")).collect()}
    assert got == {"è²¨ç‰©ç•ªå·": ("貨物番号", True), "100%_è²¨ç‰©ç•ªå·": ("100%_貨物番号", True)}


def test_plain_words_beside_frequent_ones_with_signs_are_right(spark):
    # 2 is what some channels leave of 2°, No of Não, however much more frequent these are
    rows = [(f"10 µm ± 2° {k}",) for k in range(400)] + [(f"Não confirmado {k}",) for k in range(400)] + [("Hold date 2",), ("No data",), ("Menu",)] + [(f"Menü {k}",) for k in range(300)]
    assert mojibake.restore_texts(spark.createDataFrame(rows, "text string")).collect() == []
