import datetime as dt

import pytest

from tamarack.operators import drift

SCHEMA = "db_name string, file_name string, file_no int, table_name string, col_pos int, col_name string, col_type int, type_name string, loaded_at timestamp_ntz"
T0 = dt.datetime(2024, 1, 1)


def files(spark, *deliveries):
    rows = []
    for no, tables in enumerate(deliveries, 1):
        for t, cols in tables.items():
            for pos, (c, kind) in enumerate(cols, 1):
                code, name = kind if isinstance(kind, tuple) else (None, kind)
                rows.append(("d", f"F{no}.mdb ", no, t, pos, c, code, name, T0))
    return spark.createDataFrame(rows, SCHEMA)


def changes(spark, *deliveries):
    return {(r["file_name"], r["table_name"], r["col_name"], r["change_kind"]) for r in drift.schema_changes(files(spark, *deliveries)).collect()}


def test_each_kind_of_change(spark):
    one = {"T": [("a", "Text"), ("b", "INT"), ("c", "Memo"), ("d", "Byte")], "Old": [("x", "Text")], "Gone": [("q", "Date/Time"), ("r", "Byte")]}
    two = {" t": [("A ", "Short Text"), ("b2", "Integer"), ("c", (8, "Memo")), ("e", "Double")], "New": [("X", "TEXT")], "Came": [("z", "Byte")]}
    assert changes(spark, one, two) == {
        ("f2.mdb", "t", "b2", "renamed"),
        ("f2.mdb", "t", "c", "type_changed"),
        ("f2.mdb", "t", "d", "removed"),
        ("f2.mdb", "t", "e", "added"),
        ("f2.mdb", "new", "", "table_renamed"),
        ("f2.mdb", "gone", "", "table_removed"),
        ("f2.mdb", "came", "", "table_added"),
    }


def test_brackets_case_and_blanks_are_no_change(spark):
    assert changes(spark, {"[T 1]": [("[A]", "Text"), (" b ", "Long Integer")]}, {" t 1 ": [("a", "TEXT"), ("[B]", "longint")]}) == set()


def test_no_change_and_moves(spark):
    one = {"t": [("a", "Text"), ("b", "INT"), ("c", "MONEY")]}
    two = {"T ": [("c", "Currency"), ("A", (10, "?")), ("b", "Integer")]}
    assert changes(spark, one, one, two) == set()


def test_rename_needs_type_and_neighbours(spark):
    one = {"t": [("a", "Text"), ("b", "INT"), ("c", "Text")], "u": [("p", "Text"), ("q", "Text"), ("r", "Text")]}
    two = {"t": [("a", "Text"), ("x", "Text"), ("c", "Text")], "u": [("p", "Text"), ("r", "Text"), ("s", "Text")]}
    assert {c[3] for c in changes(spark, one, two)} == {"added", "removed"}


def test_rename_of_first_last_and_only_column(spark):
    one = {"t": [("a", "Text"), ("b", "INT"), ("c", "Text")], "u": [("p", "Text")]}
    two = {"t": [("a1", "Text"), ("b", "INT"), ("c1", "Text")], "u": [("p1", "Text")]}
    assert {(c[2], c[3]) for c in changes(spark, one, two)} == {("a1", "renamed"), ("c1", "renamed"), ("p1", "renamed")}


def test_empty_nulls_and_gap_in_numbers(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert drift.schema_changes(empty).count() == 0 and drift.consistent_layout(empty).count() == 0
    rows = [("d", "f1", 1, "t", 1, "a", None, None, T0), ("d", "f9", 9, "t", 1, "a", None, None, T0), ("d", "f9", 9, "t", 2, "b", 4, None, T0), ("d", "f9", 9, "t", 2, "b", 4, None, T0), (None, "f", 1, "t", 1, "z", 1, "x", T0), ("d", "f9", 9, "t", None, None, 1, "x", T0)]
    got = {tuple(r)[2:6] for r in drift.schema_changes(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {("f9", "t", "b", "added")}


def test_layout_follows_renames(spark):
    one = {"t": [("a", "Text"), ("b", "INT"), ("c", "Memo")]}
    two = {"t": [("a", "Text"), ("b2", "Integer"), ("c", "Memo")]}
    three = {"t": [("a", "Text"), ("b2", "Double"), ("c", "Memo")]}
    rows = {r["col_name"]: r for r in drift.consistent_layout(files(spark, one, two, three)).collect()}
    assert set(rows) == {"a", "b2", "c"}
    assert rows["b2"]["spark_type"] == "double" and rows["b2"]["n_files"] == 3 and rows["b2"]["first_file"] == "f1.mdb"


def test_unite(spark):
    a = spark.createDataFrame([("1", "x")], "K string, old string")
    b = spark.createDataFrame([(2, 3.5)], "k int, extra double")
    rows = drift.unite([a, b], [("k", "bigint"), ("new", "string"), ("extra", "double")], {"old": "new"}).collect()
    assert sorted(map(tuple, rows)) == [(1, "x", None), (2, None, 3.5)]
    with pytest.raises(ValueError):
        drift.unite([], [("k", "bigint")])


def test_extra_columns(spark):
    df = files(spark, {"t": [("a", "Text")]}, {"t": [("a", "Text"), ("b", "INT")]}).selectExpr("*", "1 as rank", "'x' as kind", "2 as next_no", "'y' as left_name")
    assert [r["change_kind"] for r in drift.schema_changes(df).collect()] == ["added"]


def test_scores_decide_which_table_was_renamed(spark, monkeypatch):
    one = {"a_tmp": [("x", "Text"), ("y", "INT")], "zeta": [("x", "Text"), ("y", "INT")]}
    two = {"zeta2": [("x", "Text"), ("y", "INT")]}
    got = changes(spark, one, two)
    assert got == {("f2.mdb", "zeta2", "", "table_renamed"), ("f2.mdb", "a_tmp", "", "table_removed")}
    # without likeness every score is the same, and the first by name is taken
    assert drift.flood_tables(["a_tmp", "zeta"], ["zeta2"])[0][:2] == ("zeta", "zeta2")
    monkeypatch.setattr(drift, "likeness", lambda a, b: 0.0)
    assert drift.flood_tables(["a_tmp", "zeta"], ["zeta2"])[0][:2] == ("a_tmp", "zeta2")


def column(name, old=None, new=None):
    side = lambda x: x and {"kind": x[0], "left_name": x[1], "right_name": x[2], "rank": x[3]}
    return {"col_name": name, "old": side(old), "new": side(new)}


def flooded(columns):
    return {(m["old_col_name"], m["new_col_name"]) for m in drift.flood_columns(columns) if m["old_col_name"] != m["new_col_name"]}


def test_names_decide_where_neighbours_are_even(monkeypatch):
    # id, first, town -> id, middle, first_name, town: each newcomer shares one neighbour with the column that went
    cols = [column("id", ("4", "^", "first", 1), ("4", "^", "middle", 1)), column("town", ("10", "first", "$", 3), ("10", "first_name", "$", 4))]
    cols += [column("first", ("10", "id", "town", 2)), column("middle", None, ("10", "id", "first_name", 2)), column("first_name", None, ("10", "middle", "town", 3))]
    assert flooded(cols) == {("first", "first_name")}
    monkeypatch.setattr(drift, "likeness", lambda a, b: 0.5)
    assert flooded(cols) == {("first", "middle")}


def test_flooding_lets_neighbours_outweigh_names():
    # amount went and total came in its place; amount_old came elsewhere with another type
    cols = [column("a", ("4", "^", "amount", 1), ("4", "^", "total", 1)), column("b", ("4", "amount", "c", 3), ("4", "total", "c", 3)), column("c", ("4", "b", "$", 4), ("4", "b", "amount_old", 4))]
    cols += [column("amount", ("5", "a", "b", 2)), column("total", None, ("5", "a", "b", 2)), column("amount_old", None, ("10", "c", "$", 5))]
    assert flooded(cols) == {("amount", "total")}


def test_layout_follows_what_the_flooding_matches(spark):
    one = {"t": [("id", "INT"), ("first", "Text"), ("last", "Text"), ("town", "Text")]}
    two = {"t": [("id", "INT"), ("first_", "Text"), ("last_", "Text"), ("town", "Text")]}
    df = files(spark, one, two)
    assert {r["change_kind"] for r in drift.schema_changes(df).collect()} == {"added", "removed"}
    assert {r["col_name"] for r in drift.consistent_layout(df).collect()} == {"id", "first_", "last_", "town"}
    assert {r["col_name"] for r in drift.consistent_layout(df, follow=2.0).collect()} == {"id", "first", "last", "first_", "last_", "town"}
    row = drift.consistent_columns(df).filter("file_no = 1 and old_column = 'first'").first()
    assert (row["table_name"], row["col_name"]) == ("t", "first_")


def test_random_changes_match_the_rule(spark):
    """The rule spelled out over every pair, on random series with moves, renames beside each other and copied tables."""
    import random

    r = random.Random(31)
    kinds = ["Text", "INT", "Memo", "MONEY"]
    series, want = [], set()
    tables = {f"tab{k}": [(f"c{k}_{j}", r.choice(kinds)) for j in range(r.randint(1, 7))] for k in range(6)}
    for no in range(1, 16):
        series.append({t: list(c) for t, c in tables.items()})
        for t in list(tables):
            cols = tables[t]
            for _ in range(r.choice([0, 1, 2])):
                p, what = r.randrange(len(cols)), r.random()
                if what < 0.4:
                    cols[p] = (f"n{r.randrange(10**6)}", cols[p][1])
                elif what < 0.6:
                    cols[p] = (cols[p][0], r.choice(kinds))
                elif what < 0.8:
                    cols.insert(p, (f"m{r.randrange(10**6)}", r.choice(kinds)))
                elif len(cols) > 1:
                    cols.pop(p)
            if r.random() < 0.15:
                tables[f"{t}_{no}"] = tables.pop(t)
    for no, (a, b) in enumerate(zip(series, series[1:]), 2):
        for t in set(a) & set(b):
            ends = lambda cols: {c: (k, ("^", *(x for x, _ in cols))[i], (*(x for x, _ in cols), "$")[i + 1]) for i, (c, k) in enumerate(cols)}
            x, y = ends(a[t]), ends(b[t])
            new = {d for c in set(x) - set(y) for d in set(y) - set(x) if x[c] == y[d]}
            old = {c for c in set(x) - set(y) for d in set(y) - set(x) if x[c] == y[d]}
            want |= {(f"f{no}.mdb", t, d, "renamed") for d in new} | {(f"f{no}.mdb", t, d, "added") for d in set(y) - set(x) - new} | {(f"f{no}.mdb", t, c, "removed") for c in set(x) - set(y) - old}
            want |= {(f"f{no}.mdb", t, c, "type_changed") for c in set(x) & set(y) if x[c][0] != y[c][0]}
    got = changes(spark, *series)
    assert {c for c in got if c[2]} == want and len(want) > 50


def test_flooding_never_loses_a_rename_by_the_rule():
    import random

    r = random.Random(5)
    for _ in range(1500):
        a = [(f"c{k}", r.choice("xyz")) for k in range(r.randint(1, 6))]
        b = list(a)
        for _ in range(r.randint(1, 4)):
            p = r.randrange(len(b)) if b else 0
            what = r.random()
            if what < 0.5 and b:
                b[p] = (r.choice([f"n{r.randrange(99)}", b[p][0] + "_x", f"c{r.randrange(9)}1"]), b[p][1])
            elif what < 0.75:
                b.insert(p, (f"m{r.randrange(99)}", r.choice("xyz")))
            elif b:
                b.pop(p)
        b = list(dict(b).items())
        ends = lambda cols: {c: (k, ("^", *(x for x, _ in cols))[i], (*(x for x, _ in cols), "$")[i + 1], i + 1) for i, (c, k) in enumerate(cols)}
        x, y = ends(a), ends(b)
        rule = {(c, d) for c in set(x) - set(y) for d in set(y) - set(x) if x[c][:3] == y[d][:3]}
        assert rule <= flooded([column(c, x.get(c), y.get(c)) for c in {**x, **y}]), (a, b)


def words(n, seed):
    import random

    r = random.Random(seed)
    return ["".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(10)) for _ in range(n)]


def test_the_best_pairs_are_those_of_a_sorted_list_of_all_pairs():
    import random

    r = random.Random(8)
    for _ in range(400):
        names = list(dict.fromkeys("".join(r.choice("ab1") for _ in range(r.randint(1, 5))) for _ in range(r.randint(0, 25))))
        cut = r.randint(0, len(names))
        gone, came = sorted(names[:cut]), sorted(names[cut:])
        want, olds, news = [], set(), set()
        for score, i, j in sorted((-((1 - drift.FLOW) * drift.likeness(a, b) + drift.FLOW), i, j) for i, a in enumerate(gone) for j, b in enumerate(came)):
            if i not in olds and j not in news:
                olds.add(i)
                news.add(j)
                want.append((gone[i], came[j], -score))
        assert drift.flood_tables(gone[::-1], came[::-1]) == want


def test_many_tables_of_one_layout_are_matched_as_few_are(spark):
    # the names that come are in another order by their first letters than those that go; 360 * 300 pairs
    gone = words(360, 1)
    came = {f"{999 - k}_{w}": w for k, w in enumerate(gone[:300])}
    assert {(a, b) for a, b, _ in drift.flood_tables(gone, list(came))} == {(w, c) for c, w in came.items()}
    assert {(a, b) for a, b, _ in drift.flood_tables(gone[:20], list(came)[:20])} == {(w, c) for c, w in list(came.items())[:20]}
    layout = [("x", "Text"), ("y", "INT")]
    got = changes(spark, {t: layout for t in gone}, {t: layout for t in came})
    assert got == {("f2.mdb", c, "", "table_renamed") for c in came} | {("f2.mdb", w, "", "table_removed") for w in gone[300:]}


def test_many_columns_are_matched_as_few_are(monkeypatch):
    # every name changes, so no pair shares a neighbour but the first and the last; 400 * 400 pairs
    def renamed(old):
        new = [f"{w}_n" for w in old]
        ends = lambda cols: [("10", a, b, n) for n, (a, b) in enumerate(zip(["^", *cols], [*cols[1:], "$"]), 1)]
        return [column(c, s) for c, s in zip(old, ends(old))] + [column(c, None, s) for c, s in zip(new, ends(new))]

    for n in (5, 400):
        assert flooded(renamed(words(n, 2))) == {(w, f"{w}_n") for w in words(n, 2)}
    whole = drift.flood_columns(renamed(words(40, 3)))
    monkeypatch.setattr(drift, "BLOCK", 7)
    assert drift.flood_columns(renamed(words(40, 3))) == whole
