"""The hierarchy operator against a walk up the parents, with and without shortened chains."""

import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from tamarack.operators import forms_tree
from tamarack.operators.hierarchy import descendants, hierarchy


def brute(parents: dict) -> dict:
    out = {}
    for node in parents:
        path, x = [node], node
        while parents.get(x) in parents and parents[x] not in path:
            x = parents[x]
            path.append(x)
        up = parents.get(x)
        if up in parents:
            loop = path[path.index(up) :]
            out[node] = (min(loop), -1)
        else:
            out[node] = (x, len(path) - 1)
    return out


def run(spark, parents: dict, paths: bool, finish_rows: int = 0) -> dict:
    links = spark.createDataFrame(list(parents.items()), "a long, b long")
    return {r["id"]: (r["root_id"], r["depth"]) for r in hierarchy(links, "a", "b", paths, finish_rows).collect()}


def forest(seed: int, n: int) -> dict:
    r = random.Random(seed)
    ids = r.sample(range(1, 10**15), n)
    parents = {}
    for k, i in enumerate(ids):
        parents[i] = ids[r.randrange(k)] if k and r.random() < 0.9 else None
    for _ in range(3):  # loops with trees hanging from them
        ring = r.sample(ids, 4)
        for a, b in zip(ring, ring[1:] + ring[:1]):
            parents[a] = b
    parents[ids[0]] = 7  # a parent that is no node
    return parents


@pytest.mark.parametrize("paths,finish_rows", [(True, 0), (False, 0), (False, 40), (True, 10**6), (False, 10**6)])
def test_matches_walk(spark, paths, finish_rows):
    parents = forest(7 + paths, 300)
    assert run(spark, parents, paths, finish_rows) == brute(parents)


def test_both_ways_give_the_same(spark):
    links = spark.createDataFrame(list(forest(3, 200).items()), "a long, b long")
    rows = [{r["id"]: (r["parent_id"], r["root_id"], r["depth"], r["subtree_size"], r["on_loop"]) for r in hierarchy(links, "a", "b", p, n).collect()} for p, n in ((True, 10**6), (False, 0), (False, 30))]
    assert rows[0] == rows[1] == rows[2]


def test_a_chain_takes_few_rounds(spark, monkeypatch):
    from tamarack.operators import hierarchy as h

    calls = []
    real = h._peel_leaves
    monkeypatch.setattr(h, "_peel_leaves", lambda state: calls.append(1) or real(state))
    n = 2000
    links = spark.createDataFrame([(k, k - 1 if k else None) for k in range(n)] + [(10_000 + k, 10_000 + (k + 1) % 500) for k in range(500)] + [(20_000, 10_007)], "a long, b long")
    rows = {r["id"]: r for r in hierarchy(links, "a", "b", False, 100).collect()}
    assert all(rows[k]["depth"] == k and rows[k]["root_id"] == 0 and rows[k]["subtree_size"] == n - k for k in range(n))
    assert all(rows[10_000 + k]["on_loop"] and rows[10_000 + k]["root_id"] == 10_000 and rows[10_000 + k]["subtree_size"] == 1 + (k == 7) for k in range(500))
    assert (rows[20_000]["depth"], rows[20_000]["root_id"], rows[20_000]["parent_id"]) == (-1, 10_000, 10_007)
    assert len(calls) < 40


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.dictionaries(st.integers(1, 12), st.one_of(st.none(), st.integers(1, 12)), max_size=12))
def test_small_graphs(spark, parents):
    assert run(spark, parents, False, 3) == run(spark, parents, True, 10**6) == brute(parents)


def test_hot_parent_and_chain(spark):
    parents = {k: 1 for k in range(2, 400)}
    parents[1] = None
    parents |= {1000 + k: (1000 + k - 1 if k else None) for k in range(12)}
    links = spark.createDataFrame(list(parents.items()), "a long, b long")
    rows = {r["id"]: r for r in hierarchy(links, "a", "b").collect()}
    assert rows[1]["subtree_size"] == 399 and rows[1011]["depth"] == 11
    assert rows[1011]["ancestors"] == list(range(1000, 1011))


def test_empty_nulls_and_repeats(spark):
    links = spark.createDataFrame([(1, None, "x"), (1, None, "y"), (2, 1, "z"), (None, 1, "q"), (3, 3, "self")], "id long, parent_id long, depth string")
    rows = {r["id"]: (r["root_id"], r["depth"]) for r in hierarchy(links, "id", "parent_id").collect()}
    assert rows == {1: (1, 0), 2: (1, 1), 3: (3, -1)}
    assert hierarchy(links.limit(0), "id", "parent_id").count() == 0


def test_descendants(spark):
    links = spark.createDataFrame([(1, None), (2, 1), (3, 2), (4, 4)], "a long, b long")
    pairs = {tuple(r) for r in descendants(hierarchy(links, "a", "b")).collect()}
    assert pairs == {(1, 2, 1), (1, 3, 2), (2, 3, 1)}


def test_descendants_below_a_loop(spark):
    links = spark.createDataFrame([(1, 2), (2, 1), (3, 1), (4, 3), (5, 4), (6, 2), (7, None), (8, 7)], "a long, b long")
    tree = hierarchy(links, "a", "b")
    assert {tuple(r) for r in descendants(tree).collect()} == {(1, 3, 1), (1, 4, 2), (3, 4, 1), (1, 5, 3), (3, 5, 2), (4, 5, 1), (2, 6, 1), (7, 8, 1)}
    assert {r["id"]: r["depth"] for r in tree.collect()} == {1: -1, 2: -1, 3: -1, 4: -1, 5: -1, 6: -1, 7: 0, 8: 1}


CONTROL = "control_id long, form_id long, db_file string, form_name string, ctl_name string, section_name string, is_section boolean, source_object string, ctl_type string, loaded_at timestamp_ntz"


def controls(spark, rows):
    return spark.createDataFrame([(*r, None) for r in rows], CONTROL)


def test_control_links_follow_names_and_hosts(spark):
    rows = [
        (1, 10, "a.mdb", "main", "Detail", None, True, None, "Detail"),
        (2, 10, "a.mdb", "main", "sub", " [DETAIL] ", False, "form.[Inner Form]", "SubForm"),
        (3, 11, "a.mdb", "inner form", "Detail", "x", True, None, "Detail"),
        (4, 11, "a.mdb", "inner form", "txt", "detail", False, None, "TextBox"),
        (5, 12, "b.mdb", "inner form", "Detail", None, True, None, "Detail"),
        (6, 10, "a.mdb", "main", "tab", "Detail", False, "Table.inner form", "SubForm"),
        (7, 10, "a.mdb", "main", None, None, None, None, None),
        (4, 11, "a.mdb", "inner form", "txt", "detail", False, None, "TextBox"),
    ]
    tree = {r["id"]: (r["root_id"], r["depth"]) for r in forms_tree.control_tree(controls(spark, rows)).collect()}
    assert tree == {1: (1, 0), 2: (1, 1), 3: (1, 2), 4: (1, 3), 5: (5, 0), 6: (1, 1), 7: (7, 0)}
    paths = {r["id"]: r["path"] for r in forms_tree.control_paths(controls(spark, rows), forms_tree.control_tree(controls(spark, rows))).collect()}
    assert paths[4] == "Detail/sub/Detail/txt" and paths[7] == ""
    assert forms_tree.control_tree(controls(spark, [])).count() == 0


def test_below_holds_what_hangs_from_loops(spark, small):
    from tamarack.queries import pipeline

    trees, below = ({tuple(r) for r in pipeline.QUERIES[q](spark, small).collect()} for q in ("p1_descendants", "p1_below"))
    assert trees <= below
