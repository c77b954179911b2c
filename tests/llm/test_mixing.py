import random

from tamarack.llm import mixing

SIZES, PLAN = "doc_id long, source string, n_tokens long", "source string, target_share double, max_repeats int"


def shares(rows):
    total = sum(r["n_tokens"] * r["n_repeats"] for r in rows)
    out = {}
    for r in rows:
        out[r["source"]] = out.get(r["source"], 0) + r["n_tokens"] * r["n_repeats"] / total
    return out


def test_shares_and_caps(spark):
    r = random.Random(1)
    sizes = [(k, s, r.randrange(20, 900)) for k, s in enumerate(["big"] * 3000 + ["mid"] * 500 + ["tiny"] * 60)]
    plan = [("big", 0.5, 1), ("mid", 0.4, 3), ("tiny", 0.1, 8), ("absent", 0.0, 2)]
    df = mixing.mix(spark.createDataFrame(sizes, SIZES), spark.createDataFrame(plan, PLAN), block_docs=200)
    rows = df.collect()
    got = shares(rows)
    for s, share, cap in plan[:3]:
        assert abs(got[s] - share) < 0.004, got
        assert max(x["n_repeats"] for x in rows if x["source"] == s) <= cap
    assert len({x["doc_id"] for x in rows}) == len(rows)
    assert sorted(map(tuple, rows)) == sorted(map(tuple, mixing.mix(spark.createDataFrame(sizes, SIZES), spark.createDataFrame(plan, PLAN), block_docs=200).collect()))
    # one source must be used up to its cap, else a larger mixture were possible
    used = {s: sum(x["n_tokens"] * x["n_repeats"] for x in rows if x["source"] == s) / sum(t for _, q, t in sizes if q == s) for s, _, _ in plan[:3]}
    assert any(used[s] > cap * 0.99 for s, _, cap in plan[:3])


def test_balance_of_documents_and_tokens():
    r = random.Random(2)
    units = [[k, r.randrange(1, 1000), 0.37] for k in range(5000)]
    want_tokens, want_docs = sum(u[1] * u[2] for u in units), sum(u[2] for u in units)
    rest = mixing.fly(units, random.Random(3))
    assert len(rest) <= 2
    mixing.land(rest, random.Random(4))
    assert all(u[2] in (0.0, 1.0) for u in units)
    assert abs(sum(u[1] * u[2] for u in units) - want_tokens) < 1500
    assert abs(sum(u[2] for u in units) - want_docs) <= 2


def test_inclusion_probabilities_are_kept():
    hits = [0] * 12
    for seed in range(3000):
        units = [[k, 10 + 7 * k, 0.1 + 0.06 * k] for k in range(12)]
        rng = random.Random(seed)
        mixing.land(mixing.fly(units, rng), rng)
        for k, u in enumerate(units):
            hits[k] += u[2]
    for k in range(12):
        assert abs(hits[k] / 3000 - (0.1 + 0.06 * k)) < 0.04


def test_ties_and_equal_sizes():
    units = [[k, 5, 0.5] for k in range(101)]
    rng = random.Random(1)
    mixing.land(mixing.fly(units, rng), rng)
    assert sum(u[2] for u in units) in (50, 51)


def test_odd_inputs(spark):
    sizes = [(1, "a", 10), (2, "a", None), (3, None, 5), (4, "a", 0), (5, "outside", 99), (None, "a", 4)]
    plan = [("a", 0.5, 2), ("nothing", 0.5, 2), (None, 0.1, 1)]
    rows = mixing.mix(spark.createDataFrame(sizes, SIZES), spark.createDataFrame(plan, PLAN)).collect()
    assert [(r["doc_id"], r["n_repeats"]) for r in rows] == [(1, 2)]
    empty = mixing.mix(spark.createDataFrame([], SIZES), spark.createDataFrame(plan, PLAN))
    assert empty.count() == 0
    report = {r["source"]: r for r in mixing.actual_shares(empty, spark.createDataFrame(plan, PLAN)).collect()}
    assert report["a"]["n_tokens"] == 0


def test_smaller_total(spark):
    sizes = [(k, "a" if k % 2 else "b", 10) for k in range(1000)]
    rows = mixing.mix(spark.createDataFrame(sizes, SIZES), spark.createDataFrame([("a", 0.5, 4), ("b", 0.5, 4)], PLAN), total_tokens=2000).collect()
    assert abs(sum(r["n_tokens"] * r["n_repeats"] for r in rows) - 2000) <= 40


def test_token_counts(spark):
    docs = spark.createDataFrame([(1, "s", "hello world"), (2, "s", None), (3, None, ""), (4, "s", "<|endoftext|>")], "doc_id long, source string, text string")
    got = {r["doc_id"]: r["n_tokens"] for r in mixing.token_counts(docs).collect()}
    assert got[1] == 2 and got[2] == 0 and got[3] == 0 and got[4] > 1


def test_leftovers_fly_on(spark):
    r = random.Random(8)
    sizes = spark.createDataFrame([(k, "ab"[k % 2], r.randrange(20, 900)) for k in range(3000)], SIZES)
    plan = spark.createDataFrame([("a", 0.7, 1), ("b", 0.3, 1)], PLAN)
    rows = mixing.mix(sizes, plan, block_docs=20).collect()
    assert len({x["doc_id"] for x in rows}) == len(rows) and abs(shares(rows)["b"] - 0.3) < 0.005


def test_extra_columns(spark):
    sizes = spark.createDataFrame([(1, "a", 10, 0.5, 7), (2, "a", 30, 0.5, 7)], SIZES + ", rate double, block int")
    plan = spark.createDataFrame([("a", 1.0, 1, 5)], PLAN + ", tokens int")
    assert sorted(tuple(r) for r in mixing.mix(sizes, plan).collect()) == [(1, "a", 10, 1), (2, "a", 30, 1)]
