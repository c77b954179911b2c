"""Leakage search against brute force over word windows."""

import random

from tamarack.llm import leakage
from tamarack.llm.cues import dialogue

WORDS = [f"{a}{b}" for a in ("amber", "copper", "lantern", "violin", "harbour", "meadow", "quartz", "thistle") for b in ("", "s", "ly", "worth", "stone", "field")]


def cue_file(words, number=True, eol="\n"):
    out = []
    for k in range(0, len(words), 6):
        head = ([str(k // 6 + 1)] if number else []) + [f"00:00:{k // 6 % 60:02d},000 --> 00:00:{k // 6 % 60:02d},900"]
        out.append(eol.join(head + [" ".join(words[k : k + 3]), " ".join(words[k + 3 : k + 6])]))
    return (eol * 2).join(out)


def brute(docs, items, least=0.5):
    out = set()
    for d, text in docs:
        if not text:
            continue
        w = leakage.words(" ".join(dialogue(text)))
        for i, item in items:
            x = leakage.words(item or "")
            need = max(1, -(-len(x) // 2))
            runs = {tuple(x[k : k + need]) for k in range(len(x) - need + 1)} if x else set()
            if any(tuple(w[k : k + need]) in runs for k in range(len(w) - need + 1)):
                out.add((d, i))
    return out


def test_matches_brute_force(spark):
    r = random.Random(3)
    items = [(i, " ".join(r.choice(WORDS) for _ in range(r.choice([6, 15, 40])))) for i in range(12)] + [(90, None), (91, ""), (92, "single")]
    docs = []
    for d in range(150):
        words = [r.choice(WORDS) for _ in range(r.randrange(5, 120))]
        if d % 3 == 0:
            x = items[d % 12][1].split()
            size = max(1, int(len(x) * r.choice([0.3, 0.45, 0.5, 0.7, 1.0])))
            k = r.randrange(len(x) - size + 1)
            at = r.randrange(len(words))
            words[at:at] = x[k : k + size]
        docs.append((d, cue_file(words, d % 2 == 0, "\r\n" if d % 5 == 0 else "\n")))
    docs += [(900, None), (901, ""), (902, "Single!"), (0, docs[0][1])]
    got = {(x["doc_id"], x["item_id"]) for x in leakage.leaked_items(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, item_text string")).collect()}
    assert got == brute(docs, items)
    assert {x for x in got if x[1] == 92} == {(902, 92)}


def test_blocks_of_items_give_the_same(spark):
    items = spark.createDataFrame([(i, f"word{i} alpha{i} beta{i} gamma{i}") for i in range(9)], "item_id long, item_text string")
    docs = spark.createDataFrame([(i, f"so word{i} alpha{i} beta{i} gamma{i} then") for i in range(9)], "doc_id long, text string")
    one = {tuple(r) for r in leakage.leaked_items(docs, items).collect()}
    many = {tuple(r) for r in leakage.leaked_items(docs, items, block_words=8).collect()}
    assert one == many and len(one) == 9


def test_noise_is_passed_over(spark):
    item = "Before the lacquered bridge of Eskstead was surveyed, Haromar assumed that 1894 rivets of chalky iron would suffice"
    noisy = "1\n00:00:01,000 --> 00:00:02,000\n<i>BEFORE THE lacquered</i> bridge\n\n7\n00:00:03,000 --> 00:00:04,000\n[door slams] of Eskstead was surveyed\n\n00:00:05.000 --> 00:00:06.000\nget more at www.adverts.example\n\n9\n00:00:07,000 --> 00:00:08,000\n{\\an8}Haromar assurned that 1894 rivets of cbalky ir0n wou1d suffice"
    scrambled = " ".join(sorted(item.split()))
    docs = spark.createDataFrame([(1, noisy), (2, scrambled), (3, " ".join(item.split()[:7]))], "doc_id long, text string")
    got = {tuple(r)[:2] for r in leakage.leaked_items(docs, spark.createDataFrame([(5, item)], "item_id long, item_text string")).collect()}
    assert got == {(1, 5)}


def test_garbled_accents_and_other_scripts(spark):
    items = [(1, "die äußeren Lampen am Kai brannten für die körnige Glocke"), (2, "мы должны продать старую карту завтра утром")]
    docs = [(1, "DIE ÄUSSEREN LAMPEN AM KAI BRANNTEN FÜR DIE KÖRNIGE GLOCKE"), (2, "die Ã¤uÃŸeren Lampen am Kai brannten fÃ¼r die kÃ¶rnige Glocke"), (3, "Мы должны продать старую карту завтра утром.")]
    got = {tuple(r)[:2] for r in leakage.leaked_items(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, item_text string")).collect()}
    assert got == {(1, 1), (2, 1), (3, 2)}


def test_empty_tables_and_long_text(spark):
    docs, items = "doc_id long, text string, item_id int", "item_id long, item_text string, doc_id int"
    none, long = spark.createDataFrame([], docs), spark.createDataFrame([(1, "filler " * 200_000 + "rare words stand here", 0)], docs)
    assert leakage.leaked_items(none, spark.createDataFrame([(1, "a b", 0)], items)).count() == 0
    assert leakage.leaked_items(long, spark.createDataFrame([], items)).count() == 0
    assert leakage.leaked_items(long, spark.createDataFrame([(4, "rare words stand here", 0)], items)).count() == 1


def test_damage_is_decided_by_the_expected_word(spark):
    item = "they will like to follow it into the violin school of old glass corner men who still sing"
    word = item.split()
    # words of many l and o, short words, forms that several words share, words that become others, ss and rn, parted and joined words
    spoilt = {"will": "wiql", "like": "lyke", "into": "imto", "follow": "fqllow", "still": "stlll", "violin": "vio#lin", "school": "schoql", "to": "tq", "it": "iq", "of": "qf", "the": "tha", "old": "cold", "men": "man", "glass": "glasq", "corner": "coxner", "sing": "sinq"}
    docs, want = [], set()
    need = -(-len(word) // 2)
    for d, (w, bad) in enumerate(spoilt.items()):
        at = word.index(w)
        low = max(0, min(at - need // 2, len(word) - need))
        docs.append((d, " ".join(["zebra", *word[low:at], bad, *word[at + 1 : low + need], "quagga"]) if low + need - 1 > at else " ".join(["zebra", *word[low:at], bad])))
        if low < at < low + need - 1 or len(w) > 3:
            want.add((d, 1))
    items = [(1, item), (2, "cold ring tha wall lake man violet schools"), (3, "мы должны продать старую карту завтра"), (4, "我们必须明天卖掉旧地图")]
    docs += [(100, "Мы должны продатъ старую"), (101, "мы долж?ны продать"), (102, "我们必须朋天"), (103, "我们必明天卖")]
    docs += [(200, "they will likes"), (201, " ".join(reversed(word))), (202, "they wiql like")]
    want |= {(100, 3), (101, 3), (102, 4), (103, 4)}
    d, i = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, item_text string")
    got = {tuple(r) for r in leakage.leaked_items(d, i).collect()}
    assert {x[:2] for x in got} == want
    for size in (1, 20):
        assert {tuple(r) for r in leakage.leaked_items(d, i, block_words=size).collect()} == got


def test_adverts_take_no_dialogue_along(spark):
    item = "the lacquered bridge of Eskstead was surveyed by Haromar before dawn"
    head = "1\n00:00:01,000 --> 00:00:02,000\n"
    docs = [
        (1, f"{item}\nget more at www.adverts.example"),
        (2, f"{head}{item}\nget more at www.adverts.example"),
        (3, f"{head}the lacquered bridge of Eskstead\n\n2\n00:00:2 -> 00:03\nmore at adverts.example\nwas surveyed by Haromar before dawn"),
        (4, f"{head}He left.Net result: {item}"),
        (5, f"{head}download our player, {item}"),
        (6, f"{head}get more at www.adverts.example"),
    ]
    got = {tuple(r)[:2] for r in leakage.leaked_items(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(1, item)], "item_id long, item_text string")).collect()}
    assert got == {(d, 1) for d in (1, 2, 3, 4, 5)}
    assert dialogue(docs[5][1]) == [] and dialogue(head + "Download lumacap player, 50% off today!") == []
    assert dialogue(head + "20% off today") == ["20% off today"]


def test_index_holds_every_word_of_every_document(spark):
    r = random.Random(8)
    docs = [(d, " ".join(r.choice(WORDS) for _ in range(r.randrange(0, 60)))) for d in range(40)] + [(50, None), (None, "amber"), (51, "?!")]
    rows = leakage.positional_index(spark.createDataFrame(docs, "doc_id long, text string"), index_words=100).collect()
    assert len(rows) > 5
    back = {}
    for row in rows:
        at, words = 0, [None] * sum(row["lengths"])
        for term, n, n_docs in zip(row["terms"], row["counts"], row["n_docs"]):
            places = row["places"][at : at + n]
            at += n
            owners = {next(k for k in range(len(row["docs"])) if p < sum(row["lengths"][: k + 1])) for p in places}
            assert places == sorted(places) and len(owners) == n_docs
            for p in places:
                words[p] = term
        for doc, n in zip(row["docs"], row["lengths"]):
            back[doc], words = words[:n], words[n:]
    assert back == {d: [w.decode() for w in leakage.words(t)] for d, t in docs if t and d is not None and leakage.words(t)}


def test_blocks_of_the_index_give_the_same(spark):
    docs = spark.createDataFrame([(i, f"so word{i} alpha{i} beta{i} gamma{i} then") for i in range(9)] + [(3, "word4 alpha4 beta4")], "doc_id long, text string")
    items = spark.createDataFrame([(i, f"word{i} alpha{i} beta{i} gamma{i}") for i in range(9)], "item_id long, item_text string")
    one = {tuple(r) for r in leakage.leaked_items(docs, items).collect()}
    many = {tuple(r) for r in leakage.leaked_items(docs, items, index_words=1).collect()}
    assert one == many and len(one) == 10


def test_an_item_may_hold_an_address(spark):
    item = "Visit www.sunrise.com before the quick brown fox jumps over the gate"
    head = "1\n00:00:01,000 --> 00:00:02,000\n"
    docs = [(1, f"{head}{item}"), (2, f"{head}Visit www.sunrise.com\n\n2\n00:00:03,000 --> 00:00:04,000\nbefore the quick brown fox"), (3, f"{head}other words\nget more at www.adverts.example")]
    got = {tuple(r) for r in leakage.leaked_items(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(1, item)], "item_id long, item_text string")).collect()}
    assert got == {(1, 1, 13, 13), (2, 1, 9, 13)}


def near_brute(docs, items, least, slack):
    out = set()
    for d, text in docs:
        own = leakage.words(text or "")
        for i, item in items:
            x = leakage.words(item or "")
            if not x or not own:
                continue
            width = max(1, int(slack * len(x)))
            best = max(len(set(own[k : k + width]) & set(x)) for k in range(len(own)))
            if best and best >= least * len(set(x)):
                out.add((d, i, best, len(set(x))))
    return out


def test_near_items_match_brute_force(spark):
    r = random.Random(12)
    items = [(i, " ".join(r.choice(WORDS) for _ in range(r.choice([1, 5, 9])))) for i in range(14)] + [(90, None), (91, "")]
    docs = []
    for d in range(120):
        words = [r.choice(WORDS) for _ in range(r.randrange(1, 90))]
        if d % 2:
            x = items[d % 14][1].split()
            r.shuffle(x)
            at = r.randrange(len(words))
            words[at:at] = [w for y in x for w in ([y] if r.random() < 0.8 else [y, r.choice(WORDS)])]
        docs.append((d, " ".join(words)))
    index = leakage.positional_index(spark.createDataFrame([*docs, (900, None)], "doc_id long, text string"), index_words=500)
    table = spark.createDataFrame(items, "item_id long, item_text string")
    for least, slack in ((0.8, 1.5), (0.5, 1.0), (1.0, 2.0)):
        got = {tuple(x) for x in leakage.near_items(index, table, least, slack).collect()}
        assert got == near_brute(docs, items, least, slack) and len(got) > 30
    assert {tuple(x) for x in leakage.near_items(index, table, block_words=5).collect()} == near_brute(docs, items, 0.8, 1.5)
    assert leakage.near_items(index, table.filter("item_id > 89")).count() == 0
