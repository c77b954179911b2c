"""Content scoring: disguises, label model, and held-out accuracy on planted sentences."""

import random

import numpy as np
import pytest

from tamarack.llm import abuse, voters

PLANTED = {
    "abuse": ["You worthless moron, get out of my sight before I strangle you.", "Shut your mouth, you p.a.t.h.e.t.i.c idiot!", "Ferme ta gueule, espèce de crétin inutile !", "Du verdammter Mistkerl, ich schlag dir die Zähne ein."],
    "hate": ["All Zorvians are subhumans and should be exterminated.", "Those Zorvians breed like verm1n; they ought to be wiped out.", "Todos los zorvianos son basura y hay que exterminarlos.", "We don't serve Zorvians in here, they are filth."],
    "sexual": ["Naked on the bed, they had s-e-x until she screamed with an orgasm.", "He licked slowly down to the n*pples while the other lay there aroused and naked.", "Get on your knees and undress, I want you nak​ed and moaning.", "Nackt lagen sie auf dem Bett und hatten stöhnend Sex."],
}
HARMLESS = ["Don't be silly, you're no idiot.", "You need to note the sex of each seedling before planting.", "She was screened for breast cancer at the clinic.", "The cellar is full of rats, real vermin, call Fintan.", "That was a stupid mistake, and it was mine.", "Nobody calls the Zorvians vermin in my house, they are guests."]
FILLER = ["Where is the umbrella?", "The doctor is at the ferry landing.", "Am Montag fährt niemand über die Brücke.", "I told Nerys to paint the wooden ledger tonight.", "Nadie va a la estación mañana.", "Come on, we have to bring it before noon."]


@pytest.fixture(scope="module")
def corpus():
    r = random.Random(5)
    docs, truth = [], {}
    for d in range(400):
        lines = [r.choice(FILLER) for _ in range(8)] + [r.choice(HARMLESS)]
        kinds = [k for k in PLANTED if r.random() < 0.15]
        for k in kinds:
            lines.insert(r.randrange(len(lines)), r.choice(PLANTED[k]))
        truth[d] = set(kinds)
        docs.append((d, "\n\n".join(f"{n}\n00:00:{n:02d},000 --> 00:00:{n:02d},900\n{x}" for n, x in enumerate(lines, 1)), "s1" if d % 2 else None))
    return docs + [(900, None, "s1"), (901, "", "s1"), (902, "word " * 300_000, "s1")], truth


def test_finds_planted_and_only_those(spark, corpus):
    docs, truth = corpus
    df = spark.createDataFrame(docs, "doc_id long, text string, source string")
    scores = abuse.content_scores(df)
    assert scores.count() == len(docs)
    got = {}
    for r in abuse.found_content(scores).collect():
        got.setdefault(r["doc_id"], set()).add(r["category"])
    wrong = [d for d in truth if got.get(d, set()) != truth[d]]
    assert len(wrong) <= 0.02 * len(truth), [(d, truth[d], got.get(d)) for d in wrong[:5]]
    assert not {900, 901, 902} & set(got)
    rates = {r["source"]: r for r in abuse.content_rates(df, scores).collect()}
    assert rates["s1"]["n_docs"] == 203 and 0 < rates[None]["abuse_rate"] < 0.5


def test_disguises():
    p = lambda s: " ".join(voters.plain(s))
    assert p("n-a-k-e-d S.E.X!") == "naked sex"
    assert p("mo​aning n@k3d m*aning veeeermine") == "moaning naked moaning vermine"
    assert p("b@$t@rd subhuman$ c\ufffdllate \ufffdliminer") == "bastard subhumans callate eliminer"
    assert p("GrÃ¶ÃŸe Café dЎ") .startswith("grosse cafe")
    assert p("in 1894 A4 12") == "in 1894 a4 12" or "1894" in p("in 1894 A4 12")


def test_harmless_sentences_meet_an_objection_or_one_word_only():
    for s in HARMLESS:
        for plain in voters.plain(s):
            for c, v in abuse.spoken_votes(plain).items():
                heard = {n[0] for n, x in zip(voters.VOTERS[c], v) if x == "+"}
                assert "-" in v or heard <= voters.LEXICAL, s


def test_label_model_finds_the_bad_voter():
    r = random.Random(7)
    patterns: dict[str, int] = {}
    for _ in range(4000):
        y = r.random() < 0.4
        v = ["+" if (y and r.random() < 0.8) or (not y and r.random() < 0.03) else "0" for _ in range(3)]
        noise = "+" if r.random() < 0.3 else "0"
        key = "".join(v) + noise + v[0] + ("-" if r.random() < (0.02 if y else 0.6) else "0")
        if "+" in key:
            patterns[key] = patterns.get(key, 0) + 1
    m = abuse.LabelModel(list("abcdef"), [1] * 5 + [-1]).fit(patterns)
    assert m.posterior("+++000") > 0.9 and m.posterior("000+00") < m.posterior("0+0000") and m.chance[3] < m.chance[1] - 0.15
    assert m.posterior("000+0-") < 0.2 and m.chance[5] < 0.1
    assert m.correlation[0, 4] > 0.8 and m.weight[0] < m.weight[1]


def test_label_model_is_stable_whatever_the_sample():
    whole = {"+++00": 40, "++000": 60, "+000-": 200, "0+000": 90, "+0000": 30, "++++0": 5}
    names, signs = ["insult", "address", "threat", "contempt", "denied"], [1, 1, 1, 1, -1]
    for scale in (0.05, 0.3, 1, 100):
        m = abuse.LabelModel(names, signs).fit({k: max(1, int(v * scale)) for k, v in whole.items()})
        assert m.posterior("++000") > 0.5 > m.posterior("+000-") and m.posterior("+0000") < 0.5 and 0.2 < m.prior < 0.7


def test_linear_model_generalises():
    r = random.Random(9)
    rows, target = [], []
    for _ in range(800):
        bad = r.random() < 0.4
        ws = [r.choice("alpha beta gamma delta".split()) for _ in range(5)] + ([r.choice(["vile", "nasty"])] if bad else [])
        r.shuffle(ws)
        rows.append(abuse.features(" ".join(ws)))
        target.append(float(bad))
    bias, w = abuse.train_linear(rows[:600], np.array(target[:600]), np.ones(600))
    held = [(sum(w.get(f, 0) for f in x) + bias > 0) == (t > 0.5) for x, t in zip(rows[600:], target[600:])]
    assert sum(held) / len(held) > 0.97
    assert abuse.train_linear([], np.zeros(0), np.zeros(0), {"\tx": 2.0}) == (abuse.SILENT, {"\tx": 2.0})


def test_linear_model_is_at_its_minimum():
    rows, target, weight = [["a", "b"], ["b"], ["c", "a"], []], np.array([0.9, 0.2, 0.6, 0.0]), np.array([1.0, 2.0, 1.0, 3.0])
    bias, w = abuse.train_linear(rows, target, weight, {"c": 1.5}, bias=-1.0, ridge=0.7, firm=3.0)
    p = np.array([1 / (1 + np.exp(-(bias + sum(w[f] for f in r)))) for r in rows])
    e = weight * (p - target)
    slopes = [e[0] + e[2] + 0.7 * w["a"], e[0] + e[1] + 0.7 * w["b"], e[2] + 2.1 * (w["c"] - 1.5), e.sum() + 0.35 * (bias + 1)]
    assert max(map(abs, slopes)) < 1e-2


def test_words_no_training_sentence_holds_stay_harmless(spark, corpus):
    docs, _ = corpus
    strange = [(2000 + k, f"Zu{k} kuva{k} olemi{k} tarsa{k}. Brim{k}!", "s9") for k in range(60)]
    scores = abuse.content_scores(spark.createDataFrame(docs + strange, "doc_id long, text string, source string"), train_sentences=40)
    assert scores.filter("doc_id >= 2000").selectExpr("max(greatest(abuse, hate, sexual)) m").first()["m"] < 0.2


#: Sentences in words of their own: what any voter for a category would say of them alone is wrong.
HELD_OUT = [
    ("I will kill you at chess tonight!", set()),
    ("He was a lousy coward in the war.", set()),
    ("They are all animals in the zoo.", set()),
    ("Don't you dare say all immigrants are rats.", set()),
    ("They wanted sex education in school.", set()),
    ("Our cat caught a fat rat in the barn.", set()),
    ("The nurse said the naked babies were cold.", set()),
    ("You are a filthy lying snake and I will end you.", {"abuse"}),
    ("I hope you rot in hell, you wretch.", {"abuse"}),
    ("Those foreigners have to be gassed.", {"hate"}),
    ("You stupid cow, drop dead.", {"abuse"}),
    ("She sucked him until he came in her mouth.", {"sexual"}),
]


def test_model_decides_where_the_lexicon_is_wrong(spark, corpus):
    docs, _ = corpus
    more = [(3000 + k, text, "h") for k, (text, _) in enumerate(HELD_OUT)]
    found = abuse.found_content(abuse.content_scores(spark.createDataFrame(docs + more, "doc_id long, text string, source string"))).filter("doc_id >= 3000").collect()
    got = {k: {r["category"] for r in found if r["doc_id"] == 3000 + k} for k in range(len(HELD_OUT))}
    wrong = [(text, got[k]) for k, (text, truth) in enumerate(HELD_OUT) if got[k] != truth]
    assert len(wrong) <= 1, wrong
    # ablation: any word of the lexicons alone, and any voter alone
    by_word = by_voter = 0
    for text, truth in HELD_OUT:
        votes = {c: v for s in voters.plain(text) for c, v in abuse.spoken_votes(s).items()}
        words = {c for c, v in votes.items() if any(x == "+" and n[0] in voters.LEXICAL for n, x in zip(voters.VOTERS[c], v))}
        by_word += words != truth
        by_voter += set(votes) != truth
    assert by_word >= 7 and by_voter >= 6


def test_words_alone_tell_what_no_voter_hears(spark):
    r = random.Random(4)
    docs = [(k, f"{r.choice(['You miserable idiot', 'You worthless moron'])} of {'kolmatreq'[k % 9]}{k}, grumblefax the zandle.", "s") for k in range(60)] + [(k, r.choice(FILLER), "s") for k in range(60, 300)]
    found = abuse.content_scores(spark.createDataFrame([*docs, (900, "Grumblefax the zandle.", "s"), (901, "Where is the zebra?", "s")], "doc_id long, text string, source string"))
    by = {x["doc_id"]: x["abuse"] for x in found.collect()}
    assert by[900] > 2 * by[901]


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string, source string")
    assert abuse.content_scores(df).count() == 0


def test_extra_columns(spark):
    df = spark.createDataFrame([(1, "Hello there.", "s", 1.0, "x")], "doc_id long, text string, source string, abuse double, plain string")
    scores = abuse.content_scores(df)
    assert scores.columns == ["doc_id", "abuse", "hate", "sexual"] and abuse.content_rates(df, scores).first()["n_docs"] == 1


def expand(pattern, r):
    """A random text that the parsed pattern may match; assertions are left to a check of the whole."""
    out = []
    for op, arg in pattern:
        name = str(op)
        if name == "LITERAL":
            out.append(chr(arg))
        elif name == "IN" or name == "ANY":
            out.append("q")
        elif name == "SUBPATTERN":
            out.append(expand(arg[3], r))
        elif name == "BRANCH":
            out.append(expand(r.choice(arg[1]), r))
        elif name in ("MAX_REPEAT", "MIN_REPEAT"):
            out += [expand(arg[2], r) for _ in range(r.randint(arg[0], min(arg[1], arg[0] + 2)))]
    return "".join(out)


def test_gate_lets_every_vote_pass():
    r = random.Random(2)
    for text in ("They all need to be gassed.", "They have to be expelled", "Têm de ser exterminados", "tem de ser exterminadas", "Ferme la", "Geh dich", "ersaufe", "ersaufen", "those men here are for exterminators", "They must be shot"):
        assert all(voters.may_vote(s) for s in voters.plain(text)), text
    tried = 0
    for category in voters.VOTERS.values():
        for name, pattern, vote in category:
            for _ in range(1500 if vote > 0 else 0):
                text = f"so {expand(voters._parser.parse(pattern.pattern), r)} then"
                if pattern.search(text):
                    tried += 1
                    assert voters.may_vote(text), (name, text)
    assert tried > 20_000
    assert not voters.may_vote("you are the doctor and they have all of it")


def test_adverts_and_brackets_are_scored(spark, corpus):
    docs, _ = corpus
    line = "You worthless moron, get out of my sight before I strangle you."
    more = [(1000, f"{line} See www.adverts.example", "s1"), (1001, f"1\n00:00:01,000 --> 00:00:02,000\n[{line}]", "s1"), (1002, f"1\n00:00:01,000 --> 00:00:02,000\n{line}\nget more at www.adverts.example", "s1")]
    found = abuse.found_content(abuse.content_scores(spark.createDataFrame(docs + more, "doc_id long, text string, source string"))).collect()
    assert {(d, "abuse") for d in (1000, 1001, 1002)} <= {tuple(r) for r in found}


def test_masks_of_any_size_and_place():
    for masked, word in {"s*x": "sex", "n*de": "nude", "sc*m": "scum", "p*nk": "punk", "f*ck": "fuck", "b**ch": "bitch", "f**k": "fuck", "b*****d": "bastard", "bitc*": "bitch", "*itch": "bitch", "n*k*d": "naked", "b1tc*": "bitch"}.items():
        assert voters.plain(f"you {masked}.") == [f"you {word}"], masked
    assert sum(voters.votes(voters.plain("You b**ch!")[0])["abuse"]) > 1
    assert voters.plain("a note* s*e*x ***") == ["a note sex"] and voters.filled("f***") is None


def test_repetition_within_a_document_changes_nothing(spark, corpus):
    docs, _ = corpus
    lines = [*HARMLESS, "The city was hit by the plague.", *[x for v in PLANTED.values() for x in v]]
    more = [(4000 + 10 * k + n, "\n\n".join([line] * n), "r") for k, line in enumerate(lines) for n in (1, 2, 5)]
    scores = {r["doc_id"]: tuple(r)[1:] for r in abuse.content_scores(spark.createDataFrame(docs + more, "doc_id long, text string, source string")).filter("doc_id >= 4000").collect()}
    for k in range(len(lines)):
        once, twice, often = (scores[4000 + 10 * k + n] for n in (1, 2, 5))
        assert np.allclose(once, twice, atol=1e-9) and np.allclose(once, often, atol=1e-9), lines[k]
