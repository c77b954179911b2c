"""Abusive, hateful or sexual content by weak supervision.

Lexicon and pattern voters speak on sentences; a generative label model
estimates, without labels, how often each voter is right for either class and
which voters repeat each other; a linear classifier over words, pairs of words
and votes is trained on its posterior labels and scores every sentence of
every document.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tamarack.llm import voters as V
from tamarack.llm.cues import asides, dialogue
from tamarack.workspace import settle

#: The most sentences the classifiers are trained on: so many of all sentences, and so many of those that a voter speaks for, by category.
TRAIN_SENTENCES = 20_000
#: Sentences whose votes or scores a task remembers.
KEPT = 200_000
_SPOKEN = pa.list_(pa.struct([("category", pa.string()), ("votes", pa.string()), ("sentence", pa.string())]))
_CODE = {-1: "-", 0: "0", 1: "+"}
#: Log odds, before training, of a sentence that no voter speaks for.
SILENT = -5.0


def spoken_votes(sentence: str) -> dict[str, str]:
    """Vote patterns of the categories that some voter speaks for on a sentence in plain form, a sign for each voter."""
    if not V.may_vote(sentence):
        return {}
    return {c: "".join(_CODE[x] for x in v) for c, v in V.votes(sentence).items() if max(v) > 0}


def sentences_of(text: str | None) -> list[str]:
    """All sentences of a document in plain form; adverts and texts in brackets may be abusive too and are sentences of their own."""
    text = text or ""
    out = V.plain("\n".join(dialogue(text, adverts=True)))
    if extra := asides(text):
        out += V.plain("\n\n".join(extra))
    return out


def _scan(doc_type: pa.DataType):
    known: dict[str, list[dict]] = {}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts, found, numbers = [], [], [], []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                own = sentences_of(text.as_py())
                spoken: list[dict] = []
                for s in own:
                    got = known.get(s)
                    if got is None:
                        if len(known) > KEPT:
                            known.clear()
                        got = known[s] = [{"category": c, "votes": v, "sentence": s} for c, v in spoken_votes(s).items()]
                    spoken += got
                ids.append(doc)
                texts.append("\n".join(own))
                found.append(spoken)
                numbers.append(len(own))
            yield pa.RecordBatch.from_arrays([pa.array(ids, doc_type), pa.array(texts, pa.string()), pa.array(found, _SPOKEN), pa.array(numbers, pa.int64())], names=["doc_id", "plain", "spoken", "n_sentences"])

    return run


class LabelModel:
    """Accuracies of the voters of one category, fitted by expectation maximisation on counted vote patterns.

    Given the class, a voter that speaks is right with its accuracy, and
    silence says nothing.  Before any data an objection is expected to be right
    in 97 of 100 cases, a pattern in 80 and a lexicon's word in 20; that counts
    twice as much as the data, for patterns half as much, and ten cases more.
    Voters for the class that agree beyond what the classes explain share their
    say: a voter's log odds are divided by one plus the sum of its squared
    excess correlations.
    """

    PRIOR = 0.4

    def __init__(self, names: list[str], signs: list[int], rounds: int = 60):
        self.names, self.signs, self.rounds = names, np.array(signs), rounds
        expected = np.array([0.97 if s < 0 else 0.2 if n in V.LEXICAL else 0.8 for n, s in zip(names, signs)])
        self.belief = np.array([0.5 if n not in V.LEXICAL and s > 0 else 2.0 for n, s in zip(names, signs)])
        #: How likely the class is where the voter speaks.
        self.expected = np.where(self.signs > 0, expected, 1 - expected)
        self.chance, self.prior, self.weight = self.expected, self.PRIOR, np.ones(len(names))

    def _votes(self, patterns: list[str]) -> np.ndarray:
        return np.array([[{"-": -1, "0": 0, "+": 1}[c] for c in k] for k in patterns], dtype=int).reshape(len(patterns), len(self.names))

    def fit(self, patterns: dict[str, int]) -> LabelModel:
        keys = sorted(patterns)
        votes = self._votes(keys)
        n = np.array([patterns[k] for k in keys], dtype=float)
        speaks = votes != 0
        heard = n @ speaks
        belief = self.belief * heard + 10
        for step in range(3):
            if step:
                self.weight = 1 / (1 + (self._excess(votes, n, q) ** 2).sum(1))
            for _ in range(self.rounds):
                q = self._posterior(votes)
                self.chance = np.clip(((n * q) @ speaks + belief * self.expected) / (heard + belief), 1e-3, 1 - 1e-3)
                self.prior = float(((n * q).sum() + 0.5 * n.sum() * self.PRIOR) / (1.5 * n.sum()))
        return self

    def _gain(self) -> np.ndarray:
        """What each voter adds to the log odds where it speaks."""
        return self.weight * (np.log(self.chance / (1 - self.chance)) - math.log(self.prior / (1 - self.prior)))

    def _posterior(self, votes: np.ndarray) -> np.ndarray:
        odds = math.log(self.prior / (1 - self.prior)) + (votes != 0) @ self._gain()
        return 1 / (1 + np.exp(-np.clip(odds, -30, 30)))

    def _excess(self, votes: np.ndarray, n: np.ndarray, q: np.ndarray) -> np.ndarray:
        x = votes.astype(float)
        out = np.zeros((votes.shape[1],) * 2)
        for a, b in combinations(np.flatnonzero(self.signs > 0), 2):
            cov = var_a = var_b = 0.0
            for w in (n * (1 - q), n * q):
                total = w.sum()
                if total > 0:
                    ma, mb = (w * x[:, a]).sum() / total, (w * x[:, b]).sum() / total
                    cov += (w * (x[:, a] - ma) * (x[:, b] - mb)).sum()
                    var_a += (w * (x[:, a] - ma) ** 2).sum()
                    var_b += (w * (x[:, b] - mb) ** 2).sum()
            if var_a > 0 and var_b > 0:
                out[a, b] = out[b, a] = max(0.0, cov / math.sqrt(var_a * var_b))
        self.correlation = out
        return out

    def posterior(self, pattern: str) -> float:
        return float(self._posterior(self._votes([pattern]))[0])

    def log_odds(self) -> tuple[float, dict[str, float]]:
        """Log odds where all are silent, and what each voter adds to them where it speaks."""
        return math.log(self.prior / (1 - self.prior)), dict(zip(self.names, map(float, self._gain())))


def features(sentence: str) -> list[str]:
    """Words and pairs of neighbouring words."""
    ws = sentence.split()
    return list(dict.fromkeys([*ws, *map(" ".join, zip(ws, ws[1:]))]))


def train_linear(rows: list[list[str]], target: np.ndarray, weight: np.ndarray, centre: dict[str, float] | None = None, bias: float = SILENT, ridge: float = 0.2, firm: float = 250.0, most: int = 200) -> tuple[float, dict[str, float]]:
    """Bias and weights of a logistic regression on soft labels, minimised by limited-memory quasi-Newton steps until it has converged.

    The ridge pulls weights to 0, those that ``centre`` names ``firm`` times as
    strongly to what it gives them, and the bias weakly to ``bias``.  The vocabulary is that of the rows: what none of them
    holds has the weight of its centre.
    """
    centre = centre or {}
    place = {f: k for k, f in enumerate(dict.fromkeys([*centre, *(f for r in rows for f in r)]))}
    size = len(place)
    middle = np.zeros(size + 1)
    pull = np.full(size + 1, ridge)
    for f, v in centre.items():
        middle[place[f]], pull[place[f]] = v, firm * ridge
    middle[-1], pull[-1] = bias, ridge / 2
    if not rows:
        return bias, dict(centre)
    lengths = np.array([len(r) for r in rows], dtype=np.int64)
    flat = np.fromiter((place[f] for r in rows for f in r), dtype=np.int64, count=int(lengths.sum()))
    owner = np.repeat(np.arange(len(rows), dtype=np.int64), lengths)

    def loss(w: np.ndarray) -> tuple[float, np.ndarray]:
        z = np.clip(np.bincount(owner, w[flat], minlength=len(rows)) + w[-1], -60, 60)
        away = w - middle
        value = float((weight * (np.logaddexp(0, z) - target * z)).sum() + 0.5 * (pull * away * away).sum())
        error = weight * (1 / (1 + np.exp(-z)) - target)
        g = np.bincount(flat, error[owner], minlength=size + 1)
        g[-1] = error.sum()
        return value, g + pull * away

    w = middle.copy()
    value, g = loss(w)
    steps: list[tuple[np.ndarray, np.ndarray, float]] = []
    for _ in range(most):
        d = g.copy()
        kept = []
        for s, y, r in reversed(steps):
            a = r * (s @ d)
            kept.append(a)
            d -= a * y
        if steps:
            s, y, r = steps[-1]
            d /= r * (y @ y)
        else:
            d /= max(1.0, float(np.abs(g).max()))
        for (s, y, r), a in zip(steps, reversed(kept)):
            d += s * (a - r * (y @ d))
        slope, size_of_step = float(g @ d), 1.0
        while True:
            after, g_after = loss(w - size_of_step * d)
            if after <= value - 1e-4 * size_of_step * slope or size_of_step < 1e-8:
                break
            size_of_step /= 2
        s, y = -size_of_step * d, g_after - g
        w, g, gone, value = w + s, g_after, value - after, after
        if s @ y > 1e-12:
            steps = [*steps[-7:], (s, y, 1 / float(s @ y))]
        if gone <= 1e-6 * max(1.0, abs(value)):
            break
    return float(w[-1]), {f: float(w[k]) for f, k in place.items()}


def _score(models: dict[str, tuple[float, dict[str, float]]], doc_type: pa.DataType):
    names = list(models)
    bias = [models[c][0] for c in names]
    words: dict[str, tuple] = {}
    pairs: dict[str, dict[str, tuple]] = {}
    votes = {(c, f.removeprefix("\t")): v for c in names for f, v in models[c][1].items() if f.startswith("\t")}
    for f in {f for c in names for f in models[c][1] if not f.startswith("\t")}:
        cell = tuple(models[c][1].get(f, 0.0) for c in names)
        first, _, second = f.partition(" ")
        if second:
            pairs.setdefault(first, {})[second] = cell
        else:
            words[first] = cell
    voters = {c: [v[0] for v in V.VOTERS[c]] for c in names}
    known: dict[str, list[float]] = {}

    def score(sentence: str) -> list[float]:
        ws = sentence.split()
        hits = {w: v for w in ws if (v := words.get(w)) is not None}
        for a, b in zip(ws, ws[1:]):
            if (f := pairs.get(a)) is not None and (v := f.get(b)) is not None:
                hits[a, b] = v
        return list(map(sum, zip(bias, *hits.values())))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = {c: k for k, c in enumerate(names)}
        for batch in batches:
            best = [[] for _ in names]
            for text, spoken in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                # a sentence said twice has its votes twice
                said: dict[str, dict[str, str]] = {}
                for s in spoken or ():
                    said.setdefault(s["sentence"], {})[s["category"]] = s["votes"]
                low = [-99.0] * len(names)
                for s in set((text or "").split("\n")):
                    z = known.get(s)
                    if z is None:
                        if len(known) > KEPT:
                            known.clear()
                        z = score(s)
                        for c, pattern in said.get(s, {}).items():
                            z[place[c]] += votes[c, ""] + sum(votes[c, n] for n, v in zip(voters[c], pattern) if v != "0")
                        known[s] = z
                    low = list(map(max, low, z))
                for k, z in enumerate(low):
                    best[k].append(1 / (1 + math.exp(-max(-30.0, min(30.0, z)))))
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(b, pa.float64()) for b in best]], names=["doc_id", *names])

    return run


def _some(rows: DataFrame, every: int, number: int) -> list[str]:
    """At most ``number`` distinct sentences, those of the smallest hashes; all of them where there are no more.

    The rows are thinned by the sentence's hash before they are grouped and
    sorted, so what is shuffled stays in proportion to ``number``.
    """
    lot = F.xxhash64("sentence")
    if every > 4 * number:
        rows = rows.filter(F.pmod(lot, F.lit(1_000_000_000)) < math.ceil(4_000_000_000 * number / every))
    return [r["sentence"] for r in rows.select("sentence").distinct().orderBy(lot, "sentence").limit(number).collect()]


def _pa_type(kind: str) -> pa.DataType:
    return {"bigint": pa.int64(), "int": pa.int32()}.get(kind, pa.string())


def content_models(scanned: DataFrame, train_sentences: int = TRAIN_SENTENCES) -> dict[str, tuple[float, dict[str, float]]]:
    """Bias and weights of each category's classifier, from the label model over all votes.

    Every sentence with votes stands in the training twice, by its words and
    votes and, at half the weight, by its words alone, so the words learn to
    speak without the votes; sentences that no voter speaks for are harmless.
    The ridge pulls the votes' weights to the label model's log odds.
    """
    said = scanned.select(F.explode("spoken").alias("s")).select("s.*")
    # distinct vote patterns: their number depends on the voters, not on the documents
    counted: dict[str, Counter] = {c: Counter() for c in V.CATEGORIES}
    for r in said.groupBy("category", "votes").agg(F.count("*").alias("n")).collect():
        counted[r["category"]][r["votes"]] = r["n"]
    every = scanned.agg(F.sum("n_sentences").alias("n")).first()["n"] or 0
    chosen = _some(scanned.select(F.explode(F.split("plain", "\n")).alias("sentence")), every, train_sentences)
    for c in V.CATEGORIES:
        chosen += _some(said.filter(F.col("category") == c), counted[c].total(), train_sentences)
    chosen = [s for s in dict.fromkeys(chosen) if s]
    votes = [spoken_votes(s) for s in chosen]
    words = [features(s) for s in chosen]
    models = {}
    for c in V.CATEGORIES:
        model = LabelModel([v[0] for v in V.VOTERS[c]], [v[2] for v in V.VOTERS[c]])
        if counted[c]:
            model.fit(dict(counted[c]))
        prior, gain = model.log_odds()
        # an intercept of their own takes sentences with votes to the label model's odds
        centre = {"\t": prior - SILENT, **{f"\t{n}": v for n, v in gain.items()}}
        rows, target, weight = [], [], []
        for own, spoken in zip(words, votes):
            if pattern := spoken.get(c):
                p = model.posterior(pattern)
                rows += [own + ["\t"] + [f"\t{n}" for n, v in zip(model.names, pattern) if v != "0"], own]
                target += [p, p]
                weight += [1.0, 0.5]
            else:
                rows.append(own)
                target.append(0.0)
                weight.append(1.0)
        models[c] = train_linear(rows, np.array(target), np.array(weight), centre)
    return models


def content_scores(documents: DataFrame, train_sentences: int = TRAIN_SENTENCES) -> DataFrame:
    """doc_id and the scores abuse, hate and sexual (0 to 1) of every document: its worst sentence's.

    Null and empty texts score as an empty sentence does.  Votes are counted
    over all sentences of all documents and all are scored; the classifiers
    are fitted on at most ``train_sentences`` distinct sentences of all, and as
    many of those that a voter speaks for, by category: those of the smallest
    hashes.
    """
    kind = documents.schema["doc_id"].dataType.simpleString()
    spoken = "array<struct<category string, votes string, sentence string>>"
    scanned = settle(documents.filter("doc_id is not null").select("doc_id", "text").mapInArrow(_scan(_pa_type(kind)), f"doc_id {kind}, plain string, spoken {spoken}, n_sentences long"))
    models = content_models(scanned, train_sentences)
    out = f"doc_id {kind}, " + ", ".join(f"{c} double" for c in V.CATEGORIES)
    return scanned.select("doc_id", "plain", "spoken").mapInArrow(_score(models, _pa_type(kind)), out)


def found_content(scores: DataFrame, threshold: float = 0.5) -> DataFrame:
    """doc_id, category of every score of at least ``threshold``."""
    cells = F.array(*[F.struct(F.lit(c).alias("category"), F.col(c).alias("score")) for c in V.CATEGORIES])
    return scores.select("doc_id", F.explode(cells).alias("c")).filter(F.col("c.score") >= threshold).select("doc_id", "c.category").distinct()


def content_rates(documents: DataFrame, scores: DataFrame, threshold: float = 0.5) -> DataFrame:
    """source, n_docs and the share of its documents at or over the threshold, by category."""
    sources = documents.filter("doc_id is not null").select("doc_id", "source")
    shares = [F.avg((F.col(c) >= threshold).cast("double")).alias(f"{c}_rate") for c in V.CATEGORIES]
    return sources.join(scores, "doc_id").groupBy("source").agg(F.count("*").alias("n_docs"), *shares)
