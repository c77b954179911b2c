"""Evaluation texts leaking into training text, found with a positional inverted index.

The index is partitioned by document: each row is a block of documents with
its postings in term-major order, term -> places, so building and intersecting
it moves no posting between tasks, and any set of items is looked up in it.
For each item the rarest words of the corpus are the anchors: every stretch of
half the item contains several.  Anchor postings, also those of words that
share a deletion form with an anchor, less the anchor's offset give the places
where the item may stand; there the document's words are read back from the
postings and compared with the expected ones to the longest unbroken run.
Whether a word is damaged is decided there, by the expected word alone, so
neither the other items nor the blocks they are taken in have a say.
``near_items`` finds the items' words close together in any order.
"""

from __future__ import annotations

import re
from array import array
from collections import defaultdict
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import groupby, product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tamarack.llm.cues import dialogue, may_advertise
from tamarack.workspace import settle

#: Words of items handled in one pass over the index; more items are taken in blocks.
BLOCK_WORDS = 2_000_000
#: Words of documents from which a block of the index is closed; a block holds whole documents.
INDEX_WORDS = 1 << 18
#: Anchors within every stretch that must be found.
ANCHORS = 3
#: Letters that character recognition confuses count as one, punctuation separates, apostrophes vanish.
_ONE = bytes.maketrans(b"1i|0bfc", b"lllohte")
#: Capitals, which lower-case text doesn't hold, are the digits that characters of other scripts are written with, four each.
_KEEP = set(b"abcdefghijklmnopqrstuvwxyz0123456789|ABCDEFGHIJKLMNOP")
_TABLE = bytes((_ONE[c] if c in _KEEP else 32) for c in range(256))
_HEX = str.maketrans("0123456789abcdef", "ABCDEFGHIJKLMNOP")
_UNHEX = str.maketrans("ABCDEFGHIJKLMNOP", "0123456789abcdef")
_WIDE = re.compile("[぀-鿿가-힯]|[Ͱ-῿]{2,}")
_WIDE_WORD = re.compile("[A-P]{4}")
_NUMBER = re.compile("[0-9lo]*[2-9][0-9lo]*")
_PAIR = re.compile("(ss|rn)")
#: Characters from which a damaged word is sure to be the expected one; shorter ones and numbers count between others only.
SURE = 4
#: Damaged words not sure of themselves that may follow each other within a run.
UNSURE = 2
#: Right words of a run for each damaged one; where there are fewer, or at a run's end, a damaged word must be no word of any item.
STRAY = 3


def _raw(text: str) -> bytes:
    low = text.lower()
    if not low.isascii():
        if _WIDE.search(low):
            low = _WIDE.sub(lambda m: " " + "".join(f"{ord(c):04x}" for c in m.group()).translate(_HEX) + " ", low)
        raw = low.encode("ascii", "ignore")
    else:
        raw = low.encode()
    return raw.replace(b"'", b"")


def _full(text: str) -> list[bytes]:
    """Words as in ``words``, with ss and rn as they are."""
    return _raw(text).translate(_TABLE).split()


def _joined(word: bytes) -> bytes:
    return word.replace(b"ss", b"").replace(b"rn", b"m")


def words(text: str) -> list[bytes]:
    """Canonical words: lower case, look-alike characters as one, marks and Latin letters with accents left out.

    Leaving them out makes a word the same whether its accents are right,
    lost or garbled; ss goes with them, as capitals write it for a sharp s.  Words of other scripts are kept as they are, characters
    of scripts without blanks one by one.
    """
    return _raw(text).replace(b"ss", b"").replace(b"rn", b"m").translate(_TABLE).split()


def _text(word: bytes) -> str:
    """A canonical word with one character for each of its characters."""
    w = word.decode()
    return _WIDE_WORD.sub(lambda m: chr(int(m.group().translate(_UNHEX), 16)), w) if "A" <= w[:1] <= "P" or not w.islower() else w


@lru_cache(1 << 16)
def _forms(full: bytes) -> tuple[str, ...]:
    """The forms of an item's word that a damaged one may come from: each ss and rn as it is or as ``words`` writes it."""
    parts = _PAIR.split(_text(full))
    ways = [((p,) if k % 2 == 0 else (p, "" if p == "ss" else "m")) for k, p in enumerate(parts[:9])]
    return tuple({"".join(way) + "".join(parts[9:]) for way in product(*ways)})


def _within_one(x: str, y: str) -> bool:
    """Whether one wrong, missing or added character makes x of y."""
    if len(x) > len(y):
        x, y = y, x
    if len(y) - len(x) > 1:
        return False
    k = 0
    while k < len(x) and x[k] == y[k]:
        k += 1
    return x[k + 1 :] == y[k + 1 :] if len(x) == len(y) else x[k:] == y[k + 1 :]


@lru_cache(1 << 17)
def near(word: bytes, full: bytes) -> bool:
    """Whether a document's canonical word is an item's word with at most one wrong, missing or added character."""
    x = _text(word)
    for y in _forms(full):
        if _within_one(x, y):
            return True
        # a wrong character that makes an ss or rn of its neighbour
        if len(x) < len(y):
            for k in range(len(y) - 1):
                if ("s" in y[k : k + 2] and x == y[:k] + y[k + 2 :]) or ((y[k] == "r" or y[k + 1] == "n") and x == y[:k] + "m" + y[k + 2 :]):
                    return True
    return False


@lru_cache(1 << 16)
def _sure(full: bytes) -> bool:
    w = _text(full)
    return len(w) >= SURE and not _NUMBER.fullmatch(w)


def _deletions(w: str) -> set[str]:
    return {w, *(w[:k] + w[k + 1 :] for k in range(len(w)))}


def readings(text: str) -> list[list[bytes]]:
    """The canonical words of a document without its adverts, and with them where it has any, as an item may hold an address itself."""
    own = words(" ".join(dialogue(text)))
    whole = words(" ".join(dialogue(text, adverts=True))) if may_advertise(text) else own
    return [x for x in ([own] if own == whole else [own, whole]) if x]


def _block(docs: list, lengths: list[int], terms: dict[bytes, int], ids: array, doc_type: pa.DataType) -> pa.RecordBatch:
    """One row of the index: places of each term's occurrences, counted from the block's start, terms by their first place."""
    term = np.frombuffer(ids, dtype=np.int32)
    places = np.argsort(term, kind="stable").astype(np.int32)
    counts = np.bincount(term, minlength=len(terms)).astype(np.int32)
    owner = np.repeat(np.arange(len(docs)), lengths)[places]
    first = np.ones(len(places), dtype=np.int32)
    first[1:] = (owner[1:] != owner[:-1]) | (term[places][1:] != term[places][:-1])
    n_docs = np.add.reduceat(first, np.concatenate([[0], np.cumsum(counts)[:-1]])).astype(np.int32)
    one = lambda values: pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)
    cells = [pa.array(docs, doc_type), pa.array(lengths, pa.int32()), pa.array([t.decode() for t in terms], pa.string()), pa.array(n_docs), pa.array(counts), pa.array(places)]
    return pa.RecordBatch.from_arrays([one(c) for c in cells], names=["docs", "lengths", "terms", "n_docs", "counts", "places"])


def _index(doc_type: pa.DataType, index_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        docs: list = []
        lengths: list[int] = []
        terms: dict[bytes, int] = {}
        ids = array("i")
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                text = text.as_py()
                for own in readings(text) if text and doc is not None else ():
                    docs.append(doc)
                    lengths.append(len(own))
                    ids.extend([terms.setdefault(w, len(terms)) for w in own])
                    if len(ids) >= index_words:
                        yield _block(docs, lengths, terms, ids, doc_type)
                        docs, lengths, terms, ids = [], [], {}, array("i")
        if docs:
            yield _block(docs, lengths, terms, ids, doc_type)

    return run


def positional_index(documents: DataFrame, index_words: int = INDEX_WORDS) -> DataFrame:
    """The positional inverted index of all words of all documents, to be stored once and searched for any items.

    Rows are blocks of whole documents: docs and lengths (ids and numbers of
    words), terms with n_docs and counts, and places, the postings of the terms
    one after the other.  A document with adverts stands in it twice, without
    and with them.  Null texts and ids, and texts without words, are left out.
    """
    kind = documents.schema["doc_id"].dataType.simpleString()
    schema = f"docs array<{kind}>, lengths array<int>, terms array<string>, n_docs array<int>, counts array<int>, places array<int>"
    return documents.select("doc_id", "text").mapInArrow(_index(_arrow_type(kind), index_words), schema)


def _arrow_type(kind: str) -> pa.DataType:
    return {"bigint": pa.int64(), "int": pa.int32()}.get(kind, pa.string())


class _Shard:
    """A block of the index, read."""

    def __init__(self, batch: pa.RecordBatch, row: int):
        cell = lambda name: batch.column(batch.schema.get_field_index(name))[row].values
        self.docs = cell("docs").to_pylist()
        self.terms = [t.encode() for t in cell("terms").to_pylist()]
        self.places = cell("places").to_numpy()
        counts = cell("counts").to_numpy()
        self.ends = np.cumsum(counts)
        self.doc_ends = np.cumsum(cell("lengths").to_numpy())
        self.ids = np.empty(len(self.places), dtype=np.int32)
        self.ids[self.places] = np.repeat(np.arange(len(self.terms), dtype=np.int32), counts)

    def postings(self, term: int) -> np.ndarray:
        return self.places[(self.ends[term - 1] if term else 0) : self.ends[term]]

    def span(self, doc: int) -> tuple[int, int]:
        return (int(self.doc_ends[doc - 1]) if doc else 0), int(self.doc_ends[doc])


def anchors_of(items: list[tuple[int, list[int]]], frequency: dict[int, int], least: float = 0.5, number: int = ANCHORS) -> dict[int, list[tuple[int, int]]]:
    """term -> (item number, place in the item), so that every stretch of ``least`` of an item holds ``number`` anchors of its rarest words."""
    out: dict[int, list[tuple[int, int]]] = defaultdict(list)
    for n, (_, terms) in enumerate(items):
        span = max(1, -(-len(terms) * least // 1).__int__())
        chosen: set[int] = set()
        for start in range(0, max(1, len(terms) - span + 1)):
            window = range(start, min(start + span, len(terms)))
            have = sum(k in chosen for k in window)
            if have < number:
                rest = sorted((k for k in window if k not in chosen), key=lambda k: (frequency.get(terms[k], 0), -k))
                chosen.update(rest[: number - have])
        for k in chosen:
            out[terms[k]].append((n, k))
    return dict(out)


def _damaged(item: list[bytes], full: list[bytes], own: list[bytes], a: int, b: int, way: int) -> tuple[int, int, bool] | None:
    """How the item's word a may stand damaged at the document's word b: words of the item and of the document it takes, and whether it is sure."""
    n, m, f = len(item), len(own), full[a]
    options = []
    if near(own[b], f):
        options.append((1, 1, _sure(f)))
    # a stray sign within a word, or a letter of another script, parts it
    for size in (2, 3):
        last = b + way * (size - 1)
        if not 0 <= last < m:
            break
        parts = own[min(b, last) : max(b, last) + 1]
        if (size == 2 or len(_text(parts[1])) == 1) and near(b"".join(parts), f):
            options.append((1, size, _sure(f)))
    if 0 <= a + way < n:
        # a lost blank joins two words, and a lost or added character of a script without blanks is a word
        if own[b] == _joined(f + full[a + way] if way > 0 else full[a + way] + f):
            options.append((2, 1, True))
        if f.isupper() and len(f) == 4 and item[a + way] == own[b]:
            options.append((2, 1, True))
    if own[b].isupper() and len(own[b]) == 4 and 0 <= b + way < m and own[b + way] == item[a]:
        options.append((1, 2, True))
    for x, y, sure in options:
        if 0 <= a + way * x < n and 0 <= b + way * y < m and item[a + way * x] == own[b + way * y]:
            return x, y, sure
    return options[0] if options else None


def _chain(item: list[bytes], full: list[bytes], own: list[bytes], i: int, j: int, way: int) -> list[tuple[int, int, list[bytes], list[bytes]]]:
    """Where a run from item place i at document place j may end in one direction: item place, right words up to it, damaged words up to it, and those of them after the last right word.

    These are the end of the right words, the last place at which damage is still stray, and the end of all.
    """
    n, m, unsure, right = len(item), len(own), 0, 0
    bad: list[bytes] = []
    loose: list[bytes] = []
    ends = [(i, 0, [], [])] * 3
    while 0 <= (a := i + way) < n and 0 <= (b := j + way) < m:
        if own[b] == item[a]:
            i, j, unsure, right, loose = a, b, 0, right + 1, []
        else:
            step = _damaged(item, full, own, a, b, way)
            if step is None:
                break
            last = b + way * (step[1] - 1)
            form = b" ".join(own[min(b, last) : max(b, last) + 1])
            bad, loose = [*bad, form], [*loose, form]
            i, j = i + way * step[0], last
            unsure = 0 if step[2] else unsure + 1
            if unsure > UNSURE:
                break
        if not unsure:
            ends[2] = (i, right, bad, loose)
            if right >= STRAY * len(bad) and not loose:
                ends[1] = ends[2]
            if not bad:
                ends[0] = ends[2]
    return ends


def _runs(item: list[bytes], full: list[bytes], own: list[bytes], places: list[tuple[int, int, bool]], need: float) -> list[tuple[int, tuple[bytes, ...]]]:
    """Lengths of at least ``need`` of the item's runs through (shift, item place, whether the word is right), each with the damaged words that must be no word of any item."""
    best, doubtful = 0, {}
    # the runs of one shift follow each other; each starts where the one before ended
    before, done = None, -1
    for shift, k, right in places:
        if shift != before:
            before, done = shift, -1
        if k <= done:
            continue
        p = k + shift
        sure = right or _sure(full[k])
        if not sure and not ((k + 1 < len(item) and p + 1 < len(own) and item[k + 1] == own[p + 1]) or (k and p and item[k - 1] == own[p - 1])):
            continue
        ahead, back = _chain(item, full, own, k, p, 1), _chain(item, full, own, k, p, -1)
        done = ahead[0][0] if right else k
        for last, right_a, bad_a, loose_a in ahead:
            for first, right_b, bad_b, loose_b in back:
                length = last - first + 1 - (not sure and (first == k or last == k))
                bad = [*bad_a, *bad_b] if right else [*bad_a, own[p], *bad_b]
                good = right_a + right_b + right
                if length < need or length <= best or not good:
                    continue
                if good >= STRAY * len(bad):
                    bad = [*loose_a, *loose_b] if right else [*loose_a, *([own[p]] if not right_a or not right_b else []), *loose_b]
                if not bad:
                    best = length
                else:
                    doubtful[frozenset(bad)] = max(length, doubtful.get(frozenset(bad), 0))
    return [(best, ())] * (best > 0) + [(v, tuple(b)) for b, v in doubtful.items() if v > best]


def _hits(shard: _Shard, anchors: Callable[[bytes], tuple]) -> Iterator[tuple[int, int, list[tuple[int, int, bool]]]]:
    """Document, item and sorted (shift, item place, whether the word is right) of every document of a block that holds an anchor's posting."""
    parts = []
    for t, term in enumerate(shard.terms):
        for n, k, right in anchors(term):
            at = shard.postings(t)
            parts.append(np.column_stack([at, np.full((len(at), 3), (n, k, right), dtype=np.int64)]))
    if not parts:
        return
    rows = np.concatenate(parts)
    doc = np.searchsorted(shard.doc_ends, rows[:, 0], side="right")
    starts = np.concatenate([[0], shard.doc_ends[:-1]])
    # the offset-adjusted lists: one document, item and shift together
    shift = rows[:, 0] - starts[doc] - rows[:, 2]
    order = np.lexsort((rows[:, 3], rows[:, 2], shift, rows[:, 1], doc))
    table = np.column_stack([doc, rows[:, 1], shift, rows[:, 2], rows[:, 3]])[order].tolist()
    for (d, n), group in groupby(table, key=lambda r: (r[0], r[1])):
        yield d, n, [(r[2], r[3], bool(r[4])) for r in group]


def _intersect(items: list[tuple[int, list[bytes], list[bytes]]], anchors: dict[bytes, list[tuple[int, int]]], least: float, doc_type: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forms: dict[str, set[bytes]] = defaultdict(set)
        for w, places in anchors.items():
            for full in {items[n][2][k] for n, k in places}:
                for y in _forms(full):
                    if len(y) > 1:
                        for form in _deletions(y):
                            forms[form].add(w)
        known: dict[bytes, tuple] = {}

        def candidates(word: bytes) -> tuple:
            """Item number, place and whether the word is right, of the anchors that ``word`` is or may be damaged from."""
            if (got := known.get(word)) is not None:
                return got
            x = _text(word)
            out = [(n, k, True) for n, k in anchors.get(word, ())]
            for w in {w for form in _deletions(x) for w in forms.get(form, ())} - {word}:
                out += [(n, k, False) for n, k in anchors[w] if near(word, items[n][2][k])]
            if len(known) > 500_000:
                known.clear()
            known[word] = tuple(out)
            return known[word]

        for batch in batches:
            docs, found, spans, sizes, doubts = [], [], [], [], []
            for row in range(batch.num_rows):
                shard = _Shard(batch, row)
                current, own = -1, []
                for d, n, places in _hits(shard, candidates):
                    if d != current:
                        first, last = shard.span(d)
                        current, own = d, [shard.terms[t] for t in shard.ids[first:last].tolist()]
                    item_id, item, full = items[n]
                    for length, bad in _runs(item, full, own, places, least * len(item)):
                        docs.append(shard.docs[d])
                        found.append(item_id)
                        spans.append(length)
                        sizes.append(len(item))
                        doubts.append([w.decode() for w in bad])
            yield pa.RecordBatch.from_arrays([pa.array(docs, doc_type), pa.array(found, pa.int64()), pa.array(spans, pa.int32()), pa.array(sizes, pa.int32()), pa.array(doubts, pa.list_(pa.string()))], names=["doc_id", "item_id", "run_words", "item_words", "doubts"])

    return run


def _spelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = {w for text in batch.column(0).to_pylist() for w in words(" ".join(dialogue(text, adverts=True)))}
        yield pa.RecordBatch.from_arrays([pa.array([w.decode() for w in found], pa.string())], names=["word"])


def _item_blocks(items: DataFrame, block_words: int) -> Iterator[list[tuple[int, list[bytes], list[bytes]]]]:
    """Items with their canonical words and the words as written, in blocks of bounded size."""
    block: list[tuple[int, list[bytes], list[bytes]]] = []
    size = 0
    for row in items.select(F.col("item_id").cast("long").alias("i"), F.col("item_text").alias("t")).filter("i is not null and t is not null").distinct().toLocalIterator():
        full = [w for w in _full(" ".join(dialogue(row["t"], adverts=True))) if _joined(w)]
        ws = [_joined(w) for w in full]
        if ws:
            block.append((row["i"], ws, full))
            size += len(ws)
            if size >= block_words:
                yield block
                block, size = [], 0
    if block:
        yield block


def document_counts(index: DataFrame, vocabulary: list[bytes]) -> dict[bytes, int]:
    """In how many documents of the index each word of the vocabulary stands, adverts read twice counted twice."""
    spark = index.sparkSession
    asked = spark.createDataFrame([(w.decode(),) for w in vocabulary], "term string")
    have = index.select(F.explode(F.arrays_zip("terms", "n_docs")).alias("t")).select(F.col("t.terms").alias("term"), F.col("t.n_docs").alias("n"))
    return {r["term"].encode(): r["n"] for r in have.join(asked, "term", "left_semi").groupBy("term").agg(F.sum("n").alias("n")).collect()}


_FOUND = "item_id bigint, run_words int, item_words int"


def search_index(index: DataFrame, items: DataFrame, least: float = 0.5, block_words: int = BLOCK_WORDS) -> DataFrame:
    """``leaked_items`` over a stored ``positional_index``."""
    doc_type = index.schema["docs"].dataType.elementType.simpleString()
    result = None
    for block in _item_blocks(items, block_words):
        vocabulary: dict[bytes, int] = {}
        coded = [(i, [vocabulary.setdefault(w, len(vocabulary)) for w in ws]) for i, ws, _ in block]
        spelled = list(vocabulary)
        counts = document_counts(index, spelled)
        anchors = {spelled[t]: places for t, places in anchors_of(coded, {vocabulary[w]: n for w, n in counts.items()}, least).items()}
        part = index.mapInArrow(_intersect(block, anchors, least, _arrow_type(doc_type)), f"doc_id {doc_type}, {_FOUND}, doubts array<string>")
        result = part if result is None else result.unionByName(part)
    if result is None:
        return index.sparkSession.createDataFrame([], f"doc_id {doc_type}, {_FOUND}")
    result = settle(result)
    # the words of all items, not of a block, say whether a doubtful word is one of its own right
    known = items.filter("item_id is not null and item_text is not null").select("item_text").mapInArrow(_spelled, "word string").distinct()
    wrong = result.filter("size(doubts) > 0").withColumn("word", F.explode("doubts")).join(known, "word", "left_semi").select("doc_id", "item_id", "doubts").distinct()
    result = result.join(wrong, ["doc_id", "item_id", "doubts"], "left_anti")
    return result.groupBy("doc_id", "item_id").agg(F.max("run_words").alias("run_words"), F.max("item_words").alias("item_words"))


def leaked_items(documents: DataFrame, items: DataFrame, least: float = 0.5, block_words: int = BLOCK_WORDS, index_words: int = INDEX_WORDS) -> DataFrame:
    """doc_id, item_id, run_words, item_words of every document that holds at least ``least`` of an item's words in one run.

    Cue numbers, times, tags, sound descriptions, case, punctuation and
    look-alike characters don't count, nor do the lines of adverts that part a
    run, nor does a single wrong, missing or added character of a word; of a
    number or a word of under four characters only within a run, as at its end
    it may well be another word.  A run with fewer than ``STRAY`` right words
    for each damaged one, or with damaged words at an end, counts only if these
    are no words of some item.
    Items without words match nothing; null texts and ids are ignored; an item
    id with several texts is looked for by each, its longest run counts.
    Items are taken in blocks of ``block_words`` words, one pass over the
    index each, so what a task holds is bounded.
    """
    return search_index(settle(positional_index(documents, index_words)), items, least, block_words)


def _near(items: list[tuple[int, list[bytes]]], chosen: dict[bytes, list[int]], least: float, slack: float, doc_type: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs, found, most, sizes = [], [], [], []
            for row in range(batch.num_rows):
                shard = _Shard(batch, row)
                number = {w: t for t, w in enumerate(shard.terms)}
                for d, n, places in _hits(shard, lambda term: [(n, 0, True) for n in chosen.get(term, ())]):
                    item_id, own = items[n]
                    first, last = shard.span(d)
                    width = max(1, int(slack * len(own)))
                    sought = {number[w] for w in set(own) if w in number}
                    best, done = 0, -1
                    for shift, _, _ in places:
                        low, high = max(0, shift - width + 1, done), min(last - first, shift + width)
                        # places looked at before are looked at again only as far as a window reaches over them
                        seen = [(p, t) for p, t in enumerate(shard.ids[first + low : first + high].tolist(), low) if t in sought]
                        count: dict[int, int] = {}
                        left = 0
                        for p, t in seen:
                            count[t] = count.get(t, 0) + 1
                            while seen[left][0] <= p - width:
                                u = seen[left][1]
                                count[u] -= 1
                                if not count[u]:
                                    del count[u]
                                left += 1
                            best = max(best, len(count))
                        done = max(low, high - width + 1)
                    if best >= least * len(set(own)):
                        docs.append(shard.docs[d])
                        found.append(item_id)
                        most.append(best)
                        sizes.append(len(set(own)))
            yield pa.RecordBatch.from_arrays([pa.array(docs, doc_type), pa.array(found, pa.int64()), pa.array(most, pa.int32()), pa.array(sizes, pa.int32())], names=["doc_id", "item_id", "near_words", "item_words"])

    return run


def near_items(index: DataFrame, items: DataFrame, least: float = 0.8, slack: float = 1.5, block_words: int = BLOCK_WORDS) -> DataFrame:
    """doc_id, item_id, near_words, item_words of every document with a stretch of ``slack`` times the item's length that holds at least ``least`` of the item's different words, in any order.

    ``index`` is a ``positional_index``.  Words count as there, undamaged.
    near_words is the most different words in one stretch.  A stretch with that
    many words holds one of the item's rarest, so many of them that the others
    are too few; only their postings are followed.  Items without words match
    nothing; an item id with several texts is looked for by each.
    """
    doc_type = index.schema["docs"].dataType.elementType.simpleString()
    out = f"doc_id {doc_type}, item_id bigint, near_words int, item_words int"
    result = None
    for block in _item_blocks(items, block_words):
        counts = document_counts(index, list({w for _, ws, _ in block for w in ws}))
        chosen: dict[bytes, list[int]] = defaultdict(list)
        for n, (_, ws, _) in enumerate(block):
            rarest = sorted(set(ws), key=lambda w: (counts.get(w, 0), w))
            for w in rarest[: len(rarest) - max(1, int(np.ceil(least * len(rarest)))) + 1]:
                chosen[w].append(n)
        part = index.mapInArrow(_near([(i, ws) for i, ws, _ in block], dict(chosen), least, slack, _arrow_type(doc_type)), out)
        result = part if result is None else result.unionByName(part)
    if result is None:
        return index.sparkSession.createDataFrame([], out)
    return result.groupBy("doc_id", "item_id").agg(F.max(F.struct("near_words", "item_words")).alias("b")).select("doc_id", "item_id", "b.near_words", "b.item_words")
