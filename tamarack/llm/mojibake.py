"""Text garbled by a wrong decoding, found and restored with a noisy-channel model.

A channel is a pair of encodings: the one the text was written in and the one
it was read with.  Every word with unusual characters gets a lattice of
candidates: its bytes under the wrong encoding, read with the right one, with
wildcards where bytes were lost, and the corpus words that a lossy channel
turns into it.  A candidate gains by its frequency in the corpus against the
garbled form's, and by what only a wrong decoding explains; a Viterbi search
over the words of a field finds the best path, charging for every change of
channel.
"""

from __future__ import annotations

import math
import unicodedata
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tamarack.workspace import settle

#: Encodings that texts are written in and read with, and what a channel of that first encoding costs.
WRITTEN = {"utf-8": 1.0, "cp1252": 2.0, "cp1251": 2.0, "cp1250": 2.2, "gbk": 2.0, "cp932": 2.0, "euc_jp": 2.0, "koi8_r": 2.5, "cp866": 2.5, "mac_roman": 3.0, "big5": 3.0, "euc_kr": 3.0}
READ = ("cp1252", "latin_1", "cp437", "cp850", "mac_roman", "cp1251", "cp1250", "koi8_r", "cp866", "gbk", "cp932", "utf-8")
WIDE = ("gbk", "cp932", "euc_jp", "big5", "euc_kr")
#: Stands for a character that lost bytes (private use, so no text has it by right).
WILD = "\ue000"
LOST = "\ufffd"
#: Cost of changing from one channel to another, and into or out of a damaged span.
SWITCH, ENTER = 4.0, 0.3
#: Characters that right text doesn't hold: control characters, the replacement character, private use.
MARKS = "[\\x{80}-\\x{9f}\\x{fffd}\\x{e000}-\\x{f8ff}]"
#: What a form that doesn't occur counts as, and the evidence of one whole multibyte character.
UNSEEN, WHOLE = 0.3, 3.0
#: What it costs that a word from which a lossy channel took all signs of damage is taken for one.
UNMARKED = 2.0
#: Signs beyond ASCII: a word of letters alone, such as a Russian one, may be valid UTF-8 in some code page by chance.
SIGNS = "[^\\x00-\\x7f\\p{L}\\p{M}]|[\u00aa\u00ba\u00b5]"
LATTICE = "array<struct<channel string, form string, evidence double>>"


def _c1(text: str) -> bool:
    return any("\x80" <= c <= "\x9f" for c in text)


def _bytes(word: str, read: str) -> bytes | None:
    """The bytes that ``read`` turned into ``word``; bytes it has no character for may stand as control characters."""
    try:
        return word.encode(read)
    except UnicodeEncodeError:
        if read == "gbk":
            # its later form gives private-use characters to more pairs of bytes
            wide = word.encode("gb18030", "surrogatepass")
            return wide if len(wide) == sum(1 if c.isascii() else 2 for c in word) else None
        if read not in ("cp1252", "cp1250", "cp1251"):
            return None
    out = bytearray()
    for c in word:
        try:
            out += c.encode(read)
        except UnicodeEncodeError:
            if not "\x80" <= c <= "\x9f":
                return None
            out.append(ord(c))
    return bytes(out)


def _utf8_lattice(raw: bytes) -> tuple[str, int, int] | None:
    """UTF-8 with wildcards for characters that lost bytes: text, whole and wild multibyte characters; None if it isn't UTF-8."""
    out, whole, wild, k = [], 0, 0, 0
    while k < len(raw):
        b = raw[k]
        need = 0 if b < 0x80 else 1 if 0xC2 <= b < 0xE0 else 2 if 0xE0 <= b < 0xF0 else 3 if 0xF0 <= b < 0xF5 else -1
        if need < 0:
            return None
        part = raw[k : k + need + 1]
        if need == 0:
            out.append(chr(b))
            k += 1
            continue
        have = 1
        while have <= need and k + have < len(raw) and 0x80 <= raw[k + have] < 0xC0:
            have += 1
        try:
            if have <= need:
                raise ValueError
            out.append(part.decode())
            whole += 1
        except ValueError:
            out.append(WILD)
            wild += 1
        k += have
    return "".join(out), whole, wild


def _script(c: str) -> str:
    o = ord(c)
    if not c.isalpha():
        return ""
    return "latin" if o < 0x250 else "cyrillic" if 0x400 <= o < 0x530 else "wide" if o >= 0x2E80 else "other"


def _odd(word: str) -> bool:
    """A word that mixes scripts or has a capital with an accent after a small letter."""
    scripts = {s for c in word if (s := _script(c))}
    if len(scripts) > 1:
        return True
    return any(a.islower() and b.isupper() and not b.isascii() for a, b in zip(word, word[1:]))


def _plausible(text: str) -> bool:
    return not any(unicodedata.category(c) in ("Cc", "Cn", "Co", "Cs") or c == LOST or "｡" <= c <= "ﾟ" or "─" <= c <= "▟" for c in text)


def backward(word: str) -> list[tuple[str, str, float]]:
    """Candidates of a garbled word that lost nothing, or that UTF-8's form lets us read with wildcards: channel, form, evidence."""
    out: dict[tuple[str, str], float] = {}
    seen = _c1(word)
    whole_bytes = {}
    for read in READ:
        if read != "utf-8" and (raw := _bytes(word, read)) is not None and raw.isascii() is False:
            whole_bytes[read] = raw
    for read, raw in whole_bytes.items():
        for written in WRITTEN:
            if written == read or {written, read} == {"cp1252", "latin_1"}:
                continue
            channel = f"{written}>{read}"
            if written == "utf-8":
                got = _utf8_lattice(raw)
                if got is None or not got[1] + got[2]:
                    continue
                form, whole, wild = got
                # loose marks over Latin letters are rarely written
                evidence = WHOLE * whole + 0.5 * wild - 0.5 * any("\u0300" <= c <= "\u036f" for c in form)
                if not wild and not form.isascii():
                    # read twice with the wrong encoding
                    for again in ("cp1252", "latin_1"):
                        inner = _bytes(form, again)
                        twice = _utf8_lattice(inner) if inner is not None else None
                        if twice and twice[1] and not twice[2] and _plausible(twice[0]):
                            out[(channel + ">twice", twice[0])] = evidence + 3.0 * twice[1]
                            break
            else:
                try:
                    form = raw.decode(written)
                except UnicodeDecodeError:
                    continue
                evidence = 2.0 * (_odd(word) and not _odd(form))
                alien = [c for c in form if _script(c) in ("cyrillic", "wide")]
                if all(0x80 <= ord(c) < 0x2030 and not 0x250 <= ord(c) < 0x2000 for c in word) and len(alien) >= 3 - (written in WIDE) and len(alien) == sum(c.isalpha() for c in form):
                    evidence += 0.6 * len(alien)
            if form != word and _plausible(form.replace(WILD, "")):
                key = (channel, form)
                out[key] = max(out.get(key, -1.0), evidence + 2.0 * seen)
    return [(c, f, e) for (c, f), e in out.items()]


def forward(word: str) -> list[tuple[str, str, float]]:
    """What lossy channels turn a word into: channel, garbled form, evidence."""
    out: dict[tuple[str, str], float] = {}

    def add(channel: str, garbled: str, evidence: float) -> None:
        garbled = garbled.strip(" ")
        if garbled.isascii() and "?" not in garbled:
            # what is left bears no mark of damage: a number or a few letters may stand for themselves, other words mostly do
            if sum(map(str.isalpha, garbled)) < 3:
                return
            evidence -= UNMARKED
        if garbled and garbled != word:
            # a word of lost characters alone could be anything
            out.setdefault((channel, garbled), evidence if garbled.strip(LOST + "?") else -9.0)

    for written in WRITTEN:
        try:
            raw = word.encode(written)
        except UnicodeEncodeError:
            continue
        for read in READ:
            if read == written:
                continue
            channel = f"{written}>{read}"
            if read in ("cp1252", "cp1250", "cp1251", "latin_1"):
                kept = "".join(chr(b) if 0x80 <= b <= 0x9F and read == "latin_1" else bytes([b]).decode(read, "replace") for b in raw)
                add(channel, kept, 1.0)
                add(channel, "".join(c for c in kept if c != LOST and not "\x80" <= c <= "\x9f"), 1.0)
                add(channel, "".join(c for c in kept if c != LOST and not "\x80" <= c <= "\x9f").replace("\xa0", " "), 0.5)
            elif read == "utf-8" and not raw.isascii() and LOST not in raw.decode(read, "replace"):
                # the word itself is UTF-8 read wrongly, however often it occurs
                continue
            else:
                add(channel, raw.decode(read, "replace"), 1.0)
                if read == "gbk":
                    add(channel, raw.decode("gb18030", "replace"), 1.0)
                if read != "utf-8":
                    add(channel, raw.decode(read, "ignore"), 0.5)
    add("ascii", word.encode("ascii", "replace").decode(), 0.5)
    add("holes", "".join(c if c.isascii() else LOST for c in word), 0.5)
    return [(c, g, e) for (c, g), e in out.items()]


def _lattice_udf(fn):
    def run(words: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in words:
            yield pd.Series([[{"channel": c, "form": f, "evidence": float(e)} for c, f, e in fn(w)] for w in batch], dtype=object)

    run.__annotations__ = {"words": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return F.pandas_udf(run, LATTICE)


def viterbi(tokens: list[str], lattice: list[dict[str, tuple[float, str]]]) -> list[str]:
    """The best channel for each token ('' where it is right): sum of gains less the cost of changes."""
    states = [""] + sorted({c for d in lattice for c in d})
    score = {s: 0.0 if s == "" else -ENTER for s in states}
    back: list[dict[str, str]] = []
    for token, options in zip(tokens, lattice):
        now, way = {}, {}
        for s in states:
            if s == "":
                gain = 0.0
            elif s in options:
                gain = options[s][0]
            elif token.isascii():
                gain = 0.0
            else:
                continue
            best = max(score, key=lambda p: (score[p] - (0.0 if p == s else ENTER if "" in (p, s) else SWITCH), p == s, p))
            now[s] = score[best] - (0.0 if best == s else ENTER if "" in (best, s) else SWITCH) + gain
            way[s] = best
        score = now
        back.append(way)
    path = []
    s = max(score, key=lambda p: (score[p], p == "", p))
    for way in reversed(back):
        path.append(s)
        s = way[s]
    return path[::-1]


def _core(word: str) -> str:
    return word.rstrip(",:;")


def _decode_udf():
    def run(frames: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for texts, edges in frames:
            restored, damaged, channels = [], [], []
            for text, found in zip(texts, edges):
                options: dict[str, dict] = {}
                for e in found if found is not None else ():
                    cell = options.setdefault(e["word"], {})
                    if e["channel"] not in cell or cell[e["channel"]][0] < e["gain"]:
                        cell[e["channel"]] = (e["gain"], e["form"])
                tokens = text.split(" ")
                cores = [_core(t) for t in tokens]
                path = viterbi(cores, [options.get(c, {}) for c in cores])
                used = []
                for k, s in enumerate(path):
                    if s and s in options.get(cores[k], {}):
                        tokens[k] = options[cores[k]][s][1].replace(WILD, LOST) + tokens[k][len(cores[k]) :]
                        used.append(s)
                restored.append(" ".join(tokens))
                damaged.append(len(used))
                channels.append(",".join(sorted(set(used))))
            yield pd.DataFrame({"restored": restored, "n_damaged": damaged, "channels": channels})

    run.__annotations__ = {"frames": Iterator[tuple[pd.Series, pd.Series]], "return": Iterator[pd.DataFrame]}
    return F.pandas_udf(run, "restored string, n_damaged int, channels string")


def restore_texts(fields: DataFrame) -> DataFrame:
    """Texts of ``fields`` (column ``text``) that were decoded wrongly: text, restored, channels, complete.

    Each distinct text appears once.  ``complete`` is false where characters
    couldn't be restored; they stand as U+FFFD.  Null and empty texts, and
    correct text in any language, give no row.
    """
    texts = settle(fields.filter("text <> ''").groupBy("text").agg(F.count("*").alias("n")))
    split = texts.select("text", "n", F.explode(F.array_distinct(F.transform(F.split("text", " "), lambda w: F.rtrim(w, F.lit(",:;")))))
                         .alias("word")).filter("word <> ''")
    split = settle(split)
    vocabulary = settle(split.groupBy("word").agg(F.sum("n").alias("freq")))
    unusual = F.col("word").rlike(r"[^\x00-\x7f]")
    odd = vocabulary.filter(unusual)
    own = vocabulary.select("word", F.col("freq").alias("own"))
    back = odd.select("word", F.explode(_lattice_udf(backward)(F.col("word"))).alias("c")).select("word", "c.channel", "c.form", "c.evidence")
    ahead = odd.select(F.col("word").alias("form"), F.explode(_lattice_udf(forward)(F.col("word"))).alias("c")).select("c.channel", "form", "c.evidence", F.col("c.form").alias("word"))
    ahead = ahead.join(own.select("word"), "word", "left_semi").select("word", "channel", "form", "evidence")
    cost = F.create_map(*[F.lit(x) for w, c in WRITTEN.items() for x in (w, c)])
    prior = F.coalesce(F.element_at(cost, F.split("channel", ">")[0]), F.lit(2.0)) + F.when(F.col("channel").endswith("twice"), 1.0).otherwise(0.0)
    known = vocabulary.select(F.col("word").alias("form"), F.col("freq").alias("seen"))
    # a reading with wildcards that a corpus word fills is that word
    wild = F.replace(F.regexp_replace("form", r"([%_\\])", r"\\$1"), F.lit(WILD), F.lit("_"))
    whole_words = ahead.select("word", "channel", F.col("form").alias("__whole"))
    filled = back.filter(F.col("form").contains(WILD)).withColumn("__like", wild).join(whole_words, ["word", "channel"]).filter("__whole like __like")
    filled = filled.select("word", "channel", F.col("__whole").alias("form"), (F.col("evidence") + 0.5).alias("evidence"))
    edges = back.unionByName(ahead).unionByName(filled).join(own, "word").join(known, "form", "left")
    ratio = F.log(F.coalesce("seen", F.lit(UNSEEN)) / F.col("own"))
    # repetition says nothing against a word that is valid UTF-8 read wrongly, as a whole file may be exported so: it counts as standing there once
    whole = F.col("channel").rlike("^utf-8>") & (F.col("evidence") >= WHOLE) & ~F.col("form").contains(WILD) & (F.col("channel").rlike(">(cp1252|latin_1)") | F.col("word").rlike(SIGNS))
    gain = F.when(whole, F.greatest(ratio, F.lit(math.log(UNSEEN)))).otherwise(ratio) + F.col("evidence") - prior
    # a form that occurs no oftener than the garbled word itself proves nothing by occurring
    edges = settle(edges.withColumn("gain", gain).filter("gain > 0").select("word", "channel", "form", "gain"))
    hurt = split.join(edges, "word").groupBy("text").agg(F.collect_list(F.struct("word", "channel", "form", "gain")).alias("edges"))
    marked = texts.filter(F.col("text").rlike(MARKS)).select("text")
    paths = marked.join(hurt, "text", "full").withColumn("r", _decode_udf()(F.col("text"), F.col("edges"))).select("text", "r.*")
    left = F.col("restored").rlike(MARKS)
    return paths.filter((F.col("n_damaged") > 0) | left).select("text", "restored", "channels", (~left).alias("complete"))


def form_texts(controls: DataFrame, forms: DataFrame) -> DataFrame:
    """record_kind, record_id, field_name, text of the captions and tips of controls and forms, repeated rows once."""
    fields = ["caption", "control_tip_text", "status_bar_text"]
    pairs = F.array(*[F.struct(F.lit(f).alias("field_name"), F.col(f).alias("text")) for f in fields])
    of_controls = controls.select(F.lit("control").alias("record_kind"), F.col("control_id").alias("record_id"), F.explode(pairs).alias("p")).select("record_kind", "record_id", "p.*")
    of_forms = forms.select(F.lit("form").alias("record_kind"), F.col("form_id").alias("record_id"), F.lit("caption").alias("field_name"), F.col("caption").alias("text"))
    return reduce(DataFrame.unionByName, [of_controls, of_forms]).filter("record_id is not null and text <> ''").distinct()


def damaged_fields(fields: DataFrame) -> DataFrame:
    """record_kind, record_id, field_name, text, restored, channels, complete of every field whose text was decoded wrongly."""
    fields = settle(fields.select("record_kind", "record_id", "field_name", "text"))
    return fields.join(restore_texts(fields), "text").select("record_kind", "record_id", "field_name", "text", "restored", "channels", "complete")
