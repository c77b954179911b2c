"""Lexicons and patterns that vote on abusive, hateful and sexual dialogue.

A voter looks at one sentence in plain form (see ``plain``) and says +1, -1 or
nothing.  Voters are weak on purpose; how far each can be trusted is estimated
by the label model.
"""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache
from re import _parser

# Word lists in plain form, by language.
INSULTS = """idiot idiots moron morons imbecile maggot dirtbag scumbag scum bastard loser coward pig swine worm fool cretin dimwit halfwit jerk bitch whore
trash garbage filth parasite vermin asshole dickhead wanker freak creep weasel lowlife retard dumbass jackass prick punk tramp rat cockroach
wretch cow snake slut twat leech toad douchebag
abruti cretin imbecile connard salaud salope ordure raclure lache debile pourriture enfoire fumier pauvre minable vermine encule dechet
idiota imbecil cabron desgraciado cobarde basura gusano estupido mierda cerdo canalla escoria gilipollas pendejo
mistkerl drecksack schwachkopf abschaum arschloch trottel versager feigling dreckskerl hurensohn miststuck schwein wichser
desgracado lixo verme covarde canalha babaca otario""".split()
SCORN = """worthless useless pathetic rotten filthy gutless brainless disgusting stupid dumb ugly miserable spineless lousy stinking dirty vile wretched lying
minable inutile pourri sale repugnant stupide degoutant inutil asqueroso podrido
erbarmlicher wertloser verdammter dummer dreckiger nutzloser elender erbarmliche wertlose verdammte
nojento podre""".split()
DEGRADING = """vermin subhuman subhumans filth disease animals parasites scum cockroaches rats pest plague dirt trash garbage cancer
vermine parasite sous hommes sauvages ordures cafards alimanas parasitos basura escoria plaga ratas animales
ungeziefer parasiten untermenschen abschaum tiere dreck seuche vermes parasitas lixo praga""".split()
EXPLICIT = """naked nude sex moaning moaned moan orgasm orgasms nipples nipple breasts thighs aroused undress undressed licked penis vagina erection
nue nues nus seins orgasme sexe gemissait gemissant deshabilla nu
desnuda desnudo desnudos desnudas sexo orgasmo gemia pezones pechos senos
nackt nackte sex bruste stohnend stohnte orgasmus entblosst brustwarzen
nua pelada gemendo mamilos seios""".split()


def _any(words: list[str]) -> str:
    return "(?:" + "|".join(sorted({re.escape(w) for w in words}, key=lambda w: (-len(w), w))) + ")"


_INS, _ADJ, _DEG, _EXP = _any(INSULTS), _any(SCORN), _any([w for w in DEGRADING if w not in ("sous", "hommes")] + ["sous hommes"]), _any(EXPLICIT)
_NO = r"(?!no |not |n t |never |pas |kein )"
_GAP = rf"(?:{_NO}\w+ ){{0,3}}"
_HARM = "(?:break|strangle|kill|cut|crush|smash|beat|gut|burn|choke|slit|bury|hurt|murder|shoot|stab|skin|destroy|end|rip)"
_PEOPLES = "(?:people|peoples|folk|race|tribe|believers|foreigners|immigrants|migrants|refugees|gypsies|jews|muslims|christians|arabs|etrangers|juifs|musulmans|extranjeros|judios|musulmanes|auslander|juden|moslems|estrangeiros|judeus)"
#: Rejecting such talk, or reporting that it is rejected.
_REJECTED = r"\bnobody calls\b|\b(?:don t|do not|never|stop|quit) (?:you )?(?:dare )?(?:ever )?(?:call|calling|say|saying|speak|talk)\b|\bhow dare (?:you|they)\b|\b(?:apologi[sz]e|ashamed of yourself)\b|\b(?:it is|it s|that is|that s) (?:wrong|cruel|a lie) to (?:say|call)\b"

_UNSAID = r"^(?!.*\b(?:don t|do not|never|stop|quit) (?:you )?(?:dare )?(?:ever )?(?:call|calling|say|saying) )"

#: Category -> voters: name, pattern, vote.  None alone is a verdict.
VOTERS: dict[str, list[tuple[str, re.Pattern, int]]] = {
    "abuse": [
        ("insult", re.compile(rf"\b{_INS}\b"), 1),
        ("scorn", re.compile(rf"\b{_ADJ}\b"), 1),
        ("near_you", re.compile(rf"\b(?:you|ya|du|tu|toi|eres|bist|voce) (?:\w+ ){{0,4}}(?:{_INS}|{_ADJ})\b|\b(?:{_INS}|{_ADJ}) (?:\w+ ){{0,3}}(?:you|du|toi)\b"), 1),
        ("address", re.compile(rf"\b(?:you|ya) (?:(?:are|re) )?{_NO}(?:{_NO}(?!on |in |at |to )\w+ ){{0,2}}(?:{_INS}|piece of \w+)\b|\b(?:espece de|tu es|tu nes|t es qu un|eres|du bist|voce e) {_GAP}(?:{_INS}|{_ADJ})\b|\bdu (?:{_ADJ} ){{0,2}}{_INS}\b|\b{_INS} wie du\b|\b(?:{_INS}|piece of \w+) (?:you are|you re)\b|\bcallate (?:{_INS}|{_ADJ})"), 1),
        ("scorned", re.compile(rf"\b{_ADJ} {_INS}\b|\b(?:{_INS}) (?:{_ADJ})\b|\b{_ADJ} piece of (?:garbage|trash|shit|filth|crap)\b"), 1),
        ("silence", re.compile(r"\bshut (?:your mouth|up you|your face|your trap)\b|\bferme (?:ta gueule|la)\b|\bta gueule\b|\bhalt (?:die fresse|dein maul|die klappe)\b|\bcallate\b|\bcala a boca\b|\bget out of my sight\b|\bget lost you\b"), 1),
        ("threat", re.compile(rf"\b(?:i will|i ll|i m going to|i m gonna|before i) {_HARM} (?:you|your|every bone|ya)\b|\bje vais te (?:casser|tuer|egorger|buter|crever|etrangler|massacrer)\b|\bte voy a (?:romper|matar|partir|reventar|machacar)\b|\bich (?:schlag|schlage|bring|bringe|brech|breche|mach|reiss) (?:dir|dich)\b|\bvou te (?:matar|quebrar|partir)\b"), 1),
        ("injury", re.compile(r"\b(?:every bone in your body|cut your throat|strangle you|you bloody|break your (?:neck|legs|face|jaw)|casser les dents|te romper la cara|dir die zahne ein|partir a cara)\b"), 1),
        ("harm_self", re.compile(r"\b(?:drown|hang|kill|shoot) yourself\b|\bjump off (?:the|a) (?:bridge|roof|cliff)\b|\bva (?:donc )?te (?:noyer|pendre|tuer)\b|\btirate (?:del|por|de un)\b|\bspring (?:doch )?von der brucke\b|\b(?:geh dich|hang dich|ersauf)\w*\b"), 1),
        ("curse", re.compile(r"\brot in hell\b|\bburn in hell\b|\bgo to hell\b|\bdrop dead\b|\b(?:screw|damn) you\b|\bfuck (?:you|off)\b|\bhope you (?:die|rot|choke|burn|drown)\b|\bvete al (?:infierno|diablo)\b|\bva au diable\b|\bfahr zur holle\b|\bverpiss dich\b"), 1),
        ("contempt", re.compile(rf"\bnothing but an? (?:\w+ )?(?:{_INS}|piece of \w+)\b|\bwhat an? (?:\w+ )?(?:{_INS}|piece of \w+)\b|\bmakes? me sick\b|\bdespises? you\b|\bgehort in die gosse\b|\bjust by breathing\b"), 1),
        ("unmissed", re.compile(r"\bnobody will miss you\b|\bwould smell better\b|\bpersonne ne (?:te )?pleurera\b|\bnadie va a llorar por ti\b|\bdich vermisst\b|\bdo us all a favou?r\b"), 1),
        ("denied", re.compile(rf"\bno {_INS}\b|\bnot (?:an? )?(?:\w+ )?{_INS}\b|\b(?:silly|stupid|dumb) (?:mistake|thing|me|idea|question|game|joke|rule)\b|\bmy own fault\b|\bi (?:was|am|m|felt|feel) (?:such )?(?:an? )?(?:{_ADJ} )?{_INS}\b"), -1),
        ("rejected", re.compile(_REJECTED), -1),
        ("of_a_people", re.compile(r"\b(?:they|those|these|every one of|all|los|les|todos los|tous les|alle) (?:\w+ ){0,5}(?:are|re|ought|is|breed|must|should|sont|son|sind|cest|c est)\b"), -1),
        ("literal", re.compile(r"\b(?:puppies|kennel|farm|barn|zoo|cellar|stable|milk|meadow|colou?r|painted|shed|coop)\b"), -1),
        ("playful", re.compile(r"\b(?:chess|cards|poker|tennis|golf|match|quiz|board game|dice|kidding|joking|karaoke)\b"), -1),
        ("told", re.compile(r"\b(?:in the (?:war|story|play|film|book|legend)|the villain|once upon)\b"), -1),
    ],
    "hate": [
        ("degrading", re.compile(rf"\b(?!(?<!uma )praga\b)(?<!piece of ){_DEG}\b"), 1),
        ("degraded", re.compile(rf"\b(?:are|re|is|all|just|sont|son|sind|sao|cest|c est) (?:all |just |nothing but |only |a |an |des |de la |du |un |una |une |ein |eine |nur |todos |doch |bloss ){{0,4}}{_DEG}\b"), 1),
        ("eradicate", re.compile(r"\b(?:should|must|ought to|have to|has to|need to) (?:all )?be (?:\w+ )?(?:exterminated|wiped out|driven out|burned|locked up|eliminated|killed|gassed|hanged|shot|expelled|put down)\b|\bil faut (?:tous )?les (?:exterminer|eliminer|liminer|chasser|tuer|bruler)\b|\bhay que (?:exterminarlos|echarlos|matarlos|eliminarlos|quemarlos)\b|\bgehoren (?:alle )?(?:vernichtet|ausgerottet|vertrieben|vergast|verbrannt|eingesperrt)\b|\btem de ser exterminad"), 1),
        ("breed", re.compile(r"\bbreed like\b|\bby blood\b|\bthe only good one\b|\bthe only good \w+ is a dead\b|\bno son personas\b|\bsous hommes\b|\buntermenschen\b|\bsubhumans?\b|\bfilthy (?:race|breed|people)\b"), 1),
        ("exclude", re.compile(r"\bnever have been allowed to\b|\bno dogs no\b|\bdon t serve\b|\bdehors ou morts\b|\bjagt sie\b|\bsie raus\b|\bchildren too\b|\bburned out of their\b|\ba dead one\b|\bgo back (?:home|to where)\b"), 1),
        ("collective", re.compile(rf"{_UNSAID}.*\b(?:all|every one of|every|those|these|the only good|people like|tous les|les|todos los|los|alle|die|todos os|os) (?:\w+ ){{1,5}}(?:is|are|be|sont|son|sind|breed|cest|c|gehoren|sao|ought|must|should)\b.*(?:{_DEG}|exterm\w*|thief|morts|dead one)"), 1),
        ("peoples", re.compile(rf"{_UNSAID}.*\b(?:all|every|those|these|the|people like) (?:\w+ ){{0,2}}{_PEOPLES}\b.*\b(?:{_DEG}|exterminated|gassed|killed|expelled|hanged|shot|burned|driven out|wiped out|dogs|dead)\b"), 1),
        ("pests", re.compile(r"\b(?:roses?|cellar|bread|garden|seedlings?|fields?|crops?|kitchen|attic|cheese|barn|gardener|orchard|grain)\b"), -1),
        ("beasts", re.compile(r"\b(?:zoo|circus|farm|cage|keeper|puppies|vet|cats|horses|cows|birds|fish|wolves|mice)\b"), -1),
        ("welcome", re.compile(r"\b(?:guests?|in my house|friends?|welcome|neighbou?rs)\b"), -1),
        ("rejected", re.compile(_REJECTED), -1),
        ("ill", re.compile(r"\b(?:doctor|clinic|hospital|screened|surgeon)\b"), -1),
    ],
    "sexual": [
        ("explicit", re.compile(rf"\b{_EXP}\b"), 1),
        ("two_terms", re.compile(rf"\b({_EXP})\b.*\b(?!\1\b){_EXP}\b"), 1),
        ("act", re.compile(r"\b(?:had|have|having|wanted|begged for|asked for|wants) (?:\w+ )?sex\b|\borgasm\w*\b|\bfaisaient l amour\b|\b(?:pidio|tenian|tener|queria) sexo\b|\b(?:reclama|rclama|voulait) du sexe\b|\b(?:wollte|hatten)(?: \w+)? sex\b|\bfaziam sexo\b|\bfuck(?:ed|ing)? (?:me|her|him)\b"), 1),
        ("taken", re.compile(r"\b(?:sucked|sucking|rode|riding|mounted|penetrated|thrust|fingered) (?:into |inside |in )?(?:him|her|me)\b|\b(?:pussy|blowjob|handjob|masturbat\w*)\b"), 1),
        ("climax", re.compile(r"\b(?:came|come|cum|coming) (?:in|inside|on|over) (?:her|his|my) (?:mouth|face|breasts|hand)\b|\b(?:came|climaxed) (?:inside|loudly|together)\b"), 1),
        ("touch", re.compile(r"\b(?:licked|kissed|slid|caressed|grabbed|stroked|sucked|lechait|embrassa|lamio|beso|kusste|leckte)\b.*\b(?:nipples?|thighs?|breasts?|naked|bare|seins|cuisses|pezones|muslos|pechos|bruste|schenkel)\b"), 1),
        ("bared", re.compile(r"\b(?:naked|nude|nackt|nackte|desnud\w+|nue?s?|undress|pulled off the last clothes|se quito la ropa|se deshabilla|zog sich)\b.*\b(?:moan\w*|gem\w+|gmis\w+|stohn\w*|nipples|thighs|breasts|bed|knees|aroused|sex\w*|seins|cama|lit|bett|bruste|loudly)\b|\b(?:on your knees|begged for)\b.*\b(?:naked|undress|moaning|sex)\b"), 1),
        ("medical", re.compile(r"\b(?:cancer|screened|nurse|doctor said|clinic|surgery|midwife)\b"), -1),
        ("plants", re.compile(r"\b(?:seedlings?|planting|plants?|species|chicks?|flowers?)\b"), -1),
        ("swimming", re.compile(r"\b(?:breaststroke|swam|swim|babies|bathing)\b"), -1),
        ("art", re.compile(r"\b(?:statue|painted|painting|colou?r|museum|sculpture|portrait)\b"), -1),
        ("lesson", re.compile(r"\bsex education\b|\b(?:opposite|same|fair|weaker) sex\b|\b(?:school|lesson|equality|discrimination)\b"), -1),
    ],
}
CATEGORIES = tuple(VOTERS)
#: Voters that look for single words of a lexicon.
LEXICAL = frozenset(("insult", "scorn", "near_you", "degrading", "explicit"))

#: Words that are put right where they are disguised.
TRIGGERS = frozenset(INSULTS) | frozenset(SCORN) | frozenset(DEGRADING) | frozenset(EXPLICIT) | frozenset(
    """shut gueule fresse maul klappe callate boca sight lost strangle kill break cut crush smash beat gut burn choke slit bury hurt murder shoot stab skin destroy
    bone casser tuer egorger buter crever etrangler massacrer romper matar partir reventar machacar schlag schlage bring bringe brech breche mach reiss quebrar zahne cara
    yourself jump favour favor noyer pendre tirate spring ersauf hang nothing what sick despises despise miss smell gosse pleurera llorar breathing piece espece
    should must ought exterminer eliminer liminer chasser bruler exterminarlos echarlos matarlos eliminarlos quemarlos vernichtet ausgerottet vertrieben vergast verbrannt eingesperrt
    breed blood good allowed dogs serve dehors personas children thief dead race exterminated wiped driven burned locked
    amour begged fuck fucked fucking kissed slid caressed grabbed stroked sucked lechait embrassa lamio beso kusste leckte bare clothes ropa zog knees faziam orgasmic""".split()
)

#: Words too frequent to look for where a pattern also asks for another.
_FREQUENT = frozenset("""a an all and are as at be but by c cest d de des die do don du e ein es est for from get go had halt has have having her him i il in is it just l la las les like ll
    los m me must my n ne need no not nothing nur of off on one only os ought out para que re s sao se should sind so son sont te that the them these they this those to todos tous un una und us va was
    we what who will would ya you your""".split())
_LIMIT = 3000


def _needs(pattern) -> tuple[set[str] | None, set[str] | None]:
    """Strings of which a match of a parsed pattern is one, or None, and strings of which it holds one, or None; NUL stands for a word's edge."""
    exact: set[str] | None = {""}
    best: set[str] | None = None
    whole = True

    def flush() -> None:
        nonlocal best, exact
        if exact is not None and (found := {p for s in exact if (p := _rarest(s)) is not None}) and all(_rarest(s) is not None for s in exact):
            best = found if best is None or _cost(found) < _cost(best) else best
        exact = {""}

    for op, arg in pattern:
        name = str(op)
        part: set[str] | None = None
        need: set[str] | None = None
        if name == "LITERAL":
            part = {chr(arg)}
        elif name == "AT":
            part = {"\0"} if str(arg) == "AT_BOUNDARY" else {""}
        elif name in ("ASSERT", "ASSERT_NOT"):
            part = {""}
        elif name == "SUBPATTERN":
            part, need = _needs(arg[3])
        elif name == "BRANCH":
            sides = [_needs(x) for x in arg[1]]
            part = set().union(*(x for x, _ in sides)) if all(x is not None for x, _ in sides) else None
            need = set().union(*(x for _, x in sides)) if all(x is not None for _, x in sides) else None
        elif name in ("MAX_REPEAT", "MIN_REPEAT"):
            low, high, inner = arg
            part, need = _needs(inner)
            part = None if part is None or high != 1 else part | {""} if low == 0 else part
            need = need if low else None
        if part is not None and len(exact) * len(part) <= _LIMIT:
            exact = {a + b for a in exact for b in part}
            continue
        flush()
        whole = False
        if part is not None:
            exact = part
        elif need and (best is None or _cost(need) < _cost(best)):
            best = need
    kept = exact if whole else None
    flush()
    return kept, best


def _rarest(text: str) -> str | None:
    """The word or part of a word to look for, with a blank at each edge that is a word's edge; None if there is none."""
    found = []
    for m in re.finditer(r"[^ \0]+", text):
        closed = (m.start() > 0, m.end() < len(text))
        found.append(" " * closed[0] + m.group() + " " * closed[1])
    return min(found, key=lambda w: (_cost({w}), -len(w), w), default=None)


def _cost(found: set[str]) -> tuple[int, int]:
    common = sum(w.strip() in _FREQUENT or len(w.strip()) < 3 for w in found)
    return common, sum(not w.startswith(" ") for w in found)


def _gate(pattern: re.Pattern) -> set[str]:
    """Words or parts of words (edges are blanks) of which every sentence holds one that ``pattern`` matches."""
    need = _needs(_parser.parse(pattern.pattern))[1]
    if not need:
        raise ValueError(f"no word is sure to stand in {pattern.pattern}")
    return need


#: From the patterns themselves: a sentence on which any voter for +1 speaks holds one of these.
GATE = frozenset().union(*(_gate(pattern) for voters in VOTERS.values() for _, pattern, vote in voters if vote > 0))
_GATE_WORDS = frozenset(w.strip() for w in GATE if w.startswith(" ") and w.endswith(" ")) | TRIGGERS
_GATE_PARTS = re.compile("|".join(sorted(map(re.escape, (w for w in GATE if not (w.startswith(" ") and w.endswith(" ")))))) or "(?!)")
_opens: dict[str, bool] = {}


def may_vote(sentence: str) -> bool:
    """Whether some voter for +1 may speak on a sentence in plain form; sure where it is false."""
    get = _opens.get
    for w in sentence.split():
        if (known := get(w)) is None:
            if len(_opens) > 500_000:
                _opens.clear()
            known = _opens[w] = w in _GATE_WORDS or _GATE_PARTS.search(f" {w} ") is not None
        if known:
            return True
    return False


_UNSEEN = re.compile("[\u200b\u200c\u200d\u2060\ufeff\u00ad\u200e\u200f]")
_LEAD = re.compile("[\u00c2-\u00c5\u00d0\u00d1\u00e2\u00e3]")
_OTHER = re.compile("[\u0250-\u1dff\u2c00-\ud7ff\uf900-\ufb00]")
_SPACED = re.compile(r"(?<![^\W_])[^\W_](?:[.\-_*·][^\W_]){2,}(?![^\W_])")
_LONG = re.compile(r"([a-z])\1{2,}")
_WORD = re.compile(r"[^\W_]+(?:[@$*!+]+[^\W_]+)*[$@*]*|[@$*]+[^\W_]+(?:[@$*!+]+[^\W_]+)*[$@*]*")
_LEET = str.maketrans("0134579@$!+", "oieastgasit")
_LEET_L = str.maketrans("0134579@$!+", "oleastgaslt")
_SPLIT = re.compile(r"(?<=[.!?…])[\"'”»)]*\s+(?=[^\W_]|[-–—¡¿\"“«(@$])|\n\s*\n")
_LATIN = str.maketrans({"\u2019": "'", "ß": "ss", "œ": "oe", "æ": "ae", "ø": "o", "ł": "l", "đ": "d", "ı": "i"})
_UTF8 = re.compile("[\u0080-ÿŒœŠšŸŽžƒˆ˜–—‘’‚“”„†‡•…‰‹›€™]{2,}")
_CP1251 = re.compile("[ГВвРС][\u00a0-¿Ђ-џ‚-›€™Ґґ№]")


def _cp1252(run: str) -> bytes:
    return b"".join(bytes([ord(c)]) if ord(c) < 0xA0 or 0xA0 <= ord(c) <= 0xFF else c.encode("cp1252") for c in run)


def _recode(m: re.Match) -> str:
    try:
        return _cp1252(m.group()).decode()
    except (UnicodeDecodeError, UnicodeEncodeError):
        return m.group()


def readable(text: str) -> str:
    """``text`` with runs of UTF-8 read as a Western code page, or pairs of it read as a Cyrillic one, put right."""
    if _LEAD.search(text):
        text = _UTF8.sub(_recode, text)
    if _CP1251.search(text):
        def pair(m: re.Match) -> str:
            try:
                return m.group().encode("cp1251").decode()
            except (UnicodeDecodeError, UnicodeEncodeError):
                return m.group()

        text = _CP1251.sub(pair, text)
    return text


def _fold(word: str) -> str:
    if not _OTHER.search(word):
        return unicodedata.normalize("NFKD", word.translate(_LATIN) if "\u00df" in word or "\u0153" in word or "\u00f8" in word or "\u0142" in word or "\u00e6" in word else word.replace("\u2019", "'")).encode("ascii", "ignore").decode()
    return "".join(c for c in unicodedata.normalize("NFKD", word.translate(_LATIN)) if not unicodedata.combining(c))


_KNOWN = TRIGGERS
_HOLES: dict[str, str] = {}
for _w in sorted(TRIGGERS):
    if len(_w) > 4:
        for _k in range(len(_w)):
            _HOLES.setdefault(_w[:_k] + "*" + _w[_k + 1 :], _w)


#: The lexicons' words by length, with the categories they speak for.
_LEXICON: dict[int, dict[str, set[str]]] = {}
for _category, _list in (("abuse", INSULTS), ("abuse", SCORN), ("hate", DEGRADING), ("sexual", EXPLICIT), ("sexual", ["fuck", "fucked", "fucking"])):
    for _w in _list:
        if len(_w) > 2:
            _LEXICON.setdefault(len(_w), {}).setdefault(_w, set()).add(_category)


@lru_cache(1 << 16)
def filled(form: str) -> str | None:
    """The lexicons' word that a masked form stands for: any number of holes at any place, two letters seen; None where the words that fit have no category in common."""
    if len(form) - form.count("*") < 2:
        return None
    fits = re.compile(form.replace("*", "[a-z]") if form.replace("*", "").isalnum() else "(?!)")
    found = {w: c for w, c in _LEXICON.get(len(form), {}).items() if fits.fullmatch(w)}
    return min(found) if found and set.intersection(*found.values()) else None


def _unspaced(m: re.Match) -> str:
    return ("*" in (text := m.group()) and filled(text)) or re.sub(r"[.\-_*·]", "", text)


def _word(word: str) -> str:
    """A word with look-alike characters put right; a masked character is filled from the lexicons."""
    if word.isalpha():
        return _LONG.sub(r"\1", word) if _LONG.search(word) else word
    if word.isdigit():
        return word
    for table in (_LEET, _LEET_L):
        form = _LONG.sub(r"\1", word.translate(table))
        if form in _KNOWN:
            return form
        if "*" in form and (whole := filled(form) or _HOLES.get(form)):
            return whole
    return form.replace("*", "")


def plain(text: str) -> list[str]:
    """Sentences in plain form: lower case, no marks or accents, words parted by one blank, disguises undone.

    Undone are invisible characters, letters parted by dots or hyphens,
    letters repeated three times and more, digits and signs for letters, masked
    or lost letters, and UTF-8 read as a Western or Cyrillic code page.
    """
    if "\ufffd" in text:
        text = text.replace("\ufffd", "*")
    low = text.lower() if text.isascii() else readable(_UNSEEN.sub("", text)).lower()
    if not low.isascii():
        low = _fold(low)
    low = _SPACED.sub(_unspaced, low)
    out = []
    for sentence in _SPLIT.split(low):
        ws = _WORD.findall(sentence)
        if ws:
            joined = " ".join(ws)
            if _LONG.search(joined) or not joined.replace(" ", "").isalpha():
                joined = " ".join(w if w.isalpha() and not _LONG.search(w) else _word(w) for w in ws)
            out.append(joined)
    return out


def votes(sentence: str) -> dict[str, tuple[int, ...]]:
    """Votes per category, only for categories on which some voter speaks."""
    out = {}
    for category, voters in VOTERS.items():
        v = tuple(vote if pattern.search(sentence) else 0 for _, pattern, vote in voters)
        if any(v):
            out[category] = v
    return out
