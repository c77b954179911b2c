"""Dialogue of subtitle files: text without cue numbers, times, tags and sound descriptions."""

from __future__ import annotations

import re

_TIME = r"(?:\d{1,3}:)?\d{1,2}:\d{1,2}[.,:]\d{1,3}"
#: A cue's head: an optional line with its number, then the line with its times.
_HEAD = re.compile(rf"(?:^|\n)[ \t\ufeff]*(?:\d+[ \t]*\n[ \t]*)?{_TIME}[ \t]*-->[^\n]*")
_TAGS = re.compile(r"<[^<>\n]*>|\{[^{}\n]*\}")
#: Sound descriptions are short by definition: a longer text in brackets is dialogue.
_SOUNDS = re.compile(r"\[[^\[\]]{0,120}\]|\([^()]{0,120}\)|♪[^♪]{0,120}♪|^[ \t\ufeff]*WEBVTT[^\n]*", re.MULTILINE)
#: Adverts of subtitle makers: the line of a cue with a web address.  A host has a blank, a sign or the line's start before it, small letters or capitals throughout, and no word after it.
_ADVERT = re.compile(r"\bhttps?://|(?<![\w.-])(?:www\.)?(?:[a-z0-9][a-z0-9-]*\.)+(?:example|invalid|com|net|org|info|tv)(?![\w-])|(?<![\w.-])(?:WWW\.)?(?:[A-Z0-9][A-Z0-9-]*\.)+(?:EXAMPLE|INVALID|COM|NET|ORG|INFO|TV)(?![\w-])|(?<![\w.-])(?:[wW]{3}\.)?(?:[A-Za-z0-9][A-Za-z0-9-]*\.)+(?:example|invalid|com|org)(?![\w-])")
#: Set phrases of adverts and credits without one.
_CREDIT = re.compile(r"synced (?:&|and) corrected by|\b(?:subtitles|captions|untertitel) ?(?:by|at|von|:)|become a vip member|advertise your product|\bdownload \S+ player\b.*\d ?% off", re.IGNORECASE)
#: One of these stands in every advert or credit; looked for first, as that is quicker.
_SIGNS = (".example", ".invalid", ".com", ".net", ".org", ".info", ".tv", "http", "synced", "subtitles", "captions", "untertitel", "vip member", "advertise your", "download ")


def _suspect(low: str) -> bool:
    return any(w in low for w in _SIGNS)


def may_advertise(text: str) -> bool:
    """Whether ``dialogue`` may leave out a line of an advert or credit; sure where it is false."""
    return _suspect(text.lower())


def _without_adverts(cue: str) -> str:
    return "\n".join(line for line in cue.split("\n") if not (_suspect(line.lower()) and (_ADVERT.search(line) or _CREDIT.search(line))))


def asides(text: str) -> list[str]:
    """Texts in brackets and between notes, which ``dialogue`` leaves out."""
    if "[" not in text and "(" not in text and "\u266a" not in text:
        return []
    return [m for m in (x.strip("[]()\u266a \n") for x in _SOUNDS.findall(_TAGS.sub("", text))) if m and not m.startswith("WEBVTT")]


def dialogue(text: str, adverts: bool = False) -> list[str]:
    """The cues' texts, in order; blank ones are left out.

    With ``adverts`` false the lines of adverts and credits are left out, those
    that hold a web address or a set phrase, but only within cues: what stands
    before the first cue's head stays.
    """
    if "\r" in text:
        text = text.replace("\r\n", "\n").replace("\r", "\n")
    cues = _HEAD.split(text)
    if not adverts and len(cues) > 1 and _suspect(text.lower()):
        cues = [cues[0], *(_without_adverts(c) if _suspect(c.lower()) else c for c in cues[1:])]
    if "<" in text or "{" in text:
        cues = [_TAGS.sub("", c) if "<" in c or "{" in c else c for c in cues]
    if "[" in text or "(" in text or "\u266a" in text or "WEBVTT" in text:
        cues = [_SOUNDS.sub(" ", c) for c in cues]
    return [c for c in map(str.strip, cues) if c]
