"""The LIKE patterns of the dialect: * and % any run, ? and _ one character, [a-z] and [!a-z] classes; no case."""

from __future__ import annotations

import re

from tamarack.functions.values import quote

_META = set("\\.^$|()[]{}+*?&#~-")


def like_regex(pattern: str) -> str:
    """A Java regular expression that matches what ``pattern`` does."""
    out, k = [], 0
    while k < len(pattern):
        c = pattern[k]
        if c in "*%":
            out.append(".*")
        elif c in "?_":
            out.append(".")
        elif c == "[" and (end := pattern.find("]", k + 2 if pattern[k + 1 : k + 2] != "!" else k + 3)) > 0:
            body = pattern[k + 1 : end]
            negated = body.startswith("!")
            body = body[1:] if negated else body
            out.append("[" + ("^" if negated else "") + "".join("\\" + x if x in "\\[]^&~" else x for x in body) + "]")
            k = end
        else:
            out.append("\\" + c if c in _META else c)
        k += 1
    return "(?isu)^" + "".join(out) + "\\z"


def like_sql(text: str, pattern: str) -> str:
    """Condition that ``text`` (SQL) matches a constant pattern; plain prefixes, suffixes and infixes need no regular expression."""
    bare = pattern.replace("%", "*")
    inner = bare.strip("*")
    if not re.search(r"[*?_\[]", inner):
        low = quote(inner.lower())
        starts, ends = bare.startswith("*"), bare.endswith("*")
        if not inner:
            return f"({text} IS NOT NULL AND {text} = {text})" if bare else f"({text} = '')"
        if starts and ends:
            return f"CONTAINS(LOWER({text}), {low})"
        if ends:
            return f"STARTSWITH(LOWER({text}), {low})"
        if starts:
            return f"ENDSWITH(LOWER({text}), {low})"
        return f"(LOWER({text}) = {low})"
    return f"RLIKE({text}, {quote(like_regex(pattern))})"


def like_dynamic(text: str, pattern: str) -> str:
    """Condition for a pattern that is itself an expression."""
    body = f"REGEXP_REPLACE({pattern}, {quote(r'([.^$|(){}+&#~' + chr(92) * 2 + '])')}, {quote(chr(92) * 2 + '$1')})"
    for what, into in ((r"[*%]", ".*"), (r"[?_]", "."), (r"\[!", "[^")):
        body = f"REGEXP_REPLACE({body}, {quote(what)}, {quote(into)})"
    return f"RLIKE({text}, CONCAT('(?isu)^', {body}, {quote(chr(92) + 'z')}))"
