"""Words as full-text search sees them: cut, folded, stemmed."""

from __future__ import annotations

import re
import unicodedata

import regex

#: Marks that Latin letters are written with.
_MARKS = {d[1] for c in map(chr, range(0xC0, 0x1F00)) if len(d := unicodedata.normalize("NFD", c)) == 2 and d[0].isascii() and unicodedata.combining(d[1])}

#: Words of a text: letters, digits and private characters, with the marks that follow them.
WORDS = regex.compile(rf"[\p{{L}}\p{{N}}\p{{Co}}][\p{{L}}\p{{N}}\p{{Co}}{''.join(sorted(_MARKS))}]*")

_VOWELS = "aeiou"


def _consonant(w: str, i: int) -> bool:
    return w[i] not in _VOWELS and not (w[i] == "y" and i > 0 and _consonant(w, i - 1))


def _measure(w: str) -> int:
    """Changes from vowels to consonants."""
    form = "".join("c" if _consonant(w, i) else "v" for i in range(len(w)))
    return len(re.findall("v+c", form))


def _short(w: str) -> bool:
    """Ends in consonant, vowel, consonant, the last not w, x or y."""
    n = len(w)
    return n >= 3 and _consonant(w, n - 1) and not _consonant(w, n - 2) and _consonant(w, n - 3) and w[-1] not in "wxy"


def _has_vowel(w: str) -> bool:
    return any(not _consonant(w, i) for i in range(len(w)))


# The endings of steps 2 to 4 of the published algorithm (Porter, 1980), with the two its author changed later (bli, logi).
_STEP2 = {
    "ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "bli": "ble", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous",
    "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble", "logi": "log",
}
_STEP3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
_STEP4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize")


def _swap(w: str, table: dict[str, str], least: int) -> str:
    """The longest ending of the table goes, if what is left has the measure."""
    for end in sorted(table, key=len, reverse=True):
        if w.endswith(end):
            base = w[: -len(end)]
            return base + table[end] if _measure(base) >= least else w
    return w


def stem(w: str) -> str:
    """Porter's stem of a lower-case word. Its UTF-8 bytes are its letters, those
    beyond ASCII and digits consonants; words of less than three or more than 64 stay."""
    if not w.isascii():
        return _stem(w.encode().decode("latin-1")).encode("latin-1").decode(errors="replace")
    return _stem(w)


def _stem(w: str) -> str:
    if not 3 <= len(w) <= 64:
        return w
    if len(w) > 4 and w.endswith("sses") or len(w) > 3 and w.endswith("ies"):
        w = w[:-2]
    elif w.endswith("s") and not w.endswith("ss"):
        w = w[:-1]
    if len(w) > 3 and w.endswith("eed"):
        w = w[:-1] if _measure(w[:-3]) > 0 else w
    else:
        for end in ("ed", "ing"):
            if w.endswith(end) and _has_vowel(w[: -len(end)]):
                w = w[: -len(end)]
                if w.endswith(("at", "bl", "iz")):
                    w += "e"
                elif len(w) > 1 and w[-1] == w[-2] and _consonant(w, len(w) - 1) and w[-1] not in "lsz":
                    w = w[:-1]
                elif _measure(w) == 1 and _short(w):
                    w += "e"
                break
    if w.endswith("y") and _has_vowel(w[:-1]):
        w = w[:-1] + "i"
    w = _swap(w, _STEP2, 1)
    w = _swap(w, _STEP3, 1)
    for end in sorted(_STEP4, key=len, reverse=True):
        if w.endswith(end):
            base = w[: -len(end)]
            if _measure(base) > 1 and (end != "ion" or base[-1:] in ("s", "t")):
                w = base
            break
    if w.endswith("e"):
        m = _measure(w[:-1])
        if m > 1 or m == 1 and not _short(w[:-1]):
            w = w[:-1]
    if w.endswith("ll") and _measure(w) > 1:
        w = w[:-1]
    return w


def _plain(c: str) -> str:
    """A lower-case letter without its mark, if it is a Latin letter with one; nothing for a mark."""
    if c in _MARKS:
        return ""
    c = f if len(f := c.casefold()) == 1 else c
    d = unicodedata.normalize("NFD", c)
    return d[0] if len(d) == 2 and d[0].isascii() else c


def folded(w: str) -> str:
    """A lower-case word without the marks of Latin letters, stemmed."""
    return stem(w if w.isascii() else "".join(map(_plain, w)))
