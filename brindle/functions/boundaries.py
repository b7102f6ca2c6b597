"""Texts on both sides of every boundary that a grammar can draw, generated from character properties.

Every alternative of a grammar is made of classes of characters; what it takes in or leaves to the next one shows where a
character of one class stands before one of another. So each class gives its first characters, and each family of texts pins
the alternatives that it is named for.
"""

from __future__ import annotations

import functools
import itertools
import sys
import unicodedata

# The endings that grammars keep as pieces of their own.
ENDINGS = ("s", "t", "re", "ve", "m", "ll", "d")
_CATEGORIES = ("Lu", "Ll", "Lt", "Lm", "Lo", "Mn", "Mc", "Nd", "Nl", "No", "Pd", "Ps", "Po", "Sm", "So", "Zs")


@functools.cache
def representatives() -> dict[str, str]:
    """A character of each class: of ASCII those that patterns name, beyond it the first one of each general category."""
    out = {"lower": "a", "upper": "A", "digit": "1", "sign": ".", "slash": "/", "quote": "'", "space": " ", "tab": "\t", "feed": "\n", "return": "\r"}
    for wanted in _CATEGORIES:
        out[wanted] = next(chr(c) for c in range(0x80, 0x3000) if unicodedata.category(chr(c)) == wanted)
    out["plane"] = next(chr(c) for c in range(0x1F600, 0x1F700) if unicodedata.category(chr(c)) == "So")
    out["han"] = next(chr(c) for c in range(0x4E00, 0x4E10) if unicodedata.category(chr(c)) == "Lo")
    return out


@functools.cache
def unnormalised() -> tuple[str, ...]:
    """Texts that NFC changes: a composing pair, a character that stands for another one, marks out of order, conjoining letters."""
    composed = next(chr(c) for c in range(0x80, 0x300) if len(unicodedata.normalize("NFD", chr(c))) == 2)
    single = next(chr(c) for c in range(0x300, 0x3000) if len(d := unicodedata.normalize("NFD", chr(c))) == 1 and d != chr(c) and not unicodedata.combining(d))
    marks = [chr(c) for c in range(0x300, 0x370) if unicodedata.combining(chr(c))]
    first = marks[0]
    lower = next(m for m in marks if unicodedata.combining(m) < unicodedata.combining(first))
    return unicodedata.normalize("NFD", composed), single, "q" + first + lower, unicodedata.normalize("NFD", chr(0xAC01))


@functools.cache
def boundary_texts() -> dict[str, list[str]]:
    """Texts by family."""
    r = representatives()
    spaces = [r[k] for k in ("space", "tab", "feed", "return", "Zs")]
    words = [c for k, c in r.items() if c not in spaces]
    pairs = list(itertools.product(words, words))
    cases = [r["upper"], r["lower"], r["Lt"], r["Lm"], r["Mn"]]
    return {
        "empty, and runs of a class: digits by threes or one, signs, letters": ["", *(c * n for c in words for n in (1, 2, 3, 4))],
        "one class before another: what a piece takes in": ["".join(p) for p in pairs],
        "a space between: the last space goes with what follows": [" ".join(p) for p in pairs],
        "runs of white space: the last one stands apart": [a + b + c + d for a, d in ((r["lower"], r["digit"]), (r["sign"], r["upper"])) for b, c in itertools.product(spaces, spaces)],
        "white space at either end": [b + c + w + d for w in ("", r["lower"], r["digit"]) for b, c, d in itertools.product(["", *spaces], ["", *spaces], ["", *spaces])],
        "line breaks after signs and slashes": [r["sign"] + s + b + w for s in ("", r["slash"], r["slash"] * 2) for b in (r["feed"], r["return"] + r["feed"], r["feed"] * 2) for w in ("", r["lower"], r["slash"])],
        "endings after an apostrophe, in any case": [w + r["quote"] + e + x for w in ("", r["lower"], r["digit"], " ") for s in ENDINGS for e in (s, s.upper(), s.title()) for x in ("", r["lower"])],
        "a sign before letters goes with them, a second one doesn't": [n * s + r["lower"] * 2 for s in (r["sign"], r["Po"], r["So"], r["Mn"], r["plane"]) for n in (1, 2)],
        "changes of case": ["".join(p) for p in itertools.product(cases, cases, cases)],
        "no normal form": list(unnormalised()),
    }


def all_texts() -> list[str]:
    return list(itertools.chain.from_iterable(boundary_texts().values()))


def joined_texts(width: int = 60) -> list[str]:
    """The same as few longer texts."""
    out = []
    for texts in boundary_texts().values():
        out += ["|".join(texts[i : i + width]) for i in range(0, len(texts), width)]
    return [sys.intern(t) for t in out]
