"""Sets of code points as sorted, disjoint, inclusive ranges."""

from __future__ import annotations

from collections.abc import Iterable
from functools import lru_cache

import regex

Ranges = tuple[tuple[int, int], ...]
LAST = 0x10FFFF
#: A range as wide as this, or wider, stays as it is when case is ignored.
UNFOLDED = 0x1000


def union(*sets: Iterable[tuple[int, int]]) -> Ranges:
    out: list[list[int]] = []
    for lo, hi in sorted(r for s in sets for r in s):
        if out and lo <= out[-1][1] + 1:
            out[-1][1] = max(out[-1][1], hi)
        else:
            out.append([lo, hi])
    return tuple((a, b) for a, b in out)


def complement(ranges: Ranges) -> Ranges:
    out, at = [], 0
    for lo, hi in union(ranges):
        if lo > at:
            out.append((at, lo - 1))
        at = hi + 1
    if at <= LAST:
        out.append((at, LAST))
    return tuple(out)


def intersection(a: Ranges, b: Ranges) -> Ranges:
    out, i, j = [], 0, 0
    while i < len(a) and j < len(b):
        lo, hi = max(a[i][0], b[j][0]), min(a[i][1], b[j][1])
        if lo <= hi:
            out.append((lo, hi))
        if a[i][1] < b[j][1]:
            i += 1
        else:
            j += 1
    return tuple(out)


def difference(a: Ranges, b: Ranges) -> Ranges:
    return intersection(a, complement(b))


def symmetric_difference(a: Ranges, b: Ranges) -> Ranges:
    return union(difference(a, b), difference(b, a))


def of(text: str) -> Ranges:
    return union((ord(c), ord(c)) for c in text)


def span(lo: str, hi: str) -> Ranges:
    return ((ord(lo), ord(hi)),)


ALL: Ranges = ((0, LAST),)
DIGIT, WORD = span("0", "9"), union(span("0", "9"), span("A", "Z"), span("a", "z"), of("_"))
NOT_LINE_FEED = complement(of("\n"))

# Fixed values of the dialect: its horizontal white space, line breaks, and POSIX classes.
HORIZONTAL = union(of("\t \u00a0\u1680\u202f\u205f\u3000"), ((0x2000, 0x200A),))
LINE_BREAKS = union(((0x0A, 0x0D),), of("\x85\u2028\u2029"))
POSIX = {
    "alpha": union(span("A", "Z"), span("a", "z")),
    "digit": DIGIT,
    "alnum": union(span("0", "9"), span("A", "Z"), span("a", "z")),
    "upper": span("A", "Z"),
    "lower": span("a", "z"),
    "space": union(((9, 13),), of(" ")),
    "blank": of("\t "),
    "cntrl": union(((0, 31),), ((127, 127),)),
    "print": ((32, 126),),
    "graph": ((33, 126),),
    "punct": difference(((33, 126),), union(span("0", "9"), span("A", "Z"), span("a", "z"))),
    "xdigit": union(span("0", "9"), span("A", "F"), span("a", "f")),
    "word": WORD,
    "ascii": ((0, 127),),
}
#: Names of boolean properties and the name under which the property data has them.
BOOLEAN = {
    "alpha": "Alphabetic", "alphabetic": "Alphabetic", "lower": "Lowercase", "lowercase": "Lowercase", "upper": "Uppercase", "uppercase": "Uppercase",
    "space": "White_Space", "whitespace": "White_Space", "wspace": "White_Space", "hexdigit": "Hex_Digit", "xdigit": "Hex_Digit", "asciihexdigit": "ASCII_Hex_Digit",
    "emoji": "Emoji", "emojipresentation": "Emoji_Presentation", "extendedpictographic": "Extended_Pictographic", "xidstart": "XID_Start", "xidcontinue": "XID_Continue",
    "idstart": "ID_Start", "idcontinue": "ID_Continue", "patternsyntax": "Pattern_Syntax", "patternwhitespace": "Pattern_White_Space",
}
#: Those that Java has under the same name after Is.
_IN_JAVA = {"Alphabetic", "Lowercase", "Uppercase", "White_Space", "Hex_Digit"}


@lru_cache(maxsize=None)
def _scanned(expression: str) -> Ranges:
    """The code points that a one-character expression of the regex module matches."""
    found, everything = [], "".join(map(chr, range(LAST + 1)))
    for m in regex.compile(f"{expression}+").finditer(everything):
        found.append((m.start(), m.end() - 1))
    return tuple(found)


@lru_cache(maxsize=None)
def named(name: str) -> tuple[Ranges, str | None] | None:
    """(ranges, how Java spells the set, if it does) of a property: a general category, a script, or a boolean."""
    key = "".join(c for c in name.lower() if c not in " _-")
    if not key.isalnum():
        return None
    if key in ("any", "all"):
        return ALL, None
    if key == "word":
        return union(_scanned(r"\p{Alphabetic}"), _scanned(r"\p{M}"), _scanned(r"\p{Nd}"), _scanned(r"\p{Pc}"), _scanned(r"\p{Join_Control}")), None
    if key == "digit":
        return _scanned(r"\p{Nd}"), r"\p{Nd}"
    if key in BOOLEAN:
        full = BOOLEAN[key]
        return _scanned(rf"\p{{{full}}}"), rf"\p{{Is{full}}}" if full in _IN_JAVA else None
    for kind, java in (("gc", "gc="), ("script", "sc=")):
        try:
            ranges = _scanned(rf"\p{{{kind}={key}}}")
        except regex.error:
            continue
        short = {"gc": _category, "script": lambda k: "Is" + k.capitalize() if k.isascii() and len(k) > 4 else None}[kind](key)
        return ranges, rf"\p{{{short}}}" if short else None
    return None


def _category(key: str) -> str | None:
    return key[0].upper() + key[1:] if len(key) <= 2 and key != "lc" else None


def white_space() -> Ranges:
    return _scanned(r"\p{White_Space}")


@lru_cache(maxsize=1)
def _variants() -> dict[int, frozenset[int]]:
    """Code points that are one when case is ignored, by single-character upper and lower case (dotless i and dotted I aside)."""
    group: dict[int, set[int]] = {}
    for c in range(0x1E960):
        if 0xD800 <= c < 0xE000 or c in (0x130, 0x131):
            continue
        for other in {chr(c).lower(), chr(c).upper()}:
            if len(other) == 1 and ord(other) != c:
                joined = group.get(c, {c}) | group.get(ord(other), {ord(other)})
                for x in joined:
                    group[x] = joined
    return {c: frozenset(g) for c, g in group.items()}


def folded(ranges: Ranges) -> Ranges:
    variants, more = _variants(), []
    for lo, hi in ranges:
        if hi - lo < UNFOLDED:
            more += [(v, v) for c in range(lo, hi + 1) for v in variants.get(c, ())]
    return union(ranges, more)
