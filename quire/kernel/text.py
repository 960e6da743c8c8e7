"""Scalar rules shared by the kernel; quire.functions has them as columns."""

from __future__ import annotations

import re
import unicodedata
from datetime import date

from quire.kernel import tables

#: Unicode white space (str.strip() alone would also take the separators 1C to 1F).
BLANK = "\t\n\x0b\x0c\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
_BLANKS = re.compile(f"[{BLANK}]+")
_MARKUP, _TABLE_MARKUP = re.compile(r"[*_`$]"), re.compile(r"[*_`$|]")
_YAML_START = tuple("'\"&*?|-<>=!%@`[]{} ")
_BIB_ESCAPES = (("~", "\xa0"), ("---", "—"), ("--", "–"), ("\\&", "&"), ("\\%", "%"), ("\\_", "_"), ("\\$", "$"), ("\\#", "#"))


def trim(s: str) -> str:
    return s.strip(BLANK)


def trim_end(s: str) -> str:
    return s.rstrip(BLANK)


def words(s: str) -> list[str]:
    return [w for w in _BLANKS.split(s) if w]


def lines(s: str) -> list[str]:
    """Lines without their ends; a last line without text doesn't count."""
    found = s.split("\n")
    if not found[-1]:
        found.pop()
    return [x.removesuffix("\r") for x in found]


def count(s: str) -> int | None:
    """A whole number, or None."""
    s = trim(s)
    return int(s) if s.isascii() and s.removeprefix("+").isdigit() else None


def escape(s: str, in_table: bool = False) -> str:
    """Markdown's own characters behind backslashes; the bar only matters in tables."""
    return (_TABLE_MARKUP if in_table else _MARKUP).sub(r"\\\g<0>", s)


def yaml(s: str) -> str:
    """A YAML scalar, quoted where it has to be."""
    plain = s and ": " not in s and not s.endswith((":", " ")) and "#" not in s and '"' not in s and not s.startswith(_YAML_START)
    return s if plain else '"' + s.replace("\\", "\\\\").replace('"', '\\"') + '"'


def bib_value(s: str) -> str:
    s = " ".join(words(s))
    for old, new in _BIB_ESCAPES:
        s = s.replace(old, new)
    return s


def names(field: str) -> list[str]:
    return [trim(x) for x in field.split(" and ")]


def surname(name: str) -> str:
    last, comma, _ = name.partition(",")
    if comma:
        return trim(last)
    return (words(name) or [name])[-1]


def short_names(field: str) -> str:
    found = [surname(x) for x in names(field)]
    return " and ".join(found) if len(found) < 3 else f"{found[0]} et al."


def author_list(field: str) -> str:
    found = []
    for name in names(field):
        last, comma, first = name.partition(",")
        found.append(f"{trim(first)} {trim(last)}" if comma else name)
    return " and ".join(found) if len(found) < 3 else ", ".join(found[:-1]) + ", and " + found[-1]


def accented(mark: str, text: str) -> str:
    """The first letter of a text under an accent.

    Letters outside the accent's own list keep a combining mark, and characters
    that are neither letter nor digit stay as they are.
    """
    combining, alone, composing = tables.ACCENTS[mark]
    if not text:
        return alone
    base, rest = text[0], text[1:]
    if base in composing:
        return unicodedata.normalize("NFC", base + combining) + rest
    return base + (combining if base.isalnum() else "") + rest


def filled(body: str, arguments: list[str]) -> str:
    """#1, #2, ... replaced one after the other; an argument's own #n is replaced too."""
    for i, value in enumerate(arguments, 1):
        body = body.replace(f"#{i}", value)
    return body


def long_date(day: date) -> str:
    return f"{day:%B %d, %Y}"


def human_bytes(n: int) -> str:
    if n < 1 << 10:
        return f"{n} B"
    return f"{n / (1 << 10):.1f} KB" if n < 1 << 20 else f"{n / (1 << 20):.1f} MB"
