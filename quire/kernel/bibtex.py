"""BibTeX databases and what citations make of them."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from quire.kernel import text

_ENTRY = re.compile(r"@([^\W\d_]*)\s*([{(])?")
_QUOTED = re.compile(r'"([^"]*)"?')


@dataclass
class Entry:
    key: str
    kind: str
    fields: dict[str, str] = field(default_factory=dict)

    def full(self) -> str:
        """The entry as a line of the bibliography; missing fields are empty."""
        get = self.fields.get
        who = text.author_list(get("author", "")) if "author" in self.fields else ""
        title, year = get("title", ""), get("year", "")
        if self.kind == "article":
            return f'{who}. "{title}". *{get("journal", "")}* ({year})'
        if self.kind == "book":
            return f"{who}. *{title}*. {get('publisher', '')} ({year})"
        return f'{who}. "{title}" ({year})'


def _closing(src: str, at: int, close: str) -> int:
    """Behind the delimiter that closes a block without an entry."""
    depth = 1
    while at < len(src) and depth:
        depth += 1 if src[at] == "{" else -1 if src[at] == close else 0
        at += 1
    return at


def _first_of(src: str, at: int, stops: str) -> int:
    while at < len(src) and src[at] not in stops:
        at += 1
    return at


def _value(src: str, at: int, close: str) -> tuple[str, int]:
    if src[at : at + 1] == '"':
        found = _QUOTED.match(src, at)
        return found[1], found.end()
    if src[at : at + 1] != "{":
        end = _first_of(src, at, "," + close)
        return src[at:end], end
    kept, depth = [], 1
    while depth and at + 1 < len(src):
        at += 1
        if src[at] in "{}":
            depth += 1 if src[at] == "{" else -1
        else:
            kept.append(src[at])
    return "".join(kept), at + 1


def parse(src: str) -> list[Entry]:
    """Entries in order. Values lose their braces; @comment, @preamble and @string are passed over."""
    out, at = [], 0
    while found := _ENTRY.search(src, at):
        kind, at = found[1].lower(), found.end()
        if not found[2]:
            continue
        close = "}" if found[2] == "{" else ")"
        if kind in ("comment", "preamble", "string"):
            at = _closing(src, at, close)
            continue
        end = _first_of(src, at, "," + close)
        entry, at = Entry(text.trim(src[at:end]), kind), end
        while at < len(src) and src[at] != close:
            if src[at] == "," or src[at].isspace():
                at += 1
                continue
            end = _first_of(src, at, "=" + close)
            if end >= len(src) or src[end] == close:
                at = end
                break
            name, at = text.trim(src[at:end]).lower(), end + 1
            while at < len(src) and src[at].isspace():
                at += 1
            value, at = _value(src, at, close)
            if name:
                entry.fields[name] = text.bib_value(value)
        at += 1
        if entry.key:
            out.append(entry)
    return out


class Citations:
    """A document's bibliography, its style and the numbers given so far."""

    def __init__(self) -> None:
        self.author_year = False
        self.entries: dict[str, Entry] = {}
        self.numbers: dict[str, int] = {}

    def render(self, keys: list[str], mode: str, before: str | None, after: str | None) -> str:
        if self.author_year:
            cited, opening, closing = "; ".join(self._named(k, mode) for k in keys), "(", ")"
            before = before and f"{before} "
        else:
            cited, opening, closing = ", ".join(str(self.numbers.setdefault(k, len(self.numbers) + 1)) for k in keys), "[", "]"
            before = before and f"{before}, "
            authors = [self.entries[k].fields["author"] for k in keys if k in self.entries and "author" in self.entries[k].fields]
            match mode:
                case "textual":
                    return f"{', '.join(authors)}[{cited}]"
                case "author":
                    return ", ".join(authors)
                case "year" | "yearpar":
                    return f"[{cited}]"
        if mode not in ("normal", "parenthetical"):
            return cited
        return f"{opening}{before or ''}{cited}{f', {after}' if after is not None else ''}{closing}"

    def _named(self, key: str, mode: str) -> str:
        entry = self.entries.get(key)
        if not entry:
            return key
        who, year = entry.fields.get("author"), entry.fields.get("year", "n.d.")
        who = key if who is None else text.short_names(who)
        shapes = {"author": who, "year": year, "yearpar": f"({year})", "textual": f"{who} ({year})", "alt": f"{who} {year}"}
        return shapes.get(mode, f"{who}, {year}")

    def bibliography(self) -> str | None:
        """Numeric: what was cited, by number. Author-year: all entries, by first surname, year and key."""
        if self.author_year:
            order = sorted(self.entries.values(), key=lambda e: (text.surname(e.fields["author"].split(" and ")[0]) if "author" in e.fields else e.key, e.fields.get("year", ""), e.key))
            found = [f"- {e.full()}\n\n" for e in order]
        else:
            cited = sorted((n, self.entries[k]) for k, n in self.numbers.items() if k in self.entries)
            found = [f"[{n}] {e.full()}\n\n" for n, e in cited]
        return "## References\n\n" + "".join(found) if found else None
