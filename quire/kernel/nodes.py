"""Blocks and inlines of a document."""

from __future__ import annotations

from collections.abc import Iterator

from quire.kernel.text import trim


class Node:
    """A block or an inline: its kind, what it holds, and named attributes.

    `kids` holds nodes, and for list items, descriptions and table cells lists
    of nodes.
    """

    __slots__ = ("attrs", "kids", "kind", "text")

    def __init__(self, kind: str, text: str = "", kids: list | None = None, **attrs: object) -> None:
        self.kind, self.text, self.kids, self.attrs = kind, text, [] if kids is None else kids, attrs

    def __repr__(self) -> str:
        return f"{self.kind}({self.text!r}, {self.kids!r}, {self.attrs!r})"

    def __getitem__(self, name: str) -> object:
        return self.attrs.get(name)


#: All spaces are one node; nothing is ever noted on it.
SPACE = Node("space")
SPACE_KINDS = ("space", "line_break")
#: Inlines that only wrap others.
WRAPPERS = frozenset("emph strong strikeout underline superscript subscript smallcaps span quoted link image".split())


#: Text nodes that are remembered (nothing is ever noted on them either), and the length up to which.
_TEXTS: dict[str, Node] = {}
_KNOWN_TEXTS, _KNOWN_LENGTH = 1 << 14, 32


def text_node(s: str) -> Node:
    if (node := _TEXTS.get(s)) is None:
        node = Node("text", s)
        if len(s) <= _KNOWN_LENGTH:
            if len(_TEXTS) >= _KNOWN_TEXTS:
                _TEXTS.clear()
            _TEXTS[s] = node
    return node


def trimmed(inlines: list[Node]) -> list[Node]:
    """Without spaces and line breaks at either end."""
    start, end = 0, len(inlines)
    while start < end and inlines[start].kind in SPACE_KINDS:
        start += 1
    while end > start and inlines[end - 1].kind in SPACE_KINDS:
        end -= 1
    return inlines[start:end]


def parts(block: Node) -> Iterator[tuple[str, list[Node]]]:
    """A block's contents in reading order, as ("inlines" or "blocks", nodes)."""
    match block.kind:
        case "section" | "paragraph":
            yield "inlines", block.kids
        case "bullet_list" | "ordered_list":
            for item in block.kids:
                yield "blocks", item
        case "description_list":
            for term, description in block.kids:
                yield "inlines", term
                yield "blocks", description
        case "quote" | "composite" | "theorem":
            yield "blocks", block.kids
        case "table":
            yield "inlines", block["caption"] or []
            for row in block.kids:
                for cell in row:
                    yield "blocks", cell
        case "figure":
            yield "inlines", block["caption"] or []


def plain(inlines: list[Node]) -> str:
    """The text alone, as it titles a label."""
    out = []
    for x in inlines:
        if x.kind in SPACE_KINDS:
            out.append(" ")
        elif x.kind in ("text", "code", "math", "raw", "ref"):
            out.append(x.text)
        else:
            out.append(plain(x.kids))
    return trim("".join(out))
