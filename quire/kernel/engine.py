"""One document from source to Markdown, with everything noted on the way."""

from __future__ import annotations

import sys
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

from quire.kernel import render, scanner
from quire.kernel.nodes import WRAPPERS, Node, parts, text_node
from quire.kernel.reader import Reader, Settings

#: Python frames a document may nest; deeper ones end with an error of their own.
MAX_FRAMES = 20_000
#: Counted kinds of blocks, and of inlines.
BLOCK_STATS = {
    "section": "headings",
    "paragraph": "paragraphs",
    "bullet_list": "lists",
    "ordered_list": "lists",
    "description_list": "lists",
    "table": "tables",
    "figure": "figures",
    "display_math": "equations",
    "code_block": "code_blocks",
    "verbatim": "code_blocks",
    "quote": "quotes",
    "theorem": "theorems",
}
INLINE_STATS = {"math": "inline_math", "cite": "citations", "link": "links"}
STATS = tuple(dict.fromkeys([*BLOCK_STATS.values(), *INLINE_STATS.values(), "footnotes"]))


@dataclass
class Result:
    blocks: list[Node] = field(default_factory=list)
    metadata: dict[str, str] = field(default_factory=dict)
    footnotes: dict[int, str] = field(default_factory=dict)
    bibliography: str | None = None
    warnings: list[str] = field(default_factory=list)
    events: list[dict] = field(default_factory=list)
    entries: list = field(default_factory=list)
    error: str | None = None

    def markdown(self, with_frontmatter: bool = True) -> str | None:
        if self.error is not None:
            return None
        return render.document(self.blocks, self.metadata, self.footnotes, self.bibliography, with_frontmatter)

    def stats(self) -> dict[str, int]:
        found = Counter(kind for kind in _counted(self.blocks))
        return {name: found[name] for name in STATS} | {"footnotes": len(self.footnotes)}


def _counted(blocks: list[Node], in_table: bool = False) -> Iterator[str]:
    """The names of all that is counted. Paragraphs of table cells, and what footnotes hold, are not."""
    for node in blocks:
        name = BLOCK_STATS.get(node.kind)
        if name and not (in_table and name == "paragraphs"):
            yield name
        for kind, kids in parts(node):
            yield from _counted(kids, in_table or node.kind == "table") if kind == "blocks" else _counted_inlines(kids)


def _counted_inlines(inlines: list[Node]) -> Iterator[str]:
    for node in inlines:
        if node.kind in INLINE_STATS:
            yield INLINE_STATS[node.kind]
        if node.kind in WRAPPERS:
            yield from _counted_inlines(node.kids)


class _Resolver:
    """The second pass: references whose labels came later, and citations with the final style."""

    def __init__(self, reader: Reader) -> None:
        self.reader = reader

    def blocks(self, nodes: list[Node]) -> None:
        for node in nodes:
            for kind, kids in parts(node):
                (self.blocks if kind == "blocks" else self.inlines)(kids)

    def inlines(self, nodes: list[Node]) -> None:
        r = self.reader
        for i, node in enumerate(nodes):
            if node.kind == "ref":
                shown = r.shown_reference(node["command"], node.text)
                r.note("late_ref", kind=node["command"], label=node.text, shown=shown)
                if shown is None:
                    r.warn(f"unresolved reference `\\{node['command']}{{{node.text}}}`")
                else:
                    nodes[i] = text_node(shown)
            elif node.kind == "cite" and not node.kids:
                if r.citations.entries:
                    for key in node["keys"]:
                        if key not in r.citations.entries:
                            r.warn(f"citation key `{key}` not found in bibliography")
                shown = r.citations.render(node["keys"], node["mode"], node["before"], node["after"])
                r.note("cite", keys=node["keys"], mode=node["mode"], shown=shown, before=node["before"], after=node["after"])
                node.kids = [text_node(shown)]
            elif node.kind in WRAPPERS:
                self.inlines(node.kids)


def read(source: str | None, settings: Settings | None = None) -> Result:
    """A document read and resolved. Null reads as empty; what can't be read gives a result with an error."""
    limit = sys.getrecursionlimit()
    sys.setrecursionlimit(max(limit, MAX_FRAMES))
    try:
        reader = Reader(scanner.scan(source or ""), settings or Settings())
        blocks = reader.document()
        reader.load_bibliographies()
        resolver, notes = _Resolver(reader), {}
        if reader.pending:
            resolver.blocks(blocks)
        for number in sorted(reader.footnotes):
            if reader.pending:
                resolver.inlines(reader.footnotes[number])
            notes[number] = render.fragment(reader.footnotes[number])
            reader.note("footnote", number=str(number), shown=notes[number])
        return Result(blocks, reader.metadata, notes, reader.citations.bibliography(), reader.warnings, reader.events, list(reader.citations.entries.values()))
    except scanner.UnbalancedBraces as e:
        return Result(error=str(e))
    except RecursionError:
        return Result(error="Groups or environments are nested too deep")
    finally:
        sys.setrecursionlimit(limit)


def convert(source: str | None, settings: Settings | None = None, with_frontmatter: bool = True) -> str:
    """Markdown of a document; raises ValueError where it can't be read."""
    found = read(source, settings)
    if found.error is not None:
        raise ValueError(found.error)
    return found.markdown(with_frontmatter)
