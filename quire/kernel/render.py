"""Blocks and inlines to Markdown. Blocks give strings; inlines share a buffer, as their spaces depend on what stands before."""

from __future__ import annotations

from quire.kernel import text
from quire.kernel.nodes import Node

_AROUND = {
    "emph": ("*", "*"),
    "strong": ("**", "**"),
    "strikeout": ("~~", "~~"),
    "underline": ("<u>", "</u>"),
    "superscript": ("<sup>", "</sup>"),
    "subscript": ("<sub>", "</sub>"),
    "smallcaps": ('<span style="font-variant: small-caps;">', "</span>"),
    "quoted": ('"', '"'),
    "span": ("", ""),
}


class _Flow:
    def __init__(self, start: str = "", in_table: bool = False) -> None:
        self.out, self.last, self.in_table = [start], start[-1:], in_table

    def add(self, s: str) -> None:
        if s:
            self.out.append(s)
            self.last = s[-1]

    def inlines(self, nodes: list[Node]) -> _Flow:
        add = self.out.append
        for node in nodes:
            kind = node.kind
            if kind == "text":
                if s := node.text:
                    add(s if s.isalnum() else text.escape(s, self.in_table))
                    self.last = s[-1]
            elif kind == "space":
                if self.last not in ("", " ", "\n"):
                    add(" ")
                    self.last = " "
            else:
                self.inline(node)
        return self

    def around(self, opening: str, nodes: list[Node], closing: str) -> None:
        self.add(opening)
        self.inlines(nodes)
        self.add(closing)

    def inline(self, node: Node) -> None:
        kind, s = node.kind, node.text
        if kind in _AROUND:
            opening, closing = _AROUND[kind]
            self.around(opening, node.kids, closing)
        elif kind == "line_break":
            self.add("<br>" if self.in_table else "  \n")
        elif kind == "code":
            s = s.replace("|", "\\|") if self.in_table else s
            self.add(f"`` {s} ``" if "`" in s else f"`{s}`")
        elif kind == "math":
            s = s.replace("|", "\\|") if self.in_table else s
            self.add(f"${text.trim(s)}$")
        elif kind in ("link", "image"):
            self.around("[" if kind == "link" else "![", node.kids, f"]({s})")
        elif kind == "cite":
            if node.kids:
                self.inlines(node.kids)
            else:
                self.add("[" + ", ".join(f"@{k}" for k in node["keys"]) + "]")
        elif kind == "ref":
            self.add(f"[{s}](#{s})")
        else:
            self.add(s)

    def done(self) -> str:
        return "".join(self.out)


def fragment(inlines: list[Node], in_table: bool = False) -> str:
    return text.trim(_Flow(in_table=in_table).inlines(inlines).done())


def blocks(nodes: list[Node], in_table: bool = False) -> str:
    return "".join(block(x, in_table) for x in nodes)


def _anchor(node: Node) -> str:
    return "" if node["label"] is None else f" {{#{node['label']}}}"


def _item(marker: str, nodes: list[Node]) -> str:
    """An item with its further lines indented; a list right behind its first paragraph stays close."""
    out = ""
    for i, node in enumerate(nodes):
        if i and node.kind in ("bullet_list", "ordered_list") and nodes[i - 1].kind == "paragraph":
            out = out.rstrip("\n") + "\n"
        out += block(node)
    found = text.lines(text.trim_end(out))
    indent = " " * len(marker)
    return marker + "\n".join(x if not i or not x else indent + x for i, x in enumerate(found or [""])) + "\n"


def _padded(cells: tuple[str, ...], width: int, column: str) -> list[str]:
    if column == "r":
        return [x.rjust(width) for x in cells]
    if column == "c":
        return [" " * ((width - len(x)) // 2) + x + " " * ((width - len(x) + 1) // 2) for x in cells]
    return [x.ljust(width) for x in cells]


def _bar(width: int, column: str) -> str:
    left, right = column in ("l", "c"), column in ("r", "c")
    return ":" * left + "-" * (width + 2 - left - right) + ":" * right


def cell(nodes: list[Node]) -> str:
    if not nodes:
        return ""
    if len(nodes) == 1 and nodes[0].kind == "paragraph" and len(nodes[0].kids) == 1 and nodes[0].kids[0].kind == "text":
        s = nodes[0].kids[0].text
        return s if s.isalnum() else text.trim(text.escape(s, True)).replace("\n", " ")
    return text.trim(blocks(nodes, True)).replace("\n", " ")


def _table(node: Node) -> str:
    caption = fragment(node["caption"] or [], True)
    head = f"**{caption}**\n\n" if caption else ""
    rows = [[cell(c) for c in row] for row in node.kids]
    size = max(map(len, rows), default=0)
    if not size:
        return head
    rows = [r + [""] * (size - len(r)) for r in rows]
    columns = (node["columns"] + [""] * size)[:size]
    cells = list(zip(*rows, strict=True))
    widths = [max(3, *map(len, x)) for x in cells]
    shown = ["| " + " | ".join(r) + " |\n" for r in zip(*map(_padded, cells, widths, columns), strict=True)]
    shown.insert(1, "|" + "|".join(map(_bar, widths, columns)) + "|\n")
    return head + "".join(shown) + "\n"


def _theorem(node: Node) -> str:
    head = node["shown"] or node["environment"].upper()
    if node["number"] is not None:
        head += f" {node['number']}"
    if node["title"] is not None:
        head += f" ({node['title']})"
    body = "".join(f"> {x}\n" for x in text.lines(text.trim_end(blocks(node.kids))))
    return f"> **{head}**{_anchor(node)}\n>\n{body}\n"


def block(node: Node, in_table: bool = False) -> str:
    match node.kind:
        case "section":
            return "#" * min(node["level"] + 1, 6) + f" {fragment(node.kids)}{_anchor(node)}\n\n"
        case "paragraph":
            shown = fragment(node.kids, in_table)
            return shown and shown + "\n\n"
        case "bullet_list":
            return "".join(_item("- ", x) for x in node.kids) + "\n"
        case "ordered_list":
            return "".join(_item(f"{i}. ", x) for i, x in enumerate(node.kids, 1)) + "\n"
        case "description_list":
            return "".join(_Flow("**").inlines(term).done() + "**\n" + "".join(f": {text.trim_end(block(x))}\n" for x in about) + "\n" for term, about in node.kids)
        case "quote":
            found = text.lines(text.trim_end(blocks(node.kids)))
            return "".join(f"> {x}\n" if x else ">\n" for x in found) + "\n"
        case "code_block" | "verbatim":
            return f"```{node['language'] or ''}\n{text.trim_end(node.text)}\n```\n\n"
        case "display_math":
            return f"$$\n{text.trim(node.text)}\n$$\n\n"
        case "table":
            return _table(node)
        case "figure":
            return _Flow("![").inlines(node["caption"] or []).done() + f"]({node.text}){_anchor(node)}\n\n"
        case "composite":
            return blocks(node.kids, in_table)
        case "theorem":
            return _theorem(node)
        case "raw_block":
            return node.text + "\n"
        case "rule":
            return "---\n\n"
    raise ValueError(node.kind)


def frontmatter(metadata: dict[str, str]) -> str:
    shown = "".join(f"{k}: {text.yaml(metadata[k])}\n" for k in ("title", "author", "date") if k in metadata)
    return f"---\n{shown}---\n\n" if shown else ""


def document(nodes: list[Node], metadata: dict[str, str], notes: dict[int, str], bibliography: str | None, with_frontmatter: bool) -> str:
    out = (frontmatter(metadata) if with_frontmatter else "") + blocks(nodes)
    if notes:
        out += "\n---\n\n" + "".join(f"[^{n}]: {notes[n]}\n" for n in sorted(notes))
    if bibliography is not None:
        out += ("" if out.endswith("\n\n") else "\n") + bibliography
    return out
