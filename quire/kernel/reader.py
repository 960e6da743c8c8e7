"""Tokens to blocks, as a fold over one document.

What a token means depends on the definitions before it, so reading is
sequential within a document. Tokens wait on a stack: an expansion is pushed on
top, and a fragment is read from a stack of its own.
"""

from __future__ import annotations

import posixpath
import re
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field
from datetime import date
from functools import lru_cache

from quire.kernel import bibtex, scanner, tables, text
from quire.kernel.nodes import SPACE, SPACE_KINDS, Node, plain, text_node, trimmed
from quire.kernel.scanner import END, Token, written

#: Expansions of macros and environments in a document; what comes beyond stays as it is written.
MAX_EXPANSIONS = 10_000
#: Expansions in one formula.
MAX_MATH_EXPANSIONS = 200


@dataclass
class Macro:
    parameters: int
    body: str
    default: str | None = None
    ending: str = ""


@dataclass
class Label:
    kind: str
    number: str
    title: str | None


@dataclass
class Theorem:
    shown: str
    numbered: bool
    counter: str
    within: str | None = None


@dataclass
class Settings:
    """What surrounds a document.

    `files` are the texts that it can include or cite from, by normal path.
    `commands` adds inline commands: a function from the braced argument (or
    None) to Markdown.
    """

    base: str | None = None
    files: Mapping[str, str] = field(default_factory=dict)
    search: tuple[str, ...] = (".",)
    today: date | None = None
    commands: Mapping[str, Callable[[str | None], str]] = field(default_factory=dict)


#: Inline commands that only have an argument handed through raw.
_HANDED: dict[str, Callable[[str | None], str]] = {"nolinkurl": lambda x: f"`{x or ''}`", "vbox": lambda x: x or ""}

_WRAPPING = {"textbf": "strong", "textit": "emph", "emph": "emph", "textsl": "emph", "underline": "underline", "underbar": "underline", "ul": "underline", "uline": "underline"}
_WRAPPING |= {"textsuperscript": "superscript", "textsubscript": "subscript", "textsc": "smallcaps", "st": "strikeout", "sout": "strikeout", "hl": "span", "enquote": "quoted"}
_WRAPPING |= dict.fromkeys("mbox hbox fbox text textnormal textrm textsf textup textmd centerline makecell smash".split(), "span")
#: Arguments before the content: o one option, O any number, b braced; * a star.
_BOXED = {"hyperref": "o", "textcolor": "ob", "colorbox": "b", "makebox": "O", "framebox": "O", "parbox": "ob", "raisebox": "bO", "scalebox": "bo", "resizebox": "bb"}
_UPPER, _LOWER = frozenset(("MakeUppercase", "MakeTextUppercase", "uppercase")), frozenset(("MakeLowercase", "MakeTextLowercase", "lowercase"))
_SCOPES = {"chapter": 0, "section": 1, "subsection": 2, "subsubsection": 3, "paragraph": 4, "subparagraph": 5}
_PARAGRAPH_ENDS = frozenset(("par_break", "begin", "end", "section", "display_math", "raw"))
_ITEM_ENDS = frozenset(("par_break", "begin", "display_math", "raw"))
_THEOREMS = {name: Theorem(shown, numbered, name) for name, (shown, numbered) in tables.THEOREMS.items()}
_ONLY_LAYOUT = frozenset(tables.LAYOUT) - {*tables.CITATIONS, *tables.REFERENCES, *tables.MACROS, *tables.ACCENTS, *tables.SYMBOLS, "footnote", "thanks", "footnotemark", "footnotetext"}
_STARTS_PARAGRAPH = frozenset(("text", "inline_math", "left_brace", "ref", "cite", "verb", "tilde", "line_break"))
_LISTING_LANGUAGE = re.compile(r"(?:^|,)\s*language\s*=([^,]*)")


class Reader:
    def __init__(self, tokens: list[Token], settings: Settings) -> None:
        self.stack: list[Token] = tokens[::-1]
        self.settings, self.base, self.search = settings, settings.base, list(settings.search)
        self.macros: dict[str, Macro] = {}
        self.environments: dict[str, Macro] = {}
        self.theorems = dict(_THEOREMS)
        self.theorem_counts: dict[tuple[str, str | None], int] = {}
        self.sections = [0] * 6
        self.counts = {"Figure": 0, "Table": 0, "Equation": 0}
        self.labels: dict[str, Label] = {}
        self.footnotes: dict[int, list[Node]] = {}
        self.footnote_count = 0
        self.metadata: dict[str, str] = {}
        self.bibliographies: list[str] = []
        self.citations = bibtex.Citations()
        self.included: set[str] = set()
        self.warnings: list[str] = []
        self.events: list[dict] = []
        self.expansions = 0
        #: Whether some reference or citation is to be looked at again in the end.
        self.pending = False

    # tokens

    @property
    def now(self) -> Token:
        return self.stack[-1] if self.stack else END

    def step(self) -> Token:
        return self.stack.pop() if self.stack else END

    def at(self, kind: str, value: str | None = None) -> bool:
        k, t, _ = self.now
        return k == kind and (value is None or t == value)

    def push(self, src: str) -> None:
        self.stack.extend(scanner.scan(src)[::-1])

    def gap(self) -> None:
        """Past blanks and comments, but not newlines."""
        while self.now[0] in ("whitespace", "comment"):
            self.step()

    def star(self) -> bool:
        found = self.at("text", "*")
        if found:
            self.step()
        return found

    def option(self) -> str | None:
        """A bracketed argument as text."""
        if not self.at("left_bracket"):
            return None
        self.step()
        return self._until("right_bracket")

    def _until(self, kind: str) -> str:
        """Text up to a token of this kind, which is passed over."""
        out = []
        while self.stack and not self.at(kind):
            out.append(written(self.step()))
        self.step()
        return "".join(out)

    def group(self) -> list[Token]:
        """The tokens of a braced argument; none if there is no brace."""
        if not self.at("left_brace"):
            return []
        self.step()
        depth, out = 1, []
        while self.stack:
            token = self.step()
            depth += {"left_brace": 1, "right_brace": -1}.get(token[0], 0)
            if not depth:
                break
            out.append(token)
        return out

    def braced(self) -> str:
        return "".join(map(written, self.group()))

    def skip(self, signature: str) -> None:
        """Past arguments (see _BOXED)."""
        for c in signature:
            if c == "b":
                self.braced()
            elif c == "*":
                self.star()
            elif c == "o":
                self.option()
            else:
                while self.option() is not None:
                    pass

    def body_of(self, env: str) -> str:
        """Text up to the end of an environment."""
        out = []
        while self.stack:
            token = self.step()
            if token[:2] == ("end", env):
                break
            out.append(written(token))
        return "".join(out)

    def fragment(self, tokens: list[Token]) -> tuple[list[Node], str | None]:
        """Tokens read as inlines, and the last label among them, which is taken out."""
        label = None
        for kind, value, _ in tokens:
            if kind == "label":
                label = value
        outer, self.stack = self.stack, [t for t in reversed(tokens) if t[0] != "label"]
        out = []
        try:
            while self.stack:
                if self.at("par_break"):
                    self.step()
                    out.append(SPACE)
                elif (node := self.inline()) is not None:
                    out.append(node)
        finally:
            self.stack = outer
        return out, label

    # what is noted besides the blocks

    def note(self, event: str, **what: object) -> None:
        self.events.append({"event": event, "pos": len(self.events), **what})

    def warn(self, message: str) -> None:
        self.warnings.append(message)

    def set_label(self, name: str, kind: str, number: str, title: str | None) -> None:
        self.labels[name] = Label(kind, number, title)
        self.note("label", label=name, kind=kind, number=number, title=title)

    def counted_label(self, name: str, kind: str, title: str | None = None) -> str:
        self.counts[kind] += 1
        number = str(self.counts[kind])
        self.set_label(name, kind, number, title)
        return number

    @property
    def section_number(self) -> str:
        """From the first counter that has started to the one before the next that hasn't."""
        out: list[str] = []
        for n in self.sections:
            if n:
                out.append(str(n))
            elif out:
                break
        return ".".join(out)

    # blocks

    def document(self) -> list[Node]:
        out = []
        while self.stack:
            self.gap()
            if self.stack and (block := self.block()) is not None:
                out.append(block)
        return out

    def inside(self, env: str, on_label: Callable[[str], None] | None = None) -> list[Node]:
        """Blocks up to the end of an environment."""
        out = []
        while self.stack:
            self.gap()
            if self.at("end", env):
                self.step()
                break
            if on_label and self.at("label"):
                on_label(self.step()[1])
            elif (block := self.block()) is not None:
                out.append(block)
        return out

    def block(self) -> Node | None:
        kind, value, aux = self.now
        if kind == "begin":
            self.step()
            return self.environment(value)
        if kind == "end" and value in self.environments:
            self.step()
            if text.trim(self.environments[value].ending):
                self.push(self.environments[value].ending)
            return None
        if kind == "command" and value in tables.BLOCK_COMMANDS:
            self.step()
            return self.block_command(value)
        if kind == "command" or kind in _STARTS_PARAGRAPH:
            return self.paragraph()
        self.step()
        if kind == "section":
            return self.section(aux, value)
        if kind == "display_math":
            return Node("display_math", self.math(value))
        if kind == "raw":
            return _raw_block(value, aux.removeprefix("\n"))
        return None

    def section(self, level: int, title: str) -> Node:
        self.sections[level:] = [self.sections[level] + 1] + [0] * (5 - level)
        inlines, label = self.fragment(scanner.scan(title))
        while self.now[0] in ("whitespace", "newline", "comment"):
            self.step()
        if self.at("label"):
            label = self.step()[1]
        number = self.section_number
        self.note("heading", level=level, number=number, title=plain(inlines), label=label)
        if label is not None:
            self.set_label(label, "Section", number, plain(inlines))
        return Node("section", kids=inlines, level=level, label=label, number=number)

    def paragraph(self) -> Node | None:
        out: list[Node] = []
        add, stack = out.append, self.stack
        while stack:
            kind, value, _ = stack[-1]
            if kind == "text":
                stack.pop()
                add(Node("text", value))
            elif kind == "whitespace" or kind == "newline":
                stack.pop()
                add(SPACE)
            elif kind == "command" and value in _ONLY_LAYOUT and value not in self.macros:
                stack.pop()
                self.layout(value)
            elif kind in _PARAGRAPH_ENDS:
                break
            elif kind == "command" and value == "par":
                stack.pop()
                break
            elif (node := self.inline()) is not None:
                add(node)
        return Node("paragraph", kids=out) if out else None

    def environment(self, env: str) -> Node | None:
        if env == "document":
            return None
        if env == "abstract":
            heading = Node("paragraph", kids=[Node("strong", kids=[text_node("Abstract")])])
            return Node("quote", kids=[heading, *self.inside(env)])
        if env in ("itemize", "enumerate"):
            return self.list(env)
        if env == "description":
            return self.description()
        if env in tables.QUOTES:
            return Node("quote", kids=self.inside(env))
        if env in tables.MATH:
            return self.math_environment(env)
        if env in tables.TABLES:
            return self.float(env, self.table)
        if env in tables.TABULARS:
            return self.tabular(env)
        if env in tables.FIGURES:
            return self.float(env, self.figure)
        if env in tables.THROUGH:
            arguments, option = tables.THROUGH[env]
            if option:
                self.gap()
                self.option()
            for _ in range(arguments):
                self.gap()
                self.braced()
            return _joined(self.inside(env))
        if env == "thebibliography":
            return self.bibitems()
        if env in tables.DRAWINGS:
            return Node("code_block", self.body_of(env), language="latex")
        if env in self.theorems:
            return self.theorem(env)
        if env in self.environments:
            return self.user_environment(env)
        self.warn(f"unknown environment `{env}` preserved as raw LaTeX")
        return Node("raw_block", f"\\begin{{{env}}}{self.body_of(env)}\\end{{{env}}}")

    def user_environment(self, env: str) -> None:
        """Its beginning goes on top of the tokens, as its ending does where it ends."""
        definition = self.environments[env]
        arguments = []
        wanted = definition.parameters
        if definition.default is not None:
            self.gap()
            given = self.option()
            arguments.append(definition.default if given is None else given)
            wanted -= 1
        for _ in range(wanted):
            self.gap()
            arguments.append(self.braced())
        body = text.filled(definition.body, arguments)
        if text.trim(body) and self.expansions < MAX_EXPANSIONS:
            self.expansions += 1
            self.push(body)

    # lists

    def list(self, env: str) -> Node:
        self.gap()
        self.option()
        items = []
        while self.stack:
            self.gap()
            kind, value, _ = self.step()
            if kind == "end" and value == env:
                break
            if kind == "item":
                self.marker()
                items.append(self.item(env))
        return Node("bullet_list" if env == "itemize" else "ordered_list", kids=items)

    def marker(self) -> None:
        """A marker of its own, as in \\item[--], is passed over; the blanks before it only with it."""
        ahead = len(self.stack) - 1
        while ahead >= 0 and self.stack[ahead][0] in ("whitespace", "newline"):
            ahead -= 1
        if ahead >= 0 and self.stack[ahead][0] == "left_bracket":
            del self.stack[ahead + 1 :]
            self.option()

    def item(self, env: str) -> list[Node]:
        """An inline run and the blocks that directly follow it; what comes behind the first gap is not kept."""
        inlines, out = [], []
        while self.stack and not self.at("item") and not self.at("end", env) and self.now[0] not in _ITEM_ENDS:
            if (node := self.inline()) is not None:
                inlines.append(node)
        if inlines:
            out.append(Node("paragraph", kids=inlines))
        while self.stack:
            self.gap()
            if self.at("item") or self.at("end", env):
                break
            block = self.block()
            if block is None:
                break
            out.append(block)
        return out or [Node("paragraph")]

    def description(self) -> Node:
        items = []
        while self.stack:
            self.gap()
            kind, value, _ = self.step()
            if kind == "end" and value == "description":
                break
            if kind == "item":
                term = [text_node("Item")]
                if self.at("left_bracket"):
                    self.step()
                    term = self.inlines_to("right_bracket")
                items.append((term, self.item("description")))
        return Node("description_list", kids=items)

    # mathematics

    def math_environment(self, env: str) -> Node:
        base, numbered = env.rstrip("*"), not env.endswith("*")
        if base == "alignat":
            self.gap()
            self.braced()
        out, label, number = [], None, ""
        while self.stack:
            token = self.step()
            kind, value, _ = token
            if kind == "end" and value == env:
                break
            if kind == "label":
                label = value
                if numbered:
                    self.counted_label(value, "Equation")
            elif kind != "command" or value not in ("nonumber", "notag"):
                out.append(written(token))
        content = self.math(text.trim("".join(out)))
        if numbered and label is not None:
            number = self.labels[label].number
            content += f"\\tag{{{number}}}"
        wrapper = "aligned" if base in tables.ALIGNED else "gathered" if base == "gather" else ""
        if wrapper:
            content = f"\\begin{{{wrapper}}}\n{content}\n\\end{{{wrapper}}}"
        return Node("display_math", content, label=label, number=number)

    def math(self, formula: str) -> str:
        """A formula with the document's macros replaced, again and again from the same place."""
        at, left = 0, MAX_MATH_EXPANSIONS
        while left and (at := formula.find("\\", at)) >= 0:
            name = scanner.name_at(formula, at + 1)
            macro = self.macros.get(name) if name else None
            if macro is None:
                at += 1
                continue
            arguments, end = _math_arguments(macro, formula, at + 1 + len(name))
            formula = formula[:at] + text.filled(macro.body, arguments) + formula[end:]
            left -= 1
        return formula

    # floats

    def float(self, env: str, finish: Callable[[dict], Node | None]) -> Node | None:
        """A table or figure: the last caption, label and tabular, and all images."""
        self.gap()
        self.option()
        found: dict = {"caption": None, "label": None, "tabular": None, "images": []}
        while self.stack:
            self.gap()
            kind, value, _ = self.step()
            if kind == "end" and value == env:
                break
            if kind == "label":
                found["label"] = value
            elif kind == "command" and value == "caption":
                self.skip("*o")
                found["caption"], label = self.fragment(self.group())
                found["label"] = found["label"] if label is None else label
            elif kind == "command" and value == "includegraphics" and env in tables.FIGURES:
                self.skip("*o")
                if path := self.braced():
                    found["images"].append(path)
            elif kind == "begin" and value in tables.TABULARS and env in tables.TABLES:
                found["tabular"] = self.tabular(value)
        return finish(found)

    def _number_float(self, kind: str, found: dict) -> str:
        if found["label"] is None:
            return ""
        return self.counted_label(found["label"], kind, plain(found["caption"] or []) or None)

    def table(self, found: dict) -> Node | None:
        tabular = found["tabular"]
        if tabular is None:
            return None
        number = self._number_float("Table", found)
        tabular.attrs |= {"caption": found["caption"], "label": found["label"], "number": number}
        return tabular

    def figure(self, found: dict) -> Node | None:
        number, caption = self._number_float("Figure", found), found["caption"]
        if not found["images"]:
            return None if caption is None else Node("paragraph", kids=caption)
        first = {"caption": caption, "label": found["label"], "number": number}
        return _joined([Node("figure", path, **({} if i else first)) for i, path in enumerate(found["images"])])

    def tabular(self, env: str) -> Node:
        self.gap()
        self.option()
        if env in tables.WIDE_TABULARS:
            self.gap()
            self.braced()
        self.gap()
        spec = self.braced() if self.at("left_brace") else None
        columns = [""] if spec is None else list(_short_columns(spec)) if len(spec) <= 64 else _columns(spec)
        rows: list[list[list[Node]]] = []
        row: list[list[Node]] = []
        cell: list[Node] = []
        owed = 0

        def close_cell() -> None:
            nonlocal cell, owed
            if cell:
                # most cells end with a blank, and few hold more than a word
                if cell[-1] is SPACE:
                    cell.pop()
                kept = cell if len(cell) == 1 and cell[0].kind not in SPACE_KINDS else trimmed(cell)
                row.append([Node("paragraph", kids=kept)] if kept else [])
                cell = []
            else:
                row.append([])
            if owed:
                row.extend([] for _ in range(owed))
                owed = 0

        stack = self.stack
        while stack:
            kind, value, _ = token = stack.pop()
            if kind == "whitespace" or kind == "newline":
                # blanks before a cell are cut away in any case
                if cell:
                    cell.append(SPACE)
            elif kind == "text":
                cell.append(text_node(value))
            elif kind == "ampersand":
                close_cell()
            elif kind == "line_break":
                if stack and stack[-1][0] == "left_bracket":
                    self.option()
                close_cell()
                rows.append(row)
                row = []
            elif kind == "command" and value in tables.TABLE_RULES:
                self.rule_arguments(value)
            elif kind == "end" and value == env:
                break
            elif kind == "label" or kind == "comment":
                continue
            elif kind == "command" and value in ("multicolumn", "multirow"):
                first = self.braced()
                if value == "multirow":
                    self.option()
                else:
                    n = text.count(first)
                    owed = max(owed, (1 if n is None else n) - 1)
                self.braced()
                cell += self.fragment(self.group())[0]
            else:
                stack.append(token)
                if (node := self.inline()) is not None:
                    cell.append(node)
        if cell or row or owed:
            close_cell()
            rows.append(row)
        return Node("table", kids=[r for r in rows if any(r)], columns=columns)

    def rule_arguments(self, rule: str) -> None:
        if rule in ("cline", "cmidrule", "cmidrules"):
            if self.now[0] == "text" and self.now[1].startswith("("):
                self.step()
            self.skip("ob")
        elif rule in ("rowcolor", "arrayrulecolor"):
            self.braced()
        elif rule == "addlinespace":
            self.option()

    # theorems and bibliographies

    def theorem(self, env: str) -> Node:
        definition = self.theorems[env]
        number = self.theorem_number(definition)
        title, labels = self.option(), []
        content = self.inside(env, labels.append)
        label = labels[-1] if labels else None
        if label is not None and number is not None:
            self.set_label(label, definition.shown, number, title)
        return Node("theorem", kids=content, environment=env, shown=definition.shown, number=number, label=label, title=title)

    def theorem_number(self, definition: Theorem) -> str | None:
        if not definition.numbered:
            return None
        scope = None
        if definition.within is not None:
            depth = _SCOPES.get(definition.within)
            scope = self.section_number if depth is None else ".".join(str(n) for n in self.sections[: depth + 1] if n)
        key = definition.counter, scope
        n = self.theorem_counts[key] = self.theorem_counts.get(key, 0) + 1
        number = f"{scope}.{n}" if scope else str(n)
        self.note("theorem", label=definition.counter, kind=definition.shown, number=number, title=scope)
        return number

    def bibitems(self) -> Node | None:
        self.gap()
        self.braced()
        entries: list[tuple[str, list[Node]]] = []
        while self.stack:
            if self.at("end", "thebibliography"):
                self.step()
                break
            if self.at("command", "bibitem"):
                self.step()
                self.option()
                entries.append((self.braced(), []))
            elif self.at("par_break"):
                self.step()
                if entries and entries[-1][1]:
                    entries[-1][1].append(SPACE)
            elif (node := self.inline()) is not None and entries:
                entries[-1][1].append(node)
        if not entries:
            return None
        out = [Node("section", kids=[text_node("References")], level=1)]
        for key, inlines in entries:
            marker = self.citations.render([key], "normal", None, None)
            self.note("cite", keys=[key], mode="bibitem", shown=marker)
            out.append(Node("paragraph", kids=[text_node(f"{marker} "), *inlines]))
        return Node("composite", kids=out)

    # block commands

    def block_command(self, name: str) -> Node | None:
        match name:
            case "par" | "noindent":
                return None
            case "hline" | "hrule":
                return Node("rule")
            case "documentclass":
                self.skip("ob")
            case "include" | "input":
                return self.include(name, self.braced())
            case "usepackage":
                options, package = self.option() or "", self.braced()
                if package == "biblatex" and any(_author_year_option(o) for o in options.split(",")):
                    self.citations.author_year = True
            case "newcommand" | "renewcommand" | "providecommand" | "def" | "DeclareRobustCommand":
                self.star()
                self.define_macro(keep=name == "providecommand")
            case "newenvironment" | "renewenvironment":
                self.star()
                self.define_environment()
            case "newtheorem":
                self.define_theorem(numbered=not self.star())
            case "bibliography" | "addbibresource":
                if spec := self.braced():
                    self.bibliographies.append(spec)
            case "bibliographystyle":
                style = text.trim(self.braced()).lower()
                if style in tables.NUMERIC_STYLES or style in tables.AUTHOR_YEAR_STYLES:
                    self.citations.author_year = style in tables.AUTHOR_YEAR_STYLES
            case "title" | "author" | "date":
                self.describe(name)
            case "maketitle":
                return self.title_block()
            case "graphicspath":
                self.search += [p for p in (text.trim(x) for x in re.findall(r"\{([^{}]+)\}", self.braced())) if p not in self.search]
            case _:
                self.layout(name)
        return None

    def layout(self, name: str) -> None:
        """Past the arguments of a command that has no output."""
        arguments, option = tables.LAYOUT[name]
        stack = self.stack
        if stack and stack[-1][0] == "text":
            self.star()
        if option:
            self.option()
        for _ in range(arguments):
            while stack and stack[-1][0] in ("whitespace", "comment"):
                stack.pop()
            if stack and stack[-1][0] == "left_brace":
                depth = 0
                while stack:
                    kind = stack.pop()[0]
                    if kind == "left_brace":
                        depth += 1
                    elif kind == "right_brace":
                        depth -= 1
                        if not depth:
                            break

    def define_macro(self, keep: bool) -> None:
        if self.at("left_brace"):
            name = self.braced()
        elif self.at("command"):
            name = self.step()[1]
        else:
            return
        if not name:
            return
        parameters = text.count(self.option() or "") or 0
        if self.now[0] == "text" and self.now[1].startswith("#"):
            parameters = self.step()[1].count("#")
        default, body = self.option(), self.braced()
        name = text.trim(name).lstrip("\\")
        if name and not (keep and name in self.macros):
            self.macros[name] = Macro(parameters, body, default)
            self.note("macro", label=name, number=str(parameters), title=default, shown=body)

    def define_environment(self) -> None:
        name = self.braced()
        parameters = text.count(self.option() or "") or 0
        default, beginning, ending = self.option(), self.braced(), self.braced()
        if name:
            self.environments[name] = Macro(parameters, beginning, default, ending)
            self.note("environment", label=name, number=str(parameters), title=default, shown=beginning)

    def define_theorem(self, numbered: bool) -> None:
        env = self.braced()
        if not env:
            return
        shared, shown, within = self.option() or None, self.braced() or "Theorem", self.option() or None
        self.theorems[env] = Theorem(shown, numbered, shared or env, within)

    def describe(self, name: str) -> None:
        from quire.kernel.render import fragment

        self.option()
        shown = " ".join(text.words(fragment(self.fragment(self.group())[0])))
        shown = text.trim(text.trim(shown.replace(" ,", ",").replace(",,", ",")).lstrip(","))
        if shown:
            self.metadata[name] = shown

    def title_block(self) -> Node | None:
        out = []
        if "title" in self.metadata:
            out.append(Node("section", kids=[Node("raw", self.metadata["title"])], level=0))
        byline = "  \n".join(self.metadata[k] for k in ("author", "date") if k in self.metadata)
        if byline:
            out.append(Node("paragraph", kids=[Node("emph", kids=[Node("raw", byline)])]))
        return _joined(out)

    # files

    def _resolve(self, name: str, extended: bool, places: list[str]) -> str | None:
        for candidate in [name, f"{name}.tex"] if extended and not name.endswith(".tex") else [name]:
            for place in places:
                path = posixpath.normpath(posixpath.join(place, candidate))
                if path in self.settings.files:
                    return path
        return None

    def include(self, command: str, name: str) -> Node | None:
        """Another file's blocks. A file is read once; a second time counts as not found."""
        if not name:
            return None
        places = ([] if self.base is None else [self.base]) + self.search
        path = None
        for extended in (True,) if command == "include" else (False, True):
            found = self._resolve(name, extended, places)
            if found is not None and found not in self.included:
                path = found
                break
        self.note("include", label=name, kind=command, title=path)
        if path is None:
            self.warn(f"could not resolve \\{command}{{{name}}} — content skipped")
            return None
        self.included.add(path)
        outer = self.stack, self.base, self.expansions
        self.stack, self.expansions = scanner.scan(self.settings.files[path])[::-1], 0
        self.base = posixpath.dirname(self._resolve(name, True, places) or path)
        try:
            return _joined(self.document())
        finally:
            self.stack, self.base, self.expansions = outer

    def load_bibliographies(self) -> None:
        for spec in self.bibliographies:
            for name in filter(None, map(text.trim, spec.split(","))):
                for candidate in [name] if name.endswith(".bib") else [name, f"{name}.bib"]:
                    tried = ([] if self.base is None else [posixpath.join(self.base, candidate)]) + [candidate]
                    path = next((p for p in map(posixpath.normpath, tried) if p in self.settings.files), None)
                    if path is not None:
                        self.citations.entries |= {e.key: e for e in bibtex.parse(self.settings.files[path])}
                        break

    # inlines

    def inlines_to(self, kind: str) -> list[Node]:
        """Inlines up to a token of this kind, which is passed over."""
        out = []
        while self.stack and not self.at(kind):
            if (node := self.inline()) is not None:
                out.append(node)
        self.step()
        return out

    def content(self) -> list[Node]:
        if not self.at("left_brace"):
            return []
        self.step()
        return self.inlines_to("right_brace")

    def inline(self) -> Node | None:
        kind, value, aux = self.step()
        match kind:
            case "text":
                return text_node(value)
            case "whitespace" | "newline":
                return SPACE
            case "command":
                return self.inline_command(value)
            case "inline_math":
                return Node("math", self.math(value))
            case "left_brace":
                return self.braced_group()
            case "verb":
                return Node("code", value)
            case "tilde":
                return text_node("\xa0")
            case "line_break":
                self.option()
                return Node("line_break")
            case "ref":
                return self.reference(aux, value)
            case "cite":
                keys = [k for k in map(text.trim, value.split(",")) if k]
                self.pending = True
                return Node("cite", keys=keys, mode=tables.CITATIONS[aux])
        return None

    def braced_group(self) -> Node | None:
        """A group; font declarations at its start style all of it."""
        if self.stack and self.stack[-1][0] == "right_brace":
            self.stack.pop()
            return None
        styles = []
        while True:
            ahead = len(self.stack) - 1
            while ahead >= 0 and self.stack[ahead][0] == "whitespace":
                ahead -= 1
            if ahead < 0 or self.stack[ahead][0] != "command" or self.stack[ahead][1] not in tables.DECLARATIONS:
                break
            styles.append(tables.DECLARATIONS[self.stack[ahead][1]])
            del self.stack[ahead:]
        inlines = self.inlines_to("right_brace")
        if styles:
            inlines = trimmed(inlines)
        for style in reversed(styles):
            if style and inlines:
                inlines = [Node(style, kids=inlines)]
        if len(inlines) < 2:
            return inlines[0] if inlines else None
        return Node("span", kids=inlines)

    def inline_command(self, name: str) -> Node | None:
        if name in _ONLY_LAYOUT and name not in self.macros:
            return self.layout(name)
        if name in tables.CITATIONS:
            return self.citation(name)
        if name in tables.REFERENCES:
            return self.reference(name, self.braced())
        if name in ("footnote", "thanks", "footnotemark", "footnotetext"):
            return self.footnote(name)
        if name in self.macros or name in tables.MACROS:
            return self.expand(name)
        if name in tables.ACCENTS:
            value = self.braced() if self.at("left_brace") else self.step()[1] if self.at("text") else ""
            return text_node(text.accented(name, value))
        if name in tables.SYMBOLS:
            return text_node(tables.SYMBOLS[name])
        if name in tables.LAYOUT:
            return self.layout(name)
        if name in tables.TEXT_SYMBOLS:
            return text_node(tables.TEXT_SYMBOLS[name])
        if name in _WRAPPING:
            return Node(_WRAPPING[name], kids=self.content())
        if name in _BOXED:
            self.skip(_BOXED[name])
            return Node("span", kids=self.content())
        if name in _UPPER:
            return text_node(self.braced().upper())
        if name in _LOWER:
            return text_node(self.braced().lower())
        match name:
            case "texttt" | "code" | "verb":
                return Node("code", self.braced())
            case "ensuremath":
                return Node("math", self.braced())
            case "href":
                self.option()
                return Node("link", self.braced(), kids=self.content())
            case "url":
                url = self.braced()
                return Node("link", url, kids=[text_node(url)])
            case "includegraphics":
                self.skip("*o")
                return Node("image", self.braced())
            case "caption":
                self.skip("*o")
                return Node("strong", kids=self.content())
            case "newline":
                return Node("line_break")
            case "linebreak":
                self.option()
                return Node("line_break")
            case "and" | "And" | "AND":
                return text_node(", ")
            case "par":
                return SPACE
            case "today":
                return text_node(text.long_date(self.settings.today or date.today()))
        handler = self.settings.commands.get(name) or _HANDED.get(name)
        if handler:
            shown = handler(self.braced() if self.at("left_brace") else None)
            if shown and shown != f"\\{name}":
                return Node("raw", shown)
        self.warn(f"unknown command `\\{name}` kept as plain text")
        return text_node(f"\\{name}")

    def footnote(self, name: str) -> Node | None:
        given = self.option()
        number = text.count(given or "") if name in ("footnotemark", "footnotetext") else None
        if name == "footnotemark":
            if number is None:
                number = self.footnote_count = self.footnote_count + 1
            return text_node(f"[^{number}]")
        inlines, _ = self.fragment(self.group())
        if name == "footnotetext":
            self.footnotes[self.footnote_count if number is None else number] = inlines
            return None
        self.footnote_count += 1
        self.footnotes[self.footnote_count] = inlines
        return text_node(f"[^{self.footnote_count}]")

    def expand(self, name: str) -> Node | None:
        macro = self.macros.get(name) or Macro(0, tables.MACROS.get(name, ""))
        arguments, wanted = [], macro.parameters
        if macro.default is not None:
            given = self.option()
            arguments.append(macro.default if given is None else given)
            wanted -= 1
        for _ in range(wanted):
            self.gap()
            arguments.append(self.braced())
        if self.expansions >= MAX_EXPANSIONS:
            return text_node(f"\\{name}")
        self.expansions += 1
        self.push(text.filled(macro.body, arguments))
        return None

    def citation(self, name: str) -> Node:
        first, second = self.option(), self.option()
        before, after = (None, first) if second is None else (first, second)
        keys = [text.trim(k) for k in self.braced().partition("}")[0].split(",")]
        self.pending = True
        return Node("cite", keys=keys, mode=tables.CITATIONS[name], before=_cite_note(before), after=_cite_note(after))

    def reference(self, kind: str, label: str) -> Node:
        """The reference's text if its label is known by now; else a node that is looked at again in the end."""
        shown = self.shown_reference(kind, label)
        self.note("ref", kind=kind, label=label, shown=shown)
        self.pending |= shown is None
        return Node("ref", label, command=kind) if shown is None else text_node(shown)

    def shown_reference(self, kind: str, label: str) -> str | None:
        found = self.labels.get(label)
        if found is None:
            return None
        match kind:
            case "nameref":
                return label if found.title is None else found.title
            case "eqref":
                return f"({found.number})"
            case "autoref" | "Cref" | "cref" | "vref":
                kind_of = found.kind.lower() if kind == "cref" else found.kind
                return f"{kind_of} {found.number}" if found.number else kind_of
        return found.number


def _joined(blocks: list[Node]) -> Node | None:
    return Node("composite", kids=blocks) if len(blocks) > 1 else blocks[0] if blocks else None


def _cite_note(note: str | None) -> str | None:
    if note is None:
        return None
    return text.trim_end(text.trim(note.replace("~", "\xa0")).rstrip(",")) or None


def _author_year_option(option: str) -> bool:
    key, _, value = option.partition("=")
    return text.trim(key) == "style" and "authoryear" in value


def _leading(opening: str, closing: str, body: str) -> tuple[str | None, str]:
    """A group at the start of a raw body, and the rest without the newline behind it."""
    start = body.lstrip(text.BLANK)
    end = start.find(closing)
    if not start.startswith(opening) or end < 0:
        return None, body
    return start[1:end], start[end + 1 :].removeprefix("\n")


def _raw_block(env: str, body: str) -> Node | None:
    language = None
    if env == "comment":
        return None
    if env == "lstlisting":
        options, body = _leading("[", "]", body)
        found = _LISTING_LANGUAGE.search(options or "")
        language = text.trim(found[1]).lower() if found else None
    elif env == "minted":
        _, body = _leading("[", "]", body)
        language, body = _leading("{", "}", body)
    elif env.startswith("filecontents"):
        _, body = _leading("{", "}", body)
    else:
        return Node("verbatim", body)
    return Node("code_block", body, language=language or None)


@lru_cache(256)
def _short_columns(spec: str) -> tuple[str, ...]:
    return tuple(_columns(spec))


def _columns(spec: str) -> list[str]:
    """A column specification as one letter (l, c, r) for each column."""
    out: list[str] = []
    at = 0

    def group() -> str:
        nonlocal at
        if spec[at : at + 1] != "{":
            return ""
        depth, start = 1, at + 1
        at = start
        while at < len(spec):
            depth += {"{": 1, "}": -1}.get(spec[at], 0)
            at += 1
            if not depth:
                return spec[start : at - 1]
        return spec[start:]

    while at < len(spec):
        c = spec[at]
        at += 1
        if c in "lcr":
            out.append(c)
        elif c in "pmbX":
            out.append("l")
            group()
        elif c in "@><!":
            group()
        elif c == "*":
            n, inner = text.count(group()) or 0, group()
            out += _columns(inner) * n
    return out


def _math_arguments(macro: Macro, formula: str, at: int) -> tuple[list[str], int]:
    """A macro's arguments inside a formula: an option, then groups or single characters."""
    out, wanted = [], macro.parameters
    if macro.default is not None:
        wanted -= 1
        if formula[at : at + 1] == "[":
            end = formula.find("]", at)
            end = len(formula) if end < 0 else end
            out.append(formula[at + 1 : end])
            at = min(end + 1, len(formula))
        else:
            out.append(macro.default)
    for _ in range(wanted):
        while at < len(formula) and formula[at].isspace():
            at += 1
        if at >= len(formula):
            break
        if formula[at] != "{":
            out.append(formula[at])
            at += 1
            continue
        depth, start = 1, at + 1
        at = start
        while at < len(formula) and depth:
            depth += {"{": 1, "}": -1}.get(formula[at], 0)
            at += 1
        out.append(formula[start : at if depth else at - 1])
    return out, at
