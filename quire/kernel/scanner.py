"""LaTeX source to tokens.

A token is a tuple (kind, text, aux). `aux` is the heading's level, the body of
a raw environment, or the command of a reference or citation.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from quire.kernel import tables

Token = tuple[str, str, object]
END: Token = ("eof", "", None)

#: What a token of this kind is, written as LaTeX, where it carries no text.
PLAIN = {
    "newline": "\n",
    "par_break": "\n\n",
    "left_brace": "{",
    "right_brace": "}",
    "left_bracket": "[",
    "right_bracket": "]",
    "line_break": "\\\\",
    "ampersand": "&",
    "tilde": "~",
    "item": "\\item ",
    "comment": "",
    "eof": "",
}
#: Commands that are not yet a token when their name has been read.
_READING = ("verb", "Verb", "lstinline", "begin", "end", "label", *tables.HEADINGS, *tables.REFERENCES, *tables.CITATIONS)
_SINGLE = {"{": "left_brace", "}": "right_brace", "[": "left_bracket", "]": "right_bracket", "&": "ampersand", "~": "tilde"}
#: What most of a source is: 1 text, 2 blanks, 3 a newline with 4 the one that makes it a paragraph's end.
_PLAIN_RUN = re.compile(r"([^\\{}\[\]$%&~\n \t\r'`]+)|([ \t\r]+)|(\n)[ \t\r]*(\n?)")
#: What is a token by itself, whatever stands around it, and the longest run of such.
_FREE = r"[^\\{}\[\]$%&~\n \t\r'`]+|[ \t\r]+|\n[ \t\r]*\n?|[{}\[\]&~]"
_FREE += rf"|\\(?!(?:{'|'.join(_READING)})(?![A-Za-z]))[A-Za-z]++(?![^\x00-\x7f])|\\[\\%$&#_{{}} \t\n'`^\"~=.,;:!]"
_FREE_ONE, _FREE_RUN = re.compile(_FREE), re.compile(f"(?:{_FREE})++")
#: Tokens that are remembered, and the length up to which their source is.
_KNOWN_TOKENS, _KNOWN_LENGTH = 1 << 14, 32
_COMMENT = re.compile(r"%((?:\\[\s\S]|[^\\\n])*\\?)")
_AFTER_COMMENT = re.compile(r"\n(?![ \t\r]*(?:\n|\Z))")
_UNTIL = {close: re.compile(rf"(?:\\[\s\S]|[^\\{re.escape(close)}])*\\?") for close in "}]$"}
_BRACE_OR_ESCAPE = re.compile(r"\\[\s\S]|[{}]")
_OPTION_BLANKS = re.compile(r"[ \t\r\n]*")


class UnbalancedBraces(ValueError):
    """The name of an environment has no closing brace."""

    def __init__(self) -> None:
        super().__init__("Unbalanced braces: expected closing brace")


def name_at(src: str, at: int) -> str:
    """The run of letters that starts at this place."""
    end = at
    while end < len(src) and src[end].isalpha():
        end += 1
    return src[at:end]


def _braced(src: str, at: int) -> tuple[str | None, int]:
    """The text in the braces that open at this place, up to the first closing one that isn't escaped."""
    if src[at : at + 1] != "{":
        return None, at
    found = _UNTIL["}"].match(src, at + 1)
    return found[0], min(found.end() + 1, len(src))


def _up_to(src: str, mark: str, at: int) -> tuple[str, int]:
    end = src.find(mark, at)
    return (src[at:], len(src)) if end < 0 else (src[at:end], end + len(mark))


def _heading(src: str, at: int, level: int) -> tuple[Token, int]:
    at += src[at : at + 1] == "*"
    if src[at : at + 1] == "[":
        at = min(_UNTIL["]"].match(src, at + 1).end() + 1, len(src))
        at = _OPTION_BLANKS.match(src, at).end()
    if src[at : at + 1] != "{":
        return ("command", "section", None), at
    depth, start, place = 1, at + 1, at + 1
    while found := _BRACE_OR_ESCAPE.search(src, place):
        place = found.end()
        depth += {"{": 1, "}": -1}.get(found[0], 0)
        if not depth:
            return ("section", src[start : place - 1], level), place
    return ("section", src[start:], level), len(src)


def _verb(src: str, at: int) -> tuple[Token, int]:
    at += src[at : at + 1] == "*"
    if at >= len(src):
        return ("command", "verb", None), at
    code, at = _up_to(src, "}" if src[at] == "{" else src[at], at + 1)
    return ("verb", code, None), at


def _begin(src: str, at: int) -> tuple[Token, int]:
    name, end = _braced(src, at)
    if name is None:
        return ("command", "begin", None), at
    if end == at + 1 + len(name):
        raise UnbalancedBraces
    if name not in tables.RAW_ENVIRONMENTS:
        return ("begin", name, None), end
    body, end = _up_to(src, f"\\end{{{name}}}", end)
    return ("raw", name, body), end


def _end(src: str, at: int) -> tuple[Token, int]:
    name, end = _braced(src, at)
    if name is None:
        return ("command", "end", None), at
    if end == at + 1 + len(name):
        raise UnbalancedBraces
    return ("end", name, None), end


def _command(src: str, at: int) -> tuple[Token | None, int]:
    """What a backslash starts; `at` is behind it."""
    c = src[at : at + 1]
    if not c:
        return ("line_break", "", None), at
    after = at + 1
    match c:
        case "\\":
            return ("line_break", "", None), after
        case "[":
            body, end = _up_to(src, "\\]", after)
            return ("display_math", body, None), end
        case "(":
            body, end = _up_to(src, "\\)", after)
            return ("inline_math", body, None), end
        case "]":
            return ("text", "\\]", None), after
        case ")" | "-" | "/" | "@" | "*":
            return None, after
        case "%" | "$" | "&" | "#" | "_" | "{" | "}":
            return ("text", c, None), after
        case "'" | "`" | "^" | '"' | "~" | "=" | "." | "," | ";" | ":" | "!":
            return ("command", c, None), after
        case " " | "\t" | "\n":
            return ("whitespace", " ", None), after
    name = name_at(src, at)
    if not name:
        return ("text", c, None), after
    at += len(name)
    if name in _READERS:
        return _READERS[name](src, at)
    if name in tables.HEADINGS:
        return _heading(src, at, tables.HEADINGS[name])
    kind = "ref" if name in tables.REFERENCES else "cite" if name in tables.CITATIONS else ""
    if kind:
        text, end = _braced(src, at)
        return (("command", name, None), at) if text is None else ((kind, text, name), end)
    return ("command", name, None), at


def _label(src: str, at: int) -> tuple[Token, int]:
    text, end = _braced(src, at)
    return (("command", "label", None), at) if text is None else (("label", text, None), end)


_READERS: dict[str, Callable[[str, int], tuple[Token, int]]] = {
    "verb": _verb,
    "Verb": _verb,
    "lstinline": _verb,
    "begin": _begin,
    "end": _end,
    "item": lambda src, at: (("item", "", None), at),
    "label": _label,
}


def _math(src: str, at: int) -> tuple[Token, int]:
    if src[at + 1 : at + 2] == "$":
        end = src.find("$$", at + 2)
        if end >= 0:
            return ("display_math", src[at + 2 : end], None), end + 2
        return ("display_math", src[at + 2 :].removesuffix("$"), None), len(src)
    body = _UNTIL["$"].match(src, at + 1)
    return ("inline_math", body[0], None), min(body.end() + 1, len(src))


class _Known(dict):
    """Tokens by what is written, read once."""

    def __missing__(self, written: str) -> Token:
        token = _free(written)
        if len(written) <= _KNOWN_LENGTH:
            if len(self) >= _KNOWN_TOKENS:
                self.clear()
            self[written] = token
        return token


def _free(written: str) -> Token:
    if written[0] == "\\":
        return _command(written, 1)[0]
    if written in _SINGLE:
        return (_SINGLE[written], "", None)
    text, blanks, _, second = _PLAIN_RUN.match(written).groups()
    if text:
        return ("text", text.replace("---", "—").replace("--", "–") if "--" in text else text, None)
    if blanks:
        return ("whitespace", blanks, None)
    return ("par_break" if second else "newline", "", None)


_KNOWN = _Known()


def scan(src: str) -> list[Token]:
    """Tokens of a source, without an end token.

    A command as the very last characters, such as a bare \\ref, is an ordinary
    command. Only an environment's name without closing brace is an error.
    """
    out: list[Token] = []
    at, size = 0, len(src)
    while at < size:
        if run := _FREE_RUN.match(src, at):
            out += map(_KNOWN.__getitem__, _FREE_ONE.findall(src, at, run.end()))
            at = run.end()
            continue
        c = src[at]
        if c == "\\":
            token, at = _command(src, at + 1)
            if token:
                out.append(token)
        elif c in _SINGLE:
            out.append((_SINGLE[c], "", None))
            at += 1
        elif c == "$":
            token, at = _math(src, at)
            out.append(token)
        elif c == "%":
            run = _COMMENT.match(src, at)
            out.append(("comment", run[1], None))
            at = run.end()
            if joined := _AFTER_COMMENT.match(src, at):
                at = joined.end()
        else:
            twice = src[at + 1 : at + 2] == c
            out.append(("text", ("“" if twice else "‘") if c == "`" else ("”" if twice else "’"), None))
            at += 1 + twice
    return out


def written(token: Token) -> str:
    """A token as LaTeX again. Escapes, stars and comments are not kept."""
    kind, text, aux = token
    match kind:
        case "text" | "whitespace":
            return text
        case "command":
            return f"\\{text}"
        case "inline_math":
            return f"${text}$"
        case "display_math":
            return f"$${text}$$"
        case "begin" | "end":
            return f"\\{kind}{{{text}}}"
        case "raw":
            return f"\\begin{{{text}}}{aux}\\end{{{text}}}"
        case "verb":
            return f"\\verb|{text}|"
        case "label":
            return f"\\label{{{text}}}"
        case "ref" | "cite":
            return f"\\{aux}{{{text}}}"
        case "section":
            return f"\\{tables.HEADING_NAMES[aux]}{{{text}}}"
    return PLAIN[kind]
