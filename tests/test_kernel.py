"""Conversion rules, one document each."""

from datetime import date

import pytest

from quire.kernel import bibtex, scanner, text
from quire.kernel.engine import convert, read
from quire.kernel.reader import Settings


def kinds(src):
    return [t[0] for t in scanner.scan(src)]


@pytest.mark.parametrize(
    ("latex", "expected"),
    [
        ("Hello World", "Hello World\n\n"),
        ("", ""),
        ("  % only a comment", ""),
        ("\\section{Introduction}", "## Introduction\n\n"),
        ("\\section*{A}\\part{B}", "## A\n\n# B\n\n"),
        ("\\section[short]{Long {x} title}", "## Long x title\n\n"),
        ("\\textbf{bold} and \\textit{italic}", "**bold** and *italic*\n\n"),
        ("\\begin{itemize}\\item Top\\begin{itemize}\\item Nested\\end{itemize}\\item Next\\end{itemize}", "- Top\n  - Nested\n- Next\n\n"),
        ("\\begin{enumerate}[a)]\\item[x] A\\item B\\end{enumerate}", "1. A\n2. B\n\n"),
        ("\\begin{description}\\item[T] d\\item e\\end{description}", "**T**\n: d\n\n**Item**\n: e\n\n"),
        ("a $x + y$ b", "a $x + y$ b\n\n"),
        ("$$E = mc^2$$", "$$\nE = mc^2\n$$\n\n"),
        ("\\[a\\]", "$$\na\n$$\n\n"),
        ("\\(a\\)", "$a$\n\n"),
        ("\\begin{align*}a&=b\\\\c&=d\\end{align*}", "$$\n\\begin{aligned}\na&=b\\\\c&=d\n\\end{aligned}\n$$\n\n"),
        ("\\begin{gather}a\\end{gather}", "$$\n\\begin{gathered}\na\n\\end{gathered}\n$$\n\n"),
        ("\\begin{equation}\\label{e}a\\end{equation}By \\eqref{e} we win.", "$$\na\\tag{1}\n$$\n\nBy (1) we win.\n\n"),
        ("See \\ref{s} now.\n\n\\section{S}\\label{s}", "See 1 now.\n\n## S {#s}\n\n"),
        ("\\section{The \\texttt{code} story\\label{sec:x}}", "## The `code` story {#sec:x}\n\n"),
        ("50\\% of R\\&D \\$5 \\#1 a\\_b \\{x\\}", "50% of R&D \\$5 #1 a\\_b {x}\n\n"),
        ("Caf\\'e na\\\"ive fa\\c{c}ade Erd\\H{o}s", "Café naïve façade Erdős\n\n"),
        ("\\v{g} \\~{} \\'{}", "ǧ ~ ´\n\n"),
        ("``double'' `single' a--b c---d", "“double” ‘single’ a–b c—d\n\n"),
        ("\\ldots\\ \\S5 \\copyright", "… §5 ©\n\n"),
        ("\\verb+a|b+ \\verb*{x}", "`a|b` `x`\n\n"),
        ("\\begin{verbatim}\n% no $x$ \\cmd\n\\end{verbatim}", "```\n% no $x$ \\cmd\n```\n\n"),
        ("\\begin{lstlisting}[language=Python]\nx = 1\n\\end{lstlisting}", "```python\nx = 1\n```\n\n"),
        ("\\begin{minted}[a]{rust}\nfn\n\\end{minted}", "```rust\nfn\n```\n\n"),
        ("\\begin{tikzpicture}\\draw x;\\end{tikzpicture}", "```latex\n\\draw x;\n```\n\n"),
        ("\\begin{tabular}{lcr}\\hline a & b & c \\\\ \\hline 1 & 2 & 3\\\\\\end{tabular}", "| a   |  b  |   c |\n|:----|:---:|----:|\n| 1   |  2  |   3 |\n\n"),
        ("\\begin{tabular}{ll}\\multicolumn{2}{c}{s} & z\\end{tabular}", "| s   |     | z   |\n|:----|:----|-----|\n\n"),
        ("\\newcommand{\\pair}[2]{#1 and #2}\n\n\\pair{alpha}{beta}", "alpha and beta\n\n"),
        ("\\def\\pair#1#2{#2#1}\n\n\\pair{a}{b}", "ba\n\n"),
        ("\\newcommand{\\R}{\\mathbb{R}}\n\n$\\R^n$", "$\\mathbb{R}^n$\n\n"),
        ("\\newcommand{\\n}{Alice}\n\n\\providecommand{\\n}{Bob}\n\n\\n", "Alice\n\n"),
        ("\\newenvironment{note}[1]{\\begin{quote}\\textbf{Note (#1):} }{\\end{quote}}\n\n\\begin{note}{key}Body text.\\end{note}", "> **Note (key):** Body text.\n\n"),
        ("\\newtheorem{remark}{Remark}\n\n\\begin{remark}[Key]x\\end{remark}", "> **Remark 1 (Key)**\n>\n> x\n\n"),
        ("\\begin{proof}x\n\ny\\end{proof}", "> **Proof**\n>\n> x\n> \n> y\n\n"),
        ("\\begin{figure}\\includegraphics{plot.png}\\caption{Overview}\\label{f}\\end{figure}See \\autoref{f}.", "![Overview](plot.png) {#f}\n\nSee Figure 1.\n\n"),
        ("Claim\\footnote{See \\textit{elsewhere}.}", "Claim[^1]\n\n\n---\n\n[^1]: See *elsewhere*.\n"),
        ("a\\footnotemark[3]\\footnotetext[3]{T}", "a[^3]\n\n\n---\n\n[^3]: T\n"),
        ("\\title{My Paper}\\author{A \\and B}\\maketitle", "---\ntitle: My Paper\nauthor: A, B\n---\n\n# My Paper\n\n*A, B*\n\n"),
        ("\\begin{thebibliography}{9}\\bibitem{a1} One. Title.\\end{thebibliography}See \\cite{a1}.", "## References\n\n[1] One. Title.\n\nSee [1].\n\n"),
        ("\\begin{mystery}a \\textbf{b}\\end{mystery}", "\\begin{mystery}a \\textbf{b}\\end{mystery}\n"),
        ("\\begin{abstract}x\\end{abstract}", "> **Abstract**\n>\n> x\n\n"),
        ("\\begin{center}a\n\nb\\end{center}", "a\n\nb\n\n"),
        ("{\\bf bold} {\\it\\bf both} {plain}", "**bold** ***both*** plain\n\n"),
        ("a [b] c", "a b c\n\n"),
        ("a \\ref{gone}", "a [gone](#gone)\n\n"),
        ("x~y \\\\[2pt] z", "x\xa0y   \nz\n\n"),
        ("\\href[o]{http://a}{b} \\url{http://c}", "[b](http://a) [http://c](http://c)\n\n"),
        ("\\vspace{1em}text\\hfill more", "text more\n\n"),
        ("a % note\nb", "a b\n\n"),
        ("a % note\n\nb", "a\n\nb\n\n"),
        ("\\unknown{x}", "\\unknownx\n\n"),
        ("\\nolinkurl{a_b}", "`a_b`\n\n"),
        ("\\hrule", "---\n\n"),
        ("\\ref", "[](#)\n\n"),
        ("{unclosed \\textbf{x", "unclosed **x**\n\n"),
    ],
)
def test_markdown(latex, expected):
    assert convert(latex) == expected


def test_gaps_inside_lists_end_items():
    assert convert("\\begin{itemize}\\item a\n\nlost\\item b\\end{itemize}") == "- a\n- b\n\n"


def test_sections_theorems_and_shared_counters():
    src = "\\newtheorem{thm}{Theorem}[section]\n\n\\newtheorem{lem}[thm]{Lemma}\n\n\\section{A}\\begin{thm}x\\end{thm}\\begin{thm}x\\end{thm}\\section{B}\\begin{thm}x\\end{thm}\\begin{lem}y\\end{lem}"
    out = convert(src)
    assert [n for n in ("Theorem 1.1", "Theorem 1.2", "Theorem 2.1", "Lemma 1") if n in out] == ["Theorem 1.1", "Theorem 1.2", "Theorem 2.1", "Lemma 1"]


def test_bibliography_styles_and_missing_keys():
    files = {"refs.bib": "@book{k, author={Donald Knuth}, title={TeX}, year=1984, publisher=AW}\n@article{l, author={Lamport, Leslie}, title={{L}a}, year={1994}, journal={J}}"}
    src = "\\cite{l} \\cite{k,no} \\citet{k}\n\n\\bibliography{refs}"
    found = read(src, Settings(files=files))
    assert found.markdown() == '[1] [2, 3] Donald Knuth[2]\n\n## References\n\n[1] Leslie Lamport. "La". *J* (1994)\n\n[2] Donald Knuth. *TeX*. AW (1984)\n\n'
    assert found.warnings == ["citation key `no` not found in bibliography"]
    named = convert("\\bibliographystyle{plainnat}\n\n" + src.replace(",no", "") + "\n\n\\citep[see][p.~2,]{l}", Settings(files=files))
    assert named.startswith("(Lamport, 1994) (Knuth, 1984) Knuth (1984)\n\n(see Lamport, 1994, p.\xa02)\n\n## References\n\n- Donald Knuth")


def test_includes_once_and_by_their_own_folder():
    files = {"d/a.tex": "A \n\n\\input{sub/b}", "d/sub/b.tex": "B\n\n\\input{c}\n\n\\input{../a}", "d/sub/c.tex": "C"}
    found = read("\\input{a}\n\n\\include{none}", Settings(base="d", files=files))
    assert found.markdown() == "A\n\nB\n\nC\n\n"
    assert found.warnings == ["could not resolve \\input{../a} — content skipped", "could not resolve \\include{none} — content skipped"]


def test_warnings_and_statistics():
    found = read("\\section{A}\n\\weird $x$ \\ref{no} \\cite{k} \\url{u}\n\n\\begin{odd}\\end{odd}\n\\begin{tabular}{l}a\\end{tabular}")
    assert found.warnings == ["unknown command `\\weird` kept as plain text", "unknown environment `odd` preserved as raw LaTeX", "unresolved reference `\\ref{no}`"]
    stats = found.stats()
    assert {k: v for k, v in stats.items() if v} == {"headings": 1, "paragraphs": 1, "tables": 1, "inline_math": 1, "citations": 1, "links": 1}


def test_expansion_ends_for_definitions_that_name_themselves():
    assert "\\x" in convert("\\newcommand{\\x}{a\\x}\n\n\\x")
    assert convert("\\newenvironment{e}{\\begin{e}}{}\n\n\\begin{e}z") == "z\n\n"
    assert len(convert("\\newcommand{\\x}{a\\x}\n\n$\\x$")) < 400


def test_unbalanced_names_and_deep_nesting_are_errors_of_their_own():
    assert read("\\begin{x").error == "Unbalanced braces: expected closing brace"
    assert read("\\end{x").error
    assert read("{" * 300_000).error == "Groups or environments are nested too deep"
    assert convert("{" * 500 + "x") == "x\n\n"


def test_date_and_commands_of_ones_own():
    assert convert("\\today", Settings(today=date(2024, 3, 5))) == "March 05, 2024\n\n"
    assert convert("\\shout{a}", Settings(commands={"shout": lambda x: f"<b>{x}</b>"})) == "<b>a</b>\n\n"


def test_tokens():
    assert kinds("a b\n\n c\n$x$ \\cmd{y}[z]&\\\\") == ["text", "whitespace", "text", "par_break", "whitespace", "text", "newline", "inline_math", "whitespace", "command", "left_brace", "text", "right_brace", "left_bracket", "text", "right_bracket", "ampersand", "line_break"]
    assert scanner.scan("$$a$b$$")[0] == ("display_math", "a$b", None)
    assert scanner.scan("\\cite{a,b}")[0] == ("cite", "a,b", "cite")
    assert scanner.scan("% a\\\nb")[0] == ("comment", " a\\\nb", None)


def test_bibtex_forms():
    entries = bibtex.parse("@string{x = {y}} @ARTICLE(k1, A = \"q {x}\", b = 12) @misc{, c={}} @misc{k2, t = {a {B} -- c~d \\& e},}")
    assert [(e.key, e.kind, e.fields) for e in entries] == [("k1", "article", {"a": "q {x}", "b": "12"}), ("k2", "misc", {"t": "a B – c\xa0d & e"})]


def test_scalars():
    assert [text.human_bytes(n) for n in (12, 1280, 1792, 3 << 20)] == ["12 B", "1.2 KB", "1.8 KB", "3.0 MB"]
    assert [text.yaml(x) for x in ("a", "", "a: b", "#x", 'say "x"', "-x")] == ["a", '""', '"a: b"', '"#x"', '"say \\"x\\""', '"-x"']
    assert text.author_list("Last, First and B C and D") == "First Last, B C, and D"
    assert text.filled("#1 #2", ["#2", "x"]) == "x x"
