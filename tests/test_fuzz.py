"""Any text converts, and the parts agree with each other."""

from hypothesis import given, settings
from hypothesis import strategies as st

from quire.kernel import bibtex, render, scanner, text
from quire.kernel.engine import read

PIECES = [
    "a", "B c", " ", "\n", "\n\n", "{", "}", "[", "]", "$", "$$", "%", "&", "~", "\\\\", "\\", "#1", "'", "``", "--", "*_`|", "é", "\x00", " ",
    "\\begin{itemize}", "\\end{itemize}", "\\item", "\\item[x]", "\\begin{tabular}{lr}", "\\end{tabular}", "\\multicolumn{2}{c}{x}", "\\begin{table}", "\\end{table}", "\\caption{c}",
    "\\begin{figure}", "\\end{figure}", "\\includegraphics{p}", "\\section{s}", "\\label{l}", "\\ref{l}", "\\cite{k}", "\\citep[a][b]{k,m}", "\\footnote{f}", "\\textbf{", "\\emph{x}",
    "\\newcommand{\\m}[2][d]{#1#2\\m}", "\\m{x}", "\\m", "\\begin{theorem}", "\\end{theorem}", "\\begin{equation}", "\\end{equation}", "\\begin{verbatim}", "\\end{verbatim}", "\\verb|x|",
    "\\newenvironment{e}{\\begin{e}}{\\end{e}}", "\\begin{e}", "\\end{e}", "\\begin{odd}", "\\end{odd}", "\\bibliographystyle{apa}", "\\title{t}", "\\maketitle", "\\'", "\\c c", "\\input{f}", "\\unknown", "\\begin", "\\end", "\\ref", "\\def\\q#1{#1}", "\\q{z}", "\\footnotetext{t}", "\\begin{thebibliography}{9}", "\\bibitem{k}", "\\end{thebibliography}", "\\\\[2pt]", "\\hline", "\\(", "\\[", "\\]",
]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(PIECES), max_size=40).map("".join))
def test_any_sequence_of_pieces_converts(source):
    found = read(source)
    assert found.error in (None, "Unbalanced braces: expected closing brace")
    if found.error is None:
        assert isinstance(found.markdown(), str) and found.stats()["footnotes"] == len(found.footnotes)
        assert "".join(map(render.block, found.blocks)) in found.markdown()


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=200))
def test_any_text_converts(source):
    assert read(source).error in (None, "Unbalanced braces: expected closing brace")
    bibtex.parse(source)


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=st.sampled_from("ab \n\t.,;:!?é-0"), max_size=120))
def test_plain_text_is_written_back_as_scanned(source):
    shown = "".join(map(scanner.written, scanner.scan(source)))
    assert text.words(shown) == text.words(source.replace("---", "—").replace("--", "–"))


def test_long_documents_take_time_in_proportion():
    import time

    def seconds(n):
        start = time.process_time()
        read("\\newcommand{\\m}{x}\n\n" + "Some \\m{} text {\\bf here} $a_1$ and\\footnote{more}.\n\n\\begin{itemize}\\item a\\end{itemize}\n" * n).markdown()
        return time.process_time() - start

    seconds(50)
    assert seconds(4000) < 40 * max(seconds(400), 0.01)
