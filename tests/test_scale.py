"""What lets queries grow: pieces, documents read once, parts for all cores, known tokens."""

import pyarrow as pa
import pytest

from quire import catalogue
from quire.kernel import nodes, scanner
from quire.kernel.engine import convert
from quire.operators import convert as K
from quire.operators import schema

#: Queries whose documents are the rows of a table with few splits.
DEALT = [
    "plain_documents_converted",
    "token_kind_counts",
    "paragraph_counts",
    "boxes_links_and_breaks",
    "labels_redefined_and_missing",
    "footnote_marks",
    "captioned_tables",
    "transparent_environments",
    "bibliography_items",
    "whole_documents",
    "unknown_environments_and_drawings",
    "citations_of_authors_numeric",
    "macros_and_environments",
    "layout_commands_dropped",
    "statistics_of_all_kinds",
    "citations_author_year",
    "citation_numbers_of_documents",
    "figures_and_theorems",
    "biblatex_author_year",
    "math_macros",
    "inline_styles",
    "quotes_and_dashes_converted",
    "quote_abstract",
    "code_blocks",
    "listings",
    "math_environments",
    "frontmatter_and_title",
    "warnings_by_message",
    "run_totals",
    "included_once",
    "blocks_of_documents",
    "inlines_of_documents",
    "warnings_as_lines",
    "bibtex_entries",
    "names_and_citations",
    "bibliography_numeric",
    "bibliography_author_year",
]


def _plan(spark, sf_dir, name):
    return catalogue.QUERIES[name](spark, sf_dir)._jdf.queryExecution().toString()


@pytest.mark.parametrize("name", DEALT)
def test_documents_are_dealt_to_all_cores(spark, sf_dir, name):
    assert f"RoundRobinPartitioning({K.PARTS * spark.sparkContext.defaultParallelism})" in _plan(spark, sf_dir, name)


def test_a_facet_is_handed_on_in_pieces():
    texts = pa.array(["x" * 300_000, None, "y" * 900_000, "", "z" * 5_000_000, "a", "b"])
    pieces = [p.to_pylist() for (p,) in K._pieces(texts)]
    assert [t for p in pieces for t in p] == texts.to_pylist()
    assert len(pieces) > 2 and all(sum(len(t or "") for t in p[:-1]) <= K.PIECE for p in pieces)
    assert [p.to_pylist() for (p,) in K._pieces(texts.slice(0, 0))] == [[]]


def test_tokens_are_counted_where_they_are_read(spark, sf_dir):
    plan = _plan(spark, sf_dir, "token_kind_counts")
    assert "token_kinds(" in plan and "tokens(" not in plan


def test_equal_documents_are_read_once():
    read = []
    once = K._Once(lambda s: [(len(s), read.append(s) or s, "", None, None)], pa.list_(schema.TOKEN))
    assert [r[0]["kind"] for r in once(pa.array(["a", "b", "a", "a"])).to_pylist()] == ["a", "b", "a", "a"]
    assert once(pa.array(["b", "c"])).to_pylist()[1][0]["pos"] == 1
    assert read == ["a", "b", "c"]


def test_cells_are_not_shuffled(spark, sf_dir):
    assert _plan(spark, sf_dir, "table_lines").split("== Physical Plan ==")[1].count("Exchange") == 1


def test_known_tokens_are_bounded_and_no_different():
    scanner._KNOWN.clear()
    source = "".join(f"w{i} & \\c{'x' * (i % 50)}\n" for i in range(3 * scanner._KNOWN_TOKENS))
    assert scanner.scan(source) == scanner.scan(source)
    assert len(scanner._KNOWN) <= scanner._KNOWN_TOKENS and max(map(len, scanner._KNOWN)) <= scanner._KNOWN_LENGTH
    for i in range(3 * nodes._KNOWN_TEXTS):
        nodes.text_node(f"w{i}")
    assert len(nodes._TEXTS) <= nodes._KNOWN_TEXTS


def test_blanks_around_cells():
    source = "\\begin{tabular}{lr} \\par & \\newline a b \\par\n& {} \\\\[2pt] & & \\\\ c \\end{tabular}"
    assert convert(source) == "|     | a b |     |\n|:----|----:|-----|\n| c   |     |     |\n\n"


@pytest.mark.parametrize("name", ["tables_rendered", "document_statistics", "table_lines"])
def test_gathered_documents_have_a_number_of_parts_that_stays(spark, sf_dir, name):
    assert "REPARTITION_BY_NUM" in _plan(spark, sf_dir, name) and K.python_parts(spark) >= K.PARTS * spark.sparkContext.defaultParallelism


def test_layout_commands_between_words():
    assert convert("\\newcommand{\\hfill}{H}\n\n\\noindent{}a\\vspace*{1em} \\relax\\setlength{a} {b{c}}\\hfill{}b {} \\vspace{open") == "a Hb\n\n"
