"""Queries on whole documents, environments, files, inline commands, bibliographies, footnotes and the facets of trees."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire import api
from quire.functions import columns as C
from quire.kernel.engine import STATS
from quire.kernel.reader import Settings
from quire.operators import convert as K
from quire.plans import passes
from quire.plans.registry import dealt, query, table, tex
from quire.sources import sinks


def _parts(spark: SparkSession, sf_dir: str, *source, **settings) -> DataFrame:
    """A document for each part, converted."""
    docs = dealt(spark, sf_dir, "part").select("p_partkey", tex(*source).alias("content"))
    return docs.select("p_partkey", K.converted("content", settings=Settings(**settings)).alias("c"))


_NN = "chr(10) || chr(10)"


@query(f"SELECT p_partkey, 'Size ' || p_size || ' of part ' || p_partkey || ' at 50%' || {_NN} || '---' || {_NN} || 'End.' || {_NN} AS markdown FROM part")
def whole_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A preamble, the document's environment, comments and a rule."""
    size, key = F.col("p_size"), F.col("p_partkey")
    start = "\\documentclass[a4paper,12pt]{article}\n\\usepackage[utf8]{inputenc} % encoding\n\\begin{document}\n"
    out = _parts(spark, sf_dir, start, "Size ", size, " % gone ", key, "\nof part ", key, " at 50\\%%\n\n% a line of its own ", size, "\n\\hrule\n\nEnd.\n\\end{document}\n")
    return out.select("p_partkey", "c.markdown")


@query(f"SELECT p_partkey, string_agg(w || ' ' || p_size || {_NN}, '' ORDER BY w) AS markdown FROM part, (SELECT unnest(['a', 'b', 'c', 'd', 'e']) AS w) GROUP BY p_partkey, p_size")
def transparent_environments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Environments that only lay out: their content stays, their arguments go."""
    size = F.col("p_size")
    wraps = {"a": ("center", ""), "b": ("minipage", "[t]{5cm}"), "c": ("flushleft", ""), "d": ("multicols", "{2}"), "e": ("flushright", "")}
    source = [x for word, (env, arguments) in wraps.items() for x in (f"\\begin{{{env}}}{arguments}\n{word} ", size, f"\n\\end{{{env}}}\n")]
    return _parts(spark, sf_dir, *source).select("p_partkey", "c.markdown")


@query(rf"""
SELECT p_partkey, 'See [1] and [2].' || {_NN} || '## References' || {_NN} || '[1] One, Title ' || p_size || '.' || {_NN} || '[2] Two ' || p_partkey || '.' || {_NN} || '[3] Three.' || {_NN} AS markdown FROM part
""")
def bibliography_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A bibliography that is written out; cited entries have their numbers from the text."""
    size, key = F.col("p_size"), F.col("p_partkey")
    out = _parts(spark, sf_dir, "See \\cite{one} and \\cite{two}.\n\n\\begin{thebibliography}{9}\n\\bibitem{one} One, Title ", size, ".\n\\bibitem[lab]{two} Two ", key, ".\n\n\\bibitem{three} Three.\n\\end{thebibliography}")
    return out.select("p_partkey", "c.markdown")


@query(r"""
SELECT p_partkey, '\begin{mystery}' || chr(10) || 'raw ' || p_size || ' \x' || chr(10) || '\end{mystery}' || chr(10) || '```latex' || chr(10) || chr(10) || '\draw (0,' || p_size || ');' || chr(10) || '```' || chr(10) || chr(10) AS markdown,
  'unknown environment `mystery` preserved as raw LaTeX' AS warning FROM part
""")
def unknown_environments_and_drawings(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.col("p_size")
    out = _parts(spark, sf_dir, "\\begin{mystery}\nraw ", size, " \\x\n\\end{mystery}\n\\begin{tikzpicture}\n\\draw (0,", size, ");\n\\end{tikzpicture}")
    return out.select("p_partkey", "c.markdown", F.array_join("c.warnings", ";").alias("warning"))


@query(rf"""
SELECT p_partkey, 'Child ' || p_size || {_NN} || 'Last.' || {_NN} AS markdown, 'could not resolve \input{{gone}} — content skipped;could not resolve \include{{c}} — content skipped' AS warning FROM part
""")
def included_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file is read once: a second time, and one that isn't there, are skipped with a warning."""
    docs = dealt(spark, sf_dir, "part").select("p_partkey", F.lit("\\include{c}\n\\input{gone}\n\\include{c}\nLast.").alias("content"), F.to_json(F.create_map(F.lit("c.tex"), tex("Child ", F.col("p_size")))).alias("files_json"))
    return K.convert(docs).select("p_partkey", "markdown", F.array_join("warnings", ";").alias("warning"))


@query(r"""
SELECT p_partkey, '[http://a/' || p_size || '](http://a/' || p_size || ') a  ' || chr(10) || 'b  ' || chr(10) || 'c  ' || chr(10) || 'd H T R B m k p r h $x^' || p_size || '$ ' || lower(p_brand) || ' March 07, 2024' || chr(10) || chr(10)
  || 'one' || chr(10) || chr(10) || 'two' || chr(10) || chr(10) || '**Stray ' || p_size || '** `u' || p_size || '` v HI ' || p_size || '!' || chr(10) || chr(10) AS markdown FROM part
""")
def boxes_links_and_breaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inline commands of all families, and one that the caller adds."""
    size = F.col("p_size")
    source = (
        "\\url{http://a/", size, "} a\\\\b\\newline c\\linebreak[2]d \\hyperref[l]{H} \\textcolor[rgb]{0,1}{T} \\textcolor{red}{R} \\colorbox{x}{B} \\mbox{m} \\makebox[1cm][c]{k} ",
        "\\parbox[t]{1cm}{p} \\raisebox{1pt}{r} \\hl{h} \\ensuremath{x^", size, "} \\MakeLowercase{", F.col("p_brand"), "} \\today\n\none\\par two\n\n\\caption{Stray ", size, "} \\nolinkurl{u", size, "} \\vbox{v} \\shout{hi ", size, "}",
    )
    out = _parts(spark, sf_dir, *source, today=date(2024, 3, 7), commands={"shout": lambda x: f"{(x or '').upper()}!"})
    return out.select("p_partkey", "c.markdown")


@query(rf"""
SELECT p_partkey, '[1] Jo P' || p_size || ' and Al Six[1] [see, 1, p. ' || p_size || '] Jo P' || p_size || ' and Al Six [1] 1 1 [1] [1]' || {_NN} || '## References' || {_NN}
  || '[1] Jo P' || p_size || ' and Al Six. *T' || p_partkey || '*.  (1907)' || {_NN} AS markdown FROM part
""")
def citations_of_authors_numeric(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All modes in numeric style; of two entries with one key the last counts, and empty keys and names are none."""
    size, key = F.col("p_size"), F.col("p_partkey")
    bib = tex("@book{k, author={A One}, year=1, title={X}}\n@book{k, author={Jo P", size, " and Al Six}, title={T", key, "}, year=1907}\n@misc{, title={none}}\n")
    content = tex("\\bibliography{refs, ,}\n\n\\cite{k} \\citet{k} \\citep[see][p. ", size, "]{k} \\citeauthor{k} \\citeyear{k} \\citealt{k} \\citealp{k} \\citeyearpar{k} \\cite{,k, }")
    docs = dealt(spark, sf_dir, "part").select("p_partkey", content.alias("content"), F.to_json(F.create_map(F.lit("refs.bib"), bib)).alias("files_json"))
    return K.convert(docs).select("p_partkey", "markdown")


@query(rf"""
SELECT p_partkey, '(P' || p_size || ', 1907)' || {_NN} || '## References' || {_NN} || '- A P' || p_size || '. *X*.  (1907)' || {_NN} AS markdown FROM part
""")
def biblatex_author_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A package's option sets the style."""
    bib = tex("@book{k, author={A P", F.col("p_size"), "}, year=1907, title={X}}")
    docs = dealt(spark, sf_dir, "part").select("p_partkey", F.lit("\\usepackage[backend=biber,style=authoryear]{biblatex}\n\\addbibresource{r.bib}\n\n\\cite{k}").alias("content"), F.to_json(F.create_map(F.lit("r.bib"), bib)).alias("files_json"))
    return K.convert(docs).select("p_partkey", "markdown")


@query(rf"""
SELECT p_partkey, '## A' || p_size || ' {{#x}}' || {_NN} || 'See 1.' || {_NN} || '## B {{#x}}' || {_NN} || 'See 2 and [gone' || p_size || '](#gone' || p_size || ') [e](#e) [no](#no).' || {_NN} || '2 B' || {_NN} AS markdown,
  'unresolved reference `\ref{{gone' || p_size || '}}`;unresolved reference `\eqref{{e}}`;unresolved reference `\cref{{no}}`' AS warning FROM part
""")
def labels_redefined_and_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The label in force counts; references behind macros; what stays unresolved is a link and a warning."""
    size = F.col("p_size")
    out = _parts(spark, sf_dir, "\\section{A", size, "}\\label{x}\nSee \\ref{x}.\n\n\\section{B}\\label{x}\nSee \\ref{x} and \\ref{gone", size, "} \\eqref{e} \\cref{no}.\n\n\\newcommand{\\see}[1]{\\ref{#1} \\nameref{#1}}\\see{x}")
    return out.select("p_partkey", "c.markdown", F.array_join("c.warnings", ";").alias("warning"))


@query(rf"""
SELECT p_partkey, 'A[^1] B[^' || 10 + p_size || '] C.[^2]' || {_NN} || chr(10) || '---' || {_NN} || '[^1]: One.' || chr(10) || '[^2]: Next ' || p_partkey || chr(10) || '[^' || 10 + p_size || ']: Note ' || p_size || '.' || chr(10) AS markdown FROM part
""")
def footnote_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Marks and texts apart, with numbers of their own."""
    size, number = F.col("p_size"), F.col("p_size") + 10
    out = _parts(spark, sf_dir, "A\\footnotemark B\\footnotemark[", number, "] C.\\footnotetext[", number, "]{Note ", size, ".}\\footnotetext[1]{One.}\\footnote{Next ", F.col("p_partkey"), "}")
    return out.select("p_partkey", "c.markdown")


@query(rf"""
SELECT p_partkey, '**Cap ' || p_size || '**' || {_NN} || '| a   |' || chr(10) || '|:----|' || chr(10) || '| ' || rpad(CAST(p_partkey AS VARCHAR), 3, ' ') || ' |' || {_NN} || 'See Table 1.' || {_NN} AS markdown
FROM part WHERE length(CAST(p_partkey AS VARCHAR)) <= 3
UNION ALL SELECT p_partkey, '**Cap ' || p_size || '**' || {_NN} || '| a' || repeat(' ', length(CAST(p_partkey AS VARCHAR)) - 1) || ' |' || chr(10) || '|:' || repeat('-', length(CAST(p_partkey AS VARCHAR)) + 1) || '|' || chr(10) || '| ' || p_partkey || ' |' || {_NN} || 'See Table 1.' || {_NN}
FROM part WHERE length(CAST(p_partkey AS VARCHAR)) > 3
""")
def captioned_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _parts(spark, sf_dir, "\\begin{table}[h]\\caption{Cap ", F.col("p_size"), "}\\label{t}\\begin{tabular}{l}a\\\\", F.col("p_partkey"), "\\end{tabular}\\end{table}\nSee \\Cref{t}.")
    return out.select("p_partkey", "c.markdown")


_COUNTS = {"headings": "1", "paragraphs": "3 + p_size % 3", "lists": "p_size % 3", "tables": "p_size % 2", "figures": "2", "equations": "1", "code_blocks": "1", "quotes": "1", "theorems": "1", "inline_math": "1", "citations": "1", "links": "1", "footnotes": "1"}


@query(f"SELECT p_partkey, {', '.join(f'CAST({v} AS BIGINT) AS {k}' for k, v in _COUNTS.items())} FROM part")
def statistics_of_all_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All thirteen counters."""
    size = F.col("p_size")
    lists = F.repeat(F.lit("\\begin{itemize}\\item a\\end{itemize}\n"), (size % 3).cast("int"))
    grid = F.when(size % 2 == 1, "\\begin{tabular}{l}a\\\\b\\end{tabular}\n").otherwise("")
    source = tex(
        "\\section{S}\nP $m$ \\url{u} \\cite{k}\\footnote{N}\n\n", lists, grid, "\\begin{figure}\\includegraphics{p}\\includegraphics{q}\\caption{c}\\end{figure}\n",
        "\\begin{equation}x\\end{equation}\n\\begin{verbatim}\nv\n\\end{verbatim}\n\\begin{quote}q\\end{quote}\n\\begin{theorem}t\\end{theorem}",
    )
    docs = dealt(spark, sf_dir, "part").select("p_partkey", K.stats(source).alias("s"))
    return docs.select("p_partkey", *(F.col(f"s.{n}").cast("long").alias(n) for n in STATS))


@query(r"""
SELECT p_partkey, b.* FROM part, (SELECT * FROM (VALUES (0, NULL, 0, 'section', 1), (1, NULL, 0, 'quote', NULL), (2, 1, 1, 'paragraph', NULL), (3, NULL, 0, 'bullet_list', NULL), (4, 3, 1, 'paragraph', NULL))
  v(block_id, parent_id, depth, kind, level)) b
""")
def blocks_of_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tree of blocks as rows that name their parents."""
    docs = dealt(spark, sf_dir, "part").select("p_partkey", tex("\\section{S}\n\n\\begin{quote}q ", F.col("p_size"), "\\end{quote}\n\\begin{itemize}\\item i\\end{itemize}").alias("content"))
    return K.exploded(docs, K.blocks("content"), "p_partkey").select("p_partkey", "block_id", "parent_id", "depth", "kind", "level")


@query(r"""
SELECT p_partkey, kind, text, n FROM (
  SELECT p_partkey, 'text' AS kind, 'size' || p_size AS text, 1 AS n FROM part UNION ALL SELECT p_partkey, 'strong', '', 1 FROM part UNION ALL SELECT p_partkey, 'math', 'x_' || p_size, 1 FROM part
  UNION ALL SELECT p_partkey, 'cite', 'a,b' || p_size, 1 FROM part)
""")
def inlines_of_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The inlines below blocks, those of wrappers and citations included."""
    size = F.col("p_size")
    docs = dealt(spark, sf_dir, "part").select("p_partkey", tex("\\textbf{size", size, "} $x_", size, "$ \\cite{a,b", size, "}").alias("content"))
    rows = K.exploded(docs, K.inlines("content"), "p_partkey").where("kind IN ('strong', 'math') OR kind = 'cite' OR text LIKE 'size%'")
    return rows.groupBy("p_partkey", "kind", "text").agg(F.count(F.lit(1)).cast("int").alias("n"))


@query(r"""
SELECT p_partkey, 'out/p' || p_partkey || '.md' AS target, 'in/p' || p_partkey || '.v' || p_size || '.md' AS beside, CAST(NULL AS VARCHAR) AS shown,
  'figs' || p_size || ',b/' AS folders, 'k' || p_size || ',x' AS keys FROM part
""")
def outputs_folders_and_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where documents go by the form of the output's name (a folder takes names up to their first ending from behind twice); folders of graphics and keys of citations as columns."""
    docs = table(spark, sf_dir, "part").select("p_partkey", "p_size", tex("in/p", F.col("p_partkey"), ".v", F.col("p_size"), ".tex").alias("path"))
    for name, out in (("_first", "out/"), ("beside", None), ("shown", "-")):
        docs = sinks.plan_outputs(docs, out).withColumnRenamed("target", name)
    folders = F.array_join(C.graphics_paths(tex("{figs", F.col("p_size"), "}{b/}")), ",")
    keys = F.array_join(C.citation_keys(tex(" k", F.col("p_size"), ", ,x ")), ",")
    return docs.select("p_partkey", F.col("_first").alias("target"), "beside", "shown", folders.alias("folders"), keys.alias("keys"))


@query(r"""
SELECT p_partkey, 'warning: unknown command `\odd` kept as plain text' || CASE WHEN p_size % 3 > 0 THEN ' (×' || p_size % 3 + 1 || ')' ELSE '' END AS line, 0 AS ord FROM part
UNION ALL SELECT p_partkey, 'warning: unknown command `\last` kept as plain text', p_size % 3 + 1 FROM part
""")
def warnings_as_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document's messages as a report shows them: once each, with their number, in order of appearance."""
    source = tex("\\odd x ", F.repeat(F.lit("\\odd y "), (F.col("p_size") % 3).cast("int")), "\\last z")
    docs = dealt(spark, sf_dir, "part").select("p_partkey", K.converted(source).alias("c")).select("p_partkey", "c.warnings")
    return api.warning_lines(docs, "p_partkey")


@query(r"""
SELECT c_custkey, CAST(c_nationkey AS INT) AS times, 'k' || c_custkey % 7 AS key, CAST(1 AS INT) AS number FROM customer
""")
def citation_numbers_of_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A key that is cited again and again has one number; `times` tells how often it is."""
    docs = dealt(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", F.repeat(tex("\\cite{k", F.col("c_custkey") % 7, "} "), F.greatest(F.lit(1), F.col("c_nationkey")).cast("int")).alias("content"))
    docs = docs.select(F.struct("c_custkey", "c_nationkey").alias("doc"), "content")
    cites = K.exploded(docs, K.events("content"), "doc").where("event = 'cite'")
    numbers = passes.citation_numbers(cites, "doc")
    return numbers.select("doc.c_custkey", F.col("doc.c_nationkey").cast("int").alias("times"), "key", "number")
