"""Queries on numbering, references, citations, bibliographies, tables, figures and files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions import columns as C
from quire.operators import convert as K
from quire.plans import passes
from quire.plans.registry import dealt, gathered, query, table, tex
from quire.sources import files as S

_HEADINGS = ("chapter", "section", "subsection", "subsubsection", "paragraph", "subparagraph")


def _events(docs: DataFrame, key: str, kind: str) -> DataFrame:
    return K.exploded(docs, K.events("content"), key).where(F.col("event") == kind)


def _leveled_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document for each customer: a heading for each order, its level taken from the key."""
    orders = table(spark, sf_dir, "orders")
    level = F.col("o_orderkey") % 6
    name = F.element_at(F.array(*map(F.lit, _HEADINGS)), (level + 1).cast("int"))
    return gathered(orders, "o_custkey", "o_orderkey", tex("\\", name, "{O", F.col("o_orderkey"), "}\n"))


_COUNTERS = """
WITH h AS (SELECT o_custkey, o_orderkey, o_orderkey % 6 AS lv FROM orders),
g AS (SELECT *, {opens} FROM h),
c AS (SELECT *, {counts} FROM g),
p AS (SELECT o_custkey, o_orderkey, [c0, c1, c2, c3, c4, c5] AS cs FROM c),
s AS (SELECT *, list_position(list_transform(cs, lambda x: x > 0), true) AS st FROM p),
t AS (SELECT *, cs[st:] AS tl FROM s)
SELECT o_custkey, 'O' || o_orderkey AS title,
  array_to_string(list_transform(CASE WHEN coalesce(list_position(tl, 0), 0) > 0 THEN tl[:list_position(tl, 0) - 1] ELSE tl END, lambda x: CAST(x AS VARCHAR)), '.') AS number
FROM t
""".format(
    opens=", ".join(f"coalesce(sum(CASE WHEN lv < {n} THEN 1 ELSE 0 END) OVER (PARTITION BY o_custkey ORDER BY o_orderkey), 0)::BIGINT AS g{n}" for n in range(6)),
    counts=", ".join(f"coalesce(sum(CASE WHEN lv = {n} THEN 1 ELSE 0 END) OVER (PARTITION BY o_custkey, g{n} ORDER BY o_orderkey), 0)::BIGINT AS c{n}" for n in range(6)),
)


@query(_COUNTERS)
def section_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers of headings as the reader gives them, in one pass over each document."""
    found = _events(_leveled_orders(spark, sf_dir), "o_custkey", "heading")
    return found.select("o_custkey", "title", "number")


@query(_COUNTERS)
def section_numbers_relational(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same by windows over the headings' levels."""
    found = _events(_leveled_orders(spark, sf_dir), "o_custkey", "heading").select("o_custkey", "pos", "level", "title")
    return passes.section_numbers(found, "o_custkey").select("o_custkey", "title", "number")


_FLOATS = """
SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, CAST(l_partkey AS BIGINT) AS l_partkey,
  CASE l_linenumber % 3 WHEN 0 THEN 'Figure' WHEN 1 THEN 'Table' ELSE 'Equation' END AS kind,
  CAST(row_number() OVER (PARTITION BY l_orderkey, l_linenumber % 3 ORDER BY l_linenumber, l_partkey) AS VARCHAR) AS number
FROM lineitem WHERE l_returnflag <> 'N'
"""


def _floats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document for each order: a figure, table or equation for each line; lines that came back have labels."""
    line, part = F.col("l_linenumber"), F.col("l_partkey")
    label = F.when(F.col("l_returnflag") == "N", "").otherwise(tex("\\label{", line, ":", part, "}"))
    figure = tex("\\begin{figure}\\includegraphics{p.png}\\caption{P}", label, "\\end{figure}\n")
    grid = tex("\\begin{table}\\begin{tabular}{l}a\\\\ b\\end{tabular}", label, "\\end{table}\n")
    equation = tex("\\begin{equation}x", label, "\\end{equation}\n")
    part_of = F.when(line % 3 == 0, figure).when(line % 3 == 1, grid).otherwise(equation)
    return gathered(table(spark, sf_dir, "lineitem"), "l_orderkey", ["l_linenumber", "l_partkey"], part_of)


@query(_FLOATS)
def float_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Figures, tables and equations: only labelled ones count."""
    found = _events(_floats(spark, sf_dir), "l_orderkey", "label")
    place = F.split("label", ":")
    return found.select("l_orderkey", place[0].cast("long").alias("l_linenumber"), place[1].cast("long").alias("l_partkey"), "kind", "number")


@query(_FLOATS)
def float_numbers_relational(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _events(_floats(spark, sf_dir), "l_orderkey", "label").drop("number")
    place = F.split("label", ":")
    numbered = passes.running_numbers(found, ["l_orderkey", "kind"])
    return numbered.select("l_orderkey", place[0].cast("long").alias("l_linenumber"), place[1].cast("long").alias("l_partkey"), "kind", "number")


@query("""
WITH o AS (SELECT o_custkey, o_orderkey, sum(CASE WHEN o_orderkey % 4 = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY o_custkey ORDER BY o_orderkey)::BIGINT AS sec FROM orders),
t AS (SELECT *, row_number() OVER (PARTITION BY o_custkey, sec ORDER BY o_orderkey) AS k, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n FROM o)
SELECT o_custkey, o_orderkey, CASE WHEN sec > 0 THEN sec || '.' || k ELSE CAST(k AS VARCHAR) END AS scoped, CAST(2 * n - 1 AS VARCHAR) AS shared, CAST(2 * n AS VARCHAR) AS shared_second FROM t
""")
def theorem_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Theorems numbered within sections, and two environments that share a counter."""
    head = F.when(F.col("o_orderkey") % 4 == 0, "\\section{S}\n").otherwise("")
    part = tex(head, *(f"\\begin{{{e}}}\\label{{{e}}}x\\end{{{e}}}\n" for e in ("thm", "prop", "lem")))
    docs = gathered(table(spark, sf_dir, "orders"), "o_custkey", "o_orderkey", part)
    start = "\\newtheorem{thm}{Theorem}[section]\n\n\\newtheorem{prop}{Proposition}\n\n\\newtheorem{lem}[prop]{Lemma}\n\n"
    docs = docs.select("o_custkey", tex(start, F.col("content")).alias("content"))
    found = _events(docs, "o_custkey", "label").where(F.col("label").isin("thm", "prop", "lem"))
    # The n-th theorem belongs to the n-th order.
    ranked = passes.running_numbers(found.select("o_custkey", "label", "pos", F.col("number").alias("shown")), ["o_custkey", "label"])
    wide = ranked.groupBy("o_custkey", "number").pivot("label", ["thm", "prop", "lem"]).agg(F.first("shown"))
    orders = passes.running_numbers(table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey"), ["o_custkey"], "o_orderkey")
    return orders.join(wide, ["o_custkey", "number"]).select("o_custkey", "o_orderkey", F.col("thm").alias("scoped"), F.col("prop").alias("shared"), F.col("lem").alias("shared_second"))


def _order_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document for each customer: each order is referred to before and behind its section, which only some have."""
    key = F.col("o_orderkey")
    label = F.when(F.col("o_orderstatus") == "F", "").otherwise(tex("\\label{o", key, "}"))
    part = tex("A\\ref{o", key, "}.\n\n\\section{O}", label, "\nB\\ref{o", key, "}.\n\n")
    return gathered(table(spark, sf_dir, "orders"), "o_custkey", "o_orderkey", part)


_REFERENCES = """
WITH o AS (SELECT o_custkey, o_orderkey, o_orderstatus, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n FROM orders)
SELECT o_custkey, 'o' || o_orderkey AS label, CASE WHEN o_orderstatus <> 'F' THEN CAST(n AS VARCHAR) END AS shown FROM o
UNION ALL SELECT o_custkey, 'o' || o_orderkey, CASE WHEN o_orderstatus <> 'F' THEN CAST(n AS VARCHAR) END FROM o
"""


@query(_REFERENCES)
def references_joined(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References beside the labels they name, by the relational pass; those without label stay."""
    found = K.exploded(_order_references(spark, sf_dir), K.events("content"), "o_custkey")
    return passes.references_of_events(found, "o_custkey").select("o_custkey", "label", "shown")


@query(_REFERENCES)
def references_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same as the reader resolves them, at once or in its second pass."""
    found = K.exploded(_order_references(spark, sf_dir), K.events("content"), "o_custkey")
    kept = found.where("(event = 'ref' AND shown IS NOT NULL) OR event = 'late_ref'")
    return kept.select("o_custkey", "label", "shown")


@query("SELECT o_custkey, 'o' || o_orderkey AS label FROM orders WHERE o_orderstatus = 'F' UNION ALL SELECT o_custkey, 'o' || o_orderkey FROM orders WHERE o_orderstatus = 'F'")
def references_unresolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = K.exploded(_order_references(spark, sf_dir), K.events("content"), "o_custkey")
    return passes.references_of_events(found, "o_custkey").where("shown IS NULL").select("o_custkey", "label")


@query("""
SELECT n_nationkey, kind, CASE kind WHEN 'nameref' THEN t WHEN 'eqref' THEN '(' || n || ')' WHEN 'cref' THEN lower(ty) || ' ' || n
  WHEN 'ref' THEN n WHEN 'pageref' THEN n ELSE ty || ' ' || n END AS shown
FROM (SELECT n_nationkey, CASE n_nationkey % 3 WHEN 0 THEN 'Section' WHEN 1 THEN 'Figure' ELSE 'Theorem' END AS ty, '1' AS n,
        CASE n_nationkey % 3 WHEN 0 THEN n_name WHEN 1 THEN n_name ELSE 'l' END AS t FROM nation),
     (SELECT unnest(['ref', 'eqref', 'autoref', 'nameref', 'pageref', 'cref', 'Cref', 'vref']) AS kind)
""")
def reference_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All eight commands against labels of sections, figures and theorems."""
    kinds = ("ref", "eqref", "autoref", "nameref", "pageref", "cref", "Cref", "vref")
    target = (
        F.when(F.col("n_nationkey") % 3 == 0, tex("\\section{", F.col("n_name"), "}\\label{l}\n"))
        .when(F.col("n_nationkey") % 3 == 1, tex("\\begin{figure}\\includegraphics{x}\\caption{", F.col("n_name"), "}\\label{l}\\end{figure}\n"))
        .otherwise("\\begin{theorem}\\label{l}x\\end{theorem}\n")
    )
    docs = table(spark, sf_dir, "nation").select("n_nationkey", tex("".join(f"\\{k}{{l}} " for k in kinds), "\n\n", target).alias("content"))
    return _events(docs, "n_nationkey", "late_ref").select("n_nationkey", "kind", "shown")


@query(r"""
SELECT n_nationkey, string_agg('Supplier ' || s_suppkey || '[^' || rn || '].' || chr(10) || chr(10), '' ORDER BY rn) || chr(10) || '---' || chr(10) || chr(10)
  || string_agg('[^' || rn || ']: Key *' || s_suppkey || '*' || chr(10), '' ORDER BY rn) AS markdown
FROM (SELECT s_nationkey AS n_nationkey, s_suppkey, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS rn FROM supplier) GROUP BY n_nationkey
""")
def footnotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = tex("Supplier ", F.col("s_suppkey"), "\\footnote{Key \\emph{", F.col("s_suppkey"), "}}.\n\n")
    docs = gathered(table(spark, sf_dir, "supplier"), "s_nationkey", "s_suppkey", part)
    return docs.select(F.col("s_nationkey").alias("n_nationkey"), K.to_markdown("content").alias("markdown"))


def _cited_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document for each customer that cites the priority and clerk-like keys of its orders."""
    part = tex("\\cite{k", F.col("o_orderkey") % 7, ", k", F.col("o_orderkey") % 5, "} ")
    return gathered(table(spark, sf_dir, "orders"), "o_custkey", "o_orderkey", part)


_CITED = """
WITH u AS (SELECT o_custkey, o_orderkey, 0 AS i, 'k' || (o_orderkey % 7) AS key FROM orders UNION ALL SELECT o_custkey, o_orderkey, 1, 'k' || (o_orderkey % 5) FROM orders),
f AS (SELECT o_custkey, key, min(o_orderkey * 2 + i) AS first FROM u GROUP BY 1, 2)
SELECT o_custkey, key, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY first) AS BIGINT) AS number FROM f
"""


@query(_CITED)
def citation_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys numbered by first use."""
    cites = _events(_cited_parts(spark, sf_dir), "o_custkey", "cite")
    return passes.citation_numbers(cites, "o_custkey").select("o_custkey", "key", F.col("number").cast("long").alias("number"))


@query(f"""
WITH n AS ({_CITED})
SELECT o.o_custkey, o_orderkey, '[' || a.number || ', ' || b.number || ']' AS shown FROM orders o
JOIN n a ON a.o_custkey = o.o_custkey AND a.key = 'k' || (o_orderkey % 7) JOIN n b ON b.o_custkey = o.o_custkey AND b.key = 'k' || (o_orderkey % 5)
""")
def citations_numeric(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each citation as the reader shows it."""
    cites = _events(_cited_parts(spark, sf_dir), "o_custkey", "cite").select("o_custkey", "pos", "shown")
    ranked = passes.running_numbers(cites, ["o_custkey"])
    orders = passes.running_numbers(table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey"), ["o_custkey"], "o_orderkey")
    return orders.join(ranked.select("o_custkey", "number", "shown"), ["o_custkey", "number"]).select("o_custkey", "o_orderkey", "shown")


def _customer_entry() -> tuple:
    key = F.col("c_custkey")
    who = F.when(key % 3 == 0, tex("Doe", key, ", Jane")).when(key % 3 == 1, tex("Ann Lee", key, " and Poe", key, ", Bob")).otherwise(tex("A Roe", key, " and B Moe and C Zoe"))
    entry = tex("@", F.when(key % 2 == 0, "article").otherwise("book"), "{c", key, ", author = {", who, '}, title = "T ', key, '", journal={J}, publisher = {P \\& {Q}}, year = ', 1900 + key % 100, "}\n")
    return who, entry


_SHORT = "CASE c_custkey % 3 WHEN 0 THEN 'Doe' || c_custkey WHEN 1 THEN 'Lee' || c_custkey || ' and Poe' || c_custkey ELSE 'Roe' || c_custkey || ' et al.' END"
_LONG = "CASE c_custkey % 3 WHEN 0 THEN 'Jane Doe' || c_custkey WHEN 1 THEN 'Ann Lee' || c_custkey || ' and Bob Poe' || c_custkey ELSE 'A Roe' || c_custkey || ', B Moe, and C Zoe' END"
_FULL = f"""{_LONG} || CASE WHEN c_custkey % 2 = 0 THEN '. "T ' || c_custkey || '". *J* (' ELSE '. *T ' || c_custkey || '*. P & Q (' END || (1900 + c_custkey % 100) || ')'"""


@query(f"""
SELECT c_custkey, ('(' || a || ', ' || y || ') ' || a || ' (' || y || ') (see ' || a || ', ' || y || ', p. 3) ' || a || ' ' || y || ' (' || y || ') ' || a || ' ' || y || ' ' || a || ', ' || y || ' (gone)'
  || chr(10) || chr(10) || '## References' || chr(10) || chr(10) || '- ' || f || chr(10) || chr(10)) AS markdown,
  'citation key `gone` not found in bibliography' AS warning
FROM (SELECT c_custkey, {_SHORT} AS a, 1900 + c_custkey % 100 AS y, {_FULL} AS f FROM customer)
""")
def citations_author_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All citation modes in author-year style, each customer as a database of one entry."""
    key = F.col("c_custkey")
    content = tex("\\bibliographystyle{plainnat}\n\n\\bibliography{refs}\n\n", *(x for c in ("cite{", "citet{", "citep[see][p. 3]{", "citealt{", "citeyearpar{", "citeauthor{", "citeyear{", "citealp{") for x in (f"\\{c}c", key, "} ")), "\\cite{gone}")
    docs = dealt(spark, sf_dir, "customer").select("c_custkey", content.alias("content"), F.to_json(F.create_map(F.lit("refs.bib"), _customer_entry()[1])).alias("files_json"))
    out = docs.select("c_custkey", K.converted("content", files=F.col("files_json")).alias("c"))
    return out.select("c_custkey", "c.markdown", F.array_join("c.warnings", ";").alias("warning"))


@query("""
SELECT c_custkey, 'c' || c_custkey AS key, CASE WHEN c_custkey % 2 = 0 THEN 'article' ELSE 'book' END AS entry_type, 'T ' || c_custkey AS title, 'P & Q' AS publisher, CAST(1900 + c_custkey % 100 AS VARCHAR) AS year FROM customer
""")
def bibtex_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = dealt(spark, sf_dir, "customer").select("c_custkey", tex("@comment{x {y}} junk @string{a = {b}}\n", _customer_entry()[1]).alias("content"))
    rows = K.exploded(docs, K.bibtex_entries(F.col("content")), "c_custkey")
    return rows.select("c_custkey", "key", "entry_type", *(F.element_at("fields", F.lit(n)).alias(n) for n in ("title", "publisher", "year")))


@query(f"SELECT c_custkey, {_SHORT} AS short, {_LONG} AS long, {_FULL} AS line FROM customer")
def names_and_citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Author fields and whole entries by column functions."""
    who, entry = _customer_entry()
    docs = dealt(spark, sf_dir, "customer").select("c_custkey", who.alias("who"), entry.alias("content"))
    rows = K.exploded(docs, K.bibtex_entries(F.col("content")), "c_custkey", "who")
    return rows.select("c_custkey", C.short_names("who").alias("short"), C.author_list("who").alias("long"), C.full_citation("entry_type", "fields").alias("line"))


@query("""
SELECT p_partkey, p_brand || chr(160) || 'x & y – z ' || p_size || '%' AS value, 'x' || p_size AS surname, CASE WHEN p_size % 2 = 0 THEN 'p.' || chr(160) || p_size END AS note, p_size % 2 = 0 AS author_year,
  CASE p_size % 3 WHEN 0 THEN true WHEN 1 THEN false END AS style FROM part
""")
def bibliography_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.col("p_size")
    return table(spark, sf_dir, "part").select(
        "p_partkey",
        C.bib_value(tex("  ", F.col("p_brand"), "~x \\&\n  y -- z ", size, "\\%")).alias("value"),
        C.surname(F.when(size % 2 == 0, tex("x", size, ", First")).otherwise(tex("First Mid x", size))).alias("surname"),
        C.citation_note(F.when(size % 2 == 0, tex(" p.~", size, ",, ")).otherwise(" , ")).alias("note"),
        C.author_year_option(F.when(size % 2 == 0, "backend=biber, style = authoryear-comp").otherwise("style=numeric")).alias("author_year"),
        C.author_year_style(F.when(size % 3 == 0, " PlainNat").when(size % 3 == 1, "ieeetr").otherwise("mine")).alias("style"),
    )


def _bibliography(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Nations cite their customers, those with debts twice over; all customers have entries."""
    people = dealt(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_acctbal", _customer_entry()[1].alias("content"))
    entries = K.exploded(people, K.bibtex_entries(F.col("content")), "c_custkey", "c_nationkey").select("c_nationkey", F.col("c_custkey").alias("ord"), "key", "entry_type", "fields")
    cites = people.where("c_acctbal < 0").select("c_nationkey", F.col("c_custkey").alias("pos"), F.array(tex("c", F.col("c_custkey"))).alias("keys"))
    return cites, entries


@query(f"""
SELECT c_nationkey, n AS ord, '[' || n || '] ' || line AS line FROM
(SELECT c_nationkey, CAST(row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS BIGINT) AS n, {_FULL} AS line FROM customer WHERE c_acctbal < 0)
""")
def bibliography_numeric(spark: SparkSession, sf_dir: str) -> DataFrame:
    cites, entries = _bibliography(spark, sf_dir)
    return passes.bibliography(cites, entries, "c_nationkey").select("c_nationkey", F.col("ord").cast("long").alias("ord"), "line")


@query(f"""
SELECT c_nationkey, CAST(row_number() OVER (PARTITION BY c_nationkey ORDER BY CASE c_custkey % 3 WHEN 0 THEN 'Doe' || c_custkey WHEN 1 THEN 'Lee' || c_custkey ELSE 'Roe' || c_custkey END) AS BIGINT) AS ord,
  '- ' || {_FULL} AS line FROM customer
""")
def bibliography_author_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    cites, entries = _bibliography(spark, sf_dir)
    return passes.bibliography(cites, entries, "c_nationkey", author_year=True).select("c_nationkey", F.col("ord").cast("long").alias("ord"), "line")


@query("""
WITH u AS (SELECT DISTINCT o_custkey, 'c' || (o_custkey + o_orderkey % 3) AS key, o_custkey AS k FROM orders)
SELECT u.o_custkey, u.key FROM u WHERE u.key <> 'c' || u.k
""")
def citations_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cited keys without an entry; each document has one entry, its customer's own."""
    orders = table(spark, sf_dir, "orders")
    cites = orders.select("o_custkey", F.array(tex("c", F.col("o_custkey") + F.col("o_orderkey") % 3)).alias("keys"))
    entries = orders.select("o_custkey", tex("c", F.col("o_custkey")).alias("key")).distinct()
    return passes.missing_citations(cites, entries, "o_custkey")


_CELLS = """
WITH l AS (SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_returnflag) AS rn, CAST(l_partkey AS VARCHAR) AS a,
  CASE WHEN l_linenumber % 2 = 0 THEN 'back \\|' ELSE l_returnflag END AS b, CAST(l_linenumber AS VARCHAR) AS c FROM lineitem),
c AS (SELECT * FROM l UNION ALL SELECT DISTINCT l_orderkey, 0, 'part', 'flag', 'n' FROM l),
w AS (SELECT l_orderkey, greatest(3, max(length(a))) AS wa, greatest(3, max(length(b))) AS wb, greatest(3, max(length(c))) AS wc FROM c GROUP BY 1),
r AS (SELECT l_orderkey, rn, '| ' || a || repeat(' ', wa - length(a)) || ' | ' || repeat(' ', (wb - length(b)) // 2) || b || repeat(' ', wb - length(b) - (wb - length(b)) // 2) || ' | ' || repeat(' ', wc - length(c)) || c || ' |' AS line,
  '|:' || repeat('-', wa + 1) || '|:' || repeat('-', wb) || ':|' || repeat('-', wc + 1) || ':|' AS bar FROM c JOIN w USING (l_orderkey))
"""


def _order_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = F.col("l_linenumber")
    flag = F.when(line % 2 == 0, "back \\textbar").otherwise(F.col("l_returnflag"))
    part = tex(" ", F.col("l_partkey"), " & ", flag, " & ", line, " \\\\[2pt]\n & & \\\\ \\hline\n")
    docs = gathered(table(spark, sf_dir, "lineitem"), "l_orderkey", ["l_linenumber", "l_partkey"], part)
    return docs.select("l_orderkey", tex("\\begin{tabular}{|l|c|r|}\\toprule part & flag & n \\\\ \\midrule\n", F.col("content"), "\\bottomrule\\end{tabular}").alias("content"))


@query(_CELLS + "SELECT l_orderkey, string_agg(line || chr(10) || CASE WHEN rn = 0 THEN bar || chr(10) ELSE '' END, '' ORDER BY rn) || chr(10) AS markdown FROM r GROUP BY 1")
def tables_rendered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table for each order, with rules, empty rows and escaped bars."""
    return _order_tables(spark, sf_dir).select("l_orderkey", K.to_markdown("content").alias("markdown"))


@query(_CELLS + "SELECT l_orderkey, CAST(rn AS BIGINT) AS row, line || CASE WHEN rn = 0 THEN chr(10) || bar ELSE '' END AS line FROM r")
def table_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same from the cells of each table."""
    tables = _order_tables(spark, sf_dir).select("l_orderkey", K.cells("content").alias("cells"))
    return passes.lines_of_tables(tables, ["l_orderkey"]).select("l_orderkey", F.col("row").cast("long").alias("row"), "line")


@query("""
SELECT n_nationkey, CAST(1 AS BIGINT) AS rows, CAST(4 AS BIGINT) AS head_cells, CAST(n_nationkey % 3 + 1 AS BIGINT) AS last_cells FROM nation
""")
def table_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A cell over several columns owes empty ones; a cell over several rows doesn't; empty rows go."""
    span = F.col("n_nationkey") % 3 + 1
    content = tex("\\begin{tabularx}{1cm}{*{2}{l}rp{1cm}}\\multicolumn{3}{c}{a} & b \\\\ & & \\\\ \\multicolumn{", span, "}{l}{\\multirow{2}{*}{x}}\\end{tabularx}")
    docs = table(spark, sf_dir, "nation").select("n_nationkey", content.alias("content"))
    cells = K.exploded(docs, K.cells("content"), "n_nationkey")
    return cells.groupBy("n_nationkey").agg(
        F.max("row").cast("long").alias("rows"), F.count_if(F.col("row") == 0).alias("head_cells"), F.count_if(F.col("row") == 1).alias("last_cells")
    )


@query(r"""
SELECT p_partkey, '![Part ' || p_size || '](p' || p_partkey || '.png) {#fig}' || chr(10) || chr(10) || '![](q.png)' || chr(10) || chr(10) || 'See Figure 1.' || chr(10) || chr(10)
  || '> **Claim 1 (of ' || p_size || ')** {#c}' || chr(10) || '>' || chr(10) || '> Body' || chr(10) || '> ' || chr(10) || '> more.' || chr(10) || chr(10) AS markdown FROM part
""")
def figures_and_theorems(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.col("p_size")
    content = tex(
        "\\newtheorem{claim}{Claim}\n\n\\begin{figure}[ht]\\centering\\includegraphics[width=1cm]{p", F.col("p_partkey"), ".png}\\includegraphics{q.png}\\caption{Part ", size,
        "}\\label{fig}\\end{figure}\nSee \\autoref{fig}.\n\n\\begin{claim}[of ", size, "]\\label{c}\nBody\n\nmore.\\end{claim}",
    )
    return dealt(spark, sf_dir, "part").select("p_partkey", K.to_markdown(content).alias("markdown"))


def _include_tree(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Regions include their nations, and those their suppliers' count; some names have no file."""
    nations = table(spark, sf_dir, "nation")
    part = tex("\\input{n/n", F.col("n_nationkey"), "}\n\\input{gone", F.col("n_nationkey"), "}\n")
    docs = gathered(nations, "n_regionkey", "n_nationkey", part).withColumn("base_dir", F.lit("r"))
    of_nation = nations.select(tex("r/n/n", F.col("n_nationkey"), ".tex").alias("path"), tex("N", F.col("n_nationkey"), "\n\n\\input{../s/s", F.col("n_nationkey"), ".tex}\n").alias("content"))
    of_leaf = nations.select(tex("r/s/s", F.col("n_nationkey"), ".tex").alias("path"), tex("S", F.col("n_nationkey"), "\n\n\\input{../n/n", F.col("n_nationkey"), "}\n").alias("content"))
    return docs, of_nation.unionByName(of_leaf)


@query(r"""
SELECT n_regionkey, path, CAST(depth AS BIGINT) AS depth FROM (
  SELECT n_regionkey, 'r/n/n' || n_nationkey || '.tex' AS path, 1 AS depth FROM nation UNION ALL SELECT n_regionkey, 'r/s/s' || n_nationkey || '.tex', 2 FROM nation)
""")
def includes_reached(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The files that each document reaches, once each, cycles and all."""
    docs, files = _include_tree(spark, sf_dir)
    return S.reachable(docs, files, "n_regionkey").select("n_regionkey", "path", F.col("depth").cast("long").alias("depth"))


@query(r"""
SELECT n_regionkey, string_agg('N' || n_nationkey || chr(10) || chr(10) || 'S' || n_nationkey || chr(10) || chr(10), '' ORDER BY n_nationkey) AS markdown, CAST(2 * count(*) AS BIGINT) AS skipped FROM nation GROUP BY 1
""")
def includes_converted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same documents with their files' text in place; missing files and files seen before are skipped with a warning."""
    docs, files = _include_tree(spark, sf_dir)
    found = K.convert(S.with_files(docs, files, "n_regionkey"))
    return found.select("n_regionkey", "markdown", F.size("warnings").cast("long").alias("skipped"))


def _deep_tree(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Nations include a file that all share and begin a chain of 30 files; the last names a file of a listed folder."""
    nations = table(spark, sf_dir, "nation")
    start = tex("\\graphicspath{{g/}}\\graphicspath{{./pics/}{more/}}\n\\input{shared}\n\\include{c", F.col("n_nationkey") % 5, "/f0}\n")
    docs = nations.select("n_nationkey", start.alias("content"), F.lit("top").alias("base_dir"))
    steps = spark.range(0, 5).select(F.col("id").alias("chain"), F.explode(F.sequence(F.lit(0), F.lit(29))).alias("at"))
    step = F.col("at")
    below = F.when(step == 29, F.lit("\\input{leaf}")).otherwise(tex("\\input{f", step + 1, "}"))
    chain = steps.select(tex("top/c", F.col("chain"), "/f", step, ".tex").alias("path"), tex("F", step, "\n\n", below, "\n").alias("content"))
    rows = [("top/shared.tex", "\\newcommand{\\all}{All}\n"), ("more/leaf.tex", "\\all\\ of it")]
    return docs, chain.unionByName(spark.createDataFrame(rows, "path string, content string"))


@query(r"""
SELECT n_nationkey, path, CAST(depth AS BIGINT) AS depth FROM (
  SELECT n_nationkey, 'top/shared.tex' AS path, 1 AS depth FROM nation
  UNION ALL SELECT n_nationkey, 'top/c' || n_nationkey % 5 || '/f' || i || '.tex', i + 1 FROM nation, range(30) r(i)
  UNION ALL SELECT n_nationkey, 'more/leaf.tex', 31 FROM nation)
""")
def includes_reached_deep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files at any depth, and those that only a listed folder leads to."""
    docs, files = _deep_tree(spark, sf_dir)
    return S.reachable(docs, files, "n_nationkey", (".",)).select("n_nationkey", "path", F.col("depth").cast("long").alias("depth"))


@query(r"""
SELECT n_nationkey, string_agg('F' || i || chr(10) || chr(10), '' ORDER BY i) || 'All of it' || chr(10) || chr(10) AS markdown FROM nation, range(30) r(i) GROUP BY 1
""")
def includes_converted_deep(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, files = _deep_tree(spark, sf_dir)
    found = K.convert(S.with_files(docs, files, "n_nationkey", (".",)))
    return found.select("n_nationkey", "markdown")
