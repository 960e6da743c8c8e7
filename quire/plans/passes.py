"""What follows reading, as joins, windows and aggregates over the tables of a corpus.

All of these partition by doc_id (and hot documents are bounded by their own
length), so one shuffle on doc_id serves a chain of them. Definitions of large
documents are never gathered on the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions import columns as C

LEVELS = 6


def section_numbers(headings: DataFrame, doc: str = "doc_id", pos: str = "pos", level: str = "level") -> DataFrame:
    """Adds `number`: the counters from the first that has started to the next zero.

    A level counts headings since the last shallower one, so it is a running
    sum within segments that shallower headings open.
    """
    order = Window.partitionBy(doc).orderBy(pos).rowsBetween(Window.unboundedPreceding, 0)
    out = headings
    for n in range(LEVELS):
        out = out.withColumn(f"_open{n}", F.sum((F.col(level) < n).cast("int")).over(order))
    for n in range(LEVELS):
        segment = Window.partitionBy(doc, f"_open{n}").orderBy(pos).rowsBetween(Window.unboundedPreceding, 0)
        out = out.withColumn(f"_c{n}", F.sum((F.col(level) == n).cast("int")).over(segment))
    counters = F.array(*(F.col(f"_c{n}") for n in range(LEVELS)))
    start = F.array_position(F.transform(counters, lambda c: c > 0), True).cast("int")
    tail = F.slice(counters, start, F.lit(LEVELS))
    stop = F.array_position(tail, F.lit(0).cast("long")).cast("int")
    number = F.array_join(F.when(stop > 0, F.slice(tail, F.lit(1), stop - 1)).otherwise(tail), ".")
    return out.withColumn("number", number).drop(*(f"_open{n}" for n in range(LEVELS)), *(f"_c{n}" for n in range(LEVELS)))


def running_numbers(rows: DataFrame, keys: list[str], pos: str = "pos", counted: Column | None = None) -> DataFrame:
    """Adds `number`: the running count of counted rows (all by default) by key; null for the others."""
    counted = F.lit(True) if counted is None else F.coalesce(counted, F.lit(False))
    order = Window.partitionBy(*keys).orderBy(pos).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("number", F.when(counted, F.sum(counted.cast("int")).over(order).cast("string")))


def last_labels(labels: DataFrame, doc: str = "doc_id") -> DataFrame:
    """One row for each label of a document: the last definition."""
    return labels.groupBy(doc, "label").agg(F.max_by(F.struct("kind", "number", "title"), "pos").alias("_l")).select(doc, "label", "_l.*")


def references_of_events(events: DataFrame, doc: str = "doc_id") -> DataFrame:
    """References of an event stream (doc, pos, event, kind, label, number, title) with `shown`; the stream is read once.

    A reference shows the last definition before it, else the last of all; null if
    there is none. The definition in force is carried along the label's own events,
    so a label used a thousand times costs a sort and not a product.
    """
    own = events.where("event IN ('ref', 'label')")
    key = Window.partitionBy(doc, "label")
    own = own.select(doc, "pos", "label", "kind", F.when(F.col("event") == "label", F.struct("kind", "number", "title")).alias("_d"))
    before = F.last("_d", ignorenulls=True).over(key.orderBy("pos").rowsBetween(Window.unboundedPreceding, 0))
    final = F.max_by("_d", F.when(F.col("_d").isNotNull(), F.col("pos"))).over(key)
    found = own.withColumn("_f", F.coalesce(before, final)).where(F.col("_d").isNull())
    return found.select(doc, "pos", F.col("kind").alias("command"), "label", C.shown_reference("kind", "_f.kind", "_f.number", "_f.title", "label").alias("shown"))


def resolve_references(refs: DataFrame, labels: DataFrame, doc: str = "doc_id") -> DataFrame:
    """The same from two tables. refs: doc, pos, command, label. labels: doc, pos, label, kind, number, title."""
    none = F.lit(None).cast("string")
    one = refs.select(doc, "pos", F.lit("ref").alias("event"), F.col("command").alias("kind"), "label", none.alias("number"), none.alias("title"))
    return references_of_events(one.unionByName(labels.select(doc, "pos", F.lit("label").alias("event"), "kind", "label", "number", "title")), doc)


def unresolved_references(refs: DataFrame, labels: DataFrame, doc: str = "doc_id") -> DataFrame:
    return refs.join(labels.select(doc, "label").distinct(), [doc, "label"], "left_anti")


def citation_numbers(cites: DataFrame, doc: str = "doc_id") -> DataFrame:
    """doc, key, number: keys numbered by first use. cites: doc, pos, keys."""
    uses = cites.select(doc, F.posexplode("keys").alias("_i", "key"), "pos")
    first = uses.groupBy(doc, "key").agg(F.min(F.struct("pos", "_i")).alias("_first"))
    return first.withColumn("number", F.row_number().over(Window.partitionBy(doc).orderBy("_first"))).drop("_first")


def last_entries(entries: DataFrame, doc: str = "doc_id") -> DataFrame:
    """One row for each key: the last entry."""
    return entries.groupBy(doc, "key").agg(F.max_by(F.struct("entry_type", "fields"), "ord").alias("_e")).select(doc, "key", "_e.*")


def missing_citations(cites: DataFrame, entries: DataFrame, doc: str = "doc_id") -> DataFrame:
    """Cited keys without entry, in documents that have entries at all."""
    used = cites.select(doc, F.explode("keys").alias("key")).distinct()
    return used.join(entries.select(doc).distinct(), doc, "left_semi").join(entries.select(doc, "key").distinct(), [doc, "key"], "left_anti")


def bibliography(cites: DataFrame, entries: DataFrame, doc: str = "doc_id", author_year: bool = False) -> DataFrame:
    """Lines of the bibliography with their order `ord`: cited entries by number, or all entries by surname, year and key."""
    last = last_entries(entries, doc)
    line = C.full_citation("entry_type", "fields")
    if author_year:
        author = F.element_at("fields", F.lit("author"))
        name = F.coalesce(C.surname(F.split_part(author, F.lit(" and "), F.lit(1))), F.col("key"))
        order = Window.partitionBy(doc).orderBy(name, F.coalesce(F.element_at("fields", F.lit("year")), F.lit("")), "key")
        return last.select(doc, "key", F.row_number().over(order).alias("ord"), F.concat(F.lit("- "), line).alias("line"))
    numbers = citation_numbers(cites, doc)
    return last.join(numbers, [doc, "key"]).select(doc, "key", F.col("number").alias("ord"), F.concat(F.lit("["), F.col("number"), F.lit("] "), line).alias("line"))


def warning_report(warnings: DataFrame, doc: str = "doc_id") -> DataFrame:
    """Each message once a document, with its count, in order of first appearance. warnings: doc, seq, message."""
    return warnings.groupBy(doc, "message").agg(F.count(F.lit(1)).alias("n"), F.min("seq").alias("first_seq"))


def run_totals(converted: DataFrame) -> DataFrame:
    """One row: files, failures, warnings and the exit status of a plain, a strict and a check run."""
    failures = F.count_if(F.col("error").isNotNull())
    warned = F.coalesce(F.sum(F.size("warnings")), F.lit(0)).cast("long")
    return converted.agg(F.count(F.lit(1)).alias("files"), failures.alias("failures"), warned.alias("warnings")).select(
        "*",
        (F.col("failures") > 0).cast("int").alias("exit_plain"),
        ((F.col("failures") > 0) | (F.col("warnings") > 0)).cast("int").alias("exit_strict"),
        ((F.col("failures") > 0) | (F.col("warnings") > 0)).cast("int").alias("exit_check"),
    )


def statistics(converted: DataFrame, doc: str = "doc_id") -> DataFrame:
    return converted.select(doc, "stats.*")


def table_lines(cells: DataFrame, keys: list[str]) -> DataFrame:
    """Markdown rows of tables from their cells; the head row carries the rule below it.

    cells: keys, row (0 is the head), col, align, text. Widths are maxima by
    column, at least 3; a row without some cell gets an empty one.
    """
    return lines_of_tables(cells.groupBy(*keys).agg(F.collect_list(F.struct("row", "col", "align", "text")).alias("cells")), keys)


def lines_of_tables(tables: DataFrame, keys: list[str]) -> DataFrame:
    """The same from tables: keys, and `cells` as an array of structs. Nothing is shuffled; layout is made of arrays within the row, bounded by the table itself."""
    tables = tables.select(*keys, F.col("cells").alias("_all"))
    numbers = F.array_sort(F.array_distinct(F.transform("_all", lambda x: x["col"])))
    of = lambda n: F.filter("_all", lambda x: x["col"] == n)
    width = lambda n: F.greatest(F.lit(3), F.array_max(F.transform(of(n), lambda x: F.char_length(x["text"]))))
    tables = tables.withColumn("_c", F.transform(numbers, lambda n: F.struct(n.alias("col"), width(n).alias("w"), F.array_max(F.transform(of(n), lambda x: x["align"])).alias("a"))))
    tables = tables.withColumn("row", F.explode(F.array_distinct(F.transform("_all", lambda x: x["row"]))))
    own = F.filter("_all", lambda x: x["row"] == F.col("row"))
    both = tables.withColumn("_t", F.map_from_entries(F.transform(own, lambda x: F.struct(x["col"], x["text"]))))
    line = F.array_join(F.transform("_c", lambda c: C.padded(F.coalesce(F.try_element_at(F.col("_t"), c["col"]), F.lit("")), c["w"], c["a"])), " | ")
    rule = F.array_join(F.transform("_c", lambda c: C.bar(c["w"], c["a"])), "|")
    line = F.concat(F.lit("| "), line, F.lit(" |"))
    return both.select(*keys, "row", F.when(F.col("row") == 0, F.concat(line, F.lit("\n|"), rule, F.lit("|"))).otherwise(line).alias("line"))
