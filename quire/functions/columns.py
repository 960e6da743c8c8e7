"""The engine's scalar functions as columns that stay in the JVM."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from quire.kernel import tables
from quire.kernel.text import accented

_NBSP = "\xa0"


def _col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _replaced(x: Column, pairs: list[tuple[str, str]]) -> Column:
    return reduce(lambda c, p: F.replace(c, F.lit(p[0]), F.lit(p[1])), pairs, x)


def markdown_escaped(x: Column | str, in_table: bool = False) -> Column:
    return F.regexp_replace(_col(x), r"([*_`$|])" if in_table else r"([*_`$])", r"\\$1")


def yaml_scalar(x: Column | str) -> Column:
    """Quoted if empty, or if it holds what YAML would read as markup."""
    x = _col(x)
    odd = (x == "") | x.contains(": ") | x.endswith(":") | x.contains("#") | x.contains('"') | x.rlike(r"""^['"&*?|\-<>=!%@`\[\]{} ]""") | x.endswith(" ")
    return F.when(odd, F.concat(F.lit('"'), _replaced(x, [("\\", "\\\\"), ('"', '\\"')]), F.lit('"'))).otherwise(x)


def bib_value(x: Column | str) -> Column:
    """White space collapsed; ties, dashes and escapes as characters."""
    flat = F.trim(F.regexp_replace(_col(x), r"\s+", " "))
    return _replaced(flat, [("~", _NBSP), ("---", "—"), ("--", "–"), ("\\&", "&"), ("\\%", "%"), ("\\_", "_"), ("\\$", "$"), ("\\#", "#")])


def surname(name: Column | str) -> Column:
    name = _col(name)
    last = F.element_at(F.split(F.trim(name), r"\s+"), -1)
    return F.when(name.contains(","), F.trim(F.split_part(name, F.lit(","), F.lit(1)))).otherwise(last)


# F.trim itself would take a lambda's second argument, the index, as characters to trim.


def _names(field: Column | str) -> Column:
    return F.transform(F.split(_col(field), " and "), lambda x: F.trim(x))


def short_names(field: Column | str) -> Column:
    """K; K and L; K et al."""
    found = F.transform(_names(field), surname)
    return F.when(F.size(found) > 2, F.concat(found[0], F.lit(" et al."))).otherwise(F.array_join(found, " and "))


def author_list(field: Column | str) -> Column:
    """A; A and B; A, B, and C, with first names first."""

    def turned(name: Column) -> Column:
        comma = F.instr(name, ",")
        return F.when(comma > 0, F.concat_ws(" ", F.trim(F.substring(name, comma + 1, F.length(name))), F.trim(F.substring(name, F.lit(1), comma - 1)))).otherwise(name)

    found = F.transform(_names(field), turned)
    many = F.concat(F.array_join(F.slice(found, F.lit(1), F.size(found) - 1), ", "), F.lit(", and "), F.element_at(found, -1))
    return F.when(F.size(found) > 2, many).otherwise(F.array_join(found, " and "))


def full_citation(kind: Column | str, fields: Column | str) -> Column:
    """An entry as a line of the bibliography."""
    kind, fields = _col(kind), _col(fields)

    def get(name: str) -> Column:
        return F.coalesce(F.element_at(fields, F.lit(name)), F.lit(""))

    who = F.coalesce(author_list(F.element_at(fields, F.lit("author"))), F.lit(""))
    article = F.concat(who, F.lit('. "'), get("title"), F.lit('". *'), get("journal"), F.lit("* ("), get("year"), F.lit(")"))
    book = F.concat(who, F.lit(". *"), get("title"), F.lit("*. "), get("publisher"), F.lit(" ("), get("year"), F.lit(")"))
    other = F.concat(who, F.lit('. "'), get("title"), F.lit('" ('), get("year"), F.lit(")"))
    return F.when(kind == "article", article).when(kind == "book", book).otherwise(other)


def heading_prefix(level: Column | str) -> Column:
    return F.repeat(F.lit("#"), F.least(_col(level) + 1, F.lit(6)))


def human_bytes(n: Column | str) -> Column:
    """B, KB or MB at powers of 1024; halves go to the even digit; null stays null."""
    n = _col(n).cast("long")
    return (
        F.when(n.isNull(), F.lit(None))
        .when(n < 1024, F.format_string("%d B", n))
        .when(n < 1024 * 1024, F.format_string("%.1f KB", F.bround(n / 1024.0, 1)))
        .otherwise(F.format_string("%.1f MB", F.bround(n / (1024.0 * 1024.0), 1)))
    )


def output_name(path: Column | str) -> Column:
    """The file name with .md for its extension, or for what is behind the last dot of its stem."""
    stem = F.regexp_replace(F.regexp_extract(_col(path), r"([^/]*)$", 1), r"(?<=.)\.[^.]*$", "")
    return F.concat(F.regexp_replace(stem, r"(?<=.)\.[^.]*$", ""), F.lit(".md"))


def ligatures(x: Column | str) -> Column:
    return _replaced(_col(x), [("---", "—"), ("--", "–")])


def smart_quotes(x: Column | str) -> Column:
    return _replaced(_col(x), [("``", "“"), ("`", "‘"), ("''", "”"), ("'", "’")])


def _table(found: dict[str, str]) -> Column:
    return F.create_map(*(F.lit(x) for pair in found.items() for x in pair))


def symbol(command: Column | str) -> Column:
    """The character of a command such as ldots or textbar; null for other commands."""
    return F.try_element_at(_table({**tables.TEXT_SYMBOLS, **tables.SYMBOLS}), _col(command))


def accent(mark: Column | str, letter: Column | str) -> Column:
    """A letter under an accent: composed where the accent's table has it, else with a combining mark."""
    composed = _table({m + x: accented(m, x) for m, (_, _, letters) in tables.ACCENTS.items() for x in letters})
    combining = _table({m: c for m, (c, _, _) in tables.ACCENTS.items()})
    mark, letter = _col(mark), _col(letter)
    known = F.try_element_at(composed, F.concat(mark, letter))
    marked = F.concat(letter, F.when(letter.rlike(r"^[\p{L}\p{N}]"), F.try_element_at(combining, mark)).otherwise(F.lit("")))
    return F.coalesce(known, marked)


def metadata_value(x: Column | str) -> Column:
    """A title, author or date on one line, without commas that stand alone."""
    flat = F.trim(F.regexp_replace(_col(x), r"\s+", " "))
    return F.trim(F.ltrim(_replaced(flat, [(" ,", ","), (",,", ",")]), F.lit(",")))


def listing_language(options: Column | str) -> Column:
    found = F.regexp_extract(_col(options), r"(?:^|,)\s*language\s*=([^,]*)", 1)
    return F.nullif(F.lower(F.trim(found)), F.lit(""))


def author_year_option(options: Column | str) -> Column:
    """Whether biblatex's options name an author-year style."""
    return F.exists(F.split(_col(options), ","), lambda o: (F.trim(F.split_part(o, F.lit("="), F.lit(1))) == "style") & F.split_part(o, F.lit("="), F.lit(2)).contains("authoryear"))


def author_year_style(style: Column | str) -> Column:
    """True for author-year, false for numeric styles, null for others."""
    name = F.lower(F.trim(_col(style)))
    return F.when(name.isin(sorted(tables.AUTHOR_YEAR_STYLES)), True).when(name.isin(sorted(tables.NUMERIC_STYLES)), False)


def citation_note(x: Column | str) -> Column:
    found = F.rtrim(F.regexp_replace(F.trim(F.replace(_col(x), F.lit("~"), F.lit(_NBSP))), ",+$", ""))
    return F.nullif(found, F.lit(""))


def citation_keys(x: Column | str) -> Column:
    return F.filter(F.transform(F.split(_col(x), ","), lambda k: F.trim(k)), lambda k: k != "")


def macro_filled(body: Column | str, arguments: list[Column]) -> Column:
    """#1, #2, ... replaced one after the other."""
    return reduce(lambda c, p: F.replace(c, F.lit(f"#{p[0]}"), p[1]), enumerate(arguments, 1), _col(body))


def quoted_lines(x: Column | str, blank: str = ">") -> Column:
    """Each line behind '> '; lines without text as `blank`."""
    return F.array_join(F.transform(F.split(_col(x), "\n"), lambda s: F.when(s == "", F.lit(blank)).otherwise(F.concat(F.lit("> "), s))), "\n")


def padded(cell: Column | str, width: Column | str, align: Column | str) -> Column:
    cell, align = _col(cell), _col(align)
    gap = F.greatest(F.lit(0), _col(width) - F.char_length(cell))
    before = F.when(align == "r", gap).when(align == "c", F.floor(gap / 2)).otherwise(0).cast("int")
    return F.concat(F.repeat(F.lit(" "), before), cell, F.repeat(F.lit(" "), (gap - before).cast("int")))


def bar(width: Column | str, align: Column | str) -> Column:
    width, align = _col(width), _col(align)

    def dashes(n: Column) -> Column:
        return F.repeat(F.lit("-"), n.cast("int"))

    return (
        F.when(align == "l", F.concat(F.lit(":"), dashes(width + 1)))
        .when(align == "r", F.concat(dashes(width + 1), F.lit(":")))
        .when(align == "c", F.concat(F.lit(":"), dashes(width), F.lit(":")))
        .otherwise(dashes(width + 2))
    )


def code_span(x: Column | str, in_table: bool = False) -> Column:
    x = F.replace(_col(x), F.lit("|"), F.lit("\\|")) if in_table else _col(x)
    return F.when(x.contains("`"), F.concat(F.lit("`` "), x, F.lit(" ``"))).otherwise(F.concat(F.lit("`"), x, F.lit("`")))


def long_date(day: Column | str) -> Column:
    return F.date_format(_col(day), "MMMM dd, yyyy")


def graphics_paths(spec: Column | str) -> Column:
    return F.transform(F.regexp_extract_all(_col(spec), F.lit(r"\{([^{}]+)\}"), F.lit(1)), lambda p: F.trim(p))


def shown_reference(command: Column | str, kind: Column | str, number: Column | str, title: Column | str, label: Column | str) -> Column:
    """A reference's text; null where its label is unknown (a null kind)."""
    command, kind, number = _col(command), _col(kind), _col(number)
    of = F.when(command == "cref", F.lower(kind)).otherwise(kind)
    return F.when(
        kind.isNotNull(),
        F.when(command == "nameref", F.coalesce(_col(title), _col(label)))
        .when(command == "eqref", F.concat(F.lit("("), number, F.lit(")")))
        .when(command.isin("autoref", "Cref", "cref", "vref"), F.when(number == "", of).otherwise(F.concat(of, F.lit(" "), number)))
        .otherwise(number),
    )
