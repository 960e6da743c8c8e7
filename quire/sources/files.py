"""LaTeX sources, and the files that documents include or cite from."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.sources.shared import Cut, spread_join

#: Levels that are read as tables of their own before they become one.
PIECES = 8

_NAMES = r"\\(?:input|include)\{([^}]*)\}"
_BIBLIOGRAPHIES = r"\\(?:bibliography|addbibresource)\{([^}]*)\}"
_GRAPHICS = r"\\graphicspath\{((?:\{[^}]*\})*)\}"


def read_texts(spark: SparkSession, *paths: str) -> DataFrame:
    """path, base_dir, content: one row for each file, read whole."""
    found = spark.read.text(list(paths), wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("content"))
    return found.withColumn("base_dir", parent("path"))


def one_text(spark: SparkSession, content: str, path: str | None = None) -> DataFrame:
    """A text that is at hand, such as standard input, as a document. Without a path it has no base folder."""
    return spark.createDataFrame([(path or "-", content, None if path is None else path.rpartition("/")[0])], "path string, content string, base_dir string")


def parent(path: Column | str) -> Column:
    path = F.col(path) if isinstance(path, str) else path
    return F.regexp_extract(path, r"^(.*)/[^/]*$", 1)


def normal(path: Column) -> Column:
    """A path without '.' and 'x/..' parts."""
    kept = F.filter(F.split(path, "/"), lambda p: (p != "") & (p != "."))
    folded = F.aggregate(
        kept,
        F.array().cast("array<string>"),
        lambda done, p: F.when((p == "..") & (F.size(done) > 0) & (F.element_at(done, -1) != ".."), F.slice(done, F.lit(1), F.size(done) - 1)).otherwise(F.concat(done, F.array(p))),
    )
    joined = F.array_join(folded, "/")
    return F.when(path.startswith("/"), F.concat(F.lit("/"), joined)).when(joined == "", F.lit(".")).otherwise(joined)


def search_roots(value: str | None = None) -> tuple[str, ...]:
    """Where names are looked for besides a text's own folder: here, and the places that TEXINPUTS (or the given value) lists."""
    listed = os.environ.get("TEXINPUTS", "") if value is None else value
    return (".", *dict.fromkeys(p for p in listed.split(":") if p not in ("", ".")))


def _names(content: Column) -> Column:
    """All that a text's includes and bibliographies name, with and without the usual ending."""
    names = F.transform(F.regexp_extract_all(content, F.lit(_NAMES), F.lit(1)), lambda n: F.array(n, F.concat(n, F.lit(".tex"))))
    specs = F.flatten(F.transform(F.regexp_extract_all(content, F.lit(_BIBLIOGRAPHIES), F.lit(1)), lambda s: F.split(s, ",")))
    specs = F.transform(specs, lambda n: F.array(F.trim(n), F.concat(F.trim(n), F.lit(".bib"))))
    return F.array_distinct(F.filter(F.flatten(F.concat(names, specs)), lambda n: ~n.isin("", ".tex", ".bib")))


def _graphics(content: Column) -> Column:
    """The folders of all \\graphicspath commands of a text; names are looked for there too."""
    groups = F.transform(F.regexp_extract_all(content, F.lit(_GRAPHICS), F.lit(1)), lambda g: F.regexp_extract_all(g, F.lit(r"\{([^}]*)\}"), F.lit(1)))
    return F.array_distinct(F.filter(F.transform(F.flatten(groups), lambda p: F.trim(p)), lambda p: p != ""))


def _placed(name: Column, place: Column) -> Column:
    return normal(F.when(name.startswith("/") | (place == ""), name).otherwise(F.concat_ws("/", place, name)))


def include_edges(texts: DataFrame, paths: DataFrame, key: str = "path", roots: tuple[str, ...] = (".",)) -> DataFrame:
    """key, child: which of the paths each text names from its own folder or the roots.

    texts: key, content, base_dir. paths: a written table of `path`. Contents are
    read here and go no further; an equi-join on paths, hot ones spread.
    """
    places = F.array(F.coalesce("base_dir", F.lit("")), *map(F.lit, roots))
    found = F.array_distinct(F.flatten(F.transform(_names(F.col("content")), lambda n: F.transform(places, lambda p: _placed(n, p)))))
    named = Cut(texts.select(key, F.explode(found).alias("child")), "named")
    edges = Cut(spread_join(named.table, paths.select(F.col("path").alias("child")), "child", F.col(key)), "edges")
    named.drop()
    return edges.table


def reachable(docs: DataFrame, files: DataFrame, doc: str = "doc_id", roots: tuple[str, ...] | None = None) -> DataFrame:
    """doc, path, depth: the files that documents reach, once each, at their least depth, however deep.

    Which text names which file is found once for each text. Then a breadth-first
    search goes on, a level a round, until no document reaches anything new; a
    round joins paths only and begins from a written table, so plans don't grow
    with depth. Folders that a document's texts list for graphics are searched for
    all names of that document.

    Defined results: null contents name nothing; a null base folder is the current
    one; of files with one path one is taken; no files or documents give no rows.
    """
    if doc in ("path", "content", "base_dir", "depth", "child", "place", "name"):
        raise ValueError(f"documents need a key of another name than {doc}")
    roots = search_roots() if roots is None else roots
    files = files.select("path", "content").withColumn("base_dir", parent("path"))
    paths = Cut(files.select("path").distinct(), "paths").table
    edges = include_edges(files, paths, "path", roots)
    # a row for each file that names or lists something, bounded by the file itself
    children = edges.groupBy("path").agg(F.collect_list("child").alias("children"))
    told = files.select("path", _names(F.col("content")).alias("names"), _graphics(F.col("content")).alias("places")).join(children, "path", "left")
    told = Cut(told.where((F.size("names") > 0) | (F.size("places") > 0)), "told").table
    own = Cut(docs.select(doc, _names(F.col("content")).alias("names"), _graphics(F.col("content")).alias("places")), "own").table
    # names are looked for in the folders that documents list; texts of files may list more of them
    places = Cut(own.select(doc, F.explode("places").alias("place")).distinct(), "places")
    files_list = not told.where(F.size("places") > 0).isEmpty()
    listing = files_list or not places.table.isEmpty()

    def listed(texts: DataFrame, folders: DataFrame) -> DataFrame:
        wanted = texts.select(doc, F.explode("names").alias("name")).join(folders, doc)
        return wanted.select(doc, _placed(F.col("name"), F.col("place")).alias("path")).join(paths, "path", "left_semi").select(doc, "path")

    step = include_edges(docs.select(doc, "content", "base_dir"), paths, doc, roots).select(doc, F.col("child").alias("path"))
    texts, pieces, total, level = own, [], 0, 0
    while True:
        level += 1
        if pieces:
            texts = spread_join(pieces[-1].table.select(doc, "path"), told, "path", F.col(doc), total)
            step = texts.select(doc, F.explode("children").alias("path"))
            if files_list:
                more = Cut(texts.select(doc, F.explode("places").alias("place")).distinct().join(places.table, [doc, "place"], "left_anti"), "more")
                if not more.table.isEmpty():
                    # what has been read before may name files there too
                    read = own.select(doc, "names").unionByName(spread_join(_all(pieces).select(doc, "path"), told, "path", F.col(doc)).select(doc, "names"))
                    step = step.unionByName(listed(read, more.table))
                    places = Cut(places.table.unionByName(more.table), "places")
        if listing:
            step = step.unionByName(listed(texts, places.table))
        step = step.distinct()
        front = Cut((step.join(_all(pieces).select(doc, "path"), [doc, "path"], "left_anti") if pieces else step).withColumn("depth", F.lit(level)), "front")
        total = front.table.count()
        if not total:
            return _all(pieces, front)
        if len(pieces) >= PIECES:
            old, pieces = pieces, [Cut(_all(pieces), "found")]
            for cut in old:
                cut.drop()
        pieces.append(front)


def _all(pieces: list[Cut], last: Cut | None = None) -> DataFrame:
    out, *others = [p.table for p in pieces] + ([] if last is None else [last.table])
    for table in others:
        out = out.unionByName(table)
    return out


def with_files(docs: DataFrame, files: DataFrame, doc: str = "doc_id", roots: tuple[str, ...] | None = None) -> DataFrame:
    """Documents with `files_json`, the files that each reaches as a JSON object by path (null for none).

    Contents are joined at the end, once for each document that reads them. What a
    document gathers is bounded by its own includes, as it would be when it is
    read. Names that only a macro's expansion spells out are not found.
    """
    found = reachable(docs, files, doc, roots)
    whole = spread_join(found.select(doc, "path"), files.select("path", "content").dropDuplicates(["path"]), "path", F.col(doc))
    gathered = whole.groupBy(doc).agg(F.to_json(F.map_from_entries(F.sort_array(F.collect_list(F.struct("path", "content"))))).alias("files_json"))
    return docs.join(gathered, doc, "left")
