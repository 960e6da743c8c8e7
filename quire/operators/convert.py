"""The kernel as columns and tables.

Each facet of a document (its Markdown, tokens, blocks, cells, events, ...) is
an Arrow function of the source column alone, so a query pays for the facets
that it reads, other columns never leave the JVM, and no facet shuffles:
documents are independent of each other. Facets are exploded in the JVM.

Null sources read as empty. A document that can't be read has an `error`, null
Markdown and no rows in other facets; the others go on.

Memory doesn't grow with a batch: a facet reads about `PIECE` bytes of sources
and hands on what it made of them. Equal documents are read once as long as no
more than `PIECE` bytes of other sources lie between them.
"""

from __future__ import annotations

import contextlib
import json
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from dataclasses import replace
from datetime import date
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.kernel import bibtex, engine, render, scanner
from quire.kernel.nodes import WRAPPERS, Node, parts
from quire.kernel.reader import Settings
from quire.operators import schema


#: Bytes of sources that are read before their facet is handed on; a longer document stands alone.
PIECE = 1 << 20


def _pieces(*columns: pa.Array) -> Iterator[tuple[pa.Array, ...]]:
    """A batch's columns in slices of about PIECE bytes."""
    sizes = sum(pc.fill_null(pc.binary_length(c), 0).to_numpy(zero_copy_only=False).astype(np.int64) for c in columns)
    before = (np.cumsum(sizes) - sizes) // PIECE
    starts = [0, *(np.flatnonzero(np.diff(before)) + 1).tolist(), len(sizes)]
    for a, b in zip(starts, starts[1:]):
        yield tuple(c.slice(a, b - a) for c in columns)


def _lists(found: list[list], kind: pa.ListType) -> pa.Array:
    """Lists of rows, built as flat columns and offsets; a row is a tuple of the struct's fields or a dict."""
    rows = list(chain.from_iterable(found))
    if not rows or isinstance(rows[0], dict):
        return pa.array(found, type=kind)
    offsets = np.cumsum([0, *map(len, found)], dtype=np.int32)
    fields = list(kind.value_type)
    columns = [pa.array(column, f.type) for column, f in zip(zip(*rows, strict=True), fields, strict=True)]
    return pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays(columns, fields=fields))


class _Once:
    """What is made of each source, once for equal ones; forgets what it has seen after PIECE characters."""

    def __init__(self, make: Callable[..., object], kind: pa.DataType) -> None:
        self.make, self.kind, self.seen, self.held = make, kind, {}, 0

    def __call__(self, *columns: pa.Array) -> pa.Array:
        places: dict[tuple, int] = {}
        found, at = [], []
        for row in zip(*(c.to_pylist() for c in columns), strict=True):
            place = places.get(row)
            if place is None:
                place = places[row] = len(found)
                found.append(self._of(row))
            at.append(place)
        out = _lists(found, self.kind) if found and isinstance(found[0], list) else pa.array(found, type=self.kind)
        return out if len(found) == len(at) else out.take(pa.array(at, pa.int32()))

    def _of(self, row: tuple) -> object:
        if row not in self.seen:
            if self.held > PIECE:
                self.seen, self.held = {}, 0
            self.seen[row] = self.make(*row)
            self.held += sum(map(len, filter(None, row)))
        return self.seen[row]


def _columns_of_tokens(sources: Iterable[str | None]) -> pa.Array:
    """Lists of tokens, built as flat columns and offsets: no object for each token's row."""
    offsets, kinds, texts, auxes, levels = [0], [], [], [], []
    for source in sources:
        with contextlib.suppress(scanner.UnbalancedBraces):
            for kind, text, aux in scanner.scan(source or ""):
                kinds.append(kind)
                texts.append(text or scanner.PLAIN.get(kind, ""))
                numbered = isinstance(aux, int)
                auxes.append(None if numbered else aux)
                levels.append(aux if numbered else None)
        offsets.append(len(kinds))
    ends = np.array(offsets, dtype=np.int32)
    places = np.arange(len(kinds), dtype=np.int32) - np.repeat(ends[:-1], np.diff(ends))
    columns = [pa.array(places), pa.array(kinds, pa.string()), pa.array(texts, pa.string()), pa.array(auxes, pa.string()), pa.array(levels, pa.int32())]
    return pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays(columns, fields=list(schema.TOKEN)))


class _Flat:
    """A tree as rows that name their parents."""

    def __init__(self, found: engine.Result) -> None:
        self.blocks: list[dict] = []
        self.inlines: list[dict] = []
        self._blocks(found.blocks, None, 0)

    def _blocks(self, nodes: list[Node], parent: int | None, depth: int) -> None:
        for i, node in enumerate(nodes):
            mine = len(self.blocks)
            self.blocks.append(
                {
                    "block_id": mine, "parent_id": parent, "ord": i, "depth": depth, "kind": node.kind, "level": node["level"], "lang": node["language"],
                    "text": node.text, "label": node["label"], "number": node["number"] or None, "title": node["title"], "markdown": render.block(node),
                }
            )
            for kind, kids in parts(node):
                if kind == "blocks":
                    self._blocks(kids, mine, depth + 1)
                else:
                    self._inlines(kids, mine, None)

    def _inlines(self, nodes: list[Node], block: int, parent: int | None) -> None:
        for i, node in enumerate(nodes):
            mine = len(self.inlines)
            text = ",".join(node["keys"]) if node.kind == "cite" else node.text
            self.inlines.append({"inline_id": mine, "block_id": block, "parent_id": parent, "ord": i, "kind": node.kind, "text": text})
            if node.kind in WRAPPERS or node.kind == "cite":
                self._inlines(node.kids, block, mine)


def _cells(found: engine.Result) -> list[tuple]:
    """The cells of all tables, by the numbers that blocks have in _Flat."""
    out: list[tuple] = []
    count = 0

    def blocks(nodes: list[Node]) -> None:
        nonlocal count
        for node in nodes:
            mine, count = count, count + 1
            if node.kind == "table":
                columns = node["columns"]
                for row, cells in enumerate(node.kids):
                    for col, cell in enumerate(cells):
                        out.append((mine, row, col, not row, columns[col] if col < len(columns) else "", render.cell(cell)))
            for kind, kids in parts(node):
                if kind == "blocks":
                    blocks(kids)

    blocks(found.blocks)
    return out


def _events(found: engine.Result) -> list[dict]:
    return found.events


def _entries(entries: Iterable[bibtex.Entry]) -> list[dict]:
    return [{"ord": i, "key": e.key, "entry_type": e.kind, "fields": list(e.fields.items())} for i, e in enumerate(entries)]


def _converted(found: engine.Result, with_frontmatter: bool) -> dict:
    return {
        "markdown": found.markdown(with_frontmatter), "error": found.error, "warnings": found.warnings, "metadata": list(found.metadata.items()),
        "bibliography": found.bibliography, "stats": found.stats(),
    }


def _reading(make: Callable[[engine.Result], object], kind: pa.DataType, settings: Settings) -> Callable[[Column, Column, Column], Column]:
    """A facet as a function of (source, base folder, files by path as a JSON object or null)."""

    def one(s: str | None, b: str | None, f: str | None) -> object:
        here = settings if b is None and f is None else replace(settings, base=b, files=json.loads(f) if f else settings.files)
        return make(engine.read(s, here))

    @F.arrow_udf(schema.spark_type(kind))
    def facet(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        once = _Once(one, kind)
        for batch in batches:
            for piece in _pieces(*batch):
                yield once(*piece)

    return facet


def _facet(make: Callable[[engine.Result], object], kind: pa.DataType, source: Column | str, base: Column | None, files: Column | None, settings: Settings | None) -> Column:
    null = F.lit(None).cast("string")
    source = F.col(source) if isinstance(source, str) else source
    return _reading(make, kind, settings or Settings())(source, null if base is None else base, null if files is None else files)


def converted(source: Column | str, base: Column | None = None, files: Column | None = None, *, frontmatter: bool = True, settings: Settings | None = None) -> Column:
    """struct(markdown, error, warnings, metadata, bibliography, stats)."""
    return _facet(lambda r: _converted(r, frontmatter), schema.CONVERTED, source, base, files, settings)


def to_markdown(source: Column | str, *, frontmatter: bool = True, settings: Settings | None = None) -> Column:
    """A source column as Markdown; null where it can't be read."""
    return _facet(lambda r: r.markdown(frontmatter), pa.string(), source, None, None, settings)


def stats(source: Column | str, *, settings: Settings | None = None) -> Column:
    """The counts of a document's blocks and inlines, without its Markdown; zeros where it can't be read."""
    return _facet(lambda r: r.stats(), schema.STATISTICS, source, None, None, settings)


def events(source: Column | str, base: Column | None = None, files: Column | None = None, *, settings: Settings | None = None) -> Column:
    """All that was defined, numbered, referred to or cited, in the order of reading."""
    return _facet(_events, pa.list_(schema.EVENT), source, base, files, settings)


def blocks(source: Column | str, base: Column | None = None, files: Column | None = None, *, settings: Settings | None = None) -> Column:
    return _facet(lambda r: _Flat(r).blocks, pa.list_(schema.BLOCK), source, base, files, settings)


def inlines(source: Column | str, *, settings: Settings | None = None) -> Column:
    return _facet(lambda r: _Flat(r).inlines, pa.list_(schema.INLINE), source, None, None, settings)


def cells(source: Column | str, *, settings: Settings | None = None) -> Column:
    return _facet(_cells, pa.list_(schema.CELL), source, None, None, settings)


@F.arrow_udf(schema.spark_type(pa.list_(schema.TOKEN)))
def tokens(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """Tokens with their positions."""
    for batch in batches:
        for (piece,) in _pieces(batch):
            yield _columns_of_tokens(piece.to_pylist())


def _kinds(source: str | None) -> list[tuple[str, int]]:
    try:
        return list(Counter(kind for kind, _, _ in scanner.scan(source or "")).items())
    except scanner.UnbalancedBraces:
        return []


@F.arrow_udf(schema.spark_type(pa.list_(schema.KIND_COUNT)))
def token_kinds(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """The kinds of a document's tokens with their numbers; the tokens themselves stay in Python."""
    once = _Once(_kinds, pa.list_(schema.KIND_COUNT))
    for batch in batches:
        for piece in _pieces(batch):
            yield once(*piece)


@F.arrow_udf(schema.spark_type(pa.list_(schema.ENTRY)))
def bibtex_entries(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """The entries of BibTeX databases, in order."""
    once = _Once(lambda s: _entries(bibtex.parse(s or "")), pa.list_(schema.ENTRY))
    for batch in batches:
        for piece in _pieces(batch):
            yield once(*piece)


#: Parts for each core that few splits are dealt to.
PARTS = 3


def python_parts(spark: SparkSession) -> int:
    """Parts of a shuffle whose rows go on to Python."""
    return max(PARTS * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))


def spread(docs: DataFrame) -> DataFrame:
    """The same documents, dealt to all cores if their table has few splits: what Python does to them costs more than the exchange.

    docs should be a table as it is read; one that was shuffled has parts enough.
    """
    parts = PARTS * docs.sparkSession.sparkContext.defaultParallelism
    return docs.repartition(parts) if docs._jdf.queryExecution().toRdd().getNumPartitions() < parts else docs


def exploded(docs: DataFrame, facet: Column, *keep: str) -> DataFrame:
    """A facet's rows beside the kept columns."""
    return docs.select(*keep, facet.alias("_facet")).select(*keep, F.inline("_facet"))


def convert(docs: DataFrame, content: str = "content", *, frontmatter: bool = True, today: date | None = None, search: tuple[str, ...] = (".",)) -> DataFrame:
    """Documents with markdown, error, warnings and stats. `search` has the places where names of files are looked for.

    `base_dir` and `files_json`, where docs has them (see sources.with_files),
    let documents include and cite files.
    """
    base = F.col("base_dir") if "base_dir" in docs.columns else None
    files = F.col("files_json") if "files_json" in docs.columns else None
    found = converted(content, base, files, frontmatter=frontmatter, settings=Settings(today=today, search=search))
    kept = [c for c in docs.columns if c not in ("files_json", "markdown", "error", "warnings", "metadata", "bibliography", "stats", "_facet")]
    return docs.select(*kept, found.alias("_facet")).select(*kept, "_facet.*")
