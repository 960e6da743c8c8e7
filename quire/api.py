"""A run over files or tables: convert, check, write, report."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.kernel import text
from quire.kernel.engine import STATS
from quire.operators import convert as K
from quire.plans import passes
from quire.sources import files as S
from quire.sources import sinks


@dataclass
class Options:
    out: str | None = None
    force: bool = False
    frontmatter: bool = True
    check: bool = False
    strict: bool = False


@dataclass
class Run:
    """What a run has made: its documents, and its report with the exit status."""

    documents: DataFrame
    files: int
    failures: int
    warnings: int
    status: int
    messages: list[str] = field(default_factory=list)


def convert_paths(spark: SparkSession, paths: Sequence[str], options: Options | None = None, others: Sequence[str] = ()) -> DataFrame:
    """Files as converted documents. `others` are paths of files that may be included or cited from."""
    docs = S.read_texts(spark, *paths).withColumn("doc_id", F.col("path"))
    if others:
        docs = S.with_files(docs, S.read_texts(spark, *others).select("path", "content"))
    return K.convert(docs, frontmatter=(options or Options()).frontmatter, search=S.search_roots())


def run(documents: DataFrame, options: Options | None = None, many: bool = True) -> Run:
    """Writes what is to be written and counts. Documents that fail don't keep others from being written.

    documents: path, markdown, error, warnings (see convert_paths).
    """
    options = options or Options()
    documents = sinks.plan_outputs(documents, options.out, many=many)
    if not options.check:
        sinks.write_markdown(documents, options.force)
    total = passes.run_totals(documents).first()
    files, failures, warnings = total["files"], total["failures"], total["warnings"]
    messages = []
    if failures:
        messages.append(f"{failures} of {files} file(s) failed to convert")
    elif options.strict and warnings:
        messages.append(f"--strict: {warnings} conversion warning(s) treated as errors")
    elif options.check:
        messages.append(f"--check: {warnings} conversion warning(s) found" if warnings else "check passed: all constructs converted faithfully")
    status = int(failures > 0 or (warnings > 0 and (options.check or options.strict)))
    return Run(documents, files, failures, warnings, status, messages)


def warning_lines(documents: DataFrame, key: str = "path") -> DataFrame:
    """key, ord, line: each message once with its count, in order of first appearance."""
    rows = documents.select(key, F.posexplode("warnings").alias("seq", "message"))
    report = passes.warning_report(rows, key)
    times = F.when(F.col("n") > 1, F.concat(F.lit(" (×"), F.col("n"), F.lit(")"))).otherwise("")
    return report.select(key, F.col("first_seq").alias("ord"), F.concat(F.lit("warning: "), F.col("message"), times).alias("line"))


def progress_line(path: str, target: str | None, warnings: int, check: bool = False) -> str:
    to = "checked" if check else target or "stdout"
    note = f" ({warnings} warning{'' if warnings == 1 else 's'})" if warnings else ""
    return f"✓ {path} → {to}{note}"


def statistics_lines(name: str, stats: dict[str, int], size_in: int, size_out: int) -> list[str]:
    """Counts and sizes of a document as lines."""
    n = dict.fromkeys(STATS, 0) | stats
    shown = (("headings", "headings"), ("paragraphs", "paragraphs"), ("lists", "lists"), ("tables", "tables"), ("figures", "figures"), ("equations", "equations"), ("code_blocks", "code"), ("theorems", "theorems"))
    inline = (("inline_math", "math"), ("citations", "citations"), ("links", "links"), ("footnotes", "footnotes"))
    return [
        f"  {name}",
        "  blocks   " + " · ".join(f"{n[k]} {label}" for k, label in shown),
        "  inline   " + " · ".join(f"{n[k]} {label}" for k, label in inline),
        f"  size     {text.human_bytes(size_in)} → {text.human_bytes(size_out)}",
    ]
