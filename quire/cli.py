"""Command line: LaTeX files, or standard input, to Markdown."""

from __future__ import annotations

import argparse
import sys
from pathlib import Path

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from quire import api
from quire.operators import convert as K
from quire.sources import files as S


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="quire", description="Convert LaTeX documents to Markdown.")
    p.add_argument("inputs", nargs="*", help="files, or - for standard input")
    p.add_argument("-o", "--output", help="a file, a folder, or - for standard output")
    p.add_argument("-f", "--force", action="store_true", help="replace files that exist")
    loud = p.add_mutually_exclusive_group()
    loud.add_argument("-v", "--verbose", action="store_true")
    loud.add_argument("-q", "--quiet", action="store_true")
    p.add_argument("--no-frontmatter", action="store_true")
    p.add_argument("--check", action="store_true", help="write nothing; fail if there are warnings")
    p.add_argument("--strict", action="store_true", help="write, and fail if there are warnings")
    p.add_argument("--stats", action="store_true")
    p.add_argument("--debug-tokens", action="store_true")
    p.add_argument("--debug-ast", action="store_true")
    return p


def main(arguments: list[str] | None = None, spark: SparkSession | None = None) -> int:
    args = parser().parse_args(arguments)
    inputs = args.inputs or ["-"]
    if len(inputs) > 1 and "-" in inputs:
        print("'-' (stdin) cannot be combined with other input files", file=sys.stderr)
        return 1
    spark = spark or SparkSession.builder.appName("quire").getOrCreate()
    if inputs == ["-"]:
        docs = S.one_text(spark, sys.stdin.read())
        found = {}
    else:
        # Files on this machine: at most what the command line names, with all that lies beside them or where TEXINPUTS points.
        missing = [p for p in inputs if not Path(p).is_file()]
        rows = [(p, Path(p).read_text(encoding="utf-8"), str(Path(p).parent)) for p in inputs if p not in missing]
        docs = spark.createDataFrame(rows, "path string, content string, base_dir string")
        places = [Path(p).parent for p in inputs] + [Path(r) for r in S.search_roots()[1:]]
        beside = {q for place in places for q in place.rglob("*") if q.suffix in (".tex", ".bib") and q.is_file()}
        found = {str(q): q.read_text(encoding="utf-8", errors="replace") for q in sorted(beside)}
        for p in missing:
            print(f"error: {p}: Failed to read input file: {p}", file=sys.stderr)
    if found:
        files = spark.createDataFrame(list(found.items()), "path string, content string")
        docs = S.with_files(docs.withColumn("doc_id", F.col("path")), files.withColumn("path", S.normal(F.col("path"))))
    if args.debug_tokens:
        for row in K.exploded(docs, K.tokens("content"), "path").orderBy("path", "pos").toLocalIterator():
            print(f"{row['pos']:4}: {row['kind']} {row['text']!r}", file=sys.stderr)
    if args.debug_ast:
        for row in K.exploded(docs, K.blocks("content"), "path").orderBy("path", "block_id").toLocalIterator():
            print("  " * row["depth"] + f"{row['kind']} {row['text']!r}", file=sys.stderr)
    many = len(inputs) > 1
    out = args.output
    if out and out != "-" and Path(out).is_dir():
        out += "/"
    converted = K.convert(docs, frontmatter=not args.no_frontmatter, search=S.search_roots()).persist()
    options = api.Options(out, args.force, not args.no_frontmatter, args.check, args.strict)
    try:
        done = api.run(converted, options, many or bool(out and out.endswith("/")))
    except Exception as e:
        if "FileExistsError" not in str(e):
            raise
        print("error: Output file already exists. Use --force to overwrite.", file=sys.stderr)
        return 1
    for row in done.documents.toLocalIterator():
        if row["error"]:
            print(f"error: {row['path']}: {row['error']}", file=sys.stderr)
            continue
        if row["target"] is None and not args.check:
            sys.stdout.write(row["markdown"])
        if (many or args.check) and not args.quiet:
            print(api.progress_line(row["path"], row["target"], len(row["warnings"]), args.check), file=sys.stderr)
        if row["warnings"] and not (args.quiet or args.check or args.verbose):
            n = len(row["warnings"])
            print(f"warning: {n} conversion note{'' if n == 1 else 's'} — run with --check for details", file=sys.stderr)
        if args.stats:
            print("\n".join(api.statistics_lines(row["path"], row["stats"].asDict(), len(row["content"].encode()), len(row["markdown"].encode()))), file=sys.stderr)
    if (args.check or args.verbose) and not args.quiet:
        for row in api.warning_lines(done.documents).orderBy("path", "ord").toLocalIterator():
            print(row["line"], file=sys.stderr)
    failures = done.failures + (len(inputs) - done.files)
    if failures:
        print(f"{failures} of {len(inputs)} file(s) failed to convert", file=sys.stderr)
        return 1
    if done.messages and (done.status or not args.quiet):
        print("\n".join(done.messages), file=sys.stderr)
    return done.status


if __name__ == "__main__":
    sys.exit(main())
