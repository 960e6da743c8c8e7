"""The engine on Spark: facets, files, sinks, streams, the command line."""

import io
import json
import sys

import pytest
from pyspark.sql import functions as F

from quire import api, cli
from quire.operators import convert as K
from quire.plans import passes
from quire.sources import files as S
from quire.sources import sinks


@pytest.fixture(scope="module")
def docs(spark):
    rows = [("a", "\\section{A}\\label{s}\nText \\ref{s} \\ref{t}\n\n\\begin{tabular}{lr}a & b\\\\ 1 & 22\\\\ x\\end{tabular}"), ("b", None), ("c", ""), ("d", "\\begin{x"), ("e", "\\weird \\weird")]
    return spark.createDataFrame(rows, "doc_id string, content string")


def test_a_bad_document_leaves_the_others(docs):
    found = {r["doc_id"]: r for r in K.convert(docs).collect()}
    assert found["a"]["markdown"].startswith("## A {#s}\n\nText 1 [t](#t)\n\n| a   |   b |")
    assert found["b"]["markdown"] == found["c"]["markdown"] == ""
    assert found["d"]["markdown"] is None and found["d"]["error"].startswith("Unbalanced")
    assert len(found["e"]["warnings"]) == 2


def test_names_that_clash_are_replaced(docs):
    found = K.convert(docs.withColumn("markdown", F.lit(1)).withColumn("error", F.lit(2)).withColumn("extra", F.lit(3)))
    assert found.columns == ["doc_id", "content", "extra", "markdown", "error", "warnings", "metadata", "bibliography", "stats"]
    assert found.where("extra = 3").count() == 5


def test_empty_table(spark, docs):
    none = docs.limit(0)
    assert K.convert(none).count() == 0
    assert K.exploded(none, K.blocks("content"), "doc_id").count() == 0
    assert passes.run_totals(K.convert(none)).first().asDict() == {"files": 0, "failures": 0, "warnings": 0, "exit_plain": 0, "exit_strict": 0, "exit_check": 0}


def test_facets(docs):
    blocks = K.exploded(docs, K.blocks("content"), "doc_id").where("doc_id = 'a'").orderBy("block_id").collect()
    assert [b["kind"] for b in blocks][:3] == ["section", "paragraph", "table"] and blocks[0]["label"] == "s" and blocks[0]["number"] == "1"
    cells = K.exploded(docs, K.cells("content"), "doc_id").orderBy("row", "col").collect()
    assert [(c["row"], c["col"], c["text"]) for c in cells] == [(0, 0, "a"), (0, 1, "b"), (1, 0, "1"), (1, 1, "22"), (2, 0, "x")]
    inlines = K.exploded(docs, K.inlines("content"), "doc_id").where("kind = 'ref'").collect()
    assert [i["text"] for i in inlines] == ["t"]
    lines = passes.table_lines(K.exploded(docs, K.cells("content"), "doc_id"), ["doc_id"]).orderBy("row").collect()
    assert [r["line"] for r in lines] == ["| a   |   b |\n|:----|----:|", "| 1   |  22 |", "| x   |     |"]


def test_conversion_does_not_shuffle(docs):
    plan = K.convert(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "ArrowEvalPython" in plan


def test_only_the_source_goes_to_python(spark, sf_dir):
    frame = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", K.to_markdown("text").alias("m"))
    plan = frame._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in plan


def test_references_by_the_definition_in_force(spark):
    refs = spark.createDataFrame([("d", 1, "ref", "x"), ("d", 3, "ref", "x"), ("d", 5, "cref", "x"), ("d", 6, "ref", "gone")], "doc_id string, pos int, command string, label string")
    labels = spark.createDataFrame([("d", 2, "x", "Figure", "1", None), ("d", 4, "x", "Table", "7", None)], "doc_id string, pos int, label string, kind string, number string, title string")
    found = passes.resolve_references(refs, labels).orderBy("pos").collect()
    assert [r["shown"] for r in found] == ["7", "1", "table 7", None]


def test_normal_paths(spark):
    rows = ["a/./b/../c.tex", "../x", "/a/../b", "./", "a//b"]
    got = spark.createDataFrame([(r,) for r in rows], "p string").select(S.normal(F.col("p"))).collect()
    assert [r[0] for r in got] == ["a/c.tex", "../x", "/b", ".", "a/b"]


def test_files_reach_documents(spark):
    docs = spark.createDataFrame([("m", "\\input{a}\n\n\\cite{k}\n\n\\bibliography{r}", "d"), ("n", "none", None)], "doc_id string, content string, base_dir string")
    files = spark.createDataFrame([("d/a.tex", "A \\input{b}\n\n\\input{b}"), ("d/b.tex", "B"), ("d/r.bib", "@book{k, title={T}, author={A B}, year=1}"), ("z.tex", "unused")], "path string, content string")
    both = S.with_files(docs, files)
    assert {r["doc_id"]: sorted(json.loads(r["files_json"] or "{}")) for r in both.collect()} == {"m": ["d/a.tex", "d/b.tex", "d/r.bib"], "n": []}
    found = {r["doc_id"]: r["markdown"] for r in K.convert(both).collect()}
    assert found["m"].startswith("A \\input") and "[1] A B. *T*.  (1)" in found["m"]


def test_plans_of_outputs(spark):
    docs = spark.createDataFrame([("in/a.tex",), ("in/b.c.tex",)], "path string")

    def targets(out, many=True):
        return [r["target"] for r in sinks.plan_outputs(docs, out, many=many).collect()]

    assert targets("o/") == ["o/a.md", "o/b.md"]
    assert targets(None) == ["in/a.md", "in/b.c.md"]
    assert targets("-") == targets(None, many=False) == [None, None]
    assert targets("x.md", many=False) == ["x.md", "x.md"]


def test_existing_files_need_force(spark, tmp_path):
    (tmp_path / "a.md").write_text("old")
    done = spark.createDataFrame([(str(tmp_path / "a.md"), "new")], "target string, markdown string")
    with pytest.raises(Exception, match="already exists"):
        sinks.write_markdown(done)
    sinks.write_markdown(done, force=True)
    assert (tmp_path / "a.md").read_text() == "new"


def test_stream_converts_once(spark, tmp_path):
    from quire.streaming.convert import convert_stream

    source = tmp_path / "in"
    source.mkdir()
    for n in range(2):
        (source / f"{n}.tex").write_text(f"\\section{{S{n}}}")
        convert_stream(spark, str(source), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(60)
    assert sorted(r["markdown"] for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["## S0\n\n", "## S1\n\n"]


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "good.tex").write_text("\\input{part}\n\n\\section{S}")
    (tmp_path / "part.tex").write_text("Included")
    (tmp_path / "odd.tex").write_text("\\weirdcmd \\weirdcmd \\ref{sec:nowhere}")
    return tmp_path


def test_command_line(spark, folder, capsys):
    assert cli.main([str(folder / "good.tex")], spark) == 0
    assert capsys.readouterr().out == "Included\n\n## S\n\n"
    assert cli.main([str(folder / "odd.tex"), "--check"], spark) == 1
    err = capsys.readouterr().err
    assert "unknown command `\\weirdcmd` kept as plain text (×2)" in err and "unresolved reference" in err and "--check: 3 conversion warning(s) found" in err
    assert not (folder / "odd.md").exists()
    assert cli.main([str(folder / "good.tex"), str(folder / "none.tex"), "-o", str(folder / "out")], spark) == 1
    assert "1 of 2 file(s) failed" in capsys.readouterr().err
    assert (folder / "out" / "good.md").read_text() == "Included\n\n## S\n\n"
    assert cli.main([str(folder / "odd.tex"), "--strict", "-o", str(folder / "odd.md")], spark) == 1
    assert (folder / "odd.md").exists()
    assert cli.main(["-", "x"], spark) == 1


def test_standard_input_and_statistics(spark, monkeypatch, capsys):
    monkeypatch.setattr(sys, "stdin", io.StringIO("\\section{A}\n$x$"))
    assert cli.main(["--stats"], spark) == 0
    shown = capsys.readouterr()
    assert shown.out == "## A\n\n$x$\n\n"
    assert "1 headings · 1 paragraphs" in shown.err and "1 math" in shown.err and "15 B" in shown.err


def test_report_lines(docs):
    found = K.convert(docs).withColumn("path", F.col("doc_id"))
    assert [r["line"] for r in api.warning_lines(found).where("path = 'e'").collect()] == ["warning: unknown command `\\weird` kept as plain text (×2)"]


def test_entry_points(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 5
    assert set(e.oracle_sql()) <= set(e.queries())
