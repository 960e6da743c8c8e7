"""The pipeline, and the queries that have SQL."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quire.llm import cotraining, queries
from quire.llm._spark import cut
from tests.llm.data import documents, edge, empty, words
from tests.oracle import differences


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_its_sql(spark, sf_dir, name):
    assert not differences(spark, sf_dir, queries.queries()[name], queries.oracle_sql()[name])


def test_queries_have_one_name_for_each_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.queries()) == list(range(1, 11))


def test_stages_take_effect_and_keep_columns(spark, sf_dir):
    docs = documents(spark, sf_dir)
    columns, seen = docs.columns, []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), "test")
        assert docs.columns == columns, name
        seen.append({r["doc_id"] for r in docs.select("doc_id").collect()})
    rules = queries.queries()["op6_quality_rules"](spark, sf_dir).where("kept")
    assert seen[0] == {r["doc_id"] for r in rules.collect()}
    assert all(b <= a for a, b in zip(seen, seen[1:])) and len(seen[2]) < len(seen[1])
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir).collect()
    assert {r["doc_id"] for r in packed} == seen[-1]
    lengths: dict = {}
    for r in packed:
        lengths[r["sequence_id"]] = lengths.get(r["sequence_id"], 0) + r["length"]
    assert max(lengths.values()) <= 1024


def test_classifier_rejects_poor_documents_that_pass_the_rules(spark):
    sf_dir = "/root/testdata/sf0.01"
    (_, rules), (_, classifier) = corpus_pipeline.STAGES[:2]
    docs = documents(spark, sf_dir)
    bad = spark.read.parquet(f"{sf_dir}/labels.parquet").where("quality = 0")
    noisy = docs.join(bad, "doc_id", "left_semi").withColumns({"doc_id": F.col("doc_id") + 10**9, "text": F.translate("text", "#*$%&|<>", "!!!!!!!!")})
    passed = cut(rules(spark, docs.unionByName(noisy.select(docs.columns)), sf_dir), "test")
    planted, others = passed.where(f"doc_id >= {10**9}").count(), passed.where(f"doc_id < {10**9}").count()
    kept = [r["doc_id"] for r in classifier(spark, passed, sf_dir).select("doc_id").collect()]
    assert planted and not any(i >= 10**9 for i in kept)
    assert sum(i < 10**9 for i in kept) > 0.9 * others


@pytest.mark.parametrize("rare", [0, 1])
def test_classifier_goes_through_if_labels_of_a_class_are_rare(spark, tmp_path, rare):
    docs = documents(spark, "/root/testdata/sf0.01")
    ids = sorted(r["doc_id"] for r in docs.select("doc_id").where(~cotraining.held_out(F.col("doc_id"))).collect())
    learned = [i for i in ids if cotraining._fold(i)]
    # of its share of a round nothing is left
    assert round(cotraining.PER_ROUND / len(learned)) == 0
    labels = spark.createDataFrame([(i, rare if i == learned[0] else 1 - rare) for i in ids], "doc_id long, quality int")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    kept = {r["doc_id"] for r in corpus_pipeline.STAGES[1][1](spark, docs, str(tmp_path)).select("doc_id").collect()}
    assert kept == {r["doc_id"] for r in cotraining.op10_quality_classifier(spark, str(tmp_path)).where("kept").collect()}


def test_run_puts_each_stage_behind_the_one_before(spark, sf_dir, monkeypatch):
    def adding(n):
        return lambda s, docs, d: docs.withColumn("n_chars", F.coalesce("n_chars", F.lit(0)) * 2 + n)

    monkeypatch.setattr(corpus_pipeline, "STAGES", [(str(n), adding(n)) for n in (1, 3, 5)])
    first = documents(spark, sf_dir).orderBy("doc_id").first()
    got = corpus_pipeline.run(spark, sf_dir).where(F.col("doc_id") == first["doc_id"]).first()
    assert got["n_chars"] == ((first["n_chars"] * 2 + 1) * 2 + 3) * 2 + 5


def test_mixed_words_are_near_the_input(spark, sf_dir):
    docs = documents(spark, sf_dir)
    mixed = corpus_pipeline.STAGES[3][1](spark, docs, sf_dir)
    before, after = (sum(len(words(r["text"])) for r in d.collect()) for d in (docs, mixed))
    assert 0.8 * before < after < 1.2 * before


def test_odd_tables_go_through(spark, sf_dir):
    rules, classifier, near, mixed, packed = (f for _, f in corpus_pipeline.STAGES)
    for docs in (edge(spark), empty(spark)):
        for stage in (rules, classifier, mixed):
            assert stage(spark, docs, sf_dir).columns == docs.columns
        assert packed(spark, classifier(spark, docs, sf_dir), sf_dir).count() >= 0
    assert near(spark, empty(spark), sf_dir).count() == 0
