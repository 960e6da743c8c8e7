"""The corpus pipeline: rules, classifier, near-duplicates, mix, packing.

Each stage reads what its predecessor wrote. All but the last return the columns
of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quire.llm import cotraining, dedup, mixing, packing, quality_rules
from quire.llm._spark import cut, table

STAGES = [
    ("quality rules", quality_rules.filter_stage),
    ("quality classifier", cotraining.filter_stage),
    ("MinHash near-dedup", dedup.dedup_stage),
    ("mixing sources to target weights", mixing.mix_stage),
    ("best-fit packing", packing.pack_stage),
]

#: The classifier's training, the dedup's links and the tokens aren't SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), name.split()[0].lower())
    return STAGES[-1][1](spark, docs, sf_dir)
