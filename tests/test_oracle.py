import pytest

from quire import catalogue
from tests.oracle import differences


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query_equals_its_sql(spark, sf_dir, name):
    assert name in catalogue.ORACLE
    assert not differences(spark, sf_dir, catalogue.QUERIES[name], catalogue.ORACLE[name])


def test_sizes_of_long_and_unknown_documents(spark, tmp_path):
    rows = [(1, 5, "a"), (2, 1 << 20, "b"), (3, 5 * (1 << 18), "c"), (4, 123_456_789, "d"), (5, None, "e"), (6, 2000, None), (7, None, None)]
    spark.createDataFrame(rows, "doc_id long, n_chars long, source string").write.parquet(f"{tmp_path}/documents.parquet")
    name = "sizes_and_names"
    assert not differences(spark, str(tmp_path), catalogue.QUERIES[name], catalogue.ORACLE[name])
    assert {r["doc_id"]: r["size"] for r in catalogue.QUERIES[name](spark, str(tmp_path)).collect()} == {1: "5 B", 2: "1.0 MB", 3: "1.2 MB", 4: "117.7 MB", 5: None, 6: "2.0 KB", 7: None}
