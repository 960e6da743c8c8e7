"""Plans that must not grow."""

from quire.llm import quality_rules
from tests.llm.data import documents


def test_a_filter_on_the_verdict_doesnt_write_the_measures_out_again(spark, sf_dir):
    found = quality_rules.op6_quality_rules(spark, sf_dir)
    for frame in (found.where("kept"), found.where("n_repeat_words > 3 AND NOT base_failed"), quality_rules.filter_stage(spark, documents(spark, sf_dir), sf_dir)):
        assert len(frame._jdf.queryExecution().optimizedPlan().toString()) < 40_000
        assert frame.count() >= 0


def test_words_and_lines_stay_out_of_rows(spark, sf_dir):
    """Arrays that one projection hands to the next are copied into rows, and each access to their elements allocates there."""
    for frame in (quality_rules.op6_quality_rules(spark, sf_dir), quality_rules.filter_stage(spark, documents(spark, sf_dir), sf_dir)):
        nodes = [frame._jdf.queryExecution().optimizedPlan()]
        for node in nodes:
            assert '"array"' not in node.schema().json()
            nodes += [node.children().apply(i) for i in range(node.children().size())]
        assert len(nodes) > 2
