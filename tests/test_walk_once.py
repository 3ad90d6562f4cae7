"""The walk over a CIGAR is made once per read, however many of its fields are read."""

from lociframe.queries.alignments import clipped_starts


def test_clipped_starts_walk_each_read_once(spark):
    plan = clipped_starts(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("aggregate(regexp_extract_all(") == 1, plan
