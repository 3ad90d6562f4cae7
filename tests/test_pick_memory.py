"""The pick of the last call at a site sorts shares of the calls, not whole splits of a file."""

from lociframe.operators import loci as lc


def test_calls_are_dealt_out_before_they_are_sorted(spark):
    calls = spark.range(1000).selectExpr(
        "id % 3 as sample_id", "'chr5' as chrom", "63694334L as pos", "'A' as ref", "'G' as alt", "0.5D as raf", "'0|1' as gt", "array(0D, 1D) as gp", "id as ord"
    )
    piles = spark.createDataFrame([], "sample_id long, chrom string, pos long, counts map<string, long>, total long")
    out = lc.loci_calls(calls.select("sample_id").distinct(), calls, piles)
    plan = out._jdf.queryExecution().executedPlan().toString().splitlines()
    first = next(i for i, line in enumerate(plan) if "partial_max_by" in line)
    assert any("REPARTITION_BY_COL" in line for line in plan[first : first + 4]), "\n".join(plan)
    assert out.count() == 36
