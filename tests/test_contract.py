"""The driver contract, and a few queries next to their SQL. tools/check_queries.py compares all of them."""

import os
import shutil
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
sys.path.insert(0, str(Path(__file__).resolve().parents[1] / "tools"))

from check_queries import TABLES, compare  # noqa: E402

from __spark_entry__ import entry, oracle_sql, queries  # noqa: E402
from lociframe.queries import ORACLES, QUERIES  # noqa: E402

SF = "/root/testdata/sf0.001"
SHOWN = ["depth_quality", "merged_regions", "catalogue_summary", "impact_summary", "homozygosity_runs", "percentile_rank", "standardised_scores", "locus_genotypes", "dysbiosis_index", "variant_lines"]


def test_every_oracle_has_a_query():
    assert set(oracle_sql()) <= set(queries())
    assert set(QUERIES) <= set(queries()) and set(ORACLES) <= set(oracle_sql())
    assert set(QUERIES) - set(ORACLES) == {"ancestry_mixture", "ridge_models", "ridge_predictions", "ridge_top_features"}


def test_optional_part_may_be_missing(scratch):
    """The entry module imports without the optional part, and an import fault inside that part is not hidden."""
    copy = Path(scratch) / "copy"
    root = Path(__file__).resolve().parents[1]
    shutil.copytree(root / "lociframe", copy / "lociframe", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", copy)
    code = "import __spark_entry__ as e; assert 'depth_quality' in e.queries() and 'pipeline' not in e.queries()"
    subprocess.run([sys.executable, "-B", "-c", code], cwd=copy, env={**os.environ, "PYTHONPATH": str(copy)}, check=True)
    (copy / "corpus_pipeline.py").write_text("import no_such_module")
    assert subprocess.run([sys.executable, "-B", "-c", code], cwd=copy, env={**os.environ, "PYTHONPATH": str(copy)}, capture_output=True).returncode


def test_entry(spark):
    assert entry(spark).count() == 3


@pytest.mark.parametrize("name", SHOWN)
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    verdict, _ = compare(spark, con, name, SF)
    assert verdict.startswith("ok"), verdict
