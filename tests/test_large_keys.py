"""Queries on tables whose keys are as large as those of many times the test data, next to their SQL."""

import sys
from pathlib import Path

import duckdb
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1] / "tools"))

from check_queries import compare  # noqa: E402

SF = "/root/testdata/sf0.001"
SHIFTS = (0, 1), (1, 60), (1, 4000)  # copies, as factors of the keys' shifts at 0.1: also two lines that differ in the supplier alone


@pytest.fixture(scope="module")
def large(tmp_path_factory):
    folder = tmp_path_factory.mktemp("spark-large")
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    moved = " UNION ALL ".join(
        f"SELECT * REPLACE (l_orderkey + {on * k * 600_000} AS l_orderkey, l_partkey + {on * k * 20_000} AS l_partkey, l_suppkey + {on * k * 1000} AS l_suppkey)"
        f" FROM '{SF}/lineitem.parquet'"
        for on, k in SHIFTS
    )
    twin = f"SELECT * REPLACE (l_suppkey + 100_000 AS l_suppkey, 1 - l_tax AS l_tax) FROM '{SF}/lineitem.parquet' WHERE l_orderkey % 3 = 0"
    con.execute(f"COPY ({moved} UNION ALL {twin}) TO '{folder}/lineitem.parquet' (FORMAT parquet)")
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{folder}/lineitem.parquet'")
    return str(folder), con


@pytest.mark.parametrize("name", ["best_effects", "frequency_attached", "gene_extents", "high_effect_counts", "high_variants_ordered", "impact_summary", "moderate_by_gene"])
def test_annotation_queries_take_large_keys(spark, large, name):
    folder, con = large
    verdict, _ = compare(spark, con, name, folder)
    assert verdict.startswith("ok"), verdict
