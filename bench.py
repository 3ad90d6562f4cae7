"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from lociframe.queries import QUERIES  # noqa: E402
from lociframe.session import build_session  # noqa: E402

HEADLINE = [
    "depth_quality",
    "depth_ratio_bins",
    "window_coverage",
    "merged_regions",
    "region_gene_overlap",
    "points_in_regions",
    "site_pileup",
    "marked_duplicates",
    "catalogue_genotypes",
    "panel_dosages",
    "best_effects",
    "gene_extents",
    "impact_summary",
    "homozygosity_runs",
    "genotype_f",
    "percentile_rank",
    "value_distribution",
    "ancestry_mixture",
    "marginal_ridge",
    "standardised_scores",
    "unpacked_genotypes",
    "locus_genotypes",
    "coat_phenotype",
    "sample_diversity",
    "fragment_hits",
    "ridge_models",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 8))
    spark = build_session(
        "bench",
        f"local[{cpus}]",
        **{"spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false", "spark.driver.memory": "12g", "spark.ui.showConsoleProgress": "false"},
    )
    spark.sparkContext.setLogLevel("ERROR")

    def run(name: str) -> float:
        started = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - started

    for warm in ("depth_quality", "ancestry_mixture"):  # JVM and Python workers
        run(warm)
    timings = {name: round(run(name), 3) for name in HEADLINE}
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(timings.values()), 3),
                "unit": "sec",
                "queries": timings,
                "sf": Path(sf_dir).name.removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
