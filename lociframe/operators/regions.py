"""Deletion regions: low windows, merging, panel depth, gene disruption, verdicts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lociframe.functions.text import format_bp
from lociframe.plans import intervals
from lociframe.plans.picks import first_by, last_by

REGION = ("sample_id", "chrom", "start", "end")


def low_windows(
    windows: DataFrame, sample: Sequence[str] = ("sample_id",), depth: str = "depth", frac: float = 0.15
) -> DataFrame:
    """Windows below `frac` of the unweighted mean depth, with `norm` = depth / mean at 3 decimals."""
    mean = windows.groupBy(*sample).agg(F.avg(depth).alias("_mean"))
    return (
        windows.join(mean, list(sample))
        .where(F.col(depth) < frac * F.col("_mean"))
        .withColumn("norm", F.round(F.col(depth) / F.col("_mean"), 3))
        .drop("_mean")
    )


def ref_depth(
    regions: DataFrame,
    panel: DataFrame,
    keys: Sequence[str] = ("chrom",),
    region_id: Sequence[str] = REGION,
    bin_size: int = 1_000_000,
) -> DataFrame:
    """Mean positive panel ratio over the bins a region touches, in percent; null without any."""
    touched = regions.select(
        *dict.fromkeys([*region_id, *keys]),
        F.explode(intervals.buckets(F.col("start"), F.col("end"), bin_size)).alias("bin_idx"),
    )
    depth = (
        touched.join(panel.where(F.col("ratio") > 0).select(*keys, "bin_idx", "ratio"), [*keys, "bin_idx"])
        .groupBy(*region_id)
        .agg(F.round(F.avg("ratio") * 100).cast("long").alias("ref_depth_pct"))
    )
    return regions.join(depth, list(region_id), "left")


def exon_overlap(exons: Column, start: Column, end: Column) -> Column:
    """exonic when an exon shares more than a border with the region."""
    hit = F.exists(exons, lambda x: (x["s"] < end) & (x["e"] > start))
    return F.when(F.coalesce(hit, F.lit(False)), "exonic").otherwise("intronic")


def overlap_kind(gene_start: Column, gene_end: Column, start: Column, end: Column) -> Column:
    return F.when((gene_start >= start) & (gene_end <= end), "full").otherwise("partial")


def overlap_genes(
    regions: DataFrame, genes: DataFrame, keys: Sequence[str] = ("chrom",), bucket: int = 1_000_000
) -> DataFrame:
    """Region × gene pairs (closed bounds) with `overlap` and `exon_overlap`.

    `genes`: keys, gene_ord, gene, biotype, gene_start, gene_end, exons.
    """
    pairs = intervals.overlap_join(regions, genes, keys, ("start", "end"), ("gene_start", "gene_end"), bucket)
    return pairs.withColumn(
        "overlap", overlap_kind(F.col("gene_start"), F.col("gene_end"), F.col("start"), F.col("end"))
    ).withColumn("exon_overlap", exon_overlap(F.col("exons"), F.col("start"), F.col("end")))


def overlap_genes_by_points(
    regions: DataFrame,
    genes: DataFrame,
    exonic_points: DataFrame,
    region_id: Sequence[str] = REGION,
    bucket: int = 1_000_000,
) -> DataFrame:
    """Like overlap_genes, but a gene is exonic when one of its exonic positions lies in the region.

    `exonic_points`: sample_id, gene_id, pos. `genes` needs sample_id and gene_id.
    """
    keys = ["sample_id", "chrom"]
    pairs = intervals.overlap_join(regions, genes, keys, ("start", "end"), ("gene_start", "gene_end"), bucket)
    ids = [*region_id, "gene_id"]
    hits = intervals.points_in_intervals(
        pairs.select(*ids), exonic_points, ["sample_id", "gene_id"], ("start", "end"), "pos", ids, bucket
    )
    return (
        pairs.join(hits, ids, "left")
        .withColumn("overlap", overlap_kind(F.col("gene_start"), F.col("gene_end"), F.col("start"), F.col("end")))
        .withColumn("exon_overlap", F.when(F.coalesce("n_points", F.lit(0)) > 0, "exonic").otherwise("intronic"))
        .drop("n_points")
    )


GENE_DETAIL = ("gene", "biotype", "chrom", "start", "end", "overlap", "exon_overlap")


def gene_detail() -> Column:
    return F.struct(
        "gene",
        "biotype",
        "chrom",
        F.col("gene_start").alias("start"),
        F.col("gene_end").alias("end"),
        "overlap",
        "exon_overlap",
    )


def attach_genes(regions: DataFrame, pairs: DataFrame, region_id: Sequence[str] = REGION) -> DataFrame:
    """Add disrupted_genes and disrupted_gene_details in gene order (empty arrays where there are none)."""
    detail = gene_detail()
    ordered = F.array_sort(F.collect_list(F.struct(F.col("gene_ord"), detail.alias("d"))))
    listed = pairs.groupBy(*region_id).agg(F.transform(ordered, lambda x: x["d"]).alias("disrupted_gene_details"))
    shape = "array<struct<gene:string,biotype:string,chrom:string,start:bigint,end:bigint,overlap:string,exon_overlap:string>>"
    return (
        regions.join(listed, list(region_id), "left")
        .withColumn(
            "disrupted_gene_details", F.coalesce(F.col("disrupted_gene_details").cast(shape), F.array().cast(shape))
        )
        .withColumn("disrupted_genes", F.transform("disrupted_gene_details", lambda d: d["gene"]))
    )


def keep_region(size: Column, n_genes: Column, min_size: int = 50_000) -> Column:
    return (size >= min_size) | (n_genes > 0)


def region_verdict(ref_depth_pct: Column, cut: int = 80) -> Column:
    return F.when(ref_depth_pct < cut, "mappability_artefact").otherwise("putative_deletion")


def unique_genes(
    pairs: DataFrame, order: Sequence[str], sample: Sequence[str] = ("sample_id",), keep: str = "first"
) -> DataFrame:
    """One detail per sample and gene: the first (first pass) or the last (after re-annotation) in region order."""
    pick = first_by if keep == "first" else last_by
    return pick(pairs, [*sample, "gene"], list(order))


def call_regions(windows: DataFrame, genes: DataFrame, panel: DataFrame) -> DataFrame:
    """Deletion regions of every sample from windows (sample_id, chrom, start, end, depth, width)."""
    low = low_windows(windows)
    merged = intervals.merge_adjacent(low, ["sample_id", "chrom"], "start", "end", F.col("width"), "norm")
    measured = ref_depth(merged, panel)
    regions = attach_genes(measured, overlap_genes(measured, genes))
    size = F.col("end") - F.col("start")
    return (
        regions.where(keep_region(size, F.size("disrupted_genes")))
        .withColumn("size", format_bp(size))
        .withColumn("sample_pct_mean", F.round(F.col("norm") * 100).cast("long"))
        .withColumn("verdict", region_verdict(F.col("ref_depth_pct")))
    )


def region_summary(regions: DataFrame, widths: DataFrame) -> DataFrame:
    """Counters per sample (zeros for samples without a region)."""
    real = F.col("verdict") != "mappability_artefact"
    genes = (
        regions.where(real)
        .select("sample_id", F.explode("disrupted_genes").alias("gene"))
        .distinct()
        .groupBy("sample_id")
        .agg(F.count("gene").alias("unique_genes"))
    )
    counts = regions.groupBy("sample_id").agg(
        F.count_if(real).alias("total_regions"), F.count_if(~real).alias("artefact_regions")
    )
    kb = F.round(F.col("width") / 1000, 1)
    return (
        widths.join(counts, "sample_id", "left")
        .join(genes, "sample_id", "left")
        .na.fill(0, ["total_regions", "artefact_regions", "unique_genes"])
        .withColumn("calling_resolution_kb", kb)
        .withColumn("min_detectable_kb", F.round(kb * 2).cast("long"))
        .drop("width")
    )


def reannotate_regions(regions: DataFrame, genes: DataFrame, exonic_points: DataFrame) -> DataFrame:
    """Replace the genes of the real regions from annotated sites; artefact regions stay as they are."""
    artefact = F.col("verdict") == "mappability_artefact"
    bare = regions.where(~artefact).drop("disrupted_genes", "disrupted_gene_details")
    fresh = attach_genes(bare, overlap_genes_by_points(bare, genes, exonic_points))
    return regions.where(artefact).unionByName(fresh)


def flag_gene(regions: DataFrame, samples: DataFrame, fragment: str) -> DataFrame:
    """Per sample: does a real region disrupt a gene whose name holds `fragment`? Null for samples never called."""
    hit = (F.col("verdict") != "mappability_artefact") & F.exists("disrupted_genes", lambda g: g.contains(fragment))
    found = regions.groupBy("sample_id").agg(F.bool_or(hit).alias("_hit"))
    return (
        samples.join(found, "sample_id", "left")
        .withColumn("gene_deleted", F.when(F.col("regions_called"), F.coalesce("_hit", F.lit(False))))
        .drop("_hit", "regions_called")
    )
