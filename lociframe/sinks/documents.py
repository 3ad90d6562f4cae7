"""Result documents, one nested row per sample. Rounding happens here and nowhere before.

A document lists bins, regions, genes or taxa of one sample, which a genome bounds, so the lists are collected per
sample; nothing is collected over samples.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lociframe import fixed_values as fv
from lociframe.functions.text import natural_key
from lociframe.functions import genotypes as gt
from lociframe.operators import annotation as ann
from lociframe.operators import coverage as cov
from lociframe.operators import inbreeding as inb
from lociframe.operators import loci as lc
from lociframe.operators import microbiome as mb
from lociframe.operators.regions import unique_genes


def rounded(**digits: int) -> list[Column]:
    return [F.round(name, n).alias(name) for name, n in digits.items()]


def listed(order: list[Column], item: Column, out: str) -> Column:
    """Ordered list of structs in a group."""
    key = F.struct(*[k.alias(f"k{i}") for i, k in enumerate(order)])

    # The items may hold maps, which have no order, so only the keys are compared.
    def by_key(a, b):
        return F.when(a["key"] < b["key"], -1).when(a["key"] > b["key"], 1).otherwise(0)

    packed = F.array_sort(F.collect_list(F.struct(key.alias("key"), item.alias("item"))), by_key)
    return F.transform(packed, lambda x: x["item"]).alias(out)


def coverage_document(ratios: DataFrame, reference: DataFrame | None = None) -> DataFrame:
    """Ratio track per chromosome with optional reference tracks cut or padded to its length.

    `ratios`: output of normalise_x. `reference`: chrom, reference (array), panel (array).
    """
    keys = ["sample_id", "predicted_sex", "chrx_auto_ratio"]
    tracks = cov.bins_to_array(ratios.withColumn("ratio", F.round("ratio", 4)), [*keys, "chrom"], "bin_idx", "ratio", "ratio")
    if reference is None:
        empty = F.lit(None).cast("array<double>")
        tracks = tracks.withColumns({"reference": empty, "panel": empty})
    else:
        tracks = tracks.join(reference.select("chrom", "reference", "panel"), "chrom", "left")
    n = F.size("ratio")
    item = F.struct(
        "chrom",
        cov.pad_array(F.col("reference"), n).alias("reference"),
        cov.pad_array(F.col("panel"), n).alias("panel"),
        "ratio",
    )
    docs = tracks.groupBy(*keys).agg(listed(natural_key(F.col("chrom")), item, "chromosomes"))
    meta = F.struct("predicted_sex", F.round("chrx_auto_ratio", 3).alias("chrx_auto_ratio"))
    return docs.select("sample_id", "chromosomes", meta.alias("_meta"))


def read_figures(stats: DataFrame) -> DataFrame:
    """Read figures of the quality document, those that the trimming report gives only if `stats` has them."""
    reported = {
        "total_reads_raw": None, "total_reads_after_qc": None, "total_bases_raw_gb": 2, "pct_q30_raw": 1,
        "read_length_bp": None, "read_length_after_trimming_bp": None, "fragment_size_mean_bp": None,
    }
    shown = [F.col(k) if places is None else F.round(k, places).alias(k) for k, places in reported.items() if k in stats.columns]
    return stats.select("sample_id", *shown, F.col("primary_mapped").alias("reads_mapped"), F.round("duplication_rate_pct", 1).alias("duplication_rate_pct"))


def qc_document(windows: DataFrame, read_stats: DataFrame | None = None) -> DataFrame:
    genome = cov.qc_genome(windows)
    item = F.struct("chrom", *rounded(mean_depth=1, median_depth=1, p10_depth=1), "n_bins", "low_bins")
    chroms = cov.qc_chrom(windows).groupBy("sample_id").agg(listed(natural_key(F.col("chrom")), item, "chromosomes"))
    doc = genome.join(chroms, "sample_id").select(
        "sample_id",
        *rounded(genome_mean_depth=1, genome_median_depth=1, genome_std_depth=1, uniformity_cv=3),
        *rounded(pct_bins_gt10x=1, pct_bins_gt15x=1, pct_bins_gt20x=1, pct_bins_gt30x=1),
        "n_low_bins",
        "n_total_bins",
        "chromosomes",
        "qc_status",
        "warning",
        F.format_string("Mean genome coverage %.1fx across %d 1Mb bins.", "genome_mean_depth", "n_total_bins").alias("assessment"),
    )
    return doc if read_stats is None else doc.join(read_stats, "sample_id", "left")


def region_document(regions: DataFrame, pairs: DataFrame, summary: DataFrame, keep: str = "first") -> DataFrame:
    """Real and artefact regions, genes of the real ones and the counters.

    `keep`: which detail of a gene in several regions is shown: the first of all regions, or the last of the real ones.
    """
    item = F.struct(
        "chrom", "start", "end", "size", "sample_pct_mean", "ref_depth_pct", "disrupted_genes", "disrupted_gene_details", "verdict"
    )
    artefact = F.col("verdict") == "mappability_artefact"
    order = [F.col("chrom"), F.col("start")]
    real = regions.where(~artefact).groupBy("sample_id").agg(listed(order, item, "regions"))
    fake = regions.where(artefact).groupBy("sample_id").agg(listed(order, item, "artefact_regions"))
    names = regions.where(~artefact).select("sample_id", F.explode("disrupted_genes").alias("gene")).distinct()
    if keep == "last":
        real_keys = regions.where(~artefact).select("sample_id", "chrom", "start")
        pairs = pairs.join(real_keys, ["sample_id", "chrom", "start"], "left_semi")
    found = unique_genes(pairs, ["chrom", "start", "gene_ord"], keep=keep).join(names, ["sample_id", "gene"], "left_semi")
    gene = F.struct("gene", "biotype", "chrom", F.col("gene_start").alias("start"), F.col("gene_end").alias("end"), "overlap", "exon_overlap")
    genes = found.groupBy("sample_id").agg(listed([F.col("gene")], gene, "disrupted_genes"))
    counters = F.struct(*[c for c in summary.columns if c != "sample_id"]).alias("summary")
    return (
        summary.select("sample_id", counters)
        .join(real, "sample_id", "left")
        .join(fake, "sample_id", "left")
        .join(genes, "sample_id", "left")
    )


def catalogue_document(sparse: DataFrame, defaults: DataFrame, catalogue: DataFrame, summary: DataFrame) -> DataFrame:
    """All catalogue variants of each sample: its own calls, and the sample's default calls for the others.

    The catalogue is one shared array, from which a sample's own variants are taken out by number.
    """
    call = F.struct(
        "zygosity",
        "affected",
        "call_confidence",
        F.when(F.col("in_panel"), F.col("gt")).alias("panel_gt"),
        F.when(F.col("in_panel"), F.transform("gp", lambda g: F.round(g, 4))).alias("panel_gp"),
        F.when(F.col("zygosity") != "low_gp_no_call", F.round("panel_af", 4)).alias("panel_af"),
        "source",
        "note",
        *[F.when(F.col("source") == "reads_direct", F.col(c)).alias(o) for c, o in (("total", "depth"), ("ref_count", "ref_count"), ("alt_count", "alt_count"))],
    )
    shown = ("cat_id", "chrom", "pos", "ref", "alt", "extra")
    shared = catalogue.agg(listed([F.col("cat_id")], F.struct(*shown), "_items"))
    numbers = shared.select(F.posexplode(F.transform("_items", lambda x: x["cat_id"])).alias("_no", "cat_id"))
    own = F.struct("_no", F.struct(*shown, call.alias("call")).alias("item"))
    held = sparse.join(numbers, "cat_id").groupBy("sample_id").agg(F.collect_list(own).alias("_held"))
    usual = defaults.groupBy("sample_id").agg(
        F.max(F.when(F.col("_placed"), call)).alias("_snv_call"), F.max(F.when(~F.col("_placed"), call)).alias("_other_call")
    )

    def filled(no):
        x = F.get("_items", no)
        usual_call = F.when(gt.is_snv(x["ref"], x["alt"], x["pos"]), F.col("_snv_call")).otherwise(F.col("_other_call"))
        return F.struct(no.alias("_no"), F.struct(*[x[c].alias(c) for c in shown], usual_call.alias("call")).alias("item"))

    numbered = F.transform("_items", lambda _, no: no)
    rest = F.transform(F.array_except(numbered, F.coalesce(F.transform("_held", lambda h: h["_no"]), F.array().cast("array<int>"))), filled)
    by_number = lambda a, b: a["_no"] - b["_no"]
    every = F.array_sort(F.when(F.col("_held").isNull(), rest).otherwise(F.concat("_held", rest)), by_number)
    counters = F.struct(*[c for c in summary.columns if c != "sample_id"]).alias("summary")
    return (
        summary.select("sample_id", counters)
        .join(usual, "sample_id")
        .join(held, "sample_id", "left")
        .join(shared, F.lit(True))
        .select("sample_id", "summary", F.transform(every, lambda x: x["item"]).alias("variants"))
    )


def mixture_document(ranked: DataFrame, coverage: DataFrame) -> DataFrame:
    """All components by falling share. `ranked`: sample_id, breed, breed_name, proportion, rank."""
    item = F.struct("breed", "breed_name", F.round("proportion", 6).alias("proportion"))
    docs = ranked.groupBy("sample_id").agg(listed([F.col("rank")], item, "breed_composition"), F.count(F.lit(1)).alias("k"))
    return docs.join(coverage.select("sample_id", "snps_used", F.round("pct_covered", 1).alias("pct_covered")), "sample_id")


def gene_map_document(extents: DataFrame) -> DataFrame:
    """Genes per chromosome number; exons and coding parts are unknown here and stay empty."""
    none = F.array().cast("array<array<bigint>>")
    item = F.struct("gene_id", "name", "start", "end", "strand", "biotype", none.alias("exons"), none.alias("cds"))
    chrom = F.regexp_replace("chrom", "^chr", "")
    return extents.groupBy("sample_id", chrom.alias("chrom")).agg(listed([F.col("gene_ord")], item, "genes"))


def functional_document(effects: DataFrame) -> DataFrame:
    summary = ann.impact_summary(effects)
    counters = summary.select("sample_id", F.struct(*[c for c in summary.columns if c != "sample_id"]).alias("summary"))
    high = effects.where(F.col("impact") == "HIGH")
    row = F.struct(
        "impact",
        F.col("gene_name").alias("gene"),
        F.regexp_replace("chrom", "^chr", "").alias("chr"),
        F.col("pos").cast("string").alias("pos"),
        "ref",
        "alt",
        "effect",
        "zygosity",
        F.round("af", 6).alias("panel_af"),
    )
    order = [F.when(F.col("zygosity") == "hom_alt", 0).otherwise(1), F.coalesce("af", F.lit(1.0)), F.col("ord"), F.col("ann_idx")]
    variants = high.groupBy("sample_id").agg(listed(order, row, "high_variants"))
    counts = ann.effect_counts(effects).groupBy("sample_id").agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("base_effect", "n")))).alias("high_effect_counts")
    )
    gene = F.struct(F.col("gene_name").alias("gene"), "n_moderate", "hom_alt", "het", "effects", F.round("min_af", 6).alias("min_af"))
    moderate = ann.moderate_by_gene(effects).groupBy("sample_id").agg(
        listed([-F.col("n_moderate"), F.col("first_seen")], gene, "moderate_by_gene")
    )
    return (
        counters.join(counts, "sample_id", "left").join(variants, "sample_id", "left").join(moderate, "sample_id", "left")
    )


def scores_document(behaviour: DataFrame, physical: DataFrame, counts: DataFrame) -> DataFrame:
    """`behaviour` and `physical`: sample_id, trait, prs_z, percentile, predicted, n_snps_used, heritability, label."""

    def fold(rows: DataFrame, out: str) -> DataFrame:
        item = F.struct(
            "trait",
            *rounded(prs_z=3, percentile=1, predicted=2),
            "label",
            "n_snps_used",
            F.when(F.col("trait") == "weight_kg", F.round(F.col("predicted") * fv.POUNDS_PER_KG, 1)).alias("pred_lbs"),
            F.format_string("GWAS prediction for %s", F.lower("trait")).alias("description"),
            "heritability",
        )
        return rows.groupBy("sample_id").agg(listed([F.col("trait")], item, out))

    return counts.join(fold(behaviour, "traits"), "sample_id", "left").join(fold(physical, "physical_traits"), "sample_id", "left")


def inbreeding_document(segments: DataFrame, froh: DataFrame) -> DataFrame:
    item = F.struct("chrom", "start", "end", F.round((F.col("end") - F.col("start")) / 1e6, 3).alias("length_mb"))
    lists = segments.groupBy("sample_id").agg(listed([*natural_key(F.col("chrom")), F.col("start")], item, "roh_segments"))
    return froh.join(lists, "sample_id", "left").select(
        "sample_id",
        F.round("f_roh", 4).alias("f_roh"),
        F.round(F.col("f_roh") * 100, 2).alias("f_roh_pct"),
        F.round("roh_total_mb", 2).alias("roh_total_mb"),
        "roh_n_segments",
        "level",
        F.lit(inb.AUTOSOMES_MB).alias("autosomal_genome_mb"),
        "roh_segments",
    )


def f_distribution_document(f: DataFrame, reference: DataFrame, value: str = "f_value") -> DataFrame:
    """Sample F against a reference list of one number per individual."""
    dist = inb.dist_summary(reference, value, probs={"p25": 0.25, "p50": 0.5, "p75": 0.75})
    hist = inb.histogram(reference, value).agg(
        listed([F.col("bin")], F.col("n"), "hist_counts"),
        listed([F.col("bin")], F.col("lower"), "_lower"),
        F.max("upper").alias("_top"),
    )
    placed = inb.percentile_rank(reference, f.where(F.col("f").isNotNull()), value, "f", "strict")
    return placed.join(dist, F.lit(True)).join(hist, F.lit(True)).select(
        "sample_id",
        F.round("f", 4).alias("sample_f"),
        F.round("percentile", 1).alias("sample_percentile"),
        F.col("n").alias("n_samples"),
        F.round("mean", 4).alias("ref_mean"),
        *[F.round(p, 4).alias(f"ref_{p}") for p in ("p25", "p50", "p75")],
        "hist_counts",
        F.concat("_lower", F.array("_top")).alias("hist_edges"),
        "n_obs",
    )


def coat_document(phenotype: DataFrame, observed: DataFrame, flags: DataFrame) -> DataFrame:
    """`phenotype`: predict_phenotype; `observed`: locus_document; `flags`: flag_gene on the graying gene."""
    info = {row[0]: row for row in fv.LOCI}
    variants = observed.schema["observed_variants"].dataType
    observed_by_locus = observed.groupBy("sample_id").agg(
        F.map_from_entries(F.collect_list(F.struct("locus", "observed_variants"))).alias("_obs")
    )
    rows = phenotype.join(observed_by_locus, "sample_id", "left").join(flags, "sample_id", "left")

    def locus(name: str) -> Column:
        _, gene, chrom, title, role, part = info[name]
        legend = F.create_map(*[F.lit(x) for l, a, text in fv.ALLELE_LEGEND if l == name for x in (a, text)])
        extra = [F.col("proxy_false_positive_prediction")] if name == "E" else []
        return F.struct(
            F.lit(gene).alias("gene"),
            F.lit(chrom).alias("chrom"),
            F.lit(title).alias("name"),
            F.lit(role).alias("role"),
            F.lit(part).alias("phenotype_contribution"),
            legend.alias("alleles_reference"),
            F.array(f"{name}.a1", f"{name}.a2").alias("predicted_alleles"),
            F.col(f"{name}.conf").alias("confidence"),
            F.col(f"{name}.text").alias("interpretation"),
            F.coalesce(F.try_element_at("_obs", F.lit(name)), F.array().cast(variants)).alias("observed_variants"),
            *extra,
        ).alias(name)

    summary = F.struct(
        "predicted_base_color",
        "predicted_pattern",
        "predicted_dilution",
        F.lit(fv.WHITE_NOTE).alias("predicted_white"),
        F.lit(fv.MERLE_NOTE).alias("predicted_merle"),
        "overall_confidence",
        F.lit(fv.COAT_CAVEAT).alias("caveat"),
        lc.graying_note(F.col("gene_deleted")).alias("graying_note"),
    )
    return rows.select("sample_id", summary.alias("summary"), F.struct(*[locus(l) for l in lc.LOCI]).alias("loci"))


def taxa_document(scaled: DataFrame) -> DataFrame:
    """One list per rank, by falling abundance, in percent of all reads."""
    shown = scaled.withColumn("relative_abundance", F.round("relative_abundance", 6))
    per_rank = mb.order_taxa(shown)
    totals = scaled.groupBy("sample_id").agg(F.round(F.first("total_classified_pct"), 4).alias("total_classified_pct"))
    lists = per_rank.groupBy("sample_id").pivot("rank", list(fv.TAXON_RANKS)).agg(F.first("taxa"))
    renamed = lists.select("sample_id", *[F.col(k).alias(v) for k, v in fv.TAXON_RANKS.items()])
    return totals.join(renamed, "sample_id")


def age_document(predicted: DataFrame, metrics: DataFrame, top: DataFrame, samples: DataFrame, counts: dict[str, int]) -> DataFrame:
    """`metrics`: cv_r2, cv_mae (one row); `top`: clade, coefficient (ten rows); `samples`: sample_id, age."""
    species = F.translate(F.regexp_replace("clade", r".*\|s__", ""), "_", " ")
    folded = top.agg(
        listed([-F.abs("coefficient")], F.struct(species.alias("name"), F.round("coefficient", 5).alias("coefficient")), "top_species")
    )
    return (
        predicted.join(metrics, F.lit(True))
        .join(folded, F.lit(True))
        .join(samples.select("sample_id", F.col("age").alias("actual_age_years")), "sample_id", "left")
        .select(
            "sample_id",
            F.round("predicted", 2).alias("predicted_age_years"),
            F.round("cv_r2", 3).alias("cv_r2"),
            F.round("cv_mae", 3).alias("cv_mae_years"),
            *[F.lit(v).alias(k) for k, v in counts.items()],
            "top_species",
            "actual_age_years",
        )
    )


def health_document(health: DataFrame, hits: DataFrame) -> DataFrame:
    """`health`: one row per sample with diversity, percentiles, reference quartiles and burden columns."""
    name = F.translate(F.regexp_replace("fragment", "^s__", ""), "_", " ")
    item = F.struct(name.alias("name"), F.round("pct", 3).alias("pct"), "color", "association")
    lists = hits.groupBy("sample_id").agg(listed([-F.col("pct")], item, "pathobiont_hits"))
    numbers = [F.round(c, 4).alias(c) if t == "double" else F.col(c) for c, t in health.dtypes if c != "sample_id"]
    return health.select("sample_id", *numbers).join(lists, "sample_id", "left")


def panel_document(ratios: DataFrame, names: list[str], source: str) -> DataFrame:
    """Panel-of-normals tracks and their description, one row."""
    tracks = cov.bins_to_array(ratios.withColumn("ratio", F.round("ratio", 4)), ["chrom", "baseline"], "bin_idx", "ratio", "ratio")
    folded = tracks.agg(
        listed(natural_key(F.col("chrom")), F.struct("chrom", "ratio"), "chromosomes"), F.round(F.max("baseline"), 2).alias("_median")
    )
    meta = F.struct(
        F.lit(source).alias("source"),
        F.col("_median").alias("panel_median_depth"),
        F.lit(len(names)).alias("n_samples"),
        F.array(*[F.lit(n) for n in names]).alias("samples"),
    )
    return folded.select("chromosomes", meta.alias("_meta"))
