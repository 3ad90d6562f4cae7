"""The staged cohort run: every stage reads tables, writes tables and publishes documents for all pending samples."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lociframe import fixed_values as fv
from lociframe.functions import genotypes as gt
from lociframe.functions.cigar import with_blocks
from lociframe.functions.text import is_autosome
from lociframe.operators import ancestry as anc
from lociframe.operators import annotation as ann
from lociframe.operators import catalogue as cat
from lociframe.operators import coverage as cov
from lociframe.operators import inbreeding as inb
from lociframe.operators import loci as lc
from lociframe.operators import microbiome as mb
from lociframe.operators import reads as rd
from lociframe.operators import regions as reg
from lociframe.operators import scores as sc
from lociframe.plans.blockscan import BLOCK, running_number
from lociframe.plans.quantiles import exact_quantiles
from lociframe.sinks import documents as docs
from lociframe.sinks import publish as store
from lociframe.sinks.publish import exists, load
from lociframe.sources.jsondocs import extract_read_stats
from lociframe.sources.taxa import is_genus, is_species

MEGABASE = 1_000_000


@dataclass
class Cohort:
    """Inputs by name, an internal table folder and a document folder.

    Reference inputs and outputs are separate folders, so no stage reads a path it is writing. Inside a run (`begin` to
    `finish`) tables and documents are written under the run's number and become visible together; documents are
    published from the committed tables. Outside of one, each table is committed on its own.
    """

    spark: SparkSession
    inputs: dict[str, DataFrame]
    tables: str
    public: str
    run_no: int | None = None
    written: list[tuple[str, DataFrame]] = field(default_factory=list)

    def of(self, name: str, samples: DataFrame) -> DataFrame:
        """Rows of an input for the given samples; reads and calls that are no input come from stages 4 and 7."""
        if name not in self.inputs:
            return self.stored(name, samples)
        return self.inputs[name].join(samples.select("sample_id"), "sample_id", "left_semi")

    def stored(self, name: str, samples: DataFrame) -> DataFrame:
        """Rows of an earlier stage's table, or of one that this run has written, for the given samples."""
        mine = [of for table, of in self.written if table == name]
        own = (self.run_no, mine[-1]) if mine else None
        return load(self.spark, name, self.tables, own).join(samples.select("sample_id"), "sample_id", "left_semi")

    def keep(self, df: DataFrame, name: str, samples: DataFrame, order: tuple[str, ...] = ()) -> None:
        """Write a table; `order` sorts the rows of each file, so that a scan by place reads a few row groups."""
        if self.run_no is None:
            store.save(df, name, self.tables, samples, order)
        else:
            store.write_version(df, name, self.tables, samples, self.run_no, order)
            self.written.append((name, samples))

    def show(self, df: DataFrame, name: str, samples: DataFrame) -> None:
        if self.run_no is None:
            store.publish(df, name, self.public, samples)
        else:
            self.keep(df, store.DOCUMENT + name, samples)

    def begin(self) -> None:
        """Open a run; what an earlier run wrote without a commit is forgotten, what it committed is published."""
        store.publish_committed(self.spark, self.tables, self.public)
        self.run_no, self.written = store.new_run(self.spark, self.tables), []

    def finish(self) -> None:
        """Commit the run, then publish its documents."""
        store.commit(self.spark, self.tables, self.run_no, self.written)
        self.run_no, self.written = None, []
        store.publish_committed(self.spark, self.tables, self.public)


def stage_lanes(c: Cohort, samples: DataFrame) -> None:
    """Stage 1: the lanes of each sample in version order. Merging them is a union, so no copy of the reads is written."""
    c.keep(rd.lane_manifest(c.of("lanes", samples)), "lane_manifest", samples)
    both = c.stored("lane_manifest", samples).groupBy("sample_id").agg(F.sum("reads_1").alias("a"), F.sum("reads_2").alias("b"))
    without = samples.join(both.where((F.col("a") > 0) & (F.col("b") > 0)), "sample_id", "left_anti").select("sample_id").limit(5).collect()
    if without:
        raise ValueError(f"no lanes of both mates for {', '.join(r.sample_id for r in without)}")


def stage_cleaning(c: Cohort, samples: DataFrame) -> None:
    """Stage 2: trimmed pairs for the aligner, with the figures of a trimming report."""
    numbered = c.of("lanes", samples).join(c.stored("lane_manifest", samples).select("sample_id", "lane", "lane_no"), ["sample_id", "lane"])
    c.keep(rd.clean_pairs(numbered), "clean_reads", samples)
    c.keep(rd.read_figures(c.of("lanes", samples), c.stored("clean_reads", samples)), "read_figures", samples)


def stage_marking(c: Cohort, samples: DataFrame) -> None:
    """Stage 4: duplicates of the aligned reads (alignment itself is stage 3, outside) marked, in coordinate order."""
    marked = rd.set_duplicate_bit(rd.mark_read_duplicates(c.of("aligned", samples)))
    c.keep(marked, "reads", samples, ("chrom", "pos"))


def stage_stitching(c: Cohort, samples: DataFrame) -> DataFrame:
    """Stage 7: bring the ledger of imputed chunks up to date and stitch those that are done into the calls.

    Inputs: `chunks`, `chunk_results` (the log of attempts), `chunk_calls` (calls with their chunk_key), and if there are
    chunks known to fail, `failed_chunks`. Returns the samples that no chunk is open of; the others are due again.
    """
    none = c.spark.createDataFrame([], "chunk_key string")
    before = c.stored("chunk_ledger", samples) if exists(c.spark, "chunk_ledger", c.tables) else None
    ledger = rd.chunk_ledger(samples, c.inputs["chunks"], c.of("chunk_results", samples), c.inputs.get("failed_chunks", none), before)
    c.keep(ledger, "chunk_ledger", samples)
    c.keep(rd.chunk_calls_to_sites(c.of("chunk_calls", samples), c.stored("chunk_ledger", samples)), "calls", samples, ("chrom", "pos"))
    flat = c.stored("calls", samples).withColumn("alt", F.array_join("alt", ","))
    c.keep(rd.variant_stats(flat), "call_stats", samples)
    return samples.join(open_chunks(c, samples).select("sample_id"), "sample_id", "left_anti")


def open_chunks(c: Cohort, samples: DataFrame) -> DataFrame:
    """What the imputer is to run next: chunks that are neither done nor known to fail, with their attempts so far.

    Samples that the ledger does not know yet have all their chunks open but for those known to fail.
    """
    keys = ["sample_id", "chunk_key"]
    none = c.spark.createDataFrame([], "chunk_key string")
    started = c.run_no is not None or exists(c.spark, "chunk_ledger", c.tables)
    known = c.stored("chunk_ledger", samples) if started else None
    nothing = c.spark.createDataFrame([], "sample_id string, chunk_key string, attempt long, ok boolean")
    rows = rd.chunk_ledger(samples, c.inputs["chunks"], nothing, c.inputs.get("failed_chunks", none), known)
    done, failed = (rows.where(F.col("status") == s).select(*keys) for s in ("done", "known_failed"))
    return rd.pending_chunks(rows, done, failed, keys)


def filter_called_variants(c: Cohort, samples: DataFrame, **limits) -> DataFrame:
    """The separate variant-calling job: marks the calls of the input `raw_variants`, keeps the passing ones as table
    `variants` and their counts as `variant_stats`; returns the counts."""
    c.keep(rd.filter_variants(c.of("raw_variants", samples), **limits), "variants", samples, ("chrom", "pos"))
    c.keep(rd.variant_stats(c.stored("variants", samples)), "variant_stats", samples)
    return c.stored("variant_stats", samples)


def read_spans(reads: DataFrame) -> DataFrame:
    """Half-open stretches that count towards depth. Deletions and skips inside a read count, as in the usual per-region
    sum of depths; pass gaps=False to `with_blocks` for aligned bases only."""
    blocks = with_blocks(cov.countable_reads(reads), gaps=True)
    return blocks.select("sample_id", "chrom", (F.col("b_start") - 1).alias("start"), F.col("b_end").alias("end"))


def stage_coverage(c: Cohort, samples: DataFrame) -> None:
    """Reads are scanned once, for the places where depth changes; both widths are integrated from those."""
    contigs = c.inputs["contigs"]
    c.keep(cov.depth_events(read_spans(c.of("reads", samples))), "depth_events", samples)
    events = c.stored("depth_events", samples)
    megabases = samples.select("sample_id").withColumn("width", F.lit(MEGABASE).cast("long"))
    wide = cov.integrate_events(events, cov.tile_by(contigs, megabases))
    c.keep(cov.with_depth(wide.drop("width")), "coverage_1mb", samples)
    widths = cov.adaptive_width(c.stored("coverage_1mb", samples))
    c.keep(widths, "region_widths", samples)
    tiles = cov.tile_by(contigs, c.stored("region_widths", samples))
    c.keep(cov.with_depth(cov.integrate_events(events, tiles)), "coverage_regions", samples)


def stage_quality(c: Cohort, samples: DataFrame) -> None:
    windows = c.stored("coverage_1mb", samples)
    binned = cov.fill_bins(
        windows.select("sample_id", "chrom", "bin_idx", F.round("depth", 4).alias("depth")), ["sample_id", "chrom"], "bin_idx", {"depth": 0.0}
    )
    sexed = cov.predict_sex(cov.baseline_depth(binned))
    c.show(docs.coverage_document(cov.normalise_x(binned, sexed), c.inputs.get("reference_tracks")), "coverage_1mb", samples)
    flags = rd.flag_summary(c.of("reads", samples))
    if "read_reports" in c.inputs:
        figures = extract_read_stats(c.of("read_reports", samples))
        flags = flags.join(figures.drop("histogram").join(rd.fragment_size(figures, ["sample_id"]), "sample_id", "left"), "sample_id", "left")
    elif exists(c.spark, "read_figures", c.tables):
        flags = flags.join(c.stored("read_figures", samples), "sample_id", "left")
    cleaned = F.coalesce("total_reads_after_qc", "primary") if "total_reads_after_qc" in flags.columns else F.col("primary")
    quality = docs.qc_document(windows, docs.read_figures(rd.duplication_rate(flags, cleaned)))
    c.keep(quality, "quality", samples)
    c.show(c.stored("quality", samples), "qc_result", samples)
    cells = c.stored("coverage_regions", samples)
    c.keep(reg.call_regions(cells, c.inputs["genes"], c.inputs["panel_coverage"]), "regions", samples)
    publish_regions(c, samples, "regions")


def publish_regions(c: Cohort, samples: DataFrame, version: str) -> None:
    regions = c.stored(version, samples)
    detail = F.col("_d")
    pairs = regions.select("sample_id", F.col("start").alias("r_start"), F.posexplode("disrupted_gene_details").alias("gene_ord", "_d")).select(
        "sample_id", "gene_ord", detail["gene"].alias("gene"), detail["biotype"].alias("biotype"), detail["chrom"].alias("chrom"),
        F.col("r_start").alias("start"), detail["start"].alias("gene_start"), detail["end"].alias("gene_end"),
        detail["overlap"].alias("overlap"), detail["exon_overlap"].alias("exon_overlap"),
    )
    summary = reg.region_summary(regions, c.stored("region_widths", samples))
    c.show(docs.region_document(regions, pairs, summary, "last" if version == "regions_annotated" else "first"), "cnv_homdel", samples)


def stage_catalogue(c: Cohort, samples: DataFrame) -> None:
    catalogue = cat.drop_keys(c.inputs["catalogue"], "extra", c.inputs.get("private_keys", []))
    depth = c.stored("quality", samples).select("sample_id", F.col("genome_mean_depth").alias("mean_depth"))
    piled = rd.pileup(c.of("reads", samples), catalogue.where(F.col("pos").isNotNull()))
    c.keep(cat.sparse_catalogue(catalogue, c.of("calls", samples), depth, piled), "catalogue_calls", samples)
    called = c.stored("catalogue_calls", samples)
    defaults = cat.default_calls(catalogue, called, depth)
    summary = cat.catalogue_summary(called, defaults=defaults).join(depth, "sample_id").withColumn(
        "read_fallback_used", F.col("mean_depth") >= cat.MIN_MEAN_DEPTH
    )
    c.show(docs.catalogue_document(called, defaults, catalogue, summary), "catalogue_result", samples)


def single_alt_calls(c: Cohort, samples: DataFrame) -> DataFrame:
    """Calls with the ALT list as text, the way the panel and site lookups compare it."""
    return c.of("calls", samples).withColumn("alt", F.array_join("alt", ",")).withColumn("raf", F.get("raf", 0))


def stage_ancestry(c: Cohort, samples: DataFrame) -> None:
    snps, components, labels = c.inputs["snps"], c.inputs["components"], c.inputs["component_labels"]
    matched = cat.match_panel(snps, single_alt_calls(c, samples))
    dosages = matched.select("sample_id", "snp_idx", gt.dosage_first(F.col("ref"), F.col("a1"), F.col("gp")).alias("dosage"))
    order = anc.ordered_labels(labels)
    k = order.count()
    mixture = anc.project_mixture(dosages, components, k).join(order.withColumnRenamed("label", "breed"), "k")
    named = anc.decode(mixture, c.inputs["breed_names"], "breed", "name", "breed_name")
    coverage = cat.panel_coverage(dosages, snps.count())
    c.show(docs.mixture_document(anc.top_components(named), coverage), "breed_result", samples)


def stage_annotation(c: Cohort, samples: DataFrame) -> None:
    annotated = c.of("annotated", samples)
    exploded = ann.explode_annotations(annotated)
    extents = ann.gene_extents(exploded)
    c.show(docs.gene_map_document(extents), "cnv_genes", samples)
    genes = extents.select(
        "sample_id", "chrom", "gene_id", F.col("gene_ord"), F.col("name").alias("gene"),
        "biotype", F.col("start").alias("gene_start"), F.col("end").alias("gene_end"),
    )
    fresh = reg.reannotate_regions(c.stored("regions", samples), genes, ann.exonic_points(exploded))
    c.keep(fresh, "regions_annotated", samples)
    publish_regions(c, samples, "regions_annotated")
    frequencies = single_alt_calls(c, samples).select("sample_id", "chrom", "pos", "alt", F.col("raf").alias("af"), "ord")
    c.keep(ann.functional_effects(annotated, frequencies), "effects", samples)
    c.show(docs.functional_document(c.stored("effects", samples)), "functional_variants", samples)


def stage_scores(c: Cohort, samples: DataFrame) -> None:
    matched = cat.match_panel(c.inputs["snps"], single_alt_calls(c, samples))
    dosages = matched.select("sample_id", "snp_idx", gt.dosage_second(F.col("alt"), F.col("a2"), F.col("gp")).alias("dosage"))
    people, names, table = c.inputs["individuals"], c.inputs["trait_names"], c.inputs["traits"]
    values = table.withColumn("value", F.col("value").try_cast("double")).where(F.col("value").isNotNull())
    behaviour = sc.breed_trait(people, names, values.where(F.col("trait").isin(*fv.TRAIT_COLUMNS)))
    behaviour = behaviour.join(sc.eligible_traits(behaviour), "trait", "left_semi")
    sizes = sc.breed_trait(people, names, values.where(F.col("trait").isin("height_cm", "weight_kg")))
    text = table.where(F.col("value") != "")
    coats = text.where(F.col("trait") == "Coat Type").select(
        "breed_name", F.explode(F.array(*[F.struct(F.lit(f"coat_type:{t}").alias("trait"), sc.one_vs_rest(F.col("value"), t).alias("value")) for t in fv.COAT_TYPES])).alias("x")
    ).select("breed_name", "x.*")
    coats = sc.breed_trait(people, names, coats)
    coats = coats.join(sc.eligible_traits(coats), "trait", "left_semi")
    length = text.where(F.col("trait") == "Coat Length").select(
        "breed_name", F.lit("coat_length").alias("trait"), sc.ordinal_code(F.col("value"), fv.COAT_LENGTH).alias("value")
    ).where(F.col("value").isNotNull())
    length = sc.breed_trait(people, names, length)
    every = behaviour.unionByName(sizes).unionByName(coats).unionByName(length)
    c.keep(sc.trait_scores(dosages, c.inputs["genotypes"], people, every), "scores", samples)
    scored = c.stored("scores", samples)
    bound = F.col("trait")
    low, high = F.lit(float(fv.TRAIT_BOUNDS["behaviour"][0])), F.lit(float(fv.TRAIT_BOUNDS["behaviour"][1]))
    for name in ("height_cm", "weight_kg", "coat_length"):
        a, b = fv.TRAIT_BOUNDS[name]
        low, high = F.when(bound == name, float(a)).otherwise(low), F.when(bound == name, float(b)).otherwise(high)
    units = sc.rescale_score(scored, every, low, high)
    known = c.inputs["heritability"]
    is_coat = F.col("trait").startswith("coat_type:")
    plain = sc.carry_over(units.where(~is_coat), known, "trait", ["heritability"])
    plain = plain.withColumn("label", F.when(F.col("trait") == "coat_length", sc.nearest_level(F.col("predicted"), fv.COAT_LENGTH)))
    rank = F.array_position(F.array(*[F.lit(f"coat_type:{t}") for t in fv.COAT_TYPES]), F.col("trait"))
    best = sc.argmax_category(units.where(is_coat).withColumn("_tie", rank), ["sample_id"], "prs_z", "_tie").drop("_tie")
    best = best.withColumns({"label": F.split("trait", ":")[1], "trait": F.lit("coat_type"), "predicted": F.lit(None).cast("double")})
    best = sc.carry_over(best, known, "trait", ["heritability"])
    physical = F.col("trait").isin("height_cm", "weight_kg", "coat_length")
    panel = people.agg(F.count_distinct("breed").alias("n_ref_breeds"))
    counts = dosages.groupBy("sample_id").agg(F.count("dosage").alias("snps_imputed")).join(panel, F.lit(True))
    c.show(docs.scores_document(plain.where(~physical), plain.where(physical).unionByName(best), counts), "prs_result", samples)


def stage_inbreeding(c: Cohort, samples: DataFrame) -> None:
    calls = c.of("calls", samples).where(is_autosome(F.col("chrom")))
    sites = calls.withColumn("is_het", gt.is_het("gt")).where(F.col("is_het").isNotNull())
    c.keep(inb.roh(sites.select("sample_id", "chrom", "pos", "ord", "is_het"), tie=["ord"]), "runs", samples)
    runs = c.stored("runs", samples)
    c.show(docs.inbreeding_document(runs, inb.froh(runs, samples)), "inbreeding_result", samples)
    joined = inb.join_af(calls, c.inputs["panel_af"])
    f = inb.genotype_f(joined, gt.is_hom_biallelic(F.col("gt")))
    c.show(docs.f_distribution_document(f, c.inputs["reference_f"]), "inbreeding_f_result", samples)


def latest_regions(c: Cohort, samples: DataFrame) -> DataFrame:
    """Regions by gene and verdict: the annotated ones of samples that are through stage 10, else those of the first pass."""
    shape = ["sample_id", "chrom", "start", "end", "verdict", "disrupted_genes"]
    if not (exists(c.spark, "regions_annotated", c.tables) and exists(c.spark, "done_10", c.tables)):
        return c.stored("regions", samples).select(*shape)
    through = samples.join(load(c.spark, "done_10", c.tables).select("sample_id"), "sample_id", "left_semi")
    first = c.stored("regions", samples).join(through.select("sample_id"), "sample_id", "left_anti")
    return c.stored("regions_annotated", through).select(*shape).unionByName(first.select(*shape))


def stage_coat(c: Cohort, samples: DataFrame) -> None:
    sites = lc.known_sites(c.spark)
    piled = rd.pileup(c.of("reads", samples), sites)
    calls = lc.loci_calls(samples, single_alt_calls(c, samples), piled)
    looks = lc.predict_phenotype(lc.validate_E(lc.call_loci(lc.locus_evidence(calls))))
    called = samples.select("sample_id").join(
        c.stored("region_widths", samples).select("sample_id", F.lit(True).alias("_r")), "sample_id", "left"
    ).select("sample_id", F.coalesce("_r", F.lit(False)).alias("regions_called"))
    flags = reg.flag_gene(latest_regions(c, samples), called, fv.GRAYING_GENE)
    c.show(docs.coat_document(looks, lc.locus_document(calls), flags), "coat_color", samples)


def stage_taxa(c: Cohort, samples: DataFrame) -> None:
    profile = c.of("profiles", samples)
    scaled = mb.scale_profile(profile)
    c.show(docs.taxa_document(scaled), "microbiome_result", samples)
    refs, long = c.inputs["taxa_refs"], c.inputs["taxa_long"]
    n = refs.agg(F.count(F.lit(1)).alias("n"))
    n_refs = n.first()["n"]
    species = scaled.where(F.col("rank") == "s").select("sample_id", "clade", F.col("within").alias("abundance"))
    stage_age(c, samples, species, refs, long, n, n_refs)
    stage_health(c, samples, scaled, species, refs, long, n)


def stage_age(c, samples, species, refs, long, n, n_refs) -> None:
    features = long.where(is_species(F.col("clade")))
    kept = mb.prevalent(features, n)
    # The feature list is one row per prevalent species.
    order = features.join(kept, "clade", "left_semi").groupBy("clade").agg(F.min("feature_ord").alias("o"))
    listed = order.agg(F.array_sort(F.collect_list(F.struct("o", "clade"))).alias("l")).select(F.posexplode("l").alias("f_idx", "x"))
    indexed = listed.select("f_idx", F.col("x.clade").alias("clade"))
    p = indexed.count()
    # Folds go by row number: ids may have gaps.
    y = running_number(refs.select("ref_id", F.col("age").alias("y"), F.floor(F.col("ref_id") / 10_000).alias(BLOCK)), [], [F.col("ref_id")], "row_no")
    y = y.select("ref_id", (F.col("row_no") - 1).alias("row_no"), "y")
    rows = mb.feature_rows(features.withColumn("v", mb.log_abundance(F.col("abundance"))), y, indexed)
    models = mb.ridge_cv(rows, n_refs, p)
    model = models.where(F.col("outer") == -1).select("beta")
    predicted = mb.predict_age(indexed, samples, species, model)
    matched = species.join(indexed, "clade", "left_semi").groupBy("sample_id").agg(F.count("clade").alias("n_features_matched"))
    doc = docs.age_document(
        predicted, mb.cv_metrics(rows, models, n_refs), mb.top_features(model, indexed), samples,
        {"n_training_samples": n_refs, "n_species_features": p},
    )
    c.show(doc.join(matched, "sample_id", "left"), "microbiome_age_result", samples)


def stage_health(c, samples, scaled, species, refs, long, n) -> None:
    genera = long.where(is_genus(F.col("clade")))
    leaf = F.element_at(F.split("clade", r"\|g__"), -1)
    common = genera.join(mb.prevalent(genera, n), "clade", "left_semi").withColumn("genus", leaf)
    mine = mb.rollup_genus(scaled.where(F.col("rank") == "s"))
    pairs = mine.select("sample_id", "genus", "abundance").join(common.select("genus").distinct(), "genus", "left_semi")
    # A sample is compared with the reference over its own genera; samples with the same genera share that reference.
    sets = mb.feature_sets(pairs, samples)
    ref_div = mb.set_diversity(sets, common, n)
    sample_div = mb.diversity(pairs, ["sample_id"], frame=samples.select("sample_id")).join(sets.select("sample_id", "set_id"), "sample_id")
    rich = inb.percentile_rank(ref_div, sample_div, "richness", "richness", "rank", ["set_id"], "richness_percentile", weight="w")
    both = inb.percentile_rank(ref_div, rich, "shannon", "shannon", "rank", ["set_id"], "shannon_percentile", weight="w")
    quart = {"p25": 0.25, "p50": 0.5, "p75": 0.75}
    spread = exact_quantiles(ref_div, ["set_id"], "richness", {f"ref_richness_{k}": q for k, q in quart.items()}, weight="w")
    spread = spread.withColumns({c: F.col(c).cast("int") for c in spread.columns if c != "set_id"}).join(
        exact_quantiles(ref_div, ["set_id"], "shannon", {f"ref_shannon_{k}": q for k, q in quart.items()}, weight="w"), "set_id"
    )
    whole = mb.diversity(species, ["sample_id"], frame=samples.select("sample_id")).select(
        "sample_id", F.col("richness").alias("sample_richness"), F.col("shannon").alias("sample_shannon")
    )
    fragments = c.spark.createDataFrame(fv.PATHOBIONTS, "fragment string, color string, association string")
    hits = mb.pathobiont_hits(scaled.where(F.col("rank") == "s"), fragments)
    load_ = mb.dysbiosis(hits, samples)
    burden = mb.ref_burden(long, refs, fragments)
    placed = inb.percentile_rank(burden, load_, "burden", "pathobiont_burden_pct", "rank", out="pathobiont_percentile")
    marks = {f"ref_pathobiont_{k}": q for k, q in (("median", 0.5), ("p75", 0.75), ("p90", 0.9))}
    ref_load = burden.agg(F.avg("burden").alias("ref_pathobiont_mean"))
    # One row each: without reference rows there are no quantiles, and the left join leaves them null.
    ref_load = ref_load.join(exact_quantiles(burden, [], "burden", marks), F.lit(True), "left")
    health = (
        both.withColumnsRenamed({"richness": "sample_richness_matched", "shannon": "sample_shannon_matched"})
        .join(whole, "sample_id")
        .join(spread, "set_id", "left")
        .drop("set_id")
        .join(placed, "sample_id")
        .join(ref_load, F.lit(True))
        .join(pairs.groupBy("sample_id").agg(F.count("genus").alias("n_matched_genera")), "sample_id", "left")
    )
    c.show(docs.health_document(health, hits), "microbiome_health_result", samples)


#: A stage may return the samples that it has finished; without that, all of its samples are.
STAGES: dict[int, Callable[[Cohort, DataFrame], DataFrame | None]] = {
    1: stage_lanes,
    2: stage_cleaning,
    4: stage_marking,
    5: stage_coverage,
    6: stage_quality,
    7: stage_stitching,
    8: stage_catalogue,
    9: stage_ancestry,
    10: stage_annotation,
    11: stage_scores,
    12: stage_inbreeding,
    13: stage_coat,
    15: stage_taxa,
}
ALWAYS_FROM = 15
#: Inputs without which a stage has nothing to do: a run may begin with marked reads and stitched calls.
NEEDED = {1: ("lanes",), 2: ("lanes",), 4: ("aligned",), 7: ("chunks", "chunk_results", "chunk_calls")}
#: Stored tables that a stage reads; it is due again when one of them is newer than its mark.
SOURCES = {
    2: ("lane_manifest",), 5: ("reads",), 6: ("reads", "read_figures", "coverage_1mb", "coverage_regions"), 8: ("calls", "reads", "quality"),
    9: ("calls",), 10: ("calls", "regions"), 11: ("calls",), 12: ("calls",), 13: ("calls", "reads", "regions", "regions_annotated"),
}


def pending(c: Cohort, samples: DataFrame, stage: int, skip_done: bool) -> DataFrame:
    """Samples whose first stage is not behind this one, minus the finished ones when asked to skip them.

    A sample is not finished if a table that the stage reads has been written since. Stage 7 with its log of attempts is
    due until no chunk is open.
    """
    due = samples if stage >= ALWAYS_FROM else samples.where(F.col("from_stage") <= stage)
    mark = f"done_{stage}"
    if skip_done and exists(c.spark, mark, c.tables):
        log = store.commits(c.spark, c.tables)
        marked = log.where(F.col("table") == mark).groupBy("sample_id").agg(F.max("run").alias("_mark"))
        fresh = log.where(F.col("table").isin(*SOURCES.get(stage, ()))).groupBy("sample_id").agg(F.max("run").alias("_newest"))
        done = load(c.spark, mark, c.tables).select("sample_id").join(marked, "sample_id").join(fresh, "sample_id", "left")
        done = done.where(F.col("_newest").isNull() | (F.col("_newest") <= F.col("_mark")))
        due = due.join(done.select("sample_id"), "sample_id", "left_anti")
    return due


def run(c: Cohort, samples: DataFrame, stages: list[int] | None = None, skip_done: bool = False) -> list[int]:
    """Run the stages in order for all samples that need them; returns the stages that had work."""
    worked = []
    for number in stages or sorted(STAGES):
        if not all(name in c.inputs for name in NEEDED.get(number, ())):
            continue
        due = pending(c, samples, number, skip_done)
        if due.isEmpty():
            continue
        c.begin()
        try:
            finished = STAGES[number](c, due)
            finished = due if finished is None else finished
            c.keep(finished.select("sample_id", F.lit(number).alias("stage")), f"done_{number}", due)
        except BaseException:
            c.run_no, c.written = None, []
            raise
        c.finish()
        worked.append(number)
    return worked


def build_panel(c: Cohort, names: list[str], source: str = "pooled reads") -> DataFrame:
    """Panel of normals from the pooled reads of chosen samples: chrom, bin_idx, depth, ratio."""
    chosen = c.spark.createDataFrame([(n,) for n in names], "sample_id string")
    spans = read_spans(c.of("reads", chosen))
    tiles = cov.tile(c.inputs["contigs"].withColumn("width", F.lit(MEGABASE).cast("long")), "width")
    pooled = cov.integrate_events(cov.depth_events(spans, ["chrom"]), tiles, ["chrom"], ["chrom"])
    return cov.panel_of_normals(cov.with_depth(pooled.drop("width")))
