"""Known-site calls, per-locus genotypes and the coat phenotype, as rule columns over one row per sample."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lociframe import fixed_values as fv
from lociframe.functions import genotypes as gt
from lociframe.functions.text import sentence_case
from lociframe.operators.reads import base_count, tier_counts
from lociframe.plans.picks import last_by

LOCI = ("E", "K", "A", "B", "D", "M", "S", "W")


SITE_FIELDS = ("site_ord", "locus", "chrom", "pos", "exp_ref", "exp_alt", "allele", "inheritance", "effect")


def known_sites(spark: SparkSession) -> DataFrame:
    rows = [(i, *row) for i, row in enumerate(fv.KNOWN_SITES)]
    return spark.createDataFrame(
        rows,
        "site_ord int, locus string, chrom string, pos long, exp_ref string, exp_alt string, allele string,"
        " inheritance string, effect string",
    )


def with_known_sites(samples: DataFrame) -> DataFrame:
    """Each sample with the twelve known sites, exploded from literals."""

    def literal(i: int, row: tuple) -> Column:
        kinds = ("int", "string", "string", "long", "string", "string", "string", "string", "string")
        values = (i, *row)
        return F.struct(*[F.lit(v).cast(k).alias(n) for n, k, v in zip(SITE_FIELDS, kinds, values, strict=True)])

    sites = F.array(*[literal(i, row) for i, row in enumerate(fv.KNOWN_SITES)])
    return samples.select("sample_id", F.explode(sites).alias("_s")).select("sample_id", "_s.*")


def loci_calls(
    samples: DataFrame, calls: DataFrame, pileups: DataFrame, accept: float = 0.80, min_reads: int = 5
) -> DataFrame:
    """Every sample × every known site: found, source, n_alt, conf, counts and the call fields.

    `calls`: sample_id, chrom, pos, ref, alt (text), raf (first), gt, gp, ord; the last call at a position wins.
    A panel call below `accept` is kept with low confidence; reads are used only where the panel has nothing.
    """
    spots = known_sites(samples.sparkSession).select("chrom", "pos")
    near = calls.join(spots, ["chrom", "pos"], "left_semi")
    # Dealt out first: the pick sorts rows, and a share of a sample and site needs less room for that than a split of a file.
    near = near.select("sample_id", "chrom", "pos", "ref", "alt", "raf", "gt", "gp", "ord").repartition("sample_id", "chrom", "pos")
    hits = last_by(near, ["sample_id", "chrom", "pos"], ["ord"])
    grid = with_known_sites(samples)
    rows = grid.join(hits.withColumn("_hit", F.lit(True)), ["sample_id", "chrom", "pos"], "left").join(
        pileups.where(F.col("total") >= min_reads).select("sample_id", "chrom", "pos", "counts", "total"),
        ["sample_id", "chrom", "pos"],
        "left",
    )
    hit = F.coalesce("_hit", F.lit(False))
    accepted = F.col("max_gp") >= accept
    swapped = accepted & gt.is_swapped(F.col("ref"), F.col("alt"), F.col("exp_ref"), F.col("exp_alt"))
    rows = rows.withColumn("max_gp", F.when(hit, gt.max_posterior(F.col("gp")))).withColumn("_sw", F.coalesce(swapped, F.lit(False)))
    copies = F.when(hit, gt.oriented_copies(gt.alt_copies("gt"), F.col("_sw")))
    by_reads = ~hit & F.col("total").isNotNull()
    return (
        rows.withColumn("found", hit | by_reads)
        .withColumn("n_alt", copies)
        .withColumn(
            "source",
            F.when(hit & accepted, "panel imputed")
            .when(hit, "panel imputed (low GP)")
            .when(by_reads, F.format_string("read pileup (%d reads)", "total"))
            .otherwise("not in panel / no reads"),
        )
        .withColumn(
            "conf",
            F.when(hit, gt.posterior_tier(F.col("max_gp"), accept))
            .when(by_reads, tier_counts(F.col("total"), min_reads))
            .otherwise("none"),
        )
        .withColumn("ref", F.when(F.col("_sw"), F.col("exp_ref")).otherwise(F.col("ref")))
        .withColumn("alt", F.when(F.col("_sw"), F.col("exp_alt")).otherwise(F.col("alt")))
        .withColumn("counts", F.when(by_reads, F.col("counts")))
        .withColumn("total", F.when(by_reads, F.col("total")))
        .drop("_hit", "_sw", "ord")
    )


def copies_of(locus: str, allele: str) -> Column:
    """Most copies seen over the found sites of an allele; null without a count."""
    return F.max(F.when(F.col("found") & (F.col("locus") == locus) & (F.col("allele") == allele), F.col("n_alt")))


def allele_copies(calls: DataFrame, keys: tuple[str, ...] = ("sample_id", "locus", "allele")) -> DataFrame:
    return calls.groupBy(*keys).agg(F.max(F.when(F.col("found"), F.col("n_alt"))).alias("copies"))


def locus_evidence(calls: DataFrame, min_conf: tuple[str, ...] = ("high", "medium", "low")) -> DataFrame:
    """One row per sample with all the counts the rules need.

    By default calls below the posterior gate vote too; `min_conf` restricts the votes.
    """
    voting = F.col("n_alt").isNotNull() & F.col("conf").isin(*min_conf)
    rows = calls.withColumn("n_alt", F.when(voting, F.col("n_alt")))
    found = {l: F.coalesce(F.bool_or((F.col("locus") == l) & F.col("found")), F.lit(False)).alias(f"found_{l}") for l in "EKAS"}

    def of(locus, allele):
        return F.col("found") & (F.col("locus") == locus) & (F.col("allele") == allele) & F.col("n_alt").isNotNull()

    causal = (F.col("pos") == fv.CAUSAL_E_POS) & (F.col("locus") == "E") & F.col("found")
    hom_e = of("E", "e") & (F.col("n_alt") == 2)
    sites = {}
    for locus, allele in (("A", "at_tag"), ("B", "b"), ("D", "d")):
        sites[f"{locus}_hom"] = F.coalesce(F.bool_or(of(locus, allele) & (F.col("n_alt") == 2)), F.lit(False))
        sites[f"{locus}_hets"] = F.count_if(of(locus, allele) & (F.col("n_alt") == 1))
        sites[f"{locus}_n"] = F.count_if(of(locus, allele))
    return rows.groupBy("sample_id").agg(
        *found.values(),
        copies_of("E", "e").alias("n_e"),
        copies_of("E", "Em").alias("n_em"),
        copies_of("K", "KB").alias("n_kb"),
        copies_of("S", "sp").alias("n_sp"),
        (F.count_if(hom_e) == F.count_if(hom_e & (F.col("pos") == fv.PROXY_E_POS))).alias("e_proxy_only"),
        F.coalesce(
            F.max(F.when(causal, base_count(F.col("counts"), F.lit(fv.CAUSAL_E_BASE)))), F.lit(0)
        ).alias("e_causal_reads"),
        F.max(F.when(causal, F.col("total"))).alias("e_causal_depth"),
        *[c.alias(n) for n, c in sites.items()],
    )


def fill_template(template: str, **values: Column) -> Column:
    """The template with each {name} replaced by its column."""
    text = F.lit(template)
    for name, value in values.items():
        text = F.replace(text, F.lit("{" + name + "}"), value)
    return text


def _outcome(a1: str, a2: str, conf: str, text: str, **values: Column) -> Column:
    return F.struct(
        F.lit(a1).alias("a1"), F.lit(a2).alias("a2"), F.lit(conf).alias("conf"), fill_template(fv.LOCUS_TEXT[text], **values).alias("text")
    )


def call_E() -> Column:
    two, em = F.col("n_e") == 2, F.coalesce(F.col("n_em") >= 1, F.lit(False))
    proxy, reads = F.col("e_proxy_only"), F.col("e_causal_reads") > 0
    shown = F.when(F.col("e_causal_depth") > 0, F.format_string(fv.READS_SHOWN, "e_causal_depth")).otherwise(fv.READS_NONE)
    return (
        F.when(~F.col("found_E"), _outcome("?", "?", "low", "E_missing"))
        .when(two & proxy & ~reads, _outcome("e", "e", "low", "E_proxy_low", reads=shown))
        .when(two & proxy, _outcome("e", "e", "medium", "E_proxy_medium"))
        .when(two, _outcome("e", "e", "high", "E_ee"))
        .when((F.col("n_e") == 1) & em, _outcome("Em", "e", "medium", "E_Em_e"))
        .when(F.col("n_e") == 1, _outcome("E", "e", "medium", "E_E_e"))
        .when(em, _outcome("Em", "E", "medium", "E_Em_E"))
        .otherwise(_outcome("E", "E", "medium", "E_E_E"))
    )


def call_K() -> Column:
    return (
        F.when(~F.col("found_K"), _outcome("?", "?", "low", "K_missing"))
        .when(F.col("n_kb") == 2, _outcome("KB", "KB", "high", "K_2"))
        .when(F.col("n_kb") == 1, _outcome("KB", "ky", "high", "K_1"))
        .otherwise(_outcome("ky", "ky", "high", "K_0"))
    )


def call_A() -> Column:
    return (
        F.when(~F.col("found_A"), _outcome("?", "?", "low", "A_missing"))
        .when(F.col("A_hom") | (F.col("A_hets") >= 2), _outcome("at", "at", "medium", "A_at_at"))
        .when(F.col("A_hets") == 1, _outcome("ay/?", "at", "low", "A_one"))
        .otherwise(_outcome("ay/?", "ay/?", "low", "A_none"))
    )


def call_B() -> Column:
    return (
        F.when(F.col("B_n") == 0, _outcome("?", "?", "low", "B_missing"))
        .when(F.col("B_hom") | (F.col("B_hets") >= 2), _outcome("b", "b", "high", "B_bb"))
        .when(F.col("B_hets") == 1, _outcome("b", "?", "low", "B_one"))
        .otherwise(_outcome("B", "B", "high", "B_BB"))
    )


def call_D() -> Column:
    return (
        F.when(F.col("D_n") == 0, _outcome("?", "?", "low", "D_missing"))
        .when(F.col("D_hom") | (F.col("D_hets") >= 2), _outcome("d", "d", "high", "D_dd"))
        .when(F.col("D_hets") == 1, _outcome("D", "d", "high", "D_one"))
        .otherwise(_outcome("D", "D", "high", "D_DD"))
    )


def call_S() -> Column:
    return (
        F.when(~F.col("found_S"), _outcome("?", "?", "low", "S_missing"))
        .when(F.col("n_sp") == 2, _outcome("sp", "sp", "medium", "S_2"))
        .when(F.col("n_sp") == 1, _outcome("S", "sp", "medium", "S_1"))
        .otherwise(_outcome("S", "S", "medium", "S_0"))
    )


def call_loci(evidence: DataFrame) -> DataFrame:
    """sample_id and one struct (a1, a2, conf, text) per locus."""
    rules = {
        "E": call_E(),
        "K": call_K(),
        "A": call_A(),
        "B": call_B(),
        "D": call_D(),
        "M": _outcome("m", "m", "low", "M"),
        "S": call_S(),
        "W": _outcome("w", "w", "low", "W"),
    }
    return evidence.select("sample_id", *[rule.alias(locus) for locus, rule in rules.items()])


def _has(locus: str, allele: str) -> Column:
    return (F.col(f"{locus}.a1") == allele) | (F.col(f"{locus}.a2") == allele)


def _both(locus: str, allele: str) -> Column:
    return (F.col(f"{locus}.a1") == allele) & (F.col(f"{locus}.a2") == allele)


def validate_E(loci: DataFrame) -> DataFrame:
    """For a low-confidence e/e, add the colour the coat would have if the proxy is wrong and say so in the text."""
    doubtful = _both("E", "e") & (F.col("E.conf") == "low")
    brown = _both("B", "b")
    colour = (
        F.when(_has("K", "KB") & brown, "chocolate")
        .when(_has("K", "KB"), "black")
        .when(F.col("K.a1").isin("ky", "?") & brown, "chocolate or sable (A locus)")
        .otherwise("black or sable (A locus)")
    )
    remark = fill_template(
        fv.PROXY_REMARK, colour=F.col("proxy_false_positive_prediction"),
        k1=F.col("K.a1"), k2=F.col("K.a2"), b1=F.col("B.a1"), b2=F.col("B.a2"),
    )
    remark = F.concat(F.col("E.text"), remark)
    return loci.withColumn("proxy_false_positive_prediction", F.when(doubtful, colour)).withColumn(
        "E", F.col("E").withField("text", F.when(doubtful, remark).otherwise(F.col("E.text")))
    )


def predict_phenotype(loci: DataFrame) -> DataFrame:
    """Base colour, pattern and dilution: B and D give the pigment, then E, K and A decide in this order."""
    brown, dilute = _both("B", "b"), _both("D", "d")
    brown_open = ((F.col("B.a1") == "b") & (F.col("B.a2") == "?")) | ((F.col("B.a1") == "?") & (F.col("B.a2") == "b"))

    def pigment(i: int) -> Column:
        p = {k: F.lit(v[i]) for k, v in fv.PIGMENTS.items()}
        return (
            F.when(brown & dilute, p["bb_dd"])
            .when(brown, p["bb"])
            .when(brown_open & dilute, p["b?_dd"])
            .when(brown_open, p["b?"])
            .when(dilute, p["dd"])
            .otherwise(p["black"])
        )

    rows = loci.withColumn("_c", pigment(0)).withColumn("_n", pigment(1))
    c, nose = F.col("_c"), F.col("_n")
    cap, cap_nose = sentence_case(c), sentence_case(nose)
    mask = F.when(_has("E", "Em"), " with melanistic mask (Em)").otherwise("")
    brindle = F.when(_has("K", "kbr"), " brindled").otherwise("")
    red, black = _both("E", "e"), _has("K", "KB")
    say = F.concat
    t = F.lit
    base = (
        F.when(red, say(t("Phaeomelanin — cream / yellow / red (e/e overrides K, A, B loci for coat; "), nose, t(" from B/D loci)")))
        .when(black, say(t("Eumelanin — solid "), c))
        .when(_has("A", "ay"), say(t("Eumelanin base — "), c, t("; phaeomelanin coat (sable/fawn)")))
        .when(_has("A", "aw"), say(t("Eumelanin base — "), c, t("; agouti banding (wolf sable)")))
        .when(_has("A", "at"), say(t("Eumelanin — "), c, t(" with tan points")))
        .when(_both("A", "a"), say(t("Eumelanin — solid "), c, t(" (recessive black)")))
        .otherwise(say(t("Eumelanin base — "), c, t(" (A locus undetermined)")))
    )
    pattern = (
        F.when(
            red,
            say(
                t("Solid phaeomelanin coat — no eumelanin in hair regardless of K or A locus. Skin pigment ("),
                nose,
                t(") is determined by B and D loci independently."),
            ),
        )
        .when(black, say(t("Solid "), c, mask, t(" — KB dominant black suppresses A locus entirely. "), cap_nose, t(".")))
        .when(
            _has("A", "ay"),
            say(
                cap, t("-based"), brindle, t(" sable/fawn"), mask,
                t(" — predominantly phaeomelanin (yellow/red/cream) coat with "), c, t("-tipped hairs. "), cap_nose,
                t(". Note: ay requires structural variant confirmation (not in panel)."),
            ),
        )
        .when(
            _has("A", "aw"),
            say(
                cap, t("-based"), brindle, t(" wolf sable / agouti"), mask,
                t(" — individual hairs banded with alternating "), c, t(" and phaeomelanin. "), cap_nose, t("."),
            ),
        )
        .when(
            _has("A", "at"),
            say(
                cap, t("-based"), brindle, t(" tan points"), mask, t(" — "), c,
                t(" body with phaeomelanin markings on muzzle, eyebrows, chest, inner ears, and lower legs. "), cap_nose, t("."),
            ),
        )
        .when(
            _both("A", "a"),
            say(
                t("Solid "), c, mask,
                t(" via recessive black (a/a) — A locus bypasses phaeomelanin expression entirely. "), cap_nose, t("."),
            ),
        )
        .otherwise(
            say(
                cap, t("-based"), brindle, t(" coat"), mask,
                t("; A locus pattern unknown (sable/agouti/tan-points require structural variant analysis). "), cap_nose, t("."),
            )
        )
    )
    dilution = (
        F.when(red, fv.DILUTION_NA)
        .when(black & dilute, say(t("Dilute (d/d) — "), c, t(" coat")))
        .when(dilute, say(t("Dilute (d/d) — "), c, t(" eumelanin")))
        .otherwise(fv.FULL_PIGMENT)
    )
    return (
        rows.withColumn("predicted_base_color", base)
        .withColumn("predicted_pattern", pattern)
        .withColumn("predicted_dilution", dilution)
        .withColumn("overall_confidence", overall_confidence([F.col(f"{l}.conf") for l in "EKBD"]))
        .drop("_c", "_n")
    )


def overall_confidence(confs: list[Column]) -> Column:
    """medium when every deciding locus is high or medium, else low."""
    good = F.lit(True)
    for conf in confs:
        good = good & conf.isin("high", "medium")
    return F.when(good, "medium").otherwise("low")


def graying_note(gene_deleted: Column) -> Column:
    return (
        F.when(gene_deleted.isNull(), fv.GRAYING_NOTES["unknown"])
        .when(gene_deleted, fv.GRAYING_NOTES["hit"])
        .otherwise(fv.GRAYING_NOTES["none"])
    )


def locus_document(calls: DataFrame, alt_af_from_raf: bool = True) -> DataFrame:
    """Observed variants per sample and locus, in site order, with only the fields that apply.

    The reported frequency is 1 − raf by default; pass False where `raf` already is the alternative's frequency.
    """
    counted = F.col("n_alt").isNotNull()
    af = F.round(1 - F.col("raf"), 4) if alt_af_from_raf else F.round("raf", 4)
    observed = F.struct(
        F.col("site_ord"),
        F.col("pos"),
        F.col("source"),
        F.col("effect"),
        F.when(counted, F.col("gt")).alias("gt"),
        F.when(counted, F.col("n_alt")).alias("n_alt"),
        F.when(counted, F.col("ref")).alias("ref"),
        F.when(counted, F.col("alt")).alias("alt"),
        F.transform("gp", lambda g: F.round(g, 3)).alias("gp"),
        F.when(F.col("gp").isNotNull(), F.round("max_gp", 3)).alias("max_gp"),
        af.alias("af"),
        F.col("counts").alias("read_counts"),
        F.col("total").alias("depth"),
    )
    # The read counts are a map, which has no order, so only the sites are compared.
    by_site = lambda a, b: F.when(a["site_ord"] < b["site_ord"], -1).when(a["site_ord"] > b["site_ord"], 1).otherwise(0)
    listed = F.array_sort(F.collect_list(observed), by_site)
    return calls.where(F.col("found")).groupBy("sample_id", "locus").agg(
        F.transform(listed, lambda x: x.dropFields("site_ord")).alias("observed_variants")
    )
