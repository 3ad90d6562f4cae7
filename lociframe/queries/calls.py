"""Imputed-call queries: lineitem rows as calls, parts as catalogue and panel SNPs."""

from __future__ import annotations

from pyspark.sql import functions as F

from lociframe.functions import genotypes as gt
from lociframe.operators import catalogue as cat
from lociframe.queries.base import query, r, table

# A call per line item: two listed alternatives, a genotype by line number, posteriors from the discount.
CALLS = """
calls AS (
  SELECT l_returnflag AS sample_id, 'chr' || (l_partkey % 38 + 1) AS chrom, l_partkey AS pos,
    CASE WHEN l_linenumber = 6 THEN 'T' ELSE 'A' END AS ref, [l_linestatus, 'C'] AS alt, l_linestatus AS alt1,
    [l_tax, l_tax / 2] AS raf,
    ['0|0', '0|1', '1|1', './.', '1|2', '2|2', '1/0'][l_linenumber] AS gt,
    CASE WHEN l_quantity >= 3 THEN [0.5 - l_discount * 5, 0.5 - l_discount * 5, l_discount * 10] END AS gp,
    l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice
  FROM lineitem)"""
CATALOGUE = """
catalogue AS (
  SELECT p_partkey AS cat_id, 'chr' || (p_partkey % 38 + 1) AS chrom, CASE WHEN p_size <> 50 THEN p_partkey END AS pos,
    CASE WHEN p_size % 10 = 0 THEN 'AT' ELSE 'A' END AS ref, ['F', 'O', 'C', 'G'][p_size % 4 + 1] AS alt
  FROM part)"""
ORD = "l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice"
FOUND = f"""
found AS (
  SELECT cat_id, sample_id, gt, gp, raf[i] AS panel_af FROM (
    SELECT k.cat_id, c.*, list_position(c.alt, k.alt) AS i FROM calls c JOIN catalogue k
      ON c.chrom = k.chrom AND c.pos = k.pos AND c.ref = k.ref AND list_contains(c.alt, k.alt))
  QUALIFY row_number() OVER (PARTITION BY cat_id, sample_id ORDER BY {ORD}) = 1)"""


def calls(spark, sf):
    line = table(spark, sf, "lineitem")
    d = F.col("l_discount")
    codes = F.array(*[F.lit(g) for g in ("0|0", "0|1", "1|1", "./.", "1|2", "2|2", "1/0")])
    return line.select(
        F.col("l_returnflag").alias("sample_id"),
        F.concat(F.lit("chr"), F.col("l_partkey") % 38 + 1).alias("chrom"),
        F.col("l_partkey").alias("pos"),
        F.when(F.col("l_linenumber") == 6, "T").otherwise("A").alias("ref"),
        F.array("l_linestatus", F.lit("C")).alias("alt"),
        F.array("l_tax", F.col("l_tax") / 2).alias("raf"),
        F.element_at(codes, F.col("l_linenumber")).alias("gt"),
        F.when(F.col("l_quantity") >= 3, F.array(0.5 - d * 5, 0.5 - d * 5, d * 10)).alias("gp"),
        F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice").alias("ord"),
    )


def catalogue(spark, sf):
    alts = F.array(*[F.lit(a) for a in "FOCG"])
    return table(spark, sf, "part").select(
        F.col("p_partkey").alias("cat_id"),
        F.concat(F.lit("chr"), F.col("p_partkey") % 38 + 1).alias("chrom"),
        F.when(F.col("p_size") != 50, F.col("p_partkey")).alias("pos"),
        F.when(F.col("p_size") % 10 == 0, "AT").otherwise("A").alias("ref"),
        F.element_at(alts, F.col("p_size") % 4 + 1).alias("alt"),
    )


@query(
    "catalogue_lookup",
    f"WITH {CALLS}, {CATALOGUE}, {FOUND} SELECT cat_id, sample_id, gt, round(panel_af, 6) AS panel_af, "
    "round(list_max(gp), 6) AS max_gp FROM found",
)
def catalogue_lookup(spark, sf):
    out = cat.lookup_catalogue(catalogue(spark, sf), calls(spark, sf))
    return out.select("cat_id", "sample_id", "gt", r("panel_af").alias("panel_af"), r(F.array_max("gp")).alias("max_gp"))


CALLED = f"""
samples AS (SELECT l_returnflag AS sample_id, CASE l_returnflag WHEN 'A' THEN 9.96 WHEN 'N' THEN 9.94 ELSE 25.0 END AS mean_depth
  FROM lineitem GROUP BY 1),
piled AS (SELECT l_returnflag AS sample_id, l_partkey AS pos, count(*) AS total, count(*) FILTER (l_linestatus = 'F') AS n_f,
  count(*) FILTER (l_linestatus = 'O') AS n_o FROM lineitem GROUP BY ALL),
graded AS (
  SELECT s.sample_id, s.mean_depth, k.*, f.cat_id IS NOT NULL AS in_panel, f.gt, f.gp, round(COALESCE(list_max(f.gp), 0.0), 4) AS best,
    COALESCE(p.total, 0) AS total, CASE k.alt WHEN 'F' THEN COALESCE(n_f, 0) WHEN 'O' THEN COALESCE(n_o, 0) ELSE 0 END AS alt_count,
    length(k.ref) = 1 AND COALESCE(k.pos, 0) <> 0 AS snv
  FROM samples s CROSS JOIN catalogue k LEFT JOIN found f ON f.cat_id = k.cat_id AND f.sample_id = s.sample_id
  LEFT JOIN piled p ON p.sample_id = s.sample_id AND p.pos = k.pos),
called AS (
  SELECT *, CASE WHEN NOT snv THEN 'indel_no_call'
      WHEN in_panel AND best >= 0.9 THEN CASE gt WHEN '1|1' THEN 'alt/alt' WHEN '0|0' THEN 'ref/ref' ELSE 'het' END
      WHEN in_panel THEN 'low_gp_no_call'
      WHEN round(mean_depth, 1) >= 10 AND alt_count >= 5 THEN 'alt/alt'
      WHEN round(mean_depth, 1) >= 10 THEN 'no_call' ELSE 'not_in_panel' END AS zygosity,
    CASE WHEN NOT snv THEN 'indel' WHEN in_panel THEN 'panel_imputed'
      WHEN round(mean_depth, 1) >= 10 AND alt_count >= 5 THEN 'reads_direct'
      WHEN round(mean_depth, 1) >= 10 THEN 'not_in_panel_insufficient_reads'
      ELSE 'not_in_panel_low_coverage' END AS source FROM graded),
final AS (
  SELECT *, zygosity IN ('alt/alt', 'het') AS affected, CASE source
    WHEN 'panel_imputed' THEN CASE WHEN best >= 0.9 THEN 'high' ELSE 'low' END
    WHEN 'reads_direct' THEN CASE WHEN total >= 20 THEN 'high' WHEN total >= 10 THEN 'medium' ELSE 'low' END
    ELSE 'none' END AS call_confidence FROM called)"""


def called_inputs(spark, sf):
    line = table(spark, sf, "lineitem")
    samples = line.select(F.col("l_returnflag").alias("sample_id")).distinct().withColumn(
        "mean_depth", F.when(F.col("sample_id") == "A", 9.96).when(F.col("sample_id") == "N", 9.94).otherwise(25.0)
    )
    per_base = line.groupBy(
        F.col("l_returnflag").alias("sample_id"),
        F.concat(F.lit("chr"), F.col("l_partkey") % 38 + 1).alias("chrom"),
        F.col("l_partkey").alias("pos"),
        F.col("l_linestatus").alias("base"),
    ).agg(F.count(F.lit(1)).alias("n"))
    from lociframe.operators.reads import counts_map

    piled = counts_map(per_base, ["sample_id", "chrom", "pos"])
    return catalogue(spark, sf), calls(spark, sf), samples, piled


@query(
    "catalogue_genotypes",
    f"WITH {CALLS}, {CATALOGUE}, {FOUND}, {CALLED} SELECT sample_id, cat_id, zygosity, source, affected, call_confidence FROM final",
)
def catalogue_genotypes(spark, sf):
    called = cat.genotype_catalogue(*called_inputs(spark, sf))
    return called.select("sample_id", "cat_id", "zygosity", "source", "affected", "call_confidence")


@query(
    "catalogue_sparse_calls",
    f"""WITH {CALLS}, {CATALOGUE}, {FOUND}, {CALLED} SELECT sample_id, cat_id, zygosity, source, affected, call_confidence, total
FROM final WHERE in_panel OR (total > 0 AND pos IS NOT NULL)""",
)
def catalogue_sparse_calls(spark, sf):
    called = cat.sparse_catalogue(*called_inputs(spark, sf))
    return called.select("sample_id", "cat_id", "zygosity", "source", "affected", "call_confidence", F.col("total").cast("long").alias("total"))


@query(
    "catalogue_summary",
    f"""WITH {CALLS}, {CATALOGUE}, {FOUND}, {CALLED} SELECT sample_id, count(*) AS total_screened,
  count(*) FILTER (affected AND length(ref) = 1) AS affected_snv,
  count(*) FILTER (affected AND length(ref) = 1 AND call_confidence = 'high') AS affected_high_confidence,
  count(*) FILTER (source = 'indel') AS indel_unknown, count(*) FILTER (NOT affected AND length(ref) = 1) AS unaffected,
  count(*) FILTER (source = 'panel_imputed') AS in_panel, count(*) FILTER (source = 'reads_direct') AS called_from_reads,
  count(*) FILTER (starts_with(source, 'not_in_panel')) AS not_callable FROM final GROUP BY sample_id""",
)
def catalogue_summary(spark, sf):
    variants, found, samples, piled = called_inputs(spark, sf)
    sparse = cat.sparse_catalogue(variants, found, samples, piled)
    return cat.catalogue_summary(sparse, defaults=cat.default_calls(variants, sparse, samples))


SNPS = """
snps AS (SELECT p_partkey % 1500 AS pos, max(p_partkey) AS snp_idx, arg_max(p_size % 2 = 0, p_partkey) AS even
  FROM part GROUP BY 1),
panel AS (SELECT 'chr' || (pos % 38 + 1) AS chrom, pos, snp_idx, CASE WHEN even THEN 'A' ELSE 'F' END AS a1,
  CASE WHEN even THEN 'F' ELSE 'A' END AS a2 FROM snps)"""
MATCHED = f"""
matched AS (SELECT sample_id, snp_idx, a1, a2, ref, alt1, gp FROM calls JOIN panel USING (chrom, pos)
  WHERE ref IN (a1, a2) AND alt1 IN (a1, a2) AND len(gp) >= 3
  QUALIFY row_number() OVER (PARTITION BY sample_id, snp_idx ORDER BY {", ".join(c.strip() + " DESC" for c in ORD.split(","))}) = 1),
dosed AS (SELECT *, CASE WHEN ref = a1 THEN 2 * gp[1] + gp[2] ELSE gp[2] + 2 * gp[3] END AS dosage_a1,
  CASE WHEN alt1 = a2 THEN gp[2] + 2 * gp[3] ELSE 2 * gp[1] + gp[2] END AS dosage_a2 FROM matched)"""


def matched(spark, sf):
    even = F.col("p_size") % 2 == 0
    pos = F.col("p_partkey") % 1500
    snps = table(spark, sf, "part").select(
        (pos % 38 + 1).cast("string").alias("chrom"),
        pos.alias("pos"),
        F.col("p_partkey").alias("snp_idx"),
        F.when(even, "A").otherwise("F").alias("a1"),
        F.when(even, "F").otherwise("A").alias("a2"),
    )
    return cat.match_panel(snps, calls(spark, sf).withColumn("alt", F.get("alt", 0)))


@query(
    "panel_dosages",
    f"""WITH {CALLS}, {SNPS}, {MATCHED} SELECT sample_id, snp_idx, round(dosage_a1, 6) AS dosage_a1,
round(dosage_a2, 6) AS dosage_a2 FROM dosed""",
)
def panel_dosages(spark, sf):
    return matched(spark, sf).select(
        "sample_id",
        "snp_idx",
        r(gt.dosage_first(F.col("ref"), F.col("a1"), F.col("gp"))).alias("dosage_a1"),
        r(gt.dosage_second(F.col("alt"), F.col("a2"), F.col("gp"))).alias("dosage_a2"),
    )


@query(
    "panel_coverage",
    f"""WITH {CALLS}, {SNPS}, {MATCHED} SELECT sample_id, count(dosage_a1) AS snps_used,
round(100.0 * count(dosage_a1) / 1500, 6) AS pct_covered FROM dosed GROUP BY 1""",
)
def panel_coverage(spark, sf):
    rows = matched(spark, sf).withColumn("dosage", gt.dosage_first(F.col("ref"), F.col("a1"), F.col("gp")))
    return cat.panel_coverage(rows, 1500).withColumn("pct_covered", r("pct_covered"))


@query(
    "calls_at_sites",
    f"""WITH {CALLS}, {CATALOGUE} SELECT sample_id, chrom, count(*) AS n FROM calls SEMI JOIN
(SELECT chrom, pos FROM catalogue WHERE ref = 'AT') USING (chrom, pos) GROUP BY ALL""",
)
def calls_at_sites(spark, sf):
    sites = catalogue(spark, sf).where((F.col("ref") == "AT") & F.col("pos").isNotNull())
    return cat.restrict_to_sites(calls(spark, sf), sites).groupBy("sample_id", "chrom").agg(F.count(F.lit(1)).alias("n"))


@query(
    "zygosity_rules",
    f"""WITH {CALLS} SELECT sample_id, gt, count(*) AS n,
  CASE gt WHEN '1|1' THEN 'alt/alt' WHEN '0|0' THEN 'ref/ref' ELSE 'het' END AS strict,
  CASE WHEN gt IN ('0|0', './.') THEN NULL WHEN gt = '1|1' THEN 'hom_alt' WHEN gt IN ('0|1', '1/0') THEN 'het' ELSE 'other' END AS alt_rule,
  CASE WHEN gt <> './.' THEN gt IN ('0|1', '1|2', '1/0') END AS is_het, gt IN ('0|0', '1|1') AS is_hom,
  CAST(length(gt) - length(replace(gt, '1', '')) AS INTEGER) AS alt_copies,
  NOT contains(gt, '.') AND NOT contains(gt, '2') AS biallelic
FROM calls GROUP BY ALL""",
)
def zygosity_rules(spark, sf):
    counted = calls(spark, sf).groupBy("sample_id", "gt").agg(F.count(F.lit(1)).alias("n"))
    known = F.array(F.lit("0"), F.lit("1"))
    return counted.select(
        "sample_id", "gt", "n",
        gt.zygosity_strict("gt").alias("strict"),
        gt.zygosity_alt("gt").alias("alt_rule"),
        gt.is_het("gt").alias("is_het"),
        gt.is_hom_biallelic(F.col("gt")).alias("is_hom"),
        gt.alt_copies("gt").alias("alt_copies"),
        gt.allele_subset(gt.alleles("gt"), known).alias("biallelic"),
    )


@query(
    "posterior_gates",
    f"""WITH {CALLS}, g AS (SELECT sample_id, ref, alt1, gt, COALESCE(list_max(gp), 0.0) AS best FROM calls),
o AS (SELECT *, ref = 'T' AND alt1 = 'F' AS swapped, CAST(length(gt) - length(replace(gt, '1', '')) AS INTEGER) AS n1 FROM g)
SELECT sample_id, best >= 0.9 AS confident, CASE WHEN best >= 0.9 THEN 'high' WHEN best >= 0.8 THEN 'medium' ELSE 'low' END AS tier,
  swapped, CASE WHEN swapped THEN 2 - n1 ELSE n1 END AS n_alt, count(*) AS n FROM o GROUP BY ALL""",
)
def posterior_gates(spark, sf):
    """Gate, tier and orientation of every call; the expected alleles are F and T."""
    best = gt.max_posterior(F.col("gp"))
    swapped = gt.is_swapped(F.col("ref"), F.get("alt", 0), F.lit("F"), F.lit("T"))
    return (
        calls(spark, sf)
        .select(
            "sample_id",
            gt.passes_posterior(F.col("gp")).alias("confident"),
            gt.posterior_tier(best).alias("tier"),
            swapped.alias("swapped"),
            gt.oriented_copies(gt.alt_copies("gt"), swapped).alias("n_alt"),
        )
        .groupBy("sample_id", "confident", "tier", "swapped", "n_alt")
        .agg(F.count(F.lit(1)).alias("n"))
    )


@query(
    "dropped_keys",
    """SELECT event_id, 'level=' || (user_id % 3) || ',type=' || event_type AS kept FROM events""",
)
def dropped_keys(spark, sf):
    pairs = F.create_map(
        F.lit("private_k"), F.get_json_object("props", "$.k"), F.lit("level"), (F.col("user_id") % 3).cast("string"),
        F.lit("type"), F.col("event_type"),
    )
    rows = cat.drop_keys(table(spark, sf, "events").select("event_id", pairs.alias("m")), "m", ["private_k"])
    listed = F.transform(F.array_sort(F.map_entries("m")), lambda e: F.concat_ws("=", e["key"], e["value"]))
    return rows.select("event_id", F.array_join(listed, ",").alias("kept"))
