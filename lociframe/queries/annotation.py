"""Annotation queries: `ANN`-shaped texts are built from lineitem, parsed back and summarised."""

from __future__ import annotations

from decimal import Decimal
from functools import reduce

from pyspark.sql import functions as F

from lociframe.operators import annotation as ann
from lociframe.queries.base import query, table

EFFECTS = ["missense_variant&splice_region_variant", "stop_gained", "intron_variant", "frameshift_variant", "3_prime_UTR_variant"]
IMPACTS = ["MODERATE", "HIGH", "MODIFIER", "HIGH", "MODERATE"]
GENES = ["'BRCA' || (l_partkey % 7)", "CASE WHEN l_suppkey % 5 = 0 THEN 'ABCDE-FGHIJ' ELSE 'TP' || (l_suppkey % 11) END"]

_e = "['" + "', '".join(EFFECTS) + "']"
_i = "['" + "', '".join(IMPACTS) + "']"
ROWS = f"""
variants AS (
  SELECT l_returnflag AS sample_id, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice,
    'chr' || (l_partkey % 38 + 1) AS chrom, l_partkey AS pos, 'A' AS ref, l_linestatus AS alt,
    ['0|0', '0|1', '1|1', './.', '1|2', '', '1/0'][l_linenumber] AS gt, l_tax AS af
  FROM lineitem),
anns AS (
  SELECT *, 0 AS ann_idx, {_e}[l_suppkey % 5 + 1] AS effect, {_i}[l_suppkey % 5 + 1] AS impact, {GENES[0]} AS gene_name,
    'ENS' || (l_partkey % 7) AS gene_id, alt AS allele FROM variants
  UNION ALL
  SELECT *, 1, {_e}[l_partkey % 5 + 1], {_i}[l_partkey % 5 + 1], {GENES[0]}, 'ENS' || (l_partkey % 7),
    CASE WHEN l_suppkey % 3 = 0 THEN 'Z' ELSE alt END FROM variants
  UNION ALL
  SELECT *, 2, {_e}[(l_partkey + l_suppkey) % 5 + 1], {_i}[(l_partkey + l_suppkey) % 5 + 1], {GENES[1]},
    'ENT' || (l_suppkey % 11), alt FROM variants)"""
ORD = "l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, ann_idx"
BEST = f"""
carried AS (SELECT *, CASE WHEN gt = '1|1' THEN 'hom_alt' WHEN gt IN ('0|1', '1/0') THEN 'het' ELSE 'other' END AS zygosity
  FROM anns WHERE gt NOT IN ('0|0', './.') AND impact IN ('HIGH', 'MODERATE') AND allele = alt AND gene_name <> ''),
best AS (SELECT * FROM carried QUALIFY row_number() OVER (
  PARTITION BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, gene_name
  ORDER BY CASE impact WHEN 'HIGH' THEN 0 ELSE 1 END, ann_idx) = 1),
dedup AS (SELECT * EXCLUDE (af) FROM best QUALIFY row_number() OVER (
  PARTITION BY sample_id, chrom, pos, ref, alt, gene_name, impact ORDER BY {ORD}) = 1),
freq AS (SELECT sample_id, chrom, pos, alt, af FROM variants WHERE l_linenumber <> 3 QUALIFY row_number() OVER (
  PARTITION BY sample_id, chrom, pos, alt
  ORDER BY l_orderkey DESC, l_linenumber DESC, l_partkey DESC, l_suppkey DESC, l_extendedprice DESC) = 1),
effects AS (SELECT d.*, f.af, split_part(effect, '&', 1) AS base_effect
  FROM dedup d LEFT JOIN freq f USING (sample_id, chrom, pos, alt))"""


def ordinal():
    """A number that orders lines by order, line, part, supplier and price: eleven digits of the order, one of the line, nine
    of the part, eight of the supplier, nine of the cents. They fill a decimal; the parts are decimals before they are
    put together, as a long ends at a part of 922,337 and a supplier of five digits."""

    def digits(col, n, behind):
        return col.cast(f"decimal({n},0)") * F.lit(Decimal(10**behind))

    cents = F.round(F.col("l_extendedprice") * 100)
    parts = ("l_orderkey", 11, 27), ("l_linenumber", 1, 26), ("l_partkey", 9, 17), ("l_suppkey", 8, 9)
    shifted = [digits(F.col(c), n, behind).cast("decimal(38,0)") for c, n, behind in parts]
    return reduce(lambda a, b: (a + b).cast("decimal(38,0)"), shifted + [cents.cast("decimal(9,0)")])


def variants(spark, sf):
    """Lines of annotated calls with the annotation as text."""
    line = table(spark, sf, "lineitem")
    effects, impacts = (F.array(*[F.lit(x) for x in xs]) for xs in (EFFECTS, IMPACTS))
    codes = F.array(*[F.lit(g) for g in ("0|0", "0|1", "1|1", "./.", "1|2", "", "1/0")])
    part, supp = F.col("l_partkey"), F.col("l_suppkey")

    def one(allele, pick, gene, gene_id):
        i = (pick % 5).cast("int")
        return F.concat_ws("|", allele, F.get(effects, i), F.get(impacts, i), gene, gene_id, F.lit("transcript"), F.lit("TX"), F.lit("protein_coding"))

    alt = F.col("l_linestatus")
    first_gene, first_id = F.concat(F.lit("BRCA"), part % 7), F.concat(F.lit("ENS"), part % 7)
    other = F.when(supp % 5 == 0, "ABCDE-FGHIJ").otherwise(F.concat(F.lit("TP"), supp % 11))
    text = F.concat_ws(
        ",",
        one(alt, supp, first_gene, first_id),
        one(F.when(supp % 3 == 0, "Z").otherwise(alt), part, first_gene, first_id),
        one(alt, part + supp, other, F.concat(F.lit("ENT"), supp % 11)),
    )
    return line.select(
        F.col("l_returnflag").alias("sample_id"),
        F.concat(F.lit("chr"), part % 38 + 1).alias("chrom"),
        part.alias("pos"),
        F.lit("A").alias("ref"),
        alt.alias("alt"),
        F.element_at(codes, F.col("l_linenumber")).alias("gt"),
        ordinal().alias("ord"),
        text.alias("ann_text"),
        F.when(F.col("l_linenumber") != 3, F.col("l_tax")).alias("af"),
    )


def effects(spark, sf):
    rows = variants(spark, sf)
    return ann.functional_effects(rows.drop("af"), rows.select("sample_id", "chrom", "pos", "alt", "af", "ord"))


@query(
    "annotation_parse",
    f"""WITH {ROWS} SELECT sample_id, impact, effect, gene_name, gene_id, allele, CAST(ann_idx AS INTEGER) AS ann_idx,
'protein_coding' AS biotype, count(*) AS n FROM anns GROUP BY ALL""",
)
def annotation_parse(spark, sf):
    keys = ["sample_id", "impact", "effect", "gene_name", "gene_id", "allele", "ann_idx", "biotype"]
    return ann.explode_annotations(variants(spark, sf)).groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))


@query(
    "best_effects",
    f"""WITH {ROWS}, {BEST} SELECT sample_id, chrom, pos, ref, alt, gene_name, impact, effect, zygosity, af FROM effects""",
)
def best_effects(spark, sf):
    return effects(spark, sf).select("sample_id", "chrom", "pos", "ref", "alt", "gene_name", "impact", "effect", "zygosity", "af")


@query(
    "gene_extents",
    f"""WITH {ROWS}, g AS (SELECT * FROM anns WHERE NOT regexp_matches(gene_name, '^[^-]{{5,}}-[^-]{{5,}}$'))
SELECT sample_id, gene_id, arg_min(gene_name, o) AS name, arg_min(chrom, o) AS chrom, min(pos) AS start, max(pos) AS "end",
  'protein_coding' AS biotype, '+' AS strand FROM (SELECT *, ROW({ORD}) AS o FROM g) GROUP BY sample_id, gene_id""",
)
def gene_extents(spark, sf):
    return ann.gene_extents(ann.explode_annotations(variants(spark, sf))).drop("gene_ord")


@query(
    "exonic_points",
    f"""WITH {ROWS} SELECT sample_id, gene_id, count(DISTINCT pos) AS n FROM anns
WHERE gene_name <> 'ABCDE-FGHIJ' AND regexp_matches(effect, 'missense_variant|stop_gained|frameshift_variant|3_prime_UTR_variant') GROUP BY ALL""",
)
def exonic_points(spark, sf):
    return ann.exonic_points(ann.explode_annotations(variants(spark, sf))).groupBy("sample_id", "gene_id").agg(F.count("pos").alias("n"))


@query(
    "high_effect_counts",
    f"WITH {ROWS}, {BEST} SELECT sample_id, base_effect, count(*) AS n FROM effects WHERE impact = 'HIGH' GROUP BY ALL",
)
def high_effect_counts(spark, sf):
    return ann.effect_counts(effects(spark, sf))


@query(
    "moderate_by_gene",
    f"""WITH {ROWS}, {BEST}, m AS (SELECT *, ROW({ORD}) AS o FROM effects WHERE impact = 'MODERATE'),
e AS (SELECT sample_id, gene_name, base_effect, min(o) AS o FROM m GROUP BY ALL),
l AS (SELECT sample_id, gene_name, string_agg(base_effect, ',' ORDER BY o) AS effects FROM e GROUP BY ALL)
SELECT sample_id, gene_name, count(*) AS n_moderate, count(*) FILTER (zygosity = 'hom_alt') AS hom_alt,
  count(*) FILTER (zygosity = 'het') AS het, any_value(effects) AS effects, min(af) FILTER (zygosity = 'hom_alt') AS min_af
FROM m JOIN l USING (sample_id, gene_name) GROUP BY sample_id, gene_name""",
)
def moderate_by_gene(spark, sf):
    rows = ann.order_moderate(ann.moderate_by_gene(effects(spark, sf)))
    return rows.drop("first_seen").withColumn("effects", F.array_join("effects", ","))


@query(
    "impact_summary",
    f"""WITH {ROWS}, {BEST} SELECT sample_id, count(*) FILTER (impact = 'HIGH') AS high_total,
  count(*) FILTER (impact = 'HIGH' AND zygosity = 'hom_alt') AS high_hom_alt,
  count(*) FILTER (impact = 'HIGH' AND zygosity = 'het') AS high_het,
  count(*) FILTER (impact = 'HIGH' AND zygosity = 'hom_alt' AND af < 0.01) AS high_hom_rare_1pct,
  count(*) FILTER (impact = 'HIGH' AND zygosity = 'hom_alt' AND af < 0.05) AS high_hom_rare_5pct,
  count(*) FILTER (impact = 'HIGH' AND zygosity = 'hom_alt' AND af < 0.10) AS high_hom_rare_10pct,
  count(*) FILTER (impact = 'MODERATE') AS moderate_total,
  count(*) FILTER (impact = 'MODERATE' AND zygosity = 'hom_alt') AS moderate_hom_alt,
  count(*) FILTER (impact = 'MODERATE' AND zygosity = 'het') AS moderate_het FROM effects GROUP BY sample_id""",
)
def impact_summary(spark, sf):
    return ann.impact_summary(effects(spark, sf))


@query(
    "high_variants_ordered",
    f"""WITH {ROWS}, {BEST} SELECT sample_id, chrom, pos, alt, gene_name, zygosity, af FROM effects WHERE impact = 'HIGH'
ORDER BY CASE zygosity WHEN 'hom_alt' THEN 0 ELSE 1 END, COALESCE(af, 1.0), {ORD}""",
)
def high_variants_ordered(spark, sf):
    return ann.order_high(effects(spark, sf)).select("sample_id", "chrom", "pos", "alt", "gene_name", "zygosity", "af")


@query(
    "frequency_attached",
    f"""WITH {ROWS}, {BEST}, w AS (SELECT sample_id, chrom, pos, alt, count(*) AS n FROM variants GROUP BY ALL)
SELECT w.*, f.af FROM w LEFT JOIN freq f USING (sample_id, chrom, pos, alt)""",
)
def frequency_attached(spark, sf):
    rows = variants(spark, sf)
    sites = rows.groupBy("sample_id", "chrom", "pos", "alt").agg(F.count(F.lit(1)).alias("n"))
    return ann.attach_af(sites, rows.select("sample_id", "chrom", "pos", "alt", "af", "ord"))
