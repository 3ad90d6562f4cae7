"""Source queries: text lines and documents are built from the tables and read by the parsers."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import functions as F

from lociframe.functions.text import NBSP, clean_label, contains_any, is_autosome, is_fusion_name
from lociframe.queries.base import query, r, table
from lociframe.session import ensure_checkpoint_dir
from lociframe.sources import jsondocs, plink, tables, taxa, vcf


@query(
    "sample_sheet_defaults",
    """SELECT CAST(c_custkey AS VARCHAR) AS sample_id, CASE WHEN c_nationkey % 5 = 0 THEN NULL ELSE 'in/' || c_name END AS fastq_dir,
  CASE WHEN c_acctbal > 0 THEN c_acctbal END AS age, CASE WHEN c_nationkey % 2 = 0 THEN lower(CAST(c_custkey AS VARCHAR)) ELSE c_name END AS output_name,
  'work/' || c_custkey AS work_dir, 'public/' || CASE WHEN c_nationkey % 2 = 0 THEN lower(CAST(c_custkey AS VARCHAR)) ELSE c_name END AS pub_dir,
  CASE WHEN c_nationkey % 3 = 0 THEN 1 ELSE CAST(c_nationkey AS INTEGER) END AS from_stage,
  CASE WHEN c_nationkey % 5 = 0 THEN 'empty fastq_dir' END AS problem FROM customer""",
)
def sample_sheet_defaults(spark, sf):
    n = F.col("c_nationkey")
    sheet = table(spark, sf, "customer").select(
        F.col("c_custkey").cast("string").alias("sample_id"),
        F.when(n % 5 == 0, " ").otherwise(F.concat(F.lit("in/"), "c_name")).alias("fastq_dir"),
        F.when(F.col("c_acctbal") > 0, F.col("c_acctbal").cast("string")).otherwise("old").alias("age"),
        F.when(n % 2 == 0, "").otherwise(F.col("c_name")).alias("output_name"),
        F.lit(None).cast("string").alias("work_dir"),
        F.lit("").alias("pub_dir"),
        F.when(n % 3 == 0, "").otherwise(n.cast("string")).alias("from_stage"),
        F.lit("").alias("sex"),
        F.lit("").alias("notes"),
    )
    return tables.clean_sample_sheet(sheet).drop("sex", "notes")


@query(
    "contig_lines",
    """SELECT 'chr' || l_linenumber AS chrom, max(l_orderkey) AS length FROM lineitem WHERE l_linenumber < 7 GROUP BY 1
UNION ALL SELECT 'chrX', max(l_orderkey) FROM lineitem WHERE l_linenumber = 7""",
)
def contig_lines(spark, sf):
    """Index lines for numbered chromosomes, X and names out of scope."""
    lengths = table(spark, sf, "lineitem").groupBy("l_linenumber").agg(F.max("l_orderkey").alias("n"))
    names = F.array(F.when(F.col("l_linenumber") == 7, "chrX").otherwise(F.concat(F.lit("chr"), "l_linenumber")), F.concat(F.lit("chrUn_"), "l_linenumber"), F.lit("chrM"))
    lines = lengths.select(F.explode(names).alias("c"), "n").select(F.concat_ws("\t", "c", "n", F.lit("5"), F.lit("60")).alias("value"))
    return tables.parse_contigs(lines)


@query(
    "coverage_lines",
    """SELECT l_returnflag AS sample_id, 'chr' || (l_partkey % 38 + 1) AS chrom, count(*) AS n, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS bases,
  round(sum(CAST(l_quantity AS BIGINT) / (1.0 * l_linenumber - 1)), 4) AS depth
FROM lineitem WHERE l_linenumber > 1 GROUP BY ALL""",
)
def coverage_lines(spark, sf):
    """Zero-length windows and lines with three columns are dropped."""
    start = F.col("l_partkey") * 10
    short = F.concat_ws("\t", F.lit("chr1"), start, start)
    full = F.concat_ws("\t", F.concat(F.lit("chr"), F.col("l_partkey") % 38 + 1), start, start + F.col("l_linenumber") - 1, F.col("l_quantity").cast("long"))
    lines = table(spark, sf, "lineitem").select(
        F.col("l_returnflag").alias("sample_id"), F.explode(F.array(full, short)).alias("value")
    )
    parsed = tables.parse_coverage(lines, ["sample_id"])
    return parsed.groupBy("sample_id", "chrom").agg(
        F.count(F.lit(1)).alias("n"), F.sum("bases").alias("bases"), r(F.sum("depth"), 4).alias("depth")
    )


@query(
    "variant_lines",
    """SELECT l_orderkey AS ord, 'chr' || (l_partkey % 38 + 1) AS chrom, l_partkey AS pos, 'A' AS ref, l_linestatus AS alt,
  ['0|0', '0|1', '1|1', './.', '', '1|2', '0/1'][l_linenumber] AS gt,
  CASE WHEN l_linenumber <> 2 THEN l_linestatus || '|' || l_returnflag || '|x=1' ELSE '' END AS ann_text, CAST(l_suppkey AS VARCHAR) AS dp
FROM lineitem""",
)
def variant_lines(spark, sf):
    """Eight to ten columns, GT at different places of FORMAT, INFO entries with and without '='."""
    line = table(spark, sf, "lineitem")
    n = F.col("l_linenumber")
    codes = F.array(*[F.lit(g) for g in ("0|0", "0|1", "1|1", "./.", "", "1|2", "0/1")])
    ann = F.when(n != 2, F.concat(F.lit("ANN="), "l_linestatus", F.lit("|"), "l_returnflag", F.lit("|x=1"))).otherwise("FLAG")
    info = F.concat_ws(";", F.concat(F.lit("DP="), "l_suppkey"), F.lit("IMP"), ann)
    fixed = F.concat_ws("\t", F.concat(F.lit("chr"), F.col("l_partkey") % 38 + 1), "l_partkey", F.lit("."), F.lit("A"), "l_linestatus", F.lit("50"), F.lit("PASS"), info)
    gt = F.element_at(codes, n)
    tail = F.when(n == 5, F.lit("")).when(n % 2 == 0, F.concat(F.lit("\tGP:GT\t0,1,0:"), gt)).otherwise(F.concat(F.lit("\tGT:GP\t"), gt, F.lit(":0,1,0")))
    lines = line.select(
        F.col("l_orderkey").alias("ord"), F.explode(F.array(F.concat(F.lit("##"), fixed), F.concat(fixed, tail))).alias("value")
    )
    out = vcf.parse_vcf(lines, [])
    return out.select("ord", "chrom", "pos", "ref", "alt", "gt", "ann_text", F.element_at("info", "DP").alias("dp"))


@query(
    "call_lines",
    """SELECT l_orderkey AS ord, l_partkey AS pos, l_linestatus || ',C' AS alts, CASE WHEN l_linenumber <> 3 THEN l_discount END AS raf1,
  CASE WHEN l_linenumber <> 4 THEN round(l_tax, 4) END AS gp3 FROM lineitem""",
)
def call_lines(spark, sf):
    n = F.col("l_linenumber")
    raf = F.concat_ws(",", F.when(n == 3, ".").otherwise(F.col("l_discount").cast("string")), F.lit("0.5"))
    gp = F.concat_ws(",", F.lit("0.1"), F.when(n == 4, "x").otherwise("0.2"), F.col("l_tax").cast("string"))
    lines = table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("ord"),
        F.concat_ws("\t", F.lit("chr1"), "l_partkey", F.lit("A"), F.concat("l_linestatus", F.lit(",C")), raf, F.lit("0|1"), gp).alias("value"),
    )
    out = tables.project_calls(lines, [])
    return out.select("ord", "pos", F.array_join("alt", ",").alias("alts"), F.get("raf", 0).alias("raf1"), r(F.get("gp", 2), 4).alias("gp3"))


@query(
    "snp_list_lines",
    """SELECT p_partkey AS snp_idx, CAST(p_size AS VARCHAR) AS chrom, p_partkey * 3 AS pos, 'A' AS a1, 'G' AS a2 FROM part""",
)
def snp_list_lines(spark, sf):
    lines = table(spark, sf, "part").select(
        F.col("p_partkey").alias("ord"),
        F.concat_ws(" \t", "p_size", F.concat(F.lit("rs"), "p_partkey"), F.lit("0"), F.col("p_partkey") * 3, F.lit("A"), F.lit("G")).alias("value"),
    )
    return plink.parse_bim(lines)


@query(
    "individual_lines",
    "SELECT CAST(c_custkey AS INTEGER) AS ind_idx, c_mktsegment AS breed FROM customer",
)
def individual_lines(spark, sf):
    lines = table(spark, sf, "customer").select(
        F.col("c_custkey").alias("ord"), F.concat_ws(" ", "c_mktsegment", "c_name", F.lit("0 0 1 -9")).alias("value")
    )
    return plink.parse_fam(lines)


@query(
    "matrix_lines",
    """SELECT vec_id AS snp_idx, CAST(len(embedding) AS INTEGER) AS k, round(list_sum(list_transform(embedding, lambda e : CAST(e AS DOUBLE))), 4) AS total FROM embeddings""",
)
def matrix_lines(spark, sf):
    text = F.array_join(F.transform("embedding", lambda e: e.cast("double").cast("string")), "  ")
    lines = table(spark, sf, "embeddings").select(F.col("vec_id").alias("ord"), text.alias("value"))
    out = tables.parse_matrix(lines)
    return out.select("snp_idx", F.size("p").alias("k"), r(F.aggregate("p", F.lit(0.0), lambda a, x: a + x), 4).alias("total"))


@query(
    "frequency_lines",
    """SELECT l_orderkey AS ord, l_partkey AS pos, CASE WHEN l_linenumber <> 1 THEN l_discount END AS af FROM lineitem""",
)
def frequency_lines(spark, sf):
    af = F.when(F.col("l_linenumber") == 1, ".").otherwise(F.concat(F.col("l_discount").cast("string"), F.lit(",0.01")))
    lines = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("ord"), F.concat_ws("\t", F.lit("chr1"), "l_partkey", af).alias("value"))
    return tables.parse_panel_af(lines).drop("chrom")


@query("reference_f_lines", "SELECT c_name AS ref_id, c_acctbal AS f_value FROM customer WHERE c_custkey > 0")
def reference_f_lines(spark, sf):
    """Line 0 is the header; a short line follows each full one."""
    full = F.concat_ws("  ", "c_name", F.lit("10 20.5"), F.lit("30"), F.col("c_acctbal").cast("string"))
    short = F.concat_ws(" ", "c_name", F.lit("10 20.5"))
    lines = table(spark, sf, "customer").select(F.col("c_custkey").alias("ord"), F.explode(F.array(full, short)).alias("value"))
    return tables.parse_ref_f(lines)


@query(
    "melted_traits",
    """SELECT p_name || ' ' || p_partkey AS breed_name, 'Shedding Level' AS trait, CAST(p_size AS VARCHAR) AS value FROM part
UNION ALL SELECT p_name || ' ' || p_partkey, 'Energy Level', p_brand FROM part WHERE p_size <> 7""",
)
def melted_traits(spark, sf):
    """No-break spaces become spaces, empty values and missing columns give no row."""
    name = F.concat(F.lit(" "), F.translate("p_name", " ", NBSP), F.lit(NBSP), F.col("p_partkey"), F.lit(NBSP))
    wide = table(spark, sf, "part").select(
        name.alias("Breed"),
        F.col("p_size").cast("string").alias("Shedding Level"),
        F.when(F.col("p_size") == 7, NBSP).otherwise(F.col("p_brand")).alias("Energy Level"),
    )
    return tables.melt_traits(wide, ["Shedding Level", "Drooling Level", "Energy Level"])


@query(
    "read_statistics",
    """SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS total_reads_raw, round(value / 1e9, 12) AS total_bases_raw_gb, round(value, 4) AS pct_q30_raw,
  CASE WHEN user_id % 2 = 0 THEN 150.0::DOUBLE ELSE 140.0 END AS read_length_bp FROM events""",
)
def read_statistics(spark, sf):
    length = F.when(F.col("user_id") % 2 == 0, '"read1_mean_length": 150, "read_mean_length": 1').otherwise('"read_mean_length": 140')
    doc = F.concat(
        F.lit('{"summary": {"before_filtering": {"total_reads": '), F.get_json_object("props", "$.k"), F.lit(', "total_bases": '), "value",
        F.lit(', "q30_rate": '), F.col("value") / 100, F.lit(", "), length, F.lit("}}}"),
    )
    out = jsondocs.extract_read_stats(table(spark, sf, "events").select("event_id", doc.alias("json")))
    return out.select("event_id", "total_reads_raw", r("total_bases_raw_gb", 12).alias("total_bases_raw_gb"), r("pct_q30_raw", 4).alias("pct_q30_raw"), "read_length_bp")


@query(
    "flag_summary_lines",
    """SELECT c_nationkey AS sample_id, max(c_custkey) AS reads_mapped, max(c_custkey + 7) AS primary_duplicates FROM customer GROUP BY 1""",
)
def flag_summary_lines(spark, sf):
    k = F.col("c_custkey")
    texts = F.array(
        F.concat(k, F.lit(" + 0 primary mapped (99.1% : N/A)")), F.concat(k + 7, F.lit(" + 0 primary duplicates")),
        F.concat(k * 9, F.lit(" + 0 mapped (98% : N/A)")), F.concat(k * 5, F.lit(" + 0 primary")),
    )
    lines = table(spark, sf, "customer").select(F.col("c_nationkey").alias("sample_id"), F.explode(texts).alias("value"))
    return jsondocs.parse_flag_summary(lines)


@query(
    "lane_order",
    """WITH x AS (SELECT DISTINCT 's_L' || (c_nationkey + 1) || '_R1_a.fq' AS lane, c_nationkey + 1 AS n FROM customer)
SELECT lane, CAST(row_number() OVER (ORDER BY n) - 1 AS INTEGER) AS lane_no, (SELECT count(*) FROM customer WHERE c_nationkey + 1 = n) AS n_lines FROM x""",
)
def lane_order(spark, sf):
    rows = table(spark, sf, "customer").select(F.concat(F.lit("s_L"), F.col("c_nationkey") + 1, F.lit("_R1_a.fq")).alias("lane"), F.col("c_name").alias("value"))
    return tables.with_lane_order(rows).groupBy("lane", "lane_no").agg(F.count("value").alias("n_lines"))


@query(
    "chunk_lines",
    """SELECT 'chr' || (c_nationkey + 1) AS chrom, CAST(c_custkey AS INTEGER) AS chunk_id, 'chr' || (c_nationkey + 1) || '_chunk' || c_custkey AS chunk_key
FROM customer""",
)
def chunk_lines(spark, sf):
    chrom = F.concat(F.lit("chr"), F.col("c_nationkey") + 1)
    lines = table(spark, sf, "customer").select(
        F.concat_ws("\t", "c_custkey", chrom, F.concat(chrom, F.lit(":1-2000000")), F.concat(chrom, F.lit(":1-1500000"))).alias("value")
    )
    return tables.parse_chunks(lines).select("chrom", "chunk_id", "chunk_key")


@query(
    "json_documents",
    """SELECT event_type, count(*) AS n, CAST(sum(CAST(json_extract(props, '$.k') AS BIGINT)) AS BIGINT) AS k FROM events GROUP BY 1""",
)
def json_documents(spark, sf):
    parsed = table(spark, sf, "events").select("event_type", F.from_json("props", "k bigint").alias("p"))
    return parsed.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("p.k").alias("k"))


@query(
    "json_reference_files",
    """SELECT event_type, count(*) AS n, CAST(sum(CAST(json_extract(props, '$.k') AS BIGINT)) AS BIGINT) AS k FROM events GROUP BY 1""",
)
def json_reference_files(spark, sf):
    """Events as JSON files, one array of neighbouring ids each, in the shared folder; the first path does not exist."""
    parsed = F.struct("event_type", F.from_json("props", "k bigint").alias("props"))
    arrays = table(spark, sf, "events").groupBy(F.floor(F.col("event_id") / 20_000).alias("part")).agg(F.to_json(F.collect_list(parsed)).alias("value"))
    target = f"{ensure_checkpoint_dir(spark)}/json-{uuid4().hex}"
    arrays.repartition("part").write.partitionBy("part").text(target)
    docs = jsondocs.read_json_or_empty(spark, [f"{target}-missing", target], "event_type string, props struct<k: bigint>")
    return docs.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("props.k").alias("k"))


_CLADES = ("k__B|g__Alpha", "k__B|g__Alpha|s__one", "k__B|g__Beta|s__two", "k__B|g__Beta|s__two|t__x")


@query(
    "wide_reference_melted",
    " UNION ALL ".join(
        f"SELECT c_custkey AS ref_id, CAST(c_nationkey AS DOUBLE) AS age, '{c}' AS clade, CAST({i + 2} AS INTEGER) AS feature_ord, "
        f"round(CAST(c_acctbal AS DOUBLE) * {i + 1}, 2) AS abundance, {str('|s__' in c and '|t__' not in c).lower()} AS species, "
        f"{str('|s__' not in c).lower()} AS genus FROM customer"
        for i, c in enumerate(_CLADES)
    ),
)
def wide_reference_melted(spark, sf):
    """Customers as reference samples: an age column and one column per clade."""
    values = [F.round(F.col("c_acctbal").cast("double") * (i + 1), 2).alias(c) for i, c in enumerate(_CLADES)]
    wide = table(spark, sf, "customer").select(F.col("c_custkey").alias("ref_id"), F.col("c_nationkey").alias("Age"), *values)
    refs, long = taxa.melt_reference(wide)
    marked = long.withColumns({"species": taxa.is_species(F.col("clade")), "genus": taxa.is_genus(F.col("clade"))})
    return refs.join(marked, "ref_id").select("ref_id", "age", "clade", "feature_ord", "abundance", "species", "genus")


@query(
    "term_filter",
    """SELECT source, lang, count(*) FILTER (regexp_matches(text, 'the|tion|eaux')) AS with_term, count(*) FILTER (contains(text, 'thand')) AS with_fragment, count(*) AS n
FROM documents GROUP BY ALL""",
)
def term_filter(spark, sf):
    """Substring tests over whole texts."""
    text = F.col("text")
    return table(spark, sf, "documents").groupBy("source", "lang").agg(
        F.count_if(contains_any(text, ["the", "tion", "eaux"])).alias("with_term"),
        F.count_if(text.contains("thand")).alias("with_fragment"),
        F.count(F.lit(1)).alias("n"),
    )


@query(
    "name_filters",
    """WITH x AS (SELECT c_custkey, 'chr' || (c_custkey % 45) AS chrom, c_mktsegment || '-' || CASE WHEN c_nationkey % 2 = 0 THEN 'ABCDE' ELSE 'AB' END AS gene FROM customer)
SELECT c_custkey, (c_custkey % 45) BETWEEN 1 AND 38 AS autosome, length(split_part(gene, '-', 1)) > 4 AND contains(gene, '-ABCDE') AS fusion, trim(gene) AS label FROM x""",
)
def name_filters(spark, sf):
    gene = F.concat("c_mktsegment", F.lit("-"), F.when(F.col("c_nationkey") % 2 == 0, "ABCDE").otherwise("AB"))
    rows = table(spark, sf, "customer").select("c_custkey", F.concat(F.lit("chr"), F.col("c_custkey") % 45).alias("chrom"), gene.alias("gene"))
    return rows.select(
        "c_custkey", is_autosome(F.col("chrom")).alias("autosome"), is_fusion_name(F.col("gene")).alias("fusion"),
        clean_label(F.concat(F.lit(" "), "gene")).alias("label"),
    )
