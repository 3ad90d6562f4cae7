"""Read-level queries: lineitem rows as reads, documents as copies, customers and orders as work lists."""

from __future__ import annotations

from pyspark.sql import functions as F

from lociframe.operators import reads as rd
from lociframe.queries.base import query, r, table
from lociframe.sources.jsondocs import fragment_histogram

# Reads: position = part key, four to seven bases spelled from the supplier key, one quality per base.
READS = """
reads AS (
  SELECT l_returnflag AS sample_id, l_orderkey * 10 + l_linenumber AS read_id, (l_orderkey * 7 + l_suppkey) % 4096 AS flag,
    'chr' || (l_partkey % 3 + 1) AS chrom, l_partkey AS pos, l_partkey + 2 + l_linenumber AS "end",
    CAST(l_quantity AS INTEGER) AS mapq,
    substr(translate(lpad(CAST(l_suppkey AS VARCHAR), 5, '0') || CAST(l_orderkey AS VARCHAR) || '0000000', '0123456789', 'ACGTACGTGC'),
      1, l_linenumber + 3) AS seq,
    l_orderkey, l_suppkey, l_linenumber, l_extendedprice
  FROM lineitem)"""


def reads(spark, sf):
    line = table(spark, sf, "lineitem")
    spelled = F.translate(
        F.concat(F.lpad(F.col("l_suppkey").cast("string"), 5, "0"), F.col("l_orderkey").cast("string"), F.lit("0000000")),
        "0123456789",
        "ACGTACGTGC",
    )
    n = F.col("l_linenumber") + 3
    return line.select(
        F.col("l_returnflag").alias("sample_id"),
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("read_id"),
        ((F.col("l_orderkey") * 7 + F.col("l_suppkey")) % 4096).alias("flag"),
        F.concat(F.lit("chr"), F.col("l_partkey") % 3 + 1).alias("chrom"),
        F.col("l_partkey").alias("pos"),
        (F.col("l_partkey") + 2 + F.col("l_linenumber")).alias("end"),
        F.col("l_quantity").cast("int").alias("mapq"),
        F.substr(spelled, F.lit(1), n).alias("seq"),
        F.transform(F.sequence(F.lit(1), n), lambda i: ((F.col("l_orderkey") + i * F.col("l_suppkey")) % 41).cast("int")).alias("qual"),
    )


@query(
    "site_pileup",
    f"""WITH {READS},
sites AS (SELECT DISTINCT 'chr' || (p_partkey % 3 + 1) AS chrom, p_partkey AS pos FROM part),
hits AS (SELECT sample_id, r.chrom, s.pos, read_id, flag, substr(seq, CAST(s.pos - r.pos + 1 AS INTEGER), 1) AS base,
    (l_orderkey + (s.pos - r.pos + 1) * l_suppkey) % 41 AS bq
  FROM reads r JOIN sites s ON r.chrom = s.chrom AND s.pos BETWEEN r.pos AND r."end"
  WHERE mapq >= 20 AND flag & 1796 = 0 AND (flag & 1 = 0 OR flag & 2 <> 0)),
once AS (SELECT * FROM hits WHERE bq >= 20 AND base <> ''
  QUALIFY row_number() OVER (PARTITION BY sample_id, chrom, pos, read_id ORDER BY bq DESC, flag, base) = 1)
SELECT sample_id, chrom, pos, count(*) AS total, count(*) FILTER (base = 'A') AS n_a, count(*) FILTER (base = 'C') AS n_c,
  count(*) FILTER (base = 'G') AS n_g, count(*) FILTER (base = 'T') AS n_t
FROM once GROUP BY ALL""",
)
def site_pileup(spark, sf):
    sites = table(spark, sf, "part").select(
        F.concat(F.lit("chr"), F.col("p_partkey") % 3 + 1).alias("chrom"), F.col("p_partkey").alias("pos")
    )
    piled = rd.pileup(reads(spark, sf), sites)
    return piled.select(
        "sample_id", "chrom", "pos", "total",
        *[rd.base_count(F.col("counts"), F.lit(b)).alias(f"n_{b.lower()}") for b in "ACGT"],
    )


@query(
    "read_flag_summary",
    f"""WITH {READS} SELECT sample_id, count(*) AS total, count(*) FILTER (flag & 2304 = 0) AS "primary",
  count(*) FILTER (flag & 256 <> 0) AS secondary, count(*) FILTER (flag & 2048 <> 0) AS supplementary,
  count(*) FILTER (flag & 1024 <> 0) AS duplicates,
  count(*) FILTER (flag & 2304 = 0 AND flag & 1024 <> 0) AS primary_duplicates,
  count(*) FILTER (flag & 4 = 0) AS mapped, count(*) FILTER (flag & 2304 = 0 AND flag & 4 = 0) AS primary_mapped,
  round(100.0 * count(*) FILTER (flag & 2304 = 0 AND flag & 1024 <> 0) / count(*) FILTER (flag & 2304 = 0), 6)
    AS duplication_rate_pct
FROM reads GROUP BY sample_id""",
)
def read_flag_summary(spark, sf):
    flags = rd.flag_summary(reads(spark, sf))
    return rd.duplication_rate(flags, F.col("primary")).withColumn("duplication_rate_pct", r("duplication_rate_pct"))


@query("unmapped_reads", f"WITH {READS} SELECT sample_id, chrom, count(*) AS n FROM reads WHERE flag & 4 <> 0 GROUP BY ALL")
def unmapped_reads(spark, sf):
    return rd.unmapped_reads(reads(spark, sf)).groupBy("sample_id", "chrom").agg(F.count(F.lit(1)).alias("n"))


@query(
    "cleaned_reads",
    """WITH x AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
    repeat(translate(lpad(CAST(l_suppkey AS VARCHAR), 5, '0'), '0123456789', 'ACGTACGTGC'), 7) || repeat(
      CASE l_linenumber WHEN 1 THEN 'G' WHEN 2 THEN 'A' WHEN 3 THEN 'CT' ELSE 'T' END, CAST(l_quantity AS INTEGER)) AS raw
  FROM lineitem),
y AS (SELECT *, regexp_replace(regexp_replace(raw, 'G{10,}$', ''), '(A{10,}|C{10,}|T{10,}|N{10,})$', '') AS seq FROM x),
z AS (SELECT *, len(list_filter(range(1, length(seq) + 1), lambda i : (l_orderkey + i * l_partkey) % 41 < 20)) AS bad FROM y)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, seq, CAST(length(seq) AS INTEGER) AS n FROM z
WHERE length(seq) >= 36 AND 1.0 * bad / length(seq) <= 0.4""",
)
def cleaned_reads(spark, sf):
    line = table(spark, sf, "lineitem")
    body = F.translate(F.lpad(F.col("l_suppkey").cast("string"), 5, "0"), "0123456789", "ACGTACGTGC")
    tail = (
        F.when(F.col("l_linenumber") == 1, "G").when(F.col("l_linenumber") == 2, "A").when(F.col("l_linenumber") == 3, "CT").otherwise("T")
    )
    raw = F.concat(F.repeat(body, F.lit(7)), F.repeat(tail, F.col("l_quantity").cast("int")))
    built = line.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", raw.alias("seq")).withColumn(
        "qual",
        F.transform(F.sequence(F.lit(1), F.length("seq")), lambda i: ((F.col("l_orderkey") + i * F.col("l_partkey")) % 41).cast("int")),
    )
    return rd.clean_reads(built).drop("qual").withColumn("n", F.length("seq"))


@query(
    "marked_duplicates",
    """SELECT doc_id, row_number() OVER (PARTITION BY text ORDER BY n_chars DESC, doc_id) > 1 AS is_duplicate FROM documents""",
)
def marked_duplicates(spark, sf):
    """Exact copies of a text keep one unmarked row."""
    docs = table(spark, sf, "documents").select("doc_id", "n_chars", F.sha2("text", 256).alias("signature"))
    return rd.mark_duplicates(docs, ["signature"], "n_chars", "doc_id").select("doc_id", "is_duplicate")


@query(
    "marked_read_duplicates",
    """WITH r AS (SELECT l_partkey, l_shipdate, l_returnflag, l_extendedprice, concat_ws('/', l_orderkey, l_linenumber, l_partkey,
  l_suppkey, CAST(round(l_extendedprice * 100) AS BIGINT)) AS read_id FROM lineitem)
SELECT read_id, row_number() OVER (PARTITION BY l_partkey, l_shipdate, l_returnflag
  ORDER BY l_extendedprice DESC, read_id) > 1 AS is_duplicate FROM r""",
)
def marked_read_duplicates(spark, sf):
    """Same position, day and flag: the read with the highest price stays unmarked."""
    cents = F.round(F.col("l_extendedprice") * 100).cast("long")
    read_id = F.concat_ws("/", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", cents)
    line = table(spark, sf, "lineitem").select("l_partkey", "l_shipdate", "l_returnflag", "l_extendedprice", read_id.alias("read_id"))
    out = rd.mark_duplicates(line, ["l_partkey", "l_shipdate", "l_returnflag"], "l_extendedprice")
    return out.select("read_id", "is_duplicate")


@query(
    "genotypes_from_counts",
    """WITH c AS (SELECT l_partkey, count(*) AS total, count(*) FILTER (l_returnflag = 'N') AS ref_count,
  count(*) FILTER (l_returnflag = 'R') AS alt_count FROM lineitem GROUP BY l_partkey)
SELECT l_partkey, total, ref_count, alt_count,
  CASE WHEN total >= 5 AND ref_count + alt_count >= 5 THEN
    CASE WHEN 1.0 * alt_count / (ref_count + alt_count) < 0.1 THEN 'ref/ref'
         WHEN 1.0 * alt_count / (ref_count + alt_count) > 0.9 THEN 'alt/alt' ELSE 'het' END END AS read_zygosity,
  CASE WHEN total >= 5 AND ref_count + alt_count >= 5 THEN
    CASE WHEN total >= 20 THEN 'high' WHEN total >= 10 THEN 'medium' ELSE 'low' END END AS read_confidence,
  CASE WHEN total >= 15 THEN 'medium' WHEN total >= 5 THEN 'low' ELSE 'none' END AS tier
FROM c""",
)
def genotypes_from_counts(spark, sf):
    per_base = table(spark, sf, "lineitem").groupBy("l_partkey", F.col("l_returnflag").alias("base")).agg(F.count(F.lit(1)).alias("n"))
    counts = rd.counts_map(per_base, ["l_partkey"]).withColumns({"ref": F.lit("n"), "alt": F.lit("r")})
    return rd.call_from_counts(counts).withColumn("tier", rd.tier_counts(F.col("total"))).drop("counts", "ref", "alt")


@query(
    "fragment_sizes",
    """WITH e AS (SELECT event_type, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events)
SELECT event_type, CAST(round(1.0 * SUM(k) / count(*)) AS BIGINT) AS fragment_size_mean_bp FROM e WHERE k >= 1 GROUP BY 1""",
)
def fragment_sizes(spark, sf):
    k = F.get_json_object("props", "$.k").cast("int")
    hist = fragment_histogram(table(spark, sf, "events").select("event_type", k.alias("k")), ["event_type"], "k")
    return rd.fragment_size(hist, ["event_type"])


@query(
    "filtered_variants",
    """SELECT l_returnflag AS sample_id, count(*) AS n_records, count(*) FILTER (length(l_linestatus || CASE WHEN l_tax > 0.06 THEN 'T' ELSE '' END) = 1) AS n_snv,
  count(*) FILTER (length(l_linestatus || CASE WHEN l_tax > 0.06 THEN 'T' ELSE '' END) <> 1) AS n_indel
FROM lineitem WHERE NOT (l_discount * 1000 < 20 OR l_quantity < 10) GROUP BY 1""",
)
def filtered_variants(spark, sf):
    calls = table(spark, sf, "lineitem").select(
        F.col("l_returnflag").alias("sample_id"),
        F.lit("A").alias("ref"),
        F.concat("l_linestatus", F.when(F.col("l_tax") > 0.06, "T").otherwise("")).alias("alt"),
        (F.col("l_discount") * 1000).alias("qual"),
        F.col("l_quantity").alias("dp"),
    )
    return rd.variant_stats(rd.filter_variants(calls))


@query(
    "pending_work",
    """SELECT c_custkey AS chunk_key FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')
AND c_custkey NOT IN (SELECT s_suppkey FROM supplier WHERE s_acctbal < 0)""",
)
def pending_work(spark, sf):
    """Customers without a finished order, minus a failed list."""
    return rd.pending_chunks(
        table(spark, sf, "customer").select(F.col("c_custkey").alias("chunk_key")),
        table(spark, sf, "orders").where(F.col("o_orderstatus") == "F").select(F.col("o_custkey").alias("chunk_key")),
        table(spark, sf, "supplier").where(F.col("s_acctbal") < 0).select(F.col("s_suppkey").alias("chunk_key")),
    )


@query(
    "stitched_calls",
    """SELECT l_orderkey, l_linenumber, l_discount AS max_gp, l_suppkey AS chunk_id, l_partkey FROM lineitem
QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_discount DESC, l_suppkey, l_partkey) = 1""",
)
def stitched_calls(spark, sf):
    calls = table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", F.col("l_discount").alias("max_gp"), F.col("l_suppkey").alias("chunk_id"), "l_partkey"
    )
    return rd.stitch_chunks(calls, ["l_orderkey", "l_linenumber"], "max_gp", ["chunk_id", "l_partkey"])


@query("union_of_parts", "SELECT event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1")
def union_of_parts(spark, sf):
    events = table(spark, sf, "events").select("event_id", "event_type", "value")
    kinds = ["signup", "error", "view", "click", "purchase"]
    parts = [events.where(F.col("event_type") == k) for k in kinds]
    whole = rd.union_parts(*parts, events.where(~F.col("event_type").isin(kinds)))
    return whole.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 2).alias("total"))


@query(
    "coordinate_layout",
    "SELECT l_returnflag AS sample_id, l_linestatus AS chrom, l_partkey AS pos, l_orderkey, l_linenumber, l_suppkey FROM lineitem",
)
def coordinate_layout(spark, sf):
    rows = table(spark, sf, "lineitem").select(
        F.col("l_returnflag").alias("sample_id"), F.col("l_linestatus").alias("chrom"), F.col("l_partkey").alias("pos"),
        "l_orderkey", "l_linenumber", "l_suppkey",
    )
    return rd.sort_reads(rows)
