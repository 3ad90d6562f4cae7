"""Gapped reads: lineitem rows with clips, insertions, deletions and skips between two aligned stretches."""

from __future__ import annotations

from pyspark.sql import functions as F

from lociframe.functions.cigar import with_blocks
from lociframe.operators import coverage as cov
from lociframe.operators import reads as rd
from lociframe.queries.base import query, table

ROW = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
WIDTHS = (50, 128)

# Every 11th order's reads have no CIGAR. The walk is recursive: one row per operation, with the places in front of it.
GAPPED = """
g AS (
  SELECT *, row_number() OVER () AS rid, l_returnflag AS sample_id, 'chr' || (l_partkey % 3 + 1) AS chrom, l_partkey AS pos, l_partkey + 6 AS "end",
    concat_ws('/', l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(round(l_extendedprice * 100) AS BIGINT)) AS read_id,
    (l_orderkey * 7 + l_suppkey) % 4096 AS flag, CAST(l_quantity AS INTEGER) AS mapq, l_orderkey % 5 AS mate_pos,
    translate(lpad(CAST(l_suppkey AS VARCHAR), 7, '0') || lpad(CAST(l_orderkey AS VARCHAR), 8, '0') || lpad(CAST(l_partkey AS VARCHAR), 8, '0'), '0123456789', 'ACGTACGTGC') AS seq,
    CASE WHEN l_orderkey % 11 = 0 THEN '*' ELSE
      CASE l_orderkey % 4 WHEN 0 THEN '' WHEN 1 THEN '2S' WHEN 2 THEN '3H' ELSE '1H2S' END || (l_linenumber + 3) || 'M' ||
      CASE l_suppkey % 5 WHEN 0 THEN '2=1X' WHEN 1 THEN '2I' WHEN 2 THEN '3D' WHEN 3 THEN '40N' ELSE '1I2D' END || '4M' ||
      CASE l_partkey % 3 WHEN 0 THEN '' WHEN 1 THEN '2S' ELSE '1S2H' END END AS cigar
  FROM lineitem),
walk AS (
  SELECT rid, 0 AS k, cigar AS rest, 'P' AS op, CAST(0 AS BIGINT) AS n, CAST(pos AS BIGINT) AS r, CAST(0 AS BIGINT) AS q FROM g WHERE cigar <> '*'
  UNION ALL
  SELECT rid, k + 1, substr(rest, length(tok) + 1), right(tok, 1), CAST(left(tok, length(tok) - 1) AS BIGINT),
    r + CASE WHEN op IN ('M', '=', 'X', 'D', 'N') THEN n ELSE 0 END, q + CASE WHEN op IN ('M', '=', 'X', 'I', 'S') THEN n ELSE 0 END
  FROM (SELECT *, regexp_extract(rest, '^[0-9]+[MIDNSHP=X]') AS tok FROM walk WHERE rest <> '')),
blocks AS (
  SELECT rid, r AS b_start, r + n - 1 AS b_end, q AS b_q FROM walk WHERE op IN ('M', '=', 'X')
  UNION ALL SELECT rid, pos, "end", 0 FROM g WHERE cigar = '*'),
ends AS (
  SELECT rid, min(r) FILTER (op IN ('M', '=', 'X')) AS a, max(r + n - 1) FILTER (op IN ('M', '=', 'X')) AS z,
    coalesce(sum(n) FILTER (op IN ('S', 'H') AND k <= first_m), 0) AS lead, coalesce(sum(n) FILTER (op IN ('S', 'H') AND k > first_m), 0) AS tail,
    coalesce(sum(n) FILTER (op = 'D'), 0) AS deleted, coalesce(sum(n) FILTER (op = 'N'), 0) AS skipped
  FROM (SELECT *, min(k) FILTER (op IN ('M', '=', 'X')) OVER (PARTITION BY rid) AS first_m FROM walk) GROUP BY rid),
starts AS (
  SELECT g.*, flag & 16 <> 0 AS reverse, lead, tail, deleted, skipped,
    CAST(CASE WHEN cigar = '*' THEN CASE WHEN flag & 16 <> 0 THEN "end" ELSE pos END WHEN flag & 16 <> 0 THEN z + tail ELSE pos - lead END AS BIGINT) AS five_prime
  FROM g LEFT JOIN ends USING (rid))"""


def gapped(spark, sf):
    line = table(spark, sf, "lineitem")
    pick = lambda c, *values: F.element_at(F.array(*map(F.lit, values)), (c + 1).cast("int"))
    spelled = F.translate(F.concat(*[F.lpad(F.col(c).cast("string"), n, "0") for c, n in (("l_suppkey", 7), ("l_orderkey", 8), ("l_partkey", 8))]), "0123456789", "ACGTACGTGC")
    cigar = F.concat(
        pick(F.col("l_orderkey") % 4, "", "2S", "3H", "1H2S"),
        (F.col("l_linenumber") + 3).cast("string"), F.lit("M"),
        pick(F.col("l_suppkey") % 5, "2=1X", "2I", "3D", "40N", "1I2D"), F.lit("4M"),
        pick(F.col("l_partkey") % 3, "", "2S", "1S2H"),
    )
    cents = F.round(F.col("l_extendedprice") * 100).cast("long")
    return line.select(
        *ROW,
        F.col("l_returnflag").alias("sample_id"),
        F.concat(F.lit("chr"), F.col("l_partkey") % 3 + 1).alias("chrom"),
        F.col("l_partkey").alias("pos"),
        (F.col("l_partkey") + 6).alias("end"),
        F.concat_ws("/", *ROW, cents).alias("read_id"),
        ((F.col("l_orderkey") * 7 + F.col("l_suppkey")) % 4096).alias("flag"),
        F.col("l_quantity").cast("int").alias("mapq"),
        (F.col("l_orderkey") % 5).alias("mate_pos"),
        spelled.alias("seq"),
        F.transform(F.sequence(F.lit(1), F.lit(23)), lambda i: ((F.col("l_orderkey") + i * F.col("l_suppkey")) % 41).cast("int")).alias("qual"),
        F.when(F.col("l_orderkey") % 11 == 0, "*").otherwise(cigar).alias("cigar"),
    )


@query("cigar_blocks", f"WITH RECURSIVE {GAPPED} SELECT {', '.join(ROW)}, b_start, b_end, b_q FROM g JOIN blocks USING (rid)")
def cigar_blocks(spark, sf):
    return with_blocks(gapped(spark, sf)).select(*ROW, "b_start", "b_end", "b_q")


@query(
    "clipped_starts",
    f"""WITH RECURSIVE {GAPPED} SELECT {', '.join(ROW)}, reverse, five_prime, CAST(coalesce(deleted, 0) AS BIGINT) AS deleted,
  CAST(coalesce(skipped, 0) AS BIGINT) AS skipped FROM starts""",
)
def clipped_starts(spark, sf):
    """Unclipped 5' start, and the bases of the reference that a read deletes or skips."""
    rows = rd.with_signature(gapped(spark, sf), keep="w")
    total = lambda c: F.coalesce(F.aggregate(F.col(c), F.lit(0).cast("long"), lambda acc, s: acc + s["end"] - s["start"] + 1), F.lit(0))
    return rows.select(*ROW, "reverse", "five_prime", total("w.deleted").alias("deleted"), total("w.skipped").alias("skipped"))


@query(
    "read_duplicates",
    f"""WITH RECURSIVE {GAPPED}, s AS (SELECT *, flag & 2308 = 0 AS counted,
    list_sum([CASE WHEN (l_orderkey + i * l_suppkey) % 41 >= 15 THEN (l_orderkey + i * l_suppkey) % 41 ELSE 0 END for i in range(1, 24)]) AS score FROM starts)
SELECT read_id, flag, counted AND row_number() OVER (PARTITION BY counted, sample_id, chrom, five_prime, reverse, mate_pos ORDER BY score DESC, read_id, flag) > 1
  AS is_duplicate FROM s""",
)
def read_duplicates(spark, sf):
    return rd.mark_read_duplicates(gapped(spark, sf)).select("read_id", "flag", "is_duplicate")


@query(
    "gapped_pileup",
    f"""WITH RECURSIVE {GAPPED},
sites AS (SELECT DISTINCT 'chr' || (p_partkey % 3 + 1) AS chrom, p_partkey AS pos FROM part),
hits AS (SELECT sample_id, g.chrom, s.pos, read_id, flag, substr(seq, CAST(s.pos - b_start + b_q + 1 AS INTEGER), 1) AS base,
    (l_orderkey + (s.pos - b_start + b_q + 1) * l_suppkey) % 41 AS bq
  FROM g JOIN blocks USING (rid) JOIN sites s ON g.chrom = s.chrom AND s.pos BETWEEN b_start AND b_end
  WHERE mapq >= 20 AND flag & 1796 = 0 AND (flag & 1 = 0 OR flag & 2 <> 0)),
once AS (SELECT * FROM hits WHERE bq >= 20 QUALIFY row_number() OVER (PARTITION BY sample_id, chrom, pos, read_id ORDER BY bq DESC, flag, base) = 1)
SELECT sample_id, chrom, pos, count(*) AS total, count(*) FILTER (base = 'A') AS n_a, count(*) FILTER (base = 'C') AS n_c,
  count(*) FILTER (base = 'G') AS n_g, count(*) FILTER (base = 'T') AS n_t
FROM once GROUP BY ALL""",
)
def gapped_pileup(spark, sf):
    sites = table(spark, sf, "part").select(F.concat(F.lit("chr"), F.col("p_partkey") % 3 + 1).alias("chrom"), F.col("p_partkey").alias("pos"))
    piled = rd.pileup(gapped(spark, sf), sites)
    return piled.select("sample_id", "chrom", "pos", "total", *[rd.base_count(F.col("counts"), F.lit(b)).alias(f"n_{b.lower()}") for b in "ACGT"])


@query(
    "gapped_coverage",
    f"""WITH RECURSIVE {GAPPED},
c AS (SELECT chrom, max(pos) + 30 AS length FROM g GROUP BY chrom),
t AS (SELECT sample_id, chrom, width, s AS start, least(s + width, length) AS "end" FROM (
    SELECT sample_id, chrom, width, length, unnest(range(0, length, width)) AS s
    FROM (SELECT DISTINCT sample_id FROM g) x, c, (VALUES {', '.join(f'({w})' for w in WIDTHS)}) w(width))),
p AS (SELECT sample_id, chrom, unnest(range(b_start - 1, b_end)) AS p FROM g JOIN blocks USING (rid) WHERE flag & 1796 = 0),
d AS (SELECT sample_id, chrom, p, count(*) AS n FROM p GROUP BY ALL),
b AS (SELECT sample_id, chrom, width, (p // width) * width AS start, sum(n) AS bases FROM d, (VALUES {', '.join(f'({w})' for w in WIDTHS)}) w(width), c
  WHERE c.chrom = d.chrom AND p >= 0 AND p < length GROUP BY ALL)
SELECT sample_id, chrom, CAST(width AS BIGINT) AS width, CAST(start AS BIGINT) AS start, "end", CAST(coalesce(bases, 0) AS BIGINT) AS bases
FROM t LEFT JOIN b USING (sample_id, chrom, width, start)""".replace("SELECT sample_id, chrom, width, (p // width)", "SELECT d.sample_id, d.chrom, width, (p // width)"),
)
def gapped_coverage(spark, sf):
    """Aligned bases in the tiles of two widths, from one scan of the reads."""
    reads = gapped(spark, sf)
    blocks = with_blocks(cov.countable_reads(reads)).select("sample_id", "chrom", (F.col("b_start") - 1).alias("start"), F.col("b_end").alias("end"))
    contigs = reads.groupBy("chrom").agg((F.max("pos") + 30).alias("length"))
    widths = reads.select("sample_id").distinct().withColumn("width", F.explode(F.array(*[F.lit(w).cast("long") for w in WIDTHS])))
    tiles = cov.tile_by(contigs, widths)
    return cov.integrate_events(cov.depth_events(blocks), tiles).select("sample_id", "chrom", "width", "start", "end", "bases")
