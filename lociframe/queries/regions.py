"""Low-window, merge and interval-overlap queries on events: a user is a sample, the time axis the chromosome."""

from __future__ import annotations

from pyspark.sql import functions as F

from lociframe.functions.text import format_bp
from lociframe.operators import coverage as cov
from lociframe.operators import regions as reg
from lociframe.plans import intervals
from lociframe.queries.base import query, r, seconds, sql_seconds, table

T0 = 1704067200
WIDTH = 21_600

LOW = f"""
e AS (SELECT user_id AS sample_id, ({sql_seconds('ts')} - {T0}) // {WIDTH} AS bin_idx, count(*) AS n FROM events GROUP BY ALL),
f AS (SELECT sample_id, unnest(range(0, MAX(bin_idx) + 1)) AS bin_idx FROM e GROUP BY sample_id),
windows AS (SELECT sample_id, bin_idx * {WIDTH} AS start, (bin_idx + 1) * {WIDTH} AS "end", COALESCE(n, 0) * 1.0 AS depth
  FROM f LEFT JOIN e USING (sample_id, bin_idx)),
low AS (SELECT w.*, round(depth / m, 3) AS norm FROM windows w
  JOIN (SELECT sample_id, avg(depth) AS m FROM windows GROUP BY sample_id) USING (sample_id) WHERE depth < 0.15 * m),
flagged AS (SELECT *, CASE WHEN start <= max("end") OVER (PARTITION BY sample_id ORDER BY start
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + {WIDTH} THEN 0 ELSE 1 END AS opens FROM low),
numbered AS (SELECT *, sum(opens) OVER (PARTITION BY sample_id ORDER BY start) AS island FROM flagged),
merged AS (SELECT sample_id, min(start) AS start, max("end") AS "end", avg(norm) AS norm, count(*) AS n_merged
  FROM numbered GROUP BY sample_id, island)
"""
GENES = f"""
genes AS (SELECT user_id AS sample_id, event_id AS gene_ord, event_type || '-' || (event_id % 500) AS gene,
  {sql_seconds('ts')} - {T0} AS gs, {sql_seconds('ts')} - {T0} + CAST(floor(value * 600) AS BIGINT) AS ge
  FROM events WHERE event_type = 'purchase'),
pairs AS (SELECT m.sample_id, m.start, m."end", g.gene_ord, g.gene, g.gs AS gene_start, g.ge AS gene_end,
  CASE WHEN g.gs >= m.start AND g.ge <= m."end" THEN 'full' ELSE 'partial' END AS overlap,
  CASE WHEN g.gs < m."end" AND g.gs + (g.ge - g.gs) // 4 > m.start THEN 'exonic' ELSE 'intronic' END AS exon_overlap
  FROM merged m JOIN genes g ON m.sample_id = g.sample_id AND g.ge >= m.start AND g.gs <= m."end")
"""


def windows(spark, sf):
    counts = (
        table(spark, sf, "events")
        .groupBy(F.col("user_id").alias("sample_id"), F.floor((seconds("ts") - T0) / WIDTH).alias("bin_idx"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    full = cov.fill_bins(counts, ["sample_id"], "bin_idx", {"n": 0})
    return full.select(
        "sample_id",
        F.lit("t").alias("chrom"),
        (F.col("bin_idx") * WIDTH).alias("start"),
        ((F.col("bin_idx") + 1) * WIDTH).alias("end"),
        F.col("n").cast("double").alias("depth"),
    )


def merged(spark, sf):
    low = reg.low_windows(windows(spark, sf))
    return intervals.merge_adjacent(low, ["sample_id", "chrom"], "start", "end", WIDTH, "norm", block_span=WIDTH * 64)


def genes(spark, sf):
    start = seconds("ts") - T0
    length = F.floor(F.col("value") * 600).cast("long")
    return (
        table(spark, sf, "events")
        .where(F.col("event_type") == "purchase")
        .select(
            F.col("user_id").alias("sample_id"),
            F.col("event_id").alias("gene_ord"),
            F.concat_ws("-", "event_type", F.col("event_id") % 500).alias("gene"),
            F.lit("purchase").alias("biotype"),
            start.alias("gene_start"),
            (start + length).alias("gene_end"),
            F.array(F.struct(start.alias("s"), (start + F.floor(length / 4)).alias("e"))).alias("exons"),
        )
    )


def pairs(spark, sf):
    return reg.overlap_genes(merged(spark, sf), genes(spark, sf), ["sample_id"], WIDTH)


@query("low_windows", f"""WITH {LOW} SELECT sample_id, start, "end", depth, norm FROM low""")
def low_windows(spark, sf):
    return reg.low_windows(windows(spark, sf)).drop("chrom")


@query(
    "merged_regions",
    f"""WITH {LOW} SELECT sample_id, start, "end", round(norm, 6) AS norm, n_merged FROM merged""",
)
def merged_regions(spark, sf):
    return merged(spark, sf).select("sample_id", "start", "end", r("norm").alias("norm"), "n_merged")


@query(
    "region_panel_depth",
    f"""WITH {LOW},
p AS (SELECT ({sql_seconds('ts')} - {T0}) // 86400 AS b, count(*) AS n FROM events GROUP BY 1),
pr AS (SELECT b, n / (SELECT median(n) FROM p) AS ratio FROM p),
d AS (SELECT sample_id, start, "end", CAST(round(avg(ratio) * 100) AS BIGINT) AS ref_depth_pct
  FROM (SELECT sample_id, start, "end", unnest(range(start // 86400, "end" // 86400 + 1)) AS b FROM merged)
  JOIN pr USING (b) WHERE ratio > 0 GROUP BY ALL)
SELECT m.sample_id, m.start, m."end", d.ref_depth_pct FROM merged m LEFT JOIN d USING (sample_id, start, "end")""",
)
def region_panel_depth(spark, sf):
    daily = (
        table(spark, sf, "events")
        .groupBy(F.lit("t").alias("chrom"), F.floor((seconds("ts") - T0) / 86400).alias("bin_idx"))
        .agg(F.count(F.lit(1)).cast("double").alias("depth"))
    )
    panel = cov.panel_of_normals(daily)
    return reg.ref_depth(merged(spark, sf), panel, bin_size=86400).select("sample_id", "start", "end", "ref_depth_pct")


@query("region_gene_overlap", f"""WITH {LOW}, {GENES} SELECT * FROM pairs""")
def region_gene_overlap(spark, sf):
    return pairs(spark, sf).select(
        "sample_id", "start", "end", "gene_ord", "gene", "gene_start", "gene_end", "overlap", "exon_overlap"
    )


@query(
    "points_in_regions",
    f"""WITH {LOW}
SELECT m.sample_id, m.start, m."end", count(*) AS n_points FROM merged m
JOIN (SELECT user_id AS sample_id, {sql_seconds('ts')} - {T0} AS pos FROM events) p
  ON m.sample_id = p.sample_id AND p.pos BETWEEN m.start AND m."end"
GROUP BY ALL""",
)
def points_in_regions(spark, sf):
    points = table(spark, sf, "events").select(F.col("user_id").alias("sample_id"), (seconds("ts") - T0).alias("pos"))
    return intervals.points_in_intervals(
        merged(spark, sf), points, ["sample_id"], ("start", "end"), "pos", ["sample_id", "start", "end"], bucket=WIDTH
    )


@query(
    "region_verdicts",
    f"""WITH {LOW}, {GENES},
g AS (SELECT sample_id, start, "end", count(*) AS n_genes, string_agg(gene, ',' ORDER BY gene_ord) AS genes
  FROM pairs GROUP BY ALL)
SELECT m.sample_id, m.start, m."end", COALESCE(genes, '') AS genes,
  CASE WHEN m."end" - m.start >= 1000000 THEN printf('%.2fMb', (m."end" - m.start) / 1e6)
       WHEN m."end" - m.start >= 1000 THEN ((m."end" - m.start) // 1000) || 'kb'
       ELSE (m."end" - m.start) || 'bp' END AS size,
  CASE WHEN n_merged * 10 < 80 THEN 'mappability_artefact' ELSE 'putative_deletion' END AS verdict
FROM merged m LEFT JOIN g USING (sample_id, start, "end")
WHERE m."end" - m.start >= 50000 OR COALESCE(n_genes, 0) > 0""",
)
def region_verdicts(spark, sf):
    """Retention, size text and verdict; the number of merged windows stands in for the panel depth."""
    rows = reg.attach_genes(merged(spark, sf), pairs(spark, sf))
    size = F.col("end") - F.col("start")
    return rows.where(reg.keep_region(size, F.size("disrupted_genes"))).select(
        "sample_id",
        "start",
        "end",
        F.array_join("disrupted_genes", ",").alias("genes"),
        format_bp(size).alias("size"),
        reg.region_verdict(F.col("n_merged") * 10).alias("verdict"),
    )


for _keep, _dir in (("first", "ASC"), ("last", "DESC")):

    @query(
        f"unique_genes_{_keep}",
        f"""WITH {LOW}, {GENES}
SELECT sample_id, gene, start, "end", gene_start, gene_end, overlap, exon_overlap FROM (
  SELECT *, row_number() OVER (PARTITION BY sample_id, gene ORDER BY start {_dir}, gene_ord {_dir}) AS rn FROM pairs)
WHERE rn = 1""",
    )
    def _unique_genes(spark, sf, keep=_keep):
        found = reg.unique_genes(pairs(spark, sf), ["start", "gene_ord"], keep=keep)
        return found.select("sample_id", "gene", "start", "end", "gene_start", "gene_end", "overlap", "exon_overlap")


@query(
    "reannotated_regions",
    f"""WITH {LOW}, {GENES},
hit AS (SELECT DISTINCT p.sample_id, p.start, p."end", p.gene_ord FROM pairs p
  JOIN (SELECT user_id AS sample_id, {sql_seconds('ts')} - {T0} AS pos FROM events WHERE event_type = 'click') c
  ON c.sample_id = p.sample_id AND c.pos BETWEEN p.gene_start AND p.gene_end AND c.pos BETWEEN p.start AND p."end")
SELECT p.sample_id, p.start, p."end", p.gene, p.gene_ord, p.overlap,
  CASE WHEN h.gene_ord IS NULL THEN 'intronic' ELSE 'exonic' END AS exon_overlap
FROM pairs p LEFT JOIN hit h USING (sample_id, start, "end", gene_ord)""",
)
def reannotated_regions(spark, sf):
    """Genes of the regions again, now exonic where a click lies inside both gene and region."""
    found = genes(spark, sf).withColumn("gene_id", F.col("gene_ord")).withColumn("chrom", F.lit("t"))
    clicks = table(spark, sf, "events").where(F.col("event_type") == "click").select(
        F.col("user_id").alias("sample_id"), (seconds("ts") - T0).alias("pos"), F.lit(1).alias("one")
    )
    inside = clicks.withColumn("pos_end", F.col("pos"))
    exonic = intervals.overlap_join(
        inside, found.select("sample_id", "gene_id", "gene_start", "gene_end"), ["sample_id"],
        ("pos", "pos_end"), ("gene_start", "gene_end"), bucket=WIDTH,
    ).select("sample_id", "gene_id", "pos")
    out = reg.overlap_genes_by_points(merged(spark, sf), found, exonic, bucket=WIDTH)
    return out.select("sample_id", "start", "end", "gene", "gene_ord", "overlap", "exon_overlap")


@query(
    "gene_deletion_flag",
    f"""WITH {LOW}, {GENES}
SELECT u.sample_id, CASE WHEN u.sample_id % 10 = 0 THEN NULL
  ELSE COALESCE(bool_or(contains(gene, '-7') AND n_merged >= 3), FALSE) END AS gene_deleted
FROM (SELECT DISTINCT user_id AS sample_id FROM events) u
LEFT JOIN (SELECT p.*, m.n_merged FROM pairs p JOIN merged m USING (sample_id, start, "end")) p USING (sample_id)
GROUP BY u.sample_id""",
)
def gene_deletion_flag(spark, sf):
    rows = reg.attach_genes(merged(spark, sf), pairs(spark, sf)).withColumn(
        "verdict", F.when(F.col("n_merged") < 3, "mappability_artefact").otherwise("putative_deletion")
    )
    users = table(spark, sf, "events").select(F.col("user_id").alias("sample_id")).distinct()
    users = users.withColumn("regions_called", F.col("sample_id") % 10 != 0)
    return reg.flag_gene(rows, users, "-7")
