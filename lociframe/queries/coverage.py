"""Coverage, quality and tiling queries on lineitem, orders, events and customers."""

from __future__ import annotations

from pyspark.sql import functions as F

from lociframe.functions.text import in_scope, natural_key
from lociframe.operators import coverage as cov
from lociframe.queries.base import days, query, r, seconds, sql_days, sql_seconds, table

# Samples are return flags, chromosomes line numbers (7 = X), bins 30-day stretches of the ship date.
BINNED = f"""
binned AS (
  SELECT l_returnflag AS sample_id,
         CASE WHEN l_linenumber = 7 THEN 'chrX' ELSE 'chr' || l_linenumber END AS chrom,
         {sql_days('l_shipdate')} // 30 AS bin_idx,
         SUM(l_quantity) AS bases
  FROM lineitem GROUP BY ALL),
framed AS (
  SELECT sample_id, chrom, unnest(range(0, MAX(bin_idx) + 1)) AS bin_idx FROM binned GROUP BY sample_id, chrom),
filled AS (
  SELECT f.sample_id, f.chrom, f.bin_idx, COALESCE(b.bases, 0.0) / 30 AS depth
  FROM framed f LEFT JOIN binned b USING (sample_id, chrom, bin_idx)),
base AS (
  SELECT sample_id,
         median(depth) FILTER (depth > 0 AND chrom <> 'chrX') AS baseline,
         median(depth) FILTER (depth > 0 AND chrom = 'chrX') AS x_median
  FROM filled GROUP BY sample_id),
sexed AS (
  SELECT *, COALESCE(x_median / baseline, 1.0) AS chrx_auto_ratio,
         CASE WHEN COALESCE(x_median / baseline, 1.0) < 0.75 THEN 'male' ELSE 'female' END AS predicted_sex
  FROM base)
"""


def binned(spark, sf):
    line = table(spark, sf, "lineitem")
    chrom = F.when(F.col("l_linenumber") == 7, "chrX").otherwise(F.concat(F.lit("chr"), F.col("l_linenumber")))
    return line.groupBy(
        F.col("l_returnflag").alias("sample_id"), chrom.alias("chrom"), F.floor(days("l_shipdate") / 30).alias("bin_idx")
    ).agg(F.sum("l_quantity").alias("bases"))


def filled(spark, sf):
    full = cov.fill_bins(binned(spark, sf), ["sample_id", "chrom"], "bin_idx", {"bases": 0.0})
    spans = full.withColumn("start", F.col("bin_idx") * 30).withColumn("end", F.col("start") + 30)
    return cov.with_depth(spans)


def sexed(spark, sf):
    return cov.predict_sex(cov.baseline_depth(filled(spark, sf)))


@query(
    "depth_quality",
    f"""WITH {BINNED}
SELECT sample_id, round(avg(depth), 6) AS genome_mean_depth, round(median(depth), 6) AS genome_median_depth,
  round(stddev_samp(depth), 6) AS genome_std_depth, round(stddev_samp(depth) / avg(depth), 6) AS uniformity_cv,
  round(100.0 * count(*) FILTER (depth >= 10) / count(*), 6) AS pct_bins_gt10x,
  round(100.0 * count(*) FILTER (depth >= 15) / count(*), 6) AS pct_bins_gt15x,
  round(100.0 * count(*) FILTER (depth >= 20) / count(*), 6) AS pct_bins_gt20x,
  round(100.0 * count(*) FILTER (depth >= 30) / count(*), 6) AS pct_bins_gt30x,
  count(*) FILTER (depth < 15) AS n_low_bins, count(*) AS n_total_bins,
  CASE WHEN avg(depth) >= 20 THEN 'PASS' WHEN avg(depth) >= 10 THEN 'WARN' ELSE 'FAIL' END AS qc_status,
  any_value(round(chrx_auto_ratio, 6)) AS chrx_auto_ratio, any_value(predicted_sex) AS predicted_sex
FROM filled JOIN sexed USING (sample_id) GROUP BY sample_id""",
)
def depth_quality(spark, sf):
    """Flagship: bins → filled bins → baseline and sex → depth quality per sample."""
    stats = cov.qc_genome(filled(spark, sf)).drop("warning")
    sex = sexed(spark, sf).select("sample_id", "chrx_auto_ratio", "predicted_sex")
    digits = [c for c in stats.columns if c.startswith(("genome_", "pct_", "uniformity"))]
    return stats.join(sex, "sample_id").withColumns({c: r(c) for c in [*digits, "chrx_auto_ratio"]})


@query(
    "depth_ratio_bins",
    f"""WITH {BINNED}
SELECT sample_id, chrom, CAST(bin_idx AS BIGINT) AS bin_idx, round(depth, 6) AS depth,
  round(CASE WHEN chrom = 'chrX' AND predicted_sex = 'male' THEN
      CASE WHEN depth = 0 THEN 0.0 WHEN depth >= 0.75 * baseline THEN depth / baseline
           ELSE depth / (0.5 * baseline) END
    WHEN depth > 0 THEN depth / baseline ELSE 0.0 END, 6) AS ratio
FROM filled JOIN sexed USING (sample_id)""",
)
def depth_ratio_bins(spark, sf):
    out = cov.normalise_x(filled(spark, sf), sexed(spark, sf))
    return out.select("sample_id", "chrom", "bin_idx", r("depth").alias("depth"), r("ratio").alias("ratio"))


@query(
    "sex_call",
    f"""WITH {BINNED} SELECT sample_id, round(baseline, 6) AS baseline, round(x_median, 6) AS x_median,
round(chrx_auto_ratio, 6) AS chrx_auto_ratio, predicted_sex FROM sexed""",
)
def sex_call(spark, sf):
    return sexed(spark, sf).select(
        "sample_id", r("baseline").alias("baseline"), r("x_median").alias("x_median"),
        r("chrx_auto_ratio").alias("chrx_auto_ratio"), "predicted_sex",
    )


@query(
    "depth_quality_by_chrom",
    f"""WITH {BINNED}
SELECT sample_id, chrom, round(avg(depth), 6) AS mean_depth, round(median(depth), 6) AS median_depth,
  round(list_sort(list(depth))[count(*) // 10 + 1], 6) AS p10_depth, count(*) AS n_bins,
  count(*) FILTER (depth < 15) AS low_bins
FROM filled GROUP BY sample_id, chrom""",
)
def depth_quality_by_chrom(spark, sf):
    return cov.qc_chrom(filled(spark, sf)).withColumns({c: r(c) for c in ("mean_depth", "median_depth", "p10_depth")})


@query(
    "natural_chrom_order",
    f"""WITH {BINNED}, c AS (SELECT chrom, SUM(bases) AS bases FROM binned GROUP BY chrom)
SELECT chrom, bases, row_number() OVER (ORDER BY try_cast(replace(chrom, 'chr', '') AS BIGINT) IS NULL,
  try_cast(replace(chrom, 'chr', '') AS BIGINT), replace(chrom, 'chr', '')) AS place
FROM c WHERE regexp_matches(chrom, '^chr([0-9]+|X)$')""",
)
def natural_chrom_order(spark, sf):
    from lociframe.operators.scores import rank_within

    per = binned(spark, sf).where(in_scope(F.col("chrom"))).groupBy("chrom").agg(F.sum("bases").alias("bases"))
    # At most one row per chromosome of the genome.
    placed = rank_within(per.withColumn("_g", F.lit(0)), ["_g"], natural_key(F.col("chrom")), "place")
    return placed.withColumn("place", F.col("place").cast("long")).drop("_g")


@query(
    "tile_contigs",
    """WITH c AS (SELECT c_nationkey AS chrom, MAX(c_custkey) + 1 AS length FROM customer GROUP BY c_nationkey)
SELECT chrom, s AS start, least(s + 97, length) AS "end", CAST(s // 97 AS BIGINT) AS bin_idx
FROM (SELECT chrom, length, unnest(range(0, length, 97)) AS s FROM c)""",
)
def tile_contigs(spark, sf):
    contigs = table(spark, sf, "customer").groupBy(F.col("c_nationkey").alias("chrom")).agg(
        (F.max("c_custkey") + 1).alias("length")
    )
    return cov.tile(contigs, 97).select("chrom", "start", "end", "bin_idx")


@query(
    "adaptive_tiles",
    f"""WITH span AS (SELECT user_id, {sql_seconds('max(ts)')} - {sql_seconds('min(ts)')} + 1 AS len, count(*) AS bases
    FROM events GROUP BY user_id),
w AS (SELECT user_id AS sample_id,
    CAST(least(greatest(floor(40.0 / (bases / len) + 0.5), 15000), 2000000) AS BIGINT) AS width FROM span),
c AS (SELECT event_type AS chrom, {sql_seconds('max(ts)')} - {sql_seconds('min(ts)')} + 1 AS length
    FROM events GROUP BY event_type)
SELECT sample_id, chrom, width, s AS start, least(s + width, length) AS "end"
FROM (SELECT *, unnest(range(0, length, width)) AS s FROM w, c)""",
)
def adaptive_tiles(spark, sf):
    """Tile width per user from the event rate, then tiles of every event type at that width."""
    events = table(spark, sf, "events").withColumn("t", seconds("ts"))
    spans = events.groupBy(F.col("user_id").alias("sample_id")).agg(
        (F.max("t") - F.min("t") + 1).alias("end"), F.count(F.lit(1)).alias("bases")
    ).withColumn("start", F.lit(0).cast("long"))
    widths = cov.adaptive_width(spans, numerator=40.0, low=15_000, high=2_000_000)
    contigs = events.groupBy(F.col("event_type").alias("chrom")).agg((F.max("t") - F.min("t") + 1).alias("length"))
    return cov.tile_by(contigs, widths).select("sample_id", "chrom", "width", "start", "end")


SHIP = f"""ship AS (SELECT l_returnflag AS sample_id, o_orderpriority AS chrom,
  {sql_days('o_orderdate', '1992-01-01')} AS s, {sql_days('l_shipdate', '1992-01-01')} AS e
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""


@query(
    "window_coverage",
    f"""WITH {SHIP}, spread AS (SELECT sample_id, chrom, s, e, unnest(range(s // 30, (e - 1) // 30 + 1)) AS b
  FROM ship WHERE e > s)
SELECT sample_id, chrom, CAST(b AS BIGINT) AS bin_idx,
  CAST(SUM(least(e, (b + 1) * 30) - greatest(s, b * 30)) AS BIGINT) AS bases
FROM spread GROUP BY sample_id, chrom, b""",
)
def window_coverage(spark, sf):
    """Days between order and shipment that fall in each 30-day window."""
    line = table(spark, sf, "lineitem").select("l_orderkey", "l_returnflag", "l_shipdate")
    orders = table(spark, sf, "orders").select("o_orderkey", "o_orderpriority", "o_orderdate")
    reads = line.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.col("l_returnflag").alias("sample_id"),
        F.col("o_orderpriority").alias("chrom"),
        days("o_orderdate", "1992-01-01").alias("start"),
        days("l_shipdate", "1992-01-01").alias("end"),
    )
    return cov.window_coverage(reads, 30).select("sample_id", "chrom", "bin_idx", "bases")


@query(
    "bin_arrays",
    f"""WITH {BINNED},
a AS (SELECT sample_id, chrom, list(CAST(depth * 30 AS BIGINT) ORDER BY bin_idx) AS arr FROM filled GROUP BY ALL),
o AS (SELECT o_orderpriority[1] AS p, {sql_days('o_orderdate')} // 30 AS bin_idx, count(*) AS n
  FROM orders GROUP BY ALL),
of AS (SELECT 'chr' || p AS chrom, unnest(range(0, MAX(bin_idx) + 1)) AS bin_idx FROM o GROUP BY p),
b AS (SELECT chrom, list(COALESCE(n, 0) ORDER BY bin_idx) AS panel FROM of
  LEFT JOIN (SELECT 'chr' || p AS chrom, bin_idx, n FROM o) USING (chrom, bin_idx) GROUP BY chrom)
SELECT a.sample_id, a.chrom, CAST(len(arr) AS INTEGER) AS n_bins, array_to_string(arr, ',') AS track,
  array_to_string([CASE WHEN i <= len(COALESCE(panel, [])) THEN panel[i] ELSE 0 END for i in range(1, len(arr) + 1)], ',')
    AS panel_track
FROM a LEFT JOIN b USING (chrom)""",
)
def bin_arrays(spark, sf):
    """Track per sample and chromosome, and a second track cut or padded to its length."""
    mine = filled(spark, sf).withColumn("bases", F.col("depth") * 30)
    tracks = cov.bins_to_array(mine, ["sample_id", "chrom"], "bin_idx", "bases", "arr")
    counts = (
        table(spark, sf, "orders")
        .groupBy(F.concat(F.lit("chr"), F.substring("o_orderpriority", 1, 1)).alias("chrom"), F.floor(days("o_orderdate") / 30).alias("bin_idx"))
        .agg(F.count(F.lit(1)).cast("double").alias("n"))
    )
    panel = cov.bins_to_array(cov.fill_bins(counts, ["chrom"], "bin_idx", {"n": 0.0}), ["chrom"], "bin_idx", "n", "panel")

    def text(arr):
        return F.array_join(F.transform(arr, lambda v: F.round(v).cast("long")), ",")

    return tracks.join(panel, "chrom", "left").select(
        "sample_id",
        "chrom",
        F.size("arr").alias("n_bins"),
        text(F.col("arr")).alias("track"),
        text(cov.pad_array(F.col("panel"), F.size("arr"))).alias("panel_track"),
    )


@query(
    "fill_missing_bins",
    f"""WITH e AS (SELECT user_id AS sample_id, ({sql_seconds('ts')} - 1704067200) // 86400 AS bin_idx, count(*) AS n
  FROM events GROUP BY ALL),
f AS (SELECT sample_id, unnest(range(0, MAX(bin_idx) + 1)) AS bin_idx FROM e GROUP BY sample_id)
SELECT sample_id, CAST(bin_idx AS BIGINT) AS bin_idx, CAST(COALESCE(n, 0) AS BIGINT) AS n
FROM f LEFT JOIN e USING (sample_id, bin_idx)""",
)
def fill_missing_bins(spark, sf):
    daily = (
        table(spark, sf, "events")
        .groupBy(F.col("user_id").alias("sample_id"), F.floor((seconds("ts") - 1704067200) / 86400).alias("bin_idx"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    return cov.fill_bins(daily, ["sample_id"], "bin_idx", {"n": 0})


@query(
    "panel_of_normals",
    f"""WITH {BINNED},
pooled AS (SELECT chrom, bin_idx, SUM(bases) / 30 AS depth FROM binned WHERE sample_id <> 'A' GROUP BY ALL),
m AS (SELECT median(depth) FILTER (depth > 0 AND chrom <> 'chrX') AS baseline FROM pooled)
SELECT chrom, CAST(bin_idx AS BIGINT) AS bin_idx, round(depth, 6) AS depth, round(CASE WHEN depth > 0 THEN
  depth / (CASE WHEN chrom = 'chrX' THEN 0.5 * baseline ELSE baseline END) ELSE 0.0 END, 6) AS ratio
FROM pooled, m""",
)
def panel_of_normals(spark, sf):
    pooled = (
        binned(spark, sf)
        .where(F.col("sample_id") != "A")
        .groupBy("chrom", "bin_idx")
        .agg((F.sum("bases") / 30).alias("depth"))
    )
    return cov.panel_of_normals(pooled).select("chrom", "bin_idx", r("depth").alias("depth"), r("ratio").alias("ratio"))
