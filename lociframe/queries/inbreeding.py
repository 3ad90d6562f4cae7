"""Homozygosity runs, F statistics and reference distributions on events, lineitem and orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from lociframe.functions import genotypes as gt
from lociframe.operators import inbreeding as inb
from lociframe.queries.base import query, r, seconds, sql_seconds, table
from lociframe.session import cut_lineage

ROH_WINDOW, ROH_MIN = 6, 50_000

# The reference walk as a recursive query over het sites: state = (ordinal of the het, standing on it or behind it).
ROH = f"""
s0 AS (SELECT user_id AS sample_id, {sql_seconds('ts')} AS pos, event_type = 'error' AS het,
  row_number() OVER (PARTITION BY user_id ORDER BY {sql_seconds('ts')}, event_id) - 1 AS o FROM events),
tot AS (SELECT sample_id, count(*) AS n FROM s0 GROUP BY 1 HAVING count(*) >= {ROH_WINDOW}),
h AS (SELECT sample_id, o, row_number() OVER (PARTITION BY sample_id ORDER BY o) AS k FROM s0 WHERE het),
hets AS (SELECT sample_id, o, k FROM h UNION ALL SELECT sample_id, -1, 0 FROM tot),
step AS (
  SELECT a.sample_id, a.k, st.on_het, CASE WHEN st.on_het THEN a.o ELSE a.o + 1 END AS first_o,
    c.k AS next_k, COALESCE(c.o, t.n) AS stop_o
  FROM hets a CROSS JOIN (VALUES (TRUE), (FALSE)) st(on_het) JOIN tot t USING (sample_id)
  LEFT JOIN hets c ON c.sample_id = a.sample_id AND c.k = a.k + CASE WHEN st.on_het THEN 1 ELSE 2 END),
walk(sample_id, k, on_het, run_a, run_b) AS (
  SELECT sample_id, 0, FALSE, NULL::BIGINT, NULL::BIGINT FROM tot
  UNION ALL
  SELECT w.sample_id,
    CASE WHEN s.stop_o - s.first_o >= {ROH_WINDOW} THEN s.next_k WHEN w.on_het THEN w.k ELSE w.k + 1 END,
    s.stop_o - s.first_o >= {ROH_WINDOW},
    CASE WHEN s.stop_o - s.first_o >= {ROH_WINDOW} THEN s.first_o END,
    CASE WHEN s.stop_o - s.first_o >= {ROH_WINDOW} THEN s.stop_o - 1 END
  FROM walk w JOIN step s ON s.sample_id = w.sample_id AND s.k = w.k AND s.on_het = w.on_het),
runs AS (SELECT w.sample_id, a.pos AS start, b.pos AS "end" FROM walk w
  JOIN s0 a ON a.sample_id = w.sample_id AND a.o = w.run_a JOIN s0 b ON b.sample_id = w.sample_id AND b.o = w.run_b
  WHERE b.pos - a.pos >= {ROH_MIN})"""


def runs(spark, sf):
    sites = table(spark, sf, "events").select(
        F.col("user_id").alias("sample_id"), seconds("ts").alias("pos"), "event_id", (F.col("event_type") == "error").alias("is_het")
    )
    return inb.roh(
        sites, ["sample_id"], window=ROH_WINDOW, min_length=ROH_MIN, block_span=86_400, hets_per_block=4096, tie=["event_id"]
    )


@query("homozygosity_runs", f'WITH RECURSIVE {ROH} SELECT sample_id, start, "end" FROM runs')
def homozygosity_runs(spark, sf):
    return runs(spark, sf)


@query(
    "inbreeding_from_runs",
    f"""WITH RECURSIVE {ROH}, x AS (SELECT u.sample_id, COALESCE(sum("end" - start), 0) / 1e6 AS mb, count("end") AS n
  FROM (SELECT DISTINCT user_id AS sample_id FROM events) u LEFT JOIN runs USING (sample_id) GROUP BY u.sample_id)
SELECT sample_id, round(mb, 6) AS roh_total_mb, n AS roh_n_segments, round(mb / 2.6, 6) AS f_roh,
  CASE WHEN mb / 2.6 < 0.03125 THEN 'Very_Low' WHEN mb / 2.6 < 0.0625 THEN 'Low' WHEN mb / 2.6 < 0.125 THEN 'Moderate'
       WHEN mb / 2.6 < 0.25 THEN 'High' ELSE 'Very_High' END AS level FROM x""",
)
def inbreeding_from_runs(spark, sf):
    users = table(spark, sf, "events").select(F.col("user_id").alias("sample_id")).distinct()
    out = inb.froh(runs(spark, sf), users, genome_mb=2.6)
    return out.withColumns({c: r(c) for c in ("roh_total_mb", "f_roh")})


@query(
    "genotype_f",
    """WITH c AS (SELECT l_returnflag AS sample_id, l_partkey AS pos, ['0|0', '0|1', '1|1', './.', '1/1', '1|2', '0/0'][l_linenumber] AS gt,
  row_number() OVER (PARTITION BY l_returnflag, l_partkey ORDER BY l_orderkey, l_linenumber, l_suppkey, l_extendedprice) AS i FROM lineitem),
p AS (SELECT p_partkey % 1900 AS pos, CASE WHEN p_size <> 13 THEN p_size / 50.0 END AS af,
  row_number() OVER (PARTITION BY p_partkey % 1900 ORDER BY p_partkey) AS i FROM part),
j AS (SELECT sample_id, gt IN ('0|0', '1|1', '0/0', '1/1') AS hom, af FROM c JOIN p USING (pos, i) WHERE af IS NOT NULL),
s AS (SELECT sample_id, count(*) FILTER (hom) AS o_hom, sum(af * af + (1 - af) * (1 - af)) AS e_hom, count(*) AS n_obs FROM j GROUP BY 1)
SELECT sample_id, o_hom, round(e_hom, 4) AS e_hom, n_obs, round((o_hom - e_hom) / (n_obs - e_hom), 6) AS f FROM s""",
)
def genotype_f(spark, sf):
    """The n-th call at a position meets the n-th panel row there."""
    codes = F.array(*[F.lit(g) for g in ("0|0", "0|1", "1|1", "./.", "1/1", "1|2", "0/0")])
    calls = table(spark, sf, "lineitem").select(
        F.col("l_returnflag").alias("sample_id"),
        F.col("l_partkey").alias("pos"),
        F.element_at(codes, F.col("l_linenumber")).alias("gt"),
        F.struct("l_orderkey", "l_linenumber", "l_suppkey", "l_extendedprice").alias("ord"),
    )
    panel = table(spark, sf, "part").select(
        (F.col("p_partkey") % 1900).alias("pos"),
        F.when(F.col("p_size") != 13, F.col("p_size") / 50).alias("af"),
        F.col("p_partkey").alias("ord"),
    )
    out = inb.genotype_f(inb.join_af(calls, panel, ["pos"]), gt.is_hom_biallelic(F.col("gt")))
    return out.withColumns({"e_hom": r("e_hom", 4), "f": r("f")})


PRICES = """
ref AS (SELECT o_totalprice AS v FROM orders),
scores AS (SELECT o_custkey AS sample_id, floor(avg(o_totalprice)) AS score FROM orders GROUP BY 1 UNION ALL
  SELECT -o_orderkey - 1, o_totalprice FROM orders WHERE o_orderstatus = 'P'),
axis AS (SELECT v, count(*) AS n FROM ref GROUP BY v),
cum AS (SELECT v, sum(n) OVER (ORDER BY v) AS upto FROM axis),
below AS (SELECT s.sample_id, s.score, COALESCE(c.upto, 0) AS upto FROM scores s ASOF LEFT JOIN cum c ON s.score >= c.v),
strict AS (SELECT b.*, b.upto - COALESCE(a.n, 0) AS lower FROM below b LEFT JOIN axis a ON a.v = b.score)"""


def prices(spark, sf):
    orders = table(spark, sf, "orders")
    means = orders.groupBy(F.col("o_custkey").alias("sample_id")).agg(F.floor(F.avg("o_totalprice")).cast("double").alias("score"))
    exact = orders.where(F.col("o_orderstatus") == "P").select(
        (-F.col("o_orderkey") - 1).alias("sample_id"), F.col("o_totalprice").alias("score")
    )
    return orders.select(F.col("o_totalprice").alias("v")), means.unionByName(exact)


for _kind, _expr in (
    ("strict", "100.0 * lower / t"),
    ("weak", "100.0 * upto / t"),
    ("rank", "(lower + upto + CASE WHEN upto > lower THEN 1 ELSE 0 END) * 50.0 / t"),
):

    @query(
        f"percentile_{_kind}",
        f"WITH {PRICES} SELECT sample_id, score, round({_expr}, 6) AS percentile FROM strict, (SELECT count(*) AS t FROM ref)",
    )
    def _percentile(spark, sf, kind=_kind):
        reference, scores = prices(spark, sf)
        return inb.percentile_rank(reference, scores, "v", "score", kind).withColumn("percentile", r("percentile"))


MEANS = """m AS MATERIALIZED (SELECT o_custkey AS sample_id, avg(o_totalprice / 7) AS score FROM orders GROUP BY 1),
c AS (SELECT *, count(*) OVER (ORDER BY score) AS upto, count(*) OVER (ORDER BY score) - count(*) OVER (PARTITION BY score) AS lower, count(*) OVER () AS t FROM m)"""

for _kind, _expr in (("strict", "100.0 * lower / t"), ("weak", "100.0 * upto / t"), ("rank", "(lower + upto + 1) * 50.0 / t")):

    @query(f"percentile_of_means_{_kind}", f"WITH {MEANS} SELECT sample_id, round({_expr}, 6) AS percentile FROM c")
    def _means(spark, sf, kind=_kind):
        """Unrounded float means among themselves."""
        means = cut_lineage(table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("sample_id")).agg(F.avg(F.col("o_totalprice") / 7).alias("score")))
        found = inb.percentile_rank(means.select(F.col("score").alias("v")), means, "v", "score", kind)
        return found.select("sample_id", r("percentile").alias("percentile"))


@query(
    "value_histogram",
    """WITH b AS (SELECT min(o_totalprice) AS lo, max(o_totalprice) + 0.001 AS hi FROM orders),
n AS (SELECT CAST(floor((o_totalprice - lo) / (hi - lo) * 40) AS INTEGER) AS bin, count(*) AS n FROM orders, b GROUP BY 1)
SELECT CAST(i AS INTEGER) AS bin, round(lo + (hi - lo) / 40 * i, 4) AS lower, round(lo + (hi - lo) / 40 * (i + 1), 4) AS upper,
  COALESCE(n, 0) AS n FROM (SELECT unnest(range(0, 40)) AS i) CROSS JOIN b LEFT JOIN n ON n.bin = i""",
)
def value_histogram(spark, sf):
    out = inb.histogram(table(spark, sf, "orders"), "o_totalprice")
    return out.withColumns({"lower": r("lower", 4), "upper": r("upper", 4)})


@query(
    "value_distribution",
    """SELECT o_orderpriority, count(*) AS n, round(avg(o_totalprice), 4) AS mean, round(quantile_cont(o_totalprice, 0.25), 4) AS p25,
  round(quantile_cont(o_totalprice, 0.5), 4) AS p50, round(quantile_cont(o_totalprice, 0.75), 4) AS p75,
  round(quantile_cont(o_totalprice, 0.9), 4) AS p90 FROM orders GROUP BY 1""",
)
def value_distribution(spark, sf):
    out = inb.dist_summary(table(spark, sf, "orders"), "o_totalprice", ["o_orderpriority"])
    return out.withColumns({c: r(c, 4) for c in ("mean", "p25", "p50", "p75", "p90")})
