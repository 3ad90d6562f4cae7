"""Profile queries: suppliers are samples, their parts the taxa, shares of quantity the abundances."""

from __future__ import annotations

from pyspark.sql import functions as F

from lociframe.operators import inbreeding as inb
from lociframe.operators import microbiome as mb
from lociframe.plans.quantiles import exact_quantiles
from lociframe.queries.base import query, r, table
from lociframe.session import cut_lineage
from lociframe.sources.taxa import is_genus, is_species, parse_profile

FRAGMENTS = [("s__red", "red", "first"), ("s__blue_b", "orange", "second"), ("s__small_ring", "red", "third"), ("s__none", "red", "never")]
_F = ", ".join(f"('{a}', '{b}', '{c}')" for a, b, c in FRAGMENTS)

# Lines of a profile per supplier: kingdom, genus and species rows, a strain row that must be ignored, a comment.
PROFILE = f"""
q AS (SELECT l_suppkey AS sample_id, p_brand, p_name, sum(l_quantity) AS v FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL),
t AS (SELECT DISTINCT sample_id FROM q),
species AS (SELECT sample_id, 'k__Bacteria|p__P|g__' || replace(p_brand, '#', '') || '|s__' || replace(p_name, ' ', '_') AS clade,
  replace(p_brand, '#', '') AS genus, p_name AS name, v / 100 AS pct FROM q),
share AS (SELECT sample_id, 60.0 + sample_id % 40 AS classified FROM t),
frag(fragment, color, association) AS (VALUES {_F})"""


def quantities(spark, sf):
    line = table(spark, sf, "lineitem").select("l_suppkey", "l_partkey", "l_quantity")
    part = table(spark, sf, "part").select("p_partkey", "p_brand", "p_name")
    return line.join(part, F.col("l_partkey") == F.col("p_partkey")).groupBy(
        F.col("l_suppkey").alias("sample_id"), "p_brand", "p_name"
    ).agg(F.sum("l_quantity").alias("v"))


def profile(spark, sf):
    """The same profile as text lines, read back by the profile parser."""
    q = quantities(spark, sf)
    genus = F.concat(F.lit("k__Bacteria|p__P|g__"), F.replace("p_brand", F.lit("#"), F.lit("")))
    clade = F.concat(genus, F.lit("|s__"), F.replace("p_name", F.lit(" "), F.lit("_")))
    pct = (F.col("v") / 100).cast("string")
    species = F.concat_ws("\t", clade, F.lit("2|77"), pct, F.lit(""))
    strain = F.concat_ws("\t", F.concat(clade, F.lit("|t__SGB1")), F.lit("2|77|9"), pct)
    taxa = q.select("sample_id", F.explode(F.array(species, strain)).alias("value"))
    kingdom = F.concat_ws("\t", F.lit("k__Bacteria"), (60 + F.col("sample_id") % 40).cast("string"))
    comment = F.lit("#clade_name\trelative_abundance")
    heads = samples(spark, sf).select("sample_id", F.explode(F.array(kingdom, comment)).alias("value"))
    return parse_profile(taxa.unionByName(heads).withColumn("ord", F.xxhash64("value")))


def fragments(spark):
    return spark.createDataFrame(FRAGMENTS, "fragment string, color string, association string")


def samples(spark, sf):
    return table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("sample_id")).distinct()


@query(
    "profile_lines",
    f"""WITH {PROFILE} SELECT sample_id, 's' AS rank, clade, name, round(pct, 6) AS rel_abundance FROM species
UNION ALL SELECT sample_id, 'k', 'k__Bacteria', 'Bacteria', classified FROM share""",
)
def profile_lines(spark, sf):
    return profile(spark, sf).select("sample_id", "rank", "clade", "name", r("rel_abundance").alias("rel_abundance"))


@query(
    "scaled_profile",
    f"""WITH {PROFILE} SELECT sample_id, clade, classified AS total_classified_pct, round(pct * classified / 100, 6) AS relative_abundance,
round(pct, 6) AS within FROM species JOIN share USING (sample_id)""",
)
def scaled_profile(spark, sf):
    out = mb.scale_profile(profile(spark, sf)).where(F.col("rank") == "s")
    return out.select("sample_id", "clade", "total_classified_pct", r("relative_abundance").alias("relative_abundance"), r("within").alias("within"))


@query(
    "ordered_taxa",
    f"""WITH {PROFILE}, o AS (SELECT sample_id, name, row_number() OVER (PARTITION BY sample_id ORDER BY round(-pct, 9), clade) AS place, count(*) OVER (PARTITION BY sample_id) AS n FROM species)
SELECT sample_id, any_value(n) AS n_taxa, max(name) FILTER (place = 1) AS first_name FROM o GROUP BY sample_id""",
)
def ordered_taxa(spark, sf):
    scaled = mb.scale_profile(profile(spark, sf)).where(F.col("rank") == "s")
    scaled = scaled.withColumn("relative_abundance", F.round("within", 9)).withColumn("ord", F.col("clade"))
    taxa = mb.order_taxa(scaled)
    return taxa.select("sample_id", F.size("taxa").cast("long").alias("n_taxa"), F.get("taxa", 0)["name"].alias("first_name"))


@query(
    "genus_rollup",
    f"WITH {PROFILE} SELECT sample_id, genus, round(sum(pct), 6) AS abundance FROM species GROUP BY ALL",
)
def genus_rollup(spark, sf):
    species = mb.scale_profile(profile(spark, sf)).where(F.col("rank") == "s")
    return mb.rollup_genus(species).withColumn("abundance", r("abundance"))


@query(
    "prevalent_features",
    f"""WITH {PROFILE}, n AS (SELECT count(*) AS n FROM t)
SELECT clade, round(count(*) / any_value(n), 6) AS prevalence FROM species, n GROUP BY clade HAVING count(*) / any_value(n) > 0.10""",
)
def prevalent_features(spark, sf):
    long = profile(spark, sf).where(F.col("rank") == "s").select("sample_id", "clade", F.col("rel_abundance").alias("abundance"))
    n = samples(spark, sf).agg(F.count(F.lit(1)).alias("n"))
    return mb.prevalent(long, n).withColumn("prevalence", r("prevalence"))


DIV = f"""{PROFILE}, d AS (SELECT sample_id, count(*) AS richness, -sum(pct / tt * ln(pct / tt)) AS shannon FROM species
  JOIN (SELECT sample_id, sum(pct) AS tt FROM species GROUP BY 1) USING (sample_id) GROUP BY sample_id)"""


def diversities(spark, sf):
    species = profile(spark, sf).where(F.col("rank") == "s")
    return mb.diversity(species, ["sample_id"], "rel_abundance", samples(spark, sf))


@query("sample_diversity", f"WITH {DIV} SELECT sample_id, richness, round(shannon, 6) AS shannon FROM d")
def sample_diversity(spark, sf):
    return diversities(spark, sf).withColumn("shannon", r("shannon"))


@query(
    "diversity_percentiles",
    f"""WITH {DIV} SELECT a.sample_id, a.richness, round((count(*) FILTER (b.richness < a.richness) + count(*) FILTER (b.richness <= a.richness)
  + 1) * 50.0 / count(*), 6) AS richness_percentile FROM d a, d b GROUP BY a.sample_id, a.richness""",
)
def diversity_percentiles(spark, sf):
    d = diversities(spark, sf).select("sample_id", "richness")
    out = inb.percentile_rank(d, d, "richness", "richness", "rank", out="richness_percentile")
    return out.withColumn("richness_percentile", r("richness_percentile"))


@query(
    "own_set_percentiles",
    f"""WITH {PROFILE}, g AS (SELECT sample_id, genus, sum(pct) AS a FROM species GROUP BY ALL HAVING sum(pct * 100) > 600),
d AS (SELECT s.sample_id, o.sample_id AS ref_id, count(*) AS richness, greatest(0, ln(sum(o.a)) - sum(o.a * ln(o.a)) / sum(o.a)) AS shannon
  FROM g s JOIN g o USING (genus) GROUP BY ALL),
f AS (SELECT a.sample_id, COALESCE(d.richness, 0) AS richness, COALESCE(d.shannon, 0) AS shannon
  FROM t a CROSS JOIN t b LEFT JOIN d ON d.sample_id = a.sample_id AND d.ref_id = b.sample_id),
own AS (SELECT t.sample_id, count(genus) AS own FROM t LEFT JOIN g USING (sample_id) GROUP BY 1)
SELECT sample_id, own AS richness, round((count(*) FILTER (f.richness < own) + count(*) FILTER (f.richness <= own)
  + CASE WHEN count(*) FILTER (f.richness = own) > 0 THEN 1 ELSE 0 END) * 50.0 / count(*), 6) AS richness_percentile,
  round(quantile_cont(f.richness, 0.25), 6) AS richness_p25, round(quantile_cont(shannon, 0.5), 6) AS shannon_p50
FROM f JOIN own USING (sample_id) GROUP BY sample_id, own""",
)
def own_set_percentiles(spark, sf):
    """Each sample against all samples, over the genera that it holds itself in quantity."""
    genus = F.replace("p_brand", F.lit("#"), F.lit("")).alias("genus")
    held = quantities(spark, sf).groupBy("sample_id", genus).agg(F.sum("v").alias("v")).where(F.col("v") > 600)
    # Written once: the sets, the profiles and the samples' own diversity are all read from it.
    held = cut_lineage(held.select("sample_id", "genus", (F.col("v").cast("double") / 100).alias("abundance")))
    every = cut_lineage(samples(spark, sf))
    sets = mb.feature_sets(held, every)
    short = cut_lineage(sets.select("set_id").distinct()).withColumn("_n", F.monotonically_increasing_id())  # a number for 64 letters
    sets = cut_lineage(sets.join(short, "set_id").select("sample_id", F.col("_n").alias("set_id"), "members"))
    counts, mid = mb.set_ranks(sets, held.withColumnRenamed("sample_id", "ref_id"), every.count(), 0.5, "shannon_p50")
    counts = cut_lineage(counts)
    own = mb.diversity(held, ["sample_id"], frame=every).join(sets.select("sample_id", "set_id"), "sample_id")
    ranked = inb.percentile_rank(counts, own, "richness", "richness", "rank", ["set_id"], "richness_percentile", weight="w")
    low = exact_quantiles(counts, ["set_id"], "richness", {"richness_p25": 0.25}, weight="w")
    out = ranked.join(low, "set_id").join(mid, "set_id")
    return out.select("sample_id", "richness", *[r(c).alias(c) for c in ("richness_percentile", "richness_p25", "shannon_p50")])


HITS = f"""{PROFILE}, hits AS (SELECT sample_id, fragment, color, association, sum(pct) AS pct FROM species JOIN frag ON contains(clade, fragment) GROUP BY ALL)"""


def hits(spark, sf):
    species = mb.scale_profile(profile(spark, sf)).where(F.col("rank") == "s")
    return mb.pathobiont_hits(species, fragments(spark))


@query("fragment_hits", f"WITH {HITS} SELECT sample_id, fragment, color, association, round(pct, 6) AS pct FROM hits")
def fragment_hits(spark, sf):
    return hits(spark, sf).withColumn("pct", r("pct"))


@query(
    "dysbiosis_index",
    f"""WITH {HITS}, b AS (SELECT sample_id, COALESCE(sum(pct), 0) AS burden FROM t LEFT JOIN hits USING (sample_id) GROUP BY 1)
SELECT sample_id, round(burden, 6) AS pathobiont_burden_pct, round(greatest(0, 100 - burden), 6) AS commensal_pct,
  round(burden / (greatest(0, 100 - burden) + 1e-6), 6) AS dysbiosis_index FROM b""",
)
def dysbiosis_index(spark, sf):
    out = mb.dysbiosis(hits(spark, sf), samples(spark, sf))
    return out.select("sample_id", *[r(c).alias(c) for c in out.columns if c != "sample_id"])


@query(
    "reference_burden",
    f"""WITH {PROFILE}, c AS (SELECT fragment, min(clade) AS clade FROM species JOIN frag ON contains(clade, fragment) GROUP BY 1)
SELECT sample_id AS ref_id, round(COALESCE(sum(pct) FILTER (fragment IS NOT NULL), 0), 4) AS burden FROM t
LEFT JOIN (SELECT sample_id, pct, fragment FROM species JOIN c USING (clade)) USING (sample_id) GROUP BY 1""",
)
def reference_burden(spark, sf):
    """Each name counts one species only: the first in clade order."""
    long = profile(spark, sf).where(is_species(F.col("clade")) & ~is_genus(F.col("clade"))).select(
        F.col("sample_id").alias("ref_id"), "clade", F.col("clade").alias("feature_ord"), (F.col("rel_abundance") / 100).alias("abundance")
    )
    refs = samples(spark, sf).withColumnRenamed("sample_id", "ref_id")
    return mb.ref_burden(long, refs, fragments(spark)).withColumn("burden", r("burden", 4))


@query(
    "aligned_features",
    f"""WITH {PROFILE}, f AS (SELECT clade FROM species GROUP BY 1 HAVING count(*) >= (SELECT count(*) FROM t) * 0.3)
SELECT sample_id, clade, round(COALESCE(pct, 0), 6) AS abundance FROM t CROSS JOIN f LEFT JOIN species USING (sample_id, clade)""",
)
def aligned_features(spark, sf):
    long = profile(spark, sf).where(F.col("rank") == "s").select("sample_id", "clade", F.col("rel_abundance").alias("abundance"))
    n = samples(spark, sf).agg(F.count(F.lit(1)).alias("n"))
    # 0.2999…: prevalence is a strict test and the SQL uses >= 0.3.
    packed = mb.pack_profile(long)
    wanted = mb.prevalent(mb.unpack_profile(packed), n, 0.3 - 1e-9)
    return mb.align_packed(wanted, samples(spark, sf), packed).withColumn("abundance", r("abundance"))


def ridge_inputs(spark, sf):
    v = table(spark, sf, "embeddings")
    n = v.count()
    p = v.select(F.size("embedding")).first()[0]
    rows = v.select(
        F.col("vec_id").alias("row_no"), F.col("label").cast("double").alias("y"), F.transform("embedding", lambda e: e.cast("double")).alias("x")
    )
    return rows, n, p


@query("ridge_models")
def ridge_models(spark, sf):
    """Chosen penalty, R² and first coefficients of every outer fold (checked against NumPy in the tests)."""
    rows, n, p = ridge_inputs(spark, sf)
    models = mb.ridge_cv(rows, n, p)
    return models.select("outer", "alpha", r("r2").alias("r2"), r(F.get("beta", 0)).alias("intercept"), r(F.get("beta", 1)).alias("coef_1"))


@query("ridge_predictions")
def ridge_predictions(spark, sf):
    rows, n, p = ridge_inputs(spark, sf)
    model = mb.ridge_cv(rows, n, p).where(F.col("outer") == -1).select("beta")
    # The model is one row of p + 1 numbers.
    return rows.join(F.broadcast(model), F.lit(True)).select(
        F.col("row_no").alias("sample_id"), r(mb.linear_predict(F.col("x"), F.col("beta"))).alias("predicted")
    )


@query("ridge_top_features")
def ridge_top_features(spark, sf):
    rows, n, p = ridge_inputs(spark, sf)
    model = mb.ridge_cv(rows, n, p).where(F.col("outer") == -1).select("beta")
    features = table(spark, sf, "embeddings").select(F.explode(F.sequence(F.lit(0), F.size("embedding") - 1)).alias("f_idx")).distinct()
    features = features.withColumn("clade", F.concat(F.lit("dim_"), "f_idx"))
    return mb.top_features(model, features).withColumn("coefficient", r("coefficient"))


# The whole nested choice of a penalty on two features, which have a closed form: `best` penalty and model `m` per outer fold.
RIDGE_TWO = """WITH r AS (SELECT vec_id AS row_no, label::DOUBLE AS y, {x1} AS x1, {x2} AS x2 FROM embeddings),
n AS (SELECT count(*) AS n FROM r),
o AS (SELECT -1 AS k, 0 AS ha, 0 AS hb UNION ALL
  SELECT f, f * (n // 5) + least(f, n % 5), (f + 1) * (n // 5) + least(f + 1, n % 5) FROM n, (VALUES (0), (1), (2), (3), (4)) v(f)),
t AS (SELECT k, r.*, row_no - CASE WHEN row_no >= hb THEN hb - ha ELSE 0 END AS rr, (SELECT n FROM n) - (hb - ha) AS m FROM r, o
  WHERE NOT (row_no >= ha AND row_no < hb)),
f AS (SELECT *, CASE WHEN rr < (m % 5) * (m // 5 + 1) THEN rr // (m // 5 + 1) ELSE m % 5 + (rr - (m % 5) * (m // 5 + 1)) // (m // 5) END AS fold FROM t),
s AS (SELECT k, fold, count(*) AS c, sum(x1) AS a, sum(x2) AS b, sum(y) AS e, sum(x1 * x1) AS aa, sum(x1 * x2) AS ab, sum(x2 * x2) AS bb,
  sum(x1 * y) AS ae, sum(x2 * y) AS be FROM f GROUP BY ALL),
w AS (SELECT k, sum(c) AS c, sum(a) AS a, sum(b) AS b, sum(e) AS e, sum(aa) AS aa, sum(ab) AS ab, sum(bb) AS bb, sum(ae) AS ae, sum(be) AS be FROM s GROUP BY k),
tr AS (SELECT k, fold, w.c - s.c AS c, w.a - s.a AS a, w.b - s.b AS b, w.e - s.e AS e, w.aa - s.aa AS aa, w.ab - s.ab AS ab, w.bb - s.bb AS bb,
    w.ae - s.ae AS ae, w.be - s.be AS be FROM w JOIN s USING (k)
  UNION ALL SELECT k, -1, c, a, b, e, aa, ab, bb, ae, be FROM w),
z AS (SELECT k, fold, i, alpha, a / c AS ma, b / c AS mb, e / c AS me, aa - a * a / c + alpha AS p, ab - a * b / c AS q, bb - b * b / c + alpha AS u,
  ae - a * e / c AS g, be - b * e / c AS h FROM tr, (VALUES (0, 0.01::DOUBLE), (1, 0.1), (2, 1.0), (3, 10.0), (4, 100.0)) v(i, alpha)),
m AS (SELECT k, fold, i, alpha, (g * u - h * q) / (p * u - q * q) AS b1, (h * p - g * q) / (p * u - q * q) AS b2,
  me - ma * (g * u - h * q) / (p * u - q * q) - mb * (h * p - g * q) / (p * u - q * q) AS b0 FROM z),
sc AS (SELECT k, fold, i, 1 - sum((y - b0 - b1 * x1 - b2 * x2) ^ 2) / (sum(y * y) - sum(y) ^ 2 / count(*)) AS r2 FROM f JOIN m USING (k, fold) GROUP BY ALL),
best AS (SELECT k, i FROM (SELECT k, i, avg(r2) AS r2 FROM sc GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY k ORDER BY r2 DESC, i) = 1),
held AS (SELECT k, 1 - sum((y - b0 - b1 * x1 - b2 * x2) ^ 2) / (sum(y * y) - sum(y) ^ 2 / count(*)) AS r2
  FROM o JOIN best USING (k) JOIN m USING (k, i) JOIN r ON row_no >= ha AND row_no < hb WHERE fold = -1 GROUP BY k)"""


def ridge_two(x1: str, x2: str, select: str) -> str:
    return RIDGE_TWO.format(x1=x1, x2=x2) + "\n" + select


@query(
    "ridge_two_features",
    ridge_two(
        "embedding[1]::DOUBLE",
        "embedding[2]::DOUBLE",
        """SELECT CAST(k AS INTEGER) AS outer_fold, alpha, round(r2, 6) AS r2, round(b0, 6) AS intercept, round(b1, 6) AS coef_1, round(b2, 6) AS coef_2
FROM best JOIN m USING (k, i) LEFT JOIN held USING (k) WHERE fold = -1""",
    ),
)
def ridge_two_features(spark, sf):
    """The whole nested choice of a penalty, on two features, which have a closed form."""
    rows, n, _ = ridge_inputs(spark, sf)
    models = mb.ridge_cv(rows.withColumn("x", F.slice("x", 1, 2)), n, 2)
    beta = lambda i: r(F.get("beta", i))
    return models.select(
        F.col("outer").alias("outer_fold"), "alpha", r("r2").alias("r2"), beta(0).alias("intercept"), beta(1).alias("coef_1"), beta(2).alias("coef_2")
    )


SHARES = ["log10(CASE WHEN abs(embedding[%d]) < 0.05 THEN 0 ELSE abs(embedding[%d])::DOUBLE END + 0.00001)" % (i, i) for i in (1, 2)]


def share_model(spark, sf):
    """Two features as shares of a profile, of which small ones are absent: the profile's rows, the features, the model."""
    long = table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("sample_id"), F.col("label").cast("double").alias("y"), F.posexplode(F.slice("embedding", 1, 2)).alias("f_idx", "e")
    ).withColumn("v", F.abs("e").cast("double"))
    value = mb.log_abundance(F.when(F.col("v") < F.lit(0.05).cast("float"), 0.0).otherwise(F.col("v")))
    rows = long.groupBy(F.col("sample_id").alias("row_no"), "y").agg(F.transform(F.array_sort(F.collect_list(F.struct("f_idx", value.alias("x")))), lambda p: p["x"]).alias("x"))
    features = spark.createDataFrame([("a", 0), ("b", 1)], "clade string, f_idx int")
    profile = long.where(F.col("v") >= F.lit(0.05).cast("float")).join(features, "f_idx").select("sample_id", "clade", F.col("v").alias("abundance"))
    model = mb.ridge_cv(rows, rows.count(), 2).where(F.col("outer") == -1).select("beta")
    return long.select("sample_id").distinct(), profile, features, model


@query(
    "ridge_two_ages",
    ridge_two(*SHARES, "SELECT row_no AS sample_id, round(b0 + b1 * x1 + b2 * x2, 6) AS predicted FROM r, best JOIN m USING (k, i) WHERE k = -1 AND fold = -1"),
)
def ridge_two_ages(spark, sf):
    """Values predicted from a profile without its absent features."""
    samples, profile, features, model = share_model(spark, sf)
    return mb.predict_age(features, samples, profile, model).withColumn("predicted", r("predicted"))


@query(
    "ridge_two_top",
    ridge_two(*SHARES, """SELECT CASE WHEN abs(b1) >= abs(b2) THEN 'a' ELSE 'b' END AS clade,
  round(CASE WHEN abs(b1) >= abs(b2) THEN b1 ELSE b2 END, 6) AS coefficient FROM best JOIN m USING (k, i) WHERE k = -1 AND fold = -1"""),
)
def ridge_two_top(spark, sf):
    """The feature with the largest coefficient."""
    _, _, features, model = share_model(spark, sf)
    return mb.top_features(model, features, 1).select("clade", r("coefficient").alias("coefficient"))
