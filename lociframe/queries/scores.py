"""Ancestry and trait-score queries on embeddings, part, supplier and orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from lociframe.fixed_values import COAT_LENGTH
from lociframe.operators import ancestry as anc
from lociframe.operators import scores as sc
from lociframe.queries.base import query, r, table
from lociframe.session import cut_lineage
from lociframe.sources.plink import unpack_genotypes

# Genotypes: the sign and size of each embedding value as 0, 1, 2 or missing; individuals are vectors.
LONG = """
long AS (SELECT vec_id AS ind_idx, label, unnest(range(0, len(embedding))) AS snp_idx, unnest(embedding) AS e FROM embeddings),
geno AS (SELECT ind_idx, label, CAST(snp_idx AS BIGINT) AS snp_idx,
  CASE WHEN e < -0.1 THEN 0.0 WHEN e < 0 THEN 1.0 WHEN e < 0.2 THEN 2.0 END AS g FROM long)"""


def geno(spark, sf):
    vectors = table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("ind_idx"), "label", F.posexplode("embedding").alias("snp_idx", "e")
    )
    g = F.when(F.col("e") < -0.1, 0.0).when(F.col("e") < 0, 1.0).when(F.col("e") < 0.2, 2.0)
    return vectors.select("ind_idx", "label", F.col("snp_idx").cast("long").alias("snp_idx"), g.alias("g"))


def mixture_inputs(spark, sf):
    long = table(spark, sf, "embeddings").select("vec_id", "label", F.posexplode("embedding").alias("snp_idx", "e"))
    means = long.groupBy("snp_idx", "label").agg((F.avg("e") + 0.5).alias("p"))
    components = means.groupBy("snp_idx").agg(F.transform(F.array_sort(F.collect_list(F.struct("label", "p"))), lambda x: x["p"]).alias("p"))
    dosages = long.select(F.col("vec_id").alias("sample_id"), "snp_idx", (F.col("e").cast("double") + 0.5).alias("dosage"))
    return dosages, components


@query("ancestry_mixture")
def ancestry_mixture(spark, sf):
    """Every vector as a non-negative mixture of the ten label means (checked by its optimality conditions in tests)."""
    dosages, components = mixture_inputs(spark, sf)
    return anc.project_mixture(dosages, components, 10, block=16).withColumn("proportion", r("proportion"))


@query(
    "ancestry_two",
    """WITH long AS (SELECT vec_id, label, unnest(range(0, len(embedding))) AS snp, unnest(embedding)::DOUBLE AS e FROM embeddings),
p AS (SELECT snp, avg(e) FILTER (label % 2 = 0) + 0.5 AS p1, avg(e) FILTER (label % 2 = 1) + 0.5 AS p2 FROM long GROUP BY snp),
d AS (SELECT vec_id, snp, e + 0.5 AS x FROM long WHERE snp % 7 <> vec_id % 7 AND (vec_id % 5 <> 0 OR snp < 9)),
s AS (SELECT vec_id, count(*) AS n, sum(p1 * p1) + 1 AS g11, sum(p1 * p2) + 1 AS g12, sum(p2 * p2) + 1 AS g22, sum(p1 * x) + 1 AS r1, sum(p2 * x) + 1 AS r2
  FROM d JOIN p USING (snp) GROUP BY vec_id),
u AS (SELECT *, (r1 * g22 - r2 * g12) / (g11 * g22 - g12 * g12) AS u1, (r2 * g11 - r1 * g12) / (g11 * g22 - g12 * g12) AS u2,
  greatest(r1, 0) ^ 2 / g11 >= greatest(r2, 0) ^ 2 / g22 AS one FROM s),
q AS (SELECT vec_id, n, CASE WHEN u1 >= 0 AND u2 >= 0 THEN u1 WHEN one THEN greatest(r1, 0) / g11 ELSE 0 END AS q1,
  CASE WHEN u1 >= 0 AND u2 >= 0 THEN u2 WHEN one THEN 0 ELSE greatest(r2, 0) / g22 END AS q2 FROM u)
SELECT vec_id AS sample_id, CAST(k AS INTEGER) AS k, round(CASE k WHEN 0 THEN q1 ELSE q2 END / (q1 + q2 + 1e-12), 6) AS proportion, n AS snps_used
FROM q, (VALUES (0), (1)) v(k)""",
)
def ancestry_two(spark, sf):
    """Two components, which have a closed form; vectors lack a seventh of their SNPs, every fifth one all but a few."""
    long = table(spark, sf, "embeddings").select("vec_id", "label", F.posexplode("embedding").alias("snp_idx", "e")).withColumn("e", F.col("e").cast("double"))
    mean = lambda rest: F.avg(F.when(F.col("label") % 2 == rest, F.col("e"))) + 0.5
    components = long.groupBy("snp_idx").agg(F.array(mean(0), mean(1)).alias("p"))
    kept = (F.col("snp_idx") % 7 != F.col("vec_id") % 7) & ((F.col("vec_id") % 5 != 0) | (F.col("snp_idx") < 9))
    dosages = long.where(kept).select(F.col("vec_id").alias("sample_id"), "snp_idx", (F.col("e") + 0.5).alias("dosage"))
    return anc.project_mixture(dosages, components, 2, block=16).withColumn("proportion", r("proportion"))


SHARES = """
shares AS (SELECT l_suppkey AS sample_id, p_type AS breed, sum(l_quantity) / sum(sum(l_quantity)) OVER (PARTITION BY l_suppkey) AS proportion
  FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY l_suppkey, p_type)"""


def shares(spark, sf):
    line = table(spark, sf, "lineitem").select("l_suppkey", "l_partkey", "l_quantity")
    part = table(spark, sf, "part").select("p_partkey", "p_type")
    per = line.join(part, F.col("l_partkey") == F.col("p_partkey")).groupBy(F.col("l_suppkey").alias("sample_id"), F.col("p_type").alias("breed"))
    sums = per.agg(F.sum("l_quantity").alias("q"))
    totals = sums.groupBy("sample_id").agg(F.sum("q").alias("t"))
    return sums.join(totals, "sample_id").select("sample_id", "breed", (F.col("q") / F.col("t")).alias("proportion"))


@query(
    "top_components",
    f"""WITH {SHARES} SELECT sample_id, breed, round(proportion, 6) AS proportion, CAST(rn AS INTEGER) AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY proportion DESC, breed) AS rn FROM shares WHERE proportion > 0.15)
WHERE rn <= 3""",
)
def top_components(spark, sf):
    out = anc.top_components(shares(spark, sf), 3, 0.15, tie="breed")
    return out.withColumn("proportion", r("proportion"))


@query(
    "decoded_names",
    """SELECT c_custkey, COALESCE(CASE WHEN n_nationkey % 3 <> 0 THEN n_name END, CAST(c_nationkey AS VARCHAR)) AS breed_name
FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey""",
)
def decoded_names(spark, sf):
    """Names for two thirds of the codes; the code itself otherwise."""
    names = table(spark, sf, "nation").where(F.col("n_nationkey") % 3 != 0).select(
        F.col("n_nationkey").cast("string").alias("code"), F.col("n_name").alias("name")
    )
    people = table(spark, sf, "customer").select("c_custkey", F.col("c_nationkey").cast("string").alias("breed"))
    return anc.decode(people, names, "breed", "name", "breed_name").select("c_custkey", "breed_name")


@query(
    "ordered_labels",
    """WITH f AS (SELECT p_brand AS label, min(p_partkey) AS o FROM part GROUP BY 1)
SELECT CAST(row_number() OVER (ORDER BY o) - 1 AS INTEGER) AS k, label FROM f""",
)
def ordered_labels(spark, sf):
    lines = table(spark, sf, "part").select(F.col("p_brand").alias("label"), F.col("p_partkey").alias("ord"))
    return anc.ordered_labels(lines)


@query(
    "two_hop_trait",
    """SELECT c_custkey, r_name AS region FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
WHERE r_name <> 'ASIA'""",
)
def two_hop_trait(spark, sf):
    """Code → name → value; codes whose value is missing drop out."""
    customers = table(spark, sf, "customer").select("c_custkey", F.col("c_nationkey").alias("breed"))
    names = table(spark, sf, "nation").select(F.col("n_nationkey").alias("code"), F.col("n_regionkey").alias("name"))
    values = table(spark, sf, "region").where(F.col("r_name") != "ASIA").select(
        F.col("r_regionkey").alias("breed_name"), F.lit("region").alias("trait"), F.col("r_name").alias("value")
    )
    found = sc.breed_trait(customers, names, values)
    return customers.join(found, "breed").select("c_custkey", F.col("value").alias("region"))


@query(
    "unmatched_codes",
    """SELECT DISTINCT CAST(c_nationkey AS VARCHAR) AS breed, n_regionkey AS breed_name FROM customer
JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey IN (SELECT r_regionkey FROM region WHERE r_name = 'ASIA')""",
)
def unmatched_codes(spark, sf):
    customers = table(spark, sf, "customer").select(F.col("c_nationkey").cast("string").alias("breed"))
    names = table(spark, sf, "nation").select(F.col("n_nationkey").cast("string").alias("code"), F.col("n_regionkey").alias("name"))
    values = table(spark, sf, "region").where(F.col("r_name") != "ASIA").select(F.col("r_regionkey").alias("breed_name"))
    return sc.unmatched_codes(customers, names, values)


@query(
    "thinned_sites",
    """SELECT sample_id, ord FROM (SELECT l_suppkey AS sample_id, l_orderkey * 10 + l_linenumber AS ord,
  row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey * 10 + l_linenumber) AS rn
  FROM (SELECT DISTINCT l_suppkey, l_orderkey, l_linenumber FROM lineitem)) WHERE (rn - 1) % 5 = 0""",
)
def thinned_sites(spark, sf):
    rows = table(spark, sf, "lineitem").select(
        F.col("l_suppkey").alias("sample_id"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ord")
    ).distinct()
    return sc.thin(rows, 5, order="ord")


@query(
    "mean_imputed",
    f"""WITH {LONG}, m AS (SELECT snp_idx, avg(g) AS mean FROM geno GROUP BY 1)
SELECT snp_idx, ind_idx, round(COALESCE(g, mean), 6) AS g FROM geno JOIN m USING (snp_idx)""",
)
def mean_imputed(spark, sf):
    return sc.impute_mean(geno(spark, sf)).select("snp_idx", "ind_idx", r("g").alias("g"))


BETA = f"""{LONG},
m AS (SELECT snp_idx, avg(g) AS mean FROM geno GROUP BY 1),
filled AS (SELECT ind_idx, label, snp_idx, COALESCE(g, mean) AS g FROM geno JOIN m USING (snp_idx)),
y AS (SELECT 'label' AS trait, vec_id AS ind_idx, CAST(label AS DOUBLE) AS y FROM embeddings WHERE label < 8
  UNION ALL SELECT 'even', vec_id, CAST(label % 2 = 0 AS INTEGER)::DOUBLE FROM embeddings),
sums AS (SELECT trait, snp_idx, covar_pop(g, y) * count(*) AS gy, var_pop(g) * count(*) AS gg FROM filled JOIN y USING (ind_idx) GROUP BY ALL),
beta AS (SELECT trait, snp_idx, gy / (gg + 0.1 * avg(gg) OVER (PARTITION BY trait)) AS beta FROM sums)"""


def traits(spark, sf):
    v = table(spark, sf, "embeddings")
    one = v.where(F.col("label") < 8).select(F.lit("label").alias("trait"), F.col("vec_id").alias("ind_idx"), F.col("label").cast("double").alias("y"))
    even = v.select(F.lit("even").alias("trait"), F.col("vec_id").alias("ind_idx"), sc.one_vs_rest((F.col("label") % 2).cast("string"), "0").alias("y"))
    return one.unionByName(even)


def filled(spark, sf):
    return sc.impute_mean(geno(spark, sf))


@query("marginal_ridge", f"WITH {BETA} SELECT trait, snp_idx, round(beta, 6) AS beta FROM beta")
def marginal_ridge(spark, sf):
    return sc.marginal_ridge(filled(spark, sf), traits(spark, sf)).withColumn("beta", r("beta"))


SCORED = f"""{BETA},
scored AS MATERIALIZED (SELECT trait, ind_idx, sum(g * beta) AS sc FROM filled JOIN beta USING (snp_idx) GROUP BY ALL),
refs AS (SELECT c.* FROM scored c SEMI JOIN y USING (trait, ind_idx)),
st AS (SELECT trait, avg(sc) AS mu, stddev_pop(sc) AS sd FROM refs GROUP BY trait),
std AS (SELECT c.trait, c.ind_idx AS sample_id, c.sc AS score, (c.sc - mu) / (sd + 1e-8) AS prs_z FROM scored c JOIN st USING (trait))"""


def standardised(spark, sf):
    g, y = filled(spark, sf), traits(spark, sf)
    betas = sc.marginal_ridge(g, y)
    every = cut_lineage(sc.weighted_sum(g, betas, "g", ["ind_idx"], ["snp_idx"], "score"))  # scores and reference share rows
    valid = every.join(y.select("trait", "ind_idx"), ["trait", "ind_idx"], "left_semi").withColumnRenamed("score", "ref_score")
    return sc.score_and_standardise(every.withColumnRenamed("ind_idx", "sample_id"), valid)


@query(
    "standardised_scores",
    f"""WITH {SCORED}, n AS (SELECT trait, count(*) AS n FROM refs GROUP BY trait),
p AS (SELECT s.trait, s.sample_id, count(*) AS upto FROM std s JOIN refs r ON r.trait = s.trait AND r.sc <= s.score GROUP BY ALL)
SELECT trait, sample_id, round(score, 5) AS score, round(prs_z, 5) AS prs_z, round(100.0 * COALESCE(upto, 0) / n, 6) AS percentile
FROM std JOIN n USING (trait) LEFT JOIN p USING (trait, sample_id)""",
)
def standardised_scores(spark, sf):
    out = standardised(spark, sf)
    return out.select("trait", "sample_id", r("score", 5).alias("score"), r("prs_z", 5).alias("prs_z"), r("percentile").alias("percentile"))


@query("rescaled_scores", f"""WITH {SCORED}, b AS (SELECT 'label' AS trait, label, label::DOUBLE AS v FROM embeddings WHERE label < 8 GROUP BY ALL
  UNION ALL SELECT 'even', label, (label % 2 = 0)::INTEGER::DOUBLE FROM embeddings GROUP BY ALL),
u AS (SELECT trait, avg(v) AS mu, stddev_pop(v) AS sd FROM b GROUP BY trait)
SELECT trait, sample_id, round(greatest(1, least(5, mu + prs_z * sd)), 5) AS predicted FROM std JOIN u USING (trait)""")
def rescaled_scores(spark, sf):
    v = table(spark, sf, "embeddings").select("label").distinct()
    breeds = v.where(F.col("label") < 8).select(F.lit("label").alias("trait"), F.col("label").cast("double").alias("value")).unionByName(
        v.select(F.lit("even").alias("trait"), (F.col("label") % 2 == 0).cast("double").alias("value"))
    )
    out = sc.rescale_score(standardised(spark, sf), breeds, 1.0, 5.0)
    return out.select("trait", "sample_id", r("predicted", 5).alias("predicted"))


@query(
    "eligible_groups",
    "SELECT p_brand AS trait, count(p_retailprice) AS n_breeds FROM part GROUP BY 1 HAVING count(p_retailprice) >= 20",
)
def eligible_groups(spark, sf):
    values = table(spark, sf, "part").select(F.col("p_brand").alias("trait"), F.col("p_retailprice").alias("value"))
    return sc.eligible_traits(values)


@query(
    "encoded_categories",
    """WITH x AS (SELECT p_partkey, CASE p_type WHEN 'SMALL' THEN 'Short' WHEN 'MEDIUM' THEN 'Medium' WHEN 'LARGE' THEN 'Long' ELSE '' END AS len,
  p_size * 0.07 AS v FROM part)
SELECT p_partkey, CASE len WHEN 'Short' THEN 1.0::DOUBLE WHEN 'Medium' THEN 2.0 WHEN 'Long' THEN 3.0 END AS ordinal,
  CASE WHEN len <> '' THEN (len = 'Long')::INTEGER::DOUBLE END AS is_long,
  CASE WHEN v <= 1.5 THEN 'Short' WHEN v <= 2.5 THEN 'Medium' ELSE 'Long' END AS nearest FROM x""",
)
def encoded_categories(spark, sf):
    kind = (
        F.when(F.col("p_type") == "SMALL", "Short").when(F.col("p_type") == "MEDIUM", "Medium").when(F.col("p_type") == "LARGE", "Long").otherwise("")
    )
    rows = table(spark, sf, "part").select("p_partkey", kind.alias("len"), (F.col("p_size") * 0.07).alias("v"))
    return rows.select(
        "p_partkey",
        sc.ordinal_code(F.col("len"), COAT_LENGTH).alias("ordinal"),
        sc.one_vs_rest(F.col("len"), "Long").alias("is_long"),
        sc.nearest_level(F.col("v"), COAT_LENGTH).alias("nearest"),
    )


@query(
    "best_category",
    f"WITH {SHARES} SELECT sample_id, breed, round(proportion, 6) AS proportion FROM shares "
    "QUALIFY row_number() OVER (PARTITION BY sample_id ORDER BY proportion DESC, breed) = 1",
)
def best_category(spark, sf):
    return sc.argmax_category(shares(spark, sf), ["sample_id"], "proportion", "breed").withColumn("proportion", r("proportion"))


@query(
    "carried_attributes",
    """SELECT o_orderkey, c_mktsegment AS heritability FROM orders LEFT JOIN customer ON o_custkey = c_custkey AND c_acctbal > 0""",
)
def carried_attributes(spark, sf):
    reference = table(spark, sf, "customer").where(F.col("c_acctbal") > 0).select(
        F.col("c_custkey").alias("o_custkey"), F.col("c_mktsegment").alias("heritability")
    )
    return sc.carry_over(table(spark, sf, "orders").select("o_orderkey", "o_custkey"), reference, "o_custkey", ["heritability"]).drop("o_custkey")


@query(
    "unpacked_genotypes",
    """WITH b AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(l_quantity AS INTEGER) * 5 AS b0, l_linenumber * 31 AS b1 FROM lineitem),
x AS (SELECT *, unnest(range(0, 7)) AS j FROM b),
c AS (SELECT *, (CASE WHEN j < 4 THEN b0 ELSE b1 END >> CAST(2 * (j % 4) AS INTEGER)) & 3 AS code FROM x)
SELECT j AS ind_idx, CASE code WHEN 0 THEN 0 WHEN 2 THEN 1 WHEN 3 THEN 2 END AS g, count(*) AS n FROM c GROUP BY ALL""",
)
def unpacked_genotypes(spark, sf):
    """Two bytes per row hold the genotypes of seven individuals."""
    hexed = F.concat(F.lpad(F.hex((F.col("l_quantity") * 5).cast("long")), 2, "0"), F.lpad(F.hex((F.col("l_linenumber") * 31).cast("long")), 2, "0"))
    rows = table(spark, sf, "lineitem").select(F.concat_ws("/", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("snp_idx"), F.unhex(hexed).alias("packed"))
    return unpack_genotypes(rows, 7).groupBy(F.col("ind_idx").cast("long").alias("ind_idx"), F.col("g").cast("int").alias("g")).agg(F.count(F.lit(1)).alias("n"))
