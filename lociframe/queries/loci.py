"""Known-site and coat-rule queries: suppliers are samples, line items their calls and reads at the known sites."""

from __future__ import annotations

from pyspark.sql import functions as F

from lociframe.fixed_values import KNOWN_SITES, LOCUS_TEXT, PIGMENTS, PROXY_REMARK
from lociframe.operators import loci as lc
from lociframe.operators.reads import counts_map
from lociframe.queries.base import query, table


def _q(v):
    return "NULL" if v is None else str(v) if isinstance(v, int) else "'" + v.replace("'", "''") + "'"


_SITES = ", ".join("(" + ", ".join(_q(v) for v in (i, *row)) + ")" for i, row in enumerate(KNOWN_SITES))
HITS = f"""
sites(site_ord, locus, chrom, pos, exp_ref, exp_alt, allele, inheritance, effect) AS (VALUES {_SITES}),
line AS (SELECT l_suppkey AS sample_id, (l_partkey * 7 + l_orderkey) % 12 AS so, * FROM lineitem),
hits AS (SELECT sample_id, so AS site_ord, CASE WHEN l_returnflag = 'A' THEN COALESCE(exp_alt, 'G') ELSE COALESCE(exp_ref, 'A') END AS ref,
    CASE WHEN l_returnflag = 'A' THEN COALESCE(exp_ref, 'A') ELSE COALESCE(exp_alt, 'G') END AS alt, l_tax AS raf,
    ['0|0', '0|1', '1|1', './.', '0|0', '1|2', '1/1'][l_linenumber] AS gt, 0.5 + l_discount * 5 AS gp_max
  FROM line JOIN sites ON so = site_ord WHERE (sample_id + so) % 4 <> 0
  QUALIFY row_number() OVER (PARTITION BY sample_id, so ORDER BY l_orderkey DESC, l_linenumber DESC, l_partkey DESC, l_extendedprice DESC) = 1),
piles AS (SELECT sample_id, so AS site_ord, count(*) AS total, count(*) FILTER (l_linestatus = 'F') AS n_a FROM line
  WHERE (sample_id + so) % 4 = 0 GROUP BY ALL HAVING count(*) >= 5),
calls AS (
  SELECT u.sample_id, s.*, h.gt, h.raf, h.gp_max AS max_gp, h.sample_id IS NOT NULL AS hit, h.sample_id IS NOT NULL OR p.total IS NOT NULL AS found,
    h.gp_max >= 0.8 AND h.ref = s.exp_alt AND h.alt = s.exp_ref AS swapped,
    length(h.gt) - length(replace(h.gt, '1', '')) AS n1, CASE WHEN h.sample_id IS NULL THEN p.total END AS total,
    CASE WHEN h.sample_id IS NULL THEN p.n_a END AS n_a
  FROM (SELECT DISTINCT l_suppkey AS sample_id FROM lineitem) u CROSS JOIN sites s
  LEFT JOIN hits h ON h.sample_id = u.sample_id AND h.site_ord = s.site_ord
  LEFT JOIN piles p ON p.sample_id = u.sample_id AND p.site_ord = s.site_ord),
final AS (
  SELECT *, CASE WHEN hit THEN CAST(CASE WHEN COALESCE(swapped, FALSE) THEN 2 - n1 ELSE n1 END AS INTEGER) END AS n_alt,
    CASE WHEN hit THEN CASE WHEN max_gp >= 0.9 THEN 'high' WHEN max_gp >= 0.8 THEN 'medium' ELSE 'low' END
      WHEN total >= 15 THEN 'medium' WHEN total >= 5 THEN 'low' ELSE 'none' END AS conf FROM calls)"""
EVIDENCE = f"""{HITS},
ev AS (
  SELECT sample_id, bool_or(locus = 'E' AND found) AS found_e, bool_or(locus = 'K' AND found) AS found_k,
    bool_or(locus = 'A' AND found) AS found_a, bool_or(locus = 'S' AND found) AS found_s,
    max(n_alt) FILTER (locus = 'E' AND allele = 'e') AS n_e, max(n_alt) FILTER (locus = 'E' AND allele = 'Em') AS n_em,
    max(n_alt) FILTER (locus = 'K') AS n_kb, max(n_alt) FILTER (locus = 'S') AS n_sp,
    count(*) FILTER (locus = 'E' AND allele = 'e' AND n_alt = 2 AND pos <> 64186854) = 0 AS proxy_only,
    COALESCE(max(n_a) FILTER (locus = 'E' AND pos = 63922309), 0) AS causal_reads,
    max(total) FILTER (locus = 'E' AND pos = 63922309) AS causal_depth,
    count(*) FILTER (locus = 'A' AND n_alt = 2) AS a2, count(*) FILTER (locus = 'A' AND n_alt = 1) AS a1,
    count(*) FILTER (locus = 'B' AND n_alt = 2) AS b2, count(*) FILTER (locus = 'B' AND n_alt = 1) AS b1, count(n_alt) FILTER (locus = 'B') AS bn,
    count(*) FILTER (locus = 'D' AND n_alt = 2) AS d2, count(*) FILTER (locus = 'D' AND n_alt = 1) AS d1, count(n_alt) FILTER (locus = 'D') AS dn
  FROM final GROUP BY sample_id),
g AS (
  SELECT sample_id,
    CASE WHEN NOT found_e THEN '?/? low' WHEN n_e = 2 AND proxy_only AND causal_reads = 0 THEN 'e/e low'
      WHEN n_e = 2 AND proxy_only THEN 'e/e medium' WHEN n_e = 2 THEN 'e/e high'
      WHEN n_e = 1 AND COALESCE(n_em, 0) >= 1 THEN 'Em/e medium' WHEN n_e = 1 THEN 'E/e medium'
      WHEN COALESCE(n_em, 0) >= 1 THEN 'Em/E medium' ELSE 'E/E medium' END AS e,
    CASE WHEN NOT found_k THEN '?/? low' WHEN n_kb = 2 THEN 'KB/KB high' WHEN n_kb = 1 THEN 'KB/ky high' ELSE 'ky/ky high' END AS k,
    CASE WHEN NOT found_a THEN '?/? low' WHEN a2 > 0 OR a1 >= 2 THEN 'at/at medium' WHEN a1 = 1 THEN 'ay/?/at low' ELSE 'ay/?/ay/? low' END AS a,
    CASE WHEN bn = 0 THEN '?/? low' WHEN b2 > 0 OR b1 >= 2 THEN 'b/b high' WHEN b1 = 1 THEN 'b/? low' ELSE 'B/B high' END AS b,
    CASE WHEN dn = 0 THEN '?/? low' WHEN d2 > 0 OR d1 >= 2 THEN 'd/d high' WHEN d1 = 1 THEN 'D/d high' ELSE 'D/D high' END AS d,
    CASE WHEN NOT found_s THEN '?/? low' WHEN n_sp = 2 THEN 'sp/sp medium' WHEN n_sp = 1 THEN 'S/sp medium' ELSE 'S/S medium' END AS s
  FROM ev)"""


def site_calls(spark, sf):
    sites = lc.known_sites(spark)
    used = ["l_suppkey", "l_partkey", "l_orderkey", "l_linenumber", "l_quantity", "l_discount", "l_tax", "l_extendedprice", "l_returnflag", "l_linestatus"]
    line = table(spark, sf, "lineitem").select(*used).withColumns(
        {
            "sample_id": F.col("l_suppkey"),
            "so": ((F.col("l_partkey") * 7 + F.col("l_orderkey")) % 12).cast("int"),
        }
    )
    place = F.broadcast(sites.select("site_ord", "chrom", "pos", "exp_ref", "exp_alt"))  # twelve fixed rows
    read = (F.col("sample_id") + F.col("so")) % 4 == 0  # every line is a call or, at every fourth site, a read
    exp_ref, exp_alt = F.coalesce("exp_ref", F.lit("A")), F.coalesce("exp_alt", F.lit("G"))
    back = F.col("l_returnflag") == "A"
    codes = F.array(*[F.lit(g) for g in ("0|0", "0|1", "1|1", "./.", "0|0", "1|2", "1/1")])
    calls = line.where(~read).join(place, F.col("so") == F.col("site_ord")).select(
        "sample_id", "chrom", "pos",
        F.when(back, exp_alt).otherwise(exp_ref).alias("ref"),
        F.when(back, exp_ref).otherwise(exp_alt).alias("alt"),
        F.col("l_tax").alias("raf"),
        F.element_at(codes, F.col("l_linenumber")).alias("gt"),
        F.array(F.lit(0.0), 0.5 - F.col("l_discount") * 5, 0.5 + F.col("l_discount") * 5).alias("gp"),
        F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice").alias("ord"),
    )
    per_base = (
        line.where(read)
        .join(place, F.col("so") == F.col("site_ord"))
        .groupBy("sample_id", "chrom", "pos", F.when(F.col("l_linestatus") == "F", "A").otherwise("C").alias("base"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    piles = counts_map(per_base, ["sample_id", "chrom", "pos"])
    return lc.loci_calls(line.select("sample_id").distinct(), calls, piles)


def genotypes(spark, sf):
    return lc.call_loci(lc.locus_evidence(site_calls(spark, sf)))


@query(
    "known_site_calls",
    f"WITH {HITS} SELECT sample_id, CAST(site_ord AS INTEGER) AS site_ord, found, conf, n_alt, total FROM final",
)
def known_site_calls(spark, sf):
    return site_calls(spark, sf).select("sample_id", "site_ord", "found", "conf", "n_alt", "total")


@query(
    "allele_copies",
    f"WITH {HITS} SELECT sample_id, locus, allele, max(n_alt) AS copies FROM final GROUP BY ALL",
)
def allele_copies(spark, sf):
    return lc.allele_copies(site_calls(spark, sf))


@query("locus_genotypes", f"WITH {EVIDENCE} SELECT * FROM g")
def locus_genotypes(spark, sf):
    rows = genotypes(spark, sf)
    shown = [F.concat(f"{l}.a1", F.lit("/"), f"{l}.a2", F.lit(" "), f"{l}.conf").alias(l.lower()) for l in "EKABDS"]
    return rows.select("sample_id", *shown)


@query(
    "coat_phenotype",
    f"""WITH {EVIDENCE},
c AS (SELECT *, CASE WHEN b = 'b/b high' AND d = 'd/d high' THEN 'isabella/lilac' WHEN b = 'b/b high' THEN 'chocolate'
    WHEN b = 'b/? low' AND d = 'd/d high' THEN 'isabella/lilac or blue/grey' WHEN b = 'b/? low' THEN 'chocolate or black'
    WHEN d = 'd/d high' THEN 'blue/grey' ELSE 'black' END AS pig FROM g)
SELECT sample_id,
  CASE WHEN starts_with(e, 'e/e') THEN 'red' WHEN starts_with(k, 'KB') THEN 'Eumelanin — solid ' || pig
    WHEN contains(a, 'at') THEN 'Eumelanin — ' || pig || ' with tan points'
    ELSE 'Eumelanin base — ' || pig || ' (A locus undetermined)' END AS base_color,
  CASE WHEN starts_with(e, 'e/e') THEN 'Not applicable to coat (phaeomelanin unaffected by D locus)'
    WHEN d = 'd/d high' AND starts_with(k, 'KB') THEN 'Dilute (d/d) — ' || pig || ' coat'
    WHEN d = 'd/d high' THEN 'Dilute (d/d) — ' || pig || ' eumelanin' ELSE 'Full pigment (D/D or D/d)' END AS dilution,
  CASE WHEN e NOT LIKE '% low' AND k NOT LIKE '% low' AND b NOT LIKE '% low' AND d NOT LIKE '% low' THEN 'medium' ELSE 'low' END AS overall_confidence,
  CASE WHEN e = 'e/e low' THEN CASE WHEN starts_with(k, 'KB') AND b = 'b/b high' THEN 'chocolate' WHEN starts_with(k, 'KB') THEN 'black'
    WHEN b = 'b/b high' THEN 'chocolate or sable (A locus)' ELSE 'black or sable (A locus)' END END AS proxy_false_positive_prediction
FROM c""",
)
def coat_phenotype(spark, sf):
    rows = lc.predict_phenotype(lc.validate_E(genotypes(spark, sf)))
    base = F.when(F.col("predicted_base_color").startswith("Phaeomelanin"), "red").otherwise(F.col("predicted_base_color"))
    return rows.select(
        "sample_id", base.alias("base_color"), F.col("predicted_dilution").alias("dilution"), "overall_confidence",
        "proxy_false_positive_prediction",
    )


_TEXTS = ", ".join(f"({_q(k)}, {_q(v)})" for k, v in LOCUS_TEXT.items())


@query(
    "locus_interpretations",
    f"""WITH {EVIDENCE}, t(code, text) AS (VALUES {_TEXTS}),
codes AS (SELECT sample_id, 'K' AS locus, CASE k WHEN '?/? low' THEN 'K_missing' WHEN 'KB/KB high' THEN 'K_2' WHEN 'KB/ky high' THEN 'K_1' ELSE 'K_0' END AS code FROM g
  UNION ALL SELECT sample_id, 'D', CASE d WHEN '?/? low' THEN 'D_missing' WHEN 'd/d high' THEN 'D_dd' WHEN 'D/d high' THEN 'D_one' ELSE 'D_DD' END FROM g
  UNION ALL SELECT sample_id, 'M', 'M' FROM g UNION ALL SELECT sample_id, 'W', 'W' FROM g)
SELECT sample_id, locus, text FROM codes JOIN t USING (code)""",
)
def locus_interpretations(spark, sf):
    rows = genotypes(spark, sf)
    pairs = F.array(*[F.struct(F.lit(l).alias("locus"), F.col(f"{l}.text").alias("text")) for l in "KDMW"])
    return rows.select("sample_id", F.explode(pairs).alias("x")).select("sample_id", "x.*")


_PIGMENTS = ", ".join(f"({_q(k)}, {_q(c)}, {_q(n)})" for k, (c, n) in PIGMENTS.items())
_DOUBT = "CASE WHEN starts_with(k, 'KB') THEN CASE WHEN b = 'b/b high' THEN 'chocolate' ELSE 'black' END WHEN b = 'b/b high' THEN 'chocolate or sable (A locus)' ELSE 'black or sable (A locus)' END"


@query(
    "extension_texts",
    f"""WITH {EVIDENCE}, t(code, text) AS (VALUES {_TEXTS}),
codes AS (SELECT sample_id, e, k, b, {_DOUBT} AS doubt, causal_depth, CASE e WHEN '?/? low' THEN 'E_missing' WHEN 'e/e low' THEN 'E_proxy_low' WHEN 'e/e medium' THEN 'E_proxy_medium'
  WHEN 'e/e high' THEN 'E_ee' WHEN 'Em/e medium' THEN 'E_Em_e' WHEN 'E/e medium' THEN 'E_E_e' WHEN 'Em/E medium' THEN 'E_Em_E' ELSE 'E_E_E' END AS code FROM g JOIN ev USING (sample_id))
SELECT sample_id, CASE WHEN code <> 'E_proxy_low' THEN text ELSE
  replace(text, '{{reads}}', CASE WHEN causal_depth > 0 THEN causal_depth || ' reads, all reference' ELSE 'no reads' END)
  || replace(replace(replace({_q(PROXY_REMARK)}, '{{colour}}', doubt), '{{k1}}/{{k2}}', split_part(k, ' ', 1)), '{{b1}}/{{b2}}', split_part(b, ' ', 1)) END AS text
FROM codes JOIN t USING (code)""",
)
def extension_texts(spark, sf):
    return lc.validate_E(genotypes(spark, sf)).select("sample_id", F.col("E.text").alias("text"))


@query(
    "predicted_patterns",
    f"""WITH {EVIDENCE}, p(code, c, nose) AS (VALUES {_PIGMENTS}),
x AS (SELECT *, CASE WHEN b = 'b/b high' AND d = 'd/d high' THEN 'bb_dd' WHEN b = 'b/b high' THEN 'bb' WHEN b = 'b/? low' AND d = 'd/d high' THEN 'b?_dd'
    WHEN b = 'b/? low' THEN 'b?' WHEN d = 'd/d high' THEN 'dd' ELSE 'black' END AS code, CASE WHEN contains(e, 'Em') THEN ' with melanistic mask (Em)' ELSE '' END AS mask FROM g),
y AS (SELECT *, upper(c[1]) || c[2:] AS cap, upper(nose[1]) || nose[2:] AS cap_nose FROM x JOIN p USING (code))
SELECT sample_id, CASE WHEN starts_with(e, 'e/e')
    THEN 'Solid phaeomelanin coat — no eumelanin in hair regardless of K or A locus. Skin pigment (' || nose || ') is determined by B and D loci independently.'
  WHEN starts_with(k, 'KB') THEN 'Solid ' || c || mask || ' — KB dominant black suppresses A locus entirely. ' || cap_nose || '.'
  WHEN contains(a, 'at') THEN cap || '-based tan points' || mask || ' — ' || c || ' body with phaeomelanin markings on muzzle, eyebrows, chest, inner ears, and lower legs. ' || cap_nose || '.'
  ELSE cap || '-based coat' || mask || '; A locus pattern unknown (sable/agouti/tan-points require structural variant analysis). ' || cap_nose || '.' END AS pattern
FROM y""",
)
def predicted_patterns(spark, sf):
    return lc.predict_phenotype(genotypes(spark, sf)).select("sample_id", F.col("predicted_pattern").alias("pattern"))


@query(
    "locus_documents",
    f"""WITH {HITS} SELECT sample_id, locus, count(*) AS n_observed, string_agg(CAST(pos AS VARCHAR), ',' ORDER BY site_ord) AS positions,
  round(sum(CASE WHEN hit THEN 1 - raf END), 4) AS af_sum FROM final WHERE found GROUP BY ALL""",
)
def locus_documents(spark, sf):
    docs = lc.locus_document(site_calls(spark, sf))
    pos = F.transform("observed_variants", lambda d: d["pos"].cast("string"))
    afs = F.filter(F.transform("observed_variants", lambda d: d["af"].cast("double")), lambda x: x.isNotNull())
    total = F.aggregate(afs, F.lit(0.0), lambda acc, x: acc + x)
    return docs.select(
        "sample_id", "locus", F.size("observed_variants").cast("long").alias("n_observed"), F.array_join(pos, ",").alias("positions"),
        F.when(F.size(afs) > 0, F.round(total, 4)).alias("af_sum"),
    )
