"""Border cases of the operators on hand-made rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F
from table_rows import rows

from lociframe import fixed_values as fv
from lociframe.functions import genotypes as gt
from lociframe.functions.text import clean_label, format_bp, in_scope, is_autosome, is_fusion_name, natural_key, sentence_case
from lociframe.operators import ancestry as anc
from lociframe.operators import annotation as ann
from lociframe.operators import catalogue as cat
from lociframe.operators import coverage as cov
from lociframe.operators import loci as lc
from lociframe.operators import microbiome as mb
from lociframe.operators import reads as rd
from lociframe.operators import regions as reg
from lociframe.operators import scores as sc


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def test_tiles_short_last_and_empty_contig(spark):
    contigs = spark.createDataFrame([("chr1", 25), ("chr2", 0), ("chr3", 10)], "chrom string, length long")
    assert rows(cov.tile(contigs, 10), "chrom", "start", "end") == [("chr1", 0, 10), ("chr1", 10, 20), ("chr1", 20, 25), ("chr3", 0, 10)]
    widths = spark.createDataFrame([("a", 10), ("b", 20)], "sample_id string, width long")
    assert rows(cov.tile_by(contigs, widths).where("chrom = 'chr1'"), "sample_id", "start", "end") == [
        ("a", 0, 10), ("a", 10, 20), ("a", 20, 25), ("b", 0, 20), ("b", 20, 25)
    ]


def test_adaptive_width_clamps(spark):
    cov_rows = spark.createDataFrame([("deep", 0, 100, 2000), ("two", 0, 100, 200), ("thin", 0, 100, 1)], "sample_id string, start long, end long, bases long")
    assert rows(cov.adaptive_width(cov_rows)) == [("deep", 15000), ("thin", 200000), ("two", 25000)]


def test_window_coverage_splits_reads(spark):
    reads = spark.createDataFrame([("s", "c", 5, 25), ("s", "c", 10, 20), ("s", "c", 9, 9)], "sample_id string, chrom string, start long, end long")
    assert rows(cov.window_coverage(reads, 10), "bin_idx", "bases") == [(0, 5), (1, 20), (2, 5)]


def test_par_threshold_and_sex(spark):
    def ratio(d):
        return one(spark, cov.sex_aware_ratio(F.lit(d), F.lit(10.0), F.lit(True)))

    assert ratio(7.5) == 0.75 and ratio(7.4) == 1.48 and ratio(0.0) == 0.0
    base = spark.createDataFrame([("m", 10.0, 7.49), ("f", 10.0, 7.5), ("none", 10.0, None)], "sample_id string, baseline double, x_median double")
    assert rows(cov.predict_sex(base), "sample_id", "predicted_sex") == [("f", "female"), ("m", "male"), ("none", "female")]


def test_low_window_is_strict(spark):
    w = spark.createDataFrame([("s", "c", i, d) for i, d in enumerate([1.0, 1.0, 1.0, 0.15 * 3.15 / 3.85])], "sample_id string, chrom string, start long, depth double")
    mean = np.mean([1.0, 1.0, 1.0, 0.15 * 3.15 / 3.85])
    assert rows(reg.low_windows(w), "start") == ([(3,)] if 0.15 * 3.15 / 3.85 < 0.15 * mean else [])
    even = spark.createDataFrame([("s", "c", 0, 0.15), ("s", "c", 1, 1.85)], "sample_id string, chrom string, start long, depth double")
    assert rows(reg.low_windows(even), "start") == []


def test_region_rules(spark):
    assert one(spark, reg.region_verdict(F.lit(79))) == "mappability_artefact"
    assert one(spark, reg.region_verdict(F.lit(80))) == one(spark, reg.region_verdict(F.lit(None).cast("int"))) == "putative_deletion"
    assert one(spark, reg.keep_region(F.lit(49_999), F.lit(0))) is False and one(spark, reg.keep_region(F.lit(50_000), F.lit(0)))
    assert [one(spark, format_bp(F.lit(n))) for n in (999, 1000, 45_999, 1_250_000)] == ["999bp", "1kb", "45kb", "1.25Mb"]


def test_gene_borders(spark):
    regions = spark.createDataFrame([("s", "c", 100, 200)], "sample_id string, chrom string, start long, end long")
    ex = "array<struct<s:bigint,e:bigint>>"
    genes = spark.createDataFrame(
        [("c", 1, "touch", "b", 200, 300, [(200, 250)]), ("c", 2, "inside", "b", 100, 200, [(150, 160)]), ("c", 3, "away", "b", 201, 300, []), ("c", 4, "none", "b", 50, 120, None)],
        f"chrom string, gene_ord long, gene string, biotype string, gene_start long, gene_end long, exons {ex}",
    )
    got = rows(reg.overlap_genes(regions, genes), "gene", "overlap", "exon_overlap")
    assert got == [("inside", "full", "exonic"), ("none", "partial", "intronic"), ("touch", "partial", "intronic")]


def test_ref_depth_without_bins_is_null(spark):
    regions = spark.createDataFrame([("s", "c", 500_000, 1_500_000), ("s", "d", 0, 10)], "sample_id string, chrom string, start long, end long")
    panel = spark.createDataFrame([("c", 0, 1.0), ("c", 1, 0.6), ("d", 0, 0.0)], "chrom string, bin_idx long, ratio double")
    assert rows(reg.ref_depth(regions, panel), "chrom", "ref_depth_pct") == [("c", 80), ("d", None)]


@pytest.mark.parametrize(
    ("gp", "passes", "tier"), [([0.0, 0.1, 0.9], True, "high"), ([0.0, 0.2, 0.8], False, "medium"), ([0.1, 0.2, 0.79], False, "low"), (None, False, "low")]
)
def test_posterior_borders(spark, gp, passes, tier):
    col = F.lit(None).cast("array<double>") if gp is None else F.array(*[F.lit(x) for x in gp])
    assert one(spark, gt.passes_posterior(col)) is passes
    assert one(spark, gt.posterior_tier(gt.max_posterior(col))) == tier


def test_read_call_borders(spark):
    counts = spark.createDataFrame(
        [("a", {"A": 9, "G": 1}), ("b", {"A": 1, "G": 19}), ("c", {"A": 3, "G": 1}), ("d", {"A": 4, "T": 9}), ("e", {"A": 10, "G": 90})],
        "k string, counts map<string,bigint>",
    ).withColumns({"ref": F.lit("a"), "alt": F.lit("g"), "total": F.expr("aggregate(map_values(counts), 0L, (x, y) -> x + y)")})
    got = rows(rd.call_from_counts(counts), "k", "read_zygosity", "read_confidence")
    assert got == [("a", "het", "medium"), ("b", "alt/alt", "high"), ("c", None, None), ("d", None, None), ("e", "het", "high")]
    assert [one(spark, rd.tier_counts(F.lit(n))) for n in (4, 5, 14, 15)] == ["none", "low", "low", "medium"]


def test_match_panel_last_rows_win(spark):
    snps = spark.createDataFrame([(0, "1", 5, "A", "G"), (1, "1", 5, "G", "A"), (2, "1", 9, "A", "C")], "snp_idx long, chrom string, pos long, a1 string, a2 string")
    calls = spark.createDataFrame(
        [("s", 1, "chr1", 5, "A", "G", [1.0, 0.0, 0.0]), ("s", 2, "chr1", 5, "A", "G", [0.0, 0.0, 1.0]), ("s", 3, "chr1", 9, "A", "T", [1.0, 0.0, 0.0]), ("s", 4, "chr1", 9, "A", "C", [1.0])],
        "sample_id string, ord long, chrom string, pos long, ref string, alt string, gp array<double>",
    )
    got = cat.match_panel(snps, calls)
    assert rows(got.select("snp_idx", gt.dosage_first(F.col("ref"), F.col("a1"), F.col("gp")))) == [(1, 2.0)]
    assert rows(got.select("snp_idx", gt.dosage_second(F.col("alt"), F.col("a2"), F.col("gp")))) == [(1, 0.0)]


def test_best_effect_inside_the_row(spark):
    text = "G|a|MODERATE|G1|i,G|b|HIGH|G1|i,T|c|HIGH|G2|i,G|d|MODERATE|G2|i,G|e|MODERATE|G2|i,G|f|LOW|G3|i,G|g|HIGH||i,bad"
    df = spark.createDataFrame([("s", 1, "G", text), ("s", 2, "G,T", text)], "sample_id string, ord long, alt string, ann_text string")
    assert rows(ann.best_effect(df), "ord", "gene_name", "impact", "effect") == [(1, "G1", "HIGH", "b"), (1, "G2", "MODERATE", "d")]


def test_names_and_orders(spark):
    df = spark.createDataFrame([(c,) for c in ("chrX", "chr10", "chr2", "chrM", "chrUn_1")], "c string")
    assert [r["c"] for r in df.orderBy(*natural_key(F.col("c"))).collect()] == ["chr2", "chr10", "chrM", "chrUn_1", "chrX"]
    assert rows(df.where(in_scope(F.col("c")))) == [("chr10",), ("chr2",), ("chrX",)]
    assert one(spark, is_autosome(F.lit("chr38"))) and not one(spark, is_autosome(F.lit("chr39"))) and not one(spark, is_autosome(F.lit("chrX")))
    assert one(spark, is_fusion_name(F.lit("ABCDE-FGHIJ"))) and not one(spark, is_fusion_name(F.lit("ABCD-FGHIJ")))
    assert one(spark, clean_label(F.lit(" Great Dane "))) == "Great Dane"
    assert one(spark, sentence_case(F.lit("blue/grey Nose"))) == "Blue/grey nose"


def test_duplicates_with_one_signature_holding_most_rows(spark):
    data = [(i, "hot" if i % 3 else f"k{i}", i % 7) for i in range(300)]
    df = spark.createDataFrame(data, "read_id long, sig string, score int")
    got = {r["read_id"]: r["is_duplicate"] for r in rd.mark_duplicates(df, ["sig"], "score").collect()}
    best = {}
    for i, s, score in data:
        if s not in best or (-score, i) < best[s]:
            best[s] = (-score, i)
    assert got == {i: best[s][1] != i for i, s, _ in data}


def test_mates_count_once_and_orphans_are_left_out(spark):
    q = [30] * 4
    reads = spark.createDataFrame(
        [("s", "r1", 3, "c", 10, 13, 60, "ACGT", q), ("s", "r1", 3, "c", 12, 15, 60, "TTTT", [20] * 4), ("s", "r2", 1, "c", 10, 13, 60, "GGGG", q),
         ("s", "r3", 3, "c", 10, 13, 19, "CCCC", q), ("s", "r4", 0, "c", 12, 15, 60, "acgt", [19, 30, 30, 30])],
        "sample_id string, read_id string, flag int, chrom string, pos long, end long, mapq int, seq string, qual array<int>",
    )
    sites = spark.createDataFrame([("c", 12), ("c", 13)], "chrom string, pos long")
    got = {r["pos"]: dict(r["counts"]) for r in rd.pileup(reads, sites, bucket=5).collect()}
    assert got == {12: {"G": 1}, 13: {"T": 1, "C": 1}}


def test_clean_reads_length_and_tail(spark):
    rows_in = [("a", "A" + "C" * 2 + "ACGT" * 9), ("b", "ACGT" * 9), ("c", "ACGT" * 8 + "ACG"), ("d", "ACGT" * 9 + "G" * 12), ("e", "ACGT" * 9 + "G" * 5)]
    df = spark.createDataFrame([(i, s, [30] * len(s)) for i, s in rows_in], "id string, seq string, qual array<int>")
    got = {r["id"]: (len(r["seq"]), len(r["qual"])) for r in rd.clean_reads(df).collect()}
    assert got == {"a": (39, 39), "b": (36, 36), "d": (36, 36), "e": (41, 41)}


def evidence(spark, **given):
    base = {
        "sample_id": "s", "found_E": True, "found_K": True, "found_A": True, "found_S": True, "n_e": 0, "n_em": 0, "n_kb": 0, "n_sp": 0,
        "e_proxy_only": False, "e_causal_reads": 0, "e_causal_depth": 0, "A_hom": False, "A_hets": 0, "A_n": 2, "B_hom": False, "B_hets": 0, "B_n": 2, "D_hom": False,
        "D_hets": 0, "D_n": 2,
    }
    row = {**base, **given}
    kinds = {bool: "boolean", int: "int", str: "string"}
    return spark.createDataFrame([tuple(row.values())], ", ".join(f"{k} {kinds[type(base[k])]}" for k in row))


CASES = [
    ({"n_e": 2, "e_proxy_only": True}, "E", ("e", "e", "low")),
    ({"n_e": 2, "e_proxy_only": True, "e_causal_reads": 1}, "E", ("e", "e", "medium")),
    ({"n_e": 2}, "E", ("e", "e", "high")),
    ({"n_e": 1, "n_em": 1}, "E", ("Em", "e", "medium")),
    ({"n_e": None, "n_em": 2}, "E", ("Em", "E", "medium")),
    ({"n_kb": None}, "K", ("ky", "ky", "high")),
    ({"A_hets": 2}, "A", ("at", "at", "medium")),
    ({"A_hets": 1}, "A", ("ay/?", "at", "low")),
    ({"B_hets": 1}, "B", ("b", "?", "low")),
    ({"B_n": 0}, "B", ("?", "?", "low")),
    ({"D_hets": 1}, "D", ("D", "d", "high")),
    ({"n_sp": 1}, "S", ("S", "sp", "medium")),
]


@pytest.mark.parametrize(("given", "locus", "want"), CASES)
def test_locus_rules(spark, given, locus, want):
    got = lc.call_loci(evidence(spark, **given)).first()[locus]
    assert (got["a1"], got["a2"], got["conf"]) == want


def test_phenotype_precedence(spark):
    def look(**given):
        return lc.predict_phenotype(lc.validate_E(lc.call_loci(evidence(spark, **given)))).first()

    red = look(n_e=2, e_proxy_only=True, n_kb=1, B_hom=True)
    assert red["predicted_base_color"].startswith("Phaeomelanin") and red["proxy_false_positive_prediction"] == "chocolate"
    assert "shows no reads," in red["E"]["text"] and red["E"]["text"].endswith("distinguish e/e (cream/yellow) from chocolate.")
    assert "shows 7 reads, all reference," in look(n_e=2, e_proxy_only=True, e_causal_depth=7)["E"]["text"]
    assert red["predicted_dilution"] == fv.DILUTION_NA and red["overall_confidence"] == "low"
    assert look(n_kb=2, D_hom=True)["predicted_base_color"] == "Eumelanin — solid blue/grey"
    assert look(A_hom=True)["predicted_base_color"] == "Eumelanin — black with tan points"
    plain = look()
    assert plain["predicted_base_color"] == "Eumelanin base — black (A locus undetermined)" and plain["overall_confidence"] == "medium"
    masked = look(n_em=1, n_kb=1)
    assert "with melanistic mask (Em)" in masked["predicted_pattern"] and "Black nose and pads." in masked["predicted_pattern"]


def test_mixture_meets_its_optimality_conditions(spark):
    rng = np.random.default_rng(1)
    k, n = 6, 90
    p = rng.random((n, k))
    truth = np.array([[0.7, 0.3, 0, 0, 0, 0], [0, 0, 0, 0.2, 0.8, 0], [0, 0.1, 0.1, 0.1, 0.1, 0.6]])
    data, kept = [], []
    for s, q in enumerate(truth):
        ok = rng.random(n) > (0.1 if s else 0.7)
        x = 2 * p @ q + rng.normal(0, 0.1, n)
        kept.append((ok, x))
        data += [(f"s{s}", i, float(x[i])) for i in range(n) if ok[i]]
    got = anc.project_mixture(
        spark.createDataFrame(data, "sample_id string, snp_idx long, dosage double"),
        spark.createDataFrame([(i, row.tolist()) for i, row in enumerate(p)], "snp_idx long, p array<double>"), k, block=16,
    ).collect()
    for s, (ok, x) in enumerate(kept):
        share = np.array([r["proportion"] for r in sorted(got, key=lambda r: r["k"]) if r["sample_id"] == f"s{s}"])
        assert {r["snps_used"] for r in got if r["sample_id"] == f"s{s}"} == {int(ok.sum())}
        a, b = np.vstack([p[ok], np.ones(k)]), np.append(x[ok], 1.0)
        raw = anc.nonnegative_solve(a.T @ a, a.T @ b)
        slope = a.T @ (b - a @ raw)
        assert (raw >= 0).all() and (slope <= 1e-6).all() and abs(slope @ raw) < 1e-6
        assert np.allclose(share, raw / raw.sum(), atol=1e-6)


def numpy_ridge_cv(x, y, alphas, folds):
    def fit(xt, yt, a):
        xm, ym = xt.mean(0), yt.mean()
        coef = np.linalg.solve((xt - xm).T @ (xt - xm) + a * np.eye(x.shape[1]), (xt - xm).T @ (yt - ym))
        return ym - xm @ coef, coef

    def r2(model, xs, ys):
        return 1 - ((ys - model[0] - xs @ model[1]) ** 2).sum() / ((ys - ys.mean()) ** 2).sum()

    def choose(xt, yt):
        parts = np.array_split(np.arange(len(yt)), folds)
        means = []
        for a in alphas:
            means.append(np.mean([r2(fit(np.delete(xt, t, 0), np.delete(yt, t), a), xt[t], yt[t]) for t in parts]))
        best = alphas[int(np.argmax(means))]
        return best, fit(xt, yt, best)

    out = {-1: (*choose(x, y), None)}
    for o, t in enumerate(np.array_split(np.arange(len(y)), folds)):
        a, m = choose(np.delete(x, t, 0), np.delete(y, t))
        out[o] = (a, m, r2(m, x[t], y[t]), np.abs(y[t] - m[0] - x[t] @ m[1]).mean())
    return out


@pytest.mark.parametrize(("n", "p"), [(53, 7), (31, 1100)])
def test_nested_ridge_matches_numpy(spark, n, p):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(n, p))
    y = x @ rng.normal(size=p) + rng.normal(0, 2, n)
    rows_in = spark.createDataFrame([(i, float(y[i]), x[i].tolist()) for i in range(n)], "row_no long, y double, x array<double>")
    models = mb.ridge_cv(rows_in, n, p, block=8)
    got = {r["outer"]: r for r in models.collect()}
    want = numpy_ridge_cv(x, y, list(mb.ALPHAS), 5)
    assert set(got) == set(want)
    for o, w in want.items():
        assert got[o]["alpha"] == w[0]
        assert np.allclose(got[o]["beta"], [w[1][0], *w[1][1]])
    m = mb.cv_metrics(rows_in, models, n).first()
    assert abs(m["cv_r2"] - np.mean([want[o][2] for o in range(5)])) < 1e-9
    assert abs(m["cv_mae"] - np.mean([want[o][3] for o in range(5)])) < 1e-9


def test_age_prediction_equals_the_dense_dot_product(spark):
    features = spark.createDataFrame([("a", 0), ("b", 1)], "clade string, f_idx int")
    samples = spark.createDataFrame([("s",), ("empty",)], "sample_id string")
    profile = spark.createDataFrame([("s", "a", 3.0), ("s", "zzz", 9.0)], "sample_id string, clade string, abundance double")
    model = spark.createDataFrame([([1.0, 2.0, -1.0],)], "beta array<double>")
    got = {r["sample_id"]: r["predicted"] for r in mb.predict_age(features, samples, profile, model).collect()}
    log = lambda v: np.log10(v + 1e-5)
    assert abs(got["s"] - (1 + 2 * log(3.0) - log(0))) < 1e-9 and abs(got["empty"] - (1 + 2 * log(0) - log(0))) < 1e-9


def test_diversity_and_prevalence_borders(spark):
    long = spark.createDataFrame([("s", "a", 2.0), ("s", "b", 2.0), ("s", "c", 0.0)], "sample_id string, clade string, abundance double")
    frame = spark.createDataFrame([("s",), ("none",)], "sample_id string")
    got = {r["sample_id"]: (r["richness"], round(r["shannon"], 9)) for r in mb.diversity(long, ["sample_id"], frame=frame).collect()}
    assert got == {"s": (2, round(float(np.log(2)), 9)), "none": (0, 0.0)}
    ref = spark.createDataFrame([(i, c, 1.0) for c, n in (("ten", 10), ("eleven", 11)) for i in range(n)], "ref_id long, clade string, abundance double")
    assert rows(mb.prevalent(ref, spark.createDataFrame([(100,)], "n long")), "clade") == [("eleven",)]


def test_zero_share_gives_null(spark):
    profile = spark.createDataFrame([("s", 1, "k__Archaea", "k", "Archaea", 5.0), ("s", 2, "x|s__a", "s", "a", 50.0)], "sample_id string, ord long, clade string, rank string, name string, rel_abundance double")
    assert rows(mb.scale_profile(profile).where("rank = 's'"), "relative_abundance", "within") == [(0.0, None)]


def test_small_traits_are_left_out(spark):
    geno = spark.createDataFrame([(s, i, float((s + i) % 3)) for s in range(4) for i in range(40)], "snp_idx long, ind_idx int, g double")
    y = spark.createDataFrame([("big", i, float(i % 5)) for i in range(30)] + [("small", i, 1.0) for i in range(29)], "trait string, ind_idx int, y double")
    assert {r["trait"] for r in sc.marginal_ridge(geno, y).collect()} == {"big"}


def test_trait_scores_match_numpy(spark):
    rng = np.random.default_rng(3)
    n_snp, n_ind = 40, 60
    g = rng.integers(0, 3, (n_snp, n_ind)).astype(float)
    g[rng.random(g.shape) < 0.1] = np.nan
    breeds = [f"b{i % 12}" for i in range(n_ind)]
    value = {f"b{i}": float(i) for i in range(10)}
    dosage = rng.random(n_snp) * 2
    lost = {"s": {3, 8}, "t": {3, 8}, "u": set(), "v": set(range(11, 30))}  # s and t share a set, the others have their own
    gain = {"s": 1.0, "t": 0.5, "u": 0.9, "v": 0.7}
    d = [(n, i, float(dosage[i]) * gain[n]) for n in lost for i in range(n_snp) if i not in lost[n]]
    out = sc.trait_scores(
        spark.createDataFrame(d, "sample_id string, snp_idx long, dosage double"),
        spark.createDataFrame([(s, i, None if np.isnan(g[s, i]) else float(g[s, i])) for s in range(n_snp) for i in range(n_ind)], "snp_idx long, ind_idx int, g double"),
        spark.createDataFrame(list(enumerate(breeds)), "ind_idx int, breed string"),
        spark.createDataFrame([(b, "t", v) for b, v in value.items()] + [(b, "w", v * v % 7) for b, v in value.items()], "breed string, trait string, value double"),
    ).collect()
    assert len(out) == 8
    for r in out:
        idx = [i for i in range(n_snp) if i not in lost[r.sample_id]][::5]
        sub = g[idx]
        sub = np.where(np.isnan(sub), np.nanmean(sub, axis=1, keepdims=True), sub)
        y = np.array([np.nan if b not in value else value[b] if r.trait == "t" else value[b] ** 2 % 7 for b in breeds])
        ok = ~np.isnan(y)
        gc = sub[:, ok] - sub[:, ok].mean(axis=1, keepdims=True)
        var = (gc**2).sum(axis=1)
        beta = gc @ (y[ok] - y[ok].mean()) / (var + 0.1 * var.mean())
        ref = (sub.T @ beta)[ok]
        raw = beta @ dosage[idx] * gain[r.sample_id]
        assert abs(r.prs_z - (raw - ref.mean()) / (ref.std() + 1e-8)) < 1e-6
        assert abs(r.percentile - np.mean(ref <= raw) * 100) < 1e-9 and r.n_snps_used == len(idx)


def test_breed_tables_join(spark):
    from lociframe.breed_tables import adult_sizes, trait_names

    panel = spark.createDataFrame([("GOLD",), ("ECKR",), ("XYZ",)], "breed string")
    got = rows(sc.breed_trait(panel, trait_names(spark), adult_sizes(spark)), "breed", "trait", "value")
    assert got == [("GOLD", "height_cm", "58.0"), ("GOLD", "weight_kg", "30.0")]
    assert rows(sc.unmatched_codes(panel, trait_names(spark), adult_sizes(spark)), "breed") == [("ECKR",), ("XYZ",)]


def test_catalogue_gate_takes_posteriors_at_four_decimals(spark):
    table = "cat_id long, ref string, alt string, pos long, in_panel boolean, gt string, gp array<double>, mean_depth double, counts map<string,long>, total long"
    given = [(k, "A", "C", 5, True, "0|1", [0.0, p, 1 - p], 3.0, {}, 0) for k, p in enumerate((0.89994, 0.89996, 0.9))]
    got = {r.cat_id: r.zygosity for r in cat.call_with_fallback(spark.createDataFrame(given, table)).collect()}
    assert got == {0: "low_gp_no_call", 1: "het", 2: "het"}


def plain_walk(cigar, pos):
    """Aligned (place on the reference, place in the read) pairs, deleted and skipped places, and both clips."""
    import re

    r, q, aligned, deleted, skipped, lead, tail = pos, 0, [], [], [], 0, 0
    for n, op in re.findall(r"(\d+)([MIDNSHP=X])", cigar):
        n = int(n)
        if op in "M=X":
            aligned += [(r + k, q + k) for k in range(n)]
        if op in "DN":
            (deleted if op == "D" else skipped).extend(range(r, r + n))
        if op in "SH":
            lead, tail = (lead + n, tail) if not aligned else (lead, tail + n)
        r += n if op in "M=XDN" else 0
        q += n if op in "M=XIS" else 0
    return aligned, deleted, skipped, lead, tail


def test_cigar_walk_on_random_reads(spark):
    import random

    from lociframe.functions.cigar import five_prime, walk, with_blocks

    rng, cases = random.Random(8), []
    for i in range(120):
        clips = rng.choice(["", "3S", "2H", "1H4S"]), rng.choice(["", "5S", "1S2H"])
        middle = "".join(f"{rng.randint(1, 9)}{rng.choice('IDNMP=X')}" for _ in range(rng.randint(0, 8)))
        cases.append((f"r{i}", f"{clips[0]}{rng.randint(1, 9)}M{middle}4M{clips[1]}", 100 + i, rng.choice([0, 16])))
    df = spark.createDataFrame(cases, "read_id string, cigar string, pos long, flag int").withColumn("end", F.col("pos") + 9)
    got = df.withColumn("w", walk(F.col("cigar"), F.col("pos"))).withColumn("p", five_prime(F.col("w"), F.col("pos"), F.col("flag"))).collect()
    for r in got:
        aligned, deleted, skipped, lead, tail = plain_walk(r.cigar, r.pos)
        assert [(b.start + k, b.q + k) for b in r.w.blocks for k in range(b.end - b.start + 1)] == aligned
        assert [x for s in r.w.deleted for x in range(s.start, s.end + 1)] == deleted
        assert [x for s in r.w.skipped for x in range(s.start, s.end + 1)] == skipped
        assert (r.w.lead, r.w.tail) == (lead, tail)
        last = max([r.pos - 1, *[a for a, _ in aligned], *deleted, *skipped])
        assert r.p == (last + tail if r.flag & 16 else r.pos - lead)
    spans = {r.read_id: (r.b_start, r.b_end) for r in with_blocks(df, gaps=True).collect()}
    assert all(spans[r.read_id] == (r.pos, r.w.r - 1) for r in got) and len(spans) == len(got)
    bare = spark.createDataFrame([("a", None, 5, 0), ("b", "*", 6, 0), ("c", "", 7, 0)], "read_id string, cigar string, pos long, flag int").withColumn("end", F.col("pos") + 9)
    assert rows(with_blocks(bare), "read_id", "b_start", "b_end", "b_q") == [("a", 5, 14, 0), ("b", 6, 15, 0), ("c", 7, 16, 0)]


def test_pileup_passes_over_deleted_and_skipped_bases(spark):
    read = ("S", "r", 0, "chr1", 10, 40, 60, "AACCGGTT", [30] * 8, 0, "2S2M1D2M5N2M")  # bases from the third on are aligned
    columns = "sample_id string, read_id string, flag int, chrom string, pos long, end long, mapq int, seq string, qual array<int>, mate_pos long, cigar string"
    sites = spark.createDataFrame([("chr1", p) for p in range(5, 30)], "chrom string, pos long")
    got = {r["pos"]: dict(r["counts"]) for r in rd.pileup(spark.createDataFrame([read], columns), sites, bucket=4).collect()}
    assert got == {10: {"C": 1}, 11: {"C": 1}, 13: {"G": 1}, 14: {"G": 1}, 20: {"T": 1}, 21: {"T": 1}}


def test_duplicates_agree_in_the_unclipped_start(spark):
    columns = "sample_id string, read_id string, flag int, chrom string, pos long, end long, mapq int, seq string, qual array<int>, mate_pos long, cigar string"
    made = [
        ("a", 0, 10, "10M", 30), ("b", 0, 13, "3S7M", 20), ("c", 0, 12, "2H8M", 25), ("d", 0, 13, "10M", 30),  # a, b and c start at 10
        ("e", 16, 10, "8M2S", 20), ("f", 16, 12, "8M", 30), ("g", 16, 12, "4M2D2M", 10),  # all end at 19
        ("h", 256, 10, "10M", 40), ("i", 4, 10, None, 40),
    ]
    reads = spark.createDataFrame([("S", n, f, "chr1", p, p + 9, 60, "A" * 10, [q] * 10, 100, c) for n, f, p, c, q in made], columns)
    assert {r["read_id"] for r in rd.mark_read_duplicates(reads).where("is_duplicate").collect()} == {"b", "c", "e", "g"}


def test_coverage_from_events_equals_counting(spark):
    import random

    rng = random.Random(3)
    spans = [(rng.choice("ST"), rng.choice(["c1", "c2"]), s, s + rng.randint(0, 60)) for s in (rng.randint(-5, 230) for _ in range(300))]
    contigs = spark.createDataFrame([("c1", 201), ("c2", 77), ("c3", 5)], "chrom string, length long")
    widths = spark.createDataFrame([("S", 7), ("S", 50), ("T", 300)], "sample_id string, width long")
    tiles = cov.tile_by(contigs, widths)
    events = cov.depth_events(spark.createDataFrame(spans, "sample_id string, chrom string, start long, end long"))
    got = {(r.sample_id, r.chrom, r.width, r.start): (r.end, r.bases) for r in cov.integrate_events(events, tiles).collect()}
    assert len(got) == tiles.count()
    for (sample, chrom, _, start), (end, bases) in got.items():
        assert bases == sum(max(0, min(b, end) - max(a, start)) for s, c, a, b in spans if (s, c) == (sample, chrom))
