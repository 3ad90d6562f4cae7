"""A small deterministic cohort: two to four samples on chr1, chr2, chr5 and chrX."""

import random

from pyspark.sql import functions as F

from lociframe import fixed_values as fv
from lociframe import schemas
from lociframe.sources.taxa import melt_reference, parse_profile

QUAL = [30] * 100
LENGTHS = {"chr1": 3_500_000, "chr2": 2_000_000, "chr5": 1_200_000, "chrX": 2_500_000}


def build(spark, names=("S1", "S2", "S3"), seed=42):
    inputs = {}
    inputs["contigs"] = spark.createDataFrame([*LENGTHS.items()], schemas.CONTIGS)
    reads, calls, annotated, profiles = [], [], [], []
    for si, name in enumerate(names):
        rng = random.Random(f"{seed}-{name}")
        for chrom, length in LENGTHS.items():
            male_x = chrom == "chrX" and si % 2 == 0
            for i in range(length // (20_000 if male_x else 10_000)):
                pos = rng.randrange(1, length - 2000)
                if chrom == "chr1" and 1_200_000 <= pos < 1_400_000 and si == 0:
                    continue  # a deletion of the first sample
                flag = rng.choice([3, 3, 3, 1027, 4])
                reads.append((name, f"{name}{chrom}{i}", flag, chrom, pos, pos + 99, rng.choice([60, 60, 10]), "ACGT" * 25, QUAL, pos))
        ordinal = 0
        for chrom, length in (("chr1", 3_500_000), ("chr2", 2_000_000)):
            for pos in range(1000, length, 10_000):
                ordinal += 1
                p = rng.random()
                g = [round(1 - p, 3), round(p * 0.4, 3), round(p * 0.6, 3)]
                gt = rng.choice(["0|0"] * 8 + ["0|1"]) if chrom == "chr1" else rng.choice(["0|1", "1|1", "./."])
                calls.append((name, ordinal, chrom, pos, "A", ["G"], [round(rng.random(), 3)], gt, g))
        for site in fv.KNOWN_SITES[1:]:
            ordinal += 1
            calls.append((name, ordinal, site[1], site[2], site[3] or "A", [site[4] or "G"], [0.29], rng.choice(["0|1", "1|1", "0|0"]), [0.02, 0.03, 0.95]))
        for i, pos in enumerate(range(1_190_000, 1_420_000, 10_000)):
            ann = f"G|missense_variant|MODERATE|GENE{i % 3}|ENS{i % 3}|t|x|protein_coding,G|stop_gained|HIGH|OTHER|ENSO|t|x|protein_coding"
            annotated.append((name, i, "chr1", pos, "A", "G", rng.choice(["1|1", "0|1", "0|0"]), ann))
        profiles += [(name, 0, "#header"), (name, 1, "k__Bacteria\t2\t80.0")]
        for j, (_, fragment) in enumerate(taxa_names()):
            profiles.append((name, 2 + j, f"{fragment}\t2|7\t{rng.uniform(0.1, 9):.3f}"))
    inputs["reads"] = spark.createDataFrame(reads, schemas.READS)
    inputs["calls"] = spark.createDataFrame(calls, schemas.CALLS)
    inputs["annotated"] = spark.createDataFrame(
        annotated, "sample_id string, ord long, chrom string, pos long, ref string, alt string, gt string, ann_text string"
    )
    inputs["profiles"] = parse_profile(spark.createDataFrame(profiles, "sample_id string, ord long, value string"))
    side = '{"total_reads": %d, "total_bases": 1234567890, "q30_rate": 0.9312, "read1_mean_length": %d}'
    report = '{"summary": {"before_filtering": ' + side % (5000, 150) + ', "after_filtering": ' + side % (4000, 148) + '}, "insert_size": {"histogram": [9, 0, 1, 3]}}'
    inputs["read_reports"] = spark.createDataFrame([(name, report) for name in names], "sample_id string, json string")
    rng = random.Random(seed)
    inputs["genes"] = spark.createDataFrame(
        [("chr1", 1, "g1", "IRF4", "protein_coding", 1_250_000, 1_260_000, "+", [(1_250_000, 1_251_000)]),
         ("chr1", 2, "g2", "EDGE", "protein_coding", 1_390_000, 1_700_000, "+", [(1_650_000, 1_660_000)])],
        schemas.GENES,
    )
    bins = [(c, b, 1.0) for c, n in LENGTHS.items() for b in range(n // 1_000_000 + 1)]
    inputs["panel_coverage"] = spark.createDataFrame(bins, schemas.PANEL_COVERAGE)
    inputs["catalogue"] = spark.createDataFrame(
        [(1, "chr1", 11_000, "A", "G", {"name": "one", "secret": "x"}), (2, "chr1", 12_345, "A", "C", {"name": "two"}),
         (3, "chr2", 1000, "AT", "A", {"name": "indel"}), (4, "chr2", None, "A", "G", {"name": "nowhere"})],
        schemas.CATALOGUE,
    )
    inputs["private_keys"] = ["secret"]
    snps = [(i, "1", 1000 + 10_000 * i, "A", "G") for i in range(300)]
    inputs["snps"] = spark.createDataFrame(snps, "snp_idx long, chrom string, pos long, a1 string, a2 string")
    inputs["components"] = spark.createDataFrame([(i, [rng.random() for _ in range(4)]) for i in range(300)], "snp_idx long, p array<double>")
    breeds = [f"B{i:02d}" for i in range(24)]
    inputs["component_labels"] = spark.createDataFrame([(b, i) for i, b in enumerate(breeds[:4])], "label string, ord long")
    inputs["breed_names"] = spark.createDataFrame([("B00", "Zero"), ("B01", "One")], "code string, name string")
    inputs["individuals"] = spark.createDataFrame([(i, breeds[i % 24]) for i in range(72)], "ind_idx int, breed string")
    geno = [(s, i, rng.choice([0.0, 1.0, 2.0, None])) for s in range(300) for i in range(72)]
    inputs["genotypes"] = spark.createDataFrame(geno, "snp_idx long, ind_idx int, g double")
    inputs["trait_names"] = spark.createDataFrame([(b, f"Breed {b}") for b in breeds], "code string, name string")
    traits = []
    for i, b in enumerate(breeds):
        traits += [(f"Breed {b}", "Energy Level", str(1 + i % 5)), (f"Breed {b}", "height_cm", str(30 + i)), (f"Breed {b}", "weight_kg", str(5 + i)),
                   (f"Breed {b}", "Coat Type", fv.COAT_TYPES[i % 3]), (f"Breed {b}", "Coat Length", ["Short", "Medium", "Long"][i % 3])]
    inputs["traits"] = spark.createDataFrame(traits, "breed_name string, trait string, value string")
    inputs["heritability"] = spark.createDataFrame(
        [(t, h, ci, src) for t, h, ci, src in fv.PHYSICAL_HERITABILITY], "trait string, h2 double, ci string, source string"
    ).select("trait", F.struct("h2", "ci", "source").alias("heritability"))
    inputs["panel_af"] = spark.createDataFrame([(i, "chr1", 1000 + 10_000 * i, round(rng.random(), 3)) for i in range(350)], "ord long, chrom string, pos long, af double")
    inputs["reference_f"] = spark.createDataFrame([(f"r{i}", rng.gauss(0, 0.2)) for i in range(120)], "ref_id string, f_value double")
    columns = [clade for _, clade in taxa_names()]
    wide = [(i, float(rng.randrange(1, 15)), *[rng.choice([0.0, rng.random() / 50]) for _ in columns]) for i in range(40)]
    schema = "ref_id long, age double, " + ", ".join(f"`{c}` double" for c in columns)
    inputs["taxa_refs"], inputs["taxa_long"] = melt_reference(spark.createDataFrame(wide, schema))
    return inputs


def taxa_names():
    names = [("g", "k__Bacteria|p__P|g__Porphyromonas"), ("g", "k__Bacteria|p__P|g__Other")]
    names += [("s", f"k__Bacteria|p__P|g__Porphyromonas|s__{s}") for s in ("Porphyromonas_gulae", "Porphyromonas_canoris")]
    return names + [("s", f"k__Bacteria|p__P|g__Other|s__Other_sp{i}") for i in range(5)]


def samples_table(spark, names):
    return spark.createDataFrame([(n, 1, 3.0) for n in names], "sample_id string, from_stage int, age double")
