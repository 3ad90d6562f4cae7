"""Word lists, tables and texts that results depend on."""

# Sub-fields of an annotation, in order.
ANN_FIELDS = [
    "allele",
    "effect",
    "impact",
    "gene_name",
    "gene_id",
    "feature_type",
    "feature_id",
    "biotype",
    "rank",
    "hgvsc",
    "hgvsp",
    "cdna_pos",
    "cds_pos",
    "aa_pos",
    "distance",
    "messages",
]

# Effects that place a variant in an exon.
EXONIC_EFFECTS = [
    "exon_variant",
    "missense_variant",
    "synonymous_variant",
    "stop_gained",
    "stop_lost",
    "start_lost",
    "frameshift_variant",
    "splice_acceptor_variant",
    "splice_donor_variant",
    "protein_protein_contact",
    "structural_interaction_variant",
    "inframe_insertion",
    "inframe_deletion",
    "stop_retained_variant",
    "start_retained_variant",
    "coding_sequence_variant",
    "5_prime_UTR_variant",
    "3_prime_UTR_variant",
]

# Behaviour trait columns (scores 1 to 5).
TRAIT_COLUMNS = [
    "Affectionate With Family",
    "Good With Young Children",
    "Good With Other Dogs",
    "Shedding Level",
    "Coat Grooming Frequency",
    "Drooling Level",
    "Openness To Strangers",
    "Playfulness Level",
    "Watchdog/Protective Nature",
    "Adaptability Level",
    "Trainability Level",
    "Energy Level",
    "Barking Level",
    "Mental Stimulation Needs",
]

# Coat categories in the order in which ties are decided, and coat length levels.
COAT_TYPES = ["Double", "Smooth", "Wavy", "Curly", "Silky", "Wiry", "Rough"]
COAT_LENGTH = {"Short": 1, "Medium": 2, "Long": 3}

# Bounds of predicted traits and pounds per kilogram.
TRAIT_BOUNDS = {"behaviour": (1, 5), "height_cm": (20, 110), "weight_kg": (1, 120), "coat_length": (1, 3)}
POUNDS_PER_KG = 2.205

# Published heritability of the physical traits (h2, interval, source).
PHYSICAL_HERITABILITY = [
    ("height_cm", 0.62, "0.55–0.69", "Hayward 2016 (Nat Gen)"),
    ("weight_kg", 0.60, "0.52–0.68", "Hayward 2016 (Nat Gen)"),
    ("coat_type", 0.32, "0.18–0.46", "Parker 2017 (Science)"),
    ("coat_length", 0.63, "0.52–0.74", "Parker 2017 (Science)"),
]

# Species fragment, colour group, association.
PATHOBIONTS = [
    ("s__Porphyromonas_gulae", "red", "canine periodontal disease"),
    ("s__Tannerella_forsythia", "red", "periodontal disease"),
    ("s__Porphyromonas_cangingivalis", "red", "canine periodontitis"),
    ("s__Porphyromonas_canoris", "orange", "canine oral disease"),
    ("s__Porphyromonas_gingivicanis", "red", "canine periodontitis"),
    ("s__Treponema_denticola", "red", "periodontal disease"),
    ("s__Fusobacterium_nucleatum", "orange", "periodontal disease"),
    ("s__Prevotella_intermedia", "orange", "periodontal disease"),
]

# Profile rank letter → document key.
TAXON_RANKS = {
    "k": "kingdom",
    "p": "phyla",
    "c": "classes",
    "o": "orders",
    "f": "families",
    "g": "genera",
    "s": "species",
}

# Coat colour sites (locus, chrom, pos, exp_ref, exp_alt, allele, inheritance, effect).
KNOWN_SITES = [
    ("E", "chr5", 63922309, "T", "A", "e", "recessive", "MC1R p.Arg306* — causal e allele"),
    ("E", "chr5", 64186854, "C", "T", "e", "recessive", "e haplotype proxy SNP (CPNE7 intron)"),
    ("E", "chr5", 64188070, None, None, "Em", "dominant", "MC1R — melanistic mask haplotype tag"),
    ("K", "chr16", 57074438, "A", "G", "KB", "dominant", "CBD103 p.Lys43Arg — dominant black"),
    ("K", "chr16", 57036106, None, None, "KB", "dominant", "CBD103 — dominant black tagging SNP 2"),
    ("A", "chr24", 23906214, None, None, "at_tag", "recessive", "ASIP — tan-points/recessive-black coding tag"),
    ("A", "chr24", 23908000, None, None, "at_tag", "recessive", "ASIP — tan-points/recessive-black coding tag 2"),
    ("B", "chr11", 33376317, "T", "A", "b", "recessive", "TYRP1 p.Arg345Cys (b1) — brown/liver"),
    ("B", "chr11", 33440938, "C", "T", "b", "recessive", "TYRP1 p.Gln354* (b2) — brown/liver"),
    ("D", "chr25", 48403161, "G", "A", "d", "recessive", "MLPH c.123+1G>A splice site — dilute (blue/isabella)"),
    ("D", "chr25", 48431759, None, None, "d", "recessive", "MLPH — dilute tagging SNP 2"),
    ("S", "chr20", 5711695, None, None, "sp", "recessive", "MITF — piebald white spotting"),
]
CAUSAL_E_POS, PROXY_E_POS, CAUSAL_E_BASE = 63922309, 64186854, "A"

# Locus, gene, chrom, name, role, contribution.
LOCI = [
    (
        "E", "MC1R", "chr5", "Extension locus",
        "Master pigment switch: eumelanin (black/brown) vs phaeomelanin (yellow/red)",
        "e/e → all coat pigment is yellow/red regardless of other loci",
    ),
    (
        "K", "CBD103", "chr16", "Dominant black locus",
        "KB locks melanocytes in eumelanin production, overriding the A locus",
        "KB/- → solid eumelanin; ky/ky → A locus controls patterning",
    ),
    (
        "A", "ASIP", "chr24", "Agouti locus",
        "Controls eumelanin/phaeomelanin switching within the hair shaft",
        "Only expressed when ky/ky at K locus; determines sable/tan-points/solid pattern",
    ),
    (
        "B", "TYRP1", "chr11", "Brown locus",
        "Modifies eumelanin color: B → black, b/b → brown/liver/chocolate",
        "b/b converts all black pigment to brown; no effect on phaeomelanin",
    ),
    (
        "D", "MLPH", "chr25", "Dilution locus",
        "Melanosome transport: d/d dilutes pigment (black → blue, brown → isabella)",
        "d/d lightens all eumelanin; phaeomelanin unaffected",
    ),
    (
        "M", "PMEL", "chr10", "Merle locus",
        "SINE insertion causes mosaic pigment dilution producing merle pattern",
        "Not detectable from SNP imputation — requires PCR or long-read",
    ),
    (
        "S", "MITF", "chr20", "Spotting locus",
        "Controls melanocyte migration extent → white spotting area",
        "sp/sp → piebald; limited resolution from single SNP",
    ),
    (
        "W", "KIT", "chr13", "White locus",
        "Extreme white spotting; dominant W linked to deafness risk",
        "Not detectable from short-read SNP data",
    ),
]

# Locus, allele, meaning.
ALLELE_LEGEND = [
    ("E", "Em", "Melanistic mask (dominant)"),
    ("E", "E", "Wild type extension"),
    ("E", "e", "Recessive red/yellow — two copies needed"),
    ("K", "KB", "Dominant black — one copy = solid black"),
    ("K", "kbr", "Brindle (incompletely dominant)"),
    ("K", "ky", "Non-black/agouti — A locus determines pattern"),
    ("A", "ay", "Sable/fawn (dominant, regulatory variant)"),
    ("A", "aw", "Wild type agouti"),
    ("A", "at", "Tan points / tricolor (recessive)"),
    ("A", "a", "Recessive black (recessive)"),
    ("B", "B", "Black eumelanin (dominant)"),
    ("B", "b", "Brown/liver eumelanin — two copies needed"),
    ("D", "D", "Full pigment (dominant)"),
    ("D", "d", "Dilute/blue — two copies needed"),
    ("M", "M", "Merle (dominant, PMEL SINE insertion — not detectable from SNP data)"),
    ("M", "m", "Non-merle (assumed)"),
    ("S", "S", "Solid / minimal white"),
    ("S", "sp", "Piebald spotting (recessive)"),
    ("S", "sw", "Extreme white (recessive)"),
    ("W", "w", "Non-white"),
    ("W", "W", "Extreme white (dominant, KIT structural — not detectable from SNP data)"),
]

# Interpretation of each locus call.
LOCUS_TEXT = {
    "E_ee": "Homozygous recessive red — all coat pigment is phaeomelanin (yellow/red/cream)",
    "E_Em_e": "Melanistic mask carrier for recessive red (Em/e)",
    "E_E_e": "Carrier for recessive red (E/e) — normal extension expressed",
    "E_Em_E": "Melanistic mask on wild-type extension background (Em/E)",
    "E_E_E": "No e or Em alleles detected — wild-type extension (E/E)",
    "K_2": "Homozygous dominant black (KB/KB)",
    "K_1": "Dominant black carrier (KB/ky) — KB overrides A locus",
    "K_0": "No KB allele (ky/ky) — A locus controls pattern",
    "A_at_at": "Tan-points / tricolor (at/at) — recessive black or tricolor pattern",
    "A_one": "One putative at allele detected; other allele uncertain (ay/at or at/aw possible)",
    "A_none": "No at/a coding variants detected. Sable (ay) or wild agouti (aw) likely but require structural variant analysis to confirm.",
    "B_bb": "Brown/liver eumelanin (b/b or compound b1/b2)",
    "B_BB": "No brown alleles detected (B/B)",
    "D_dd": "Dilute coat (d/d) — black→blue, brown→isabella",
    "D_one": "Carrier for dilute (D/d) — full pigment expressed",
    "D_DD": "No dilute alleles detected (D/D) — full pigment",
    "M": "Merle (PMEL SINE insertion) not detectable from SNP imputation — PCR required",
    "S_2": "Piebald spotting (sp/sp) — white markings expected",
    "S_1": "Carrier for piebald (S/sp) — minimal or no white markings",
    "S_0": "No piebald allele at MITF queried position",
    "W": "KIT extreme white (structural variant) not detectable from SNP data",
}

# Own wording, not fixed values: texts that would name a panel or speak of one. {reads} is what the reads show.
LOCUS_TEXT |= {
    "E_missing": "No MC1R position of the panel was called",
    "E_proxy_low": (
        "Homozygous e/e rests on the proxy SNP alone (chr5:64186854, CPNE7 intron, alternative allele frequency about 29 %). The causal"
        " MC1R p.Arg306* position (chr5:63922309) is not in the panel; the pileup there shows {reads}, which neither confirms nor excludes"
        " the causal allele. A black or brown coat would mean that the proxy call is wrong and the genotype E/e or E/E; a cream or yellow"
        " one agrees with e/e."
    ),
    "E_proxy_medium": (
        "Homozygous e/e: the proxy SNP is homozygous (chr5:64186854) and reads at the causal MC1R position (chr5:63922309) carry the"
        " alternative base; their low depth limits the confidence."
    ),
    "K_missing": "No CBD103 position of the panel was called",
    "A_missing": "No ASIP coding position was called; ay/aw require structural variant analysis",
    "B_missing": "No TYRP1 brown allele of the panel was called",
    "B_one": "One b allele detected (heterozygous); a second b allele outside the panel cannot be excluded",
    "D_missing": "No MLPH dilute allele of the panel was called",
    "S_missing": "The MITF spotting variant of the panel was not called",
}
#: What the reads at the causal position show, in `E_proxy_low`.
READS_SHOWN, READS_NONE = "%d reads, all reference", "no reads"
#: Remark behind `E_proxy_low`: what the coat would be if the proxy is wrong.
PROXY_REMARK = (
    " If the proxy call is a false positive, the coat would be {colour} based on K ({k1}/{k2}) and B ({b1}/{b2}) loci."
    " Phenotype confirmation is required to distinguish e/e (cream/yellow) from {colour}."
)

# Base pigment by B and D status (colour, nose).
PIGMENTS = {
    "bb_dd": ("isabella/lilac", "isabella/lilac nose and pads"),
    "bb": ("chocolate", "liver/brown nose and pads"),
    "b?_dd": ("isabella/lilac or blue/grey", "isabella/lilac or blue/grey nose and pads (b allele status uncertain)"),
    "b?": ("chocolate or black", "liver/brown or black nose and pads (b allele status uncertain)"),
    "dd": ("blue/grey", "blue/grey nose and pads"),
    "black": ("black", "black nose and pads"),
}

# Notes of the coat document.
WHITE_NOTE = "Not detectable from SNP data (S locus limited; W requires structural variant)"
MERLE_NOTE = "Not detectable from SNP imputation — requires PCR or long-read sequencing"
DILUTION_NA = "Not applicable to coat (phaeomelanin unaffected by D locus)"
FULL_PIGMENT = "Full pigment (D/D or D/d)"
# Own wording, not a fixed value: the limits of the coat prediction.
COAT_CAVEAT = (
    "E, K, B and D are called from imputed genotypes at their causal sites. Sable and agouti (ay/aw of the A locus) require structural"
    " variant analysis, merle (M) and extreme white (W) PCR or long reads. Commercial tests cover further alleles."
)
GRAYING_GENE = "IRF4"
GRAYING_NOTES = {
    "hit": "IRF4 deletion detected — associated with progressive graying/silvering of eumelanin pigment, particularly visible in dark-coated dogs",
    "none": "No IRF4 deletion detected in this sample.",
    "unknown": "IRF4 deletion status unknown (CNV data unavailable)",
}
