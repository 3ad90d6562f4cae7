"""Column layouts of the main tables."""

SAMPLE_SHEET_TEXT = (
    "sample_id string, fastq_dir string, age string, output_name string, work_dir string, pub_dir string,"
    " from_stage string, sex string, notes string"
)
CONTIGS = "chrom string, length long"
COVERAGE = "sample_id string, chrom string, start long, end long, bases long, depth double"
READS = (
    "sample_id string, read_id string, flag int, chrom string, pos long, end long, mapq int, seq string,"
    " qual array<int>, mate_pos long"
)
#: Reads may also carry `cigar string`; without it a read covers pos..end without gaps.
GAPPED_READS = READS + ", cigar string"
CALLS = (
    "sample_id string, ord long, chrom string, pos long, ref string, alt array<string>, raf array<double>, gt string,"
    " gp array<double>"
)
PILEUPS = "sample_id string, chrom string, pos long, counts map<string,bigint>, total long"
CATALOGUE = "cat_id long, chrom string, pos long, ref string, alt string, extra map<string,string>"
GENES = (
    "chrom string, gene_ord long, gene_id string, gene string, biotype string, gene_start long, gene_end long,"
    " strand string, exons array<struct<s:bigint,e:bigint>>"
)
PANEL_COVERAGE = "chrom string, bin_idx long, ratio double"
REGIONS = (
    "sample_id string, chrom string, start long, end long, norm double, ref_depth_pct long, size string,"
    " sample_pct_mean long, verdict string"
)
PROFILE = "sample_id string, ord long, clade string, rank string, name string, rel_abundance double"
