"""Read-level jobs: cleaning, flags, duplicates, pileups, chunk bookkeeping and variant filters."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lociframe.functions import cigar as cg
from lociframe.functions import genotypes as gt
from lociframe.plans.picks import first_by, last_by
from lociframe.sources.tables import version_key

UNMAPPED, SECONDARY, QCFAIL, DUPLICATE, SUPPLEMENTARY = 4, 256, 512, 1024, 2048


def trim_tail(seq: Column, min_run: int = 10) -> Column:
    """Drop a run of at least `min_run` equal bases at the end of the read, G first."""
    no_g = F.regexp_replace(seq, f"G{{{min_run},}}$", "")
    return F.regexp_replace(no_g, f"(A{{{min_run},}}|C{{{min_run},}}|T{{{min_run},}}|N{{{min_run},}})$", "")


def low_quality_share(qual: Column, qualified: int = 20) -> Column:
    """Share of bases below the qualified base quality."""
    return F.size(F.filter(qual, lambda q: q < qualified)) / F.nullif(F.size(qual), F.lit(0))


def judge_reads(
    reads: DataFrame, min_length: int = 36, qualified: int = 20, max_unqualified: float = 0.4, min_run: int = 10
) -> DataFrame:
    """Trim tails (bases and qualities together); `passes` is false for short, low-quality and missing sequences."""
    trimmed = reads.withColumn("seq", trim_tail(F.col("seq"), min_run)).withColumn(
        "qual", F.slice("qual", F.lit(1), F.length("seq"))
    )
    good = F.coalesce(low_quality_share(F.col("qual"), qualified), F.lit(0.0)) <= max_unqualified
    return trimmed.withColumn("passes", F.coalesce((F.length("seq") >= min_length) & good, F.lit(False)))


def clean_reads(reads: DataFrame, **limits) -> DataFrame:
    """Trim tails, then drop short and low-quality reads; limits as in `judge_reads`."""
    return judge_reads(reads, **limits).where("passes").drop("passes")


def clean_pairs(reads: DataFrame, keys: Sequence[str] = ("sample_id", "read_id"), **limits) -> DataFrame:
    """Trim tails, then drop every pair of which a mate is short or of low quality.

    Only the ids of reads that fail are gathered, and anti-joined: a few in a good run, so Spark may broadcast them by
    their size, and no shuffle of all reads by id is forced.
    """
    judged = judge_reads(reads, **limits)
    failed = judged.where(~F.col("passes")).select(*keys).distinct()
    return judged.where("passes").drop("passes").join(failed, list(keys), "left_anti")


def lane_manifest(reads: DataFrame) -> DataFrame:
    """sample_id, lane, lane_no (version order within the sample), reads_1, reads_2: what stage 1 merges.

    A sample has at most a few dozen lanes, so their names are sorted as one array per sample.
    """
    counted = reads.groupBy("sample_id", "lane").agg(
        F.count_if(F.col("mate") == 1).alias("reads_1"), F.count_if(F.col("mate") == 2).alias("reads_2")
    )
    entry = F.struct(version_key(F.col("lane")).alias("k"), "lane", "reads_1", "reads_2")
    listed = counted.groupBy("sample_id").agg(F.array_sort(F.collect_list(entry)).alias("_l"))
    return listed.select("sample_id", F.posexplode("_l").alias("lane_no", "_x")).select(
        "sample_id", "_x.lane", "lane_no", "_x.reads_1", "_x.reads_2"
    )


def read_figures(raw: DataFrame, cleaned: DataFrame, keys: Sequence[str] = ("sample_id",)) -> DataFrame:
    """The figures of a trimming report, counted on the reads themselves, one pass over each of the two tables."""
    bases = F.length("seq").cast("long")
    first = F.when(F.col("mate") == 1, bases)
    high = F.size(F.filter("qual", lambda q: q >= 30)).cast("long")
    before = raw.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("total_reads_raw"),
        (F.sum(bases) / 1e9).alias("total_bases_raw_gb"),
        (F.sum(high) / F.nullif(F.sum(bases), F.lit(0)) * 100).alias("pct_q30_raw"),
        F.avg(first).alias("read_length_bp"),
    )
    after = cleaned.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("total_reads_after_qc"), F.avg(first).alias("read_length_after_trimming_bp")
    )
    kept = F.coalesce("total_reads_after_qc", F.lit(0)).cast("long")
    return before.join(after, list(keys), "left").withColumn("total_reads_after_qc", kept)


def unmapped_reads(reads: DataFrame, flag: str = "flag") -> DataFrame:
    return reads.where(F.col(flag).bitwiseAND(F.lit(UNMAPPED)) != 0)


def has_bit(flag: Column, bit: int) -> Column:
    return flag.bitwiseAND(F.lit(bit)) != 0


def flag_summary(reads: DataFrame, keys: Sequence[str] = ("sample_id",), flag: str = "flag") -> DataFrame:
    """Counts by flag bits."""
    f = F.col(flag)
    primary = ~has_bit(f, SECONDARY | SUPPLEMENTARY)
    mapped, dup = ~has_bit(f, UNMAPPED), has_bit(f, DUPLICATE)
    return reads.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(primary).alias("primary"),
        F.count_if(has_bit(f, SECONDARY)).alias("secondary"),
        F.count_if(has_bit(f, SUPPLEMENTARY)).alias("supplementary"),
        F.count_if(dup).alias("duplicates"),
        F.count_if(primary & dup).alias("primary_duplicates"),
        F.count_if(mapped).alias("mapped"),
        F.count_if(primary & mapped).alias("primary_mapped"),
    )


def duplication_rate(flags: DataFrame, reads_after_qc: Column) -> DataFrame:
    """Primary duplicates in percent of the reads that passed cleaning."""
    return flags.withColumn(
        "duplication_rate_pct", F.col("primary_duplicates") / F.nullif(reads_after_qc, F.lit(0)) * 100
    )


def fragment_size(hist: DataFrame, keys: Sequence[str], histogram: str = "histogram") -> DataFrame:
    """Mean fragment size from a histogram array; index 0 holds the undetermined pairs."""
    bars = hist.select(*keys, F.posexplode(histogram).alias("size", "n")).where(F.col("size") >= 1)
    mean = F.sum(F.col("size") * F.col("n")) / F.nullif(F.sum("n"), F.lit(0))
    return bars.groupBy(*keys).agg(F.round(mean).cast("long").alias("fragment_size_mean_bp"))


def mark_duplicates(
    reads: DataFrame, signature: Sequence[str], score: str, read_id: str = "read_id", out: str = "is_duplicate"
) -> DataFrame:
    """Flag all but the best read of each signature (highest score, then smallest id).

    The best reads come from a partial aggregate; the flag is joined on the read id, which is unique, so a
    signature that holds a large share of the reads does not end up in one task.
    """
    lowest_first = F.min_by(read_id, F.struct(-F.col(score), F.col(read_id)))
    best = reads.groupBy(*signature).agg(lowest_first.alias(read_id))
    kept = best.select(read_id, F.lit(True).alias("_best"))
    return reads.join(kept, read_id, "left").withColumn(out, F.col("_best").isNull()).drop("_best")


def with_signature(reads: DataFrame, keep: str | None = None) -> DataFrame:
    """Adds what duplicates agree in: `five_prime`, the unclipped start of the fragment on the read's strand, and
    `reverse`. Reads without a CIGAR start at `pos`, or on the reverse strand at `end`. The walk over the CIGAR stays in
    the column `keep`, if that is given."""
    back = has_bit(F.col("flag"), cg.REVERSE)
    plain = F.when(back, F.col("end")).otherwise(F.col("pos")).cast("long")
    if "cigar" not in reads.columns:
        return reads.withColumns({"five_prime": plain, "reverse": back})
    # An explode of one element keeps the walk from being repeated for every field that is read.
    walked = reads.select("*", F.explode(F.array(cg.walk(F.col("cigar"), F.col("pos")))).alias("_w"))
    start = F.coalesce(cg.five_prime(F.col("_w"), F.col("pos"), F.col("flag")), plain)
    signed = walked.withColumns({"five_prime": start, "reverse": back})
    return signed.withColumnRenamed("_w", keep) if keep else signed.drop("_w")


def mark_read_duplicates(reads: DataFrame, min_bq: int = 15) -> DataFrame:
    """`is_duplicate` for primary mapped reads of equal sample, chromosome, unclipped 5' start, strand and mate start: all
    but the one with the largest sum of base qualities of at least `min_bq`. Other reads are never duplicates."""
    marked = with_signature(reads).withColumn(
        "_score", F.aggregate("qual", F.lit(0).cast("long"), lambda acc, q: acc + F.when(q >= min_bq, q).otherwise(0))
    )
    counted = ~has_bit(F.col("flag"), UNMAPPED | SECONDARY | SUPPLEMENTARY)
    signature = ["sample_id", "chrom", "five_prime", "reverse", "mate_pos"]
    best = marked.where(counted).groupBy(*signature).agg(F.min(F.struct((-F.col("_score")).alias("s"), "read_id", "flag")).alias("_k"))
    kept = best.select("sample_id", F.col("_k.read_id").alias("read_id"), F.col("_k.flag").alias("flag"), F.lit(True).alias("_best"))
    joined = marked.join(kept, ["sample_id", "read_id", "flag"], "left")
    return joined.withColumn("is_duplicate", counted & F.col("_best").isNull()).select(*reads.columns, "is_duplicate")


def sort_reads(reads: DataFrame, by: Sequence[str] = ("sample_id", "chrom", "pos")) -> DataFrame:
    """Coordinate layout: range partitions sorted inside, so a scan by region touches few files."""
    return reads.repartitionByRange(*by).sortWithinPartitions(*by)


def pileup(
    reads: DataFrame, sites: DataFrame, min_bq: int = 20, min_mq: int = 20, bucket: int = 1000
) -> DataFrame:
    """Base counts at listed sites: sample_id, chrom, pos, counts (map), total.

    Aligned blocks of the reads (see `functions.cigar.with_blocks`) meet sites in buckets of positions, so a read has no
    base at a site that it deletes or skips, and clips and insertions shift the bases behind them. Both mates over one
    site count once: the read with the better base, then the smaller flag.
    """
    usable = reads.where(
        (F.col("mapq") >= min_mq) & (F.col("flag").bitwiseAND(F.lit(UNMAPPED | SECONDARY | QCFAIL | DUPLICATE)) == 0)
    )
    paired = F.col("flag").bitwiseAND(F.lit(1)) != 0
    proper = F.col("flag").bitwiseAND(F.lit(2)) != 0
    blocks = cg.with_blocks(usable.where(~paired | proper)).drop("pos", "end")
    touched = F.sequence(F.floor(F.col("b_start") / bucket).cast("long"), F.floor(F.col("b_end") / bucket).cast("long"))
    spread = blocks.where(F.col("b_end") >= F.col("b_start")).withColumn("_b", F.explode(touched))
    listed = sites.select("chrom", "pos").distinct().withColumn("_b", F.floor(F.col("pos") / bucket).cast("long"))
    offset = (F.col("pos") - F.col("b_start") + F.col("b_q")).cast("int")
    hits = (
        spread.join(listed, ["chrom", "_b"])
        .where(F.col("pos").between(F.col("b_start"), F.col("b_end")))
        .select(
            "sample_id",
            "chrom",
            "pos",
            "read_id",
            "flag",
            F.upper(F.substr("seq", offset + 1, F.lit(1))).alias("base"),
            F.get("qual", offset).alias("bq"),
        )
        .where((F.col("bq") >= min_bq) & (F.col("base") != ""))
    )
    once = last_by(hits, ["sample_id", "chrom", "pos", "read_id"], [F.col("bq"), -F.col("flag")])
    per_base = once.groupBy("sample_id", "chrom", "pos", "base").agg(F.count(F.lit(1)).alias("n"))
    return counts_map(per_base, ["sample_id", "chrom", "pos"])


def counts_map(per_base: DataFrame, keys: Sequence[str], base: str = "base", n: str = "n") -> DataFrame:
    """Fold (key, base, n) rows into a base → count map and a total."""
    entries = F.array_sort(F.collect_list(F.struct(base, n)))
    return per_base.groupBy(*keys).agg(F.map_from_entries(entries).alias("counts"), F.sum(n).alias("total"))


def base_count(counts: Column, base: Column) -> Column:
    return F.coalesce(F.try_element_at(counts, F.upper(base)), F.lit(0))


def call_from_counts(df: DataFrame, counts: str = "counts", total: str = "total", min_reads: int = 5) -> DataFrame:
    """Direct genotype from base counts; null zygosity below `min_reads` in total or on the two alleles."""
    n_ref, n_alt = base_count(F.col(counts), F.col("ref")), base_count(F.col(counts), F.col("alt"))
    enough = (F.col(total) >= min_reads) & (F.col("ref_count") + F.col("alt_count") >= min_reads)
    return (
        df.withColumn("ref_count", n_ref)
        .withColumn("alt_count", n_alt)
        .withColumn("read_zygosity", F.when(enough, gt.genotype_from_counts(F.col("ref_count"), F.col("alt_count"))))
        .withColumn("read_confidence", F.when(enough, gt.depth_tier(F.col(total))))
    )


def tier_counts(total: Column, min_reads: int = 5, medium: int = 15) -> Column:
    """Evidence tier of a locus pileup: none, low or medium."""
    return F.when(total >= medium, "medium").when(total >= min_reads, "low").otherwise("none")


def filter_variants(df: DataFrame, min_qual: float = 20, min_depth: int = 10, keep_pass: bool = True) -> DataFrame:
    """Mark LOWQUAL calls, then keep only PASS."""
    low = (F.col("qual") < min_qual) | (F.col("dp") < min_depth)
    marked = df.withColumn("filter", F.when(low, "LOWQUAL").otherwise("PASS"))
    return marked.where(F.col("filter") == "PASS") if keep_pass else marked


def variant_stats(df: DataFrame, keys: Sequence[str] = ("sample_id",)) -> DataFrame:
    """Record counts by type."""
    snv = gt.is_snv(F.col("ref"), F.col("alt"))
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_records"), F.count_if(snv).alias("n_snv"), F.count_if(~snv).alias("n_indel")
    )


def union_parts(*parts: DataFrame) -> DataFrame:
    """All rows of all lanes, chunks or chromosomes; columns are matched by name."""
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def set_duplicate_bit(reads: DataFrame, marked: str = "is_duplicate") -> DataFrame:
    """Write the duplicate mark into the flag, in place of what stood there."""
    clear = F.col("flag").bitwiseAND(F.lit(~DUPLICATE))
    return reads.withColumn("flag", F.when(F.col(marked), clear.bitwiseOR(F.lit(DUPLICATE))).otherwise(clear).cast("int")).drop(marked)


def pending_chunks(
    chunks: DataFrame, done: DataFrame, failed: DataFrame, key: str | Sequence[str] = "chunk_key"
) -> DataFrame:
    """Chunks that are neither done nor known to fail."""
    on = key if isinstance(key, str) else list(key)
    return chunks.join(done, on, "left_anti").join(failed, on, "left_anti")


#: States of a chunk that still have to be run.
OPEN_CHUNKS = ("pending", "failed")


def chunk_ledger(
    samples: DataFrame, chunks: DataFrame, results: DataFrame, known_failed: DataFrame, before: DataFrame | None = None
) -> DataFrame:
    """sample_id, chunk_key, chrom, chunk_id, status, attempts, last_attempt: every chunk of every sample.

    `results` is a log of attempts (sample_id, chunk_key, attempt, ok). `before` is the last ledger; attempts that it has
    counted are not counted again, so a log may be delivered twice or grow. A chunk is `done` after any good attempt,
    `known_failed` if it is on the list and not done, `failed` after bad attempts only (to be retried), else `pending`.
    The chunk list is bounded by the genome: it is one row that every sample is joined with.
    """
    keys = ["sample_id", "chunk_key"]
    entry = F.struct("chrom", "chunk_id", "chunk_key")
    listed = chunks.agg(F.array_sort(F.collect_set(entry)).alias("_c"))
    rows = samples.select("sample_id").distinct().join(listed, F.lit(True)).select("sample_id", F.explode("_c").alias("_x"))
    rows = rows.select("sample_id", "_x.chunk_key", "_x.chrom", "_x.chunk_id")
    fresh = results.select(*keys, "attempt", "ok")
    if before is not None:
        old = before.select(*keys, (F.col("status") == "done").alias("_done"), F.col("attempts").alias("_n"), F.col("last_attempt").alias("_last"))
        rows = rows.join(old, keys, "left")
        seen = old.select(*keys, F.col("_last").alias("_seen"))
        fresh = fresh.join(seen, keys, "left").where(F.col("_seen").isNull() | (F.col("attempt") > F.col("_seen")))
    else:
        nothing = F.lit(None)
        rows = rows.withColumns({"_done": nothing.cast("boolean"), "_n": nothing.cast("long"), "_last": nothing.cast("long")})
    news = fresh.groupBy(*keys).agg(
        F.count_distinct("attempt").alias("_new"), F.bool_or(F.coalesce("ok", F.lit(False))).alias("_ok"), F.max("attempt").alias("_newest")
    )
    listed_bad = known_failed.select("chunk_key").distinct().withColumn("_known", F.lit(True))
    rows = rows.join(news, keys, "left").join(listed_bad, "chunk_key", "left")
    attempts = F.coalesce("_n", F.lit(0)) + F.coalesce("_new", F.lit(0))
    done = F.coalesce("_done", F.lit(False)) | F.coalesce("_ok", F.lit(False))
    status = F.when(done, "done").when(F.col("_known"), "known_failed").when(attempts > 0, "failed").otherwise("pending")
    return rows.select(
        *keys, "chrom", "chunk_id", status.alias("status"), attempts.cast("long").alias("attempts"),
        F.greatest("_last", "_newest").alias("last_attempt"),
    )


def chunk_calls_to_sites(calls: DataFrame, ledger: DataFrame) -> DataFrame:
    """Calls of the chunks that are done, one per site: the most confident, then the lowest chunk.

    `ord` becomes the place in the stitched file: chunk number first, line in the chunk second.
    """
    done = ledger.where(F.col("status") == "done").select("sample_id", "chunk_key", "chunk_id")
    rows = calls.join(done, ["sample_id", "chunk_key"]).withColumns(
        {"max_gp": gt.max_posterior(F.col("gp")), "ord": F.shiftleft(F.col("chunk_id").cast("long"), 40) + F.col("ord")}
    )
    return stitch_chunks(rows, tie=("chunk_id", "ord")).drop("chunk_key", "chunk_id", "max_gp")


def stitch_chunks(
    calls: DataFrame,
    site: Sequence[str] = ("sample_id", "chrom", "pos", "ref", "alt"),
    confidence: str = "max_gp",
    tie: Sequence[str] = ("chunk_id",),
) -> DataFrame:
    """One record per site out of overlapping chunks: highest confidence, then lowest chunk."""
    return first_by(calls, list(site), [-F.col(confidence), *[F.col(t) for t in tie]])
