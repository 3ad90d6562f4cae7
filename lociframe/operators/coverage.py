"""Windows, coverage, depth baselines, sex calls and depth quality."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lociframe.functions.text import half_up
from lociframe.plans import blockscan as bs

TILES = 4096  # tiles of one block of a running sum


def tile(contigs: DataFrame, width: int | str, length: str = "length") -> DataFrame:
    """Cut each contig into [s, min(s + width, length)); `width` is a number or a column of `contigs`."""
    step = F.lit(width).cast("long") if isinstance(width, int) else F.col(width).cast("long")
    long_enough = contigs.where(F.col(length) > 0)
    return (
        long_enough.withColumn("start", F.explode(F.sequence(F.lit(0).cast("long"), F.col(length).cast("long") - 1, step)))
        .withColumn("end", F.least(F.col("start") + step, F.col(length).cast("long")))
        .withColumn("bin_idx", (F.col("start") / step).cast("long"))
    )


def adaptive_width(
    coverage: DataFrame,
    keys: Sequence[str] = ("sample_id",),
    numerator: float = 50_000,
    low: int = 15_000,
    high: int = 200_000,
) -> DataFrame:
    """Window width per sample from its size-weighted mean depth."""
    mean = F.sum("bases") / F.sum(F.col("end") - F.col("start"))
    width = F.least(F.greatest(half_up(F.lit(numerator) / mean), F.lit(low)), F.lit(high))
    return coverage.groupBy(*keys).agg(F.coalesce(width, F.lit(high)).cast("long").alias("width"))


def tile_by(contigs: DataFrame, widths: DataFrame) -> DataFrame:
    """Tiles of every contig at every sample's own width.

    The contig list is folded into one row (a genome has a few thousand contigs at most), so the pairing with the
    samples is a projection over the width table.
    """
    listed = contigs.agg(F.collect_list(F.struct("chrom", "length")).alias("_contigs"))
    paired = widths.join(listed, F.lit(True)).withColumn("_c", F.explode("_contigs"))
    return tile(paired.select(*widths.columns, "_c.chrom", "_c.length"), "width")


def depth_events(
    intervals: DataFrame,
    keys: Sequence[str] = ("sample_id", "chrom"),
    start: str = "start",
    end: str = "end",
    weight: Column | None = None,
) -> DataFrame:
    """Where the depth of half-open [start, end) intervals changes: keys, pos, delta.

    An interval is +weight at its start and -weight at its end, whatever its length, and equal positions are added up
    before the shuffle. All coverage of any width follows from these rows, so reads are scanned once.
    """
    weight = F.lit(1) if weight is None else weight
    first, last = F.col(start).cast("long"), F.col(end).cast("long")
    ends = F.array(F.struct(first.alias("pos"), weight.alias("delta")), F.struct(last.alias("pos"), (-weight).alias("delta")))
    spread = intervals.where(last > first).select(*keys, F.explode(ends).alias("_e")).select(*keys, "_e.*")
    return spread.groupBy(*keys, "pos").agg(F.sum("delta").alias("delta")).where("delta <> 0")


def _tile_sums(events: DataFrame, keys: Sequence[str], width: Column) -> DataFrame:
    """Sums of the events of each tile: keys, bin_idx, d (of delta) and m (of delta times position)."""
    rows = events.withColumn("bin_idx", F.floor(F.col("pos") / width).cast("long"))
    return rows.groupBy(*keys, "bin_idx").agg(F.sum("delta").alias("d"), F.sum(F.col("delta") * F.col("pos")).alias("m"))


def integrate_events(events: DataFrame, tiles: DataFrame, keys: Sequence[str] = ("sample_id", "chrom"), by: Sequence[str] = ("sample_id",)) -> DataFrame:
    """`tiles` (keys, width, bin_idx, start, end) with `bases`, the depth added up over each tile.

    A tile's bases are its length times the depth that comes in from the left, plus (end - pos) * delta of its own events.
    The incoming depth is a running sum over tiles, which a contig's length bounds, taken in blocks of tiles. Widths may
    differ by `by` columns, and a key may be tiled at several widths.
    """
    sized = tiles.select(*by, "width").distinct()
    wide = [*dict.fromkeys([*keys, "width"])]
    # An interval may begin in front of the first tile or end behind the last one: that part counts nowhere.
    ends = tiles.groupBy(*keys).agg(F.min("start").alias("_first"), F.max("end").alias("_last"))
    inside = events.join(ends, list(keys)).withColumn("pos", F.least(F.greatest("pos", "_first"), "_last")).drop("_first", "_last")
    sums = _tile_sums(inside.join(sized, list(by)), wide, F.col("width"))
    rows = tiles.join(sums, [*wide, "bin_idx"], "left").fillna(0, ["d", "m"])
    return _integrated(rows, wide)


def _integrated(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    rows = bs.running_sum(bs.with_block(rows, "bin_idx", TILES), keys, ["bin_idx"], F.col("d"), "_depth").drop(bs.BLOCK)
    bases = (F.col("end") - F.col("start")) * (F.col("_depth") - F.col("d")) + F.col("end") * F.col("d") - F.col("m")
    return rows.withColumn("bases", bases).drop("d", "m", "_depth")


def window_coverage(
    reads: DataFrame,
    width: int | str,
    keys: Sequence[str] = ("sample_id", "chrom"),
    start: str = "start",
    end: str = "end",
    weight: Column | None = None,
) -> DataFrame:
    """Bases of half-open [start, end) intervals in each fixed-width bin that they touch: keys, bin_idx, start, end, bases.

    Two events per interval, whatever its length and the width; `width` is a number or a column that keys determine.
    """
    w = F.lit(width).cast("long") if isinstance(width, int) else F.col(width).cast("long")
    own = [*keys] if isinstance(width, int) else [*keys, width]
    sums = _tile_sums(depth_events(reads, own, start, end, weight), own, w)
    framed = sums.groupBy(*own).agg(F.min("bin_idx").alias("_a"), F.max("bin_idx").alias("_z"))
    framed = framed.withColumn("bin_idx", F.explode(F.sequence("_a", "_z"))).drop("_a", "_z")
    rows = framed.join(sums, [*own, "bin_idx"], "left").fillna(0, ["d", "m"])
    tiled = rows.withColumn("start", F.col("bin_idx") * w).withColumn("end", (F.col("bin_idx") + 1) * w)
    return _integrated(tiled, own).where("bases <> 0").select(*own, "bin_idx", "bases", "start", "end")


def countable_reads(reads: DataFrame, flag: str = "flag") -> DataFrame:
    """Reads that count towards depth: not unmapped, secondary, failed or duplicate."""
    return reads.where(F.col(flag).bitwiseAND(F.lit(4 | 256 | 512 | 1024)) == 0)


def with_depth(coverage: DataFrame) -> DataFrame:
    """Depth of each window; windows without bases or without length are dropped."""
    return coverage.where(F.col("bases").isNotNull() & (F.col("end") > F.col("start"))).withColumn(
        "depth", F.col("bases") / (F.col("end") - F.col("start"))
    )


def fill_bins(binned: DataFrame, keys: Sequence[str], bin_col: str, values: dict[str, float]) -> DataFrame:
    """Add the missing bins 0..max(bin) of every key, with the given defaults."""
    frame = (
        binned.groupBy(*keys)
        .agg(F.max(bin_col).alias("_top"))
        .withColumn(bin_col, F.explode(F.sequence(F.lit(0).cast("long"), F.col("_top").cast("long"))))
        .drop("_top")
    )
    return frame.join(binned, [*keys, bin_col], "left").withColumns(
        {c: F.coalesce(F.col(c), F.lit(v)) for c, v in values.items()}
    )


def bins_to_array(binned: DataFrame, keys: Sequence[str], bin_col: str, value: str, out: str) -> DataFrame:
    """One array per key in bin order. Keys hold one chromosome, so the array is bounded by its length."""
    packed = F.array_sort(F.collect_list(F.struct(bin_col, value)))
    return binned.groupBy(*keys).agg(F.transform(packed, lambda p: p[value]).alias(out))


def pad_array(arr: Column, n: Column, fill: float = 0.0) -> Column:
    """Cut or fill an array to length n; a null array becomes all fill."""
    have = F.coalesce(arr, F.array().cast("array<double>"))
    missing = F.greatest(F.lit(0), n - F.size(have)).cast("int")
    return F.concat(F.slice(have, F.lit(1), n.cast("int")), F.array_repeat(F.lit(fill), missing))


def baseline_depth(
    binned: DataFrame,
    sample: Sequence[str] = ("sample_id",),
    chrom: str = "chrom",
    depth: str = "depth",
    skip: Sequence[str] = ("chrX",),
    x: str = "chrX",
) -> DataFrame:
    """Median depth over covered bins outside `skip`, and the median of chromosome `x`."""
    covered = F.col(depth) > 0
    return binned.groupBy(*sample).agg(
        F.median(F.when(covered & ~F.col(chrom).isin(*skip), F.col(depth))).alias("baseline"),
        F.median(F.when(covered & (F.col(chrom) == x), F.col(depth))).alias("x_median"),
    )


def predict_sex(baseline: DataFrame, threshold: float = 0.75) -> DataFrame:
    """Add chrx_auto_ratio (1.0 without X bins) and predicted_sex."""
    ratio = F.coalesce(F.col("x_median") / F.col("baseline"), F.lit(1.0))
    return baseline.withColumn("chrx_auto_ratio", ratio).withColumn(
        "predicted_sex", F.when(F.col("chrx_auto_ratio") < threshold, "male").otherwise("female")
    )


def depth_ratio(depth: Column, baseline: Column) -> Column:
    return F.when(depth > 0, depth / baseline).otherwise(F.lit(0.0))


def sex_aware_ratio(depth: Column, baseline: Column, is_male_x: Column, par: float = 0.75) -> Column:
    """Ratio to the baseline; on a male X, windows below the PAR threshold are compared with half of it."""
    male = (
        F.when(depth == 0, F.lit(0.0))
        .when(depth >= par * baseline, depth / baseline)
        .otherwise(depth / (0.5 * baseline))
    )
    return F.when(is_male_x, male).otherwise(depth_ratio(depth, baseline))


def normalise_x(binned: DataFrame, sexed: DataFrame, sample: Sequence[str] = ("sample_id",), x: str = "chrX") -> DataFrame:
    """Attach the sample's baseline and sex and add `ratio` to every bin."""
    male_x = (F.col("chrom") == x) & (F.col("predicted_sex") == "male")
    joined = binned.join(sexed.select(*sample, "baseline", "predicted_sex", "chrx_auto_ratio"), list(sample))
    return joined.withColumn("ratio", sex_aware_ratio(F.col("depth"), F.col("baseline"), male_x))


def panel_of_normals(binned: DataFrame, group: Sequence[str] = (), depth: str = "depth") -> DataFrame:
    """Ratio of each pooled bin to the autosomal median; X always counts as one copy."""
    keys = list(group) or ["_pool"]
    rows = binned if group else binned.withColumn("_pool", F.lit(0))
    base = baseline_depth(rows, keys, depth=depth, skip=("chrX", "chrY")).select(*keys, "baseline")
    one_copy = F.when(F.col("chrom") == "chrX", 0.5 * F.col("baseline")).otherwise(F.col("baseline"))
    out = rows.join(base, keys).withColumn("ratio", depth_ratio(F.col(depth), one_copy))
    return out if group else out.drop("_pool")


def qc_genome(windows: DataFrame, keys: Sequence[str] = ("sample_id",), depth: str = "depth") -> DataFrame:
    """Depth summary of each sample with status and warning; full precision."""
    d = F.col(depth)
    share = {t: F.count_if(d >= t) / F.count(d) * 100 for t in (10, 15, 20, 30)}
    stats = windows.groupBy(*keys).agg(
        F.avg(d).alias("genome_mean_depth"),
        F.median(d).alias("genome_median_depth"),
        F.stddev_samp(d).alias("genome_std_depth"),
        *[s.alias(f"pct_bins_gt{t}x") for t, s in share.items()],
        F.count_if(d < 15).alias("n_low_bins"),
        F.count(d).alias("n_total_bins"),
    )
    return (
        stats.withColumn("uniformity_cv", F.col("genome_std_depth") / F.nullif(F.col("genome_mean_depth"), F.lit(0.0)))
        .withColumn("qc_status", qc_status(F.col("genome_mean_depth")))
        .withColumn("warning", qc_warning(F.col("pct_bins_gt15x")))
    )


def qc_status(mean_depth: Column) -> Column:
    return F.when(mean_depth >= 20, "PASS").when(mean_depth >= 10, "WARN").otherwise("FAIL")


def qc_warning(pct15: Column) -> Column:
    shown = F.round(pct15, 1)
    return F.when(shown < 95, F.format_string("Only %.1f%% of 1Mb bins have ≥15x coverage.", shown))


def qc_chrom(windows: DataFrame, keys: Sequence[str] = ("sample_id", "chrom"), depth: str = "depth") -> DataFrame:
    """Depth summary per chromosome; p10 is the order statistic at floor(n/10)."""
    d = F.col(depth)
    ordered = F.array_sort(F.collect_list(d))
    return windows.groupBy(*keys).agg(
        F.avg(d).alias("mean_depth"),
        F.median(d).alias("median_depth"),
        F.get(ordered, F.floor(F.count(d) / 10).cast("int")).alias("p10_depth"),
        F.count(d).alias("n_bins"),
        F.count_if(d < 15).alias("low_bins"),
    )
