"""Runs of homozygosity, inbreeding coefficients and reference distributions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lociframe.plans import blockscan as bs
from lociframe.plans.grouped import map_sorted_groups
from lociframe.plans.quantiles import exact_quantiles
from lociframe.session import cut_lineage

AUTOSOMES_MB = 2200.0


def _walk(ords, prev_pos, pos, next_pos, is_own, first_k, n_sites, window, max_het, entry):
    """Follow the runs through one block of het sites.

    A state is (k, on): the search stands on het k, or on the site right after it. Returns the runs found and the
    state in which the walk leaves the block.
    """
    last_own = first_k + int(is_own.sum()) - 1
    runs = []
    k, on = entry
    while k <= last_own:
        i = k - first_k
        closing = i + max_het + (0 if on else 1)
        start = ords[i] if on else ords[i] + 1
        open_end = closing >= len(ords)
        stop = n_sites if open_end else ords[closing]
        if stop - start >= window:
            run_from = pos[i] if on else next_pos[i]
            runs.append((run_from, None if open_end else prev_pos[closing]))
            if open_end:
                return runs, None
            k, on = first_k + closing, True
        elif on:
            on = False
        else:
            k += 1
    return runs, (k, on)


def roh(
    sites: DataFrame,
    keys: Sequence[str] = ("sample_id", "chrom"),
    pos: str = "pos",
    het: str = "is_het",
    window: int = 50,
    max_het: int = 1,
    min_length: float = 500_000,
    block_span: int = 1_000_000,
    hets_per_block: int = 20_000,
    tie: Sequence[str] = (),
) -> DataFrame:
    """Runs of homozygosity: keys, start, end (positions). `sites` holds one row per observed genotype.

    A window of `window` sites with at most `max_het` hets opens a run, which goes on until one het too many; the
    search goes on at the site that closed the run. The outcome depends only on the ordinals of the het sites, and a
    walk can enter a block of hets in only max_het + 2 states. So every block is walked once per possible entry
    state in parallel, a fold over the blocks picks the state that really occurs, and only its runs are kept.
    No task sees more than one block of a key.
    """
    if hets_per_block < max_het + 2:
        raise ValueError("hets_per_block must exceed max_het + 1")
    keys = list(keys)
    order = [F.col(pos), *[F.col(t) for t in tie]]
    placed = bs.ordinals_with_neighbours(bs.with_block(sites, pos, block_span), keys, pos, order, het)
    totals = sites.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_sites"), F.min(pos).alias("_first_pos"), F.max(pos).alias("_last_pos")
    ).where(F.col("n_sites") >= window)
    hets = placed.where(F.col(het)).select(
        *keys, "ordinal", "prev_pos", F.col(pos).alias("_pos"), "next_pos", F.col("mark_no").alias("_k")
    )
    # A het in front of the first site stands for "the search starts at site 0".
    nothing = F.lit(None).cast(sites.schema[pos].dataType)
    lead_in = totals.select(
        *keys,
        F.lit(-1).cast("long").alias("ordinal"),
        nothing.alias("prev_pos"),
        nothing.alias("_pos"),
        F.col("_first_pos").alias("next_pos"),
        F.lit(0).cast("long").alias("_k"),
    )
    kb = F.floor(F.col("_k") / hets_per_block).cast("long")
    here, ahead = F.struct(kb.alias("kb"), F.lit(True).alias("own")), F.struct((kb - 1).alias("kb"), F.lit(False).alias("own"))
    needed_ahead = (F.col("_k") % hets_per_block <= max_het) & (kb > 0)
    places = F.explode(F.when(needed_ahead, F.array(here, ahead)).otherwise(F.array(here)))
    copies = hets.unionByName(lead_in).withColumn("_x", places).withColumns({"_kb": F.col("_x.kb"), "_own": F.col("_x.own")}).drop("_x")
    blocks = copies.join(totals.drop("_first_pos"), keys)

    key_fields = [f"`{k}` {sites.schema[k].dataType.simpleString()}" for k in keys]
    size = hets_per_block

    def walk_block(key: tuple, c: dict) -> list[tuple]:
        first_k, kb = int(c["_k"][0]), int(key[-1])
        n_sites, last_pos = int(c["n_sites"][0]), float(c["_last_pos"][0])
        columns = [c[name] for name in ("ordinal", "prev_pos", "_pos", "next_pos")]
        states = [(first_k, False)] + [(first_k + s, True) for s in range(max_het + 1)]
        rows = []
        for entry, state in enumerate(states[:1] if kb == 0 else states):
            runs, after = _walk(*columns, c["_own"], first_k, n_sites, window, max_het, state)
            leaves = -1 if after is None else (0 if not after[1] else 1 + after[0] - (kb + 1) * size)
            rows.append((entry, leaves, None, None))
            rows += [(entry, None, float(x), last_pos if y is None else float(y)) for x, y in runs]
        return rows

    fields = ", ".join([*key_fields, "_kb long", "entry int", "leaves int", "start double", "end double"])
    # Written once: both the moves and the runs are read from it, and the walk is the costly part.
    walked = cut_lineage(map_sorted_groups(blocks, [*keys, "_kb"], ["_k"], walk_block, fields))

    def follow(_key: tuple, c: dict) -> list[tuple]:
        step = {(kb, e): nxt for kb, e, nxt in zip(c["_kb"], c["entry"], c["leaves"], strict=True)}
        taken, entry = [], 0
        for kb in range(int(c["_kb"].max()) + 1):
            if entry < 0:
                break
            taken.append((kb, entry))
            entry = int(step[(kb, entry)])
        return taken

    # Three small rows per block of hets, so this fold is short even for the longest key.
    moves = walked.where(F.col("leaves").isNotNull()).select(*keys, "_kb", "entry", "leaves")
    taken = map_sorted_groups(moves, keys, ["_kb", "entry"], follow, ", ".join([*key_fields, "_kb long", "entry int"]))
    dtype = sites.schema[pos].dataType
    return (
        walked.where(F.col("start").isNotNull())
        .join(taken, [*keys, "_kb", "entry"])
        .where(F.col("end") - F.col("start") >= min_length)
        .select(*keys, F.col("start").cast(dtype), F.col("end").cast(dtype))
    )


def inbreeding_level(froh: Column) -> Column:
    return (
        F.when(froh < 0.03125, "Very_Low")
        .when(froh < 0.0625, "Low")
        .when(froh < 0.125, "Moderate")
        .when(froh < 0.25, "High")
        .otherwise("Very_High")
    )


def froh(
    segments: DataFrame, samples: DataFrame, keys: Sequence[str] = ("sample_id",), genome_mb: float = AUTOSOMES_MB
) -> DataFrame:
    """F-ROH of every sample, 0 for samples without a run. Lengths are summed unrounded."""
    sums = segments.groupBy(*keys).agg(
        (F.sum(F.col("end") - F.col("start")) / 1e6).alias("roh_total_mb"), F.count(F.lit(1)).alias("roh_n_segments")
    )
    return (
        samples.select(*keys)
        .join(sums, list(keys), "left")
        .na.fill(0.0, ["roh_total_mb"])
        .na.fill(0, ["roh_n_segments"])
        .withColumn("f_roh", F.col("roh_total_mb") / genome_mb)
        .withColumn("level", inbreeding_level(F.col("f_roh")))
    )


def join_af(
    calls: DataFrame, panel_af: DataFrame, site: Sequence[str] = ("chrom", "pos"), sample: Sequence[str] = ("sample_id",)
) -> DataFrame:
    """One-to-one join of calls to panel frequencies on the position.

    The n-th call at a position meets the n-th panel row there. No call beyond the longest run of panel repeats can
    match; that number (usually 1) is read first and bounds the numbering, so Spark drops later repeats before the
    shuffle and a position that repeats a million times costs each task only its first few rows.
    """
    site, sample = list(site), list(sample)
    repeats = panel_af.groupBy(*site).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
    mine = Window.partitionBy(*sample, *site).orderBy("ord")
    theirs = Window.partitionBy(*site).orderBy("ord")
    first_calls = calls.select(*sample, *site, "gt", F.row_number().over(mine).alias("_n"))
    first_calls = first_calls.where(F.col("_n") <= F.lit(repeats))
    rows = panel_af.select(*site, "af", F.row_number().over(theirs).alias("_n"))
    return first_calls.join(rows, [*site, "_n"]).where(F.col("af").isNotNull()).drop("_n")


def genotype_f(joined: DataFrame, is_hom: Column, keys: Sequence[str] = ("sample_id",), af: str = "af") -> DataFrame:
    """Observed against expected homozygosity; F is null when it is undefined."""
    p = F.col(af)
    sums = joined.groupBy(*keys).agg(
        F.count_if(is_hom).alias("o_hom"), F.sum(p * p + (1 - p) * (1 - p)).alias("e_hom"), F.count(p).alias("n_obs")
    )
    return sums.withColumn(
        "f", (F.col("o_hom") - F.col("e_hom")) / F.nullif(F.col("n_obs") - F.col("e_hom"), F.lit(0.0))
    )


def percentile_rank(
    reference: DataFrame,
    scores: DataFrame,
    value: str,
    score: str,
    kind: str = "strict",
    keys: Sequence[str] = (),
    out: str = "percentile",
    weight: str | None = None,
) -> DataFrame:
    """Percentile of each score among the reference values of its key.

    strict: share below; weak: share not above; rank: mean of both plus half a step for a tie. Reference values and
    scores are merged into one axis of distinct values per key and counted by range, so no pair of a score and a
    reference value is ever formed and a long list never sits in one task. `weight` counts a reference row many times.

    The scores are written once, and both the axis and the result read that copy: a float sum that Spark computed a
    second time could differ in its last digits and miss its place on the axis. Callers whose reference holds the same
    rows as the scores must write those once as well, or ties may part.
    """
    scores = cut_lineage(scores)
    grouping = list(keys) or ["_all"]
    if not keys:
        reference, scores = reference.withColumn("_all", F.lit(0)), scores.withColumn("_all", F.lit(0))
    values = reference.where(F.col(value).isNotNull()).select(
        *grouping, F.col(value).cast("double").alias("_v"), (F.col(weight) if weight else F.lit(1)).cast("long").alias("_n")
    )
    asked = scores.where(F.col(score).isNotNull()).select(
        *grouping, F.col(score).cast("double").alias("_v"), F.lit(0).cast("long").alias("_n")
    )
    axis = values.unionByName(asked).groupBy(*grouping, "_v").agg(F.sum("_n").alias("_n"))
    below, upto, n = F.col("_below"), F.col("_below") + F.col("_n"), F.nullif(F.col("_total"), F.lit(0))
    pct = {
        "strict": below / n * 100,
        "weak": upto / n * 100,
        "rank": (below + upto + F.when(upto > below, 1).otherwise(0)) * F.lit(50.0) / n,
    }[kind]
    ranked = cumulative_counts(axis, grouping).select(*grouping, "_v", pct.alias(out))
    joined = scores.withColumn("_v", F.col(score).cast("double")).join(ranked, [*grouping, "_v"], "left").drop("_v")
    return joined if keys else joined.drop("_all")


def cumulative_counts(axis: DataFrame, keys: Sequence[str], value: str = "_v", n: str = "_n") -> DataFrame:
    """Add `_below` (rows of the key in front of each distinct value) and `_total`.

    The values are laid out in ranges of equal size and written once; one count per range gives the offsets.
    """
    laid = cut_lineage(axis.repartitionByRange(*keys, value).withColumn("_part", F.spark_partition_id()))
    whole = Window.partitionBy(*keys)
    front = whole.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    # One row per key and range: a key of any length has at most as many rows here as the layout has partitions.
    offsets = (
        laid.groupBy(*keys, "_part")
        .agg(F.sum(n).alias("_in"))
        .select(
            *keys,
            "_part",
            F.coalesce(F.sum("_in").over(front), F.lit(0)).alias("_off"),
            F.sum("_in").over(whole).alias("_total"),
        )
    )
    inside = Window.partitionBy(*keys, "_part").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    return laid.join(offsets, [*keys, "_part"]).select(
        *keys, value, n, "_total", (F.col("_off") + F.coalesce(F.sum(n).over(inside), F.lit(0))).alias("_below")
    )


def histogram(reference: DataFrame, value: str, bins: int = 40, widen: float = 0.001) -> DataFrame:
    """Equal bins over [min, max + widen]: bin (from 0), lower, upper, n; empty bins included."""
    bounds = reference.agg(F.min(value).alias("_lo"), (F.max(value) + widen).alias("_hi"))
    numbered = reference.where(F.col(value).isNotNull()).join(bounds, F.lit(True))
    counted = (
        numbered.withColumn("bin", (F.width_bucket(F.col(value), "_lo", "_hi", F.lit(bins)) - 1).cast("int"))
        .groupBy("bin")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    step = (F.col("_hi") - F.col("_lo")) / bins
    frame = bounds.withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1)))).select(
        "bin", (F.col("_lo") + step * F.col("bin")).alias("lower"), (F.col("_lo") + step * (F.col("bin") + 1)).alias("upper")
    )
    return frame.join(counted, "bin", "left").na.fill(0, ["n"])


def dist_summary(
    reference: DataFrame, value: str, keys: Sequence[str] = (), probs: dict[str, float] | None = None
) -> DataFrame:
    """Count, mean and exact quantiles of a reference distribution."""
    probs = probs or {"p25": 0.25, "p50": 0.5, "p75": 0.75, "p90": 0.9}
    grouping = list(keys) or ["_all"]
    rows = reference if keys else reference.withColumn("_all", F.lit(0))
    means = rows.groupBy(*grouping).agg(F.count(value).alias("n"), F.avg(value).alias("mean"))
    out = means.join(exact_quantiles(rows, grouping, value, probs), grouping)
    return out if keys else out.drop("_all")
