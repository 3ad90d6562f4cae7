"""Ancestry mixtures: non-negative projection of dosages on component frequencies."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lociframe.session import cut_lineage

SAMPLES_PER_BUCKET = 64


def sample_buckets(dosages: DataFrame) -> int:
    """Hash buckets so that each holds about SAMPLES_PER_BUCKET samples; one sketch per task, one number back."""
    n = dosages.agg(F.approx_count_distinct("sample_id")).first()[0]
    return max(1, -(-int(n) // SAMPLES_PER_BUCKET))


def nonnegative_solve(gram: np.ndarray, rhs: np.ndarray, tol: float = 1e-10, max_rounds: int | None = None) -> np.ndarray:
    """Minimise qᵀGq/2 − rᵀq over q ≥ 0 by an active set on the K × K normal equations; raises if it does not end."""
    if not (np.isfinite(gram).all() and np.isfinite(rhs).all()):
        raise ValueError("the normal equations hold values that are not finite")
    k = len(rhs)
    q = np.zeros(k)
    free = np.zeros(k, dtype=bool)
    limit = tol * max(1.0, float(np.abs(rhs).max(initial=0.0)))
    for _ in range(max_rounds or 30 * k):
        slope = rhs - gram @ q
        slope[free] = -np.inf
        best = int(np.argmax(slope))
        if slope[best] <= limit:
            break
        free[best] = True
        while True:
            idx = np.flatnonzero(free)
            trial = np.zeros(k)
            trial[idx] = np.linalg.lstsq(gram[np.ix_(idx, idx)], rhs[idx], rcond=None)[0]
            bad = idx[trial[idx] <= 0]
            if len(bad) == 0:
                q = trial
                break
            step = np.min(q[bad] / (q[bad] - trial[bad] + 1e-300))
            q = q + step * (trial - q)
            free &= q > 1e-14
            q[~free] = 0.0
            if not free.any():
                break
    else:
        raise ArithmeticError(f"no solution after {max_rounds or 30 * k} rounds")
    return q


def packed(matrix: np.ndarray) -> np.ndarray:
    """Lower triangle of a symmetric matrix, row by row."""
    return matrix[np.tril_indices(len(matrix))]


def unpacked(triangle: np.ndarray, k: int) -> np.ndarray:
    full = np.zeros((k, k))
    full[np.tril_indices(k)] = triangle
    return full + np.tril(full, -1).T


def whole_gram(components: DataFrame, k: int, snp: str = "snp_idx", block: int = 4096) -> np.ndarray:
    """PᵀP over all SNPs, once for the whole cohort: partial triangles per SNP block, added in two steps. What comes back
    has the size of the component list, whatever the number of SNPs and samples."""

    def part(pdf: pd.DataFrame) -> pd.DataFrame:
        freq = np.vstack(pdf["p"].to_numpy()).astype(np.float64)
        return pd.DataFrame({"g": [int(pdf["blk"].iloc[0]) // 32], "tri": [packed(freq.T @ freq)]})

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"tri": [np.sum(np.vstack(pdf["tri"].to_numpy()), axis=0)]})

    rows = components.select("p", F.floor(F.col(snp) / block).cast("long").alias("blk"))
    parts = rows.groupBy("blk").applyInPandas(part, "g long, tri array<double>").groupBy("g").applyInPandas(add, "tri array<double>")
    return unpacked(sum((np.array(r.tri) for r in parts.collect()), np.zeros(k * (k + 1) // 2)), k)


def valid_sets(valid: DataFrame, snp: str = "snp") -> DataFrame:
    """Which samples have dosages at the same SNPs: sample_id, set_id (a 128-bit fingerprint with the count), n."""
    a, b = F.xxhash64(snp), F.xxhash64(F.col(snp), F.lit("b"))
    n = F.count(snp)
    return valid.groupBy("sample_id").agg(F.concat_ws(":", n, F.bit_xor(a), F.bit_xor(b)).alias("set_id"), n.alias("n"))


def _aligned(left: pd.DataFrame, right: pd.DataFrame, name: str) -> tuple[np.ndarray, np.ndarray, list, np.ndarray]:
    """Frequencies of a block, and for each name of `left` its values and which SNPs it has."""
    freq = np.vstack(right["p"].to_numpy()).astype(np.float64)
    row_of = pd.Series(np.arange(len(right)), index=right["snp"].to_numpy())
    codes, names = pd.factorize(left[name])
    known = left["snp"].isin(row_of.index).to_numpy()
    at = row_of.loc[left["snp"][known]].to_numpy()
    dense, seen = np.zeros((len(names), len(freq))), np.zeros((len(names), len(freq)), dtype=bool)
    dense[codes[known], at] = left["x"].to_numpy()[known]
    seen[codes[known], at] = True
    return freq, dense, list(names), seen


def _with_frequencies(rows: DataFrame, components: DataFrame, snp: str, block: int):
    """`rows` (blk, bkt, …) next to the frequencies of their SNP block, which go to each bucket once."""
    needed = rows.select(F.col("blk").alias("_blk"), F.col("bkt").alias("_bkt")).distinct()
    p = components.select(F.col(snp).alias("snp"), "p", F.floor(F.col(snp) / block).cast("long").alias("_blk"))
    p = p.join(needed, "_blk").select("snp", "p", F.col("_blk").alias("pblk"), F.col("_bkt").alias("pbkt"))
    return rows.groupBy("blk", "bkt").cogroup(p.groupBy("pblk", "pbkt"))


def set_downdates(members: DataFrame, components: DataFrame, k: int, snp: str, block: int) -> DataFrame:
    """What each set's PᵀP lacks against that of all SNPs: set_id, kind, v.

    Per set and SNP block it is the frequencies of the missing SNPs (kind `rows`), or where those are more than a
    triangle holds, the packed triangle of their product (kind `tri`); a block with all its SNPs gives nothing. So a set
    that misses little costs little, even if every sample has a set of its own. `members`: set_id, snp, blk, bkt; snp is
    null in one row per block, which tells of blocks of which a set has nothing.
    """

    def lacks(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(right) and len(left):
            freq, _, names, seen = _aligned(left.assign(x=0.0), right, "set_id")
            whole = freq.T @ freq
            for name, has in zip(names, seen, strict=True):
                gone = freq[~has]
                if 2 * len(gone) <= k + 1:
                    out += [(name, "rows", row) for row in gone]
                elif len(gone) * 2 <= len(freq):
                    out.append((name, "tri", packed(gone.T @ gone)))
                else:
                    out.append((name, "tri", packed(whole - freq[has].T @ freq[has])))
        return pd.DataFrame(out, columns=["set_id", "kind", "v"])

    return _with_frequencies(members, components, snp, block).applyInPandas(lacks, "set_id string, kind string, v array<double>")


def project_mixture(
    dosages: DataFrame, components: DataFrame, k: int, snp: str = "snp_idx", dosage: str = "dosage", block: int = 4096
) -> DataFrame:
    """Mixture shares per sample: sample_id, k, proportion, snps_used.

    Frequencies lie in 0..1 and dosages in 0..2; a row of ones pulls the raw weights towards a sum of 1 and the result is
    scaled to 1 afterwards. Samples that have the same SNPs share one matrix: a dictionary of SNP sets holds what each
    set's matrix lacks against that of all SNPs, and a sample carries its K products only. Samples of one set are solved
    in groups of SAMPLES_PER_BUCKET, so a set that all samples share is not one task.
    """
    panel = components.select(F.col(snp).alias("snp"))
    spot = F.floor(F.col("snp") / block).cast("long")
    x = dosages.where(F.col(dosage).isNotNull()).select("sample_id", F.col(snp).alias("snp"), F.col(dosage).cast("double").alias("x"))
    x = x.join(panel, "snp", "left_semi")
    buckets = lambda name, n: F.pmod(F.xxhash64(name), F.lit(n)).cast("int")
    n_buckets = sample_buckets(dosages)

    def multiply(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if right.empty or left.empty:
            return pd.DataFrame({"sample_id": [], "rhs": []})
        freq, dense, names, _ = _aligned(left, right, "sample_id")
        return pd.DataFrame({"sample_id": names, "rhs": list(dense @ freq)})

    sid = dosages.schema["sample_id"].dataType.simpleString()
    laid = x.withColumns({"blk": spot, "bkt": buckets("sample_id", n_buckets)})
    sides = _with_frequencies(laid, components, snp, block).applyInPandas(multiply, f"sample_id {sid}, rhs array<double>")
    sets = cut_lineage(valid_sets(x))
    first = sets.groupBy("set_id").agg(F.min("sample_id").alias("sample_id"), F.count(F.lit(1)).alias("m"))
    blocks = panel.select(spot.alias("blk")).distinct()
    every = first.select("set_id").join(blocks.agg(F.collect_list("blk").alias("b")), F.lit(True))  # a panel has few blocks
    marks = every.select("set_id", F.lit(None).cast(x.schema["snp"].dataType).alias("snp"), F.explode("b").alias("blk"))
    members = x.join(first, "sample_id").select("set_id", "snp", spot.alias("blk")).unionByName(marks)
    lacking = set_downdates(members.withColumn("bkt", buckets("set_id", n_buckets)), components, k, snp, block)
    share = F.ceil(F.col("m") / SAMPLES_PER_BUCKET)
    placed = sets.join(first.select("set_id", "m"), "set_id").withColumn("salt", F.pmod(F.xxhash64("sample_id"), share)).drop("m")
    each = F.explode(F.sequence(F.lit(0).cast("long"), share - 1))
    spread = first.join(lacking, "set_id").select(F.col("set_id").alias("of_set"), "kind", "v", each.alias("of_salt"))
    whole = whole_gram(components, k, snp, block)

    def solve(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        gram = whole + 1.0
        for kind in ("rows", "tri"):
            own = right.loc[right["kind"] == kind, "v"]
            if len(own):
                v = np.vstack(own.to_numpy())
                gram = gram - (v.T @ v if kind == "rows" else unpacked(v.sum(axis=0), k))
        out = []
        for name, rows in left.groupby("sample_id", sort=False):
            q = nonnegative_solve(gram, np.sum(np.vstack(rows["rhs"].to_numpy()), axis=0) + 1.0)
            q = q / (q.sum() + 1e-12)
            out += [(name, i, float(v), int(rows["n"].iloc[0])) for i, v in enumerate(q)]
        return pd.DataFrame(out, columns=["sample_id", "k", "proportion", "snps_used"])

    grouped = sides.join(placed, "sample_id").groupBy("set_id", "salt")
    return grouped.cogroup(spread.groupBy("of_set", "of_salt")).applyInPandas(
        solve, f"sample_id {sid}, k int, proportion double, snps_used long"
    )


def ordered_labels(lines: DataFrame, label: str = "label", ord_col: str = "ord") -> DataFrame:
    """Distinct labels numbered by first appearance: k, label. The list is one component panel long."""
    first = lines.groupBy(label).agg(F.min(ord_col).alias("_first"))
    listed = first.agg(F.array_sort(F.collect_list(F.struct("_first", F.col(label).alias("label")))).alias("_l"))
    return listed.select(F.posexplode("_l").alias("k", "_x")).select("k", F.col("_x.label").alias("label"))


def decode(df: DataFrame, names: DataFrame, code: str, name: str, out: str) -> DataFrame:
    """Code → name with the code itself as the fallback. `names`: code, name."""
    return (
        df.join(names.select(F.col("code").alias(code), F.col(name).alias("_name")), code, "left")
        .withColumn(out, F.coalesce("_name", F.col(code)))
        .drop("_name")
    )


def top_components(
    mixture: DataFrame, k: int | None = None, minimum: float = 0.001, keys: Sequence[str] = ("sample_id",), tie: str = "k"
) -> DataFrame:
    """Components by falling share with `rank`; with `k` only the first k above `minimum`."""
    window = Window.partitionBy(*keys).orderBy(F.desc("proportion"), tie)
    if k is None:
        return mixture.withColumn("rank", F.row_number().over(window))
    return mixture.where(F.col("proportion") > minimum).withColumn("rank", F.row_number().over(window)).where(F.col("rank") <= k)
