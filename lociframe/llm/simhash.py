"""SimHash fingerprints and near-duplicate components.

Candidate search is covering locality-sensitive hashing after Pagh: bit i of a fingerprint gets a vector m(i) in
{0,1}^(r+1) other than zero, and table v keeps bit i where <m(i), v> is odd. For any r bits some v other than zero is
orthogonal to all their vectors, so two fingerprints that differ in r bits or fewer agree in some table: no pair within
the radius is lost. With r = 2 there are seven tables that keep 36 or 37 of the 64 bits each.

Inside a bucket no pairs are formed. Each of its fingerprints is sent to itself and to its neighbours at one flipped
bit that the table leaves out. Two fingerprints of the bucket are within two bits exactly if they share such a centre,
a centre has at most 29 fingerprints, and all of those are within two bits of each other; so each is linked to the least
fingerprint of the centre, and the work grows with the bucket's size, not with its square.

Defined results: null, empty and blank texts have fingerprint zero and are linked like any other; fewer than three words
are one shingle; a component's id is the least doc_id in it, nulls left aside (null if it has no other); repeated rows
repeat; ties do not occur, as an id is a minimum.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import product

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lociframe.llm.base import packed, text_function
from lociframe.session import cut_lineage

BITS, RADIUS, SHINGLE, SEED = 64, 2, 3, 42


def shingle_digests(text: bytes, size: int = SHINGLE) -> np.ndarray:
    """XXH64 of each run of `size` words, A-Z in lower case; fewer words are one run."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    runs = [b" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1))]
    return np.fromiter((xxhash.xxh64_intdigest(r, SEED) for r in runs), np.uint64, len(runs))


def fingerprint(text: bytes) -> int:
    """64 bits, signed: a bit is set if it is set in more than half of the digests."""
    digests = shingle_digests(text)
    ones = np.zeros(BITS, np.int64)
    for k in range(0, len(digests), 1 << 14):
        part = digests[k : k + (1 << 14)].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(digests), bitorder="little").view(np.int64)[0])


def fingerprint_column(text: Column) -> Column:
    def make():
        def run(texts: pa.Array) -> pa.Array:
            return pa.array([fingerprint(t or b"") for t in texts.cast(pa.large_binary()).to_pylist()], pa.int64())

        return run

    return text_function(make, "long")(text)


def hex_digits(fp: Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


def covering_masks(radius: int = RADIUS, bits: int = BITS) -> list[int]:
    """Bits that each table keeps, as signed numbers."""
    vectors = [v for v in product((0, 1), repeat=radius + 1) if any(v)]
    masks = []
    for v in vectors:
        mask = sum(1 << i for i in range(bits) if sum(a * b for a, b in zip(vectors[i % len(vectors)], v, strict=True)) % 2)
        masks.append(mask - (1 << bits) if mask >> (bits - 1) else mask)
    return masks


def links(fps: DataFrame, fp: str = "fp") -> DataFrame:
    """Links (`a` > `b`) that connect all fingerprints within RADIUS of each other. `fps` holds each once."""
    masks = covering_masks()
    free = [[(1 << i) - (1 << BITS) * (i == BITS - 1) for i in range(BITS) if not mask >> i & 1] for mask in masks]
    tables = fps.select(F.col(fp).alias("f"), F.posexplode(F.array(*[F.col(fp).bitwiseAND(F.lit(m)) for m in masks])).alias("t", "key"))
    shared = tables.groupBy("t", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("t", "key")
    members = tables.join(shared, ["t", "key"]).select("t", "f")
    flips = F.array(*[F.array(*[F.lit(b) for b in row]) for row in free])
    centres = members.select("t", "f", F.explode(F.concat(F.array("f"), F.transform(F.element_at(flips, F.col("t") + 1), lambda b: F.col("f").bitwiseXOR(b)))).alias("c"))
    least = F.min("f").over(Window.partitionBy("t", "c"))  # at most 1 + free bits rows each
    return centres.select(F.col("f").alias("a"), least.alias("b")).where("a <> b").distinct()


def connected(edges: DataFrame, cut: Callable[[DataFrame], DataFrame] = cut_lineage) -> DataFrame:
    """`node` and `root`, the least node that `edges` (a, b) connect it with; nodes without an edge are left out.

    Large-star and small-star steps in turn: every step is an aggregation and a join on the node, so a node of very many
    edges is split like any skewed join key. Each round is written to the checkpoint folder.
    """
    edges = cut(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct())
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        lower = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(lower, "a")
        after = cut(small.select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").unionByName(lower.select("a", F.col("m").alias("b"))).distinct())
        marks = [x.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first() for x in (edges, after)]
        edges = after
        if marks[0] == marks[1]:
            return edges.groupBy("a").agg(F.min("b").alias("root")).withColumnRenamed("a", "node")


def _components(classes: DataFrame) -> DataFrame:
    """`fp`, `component`: the least `m` over the fingerprints connected with each one. `classes`: fp, m."""
    roots = connected(links(classes.select("fp")))
    labelled = classes.join(roots, classes.fp == roots.node, "left").select("fp", "m", F.coalesce("root", "fp").alias("root"))
    groups = labelled.groupBy("root").agg(F.min("m").alias("component"))
    return labelled.join(groups, "root").select("fp", "component")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: its id, `fingerprint` and `component_id`."""
    marked = cut_lineage(docs.select(F.col(id_col).alias("id"), fingerprint_column(F.col(text_col)).alias("fp")))
    parts = _components(marked.groupBy("fp").agg(F.min("id").alias("m")))
    return marked.join(parts, "fp").select(F.col("id").alias(id_col), hex_digits(F.col("fp")).alias("fingerprint"), F.col("component").alias("component_id"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each component, with its columns: the row with the least id, nulls last, and least row hash."""
    columns = [F.col(f"`{c}`") for c in docs.columns]
    rank = F.struct(F.col(id_col).isNull().alias("x"), F.col(id_col).alias("id"), F.xxhash64(*columns).alias("h"))
    marked = cut_lineage(docs.select(rank.alias("m"), fingerprint_column(F.col(text_col)).alias("fp")))
    kept = marked.groupBy("fp").agg(F.min("m").alias("m"))
    kept = _components(kept).select("component.*").distinct()
    found = packed(docs, rank.alias("m")).join(kept.select(F.col("h").alias("h"), F.struct("x", "id", "h").alias("k")), (F.col("m.h") == F.col("h")) & F.col("m").eqNullSafe(F.col("k")))
    return found.dropDuplicates(["h", "k"]).select("doc.*")  # repeated rows are equal, so any of them will do
