"""Near copies for the pipeline: SimHash fingerprints, then shingles of five words by an exact Jaccard similarity.

The first candidates are those of `simhash`: the links that connect all fingerprints within its radius, found by covering
locality-sensitive hashing. Copies with several edited words lie beyond that radius, so MinHash bands add candidates. All
candidates go through the exact check.

Texts with the same set of shingles are one node. A node's signature is BANDS bands of ROWS MinHash values; two texts of
similarity 0.8 agree in some band with a chance of 1 - (1 - 0.8 ** ROWS) ** BANDS = 0.9996. Only a node's hash, the size of
its set and its band keys are written and shuffled. In each bucket of a band every node is paired with two leaders, the
least node and the least one in an order of the bucket's own, so that most near copies are connected by few pairs. Pairs
whose sets differ too much in size are dropped. Then the sets of the nodes that stand in a bucket or pair are taken from
their texts again, and a pair is a link only if the Jaccard similarity of the two sets, counted exactly, reaches SIMILARITY;
pairs with the second leader are looked at only if the links of the fingerprints' pairs and of those with the first leader
do not connect them already. In the end every two nodes of a bucket that are still not connected are compared, in buckets
of the bands and in those of the fingerprints' tables. Each set has a digest that bounds how far two sets differ; it drops
only pairs that cannot be links. So no pair that shares a bucket is left out, and a bucket's square is met only by nodes
outside its largest connected part.

Defined results: words are those of bytewords; texts of fewer than five words are one shingle; null, empty and blank texts
are copies of each other; other texts without words are copies only if they are equal; the row with the least id, nulls
last, and least row hash stays.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lociframe.llm.base import packed, text_function
from lociframe.llm.bytewords import mixed, shingle_hashes, words_of
from lociframe.llm.simhash import connected, covering_masks, fingerprint_column
from lociframe.llm.simhash import links as fingerprint_links
from lociframe.session import cut_lineage

SHINGLE, SIMILARITY = 5, 0.8
BANDS, ROWS = 20, 5
SKETCH = "node long, n int, bands array<long>"
#: Longs of a set's digest, nodes of a bucket that meet as many others in one tile, pairs of two parts that are looked at at once.
WORDS, TILE, MANY = 16, 2048, 16

_FACTORS = np.random.default_rng(31).integers(1, 2**63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _sets(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of all texts, where each text's begin, and each text's number of words."""
    w = words_of(texts)
    counts = np.diff(w.first)
    found = [(h, w.text_of(at)) for h, at in [shingle_hashes(w, SHINGLE)]]
    for n in range(1, SHINGLE):  # shorter texts, whole
        h, at = shingle_hashes(w, n)
        doc = w.text_of(at)
        found.append((mixed(h[counts[doc] == n] + np.uint64(n)), doc[counts[doc] == n]))
    hashes, doc = (np.concatenate([f[j] for f in found]) for j in (0, 1))
    order = np.lexsort((hashes, doc))
    hashes, doc = hashes[order], doc[order]
    new = np.ones(len(hashes), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (doc[1:] != doc[:-1])
    hashes, doc = hashes[new], doc[new]
    return hashes, np.searchsorted(doc, np.arange(len(counts) + 1)), counts


def _lists(ends: np.ndarray, values: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(values.view(np.int64)))


def sketch(texts: pa.Array) -> pa.Array:
    """Structs of SKETCH: hash of the set of shingles, its size, a key for each band."""
    hashes, bounds, counts = _sets(texts)
    filled = np.flatnonzero(np.diff(bounds))
    node = np.zeros(len(counts), np.uint64)
    keys = np.zeros((len(filled), BANDS), np.uint64)
    if len(filled):
        node[filled] = mixed(np.add.reduceat(mixed(hashes), bounds[filled]))
        for k, factor in enumerate(_FACTORS):
            least = np.minimum.reduceat(mixed(hashes * factor), bounds[filled])
            keys[:, k // ROWS] = mixed(keys[:, k // ROWS] + least)
    for i in np.flatnonzero(counts == 0).tolist():
        rest = (texts[i].as_py() or "").strip()
        node[i] = xxhash.xxh64_intdigest(rest.encode(), 5) if rest else 0
    ends = np.zeros(len(counts) + 1, np.int64)
    ends[filled + 1] = BANDS
    sizes = pa.array(np.diff(bounds).astype(np.int32))
    return pa.StructArray.from_arrays([pa.array(node.view(np.int64)), sizes, _lists(np.cumsum(ends), keys.ravel())], ["node", "n", "bands"])


def shingle_sets(texts: pa.Array) -> pa.Array:
    """Structs of the sorted shingle hashes and their digest: each hash flips one of its bits, so two digests differ in no
    more bits than the sets do in hashes."""
    hashes, bounds, _ = _sets(texts)
    bits = np.zeros(len(texts) * WORDS, np.uint64)
    spot = (mixed(hashes) >> np.uint64(24)) % np.uint64(64 * WORDS)
    at = np.repeat(np.arange(len(texts)) * WORDS, np.diff(bounds)) + (spot >> np.uint64(6)).astype(np.int64)
    np.bitwise_xor.at(bits, at, np.uint64(1) << (spot & np.uint64(63)))
    return pa.StructArray.from_arrays([_lists(bounds, hashes), _lists(np.arange(len(texts) + 1) * WORDS, bits)], ["shingles", "bits"])


def sketch_column(text: Column) -> Column:
    return text_function(lambda: sketch, SKETCH)(text)


def shared_keys(nodes: DataFrame, classes: DataFrame) -> DataFrame:
    """`node`, `key`, `band`: buckets with more than one row, of the bands and (not `band`) of the fingerprints' tables.

    `nodes`: node, bands; `classes`: node, n, fp. Two fingerprints within the radius of `simhash` share a table's key.
    """
    banded = nodes.select("node", F.posexplode("bands").alias("t", "key")).select("node", F.xxhash64("t", "key").alias("key"), F.lit(True).alias("band"))
    tables = F.array(*[F.xxhash64(F.lit(BANDS + t), F.col("fp").bitwiseAND(F.lit(m))) for t, m in enumerate(covering_masks())])
    keys = banded.unionByName(classes.where("n > 0").select("node", F.explode(tables).alias("key"), F.lit(False).alias("band")))
    return keys.join(keys.groupBy("key").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("key"), "key").select("node", "key", "band")


def _near_sizes(a: str, b: str) -> Column:
    least = F.least(a, b)  # texts without words are copies only if they are one node
    return (least > 0) & (least >= F.lit(SIMILARITY) * F.greatest(a, b))


def candidate_pairs(nodes: DataFrame, alike: DataFrame, shared: DataFrame | None = None) -> DataFrame:
    """Pairs (`a` > `b`) that can be near copies by the sizes of their sets: those of `alike` (a, b), and a node with a leader
    of one of its buckets. `first` marks the former and those with the bucket's least node, the others are with the leader
    of that bucket's own order. `nodes`: node, n, bands. The pairs connect most near copies; `open_pairs` has the others."""
    keys = (shared_keys(nodes, nodes.select("node", "n", F.lit(0).cast("long").alias("fp")).limit(0)) if shared is None else shared).where("band")
    own = F.col("node").bitwiseXOR(F.col("key"))  # an order of the nodes that differs from bucket to bucket
    leaders = keys.groupBy("key").agg(F.min("node").alias("low"), F.min(own).alias("other"))
    met = keys.join(leaders, "key").select("node", F.explode(F.array(
        F.struct(F.lit(True).alias("first"), F.col("low").alias("b")), F.struct(F.lit(False).alias("first"), F.col("other").bitwiseXOR(F.col("key")).alias("b"))
    )).alias("p")).select("node", "p.*").where(F.col("node") != F.col("b"))
    met = met.unionByName(alike.select(F.col("a").alias("node"), F.lit(True).alias("first"), "b"))
    pairs = met.groupBy(F.greatest("node", "b").alias("a"), F.least("node", "b").alias("b")).agg(F.bool_or("first").alias("first"))
    size = lambda c: nodes.select(F.col("node").alias(c), F.col("n").alias(f"{c}_n"))
    return pairs.join(size("a"), "a").join(size("b"), "b").where(_near_sizes("a_n", "b_n")).select("a", "b", "first")


def open_pairs(shared: DataFrame, sets: DataFrame, roots: DataFrame, seen: DataFrame) -> DataFrame:
    """All pairs (`a` > `b`) of a bucket that `roots` do not connect, that are not among `seen` (a, b) and that can be links by
    the sizes and digests of their `sets` (node, n, bits); with their roots and the bits in which the digests differ.

    Of two such nodes one lies outside the bucket's largest connected part, so only those nodes meet the whole bucket. They
    meet in tiles of TILE nodes a side.
    """
    rooted = shared.select("node", "key").join(roots, "node", "left").select("node", "key", F.coalesce("root", "node").alias("root"))
    parts = rooted.groupBy("key", "root").agg(F.count(F.lit(1)).alias("c")).groupBy("key")
    parts = parts.agg(F.max(F.struct("c", "root")).alias("most"), F.sum("c").alias("c")).where("c > most.c")
    blocks = lambda n: F.ceil(n / TILE).cast("long")
    parts = parts.select("key", F.col("most.root").alias("most"), blocks(F.col("c") - F.col("most.c")).alias("lefts"), blocks(F.col("c")).alias("rights"))
    members = cut_lineage(rooted.join(parts, "key")).join(sets.select("node", F.size("shingles").alias("n"), "bits"), "node")
    own = lambda n: F.pmod(F.xxhash64("node"), F.col(n))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    side = lambda c: [F.col(x).alias(f"{c}_{x}") for x in ("node", "root", "n", "bits")]
    left = members.where("root <> most").select("key", own("lefts").alias("i"), every("rights").alias("j"), *side("l"))
    right = members.select("key", own("rights").alias("j"), every("lefts").alias("i"), *side("r"))
    differ = sum((F.bit_count(F.col("l_bits")[k].bitwiseXOR(F.col("r_bits")[k])) for k in range(WORDS)), F.lit(0))
    # A link of sizes n and m has at most (n + m) (1 - SIMILARITY) / (1 + SIMILARITY) = (n + m) / 9 hashes in one set only.
    can = (F.col("l_root") != F.col("r_root")) & _near_sizes("l_n", "r_n") & (differ * 9 <= F.col("l_n") + F.col("r_n"))
    ordered = F.col("l_node") > F.col("r_node")
    pick = lambda x, y: F.when(ordered, F.col(x)).otherwise(F.col(y))
    met = left.join(right, ["key", "i", "j"]).where(can).select(
        pick("l_node", "r_node").alias("a"), pick("r_node", "l_node").alias("b"), pick("l_root", "r_root").alias("a_root"), pick("r_root", "l_root").alias("b_root"), differ.alias("differ")
    )
    return met.distinct().join(seen.select("a", "b"), ["a", "b"], "left_anti")


def connect_open(roots: DataFrame, found: DataFrame, sets: DataFrame) -> DataFrame:
    """`roots` with the links among `found` (rows of `open_pairs`). If many pairs lie between the same parts, the one of the
    nearest digests is looked at first, and the others only if their parts are still not connected."""
    stars = lambda r: r.select(F.col("node").alias("a"), F.col("root").alias("b"))
    parts = [F.greatest("a_root", "b_root").alias("x"), F.least("a_root", "b_root").alias("y")]
    nearest = found.groupBy(*parts).agg(F.min(F.struct("differ", "a", "b")).alias("p")).select("p.a", "p.b")
    pairs = found.select("a", "b")
    if found.count() > MANY * nearest.count():
        roots = cut_lineage(connected(stars(roots).unionByName(links(nearest, sets))))
        pairs = apart(pairs, roots)
    return connected(stars(roots).unionByName(links(pairs, sets)))


def links(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Those of `pairs` (a, b) whose `sets` (node, shingles) reach SIMILARITY."""
    side = lambda c: sets.select(F.col("node").alias(c), F.col("shingles").alias(f"{c}_set"))
    common = F.size(F.array_intersect("a_set", "b_set"))
    both = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", common.alias("c"), (F.size("a_set") + F.size("b_set")).alias("n"))
    return both.where(F.col("c") >= F.lit(SIMILARITY) * (F.col("n") - F.col("c"))).select("a", "b")


def fingerprint_pairs(classes: DataFrame) -> DataFrame:
    """Pairs (a, b) of nodes that stand for the links of their fingerprints: each node with the least one of its fingerprint,
    and the least ones of two linked fingerprints. `classes`: node, fp."""
    least = classes.groupBy("fp").agg(F.min("node").alias("low"))
    same = classes.join(least, "fp").select(F.col("node").alias("a"), F.col("low").alias("b"))
    low = lambda c: least.select(F.col("fp").alias(c), F.col("low").alias(f"{c}_low"))
    linked = fingerprint_links(least.select("fp")).join(low("a"), "a").join(low("b"), "b").select(F.col("a_low").alias("a"), F.col("b_low").alias("b"))
    return same.unionByName(linked).where("a <> b")


def apart(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """Those of `pairs` that `roots` do not connect; they need no look at their sets."""
    root = lambda c: roots.select(F.col("node").alias(f"{c}_of"), F.col("root").alias(f"{c}_root"))
    met = pairs.join(root("a"), F.col("a") == F.col("a_of"), "left").join(root("b"), F.col("b") == F.col("b_of"), "left")
    return met.where(F.coalesce("a_root", "a") != F.coalesce("b_root", "b")).select(pairs.columns)


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each group of near copies, with its columns."""
    columns = [F.col(f"`{c}`") for c in docs.columns]
    rank = F.struct(F.col(id_col).isNull().alias("x"), F.col(id_col).alias("id"), F.xxhash64(*columns).alias("h"))
    text = F.col(text_col)
    marked = docs.select(rank.alias("m"), sketch_column(text).alias("s"), fingerprint_column(text).alias("fp")).select("m", "s.*", "fp")
    classes = cut_lineage(marked.groupBy("node", "fp").agg(F.min("m").alias("m"), F.any_value("n").alias("n"), F.any_value("bands").alias("bands")))
    nodes = classes.groupBy("node").agg(F.min("m").alias("m"), F.any_value("n").alias("n"), F.any_value("bands").alias("bands"))
    shared = cut_lineage(shared_keys(nodes, classes))
    pairs = cut_lineage(candidate_pairs(nodes, fingerprint_pairs(classes), shared))
    paired = pairs.select(F.explode(F.array("a", "b")).alias("node")).unionByName(shared.select("node")).distinct()
    asked = nodes.join(paired, "node", "left_semi").select("node", F.col("m.h").alias("h"), F.col("m").alias("k"))
    # Bounds in place of an equality keep the rows dealt by `h` alone, so they are not dealt out again to drop repeats.
    same = (F.col("m.h") == F.col("h")) & (F.col("m") >= F.col("k")) & (F.col("m") <= F.col("k"))
    texts = docs.select(rank.alias("m"), F.col(text_col).alias("t")).join(asked, same)
    sets = texts.select("node", text_function(lambda: shingle_sets, "shingles array<long>, bits array<long>")(F.col("t")).alias("s"), "h").select("h", "node", "s.*")
    sets = cut_lineage(sets.dropDuplicates(["h", "node"]).drop("h"))
    near = cut_lineage(links(pairs.where("first"), sets))
    rest = apart(pairs.where("not first"), connected(near))
    roots = cut_lineage(connected(near.unionByName(links(rest.select("a", "b"), sets))))
    found = cut_lineage(open_pairs(shared, sets, roots, pairs))
    if found.head(1):
        roots = connect_open(roots, found, sets)
    roots = roots.withColumnRenamed("node", "of")
    grouped = nodes.join(roots, nodes.node == roots.of, "left").groupBy(F.coalesce("root", "node").alias("root")).agg(F.min("m").alias("k"))
    kept = grouped.select(F.col("k.h").alias("h"), "k")
    found = packed(docs, rank.alias("m")).join(kept, same)
    return found.dropDuplicates(["h", "k"]).select("doc.*")  # repeated rows are equal, so any of them will do
