"""Document fingerprints as invertible Bloom lookup sketches, with DataFrame functions only.

A text is cut into paragraphs (lines, in stretches of at most PIECE characters from the line's start), and each distinct
one becomes a 64-bit digest. A digest goes to HASHES cells of a sketch, one in each equal part of its cells. A cell
holds a count, the xor of digests and the xor of their check hashes. Sketches are kept sparse: only cells that are not
empty, by number, so a larger sketch costs no more than a small one.

Two versions are compared by the difference of their sketches, cell by cell: common digests cancel. Peeling then takes
digests out of all cells that hold exactly one (count 1 or -1 and a check hash that agrees), round after round, until no
cell is left, which recovers the digests that only one version has. If cells remain, the comparison starts again with
sketches of FAN times as many cells, built anew from both versions' digests, up to LEVELS times. Likeness is the share
of common digests among all distinct ones.

The fingerprint is the sketch of CELLS cells as text, with the number of digests, so equal texts have equal
fingerprints.

Defined results: null texts are empty; an empty text has no digests, and two such texts have likeness 1; a paragraph
that repeats counts once; rows with equal id and text are one document for the order and give a row each; null ids come
last in descending order; ids that repeat with other texts are ordered by a hash of the text; a table of one document
takes itself as the next; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lociframe.session import cut_lineage

PIECE = 160
PARAGRAPH = r"[^\n]{1,%d}" % PIECE
CELLS, HASHES = 96, 3
FAN, LEVELS = 4, 10
ROUNDS = 64  # of peeling; below the threshold a handful is enough, and a round that finds nothing ends it
CHECK_SEED = 77
ORDER_ROWS = 20_000  # documents of one range of the order

_ENTRY = "array<struct<c:int,n:int,x:bigint,h:bigint>>"


def _let(value: Column, fn) -> Column:
    """`fn` of a value that is computed once."""
    return F.get(F.transform(F.array(value), fn), 0)


def digests(text: Column) -> Column:
    """Distinct digests of the paragraphs of a text that is not null."""
    parts = F.transform(F.regexp_extract_all(text, F.lit(PARAGRAPH), F.lit(0)), lambda p: F.trim(p))
    return F.array_distinct(F.transform(F.filter(parts, lambda p: p != ""), lambda p: F.xxhash64(p)))


def _check(digest: Column) -> Column:
    return F.xxhash64(digest, F.lit(CHECK_SEED))


def _entries(all_: Column, sign: int, cells: Column) -> Column:
    """Cell number, count, digest and check hash of each digest in each of its cells."""
    part = F.floor(cells / HASHES).cast("int")

    def of(d):
        rest = (F.lit(sign).alias("n"), d.alias("x"), _check(d).alias("h"))
        return F.array(*[F.struct((F.pmod(F.xxhash64(d, F.lit(j)), part) + part * j).cast("int").alias("c"), *rest) for j in range(HASHES)])

    return F.flatten(F.transform(all_, of))


def _merged(entries: Column) -> Column:
    """Cells that are not empty, by number: sums of the entries of each cell."""

    def runs(s):
        m = F.size(s)
        begins = F.filter(F.sequence(F.lit(1), m), lambda i: (i == 1) | (F.get(s, i - 1)["c"] != F.get(s, i - 2)["c"]))
        cut = lambda f: F.transform(f, lambda b, i: F.slice(s, b, F.coalesce(F.get(f, i + 1), m + 1) - b))
        return F.when(m > 0, _let(begins, cut)).otherwise(F.array().cast(f"array<{_ENTRY}>"))

    zero = F.struct(F.lit(0).alias("c"), F.lit(0).alias("n"), F.lit(0).cast("long").alias("x"), F.lit(0).cast("long").alias("h"))

    def add(acc, e):
        return F.struct(e["c"].alias("c"), (acc["n"] + e["n"]).alias("n"), acc["x"].bitwiseXOR(e["x"]).alias("x"), acc["h"].bitwiseXOR(e["h"]).alias("h"))

    cells = F.transform(_let(F.sort_array(entries), runs), lambda run: F.aggregate(run, zero, add))
    return F.filter(cells, lambda c: (c["n"] != 0) | (c["x"] != 0) | (c["h"] != 0))


def _peeled(cells: Column, size: Column) -> Column:
    """Number of digests that peeling recovers; null if cells remain."""
    start = F.struct(cells.alias("cells"), F.lit(0).alias("found"), F.lit(False).alias("stuck"))

    def take(acc, _):
        pure = lambda n: F.array_distinct(F.transform(F.filter(acc["cells"], lambda c: (c["n"] == n) & (_check(c["x"]) == c["h"])), lambda c: c["x"]))
        both = F.struct(pure(1).alias("p"), pure(-1).alias("m"))

        def without(own):
            n = F.size(own["p"]) + F.size(own["m"])
            less = lambda: _merged(F.concat(acc["cells"], _entries(own["p"], -1, size), _entries(own["m"], 1, size)))
            return F.struct(F.when(n > 0, less()).otherwise(acc["cells"]).alias("cells"), (acc["found"] + n).alias("found"), (n == 0).alias("stuck"))

        return F.when(acc["stuck"] | (F.size(acc["cells"]) == 0), acc).otherwise(_let(both, without))

    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, take, lambda acc: F.when(F.size(acc["cells"]) == 0, acc["found"]))


def difference(a: Column, b: Column) -> Column:
    """Number of digests that only one of two arrays of distinct digests has, by peeling. A level, with FAN times the
    cells of the one below, is tried only where all below it failed."""
    told = lambda size: _peeled(_merged(F.concat(_entries(a, 1, size), _entries(b, -1, size))), size)
    levels = F.array(*[F.lit(CELLS * FAN**k) for k in range(LEVELS)])
    return F.aggregate(levels, F.lit(None).cast("int"), lambda acc, size: F.when(acc.isNotNull(), acc).otherwise(told(size)))


def likeness(a: Column, b: Column, differing: Column) -> Column:
    """Share of common digests among all, 0 to 1."""
    both = F.size(a) + F.size(b)
    return F.when(both == 0, F.lit(1.0)).otherwise((both - differing) / (both + differing))


def sketch_text(all_: Column) -> Column:
    """Number of digests, then number, count, xor and check of each cell, in hexadecimal."""
    text = lambda c: F.concat_ws(".", *[F.lower(F.hex(c[k])) for k in ("c", "n", "x", "h")])
    return F.concat_ws(":", F.size(all_).cast("string"), F.array_join(F.transform(_merged(_entries(all_, 1, F.lit(CELLS))), text), ":"))


def successors(keys: DataFrame) -> DataFrame:
    """`keys`: id, h (hash of the text), n (length), each once. Adds next_id, next_h (next in descending id, the first
    after the last) and prev_id, prev_h, prev_n (the reverse).

    Keys are laid out in ranges of the order, so each range is ordered on its own; the neighbours of its first and last
    key come from one row per range.
    """
    n = keys.count()
    order = [F.col("id").desc_nulls_last(), F.col("h").desc()]
    parts = max(1, -(-n // ORDER_ROWS))
    laid = cut_lineage(keys.repartitionByRange(parts, *order).withColumn("p", F.spark_partition_id()))
    key = F.struct("id", "h", "n")
    rank = F.struct(F.col("id").isNotNull().alias("x"), "id", "h")
    edges = laid.groupBy("p").agg(F.max_by(key, rank).alias("first"), F.min_by(key, rank).alias("last"))
    over = Window.orderBy("p")  # one row per range
    whole = over.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    edges = edges.select(
        "p",
        F.coalesce(F.lead("first").over(over), F.first("first").over(whole)).alias("after"),
        F.coalesce(F.lag("last").over(over), F.last("last").over(whole)).alias("before"),
    )
    inside = Window.partitionBy("p").orderBy(*order)
    near = laid.select("p", "id", "h", F.lead(key).over(inside).alias("next"), F.lag(key).over(inside).alias("prev"))
    near = near.join(edges, "p").select("id", "h", F.coalesce("next", "after").alias("next"), F.coalesce("prev", "before").alias("prev"))
    return near.select("id", "h", F.col("prev.id").alias("prev_id"), F.col("prev.h").alias("prev_h"), F.col("prev.n").alias("prev_n"))


def _named(id_: Column, h: Column, prefix: str) -> list[Column]:
    """Plain join keys, none of them null, of an id that may be null and a text hash."""
    return [h.alias(f"{prefix}h"), F.coalesce(id_.cast("string"), F.lit("")).alias(f"{prefix}i"), id_.isNull().alias(f"{prefix}z")]


def _joined(a: DataFrame, b: DataFrame, x: str, y: str) -> DataFrame:
    return a.join(b, (F.col(f"{x}h") == F.col(f"{y}h")) & (F.col(f"{x}i") == F.col(f"{y}i")) & (F.col(f"{x}z") == F.col(f"{y}z")))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: its id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The texts are shuffled once, by id and text hash, and that shuffle serves both joins. In the first a text meets what
    the one in front of it needs, its first code points and its digests, which are sent on to that one in the second.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("h", F.xxhash64("text"))
    keys = rows.select("id", "h", F.length("text").alias("n")).distinct()
    placed = successors(keys).select(*_named(F.col("id"), F.col("h"), "p"), *_named(F.col("prev_id"), F.col("prev_h"), "t"), "prev_n")
    whole = rows.select(*_named(F.col("id"), F.col("h"), "w"), "text")  # no other column, or the two shuffles would differ
    sent = _joined(whole, placed, "w", "p").select(
        "wh", "wi", "wz", "th", "ti", "tz", F.left("text", F.floor(F.col("prev_n") / 3).cast("int")).alias("head"), digests(F.col("text")).alias("next")
    )
    # equal rows send the same; one of them is enough
    sent = sent.dropDuplicates(["wh", "wi", "wz"]).select("th", "ti", "tz", "head", "next")
    met = _joined(whole, sent, "w", "t")
    n = F.length("text")
    edited = F.concat(F.left(F.col("text"), n - F.floor(n / 3).cast("int")), F.col("head"))
    own = F.when(~F.col("wz"), F.col("wi").cast(rows.schema["id"].dataType))
    full = met.select(own.alias("id"), n.cast("long").alias("n_chars"), digests(F.col("text")).alias("a"), edited.alias("edited"), F.col("next").alias("c"))
    seen = full.select("id", "n_chars", F.sha2(F.col("edited"), 256).alias("edited_sha256"), "a", digests(F.col("edited")).alias("b"), "c")
    a, b, c = F.col("a"), F.col("b"), F.col("c")
    told = seen.select("id", "n_chars", "edited_sha256", "a", "b", "c", difference(a, b).alias("d_edited"), difference(a, c).alias("d_next"))
    return told.select(
        F.col("id").alias(id_col),
        "n_chars",
        "edited_sha256",
        sketch_text(a).alias("fingerprint"),
        sketch_text(b).alias("edited_fingerprint"),
        likeness(a, b, F.col("d_edited")).alias("near_edited"),
        likeness(a, c, F.col("d_next")).alias("near_next"),
    )
