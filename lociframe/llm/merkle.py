"""A Merkle manifest of a table, with stored hash midstates.

Rows are leaves, ordered by id within their group. In runs of FAN consecutive nodes, level by level, nodes become the
SHA-256 of their digests' hexadecimal text until a group has one node, its subroot; subroots, in the order of their
groups, go on in the same way to the root. A digest's text is exactly one block of SHA-256, so the hash state of a
parent before each child slot is well defined: a parent keeps a copy of the state in front of every slot. Folding a
replaced child resumes the state in front of its slot, with the replacement and the siblings to its right only; no
sibling to its left is hashed again.

Nothing holds a whole group. Leaves are laid out in ranges of the order and numbered by one count per range. Then a tree
of FAN ** depth leaves (a block of at most BLOCK) is one group of a grouped map, its top is a node of the next round,
and rounds go on until every group has one node. On the way back a block gets the path of its top, one row per block:
for each level the state before its slot and the siblings on both sides.

Defined results: fields that are null are `-`, all others their length in bytes, `:` and their text, so null and empty
differ; a null group is a group of its own, the first; null ids come first in a group; rows of equal group and id are
ordered by their digests, and equal rows are leaves each; a table of one row has an empty proof, and its leaf is the
root; an empty table gives no rows. Columns that are not named are not looked at. Rows that are equal in all named
columns stay in one range.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lociframe.session import cut_lineage

FAN = 2
BLOCK = 4096  # leaves of one block, at most
RANGE_ROWS = 50_000  # rows of one range of the order

NODE = "g long, n long, i long, d binary"
STEP = "struct<state: binary, left: binary, right: binary>"
PATH = f"g long, i long, sub binary, path array<{STEP}>"


def _root_bits(n: int, power: int) -> int:
    """The first 32 bits behind the point of the square (2) or cube (3) root of n."""
    wanted, low, high = n << (32 * power), 0, n << 32
    while low < high:
        mid = (low + high + 1) // 2
        low, high = (mid, high) if mid**power <= wanted else (low, mid - 1)
    return low & 0xFFFFFFFF


_PRIMES = [p for p in range(2, 312) if all(p % q for q in range(2, p))]
_ROUND = [np.uint32(_root_bits(p, 3)) for p in _PRIMES]
START = np.array([_root_bits(p, 2) for p in _PRIMES[:8]], np.uint32)
_DIGITS = np.frombuffer(b"0123456789abcdef", np.uint8)


def _turned(x: np.ndarray, k: int) -> np.ndarray:
    return (x >> np.uint32(k)) | (x << np.uint32(32 - k))


def _schedule(words: np.ndarray) -> np.ndarray:
    """The 64 words of a block's rounds, from its 16 (first axis)."""
    w = np.empty((64, *words.shape[1:]), np.uint32)
    w[:16] = words
    for t in range(16, 64):
        a, b = w[t - 15], w[t - 2]
        w[t] = w[t - 16] + w[t - 7] + (_turned(a, 7) ^ _turned(a, 18) ^ (a >> np.uint32(3))) + (_turned(b, 17) ^ _turned(b, 19) ^ (b >> np.uint32(10)))
    return w


def advance(states: np.ndarray, scheduled: np.ndarray) -> np.ndarray:
    """States (8 × rows) after one more block, whose schedule is given for each row or for all."""
    a, b, c, d, e, f, g, h = states
    for t in range(64):
        first = h + (_turned(e, 6) ^ _turned(e, 11) ^ _turned(e, 25)) + (g ^ (e & (f ^ g))) + _ROUND[t] + scheduled[t]
        second = (_turned(a, 2) ^ _turned(a, 13) ^ _turned(a, 22)) + ((a & b) | (c & (a | b)))
        h, g, f, e, d, c, b, a = g, f, e, d + first, c, b, a, first + second
    return states + np.stack([a, b, c, d, e, f, g, h])


def text_of(digests: np.ndarray) -> np.ndarray:
    """Hexadecimal text (rows × 64 bytes) of digests (8 × rows)."""
    raw = np.ascontiguousarray(digests.T).astype(">u4").view(np.uint8).reshape(digests.shape[1], 32)
    return np.stack([_DIGITS[raw >> 4], _DIGITS[raw & 15]], axis=2).reshape(-1, 64)


def _fed(states: np.ndarray, digests: np.ndarray) -> np.ndarray:
    """States after the texts of `digests`."""
    words = text_of(digests).view(">u4").astype(np.uint32).T
    return advance(states, _schedule(words))


def _closed(states: np.ndarray, blocks: int) -> np.ndarray:
    """Digests of messages of so many whole blocks: the padding is a block of its own."""
    last = np.zeros((16, 1), np.uint32)
    last[0], last[14], last[15] = 1 << 31, (blocks * 512) >> 32, (blocks * 512) & 0xFFFFFFFF
    return advance(states, _schedule(last))


def _words(binaries: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Digests (8 × rows) of 32-byte values."""
    joined = b"".join(binaries.to_pylist())
    return np.frombuffer(joined, ">u4").reshape(-1, 8).T.astype(np.uint32)


def _bytes(digests: np.ndarray) -> list[bytes]:
    raw = np.ascontiguousarray(digests.T).astype(">u4").tobytes()
    return [raw[k : k + 32] for k in range(0, len(raw), 32)]


class Tree:
    """The levels of one block: digests of each level, and the state of every parent before each of its child slots."""

    def __init__(self, leaves: np.ndarray, fan: int, depth: int | None):
        """`depth` levels of parents, or as many as leave one node."""
        self.fan, self.levels, self.before = fan, [leaves], []
        while len(self.before) < depth if depth is not None else self.levels[-1].shape[1] > 1:
            self._grow()

    def _grow(self) -> None:
        nodes, fan = self.levels[-1], self.fan
        m = nodes.shape[1]
        parents = -(-m // fan)
        state = np.repeat(START[:, None], parents, axis=1)
        kept = np.zeros((fan, 8, parents), np.uint32)
        for slot in range(fan):
            kept[slot] = state  # the copy in front of this slot
            own = nodes[:, slot::fan]
            state[:, : own.shape[1]] = _fed(state[:, : own.shape[1]], own)
        sizes = np.minimum(fan, m - np.arange(parents) * fan)
        digests = np.empty_like(state)
        for size in np.unique(sizes):
            digests[:, sizes == size] = _closed(state[:, sizes == size], int(size))
        self.levels.append(digests)
        self.before.append(kept)

    @property
    def top(self) -> np.ndarray:
        return self.levels[-1]

    def fold(self, digests: np.ndarray) -> np.ndarray:
        """The top that each leaf gives if it is replaced, alone, by the digest in its place."""
        at, now = np.arange(digests.shape[1]), digests
        for nodes, kept in zip(self.levels, self.before, strict=False):
            parent, slot = at // self.fan, at % self.fan
            state = _fed(kept[slot, :, parent].T, now)
            sizes = np.minimum(self.fan, nodes.shape[1] - parent * self.fan)
            for right in range(1, self.fan):
                more = slot + right < sizes
                if more.any():
                    state[:, more] = _fed(state[:, more], nodes[:, (at + right)[more]])
            now = np.empty_like(state)
            for size in np.unique(sizes):
                now[:, sizes == size] = _closed(state[:, sizes == size], int(size))
            at = parent
        return now

    def siblings(self) -> tuple[np.ndarray, np.ndarray]:
        """Texts of each leaf's siblings, level by level and left to right, with a mask of the bytes that exist."""
        n = self.levels[0].shape[1]
        texts, there, at = [np.zeros((n, 0), np.uint8)], [np.zeros((n, 0), bool)], np.arange(n)
        for nodes in self.levels[: len(self.before)]:
            start, text = at // self.fan * self.fan, text_of(nodes)
            for slot in range(self.fan):
                other = start + slot
                ok = (other != at) & (other < nodes.shape[1])
                texts.append(text[np.minimum(other, nodes.shape[1] - 1)])
                there.append(np.repeat(ok[:, None], 64, axis=1))
            at = at // self.fan
        return np.concatenate(texts, axis=1), np.concatenate(there, axis=1)

    def paths(self) -> list[list[dict]]:
        """For each leaf, by level: the state before its slot and the digests of the siblings on both sides."""
        found: list[list[dict]] = [[] for _ in range(self.levels[0].shape[1])]
        for level, (nodes, kept) in enumerate(zip(self.levels, self.before, strict=False)):
            raw = _bytes(nodes)
            for i, path in enumerate(found):
                at = i // self.fan**level
                parent, slot = divmod(at, self.fan)
                own = raw[parent * self.fan : (parent + 1) * self.fan]
                state = kept[slot, :, parent].astype(">u4").tobytes()
                path.append({"state": state, "left": b"".join(own[:slot]), "right": b"".join(own[slot + 1 :])})
        return found


def follow(digests: np.ndarray, path: list[dict]) -> np.ndarray:
    """Fold digests on along a path that is the same for all of them."""
    for step in path:
        state = np.frombuffer(step["state"], ">u4").astype(np.uint32)
        state = _fed(np.repeat(state[:, None], digests.shape[1], axis=1), digests)
        right = np.frombuffer(step["right"], ">u4").reshape(-1, 8).T.astype(np.uint32)
        for k in range(right.shape[1]):
            state = _fed(state, np.repeat(right[:, k : k + 1], digests.shape[1], axis=1))
        digests = _closed(state, (len(step["left"]) + len(step["right"])) // 32 + 1)
    return digests


def _path_text(path: list[dict]) -> bytes:
    return b"".join((step["left"] + step["right"]).hex().encode() for step in path)


def leaf(columns: Sequence[Column]) -> Column:
    """Digest, in hexadecimal, of the given columns of a row."""

    def field(c: Column) -> Column:
        text = c.cast("string")
        return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))

    return F.sha2(F.concat(*[field(c) for c in columns]), 256)


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds k, the number of a row among the rows of its group in its range."""
    last, k = None, 0
    for batch in batches:
        if not batch.num_rows:
            continue
        null, text = batch.column(0).is_null(), batch.column(0).fill_null("")
        change = np.ones(batch.num_rows, bool)
        change[1:] = np.asarray(pc.or_(pc.not_equal(text[1:], text[:-1]), pc.not_equal(null[1:], null[:-1])))
        change[0] = (null[0].as_py(), text[0].as_py()) != last
        starts = np.flatnonzero(change)
        run = np.arange(batch.num_rows) - np.concatenate([[-k], starts])[np.cumsum(change)]
        last, k = (null[-1].as_py(), text[-1].as_py()), int(run[-1]) + 1
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(run)], [*batch.schema.names, "k"])


def placed(rows: DataFrame) -> DataFrame:
    """`rows`: grp (text), id, d, r. Adds g (number of the group in their order), n (rows of the group) and i (place of
    the row in the group by id and digest)."""
    order = [F.col("grp").asc_nulls_first(), F.col("id").asc_nulls_first(), F.col("d").asc()]
    parts = max(1, -(-rows.count() // RANGE_ROWS))
    laid = rows.select("grp", "id", "d", "r").repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("p", F.spark_partition_id())
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in laid.schema.fields)
    laid = cut_lineage(laid.mapInArrow(_numbered, f"{kinds}, k long"))
    counts = cut_lineage(laid.groupBy("p", "grp").agg(F.count(F.lit(1)).alias("m")))  # a row per range and group
    of_group = Window.partitionBy("grp").orderBy("p").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("front", F.coalesce(F.sum("m").over(of_group), F.lit(0)))
    groups = counts.groupBy(F.col("grp").alias("of")).agg(F.min("p").alias("p0"), F.sum("m").alias("n"))
    starts = groups.groupBy("p0").agg(F.count(F.lit(1)).alias("c"))
    over = Window.orderBy("p0").rowsBetween(Window.unboundedPreceding, -1)  # one row per range
    starts = starts.select(F.col("p0").alias("q"), F.coalesce(F.sum("c").over(over), F.lit(0)).alias("base"))
    inside = F.row_number().over(Window.partitionBy("p0").orderBy(F.col("of").asc_nulls_first()))
    groups = groups.withColumn("in", inside).join(starts, F.col("p0") == F.col("q")).select("of", "n", (F.col("base") + F.col("in") - 1).alias("g"))
    edges = counts.join(groups, F.col("grp").eqNullSafe(F.col("of"))).select(F.col("p").alias("ep"), "of", "n", "g", "front")
    met = laid.join(edges, (F.col("p") == F.col("ep")) & F.col("grp").eqNullSafe(F.col("of")))
    return met.select("g", "n", (F.col("front") + F.col("k")).alias("i"), "id", "d", "r")


def depth_of(fan: int, block: int) -> int:
    """Levels of a block."""
    depth = 1
    while fan ** (depth + 1) <= block:
        depth += 1
    return depth


def _tree(table: pa.Table, fan: int, depth: int) -> tuple[pa.Table, Tree]:
    """The rows of a block in their order, and their tree."""
    table = table.sort_by("i")
    alone = table.column("n")[0].as_py() <= fan**depth
    return table, Tree(_words(table.column("d")), fan, None if alone else depth)


def _chain(nodes: DataFrame, fan: int, depth: int) -> list[DataFrame]:
    """`nodes` and the tops of their blocks, round after round, up to one node a group."""
    size = fan**depth

    def tops(table: pa.Table) -> pa.Table:
        table, tree = _tree(table, fan, depth)
        g, n, i = (table.column(c)[0].as_py() for c in ("g", "n", "i"))
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary())
        row = (g, -(-n // size), i // size, _bytes(tree.top)[0])
        return pa.table([pa.array([v], k) for v, k in zip(row, kinds, strict=True)], names=["g", "n", "i", "d"])

    chain = [nodes]
    while (most := chain[-1].agg(F.max("n")).first()[0]) is not None and most > 1:
        at = chain[-1].select("g", "n", "i", "d").groupBy("g", F.floor(F.col("i") / size).cast("long").alias("b"))
        chain.append(cut_lineage(at.applyInArrow(tops, NODE)))
    return chain


def _blocks(nodes: DataFrame, paths: DataFrame, size: int):
    """Blocks of `nodes` next to the path of their tops."""
    left = nodes.withColumn("b", F.floor(F.col("i") / size).cast("long")).groupBy("g", "b")
    return left.cogroup(paths.withColumnRenamed("i", "b").groupBy("g", "b"))


def _down(chain: list[DataFrame], paths: DataFrame, fan: int, depth: int) -> DataFrame:
    """Paths of the nodes above the first ones of `chain`, from those of its last nodes."""

    def extend(nodes: pa.Table, above: pa.Table) -> pa.Table:
        nodes, tree = _tree(nodes, fan, depth)
        sub, path = above.column("sub")[0], above.column("path")[0].as_py()
        kind = above.schema.field("path").type
        return pa.table(
            [nodes.column("g"), nodes.column("i"), pa.array([sub.as_py()] * len(nodes), pa.binary()), pa.array([own + path for own in tree.paths()], kind)],
            names=["g", "i", "sub", "path"],
        )

    for nodes in reversed(chain[1:-1]):
        paths = cut_lineage(_blocks(nodes, paths, fan**depth).applyInArrow(extend, PATH))
    return paths


def manifest(
    docs: DataFrame, leaf_of: Column, instead: Column | None = None, id_col: str = "doc_id", group_col: str = "lang", fan: int = FAN, block: int = BLOCK
) -> DataFrame:
    """One row per row of `docs`: its id, leaf, subroot, root, proof (the siblings' texts, 64 characters each, from the
    leaf up to the root) and folded_root, the root that `instead`, if not null, gives in the leaf's place.

    `leaf_of` and `instead` are digests in hexadecimal (see `leaf`).
    """
    replaced = F.lit(None).cast("string") if instead is None else instead
    rows = docs.select(F.col(group_col).cast("string").alias("grp"), F.col(id_col).alias("id"), F.unhex(leaf_of).alias("d"), F.unhex(replaced).alias("r"))
    kind = rows.schema["id"].dataType.simpleString()
    out = f"id {kind}, leaf string, subroot string, root string, proof string, folded_root string"
    leaves = placed(rows)
    if leaves.isEmpty():
        return rows.where(F.lit(False)).select(F.col("id").alias(id_col), *[F.lit("").alias(c.split()[0]) for c in out.split(", ")[1:]])
    depth = depth_of(fan, block)
    chain = _chain(leaves, fan, depth)
    groups = chain[-1].agg(F.count(F.lit(1))).first()[0]
    subroots = chain[-1].select(F.lit(0).cast("long").alias("g"), F.lit(groups).cast("long").alias("n"), F.col("g").alias("i"), "d")
    over = _chain(subroots, fan, depth)
    root = bytes(over[-1].first()["d"])
    nowhere = F.array().cast(f"array<{STEP}>")
    # the subroots are the first nodes of their own chain, so one more step down than for leaves gives their paths
    ends = _down([subroots, *over] if len(over) > 1 else over, over[-1].select("g", "i", F.col("d").alias("sub"), nowhere.alias("path")), fan, depth)
    tops = ends.select(F.col("i").alias("g"), "path").join(chain[-1].select("g", F.col("d").alias("sub")), "g").select("g", F.lit(0).cast("long").alias("i"), "sub", "path")
    paths = _down(chain, tops, fan, depth)

    def told(table: pa.Table, above: pa.Table) -> pa.Table:
        table, tree = _tree(table, fan, depth)
        sub, path = above.column("sub")[0].as_py(), above.column("path")[0].as_py()
        n, own = len(table), tree.levels[0]
        given = [r or d for r, d in zip(table.column("r").to_pylist(), table.column("d").to_pylist(), strict=True)]
        folded = follow(tree.fold(_words(pa.array(given))), path)
        texts, there = tree.siblings()
        tail = np.frombuffer(_path_text(path), np.uint8)
        texts = np.concatenate([texts, np.repeat(tail[None], n, axis=0)], axis=1)
        there = np.concatenate([there, np.ones((n, len(tail)), bool)], axis=1)
        ends_at = np.concatenate([[0], np.cumsum(there.sum(axis=1))]).astype(np.int32)
        proof = pa.StringArray.from_buffers(n, pa.py_buffer(ends_at), pa.py_buffer(texts[there]))
        hexes = lambda digests: pa.array([t.tobytes().decode() for t in text_of(digests)])
        columns = [table.column("id"), hexes(own), pa.array([sub.hex()] * n), pa.array([root.hex()] * n), proof, hexes(folded)]
        return pa.table(columns, names=[c.split()[0] for c in out.split(", ")])

    return _blocks(leaves, paths, fan**depth).applyInArrow(told, out).withColumnRenamed("id", id_col)
