"""Embedding whitening by Chebyshev-filtered subspace iteration.

The covariance V of all vectors is never formed. A block of a few more vectors than wanted components is improved by
polynomials of V: each degree is one pass over the data, in which tasks form z'(zQ) of their centred rows and the parts
are added up in groups. The three-term Chebyshev recurrence keeps the unwanted part of the spectrum, from the bottom (a
short Lanczos run tells it) to the least Ritz value of the block, between -1 and 1 while it lifts the wanted part, so
one filter of degree p damps far more than p plain power steps. Then the block is made orthonormal (QR), projected
(Rayleigh-Ritz, one pass) and the residuals |Vu - eu| are taken. The loop ends when every wanted pair is certified, a
residual of at most TOLERANCE times the largest eigenvalue, or when residuals below LOOSE no longer fall.

Entries are made whole numbers first (floor(SCALE * c) + SHIFT); sums and deviations are exact. The driver holds
matrices of the vector's length by the block's width, nothing that grows with the rows, and at most FAN parts at a time.

Defined results: vectors that are null or hold null or non-finite entries are dropped; so are vectors whose length is
not the commonest one (of equally common lengths the larger); null ids and repeated rows are kept and count each; ties
between eigenvalues give any basis of their space, the same for all rows; components whose eigenvalue is zero to working
precision are left out, so equal vectors, one vector or empty vectors have none; a deviation beyond a long is null; an
empty table gives no rows. Columns other than the id and the vector are not looked at.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lociframe.session import ensure_checkpoint_dir

SCALE, SHIFT = 64, 1_000_000
COMPONENTS = 32
GUARD = 16  # further columns of the block, beyond the wanted ones
TOLERANCE, LOOSE = 1e-13, 1e-9  # residual over the largest eigenvalue
LANCZOS = 12  # passes that find the ends of the spectrum
DEGREE = 30  # of one filter, at most
ROUNDS = 40
ROWS = 4096  # vectors of one stored block
FAN = 64  # parts that one task, or the driver, adds up
EDGE = 2.0**63

BLOCK = "dims int, n int, wide boolean, x binary, sums array<decimal(38,0)>"


@dataclass
class Model:
    n: int
    sums: list[int]  # of the whole-number vectors, exact
    values: np.ndarray  # eigenvalues, falling
    vectors: np.ndarray  # one column a component
    trace: float
    residual: float  # largest of the wanted pairs, over the largest eigenvalue
    passes: int
    identity_error: float = 0.0

    @property
    def explained(self) -> list[float]:
        return [float(v / self.trace) for v in self.values]


def _matrices(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row numbers and whole numbers less SHIFT of the usable vectors of a batch, one pair for each length."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    whole = column.cast(pa.large_list(pa.float64()))
    lengths = np.asarray(whole.value_lengths().fill_null(-1))
    flat = whole.flatten()
    values = np.asarray(flat.fill_null(math.nan))
    held = np.flatnonzero(lengths >= 0)  # null lists have no place in the flat values
    starts = np.cumsum(lengths[held]) - lengths[held]
    bad = np.concatenate([[0], np.cumsum(~np.isfinite(values))])
    good = bad[starts + lengths[held]] == bad[starts]
    held, starts = held[good], starts[good]
    for d in np.unique(lengths[held]):
        own = lengths[held] == d
        rows = values[starts[own][:, None] + np.arange(d)]
        with np.errstate(over="ignore"):
            # beyond the range of a long a value stays at its end, as in a cast; SHIFT is added where sums are exact
            x = np.clip(np.floor(rows * SCALE), -EDGE, np.nextafter(EDGE, 0))
        yield held[own], x.astype(np.int64)


def _exact_sums(x: np.ndarray) -> list[int]:
    high, low = x >> 32, x & 0xFFFFFFFF
    return [(int(h) << 32) + int(l) for h, l in zip(high.sum(axis=0), low.sum(axis=0), strict=True)]


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Usable vectors of a task in blocks of ROWS, with exact sums."""
    waiting: dict[int, list[np.ndarray]] = {}

    def block(d: int, parts: list[np.ndarray]) -> pa.RecordBatch:
        x = np.concatenate(parts)
        wide = bool(x.size) and bool((x != x.astype(np.int32)).any())
        sums = [Decimal(s) for s in _exact_sums(x)]
        data = x.astype(np.int64 if wide else np.int32).tobytes()
        kinds = [pa.int32(), pa.int32(), pa.bool_(), pa.binary(), pa.list_(pa.decimal128(38, 0))]
        row = [[d], [len(x)], [wide], [data], [sums]]
        return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(row, kinds, strict=True)], ["dims", "n", "wide", "x", "sums"])

    for batch in batches:
        for _, x in _matrices(batch.column(0)):
            held = waiting.setdefault(x.shape[1], [])
            for k in range(0, len(x), ROWS):
                held.append(x[k : k + ROWS])
                if sum(map(len, held)) >= ROWS:
                    yield block(x.shape[1], held)
                    held.clear()
    for d, held in waiting.items():
        if held:
            yield block(d, held)


class _Data:
    """Stored blocks of one length and the passes over them."""

    def __init__(self, blocks: DataFrame, dims: int, n: int, sums: list[int]):
        self.blocks, self.dims, self.n, self.passes = blocks.where(F.col("dims") == dims).select("n", "wide", "x"), dims, n, 0
        self.base = [s // n for s in sums]  # whole part of the mean, so that x - base is exact
        self.rest = np.array([(s % n) / n for s in sums])
        self.tasks = max(1, self.blocks.rdd.getNumPartitions())

    def added(self, part, shape: tuple[int, ...]) -> np.ndarray:
        """Sum of part(z) over the centred rows z of all blocks, a matrix of `shape`."""
        base, rest, dims = np.array(self.base, np.int64), self.rest, self.dims

        def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(shape)
            for batch in batches:
                for wide, data in zip(batch.column(1).to_pylist(), batch.column(2), strict=True):
                    x = np.frombuffer(data.as_buffer(), np.int64 if wide else np.int32).reshape(-1, dims)
                    total += part(_centred(x, base, rest))
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["m"])

        def adds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(shape)
            for batch in batches:
                for m in batch.column(0):
                    total += np.frombuffer(m.as_buffer()).reshape(shape)
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["m"])

        self.passes += 1
        made, left = self.blocks.mapInArrow(parts, "m binary"), self.tasks
        while left > FAN:
            left = -(-left // FAN)
            made = made.repartition(left).mapInArrow(adds, "m binary")
        return sum((np.frombuffer(r.m).reshape(shape) for r in made.collect()), np.zeros(shape))

    def times(self, q: np.ndarray) -> np.ndarray:
        """V q: one pass."""
        return self.added(lambda z: z.T @ (z @ q), q.shape) / self.n

    def trace(self) -> float:
        return float(self.added(lambda z: np.array([np.einsum("ij,ij->", z, z)]), (1,))[0] / self.n)


def _centred(x: np.ndarray, base: np.ndarray, rest: np.ndarray) -> np.ndarray:
    """x less the mean; whole parts are taken off as whole numbers, unless the difference could pass a long's range."""
    if x.dtype == np.int64 and x.size and float(np.abs(x.astype(np.float64)).max()) >= EDGE / 4:
        return x.astype(np.float64) - base.astype(np.float64) - rest
    return (x.astype(np.int64) - base).astype(np.float64) - rest


def _ends(data: _Data, seed: int = 5) -> tuple[float, float]:
    """Estimates of the least and the largest eigenvalue, from a Lanczos run with full reorthogonalisation."""
    rng = np.random.default_rng(seed)
    q = [v / np.linalg.norm(v) for v in [rng.standard_normal(data.dims)]]
    diagonal, beside = [], []
    for _ in range(min(LANCZOS, data.dims)):
        w = data.times(q[-1][:, None])[:, 0]
        diagonal.append(float(w @ q[-1]))
        for _ in range(2):
            for v in q:
                w = w - (w @ v) * v
        beside.append(float(np.linalg.norm(w)))
        if beside[-1] <= 1e-12 * max(map(abs, diagonal)):
            break
        q.append(w / beside[-1])
    k = len(diagonal)
    ritz, s = np.linalg.eigh(np.diag(diagonal) + np.diag(beside[: k - 1], 1) + np.diag(beside[: k - 1], -1))
    slack = beside[-1] * np.abs(s[-1])  # an eigenvalue lies this close to each Ritz value
    return max(0.0, float(ritz[0] - slack[0])), float(ritz[-1] + slack[-1])


def _filtered(data: _Data, q: np.ndarray, degree: int, low: float, high: float, top: float) -> np.ndarray:
    """Chebyshev polynomial of V on q, at most 1 in size on [low, high] and scaled to 1 at `top`."""
    half, middle = (high - low) / 2, (high + low) / 2
    first = half / (top - middle)
    scale, before = first, q
    now = (data.times(q) - middle * q) * (first / half)
    for _ in range(degree - 1):
        nxt = 1 / (2 / first - scale)
        after = (data.times(now) - middle * now) * (2 * nxt / half) - scale * nxt * before
        before, now, scale = now, after, nxt
    return now


def _degree(value: float, low: float, high: float, factor: float) -> int:
    """Degree whose polynomial exceeds `factor` at `value`, within 4 and DEGREE."""
    x = (2 * value - low - high) / (high - low)
    grows = math.log(x + math.sqrt(max(x * x - 1, 0))) if x > 1 else 0
    return int(min(DEGREE, max(4, math.ceil(math.log(max(factor, 2)) / grows)))) if grows else DEGREE


def _subspace(data: _Data, wanted: int, guard: int) -> tuple[np.ndarray, np.ndarray, float]:
    """Eigenvalues, vectors and largest residual of the `wanted` first components."""
    d, width = data.dims, min(data.dims, wanted + guard)
    q, _ = np.linalg.qr(np.random.default_rng(11).standard_normal((d, width)))
    low, top = _ends(data) if width < d else (0.0, 0.0)
    best = (math.inf, None, None)
    stale = 0
    for _ in range(ROUNDS):
        vq = data.times(q)
        values, turn = np.linalg.eigh((q.T @ vq + vq.T @ q) / 2)
        values, turn = values[::-1], turn[:, ::-1]
        u, vu = q @ turn, vq @ turn
        largest = max(values[0], 0.0)
        # an eigenvalue of zero to working precision has no component
        real = int((values[:wanted] > largest * d * 1e-14).sum()) if largest > 0 else 0
        gaps = np.linalg.norm(vu[:, :real] - u[:, :real] * values[:real], axis=0)
        residual = float(gaps.max() / largest) if real else 0.0
        stale = 0 if residual < best[0] / 2 else stale + 1
        if residual < best[0]:
            best = (residual, values[:real], u[:, :real])
        if residual <= TOLERANCE or width == d or (stale >= 2 and best[0] <= LOOSE):
            break
        if stale >= 2:
            low = 0.0  # the bottom was estimated too high
        high = max(float(values[-1]), low + 1e-9 * largest)
        degree = _degree(float(values[real - 1]), low, high, 10 * residual / TOLERANCE)
        q, _ = np.linalg.qr(_filtered(data, u, degree, low, high, max(top, largest * (1 + 1e-9))))
    residual, values, vectors = best
    if residual > LOOSE:
        raise ArithmeticError(f"eigenpairs are not certified: residual {residual:.1e} after {data.passes} passes")
    return values, vectors, residual


def fit(vectors: DataFrame, vector_col: str = "embedding", components: int = COMPONENTS, guard: int = GUARD) -> Model | None:
    """Components of all usable vectors; None if there are no such vectors."""
    spark = vectors.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/whitening-{uuid.uuid4().hex}"
    vectors.select(F.col(vector_col).alias("v")).mapInArrow(_pack, BLOCK).write.parquet(path)
    blocks = spark.read.schema(BLOCK).parquet(path)
    found = blocks.groupBy("dims").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), F.desc("dims")).first()
    if found is None:
        return None
    dims, n = found.dims, found.n
    own = blocks.where(F.col("dims") == dims).select(F.posexplode("sums").alias("j", "s"))
    sums = {r.j: int(r.s) for r in own.groupBy("j").agg(F.sum("s").alias("s")).collect()}
    data = _Data(blocks, dims, n, [sums[j] for j in range(dims)])
    shifted = [sums[j] + SHIFT * n for j in range(dims)]
    trace = data.trace() if dims else 0.0
    if trace <= 0:
        return Model(n, shifted, np.zeros(0), np.zeros((dims, 0)), trace, 0.0, data.passes)
    values, basis, residual = _subspace(data, min(components, dims), guard)
    model = Model(n, shifted, values, basis, trace, residual, data.passes)
    k = len(values)
    scaled = basis / np.sqrt(values)

    def moments(z: np.ndarray) -> np.ndarray:
        w = z @ scaled
        return np.vstack([w.T @ w, w.sum(axis=0)])

    total = data.added(moments, (k + 1, k)) / n
    model.identity_error = float(np.abs(total[:k] - np.outer(total[k], total[k]) - np.eye(k)).max())
    model.passes = data.passes
    return model


def _deviations(x: np.ndarray, n: int, base: list[int], left: list[int]) -> list[int | None]:
    """Sum of (n*x - S)^2 of each row, exact, S being n*base + left. Rows that could pass a long are summed as Python's
    whole numbers; what does pass one is null."""
    near = x.astype(np.float64) - np.array(base, np.float64)
    reach = np.abs(near).max(axis=1, initial=0.0) * n + n
    small = (reach * reach * max(1, x.shape[1]) < EDGE / 2) & (np.abs(x).max(axis=1, initial=0) < 2**61)
    off = (x[small].astype(np.int64) - np.array(base, np.int64)) * n - np.array(left, np.int64)
    out: list[int | None] = [None] * len(x)
    for i, v in zip(np.flatnonzero(small).tolist(), np.einsum("ij,ij->i", off, off).tolist(), strict=True):
        out[i] = v
    for i in np.flatnonzero(~small).tolist():
        exact = sum(((v - b) * n - r) ** 2 for v, b, r in zip(x[i].tolist(), base, left, strict=True))
        out[i] = exact if exact < 2**63 else None
    return out


def whiten(vectors: DataFrame, model: Model | None, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """One row per usable vector: its id, `deviation` and `whitened`, an array of a number per component."""
    named = vectors.select(F.col(id_col).alias("i"), F.col(vector_col).alias("v"))
    kind = named.schema["i"].dataType.simpleString()
    if model is None:
        empty = named.where(F.lit(False))
        return empty.select(F.col("i").alias(id_col), F.lit(None).cast("long").alias("deviation"), F.lit(None).cast("array<double>").alias("whitened"))
    n, k, dims = model.n, len(model.values), len(model.sums)
    plain = [s - SHIFT * n for s in model.sums]
    whole = [s // n for s in plain]
    base, left = np.array(whole, np.int64), [s - n * b for s, b in zip(plain, whole, strict=True)]
    rest = np.array([r / n for r in left])
    scaled = model.vectors / np.sqrt(model.values)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, x in _matrices(batch.column(1)):
                if x.shape[1] != dims:
                    continue
                w = _centred(x, base, rest) @ scaled
                ends = pa.array(np.arange(len(x) + 1, dtype=np.int32) * k)
                columns = [
                    batch.column(0).take(pa.array(rows)),
                    pa.array(_deviations(x, n, whole, left), pa.int64()),
                    pa.ListArray.from_arrays(ends, pa.array(w.ravel(), pa.float64())),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["i", "deviation", "whitened"])

    made = named.mapInArrow(run, f"i {kind}, deviation long, whitened array<double>")
    return made.withColumnRenamed("i", id_col)


def components_of(whitened: DataFrame, model: Model | None, id_col: str = "vec_id") -> DataFrame:
    """One row per vector and component, with what the model says about each."""
    known = model or Model(0, [], np.zeros(0), np.zeros((0, 0)), 0.0, 0.0, 0)
    shares = F.array(*[F.lit(v) for v in known.explained]).cast("array<double>")
    rows = whitened.select(F.col(f"`{id_col}`").alias("i"), "deviation", F.posexplode("whitened").alias("k", "w"))

    def same(value: float) -> Column:
        return F.lit(float(value))

    return rows.select(
        F.col("i").alias(id_col),
        (F.col("k") + 1).cast("int").alias("component"),
        F.lit(known.n).cast("long").alias("n"),
        "deviation",
        F.col("w").alias("whitened"),
        F.get(shares, F.col("k")).alias("explained"),
        same(known.identity_error).alias("identity_error"),
        same(known.residual).alias("residual"),
    )
