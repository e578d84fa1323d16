"""Embedding whitening with components from Chebyshev-filtered subspace iteration.

Vectors become whole numbers, so counts, sums and deviations are exact.  The covariance is never formed: a pass over the
distinct vectors, packed into blocks, gives V Q for a few columns Q by centring each block, multiplying it by Q and by its own
transpose, and adding up the blocks by row of the result (before and after the shuffle).  A short Lanczos run bounds the spectrum
from below.  Each round then runs the three-term recurrence of the Chebyshev polynomial whose interval is the unwanted
spectrum, which damps it and lets the wanted end grow, orthonormalises by QR, and takes Ritz pairs of the subspace
(Rayleigh-Ritz).  Rounds go on until the residuals |V q - e q| of all wanted pairs certify them to double precision.

The driver holds matrices of dimensions x ``BLOCK`` columns only.
"""

from __future__ import annotations

import decimal
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from tremorlake.llm.text import table, written

COMPONENTS = 16
BLOCK = 48  # columns of the subspace: the wanted ones and a guard
SCALE, SHIFT = 64.0, 1_000_000
LIMIT = float(1 << 62)  # entries beyond are not whole numbers of 64 bits
PACK_BYTES = 4 << 20
LANCZOS = 10
DEGREE = 10
ROUNDS = 60
CERTIFIED = 2e-14  # residual over the largest eigenvalue
ACCEPTED = 1e-11  # at the floor of rounding, where residuals stop falling
FLAT = 1e-12  # a direction with less than this share of the trace has no variance
SEED = 17


def _whole(column: pa.Array) -> np.ndarray:
    """The entries of a column of vectors as whole numbers."""
    x = np.floor(column.flatten().to_numpy(zero_copy_only=False).astype(np.float64) * SCALE)
    return x.astype(np.int64) + SHIFT


def usable(vectors: DataFrame) -> DataFrame:
    """Rows whose vector has only finite numbers (within 64 bits after scaling) and the most common length."""
    fine = F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) * SCALE < LIMIT))
    rows = vectors.withColumn("v", F.col("embedding").cast("array<double>")).where(F.col("v").isNotNull() & fine & (F.size("v") > 0))
    lengths = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    return rows.where(F.size("v") == (lengths["d"] if lengths else 0))


def packed(vectors: DataFrame, dims: int) -> DataFrame:
    """The distinct whole vectors as blocks of 64-bit numbers."""
    most = max(1, PACK_BYTES // (8 * dims))

    def pack(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, most):
                part = batch.slice(at, most)
                x = part.column(0).flatten().to_numpy(zero_copy_only=False).astype("<i8")
                yield pa.RecordBatch.from_pydict({"block": pa.array([x.tobytes()], pa.binary())})

    whole = F.transform("v", lambda c: F.floor(c * SCALE).cast("long") + SHIFT)
    return vectors.select(whole.alias("x")).distinct().mapInArrow(pack, "block binary")


def _sum_rows(blocks: DataFrame, partial, width: int) -> np.ndarray:
    """Sum ``partial(rows)`` (a matrix per block) over all blocks, added up by row of the matrix."""

    def part(batches):
        total = None
        for batch in batches:
            for raw in batch.column("block"):
                m = partial(np.frombuffer(raw.as_buffer(), "<i8"))
                total = m if total is None else total + m
        if total is not None:
            yield pa.RecordBatch.from_pydict({"row": np.arange(len(total), dtype=np.int32), **{f"c{j}": total[:, j] for j in range(width)}})

    schema = "row int, " + ", ".join(f"c{j} double" for j in range(width))
    sums = blocks.mapInArrow(part, schema).groupBy("row").agg(*[F.sum(f"c{j}").alias(f"c{j}") for j in range(width)])
    return sums.orderBy("row").toPandas().drop(columns="row").to_numpy(np.float64)


def _exact_sums(blocks: DataFrame, dims: int) -> tuple[int, list[int]]:
    """Number of vectors and their exact sums per dimension."""

    def part(batches):
        rows, low, high = 0, np.zeros(dims, object), np.zeros(dims, object)
        for batch in batches:
            for raw in batch.column("block"):
                x = np.frombuffer(raw.as_buffer(), "<i8").reshape(-1, dims)
                rows += len(x)  # halves of 32 bits cannot overflow in a block
                low += (x & 0xFFFFFFFF).sum(0).astype(object)
                high += (x >> 32).sum(0).astype(object)
        total = [decimal.Decimal(int(h) * (1 << 32) + int(lo)) for h, lo in zip(high, low)]
        yield pa.RecordBatch.from_pydict({
            "n": pa.array([rows] * dims, pa.int64()), "dim": pa.array(range(dims), pa.int32()), "s": pa.array(total, pa.decimal128(38, 0)),
        })

    sums = blocks.mapInArrow(part, "n long, dim int, s decimal(38,0)").groupBy("dim").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
    got = sums.orderBy("dim").collect()
    return (int(got[0]["n"]), [int(r["s"]) for r in got]) if got else (0, [0] * dims)


@dataclass
class Whitening:
    """n and exact sums of the fit list; eigenvectors as columns, eigenvalues, trace; how it was certified."""

    n: int
    sums: list[int]
    vectors: np.ndarray
    values: np.ndarray
    trace: float
    residual: float = 0.0
    passes: int = 0
    identity_error: float = 0.0

    @property
    def dims(self) -> int:
        return len(self.sums)


def _centre(n: int, sums: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Mean as a whole number and a rest below one, so that centring loses nothing."""
    return np.array([s // n for s in sums], np.int64), np.array([(s % n) / n for s in sums])


class Covariance:
    """V Q and its relatives by passes over the packed vectors."""

    def __init__(self, blocks: DataFrame, n: int, sums: list[int]):
        self.blocks, self.n, self.passes = blocks, n, 0
        self.whole, self.rest = _centre(n, sums)

    def _pass(self, matrix, width: int) -> np.ndarray:
        whole, rest = self.whole, self.rest

        def partial(flat):
            return matrix((flat.reshape(-1, len(whole)) - whole) - rest)

        self.passes += 1
        return _sum_rows(self.blocks, partial, width) / self.n

    def times(self, q: np.ndarray) -> np.ndarray:
        return self._pass(lambda c: c.T @ (c @ q), q.shape[1])

    def trace(self) -> float:
        return float(self._pass(lambda c: (c * c).sum(0)[:, None], 1).sum())

    def of_projection(self, p: np.ndarray) -> np.ndarray:
        """Covariance of the projected vectors themselves."""

        def squared(c):
            z = c @ p
            return z.T @ z

        return self._pass(squared, p.shape[1])


def lower_bound(v: Covariance, dims: int, rng: np.random.Generator) -> float:
    """A bound of the smallest eigenvalue from a short Lanczos run: least Ritz value less its residual."""
    q, before, beta = rng.standard_normal(dims), np.zeros(dims), 0.0
    q /= np.linalg.norm(q)
    basis, alphas, betas = [], [], []
    for _ in range(min(LANCZOS, dims)):
        basis.append(q)
        w = v.times(q[:, None])[:, 0] - beta * before
        alphas.append(float(w @ q))
        for b in basis:  # full reorthogonalisation
            w -= (w @ b) * b
        beta, before = float(np.linalg.norm(w)), q
        if beta <= 1e-10 * max(map(abs, alphas)):
            beta = 0.0
            break
        betas.append(beta)
        q = w / beta
    steps = len(alphas)
    off = betas[: steps - 1]
    ritz = np.linalg.eigvalsh(np.diag(alphas) + np.diag(off, 1) + np.diag(off, -1))
    # a run that closes early has met an invariant subspace and says nothing of the rest
    return max(0.0, float(ritz[0] - beta)) if beta else 0.0


def filtered(v: Covariance, q: np.ndarray, low: float, cut: float, top: float, degree: int) -> np.ndarray:
    """The Chebyshev polynomial of V on [low, cut] times ``q``, scaled so that it is about 1 at ``top``."""
    half, middle = (cut - low) / 2, (cut + low) / 2
    sigma = half / (top - middle)
    tau = 2 / sigma
    y = (v.times(q) - middle * q) * (sigma / half)
    for _ in range(degree - 1):
        after = 1 / (tau - sigma)
        z = (v.times(y) - middle * y) * (2 * after / half) - (sigma * after) * q
        q, y, sigma = y, z, after
    return y


def subspace(v: Covariance, dims: int, wanted: int, width: int = BLOCK, seed: int = SEED) -> tuple[np.ndarray, np.ndarray, float]:
    """(eigenvectors, eigenvalues, residual over the largest eigenvalue) of the ``wanted`` largest."""
    rng = np.random.default_rng(seed)
    width = min(dims, width)
    q, _ = np.linalg.qr(rng.standard_normal((dims, width)))
    low = lower_bound(v, dims, rng) if width < dims else 0.0
    best = None
    for _ in range(ROUNDS):
        vq = v.times(q)
        h = q.T @ vq
        values, turn = np.linalg.eigh((h + h.T) / 2)
        values, turn = values[::-1], turn[:, ::-1]
        q, vq = q @ turn, vq @ turn
        top = max(float(values[0]), 0.0)
        if top == 0.0:
            return q[:, :wanted], np.maximum(values[:wanted], 0), 0.0
        residual = float(np.linalg.norm(vq - q * values, axis=0)[:wanted].max()) / top
        if best is None or residual < best[2] / 2:
            best, stalled = (q[:, :wanted], values[:wanted], residual), 0
        else:
            stalled += 1
        if best[2] <= CERTIFIED or (stalled >= 2 and best[2] <= ACCEPTED):
            return best
        cut = float(values[-1])
        low = min(low, max(0.0, cut * (1 - 1e-3)))
        if cut <= low or width == dims:  # no unwanted spectrum: refine the subspace by V itself
            y = vq
        else:
            y = filtered(v, q, low, cut, top, DEGREE)
        q, _ = np.linalg.qr(y)
    raise RuntimeError(f"{wanted} components are not certified after {ROUNDS} rounds (residual {best[2]:.1e})")


def fit_whitening(vectors: DataFrame, components: int = COMPONENTS, width: int = BLOCK) -> Whitening | None:
    """Fit on the distinct whole vectors of ``usable`` rows; None where there is no row."""
    one = vectors.select(F.size("v").alias("d")).first()
    if one is None:
        return None
    dims = one["d"]
    blocks = written(packed(vectors, dims), "whitening-fit")
    n, sums = _exact_sums(blocks, dims)
    v = Covariance(blocks, n, sums)
    trace = v.trace()
    model = Whitening(n, sums, np.zeros((dims, 0)), np.zeros(0), trace)
    if trace <= 0:
        return model
    q, e, model.residual = subspace(v, dims, min(components, dims), width)
    keep = e > FLAT * trace
    model.vectors, model.values = q[:, keep], e[keep]
    white = v.of_projection(model.vectors / np.sqrt(model.values))
    model.identity_error = float(np.abs(white - np.eye(len(model.values))).max())
    model.passes = v.passes
    return model


def deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int | None]:
    """Sum over dimensions of (n x - S) squared, exactly; null beyond 64 bits."""
    whole, _ = _centre(n, sums)
    left = np.array([s - int(w) * n for s, w in zip(sums, whole)], np.int64)  # n x - S = n (x - whole) - left
    y = x - whole
    if len(sums) * (float(np.abs(y).max(initial=0)) * n + n) ** 2 < LIMIT:
        return (((y * n) - left) ** 2).sum(1).tolist()
    exact = ((y.astype(object) * n - left.astype(object)) ** 2).sum(1)
    return [int(t) if t < 1 << 63 else None for t in exact]


def whitened(vectors: DataFrame, model: Whitening) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error): a row per vector and component."""
    project, explained = model.vectors / np.sqrt(model.values), model.values / (model.trace or 1.0)
    k, n, sums, error = len(model.values), model.n, model.sums, model.identity_error
    whole, rest = _centre(n, sums)

    def apply(batches):
        for batch in batches:
            x = _whole(batch.column("v")).reshape(batch.num_rows, len(sums))
            z = ((x - whole) - rest) @ project
            dev = deviations(x, n, sums)
            at = pa.array(np.repeat(np.arange(batch.num_rows), k))
            rows = batch.num_rows * k
            yield pa.RecordBatch.from_pydict({
                "vec_id": batch.column("vec_id").take(at),
                "component": pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), batch.num_rows)),
                "n": pa.array(np.full(rows, n, np.int64)),
                "deviation": pa.array(dev, pa.int64()).take(at),
                "whitened": pa.array(z.reshape(-1)),
                "explained": pa.array(np.tile(explained, batch.num_rows)),
                "identity_error": pa.array(np.full(rows, error)),
            })

    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    return vectors.select(F.col("vec_id").cast("long"), "v").mapInArrow(apply, schema)


def whiten(embeddings: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """Whiten ``embeddings`` (vec_id, embedding): a row for each usable row and component.

    A vector takes no part if it is null or empty, holds null, NaN or infinite entries (or such that 64 times them needs more than
    62 bits), or has another length than most (ties: the shorter length).  Repeated rows and equal vectors count once in the fit and
    each give their rows.  There are at most as many components as dimensions; directions without variance (below 1e-12 of
    the trace) are none, so a table with one distinct vector, like an empty table, gives no rows.  A null vec_id stays null.
    Other columns are not read.
    """
    rows = usable(embeddings.select("vec_id", "embedding"))
    model = fit_whitening(rows, components)
    if model is None:
        model = Whitening(1, [0], np.zeros((1, 0)), np.zeros(0), 0.0)
        rows = rows.where(F.lit(False))
    return whitened(rows, model)


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings"))


QUERIES = {"op13_whitening": op13_whitening}
ORACLE: dict[str, str] = {}
