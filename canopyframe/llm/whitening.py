"""Whitening of embeddings by a matrix-free block Jacobi-Davidson method.

Vectors become integers ``floor(64 * c) + 1000000``. The covariance ``V`` of the distinct integer vectors is never formed: one job
applies it to a whole block of vectors, as sums over the fit list of ``(x - mean) * ((x - mean) . y)``. Each task adds up its own
share and sends one row; a position's values are then added up by a shuffle, so the driver reads ``dimensions * block`` numbers
whatever the number of tasks. Sums of ``x`` are exact (long), and vectors are centred with them before anything is multiplied.

Each round does a Rayleigh-Ritz step on the search space. Of the leading Ritz pairs those with a residual of double precision are
locked: they stay in the space but get no further correction. For every other pair the projected correction equation
``(I - U U') (V - theta I) (I - U U') t = -r`` is solved roughly by some steps of MINRES, all pairs sharing one distributed
product a step, and the space grows by the corrections. A space at its largest size restarts from its leading Ritz vectors.
The loop ends when all residuals, taken anew with one more product, are at most ``TOLERANCE * sqrt(d)`` of the largest eigenvalue.

Defined cases: rows whose vector is null, holds null, infinite or NaN entries, or whose scaled entries leave the integers that
doubles hold exactly (2**52) are dropped, as are vectors of another length than the most frequent (of equally frequent ones the
longest); repeated rows and vectors count once in the fit list and each gets its rows; components without variance (eigenvalue
under ``FLAT`` of the trace) can't be whitened and are left out, so equal vectors alone give no rows, nor does an empty table;
of equal eigenvalues any orthonormal axes may be returned. A deviation beyond a long is null. Other columns are not read.
"""
from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from canopyframe.session import cut

COMPONENTS = 16
SCALE, SHIFT = 64, 1_000_000
EXACT = 2.0 ** 52
BLOB_BYTES = 4 << 20
TOLERANCE = 64 * np.finfo(float).eps
FLAT = 1e-12
INNER = 5
ROUNDS = 300


def integer_vectors(rows: DataFrame, vec_id: str, vector: str) -> tuple[DataFrame, int]:
    """``vec_id, x`` (a vector's longs as bytes) of all usable rows, written as a table, and the dimension."""
    values = rows.select(F.col(vec_id).alias("vec_id"), F.col(vector).cast("array<double>").alias("v")).where(F.col("v").isNotNull())
    sizes = values.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    d = sizes["d"] if sizes else 0
    kind = dict(values.dtypes)["vec_id"]

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = batch.column(1)
            flat = v.flatten().to_numpy(zero_copy_only=False).reshape(-1, d)  # nulls become NaN
            with np.errstate(invalid="ignore"):
                x = np.floor(flat * SCALE)
                good = np.isfinite(x).all(1) & (np.abs(x) < EXACT).all(1)
            x = x[good].astype(np.int64) + SHIFT
            ids = batch.column(0).filter(pa.array(good))
            yield pa.RecordBatch.from_arrays([ids, pa.array([r.tobytes() for r in x], pa.binary())], ["vec_id", "x"])

    return cut(values.where(F.lit(d > 0) & (F.size("v") == d)).mapInArrow(pack, f"vec_id {kind}, x binary")), d


def fit_list(vectors: DataFrame, d: int) -> DataFrame:
    """Each distinct vector once, many to a row (``blob``), written as a table."""
    each = max(1, BLOB_BYTES // (8 * max(d, 1)))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            xs = batch.column(0)
            for i in range(0, len(xs), each):
                yield pa.RecordBatch.from_arrays([pa.array([b"".join(xs.slice(i, each).to_pylist())], pa.binary())], ["blob"])

    return cut(vectors.select("x").distinct().mapInArrow(pack, "blob binary"))


def summed(fit: DataFrame, d: int, size: int, part: Callable[[np.ndarray], np.ndarray], exact: bool = False) -> np.ndarray:
    """The sum of ``part(X)`` (``size`` numbers) over blocks ``X`` of the fit list."""
    kind, arrow = ("long", pa.int64()) if exact else ("double", pa.float64())

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, dtype=np.int64 if exact else np.float64)
        for batch in batches:
            for blob in batch.column(0).to_pylist():
                total += part(np.frombuffer(blob, dtype=np.int64).reshape(-1, d)).ravel()
        yield pa.RecordBatch.from_arrays([pa.array([total], pa.list_(arrow))], ["s"])

    rows = fit.mapInArrow(add, f"s array<{kind}>").select(F.posexplode("s").alias("i", "v")).groupBy("i").agg(F.sum("v").alias("v")).collect()
    out = np.zeros(size, dtype=np.int64 if exact else np.float64)
    for r in rows:
        out[r["i"]] = r["v"]
    return out


@dataclass
class Centre:
    """Mean of the fit list as an integer part and a remainder, so that centring loses no digits."""
    n: int
    whole: np.ndarray
    rest: np.ndarray  # exact sum of x - whole

    def of(self, x: np.ndarray) -> np.ndarray:
        return (x - self.whole) - self.rest / self.n

    def deviation(self, x: np.ndarray) -> list[int | None]:
        """Exact sums of ``(n * x - S)**2``."""
        off = x - self.whole
        far = max(int(np.abs(off).max(initial=0)), 1) * self.n + int(np.abs(self.rest).max(initial=0))
        if far * far * x.shape[1] < 2 ** 63:
            return ((self.n * off - self.rest) ** 2).sum(1).tolist()
        rest = [int(r) for r in self.rest]
        full = [sum((self.n * int(a) - r) ** 2 for a, r in zip(row, rest)) for row in off]
        return [v if v < 2 ** 63 else None for v in full]


def centre(fit: DataFrame, d: int) -> Centre | None:
    total = summed(fit, d, d + 1, lambda x: np.append((x - SHIFT).sum(0), len(x)), exact=True)
    n = int(total[d])
    if not n:
        return None
    low = np.array([int(t) // n for t in total[:d]], dtype=np.int64)
    return Centre(n, low + SHIFT, total[:d] - low * n)


def minres(product: Callable[[np.ndarray], np.ndarray], b: np.ndarray, steps: int) -> np.ndarray:
    """Some steps of MINRES for all columns of ``b`` at once, each with its own coefficients."""
    beta = np.linalg.norm(b, axis=0)
    safe = lambda x: np.where(x == 0, 1.0, x)
    v_old, v, x = np.zeros_like(b), b / safe(beta), np.zeros_like(b)
    w_old, w = np.zeros_like(b), np.zeros_like(b)
    eta, left = beta.copy(), np.zeros_like(beta)
    c_old, c, s_old, s = np.ones_like(beta), np.ones_like(beta), np.zeros_like(beta), np.zeros_like(beta)
    for _ in range(steps):
        p = product(v)
        alpha = (v * p).sum(0)
        p = p - alpha * v - left * v_old
        right = np.linalg.norm(p, axis=0)
        delta, second, third = c * alpha - c_old * s * left, s * alpha + c_old * c * left, s_old * left
        first = safe(np.hypot(delta, right))
        c_old, c, s_old, s = c, delta / first, s, right / first
        w_old, w = w, (v - third * w_old - second * w) / first
        x = x + c * eta * w
        eta = -s * eta
        v_old, v, left = v, p / safe(right), right
    return x


def _new_directions(space: np.ndarray, t: np.ndarray) -> np.ndarray:
    """An orthonormal basis of what ``t`` adds to ``space``."""
    for _ in range(2):
        t = t - space @ (space.T @ t)
        size = np.linalg.norm(t, axis=0)
        t = t[:, size > 0] / size[size > 0]
    u, s, _ = np.linalg.svd(t, full_matrices=False)
    u = u[:, s > 1e-8]
    u = u - space @ (space.T @ u)
    return np.linalg.qr(u)[0] if u.shape[1] else u


def jacobi_davidson(product: Callable[[np.ndarray], np.ndarray], d: int, k: int, inner: int = INNER, most: int | None = None, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` largest eigenvalues (falling) and unit eigenvectors of the symmetric map that ``product`` applies to blocks."""
    k = min(k, d)
    most = min(d, most or max(4 * k, 20))
    rng = np.random.default_rng(seed)
    space = np.linalg.qr(rng.standard_normal((d, k)))[0]
    image = product(space)
    limit = TOLERANCE * np.sqrt(d)
    for _ in range(ROUNDS):
        h = space.T @ image
        theta, s = np.linalg.eigh((h + h.T) / 2)
        theta, s = theta[::-1], s[:, ::-1]
        ritz, mapped = space @ s, image @ s
        lead, residual = ritz[:, :k], mapped[:, :k] - ritz[:, :k] * theta[:k]
        size = np.linalg.norm(residual, axis=0)
        if (size <= limit * abs(theta[0])).all():
            lead = np.linalg.qr(lead)[0]
            mapped = product(lead)  # residuals anew, and one more Rayleigh-Ritz step within the leading space
            h = lead.T @ mapped
            theta, s = np.linalg.eigh((h + h.T) / 2)
            theta, lead, mapped = theta[::-1], lead @ s[:, ::-1], mapped @ s[:, ::-1]
            if (np.linalg.norm(mapped - lead * theta, axis=0) <= 2 * limit * abs(theta[0])).all():
                return theta, lead
            space, image = lead, mapped
            continue
        if space.shape[1] == d:  # nothing to add: only rounding of old products is left, so take them anew
            space = np.linalg.qr(ritz)[0]
            image = product(space)
            continue
        open_ = size > limit * abs(theta[0])  # the others are locked
        if space.shape[1] + open_.sum() > most and space.shape[1] > 2 * k:
            space, image = ritz[:, : 2 * k], mapped[:, : 2 * k]
        shift, outside = theta[:k][open_], lambda y: y - lead @ (lead.T @ y)
        t = minres(lambda y: outside(product(y) - y * shift), -outside(residual[:, open_]), inner)
        fresh = _new_directions(space, t)
        if not fresh.shape[1]:
            fresh = _new_directions(space, rng.standard_normal((d, 1)))
        fresh = fresh[:, : d - space.shape[1]]
        space, image = np.hstack([space, fresh]), np.hstack([image, product(fresh)])
    raise ArithmeticError(f"residuals did not reach double precision within {ROUNDS} rounds")


@dataclass
class Whitening:
    centre: Centre
    values: np.ndarray
    axes: np.ndarray
    trace: float
    identity_error: float

    def apply(self, x: np.ndarray) -> np.ndarray:
        return (self.centre.of(x) @ self.axes) / np.sqrt(self.values)


def fit(vectors: DataFrame, d: int, components: int = COMPONENTS, most: int | None = None) -> Whitening | None:
    """The whitening of the distinct vectors; None where nothing varies."""
    rows = fit_list(vectors, d)
    c = centre(rows, d) if d else None
    if c is None:
        return None
    trace = float(summed(rows, d, 1, lambda x: np.array([(c.of(x) ** 2).sum()]))[0]) / c.n
    if not trace:
        return None

    def product(y: np.ndarray) -> np.ndarray:
        def part(x: np.ndarray) -> np.ndarray:
            z = c.of(x)
            return z.T @ (z @ y)
        return summed(rows, d, y.size, part).reshape(y.shape) / c.n

    values, axes = jacobi_davidson(product, d, components, most=most)
    some = values > FLAT * trace
    w = Whitening(c, values[some], axes[:, some], trace, 0.0)
    k = int(some.sum())

    def moments(x: np.ndarray) -> np.ndarray:
        z = w.apply(x)
        return np.append((z.T @ z).ravel(), z.sum(0))

    m = summed(rows, d, k * k + k, moments) / c.n
    w.identity_error = float(np.abs(m[: k * k].reshape(k, k) - np.outer(m[k * k:], m[k * k:]) - np.eye(k)).max())
    return w


def whiten(rows: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """``vec_id, component, n, deviation, whitened, explained, identity_error`` of every usable row and component."""
    vectors, d = integer_vectors(rows, vec_id, vector)
    kind = dict(vectors.dtypes)["vec_id"]
    shape = f"vec_id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    w = fit(vectors, d, components)
    if w is None:
        return rows.sparkSession.createDataFrame([], shape)
    k, explained = len(w.values), w.values / w.trace

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for i in range(0, whole.num_rows, 4096):
                batch = whole.slice(i, 4096)
                m = batch.num_rows
                x = np.frombuffer(b"".join(batch.column(1).to_pylist()), dtype=np.int64).reshape(m, d)
                each = np.repeat(np.arange(m), k)
                deviation = pa.array(w.centre.deviation(x), pa.int64()).take(pa.array(each))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(each)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, w.centre.n, dtype=np.int64)), deviation,
                     pa.array(w.apply(x).ravel()), pa.array(np.tile(explained, m)), pa.array(np.full(m * k, w.identity_error))],
                    ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return vectors.mapInArrow(score, shape)
