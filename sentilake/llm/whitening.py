"""Whitening of embeddings by their leading principal components.

Three passes over the vectors, each adding up fixed-size moments inside the tasks: exact sums of the entries, the products of
the centred entries, and at last the products of the whitened ones, which tell how far their covariance is from the identity.
Between them the driver holds one matrix of dimension by dimension: Householder reflections make it tridiagonal, Sturm counts
bisect its leading eigenvalues, inverse iteration finds their vectors, reorthogonalised inside clusters of close eigenvalues.
Components go to the tasks as a broadcast, whose size is the dimension times the components.

Entries are whole numbers, floor(64 c) + 1000000, so sums and deviations are exact.
"""

from dataclasses import dataclass

import numpy as np
from pyspark.sql import functions as F

COMPONENTS = 32
SCALE, SHIFT = 64, 1_000_000
LARGEST = 2.0**50  # of an entry's size, so that 64 times it is exact and fits
CLOSE = 1e-3  # eigenvalues nearer than this share of the largest are one cluster
SMALLEST = 1e-12  # share of the largest eigenvalue below which a component is rounding only
MATRIX_ENTRIES = 1 << 25  # of all moments that come to the driver
ROWS = 4096  # vectors a step inside a task


@dataclass(frozen=True)
class Whitening:
    """Fit of all vectors of one dimension."""

    n: int
    sums: list  # of the whole-number entries, exact
    eigenvalues: np.ndarray  # the leading ones, falling
    components: np.ndarray  # [dimension, component]
    trace: float
    identity_error: float = 0.0

    @property
    def sound(self):
        """Which components carry variance."""
        return self.eigenvalues > SMALLEST * max(self.eigenvalues[0], 0.0) if len(self.eigenvalues) else np.zeros(0, bool)

    def deviations(self, x):
        """n * x - sums, exact, in 64 bits where these hold it."""
        largest = int(np.abs(x).max(initial=0)) * self.n + max((abs(s) for s in self.sums), default=0)
        if largest < 2**62:
            return self.n * x - np.array(self.sums, dtype=np.int64)
        return self.n * x.astype(object) - np.array(self.sums, dtype=object)

    def whiten(self, x):
        """Deviations, and projections over the square roots of the eigenvalues; NaN for components without variance."""
        off = self.deviations(x)
        scale = np.where(self.sound, np.sqrt(np.maximum(self.eigenvalues, 0)), np.nan)
        return off, (off.astype(np.float64) / self.n) @ self.components / scale


def tridiagonal(matrix):
    """Diagonal, off-diagonal and reflectors of a symmetric matrix brought to tridiagonal form by Householder reflections."""
    m = np.array(matrix, dtype=np.float64)
    d = len(m)
    off, reflectors = np.zeros(max(0, d - 1)), []
    for k in range(d - 2):
        x = m[k + 1 :, k].copy()
        if not np.any(x[1:]):
            off[k] = x[0]
            reflectors.append(None)
            continue
        off[k] = -np.copysign(np.linalg.norm(x), x[0])
        x[0] -= off[k]
        x /= np.linalg.norm(x)
        rest = m[k + 1 :, k + 1 :]
        p = rest @ x
        p -= (x @ p) * x
        rest -= 2 * (np.outer(x, p) + np.outer(p, x))
        reflectors.append(x)
    if d > 1:
        off[d - 2] = m[d - 1, d - 2]
    return np.diag(m).copy(), off, reflectors


def sturm_counts(diagonal, off, shifts):
    """How many eigenvalues lie below each shift: the negative pivots of the shifted matrix."""
    least = np.finfo(float).tiny
    q = diagonal[0] - shifts
    count = (q < 0).astype(int)
    for a, b in zip(diagonal[1:], off * off, strict=True):
        q = np.where(np.abs(q) < least, -least, q)
        q = a - shifts - b / q
        count += q < 0
    return count


def leading_eigenvalues(diagonal, off, k):
    """The k largest, falling, by bisection."""
    d = len(diagonal)
    reach = np.append(np.abs(off), 0) + np.append(0, np.abs(off))
    low = np.full(k, (diagonal - reach).min())
    high = np.full(k, (diagonal + reach).max())
    margin = np.finfo(float).eps * max(np.abs(low[0]), np.abs(high[0])) * d if k else 0.0
    low, high = low - margin, high + margin
    rank = d - 1 - np.arange(k)
    for _ in range(200):
        middle = 0.5 * (low + high)
        if not ((middle > low) & (middle < high)).any():
            break
        above = sturm_counts(diagonal, off, middle) <= rank
        low, high = np.where(above, middle, low), np.where(above, high, middle)
    return np.sort(0.5 * (low + high))[::-1]


def _solver(diagonal, off, shift, least):
    """Solves (T - shift) y = x by elimination with row exchanges; pivots near zero are held off it."""
    n = len(diagonal)
    main, upper, second = [float(a) - shift for a in diagonal], [*map(float, off), 0.0], [0.0] * n
    steps = []
    for i in range(n - 1):
        below = float(off[i])
        swap = abs(below) > abs(main[i])
        if swap:
            main[i], below, upper[i], main[i + 1] = below, main[i], main[i + 1], upper[i]
            second[i], upper[i + 1] = upper[i + 1], 0.0
        if abs(main[i]) < least:
            main[i] = least
        factor = below / main[i]
        main[i + 1] -= factor * upper[i]
        upper[i + 1] -= factor * second[i]
        steps.append((swap, factor))
    if abs(main[-1]) < least:
        main[-1] = least

    def solve(x):
        y = x.tolist()
        for i, (swap, factor) in enumerate(steps):
            if swap:
                y[i], y[i + 1] = y[i + 1], y[i]
            y[i + 1] -= factor * y[i]
        for i in range(n - 1, -1, -1):
            rest = upper[i] * y[i + 1] if i + 1 < n else 0.0
            rest += second[i] * y[i + 2] if i + 2 < n else 0.0
            y[i] = (y[i] - rest) / main[i]
        return np.array(y)

    return solve


def inverse_iteration(diagonal, off, eigenvalues):
    """Unit eigenvectors of a tridiagonal matrix, one a column, for falling eigenvalues."""
    d = len(diagonal)
    norm = max(np.abs(diagonal).max(initial=0), np.abs(off).max(initial=0)) or 1.0
    eps = np.finfo(float).eps
    out = np.zeros((d, len(eigenvalues)))
    rng = np.random.Generator(np.random.PCG64(d))
    cluster, shift = 0, None
    for j, value in enumerate(eigenvalues):
        if j and eigenvalues[j - 1] - value > CLOSE * norm:
            cluster = j
        shift = value if shift is None else min(value, shift - 10 * eps * norm)  # equal shifts would find one vector
        solve = _solver(diagonal, off, shift, eps * norm)
        x = rng.standard_normal(d)
        for _ in range(5):
            x /= np.abs(x).max() or 1.0
            x = solve(x)
            x /= np.abs(x).max() or 1.0
            for _ in range(2):
                x -= out[:, cluster:j] @ (out[:, cluster:j].T @ x)
            x /= np.linalg.norm(x)
        out[:, j] = x
    return out


def leading_components(matrix, k):
    """(eigenvalues, components) of a symmetric matrix: the k largest, falling; a component's largest entry is positive."""
    k = min(k, len(matrix))
    size = np.abs(matrix).max(initial=0.0)
    if not k or not size:
        return np.zeros(k), np.eye(len(matrix))[:, :k]
    diagonal, off, reflectors = tridiagonal(matrix / size)
    values = leading_eigenvalues(diagonal, off, k)
    vectors = inverse_iteration(diagonal, off, values)
    for i in range(len(reflectors) - 1, -1, -1):
        if reflectors[i] is not None:
            vectors[i + 1 :] -= 2 * np.outer(reflectors[i], reflectors[i] @ vectors[i + 1 :])
    sign = np.sign(vectors[np.abs(vectors).argmax(axis=0), np.arange(k)])
    return values * size, vectors * sign


def _blocks(batch):
    """(rows, whole-number entries) of a batch's vectors, those of one dimension at a time; vectors hold no nulls."""
    column = batch.column(1)
    offsets = column.offsets.to_numpy()
    values = column.values.to_numpy(zero_copy_only=False)
    size = np.diff(offsets)
    for d in np.unique(size).tolist():
        rows = np.flatnonzero(size == d)
        for s in range(0, len(rows), ROWS):
            take = rows[s : s + ROWS]
            entries = values[offsets[take][:, None] + np.arange(d)]
            yield take, np.floor(SCALE * entries).astype(np.int64) + SHIFT


def _record(names, columns):
    import pyarrow as pa

    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=names)


def _sum_rows(batches):
    """Dimension, entry and its exact sum in two parts, with the vectors in entry -1."""
    high, low = {}, {}
    for batch in batches:
        for take, x in _blocks(batch):
            d = x.shape[1]
            if d not in high:
                high[d], low[d] = np.zeros(d + 1, np.int64), np.zeros(d + 1, np.int64)
            high[d][:d] += (x >> 31).sum(axis=0)
            low[d][:d] += (x & (2**31 - 1)).sum(axis=0)
            low[d][d] += len(take)
    for d in high:
        at = np.append(np.arange(d), -1).astype(np.int32)
        yield _record(["d", "i", "high", "low"], [np.full(d + 1, d, np.int32), at, high[d], low[d]])


def _product_rows(fits, values):
    """Dimension, two entries and the sum of their products, for the values that a fit gives of whole-number entries."""

    def rows(batches):
        total = {}
        for batch in batches:
            for _, x in _blocks(batch):
                y = values(fits[x.shape[1]], x)
                total[x.shape[1]] = total.get(x.shape[1], 0) + y.T @ y
        for d, m in total.items():
            i, j = np.triu_indices(len(m))
            yield _record(["d", "i", "j", "v"], [np.full(len(i), d, np.int32), i.astype(np.int32), j.astype(np.int32), m[i, j]])

    return rows


def _centred(fit, x):
    return fit.deviations(x).astype(np.float64) / fit.n


def _sound_and_one(fit, x):
    white = fit.whiten(x)[1][:, fit.sound]
    return np.column_stack([white, np.ones(len(x))])


def _products(usable, fits, values):
    """Matrices of summed products by dimension; the partial ones of the tasks are added up before they come to the driver."""
    schema = "d int, i int, j int, v double"
    got = usable.mapInArrow(_product_rows(fits, values), schema).groupBy("d", "i", "j").agg(F.sum("v").alias("v")).toArrow()
    d, i, j, v = (got.column(c).to_numpy() for c in ("d", "i", "j", "v"))
    out = {}
    for size in fits:
        at = d == size
        m = np.zeros((int(j[at].max(initial=-1)) + 1,) * 2)
        m[i[at], j[at]] = v[at]
        m[j[at], i[at]] = v[at]
        out[size] = m
    return out


def usable_vectors(vectors, id_col="vec_id", vector_col="embedding"):
    """(id, v) of the vectors that can be fitted: not null, all entries there, finite and below 2**50 in size."""
    v = F.col(vector_col).cast("array<double>")
    fits = F.coalesce(F.forall(v, lambda x: F.coalesce(F.abs(x) < LARGEST, F.lit(False))), F.lit(False))
    return vectors.filter(fits).select(F.col(id_col).alias("id"), v.alias("v"))


def fit(usable, components=COMPONENTS):
    """Whitening by dimension, of all rows that usable_vectors gives."""
    sums = usable.mapInArrow(_sum_rows, "d int, i int, high long, low long").groupBy("d", "i")
    totals = sums.agg(*(F.sum(F.col(c).cast("decimal(20,0)")).alias(c) for c in ("high", "low")))
    sizes = [r.d for r in totals.select("d").distinct().collect()]
    if sum(d * (d + 1) // 2 for d in sizes) > MATRIX_ENTRIES:
        raise ValueError(f"vectors of {len(sizes)} dimensions, {max(sizes)} at most, have more than {MATRIX_ENTRIES} moments")
    exact = {(r.d, r.i): int(r.high) * 2**31 + int(r.low) for r in totals.collect()}
    fits = {d: Whitening(exact[d, -1], [exact[d, i] for i in range(d)], np.zeros(0), np.zeros((d, 0)), 0.0) for d in sizes}
    for d, m in _products(usable, fits, _centred).items():
        covariance = m / fits[d].n
        values, vectors = leading_components(covariance, components)
        fits[d] = Whitening(fits[d].n, fits[d].sums, values, vectors, float(np.trace(covariance)))
    for d, m in _products(usable, fits, _sound_and_one).items():
        w = fits[d]
        k = int(w.sound.sum())
        mean = m[:k, k] / w.n
        error = np.abs(m[:k, :k] / w.n - np.outer(mean, mean) - np.eye(k)).max(initial=0.0)
        fits[d] = Whitening(w.n, w.sums, w.eigenvalues, w.components, w.trace, float(error))
    return fits


def _square_sums(off):
    """Exact sum of squares of each row as text, in 64 bits where these hold it."""
    if off.dtype != object and (not off.size or int(np.abs(off).max()) ** 2 * off.shape[1] < 2**62):
        return (off * off).sum(axis=1).astype(str).tolist()
    return [str(sum(int(x) ** 2 for x in row)) for row in off]


def _white_rows(fits):
    def rows(batches):
        import pyarrow as pa

        for batch in batches:
            for take, x in _blocks(batch):
                w = fits[x.shape[1]]
                off, white = w.whiten(x)
                k = white.shape[1]
                each = np.repeat(take, k)
                squares = np.array(_square_sums(off), dtype=object)
                share = w.eigenvalues / w.trace if w.trace else np.full(k, np.nan)
                white = white.ravel()
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(pa.array(each)),
                        pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(take))),
                        pa.array(np.full(len(each), w.n, dtype=np.int64)),
                        pa.array(np.repeat(squares, k), pa.string()),
                        pa.array(white, mask=np.isnan(white)),
                        pa.array(np.tile(share, len(take)), mask=np.isnan(np.tile(share, len(take)))),
                        pa.array(np.full(len(each), w.identity_error)),
                    ],
                    names=["id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
                )

    return rows


def project(usable, fits):
    """(id, component, n, deviation decimal, whitened, explained, identity_error) of every vector and component."""
    kind = usable.schema["id"].dataType.simpleString()
    schema = f"id {kind}, component int, n long, deviation string, whitened double, explained double, identity_error double"
    out = usable.mapInArrow(_white_rows(fits), schema)
    return out.withColumn("deviation", F.col("deviation").cast("decimal(38,0)"))


def whiten(vectors, id_col="vec_id", vector_col="embedding", components=COMPONENTS):
    """(id_col, component, n, deviation, whitened, explained, identity_error) of every usable vector and component.

    Vectors that are null or hold null, NaN, an infinity or an entry of 2**50 and more in size are left out. Vectors of
    another length are a fit of their own, empty ones have no component. Repeated rows count each; ids, null or repeated,
    are carried. A component without variance (all vectors equal, fewer vectors than components, dependent entries) has no
    scale: its rows are there with whitened null, and explained is null where no component has variance. Other columns are
    not read. An empty table gives none.
    """
    usable = usable_vectors(vectors, id_col, vector_col)
    return project(usable, fit(usable, components)).withColumnRenamed("id", id_col)
