"""Whitening of embeddings by their leading principal components.

Method: spectrum slicing. The covariance of the fit list is summed exactly on the
executors (integer sums per task, added up by a grouped sum over d(d+1)/2 + d + 1
keys), so only a d x d matrix reaches the driver. There the number of
eigenvalues below a shift s is read from the signs of the pivots of an LDL^T
factorisation of V - sI (Sylvester's law of inertia). Bisection on these counts
isolates each leading eigenvalue in an interval that holds it alone, Rayleigh
quotient iteration from that interval converges cubically to the eigenpair, and
the counts at the interval's ends certify that the pair found is the k-th and
not a neighbour. Rows are then projected and whitened by Spark expressions.

Definitions:

* A row is dropped if its vector is null, holds a null, NaN or infinite entry,
  an entry whose ``floor(256 * c)`` does not fit in a long, or if its length is
  not the table's dimension D: the most frequent length among the other rows
  (ties: the larger length).
* Entries become ``x = floor(256 * c)`` as longs. The fit list is every distinct
  x vector once; n is its size, S its per-dimension sums, V its covariance with
  divisor n, centred before multiplying, computed exactly as
  ``(n * sum(x x^T) - S S^T) / n^2``.
* Components are unit eigenvectors of V by falling eigenvalue, at most
  ``components`` of them and only those whose eigenvalue is above
  ``1e-12 * trace(V)``: a constant table (n = 1, or all copies) has none and
  gives no rows. Each is signed so that its entry of largest magnitude (the
  first of equal ones) is positive. A repeated eigenvalue gives an orthonormal
  basis of its space, the same for every row.
* Repeated rows and rows with equal vectors each get their own output rows;
  equal vectors count once in the fit list. Other columns are not carried, so
  names of other columns never clash. An empty table gives no rows.
* ``deviation`` is exact; it raises (ANSI overflow) where it would not fit in a
  long, which needs n * |x| near 2^31.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from topicloom.llm.common import ddl
from topicloom.session import materialize

SCALE = 256
COMPONENTS = 4
# Largest |x| for which a batch's products are summed exactly in doubles.
EXACT_FLOAT = 2**20


def _finite(vector: str) -> Column:
    return F.forall(
        F.col(vector),
        lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) < F.lit(2.0**55)),
    )


def integer_vectors(emb: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``key, x``: the rows kept, with x = floor(256 c) as longs."""
    kept = emb.select(F.col(f"`{key}`").alias("key"), F.col(f"`{vector}`").alias("v")).where(
        F.col("v").isNotNull() & _finite("v")
    )
    x = F.transform("v", lambda c: F.floor(c.cast("double") * SCALE).cast("long") + F.lit(0))
    return kept.select("key", x.alias("x"))


def dimension(rows: DataFrame) -> int | None:
    """The most frequent vector length (ties: the larger), or None without rows."""
    top = (
        rows.groupBy(F.size("x").alias("d"))
        .count()
        .orderBy(F.desc("count"), F.desc("d"))
        .limit(1)
        .collect()
    )
    return top[0]["d"] if top else None


def _moments(d: int):
    """Per task: n, the sums S and the upper triangle of sum(x x^T), exactly,
    as rows (k, value)."""
    upper = np.triu_indices(d)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = 0
        sums = np.zeros(d, dtype=object)
        gram = np.zeros(len(upper[0]), dtype=object)
        for batch in batches:
            if not batch.num_rows:
                continue
            flat = batch.column(0).flatten().to_numpy(zero_copy_only=False)
            x = flat.reshape(batch.num_rows, d)
            n += batch.num_rows
            top = int(np.abs(x).max()) if x.size else 0
            if top < EXACT_FLOAT and top * top * batch.num_rows < 2**53:
                xf = x.astype(np.float64)
                sums += xf.sum(axis=0).astype(np.int64).astype(object)
                gram += (xf.T @ xf)[upper].astype(np.int64).astype(object)
            else:  # exact with Python integers
                xo = x.astype(object)
                sums += xo.sum(axis=0)
                gram += (xo.T @ xo)[upper]
        values = [n, *sums.tolist(), *gram.tolist()]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(range(len(values)), pa.int32()),
                pa.array([str(v) for v in values], pa.string()),
            ],
            names=["k", "v"],
        )

    return run


@dataclass
class Fit:
    n: int
    sums: list[int]
    eigenvalues: list[float]
    vectors: list[list[float]]  # unit eigenvectors, by falling eigenvalue
    trace: float
    certified: list[bool]  # the counts proved each one is the k-th eigenvalue


def covariance(n: int, sums: list[int], gram: list[list[int]]) -> np.ndarray:
    d = len(sums)
    out = np.empty((d, d))
    for i in range(d):
        for j in range(i, d):
            out[i, j] = out[j, i] = (n * gram[i][j] - sums[i] * sums[j]) / (n * n)
    return out


def below(v: np.ndarray, shift: float) -> int:
    """Eigenvalues of the symmetric ``v`` below ``shift``: the negative pivots of
    the LDL^T factorisation of v - shift I (Sylvester). A zero pivot is taken as
    a tiny negative one, which counts an eigenvalue equal to the shift as below
    it."""
    a = v - shift * np.eye(len(v))
    tiny = np.finfo(float).eps * max(1.0, float(np.abs(v).max(initial=0.0)))
    count = 0
    for k in range(len(a)):
        pivot = a[k, k]
        if abs(pivot) < tiny:
            pivot = -tiny
        if pivot < 0:
            count += 1
        if k + 1 < len(a):
            column = a[k + 1 :, k] / pivot
            a[k + 1 :, k + 1 :] -= np.outer(column, a[k, k + 1 :])
    return count


def leading_pair(
    v: np.ndarray, k: int, earlier: list[np.ndarray]
) -> tuple[float, np.ndarray, bool]:
    """The k-th largest eigenvalue of ``v`` (k from 1) and a unit eigenvector
    orthogonal to ``earlier``, and whether the counts certify its number."""
    d = len(v)
    norm = float(np.abs(v).sum(axis=1).max(initial=0.0))
    eps = np.finfo(float).eps
    radius = np.abs(v).sum(axis=1) - np.abs(np.diag(v))
    lo = float((np.diag(v) - radius).min()) - 1.0
    hi = float((np.diag(v) + radius).max()) + 1.0
    # Invariant: at least k eigenvalues are >= lo, fewer than k are >= hi.
    above_lo, above_hi = d, 0
    tol = 4 * eps * max(norm, 1e-300)

    def bisect(enough) -> None:
        nonlocal lo, hi, above_lo, above_hi
        while hi - lo > tol and not enough():
            mid = 0.5 * (lo + hi)
            if mid in (lo, hi):
                break
            above = d - below(v, mid)
            if above >= k:
                lo, above_lo = mid, above
            else:
                hi, above_hi = mid, above

    def isolated() -> bool:
        return above_lo == k and above_hi == k - 1

    # Until the eigenvalue is alone in [lo, hi) and the interval is narrow
    # against its place, so that Rayleigh quotients started there stay in it.
    bisect(lambda: isolated() and hi - lo < 1e-3 * max(abs(lo), abs(hi), tol))

    def residual(y: np.ndarray) -> float:
        return float(np.linalg.norm(v @ y - (y @ v @ y) * y))

    def step(y: np.ndarray, shift: float) -> np.ndarray | None:
        """One solve, kept only if it lowers the residual: a solve of a matrix
        that is singular in double precision gives noise."""
        z = _solve(v, shift, y)
        if z is None:
            return None
        z = _orthogonal(z, earlier)
        return z if residual(z) < residual(y) else None

    x = _orthogonal(np.ones(d) + np.arange(d) / max(d, 1), earlier)
    for _ in range(3):  # inverse iteration at the interval's centre
        y = step(x, 0.5 * (lo + hi))
        if y is None:
            break
        x = y
    converged = False
    for _ in range(30):  # Rayleigh quotient iteration
        sigma = float(x @ v @ x)
        if not lo <= sigma <= hi:
            break
        if residual(x) <= 64 * eps * max(norm, 1e-300):
            converged = True
            break
        y = step(x, sigma)
        if y is None:  # no further progress in double precision
            converged = True
            break
        x = y
    if not converged:  # bisection to full precision, then inverse iteration
        bisect(lambda: False)
        for _ in range(6):
            y = step(x, 0.5 * (lo + hi))
            if y is None:
                break
            x = y
    sigma = float(x @ v @ x)
    return sigma, _signed(x), isolated() and lo - tol <= sigma <= hi + tol


def _solve(v: np.ndarray, sigma: float, x: np.ndarray) -> np.ndarray | None:
    """(v - sigma I)^-1 x, or None where v - sigma I is singular."""
    try:
        y = np.linalg.solve(v - sigma * np.eye(len(v)), x)
    except np.linalg.LinAlgError:
        return None
    return y if np.all(np.isfinite(y)) and np.any(y) else None


def _orthogonal(x: np.ndarray, earlier: list[np.ndarray]) -> np.ndarray:
    for _ in range(2):
        for u in earlier:
            x = x - (u @ x) * u
    size = float(np.linalg.norm(x))
    return x / size if size > 0 else x


def _signed(x: np.ndarray) -> np.ndarray:
    top = int(np.argmax(np.abs(x)))
    return -x if x[top] < 0 else x


def fit(fit_list: DataFrame, d: int, components: int = COMPONENTS) -> Fit | None:
    """The leading eigenpairs of the covariance of ``fit_list`` (column x)."""
    schema = "k int, v string"
    moments = fit_list.select("x").mapInArrow(_moments(d), schema)
    totals = dict(
        moments.groupBy("k")
        .agg(F.sum(F.col("v").cast("decimal(38,0)")).alias("v"))
        .collect()
    )
    n = int(totals.get(0, 0) or 0)
    if n == 0:
        return None
    sums = [int(totals[1 + i]) for i in range(d)]
    gram = [[0] * d for _ in range(d)]
    for at, (i, j) in enumerate(zip(*np.triu_indices(d), strict=True)):
        gram[i][j] = gram[j][i] = int(totals[1 + d + at])
    v = covariance(n, sums, gram)
    trace = float(np.trace(v))
    values, vectors, certified = [], [], []
    for k in range(1, min(components, d) + 1):
        e, u, sure = leading_pair(v, k, vectors)
        if not e > 1e-12 * trace:
            break
        values.append(e)
        vectors.append(u)
        certified.append(sure)
    return Fit(n, sums, values, [u.tolist() for u in vectors], trace, certified)


def _whitened(model: Fit, c: int) -> Column:
    n = model.n
    centred = F.zip_with(
        "x",
        F.array(*[F.lit(s) for s in model.sums]),
        lambda a, s: (a * F.lit(n) - s).cast("double") / F.lit(float(n)),
    )
    projected = F.aggregate(
        F.zip_with(centred, F.array(*[F.lit(u) for u in model.vectors[c]]), lambda a, b: a * b),
        F.lit(0.0),
        lambda acc, t: acc + t,
    )
    return projected / F.lit(math.sqrt(model.eigenvalues[c]))


def _identity_error(fit_list: DataFrame, model: Fit) -> float:
    k = len(model.vectors)
    w = fit_list.select(*[_whitened(model, c).alias(f"w{c}") for c in range(k)])
    means = w.agg(*[F.avg(f"w{c}").alias(f"m{c}") for c in range(k)]).first()
    centred = [F.col(f"w{c}") - F.lit(means[c]) for c in range(k)]
    cov = w.agg(
        *[F.avg(centred[a] * centred[b]).alias(f"c{a}_{b}") for a in range(k) for b in range(k)]
    ).first()
    return max(abs(cov[a * k + b] - (1.0 if a == b else 0.0)) for a in range(k) for b in range(k))


def whiten(
    emb: DataFrame,
    key: str = "vec_id",
    vector: str = "embedding",
    components: int = COMPONENTS,
) -> DataFrame:
    """``key, component, n, deviation, whitened, explained, identity_error,
    eigenvalue, certified``: a row for each kept row and component."""
    schema = (
        f"{ddl(emb, key)}, component int, n long, deviation long, whitened double, "
        "explained double, identity_error double, eigenvalue double, certified boolean"
    )
    spark = emb.sparkSession
    rows = integer_vectors(emb, key, vector)
    d = dimension(rows)
    if d is None:
        return spark.createDataFrame([], schema)
    rows = rows.where(F.size("x") == d)
    fit_list = materialize(rows.select("x").distinct(), "fit-list")
    model = fit(fit_list, d, components)
    if model is None or not model.vectors:
        return spark.createDataFrame([], schema)
    error = _identity_error(fit_list, model)
    deviation = F.aggregate(
        F.zip_with("x", F.array(*[F.lit(s) for s in model.sums]), lambda a, s: a * F.lit(model.n) - s),
        F.lit(0).cast("long"),
        lambda acc, t: acc + t * t,
    )
    per_component = F.array(
        *[
            F.struct(
                F.lit(c + 1).alias("component"),
                _whitened(model, c).alias("whitened"),
                F.lit(model.eigenvalues[c] / model.trace).alias("explained"),
                F.lit(model.eigenvalues[c]).alias("eigenvalue"),
                F.lit(model.certified[c]).alias("certified"),
            )
            for c in range(len(model.vectors))
        ]
    )
    out = rows.select(
        "key", deviation.alias("deviation"), F.explode(per_component).alias("c")
    ).select(
        F.col("key").alias(key),
        "c.component",
        F.lit(model.n).cast("long").alias("n"),
        "deviation",
        "c.whitened",
        "c.explained",
        F.lit(error).alias("identity_error"),
        "c.eigenvalue",
        "c.certified",
    )
    return out
