"""Whitening of embeddings: leading eigenvectors of their covariance by contour integration.

Counts, sums and products are gathered in exact integers, so the covariance doesn't depend on how rows are dealt.
FEAST: for an interval of eigenvalues, solves with the covariance shifted to complex points of a circle around it,
summed by quadrature, project a block of vectors onto the interval's eigenspace; Rayleigh-Ritz extracts the vectors,
and both steps repeat until residuals vanish.  Inertia counts say how many eigenvalues an interval holds, so that the
intervals are placed by them and none can be missed.  The solves, one for each point and interval, are Spark tasks.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docketry.llm.common import materialise
from docketry.llm.vectors import integer_vectors, lists, matrix

#: Points on the upper half of a circle.
NODES = 8
#: Eigenvalues of one interval, as near as gaps allow.
PER_INTERVAL = 4
#: Rounds of projection and extraction before giving up.
LIMIT = 40


@dataclass
class Moments:
    """Of integer vectors: how many, their sums, and the covariance with divisor n."""

    n: int
    sums: list[int]
    covariance: np.ndarray


@dataclass
class Components:
    """Unit eigenvectors as columns, by falling eigenvalue; ``trace`` is that of the covariance."""

    vectors: np.ndarray
    values: np.ndarray
    trace: float


def _products(centre: list[int]):
    """Of a task: sums of y_i * y_j for y = x - centre, in exact integers, for i <= j."""
    c, d = np.array(centre, dtype=np.int64), len(centre)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, seen = np.zeros((d, d), dtype=object), False
        for batch in batches:
            if not batch.num_rows:
                continue
            y, seen = matrix(batch, "v") - c, True
            largest = int(np.abs(y).max())
            # double precision holds integers below 2 ** 53, so sums of so many rows are exact
            fit = (1 << 53) // max(1, largest * largest)
            for at in range(0, len(y), max(1, fit)):
                part = y[at : at + max(1, fit)]
                wide = part.astype(np.float64) if fit else part.astype(object)
                product = wide.T @ wide
                total += product.astype(np.int64).astype(object) if fit else product
        if seen:
            i, j = np.triu_indices(d)
            yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array([Decimal(t) for t in total[i, j]], pa.decimal128(38, 0))], names=["i", "j", "total"])

    return run


def moments(rows: DataFrame, d: int) -> Moments:
    """Moments of ``v`` over all rows; what comes to the driver is of the size of the covariance.

    Vectors are centred at the rounded mean before they are multiplied; what rounding left is taken off exactly.
    """
    first = rows.agg(F.count(F.lit(1)).alias("n"), *[F.sum(F.col("v")[i].cast("decimal(38,0)")).alias(f"s{i}") for i in range(d)]).first()
    n, sums = first["n"], [int(first[f"s{i}"]) for i in range(d)]
    centre = [(2 * s + n) // (2 * n) for s in sums]
    rest = [s - n * c for s, c in zip(sums, centre)]
    products = rows.select("v").mapInArrow(_products(centre), "i int, j int, total decimal(38,0)").groupBy("i", "j").agg(F.sum("total").alias("total")).collect()
    v = np.zeros((d, d))
    for r in products:
        v[r["i"], r["j"]] = v[r["j"], r["i"]] = (n * int(r["total"]) - rest[r["i"]] * rest[r["j"]]) / (n * n)
    return Moments(n, sums, v)


def tridiagonal(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Diagonal and off-diagonal of a tridiagonal matrix with the eigenvalues of ``v`` (Householder)."""
    a, d = v.copy(), len(v)
    for k in range(d - 2):
        x = a[k + 1 :, k].copy()
        size = np.linalg.norm(x)
        if size > 0:
            x[0] += np.copysign(size, x[0])
            x /= np.linalg.norm(x)
            a[k + 1 :] -= 2 * np.outer(x, x @ a[k + 1 :])
            a[:, k + 1 :] -= 2 * np.outer(a[:, k + 1 :] @ x, x)
    return np.diag(a).copy(), np.diag(a, 1).copy()


def count_above(tri: tuple[np.ndarray, np.ndarray], shift: float) -> int:
    """Eigenvalues above ``shift``, by Sylvester's law: positive pivots of the shifted matrix."""
    diagonal, off = tri
    tiny = np.finfo(float).tiny / np.finfo(float).eps
    pivot, n = 1.0, 0
    for k, a in enumerate(diagonal):
        pivot = a - shift - (off[k - 1] ** 2 / pivot if k else 0.0)
        pivot = pivot if abs(pivot) > tiny else -tiny
        n += pivot > 0
    return n


def _eigenvalue_place(tri, rank: int, low: float, high: float) -> tuple[float, float]:
    """A narrow bracket of the eigenvalue of that rank, 1 the largest."""
    for _ in range(200):
        middle = (low + high) / 2
        if not low < middle < high:
            break
        low, high = (middle, high) if count_above(tri, middle) >= rank else (low, middle)
    return low, high


def intervals(tri: tuple[np.ndarray, np.ndarray], wanted: int, floor: float) -> list[tuple[float, float, int]]:
    """(low, high, eigenvalues inside), from the top, that hold the ``wanted`` largest above ``floor`` or a few more.

    Bounds lie in the middle of a gap; eigenvalues too close to be told apart share an interval.
    """
    d = len(tri[0])
    reach = float(np.abs(tri[0]).max() + 2 * np.abs(tri[1]).max(initial=0.0))
    wanted = min(wanted, count_above(tri, floor))
    out, done, high = [], 0, reach * 1.01
    while done < wanted:
        rank = min(done + PER_INTERVAL, wanted)
        low = _eigenvalue_place(tri, rank, -reach, high)[0]
        rank = count_above(tri, low - 1e-10 * reach)
        below = _eigenvalue_place(tri, rank + 1, -reach * 1.01, high)[1] if rank < d else -reach * 0.01
        edge = (low + below) / 2
        rank = count_above(tri, edge)
        out.append((edge, high, rank - done))
        done, high = rank, edge
    return out


def _solver(v: np.ndarray, blocks: list[np.ndarray]):
    """Shifted solves, one for each row ``which, node``: weight * (z - V)^-1 Y, its real part."""
    d = len(v)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for which, node, re, im, wre, wim in zip(*[batch.column(c).to_pylist() for c in ("which", "node", "re", "im", "wre", "wim")]):
                solved = np.linalg.solve(complex(re, im) * np.eye(d) - v, blocks[which].astype(complex))
                out = (complex(wre, wim) * solved).real
                yield pa.RecordBatch.from_arrays([pa.array([which], pa.int32()), pa.array([node], pa.int32()), lists(out.reshape(1, -1), pa.float64())], names=["which", "node", "part"])

    return run


def leading_components(spark: SparkSession, v: np.ndarray, wanted: int, seed: int = 7) -> Components:
    """The ``wanted`` leading eigenvectors of a covariance, fewer where its rank is less.

    Eigenvalues within rounding of zero, against the trace, are no components.  Raises if an interval isn't found
    complete, by its inertia count, to double precision.
    """
    d, trace = len(v), float(np.trace(v))
    if not d or trace <= 0:
        return Components(np.zeros((d, 0)), np.zeros(0), trace)
    tri, eps = tridiagonal(v), np.finfo(float).eps
    places = intervals(tri, wanted, 8 * d * eps * trace)
    random = np.random.default_rng(seed)
    blocks = [random.standard_normal((d, min(d, 2 * n + 4))) for _, _, n in places]
    angle, weight = np.polynomial.legendre.leggauss(NODES)
    norm, found, worst = float(np.abs(v).sum(axis=1).max()), {}, {}
    for _ in range(LIMIT):
        shifts = []
        for which, (low, high, _) in enumerate(places):
            if which not in found:
                radius = (high - low) / 2
                turn = np.exp(1j * np.pi / 2 * (angle + 1))
                # the lower half of the circle is the conjugate: twice the real part
                z, w = (low + high) / 2 + radius * turn, radius * turn * weight / 2
                shifts += [(which, k, float(z[k].real), float(z[k].imag), float(w[k].real), float(w[k].imag)) for k in range(NODES)]
        if not shifts:
            break
        tasks = spark.createDataFrame(shifts, "which int, node int, re double, im double, wre double, wim double").repartition(len(shifts), "which", "node")
        parts = sorted(tasks.mapInArrow(_solver(v, blocks), "which int, node int, part array<double>").collect(), key=lambda r: (r["which"], r["node"]))
        for which in {r["which"] for r in parts}:
            low, high, n = places[which]
            q = np.linalg.qr(sum(np.array(r["part"]).reshape(blocks[which].shape) for r in parts if r["which"] == which))[0]
            e, u = np.linalg.eigh(q.T @ v @ q)
            x = q @ u
            inside = np.flatnonzero((e > low) & (e <= high))
            residual = np.linalg.norm(v @ x[:, inside] - x[:, inside] * e[inside], axis=0).max(initial=0.0)
            blocks[which] = x
            # one more round once they are as small as rounding allows, or stop when they no longer shrink
            small = len(inside) == n and residual <= 64 * eps * norm
            if small and residual >= worst.get(which, np.inf) / 2:
                found[which] = (e[inside], x[:, inside])
            worst[which] = residual if len(inside) == n else np.inf
    if len(found) < len(places):
        raise ArithmeticError(f"eigenvalues missing from intervals {[p for k, p in enumerate(places) if k not in found]}")
    if not found:
        return Components(np.zeros((d, 0)), np.zeros(0), trace)
    e, x = np.concatenate([found[k][0] for k in range(len(places))]), np.concatenate([found[k][1] for k in range(len(places))], axis=1)
    order = np.argsort(-e, kind="stable")[:wanted]
    return Components(x[:, order], e[order], trace)


def _whitener(m: Moments, c: Components):
    """``vec_id, deviation, whitened`` of Arrow batches."""
    n, d = m.n, len(m.sums)
    centre = [(2 * s + n) // (2 * n) for s in m.sums]
    rest = np.array([(s - n * k) / n for s, k in zip(m.sums, centre)])
    # n * x - S = n * (x - centre) - (S - n * centre)
    left, whole = np.array([s - n * k for s, k in zip(m.sums, centre)], dtype=object), np.array(centre, dtype=np.int64)
    scaled = c.vectors / np.sqrt(c.values)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            y = matrix(batch, "v") - whole
            largest = n * (int(np.abs(y).max()) + 1)
            kind = np.int64 if d * largest * largest < 1 << 62 else object
            deviation = ((n * y.astype(kind) - left.astype(kind)) ** 2).sum(axis=1)
            white = (y.astype(np.float64) - rest) @ scaled
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array([Decimal(int(x)) for x in deviation], pa.decimal128(38, 0)), lists(white, pa.float64())], names=["vec_id", "deviation", "whitened"])

    return run


def whiten(vectors: DataFrame, components: int = 8, scale: int = 1024, offset: int = 100_000, id_col: str = "vec_id", vector_col: str = "embedding") -> tuple[DataFrame, Moments, Components, float]:
    """``vec_id, deviation, whitened array<double>`` for every finite vector; its moments, components, and the identity error.

    Components c become x = floor(scale * c) + offset; the covariance of x has divisor n.  ``whitened`` is x less the
    mean, projected on each component, over the root of its eigenvalue; ``deviation`` the exact sum over dimensions of
    (n * x - S) ** 2.  The identity error is the largest absolute entry of the covariance of ``whitened`` less the
    identity, 0 where nothing is whitened.  Dropped rows: see ``integer_vectors``.  Repeated rows count and come back
    each; a covariance of lower rank has fewer components (one row, or equal rows: none); an empty table gives no rows;
    extra columns are ignored.
    """
    spark = vectors.sparkSession
    rows, d = integer_vectors(vectors, scale, offset, 1 << 50, vector_col, vec_id=id_col)
    schema = f"vec_id {rows.schema['vec_id'].dataType.simpleString()}, deviation decimal(38,0), whitened array<double>"
    if not d:
        return spark.createDataFrame([], schema), Moments(0, [], np.zeros((0, 0))), Components(np.zeros((0, 0)), np.zeros(0), 0.0), 0.0
    m = moments(rows, d)
    c = leading_components(spark, m.covariance, components)
    white = materialise(rows.mapInArrow(_whitener(m, c), schema), "whitened")
    k = len(c.values)
    if not k:
        return white, m, c, 0.0
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    got = white.agg(*[F.covar_pop(F.col("whitened")[i], F.col("whitened")[j]).alias(f"c{i}_{j}") for i, j in pairs]).first()
    return white, m, c, max(abs(got[f"c{i}_{j}"] - (i == j)) for i, j in pairs)
