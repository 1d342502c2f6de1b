"""Whitening of vectors by the singular values and right vectors of the centred rows.

Tasks reduce their rows in blocks: a block is centred by its own exact mean and reduced to a triangular factor by QR.
Blocks are merged by count, sum and factor: the factors are stacked with one row a block for the way from the block's
mean to the common one, and reduced again, in a task, over a tree of tasks, and for the last few on the driver. What
comes out is the factor of all rows centred by their common mean, of the size of the dimension alone.

That factor is brought to bidiagonal form by Householder reflections. Differential quotient-difference transforms with
shifts (dqds) give the singular values to high relative accuracy; twisted factorisations of the bidiagonal's square give
the right vectors of the largest ones, those of close values are made orthogonal to each other.

Components whose singular value is zero to working precision have no direction to scale and are left out, so rows that
all are equal, or a single row, give no result; so do empty tables. Rows with unusable vectors are left out as
``vectors.whole_vectors`` says; rows that repeat count each time, and rows without an id have one of null. Of equal
singular values any orthonormal directions are right; one choice holds for all rows. ``deviation`` is null where it would
pass 64 bits. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from txnflow.llm.shared import ship, written
from txnflow.llm.vectors import matrix, whole_vectors

COMPONENTS = 8
#: Added to the scaled components.
OFFSET = 100_000
#: Bytes of factors that a task of the tree merges at once, and factors it merges at most.
MERGE_BYTES, MERGE_AT_MOST = 2**27, 16
EPS = float(np.finfo(float).eps)

Block = tuple[int, list[int], np.ndarray]


# --- reduction of rows to one factor -------------------------------------------------------------------------------


def block(x: np.ndarray) -> Block:
    """Count, exact sums and triangular factor of the rows of ``x``, centred by their mean."""
    n, s = len(x), x.sum(axis=0)
    near = s // n  # whole numbers are taken off first, so that the rest is rounded at its own size
    y = (x - near) - (s - n * near) / n
    return n, s.tolist(), np.linalg.qr(y, mode="r")


def merge(blocks: list[Block]) -> Block:
    """The block of all rows of ``blocks``."""
    if len(blocks) == 1:
        return blocks[0]
    n = sum(b[0] for b in blocks)
    s = [sum(v) for v in zip(*(b[1] for b in blocks), strict=True)]
    # sqrt(n_b) * (mean of the block - common mean), its difference from whole numbers
    way = np.array([[(n * p - b[0] * t) / (n * b[0]) for p, t in zip(b[1], s, strict=True)] for b in blocks])
    way *= np.sqrt([[float(b[0])] for b in blocks])
    return n, s, np.linalg.qr(np.vstack([*(b[2] for b in blocks), way]), mode="r")


_BLOCK = "n long, s array<decimal(38,0)>, r array<double>"


def _stored(b: Block) -> pa.RecordBatch:
    from decimal import Decimal

    s = pa.array([[Decimal(v) for v in b[1]]], pa.list_(pa.decimal128(38, 0)))
    return pa.RecordBatch.from_arrays([pa.array([b[0]], pa.int64()), s, pa.array([b[2].ravel().tolist()])], names=["n", "s", "r"])


def _block(n: int, s: list, r: list, d: int) -> Block:
    return n, [int(v) for v in s], np.array(r, float).reshape(-1, d)


def reduced(rows: DataFrame, d: int) -> Block:
    """The block of all rows; ``rows`` has whole-number vectors ``x`` of ``d`` components."""
    fan = max(2, min(MERGE_AT_MOST, MERGE_BYTES // (8 * d * d)))

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[Block] = []
        for b in batches:
            x = matrix(b.column(0), d)
            if len(x):
                held.append(block(x + OFFSET))
            if len(held) == fan:
                held = [merge(held)]
        if held:
            yield _stored(merge(held))

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[Block] = []
        for b in batches:
            for n, s, r in zip(*(b.column(c).to_pylist() for c in ("n", "s", "r")), strict=True):
                held.append(_block(n, s, r, d))
                if len(held) == fan:
                    held = [merge(held)]
        if held:
            yield _stored(merge(held))

    blocks = written(rows.select("x").mapInArrow(first, _BLOCK))
    while (k := blocks.count()) > fan:
        blocks = written(blocks.repartition(-(-k // fan)).mapInArrow(again, _BLOCK))
    return merge([_block(*b, d) for b in blocks.collect()])  # at most ``fan`` factors


# --- singular values and vectors of the factor -----------------------------------------------------------------------


def bidiagonal(a: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Diagonal, superdiagonal and orthogonal ``v`` with ``a = u @ b @ v.T``, by Householder reflections from both sides."""
    a = np.vstack([a, np.zeros((max(0, a.shape[1] - len(a)), a.shape[1]))])
    d = a.shape[1]
    v = np.eye(d)

    def mirror(x: np.ndarray) -> tuple[np.ndarray, float] | None:
        """Unit normal of the reflection that takes ``x`` to a multiple of the first axis, and that multiple."""
        size = np.linalg.norm(x)
        if size == 0 or not x[1:].any():
            return None
        w = x.copy()
        w[0] += np.copysign(size, x[0])
        return w / np.linalg.norm(w), -np.copysign(size, x[0])

    for k in range(d):
        if m := mirror(a[k:, k]):
            a[k:, k:] -= 2 * np.outer(m[0], m[0] @ a[k:, k:])
            a[k, k] = m[1]
        if k < d - 2 and (m := mirror(a[k, k + 1 :])):
            a[k:, k + 1 :] -= 2 * np.outer(a[k:, k + 1 :] @ m[0], m[0])
            v[:, k + 1 :] -= 2 * np.outer(v[:, k + 1 :] @ m[0], m[0])
            a[k, k + 1] = m[1]
    return np.diag(a).copy(), np.diag(a, 1).copy(), v


def _transform(q: list[float], e: list[float], shift: float) -> tuple[list[float], list[float], list[float]] | None:
    """One differential quotient-difference step: the new squares and the d's between; None where a square turns negative."""
    qs, es, ds = [], [], []
    d = q[0] - shift
    for i in range(len(e)):
        if d < 0:
            return None
        ds.append(d)
        new = d + e[i]
        ratio = q[i + 1] / new if new > 0 else 1.0
        qs.append(new)
        es.append(e[i] * ratio)
        d = d * ratio - shift if new > 0 else q[i + 1] - shift
    if d < 0:
        return None
    return [*qs, d], es, [*ds, d]


def dqds(diagonal: np.ndarray, upper: np.ndarray) -> list[float]:
    """Singular values of the bidiagonal matrix, falling.

    Shifts are Newton's lower bound of the smallest squared value, from the d's of the unshifted step: their inverses
    add up to the trace of the inverse. Off-diagonals below rounding end a block; blocks are worked on alone.
    """
    found: list[float] = []
    todo = [((diagonal**2).tolist(), (upper**2).tolist(), 0.0)]
    while todo:
        q, e, moved = todo.pop()
        lost = 0.0  # rounding of ``moved``
        while len(q) > 1:
            cut = next((i for i in range(len(e) - 1, -1, -1) if e[i] <= EPS**2 * min(q[i] + moved, q[i + 1] + moved) or e[i] <= np.finfo(float).tiny), None)
            if cut is not None:
                todo.append((q[: cut + 1], e[:cut], moved))
                q, e = q[cut + 1 :], e[cut + 1 :]
                continue
            plain = _transform(q, e, 0.0)
            ds = plain[2]
            bound = 0.0 if min(ds) <= 0 else (1 - 8 * EPS * len(q)) / sum(1 / d for d in ds)
            stepped = _transform(q, e, bound) if bound > EPS * moved else None
            if stepped is None:
                bound, stepped = 0.0, plain
            q, e, _ = stepped
            add = bound - lost
            total = moved + add
            moved, lost = total, (total - moved) - add
        if q:
            found.append(float(np.sqrt(q[0] + moved)))
    return sorted(found, reverse=True)


def _twists(a2: np.ndarray, l: np.ndarray, value: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:  # noqa: E741
    """Both factorisations of ``l d l' - value`` (``d`` = ``a2``): lower and upper multipliers, and the twists' pivots."""
    n, tiny = len(a2), np.finfo(float).tiny * 1e10
    low, up, s, p = np.zeros(n - 1), np.zeros(n - 1), np.zeros(n), np.zeros(n)
    s[0] = -value
    for i in range(n - 1):
        pivot = s[i] + a2[i]
        pivot = pivot if abs(pivot) > tiny else -tiny
        low[i] = a2[i] * l[i] / pivot
        s[i + 1] = low[i] * l[i] * s[i] - value
    p[-1] = a2[-1] - value
    for i in range(n - 2, -1, -1):
        pivot = a2[i] * l[i] ** 2 + p[i + 1]
        pivot = pivot if abs(pivot) > tiny else -tiny
        up[i] = l[i] * a2[i] / pivot
        p[i] = p[i + 1] * (a2[i] / pivot) - value
    return low, up, s + p + value


def twisted_vectors(diagonal: np.ndarray, upper: np.ndarray, values: list[float]) -> np.ndarray:
    """Right vectors (columns) of the bidiagonal matrix for ``values``, which fall.

    Blocks without a link between them are taken alone, each value in the block where its smallest pivot is the smallest.
    A vector is made orthogonal to those of values within a thousandth; where little of it is left, as both lie in one
    cluster, the next best twist is taken.
    """
    n = len(diagonal)
    # A square of zero has no multiplier; what is below rounding of the whole matrix stands for it.
    least = 0.01 * EPS * float(np.abs(diagonal).max())
    diagonal = np.where(np.abs(diagonal) < least, least, diagonal)
    cuts = [0, *(i + 1 for i in range(n - 1) if abs(upper[i]) <= EPS * np.sqrt(abs(diagonal[i] * diagonal[i + 1]))), n]
    out: list[np.ndarray] = []
    for k, value in enumerate(values):
        choices = []
        for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
            a = diagonal[lo:hi]
            low, up, gamma = _twists(a**2, upper[lo : hi - 1] / a[:-1], value**2)
            choices += [(abs(gamma[t]), lo + t, lo, hi, low, up) for t in range(hi - lo)]
        choices.sort(key=lambda c: c[:2])
        close = [z for z, v in zip(out, values[:k], strict=True) if v - value <= 1e-3 * v]
        best = None
        for _, t, lo, hi, low, up in choices:
            z = np.zeros(n)
            z[t] = 1.0
            for i in range(t - 1, lo - 1, -1):
                z[i] = -low[i - lo] * z[i + 1]
            for i in range(t, hi - 1):
                z[i + 1] = -up[i - lo] * z[i]
            z /= np.linalg.norm(z)
            left = z
            for _ in range(2):
                for c in close:
                    left = left - (c @ left) * c
            size = np.linalg.norm(left)
            if best is None or size > best[0]:
                best = (size, left / max(size, EPS))
            if size > 0.5:
                break
        z = best[1]
        for c in close:
            z = z - (c @ z) * c
        out.append(z / np.linalg.norm(z))
    return np.array(out).reshape(len(out), n).T


def directions(b: Block, k: int = COMPONENTS) -> tuple[np.ndarray, np.ndarray, float]:
    """Unit columns, their variances (falling) and the variance of all dimensions, from the factor of ``b``."""
    n, _, r = b
    scale = float(np.abs(r).max()) or 1.0
    diagonal, upper, v = bidiagonal(r / scale)
    values = dqds(diagonal, upper)
    values = [x for x in values[:k] if x > len(diagonal) * EPS * values[0]]
    z = v @ twisted_vectors(diagonal, upper, values) if values else np.zeros((len(diagonal), 0))
    return z, (np.array(values) * scale) ** 2 / n, float((r**2).sum() / n)


# --- rows ------------------------------------------------------------------------------------------------------------


def _whitened(x: np.ndarray, n: int, s: list[int], w: np.ndarray) -> np.ndarray:
    near = np.array([v // n for v in s])
    return ((x - near) - np.array([(v % n) / n for v in s])) @ w


def identity_error(rows: DataFrame, b: Block, w: np.ndarray) -> float:
    """Largest absolute entry of the whitened rows' covariance less the identity, measured over all rows."""
    (n, s, _), d, k = b, *w.shape
    pairs = [(i, j) for i in range(k) for j in range(i + 1)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = matrix(batch.column(0), d)
            if len(x):
                y = _whitened(x + OFFSET, n, s, w)
                m = y.mean(axis=0)
                c = (y - m).T @ (y - m)
                yield pa.RecordBatch.from_arrays([pa.array([float(v)]) for v in (len(x), *m, *(c[i, j] for i, j in pairs))], names=names)

    names = ["n", *(f"m{i}" for i in range(k)), *(f"c{i}_{j}" for i, j in pairs)]
    blocks = written(rows.select("x").mapInArrow(run, ", ".join(f"{c} double" for c in names)))
    mean = [v / n for v in blocks.agg(*(F.sum(F.col("n") * F.col(f"m{i}")) for i in range(k))).first()]
    total = blocks.agg(*(F.sum(F.col(f"c{i}_{j}") + F.col("n") * (F.col(f"m{i}") - mean[i]) * (F.col(f"m{j}") - mean[j])) for i, j in pairs)).first()
    return max(abs(t / n - (i == j)) for t, (i, j) in zip(total, pairs, strict=True))


def deviations(x: np.ndarray, n: int, s: list[int]) -> list[int | None]:
    """Per row the sum over dimensions of ``(n * x - s) ** 2``, exact; None where it passes 64 bits."""
    size = n * int(np.abs(x).max()) + max(abs(v) for v in s)
    if size < 2**62:
        gap = n * x - np.array(s, np.int64)
        if x.shape[1] * int(np.abs(gap).max()) ** 2 < 2**63:
            return (gap**2).sum(axis=1).tolist()
    gap = n * x.astype(object) - np.array(s, object)
    return [int(v) if v < 2**63 else None for v in (gap**2).sum(axis=1)]


def whiten(embeddings: DataFrame) -> DataFrame:
    """``vec_id, component, n, deviation, whitened, explained, identity_error``: a row for each usable vector and component."""
    schema = "component int, n long, deviation long, whitened double, explained double, identity_error double"
    rows, d = whole_vectors(embeddings)
    names = ["vec_id", *(f.split()[0] for f in schema.split(", "))]
    empty = rows.where("false").selectExpr("vec_id", *(f"cast(null as {f.split()[1]}) {f.split()[0]}" for f in schema.split(", ")))
    if not d:
        return empty
    ship(embeddings.sparkSession)
    b = reduced(rows, d)
    n, s, _ = b
    z, variance, total = directions(b)
    k = len(variance)
    if not k:
        return empty
    w = z / np.sqrt(variance)
    share, error = variance / total, identity_error(rows, b, w)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = matrix(batch.column("x"), d)
            m = len(x)
            if m:
                x = x + OFFSET
                at = pa.array(np.repeat(np.arange(m), k))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("vec_id").take(at), pa.array(np.tile(np.arange(1, k + 1), m), pa.int32()), pa.array(np.full(m * k, n)),
                        pa.array(deviations(x, n, s), pa.int64()).take(at), pa.array(_whitened(x, n, s, w).ravel()), pa.array(np.tile(share, m)), pa.array(np.full(m * k, error)),
                    ],
                    names=names,
                )

    return rows.select("vec_id", "x").mapInArrow(run, f"vec_id {dict(rows.dtypes)['vec_id']}, {schema}")
