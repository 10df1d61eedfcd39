"""Whitening of embeddings: exact covariance by Spark, eigenvectors in float32 refined to double precision.

The covariance is gathered from exact integer sums, so it does not depend on how rows are dealt. Eigenvectors come from a
float32 solver; the iteration of Ogita and Aishima then corrects them by matrix products in extended precision, and
eigenvalues too close for that are solved again inside their cluster. Only tables of the dimension's size reach the driver.
"""
from __future__ import annotations

from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Entries with a larger scaled size could not be held exactly in a double.
EXACT = float(1 << 53)
#: Numbers in a block of vectors that is worked on at a time.
BLOCK = 1 << 19
#: Eigenvalues below this part of the trace count as zero.
ZERO = 1e-14


def usable(df: DataFrame, vector: str, scale: float) -> DataFrame:
    """Rows whose vector holds numbers that are exact once scaled, no null, no NaN and no infinity."""
    odd = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | ~(F.abs(x.cast("double") * scale) < EXACT))
    return df.filter(F.col(vector).isNotNull() & ~odd)


def _blocks(batches, width, scale, shift):
    """(rows of the batch, their integers less ``shift``) in blocks of bounded size."""
    most = max(1, BLOCK // max(1, width))
    for batch in batches:
        for at in range(0, batch.num_rows, most):
            part = batch.slice(at, most)
            flat = part.column(1).flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
            yield part, np.floor(scale * flat).reshape(part.num_rows, width).astype(np.int64) - shift


def _totals(df: DataFrame, width: int, scale: float) -> tuple[int, list[int]]:
    """Rows, and the sum of each dimension's integers."""
    def partial(batches):
        n, total = 0, np.zeros(width, dtype=object)
        for part, x in _blocks(batches, width, scale, 0):
            n += part.num_rows
            # halves of 32 bits, so that the sums of a block cannot overflow
            total += (x >> 32).sum(axis=0).astype(object) * (1 << 32) + (x & 0xFFFFFFFF).sum(axis=0).astype(object)
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([[Decimal(int(t)) for t in total]], pa.list_(pa.decimal128(38, 0)))], ["n", "total"])

    each = df.mapInArrow(partial, "n long, total array<decimal(38,0)>").filter("n > 0")
    sums = each.select("n", F.posexplode("total").alias("i", "v")).groupBy("i").agg(F.sum("n").alias("n"), F.sum("v").alias("v")).collect()
    return (int(sums[0].n) if sums else 0), [int(r.v) for r in sorted(sums, key=lambda r: r.i)]


def _products(df: DataFrame, width: int, scale: float, centre: np.ndarray) -> np.ndarray:
    """Sums over all rows of the products of two dimensions' integers, less ``centre`` beforehand: exact Python integers."""
    def partial(batches):
        total, part_sum, room = np.zeros((width, width), dtype=object), np.zeros((width, width), dtype=np.int64), float(1 << 62)
        seen = False
        for part, d in _blocks(batches, width, scale, centre):
            seen, top = True, float(np.abs(d).max(initial=1))
            if top * top * len(d) >= EXACT:
                wide = d.astype(object)
                total += wide.T @ wide
                continue
            if room < top * top * len(d):
                total, part_sum, room = total + part_sum.astype(object), np.zeros_like(part_sum), float(1 << 62)
            f = d.astype(np.float64)
            part_sum += (f.T @ f).astype(np.int64)
            room -= top * top * len(d)
        if seen:
            total = total + part_sum.astype(object)
            yield pa.RecordBatch.from_arrays([
                pa.array(range(width), pa.int32()),
                pa.array([[Decimal(int(v)) for v in total[i, i:]] for i in range(width)], pa.list_(pa.decimal128(38, 0)))], ["i", "v"])

    each = df.mapInArrow(partial, "i int, v array<decimal(38,0)>").select("i", F.posexplode("v").alias("j", "v"))
    out = np.zeros((width, width), dtype=object)
    for r in each.groupBy("i", "j").agg(F.sum("v").alias("v")).collect():
        out[r.i, r.i + r.j] = out[r.i + r.j, r.i] = int(r.v)
    return out


def _norm(m: np.ndarray):
    return np.sqrt(np.sum(m * m))


def _clusters(values: np.ndarray, delta):
    """Groups of two and more places whose values follow each other within ``delta``."""
    order = np.argsort(values)
    cuts = np.flatnonzero(np.diff(values[order]) > delta) + 1
    return [g for g in np.split(order, cuts) if len(g) > 1]


def refine(a: np.ndarray, x: np.ndarray, rounds: int = 20) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues (falling) and unit eigenvectors of the symmetric ``a``, from rough eigenvectors ``x``.

    Each round measures how far x is from orthogonal (r) and from diagonalising a (s) and adds x @ e, where e solves both
    to first order for every pair of eigenvalues that lie apart; the error is squared each time. Pairs within ``delta``, which
    is never below the rounding of the products, cannot be told apart that way: there only orthogonality is mended, and the cluster's own small matrix, less its mean,
    is solved and its vectors turned. Works in numpy's longest float.
    """
    a, x = a.astype(np.longdouble), x.astype(np.longdouble)
    one, size, tiny = np.eye(len(a), dtype=np.longdouble), _norm(a), np.finfo(np.longdouble).eps
    for _ in range(rounds):
        r, s = one - x.T @ x, x.T @ (a @ x)
        r, s = (r + r.T) / 2, (s + s.T) / 2  # else a small gap magnifies the roundings that differ into a loss of orthogonality
        value = np.diag(s) / (1 - np.diag(r))
        delta = np.maximum(2 * (_norm(s - np.diag(value)) + size * _norm(r)), 8 * len(a) * size * tiny)
        gap = value[None, :] - value[:, None]
        far = np.abs(gap) > delta
        apart = np.where(far, gap, 1)
        e = np.where(far, (s + r * value[None, :]) / apart, r / 2)
        x = x + x @ e
        for group in _clusters(value, delta):
            y = x[:, group]
            small = y.T @ (a @ y) - np.mean(value[group]) * (y.T @ y)
            large = np.max(np.abs(small))
            if large > size * tiny * len(a):
                x[:, group] = y @ np.linalg.eigh(((small + small.T) / (2 * large)).astype(np.float64))[1].astype(np.longdouble)
        if np.all(np.abs(e) <= 8 * tiny * (1 + size / np.abs(apart))):
            break
    x = x / np.sqrt(np.sum(x * x, axis=0))
    value = np.sum(x * (a @ x), axis=0)
    order = np.argsort(-value, kind="stable")
    return value[order], x[:, order]


def eigen(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues (falling) and unit eigenvectors of a covariance: float32 solver, then ``refine``."""
    scale = np.max(np.abs(a), initial=0)
    if not scale > 0:
        return np.zeros(len(a), np.longdouble), np.eye(len(a), dtype=np.longdouble)
    rough = np.linalg.eigh((a / scale).astype(np.float32))[1]
    value, x = refine(a / scale, rough)
    return value * scale, x


def _identity_error(df: DataFrame, width: int, scale: float, centre: np.ndarray, rest: np.ndarray, map_: np.ndarray, n: int) -> float:
    """Largest entry of the whitened rows' covariance less the identity, measured over all rows."""
    k = map_.shape[1]

    def partial(batches):
        total = np.zeros((k + 1, k))
        for _, d in _blocks(batches, width, scale, centre):
            w = (d - rest) @ map_
            total[:k] += w.T @ w
            total[k] += w.sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(range(k + 1), pa.int32()), pa.array(total.tolist(), pa.list_(pa.float64()))], ["i", "v"])

    each = df.mapInArrow(partial, "i int, v array<double>").select("i", F.posexplode("v").alias("j", "v"))
    sums = np.zeros((k + 1, k))
    for r in each.groupBy("i", "j").agg(F.sum("v").alias("v")).collect():
        sums[r.i, r.j] = r.v
    mean = sums[k] / n
    return float(np.max(np.abs(sums[:k] / n - np.outer(mean, mean) - np.eye(k))))


SCHEMA = "component int, n long, deviation long, whitened double, explained double, identity_error double"


def whitened(df: DataFrame, id: str = "vec_id", vector: str = "embedding", components: int = 32, scale: float = 64, shift: int = 1_000_000) -> DataFrame:
    """One row for each vector and component: id, component (from 1, by falling eigenvalue), n, deviation, whitened,
    explained and identity_error (one value for the table).

    An entry c counts as the integer x = floor(scale * c) + shift. With n vectors and sums S of each dimension, deviation
    is the sum of (n * x - S) ** 2, exact; null where it does not fit into a long. The components are unit eigenvectors of
    the covariance of x, divisor n; whitened is x - S / n projected on one, over the root of its eigenvalue; explained its
    eigenvalue over the trace. A sign is that of the component's largest entry, made positive.

    Vectors that are null or hold null, NaN or infinite entries are left out, and such with scaled entries of 2 ** 53
    and more. Where lengths differ, the most frequent takes part (ties: the longer). Components whose eigenvalue is zero
    (fewer vectors than dimensions, a constant dimension, one vector only) have whitened null and explained 0, and do not
    count in identity_error, which is null where no component remains. Repeated and null ids keep their rows; an empty
    table, and one of empty vectors, gives an empty table. Other columns are left out, whatever their names.

    The vectors are read four times and never shuffled: sums, products, the measured error, the result. What meets are
    sums of the dimension's size for each task (tasks x width ** 2 / 2 numbers); the driver holds one such matrix.
    """
    spark = df.sparkSession
    rows = usable(df.select(F.col(id).alias("id"), F.col(vector).alias("v")), "v", scale)
    kind = df.schema[id].dataType.simpleString()
    schema = f"`{id}` {kind}, {SCHEMA}"
    common = rows.groupBy(F.size("v").alias("width")).count().orderBy(F.desc("count"), F.desc("width")).limit(1).collect()
    if not common or not common[0].width:
        return spark.createDataFrame([], schema)
    width = common[0].width
    rows = rows.filter(F.size("v") == width)
    n, sums = _totals(rows, width, scale)
    centre = np.array([(2 * s + n) // (2 * n) for s in sums], dtype=np.int64)
    left = [s - n * int(c) for s, c in zip(sums, centre)]
    product = _products(rows, width, scale, centre)
    cov = np.array([[np.longdouble(str(n * int(product[i, j]) - left[i] * left[j])) for j in range(width)] for i in range(width)])
    cov = cov / np.longdouble(str(n * n))
    value, x = eigen(cov)
    trace, k = np.trace(cov), min(components, width)
    value, x = value[:k], x[:, :k]
    x = x * np.where(x[np.argmax(np.abs(x), axis=0), np.arange(k)] < 0, -1, 1)
    real = int(np.sum(value > ZERO * trace)) if trace > 0 else 0
    map_ = (x[:, :real] / np.sqrt(value[:real])).astype(np.float64)
    rest = (np.array([np.longdouble(str(t)) for t in left]) / n).astype(np.float64)
    share = np.array([float(v / trace) for v in value[:real]] + [0.0] * (k - real))
    error = _identity_error(rows, width, scale, centre, rest, map_, n) if real else None
    less = np.array(left, dtype=object)
    small = np.array(left, dtype=np.int64) if max(map(abs, left)) < 1 << 62 else None

    def deviations(d):
        top = float(np.abs(d).max(initial=0)) * n + float(max(map(abs, left)))
        if small is not None and top * top * width < float(1 << 62):
            y = d * n - small
            return pa.array(np.einsum("ij,ij->i", y, y), pa.int64())
        exact = ((d.astype(object) * n - less) ** 2).sum(axis=1)
        return pa.array([int(v) if v < 1 << 63 else None for v in exact], pa.int64())

    def out(batches):
        for part, d in _blocks(batches, width, scale, centre):
            m = len(d)
            w = np.full((m, k), np.nan)
            w[:, :real] = (d - rest) @ map_
            flat = w.ravel()
            place = pa.array(np.repeat(np.arange(m), k))
            yield pa.RecordBatch.from_arrays([
                part.column(0).take(place), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, n, dtype=np.int64)),
                deviations(d).take(place), pa.array(flat, mask=np.isnan(flat)), pa.array(np.tile(share, m)),
                pa.array([error] * (m * k), pa.float64())], [id, "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.mapInArrow(out, schema)
