"""Embedding whitening by matrix-free block subspace iteration.

The covariance of the centred rows is never formed: a pass over the rows computes X'(XQ) for a block Q of
orthonormal columns, each task adding up a matrix of dimensions by columns. The driver takes the QR
decomposition and the Rayleigh-Ritz values and vectors of the block, and stops once the residuals
certify every component asked for: the angle to the true eigenvector is at most residual over gap. A
block that converges too slowly, because the spectrum is flat behind it, is doubled; at the width of the vectors
one pass is enough, so the number of passes does not depend on the spectrum.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkloom.session import stored

ROWS = 2048  # rows that a task multiplies at once
PATIENCE = 6  # further passes that a block may need before it is doubled instead


@dataclass(frozen=True)
class Whitening:
    """``n`` distinct vectors with sums ``total`` per dimension and entries of at most ``largest``; ``vectors`` has a component in each
    column with its ``values``; ``trace`` is the whole variance, ``passes`` the number of multiplications over the rows, ``error`` the
    largest entry of the whitened covariance less the identity."""

    n: int
    total: np.ndarray
    largest: int
    trace: float
    vectors: np.ndarray
    values: np.ndarray
    passes: int
    error: float | None

    def scales(self) -> np.ndarray:
        """1 / sqrt(value) of each component, NaN for one without variance."""
        there = self.values > 64 * np.finfo(float).eps * max(1, len(self.total)) * max(self.trace, 0.0)
        return np.where(there, 1 / np.sqrt(np.where(there, self.values, 1.0)), np.nan)


def _blocks(column: pa.Array, d: int) -> Iterator[np.ndarray]:
    x = column.flatten().to_numpy(zero_copy_only=False).reshape(-1, d)
    for at in range(0, len(x), ROWS):
        yield x[at : at + ROWS]


def integer_vectors(rows: DataFrame, id_col: str, vec_col: str, scale: int = 256) -> tuple[DataFrame, int]:
    """``(id, x)`` with ``x = floor(scale * entry)`` as longs, and the number of dimensions.

    Vectors null or with null or non-finite entries go. Of vectors of several lengths, those of the commonest length
    stay (of two as common, the longer).
    """
    sound = F.forall(vec_col, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    kept = rows.where(F.col(vec_col).isNotNull()).where(sound).select(F.col(id_col).alias("id"), F.transform(vec_col, lambda c: F.floor(c.cast("double") * scale).cast("bigint")).alias("x"))
    length = kept.groupBy(F.size("x").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    d = length["d"] if length else 0
    return kept.where(F.size("x") == d), d


def _moments(fit: DataFrame, d: int) -> tuple[int, np.ndarray, int, int]:
    """Number of rows, sums per dimension, sum of squares and largest absolute entry, as exact integers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums, squares, top = 0, np.zeros(d, object), 0, 0
        for batch in batches:
            for x in _blocks(batch.column(0), d):
                high = int(np.abs(x).max(initial=0))
                exact = x if high**2 * x.size < 1 << 62 else x.astype(object)
                n, sums, squares, top = n + len(x), sums + exact.sum(0).astype(object), squares + int((exact * exact).sum()), max(top, high)
        told = [("n", 0, n), ("squares", 0, squares), *(("sum", i, int(s)) for i, s in enumerate(sums)), ("top", 0, top)]
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _, _ in told]), pa.array([i for _, i, _ in told], pa.int32()), pa.array([str(v) for _, _, v in told])], ["kind", "at", "value"])

    exact = F.col("value").cast("decimal(38,0)")
    found = fit.mapInArrow(run, "kind string, at int, value string").groupBy("kind", "at").agg(F.sum(exact).alias("sum"), F.max(exact).alias("top")).collect()
    by = {(r["kind"], r["at"]): r for r in found}
    if ("n", 0) not in by:
        return 0, np.zeros(d, object), 0, 0
    return int(by["n", 0]["sum"]), np.array([int(by["sum", i]["sum"]) for i in range(d)], object), int(by["squares", 0]["sum"]), int(by["top", 0]["top"])


def _summed(fit: DataFrame, shape: tuple[int, int], of_block, d: int) -> np.ndarray:
    """The sum over all rows of a matrix that ``of_block`` gives for some of them; a task sends one matrix."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        acc = np.zeros(shape)
        for batch in batches:
            for x in _blocks(batch.column(0), d):
                acc += of_block(x)
        yield pa.RecordBatch.from_arrays([pa.array([acc.ravel()], pa.list_(pa.float64()))], ["part"])

    parts = fit.mapInArrow(run, "part array<double>").select(F.posexplode("part").alias("at", "value"))
    out = np.zeros(shape).ravel()
    for r in parts.groupBy("at").agg(F.sum("value").alias("value")).collect():  # dimensions times columns of the block
        out[r["at"]] = r["value"]
    return out.reshape(shape)


def fit_whitening(fit: DataFrame, d: int, components: int, block: int = 8, seed: int = 42, exact: float = 1e-10, at_most: int = 400) -> Whitening:
    """The first ``components`` components of the rows ``x`` of ``fit``, which are taken to be distinct.

    A component is certified once its residual is at most ``exact`` times the gap to its neighbours, or no
    larger than rounding makes it. Without rows, or without variance, the components are the axes and have the value 0.
    """
    n, total, squares, largest = _moments(fit, d) if d else (0, np.zeros(0, object), 0, 0)
    k = min(components, d)
    if not n or not d:
        return Whitening(n, total, largest, 0.0, np.eye(d)[:, :k], np.zeros(k), 0, None)
    mean = np.array([s / n for s in total], float)  # each is rounded once: Python divides long integers exactly
    trace = float(n * squares - sum(s * s for s in total)) / float(n * n)
    if trace == 0:
        return Whitening(n, total, largest, 0.0, np.eye(d)[:, :k], np.zeros(k), 0, None)
    rng = np.random.default_rng(seed)
    q = np.linalg.qr(rng.standard_normal((d, min(d, max(block, 2 * k)))))[0]
    rounding, passes, before = 8 * d * np.finfo(float).eps, 0, None
    while True:
        sent = fit.sparkSession.sparkContext.broadcast((mean, q))

        def product(x: np.ndarray) -> np.ndarray:
            centre, basis = sent.value
            centred = x - centre
            return centred.T @ (centred @ basis)

        y = _summed(fit, q.shape, product, d) / n
        sent.unpersist()
        passes += 1
        h = q.T @ y
        values, u = np.linalg.eigh((h + h.T) / 2)
        values, u = values[::-1], u[:, ::-1]
        z, az = q @ u, y @ u
        residual = np.linalg.norm(az - z * values, axis=0)[:k]
        near = np.concatenate((values, [0.0] * (len(values) < d)))
        gap = np.array([min(abs(near[i] - near[j]) for j in (i - 1, i + 1) if 0 <= j < len(near)) if len(near) > 1 else near[i] for i in range(k)])
        if (residual <= np.maximum(exact * gap, rounding * values[0])).all():
            break
        if passes >= at_most:
            raise RuntimeError(f"components did not settle in {at_most} passes")
        width = q.shape[1]
        worst = float((residual / np.maximum(exact * gap, rounding * values[0])).max())
        rate = min(0.999, max(0.0, values[-1] / values[k - 1])) if values[k - 1] > 0 else 0.0
        if before is not None and worst < before:
            rate = min(rate, worst / before)
        before = worst
        if width < d and (rate == 0 or np.log(worst) / -np.log(rate) > PATIENCE):
            az, before = np.concatenate((az, rng.standard_normal((d, min(d, 2 * width) - width)) * np.linalg.norm(az)), 1), None
        q = np.linalg.qr(az)[0]
    made = Whitening(n, total, largest, trace, z[:, :k], np.maximum(values[:k], 0.0), passes, None)
    return Whitening(**{**made.__dict__, "error": _identity_error(fit, made, mean, d)})


def _identity_error(fit: DataFrame, made: Whitening, mean: np.ndarray, d: int) -> float | None:
    keep = ~np.isnan(made.scales())
    if not keep.any():
        return None
    turn = (made.vectors * made.scales())[:, keep]

    def moments(x: np.ndarray) -> np.ndarray:
        w = (x - mean) @ turn
        return np.concatenate((w.T @ w, w.sum(0)[None]))

    k = turn.shape[1]
    both = _summed(fit, (k + 1, k), moments, d) / made.n
    return float(np.abs(both[:k] - np.outer(both[k], both[k]) - np.eye(k)).max())


def whitened(rows: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", components: int = 4, scale: int = 256) -> DataFrame:
    """``(id_col, component, n, deviation, whitened, explained, identity_error)`` of each row with a sound vector, for each component.

    Entries are taken as whole multiples of ``1 / scale``; the components are those of the distinct vectors, so
    repeated rows weigh nothing and give repeated results. Vectors null or with a null or non-finite entry go, and those of
    another length than the commonest. Of vectors with fewer dimensions than ``components`` all dimensions
    are given. A component without variance has a null ``whitened``; with no variance at all ``explained`` and
    ``identity_error`` are null. Null ids stay; other columns are not read; an empty table gives no rows. An entry or deviation past
    64 bits fails the job.
    """
    found, d = integer_vectors(rows, id_col, vec_col, scale)
    fit = stored(found.select("x").distinct(), "vectors")
    made = fit_whitening(fit, d, components)
    n, k = made.n, made.vectors.shape[1]
    turn, scales = made.vectors, made.scales()
    wide = d * (2 * n * max(1, made.largest)) ** 2 >= 1 << 63
    sums = made.total if wide else made.total.astype(np.int64)
    mean = np.array([s / n for s in made.total], float) if n else np.zeros(d)
    explained = [float(v / made.trace) if made.trace > 0 else None for v in made.values]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for x in _blocks(batch.column(1), d) if d else ():
                own = batch.column(0).slice(at, len(x))
                at += len(x)
                off = n * (x.astype(object) if wide else x) - sums
                deviation = pa.array(np.repeat((off * off).sum(1), k).tolist(), pa.int64())
                w = (x - mean) @ turn * scales
                ids = own.take(pa.array(np.repeat(np.arange(len(x)), k)))
                many = [np.tile(np.arange(1, k + 1, dtype=np.int32), len(x)), np.full(len(x) * k, n, np.int64)]
                rest = [pa.array(w.ravel(), pa.float64(), from_pandas=True), pa.array(explained * len(x), pa.float64()), pa.array([made.error] * (len(x) * k), pa.float64())]
                yield pa.RecordBatch.from_arrays([ids, pa.array(many[0]), pa.array(many[1]), deviation, *rest], names)

    kinds = {"component": T.IntegerType(), "n": T.LongType(), "deviation": T.LongType(), "whitened": T.DoubleType(), "explained": T.DoubleType(), "identity_error": T.DoubleType()}
    schema = T.StructType([T.StructField("id", found.schema["id"].dataType), *(T.StructField(c, t) for c, t in kinds.items())])
    names = schema.names
    return found.mapInArrow(run, schema).withColumnRenamed("id", id_col)


def op13_embedding_whitening(spark, sf_dir: str) -> DataFrame:
    return whitened(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
