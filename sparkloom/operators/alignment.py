"""Similarities between two sets of matched points, solved from moments.

What a least-squares similarity needs of its points is 17 sums. So a group is aggregated before anything is solved, and a
window along a path is the difference of running sums: its points are never listed. The solution is
the top eigenvector of a 4 x 4 matrix of a quaternion's products, for many groups or windows at once in an
Arrow batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

E, G = ("ex", "ey", "ez"), ("gx", "gy", "gz")
EQ, GQ = ("eqx", "eqy", "eqz", "eqw"), ("gqx", "gqy", "gqz", "gqw")
TASK_ROWS = 20_000
MOMENTS = ["n", *(f"s{c}" for c in E + G), *(f"c{i}{j}" for i in range(3) for j in range(3)), "sq"]


def moments(e: list[Column], g: list[Column]) -> dict[str, Column]:
    """What each matched point adds to the sums named ``MOMENTS``: 1, its coordinates, their products, and its square."""
    values = [F.lit(1.0), *e, *g, *(g[i] * e[j] for i in range(3) for j in range(3)), e[0] * e[0] + e[1] * e[1] + e[2] * e[2]]
    return dict(zip(MOMENTS, values))


def similarities(sums: np.ndarray, with_scale: bool = True, strict: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Scales, unit quaternions (x, y, z, w) and shifts that take e to g with least squares, for rows of the sums ``MOMENTS``.

    Points that all coincide have no scale: NaN. ``strict`` also gives NaN for fewer than three points, for points on a line, and for a
    scale that is not above 0.
    """
    n = sums[:, 0]
    mu_e, mu_g = sums[:, 1:4] / n[:, None], sums[:, 4:7] / n[:, None]
    k = sums[:, 7:16].reshape(-1, 3, 3) - n[:, None, None] * mu_g[:, :, None] * mu_e[:, None, :]
    spread = sums[:, 16] - n * (mu_e**2).sum(1)
    s = k.transpose(0, 2, 1)
    off = np.stack([s[:, 1, 2] - s[:, 2, 1], s[:, 2, 0] - s[:, 0, 2], s[:, 0, 1] - s[:, 1, 0]], 1)
    trace = np.trace(s, axis1=1, axis2=2)
    m = np.empty((len(n), 4, 4))
    m[:, 0, 0], m[:, 0, 1:], m[:, 1:, 0] = trace, off, off
    m[:, 1:, 1:] = s + k - trace[:, None, None] * np.eye(3)
    sound = np.isfinite(m).all((1, 2))
    values, vectors = np.linalg.eigh(np.where(sound[:, None, None], m, 0.0))
    q = vectors[:, [1, 2, 3, 0], 3]
    there = sound & (spread > 1e-14 * np.maximum(sums[:, 16], 1e-300))
    scale = np.where(there, values[:, 3] / np.where(there, spread, 1.0), np.nan) if with_scale else np.where(sound, 1.0, np.nan)
    if strict:
        flat = np.linalg.svd(np.where(sound[:, None, None], k, 0.0), compute_uv=False)
        scale = np.where((n >= 3) & (spread > 0) & (flat[:, 1] > 1e-12 * flat[:, 0]) & (scale > 0), scale, np.nan)
    return scale, q, mu_g - scale[:, None] * rotate(q, mu_e)


def rotate(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Vectors turned by unit quaternions (x, y, z, w), row by row."""
    t = 2 * np.cross(q[:, :3], v)
    return v + q[:, 3:] * t + np.cross(q[:, :3], t)


def compose(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Quaternions ``a`` after ``b``, row by row."""
    return np.concatenate((a[:, 3:] * b[:, :3] + b[:, 3:] * a[:, :3] + np.cross(a[:, :3], b[:, :3]), (a[:, 3] * b[:, 3] - (a[:, :3] * b[:, :3]).sum(1))[:, None]), 1)


def align(e: np.ndarray, g: np.ndarray, with_scale: bool = True, strict: bool = False) -> tuple[float, np.ndarray, np.ndarray]:
    """Scale, quaternion and shift that take the points ``e`` to ``g``."""
    centre_e, centre_g = (e.mean(0), g.mean(0)) if len(e) else (np.zeros(3), np.zeros(3))
    a, b = e - centre_e, g - centre_g
    sums = np.concatenate(([len(e)], a.sum(0), b.sum(0), (b.T @ a).ravel(), [(a * a).sum()]))[None]
    scale, q, shift = similarities(sums, with_scale, strict)
    return float(scale[0]), q[0], shift[0] + centre_g - scale[0] * rotate(q, centre_e[None])[0]


def _table(batch: pa.RecordBatch, names: list[str]) -> np.ndarray:
    return np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(float) for c in names], 1)


def alignments(pairs: DataFrame, group: str, with_scale: bool = True, strict: bool = False) -> DataFrame:
    """``(group, scale, qx, qy, qz, qw, tx, ty, tz, rmse)`` of the similarity that takes each group's ``ex, ey, ez`` to ``gx, gy, gz``.

    Nulls under three points, where they all coincide, or where ``strict`` rejects them. Points with a null coordinate
    are left out. Means, variances and covariances are merged stably from partial aggregates, so no group is collected.
    """
    whole = pairs.select(F.col(group).alias("group"), *E, *G).where(" and ".join(f"{c} is not null" for c in E + G))
    aggs = [F.count("*").cast("double").alias("n"), *[F.avg(c).alias(f"m{c}") for c in E + G]]
    aggs += [F.covar_pop(G[i], E[j]).alias(f"c{i}{j}") for i in range(3) for j in range(3)] + [sum((F.var_pop(c) for c in E[1:]), F.var_pop(E[0])).alias("ve"), sum((F.var_pop(c) for c in G[1:]), F.var_pop(G[0])).alias("vg")]
    sums = pairs.select(F.col(group).alias("group")).distinct().join(whole.groupBy("group").agg(*aggs).withColumnRenamed("group", "own"), F.col("group").eqNullSafe(F.col("own")), "left").drop("own")
    names = ["scale", "qx", "qy", "qz", "qw", "tx", "ty", "tz", "rmse"]
    schema = T.StructType([sums.schema["group"], *(T.StructField(c, T.DoubleType()) for c in names)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, mu_e, mu_g = _table(batch, ["n"])[:, 0], _table(batch, [f"m{c}" for c in E]), _table(batch, [f"m{c}" for c in G])
            cov, var_e, var_g = _table(batch, [f"c{i}{j}" for i in range(3) for j in range(3)]), *_table(batch, ["ve", "vg"]).T
            zero = np.zeros((len(n), 6))
            scale, q, _ = similarities(np.concatenate((n[:, None], zero, cov * n[:, None], (var_e * n)[:, None]), 1), with_scale, strict)
            scale = np.where(n >= 3, scale, np.nan)
            shift = mu_g - scale[:, None] * rotate(q, mu_e)
            # the part of the covariance along the rotation: the trace of R' cov
            along = sum((cov.reshape(-1, 3, 3)[:, :, j] * rotate(q, np.tile(np.eye(3)[j], (len(n), 1)))).sum(1) for j in range(3))
            rmse = np.sqrt(np.maximum(var_g - 2 * scale * along + scale**2 * var_e, 0.0))
            out = np.concatenate((scale[:, None], q, shift, rmse[:, None]), 1)
            out[np.isnan(scale)] = np.nan
            yield pa.RecordBatch.from_arrays([batch.column("group"), *(pa.array(x, pa.float64(), from_pandas=True) for x in out.T)], schema.names)

    return sums.mapInArrow(run, schema).withColumnRenamed("group", group)


def windowed_errors(rows: DataFrame, by: str, key: str, lengths: list[float], least: int = 3) -> DataFrame:
    """``(by, key, w, n, error, rotation)``: for the window of path length ``w`` around each registered row, the similarity that takes the
    registered rows' ``ex, ey, ez`` to ``gx, gy, gz``; the distance left at the row itself, and the angle left in degrees.

    ``rows``: ``by``, ``key``, ``cum_len`` (the path's length so far), both positions, and both rotations as unit quaternions ``eq*``,
    ``gq*`` (null: no ``rotation``). Rows without ``ex`` count for the path alone. Windows are centred, moved at the ends so
    that they keep their width, and hold both their ends; lengths over the path's, and windows of fewer than ``least`` registered
    rows, are left out. A window whose points coincide has a null ``error``.

    Running sums of the moments go over cells of the window's width, so neither a path nor a window is one task: a window is the
    sum up to its end in the last cell it meets, less that before its start in the first, and the sums of the cells from the first on. They are taken about the path's mean, so that they stay small.
    Paths are dealt out to so many tasks that ``TASK_ROWS`` rows and lengths come to one: each becomes several wide rows there, which Spark does not foresee when it merges small parts.
    """
    have = F.col("ex").isNotNull() & F.col("ey").isNotNull() & F.col("ez").isNotNull()
    named = rows.select(F.col(by).alias("path"), F.col(key).alias("key"), F.col("cum_len").cast("double").alias("at"), *E, *G, *EQ, *GQ, have.alias("have"))
    usual = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # one more, as an equal number is taken for a shuffle before it, which Spark may merge
    parts = max(usual + 1, -(-rows.select(by).count() * len(lengths) // TASK_ROWS))
    named = named.repartition(parts, "path")
    ends = named.groupBy(F.col("path").alias("own")).agg(F.max("at").alias("total"), *[F.avg(F.when(F.col("have"), F.col(c))).alias(f"m{c}") for c in E + G])
    near = named.join(ends, F.col("path") == F.col("own")).select("path", "key", "at", "have", "total", *EQ, *GQ, *[(F.col(c) - F.col(f"m{c}")).alias(c) for c in E + G])
    near = near.withColumn("w", F.explode(F.array(*[F.lit(float(x)) for x in lengths]))).where("w <= total")
    lo = F.least(F.greatest(F.col("at") - F.col("w") / 2, F.lit(0.0)), F.col("total") - F.col("w"))
    cell = lambda c: F.floor(c / F.col("w"))
    near = near.withColumn("lo", lo).withColumn("hi", F.col("lo") + F.col("w"))
    own = [F.col(c) for c in (*E, *G, *EQ, *GQ)]
    sums = moments([F.col(c) for c in E], [F.col(c) for c in G])
    points = near.where("have").select("path", "w", cell(F.col("at")).alias("cell"), "at", F.lit(1).alias("kind"), F.lit(None).cast(named.schema["key"].dataType).alias("key"), *[F.lit(None).cast("double").alias(c) for c in (*E, *G, *EQ, *GQ)], *[v.alias(c) for c, v in sums.items()])
    probe = lambda at, kind, with_pose: near.where("have").select("path", "w", cell(F.col(at)).alias("cell"), F.col(at).alias("at"), F.lit(kind).alias("kind"), "key", *(own if with_pose else [F.lit(None).cast("double").alias(c) for c in (*E, *G, *EQ, *GQ)]), *[F.lit(0.0).alias(c) for c in MOMENTS])
    # a row at the start of a window belongs to it, and so does one at its end
    mixed = points.unionByName(probe("lo", 0, False)).unionByName(probe("hi", 2, True))
    upto = Window.partitionBy("path", "w", "cell").orderBy("at", "kind").rowsBetween(Window.unboundedPreceding, 0)
    sign = F.when(F.col("kind") == 0, -1.0).otherwise(1.0)
    cut = mixed.select("path", "w", "key", "kind", *E, *G, *EQ, *GQ, *[(sign * F.sum(c).over(upto)).alias(c) for c in MOMENTS]).where("kind <> 1").drop("kind")
    whole = points.groupBy(F.col("path").alias("p"), F.col("w").alias("v"), F.col("cell").alias("full")).agg(*[F.sum(c).alias(c) for c in MOMENTS])
    spans = near.where("have").select("path", "w", "key", F.explode(F.sequence(cell(F.col("lo")), cell(F.col("hi")))).alias("cell"), cell(F.col("hi")).alias("last")).where("cell < last")
    over = spans.join(whole, (F.col("path") == F.col("p")) & (F.col("w") == F.col("v")) & (F.col("cell") == F.col("full"))).select("path", "w", "key", *[F.lit(None).cast("double").alias(c) for c in (*E, *G, *EQ, *GQ)], *MOMENTS)
    pose = [F.max(c).alias(c) for c in (*E, *G, *EQ, *GQ)]
    windows = cut.unionByName(over).groupBy("path", "w", "key").agg(*pose, *[F.sum(c).alias(c) for c in MOMENTS]).where(F.round("n") >= least)

    kinds = {"n": T.LongType(), "error": T.DoubleType(), "rotation": T.DoubleType()}
    schema = T.StructType([windows.schema["path"], windows.schema["key"], windows.schema["w"], *(T.StructField(c, k) for c, k in kinds.items())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sums = _table(batch, MOMENTS)
            sums[:, 0] = np.round(sums[:, 0])
            scale, q, shift = similarities(sums)
            e, g = _table(batch, list(E)), _table(batch, list(G))
            error = np.linalg.norm(scale[:, None] * rotate(q, e) + shift - g, axis=1)
            eq, gq = (_sound(_table(batch, list(c))) for c in (EQ, GQ))
            left = compose(compose(q, eq), gq * [-1, -1, -1, 1])
            angle = np.degrees(2 * np.arctan2(np.linalg.norm(left[:, :3], axis=1), np.abs(left[:, 3])))
            angle[np.isnan(scale)] = np.nan
            made = [pa.array(sums[:, 0].astype(np.int64)), *(pa.array(x, pa.float64(), from_pandas=True) for x in (error, angle))]
            yield pa.RecordBatch.from_arrays([batch.column("path"), batch.column("key"), batch.column("w"), *made], schema.names)

    return windows.mapInArrow(run, schema).select(F.col("path").alias(by), F.col("key").alias(key), "w", "n", "error", "rotation")


def _sound(q: np.ndarray) -> np.ndarray:
    """At length one; the identity where there is no length."""
    length = np.linalg.norm(q, axis=1, keepdims=True)
    return np.where(length < 1e-12, [0.0, 0.0, 0.0, 1.0], q / np.where(length < 1e-12, 1.0, length))
