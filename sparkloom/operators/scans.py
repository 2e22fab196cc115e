"""Running products along ordered streams, for any associative step, over many tasks.

Rows are dealt out by ranges of the order. Each task multiplies up its own rows and keeps the result with
them; the driver, which sees one row for each part, carries the product from part to part; and each row is
then combined with what stood before its part, in any order and without a further shuffle. So a stream of any length is many tasks. Steps may
depend on the row before.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkloom.operators.alignment import compose, rotate
from sparkloom.operators.names import free_prefix
from sparkloom.session import stored

Step = Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray]


def products(x: np.ndarray, starts: np.ndarray, combine: Callable) -> np.ndarray:
    """Running products of the rows of ``x``, beginning anew where ``starts``: in blocks side by side, then over the blocks' ends."""
    n, d = x.shape
    width = max(1, int(np.sqrt(n)))
    height = -(-n // width)
    held = np.concatenate((x, np.repeat(x[-1:], height * width - n, 0))).reshape(height, width, d)
    fresh = np.concatenate((starts, np.ones(height * width - n, bool))).reshape(height, width).copy()
    for j in range(1, width):
        made = combine(held[:, j - 1], held[:, j])
        held[:, j] = np.where(fresh[:, j, None], held[:, j], made)
        fresh[:, j] |= fresh[:, j - 1]
    for i in range(1, height):
        made = combine(np.repeat(held[i - 1, -1:], width, 0), held[i])
        held[i] = np.where(fresh[i][:, None], held[i], made)
    return held.reshape(-1, d)[:n]


def running(rows: DataFrame, by: str, order: list[str], inputs: list[str], step: Step, combine: Callable, identity: list[float], names: list[str], down: bool = False) -> DataFrame:
    """``rows`` with ``names``: the product of the steps of a stream's rows up to and with each, in ``order`` (``down``: from its end).

    ``step(before, now, first)`` gives the elements of rows from the inputs of the row before and their own, ``first`` marking a stream's
    first row; ``combine(a, b)`` is the product of ``a`` and then ``b``; both take many rows at once, and ``combine`` must be associative with
    ``identity``. Inputs are doubles, null as NaN. A null stream is a stream. Rows of equal order stand in any order.
    """
    p, d = free_prefix(rows), len(names)
    keys = [F.col(by), *[F.col(o).desc() if down else F.col(o).asc() for o in order]]
    ids, state = f"{p}at", [f"{p}s{i}" for i in range(d)]
    ranged = rows.withColumns({f"{p}i{i}": F.coalesce(F.col(c).cast("double"), F.lit(float("nan"))) for i, c in enumerate(inputs)})
    ranged = ranged.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn(ids, F.monotonically_increasing_id()).withColumn(f"{p}by", F.xxhash64(F.struct(by)))
    schema = T.StructType([*ranged.schema.fields, *(T.StructField(c, T.DoubleType()) for c in state), T.StructField(f"{p}own", T.BooleanType())])
    own_inputs = [f"{p}i{i}" for i in range(len(inputs))]
    ident = np.array(identity, float)

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carry, last_by, last, own = None, None, None, False
        for batch in batches:
            if not batch.num_rows:
                continue
            group = batch.column(f"{p}by").to_numpy()
            now = np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(float) for c in own_inputs], 1)
            before = np.concatenate((now[:1] if last is None else last, now[:-1]))
            starts = np.concatenate(([last_by is not None and group[0] != last_by], group[1:] != group[:-1]))
            elements = step(before, now, starts)
            if carry is None:  # whether it begins a stream, or what stands before it, is not known here
                elements[0] = ident
            found = products(elements, starts, combine)
            reset = np.logical_or.accumulate(starts)
            if carry is not None:
                found = np.where(reset[:, None], found, combine(np.repeat(carry[None], len(found), 0), found))
            reset |= own
            carry, last_by, last, own = found[-1], group[-1], now[-1:], bool(reset[-1])
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(c) for c in found.T), pa.array(reset)], schema.names)

    kept = stored(ranged.mapInArrow(local, schema), "scanned")
    part = F.shiftright(ids, 33).alias("part")
    ends = kept.groupBy(part).agg(F.min_by(F.struct(f"{p}by", F.array(*own_inputs)), ids).alias("first"), F.max_by(F.struct(f"{p}by", F.array(*own_inputs), F.array(*state), f"{p}own"), ids).alias("last"))
    before: dict[int, np.ndarray] = {}
    carry, carry_by, carry_in = ident, None, None
    for r in sorted(ends.collect(), key=lambda r: r["part"]):  # a row for each part
        now = np.array(r["first"][1], float)[None]
        fresh = carry_by is None or r["first"][0] != carry_by
        element = step(now if fresh else carry_in, now, np.array([fresh]))
        before[r["part"]] = element[0] if fresh else combine(carry[None], element)[0]
        total = np.array(r["last"][2], float)
        carry = total if r["last"][3] else combine(before[r["part"]][None], total[None])[0]
        carry_by, carry_in = r["last"][0], np.array(r["last"][1], float)[None]
    sent = rows.sparkSession.sparkContext.broadcast(before)
    keep = [f for f in rows.schema.fields]
    out = T.StructType([*keep, *(T.StructField(c, T.DoubleType()) for c in names)])

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            found = np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(float) for c in state], 1)
            parts = batch.column(ids).to_numpy() >> 33
            front = np.stack([sent.value[k] for k in np.unique(parts)])[np.searchsorted(np.unique(parts), parts)]
            reset = batch.column(f"{p}own").to_numpy(zero_copy_only=False)
            found = np.where(reset[:, None], found, combine(front, found))
            yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in keep), *(pa.array(c, from_pandas=True) for c in found.T)], out.names)

    return kept.mapInArrow(apply, out)


def _affine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """x -> m x + c, one after the other."""
    return np.stack([b[:, 0] * a[:, 0], b[:, 0] * a[:, 1] + b[:, 1]], 1)


def smoothed(rows: DataFrame, by: str, at: str, value: str, tau: float) -> DataFrame:
    """``(by, at, smoothed)``: mean of a forward and a backward exponential pass with alpha = 1 - exp(-dt / tau), over rows by (at, value)."""

    def step(before: np.ndarray, now: np.ndarray, first: np.ndarray) -> np.ndarray:
        alpha = np.where(first, 1.0, 1 - np.exp(-np.abs(now[:, 0] - before[:, 0]) / tau))
        return np.stack([1 - alpha, alpha * now[:, 1]], 1)

    named = rows.select(F.col(by).alias("by"), F.col(at).cast("bigint").alias("at"), F.col(value).cast("double").alias("value"))
    # a whole number is exact as a double up to 2 ** 53
    there = running(named, "by", ["at", "value"], ["at", "value"], step, _affine, [1.0, 0.0], ["m", "ahead"]).drop("m")
    both = running(there, "by", ["at", "value"], ["at", "value"], step, _affine, [1.0, 0.0], ["m", "back"], down=True)
    return both.select(F.col("by").alias(by), F.col("at").alias(at), ((F.col("ahead") + F.col("back")) / 2).alias("smoothed"))


def _latest(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.where(np.isnan(b[:, :1]), a, b)


def _after(before: np.ndarray, now: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The row before, infinite where there is none: that is told from the identity, which is NaN."""
    return np.where(first[:, None], np.inf, before)


def _projective(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products of 3 x 3 matrices, at any scale."""
    made = np.matmul(b.reshape(-1, 3, 3), a.reshape(-1, 3, 3)).reshape(-1, 9)
    return made / np.abs(made).max(1, keepdims=True)


def spline_moments(rows: DataFrame, by: str, at: str, value: str) -> DataFrame:
    """``(by, at, value, moment, next_at, next_value, next_moment)``: second derivatives of the natural cubic spline through each stream, and
    the row after each (nulls at the end).

    The tridiagonal system is solved by running products: elimination is a projective map of (coefficient, right side, 1), and
    substitution back an affine one. Of rows with the same time the least value counts; rows with a null time or value are left out.
    """
    named = rows.select(F.col(by).alias("by"), F.col(at).cast("double").alias("at"), F.col(value).cast("double").alias("value")).where("at is not null and value is not null and not isnan(at) and not isnan(value)")
    named = named.groupBy("by", "at").agg(F.min("value").alias("value"))
    none = [float("nan")] * 2

    ahead = running(named, "by", ["at"], ["at", "value"], _after, _latest, none, ["next_at", "next_value"], down=True)

    def eliminate(before: np.ndarray, now: np.ndarray, first: np.ndarray) -> np.ndarray:
        at, y, to, z = now.T
        last = np.isinf(to)
        edge = first | last
        low = np.where(edge | (at == before[:, 0]), 1.0, at - before[:, 0])  # equal where a part begins: its first row is not used
        up = np.where(edge, 1.0, np.where(last, 1.0, to - at))
        right = np.where(edge, 0.0, 6 * ((np.where(last, 0.0, z) - y) / up - (y - before[:, 1]) / low))
        a, b, c = np.where(edge, 0.0, low), np.where(edge, 1.0, 2 * (low + up)), np.where(edge, 0.0, up)
        zero = np.zeros(len(at))
        made = np.stack([zero, zero, c, zero, -a, right, -a, zero, b], 1)
        return made / np.abs(made).max(1, keepdims=True)

    solved = running(ahead, "by", ["at"], ["at", "value", "next_at", "next_value"], eliminate, _projective, list(np.eye(3).ravel()), [f"p{i}" for i in range(9)])
    reduced = solved.select("by", "at", "value", "next_at", "next_value", (F.col("p2") / F.col("p8")).alias("g"), (F.col("p5") / F.col("p8")).alias("d"))

    def substitute(before: np.ndarray, now: np.ndarray, first: np.ndarray) -> np.ndarray:
        return np.stack([np.where(first, 0.0, -now[:, 0]), now[:, 1]], 1)

    back = running(reduced, "by", ["at"], ["g", "d"], substitute, _affine, [1.0, 0.0], ["m", "moment"], down=True).drop("m", "g", "d")
    full = running(back, "by", ["at"], ["moment"], _after, _latest, none[:1], ["next_moment"], down=True)
    open_ = lambda c: F.when(F.col("next_at") < float("inf"), F.col(c)).alias(c)
    return full.select(F.col("by").alias(by), F.col("at").alias(at), F.col("value").alias(value), "moment", *[open_(c) for c in ("next_at", "next_value", "next_moment")])


def spline(rows: DataFrame, by: str, at: str, value: str, between: int) -> DataFrame:
    """``(by, at, value)`` on the natural cubic spline through each stream: ``between`` points in every step, and the last row."""
    found = spline_moments(rows.select(F.col(by).alias("by"), F.col(at).alias("x"), F.col(value).alias("y")), "by", "x", "y")
    h = F.col("next_x") - F.col("x")
    found = found.withColumnsRenamed({"next_at": "next_x", "next_value": "next_y"})
    steps = F.when(F.col("next_x").isNotNull(), F.sequence(F.lit(0), F.lit(between - 1))).otherwise(F.array(F.lit(0)))
    each = found.withColumn("b", F.explode(steps)).withColumn("b", F.col("b") / between)
    b, a = F.col("b"), 1 - F.col("b")
    inside = a * F.col("y") + b * F.col("next_y") + ((a * a * a - a) * F.col("moment") + (b * b * b - b) * F.col("next_moment")) * h * h / 6
    return each.select(F.col("by").alias(by), F.coalesce(F.col("x") + h * b, F.col("x")).alias(at), F.coalesce(inside, F.col("y")).alias(value))


GAUGE = ["scale", "qx", "qy", "qz", "qw", "tx", "ty", "tz"]


def followed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The similarity ``b`` and then ``a``: rows of scale, unit quaternion and shift."""
    q = compose(a[:, 1:5], b[:, 1:5])
    q /= np.linalg.norm(q, axis=1, keepdims=True)
    return np.concatenate((a[:, :1] * b[:, :1], q, a[:, :1] * rotate(a[:, 1:5], b[:, 5:]) + a[:, 5:]), 1)


def chained_gauges(stages: DataFrame, by: str, order: list[str]) -> DataFrame:
    """``stages`` with ``world_scale, world_qx, ...``: the similarity that takes each stage into the world.

    A row holds, as ``GAUGE``, the similarity from its stage to the next one of its chain, and the last the one into the world. Chains of
    any length are many tasks; quaternions are brought to length one. A null in a row makes its and all earlier stages' nulls.
    """

    def step(before: np.ndarray, now: np.ndarray, first: np.ndarray) -> np.ndarray:
        length = np.linalg.norm(now[:, 1:5], axis=1, keepdims=True)
        return np.concatenate((now[:, :1], now[:, 1:5] / length, now[:, 5:]), 1)

    return running(stages, by, order, GAUGE, step, followed, [1.0, 0, 0, 0, 1, 0, 0, 0], [f"world_{c}" for c in GAUGE], down=True)
