import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkloom.functions import rotations as rt
from sparkloom.operators import temporal as tm

QUAT = "array<double>"


def matrix(q):
    x, y, z, w = np.asarray(q) / np.linalg.norm(q)
    return np.array([[1 - 2 * (y * y + z * z), 2 * (x * y - z * w), 2 * (x * z + y * w)], [2 * (x * y + z * w), 1 - 2 * (x * x + z * z), 2 * (y * z - x * w)], [2 * (x * z - y * w), 2 * (y * z + x * w), 1 - 2 * (x * x + y * y)]])


def vector_of(q):
    q = np.asarray(q) / np.linalg.norm(q) * (-1 if q[3] < 0 else 1)
    n = np.linalg.norm(q[:3])
    return q[:3] * (2 if n < 1e-12 else 2 * math.atan2(n, q[3]) / n)


def turn_of(v):
    a = np.linalg.norm(v)
    return np.array([*(v * (0.5 if a < 1e-12 else math.sin(a / 2) / a)), math.cos(a / 2)])


def plain_slerp(a, b, f):
    """By weights of sines, on the side of the shorter arc."""
    a, b = np.asarray(a) / np.linalg.norm(a), np.asarray(b) / np.linalg.norm(b)
    if a @ b < 0:
        b = -b
    w = math.acos(min(1.0, a @ b))
    return a if w < 1e-9 else (math.sin((1 - f) * w) * a + math.sin(f * w) * b) / math.sin(w)


def quats(rng, n):
    q = rng.normal(size=(n, 4))
    return q / np.linalg.norm(q, axis=1, keepdims=True)


def test_rotations(spark):
    rng = np.random.default_rng(3)
    one, half = np.array([0, 0, 0, 1.0]), np.array([0, 0, 1.0, 0])
    a, b = quats(rng, 40), quats(rng, 40)
    a = np.concatenate((a, [one, one, one, one, half, a[0]]))
    b = np.concatenate((b, [one, -one, turn_of(np.array([1e-13, 0, 0])), half, one, -a[0]]))
    f, v = rng.random(len(a)), rng.normal(size=(len(a), 3))
    rows = [(i, x.tolist(), y.tolist(), float(t), p.tolist()) for i, (x, y, t, p) in enumerate(zip(a, b, f, v))] + [(-1, None, one.tolist(), 0.5, [0.0, 0.0, 1.0]), (-2, [0.0] * 4, one.tolist(), 0.5, [0.0, 0.0, 1.0])]
    df = spark.createDataFrame(rows, f"i int, a {QUAT}, b {QUAT}, f double, v {QUAT}")
    a_, b_ = rt.unit(F.col("a")), rt.unit(F.col("b"))
    back, shift = rt.inverse_pose(a_, F.col("v"))
    got = {r.i: r for r in df.select("i", rt.slerp(a_, b_, F.col("f")).alias("s"), rt.vector_blend(a_, b_, F.col("f")).alias("m"), rt.turned(a_, F.col("v")).alias("t"), rt.product(a_, b_).alias("p"), rt.angle_degrees(a_, b_).alias("d"), back.alias("iq"), shift.alias("it"), rt.from_rotation_vector(rt.rotation_vector(a_)).alias("r")).collect()}
    assert got[-1].s is got[-1].p is got[-1].it is None and got[-2].s == [0, 0, 0, 1]
    for i in range(len(a)):
        r = got[i]
        assert np.allclose(matrix(r.s), matrix(plain_slerp(a[i], b[i], f[i])), atol=1e-9)
        assert np.allclose(matrix(r.m), matrix(turn_of((1 - f[i]) * vector_of(a[i]) + f[i] * vector_of(b[i]))), atol=1e-9)
        assert np.allclose(r.t, matrix(a[i]) @ v[i]) and np.allclose(matrix(r.p), matrix(a[i]) @ matrix(b[i])) and np.allclose(matrix(r.r), matrix(a[i]))
        assert r.d == pytest.approx(math.degrees(2 * math.acos(min(1, abs(a[i] @ b[i])))), abs=1e-5)
        assert np.allclose(matrix(r.iq) @ (matrix(a[i]) @ [1, 2, 3] + v[i]) + r.it, [1, 2, 3])


def poses(spark, rows, name="s int, t bigint, name string"):
    return spark.createDataFrame(rows, f"{name}, position {QUAT}, rotation {QUAT}")


def test_interpolated_poses_at_the_ends_and_over_gaps(spark):
    rng = np.random.default_rng(4)
    q, p = quats(rng, 4), rng.normal(size=(4, 3))
    times = [10, 20, 40, 41]
    target = poses(spark, [(1, t, "n", p[i].tolist(), (q[i] * 3).tolist()) for i, t in enumerate(times)])
    asked = [5, 10, 12, 20, 30, 40, 41, 50]
    source = spark.createDataFrame([(1, t, "mine") for t in asked] + [(2, 10, "x"), (1, None, "x")], "s int, t bigint, _p0 string")

    def between(i, j, f, blend):
        turn = plain_slerp(q[i], q[j], f) if blend == "slerp" else turn_of((1 - f) * vector_of(q[i]) + f * vector_of(q[j]))
        return (1 - f) * p[i] + f * p[j], turn

    def check(got, want):
        found = {r.t: r for r in got.collect() if r.s == 1 and r.t is not None}
        assert {t for t, r in found.items() if r.position is not None} == set(want)
        for t, (x, turn) in want.items():
            assert np.allclose(found[t].position, x) and np.allclose(matrix(found[t].rotation), matrix(turn), atol=1e-9)

    first_open = tm.posed(tm.bracket(source, target, "s", "t"), target, "s", "t", "vector", first_ok=False, last_ok=True)
    check(first_open, {12: between(0, 1, 0.2, "vector"), 20: between(1, 1, 0, "vector"), 30: between(1, 2, 0.5, "vector"), 40: between(2, 2, 0, "vector"), 41: between(3, 3, 0, "vector")})
    gap = tm.posed(tm.bracket(source, target, "s", "t", bucket=7, past=True), target, "s", "t", "slerp", first_ok=True, last_ok=False, widest=10)
    check(gap, {10: between(0, 0, 0, "slerp"), 12: between(0, 1, 0.2, "slerp"), 40: between(2, 2, 0, "slerp")})  # 20 stands at the start of a gap
    assert gap.count() == len(asked) + 2 and gap.columns == ["s", "t", "_p0", "prev", "next", "fraction", "position", "rotation"]


def test_remap(spark):
    rng = np.random.default_rng(5)
    q, p = quats(rng, 6), rng.normal(size=(6, 3))

    def rows(s, items):
        return [(s, t, n, p[i].tolist() if i is not None else None, q[i].tolist() if i is not None else None) for t, n, i in items]

    goal = [(10, "a", 0), (20, "b", 0), (30, "c", None), (40, "d", 0)]
    target = poses(spark, rows(1, goal) + rows(2, goal) + rows(3, goal) + rows(4, goal) + rows(5, [(10, "a", None)]) + rows(6, goal))
    source = poses(
        spark,
        rows(1, [(10, "x", 1), (40, "y", 2), (35, "c", 3)])  # the one off the timeline is unavailable: exact
        + rows(2, [(10, "x", 1), (25, "y", 2), (40, "b", None), (45, "z", 3)])  # off the timeline: interpolated
        + rows(3, [(10, "c", 1), (15, "c", 2)])  # nothing left: exact, without poses
        + rows(4, [(5, "x", None)])
        + rows(5, [(10, "a", 1)])
        + rows(6, [(12, "x", 1), (18, "y", 2)]),  # no target row within
    )
    for fill in (True, False):
        got = {(r.s, r.t): r for r in tm.remapped_poses(target, source, "s", "t", "name", fill_missing=fill).collect()}
        assert set(got) == {(1, 10), (1, 40), (2, 10), (2, 40), *([(2, 20)] if fill else [])}
        assert got[1, 10].mode == "exact" and np.allclose(got[1, 40].position, p[2]) and np.allclose(got[1, 40].rotation, q[2]) and got[2, 10].name == "a"
        centre = [-matrix(q[i]).T @ p[i] for i in range(6)]
        for t, i, j, f in ((10, 1, 1, 0), (20, 1, 2, 2 / 3), (40, 2, 3, 0.75)):
            if (2, t) in got:
                world = matrix(plain_slerp(q[i] * [-1, -1, -1, 1], q[j] * [-1, -1, -1, 1], f))
                at = (1 - f) * centre[i] + f * centre[j]
                assert got[2, t].mode == "interpolate" and np.allclose(matrix(got[2, t].rotation), world.T, atol=1e-9) and np.allclose(got[2, t].position, -world.T @ at, atol=1e-9)
