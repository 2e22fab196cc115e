import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkloom.operators import rasters
from sparkloom.operators.inliers import InlierOptions, inlier_matches

MATCH = "pair int, row int, x1 double, y1 double, x2 double, y2 double, ray1 array<double>, ray2 array<double>, jac1 array<double>, jac2 array<double>, _pair string"
PAIR = "pair int, kind string, q array<double>, t array<double>, f1 double, f2 double, matrix array<double>"
FX = 500.0


def matrix(q):
    x, y, z, w = q
    return np.array([[1 - 2 * (y * y + z * z), 2 * (x * y - z * w), 2 * (x * z + y * w)], [2 * (x * y + z * w), 1 - 2 * (x * x + z * z), 2 * (y * z - x * w)], [2 * (x * z - y * w), 2 * (y * z + x * w), 1 - 2 * (x * x + y * y)]])


def cross(t):
    return np.array([[0, -t[2], t[1]], [t[2], 0, -t[0]], [-t[1], t[0], 0]])


def plain_calibrated(q, t, rows, o):
    """Row by row, with depths from the normal equations of the two rays."""
    r = matrix(q)
    e = cross(t) @ r
    out = []
    for row in rows:
        a, b = np.array(row[6]), np.array(row[7])
        if row[8] is None:
            l2, l1 = e @ a / (1e-12 + a[2]), e.T @ b / (1e-12 + b[2])
            error, limit = (l2 @ b) ** 2 / ((l2[:2] ** 2).sum() + (l1[:2] ** 2).sum()), (o.essential / FX) ** 2
        else:
            j1, j2 = np.array(row[8]).reshape(3, 2), np.array(row[9]).reshape(3, 2)
            error, limit = (b @ e @ a) ** 2 / ((b @ e @ j1 @ j1.T @ e.T @ b) + (a @ e.T @ j2 @ j2.T @ e @ a)), o.essential**2
        depths = np.linalg.lstsq(np.stack([r @ a, -b], 1), -np.array(t), rcond=None)[0]
        front = (depths > o.nearest).all() and (depths < o.farthest).all()
        e12, e21 = np.array(t) / np.linalg.norm(t), -r.T @ t / np.linalg.norm(t)
        e12, e21 = (-v if v[2] < 0 else v for v in (e12, e21))
        near = math.cos(math.radians(o.epipole_degrees)) + 1e-6
        if error < limit and front and a @ e21 < near and b @ e12 < near:
            out.append(row[1])
    return out


def ray(x, y):
    v = np.array([(x - 320) / FX, (y - 240) / FX, 1.0])
    return (v / np.linalg.norm(v)).tolist()


def test_each_kind_of_pair(spark):
    rng, rows, pairs, want = np.random.default_rng(2), [], [], {}
    options = InlierOptions()
    for pair in (1, 2):  # calibrated: points in front, behind, far off the line, at the epipole; the second pair with tangent errors
        q = np.array([0.02, -0.05, 0.01, 1.0])
        q, t = (q / np.linalg.norm(q)).tolist(), [0.3, 0.1, 1.0]
        own = []
        for i in range(120):
            p = rng.uniform([-2, -2, 2], [2, 2, 9]) * (-1 if i % 10 == 0 else 1)
            if i % 15 == 1:
                p = (-matrix(q).T @ t) * rng.uniform(-9, 9) + rng.normal(size=3) * 0.05
            s = matrix(q) @ p + t
            x1, y1, x2, y2 = p[0] / p[2] * FX + 320, p[1] / p[2] * FX + 240, s[0] / s[2] * FX + 320, s[1] / s[2] * FX + 240
            x2, y2 = x2 + rng.normal() * (40 if i % 7 == 0 else 1), y2 + rng.normal() * (40 if i % 7 == 0 else 1)
            jac = [rng.normal(size=6).tolist() for _ in "ab"] if pair == 2 else [None, None]
            own.append((pair, i, x1, y1, x2, y2, ray(x1, y1), ray(x2, y2), *jac, "mine"))
        rows += own
        pairs.append((pair, "calibrated", q, t, FX, FX, None))
        want[pair] = plain_calibrated(q, t, own, options)
    f = [0.0, 1e-4, -0.1, -1e-4, 0.0, -1.0, 1e-3, 1.0, 3.0]
    row0, row2 = np.array(f[:3]), np.array(f[6:])
    e = np.cross(row0, row2)
    for pair, lead in ((3, 5), (4, 0), (5, -4), (6, None)):  # orientations: more of one, as many of both, more of the other, all
        signs = {1: [], -1: []}
        while min(map(len, signs.values())) < 40:
            x1, y1, x2 = rng.uniform([0, 0, 0], [600, 480, 600])
            a, b, c = np.array(f).reshape(3, 3) @ [x1, y1, 1]
            y2 = -(a * x2 + c) / b
            sign = (f[0] * x2 + f[3] * y2 + f[6]) * (e[1] - e[2] * y1)
            signs[1 if sign > 0 else -1].append((x1, y1, x2, y2))
        keep = signs[1][:40] if lead is None else signs[1][: 10 + max(lead, 0)] + signs[-1][: 10 + max(-lead, 0)]
        own = [(pair, i, *p, None, None, None, None, "m") for i, p in enumerate(keep)] + [(pair, 900 + i, 10.0 * i, 3.0, 10.0 * i, 400.0, None, None, None, None, "m") for i in range(9)]
        rows += own
        pairs.append((pair, "uncalibrated", None, None, None, None, f))
        want[pair] = [] if lead == 0 else [i for i, p in enumerate(keep) if lead is None or (p in signs[1]) == (lead > 0)]
    h = [1.0, 0.02, -30.0, 0.01, 1.0, 4.0, 1e-5, 2e-5, 1.0]
    for i in range(60):
        x1, y1 = rng.uniform(0, 500, 2)
        z = np.array(h).reshape(3, 3) @ [x1, y1, 1]
        off = rng.normal(size=2) * 4
        rows.append((7, i, x1, y1, z[0] / z[2] + off[0], z[1] / z[2] + off[1], None, None, None, None, "m"))
        want.setdefault(7, []).extend([i] * int(off @ off < 16))
    pairs.append((7, "planar", None, None, None, None, h))
    rows += [(8, 0, 1.0, 1.0, 1.0, 1.0, None, None, None, None, "m"), (7, 99, None, 1.0, 1.0, 1.0, None, None, None, None, "m"), (1, 99, 1.0, 1.0, 1.0, 1.0, None, None, None, None, "m")]
    rows = [tuple(float(v) if isinstance(v, np.floating) else v for v in r) for r in rows]
    frame = spark.createDataFrame(rows, MATCH)
    got = inlier_matches(frame, spark.createDataFrame(pairs, PAIR), "pair", options)
    assert got.columns == frame.columns
    found = {}
    for r in got.collect():
        found.setdefault(r.pair, []).append(r.row)
    assert {k: sorted(v) for k, v in found.items()} == {k: sorted(v) for k, v in want.items() if v}
    assert 20 < len(want[1]) < 110 and len(want[2]) > 5 and not want[4] and len(want[7]) > 10
    with pytest.raises(Exception, match="pair without the geometry of its kind: 9"):
        inlier_matches(frame, spark.createDataFrame([(9, "calibrated", None, [1.0, 0.0, 0.0], 1.0, 1.0, None)], PAIR), "pair", options).collect()
    with pytest.raises(ValueError):
        InlierOptions(essential=-1)


def test_maps_at_points(spark):
    rng = np.random.default_rng(6)
    maps = {1: rng.normal(size=(45, 70)).astype(np.float32).astype(float), 2: rng.normal(size=(1, 3)), 3: rng.normal(size=(33, 32)), 4: rng.normal(size=(64, 65))}
    cells = [(k, x, y, float(m[y, x]), int(m[y, x] > 0)) for k, m in maps.items() for y in range(m.shape[0]) for x in range(m.shape[1])]
    sizes = [(k, m.shape[1], m.shape[0], 4 * m.shape[1], 2 * m.shape[0]) for k, m in maps.items()]
    points = []
    for k, m in maps.items():
        h, w = m.shape
        points += [(k, float(x), float(y)) for x in (0, 0.25, 31, 31.5, 32, 32.75, w - 1, w - 0.75, -0.25, -0.5, -2, w + 3) for y in (0, 31, 31.5, 32, h - 1, h - 0.5, -0.5, -1.0, h, 1e12)]
        points += [(k, *map(float, p)) for p in rng.uniform([-2, -2], [w + 2, h + 2], (60, 2))]
    points += [(1, None, 1.0), (1, float("nan"), 1.0), (9, 1.0, 1.0), (None, 1.0, 1.0)]
    frame = spark.createDataFrame([(i, *p, "mine") for i, p in enumerate(points)], "id int, map int, px double, py double, tx string")
    sized = spark.createDataFrame(sizes, "map int, width int, height int, original_width int, original_height int")
    tiled = rasters.tiles(spark.createDataFrame(cells, "map int, x int, y int, depth double, valid int"), sized, "map", ["depth", "valid"]).persist()

    def value(m, x, y, edge):
        h, w = m.shape
        at = lambda i, j: m[j, i] if 0 <= i < w and 0 <= j < h else 0.0
        if edge == "clamp":
            x, y = min(max(x, 0), w - 1), min(max(y, 0), h - 1)
            near = at(min(math.floor(x + 0.5), w - 1), min(math.floor(y + 0.5), h - 1))
        else:
            near = at(round(x), round(y))
        i, j = math.floor(x), math.floor(y)
        u, v = x - i, y - j
        return at(i, j) * (1 - u) * (1 - v) + at(i + 1, j) * u * (1 - v) + at(i, j + 1) * (1 - u) * v + at(i + 1, j + 1) * u * v, near > 0

    for edge in ("clamp", "zero"):
        got = rasters.sampled(frame, tiled, "map", F.col("px"), F.col("py"), {"d": "depth"}, {"ok": "valid"}, edge).collect()
        assert len(got) == len(points) and got[0].tx == "mine"
        for r in got:
            k, x, y = points[r.id]
            if k not in maps or x is None or math.isnan(x):
                assert r.d is None and r.ok is None
                continue
            d, ok = value(maps[k], x, y, edge)
            assert r.d == pytest.approx(d, abs=1e-12) and bool(r.ok) == ok, (k, x, y, edge)
    keys = frame.select("id", "map", (F.col("px") * 4).alias("x"), (F.col("py") * 2).alias("y"))
    got = {r.id: r for r in rasters.attached_depth(keys, tiled, sized, "map", 0.5).collect()}
    for i, (k, x, y) in enumerate(points):
        if k in maps and x is not None and not math.isnan(x):
            d, ok = value(maps[k], x, y, "zero")
            assert (got[i].depth, got[i].stddev, got[i].valid) == (pytest.approx(d, abs=1e-12), pytest.approx(d / 2, abs=1e-12), ok)
    with pytest.raises(Exception, match="original image size"):
        rasters.attached_depth(keys, tiled, sized.withColumn("original_width", F.lit(0)), "map", 0.5).collect()
    with pytest.raises(Exception, match="missing or repeated"):
        rasters.tiles(spark.createDataFrame(cells[1:], "map int, x int, y int, depth double, valid int"), sized, "map", ["depth"]).collect()
