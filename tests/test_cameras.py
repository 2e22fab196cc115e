import numpy as np
from pyspark.sql import functions as F

from sparkloom.functions import cameras as cam

PARAMS = {
    "SIMPLE_PINHOLE": [500.0, 320, 240],
    "PINHOLE": [500.0, 510, 320, 240],
    "SIMPLE_RADIAL": [500.0, 320, 240, -0.12],
    "RADIAL": [500.0, 320, 240, 0.1, -0.03],
    "OPENCV": [500.0, 505, 320, 240, -0.2, 0.05, 1e-3, -2e-3],
    "FULL_OPENCV": [500.0, 505, 320, 240, 0.2, 0.05, 1e-3, -2e-3, 0.01, 0.25, -0.02, 0.003],
    "SIMPLE_DIVISION": [500.0, 320, 240, -0.15],
    "DIVISION": [500.0, 505, 320, 240, 0.1],
    "OPENCV_FISHEYE": [400.0, 405, 320, 240, 0.02, -0.01, 0.003, -0.001],
}


def plain(model, p, point):
    """By each model's formula, on numbers."""
    u, v = point[0] / point[2], point[1] / point[2]
    n = cam.MODELS[model].focals
    fx, fy, cx, cy, k = p[0], p[n - 1], p[n], p[n + 1], p[n + 2 :]
    s = u * u + v * v
    x, y = u, v
    if "RADIAL" in model:
        f = 1 + k[0] * s + (k[1] * s * s if model == "RADIAL" else 0)
        x, y = u * f, v * f
    elif "OPENCV" == model[-6:]:
        f = 1 + k[0] * s + k[1] * s**2
        if model == "FULL_OPENCV":
            f = (f + k[4] * s**3) / (1 + k[5] * s + k[6] * s**2 + k[7] * s**3)
        x, y = u * f + 2 * k[2] * u * v + k[3] * (s + 2 * u * u), v * f + 2 * k[3] * u * v + k[2] * (s + 2 * v * v)
    elif "DIVISION" in model:
        # the radius at which r / (1 + k r^2) is the undistorted one
        roots = np.roots([k[0] * np.sqrt(s), -1, np.sqrt(s)]) if s else [0]
        r = min((z.real for z in np.atleast_1d(roots) if abs(np.imag(z)) < 1e-12 and np.real(z) >= 0), default=np.nan)
        x, y = (u * r / np.sqrt(s), v * r / np.sqrt(s)) if s else (0.0, 0.0)
    elif model == "OPENCV_FISHEYE":
        r = np.sqrt(s)
        t = np.arctan(r)
        d = t + sum(c * t ** (2 * i + 3) for i, c in enumerate(k))
        x, y = (u * d / r, v * d / r) if r else (0.0, 0.0)
    return np.array([fx * x + cx, fy * y + cy])


def test_every_model_both_ways(spark):
    rng = np.random.default_rng(1)
    rows = []
    for model, p in PARAMS.items():
        points = [*rng.uniform([-0.6, -0.5, 0.8], [0.6, 0.5, 1.5], (25, 3)), np.array([0.0, 0, 2]), np.array([1e-6, -1e-6, 1]), np.array([0.1, 0.1, 0]), np.array([0.1, 0.1, -1])]
        rows += [(model, [float(x) for x in p], [float(x) for x in point]) for point in points]
    rows += [("RADIAL", None, [0.0, 0.0, 1.0]), ("NONE", [1.0], [0.0, 0.0, 1.0])]
    df = spark.createDataFrame(rows, "model string, params array<double>, point array<double>").withColumn("i", F.monotonically_increasing_id())
    m, p = F.col("model"), F.col("params")
    df = df.withColumn("px", cam.by_model(m, lambda n: cam.project(n, p, F.col("point"))))
    back = cam.by_model(m, lambda n: cam.unproject(n, p, F.col("px")[0], F.col("px")[1]))
    got = df.select("*", back.alias("uv"), cam.by_model(m, lambda n: cam.projection_jacobian(n, p, F.col("point"))).alias("j"), cam.by_model(m, lambda n: cam.undistorted(n, p, F.col("px")[0], F.col("px")[1])).alias("flat"), cam.by_model(m, lambda n: cam.sound_params(n, p)).alias("ok")).collect()
    assert len(got) == len(rows)
    for r in got:
        if r.params is None or r.model == "NONE" or r.point[2] <= 0:
            assert r.px is r.uv is r.j is r.flat is None
            continue
        point = np.array(r.point)
        assert np.allclose(r.px, plain(r.model, r.params, point), atol=1e-8), r
        assert np.allclose(r.uv, point[:2] / point[2], atol=1e-9), r
        n = cam.MODELS[r.model].focals
        assert r.ok and np.allclose(r.flat, point[:2] / point[2] * [r.params[0], r.params[n - 1]] + r.params[n : n + 2], atol=1e-6)
        h = 1e-6
        slope = np.stack([(plain(r.model, r.params, point + d) - plain(r.model, r.params, point - d)) / (2 * h) for d in h * np.eye(3)], 1)
        assert np.allclose(np.array(r.j).reshape(2, 3), slope, atol=2e-3, rtol=1e-5), r


def test_pixels_that_no_ray_gives_are_null(spark):
    rows = [("SIMPLE_RADIAL", [100.0, 0, 0, -0.3], 90.0), ("OPENCV_FISHEYE", [100.0, 100, 0, 0, 0, 0, 0, 0], 400.0), ("DIVISION", [100.0, 100, 0, 0, -1.0], 150.0), ("SIMPLE_RADIAL", [-100.0, 0, 0, -0.3], 1.0)]
    df = spark.createDataFrame([(m, [float(x) for x in p], x) for m, p, x in rows], "model string, params array<double>, x double")
    m, p = F.col("model"), F.col("params")
    got = df.select(cam.by_model(m, lambda n: cam.unproject(n, p, F.col("x"), F.lit(0.0))).alias("uv"), cam.by_model(m, lambda n: cam.sound_params(n, p)).alias("ok")).collect()
    assert [r.uv for r in got[:3]] == [None] * 3 and [r.ok for r in got] == [True, True, True, False]
