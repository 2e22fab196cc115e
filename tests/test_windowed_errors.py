from collections import defaultdict

import numpy as np
import pytest

from sparkloom.operators.alignment import align, alignments, similarities, windowed_errors
from sparkloom.plans import catalog

DATA = "/root/testdata/sf0.001"
COLUMNS = ["ex", "ey", "ez", "gx", "gy", "gz", "eqx", "eqy", "eqz", "eqw", "gqx", "gqy", "gqz", "gqw"]
SCHEMA = "path bigint, row bigint, cum_len double, " + ", ".join(f"{c} double" for c in COLUMNS)


def matrix(q):
    x, y, z, w = np.asarray(q) / np.linalg.norm(q)
    return np.array([[1 - 2 * (y * y + z * z), 2 * (x * y - z * w), 2 * (x * z + y * w)], [2 * (x * y + z * w), 1 - 2 * (x * x + z * z), 2 * (y * z - x * w)], [2 * (x * z - y * w), 2 * (y * z + x * w), 1 - 2 * (x * x + y * y)]])


def solved(e, g):
    """Scale, rotation and shift by the polar factor of the cross covariance."""
    a, b = e - e.mean(0), g - g.mean(0)
    left, _, right = np.linalg.svd(b.T @ a)
    r = left @ np.diag([1, 1, np.sign(np.linalg.det(left @ right))]) @ right
    s = np.trace(r.T @ b.T @ a) / (a * a).sum()
    return s, r, g.mean(0) - s * r @ e.mean(0)


def left_over(own, there, at):
    """Distance and angle left at row ``at`` after the best similarity of the rows ``there``."""
    e, g = own[:, :3], own[:, 3:6]
    s, r, t = solved(e[there], g[there])
    off = r @ matrix(own[at, 6:10]) @ matrix(own[at, 10:]).T
    return np.linalg.norm(s * r @ e[at] + t - g[at]), np.degrees(np.arctan2(np.linalg.norm([off[2, 1] - off[1, 2], off[0, 2] - off[2, 0], off[1, 0] - off[0, 1]]), np.trace(off) - 1))


def plain(paths, lengths, least=3):
    want = {}
    for s, (keys, o, own) in paths.items():
        have = ~np.isnan(own[:, 0])
        for w in lengths:
            for i in np.flatnonzero(have) if o[-1] >= w else ():
                lo = min(max(o[i] - w / 2, 0.0), o[-1] - w)
                there = np.flatnonzero((o >= lo) & (o <= lo + w) & have)
                if len(there) >= least:
                    error, angle = left_over(own, there, i)
                    flat = np.linalg.svd(own[there, 3:6] - own[there, 3:6].mean(0), compute_uv=False)[1] < 1e-6
                    want[s, keys[i], w] = (len(there), error, None if flat else angle)  # on a line, turns about it are all as good
    return want


def agree(got, want, tolerance):
    found = {(r[0], r[1], r.w): (r.n, r.error, r.rotation) for r in got}
    assert found.keys() == want.keys() and len(got) == len(want)
    for k in want:
        assert found[k][0] == want[k][0] and found[k][1] == pytest.approx(want[k][1], abs=tolerance), k
        assert want[k][2] is None or found[k][2] == pytest.approx(want[k][2], abs=tolerance), k


def test_all_streams_are_scored(spark):
    streams, paths = defaultdict(list), {}
    for r in spark.read.parquet(f"{DATA}/events.parquet").selectExpr("user_id s", "unix_micros(cast(ts as timestamp)) t", "event_id k", "value v").collect():
        streams[r.s].append((r.t, r.k, r.v))
    for s, rows in streams.items():
        rows.sort()
        k, v = np.array([x[1] for x in rows]), np.array([x[2] for x in rows])
        o = np.round(np.concatenate(([0.0], np.cumsum(np.abs(np.diff(v))))), 3)
        g, near, zero = np.stack([v, np.sin(v), np.cos(o)], 1), np.sin(k.astype(float)), np.zeros(len(v))
        e = np.stack([2 * v + 1 + 0.01 * near, 2 * g[:, 1] - 3, 2 * g[:, 2]], 1)
        turns = np.stack([zero, np.sin(v / 100), zero, np.cos(v / 100), np.sin(near / 50), zero, zero, np.cos(near / 50)], 1)
        paths[s] = (k.tolist(), o, np.concatenate((e, g, turns), 1))
    got = catalog.QUERIES["w3_windowed_similarity_error"](spark, DATA).collect()
    agree(got, plain(paths, [60.0, 240.0]), 1e-6)


def test_long_path_with_gaps_repeats_and_far_from_the_origin(spark):
    rng = np.random.default_rng(3)
    paths, rows = {}, []
    for s, n in ((1, 400), (2, 40), (3, 2), (4, 12)):
        g = np.cumsum(rng.normal(size=(n, 3)) * (rng.random((n, 1)) > 0.2), 0) + [4.5e5, 5.2e6, 300]
        q = np.linalg.qr(rng.normal(size=(3, 3)))[0]
        q *= np.sign(np.linalg.det(q))
        e = 0.4 * (g + rng.normal(size=(n, 3)) * 0.02) @ q.T + [1, -2, 3]
        turns = rng.normal(size=(n, 8))
        turns[:, :4] /= np.linalg.norm(turns[:, :4], axis=1, keepdims=True)
        turns[:, 4:] /= np.linalg.norm(turns[:, 4:], axis=1, keepdims=True)
        own = np.concatenate((e, g, turns), 1)
        own[rng.random(n) < 0.1, :3] = np.nan
        if s == 4:  # a camera that stands still has no scale
            own[:, :3] = 7.0
        o = np.concatenate(([0.0], np.cumsum(np.linalg.norm(np.diff(g, axis=0), axis=1))))
        paths[s] = (list(range(n)), o, own)
        rows += [(s, i, float(o[i]), *[None if np.isnan(x) else float(x) for x in own[i]]) for i in range(n)]
    got = windowed_errors(spark.createDataFrame(rows, SCHEMA), "path", "row", [2.0, 5.0, 1000.0]).collect()
    assert {r.path for r in got} == {1, 2, 4} and all(r.error is None and r.rotation is None for r in got if r.path == 4)
    del paths[4]
    agree([r for r in got if r.path != 4], plain(paths, [2.0, 5.0, 1000.0]), 1e-4)


def test_alignments_and_degenerate_points(spark):
    rng = np.random.default_rng(5)
    q = np.linalg.qr(rng.normal(size=(3, 3)))[0]
    q *= np.sign(np.linalg.det(q))
    e = rng.normal(size=(20, 3))
    groups = {1: (e, 2.5 * e @ q.T + (1, 2, 3)), 2: (e, e * [1, 1, -1]), 3: (e[:2], e[:2]), 4: (e * 0 + 1, e), 5: (np.outer(range(6), [1, 2, 3.0]), np.outer(range(6), [3, 2, 1.0])), 6: (e + 3e6, 2.5 * e @ q.T)}
    rows = [(k, *map(float, (*a, *b))) for k, (x, y) in groups.items() for a, b in zip(x, y)] + [(1, None, 1.0, 1.0, 1.0, 1.0, 1.0), (None, *[1.0] * 6)]
    frame = spark.createDataFrame(rows, "k int, ex double, ey double, ez double, gx double, gy double, gz double")
    for strict in (False, True):
        got = {r.k: r for r in alignments(frame, "k", strict=strict).collect()}
        assert got.keys() == {1, 2, 3, 4, 5, 6, None} and got[3].scale is got[4].scale is got[None].scale is None
        assert (got[5].scale is None) == strict
        for k in (1, 2, 6):
            s, r, t = solved(*map(np.asarray, groups[k]))
            x, y = groups[k]
            assert got[k].scale == pytest.approx(s, rel=1e-7) and np.allclose(matrix([got[k].qx, got[k].qy, got[k].qz, got[k].qw]), r, atol=1e-7)
            assert got[k].rmse == pytest.approx(np.sqrt(((s * x @ r.T + t - y) ** 2).sum(1).mean()), abs=1e-6)
    s, turn, t = align(e, 2.5 * e @ q.T + (1, 2, 3))
    assert s == pytest.approx(2.5) and np.allclose(matrix(turn), q) and np.allclose(t, (1, 2, 3))
    assert np.isnan(align(e[:2], e[:2], strict=True)[0]) and align(e, 3 * e, with_scale=False)[0] == 1
    assert similarities(np.zeros((0, 17)))[0].shape == (0,)
