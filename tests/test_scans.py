import numpy as np
import pytest

from sparkloom.operators import alignment, scans


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema).repartition(5)


def test_running_products_of_any_length(spark):
    rng = np.random.default_rng(1)
    streams = {1: 1000, 2: 1, 3: 37, None: 12}
    rows = [(k, i, float(rng.normal()), "mine") for k, n in streams.items() for i in range(n)]

    def step(before, now, first):
        return np.where(first[:, None], [[0.0, 1.0]], np.stack([0.9 * np.ones(len(now)), now[:, 0] - before[:, 0]], 1))

    df = frame(spark, rows, "s int, i int, v double, _at string")
    for down in (False, True):
        got = scans.running(df, "s", ["i"], ["v"], step, scans._affine, [1.0, 0.0], ["m", "c"], down=down)
        assert got.columns == ["s", "i", "v", "_at", "m", "c"]
        found = {(r.s, r.i): r.c for r in got.collect()}
        assert len(found) == len(rows)
        for k, n in streams.items():
            v = {r[1]: r[2] for r in rows if r[0] == k}
            now = None
            for i in range(n - 1, -1, -1) if down else range(n):
                now = 1.0 if now is None else 0.9 * now + v[i] - v[i + 1 if down else i - 1]
                assert found[k, i] == pytest.approx(now, abs=1e-9)
    assert scans.running(df.where("s = 9"), "s", ["i"], ["v"], step, scans._affine, [1.0, 0.0], ["m", "c"]).count() == 0


def test_smoothing_equals_two_loops(spark):
    rng = np.random.default_rng(2)
    t = np.sort(rng.integers(0, 5000, 700))
    v = rng.normal(size=700)
    got = scans.smoothed(frame(spark, [(1, int(a), float(b)) for a, b in zip(t, v)] + [(2, 5, 1.5)], "s int, t bigint, v double"), "s", "t", "v", 9.0).collect()
    order = np.lexsort((v, t))
    t, v = t[order], v[order]
    ahead, back = v.copy(), v.copy()
    for i in range(1, 700):
        ahead[i] = ahead[i - 1] + (1 - np.exp(-(t[i] - t[i - 1]) / 9)) * (v[i] - ahead[i - 1])
        j = 699 - i
        back[j] = back[j + 1] + (1 - np.exp(-(t[j + 1] - t[j]) / 9)) * (v[j] - back[j + 1])
    assert sorted(r.smoothed for r in got if r.s == 1) == pytest.approx(sorted((ahead + back) / 2), abs=1e-9) and [r.smoothed for r in got if r.s == 2] == [1.5]


def test_spline_equals_the_whole_system(spark):
    rng = np.random.default_rng(3)
    streams = {1: 600, 2: 2, 3: 1, 4: 3}
    data = {k: (np.cumsum(rng.uniform(0.1, 3, n)), rng.normal(size=n)) for k, n in streams.items()}
    rows = [(k, float(a), float(b)) for k, (t, y) in data.items() for a, b in zip(t, y)] + [(1, None, 1.0), (1, 5.0, None)]
    df = frame(spark, rows, "s int, t double, v double")
    moments = {(r.s, r.t): r for r in scans.spline_moments(df, "s", "t", "v").collect()}
    points = scans.spline(df, "s", "t", "v", 3).collect()
    assert len(moments) == 606
    for k, (t, y) in data.items():
        n, h = len(t), np.diff(t)
        m, right = np.eye(n), np.zeros(n)
        for i in range(1, n - 1):
            m[i, i - 1 : i + 2] = h[i - 1], 2 * (h[i - 1] + h[i]), h[i]
            right[i] = 6 * ((y[i + 1] - y[i]) / h[i] - (y[i] - y[i - 1]) / h[i - 1])
        want = np.linalg.solve(m, right)
        assert [moments[k, a].moment for a in t] == pytest.approx(want, abs=1e-9)
        assert [moments[k, a].next_moment for a in t] == [*map(lambda x: pytest.approx(x, abs=1e-9), want[1:]), None]
        own = sorted((r.t, r.v) for r in points if r.s == k)
        assert len(own) == 3 * (n - 1) + 1 and own[-1] == (t[-1], y[-1])
        x, i = np.array([p[0] for p in own[:-1]]), np.repeat(np.arange(n - 1), 3)
        b = (x - t[i]) / h[i] if n > 1 else x
        a = 1 - b
        made = a * y[i] + b * y[i + 1] + ((a**3 - a) * want[i] + (b**3 - b) * want[i + 1]) * h[i] ** 2 / 6 if n > 1 else x
        assert [p[1] for p in own[:-1]] == pytest.approx(list(made), abs=1e-9)


def test_chained_gauges_equal_a_fold(spark):
    rng = np.random.default_rng(4)
    rows, want = [], {}
    for k, n in ((1, 300), (2, 1), (3, 5)):
        s, q, t = rng.uniform(0.9, 1.1, n), rng.normal(size=(n, 4)), rng.normal(size=(n, 3))
        rows += [(k, i, float(s[i]), *map(float, (*q[i], *t[i]))) for i in range(n)]
        q /= np.linalg.norm(q, axis=1, keepdims=True)
        point = rng.normal(size=3)
        for i in range(0, n, 7):  # a point of stage i, taken on stage by stage
            x = point
            for j in range(i, n):
                x = s[j] * alignment.rotate(q[j : j + 1], x[None])[0] + t[j]
            want[k, i] = (point, x)
    got = {(r.chain, r.i): r for r in scans.chained_gauges(frame(spark, rows, "chain int, i int, " + ", ".join(f"{c} double" for c in scans.GAUGE)), "chain", ["i"]).collect()}
    assert len(got) == 306
    for k, (point, x) in want.items():
        r = got[k]
        made = r.world_scale * alignment.rotate(np.array([[r.world_qx, r.world_qy, r.world_qz, r.world_qw]]), point[None])[0] + [r.world_tx, r.world_ty, r.world_tz]
        assert made == pytest.approx(x, rel=1e-9, abs=1e-9)
